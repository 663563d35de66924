"""Whole flows: packets to fused frames, and frames to a target's track."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Equipment, Fusion, Target, Tracker
from ..functions.columns import d
from ..operators import equipment, joins, ordered, packets, points, robust
from ..schemas import validate


def sensor_points(raw: DataFrame, calibration: DataFrame, low: float, high: float, thresholds: tuple[float, ...] = (10.0, 10.0, 10.0, 10.0)) -> DataFrame:
    """Packets decoded, denoised by ring and only then gated by range: the denoiser sees every return."""
    decoded = packets.decode(raw, calibration).withColumn("seq", F.col("packet_no") * 384 + F.col("block") * 32 + F.col("firing") * 16 + F.col("laser_id"))
    clean = points.ring_denoise(decoded, thresholds)
    return clean.where((F.col("distance") >= low) & (F.col("distance") <= high))


def fused(clouds: DataFrame, cloud_points: DataFrame, transforms: DataFrame, sensors: list[str], cfg: Fusion = Fusion()) -> DataFrame:
    """Synchronised clouds as one in the common frame. clouds: stream, sensor, seq, stamp; cloud_points: stream, sensor,
    cloud_seq, seq, x, y, z, intensity, ring, time. A cloud that is too small drops its group."""
    validate(cloud_points)
    sizes = cloud_points.groupBy("stream", "sensor", "cloud_seq").agg(F.count("*").alias("n")).where(F.col("n") >= max(1 if cfg.drop_empty else 0, cfg.min_points))
    usable = clouds.join(sizes.select("stream", "sensor", F.col("cloud_seq").alias("seq")), ["stream", "sensor", "seq"])
    groups = joins.synchronised(usable, sensors, cfg.slop_s)
    members = groups.select("stream", F.col("stamp").alias("out_stamp"), F.explode(F.array(*[F.struct(F.lit(s).alias("sensor"), F.lit(i).alias("cloud"), F.col(f"seq_{i}").alias("cloud_seq")) for i, s in enumerate(sensors)])).alias("m")).select("stream", "out_stamp", "m.*")
    stamped = members.join(clouds.select("stream", "sensor", F.col("seq").alias("cloud_seq"), "stamp"), ["stream", "sensor", "cloud_seq"])
    joined = cloud_points.join(stamped, ["stream", "sensor", "cloud_seq"]).withColumn("time", F.col("time") + F.col("stamp") - F.col("out_stamp"))
    return points.rigid(joined, transforms)


def target_track(frames: DataFrame, stamps: DataFrame, cfg: Target = Target(), tracker: Tracker = Tracker()) -> DataFrame:
    """frames: stream, frame_no, seq, x, y, z, intensity; stamps: stream, frame_no, stamp. Streams may number their frames
    alike. A frame without a detection is a miss; a frame without any point is one too."""
    frame = ("stream", "frame_no")
    region = points.target_region(frames, cfg)
    small = points.voxel_centroid(region, cfg.leaf, frame).select(*frame, "x", "y", "z", "intensity")
    centre = robust.target_centre(points.outliers_removed(small, cfg.sor_k, cfg.sor_sigma, frame), cfg, frame)
    seen = stamps.join(centre, list(frame), "left")
    zero = F.lit(0.0)
    rows = seen.select("stream", F.col("frame_no").alias("seq"), "stamp", F.coalesce("detected", F.lit(False)).alias("detected"), F.coalesce("cx", zero).alias("cx"), F.coalesce("cy", zero).alias("cy"), F.coalesce("inliers", F.lit(0)).alias("inliers"), F.coalesce("rms", zero).alias("rms"))
    return ordered.tracked(rows, tracker)


def fused_at(clouds: DataFrame, cloud_points: DataFrame, poses: DataFrame, sensors: list[str], cfg: Fusion = Fusion()) -> DataFrame:
    """As fused, with poses over time: sensor, at and a pose from then on. A cloud without a pose within cfg.tf_wait_s of its
    stamp drops its whole group."""
    usable = clouds.select("stream", "sensor", F.col("seq").alias("cloud_seq"), "stamp")
    groups = joins.synchronised(clouds, sensors, cfg.slop_s)
    members = groups.select("stream", F.col("stamp").alias("out_stamp"), F.explode(F.array(*[F.struct(F.lit(s).alias("sensor"), F.col(f"seq_{i}").alias("cloud_seq")) for i, s in enumerate(sensors)])).alias("m")).select("stream", "out_stamp", "m.*").join(usable, ["stream", "sensor", "cloud_seq"])
    found = joins.as_of(members, poses.select("sensor", F.col("at"), F.col("at").alias("since")), "sensor", "stamp", "since")
    there = F.coalesce(F.col("stamp") - F.col("since") <= d(cfg.tf_wait_s), F.lit(False))
    whole = found.groupBy("stream", "out_stamp").agg(F.bool_and(there).alias("ok")).where("ok").select("stream", "out_stamp")
    kept = members.join(whole, ["stream", "out_stamp"])
    joined = cloud_points.join(kept, ["stream", "sensor", "cloud_seq"]).withColumn("time", F.col("time") + F.col("stamp") - F.col("out_stamp"))
    return points.rigid_at(joined, kept.select("stream", "sensor", "cloud_seq", "stamp"), poses, unit=("stream", "sensor", "cloud_seq"))


def equipment_track(cloud: DataFrame, inputs: DataFrame, cfg: Equipment = Equipment(), robust_plane: bool = True) -> DataFrame:
    """Equipment states in the order of frames: geometry, then the input cascade, then the filters of angles and distances with
    their memory, and the downgrade after a jump. cloud: frame_no, seq, x, y, z; inputs: frame_no, n, age_s, failure."""
    states = equipment.with_input(equipment.geometry(cloud, cfg.geometry, robust_plane, inputs), inputs, cfg)
    return equipment.filtered(states.withColumn("stream", F.lit(0)), cfg).drop("stream")
