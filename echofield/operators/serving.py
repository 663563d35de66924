"""What is served: wire packets, status documents, path summaries, counters, guards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Target
from ..functions.columns import d
from .points import rotate
from .windows import path_stride

# The cloud packet's header and point layouts, its magic, version and field bits.
HEADER = np.dtype([("magic", "<u4"), ("version", "<u2"), ("cloud_type", "<u2"), ("stamp_ns", "<u8"), ("point_count", "<u4"), ("fields_mask", "<u4")])
POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("intensity", "<f4"), ("lidar_id", "u1"), ("class_id", "u1"), ("r", "u1"), ("g", "u1"), ("b", "u1")])
MAGIC, VERSION = 0x4D504344, 1
INTENSITY, LIDAR_ID, CLASS_ID, RGB = 1, 2, 4, 8
CURRENT, STABLE = 1, 2


def encode(x, y, z, intensity, lidar_id, cloud_type: int = CURRENT, stamp_ns: int = 0, threshold: float = 180.0) -> bytes:
    """A cloud as one packet: points without finite coordinates are left out, colours are zero."""
    v = np.stack([np.asarray(c, dtype=np.float64) for c in (x, y, z)], axis=1)
    keep = np.isfinite(v).all(axis=1)
    points = np.zeros(int(keep.sum()), dtype=POINT)
    for name, c in zip("xyz", v[keep].T):
        points[name] = c
    light = np.asarray(intensity, dtype=np.float32)[keep]
    points["intensity"], points["lidar_id"] = light, np.clip(np.asarray(lidar_id)[keep], 0, 255)
    points["class_id"] = np.where(light >= threshold, 3, 1 if cloud_type == STABLE else 2)
    head = np.array([(MAGIC, VERSION, cloud_type, stamp_ns, len(points), CLASS_ID | INTENSITY | LIDAR_ID | RGB)], dtype=HEADER)
    return head.tobytes() + points.tobytes()


def decode(data: bytes) -> tuple[dict, np.ndarray]:
    """Header and points; a packet of wrong length, magic or version raises."""
    if len(data) < HEADER.itemsize:
        raise ValueError("packet is shorter than its header")
    head = np.frombuffer(data, dtype=HEADER, count=1)[0]
    if head["magic"] != MAGIC or head["version"] != VERSION or len(data) != HEADER.itemsize + int(head["point_count"]) * POINT.itemsize:
        raise ValueError("not a cloud packet of this version")
    return {n: int(head[n]) for n in HEADER.names}, np.frombuffer(data, dtype=POINT, offset=HEADER.itemsize)


def encode_clouds(points: DataFrame, by: str = "frame_no", order: str = "seq", cloud_type: int = CURRENT, pose: tuple[tuple, tuple] | None = None) -> DataFrame:
    """(by, n, packet): one packet a frame, its points in order and under a pose (quaternion, offset) where one is given. A task
    holds one frame."""
    if pose is not None:
        points = rotate(points, *pose)

    def run(key: tuple, frame: pa.Table) -> pa.Table:
        at = np.argsort(frame[order].to_numpy(), kind="stable")
        data = encode(*(frame[c].to_numpy()[at] for c in ("x", "y", "z", "intensity", "lidar_id")), cloud_type)
        return pa.table({by: pa.array([key[0].as_py()], frame.schema.field(by).type), "n": pa.array([decode(data)[0]["point_count"]], pa.int64()), "packet": pa.array([data], pa.binary())})

    return points.select(by, order, "x", "y", "z", "intensity", "lidar_id").groupBy(by).applyInArrow(run, f"{by} {points.schema[by].dataType.simpleString()}, n long, packet binary")


def decode_clouds(wire: DataFrame, by: str = "frame_no") -> DataFrame:
    """(by, i, x, y, z, intensity, lidar_id, class_id) of each point of each packet."""
    schema = pa.schema([(by, pa.int64()), ("i", pa.int64()), *[(c, pa.float32()) for c in ("x", "y", "z", "intensity")], ("lidar_id", pa.int32()), ("class_id", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p = decode(data)[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), key)), pa.array(np.arange(len(p))), *[pa.array(p[c].copy()) for c in ("x", "y", "z", "intensity")], *[pa.array(p[c].astype(np.int32)) for c in ("lidar_id", "class_id")]], schema=schema)

    return wire.select(F.col(by).cast("long").alias(by), "packet").mapInArrow(run, f"{by} long, i long, x float, y float, z float, intensity float, lidar_id int, class_id int")


# The fields of the status document's parts, the columns that hold them, and what they are before anything came.
_SIDES = ("left_front", "left_rear", "right_front", "right_rear")
POSE_FIELDS = {"valid": ("valid", False), **{c: (c, 0.0) for c in ("x", "y", "z", "qx", "qy", "qz")}, "qw": ("qw", 1.0)}
TARGET_FIELDS = {"stamp_ns": ("stamp_ns", 0), **{c: (c, 0.0) for c in ("center_x_mm", "center_y_mm", "dx_mm", "dy_mm", "velocity_x_mm_s", "velocity_y_mm_s")}, "status": ("status", 2), "status_text": ("status_text", "LOST")}
REVEAL_FIELDS = {"enabled": ("enabled", False), **{c: (c, 0.0) for c in ("machine_s", "revealed_s", "face_wall_s")}, **{c: (c, 0) for c in ("visible_reflector_count", "hidden_reflector_count", "published_face_point_count")}, "reveal_source": ("reveal_source", "none")}
EQUIPMENT_FIELDS = {
    "source": ("source", ""), "quality": ("quality", "LOST"), "invalid_reason": ("reason", "none"), "overall_status": ("status", "LOST"), "stamp_ns": ("stamp_ns", 0),
    "attitude": {"valid": ("attitude_valid", False), **{f"{a}_valid": (f"{a}_valid", False) for a in ("roll", "pitch", "yaw")}, **{f"{a}_deg": (f"{a}_deg", 0.0) for a in ("roll", "pitch", "yaw")}, "ground_points": ("ground_points", 0), "wall_points": ("wall_points", 0)},
    "distances": {"valid": ("distances_valid", False), **{f"{s}_{name}": (f"{s}_{c}", v) for name, c, v in (("valid", "valid", False), ("invalid_reason", "reason", "none"), ("mm", "mm", 0.0), ("points", "points", 0)) for s in _SIDES}},
}


def _columns(fields: dict) -> list[str]:
    return [c for v in fields.values() for c in (_columns(v) if isinstance(v, dict) else [v[0]])]


def _document(fields: dict, row: Column, columns: list[str]) -> list[Column]:
    """Fields in their order; numbers have four decimals at most, what is missing its default."""
    out = []
    for name, spec in fields.items():
        if isinstance(spec, dict):
            out.append(F.struct(*_document(spec, row, columns)).alias(name))
        else:
            value = F.coalesce(row[spec[0]], F.lit(spec[1])) if spec[0] in columns else F.lit(spec[1])
            out.append((F.round(value.cast("double"), 4) if isinstance(spec[1], float) else value).alias(name))
    return out


def status_json(parts: dict[str, tuple[DataFrame, dict]], by: str = "stream", order: str = "seq", path: DataFrame | None = None, most: int = 500) -> DataFrame:
    """(by, json): the status document of each key that any part knows, from the latest row of each part; `seen` says whether a
    part has one. parts: name, then rows (by, order and columns of the fields) and fields. path: by, order, x, y, z of what is
    shown; at most `most` strides of it and its last point are listed."""
    out = None
    for name, (rows, fields) in parts.items():
        wanted = [c for c in dict.fromkeys(_columns(fields)) if c in rows.columns]
        newest = rows.groupBy(by).agg(F.max_by(F.struct(F.lit(True).alias("seen"), *wanted), order).alias(name))
        out = newest if out is None else out.join(newest, by, "full")
    if path is not None:
        shown = path_stride(path, most, by, order).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, "x", "y", "z"))).alias("_p"))
        counted = path.groupBy(by).agg(F.count("*").alias("_n"), F.min_by("x", order).alias("_from"), F.max_by("x", order).alias("_to")).join(shown, by)
        out = counted if out is None else out.join(counted, by, "full")
    documents = []
    for name, (rows, fields) in parts.items():
        documents.append(F.struct(F.coalesce(F.col(name)["seen"], F.lit(False)).alias("seen"), *_document(fields, F.col(name), rows.columns)).alias(name))
    if path is not None:
        points = F.transform(F.coalesce("_p", F.array()), lambda p: F.array(*[F.round(p[c].cast("double"), 4) for c in "xyz"]))
        documents += [points.alias("path"), F.coalesce("_n", F.lit(0)).alias("displayed_path_point_count"), F.size(points).alias("status_path_point_count"), F.round(F.coalesce("_from", d(0)), 4).alias("path_start_s"), F.round(F.coalesce("_to", d(0)), 4).alias("path_end_s")]
    return out.select(by, F.to_json(F.struct(by, *documents)).alias("json"))


def json_int(column: str, key: str, fallback: int) -> Column:
    """A number of a JSON text, rounded; the fallback where it is missing."""
    return F.coalesce(F.round(F.get_json_object(column, f"$.{key}").try_cast("double")).cast("int"), F.lit(fallback))


def json_text(column: str, key: str, fallback: str) -> Column:
    return F.coalesce(F.get_json_object(column, f"$.{key}"), F.lit(fallback))


def drop_reason(zero_stamp: Column, no_frame: Column, n: Column, least: int, missing: Column) -> Column:
    """The first check that a cloud fails on its way into fusion."""
    return F.when(zero_stamp, "zero_stamp").when(no_frame, "empty_frame_id").when(n == 0, "empty").when(n < least, "min_points").when(missing, "missing_field").otherwise("none")


def not_from_the_future(rows: DataFrame, ahead: float, by: str = "stream", order: str = "seq") -> DataFrame:
    """Rows whose stamp is at most `ahead` past the clock, which is the latest stamp before them."""
    clock = F.max("stamp").over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("_clock", clock).where(F.col("_clock").isNull() | (F.col("stamp") <= F.col("_clock") + d(ahead))).drop("_clock")


def path_summary(rows: DataFrame, whole: float, share: float = 0.7) -> DataFrame:
    """Points, span, ends and whether a path covers enough of the whole."""
    per = rows.groupBy("stream").agg(F.count("*").alias("n"), (F.max("v") - F.min("v")).alias("span"), F.min_by("v", "seq").alias("first_v"), F.max_by("v", "seq").alias("last_v"))
    return per.withColumn("complete", F.col("span") >= d(share) * d(whole)).withColumns({c: F.round(c, 6) for c in ("span", "first_v", "last_v")})


#: What the display says for a quality.
QUALITY_TEXT = {"OK": "正常", "DEGRADED": "降级", "INVALID": "无效", "LOST": "离线", "good": "正常", "degraded": "降级", "lost": "离线", "none": "无数据"}


def quality_text(quality: Column) -> Column:
    """The display's word; an unknown quality is shown as it is, a missing one as lost."""
    table = F.create_map(*[F.lit(x) for pair in QUALITY_TEXT.items() for x in pair])
    return F.coalesce(table[quality], quality, F.lit(QUALITY_TEXT["lost"]))


def record(points: DataFrame, path: str, stamp_ns: str = "stamp_ns", by: str = "sensor") -> None:
    """Writes points as Parquet, a folder for each sensor and hour; a sensor's hour is split over files by frame."""
    hours = points.withColumn("hour", F.floor(F.col(stamp_ns) / 3_600_000_000_000))
    hours.write.mode("append").partitionBy(by, "hour").option("maxRecordsPerFile", 5_000_000).parquet(path)


def drop_counters(rows: DataFrame, reason: str = "drop_reason", name: str = "drops") -> tuple[DataFrame, object]:
    """The rows, and an observation that counts them by the checks they failed while something else reads them."""
    from pyspark.sql import Observation

    seen = Observation(name)
    counts = [F.count_if(F.col(reason) == r).alias(r) for r in ("zero_stamp", "empty_frame_id", "empty", "min_points", "missing_field", "none")]
    return rows.observe(seen, F.count("*").alias("all"), *counts), seen


def marker(centres: DataFrame, cfg: Target = Target(), by: str = "frame_no") -> DataFrame:
    """The cylinder that a display draws at each centre (cx, cy): as high as the target's region, in its middle."""
    low, high = cfg.roi_z
    return centres.select(by, F.col("cx").alias("x"), F.col("cy").alias("y"), d((low + high) / 2).alias("z"), d(2 * cfg.mean_radius).alias("diameter"), d(high - low).alias("height"))
