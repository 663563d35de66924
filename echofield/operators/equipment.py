"""Equipment state of each frame: attitude from ground and walls, side distances, and the status cascade."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Equipment, Geometry
from ..functions.columns import d, finite
from .ordered import fold, smooth_angle, smooth_distance
from .robust import clearance, ground_region, in_ground, least_squares_plane, ransac_plane, station_aggregates, wall_aggregates, with_yaw
from .windows import seen_and_missed

STATIONS = ("left_front", "left_rear", "right_front", "right_rear")


def ground_reason(enough: Column, inliers: Column, rmse: Column, normal_z: Column, cfg: Geometry) -> Column:
    return F.when(~enough, "LOW_GROUND_POINTS").when(inliers < cfg.min_ground, "RANSAC_FAILED").when(rmse > d(cfg.max_rmse), "HIGH_GROUND_RMSE").when(normal_z < d(cfg.min_normal_z), "BAD_GROUND_NORMAL").otherwise("RANSAC_FAILED")


def plane_of(ground: DataFrame, cfg: Geometry, robust: bool) -> DataFrame:
    """a, b, inliers, rmse, normal_z and valid of each frame, by RANSAC or by least squares over all its ground points."""
    if robust:
        return ransac_plane(ground, cfg)
    fit = least_squares_plane(ground)
    good = (F.col("n") >= cfg.min_ground) & (F.col("rmse") <= d(cfg.max_rmse)) & (F.col("normal_z") >= d(cfg.min_normal_z))
    return fit.select("frame_no", "a", "b", F.col("n").alias("inliers"), "rmse", "normal_z", F.coalesce(good, F.lit(False)).alias("valid"))


def geometry(points: DataFrame, cfg: Geometry = Geometry(), robust: bool = True, frames: DataFrame | None = None) -> DataFrame:
    """One row a frame: attitude, clearances, validity, reasons and overall status. Frames of `frames` without points stay.
    All but the plane comes from one aggregation over the points."""
    frame = points.groupBy("frame_no").agg(F.count_if(in_ground(cfg)).alias("in_ground"), *wall_aggregates(cfg), *station_aggregates(cfg))
    sides = {s: clearance(F.coalesce(F.col(f"{s}_seen"), F.array().cast("array<double>")), cfg) for s in STATIONS}
    seen = with_yaw(frame, cfg) if frames is None else frames.select("frame_no").distinct().join(with_yaw(frame, cfg), "frame_no", "left")
    out = seen.join(plane_of(ground_region(points, cfg), cfg, robust), "frame_no", "left")
    false = F.lit(False)
    out = out.withColumns({"in_ground": F.coalesce("in_ground", F.lit(0)), "wall_points": F.coalesce("wall_points", F.lit(0)), "plane": F.coalesce("valid", false), **{f"_{s}": c for s, c in sides.items()}})
    out = out.withColumns({f"{s}_{c}": F.col(f"_{s}.{c}") for s in STATIONS for c in ("points", "mm", "valid", "reason")})
    enough = F.col("in_ground") >= cfg.min_ground
    why_ground = ground_reason(enough, F.coalesce("inliers", F.lit(0)), F.col("rmse"), F.col("normal_z"), cfg)
    yaw = F.coalesce(finite(F.col("yaw_deg")) & F.col("consistent"), false)
    why_yaw = F.when(F.coalesce("directions", F.lit(0)) == 0, "LOW_WALL_POINTS").when(F.col("consistent"), "PCA_FAILED").otherwise("PCA_INCONSISTENT")
    out = out.withColumns({"yaw_valid": yaw, "ground_reason": F.when(F.col("plane"), "none").otherwise(why_ground), "yaw_reason": F.when(yaw, "none").otherwise(why_yaw)})
    valid = [F.col(f"{s}_valid") for s in STATIONS]
    all_of, any_of = valid[0] & valid[1] & valid[2] & valid[3], valid[0] | valid[1] | valid[2] | valid[3]
    some = F.col("plane") | F.col("yaw_valid")
    status = F.when(F.col("plane") & F.col("yaw_valid") & all_of, "OK").when(some | any_of, "DEGRADED").otherwise("INVALID")
    is_one = lambda reason: F.exists(F.array(*[F.col(f"{s}_reason") for s in STATIONS]), lambda r: r == reason)
    head = F.when(F.col("ground_reason") != "none", F.col("ground_reason")).when(F.col("yaw_reason") != "none", F.col("yaw_reason"))
    reason = F.when(F.col("status") == "OK", "none").when(F.col("status") == "INVALID", head.otherwise("NO_VALID_OUTPUT")).otherwise(head.when(is_one("LOW_DISTANCE_POINTS"), "LOW_DISTANCE_POINTS").when(is_one("CLEARANCE_INVALID"), "CLEARANCE_INVALID").otherwise("PARTIAL_VALID"))
    out = out.withColumns({"attitude_valid": some, "distances_valid": all_of, "status": status}).withColumn("reason", reason)
    zero = d(0)
    angles = {"pitch_deg": F.when(F.col("plane"), F.degrees(F.atan(F.col("a")))).otherwise(zero), "roll_deg": F.when(F.col("plane"), F.degrees(F.atan(-F.col("b")))).otherwise(zero), "yaw_deg": F.coalesce("yaw_deg", zero), "ground_points": F.when(F.col("plane"), F.col("inliers")).otherwise(F.col("in_ground"))}
    return out.withColumns(angles).select("frame_no", "status", "reason", "attitude_valid", "distances_valid", F.col("plane").alias("roll_valid"), F.col("plane").alias("pitch_valid"), "yaw_valid", "roll_deg", "pitch_deg", "yaw_deg", "ground_points", "wall_points", "ground_reason", "yaw_reason", *[f"{s}_{c}" for s in STATIONS for c in ("points", "mm", "valid", "reason")])


def input_reason(n: Column, age_s: Column, failure: Column, cfg: Equipment) -> Column:
    """Why a frame's input cannot be used, or null. The clock is a column: nothing here reads the time."""
    return F.when(failure != "", failure).when(n == 0, "NO_POINTCLOUD").when(n < cfg.geometry.min_total, "LOW_TOTAL_POINTS").when((F.lit(cfg.max_age_s) > 0) & finite(age_s) & (age_s > d(cfg.max_age_s)), "POINTCLOUD_STALE")


def with_input(states: DataFrame, inputs: DataFrame, cfg: Equipment = Equipment()) -> DataFrame:
    """States under the input cascade: a bad input makes a frame LOST and everything in it invalid. inputs: frame_no, n, age_s,
    failure (empty for none)."""
    joined = states.join(inputs.select("frame_no", input_reason(F.col("n"), F.col("age_s"), F.coalesce("failure", F.lit("")), cfg).alias("_why")), "frame_no", "left")
    lost = F.col("_why").isNotNull()
    changed = {"status": F.when(lost, "LOST").otherwise(F.col("status")), "reason": F.when(lost, F.col("_why")).otherwise(F.col("reason"))}
    for c in states.columns:
        if c.endswith("_valid"):
            changed[c] = F.col(c) & ~lost
        elif c.endswith("_reason"):
            changed[c] = F.when(lost, F.col("_why")).otherwise(F.col(c))
    return joined.withColumns(changed).select(*states.columns)


def sensor_status(ins_on: Column, radar_on: Column, ins_ok: Column, radar_ok: Column) -> tuple[Column, Column]:
    """Overall status and reason of a reference sensor of two groups."""
    got = (ins_on & ins_ok) | (radar_on & radar_ok)
    every = (~ins_on | ins_ok) & (~radar_on | radar_ok)
    on = ins_on | radar_on
    return F.when(~on, "LOST").when(every, "OK").when(got, "DEGRADED").otherwise("LOST"), F.when(~on, "SENSOR_DISABLED").when(every, "none").otherwise("TCP_READ_FAILED")


def jump_downgrade(status: Column, reason: Column, attitude_valid: Column, jumped: Column) -> tuple[Column, Column]:
    """A rejected distance jump lowers the status only where nothing worse is said already."""
    applies = jumped & reason.isin("none", "PARTIAL_VALID")
    return F.when(applies, F.when(attitude_valid, "DEGRADED").otherwise("INVALID")).otherwise(status), F.when(applies, "DISTANCE_JUMP_REJECTED").otherwise(reason)


def diagnostics_level(status: Column) -> Column:
    return F.when(status == "GOOD", 0).when(status == "DEGRADED", 1).otherwise(2)


ANGLES = (("roll", False), ("pitch", False), ("yaw", True))
_FILTERED = [*(f"{a}_deg double" for a, _ in ANGLES), *(f"{s}_{c}" for s in STATIONS for c in ("mm double", "valid boolean", "reason string")), "attitude_valid boolean", "distances_valid boolean", "status string", "reason string"]


def filter_step(memory: dict, row: dict, cfg: Equipment) -> tuple:
    """One state through the filters, angles before distances. Invalid values pass and leave the memory alone."""
    out = []
    for angle, wraps in ANGLES:
        value = row[f"{angle}_deg"]
        if row[f"{angle}_valid"] and value is not None and math.isfinite(value):
            value, _ = smooth_angle(memory.setdefault(angle, {}), value, cfg.angle_alpha, cfg.max_angle_jump_deg, wraps)
        out.append(value)
    attitude, every, jumped = any(row[f"{a}_valid"] for a, _ in ANGLES), True, False
    for s in STATIONS:
        value, valid, reason = (row[f"{s}_{c}"] for c in ("mm", "valid", "reason"))
        if valid:
            value, valid = smooth_distance(memory.setdefault(s, {}), value, cfg.distance_alpha, 1000 * cfg.max_distance_jump_m)
            reason, jumped = (reason, jumped) if valid else ("DISTANCE_JUMP_REJECTED", True)
        out += [value, bool(valid), reason]
        every = every and bool(valid)
    status, reason = row["status"], row["reason"]
    if jumped and reason in ("none", "PARTIAL_VALID"):
        status, reason = "DEGRADED" if attitude else "INVALID", "DISTANCE_JUMP_REJECTED"
    return (*out, attitude, every, status, reason)


def filtered(states: DataFrame, cfg: Equipment = Equipment(), by: str = "stream", order: tuple[str, ...] = ("frame_no",)) -> DataFrame:
    """States with smoothed angles and distances; a distance that jumps is invalid and may lower the status. by, order, angles,
    the stations' mm, valid and reason, attitude_valid, distances_valid, status, reason."""
    reads = (*(f"{a}_{c}" for a, _ in ANGLES for c in ("deg", "valid")), *(f"{s}_{c}" for s in STATIONS for c in ("mm", "valid", "reason")), "status", "reason")
    return fold(states, by, order, dict, lambda m, r: filter_step(m, r, cfg), ", ".join(_FILTERED), reads)


def diagnostics(rows: DataFrame, by: str = "stream", order: str = "seq") -> DataFrame:
    """Diagnostic messages: level, the reason as the message, and counters and values as text. rows: by, order, status, detected,
    inliers, rms, reason."""
    counted = seen_and_missed(rows, by=by, order=order)
    values = {"frames_seen": "frames_seen", "frames_missed": "frames_missed", "status": "status", "inliers": "inliers", "residual_rms": "rms"}
    pairs = F.create_map(*[x for k, c in values.items() for x in (F.lit(k), F.col(c).cast("string"))])
    return counted.select(by, order, diagnostics_level(F.col("status")).alias("level"), F.col("reason").alias("message"), pairs.alias("values"))
