"""Robust aggregates of frames: exact order statistics, principal directions, planes, circles, side distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Geometry, Target
from ..functions.columns import d, finite, norm, within


def upper_median(c: Column) -> Column:
    """Element n // 2 of the sorted values; nothing is interpolated. A frame's values are held, as one frame is bounded."""
    values = F.array_sort(F.collect_list(c))
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def lower_percentile(c: Column, r: float) -> Column:
    """Element floor(r (n - 1)) of the sorted values, null for none."""
    values = F.array_sort(F.collect_list(c))
    return F.get(values, F.floor(d(r) * (F.size(values) - 1)).cast("int"))


def principal_direction(x: Column, y: Column, ok: Column, least: int = 2) -> tuple[Column, Column]:
    """Unit vector of the main axis, turned to x >= 0; null under `least` points."""
    x, y = F.when(ok, x), F.when(ok, y)
    angle = d(0.5) * F.atan2(d(2) * F.covar_pop(x, y), F.var_pop(x) - F.var_pop(y))
    enough = F.count_if(ok) >= least
    sign = F.when(F.cos(angle) < d(0), d(-1)).otherwise(d(1))
    return F.when(enough, sign * F.cos(angle)), F.when(enough, sign * F.sin(angle))


def least_squares_plane(points: DataFrame, by: str = "frame_no") -> DataFrame:
    """z = a x + b y + c for each frame: n, a, b, c, rmse, normal_z; nulls under 3 points or for points on a line."""
    n = F.count("*")
    sums = points.groupBy(by).agg(n.alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"), *[(n * F.covar_pop(p, q)).alias(f"s{p}{q}") for p, q in ("xy", "xz", "yz")], *[(n * F.var_pop(p)).alias(f"s{p}{p}") for p in "xy"])
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    good = (F.col("n") >= 3) & (F.abs(det) > d(1e-12))
    fit = sums.withColumns({"a": F.when(good, (F.col("sxz") * F.col("syy") - F.col("syz") * F.col("sxy")) / det), "b": F.when(good, (F.col("syz") * F.col("sxx") - F.col("sxz") * F.col("sxy")) / det)})
    fit = fit.withColumn("c", F.col("mz") - F.col("a") * F.col("mx") - F.col("b") * F.col("my")).select(by, "n", "a", "b", "c")
    error = F.col("z") - F.col("a") * F.col("x") - F.col("b") * F.col("y") - F.col("c")
    rmse = points.join(fit, by).groupBy(by).agg(F.sqrt(F.avg(error * error)).alias("rmse"))
    return fit.join(rmse, by).withColumn("normal_z", d(1) / F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + d(1)))


def _plane(v: np.ndarray) -> tuple[np.ndarray, float, float] | None:
    """Coefficients, rmse and normal_z of a least-squares plane."""
    mean = v.mean(axis=0)
    x, y, z = (v - mean).T
    det = (x @ x) * (y @ y) - (x @ y) ** 2
    if len(v) < 3 or abs(det) < 1e-12:
        return None
    a, b = ((x @ z) * (y @ y) - (y @ z) * (x @ y)) / det, ((y @ z) * (x @ x) - (x @ z) * (x @ y)) / det
    c = mean[2] - a * mean[0] - b * mean[1]
    return np.array([a, b, c]), float(np.sqrt(((v[:, 2] - v[:, :2] @ [a, b] - c) ** 2).mean())), float(1 / np.sqrt(a * a + b * b + 1))


def ransac(v: np.ndarray, cfg: Geometry) -> dict:
    """The plane with the most inliers by vertical residual over seeded triples, refined by least squares over them."""
    none = {"a": None, "b": None, "c": None, "inliers": 0, "rmse": None, "normal_z": None, "valid": False}
    if len(v) < max(3, cfg.min_ground):
        return none
    picks = np.random.default_rng(cfg.ransac_seed).integers(0, len(v), (cfg.ransac_rounds, 3))
    best, most, limit = None, 0, max(0.02, cfg.max_rmse)
    for i in picks:
        if len(set(i.tolist())) == 3 and (fit := _plane(v[i])) is not None:
            inside = np.abs(v[:, 2] - v[:, :2] @ fit[0][:2] - fit[0][2]) <= limit
            if inside.sum() > most:
                best, most = inside, int(inside.sum())
    if best is None or (fit := _plane(v[best])) is None:
        return none
    (a, b, c), rmse, normal = fit
    return {"a": float(a), "b": float(b), "c": float(c), "inliers": most, "rmse": rmse, "normal_z": normal, "valid": most >= cfg.min_ground and rmse <= cfg.max_rmse and normal >= cfg.min_normal_z}


def ransac_plane(points: DataFrame, cfg: Geometry = Geometry(), by: str = "frame_no") -> DataFrame:
    """One row a frame. The draws are seeded and the points sorted, so reruns agree."""
    kind = points.schema[by].dataType.simpleString()

    def run(key: tuple, frame: pa.Table) -> pa.Table:
        v = np.stack([frame[c].to_numpy() for c in ("x", "y", "z")], axis=1).astype(np.float64)
        found = ransac(v[np.lexsort(v.T)], cfg)
        return pa.table({by: [key[0].as_py()], **{k: [x] for k, x in found.items()}}, schema=pa.schema([(by, frame.schema.field(by).type), *[(k, pa.float64()) for k in "abc"], ("inliers", pa.int64()), ("rmse", pa.float64()), ("normal_z", pa.float64()), ("valid", pa.bool_())]))

    return points.select(by, "x", "y", "z").groupBy(by).applyInArrow(run, f"{by} {kind}, a double, b double, c double, inliers long, rmse double, normal_z double, valid boolean")


def in_ground(cfg: Geometry) -> Column:
    return finite(F.col("x"), F.col("y"), F.col("z")) & within(F.col("x"), cfg.ground_x) & within(F.col("y"), cfg.ground_y) & within(F.col("z"), cfg.ground_z)


def ground_region(points: DataFrame, cfg: Geometry) -> DataFrame:
    return points.where(in_ground(cfg))


def wall_aggregates(cfg: Geometry) -> list[Column]:
    """wall_points and the direction of each wall, both walls apart."""
    wall = finite(F.col("x"), F.col("y"), F.col("z")) & within(F.col("x"), cfg.wall_x) & within(F.abs(F.col("y")), cfg.wall_y_abs) & within(F.col("z"), cfg.wall_z)
    lx, ly = principal_direction(F.col("x"), F.col("y"), wall & (F.col("y") >= 0), max(2, cfg.min_wall))
    rx, ry = principal_direction(F.col("x"), F.col("y"), wall & (F.col("y") < 0), max(2, cfg.min_wall))
    return [F.count_if(wall).alias("wall_points"), lx.alias("left_x"), ly.alias("left_y"), rx.alias("right_x"), ry.alias("right_y")]


def with_yaw(sides: DataFrame, cfg: Geometry) -> DataFrame:
    """directions, diff_deg, consistent and yaw_deg beside the walls' directions."""
    dot = F.greatest(d(-1), F.least(d(1), F.col("left_x") * F.col("right_x") + F.col("left_y") * F.col("right_y")))
    both = F.col("left_x").isNotNull() & F.col("right_x").isNotNull()
    zero = d(0)
    sx, sy = (F.coalesce(F.col(f"left_{c}"), zero) + F.coalesce(F.col(f"right_{c}"), zero) for c in "xy")
    out = sides.withColumn("directions", F.col("left_x").isNotNull().cast("int") + F.col("right_x").isNotNull().cast("int"))
    out = out.withColumn("diff_deg", F.when(both, F.degrees(F.acos(F.abs(dot)))).otherwise(zero)).withColumn("consistent", F.col("diff_deg") <= d(cfg.max_wall_diff_deg))
    return out.withColumn("yaw_deg", F.when((F.col("directions") > 0) & (norm(sx, sy) > d(1e-6)), F.degrees(F.atan2(sy, sx))))


def wall_yaw(points: DataFrame, cfg: Geometry = Geometry(), by: str = "frame_no") -> DataFrame:
    return with_yaw(points.groupBy(by).agg(*wall_aggregates(cfg)), cfg)


def at_station(cfg: Geometry, x: float, side: int) -> Column:
    half = max(0.01, cfg.window_m * 0.5)
    return finite(F.col("x"), F.col("y"), F.col("z")) & (F.abs(F.col("x") - d(x)) <= d(half)) & within(F.col("z"), cfg.side_z) & within(d(side) * F.col("y"), cfg.side_y_abs)


def station_aggregates(cfg: Geometry) -> list[Column]:
    """The sorted side distances at each station, of one frame."""
    return [F.array_sort(F.collect_list(F.when(at_station(cfg, x, side), d(side) * F.col("y")))).alias(f"{name}_seen") for name, x, side in cfg.stations]


def clearance(seen: Column, cfg: Geometry) -> Column:
    """points, clearance_m, mm, valid and reason from the sorted distances at a station."""
    n = F.size(seen)
    enough = n >= cfg.min_distance
    wall = F.get(seen, F.floor(d(cfg.percentile) * (n - 1)).cast("int"))
    clear = F.when(enough, wall - d(max(0.0, cfg.half_width_m))).otherwise(d(0))
    valid = enough & (clear >= d(cfg.min_clearance_m))
    reason = F.when(~enough, "LOW_DISTANCE_POINTS").when(~valid, "CLEARANCE_INVALID").otherwise("none")
    return F.struct(n.alias("points"), clear.alias("clearance_m"), (clear * d(1000)).alias("mm"), valid.alias("valid"), reason.alias("reason"))


def side_clearance(points: DataFrame, cfg: Geometry = Geometry(), by: str = "frame_no") -> DataFrame:
    """One row for each frame and station. The four stations are conditions in one aggregation, so no join is needed."""
    seen = points.groupBy(by).agg(*station_aggregates(cfg))
    each = F.array(*[F.struct(F.lit(name).alias("station"), clearance(F.col(f"{name}_seen"), cfg).alias("c")) for name, _, _ in cfg.stations])
    return seen.select(by, F.explode(each).alias("s")).select(by, "s.station", "s.c.*")


def target_centre(points: DataFrame, cfg: Target = Target(), by: str | tuple[str, ...] = "frame_no") -> DataFrame:
    """cx, cy, candidates, inliers, rms and reason of each frame: every point is moved outward by the known radius along its
    line of sight, the medians of the moved points are the centre, and points at about the radius from it are inliers."""
    r, keys = cfg.mean_radius, [by] if isinstance(by, str) else list(by)
    flat = norm(F.col("x"), F.col("y"))
    seen = F.when(flat > d(1e-6), F.lit(True))
    moved = points.withColumns({"_mx": F.when(seen, F.col("x") + d(r) * F.col("x") / flat), "_my": F.when(seen, F.col("y") + d(r) * F.col("y") / flat)})
    centre = moved.groupBy(*keys).agg(F.count("*").alias("n"), F.count("_mx").alias("candidates"), upper_median(F.col("_mx")).alias("cx"), upper_median(F.col("_my")).alias("cy"))
    off = F.abs(norm(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) - d(r))
    inside = off <= d(cfg.tolerance)
    fit = points.join(centre, keys).groupBy(*keys, "n", "candidates", "cx", "cy").agg(F.count_if(inside).alias("inliers"), F.sqrt(F.avg(F.when(inside, off * off))).alias("rms"))
    reason = F.when(F.col("n") < cfg.min_points, "not_enough_reflector_points").when(F.col("n") < 3, "not_enough_circle_points").when(F.col("candidates") < 3, "not_enough_center_candidates").when(~finite(F.col("cx"), F.col("cy")), "invalid_center_estimate").when(F.col("inliers") < 3, "not_enough_front_surface_inliers").otherwise("none")
    return fit.withColumn("reason", reason).withColumn("detected", F.col("reason") == "none")
