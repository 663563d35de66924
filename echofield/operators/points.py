"""Filters, transforms, voxels and denoising over point tables. (frame_no, seq) orders the points of a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Target
from ..functions.columns import azimuth_centideg, cell, d, finite, in_sector, norm, quaternion_rows, within
from .joins import as_of

XYZ = ("x", "y", "z")


def xyz() -> list[Column]:
    return [F.col(c) for c in XYZ]


def finite_points(points: DataFrame) -> DataFrame:
    return points.where(finite(*xyz()))


def target_region(points: DataFrame, cfg: Target = Target()) -> DataFrame:
    """Finite points in the box whose intensity is above, not at, the threshold."""
    box = within(F.col("x"), cfg.roi_x) & within(F.col("y"), cfg.roi_y) & within(F.col("z"), cfg.roi_z)
    return finite_points(points).where(box & (F.col("intensity") > d(cfg.intensity_above)))


def range_gate(points: DataFrame, low: float, high: float) -> DataFrame:
    return points.withColumn("distance", norm(*xyz())).where(within(F.col("distance"), (low, high)))


def ring_mask(points: DataFrame, hidden: list[int], left: tuple[int, int], right: tuple[int, int]) -> DataFrame:
    """Points of the hidden rings stay only inside the two sectors; other rings stay whole."""
    az = azimuth_centideg(F.col("x"), F.col("y"))
    return points.withColumn("azimuth", az).where(~F.col("ring").isin(hidden) | in_sector(F.col("azimuth"), *left) | in_sector(F.col("azimuth"), *right))


def organised(points: DataFrame, low: float, high: float) -> DataFrame:
    """Keeps every slot; points out of range become NaN."""
    inside = within(norm(*xyz()), (low, high))
    return points.withColumns({c: F.when(inside, F.col(c)).otherwise(d(float("nan"))) for c in XYZ})


def apply_rows(rows: list[list[Column]], offset: list[Column]) -> dict[str, Column]:
    x, y, z = xyz()
    return {c: r[0] * x + r[1] * y + r[2] * z + t for c, r, t in zip(XYZ, rows, offset)}


def rigid(points: DataFrame, transforms: DataFrame, key: str = "sensor", target: str | None = None) -> DataFrame:
    """Points in the target frame. transforms: key, m00 .. m22, tx, ty, tz; one row a sensor, as many as there are sensors.
    Points whose key is the target are there already; those of a sensor without a transform are dropped with its cloud."""
    rows = [[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)]
    moved = apply_rows(rows, [F.col(t) for t in ("tx", "ty", "tz")])
    if target is None:
        return points.join(transforms, key).withColumns(moved).select(*points.columns)
    there = F.col(key).cast("string") == F.lit(target)
    kept = points.join(transforms.withColumn("_known", F.lit(True)), key, "left").where(there | F.col("_known"))
    return kept.withColumns({c: F.when(there, F.col(c)).otherwise(v) for c, v in moved.items()}).select(*points.columns)


#: A pose that holds from a stamp on.
POSE = ("qx", "qy", "qz", "qw", "tx", "ty", "tz")


def rigid_at(points: DataFrame, stamps: DataFrame, poses: DataFrame, by: str = "sensor", unit: tuple[str, ...] = ("sensor", "packet_no"), max_wait: float | None = None) -> DataFrame:
    """Points under the pose that held at the stamp of their packet or cloud. stamps: unit, stamp; poses: by, at, POSE. A unit
    without a pose is dropped, and so is one whose pose is older than max_wait."""
    known = poses.select(by, "at", F.struct("at", *POSE).alias("pose"))
    found = as_of(stamps.select(*unit, "stamp"), known, by, "stamp", "pose").where("pose IS NOT NULL")
    if max_wait is not None:
        found = found.where(F.col("stamp") - F.col("pose.at") <= d(max_wait))
    valid, rows = quaternion_rows(*[F.col(f"pose.{c}") for c in POSE[:4]])
    joined = points.join(found.select(*unit, "pose"), list(unit)).where(valid)
    return joined.withColumns(apply_rows(rows, [F.col(f"pose.{c}") for c in POSE[4:]])).select(*points.columns)


def rotate(points: DataFrame, quaternion: tuple, offset: tuple) -> DataFrame:
    """Points under a pose; a quaternion without length leaves nothing."""
    valid, rows = quaternion_rows(*(q if isinstance(q, Column) else d(q) for q in quaternion))
    return points.where(valid).withColumns(apply_rows(rows, [d(t) for t in offset]))


def concatenated(clouds: list[DataFrame]) -> DataFrame:
    """One cloud of several, in the order given: cloud, then seq."""
    out = None
    for i, c in enumerate(clouds):
        c = c.withColumn("cloud", F.lit(i))
        out = c if out is None else out.unionByName(c)
    return out


def voxel_first(points: DataFrame, leaf: float, by: tuple[str, ...] = ("frame_no",), order: str = "seq") -> DataFrame:
    """The first point of each voxel, where order tells a frame's points apart. Minima by order combine before the shuffle, in
    hash aggregation as long as the columns are numbers, so nothing is sorted."""
    others = [c for c in points.columns if c not in (*by, order)]
    keys = [cell(F.col(c), leaf).alias(f"_i{c}") for c in XYZ]
    first = points.groupBy(*by, *keys).agg(F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in others])
    return first.select(*points.columns)


def voxel_first_capped(points: DataFrame, leaf: float, most: int, by: tuple[str, ...] = ("frame_no",), order: str = "seq") -> DataFrame:
    """As voxel_first, and of a frame's voxels the first `most`; leaf 0 caps the points themselves."""
    kept = voxel_first(points, leaf, by, order) if leaf > 0 else points
    rank = F.row_number().over(W.partitionBy(*by).orderBy(order))
    return kept.withColumn("_n", rank).where(F.col("_n") <= most).drop("_n")


def voxel_centroid(points: DataFrame, leaf: float, by: tuple[str, ...] = ("frame_no",)) -> DataFrame:
    """The mean of all fields of each voxel's points, and their number."""
    keys = [cell(F.col(c), leaf).alias(f"i{c}") for c in XYZ]
    return points.groupBy(*by, *keys).agg(*[F.avg(c).alias(c) for c in (*XYZ, "intensity")], F.count("*").alias("n"))


#: Upper ends of the distance bands, and a band's factor.
BANDS = ((2.56, 8), (5.12, 26), (10.24, 48), (float("inf"), 1024))


def ring_denoise(points: DataFrame, thresholds: tuple[float, ...], by: tuple[str, ...] = ("sensor", "ring"), order: str = "seq", distance: str = "distance", width: int | None = None) -> DataFrame:
    """The point two before each arrival, where both its neighbours are near it in distance. The arrival's own distance picks
    the band. The last two points of a ring never pass, nor does the first. With a width, a ring is cut by order into buckets
    that run in parallel, each with the three points before it."""
    keys = [*by, "_b"]
    cut = points.withColumns({"_b": F.floor(F.col(order) / F.lit(width)) if width else F.lit(0), "_own": F.lit(True)})
    if width:
        end = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))
        ends = cut.withColumn("_n", end).where("_n <= 3").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, F.struct(*points.columns).alias("_p")))).alias("_ends"))
        before = W.partitionBy(*by).orderBy("_b").rowsBetween(-3, -1)
        led = ends.select("_b", F.flatten(F.collect_list("_ends").over(before)).alias("_e")).where(F.size("_e") > 0)
        halo = led.select("_b", F.explode(F.slice("_e", -F.least(F.size("_e"), F.lit(3)), F.lit(3))).alias("_e"))
        cut = cut.unionByName(halo.select("_e._p.*", "_b", F.lit(False).alias("_own")))
    w = W.partitionBy(*keys).orderBy(order)
    now, limit = F.col(distance), d(0.1 * thresholds[-1] * BANDS[-1][1])
    for (end, factor), t in reversed(list(zip(BANDS[:-1], thresholds[:-1]))):
        limit = F.when(now < d(end), d(0.1 * t * factor)).otherwise(limit)  # 48 * 0.1 * 10 is above 48
    d1, d2, d3 = (F.lag(distance, k).over(w) for k in (1, 2, 3))
    mid = F.lag(F.struct(*points.columns), 2).over(w)
    near = (d(200) * F.abs(d3 - d2) < limit) & (d(200) * F.abs(d1 - d2) < limit)
    return cut.withColumns({"_mid": mid, "_ok": near & d3.isNotNull()}).where("_ok AND _own").select("_mid.*")


def nearest_means(v, k: int, direct: int = 1024):
    """The mean distance of each point to its k nearest others, by a grid whose search widens until no nearer point can lie
    outside. v: (n, 3), more than k points."""
    import numpy as np

    def means(some, all_):
        gaps = np.sqrt(((some[:, None] - all_[None]) ** 2).sum(axis=2))
        part = np.partition(gaps, k, axis=1)[:, : k + 1]
        return part.sum(axis=1) / k, part[:, k]

    n, low = len(v), v.min(axis=0)
    out, extent = np.empty(n), np.sort(v.max(axis=0) - low)[::-1]
    # Points of a scan lie on surfaces: cells hold about k of them.
    size = float(np.sqrt(max(extent[0] * max(extent[1], extent[0] * 1e-3), 0.0) * k / n))
    if n <= direct or not size > 0:
        for a in range(0, n, 256):
            out[a : a + 256] = means(v[a : a + 256], v)[0]
        return out
    cells = np.floor((v - low) / size).astype(np.int64)
    shape = cells.max(axis=0) + 1
    key = (cells[:, 0] * shape[1] + cells[:, 1]) * shape[2] + cells[:, 2]
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    for a, b in zip(starts, np.append(starts[1:], n)):
        left, (x, y, z), reach = order[a:b], cells[order[a]], 1
        while len(left):
            xs, ys = (np.arange(max(0, c - reach), min(top, c + reach + 1)) for c, top in ((x, shape[0]), (y, shape[1])))
            rows = ((xs[:, None] * shape[1] + ys[None]) * shape[2]).ravel()
            first, last = np.searchsorted(key, rows + max(0, z - reach)), np.searchsorted(key, rows + min(shape[2], z + reach + 1))
            near = np.concatenate([order[i:j] for i, j in zip(first, last)])
            if len(near) > k:
                rest = []
                for i in range(0, len(left), 256):
                    some = left[i : i + 256]
                    mean, furthest = means(v[some], v[near])
                    sure = (furthest <= reach * size) | (len(near) == n)
                    out[some[sure]] = mean[sure]
                    rest.append(some[~sure])
                left = np.concatenate(rest)
            reach *= 2
    return out


def outliers_removed(points: DataFrame, k: int, sigma: float, by: str | tuple[str, ...] = "frame_no") -> DataFrame:
    """Statistical outlier removal: points whose mean distance to their k nearest is within sigma deviations of the mean.
    Frames of k points or fewer stay as they are. A task takes one frame, which its sensor bounds."""
    import numpy as np
    import pyarrow as pa

    def run(frame: pa.Table) -> pa.Table:
        v = np.stack([frame[c].to_numpy() for c in XYZ], axis=1)
        if len(v) <= k:
            return frame
        mean = nearest_means(v, k)
        return frame.filter(pa.array(mean <= mean.mean() + sigma * mean.std(ddof=1)))

    return points.groupBy(*([by] if isinstance(by, str) else by)).applyInArrow(run, points.schema)


def boxes(points: DataFrame, by: tuple[str, ...] = ("layer",)) -> DataFrame:
    """The bounding box of each layer's finite points: by, x_min, x_max and so on, and their number."""
    ends = [f(c).alias(f"{c}_{name}") for c in XYZ for name, f in (("min", F.min), ("max", F.max))]
    return finite_points(points).groupBy(*by).agg(*ends, F.count("*").alias("n"))


def union_box(layers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The box around the boxes of layers that have points."""
    ends = [f(f"{c}_{name}").alias(f"{c}_{name}") for c in XYZ for name, f in (("min", F.min), ("max", F.max))]
    return layers.where(F.col("n") > 0).groupBy(*by).agg(*ends, F.sum("n").alias("n"))


def legacy_union(clouds: DataFrame, transforms: DataFrame, target: str, by: str = "stream") -> DataFrame:
    """The older fusion: all clouds of a group in the target frame, one of them as it is where its frame is the target, in order
    of cloud and seq, under the latest stamp. clouds: by, cloud, sensor (its frame), stamp, seq, x, y, z and other fields."""
    latest = clouds.groupBy(by).agg(F.max("stamp").alias("out_stamp"))
    return rigid(clouds, transforms, target=target).join(latest, by)
