"""Ordered window operators: framing of packets into scans, sessions, decimation, rings, scan binning and rates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import d


def packets_per_scan(packet_rate: float, rpm: float) -> int:
    return math.ceil(packet_rate / (rpm / 60))


def framed_by_count(packets: DataFrame, per_scan: int, by: str = "sensor", order: str = "seq") -> DataFrame:
    n = F.row_number().over(W.partitionBy(by).orderBy(order))
    return packets.withColumn("scan_id", F.floor((n - 1) / per_scan).cast("long"))


def crosses(before: Column, now: Column, cut: int) -> Column:
    """Whether a revolution passes the cut angle between two azimuths; never at the first packet."""
    passed = ((before < cut) & (now >= cut)) | ((now >= cut) & (now < before)) | ((now < before) & (before < cut))
    return F.coalesce(passed, F.lit(False))


def framed_by_angle(packets: DataFrame, cut: int, by: str = "sensor", order: str = "seq", azimuth: str = "azimuth") -> DataFrame:
    """A scan closes after the packet that passes the cut angle."""
    w = W.partitionBy(by).orderBy(order)
    closing = crosses(F.lag(azimuth).over(w), F.col(azimuth), cut)
    marked = packets.withColumn("_closes", closing.cast("long"))
    return marked.withColumn("scan_id", F.coalesce(F.sum("_closes").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_closes")


def split_at_zero(blocks: DataFrame, jump: int = 1000, by: str = "sensor", order: tuple[str, str] = ("seq", "block"), azimuth: str = "azimuth") -> DataFrame:
    """Rows (sensor, packet, scan): a jump between neighbouring blocks starts a scan, and a packet that a jump parts belongs
    to both scans."""
    w = W.partitionBy(by).orderBy(*order)
    jumps = F.coalesce((F.abs(F.col(azimuth) - F.lag(azimuth).over(w)) > jump).cast("long"), F.lit(0))
    marked = blocks.withColumn("_jump", jumps)
    return marked.withColumn("scan_id", F.sum("_jump").over(w)).select(by, order[0], "scan_id").distinct()


def scan_stamps(packets: DataFrame, by: tuple[str, ...] = ("sensor", "scan_id"), order: str = "seq", stamp: str = "stamp") -> DataFrame:
    """First and last packet stamp of each scan: a scan takes the one or the other by policy."""
    return packets.groupBy(*by).agg(F.min_by(stamp, order).alias("first_stamp"), F.max_by(stamp, order).alias("last_stamp"), F.count("*").alias("packets"))


def clock_sessions(rows: DataFrame, stamp: str, back_s: float = 0.5, by: str = "stream", order: str = "seq") -> DataFrame:
    """A clock that goes back by more than back_s begins a session."""
    w = W.partitionBy(by).orderBy(order)
    return rows.withColumn("_back", F.coalesce((F.lag(stamp).over(w) - F.col(stamp) > d(back_s)).cast("long"), F.lit(0))).withColumn("session", F.sum("_back").over(w)).drop("_back")


def path_stride(rows: DataFrame, most: int, by: str = "stream", order: str = "seq") -> DataFrame:
    """Every ceil(n / most)-th row, and the last."""
    n = F.count("*").over(W.partitionBy(by))
    i = F.row_number().over(W.partitionBy(by).orderBy(order))
    marked = rows.withColumns({"_n": n, "_i": i})
    stride = F.ceil(F.col("_n") / most)
    return marked.where(((F.col("_i") - 1) % stride == 0) | (F.col("_i") == F.col("_n"))).drop("_n", "_i")


def azimuth_gaps(blocks: DataFrame, by: tuple[str, ...] = ("sensor", "seq"), order: str = "block", azimuth: str = "azimuth") -> DataFrame:
    """The gap to a packet's next block: a negative one reuses the last, or drops the block where there is none; the last block
    reuses the last."""
    w = W.partitionBy(*by).orderBy(order)
    after = F.lead(azimuth).over(w)
    raw = blocks.withColumns({"_after": after, "_gap": F.when(after >= F.col(azimuth), after - F.col(azimuth))})
    last = F.last(F.when(F.col("_gap") > 0, F.col("_gap")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    gap = F.when(F.col("_after").isNull(), F.coalesce(F.last("_gap", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)), F.lit(0))).when(F.col("_gap").isNotNull(), F.col("_gap")).otherwise(last)
    return raw.withColumn("gap", gap).where(F.col("gap").isNotNull()).drop("_after", "_gap")


def rings(lasers: DataFrame, by: str = "sensor", angle: str = "vert", laser: str = "laser_id") -> DataFrame:
    """A laser's ring: the rank of its vertical angle among the distinct ones; of equal angles the first laser has it, and the
    others ring 0."""
    rank = F.dense_rank().over(W.partitionBy(by).orderBy(angle)) - 1
    first = F.row_number().over(W.partitionBy(by, angle).orderBy(laser)) == 1
    return lasers.withColumn("ring", F.when(first, rank).otherwise(0))


def laser_scan(points: DataFrame, ring: int, resolution: float, bins: int, by: str = "frame_no", order: str = "seq") -> DataFrame:
    """For each frame and bin the range and intensity of the ring's last point there; +Inf and 0 where there is none."""
    at = F.least(F.floor((F.atan2("y", "x") + d(math.pi)) / d(resolution)).cast("int"), F.lit(bins - 1))
    hit = points.where(F.col("ring") == ring).select(by, at.alias("bin"), order, F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("range"), "intensity")
    last = hit.groupBy(by, "bin").agg(F.max_by("range", order).alias("range"), F.max_by("intensity", order).alias("intensity"))
    every = points.select(by).distinct().select(by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(last, [by, "bin"], "left").select(by, "bin", F.coalesce("range", d(math.inf)).alias("range"), F.coalesce("intensity", d(0)).alias("intensity"))


def ring_count(points: DataFrame, by: str = "sensor", frame: str = "frame_no") -> DataFrame:
    """Rings of each sensor as its first frame shows them."""
    per_frame = points.groupBy(by, frame).agg((F.max("ring") + 1).alias("n"))
    return per_frame.groupBy(by).agg(F.min_by("n", frame).alias("rings"))


#: The ring that a scan takes by the number of rings.
SCAN_RING = {64: 57, 32: 23, 16: 8}


def scan_ring(n_rings: Column) -> Column:
    return F.when(n_rings > 32, SCAN_RING[64]).when(n_rings > 16, SCAN_RING[32]).otherwise(SCAN_RING[16])


def trimmed_blocks(blocks: DataFrame, jump: int = 1000, by: tuple[str, ...] = ("sensor", "scan_id"), packet: str = "seq", order: str = "block", azimuth: str = "azimuth") -> DataFrame:
    """A scan without its neighbours' blocks: its first packet starts after its last jump where it starts past 100 degrees, and
    its last packet ends at its last jump."""
    inside = W.partitionBy(*by, packet).orderBy(order)
    whole = inside.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    scan = W.partitionBy(*by)
    marked = blocks.withColumn("_jump", F.when(F.abs(F.col(azimuth) - F.lag(azimuth).over(inside)) > jump, F.col(order)))
    marked = marked.withColumns({"_cut": F.max("_jump").over(whole), "_from": F.first(azimuth).over(whole), "_first": F.min(packet).over(scan), "_last": F.max(packet).over(scan)})
    head = (F.col(packet) != F.col("_first")) | F.col("_cut").isNull() | (F.col("_from") < 10_000) | (F.col(order) >= F.col("_cut"))
    tail = (F.col(packet) != F.col("_last")) | (F.col("_first") == F.col("_last")) | F.col("_cut").isNull() | (F.col(order) < F.col("_cut"))
    return marked.where(head & tail).drop("_jump", "_cut", "_from", "_first", "_last")


def packet_stamp(begin: Column, end: Column, offset: float, gps: Column | None = None, has_gps: Column | None = None) -> Column:
    """The middle of the read, moved by an offset; GPS time where there is one."""
    middle = (begin + end) / 2 + d(offset)
    return F.when(has_gps, gps).otherwise(middle) if gps is not None else middle


def seen_and_missed(rows: DataFrame, detected: str = "detected", by: str = "stream", order: str = "seq") -> DataFrame:
    """Running counts of frames and of misses."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumns({"frames_seen": F.count("*").over(w), "frames_missed": F.sum((~F.col(detected)).cast("long")).over(w)})


def age_flag(rows: DataFrame, tolerance: float, stamp: str = "stamp", now: str = "now") -> DataFrame:
    """Marks old or empty clouds and drops none."""
    return rows.withColumn("warns", (F.col(now) - F.col(stamp) > d(tolerance)) | (F.col("n") == 0))


def rate_bounds(rows: DataFrame, ts: str, low: float, high: float, width: str, slide: str, seconds: float, tolerance: float = 0.1, by: str = "sensor") -> DataFrame:
    """Rate of each key in sliding windows, and whether it is in bounds with a tolerance."""
    per = rows.groupBy(by, F.window(ts, width, slide).alias("w")).agg(F.count("*").alias("n"))
    rate = per.select(by, F.col("w.start").alias("start"), (F.col("n") / d(seconds)).alias("rate"))
    return rate.withColumn("ok", (F.col("rate") >= d(low * (1 - tolerance))) & (F.col("rate") <= d(high * (1 + tolerance))))


def snapshot_or_path(snapshots: DataFrame, paths: DataFrame, start_gap: float = 2.0, share: float = 0.7, by: str = "stream") -> DataFrame:
    """The newest full path of each stream where it is complete, else the accumulated one. Complete: it starts close to the
    accumulated path's start and spans enough of it. snapshots: by, stamp, start, span; paths: by, start, span."""
    newest = snapshots.groupBy(by).agg(F.max_by(F.struct("stamp", "start", "span"), "stamp").alias("s"))
    whole = (F.abs(F.col("s.start") - F.col("start")) <= d(start_gap)) & (F.col("s.span") >= d(share) * F.col("span"))
    return paths.join(newest, by, "left").withColumn("kind", F.when(F.coalesce(whole, F.lit(False)), "full_snapshot").otherwise("odom_accumulated")).select(by, "kind", F.when(F.col("kind") == "full_snapshot", F.col("s.span")).otherwise(F.col("span")).alias("span"))
