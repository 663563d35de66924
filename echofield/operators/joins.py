"""Time joins: as-of lookups, synchronised groups, latest snapshots, preferred sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import finite


def as_of(left: DataFrame, right: DataFrame, by: str, stamp: str, value: str, right_stamp: str = "at", width: float | None = None) -> DataFrame:
    """left with the value of the right row of its key that is latest at or before its stamp, null for none.

    Both sides are merged and a running last value is taken: one shuffle and no pairs. At equal stamps the right row comes
    first. With a width, stamps are cut into buckets that run in parallel: the last value of each bucket is found first, and a
    bucket starts from the last value before it, so that one key with all the rows does not end in one task.
    """
    merged = left.select(by, F.col(stamp).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    known = right.select(by, F.col(right_stamp).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(merged.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    both, keys = merged.union(known).withColumn("_b", F.floor(F.col("_t") / F.lit(width)) if width else F.lit(0)), [by, "_b"]
    w = W.partitionBy(*keys).orderBy("_t", "_side", F.col("_v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    if width:
        ends = both.groupBy(*keys).agg(F.max(F.when(F.col("_v").isNotNull(), F.struct("_t", "_v"))).alias("_end"))
        before = W.partitionBy(by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
        carried = ends.select(*keys, F.last("_end", ignorenulls=True).over(before)["_v"].alias("_carried"))
        found = found.join(carried, keys, "left").withColumn("_last", F.coalesce("_last", "_carried"))
    return found.select("_row.*", F.col("_last").alias(value))


def synchronised(clouds: DataFrame, sensors: list[str], slop: float, by: str = "stream", pivot_sensor: str | None = None) -> DataFrame:
    """Groups of one cloud from each sensor whose stamps span at most slop; each cloud is used once.

    Rule: the first sensor, or the one named, is the pivot: the one with the fewest clouds makes the fewest candidates. For each of its clouds and each other sensor the nearest stamp within slop is chosen
    (ties: earlier, then lower seq); a group stays if it is the best one, by span and then pivot stamp, for each cloud in it.
    The nearest stamp is the last one before or the first one after, so two running values find it and no pairs are made, however
    many clouds are within slop. Stamps are cut into buckets that run in parallel: each has the last cloud of the bucket before
    and the first of the one after. Clouds without a key or a finite stamp are in no group. clouds: stream, sensor, seq, stamp.
    """
    if pivot_sensor is not None:
        at = sensors.index(pivot_sensor)
        turned = synchronised(clouds, [pivot_sensor, *sensors[:at], *sensors[at + 1 :]], slop, by)
        place = {s: i for i, s in enumerate([pivot_sensor, *sensors[:at], *sensors[at + 1 :]])}
        return turned.select(by, "stamp", "span", *[F.col(f"seq_{place[s]}").alias(f"seq_{i}") for i, s in enumerate(sensors)])
    # Stamps within slop are in one bucket or in neighbours, also where the quotients are rounded.
    dated = clouds.where(finite(F.col("stamp")) & F.col(by).isNotNull()).select(by, F.floor(F.col("stamp") / F.lit(2 * slop)).cast("long").alias("_b"), "sensor", "stamp", "seq")
    pivot = dated.where((F.col("sensor") == sensors[0]) & F.col("seq").isNotNull()).distinct()
    others = dated.where(F.col("sensor").isin(*sensors[1:])).groupBy(by, "_b", "sensor", "stamp").agg(F.min("seq").alias("seq"))
    ends = others.groupBy(by, "_b", "sensor").agg(*[f(F.struct("stamp", "seq")).alias(c) for f, c in ((F.min, "lo"), (F.max, "hi"))])
    halo = ends.select(by, F.explode(F.array(F.struct((F.col("_b") - 1).alias("_b"), F.col("lo").alias("c")), F.struct((F.col("_b") + 1).alias("_b"), F.col("hi").alias("c")))).alias("e"), "sensor").select(by, "e._b", "sensor", "e.c.stamp", "e.c.seq")
    # Of equal stamps the pivot's row comes last, both ways.
    sides = [W.partitionBy(by, "_b").orderBy(order, F.col("sensor") == sensors[0]).rowsBetween(W.unboundedPreceding, W.currentRow) for order in (F.asc("stamp"), F.desc("stamp"))]
    found = {f"_{k}{i}": F.last(F.when(F.col("sensor") == sensor, F.struct("stamp", "seq")), ignorenulls=True).over(w) for i, sensor in enumerate(sensors[1:], 1) for k, w in enumerate(sides)}
    out = pivot.union(others).union(halo).withColumns(found).where(F.col("sensor") == sensors[0]).select(by, F.col("seq").alias("seq_0"), F.col("stamp").alias("stamp_0"), *found)
    for i in range(1, len(sensors)):
        near = [F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("stamp_0") - F.col(c)["stamp"]).alias("gap"), F.col(c)["stamp"].alias(f"stamp_{i}"), F.col(c)["seq"].alias(f"seq_{i}"))) for c in (f"_0{i}", f"_1{i}")]
        out = out.withColumn("p", F.least(*near)).where(F.col("p.gap") <= F.lit(slop)).select("*", f"p.stamp_{i}", f"p.seq_{i}").drop("p")
    stamps = [F.col(f"stamp_{i}") for i in range(len(sensors))]
    out = out.withColumns({"stamp": F.least(*stamps), "span": F.greatest(*stamps) - F.least(*stamps)}).where(F.col("span") <= F.lit(slop))
    for i in range(1, len(sensors)):
        rank = F.row_number().over(W.partitionBy(by, f"seq_{i}").orderBy("span", "stamp_0", "seq_0"))
        out = out.withColumn(f"_r{i}", rank)
    for i in range(1, len(sensors)):
        out = out.where(F.col(f"_r{i}") == 1)
    return out.select(by, "stamp", "span", *[f"seq_{i}" for i in range(len(sensors))])


def latest(rows: DataFrame, by: tuple[str, ...], order: str, value: Column) -> DataFrame:
    """The newest value of each key."""
    return rows.groupBy(*by).agg(F.max_by(value, order).alias("latest"))


def preferred(rows: DataFrame, source: str, by: str = "stream", order: str = "seq", session: str | None = None) -> DataFrame:
    """Rows of the preferred source, and those of others until the stream (or its session) has shown the preferred one."""
    keys = [by, session] if session else [by]
    seen = F.max((F.col("source") == source).cast("int")).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("_seen", seen).where((F.col("source") == source) | (F.col("_seen") == 0)).drop("_seen")


def under_settings(rows: DataFrame, settings: DataFrame, names: tuple[str, ...], by: str, stamp: str, defaults: dict[str, object]) -> DataFrame:
    """Rows with the settings that held at their stamp: those of the last change at or before it, the defaults before any.
    settings: by, at, names."""
    found = as_of(rows, settings.select(by, "at", F.struct(*names).alias("_set")), by, stamp, "_set")
    return found.withColumns({c: F.coalesce(F.col("_set")[c], F.lit(defaults[c])) for c in names}).drop("_set")
