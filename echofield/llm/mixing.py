"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key. Within its source the keys are range-sorted: a key's leading hex digits are its
range, ranges are summed first, their prefix sums are joined back, and a running sum inside each range completes the
distributed prefix sum. A source's budget is cut at exactly its target: whole epochs first, then documents in key order,
the last of them in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, columns_of, cut, fresh

#: A source takes at most so many times its own size.
MOST_EPOCHS = 3
#: Leading hex digits of a key that name its range: 16 ** 3 ranges for each source.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: int = MOST_EPOCHS) -> DataFrame:
    """One row a source, from (skey, source_size): its weight 1, 2, 3, 1, ... in order of skey, and its target.

    Water filling in closed form: sources in order of the level at which they fill up, most * size / weight. The first that
    is not full at the level which all before it leave fixes the level. All windows here run over one row a source.
    """
    every = W.orderBy("skey")
    line = W.orderBy("full_at", "skey")
    before = line.rowsBetween(W.unboundedPreceding, -1)
    whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = sizes.withColumn("weight", ((F.row_number().over(every) - 1) % 3 + 1).cast("long")).withColumn("cap", F.col("source_size") * most)
    levels = (
        ranked.withColumn("full_at", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("place", F.row_number().over(line))
        .withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    )
    settled = levels.withColumn("at", F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("place", "level"))).over(whole))
    target = F.when(F.col("place") < F.col("at.place"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("at.level"))
    return settled.select("skey", "source_size", "weight", F.least(target, F.col("cap").cast("double")).alias("target"))


def mix(documents: DataFrame, most: int = MOST_EPOCHS) -> DataFrame:
    """The documents' columns, then _mix: struct(size, source_size, target, taken).

    Null text counts as no words; a null source is a source of its own, ordered last. Documents that tie in key are repeats
    of one another (same id, same text), so their order does not matter. An empty table gives an empty result; a source
    without words has target 0. Other columns pass through whatever their names; a column _mix of the input gives way.
    """
    own = fresh(documents)
    names = ("size", "skey", "key", "range", "upto", "ahead", "source_size", "target", "epochs")
    size, skey, key, part, upto, ahead, source_size, target, epochs = (own + x for x in names)
    hashed = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    named = F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))
    keyed = documents.withColumns({size: word_count(F.col("text")), skey: named, key: hashed}).withColumn(part, F.substring(key, 1, RANGE_DIGITS))
    ranges = cut(keyed.groupBy(F.col(skey).alias("skey"), F.col(part).alias("range")).agg(F.sum(size).alias("range_size")))
    source = targets(ranges.groupBy("skey").agg(F.sum("range_size").alias("source_size")), most)
    before = F.sum("range_size").over(W.partitionBy("skey").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    offsets = cut(ranges.withColumn("ahead", F.coalesce(before, F.lit(0))).join(source, "skey").select("skey", "range", "ahead", "source_size", "target").toDF(skey, part, ahead, source_size, target))
    inside = W.partitionBy(skey, part).orderBy(key).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = keyed.withColumn(upto, F.sum(size).over(inside)).join(offsets, [skey, part])
    budget = F.floor(target).cast("long")
    whole = F.when(F.col(source_size) > 0, F.floor(budget / F.col(source_size)).cast("long")).otherwise(0)
    start = F.col(ahead) + F.col(upto) - F.col(size)
    taken = F.col(epochs) * F.col(size) + F.greatest(F.lit(0).cast("long"), F.least(F.col(size), budget - F.col(epochs) * F.col(source_size) - start))
    found = F.struct(F.col(size).alias("size"), F.col(source_size).alias("source_size"), F.col(target).alias("target"), taken.alias("taken")).alias("_mix")
    return summed.withColumn(epochs, whole).select(*[c for name, c in zip(documents.columns, columns_of(documents)) if name != "_mix"], found)


def mixed_documents(documents: DataFrame, most: int = MOST_EPOCHS) -> DataFrame:
    """The mix itself: each document once for each time it is taken whole, and the document at its source's cut shortened to
    the words that still fit. Documents without words, null texts among them, are kept once; repeated rows count each. Columns
    of the input, whatever their names; n_chars follows the text."""
    held = fresh(documents)
    whole_row, words = held + "row", held + "words"
    kept = documents.columns
    rows = mix(documents.withColumnRenamed("_mix", whole_row) if "_mix" in kept else documents, most)
    size, taken = F.col("_mix.size"), F.col("_mix.taken")
    whole = F.when(size > 0, F.floor(taken / size)).otherwise(1).cast("int")
    part = F.when(size > 0, taken - whole * size).otherwise(0).cast("int")
    some = F.when(whole > 0, F.array_repeat(F.lit(-1), whole)).otherwise(F.array().cast("array<int>"))
    copies = F.concat(some, F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    cutting = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.greatest(F.col(words), F.lit(0))), "")
    text = F.when(F.col(words) < 0, F.col("text")).otherwise(cutting)
    out = rows.withColumn(words, F.explode(copies)).withColumn("text", text)
    if "n_chars" in kept:
        out = out.withColumn("n_chars", F.when(F.col(words) < 0, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*[F.col(whole_row).alias("_mix") if c == "_mix" else F.col(f"`{c}`") for c in kept])
