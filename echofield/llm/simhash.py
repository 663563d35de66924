"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit i of a fingerprint carries a nonzero vector m(i) over GF(2) with radius + 1 components. For each nonzero vector v of that
space, a table keeps the bits with <m(i), v> = 1. The vectors of at most radius differing bits span at most radius
dimensions, so some v is orthogonal to them all and its table shows the two fingerprints as equal: no pair is missed.

In a table's bucket the pairs are not compared. Fingerprints within two bits of each other share a neighbour at one bit, so
each one posts itself and its one-bit neighbours among the bits the table leaves out. What shares a posting is within two
bits, at most 65 distinct fingerprints, and links to the smallest of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from .common import by_text, columns_of, cut, fresh
from .components import components

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16


def masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """The bits that each table keeps."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes | None) -> int:
    """Of the shingles of lower-cased words, repeats included: a bit is set if it is set in over half of their hashes."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    n = max(1, len(words) - SHINGLE + 1)
    counts = np.zeros(BITS, dtype=np.int64)
    hashes = (xxh64_intdigest(x, SEED) for x in shingles)
    for at in range(0, n, BLOCK):
        block = np.fromiter(hashes, dtype="<u8", count=min(BLOCK, n - at))
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(text: pa.Array) -> pa.Array:
    return pa.array([signed(fingerprint(x.as_py())) for x in text.cast(pa.binary())], pa.int64())


def fingerprints(text: str) -> Column:
    return arrow_udf(_fingerprints, LongType())(F.col(text))


def links(distinct: DataFrame) -> DataFrame:
    """(u, v) between distinct fingerprints `fp` of at most two differing bits: enough of them to connect all such pairs."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks())])
    posted = distinct.select("fp", F.explode(tables).alias("p")).select("fp", "p.t", "p.key")
    shared = cut(posted.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key"))
    met = posted.join(shared, ["t", "key"], "left_semi")
    free = F.create_map(*[x for t, m in enumerate(masks()) for x in (F.lit(t), F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(BITS) if not m >> i & 1]))])
    near = met.select("t", "fp", F.explode(free[F.col("t")]).alias("flip")).select("t", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
    groups = near.groupBy("t", "near").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return groups.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).where("u != v").distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row a document: doc_id, fp (the fingerprint as a long) and component_id (the smallest doc_id reachable).

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat, or share an id, are rows like any
    other. A component whose ids are all null has a null component_id. An empty table gives an empty result. Only doc_id and
    text are read, so other columns cannot clash.
    """
    marked = cut(by_text(documents).select("doc_id", fingerprints("text").alias("fp")))
    return marked.join(component_of(marked), "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents less near copies: of each component the row with the smallest id stays, rows without an id only where a
    component has no other; of rows that share that id and fingerprint one. Null and empty texts are copies of one another.
    Columns of the input, whatever their names. An empty table gives an empty result."""
    mine = fresh(documents)
    fp, gone_fp, gone_id, nth = (mine + x for x in ("fp", "gone_fp", "gone_id", "nth"))
    rows = by_text(documents).withColumn(fp, fingerprints("text"))
    marked = cut(rows.select("doc_id", F.col(fp).alias("fp")))
    several = component_of(marked)
    members = marked.distinct().join(several, "fp").where(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("component_id")) & F.col("component_id").isNotNull())
    gone = cut(members.where("doc_id IS NOT NULL OR component_id IS NOT NULL").select("fp", "doc_id").distinct().toDF(gone_fp, gone_id))
    kept = rows.join(gone, (F.col(fp) == F.col(gone_fp)) & F.col("doc_id").eqNullSafe(F.col(gone_id)), "left_anti")
    # Rows that are left with the id of their component's first row: one of them stays.
    place = W.partitionBy("doc_id", fp).orderBy("text")
    return kept.withColumn(nth, F.row_number().over(place)).where(F.col(nth) == 1).select(*columns_of(documents))


def component_of(marked: DataFrame) -> DataFrame:
    """(fp, component_id) for the fingerprints that link to another or that several rows have, from (doc_id, fp)."""
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = cut(components(links(distinct.select("fp"))))
    linked = distinct.join(roots, distinct["fp"] == roots["node"])
    least = cut(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    many = distinct.where("n > 1").join(roots, distinct["fp"] == roots["node"], "left_anti").select("fp", F.col("least").alias("component_id"))
    return cut(linked.join(least, "root").select("fp", "component_id").union(many))


def hexadecimal(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
