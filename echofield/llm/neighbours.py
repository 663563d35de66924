"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Each pivot's inverted file posts the vectors that have it among theirs,
with its place in their order. A query reads the files of its own nearest pivots only: what it meets there is ranked by
Spearman's footrule over the places, and the best are ranked again by the inner product itself.

The index is cut into shards of vectors, each with its own inverted files. A task builds one shard and lets the queries pass in
batches, so it holds a shard and a batch whatever their number, and a vector that many rows share is spread over all shards.
Pivots are fitted on a bounded sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, first_by_hash
from .packing import batch_of

#: Pivots at most, how many of them represent a vector, and rows to choose them from.
PIVOTS, PLACES, SAMPLE = 512, 64, 4096
#: The share of a shard that is ranked again, and the least number of the whole index, in multiples of what is asked for.
AGAIN, LEAST = 0.1, 20
#: Vectors of a shard, at least where there are so many and at most; shards wanted; queries that one task answers at most.
SHARD, SHARD_MOST, SHARDS, QUERIES = 4096, 1 << 16, 256, 1 << 18
NEAREST = 20
#: Queries are the rows whose id this divides.
EVERY = 20


def usable(vector: str, dim: int) -> Column:
    """Of the common length, finite, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) == dim) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def pivots(sample: np.ndarray, n: int = PIVOTS, seed: int = 0) -> np.ndarray:
    """Distinct vectors of the sample, at unit length, and at most a quarter of them."""
    distinct = np.unique(sample, axis=0)
    chosen = distinct[np.sort(np.random.default_rng(seed).permutation(len(distinct))[: min(n, max(2, len(distinct) // 4))])]
    return chosen / np.linalg.norm(chosen, axis=1, keepdims=True)


def orders(vectors: np.ndarray, pivot: np.ndarray, places: int = PLACES) -> np.ndarray:
    """For each vector its nearest pivots, nearest first: half of all pivots at most."""
    return np.argsort(-(vectors @ pivot.T), axis=1, kind="stable")[:, : max(1, min(places, len(pivot) // 2))]


class Shard:
    """Inverted files over distinct vectors; copies of a vector are one entry, so ties never crowd others out."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivot: np.ndarray, least: int, again: float = AGAIN, places: int = PLACES):
        self.pivot, self.places = pivot, places
        self.vectors, entry = np.unique(vectors, axis=0, return_inverse=True)
        entry = entry.ravel()
        order = np.lexsort((ids, entry))
        self.ids, self.starts = ids[order], np.searchsorted(entry[order], np.arange(len(self.vectors) + 1))
        nearest = orders(self.vectors, pivot, places)
        depth = nearest.shape[1]
        by_pivot = np.argsort(nearest.ravel(), kind="stable")
        self.posted, self.before = by_pivot // depth, depth - by_pivot % depth
        self.files = np.searchsorted(nearest.ravel()[by_pivot], np.arange(len(pivot) + 1))
        self.again = min(len(self.vectors), max(least, math.ceil(again * len(self.vectors))))

    def met(self, order: np.ndarray) -> np.ndarray:
        """Twice this is a constant less the footrule of two cut-off orders: over shared pivots, the sum of the lesser distance
        before the cut-off."""
        spans = [slice(self.files[p], self.files[p + 1]) for p in order]
        own = np.repeat(np.arange(len(order), 0, -1), [s.stop - s.start for s in spans])
        return np.bincount(np.concatenate([self.posted[s] for s in spans]), np.minimum(own, np.concatenate([self.before[s] for s in spans])), len(self.vectors))

    def search(self, q_ids: np.ndarray, queries: np.ndarray, k: int = NEAREST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query the ids and inner products of the nearest found."""
        for q_id, q, order in zip(q_ids, queries, orders(queries, self.pivot, self.places)):
            found = np.argpartition(self.met(order), len(self.vectors) - self.again)[len(self.vectors) - self.again :]
            score = (self.vectors[found] * q).sum(axis=1)
            last = max(0, len(score) - k - 1)
            best = score >= np.partition(score, last)[last]
            # The query's own row does not count, so of each entry one copy more than k can matter.
            rows = [self.ids[self.starts[e] : min(self.starts[e + 1], self.starts[e] + k + 1)] for e in found[best]]
            ids, value = np.concatenate(rows), np.repeat(score[best], [len(r) for r in rows])
            keep = ids != q_id
            top = np.lexsort((ids[keep], -value[keep]))[:k]
            yield int(q_id), ids[keep][top], value[keep][top]


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def answers(batches: Iterator[pa.RecordBatch], pivot: np.ndarray, dim: int, least: int, again: float, k: int) -> Iterator[pa.RecordBatch]:
    """Rows come by cell, a cell's vectors (cell, asks, vec_id, v) before its queries; one shard and one batch are held."""
    cell, held, shard = None, [], None
    for batch in batches:
        cells, asks, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        vectors = batch.column(3).flatten().to_numpy().reshape(-1, dim)
        edges = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(cells)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if cells[a] != cell:
                cell, held, shard = cells[a], [], None
            if not asks[a]:
                held.append((ids[a:b].copy(), vectors[a:b].copy()))
                continue
            if held:
                shard, held = Shard(*(np.concatenate(x) for x in zip(*held)), pivot, least, again), []
            if shard:
                found = list(shard.search(ids[a:b], vectors[a:b], k))
                yield batch_of([np.repeat([x for x, _, _ in found], [len(y) for _, y, _ in found]), np.concatenate([y for _, y, _ in found]), np.concatenate([z for _, _, z in found])], _FOUND)


def nearest(embeddings: DataFrame, k: int = NEAREST, every: int = EVERY, again: float = AGAIN) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each query, by inner product, ties to the smaller id.

    Queries are the rows whose id `every` divides; candidates are all rows with another id. Rows without an id, and vectors
    that are null, zero, of another length than most, or hold null or non-finite components take no part. A repeated id is a
    candidate row like any other, and one query, with the least of its vectors. With few candidates all are returned; an empty
    table gives an empty result. Only vec_id and embedding are read. A share `again` of the vectors is ranked again, but LEAST * k
    of them at least. Every shard answers every query; vectors are copied once for each QUERIES queries.
    """
    named = embeddings.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    lengths = named.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).head(1)
    empty = embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not lengths:
        return empty
    dim = lengths[0]["dim"]
    rows = cut(named.where(usable("v", dim)))
    sample = [r["v"] for r in first_by_hash(rows, SAMPLE, "vec_id", "v").select("v").collect()]
    if not sample:
        return empty
    asking = F.col("vec_id") % every == 0
    n, q = rows.agg(F.count("*"), F.count_if(asking)).first()
    wide, high = math.ceil(n / min(SHARD_MOST, max(SHARD, n // SHARDS))), max(1, math.ceil(q / QUERIES))
    shared = embeddings.sparkSession.sparkContext.broadcast(pivots(np.array(sample)))
    spread = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(wide)).cast("int")
    level = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(high)).cast("int")

    def cells(x, y):
        return (x * high + y).alias("cell")

    stored = rows.select(F.explode(F.sequence(F.lit(0), F.lit(high - 1))).alias("y"), spread.alias("x"), "vec_id", "v").select(cells(F.col("x"), F.col("y")), F.lit(False).alias("asks"), "vec_id", "v")
    asked = rows.where(asking).groupBy("vec_id").agg(F.min("v").alias("v")).select(F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("x"), level.alias("y"), "vec_id", "v").select(cells(F.col("x"), F.col("y")), F.lit(True).alias("asks"), "vec_id", "v")
    least = math.ceil(LEAST * k / wide) + 1
    dealt = stored.union(asked).repartitionById(wide * high, "cell").sortWithinPartitions("cell", "asks", "vec_id", "v")
    each = dealt.mapInArrow(lambda batches: answers(batches, shared.value, dim, least, again, k), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
