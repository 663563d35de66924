"""Quality rules: an isolation forest over rule statistics, with a threshold from labelled rows.

Each document gets the statistics of common quality rules. Trees of random splits isolate unusual documents on short paths.
All documents are scored; the threshold is where the scores of all labelled rows part good from bad best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import by_text, cut, first_by_hash

#: Rows to grow the forest on, its trees, and rows of each tree. The fit is on this bounded sample of labelled rows.
SAMPLE, TREES, ROWS = 4096, 128, 128
#: A good document that is dropped counts as so many bad ones that are kept.
GOOD_COST = 25
#: Steps of the score between which the threshold lies.
BINS = 2000

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capital")
_TYPE = ", ".join(f"{x} long" for x in STATISTICS)


def repeated(words: list[bytes]) -> int:
    """Words in five-word windows that occur twice or more. Windows are numbered exactly, from pairs to fours to fives."""
    if len(words) < 6:
        return 0
    known: dict[bytes, int] = {}
    one = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    pairs, two = np.unique(one[:-1] * len(known) + one[1:], return_inverse=True)
    fours, four = np.unique(two[:-2] * len(pairs) + two[2:], return_inverse=True)
    _, five, counts = np.unique(four[:-1] * len(known) + one[4:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[five] > 1)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + 5, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def statistics(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.split()]
    joined = b"".join(words)
    return len(words), len(joined.decode()), sum(text.count(x) for x in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")), len(lines) - len(set(lines)), repeated(words), len(lines), sum(w[:1].isupper() for w in words)


def _statistics(text: pa.Array) -> pa.Array:
    rows = [statistics(x.as_py()) for x in text.cast(pa.binary())]
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(STATISTICS), list(STATISTICS))


def features(columns: dict[str, np.ndarray]) -> np.ndarray:
    """What the forest splits on: ratios, so that length alone makes no document unusual. Symbols count thrice, by words also
    without the logarithm and by characters, as most junk is made of them."""
    c = {k: np.asarray(v, dtype=np.float64) for k, v in columns.items()}
    n, lines, chars = (np.maximum(c[k], 1) for k in ("n_words", "n_lines", "word_chars"))
    return np.stack([np.log1p(c["n_words"]), c["word_chars"] / n, np.log1p(100 * c["n_symbols"] / n), c["n_dup_lines"] / lines, c["n_repeat_words"] / n, np.log(n / lines), c["n_capital"] / n, c["n_symbols"] / n, c["n_symbols"] / chars], axis=1)


class Forest:
    """Isolation trees as arrays: for each node its feature, split, children and, at a leaf, the path length."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, size: int = ROWS, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.size = min(size, len(rows))
        self.trees = []
        for _ in range(trees if self.size > 1 else 0):
            self.trees.append(self.grow(rows[rng.choice(len(rows), self.size, replace=False)], rng))

    @staticmethod
    def expected(n: float) -> float:
        """The mean path of an unsuccessful search among n rows."""
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def grow(self, rows: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        most = int(np.ceil(np.log2(len(rows)))) + 2
        nodes: list[list] = []

        def node(part: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, depth + self.expected(len(part))])
            low, high = part.min(axis=0), part.max(axis=0)
            wide = np.flatnonzero(high > low)
            if depth < most and len(wide):
                f = int(rng.choice(wide))
                split = rng.uniform(low[f], high[f])
                left = part[:, f] < split
                if left.any() and not left.all():
                    nodes[at][:2] = f, split
                    nodes[at][2] = node(part[left], depth + 1)
                    nodes[at][3] = node(part[~left], depth + 1)
            return at

        node(rows, 0)
        return tuple(np.array(x) for x in zip(*nodes))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Near 1 for rows on short paths, about 0.5 for usual ones."""
        if not self.trees:
            return np.full(len(rows), 0.5)
        total, here = np.zeros(len(rows)), np.arange(len(rows))
        for feature, split, left, right, length in self.trees:
            at = np.zeros(len(rows), dtype=np.int64)
            while (inner := feature[at] >= 0).any():
                step = np.where(rows[here, feature[at]] < split[at], left[at], right[at])
                at = np.where(inner, step, at)
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / self.expected(self.size))


def measured(documents: DataFrame) -> DataFrame:
    """doc_id and the statistics. Null text has none of anything."""
    return by_text(documents).select("doc_id", arrow_udf(_statistics, _TYPE)("text").alias("s")).select("doc_id", "s.*")


def fit(counted: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Grows the forest on at most `sample` labelled documents, those whose ids hash lowest."""
    ids = first_by_hash(labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id").distinct(), sample, "doc_id")
    found = counted.join(F.broadcast(ids), "doc_id").select(*STATISTICS, "doc_id").distinct()
    rows = sorted(tuple(r) for r in first_by_hash(found, 2 * sample, "doc_id", *STATISTICS).collect())
    return Forest(features(dict(zip(STATISTICS, zip(*rows)))) if rows else np.empty((0, 9)))


def scored(counted: DataFrame, forest: Forest) -> DataFrame:
    shared = counted.sparkSession.sparkContext.broadcast(forest)

    def score(*columns: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(features(dict(zip(STATISTICS, (x.to_numpy(zero_copy_only=False) for x in columns))))), pa.float64())

    return counted.withColumn("anomaly", arrow_udf(score, "double")(*STATISTICS))


def threshold(rows: DataFrame, labels: DataFrame, good_cost: float = GOOD_COST) -> float:
    """The anomaly score from which documents are dropped, by all labelled rows; above 1 where no labels part them."""
    named = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    bins = rows.select("doc_id", F.floor(F.col("anomaly") * BINS).cast("int").alias("bin")).join(named, "doc_id").groupBy("bin", "quality").agg(F.count("*").alias("n")).collect()
    counts = np.zeros((2, BINS + 2))
    for r in bins:
        counts[r["quality"], r["bin"]] += r["n"]
    if not counts.sum(axis=1).all():
        return 2.0
    dropped = counts[:, ::-1].cumsum(axis=1)[:, ::-1] / counts.sum(axis=1, keepdims=True)
    gain = dropped[0] - good_cost * dropped[1]
    return int(np.argmax(gain)) / BINS if gain.max() > 0 else 2.0


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, anomaly and kept.

    base_failed: under 10 words, or over a fifth of the words in repeated windows. Null and empty texts fail. Repeated rows
    are judged alike, rows without an id like any other, and texts of any length are read whole; without labels of both kinds
    only the base rules drop. An empty table gives an empty result. Only doc_id and text are read.
    """
    counted = cut(measured(documents))
    rows = cut(scored(counted, fit(counted, labels)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    limit = threshold(rows.where(~failed), labels)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < limit))
