"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams, hashed into one table, so a misspelling shares most of a known
word's vectors. A window of a text is the mean of its words. A softmax over two classes reads the window, and
a document is as toxic as its worst window, so a long text does not dilute an insult. Labels are of documents: the first
passes learn from all windows, the later ones from each toxic document's worst.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

from .common import by_text, cut, first_by_hash, held_out
from .words import chosen_texts, folded

#: Hashed vectors, their length, and the n-grams of a word.
BUCKETS, DIM, GRAMS = 1 << 17, 8, (4, 5, 6)
#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 64, 32
#: Labelled rows to learn from, of each class, and bytes of their texts: the fit is on this bounded sample, and reads its texts
#: whole. Texts over a sixty-fourth of the bytes are not learned from.
SAMPLE, SAMPLE_BYTES = 3000, 1 << 25
#: How much the softmax is held small.
DECAY = 1e-5
#: Added to Adam's divisor: larger than the gradient of n-grams in a few windows, which thus stay small.
EPS = 1e-4
#: Words whose value a worker remembers.
REMEMBERED = 200_000


def buckets(word: str) -> list[int]:
    """Of the n-grams of the word with marks at its ends; a word too short for any is one itself."""
    data = f"<{word}>".encode()
    return [zlib.crc32(data[i : i + n]) % BUCKETS for n in GRAMS for i in range(len(data) - n + 1)] or [zlib.crc32(data) % BUCKETS]


def windows(n: int) -> list[tuple[int, int]]:
    """Starts and ends; the last window is as long as the others where the text is."""
    if n <= WINDOW:
        return [(0, n)]
    return [(a, a + WINDOW) for a in [*range(0, n - WINDOW, STRIDE), n - WINDOW]]


@dataclass
class Model:
    """What is left of a trained model for scoring: one number a bucket, which the softmax's two rows and the vectors give."""

    weights: np.ndarray
    bias: float

    def word(self, word: str) -> float:
        found = buckets(word)
        return float(self.weights[found].sum()) / len(found)


class Scorer(dict):
    """A word's share in a window's logit."""

    def __init__(self, model: Model):
        self.weights, self.bias = model.weights.tolist(), model.bias

    def __missing__(self, word: str) -> float:
        found, weights = buckets(word), self.weights
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = sum([weights[b] for b in found]) / len(found)
        return value

    def logits(self, words: list[str]) -> np.ndarray:
        values = np.fromiter(map(self.__getitem__, words), dtype=np.float64, count=len(words))
        sums = np.concatenate([[0.0], np.cumsum(values)])
        spans = np.array(windows(len(words)))
        return (sums[spans[:, 1]] - sums[spans[:, 0]]) / np.maximum(spans[:, 1] - spans[:, 0], 1) + self.bias

    def score(self, text: str | None) -> float:
        x = float(self.logits(folded(text)).max())
        return 1 / (1 + np.exp(-x)) if x > -700 else 0.0


class Bags:
    """Windows as lists of words, and words as lists of buckets."""

    def __init__(self, flat: list[np.ndarray], subs: list[list[int]]):
        self.flat, self.lengths = flat, np.array([len(x) for x in flat])
        self.sub_n = np.array([len(x) for x in subs])
        self.sub_at = np.concatenate([[0], np.cumsum(self.sub_n)])
        self.sub = np.concatenate([np.array(x) for x in subs])

    def means(self, vectors: np.ndarray, rows: np.ndarray):
        """The windows' mean vectors, and what the gradient needs to find its way back."""
        n = self.lengths[rows]
        used, back = np.unique(np.concatenate([self.flat[r] for r in rows]), return_inverse=True)
        counts = self.sub_n[used]
        starts = np.concatenate([[0], np.cumsum(counts)])
        places = self.sub[np.arange(starts[-1]) - np.repeat(starts[:-1], counts) + np.repeat(self.sub_at[used], counts)]
        word = np.add.reduceat(vectors[places], starts[:-1], axis=0) / counts[:, None]
        window = np.add.reduceat(word[back], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0) / n[:, None]
        return window, (n, back, counts, places, len(used))

    def slopes(self, vectors: np.ndarray, softmax: np.ndarray, bias: np.ndarray, rows: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, ...]:
        """Gradients by vectors, softmax and bias of the windows' log loss, of which each class has half the weight, whatever
        its share; the softmax is held small."""
        weight = np.where(truth == 1, 0.5 / max(1, truth.sum()), 0.5 / max(1, (1 - truth).sum()))
        window, (n, back, counts, places, words) = self.means(vectors, rows)
        logits = window @ softmax + bias
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        slope = (odds / odds.sum(axis=1, keepdims=True) - np.eye(2)[truth]) * weight[:, None]
        pull = np.repeat(slope @ softmax.T / n[:, None], n, axis=0)
        pull = np.stack([np.bincount(back, pull[:, k], words) for k in range(DIM)], axis=1) / counts[:, None]
        pull = np.repeat(pull, counts, axis=0)
        return np.stack([np.bincount(places, pull[:, k], BUCKETS) for k in range(DIM)], axis=1), window.T @ slope + DECAY * softmax, slope.sum(axis=0)


def train(texts: list[str], toxic: list[int], rounds: int = 80, later: int = 120, rate: float = 0.2, seed: int = 0) -> Model:
    """Vectors and softmax together, by Adam over batches of windows. Without rows of both classes every score is the share."""
    rng = np.random.default_rng(seed)
    share = (sum(toxic) + 0.5) / (len(toxic) + 1)
    if not texts or len(set(toxic)) < 2:
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    index: dict[str, int] = {}
    owner, flat = [], []
    # Every fifth row is kept back to find out where a score of 0.5 belongs.
    kept = np.arange(len(texts)) % 5 == 4 if min(sum(toxic), len(toxic) - sum(toxic)) >= 20 else np.zeros(len(texts), bool)
    for d, text in enumerate(texts):
        if kept[d]:
            continue
        words = np.array([index.setdefault(w, len(index)) for w in folded(text)], dtype=np.int32)
        for a, b in windows(len(words)):
            if b > a:
                owner.append(d)
                flat.append(words[a:b])
    bags = Bags(flat, [buckets(w) for w in index])
    owner, labels = np.array(owner), np.array(toxic)
    vectors, softmax, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (vectors, softmax, bias)]
    picked = np.arange(len(owner))
    step = 0
    for epoch in range(rounds + later):
        if epoch >= rounds and (epoch - rounds) % 10 == 0:
            scorer = np.concatenate([bags.means(vectors, rows)[0] @ (softmax[:, 1] - softmax[:, 0]) for rows in np.array_split(np.arange(len(owner)), max(1, len(owner) // 500))])
            order = np.lexsort((-scorer, owner))
            worst = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]
            picked = np.concatenate([worst[labels[owner[worst]] == 1], np.flatnonzero(labels[owner] == 0)])
        rows = rng.choice(picked, min(len(picked), 1024), replace=False)
        step += 1
        for x, g, (m, v) in zip((vectors, softmax, bias), bags.slopes(vectors, softmax, bias, rows, labels[owner[rows]]), state):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            x -= rate * (1 - 0.9 * epoch / (rounds + later)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + EPS)
    model = Model(vectors @ (softmax[:, 1] - softmax[:, 0]), float(bias[1] - bias[0]))
    # A score of 0.5 is where the documents of the sample part best, both classes counting alike but clean ones thrice.
    scorer = Scorer(model)
    if kept.any():
        texts, labels = [x for x, k in zip(texts, kept) if k], labels[kept]
    best = np.array([scorer.logits(folded(x)).max() for x in texts])
    order = np.argsort(best)
    at = np.concatenate([[best.min() - 1], (best[order][1:] + best[order][:-1]) / 2, [best.max() + 1]])
    missed = np.concatenate([[0], np.cumsum(labels[order])]) / max(1, labels.sum())
    blamed = 1 - np.concatenate([[0], np.cumsum(1 - labels[order])]) / max(1, (1 - labels).sum())
    cost = missed + 3 * blamed
    model.bias -= float(np.median(at[cost <= cost.min() + 1e-12]))
    return model


def within_bytes(sizes: list[tuple], most: int = SAMPLE_BYTES) -> list:
    """Of (id, class, bytes), in order, the ids that are taken: for each class so many that their bytes are at most `most`."""
    out, total = [], {}
    for doc_id, kind, size in sizes:
        if size <= most // 64 and total.get(kind, 0) + size <= most:
            total[kind] = total.get(kind, 0) + size
            out.append(doc_id)
    return out


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from at most `sample` labelled rows of each class, those whose ids hash lowest, outside the held-out fold, and at
    most SAMPLE_BYTES of their texts. Labels that are null or neither 0 nor 1, and rows without an id or a text, are not learned
    from; a document that is labelled twice is toxic if either says so. An empty table gives a model of the share of labels."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "toxic").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = first_by_hash(usable.where("toxic = 1"), sample, "doc_id").union(first_by_hash(usable.where("toxic = 0"), sample, "doc_id"))
    found = cut(chosen_texts(documents.where("text IS NOT NULL").select("doc_id", "text"), ids).groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    taken = within_bytes([tuple(r) for r in found.select("doc_id", "toxic", F.octet_length("text")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()])
    chosen = documents.sparkSession.createDataFrame([(x,) for x in taken], "doc_id long")
    rows = sorted(found.join(F.broadcast(chosen), "doc_id", "left_semi").collect(), key=lambda r: r["doc_id"])
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def score(documents: DataFrame, model: Model) -> DataFrame:
    """The documents' columns, then score: 0 to 1, for null and empty texts what the model gives without words.

    Whole texts of any length count, window by window. Repeated rows score alike, and rows without an id as any other; an empty
    table gives an empty result. Other columns pass through whatever their names; a column score of the input gives way.
    """
    shared = by_text(documents).sparkSession.sparkContext.broadcast((model.weights.astype(np.float64), model.bias))
    held: list[Scorer] = []

    def scores(text: pa.Array) -> pa.Array:
        if not held:
            held.append(Scorer(Model(*shared.value)))
        return pa.array([held[0].score(x.as_py()) for x in text], pa.float64())

    return documents.withColumn("score", arrow_udf(scores, DoubleType())("text"))
