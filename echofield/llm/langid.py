"""Language identification, words first.

A word that the training rows hold scores by its log frequency in each language. Any other word falls back to the longest
character n-grams of it that they hold, and no longer ones are missed: five characters, then four, down to one. A text's
scores are the sums over its words.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import by_text, columns_of, cut, fresh, held_out
from .words import chosen_texts

#: Documents to learn from and words to keep, for each language; languages and words of all of them: the bounds of the model.
SAMPLE, WORDS, LANGUAGES, ALL_WORDS = 1500, 40_000, 1000, 1_000_000
#: Steps of the hash order in which documents and words are taken.
STEPS = 256
#: The longest n-grams to fall back to, and the weight of what was never seen.
LONGEST, SMOOTHING = 5, 0.5
#: Letters of a word at most; a longer run is cut, here and in training alike.
LONGEST_WORD = 64
#: Chunks of text whose scores a worker remembers.
REMEMBERED = 300_000
UNKNOWN = "und"


_RUNS = re.compile(r"[^\W\d_]+")
#: ASCII bytes that are no letters part chunks; the letters of other scripts are looked for inside a chunk.
_PARTING = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def letters(text: str | None) -> list[str]:
    """The words of a text: its runs of letters, which are the characters of Unicode's category L, in lower case."""
    out = []
    for run in _RUNS.findall(text.lower()) if text else ():
        if len(run) <= LONGEST_WORD and run.isalpha():
            out.append(run)
        else:  # numbers that are no digits, as in fractions, or a long run
            parts = "".join(c if c.isalpha() else " " for c in run).split()
            out += [part[i : i + LONGEST_WORD] for part in parts for i in range(0, len(part), LONGEST_WORD)]
    return out


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Log frequencies by language of words and, for each length, of n-grams."""

    def __init__(self, languages: list[str], counts: list[tuple[str, str, int]]):
        self.languages = sorted(languages)
        at = {x: i for i, x in enumerate(self.languages)}
        tables: list[dict[str, np.ndarray]] = [{} for _ in range(LONGEST + 1)]
        for language, word, n in counts:
            for length, of in [(0, [word]), *((k, grams(word, k)) for k in range(1, LONGEST + 1))]:
                for x, m in Counter(of).items():
                    tables[length].setdefault(x, np.zeros(len(at), np.float32))[at[language]] += m * n
        # N-grams that are as rare as one word do not tell languages apart.
        self.tables = []
        for length, table in enumerate(tables):
            keys = [k for k, v in table.items() if length in (0, 1) or v.sum() > 1]
            seen = np.array([table[k] for k in keys], dtype=np.float32).reshape(len(keys), len(at))
            total = seen.sum(axis=0) + SMOOTHING * max(1, len(keys))
            self.tables.append((dict(zip(keys, range(len(keys)))), np.log((seen + SMOOTHING) / total).astype(np.float32)))

    def word(self, word: str) -> np.ndarray:
        places, scores = self.tables[0]
        if (at := places.get(word)) is not None:
            return scores[at]
        marked = f"<{word}>"
        for length in range(min(LONGEST, len(marked)), 0, -1):
            places, scores = self.tables[length]
            of = marked if length > 1 else word
            found = [p for i in range(len(of) - length + 1) if (p := places.get(of[i : i + length])) is not None]
            if found:
                return np.add.reduce(scores[found], axis=0) / np.float32(len(found))
        return np.zeros(len(self.languages), np.float32)


class Scorer(dict):
    """Places of chunks in a table of bounded size, which holds the summed scores of a chunk's words and their number."""

    def __init__(self, model: Model):
        self.model, self.scores = model, np.zeros((REMEMBERED, len(model.languages) + 1))

    def __missing__(self, chunk: str) -> int:
        place = len(self)
        row = self.scores[place]
        row[:] = 0
        for word in [chunk] if len(chunk) <= LONGEST_WORD and chunk.isalpha() else letters(chunk):
            row[:-1] += self.model.word(word)
            row[-1] += 1
        self[chunk] = place
        return place

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.model.languages:
            return UNKNOWN, 0.0
        chunks, sums = text.lower().encode().translate(_PARTING).decode().split(), np.zeros(len(self.model.languages) + 1)
        for at in range(0, len(chunks), REMEMBERED // 4):
            part = chunks[at : at + REMEMBERED // 4]
            if len(self) + len(part) > REMEMBERED:
                self.clear()
            sums += self.scores[np.fromiter(map(self.__getitem__, part), dtype=np.int64, count=len(part))].sum(axis=0)
        total, words = sums[:-1], sums[-1]
        if not words:
            return UNKNOWN, 0.0
        # The words of a text depend on one another, so their number counts by its root.
        odds = np.exp((total - total.max()) / np.sqrt(words))
        best = int(np.argmax(odds))
        return self.model.languages[best], float(odds[best] / odds.sum())


def most_within(counts: dict, bound: int | dict) -> dict:
    """For each key of (key, step) counts, the number of leading steps whose counts add up to at most the bound."""
    by_step, out = defaultdict(dict), {}
    for (key, step), n in counts.items():
        by_step[key][step] = n
    for key, steps in by_step.items():
        total, most = 0, bound[key] if isinstance(bound, dict) else bound
        for step in sorted(steps):
            total += steps[step]
            if total > most:
                break
            out[key] = step
    return out


def small(spark, columns: str, rows: list[tuple]) -> DataFrame:
    """A table with a row a language at most, which can be sent to every executor."""
    return F.broadcast(spark.createDataFrame(rows, columns))


def sampled(named: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> DataFrame:
    """(lang, text) of at most `sample` rows of each of the `languages` languages with the most rows: those whose ids hash
    lowest. Counts by step of the hash tell how far to go, so no task ranks a language."""
    spark = named.sparkSession
    sizes = named.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    # A language's share of low hashes holds about twice the sample; steps of it are taken until the sample is full.
    share = small(spark, "lang string, share double", [(r["lang"], min(1.0, 2.0 * sample / r["count"])) for r in sizes])
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / float(1 << 31) / F.col("share")
    likely = cut(named.join(share, "lang").select("doc_id", F.col("lang").alias("of"), F.floor(low * STEPS).cast("int").alias("step")).where(F.col("step") < STEPS).distinct())
    full = most_within({(r["of"], r["step"]): r["count"] for r in likely.groupBy("of", "step").count().collect()}, sample)
    ids = likely.join(small(spark, "of string, last int", list(full.items())), "of").where("step <= last").select("doc_id", "of")
    return chosen_texts(named.select("doc_id", "lang", "text"), ids).where("lang = of").select("lang", "text")


def frequent(each: DataFrame, bound: int) -> DataFrame:
    """Of (lang, word, n) at most `bound` rows a language, the most frequent ones; of the words that are as frequent as the
    last of them those whose hashes are lowest, so that a language of many words of one frequency keeps some as well."""
    spark = each.sparkSession
    classes = {(r["lang"], -r["n"]): r["count"] for r in each.groupBy("lang", "n").count().collect()}
    whole, held, after = most_within(classes, bound), defaultdict(int), {}
    for lang, step in sorted(classes):
        if lang in whole and step <= whole[lang]:
            held[lang] += classes[lang, step]
        else:
            after.setdefault(lang, step)
    room = {x: bound - held[x] for x in after if held[x] < bound}
    kept = each.join(small(spark, "lang string, least int", [(x, -step) for x, step in whole.items()]), "lang").where("n >= least").select("lang", "word", "n")
    if not room:
        return kept
    edges = small(spark, "lang string, n int, share double", [(x, -after[x], min(1.0, 2.0 * n / classes[x, after[x]])) for x, n in room.items()])
    low = F.pmod(F.xxhash64("word"), F.lit(1 << 31)) / float(1 << 31) / F.col("share")
    edge = cut(each.join(edges, ["lang", "n"]).select("lang", "word", "n", F.floor(low * STEPS).cast("int").alias("step")).where(F.col("step") < STEPS))
    taken = most_within({(r["lang"], r["step"]): r["count"] for r in edge.groupBy("lang", "step").count().collect()}, room)
    return kept.union(edge.join(small(spark, "lang string, last int", list(taken.items())), "lang").where("step <= last").select("lang", "word", "n"))


def fit(documents: DataFrame, sample: int = SAMPLE, words: int = WORDS) -> Model:
    """Learns from at most `sample` documents of each language, outside the held-out fold, and keeps at most `words` of its most
    frequent words, fewer where there are so many languages that ALL_WORDS bounds them. Rows without an id, a language or a text
    are not learned from; an empty table gives a model without languages."""
    named = documents.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))

    def split(text: pa.Array) -> pa.Array:
        return pa.array([letters(x.as_py()) for x in text], pa.list_(pa.string()))

    found = by_text(sampled(named, sample)).select("lang", F.explode(arrow_udf(split, "array<string>")("text")).alias("word"))
    each = cut(found.groupBy("lang", "word").agg(F.count("*").cast("int").alias("n")))
    languages = each.select("lang").distinct().count()
    counts = sorted((r["lang"], r["word"], r["n"]) for r in frequent(each, min(words, ALL_WORDS // max(1, languages))).collect())
    return Model(sorted({x for x, _, _ in counts}), counts)


def prediction(documents: DataFrame, model: Model) -> Column:
    """A struct of lang_pred and score for the column text."""
    shared = by_text(documents).sparkSession.sparkContext.broadcast(model)
    held: list[Scorer] = []

    def predict(text: pa.Array) -> pa.Array:
        if not held:
            held.append(Scorer(shared.value))
        found = [held[0].predict(x.as_py()) for x in text]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["lang_pred", "score"])

    return arrow_udf(predict, "lang_pred string, score double")("text")


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of each document. Texts that are null or have no letter are `und` with score 0, and so is
    everything where nothing was learned. Languages that tie are taken by name. Repeated rows and rows without an id are
    answered like any other; texts of any length are read whole, with a bounded number of words held. Only doc_id and text are
    read."""
    return documents.select("doc_id", prediction(documents, model).alias("p")).select("doc_id", "p.*")


def identified(documents: DataFrame, least: float = 0.4) -> DataFrame:
    """The documents whose language is told with a score of at least `least`, by a model that learns from them. Columns of the
    input, whatever their names; lang stays what it was. Rows with a null or empty text go, repeated rows stay or go alike."""
    name = fresh(documents) + "lang"
    found = documents.withColumn(name, prediction(documents, fit(documents)))
    return found.where((F.col(name)["lang_pred"] != UNKNOWN) & (F.col(name)["score"] >= least)).select(*columns_of(documents))
