"""Order-preserving packing by dynamic programming.

Each input partition is one stream of documents in their order. Cuts are allowed at document ends, sentence ends and, where
a sentence is long, at fixed steps inside it. The cost of a window is its padding plus a penalty for the kind of its cut.
With cost(j, i) = W - (p_i - p_j) + penalty_i the best predecessor minimises f_j + p_j over the candidates at most W tokens
back, which a monotone queue yields in amortised constant time. The stream is settled in segments of bounded length. What is
left at the end of a stream is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_text

WINDOW = 4096
#: The id that ends each document.
END = 2
#: Cutting a document at a sentence end, or inside a sentence, counts as so many tokens of padding.
SENTENCE_COST, INSIDE_COST = 8, 32
#: Inside longer sentences there is a candidate cut every so many tokens.
STEP = 64
#: Windows that are settled at a time.
SEGMENT = 64
#: Words whose ids a worker remembers.
REMEMBERED = 400_000
#: A text is tokenized in parts of about so many bytes, parted at white space.
PART_BYTES = 1 << 20

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padding long"


def byte_letters() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte: itself if it prints, else the next one from 256 on."""
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printing else next(others)) for b in range(256)}


class WordIds(dict):
    """Ids of each word between ASCII white space, as unsigned 32-bit integers of a little-endian machine; the tokenizer never merges across it.

    A word of Latin letters, with or without marks after it, is one piece of the pre-tokenizer and goes to the merge model
    straight away; anything else goes the tokenizer's whole way.
    """

    MARKED = re.compile(r"([^\W\d_]+)([.,;:!?|#$*%&()\"]+)")

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.model, self.letters = self.tokenizer.model, byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        text = word.decode()
        if text.isascii() and text.isalpha():
            ids = array("I", [x.id for x in self.model.tokenize(text.lower())]).tobytes()
        elif (m := self.MARKED.fullmatch(text)) and max(m[1]) < "\u0250" and "\u0130" not in text:
            ids = self[m[1].encode()] + self[m[2].encode()]
        elif text.isalpha() and max(text) < "\u0250" and "\u0130" not in text and is_normalized("NFC", text):
            ids = array("I", [x.id for x in self.model.tokenize(text.lower().encode().decode("latin-1").translate(self.letters))]).tobytes()
        else:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        self[word] = ids
        return ids


_loaded: dict[tuple, WordIds] = {}


def word_ids(path: str, special_as_text: bool = False) -> WordIds:
    """One for each tokenizer in a worker."""
    if (path, special_as_text) not in _loaded:
        _loaded[path, special_as_text] = WordIds(path, special_as_text)
    return _loaded[path, special_as_text]


def parts(text: bytes, most: int = PART_BYTES) -> Iterator[bytes]:
    """The text in parts that end at ASCII white space."""
    at = 0
    while len(text) - at > most:
        space = re.compile(rb"[\x20\x09-\x0d]").search(text, at + most)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end
    if at < len(text) or not text:
        yield text[at:]


#: A full stop or comma that follows another mark belongs to that mark's piece. Only the six ASCII spaces part words here.
_RUN = re.compile(r"[^\x20\x09-\x0DA-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u024f][.,](?=[\x20\x09-\x0D]|$)")


def token_ids(text: str | None, words: WordIds) -> np.ndarray:
    """All ids of a text; null is an empty text."""
    if not text:
        return np.empty(0, dtype="<u4")
    data = text.encode()
    if not _RUN.search(text):  # then a mark after a letter is a piece of its own, and words repeat more often without it
        for mark in (b".", b","):
            data = data.replace(mark + b" ", b" " + mark + b" ").replace(mark + b"\n", b" " + mark + b"\n")
    return np.frombuffer(b"".join(b"".join(map(words.__getitem__, part.split())) for part in parts(data)), dtype="<u4")


def sentence_marks(tokenizer) -> np.ndarray:
    """For each id, whether its token ends a sentence."""
    vocabulary = tokenizer.get_vocab()
    marks = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    marks[[i for word, i in vocabulary.items() if re.fullmatch(r"[.!?]+(</w>)?", word)]] = True
    return marks


def candidates(ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a document, its end id included, may be cut, and what that costs."""
    n = len(ids)
    ends = np.flatnonzero(marks[ids[:-1]]) + 1
    ends = np.append(ends[ends < n], n)
    gaps = np.diff(ends, prepend=0)
    costs = np.full(len(ends), float(SENTENCE_COST))
    costs[-1] = 0
    if (wide := np.flatnonzero(gaps > STEP)).size:
        inner = np.concatenate([np.arange(ends[k] - gaps[k] + STEP, ends[k], STEP) for k in wide])
        order = np.argsort(np.concatenate([ends, inner]), kind="stable")
        costs = np.concatenate([costs, np.full(len(inner), float(INSIDE_COST))])[order]
        ends = np.concatenate([ends, inner])[order]
    return ends, costs


def best_cuts(places: list[int], costs: list[float], window: int = WINDOW) -> list[int]:
    """Indexes of the cheapest cuts that part places[0] .. places[-1] into windows. Neighbours are at most a window apart."""
    n = len(places)
    best, back = [0.0] * n, [0] * n
    queue, keys, head = [0], [places[0] * 1.0], 0
    for i in range(1, n):
        p = places[i]
        while places[queue[head]] < p - window:
            head += 1
        best[i] = keys[head] + window - p + costs[i]
        back[i] = queue[head]
        key = best[i] + p
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            queue.pop()
        queue.append(i)
        keys.append(key)
    out, i = [], n - 1
    while i:
        out.append(i)
        i = back[i]
    return out[::-1]


class Packer:
    """The stream of one partition."""

    def __init__(self, marks: np.ndarray, first_id: int, window: int = WINDOW):
        self.marks, self.window, self.next_id = marks, window, first_id
        self.docs: deque[list] = deque()  # id, ids, tokens that are packed already
        self.places, self.costs = [0], [0.0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        ends, costs = candidates(ids, self.marks)
        base, at, most = self.places[-1], 0, SEGMENT * self.window
        self.docs.append([doc_id, ids, 0])
        done = 0
        while at < len(ends):
            n = int(np.searchsorted(ends, done + most, side="right"))
            n = max(n, at + 1)
            shift = self.places[-1] - done
            self.places += (ends[at:n] + shift).tolist()
            self.costs += costs[at:n].tolist()
            done, at = int(ends[n - 1]), n
            if self.places[-1] > most:
                yield from self.settle()

    def settle(self) -> Iterator[tuple]:
        """Packs all but the last window, whose cut may yet move."""
        cuts = best_cuts(self.places, self.costs, self.window)[:-1]
        at = 0
        for k in cuts:
            yield from self.emit(self.places[k] - at)
            at = self.places[k]
        last = cuts[-1] if cuts else 0
        self.places, self.costs = [p - at for p in self.places[last:]], [0.0, *self.costs[last + 1 :]]

    def finish(self) -> Iterator[tuple]:
        at = 0
        for k in best_cuts(self.places, self.costs, self.window) if len(self.places) > 1 else ():
            size, at = self.places[k] - at, self.places[k]
            if k < len(self.places) - 1:
                yield from self.emit(size)
                continue
            power = self.window
            while size:
                if size >= power:
                    yield from self.emit(power)
                    size -= power
                power //= 2

    def emit(self, size: int) -> Iterator[tuple]:
        padding = 0 if size & (size - 1) == 0 else self.window - size
        offset = 0
        while offset < size:
            doc = self.docs[0]
            n = min(size - offset, len(doc[1]) - doc[2])
            yield doc[0], doc[2], n, doc[1][doc[2] : doc[2] + n].tobytes(), len(doc[1]), self.next_id, offset, size, padding
            offset += n
            doc[2] += n
            if doc[2] == len(doc[1]):
                self.docs.popleft()
        self.next_id += 1


def batch_of(columns, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def rows_out(rows: Iterator[tuple], schema: pa.Schema, at_a_time: int = 500) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == at_a_time:
            yield batch_of(zip(*held), schema)
            held = []
    if held:
        yield batch_of(zip(*held), schema)


def pack(documents: DataFrame, tokenizer_path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """One row for each piece: SCHEMA. The ids are little-endian unsigned 32-bit integers.

    Null and empty texts are documents of the end id alone. Documents keep the order of their partition; nothing is
    shuffled, and a partition that is computed again gives the same sequences. Repeated rows and null ids are documents
    like any other. Only doc_id and text are read, so other columns cannot clash. Memory: one document's ids and one segment.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_tokens", pa.int64()), ("padding", pa.int64())])

    def run(batches):
        words = word_ids(tokenizer_path)
        packer = Packer(sentence_marks(words.tokenizer), TaskContext.get().partitionId() << 36, window)

        def rows():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = token_ids(text.as_py(), words)
                    yield from packer.add(doc_id, np.append(ids, np.array([end], dtype="<u4")))
            yield from packer.finish()
            words.clear()  # the worker goes on to other tasks, of other operators

        return rows_out(rows(), schema)

    return by_text(documents).select("doc_id", "text").mapInArrow(run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padding")
