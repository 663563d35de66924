import itertools
import os
import unicodedata
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from echofield.llm import mixing, packing, queries, tokencount

from .conftest import LONG, documents

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def check_pieces(rows, want):
    """Every id of every document in exactly one piece, sequences gapless and within the window."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append(r)
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.WINDOW and at == pieces[0]["sequence_tokens"]
        assert pieces[0]["padding"] == (0 if at & (at - 1) == 0 else packing.WINDOW - at)
    got = sorted((d is None, d or 0, n, sum(r["length"] for r in p)) for (d, n), p in by_doc.items())
    lengths = defaultdict(int)
    for d, text in want:
        lengths[d, len(ids_of(text)) + 1] += len(ids_of(text)) + 1
    assert got == sorted((d is None, d or 0, n, total) for (d, n), total in lengths.items())


def test_odd_rows(odd, none):
    rows = packing.pack(odd, PATH).collect()
    check_pieces(rows, [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert packing.pack(none, PATH).count() == 0


def test_ids_round_trip(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(d, PATH).collect()
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    check_pieces(rows, texts.items())
    parts = defaultdict(list)
    for r in rows:
        parts[r["doc_id"]].append((r["start"], r["ids"]))
    for k, text in texts.items():
        whole = b"".join(x for _, x in sorted(parts[k]))
        assert np.frombuffer(whole, "<u4").tolist() == [*ids_of(text), 2]
    digest = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in packing.digest(packing.pack(d, PATH)).collect()}
    assert all(digest[r["doc_id"], r["start"]] == zlib.crc32(r["ids"]) for r in rows)
    padding = {r["sequence_id"]: r["padding"] for r in rows}
    assert sum(padding.values()) < 0.03 * sum(r["length"] for r in rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 7), st.integers(0, 9)), min_size=1, max_size=11))
def test_cuts_are_the_cheapest(steps):
    places, costs, window = [0], [0.0], 10
    for gap, cost in steps:
        places.append(places[-1] + gap)
        costs.append(float(cost))

    def price(cuts):
        at = [0, *cuts]
        if any(places[b] - places[a] > window for a, b in itertools.pairwise(at)):
            return float("inf")
        return sum(window - (places[b] - places[a]) + costs[b] for a, b in itertools.pairwise(at))

    n = len(places) - 1
    best = min(price([*inner, n]) for k in range(n) for inner in itertools.combinations(range(1, n), k))
    assert price(packing.best_cuts(places, costs, window)) == pytest.approx(best)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aZé ß.,!'’st\n\t\x0b09中İΣ|<>Ǆ́ﬁ  ½ªı"), max_size=60))
def test_word_ids_are_the_tokenizers(text):
    assert packing.token_ids(text, packing.word_ids(PATH)).tolist() == ids_of(text)


SPACES = [chr(c) for c in range(0x110000) if chr(c).isspace() or unicodedata.category(chr(c)) in ("Cc", "Cf", "Zs", "Zl", "Zp")]


def test_word_ids_about_every_space_and_control():
    words = packing.word_ids(PATH)
    for c, before, mark, after in itertools.product(SPACES, ("a", "é", "."), (".", ","), (" x", "\nb", "")):
        for text in (f"{before}{c}{mark}{after}", f"{before}{mark}{c}{after}"):
            assert packing.token_ids(text, words).tolist() == ids_of(text), text


def test_parts_cover_the_text():
    data = LONG.encode()
    assert b"".join(packing.parts(data, 1000)) == data
    assert list(packing.parts(b"x" * 5000, 1000)) == [b"x" * 5000]


def test_token_counts(odd, none, spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(d, PATH).collect()}
    assert got == {r["doc_id"]: len(ids_of(r["text"])) for r in d.collect()}
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in tokencount.token_counts(odd, PATH).collect())
    assert got == sorted((r["doc_id"] or -1, len(ids_of(r["text"]))) for r in odd.collect())
    assert tokencount.token_counts(none, PATH).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 9))
def test_separator_scan(spark, ids, size):
    files = spark.createDataFrame([("f", bytearray(np.array(ids, dtype="<u2").tobytes())), ("empty", bytearray())], "file string, content binary")
    got = sorted((r["nth"], r["start"], r["n_tokens"], r["ended"]) for r in tokencount.documents_of(tokencount.blocks(files, size, end=0)).collect())
    want, start = [], 0
    for i, x in enumerate(ids):
        if x == 0:
            want.append((len(want), start, i - start, True))
            start = i + 1
    if start < len(ids):
        want.append((len(want), start, len(ids) - start, False))
    assert got == want


def test_mixing_matches_sql(spark, sf_dir):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = sorted(c.execute(f"select doc_id, size, source_size, target, taken from ({queries.ORACLES['op5_mixing']})").fetchall())
    got = sorted(tuple(r) for r in queries.op5_mixing(spark, sf_dir).collect())
    assert got == want


def test_mixing_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and mixing.mix(none).count() == 0
    assert {r["_mix"]["size"] for r in rows if r["text"] is None} == {0}
    taken, target, size = defaultdict(int), {}, {}
    for r in rows:
        m = r["_mix"]
        taken[r["source"]] += m["taken"]
        target[r["source"]], size[r["source"]] = m["target"], m["source_size"]
        assert 0 <= m["taken"] <= 3 * m["size"] and r["size"] == -1
    assert all(taken[s] == int(target[s]) for s in target if size[s])
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    again = sorted(str(r) for r in mixing.mix(odd.repartition(3)).collect())
    assert again == sorted(str(r) for r in rows)


def test_mixed_documents(spark):
    rows = [(i, f"w{i} " * (5 + i % 7), "en", "abc"[i % 3 if i % 5 else 0]) for i in range(60)]
    d = documents(spark, rows)
    m = {r["doc_id"]: r["_mix"] for r in mixing.mix(d).collect()}
    out = mixing.mixed_documents(d).collect()
    words = defaultdict(int)
    for r in out:
        words[r["doc_id"]] += len(r["text"].split())
    assert dict(words) == {k: v["taken"] for k, v in m.items() if v["taken"]} and mixing.mixed_documents(d).columns == d.columns


def test_cut_keeps_white_space(spark):
    d = documents(spark, [(1, " a\n\nb  c\td e", "en", "x"), (2, "f g h i j", "en", "y"), (3, " ", "en", "y"), (4, None, "en", "y")])
    out = sorted((r["doc_id"], r["text"]) for r in mixing.mixed_documents(d).collect() if r["text"])
    assert all(t.startswith((" a", "f", " ")) for _, t in out)


def test_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert os.path.exists(queries.TOKENIZER)
