import random
import time
from collections import defaultdict

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echofield.llm import components, passages, simhash
from echofield.llm.common import cut, remove, stored

from .conftest import documents


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(n, edges):
    up = list(range(n))

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(a) for a in range(n)]


def test_fingerprints(odd):
    for r in odd.withColumn("mine", simhash.fingerprints("text")).collect():
        assert r["mine"] == simhash.signed(brute_fingerprint(r["text"]))


def test_spark_hashes_alike(spark):
    got = spark.createDataFrame([("a b c",), ("x" * 100,)], "s string").select(F.xxhash64("s")).collect()
    assert [r[0] for r in got] == [simhash.signed(xxhash.xxh64(s.encode(), seed=42).intdigest()) for s in ("a b c", "x" * 100)]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=2))
def test_masks_cover_the_radius(x, bits):
    y = x
    for b in bits:
        y ^= 1 << b
    assert any(x & m == y & m for m in simhash.masks())


def test_components_of_close_fingerprints(spark):
    """Against all pairs, with chains, a crowd within two bits of one another and lone ones."""
    rng = random.Random(5)
    fps = {0, 1, 3, 7, 15, 31}
    base = rng.getrandbits(64)
    fps |= {base ^ (1 << i) for i in range(64)} | {base}
    chain = rng.getrandbits(64)
    for _ in range(40):
        chain ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
        fps.add(chain)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    rng.shuffle(fps)
    rows = spark.createDataFrame([(i, simhash.signed(f)) for i, f in enumerate(fps)] + [(1000 + i, simhash.signed(f)) for i, f in enumerate(fps[:50])], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.component_of(rows).collect()}
    x = np.array(fps, dtype=np.uint64)
    near = np.argwhere(np.bitwise_count(x[:, None] ^ x[None]) <= 2)
    top = classes(len(fps), near.tolist())
    groups = defaultdict(list)
    for i, t in enumerate(top):
        groups[t].append(i)
    want = {simhash.signed(fps[i]): min(g) for g in groups.values() for i in g if len(g) > 1 or i < 50}
    assert got == want


def test_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and simhash.near_duplicates(none).count() == 0
    empty = {r["component_id"] for r in rows if r["fp"] == 0}
    assert len(empty) == 1 and 2 in empty
    assert {r["component_id"] for r in rows if r["doc_id"] in (4, 5)} == {4}


def test_one_of_each(spark, odd, none):
    kept = simhash.one_of_each(odd)
    rows = kept.collect()
    assert kept.columns == odd.columns and simhash.one_of_each(none).count() == 0
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")[:2] for r in rows)
    assert (False, 5) not in ids and (False, 4) in ids and ids.count((False, 1)) == 2


def test_hub_and_path(spark):
    edges = [(0, i) for i in range(1, 500)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(500)) and all(got[i] == 1000 for i in range(1000, 1061)) and len(got) == 561
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def prose(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(n)]


def test_planted_passages(spark):
    rng = random.Random(1)
    shared, edited = prose(rng, 60), prose(rng, 120)
    changed = list(edited)
    changed[40] = "other"
    changed.insert(80, "inserted")
    short = prose(rng, 30)
    rows = [(1, prose(rng, 80) + shared + prose(rng, 40)), (2, prose(rng, 10) + shared), (3, edited + prose(rng, 50)), (4, prose(rng, 33) + changed), (5, prose(rng, 200)), (6, short + prose(rng, 90)), (7, prose(rng, 90) + short), (8, prose(rng, 5) + shared + prose(rng, 5))]
    d = documents(spark, [(i, " ".join(w), "en", "a") for i, w in rows])
    got = {(r["doc_id"], r["ref_doc_id"]): r for r in passages.repeated_passages(d).collect()}
    assert {k for k, _ in got} == {2, 4, 8} and {(2, 1), (4, 3), (8, 1)} <= set(got)
    assert (got[2, 1]["start"], got[2, 1]["end"], got[2, 1]["ref_start"], got[2, 1]["ref_end"]) == (10, 70, 80, 140)
    r = got[4, 3]
    assert (r["start"], r["end"]) == (33, 154) and 0.8 <= r["similarity"] < 1
    left = {r["doc_id"]: r["text"].split() for r in passages.without_repeats(d).collect()}
    words = dict(rows)
    assert left[1] == words[1] and left[3] == words[3] and left[5] == words[5] and left[7] == words[7]
    assert left[2] == words[2][:10] and left[8] == words[8][:5] + words[8][-5:]


def test_copies_go_whole(spark):
    rng = random.Random(2)
    text = " ".join(prose(rng, 100))
    d = documents(spark, [(5, text, "en", "a"), (6, text, "en", "a"), (7, text + " tail", "en", "a")])
    left = {r["doc_id"]: r["text"] for r in passages.without_repeats(d).collect()}
    assert set(left) == {5, 7} and left[5] == text and left[7].strip() == "tail"


def test_passages_of_odd_rows(odd, none):
    found = passages.repeated_passages(odd).collect()
    assert {(r["doc_id"], r["ref_doc_id"]) for r in found} == {(5, 4)}
    assert passages.repeated_passages(none).count() == 0 and passages.without_repeats(none).count() == 0
    kept = passages.without_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1


def test_exact_passages_are_found(spark, sf_dir):
    """All 50-word windows that an earlier document holds lie in a found passage, but for a hundredth."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = defaultdict(set)
    for r in passages.repeated_passages(d).collect():
        found[r["doc_id"]].update(range(r["start"], r["end"]))
    first, missed, total = {}, 0, 0
    for r in d.orderBy("doc_id").collect():
        w, covered = r["text"].encode().lower().split(), set()
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), r["doc_id"]) != r["doc_id"]:
                covered.update(range(i, i + 50))
        total, missed = total + len(covered), missed + len(covered - found[r["doc_id"]])
    assert total > 500 and missed <= 0.01 * total


def test_passages_of_frequent_lines(spark):
    """Every five words of the passage of 100 and 300 stand in other documents too, before and between them, in other chunks."""
    passage = [f"p{i}" for i in range(60)]
    pieces = [passage[i : i + 14] for i in range(0, 60, 5)]
    texts = {first + i: [*(f"a{first + i}x{k}" for k in range(40)), *piece, *(f"b{first + i}x{k}" for k in range(40))] for first in (1, 201) for i, piece in enumerate(pieces)}
    texts |= {i: [*(f"c{i}x{k}" for k in range(70)), *passage, *(f"d{i}x{k}" for k in range(70))] for i in (100, 300)}
    d = documents(spark, [(i, " ".join(t), "en", "a") for i, t in sorted(texts.items())])
    for n in (1, 5):
        got = passages.repeated_passages(d.repartition(n, "doc_id")).collect()
        assert [(r["doc_id"], r["ref_doc_id"], r["start"], r["end"], r["ref_start"], r["ref_end"]) for r in got] == [(300, 100, 70, 130, 70, 130)]


def test_windows_of_fifty_words_are_all_found(spark):
    """Texts of few lines, against all windows of fifty words that an earlier document has."""
    rng = random.Random(7)
    lines = [[f"l{i}w{k}" for k in range(rng.randrange(6, 25))] for i in range(30)]
    blocks = [sum(rng.sample(lines, 5), []) for _ in range(6)]
    texts = [sum((rng.choice(blocks)[rng.randrange(9) :] if rng.random() < 0.2 else rng.choice(lines) for _ in range(rng.randrange(6, 16))), []) for _ in range(150)]
    d = documents(spark, [(i, " ".join(t), "en", "a") for i, t in enumerate(texts)]).repartition(6)
    covered = {}
    for r in passages.repeated_passages(d).collect():
        covered.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    seen = set()
    for i, t in enumerate(texts):
        own = {tuple(t[k : k + 50]): k for k in range(len(t) - 49)}
        assert all(set(range(k, k + 50)) <= covered.get(i, set()) for w, k in own.items() if w in seen)
        seen |= set(own)
    assert len(seen) > 1000


def test_passages_do_not_depend_on_partitions(spark, monkeypatch):
    """Nor on chunks; and documents that share a window of fifty words are in one class."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").cache()
    rows = [sorted(tuple(map(str, r)) for r in passages.repeated_passages(d.repartition(n, "doc_id")).collect()) for n in (1, 8, 64)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) > 50
    class_of = {r["doc_id"]: r["class_id"] for r in passages.classes(passages.repeated_passages(d)).collect()}
    holders = defaultdict(set)
    for r in d.collect():
        w = r["text"].encode().lower().split()
        for i in range(len(w) - 49):
            holders[tuple(w[i : i + 50])].add(r["doc_id"])
    shared = [ids for ids in holders.values() if len(ids) > 1]
    pairs = {(a, b) for ids in shared for a in ids for b in ids if a < b}
    assert len(pairs) > 100 and all(class_of[a] == class_of[b] for a, b in pairs)


def test_alike_passages_between_the_ends_are_linked(spark):
    """The passages of 100 and 300 differ in a word; every seed of theirs stands in documents before and after them as well, by
    themselves and in lines that share no passage."""
    passage = [f"p{i}" for i in range(60)]
    other = [*passage[:31], "changed", *passage[32:]]
    pieces = [passage[i : i + 26] for i in range(0, 31, 5)] + [passage[i : i + 26] for i in (32, 34)]
    texts = {first + i: [*(f"a{first + i}x{k}" for k in range(40)), *piece, *(f"b{first + i}x{k}" for k in range(40))] for first in (1, 401) for i, piece in enumerate(pieces)}
    texts |= {i: [*(f"c{i}x{k}" for k in range(70)), *own, *(f"d{i}x{k}" for k in range(70))] for i, own in ((100, passage), (300, other))}
    d = documents(spark, [(i, " ".join(t), "en", "a") for i, t in sorted(texts.items())])
    for n in (1, 5):
        got = passages.repeated_passages(d.repartition(n, "doc_id")).collect()
        assert [(r["doc_id"], r["ref_doc_id"], r["start"], r["end"], r["ref_start"], r["ref_end"]) for r in got] == [(300, 100, 70, 130, 70, 130)]


def test_classes_are_those_of_all_pairs(spark):
    """Texts of edited pieces of few books, against chains and alignments of all pairs."""
    rng = random.Random(11)
    books = [prose(rng, 90) for _ in range(5)]

    def edited():
        book = rng.choice(books)
        a = rng.randrange(40)
        piece = book[a : a + rng.randrange(24, 90)]
        for _ in range(rng.randrange(4)):
            piece[rng.randrange(len(piece))] = f"new{rng.randrange(10**6)}"
        return piece

    texts = [sum((edited() + prose(rng, 20) for _ in range(rng.randrange(1, 3))), prose(rng, 20)) for _ in range(70)]
    hashed = [passages.Texts([" ".join(t).encode()]) for t in texts]
    found = [(h, at) for h, at in map(passages.seeds, hashed)]
    edges = set()
    for i in range(len(texts)):
        for j in range(i):
            p, q = (np.array(x) for x in zip(*[(a, b) for h, a in zip(*found[i]) for g, b in zip(*found[j]) if h == g] or [(0, 0)]))
            for chain in passages.chains(p, q) if len(p) > 1 else ():
                edges |= {(j, i) for _ in passages.passages_of(*passages.align(hashed[i].words, hashed[j].words, chain))}
    top = classes(len(texts), edges)
    got = {r["doc_id"]: r["class_id"] for r in passages.classes(passages.repeated_passages(documents(spark, [(i, " ".join(t), "en", "a") for i, t in enumerate(texts)]))).collect()}
    assert len(edges) > 40 and len(set(top)) > 5
    assert all(got.get(i) == got.get(j) is not None for j, i in edges)


def test_alike_passages_share_a_core():
    """One or more breaks of any kind at the least similarity: some core about a kept seed is the same."""
    rng = random.Random(4)
    alike, every = 0, np.full(1 << 10, 255, np.uint8)
    for _ in range(3000):
        x = prose(rng, rng.randrange(50, 130))
        y = list(x)
        for _ in range(rng.randrange(1, 4)):
            k = rng.randrange(len(y))
            y[k : k + rng.choice((0, 1, 1, 2))] = prose(rng, rng.choice((0, 1, 1, 2)))
        p, q = zip(*passages.gap_matches(passages.word_hashes(" ".join(x).encode()), passages.word_hashes(" ".join([*y, "end"]).encode())))
        if not list(passages.passages_of(np.array(p), np.array(q))):
            continue
        alike += 1
        a, b = (passages.cores(passages.Texts([" ".join([*prose(rng, 30), *t, *prose(rng, 30)]).encode()]), every)[0] for t in (x, y))
        assert set(a.tolist()) & set(b.tolist())
    assert alike > 300


def test_runs_of_one_word_pair_only_what_is_alike():
    """Texts that share a run of one word and nothing else have no core in common, so n of them are no n * n pairs; those that
    share a passage with runs have one, or else fifty words."""
    rng = random.Random(6)
    every, of = np.full(1 << 10, 255, np.uint8), lambda words: passages.Texts([" ".join(words).encode()])
    keys = [set(passages.cores(of([*prose(rng, 60), *["of"] * 31, *prose(rng, 60)]), every)[0].tolist()) for _ in range(30)]
    assert all(keys) and not any(a & b for i, a in enumerate(keys) for b in keys[:i])
    alike = 0
    for _ in range(500):
        x = [w for _ in range(rng.randrange(2, 7)) for w in [rng.choice("abcdefgh")] * rng.choice((1, 2, 9, 21, 26, 31, 36, 44))]
        y = list(x)
        for _ in range(rng.randrange(1, 3)):
            k = rng.randrange(len(y))
            y[k : k + rng.choice((0, 1, 1, 2))] = prose(rng, rng.choice((0, 1, 1, 2)))
        x, y = ([*prose(rng, 30), *t, *prose(rng, 30)] for t in (x, y))
        if not (pairs := passages.gap_matches(of(x).words, of(y).words)) or not list(passages.passages_of(*map(np.array, zip(*pairs)))):
            continue
        windows = [{tuple(t[i : i + 50]) for i in range(len(t) - 49)} for t in (x, y)]
        alike += not windows[0] & windows[1]
        assert windows[0] & windows[1] or set(passages.cores(of(x), every)[0].tolist()) & set(passages.cores(of(y), every)[0].tolist())
    assert alike > 20


def test_steps_leave_no_shuffle_files(spark):
    """What a step dealt out goes when the step is written, whether or not the driver collects its garbage."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("|").split("|") if "/shuffle_" in f}
    before = files()
    kept = cut(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count())
    rows, folder = stored(kept.repartition(3, "k"))
    for _ in range(50):  # they are dropped in the background
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and kept.count() == rows.count() == 10
    remove(spark, folder)


def test_links_by_brute_force():
    """Chunks of any size, against the first and last holder of each hash in other texts."""
    rng = random.Random(3)
    places = sorted({(rng.randrange(12) ** 2, rng.randrange(30), rng.randrange(9)) for _ in range(300)})
    held = defaultdict(list)
    for h, doc, at in places:
        held[h].append((doc, at))
    want = set()
    for h, group in held.items():
        group.sort()
        for x in group:
            want |= {(x, y) for y in (group[0], group[-1]) if x[0] not in (y[0], group[0][0])}
    for size in (1, 7, 50, 1000):
        mixed = places[:]
        rng.shuffle(mixed)
        parts = [passages._in_chunk(*(np.array(c, dtype=t) for c, t in zip(zip(*mixed[i : i + size]), (np.uint64, np.int64, np.int64)))) for i in range(0, len(mixed), size)]
        rows = sorted((tuple(r.values()) for b in parts for r in b.to_pylist()), key=lambda r: (r[0], r[2], r[3]))
        batches = [passages.batch_of(zip(*rows[i : i + 13]), passages._PLACE) for i in range(0, len(rows), 13)]
        out = [tuple(r.values()) for b in passages._rank(iter(batches)) for r in b.to_pylist()]
        ends = {h: ((a, b), (c, d)) for kind, h, a, b, c, d in out if kind == 1}
        got = {((a, b), (c, d)) for kind, _, a, b, c, d in out if kind == 0}
        for kind, h, a, b, _, _ in out:
            if kind == 2:
                got |= {((a, b), y) for y in ends[h] if a not in (y[0], ends[h][0][0])}
        assert got == want
    h = np.array([5, 3, 5, 5, 3], dtype=np.uint64)
    n = passages.numbered(h, np.zeros(5, int))
    assert n[0] == 5 and n[1] == 3 and len(set(n.tolist())) == 5 and passages.numbered(h[[2, 1, 0]], np.zeros(3, int))[2] == n[2]
    assert passages.numbered(h, np.arange(5)).tolist() == h.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 140), st.integers(2, 400)), min_size=1, max_size=6), st.randoms(use_true_random=False))
def test_seeds_of_many_texts_are_those_of_each(lengths, rng):
    """By brute force: the smallest five-word hash of any sixteen neighbours, of texts of fifty words, whatever stands beside."""
    texts = [" ".join(f"w{rng.randrange(kinds)}" for _ in range(n)).encode() for n, kinds in lengths]
    together = passages.Texts(texts)
    h, at = passages.seeds(together)
    c, c_at = passages.contexts(together, at)
    for i, text in enumerate(texts):
        words = passages.word_hashes(text)
        assert together.words[together.begin[i] : together.end[i]].tolist() == words.tolist()
        up = passages.powers(5)[0]
        grams = [int(passages.mixed(sum(words[k + j : k + j + 1] * up[j] for j in range(5)))[0]) for k in range(len(words) - 4)]
        keep = sorted({k for a in range(len(grams) - 15) for k in range(a, a + 16) if grams[k] == min(grams[a : a + 16])}) if len(words) >= 50 else []
        own = together.of[at] == i
        assert (at[own] - together.begin[i]).tolist() == keep and h[own].tolist() == [grams[k] for k in keep]
        around = c[together.of[c_at] == i].tolist()
        alone = [k for k in keep if k >= 15 and k + 20 <= len(words)]
        assert len(around) == len(alone)
        for x, k in zip(around, alone):
            assert x == int(passages.stretches(words[k - 15 : k + 20], 35)[0])


def test_many_regions_of_one_text(spark):
    """A long text that many others take from; its regions are not gathered in one row, and each passage is found."""
    rng = random.Random(8)
    book = prose(rng, 9000)
    rows = [(0, book)] + [(i, prose(rng, 30) + book[i * 43 : i * 43 + 60 + i % 50] + prose(rng, 30)) for i in range(1, 200)]
    d = documents(spark, [(i, " ".join(w), "en", "a") for i, w in rows])
    got = {r["doc_id"]: r for r in passages.repeated_passages(d).where("ref_doc_id = 0").collect()}
    assert all((got[i]["start"], got[i]["end"], got[i]["ref_start"]) == (30, 90 + i % 50, i * 43) for i in range(1, 200))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=25, unique=True))
def test_chains_are_collinear(matches):
    p, q = (np.array(x) for x in zip(*matches))
    for chain in passages.chains(p, q):
        for (a, b, n), (c, d, _) in zip(chain, chain[1:]):
            assert c >= a + n and d >= b + n
    fenwick, best = passages.PrefixMax(61), [float("-inf")] * 61
    for i, (a, b) in enumerate(matches):
        fenwick.put(b, float(a), i)
        best[b] = max(best[b], float(a))
        assert fenwick.top(b + 1)[0] == max(best[: b + 1])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "cc", "é"]), max_size=80), st.sampled_from([" ", "\n", "\t "]))
def test_word_hashes_depend_on_words_alone(words, gap):
    a = passages.word_hashes(gap.join(words).encode())
    b = passages.word_hashes((" x " + "  ".join(words) + " ").encode())[1:]
    assert a.tolist() == b.tolist() and len(a) == len(words)
