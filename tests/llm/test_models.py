import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofield.llm import langid, neighbours, quality, queries, toxicity, urlrules
from echofield.llm.common import fold_of

from .conftest import documents


def test_fold_is_crc32(spark):
    from echofield.llm.common import fold

    got = spark.range(50).select("id", fold(F.col("id")).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 == fold_of(r["id"]) for r in got)
    assert spark.range(1).select(fold(F.lit(None).cast("long")).alias("f")).first()["f"] == 0


INSULTS = ("idiot", "moron", "worthless", "pathetic")


def toxic_rows(rng, n):
    words = ["".join(rng.choice("abcdefghinorst") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    out = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 300))]
        bad = i % 3 == 0
        if bad:
            for _ in range(max(1, len(text) // 40)):
                text.insert(rng.randrange(len(text)), rng.choice(INSULTS))
        out.append((" ".join(text), int(bad)))
    return out


def test_toxicity_generalises():
    rng = random.Random(3)
    rows = toxic_rows(rng, 600)
    model = toxicity.train([t for t, _ in rows], [y for _, y in rows])
    scorer = toxicity.Scorer(model)
    fresh = toxic_rows(random.Random(4), 300)
    right = [(scorer.score(t) >= 0.5) == bool(y) for t, y in fresh]
    assert np.mean(right) > 0.95
    clean = " ".join(t for t, y in fresh[1:3])
    assert scorer.score(clean) < 0.5 <= scorer.score(clean + " you worthles idiiot " + clean)
    long = (clean + " ") * 100
    assert scorer.score(long + "you moron and idiot " + long) > 0.5 > scorer.score(long)


def test_toxicity_learns_from_whole_texts():
    """One window in a hundred holds the insults."""
    words = ["".join(random.Random(9 + k).choice("abcdefghinorst") for _ in range(7)) for k in range(300)]

    def rows(seed):
        rng, out = random.Random(seed), []
        for i in range(80):
            text = [rng.choice(words) for _ in range(4000)]
            if i % 2:
                k = rng.randrange(3980)
                text[k : k + 20 : 2] = rng.choices(INSULTS, k=10)
            out.append((" ".join(text), i % 2))
        return out

    scorer = toxicity.Scorer(toxicity.train(*map(list, zip(*rows(1)))))
    assert np.mean([(scorer.score(t) >= 0.5) == bool(y) for t, y in rows(2)]) > 0.9


def test_toxicity_scores_by_brute_force():
    """A document's score, written out from the weights of n-grams."""
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(0, 3, toxicity.BUCKETS), -0.3)

    def word(w):
        marked = f"<{w}>".encode()
        found = [marked[i : i + n] for n in (4, 5, 6) for i in range(len(marked) - n + 1)] or [marked]
        return sum(model.weights[zlib.crc32(g) % toxicity.BUCKETS] for g in found) / len(found)

    for text in ("", None, "a", "You IDIOT!", "é ü " * 9, " ".join(f"w{i} x{i % 5}" for i in range(40)), " ".join(f"w{i % 91}" for i in range(333))):
        words = toxicity.folded(text)
        spans = {(min(a, max(0, len(words) - 64)), min(a, max(0, len(words) - 64)) + 64) for a in range(0, max(1, len(words)), 32)}
        worst = max((sum(map(word, words[a:b])) / max(1, len(words[a:b])) for a, b in spans), default=0.0)
        assert toxicity.Scorer(model).score(text) == pytest.approx(1 / (1 + np.exp(-(worst - 0.3))))


def test_toxicity_gradients():
    """Of the loss written out, by small steps along a hundred coordinates."""
    rng = np.random.default_rng(5)
    words = [toxicity.buckets(w) for w in ("idiot", "idiots", "stone", "a", "river", "rivers")]
    flat = [rng.integers(0, 6, n) for n in (3, 1, 5, 2)]
    bags, truth, rows = toxicity.Bags(flat, words), np.array([1, 0, 0]), np.array([0, 2, 3])
    x = [rng.normal(0, 0.5, shape) for shape in ((toxicity.BUCKETS, toxicity.DIM), (toxicity.DIM, 2), (2,))]

    def loss(vectors, softmax, bias):
        total = toxicity.DECAY / 2 * (softmax**2).sum()
        for r, y in zip(rows, truth):
            window = np.mean([np.mean([vectors[b] for b in words[w]], axis=0) for w in flat[r]], axis=0)
            logits = window @ softmax + bias
            total += (0.5 if y else 0.25) * (np.log(np.exp(logits).sum()) - logits[y])
        return total

    grads = bags.slopes(*x, rows, truth)
    used = sorted({b for w in words for b in w})
    for k in range(3):
        for _ in range(35):
            at = (rng.choice(used), rng.integers(toxicity.DIM)) if k == 0 else tuple(rng.integers(n) for n in x[k].shape)
            up, down = ([y.copy() for y in x] for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert (loss(*up) - loss(*down)) / 2e-5 == pytest.approx(grads[k][at], abs=1e-8)


def test_toxicity_sample_is_bounded():
    sizes = [(i, i % 2, 100 if i != 4 else 10**9) for i in range(2000)]
    taken = toxicity.within_bytes(sizes, 64 * 100)
    assert sum(i % 2 for i in taken) == 64 and len(taken) == 128 and 4 not in taken and taken[:3] == [0, 1, 2]


def test_toxicity_without_classes():
    assert toxicity.Scorer(toxicity.train(["a b"], [1])).score("a") > 0.5
    assert 0 <= toxicity.Scorer(toxicity.train([], [])).score(None) <= 1


def test_toxicity_of_odd_rows(odd, none, labels):
    model = toxicity.fit(odd, labels)
    rows = toxicity.score(odd.drop("score"), model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(none, toxicity.fit(none, labels.where("false"))).count() == 0


def test_toxicity_never_sees_held_out_labels(spark):
    rows = toxic_rows(random.Random(5), 60)
    d = documents(spark, [(i, t, "en", "a") for i, (t, _) in enumerate(rows)])
    one = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int")
    other = spark.createDataFrame([(i, 1, 1 - y if fold_of(i) == 0 else y) for i, (_, y) in enumerate(rows)], one.schema)
    a, b = toxicity.fit(d, one), toxicity.fit(d, other)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_languages(spark):
    words = {"en": "the and house river walking quickly", "de": "der und haus fluss gehend schnell", "fr": "le et maison rivière marchant vite"}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(words[x].split()) for _ in range(25)), x, "a") for i, x in enumerate(list(words) * 40)]
    d = documents(spark, rows)
    got = langid.identify(d, langid.fit(d)).collect()
    assert all(r["lang_pred"] == rows[r["doc_id"]][2] for r in got) and all(0 < r["score"] <= 1 for r in got)
    scorer = langid.Scorer(langid.fit(d))
    assert scorer.predict("schneller gehender flüsse")[0] == "de" and scorer.predict("HOUSES, rivers!")[0] == "en"
    assert scorer.predict("123 ... _") == ("und", 0.0) and scorer.predict(None) == ("und", 0.0)
    kept = langid.identified(documents(spark, [*rows, (999, "12 34", "en", "a"), (998, None, None, None)]))
    assert {r["doc_id"] for r in kept.collect()} == set(range(120)) and kept.columns == d.columns


def test_language_bounds(spark):
    """A language keeps words whatever their frequencies are: also one of which every word is another."""
    d = documents(spark, [(i, f"alpha beta w{i}" if i % 10 else "gamma", "en" if i % 10 else "de", "a") for i in range(600)])
    model = langid.fit(d, sample=40, words=5)
    assert model.languages == ["de", "en"] and len(model.tables[0][0]) <= 10 and {"alpha", "beta", "gamma"} <= set(model.tables[0][0])
    assert langid.most_within({("a", 0): 3, ("a", 1): 3, ("b", 0): 9}, 5) == {"a": 0}
    letters = "абвгдежзик"
    many = [(i, " ".join("".join(letters[int(x)] for x in str(1000 * i + k)) for k in range(30)) if i % 2 else "the cat sat", "xx" if i % 2 else "en", "a") for i in range(400)]
    d = documents(spark, many)
    model = langid.fit(d, words=200)
    assert model.languages == ["en", "xx"] and 100 < sum(x[0] in letters for x in model.tables[0][0]) <= 200
    assert all(r["lang_pred"] == many[r["doc_id"]][2] for r in langid.identify(d, model).collect())


def test_letters_are_one_kind(spark):
    """Letters are those of Unicode's category L, in training and in answers."""
    d = documents(spark, [(1, "² ½ ① Ⅷ ٣ 12 _", "en", "a"), (2, "abc ² def", "en", "a")] + [(i, "abc def ½ ghi", "en", "a") for i in range(3, 30)])
    model = langid.fit(d)
    assert set(model.tables[0][0]) == {"abc", "def", "ghi"}
    got = {r["doc_id"]: r for r in langid.identify(d, model).collect()}
    assert (got[1]["lang_pred"], got[1]["score"]) == ("und", 0.0) and got[2]["lang_pred"] == "en"
    import unicodedata

    assert all(bool(langid.letters(chr(c))) == (unicodedata.category(chr(c))[0] == "L") for c in range(0x30000) if not 0xD800 <= c < 0xE000)


def brute_language(counts, languages, text):
    """The scores of a text, written out: words by their log frequency, others by the longest n-grams that are known."""
    import math
    import re
    import unicodedata

    lowered, cut_out = text.lower(), []
    for m in re.finditer(r"L+", "".join("L" if unicodedata.category(c)[0] == "L" else " " for c in lowered)):
        cut_out += [lowered[k : min(k + 64, m.end())] for k in range(m.start(), m.end(), 64)]

    def grams(word, n):
        marked = word if n == 1 else "<" + word + ">"
        return [marked[i : i + n] for i in range(len(marked) - n + 1)]

    def frequencies(of):
        seen = {}
        for language, word, n in counts:
            for x in of(word):
                seen.setdefault(x, {})
                seen[x][language] = seen[x].get(language, 0) + n
        return seen

    tables = {n: frequencies((lambda w, n=n: grams(w, n)) if n else (lambda w: [w])) for n in range(6)}
    for n in range(2, 6):
        tables[n] = {k: v for k, v in tables[n].items() if sum(v.values()) > 1}
    totals = {n: {x: sum(v.get(x, 0) for v in t.values()) + 0.5 * max(1, len(t)) for x in languages} for n, t in tables.items()}
    sums = dict.fromkeys(languages, 0.0)
    for word in cut_out:
        for n in (0, 5, 4, 3, 2, 1):
            if found := [x for x in ([word] if n == 0 else grams(word, n)) if x in tables[n]]:
                for x in languages:
                    sums[x] += sum(math.log((tables[n][g].get(x, 0) + 0.5) / totals[n][x]) for g in found) / len(found)
                break
    if not cut_out:
        return "und", 0.0
    best = min(languages, key=lambda x: (-sums[x], x))
    return best, 1 / sum(math.exp((sums[x] - sums[best]) / math.sqrt(len(cut_out))) for x in languages)


def test_language_scores_by_brute_force(spark, sf_dir):
    counts = [("a", "river", 9), ("a", "stone", 2), ("b", "rivière", 5), ("b", "stein", 3), ("b", "stone", 1), ("c", "река", 4), ("c", "длинно" * 20, 1)]
    scorer = langid.Scorer(langid.Model(["a", "b", "c"], counts))
    texts = ["", "12 ②", "River stone", "rivers, rivières; STEINE!", "реками x", "длинно" * 20, "ж", "a²b stone½stein", "“river”—stein", "İstone"]
    texts += [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 2000").limit(40).collect()]
    for text in texts:
        language, score = brute_language(counts, ["a", "b", "c"], text)
        got = scorer.predict(text)
        assert got[1] == pytest.approx(score, abs=1e-4) and (got[0] == language or score < 0.3334), text


def test_backoff_order():
    m = langid.Model(["a", "b"], [("a", "hello", 5), ("b", "yellow", 5)])
    assert m.word("hello")[0] > m.word("hello")[1] and m.word("yellows")[1] > m.word("yellows")[0]
    assert m.word("жжж").tolist() == [0.0, 0.0]


def test_language_never_sees_held_out_rows(spark):
    base = [(i, f"word{i % 7} common", "en" if i % 2 else "de", "a") for i in range(60)]
    changed = [(i, t, "xx", s) if fold_of(i) == 0 else (i, t, x, s) for i, t, x, s in base]
    a, b = langid.fit(documents(spark, base)), langid.fit(documents(spark, changed))
    assert a.languages == b.languages and all(np.array_equal(x[1], y[1]) for x, y in zip(a.tables, b.tables))


def test_languages_of_odd_rows(odd, none):
    rows = langid.identify(odd, langid.fit(odd)).collect()
    assert len(rows) == odd.count() and {r["lang_pred"] for r in rows if r["doc_id"] in (2, 3, 6, 8)} == {"und"}
    assert langid.identify(none, langid.fit(none)).count() == 0


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op9_language(spark, "/root/testdata/sf0.01").where("held_out").join(d, "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.98


def brute_statistics(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 5)}
    lines, seen, repeats = (text or "").split("\n"), set(), 0
    for x in lines:
        if __import__("re").search(r"[^\x20\x09-\x0D]", x):
            repeats += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), sum((text or "").count(x) for x in "#*$%&|<>"), repeats, len(inside)


@pytest.mark.parametrize("text", [None, "", " \n ", "a", "a b c d e", "a b c d e a b c d e f", "x x x x x x x", "é中 <b>|#\né中 <b>|#\n\n\n", "l one\nl one\nl  one\n", "a b c d e f a b c d e b c d e f"])
def test_statistics(text):
    assert quality.statistics(text.encode() if text is not None else None)[:5] == brute_statistics(text)


def test_statistics_of_real_texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 3000").collect()
    assert all(quality.statistics(r["text"].encode())[:5] == brute_statistics(r["text"]) for r in rows)


def test_forest_isolates():
    rng = np.random.default_rng(0)
    rows = np.vstack([rng.normal(0, 1, (1000, 3)), rng.normal(9, 1, (20, 3))])
    s = quality.Forest(rows).score(rows)
    assert s[1000:].min() > np.quantile(s[:1000], 0.95)
    assert quality.Forest(rows[:1]).score(rows[:3]).tolist() == [0.5] * 3 and quality.Forest(np.zeros((50, 3))).score(rows[:2]).shape == (2,)


def test_forest_by_brute_force():
    """Path lengths walked node by node, and what an unsuccessful search adds at a leaf."""
    rng = np.random.default_rng(1)
    rows = rng.normal(0, 1, (60, 3)).round(1)
    forest = quality.Forest(rows, trees=9, size=16)

    def longest(n):
        return 0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    for row, score in zip(rows, forest.score(rows)):
        total = 0
        for feature, split, left, right, length in forest.trees:
            at = depth = 0
            while feature[at] >= 0:
                at, depth = (left if row[feature[at]] < split[at] else right)[at], depth + 1
            assert any(length[at] == pytest.approx(depth + longest(n)) for n in range(1, 17))
            total += length[at]
        assert score == pytest.approx(2 ** (-total / 9 / longest(16)))


def test_quality_threshold_by_brute_force(spark):
    """Every threshold tried on every labelled row, and what is kept by the best."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = queries.op8_quality(spark, d).join(labels.groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id", "left").collect()
    marked = [(r["anomaly"], r["quality"]) for r in rows if not r["base_failed"] and r["quality"] is not None]
    good, bad = (np.array([a for a, q in marked if q == x]) for x in (1, 0))
    gains = [(np.mean(bad >= k / 2000) - 25 * np.mean(good >= k / 2000), -k) for k in range(2002)]
    limit = -max(gains)[1] / 2000 if max(gains)[0] > 0 else 2.0
    assert all(r["kept"] == (not r["base_failed"] and r["anomaly"] < limit) for r in rows)


def test_quality_of_held_out_labels(spark):
    """Learned without a fifth of the labels: of those the bad go and the good stay."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    from echofield.llm.common import held_out

    apart = held_out(F.col("doc_id"))
    got = quality.judge(spark.read.parquet(f"{d}/documents.parquet"), labels.where(~apart)).join(labels.where(apart), "doc_id").where("NOT base_failed").collect()
    kept = {q: np.mean([r["kept"] for r in got if r["quality"] == q]) for q in (0, 1)}
    assert kept[0] < 0.15 and kept[1] > 0.98


def test_quality_keeps_good(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op8_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    assert np.mean([r["kept"] for r in got if r["quality"] == 1]) > 0.97


def test_quality_drops_bad(spark):
    """Of labelled documents that pass the base rules."""
    d = "/root/testdata/sf0.1"
    got = queries.op8_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    kept = {q: np.mean([r["kept"] for r in got if r["quality"] == q]) for q in (0, 1)}
    assert kept[0] < 0.1 and kept[1] > 0.98


def test_quality_of_odd_rows(odd, none, labels):
    rows = quality.judge(odd, labels).collect()
    assert len(rows) == odd.count() and all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 10)
    assert quality.judge(none, labels).count() == 0 and quality.judge(odd, labels.where("false")).where("kept").count() == 2


RULES = {"example.com/en/7": "allow", "net/de/": "allow", "com/en/": "block", "example.net/de/8": "block", "org/es/": "block"}


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


URLS = [None, "", "nothing", "http://", "http://A.Example.COM/en/7x?q#f", "https://com/en/", "ftp://xcom/en/", "http://b.example.net/de/88", "http://net/de/1", "x://y://z/en/", "http://a.org?es/", "http://a.org/es/#/x", "http://a.org#/es/", "http://ÄB.com/en/é\nx", "http://a.org/es/?u=http://b.com/en/"]


def test_urls(spark, labels):
    pages = spark.createDataFrame([(i, u, "x", "mine", "mine") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string, verdict string")
    for r in urlrules.judge(pages, labels).collect():
        host, path, rule = brute_url(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (RULES[rule] if rule else "allow")
    assert urlrules.judge(pages.where("false"), labels).count() == 0


def test_urls_of_a_table(spark, sf_dir):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op7_urls(spark, sf_dir).collect()
    assert len(got) == len(urls) and all((r["host"], r["path"], r["rule"]) == brute_url(urls[r["page_id"]]) for r in got)


def test_mined_rules_block(spark):
    """Spam hosts are bad whenever their pages carry a tracking name; the rules say so and spare the rest."""
    rng = random.Random(0)
    pages, marks = [], []
    for i in range(900):
        bad = i % 3 == 0
        host = f"{rng.choice(['farm', 'www'])}.site{rng.randrange(9)}.fr"
        pages.append((i, f"http://{'farm.spam.fr' if bad else host}/p/{i}" + ("?utm_source=x" if bad or i % 7 == 0 else "")))
        marks.append((i, 0 if bad else 1, 0))
    got = {r["page_id"]: r["verdict"] for r in urlrules.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i] == ("block" if i % 3 == 0 else "allow") for i in got)


def test_rules_are_pruned():
    rules = urlrules.pruned([["a"], ["a", "b"], ["c", "d"], ["b", "c", "d"]])
    assert set(rules.sets) == {frozenset("a"), frozenset("cd")} and sum(map(len, rules.index.values())) == 2
    assert rules.of({"a", "x"}) == [0] and rules.of({"c", "d", "a"}) and rules.of({"c"}) == []


def test_rules_by_brute_force(spark):
    """Against all sets of tokens of all pages."""
    from itertools import combinations

    rng = random.Random(2)
    rows = []
    for i in range(700):
        tokens = sorted(rng.sample("abcdefgh", rng.randrange(1, 6)))
        odds = 0.9 if {"a", "b"} <= set(tokens) else 0.6 if "c" in tokens else 0.1
        rows.append((i, tokens, rng.random() < odds))
    mining, confirming = ([r for r in rows if (fold_of(r[0]) == 1) == x] for x in (False, True))
    base, again = (sum(r[2] for r in x) / len(x) for x in (mining, confirming))
    covers = {}
    for _, tokens, bad in mining:
        for k in range(1, 6):
            for s in combinations(tokens, k):
                n, m = covers.get(frozenset(s), (0, 0))
                covers[frozenset(s)] = n + 1, m + bad

    def low(bad, n):
        z, p = 1.96, bad / n
        return (p + z * z / 2 / n - z * np.sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n)

    sure = sorted((s for s, (n, bad) in covers.items() if n >= 5 and low(bad, n) > base), key=lambda s: (-low(covers[s][1], covers[s][0]), len(s), sorted(s)))
    for _ in range(10):
        count = {True: Counter(), False: Counter()}
        bads = {True: Counter(), False: Counter()}
        for side, part in ((False, mining), (True, confirming)):
            for _, tokens, bad in part:
                if first := next((s for s in sure if s <= set(tokens)), None):
                    count[side][first] += 1
                    bads[side][first] += bad
        kept = [s for s in sure if count[False][s] and low(bads[False][s], count[False][s]) > base and bads[True][s] > again * count[True][s]]
        if kept == sure:
            break
        sure = kept
    want = {s for s in sure if not any(t < s for t in sure)}
    got = urlrules.mine(spark.createDataFrame(rows, "page_id long, tokens array<string>, bad boolean").repartition(5))
    assert set(got.sets) == want and {frozenset("ab"), frozenset("c")} <= want


def test_very_long_urls(spark):
    """A host of many labels, a path of many words: tokens stay a few times as long as the url, and sets of them are few."""
    host = ".".join("ab" for _ in range(20_000))
    path = "/".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600))
    pages = [(i, f"http://{host}/{path}" if i % 3 else f"http://x.org/{i}") for i in range(60)]
    d = spark.createDataFrame(pages, "page_id long, url string")
    assert all(sum(map(len, r["tokens"])) < 4 * len(r["url"]) + 400 for r in urlrules.parsed(d).collect())
    marks = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in urlrules.judge(d, marks).collect()}
    assert all(got[i] == ("block" if i % 3 else "allow") for i in got)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, -1) for i, v in rows], "vec_id long, embedding array<float>, label int, rank int")


def test_neighbours_of_few(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0]), (None, [1.0, 1.0]), (20, [0.0, 1.0])]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(vectors(spark, rows)).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 3, 2.0), (0, 3, 2, 0.0), (0, 4, 20, 0.0), (20, 1, 2, 3.0), (20, 2, 0, 0.0), (20, 3, 1, 0.0), (20, 4, 3, 0.0)]
    assert neighbours.nearest(vectors(spark, rows).where("false")).count() == 0


def test_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    e = rng.normal(0, 1, (4000, 64)).astype(np.float32)
    e[100:1500:3] = e[100]
    got = neighbours.nearest(vectors(spark, [(i, x.tolist()) for i, x in enumerate(e)])).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    x, hits, n = e.astype(np.float64), 0, 0
    for q in range(0, 4000, 20):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(4000), -np.round(s, 9))) if i != q][:20]
        assert sorted(found[q]) == list(range(1, 21))
        assert all(abs(s[i] - v) < 1e-9 for i, v in found[q].values())
        hits, n = hits + len({i for i, _ in found[q].values()} & set(order)), n + 20
    assert hits / n >= 0.9
    copies = [i for i in range(100, 1500, 3) if i != 100]
    assert [found[100][k][0] for k in range(1, 21)] == copies[:20]


def test_footrule_by_minimum():
    """What is accumulated over the inverted files orders candidates as the footrule of cut-off orders does."""
    rng = np.random.default_rng(1)
    v, p, q = (rng.normal(0, 1, (n, 8)) for n in (40, 16, 5))
    shard = neighbours.Shard(np.arange(40), v, p, 5, places=6)

    def places(x):
        out = np.full((len(x), 16), 6)
        np.put_along_axis(out, neighbours.orders(x, p, 6), np.arange(6)[None], 1)
        return out

    for order, mine in zip(neighbours.orders(q, p, 6), places(q)):
        assert np.array_equal(np.abs(places(shard.vectors) - mine).sum(axis=1), 6 * 7 - 2 * shard.met(order))


def test_shards_and_query_blocks(spark, monkeypatch):
    """Many small cells, against all pairs; a repeated id asks once, with the least of its vectors."""
    for name, value in (("SHARD", 50), ("SHARDS", 4), ("QUERIES", 7)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(2)
    e = rng.normal(0, 1, (300, 8)).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(e)] + [(40, [9.0] * 8)]
    got = {}
    for r in neighbours.nearest(vectors(spark, rows), 5, again=1.0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
    assert sorted(got) == list(range(0, 300, 20))
    for q, found in got.items():
        s = x @ x[q]
        assert [found[k] for k in range(1, 6)] == [int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:5]
