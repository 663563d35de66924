"""Rules of pages with more tokens than FP-growth is given."""

import random

from echofield.llm import urlrules


def test_no_token_is_left_out(spark):
    """Two tokens that tell only together, on pages with thirteen that are each surer than either."""
    decoys = [f"d{k:02}" for k in range(13)]
    kinds = [([*decoys, "a", "b"], True, 100), (decoys, False, 60), (["a"], False, 150), (["b"], False, 150)]
    rows = [(i, *x) for i, x in enumerate((tokens, bad) for tokens, bad, n in kinds for _ in range(n))]
    assert urlrules.mine(spark.createDataFrame(rows, "page_id long, tokens array<string>, bad boolean")).sets == [frozenset("ab")]


def test_sets_by_size_are_those_of_growth(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        tokens = [f"t{k}" for k in range(9) if rng.random() < 0.5]
        rows.append((i, tokens + ["twin"] * ("t0" in tokens), rng.random() < (0.9 if {"t1", "t2"} <= set(tokens) else 0.8 if "t3" in tokens and "t4" not in tokens else 0.2)))
    d = spark.createDataFrame(rows, "page_id long, tokens array<string>, bad boolean")
    want = urlrules.mine(d, support=0.02).sets
    monkeypatch.setattr(urlrules, "TOKENS", 3)
    assert urlrules.mine(d, support=0.02).sets == want and want


def test_many_shared_tokens(spark):
    """Forty tokens on the same bad pages, each on a good page of its own as well: a trillion sets, few that count."""
    rows = [(i, [f"w{k:02}" for k in range(40)], True) for i in range(60)] + [(100 + k, [f"w{k:02}"], False) for k in range(40)] + [(200 + k, ["good"], False) for k in range(90)]
    rules = urlrules.mine(spark.createDataFrame(rows, "page_id long, tokens array<string>, bad boolean"))
    assert rules.sets and rules.of({"w03", "w07", *[f"w{k:02}" for k in range(40)]}) and not rules.of({"good"})
