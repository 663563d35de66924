"""Queries that must read every row, against the registered SQL without its filter."""

from echofield.plans import ORACLES, QUERIES

from .test_oracles import duck, plain  # noqa: F401


def same(spark, duck, sf_dir, name, part):  # noqa: F811
    assert ORACLES[name].count(part) <= 1
    result = duck.execute(ORACLES[name].replace(part, ""))
    columns = [d[0] for d in result.description]
    want = sorted(tuple(map(plain, r)) for r in result.fetchall())
    assert sorted(tuple(map(plain, r)) for r in QUERIES[name](spark, sf_dir).select(*columns).collect()) == want
    return want


def test_all_packets_are_decoded(spark, duck, sf_dir):  # noqa: F811
    same(spark, duck, sf_dir, "packet_decode", " WHERE seq % 10 = 0")


def test_all_points_are_shown(spark, duck, sf_dir):  # noqa: F811
    want = same(spark, duck, sf_dir, "display_text", " WHERE seq % 2 = 1")
    assert len(want) == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
