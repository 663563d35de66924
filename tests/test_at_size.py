"""What larger tables need: plans without a shuffle of returns, and rules at their very limits."""

import re

import numpy as np

from echofield.operators import joins, packets, points
from echofield.plans import QUERIES


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_denoise_limit_is_that_of_the_sql(spark):
    """200 * 0.24 is 48.0, no less than the limit of its band."""
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate((0.24, 0.0, 0.1, 6.0))], "ring int, seq long, distance double")
    assert 200 * 0.24 == 48.0 and not points.ring_denoise(rows, (10.0,) * 4, by=("ring",)).collect()


def test_synchronised_makes_no_pairs(spark):
    """A thousand clouds of each sensor within slop: a join of them has a million pairs."""
    rng = np.random.default_rng(5)
    rows = [(0, s, 1000 * k + i, float(t)) for k, s in enumerate("ABC") for i, t in enumerate(rng.integers(0, 500, 1000) / 1000)]
    rows += [(1, s, i, t) for s in "ABC" for i, t in enumerate((0.0, 0.0, 6.0, 11.9999, 17.5, float("nan"), float("inf")))]
    frame = joins.synchronised(spark.createDataFrame(rows, "stream int, sensor string, seq long, stamp double"), ["A", "B", "C"], 1.0)
    assert "Join" not in plan_of(frame)
    want = []
    for stream in (0, 1):
        of = {s: [(t, i) for k, c, i, t in rows if k == stream and c == s and np.isfinite(t)] for s in "ABC"}
        groups = []
        for t, i in of["A"]:
            near = [min((abs(t - u), u, j) for u, j in of[s]) for s in "BC"]
            stamps = (t, *[x[1] for x in near])
            if max(x[0] for x in near) <= 1 and max(stamps) - min(stamps) <= 1:
                groups.append((max(stamps) - min(stamps), t, i, near[0][2], near[1][2], min(stamps)))
        best = [{g[k]: g for g in sorted(groups, reverse=True)} for k in (3, 4)]
        want += [(stream, g[5], g[0], *g[2:5]) for g in groups if best[0][g[3]] == best[1][g[4]] == g]
    assert sorted(map(tuple, frame.collect())) == sorted(want) and len(want) > 100


def raw(spark):
    return spark.createDataFrame([(str(i % 2), i, 1000 * i, packets.packet(480 * i, 40, 2000)) for i in range(6)], "sensor string, packet_no long, stamp_ns long, data binary")


def calibrated(spark):
    return packets.example_calibration(spark, ("0", "1"))


def test_bank_returns_are_not_shuffled(spark):
    frame = packets.decode_banks(raw(spark), calibrated(spark))
    assert "Exchange hashpartitioning" not in plan_of(frame) and "SortMergeJoin" not in plan_of(frame)
    assert frame.count() == 6 * 12 * 16  # lasers 16 to 31 of the upper bank have no calibration here


def test_packets_are_spread_and_returns_are_not_shuffled(spark, sf_dir):
    """However few files the table has, some tasks for each core make the packets."""
    plan = plan_of(QUERIES["packet_decode"](spark, sf_dir))
    assert "SortMergeJoin" not in plan and "REPARTITION_BY_NUM" in plan.split("MapInArrow")[-1]
    assert all("sensor" in x and "laser_id" not in x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\), ENSURE", plan))


def test_calibrated_returns_are_not_shuffled(spark):
    frame = packets.decode(raw(spark), calibrated(spark))
    assert "Exchange hashpartitioning" not in plan_of(frame) and frame.count() == 6 * 384


def test_recalibrated_returns_are_not_shuffled(spark):
    """Angles go with the packets: after the bytes are read nothing is shuffled. A status with too few angles gives null."""
    statuses = spark.createDataFrame([("0", 2000, [1.0] * 16), ("0", 2000, [2.0] * 16), ("0", 4000, [3.0, None])], "sensor string, stamp_ns long, angles array<double>")
    frame = packets.decode_recalibrated(raw(spark), calibrated(spark), statuses)
    assert "hashpartitioning" not in plan_of(frame).split("MapInArrow")[0]
    got = {(r["packet_no"], r["laser_id"]): r["z"] for r in frame.where("block = 1 AND firing = 1").collect()}
    assert len(got) == 6 * 16 and frame.count() == 6 * 384
    at = lambda angle: 10 * np.sin(np.radians(angle))
    assert np.allclose([got[0, 3], got[1, 3], got[2, 3], got[4, 0], got[5, 15]], [at(-9), at(-9), at(2), at(3), at(15)])
    assert got[4, 1] is None and got[4, 9] is None
