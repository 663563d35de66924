"""Queries over ordered streams: folds, framing, sessions, time joins, clocks, registers, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Path, Tracker
from ..functions import columns as C
from ..operators import equipment, joins, ordered, packets, serving, windows
from .registry import query
from .views import MEAS, REGS, meas, regs, spread, table

#: Stamps are in hours and values in tens, so the limits are too.
TRACK = Tracker(good_inliers=40, min_inliers=15, good_rms=0.6, max_rms=0.9, max_jump=60.0, max_speed=30.0, lost_after=3, hold=12.0)


def rounded(frame: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return frame.withColumns({c: F.round(c, digits) for c in names})


def detections(spark, sf_dir) -> DataFrame:
    m = meas(spark, sf_dir)
    return m.select("stream", "seq", "stamp", (F.col("kind") != "error").alias("detected"), F.col("v").alias("cx"), (F.col("v") * C.d(0.5)).alias("cy"), (F.col("seq") % 60).cast("int").alias("inliers"), ((F.col("seq") % 10) / C.d(10)).alias("rms"))


_DET = f"{MEAS}, det AS (SELECT stream, seq, stamp, kind <> 'error' AS detected, v AS cx, v * 0.5::DOUBLE AS cy, CAST(seq % 60 AS INTEGER) AS inliers, (seq % 10) / 10::DOUBLE AS rms, row_number() OVER (PARTITION BY stream ORDER BY stamp, seq) AS n FROM meas)"
_OK = "d.detected AND d.inliers >= 15 AND d.rms <= 0.9::DOUBLE"
_J = "sqrt((d.cx - t.cx) * (d.cx - t.cx) + (d.cy - t.cy) * (d.cy - t.cy))"
_ACC = f"({_OK} AND (NOT t.init OR ({_J} <= 60 AND (d.stamp - t.measured <= 1e-3::DOUBLE OR {_J} / (d.stamp - t.measured) <= 30))))"
_LOST = "t.misses + 1 >= 3"
_HELD = "d.stamp - t.measured <= 12"


@query(f"""WITH RECURSIVE {_DET}, t AS (
  SELECT stream, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, false AS init, 0::DOUBLE AS stamp, 0::DOUBLE AS cx, 0::DOUBLE AS cy, 0::DOUBLE AS vx, 0::DOUBLE AS vy, 0::DOUBLE AS measured, 0 AS misses, 2 AS status FROM (SELECT DISTINCT stream FROM det)
  UNION ALL
  SELECT d.stream, d.n, d.seq, t.init OR {_ACC}, CASE WHEN {_ACC} OR t.init THEN d.stamp ELSE t.stamp END,
    CASE WHEN {_ACC} THEN d.cx WHEN t.init AND NOT {_LOST} AND {_HELD} THEN t.cx + t.vx * greatest(0, d.stamp - t.stamp) ELSE t.cx END,
    CASE WHEN {_ACC} THEN d.cy WHEN t.init AND NOT {_LOST} AND {_HELD} THEN t.cy + t.vy * greatest(0, d.stamp - t.stamp) ELSE t.cy END,
    CASE WHEN {_ACC} THEN CASE WHEN t.init THEN (d.cx - t.cx) / greatest(1e-3::DOUBLE, d.stamp - t.measured) ELSE 0 END WHEN t.init AND {_LOST} THEN 0 ELSE t.vx END,
    CASE WHEN {_ACC} THEN CASE WHEN t.init THEN (d.cy - t.cy) / greatest(1e-3::DOUBLE, d.stamp - t.measured) ELSE 0 END WHEN t.init AND {_LOST} THEN 0 ELSE t.vy END,
    CASE WHEN {_ACC} THEN d.stamp ELSE t.measured END, CASE WHEN {_ACC} THEN 0 WHEN t.init THEN t.misses + 1 ELSE 0 END,
    CASE WHEN {_ACC} THEN CASE WHEN d.inliers >= 40 AND d.rms <= 0.6::DOUBLE THEN 0 ELSE 1 END WHEN NOT t.init OR {_LOST} THEN 2 ELSE 1 END
  FROM t JOIN det d ON d.stream = t.stream AND d.n = t.n + 1)
SELECT stream, seq, round(cx, 5) AS cx, round(cy, 5) AS cy, round(vx, 5) AS vx, round(vy, 5) AS vy, status FROM t WHERE n > 0""")
def target_tracker(spark, sf_dir):
    return rounded(ordered.tracked(detections(spark, sf_dir), TRACK).drop("stamp"), "cx", "cy", "vx", "vy", digits=5)


_NUM = f"{MEAS}, num AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY seq) AS n FROM meas)"


@query(f"""WITH RECURSIVE {_NUM}, t AS (
  SELECT stream, n, seq, v AS smoothed, true AS valid, v AS last FROM num WHERE n = 1
  UNION ALL
  SELECT d.stream, d.n, d.seq, CASE WHEN abs(d.v - t.last) > 60 THEN d.v ELSE 0.3::DOUBLE * d.v + (1 - 0.3::DOUBLE) * t.last END, abs(d.v - t.last) <= 60, CASE WHEN abs(d.v - t.last) > 60 THEN t.last ELSE 0.3::DOUBLE * d.v + (1 - 0.3::DOUBLE) * t.last END
  FROM t JOIN num d ON d.stream = t.stream AND d.n = t.n + 1)
SELECT stream, seq, round(smoothed, 6) AS smoothed, valid FROM t""")
def ema_jump_filter(spark, sf_dir):
    return rounded(ordered.ema_jumps(meas(spark, sf_dir), "v", 0.3, 60.0), "smoothed")


_WRAP = "CASE WHEN d.a - t.last > 180 THEN d.a - t.last - 360 WHEN d.a - t.last < -180 THEN d.a - t.last + 360 ELSE d.a - t.last END"
_NEXT = f"t.last + 0.1::DOUBLE * ({_WRAP})"
_NEXTW = f"CASE WHEN {_NEXT} > 180 THEN {_NEXT} - 360 WHEN {_NEXT} < -180 THEN {_NEXT} + 360 ELSE {_NEXT} END"


@query(f"""WITH RECURSIVE {MEAS}, num AS (SELECT stream, seq, (CAST((seq * 37) % 360 AS DOUBLE) - 180) * 0.987654321::DOUBLE AS a, row_number() OVER (PARTITION BY stream ORDER BY seq) AS n FROM meas), t AS (
  SELECT stream, n, seq, a AS smoothed, false AS held, a AS last FROM num WHERE n = 1
  UNION ALL
  SELECT d.stream, d.n, d.seq, CASE WHEN abs({_WRAP}) > 90 THEN t.last ELSE {_NEXTW} END, abs({_WRAP}) > 90, CASE WHEN abs({_WRAP}) > 90 THEN t.last ELSE {_NEXTW} END
  FROM t JOIN num d ON d.stream = t.stream AND d.n = t.n + 1)
SELECT stream, seq, round(smoothed, 6) AS smoothed, held FROM t""")
def angle_hold_filter(spark, sf_dir):
    a = meas(spark, sf_dir).withColumn("a", ((F.col("seq") * 37 % 360).cast("double") - 180) * C.d(0.987654321))
    return rounded(ordered.angle_holds(a, "a", 0.1, 90.0), "smoothed")


@query(f"""WITH RECURSIVE {_NUM}, t AS (
  SELECT stream, n, seq, stamp, stamp AS sent, true AS sends FROM num WHERE n = 1
  UNION ALL
  SELECT d.stream, d.n, d.seq, d.stamp, CASE WHEN d.stamp - t.sent >= 1 / 0.05::DOUBLE THEN d.stamp ELSE t.sent END, d.stamp - t.sent >= 1 / 0.05::DOUBLE FROM t JOIN num d ON d.stream = t.stream AND d.n = t.n + 1)
SELECT stream, seq, round(stamp, 6) AS sent_at FROM t WHERE sends""")
def send_throttle(spark, sf_dir):
    return rounded(ordered.throttle(meas(spark, sf_dir), "stamp", 0.05), "sent_at")


@query(f"""WITH RECURSIVE {_NUM}, t AS (
  SELECT stream, n, seq, v AS spot, true AS kept FROM num WHERE n = 1
  UNION ALL
  SELECT d.stream, d.n, d.seq, CASE WHEN abs(d.v - t.spot) >= 20 THEN d.v ELSE t.spot END, abs(d.v - t.spot) >= 20 FROM t JOIN num d ON d.stream = t.stream AND d.n = t.n + 1)
SELECT stream, seq, round(spot, 6) AS px FROM t WHERE kept""")
def path_min_step(spark, sf_dir):
    m = meas(spark, sf_dir).select("stream", "seq", F.col("v").alias("x"), C.d(0).alias("y"), C.d(0).alias("z"))
    return rounded(ordered.path_steps(m, 20.0), "px").select("stream", "seq", "px")


_POSES = f"{MEAS}, num AS (SELECT stream, seq, CASE WHEN kind = 'error' THEN 'fallback' ELSE 'preferred' END AS source, CASE WHEN seq % 97 < 90 THEN 'map' ELSE 'odom' END AS frame_id, CASE WHEN seq % 23 = 0 THEN stamp - 100 ELSE stamp END AS stamp, v AS x, row_number() OVER (PARTITION BY stream ORDER BY seq) AS n FROM meas)"
_RESET = "CASE WHEN d.source <> t.source THEN 'source_changed' WHEN d.frame_id <> t.frame_id THEN 'frame_changed' WHEN d.stamp + 50 < t.stamp THEN 'delta_stamp_regression' ELSE '' END"
_FAR = f"(({_RESET}) = '' AND abs(d.x - t.at) > 80)"


@query(f"""WITH RECURSIVE {_POSES}, t AS (
  SELECT stream, n, seq, source, frame_id, stamp, x AS at, 0 AS segment, '' AS reset_reason, true AS kept FROM num WHERE n = 1
  UNION ALL
  SELECT d.stream, d.n, d.seq, d.source, d.frame_id, d.stamp, CASE WHEN ({_RESET}) <> '' OR {_FAR} OR abs(d.x - t.at) >= 5 THEN d.x ELSE t.at END,
    t.segment + CASE WHEN ({_RESET}) <> '' OR {_FAR} THEN 1 ELSE 0 END, CASE WHEN {_FAR} THEN 'odom_jump_reset' ELSE {_RESET} END, ({_RESET}) <> '' OR {_FAR} OR abs(d.x - t.at) >= 5
  FROM t JOIN num d ON d.stream = t.stream AND d.n = t.n + 1)
SELECT stream, seq, segment, reset_reason, kept FROM t""")
def path_accumulate(spark, sf_dir):
    m = meas(spark, sf_dir)
    poses = m.select("stream", "seq", F.when(F.col("kind") == "error", "fallback").otherwise("preferred").alias("source"), F.when(F.col("seq") % 97 < 90, "map").otherwise("odom").alias("frame_id"), F.when(F.col("seq") % 23 == 0, F.col("stamp") - 100).otherwise(F.col("stamp")).alias("stamp"), F.col("v").alias("x"), C.d(0).alias("y"), C.d(0).alias("z"))
    return ordered.trails(poses, Path(min_step_m=5.0, reset_jump_m=80.0, regression_s=50.0))


@query(f"""WITH {MEAS} SELECT stream, seq FROM (SELECT stream, seq, row_number() OVER (PARTITION BY stream ORDER BY seq) AS i, count(*) OVER (PARTITION BY stream) AS n FROM meas) WHERE (i - 1) % CAST(ceil(n / 8::DOUBLE) AS BIGINT) = 0 OR i = n""")
def path_stride(spark, sf_dir):
    return windows.path_stride(meas(spark, sf_dir).select("stream", "seq"), 8)


@query(f"""WITH {MEAS} SELECT stream, count(*) AS n, round(max(v) - min(v), 6) AS span, round(arg_min(v, seq), 6) AS first_v, round(arg_max(v, seq), 6) AS last_v, max(v) - min(v) >= 0.7::DOUBLE * 100 AS complete FROM meas GROUP BY stream""")
def path_span(spark, sf_dir):
    return serving.path_summary(meas(spark, sf_dir), 100.0)


@query(f"""WITH {MEAS}, num AS (SELECT stream, seq, CASE WHEN seq % 11 = 0 THEN stamp - 48 ELSE stamp END AS t FROM meas), b AS (SELECT stream, seq, coalesce(lag(t) OVER (PARTITION BY stream ORDER BY seq) - t > 0.5::DOUBLE, false)::INTEGER AS back FROM num)
SELECT stream, seq, CAST(sum(back) OVER (PARTITION BY stream ORDER BY seq) AS BIGINT) AS session FROM b""")
def clock_sessions(spark, sf_dir):
    m = meas(spark, sf_dir).select("stream", "seq", F.when(F.col("seq") % 11 == 0, F.col("stamp") - 48).otherwise(F.col("stamp")).alias("t"))
    return windows.clock_sessions(m, "t").select("stream", "seq", "session")


@query(f"""WITH {MEAS}, num AS (SELECT stream, seq, (row_number() OVER (PARTITION BY stream ORDER BY seq) - 1) // 9 AS scan_id, us FROM meas)
SELECT stream, scan_id, arg_min(us, seq) AS first_stamp, arg_max(us, seq) AS last_stamp, count(*) AS packets FROM num GROUP BY ALL""")
def count_framing(spark, sf_dir):
    framed = windows.framed_by_count(meas(spark, sf_dir), windows.packets_per_scan(90, 600), by="stream")
    return windows.scan_stamps(framed, by=("stream", "scan_id"), stamp="us")


_AZ = f"{MEAS}, az AS (SELECT stream, seq, CAST((row_number() OVER (PARTITION BY stream ORDER BY seq) * 4700 + stream * 13) % 36000 AS INTEGER) AS azimuth FROM meas), b AS (SELECT *, lag(azimuth) OVER (PARTITION BY stream ORDER BY seq) AS before FROM az)"


def azimuths(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("stream").orderBy("seq"))
    return meas(spark, sf_dir).select("stream", "seq", ((n * 4700 + F.col("stream") * 13) % 36000).cast("int").alias("azimuth"))


@query(f"""WITH {_AZ}, c AS (SELECT *, coalesce((before < 9000 AND azimuth >= 9000) OR (azimuth >= 9000 AND azimuth < before) OR (azimuth < before AND before < 9000), false)::INTEGER AS closes FROM b)
SELECT stream, seq, CAST(coalesce(sum(closes) OVER (PARTITION BY stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS scan_id FROM c""")
def cut_angle_framing(spark, sf_dir):
    return windows.framed_by_angle(azimuths(spark, sf_dir), 9000, by="stream").select("stream", "seq", "scan_id")


@query(f"""WITH {MEAS}, blocks AS (SELECT stream, seq // 4 AS packet, CAST(seq % 4 AS INTEGER) AS block, CAST((row_number() OVER (PARTITION BY stream ORDER BY seq) * 700) % 36000 AS INTEGER) AS azimuth FROM meas),
j AS (SELECT *, coalesce(abs(azimuth - lag(azimuth) OVER (PARTITION BY stream ORDER BY packet, block)) > 1000, false)::INTEGER AS jump FROM blocks)
SELECT DISTINCT stream, packet, CAST(sum(jump) OVER (PARTITION BY stream ORDER BY packet, block) AS BIGINT) AS scan_id FROM j""")
def zero_crossing_split(spark, sf_dir):
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("stream").orderBy("seq"))
    blocks = meas(spark, sf_dir).select("stream", F.floor(F.col("seq") / 4).alias("packet"), (F.col("seq") % 4).cast("int").alias("block"), (n * 700 % 36000).cast("int").alias("azimuth"))
    return windows.split_at_zero(blocks, by="stream", order=("packet", "block"))


@query(f"""WITH {_AZ}, g AS (SELECT stream, seq, azimuth, lead(azimuth) OVER (PARTITION BY stream ORDER BY seq) AS after FROM az), h AS (SELECT *, CASE WHEN after >= azimuth THEN after - azimuth END AS up FROM g),
k AS (SELECT *, last_value(CASE WHEN up > 0 THEN up END IGNORE NULLS) OVER w AS pos, last_value(up IGNORE NULLS) OVER w AS anyup FROM h WINDOW w AS (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT stream, seq, azimuth, CAST(gap AS INTEGER) AS gap FROM (SELECT *, CASE WHEN after IS NULL THEN coalesce(anyup, 0) WHEN up IS NOT NULL THEN up ELSE pos END AS gap FROM k) WHERE gap IS NOT NULL""")
def azimuth_gap(spark, sf_dir):
    return windows.azimuth_gaps(azimuths(spark, sf_dir), by=("stream",), order="seq")


@query("""WITH l AS (SELECT s_nationkey AS sensor, s_suppkey AS laser_id, round(s_acctbal / 1000) AS vert FROM supplier), r AS (SELECT *, dense_rank() OVER (PARTITION BY sensor ORDER BY vert) - 1 AS k, row_number() OVER (PARTITION BY sensor, vert ORDER BY laser_id) AS i FROM l)
SELECT sensor, laser_id, CAST(CASE WHEN i = 1 THEN k ELSE 0 END AS INTEGER) AS ring FROM r""")
def ring_assignment(spark, sf_dir):
    lasers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("sensor"), F.col("s_suppkey").alias("laser_id"), F.round(F.col("s_acctbal") / 1000).alias("vert"))
    return windows.rings(lasers).select("sensor", "laser_id", F.col("ring").cast("int").alias("ring"))


_SYNC_PARTS = """p AS (SELECT stream, seq AS seq_0, stamp AS stamp_0 FROM clouds WHERE sensor = 'click'),
b1 AS (SELECT * FROM (SELECT p.stream, seq_0, stamp_0, c.seq AS seq_1, c.stamp AS stamp_1, row_number() OVER (PARTITION BY p.stream, seq_0 ORDER BY abs(stamp_0 - c.stamp), c.stamp, c.seq) AS k FROM p JOIN clouds c ON c.stream = p.stream AND c.sensor = 'view' AND abs(stamp_0 - c.stamp) <= 6) WHERE k = 1),
b2 AS (SELECT * FROM (SELECT p.stream, seq_0, c.seq AS seq_2, c.stamp AS stamp_2, row_number() OVER (PARTITION BY p.stream, seq_0 ORDER BY abs(stamp_0 - c.stamp), c.stamp, c.seq) AS k FROM p JOIN clouds c ON c.stream = p.stream AND c.sensor = 'signup' AND abs(stamp_0 - c.stamp) <= 6) WHERE k = 1),
g AS (SELECT b1.stream, b1.seq_0, seq_1, seq_2, stamp_0, least(stamp_0, stamp_1, stamp_2) AS stamp, greatest(stamp_0, stamp_1, stamp_2) - least(stamp_0, stamp_1, stamp_2) AS span FROM b1 JOIN b2 ON b1.stream = b2.stream AND b1.seq_0 = b2.seq_0),
r AS (SELECT *, row_number() OVER (PARTITION BY stream, seq_1 ORDER BY span, stamp_0, seq_0) AS r1, row_number() OVER (PARTITION BY stream, seq_2 ORDER BY span, stamp_0, seq_0) AS r2 FROM g WHERE span <= 6)"""


@query(f"WITH {MEAS}, clouds AS (SELECT stream % 5 AS stream, kind AS sensor, seq, stamp FROM meas), {_SYNC_PARTS} SELECT stream, seq_0, seq_1, seq_2, round(stamp, 6) AS stamp, round(span, 6) AS span FROM r WHERE r1 = 1 AND r2 = 1")
def approx_sync(spark, sf_dir):
    clouds = meas(spark, sf_dir).select((F.col("stream") % 5).alias("stream"), F.col("kind").alias("sensor"), "seq", "stamp")
    return rounded(joins.synchronised(clouds, ["click", "view", "signup"], 6.0), "stamp", "span")


@query(f"WITH {MEAS}, tf AS (SELECT stream, stamp AS at, max(v) AS yaw FROM meas WHERE kind = 'purchase' GROUP BY ALL) SELECT m.stream, m.seq, round(tf.yaw, 6) AS yaw FROM meas m ASOF LEFT JOIN tf ON m.stream = tf.stream AND m.stamp >= tf.at WHERE m.kind <> 'purchase'")
def tf_asof(spark, sf_dir):
    m = meas(spark, sf_dir)
    tf = m.where("kind = 'purchase'").select("stream", F.col("stamp").alias("at"), F.col("v").alias("yaw"))
    return rounded(joins.as_of(m.where("kind <> 'purchase'").select("stream", "seq", "stamp"), tf, "stream", "stamp", "yaw", width=48.0).select("stream", "seq", "yaw"), "yaw")


@query(f"WITH {MEAS} SELECT stream, seq FROM (SELECT *, max((kind = 'purchase')::INTEGER) OVER (PARTITION BY stream ORDER BY seq) AS seen FROM meas WHERE kind IN ('purchase', 'error')) WHERE kind = 'purchase' OR seen = 0")
def preferred_source(spark, sf_dir):
    return joins.preferred(meas(spark, sf_dir).where(F.col("kind").isin("purchase", "error")).select("stream", "seq", F.col("kind").alias("source")), "purchase").select("stream", "seq")


@query(f"WITH {MEAS} SELECT stream, kind, max(seq) AS seq, round(arg_max(v, seq), 6) AS v FROM meas GROUP BY ALL")
def latest_snapshot(spark, sf_dir):
    return joins.latest(meas(spark, sf_dir), ("stream", "kind"), "seq", F.struct("seq", F.round("v", 6).alias("v"))).select("stream", "kind", "latest.*")


@query(f"""WITH {MEAS}, m AS (SELECT *, CASE WHEN seq % 50 = 0 THEN 'zero_stamp' WHEN kind = 'signup' AND seq % 7 = 0 THEN 'empty_frame_id' WHEN v = 0 THEN 'empty' WHEN v < 5 THEN 'min_points' WHEN seq % 31 = 0 THEN 'missing_field' ELSE 'none' END AS drop_reason FROM meas)
SELECT drop_reason, count(*) AS n FROM m GROUP BY ALL""")
def drop_reasons(spark, sf_dir):
    m = meas(spark, sf_dir)
    reason = serving.drop_reason(F.col("seq") % 50 == 0, (F.col("kind") == "signup") & (F.col("seq") % 7 == 0), F.col("v"), 5, F.col("seq") % 31 == 0)
    return m.groupBy(reason.alias("drop_reason")).agg(F.count("*").alias("n"))


@query(f"WITH {MEAS} SELECT kind, CAST(us // 3600000000 AS BIGINT) AS hour, count(*) AS n, count(*) BETWEEN 2 AND 6 AS in_bounds FROM meas GROUP BY ALL")
def topic_rate(spark, sf_dir):
    m = meas(spark, sf_dir).groupBy("kind", F.floor(F.col("us") / 3_600_000_000).alias("hour")).agg(F.count("*").alias("n"))
    return m.withColumn("in_bounds", F.col("n").between(2, 6))


@query(f"WITH {MEAS}, c AS (SELECT *, max(stamp) OVER (PARTITION BY stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clock FROM (SELECT stream, seq, CASE WHEN seq % 17 = 0 THEN stamp + 30 ELSE stamp END AS stamp FROM meas)) SELECT stream, seq FROM c WHERE clock IS NULL OR stamp <= clock + 24")
def future_guard(spark, sf_dir):
    m = meas(spark, sf_dir).select("stream", "seq", F.when(F.col("seq") % 17 == 0, F.col("stamp") + 30).otherwise(F.col("stamp")).alias("stamp"))
    return serving.not_from_the_future(m, 24.0).select("stream", "seq")


@query(f"WITH {REGS} SELECT seq, raw, CASE WHEN NOT read THEN 0 ELSE round((CASE WHEN is_signed AND raw >= 32768 THEN raw - 65536 ELSE raw END) * 0.1::DOUBLE, 6) END AS value, CASE WHEN NOT read THEN 0 ELSE round((CASE WHEN is_signed AND raw >= 32768 THEN raw - 65536 ELSE raw END) * 0.1::DOUBLE / 1000, 9) END AS metres FROM regs")
def register_scale(spark, sf_dir):
    r = regs(spark, sf_dir)
    value = C.scaled_register(F.when(F.col("read"), F.col("raw")), C.d(0.1), F.col("is_signed"))
    return r.select("seq", "raw", F.round(value, 6).alias("value"), F.round(value / C.d(1000), 9).alias("metres"))


@query("""WITH s AS (SELECT o_orderkey AS seq, o_orderkey % 2 = 0 AS a, o_custkey % 2 = 0 AS b, o_orderkey % 3 <> 0 AS x, o_custkey % 5 <> 0 AS y FROM orders)
SELECT seq, CASE WHEN NOT a AND NOT b THEN 'LOST' WHEN (NOT a OR x) AND (NOT b OR y) THEN 'OK' WHEN (a AND x) OR (b AND y) THEN 'DEGRADED' ELSE 'LOST' END AS status, CASE WHEN NOT a AND NOT b THEN 'SENSOR_DISABLED' WHEN (NOT a OR x) AND (NOT b OR y) THEN 'none' ELSE 'TCP_READ_FAILED' END AS reason FROM s""")
def sensor_status(spark, sf_dir):
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    status, reason = equipment.sensor_status(k % 2 == 0, c % 2 == 0, k % 3 != 0, c % 5 != 0)
    return o.select(k.alias("seq"), status.alias("status"), reason.alias("reason"))


@query(f"""WITH {MEAS}, s AS (SELECT seq, CAST(us // 1000000 AS BIGINT) AS nominal, CAST(us // 1000000 AS BIGINT) + CAST((seq % 7 - 3) * 1300 AS BIGINT) AS stamp FROM meas)
SELECT seq, CASE WHEN nominal - stamp > 1800 THEN stamp + 3600 WHEN stamp - nominal > 1800 THEN stamp - 3600 ELSE stamp END AS resolved FROM s""")
def hour_ambiguity(spark, sf_dir):
    nominal = F.floor(F.col("us") / 1_000_000)
    return meas(spark, sf_dir).select("seq", C.near_hour(nominal, nominal + (F.col("seq") % 7 - 3) * 1300).alias("resolved"))


@query(f"""WITH {MEAS}, s AS (SELECT seq, us // 1000000 AS t, us FROM meas) SELECT seq, CAST((t - t % 3600) * 1000000000 + (us % 3600000000) * 1000 AS BIGINT) AS stamp_ns,
CASE WHEN seq % 5 = 0 THEN 0 ELSE CAST(t - t % 3600 AS BIGINT) END AS calendar_s FROM s""")
def gps_time(spark, sf_dir):
    at = F.timestamp_add("MICROSECOND", F.col("us"), F.lit("1970-01-01").cast("timestamp_ntz"))
    calendar = C.calendar_hour(F.year(at) - 2000, F.month(at), F.dayofmonth(at), F.hour(at), F.col("seq") % 5 != 0)
    return meas(spark, sf_dir).select("seq", C.hour_plus_micros(F.floor(F.col("us") / 1_000_000), F.col("us") % 3_600_000_000).alias("stamp_ns"), calendar.alias("calendar_s"))


@query("SELECT event_id AS seq, CAST(coalesce(json_extract(props, '$.k')::INTEGER, -1) AS INTEGER) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def scrape_json(spark, sf_dir):
    return meas(spark, sf_dir).select("seq", serving.json_int("props", "k", -1).alias("k"), serving.json_text("props", "missing", "none").alias("missing"))


@query(f"""WITH {MEAS}, a AS (SELECT stream, arg_max(v, seq) AS v, max(seq) AS seq FROM meas WHERE kind = 'click' GROUP BY stream), b AS (SELECT stream, arg_max(v, seq) AS v, max(seq) AS seq FROM meas WHERE kind = 'view' GROUP BY stream),
c AS (SELECT stream, arg_max(v, seq) AS v, max(seq) AS seq FROM meas WHERE kind = 'error' GROUP BY stream), e AS (SELECT stream, arg_max(v, seq) AS v, max(seq) AS seq FROM meas WHERE kind = 'purchase' GROUP BY stream),
m AS (SELECT stream, seq, v, row_number() OVER w AS i, count(*) OVER (PARTITION BY stream) AS n FROM meas WINDOW w AS (PARTITION BY stream ORDER BY seq)),
p AS (SELECT stream, list([round(v, 4), round(v / 2, 4), 0] ORDER BY seq) FILTER (WHERE (i - 1) % CAST(ceil(n / 3::DOUBLE) AS BIGINT) = 0 OR i = n) AS path, max(n) AS n, round(arg_min(v, seq), 4) AS path_start_s, round(arg_max(v, seq), 4) AS path_end_s FROM m GROUP BY stream)
SELECT p.stream, a.v IS NOT NULL AS pose_seen, coalesce(round(a.v, 4), 0) AS pose_x, 1::DOUBLE AS pose_qw, b.v IS NOT NULL AS cloud_seen, CASE WHEN b.v IS NULL THEN 'LOST' WHEN b.seq % 2 = 0 THEN 'OK' ELSE 'DEGRADED' END AS cloud_status, coalesce(round(b.v, 4), 0) AS cloud_roll, coalesce(b.seq % 2 = 0, false) AS left_front_valid, coalesce(round(b.v * 10, 4), 0) AS left_front_mm,
c.v IS NOT NULL AS sensor_seen, CASE WHEN c.v IS NULL THEN 'none' ELSE 'TCP_READ_FAILED' END AS sensor_reason, e.v IS NOT NULL AS target_seen, coalesce(round(e.v * 1000, 4), 0) AS dx_mm, CAST(coalesce(e.seq % 3, 2) AS INTEGER) AS target_status, CAST(p.n AS BIGINT) AS points, CAST(len(p.path) AS INTEGER) AS listed, list_sum([x[1] FOR x IN p.path]) AS path_x, path_start_s, path_end_s
FROM p LEFT JOIN a USING (stream) LEFT JOIN b USING (stream) LEFT JOIN c USING (stream) LEFT JOIN e USING (stream)""")
def status_document(spark, sf_dir):
    """The status document of each stream from five streams of its own, read back from its JSON so that both sides compare
    values and not spelling."""
    part = "struct<seen:boolean,valid:boolean,x:double,qw:double,overall_status:string,invalid_reason:string,dx_mm:double,status:int,attitude:struct<roll_deg:double>,distances:struct<left_front_valid:boolean,left_front_mm:double>>"
    kind = f"struct<stream:bigint,{','.join(f'{n}:{part}' for n in ('pose', 'cloud_estimate', 'real_sensors', 'target_xy'))},path:array<array<double>>,displayed_path_point_count:bigint,status_path_point_count:int,path_start_s:double,path_end_s:double>"
    j = status_json(spark, sf_dir).select(F.from_json("json", kind).alias("j")).select("j.*")
    cloud, sensors, target = F.col("cloud_estimate"), F.col("real_sensors"), F.col("target_xy")
    total = F.aggregate("path", C.d(0), lambda a, p: a + p[0])
    return j.select("stream", F.col("pose.seen").alias("pose_seen"), F.col("pose.x").alias("pose_x"), F.col("pose.qw").alias("pose_qw"), cloud["seen"].alias("cloud_seen"), cloud["overall_status"].alias("cloud_status"), cloud["attitude"]["roll_deg"].alias("cloud_roll"), cloud["distances"]["left_front_valid"].alias("left_front_valid"), cloud["distances"]["left_front_mm"].alias("left_front_mm"), sensors["seen"].alias("sensor_seen"), sensors["invalid_reason"].alias("sensor_reason"), target["seen"].alias("target_seen"), target["dx_mm"].alias("dx_mm"), target["status"].alias("target_status"), F.col("displayed_path_point_count").alias("points"), F.col("status_path_point_count").alias("listed"), total.alias("path_x"), "path_start_s", "path_end_s")


@query()
def status_json(spark, sf_dir):
    """Each kind of event is one of the document's streams."""
    m = meas(spark, sf_dir)
    even = F.col("seq") % 2 == 0
    of = {k: m.where(F.col("kind") == k) for k in ("click", "view", "error", "purchase")}
    cloud = of["view"].select("stream", "seq", F.col("v").alias("roll_deg"), F.when(even, "OK").otherwise("DEGRADED").alias("status"), even.alias("left_front_valid"), (F.col("v") * 10).alias("left_front_mm"))
    parts = {
        "pose": (of["click"].select("stream", "seq", F.lit(True).alias("valid"), F.col("v").alias("x")), serving.POSE_FIELDS),
        "cloud_estimate": (cloud, serving.EQUIPMENT_FIELDS),
        "real_sensors": (of["error"].select("stream", "seq", F.lit("TCP_READ_FAILED").alias("reason")), serving.EQUIPMENT_FIELDS),
        "target_xy": (of["purchase"].select("stream", "seq", (F.col("v") * 1000).alias("dx_mm"), (F.col("seq") % 3).cast("int").alias("status")), serving.TARGET_FIELDS),
    }
    path = m.select("stream", "seq", F.col("v").alias("x"), (F.col("v") / 2).alias("y"), C.d(0).alias("z"))
    return serving.status_json(parts, path=path, most=3)


@query(f"""WITH {MEAS}, s AS (SELECT stream, seq, CASE kind WHEN 'purchase' THEN 'OK' WHEN 'view' THEN 'DEGRADED' ELSE 'LOST' END AS status, CASE WHEN seq % 3 = 0 THEN 'none' WHEN seq % 3 = 1 THEN 'PARTIAL_VALID' ELSE 'LOW_GROUND_POINTS' END AS reason, seq % 2 = 0 AS att, seq % 5 = 0 AS jump FROM meas)
SELECT stream, seq, CASE WHEN jump AND reason IN ('none', 'PARTIAL_VALID') THEN CASE WHEN att THEN 'DEGRADED' ELSE 'INVALID' END ELSE status END AS status, CASE WHEN jump AND reason IN ('none', 'PARTIAL_VALID') THEN 'DISTANCE_JUMP_REJECTED' ELSE reason END AS reason FROM s""")
def jump_downgrade(spark, sf_dir):
    m = meas(spark, sf_dir)
    status = F.when(F.col("kind") == "purchase", "OK").when(F.col("kind") == "view", "DEGRADED").otherwise("LOST")
    reason = F.when(F.col("seq") % 3 == 0, "none").when(F.col("seq") % 3 == 1, "PARTIAL_VALID").otherwise("LOW_GROUND_POINTS")
    s, r = equipment.jump_downgrade(status, reason, F.col("seq") % 2 == 0, F.col("seq") % 5 == 0)
    return m.select("stream", "seq", s.alias("status"), r.alias("reason"))


@query(f"""WITH {MEAS}, p AS (SELECT CAST(stream % 3 AS VARCHAR) AS sensor, seq AS n FROM meas),
r AS (SELECT sensor, n, k, f, (n * 480 % 36000 + 40 * b) % 36000 AS rot, b, (n * 480 % 36000 + 40 * (b + 1)) % 36000 AS after FROM p, range(12) t(b), range(2) u(f), range(16) w(k)),
a AS (SELECT sensor, k, CAST(floor(rot + 40 * ((k * 3.072::DOUBLE + f * 49.152::DOUBLE) / 98.304::DOUBLE) + 0.5::DOUBLE) AS INTEGER) % 36000 AS azimuth, (1000 + n % 3000) * 0.005::DOUBLE AS distance FROM r WHERE NOT (b = 0 AND after < rot))
SELECT sensor, count(*) AS n, round(avg(distance), 6) AS distance, round(avg(distance * cos(radians(-15 + 2 * k)) * cos(radians(azimuth / 100::DOUBLE))), 6) AS x, max(azimuth) AS max_azimuth FROM a GROUP BY sensor""")
def packet_decode(spark, sf_dir):
    """Packets made from events, decoded and projected through a calibration, by counts and sums of each sensor."""
    made = packets.synthetic(spread(meas(spark, sf_dir).select((F.col("stream") % 3).cast("string").alias("sensor"), F.col("seq").alias("packet_no")), "packet_no"))
    p = packets.decode(made, packets.example_calibration(spark))
    return p.groupBy("sensor").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 6).alias("distance"), F.round(F.avg("x"), 6).alias("x"), F.max("azimuth").alias("max_azimuth"))


@query("""SELECT CAST(label AS BIGINT) AS frame_no, vec_id AS seq, round(CAST(CAST(20 * CAST(embedding[1] AS DOUBLE) AS FLOAT) AS DOUBLE), 4) AS x, CASE WHEN 255 * least(1::DOUBLE, abs(CAST(embedding[4] AS DOUBLE)) * 4) >= 180 THEN 3 ELSE 2 END AS class_id, CAST(vec_id % 3 AS INTEGER) AS lidar_id FROM embeddings""")
def cloud_round_trip(spark, sf_dir):
    """Points encoded into wire packets and decoded again."""
    from .views import pts

    from pyspark.sql import Window as W

    p = pts(spark, sf_dir).withColumn("lidar_id", F.col("sensor"))
    places = p.select("frame_no", "seq", (F.row_number().over(W.partitionBy("frame_no").orderBy("seq")) - 1).cast("long").alias("i"))
    back = serving.decode_clouds(serving.encode_clouds(p)).join(places, ["frame_no", "i"])
    return back.select("frame_no", "seq", F.round(F.col("x").cast("double"), 4).alias("x"), "class_id", "lidar_id")


@query(f"WITH {MEAS} SELECT stream, seq, count(*) OVER w AS frames_seen, CAST(sum((kind = 'error')::INTEGER) OVER w AS BIGINT) AS frames_missed FROM meas WINDOW w AS (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def seen_missed(spark, sf_dir):
    m = meas(spark, sf_dir).select("stream", "seq", (F.col("kind") != "error").alias("detected"))
    return windows.seen_and_missed(m).select("stream", "seq", "frames_seen", "frames_missed")


@query(f"WITH {MEAS} SELECT seq, CASE WHEN kind = 'click' THEN '正常' WHEN kind = 'view' THEN '降级' WHEN kind = 'error' THEN '离线' ELSE kind END AS text FROM meas")
def quality_text(spark, sf_dir):
    kind = F.col("kind")
    return meas(spark, sf_dir).select("seq", serving.quality_text(F.when(kind == "click", "OK").when(kind == "view", "degraded").when(kind != "error", kind)).alias("text"))


@query(f"""WITH {MEAS}, b AS (SELECT stream, seq // 40 AS scan_id, seq // 4 AS packet, CAST(seq % 4 AS INTEGER) AS block, CAST((seq * 700) % 36000 AS INTEGER) AS azimuth FROM (SELECT stream % 5 AS stream, seq FROM meas)),
j AS (SELECT *, CASE WHEN abs(azimuth - lag(azimuth) OVER p) > 1000 THEN block END AS jump, first_value(azimuth) OVER p AS start FROM b WINDOW p AS (PARTITION BY stream, scan_id, packet ORDER BY block)),
k AS (SELECT *, max(jump) OVER (PARTITION BY stream, scan_id, packet) AS cut, min(packet) OVER s AS lo, max(packet) OVER s AS hi FROM j WINDOW s AS (PARTITION BY stream, scan_id))
SELECT stream, scan_id, packet, block FROM k WHERE NOT (packet = lo AND cut IS NOT NULL AND start >= 10000 AND block < cut) AND NOT (packet = hi AND lo <> hi AND cut IS NOT NULL AND block >= cut)""")
def head_tail_trim(spark, sf_dir):
    b = meas(spark, sf_dir).select((F.col("stream") % 5).alias("stream"), F.floor(F.col("seq") / 40).alias("scan_id"), F.floor(F.col("seq") / 4).alias("packet"), (F.col("seq") % 4).cast("int").alias("block"), (F.col("seq") * 700 % 36000).cast("int").alias("azimuth"))
    return windows.trimmed_blocks(b, by=("stream", "scan_id"), packet="packet").select("stream", "scan_id", "packet", "block")


@query(f"""WITH {MEAS}, s AS (SELECT stream, max(seq) AS stamp, arg_max(v, seq) AS start, max(v) AS span FROM meas WHERE kind = 'view' GROUP BY stream), p AS (SELECT stream, arg_min(v, seq) AS start, max(v) - min(v) AS span FROM meas GROUP BY stream)
SELECT p.stream, CASE WHEN coalesce(abs(s.start - p.start) <= 20 AND s.span >= 0.7::DOUBLE * p.span, false) THEN 'full_snapshot' ELSE 'odom_accumulated' END AS kind, round(CASE WHEN coalesce(abs(s.start - p.start) <= 20 AND s.span >= 0.7::DOUBLE * p.span, false) THEN s.span ELSE p.span END, 6) AS span FROM p LEFT JOIN s USING (stream)""")
def path_snapshot(spark, sf_dir):
    m = meas(spark, sf_dir)
    s = m.where("kind = 'view'").groupBy("stream").agg(F.max("seq").alias("stamp"), F.max_by("v", "seq").alias("start"), F.max("v").alias("span"))
    p = m.groupBy("stream").agg(F.min_by("v", "seq").alias("start"), (F.max("v") - F.min("v")).alias("span"))
    return rounded(windows.snapshot_or_path(s, p, 20.0), "span")


@query(f"""WITH {MEAS}, w AS (SELECT stream, kind, epoch_us(date_trunc('day', make_timestamp(us))) AS d0 FROM meas), e AS (SELECT kind, unnest([d0, d0 - 86400000000]) AS start_us FROM w)
SELECT kind, start_us, count(*) / 48::DOUBLE AS rate, count(*) / 48::DOUBLE BETWEEN 1.8::DOUBLE AND 3.3::DOUBLE AS ok FROM e GROUP BY ALL""")
def frequency_monitor(spark, sf_dir):
    """Rates per hour in two-day windows that slide by a day."""
    m = meas(spark, sf_dir).select("kind", F.timestamp_add("MICROSECOND", F.col("us"), F.lit("1970-01-01").cast("timestamp_ntz")).alias("ts"))
    r = windows.rate_bounds(m, "ts", 2.0, 3.0, "2 days", "1 day", 48.0, by="kind")
    return r.select("kind", C.micros(F.col("start")).alias("start_us"), "rate", "ok")


@query(f"""WITH RECURSIVE {_NUM}, t AS (
  SELECT stream, n, seq, v AS spot, true AS kept FROM num WHERE n = 1
  UNION ALL
  SELECT d.stream, d.n, d.seq, CASE WHEN abs(d.v - t.spot) >= 20 THEN d.v ELSE t.spot END, abs(d.v - t.spot) >= 20 FROM t JOIN num d ON d.stream = t.stream AND d.n = t.n + 1)
SELECT stream, seq, round(spot, 6) AS px FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY seq DESC) AS k FROM t WHERE kept) WHERE k <= 5""")
def path_newest(spark, sf_dir):
    """Of the kept points of each path the newest five."""
    m = meas(spark, sf_dir).select("stream", "seq", F.col("v").alias("x"), C.d(0).alias("y"), C.d(0).alias("z"))
    return rounded(ordered.path_steps(m, 20.0, most=5), "px").select("stream", "seq", "px")


@query(f"WITH {MEAS} SELECT stream, kind, seq FROM (SELECT *, row_number() OVER (PARTITION BY stream, kind ORDER BY seq DESC) AS k FROM meas) WHERE k <= 2")
def bounded_queue(spark, sf_dir):
    """What a queue of two for each topic still holds."""
    return ordered.newest(meas(spark, sf_dir), 2, ("stream", "kind")).select("stream", "kind", "seq")


@query(f"""WITH {MEAS}, s AS (SELECT stream, seq, CASE WHEN kind = 'error' THEN 'LOST' WHEN seq % 2 = 0 THEN 'GOOD' ELSE 'DEGRADED' END AS status, kind <> 'error' AS detected, CAST(seq % 60 AS INTEGER) AS inliers FROM meas)
SELECT stream, seq, CASE status WHEN 'GOOD' THEN 0 WHEN 'DEGRADED' THEN 1 ELSE 2 END AS level, CASE WHEN detected THEN 'none' ELSE 'not_enough_reflector_points' END AS message, CAST(count(*) OVER w AS VARCHAR) AS frames_seen, CAST(sum((NOT detected)::INTEGER) OVER w AS VARCHAR) AS frames_missed, status, CAST(inliers AS VARCHAR) AS inliers FROM s WINDOW w AS (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def diagnostics(spark, sf_dir):
    seen = F.col("kind") != "error"
    m = meas(spark, sf_dir).select("stream", "seq", F.when(~seen, "LOST").when(F.col("seq") % 2 == 0, "GOOD").otherwise("DEGRADED").alias("status"), seen.alias("detected"), (F.col("seq") % 60).cast("int").alias("inliers"), ((F.col("seq") % 10) / C.d(10)).alias("rms"), F.when(seen, "none").otherwise("not_enough_reflector_points").alias("reason"))
    return equipment.diagnostics(m).select("stream", "seq", "level", "message", *[F.col("values")[k].alias(k) for k in ("frames_seen", "frames_missed", "status", "inliers")])


#: Factors with many decimals, so that no smoothed value lies between two rounded ones.
_ODD = 0.0710678
_SIDE = {s: (i, f"(v * {i + 3 + _ODD}::DOUBLE + seq % 50)") for i, s in enumerate(("left_front", "left_rear", "right_front", "right_rear"))}
_TURN = {"roll": f"v / {10 + _ODD}::DOUBLE", "pitch": f"-v / {12 + _ODD}::DOUBLE", "yaw": f"(v * {3 + _ODD}::DOUBLE)"}


def _filters_sql() -> str:
    """Seven filters, each with its own memory, one step a row; invalid values pass and leave the memory."""
    state = ", ".join([*(f"{a}, {a}_valid" for a in _TURN), *(f"{s}, {s}_valid" for s in _SIDE)])
    first = ", ".join([*(f"CASE WHEN {a}_valid THEN {a} END AS {a}_last" for a in _TURN), *(f"CASE WHEN {s}_valid THEN {s} END AS {s}_last, false AS {s}_jump" for s in _SIDE)])
    later = []
    for a in _TURN:
        turn = f"(d.{a} - t.{a}_last)"
        if a == "yaw":
            turn = f"(CASE WHEN {turn} > 180 THEN {turn} - 360 * ceil(({turn} - 180) / 360) WHEN {turn} < -180 THEN {turn} + 360 * ceil((-180 - {turn}) / 360) ELSE {turn} END)"
        value = f"(t.{a}_last + 0.1::DOUBLE * {turn})"
        if a == "yaw":
            value = f"(CASE WHEN {value} > 180 THEN {value} - 360 * ceil(({value} - 180) / 360) WHEN {value} < -180 THEN {value} + 360 * ceil((-180 - {value}) / 360) ELSE {value} END)"
        later.append(f"CASE WHEN NOT d.{a}_valid THEN t.{a}_last WHEN t.{a}_last IS NULL THEN d.{a} WHEN abs({turn}) > 3 THEN t.{a}_last ELSE {value} END")
    for s in _SIDE:
        far = f"coalesce(abs(d.{s} - t.{s}_last) > 300, false)"
        later.append(f"CASE WHEN NOT d.{s}_valid OR {far} THEN t.{s}_last WHEN t.{s}_last IS NULL THEN d.{s} ELSE 0.3::DOUBLE * d.{s} + (1 - 0.3::DOUBLE) * t.{s}_last END, d.{s}_valid AND {far}")
    raw = ", ".join([*(f"{e} AS {a}, seq % {3 + i} <> 0 AS {a}_valid" for i, (a, e) in enumerate(_TURN.items())), *(f"CAST({e} AS DOUBLE) AS {s}, seq % {5 + i} <> 0 AS {s}_valid" for s, (i, e) in _SIDE.items())])
    out = ", ".join([*(f"round(CASE WHEN {a}_valid THEN {a}_last ELSE {a} END, 6) AS {a}_deg" for a in _TURN), *(f"round(CASE WHEN {s}_valid AND NOT {s}_jump THEN {s}_last ELSE {s} END, 6) AS {s}_mm, {s}_valid AND NOT {s}_jump AS {s}_valid, CASE WHEN {s}_jump THEN 'DISTANCE_JUMP_REJECTED' ELSE 'none' END AS {s}_reason" for s in _SIDE)])
    jump, attitude = " OR ".join(f"{s}_jump" for s in _SIDE), " OR ".join(f"{a}_valid" for a in _TURN)
    return f"""WITH RECURSIVE {MEAS}, num AS (SELECT stream, seq, row_number() OVER (PARTITION BY stream ORDER BY seq) AS n, CASE WHEN seq % 2 = 0 THEN 'OK' ELSE 'DEGRADED' END AS status, CASE seq % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'PARTIAL_VALID' ELSE 'LOW_GROUND_POINTS' END AS reason, {raw} FROM meas),
t AS (SELECT stream, n, seq, status, reason, {state}, {first} FROM num WHERE n = 1 UNION ALL SELECT d.stream, d.n, d.seq, d.status, d.reason, {', '.join('d.' + c for c in state.split(', '))}, {', '.join(later)} FROM t JOIN num d ON d.stream = t.stream AND d.n = t.n + 1)
SELECT stream, seq, {out}, {attitude} AS attitude_valid, {' AND '.join(f'{s}_valid AND NOT {s}_jump' for s in _SIDE)} AS distances_valid,
CASE WHEN ({jump}) AND reason IN ('none', 'PARTIAL_VALID') THEN CASE WHEN {attitude} THEN 'DEGRADED' ELSE 'INVALID' END ELSE status END AS status, CASE WHEN ({jump}) AND reason IN ('none', 'PARTIAL_VALID') THEN 'DISTANCE_JUMP_REJECTED' ELSE reason END AS reason FROM t"""


@query(_filters_sql())
def equipment_filtered(spark, sf_dir):
    """States through the filters of three angles and four distances, with the downgrade after a jump."""
    seq, v = F.col("seq"), F.col("v")
    turns = {"roll": v / C.d(10 + _ODD), "pitch": -v / C.d(12 + _ODD), "yaw": v * C.d(3 + _ODD)}
    values = [*(e.alias(f"{a}_deg") for a, e in turns.items()), *((seq % (3 + i) != 0).alias(f"{a}_valid") for i, a in enumerate(turns)), *((v * C.d(i + 3 + _ODD) + seq % 50).cast("double").alias(f"{s}_mm") for s, (i, _) in _SIDE.items()), *((seq % (5 + i) != 0).alias(f"{s}_valid") for s, (i, _) in _SIDE.items()), *(F.lit("none").alias(f"{s}_reason") for s in _SIDE)]
    states = meas(spark, sf_dir).select("stream", "seq", F.when(seq % 2 == 0, "OK").otherwise("DEGRADED").alias("status"), F.when(seq % 3 == 0, "none").when(seq % 3 == 1, "PARTIAL_VALID").otherwise("LOW_GROUND_POINTS").alias("reason"), *values)
    return rounded(equipment.filtered(states, order=("seq",)), *(f"{a}_deg" for a in turns), *(f"{s}_mm" for s in _SIDE))
