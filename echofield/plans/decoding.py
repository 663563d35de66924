"""Queries over packets, status packets, registers and replays, with values that differ from return to return."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import columns as C
from ..operators import joins, packets
from ..schemas import CALIBRATION
from ..sources import readers
from .registry import query
from .streams import rounded
from .views import MEAS, meas, spread, table


def varied(numbers: pa.Array, banks: bool) -> pa.Array:
    """A packet for each number: ranges and reflectivities differ by return, some ranges are zero; with banks, odd blocks are
    lower ones."""
    out, block, place = [], np.arange(packets.BLOCKS)[:, None], np.arange(32)[None]
    for n in numbers.to_pylist():
        p = np.frombuffer(bytearray(packets.packet(n * 480 % 36000, 40, 0)), dtype=packets.DTYPE)
        p["blocks"]["returns"]["range"] = np.where((n + block + place) % 7 == 0, 0, (n * 37 + block * 101 + place * 13) % 4000)
        p["blocks"]["returns"]["reflectivity"] = (n + 3 * block + 5 * place) % 256
        if banks:
            p["blocks"]["header"][0, 1::2] = packets.LOWER_BANK
        out.append(p.tobytes())
    return pa.array(out, pa.binary())


def made(spark, sf_dir, banks: bool = False) -> DataFrame:
    keys = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 3).cast("string").alias("sensor"), F.col("s_suppkey").alias("packet_no"), (F.col("s_suppkey") * 1000).alias("stamp_ns"))
    return spread(keys, "packet_no").withColumn("data", arrow_udf(lambda n: varied(n, banks), "binary")("packet_no"))


def calibration(spark, lasers: int) -> DataFrame:
    """Every correction differs from zero and from laser to laser."""
    rows = [(str(s), k, 0.002 * k, math.radians(-15 + 32 / lasers * k), 0.01 * k, k % 2 == 1, 0.02 + 0.001 * k, 0.03, 0.005 * k, 0.02, 10, 240, 1000.0 + 10 * k, 0.1 * k, lasers - 1 - k) for s in range(3) for k in range(lasers)]
    return spark.createDataFrame(rows, CALIBRATION)


def _returns_sql(lasers: int) -> str:
    """Packets of suppliers, b the block, i the place in it, and the calibration of laser k by its formulas."""
    return f"""p AS (SELECT CAST(s_suppkey % 3 AS VARCHAR) AS sensor, s_suppkey AS n FROM supplier),
r AS (SELECT sensor, n, b, i, (n * 480 + 40 * b) % 36000 AS rot, (n * 480 + 40 * (b + 1)) % 36000 AS after, CASE WHEN (n + b + i) % 7 = 0 THEN 0 ELSE (n * 37 + b * 101 + i * 13) % 4000 END AS raw, (n + 3 * b + 5 * i) % 256 AS light FROM p, range(12) t(b), range(32) u(i)),
cal AS (SELECT k, 0.002::DOUBLE * k AS rot_c, radians(-15 + {32 // lasers if lasers <= 32 else 0.5}::DOUBLE * k) AS vert, 0.01::DOUBLE * k AS dist_c, k % 2 = 1 AS two, 0.02::DOUBLE + 0.001::DOUBLE * k AS dcx, 0.03::DOUBLE AS dcy, 0.005::DOUBLE * k AS voff, 0.02::DOUBLE AS hoff, 1000 + 10 * k AS focal, 0.1::DOUBLE * k AS slope, CAST({lasers - 1} - k AS INTEGER) AS ring FROM range({lasers}) v(k))"""


def _project_sql(source: str, resolution: str, ratio: str) -> str:
    """The points of returns (sensor, n, b, f, k, azimuth, raw, light) through cal."""
    return f"""a0 AS (SELECT s.*, c.* EXCLUDE (k), s.raw * {resolution}::DOUBLE + c.dist_c AS dist, radians(s.azimuth / 100::DOUBLE) - c.rot_c AS turn FROM {source} s JOIN cal c ON c.k = s.k),
a1 AS (SELECT *, dist * cos(vert) - voff * sin(vert) AS flat FROM a0),
a2 AS (SELECT *, abs(flat * sin(turn) - hoff * cos(turn)) AS across, abs(flat * cos(turn) + hoff * sin(turn)) AS along FROM a1),
a3 AS (SELECT *, dist + CASE WHEN two THEN (dist_c - dcx) * (across - 2.4::DOUBLE) / (25.04::DOUBLE - 2.4::DOUBLE) + dcx - dist_c ELSE 0 END AS dx, dist + CASE WHEN two THEN (dist_c - dcy) * (along - 1.93::DOUBLE) / (25.04::DOUBLE - 1.93::DOUBLE) + dcy - dist_c ELSE 0 END AS dy FROM a2),
points AS (SELECT *, (dy * cos(vert) - voff * sin(vert)) * cos(turn) + hoff * sin(turn) AS x, -((dx * cos(vert) - voff * sin(vert)) * sin(turn) - hoff * cos(turn)) AS y, dy * sin(vert) + voff * cos(vert) AS z,
  least(greatest(light + slope * abs(256 * pow(1 - focal / 13100::DOUBLE, 2) - 256 * pow(1 - {ratio}, 2)), 10), 240) AS intensity FROM a3)"""


_SIXTEEN = """s AS (SELECT sensor, n, b, i // 16 AS f, i % 16 AS k, CAST(floor(rot + 40 * ((i % 16 * 3.072::DOUBLE + i // 16 * 49.152::DOUBLE) / 98.304::DOUBLE) + 0.5::DOUBLE) AS INTEGER) % 36000 AS azimuth, raw, light FROM r WHERE NOT (b = 0 AND after < rot))"""
_PLACE_SQL = "sensor, n AS packet_no, CAST(b AS INTEGER) AS block, CAST(f AS INTEGER) AS firing, CAST(k AS INTEGER) AS laser_id, ring"
_VALUES_SQL = "CAST(azimuth AS INTEGER) AS azimuth, round(dist, 6) AS distance, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(intensity, 4) AS intensity"


def _values(frame: DataFrame) -> DataFrame:
    return rounded(rounded(frame, "distance", "x", "y", "z"), "intensity", digits=4)


@query(f"""WITH {_returns_sql(16)}, {_SIXTEEN}, {_project_sql('s', '0.005', 'raw // 65535')}
SELECT {_PLACE_SQL}, {_VALUES_SQL}, round((49.152::DOUBLE * (2 * b + f) + 3.072::DOUBLE * (k + 1) - 1179.648::DOUBLE) / 1e6::DOUBLE, 9) AS time FROM points""")
def calibrated_decode(spark, sf_dir):
    """Every return of the sixteen-laser family through a calibration whose corrections all count."""
    return rounded(_values(packets.decode(made(spark, sf_dir), calibration(spark, 16))), "time", digits=9)


@query(f"""WITH {_returns_sql(64)}, s AS (SELECT sensor, n, b, 0 AS f, i + 32 * (b % 2) AS k, rot AS azimuth, raw, light FROM r WHERE raw > 0 AND (rot BETWEEN 9000 AND 27000 OR rot <= 3000 OR rot >= 30000)), {_project_sql('s', '0.002', 'raw / 65535::DOUBLE')}
SELECT {_PLACE_SQL}, {_VALUES_SQL}, 0::DOUBLE AS time FROM points""")
def bank_decode(spark, sf_dir):
    """Every return of the 64-laser family within two sectors, one of them across zero."""
    sectors = (packets.view_sector(90, 270), packets.view_sector(300, 30))
    return _values(packets.decode_banks(made(spark, sf_dir, banks=True), calibration(spark, 64), sectors=sectors))


@query(f"""WITH {_returns_sql(16)}, {_SIXTEEN}, t AS (SELECT CAST(n_nationkey % 3 AS VARCHAR) AS sensor, n_nationkey * 4000 + 1 AS at, n_nationkey AS m FROM nation),
v AS (SELECT p.sensor, p.n, t.m FROM p ASOF LEFT JOIN t ON p.sensor = t.sensor AND p.n * 1000 >= t.at),
a0 AS (SELECT s.*, c.* EXCLUDE (k, vert), CASE WHEN v.m IS NULL THEN c.vert ELSE radians(-14.5::DOUBLE + 1.75::DOUBLE * s.k + v.m * 0.03125::DOUBLE) END AS vert, s.raw * 0.005::DOUBLE + c.dist_c AS dist, radians(s.azimuth / 100::DOUBLE) - c.rot_c AS turn FROM s JOIN cal c ON c.k = s.k JOIN v ON v.sensor = s.sensor AND v.n = s.n),
a1 AS (SELECT *, abs((dist * cos(vert) - voff * sin(vert)) * cos(turn) + hoff * sin(turn)) AS along FROM a0)
SELECT {_PLACE_SQL}, round((dist + CASE WHEN two THEN (dist_c - dcy) * (along - 1.93::DOUBLE) / (25.04::DOUBLE - 1.93::DOUBLE) + dcy - dist_c ELSE 0 END) * sin(vert) + voff * cos(vert), 6) AS z FROM a1""")
def recalibrated_decode(spark, sf_dir):
    """Each packet with the angles of its sensor's last status before it."""
    k = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("m"))
    angles = F.array(*[C.d(-14.5 + 1.75 * i) + F.col("m") * C.d(0.03125) for i in range(16)])
    statuses = k.select((F.col("m") % 3).cast("string").alias("sensor"), (F.col("m") * 4000 + 1).alias("stamp_ns"), angles.alias("angles"))
    found = packets.decode_recalibrated(made(spark, sf_dir), calibration(spark, 16), statuses)
    return rounded(found.select("sensor", "packet_no", "block", "firing", "laser_id", "ring", "z"), "z")


@query("""WITH s AS (SELECT s_suppkey AS seq, c AS channel, CASE WHEN c % 2 = 0 THEN c // 2 ELSE 8 + c // 2 END AS j, CASE WHEN c % 2 = 0 THEN -15 + c ELSE c END AS factory FROM supplier, range(16) t(c)),
g AS (SELECT *, (seq + j) % 4 <> 0 AS given, (seq + channel) % 4 = 0 AS fallen, -15.5::DOUBLE + 2 * j + (seq % 5) * 0.25::DOUBLE AS angle FROM s)
SELECT seq, CAST(channel AS INTEGER) AS channel, CASE WHEN j >= channel AND given THEN angle WHEN fallen THEN factory WHEN given THEN angle ELSE 0 END AS angle FROM g""")
def status_angles(spark, sf_dir):
    """Angles of every channel from status packets in which every fourth slot is out of its window."""

    def status(numbers: pa.Array) -> pa.Array:
        out = []
        for n in numbers.to_pylist():
            data = bytearray(packets.PACKET_BYTES)
            slots = [99.0 if (n + i) % 4 == 0 else -15.5 + 2 * i + n % 5 * 0.25 for i in range(16)]
            data[packets.ANGLES_AT : packets.ANGLES_AT + 64] = np.array(slots, dtype="<f4").tobytes()
            out.append(bytes(data))
        return pa.array(out, pa.binary())

    s = table(spark, sf_dir, "supplier").select(F.lit("0").alias("sensor"), F.col("s_suppkey").alias("stamp_ns"), arrow_udf(status, "binary")("s_suppkey").alias("data"))
    return packets.status_angles(s).select(F.col("stamp_ns").alias("seq"), F.posexplode("angles").alias("channel", "angle"))


@query("SELECT l_orderkey * 8 + l_linenumber AS seq, CAST(l_partkey % 64 AS INTEGER) AS laser, CAST(list_position([6, 7, 10, 11, 0, 1, 4, 5, 8, 9, 14, 15, 18, 19, 22, 23, 12, 13, 16, 17, 20, 21, 26, 27, 30, 31, 2, 3, 24, 25, 28, 29, 38, 39, 42, 43, 32, 33, 36, 37, 40, 41, 46, 47, 50, 51, 54, 55, 44, 45, 48, 49, 52, 53, 58, 59, 62, 63, 34, 35, 56, 57, 60, 61], l_partkey % 64) - 1 AS INTEGER) AS ring FROM lineitem")
def laser_rings(spark, sf_dir):
    """The ring of a laser; the SQL holds the inverse table, the laser of each ring."""
    laser = (F.col("l_partkey") % 64).cast("int")
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), laser.alias("laser"), packets.laser_ring(laser).alias("ring"))


@query("""WITH p AS (SELECT CAST(s_suppkey % 3 AS VARCHAR) AS sensor, s_suppkey AS packet_no FROM supplier), q AS (SELECT sensor, min(packet_no) AS lo, count(*) AS n FROM p GROUP BY sensor)
SELECT p.sensor, packet_no, CAST(k AS INTEGER) AS pass, round(k * (n / 848::DOUBLE + 1.5::DOUBLE) + (packet_no - lo) / 848::DOUBLE, 6) AS sent_s FROM p JOIN q USING (sensor), range(3) t(k)""")
def replay_pacing(spark, sf_dir):
    """Three passes at the sensor's packet rate with a pause between."""
    p = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 3).cast("string").alias("sensor"), F.col("s_suppkey").alias("packet_no"), (F.col("s_suppkey") * 1000).alias("stamp_ns"))
    return rounded(readers.replayed(p, 848.0, 3, 1.5).select("sensor", "packet_no", "pass", "sent_s"), "sent_s")


@query("SELECT o_orderkey AS ts, 100 + o_custkey % 7 + i AS address, CAST((o_orderkey * 3 + i * 1001) % 65536 AS INTEGER) AS raw FROM orders, range(4) t(i) WHERE o_orderkey % 5 <> 0")
def register_answers(spark, sf_dir):
    """Registers of recorded answers; every fifth is an exception."""

    def answer(numbers: pa.Array) -> pa.Array:
        import struct

        rows = [struct.pack(">HHHBBB", n % 65536, 0, 3, 1, 0x83, 2) if n % 5 == 0 else struct.pack(">HHHBBB4H", n % 65536, 0, 11, 1, 3, 8, *[(n * 3 + i * 1001) % 65536 for i in range(4)]) for n in numbers.to_pylist()]
        return pa.array(rows, pa.binary())

    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ts"), (100 + F.col("o_custkey") % 7).alias("first"), arrow_udf(answer, "binary")("o_orderkey").alias("answer"))
    return readers.registers_of(a)


@query(f"""WITH {MEAS}, s AS (SELECT stream, stamp AS since, abs(v) / 4 AS lo, abs(v) AS hi FROM meas WHERE kind = 'error'), w AS (SELECT stream, since, max([lo, hi]) AS pair FROM s GROUP BY ALL)
SELECT m.stream, m.seq, round(m.v, 6) AS v FROM meas m ASOF LEFT JOIN w ON m.stream = w.stream AND m.stamp >= w.since WHERE m.v BETWEEN coalesce(w.pair[1], 1) AND coalesce(w.pair[2], 90)""")
def live_range(spark, sf_dir):
    """A range gate whose limits change while rows pass: each row is held against the limits of its stamp."""
    m = meas(spark, sf_dir)
    s = m.where("kind = 'error'").groupBy("stream", F.col("stamp").alias("at")).agg(F.max(F.struct((F.abs("v") / 4).alias("lo"), F.abs("v").alias("hi"))).alias("s")).select("stream", "at", "s.*")
    rows = joins.under_settings(m.select("stream", "seq", "stamp", "v"), s, ("lo", "hi"), "stream", "stamp", {"lo": 1.0, "hi": 90.0})
    return rounded(rows.where(F.col("v").between(F.col("lo"), F.col("hi"))).select("stream", "seq", "v"), "v")
