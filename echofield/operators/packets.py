"""Raw packets to points. Bytes become numbers in Arrow batches; calibration and projection are column algebra."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.columns import d
from .joins import as_of

# The packet layout, the block headers, and the firing times in microseconds.
PACKET_BYTES, BLOCKS, FIRINGS, LASERS = 1206, 12, 2, 16
UPPER_BANK, LOWER_BANK = 0xEEFF, 0xDDFF
BLOCK_US, LASER_US, FIRING_US, TIME_ZERO_US = 98.304, 3.072, 49.152, 1179.648
DTYPE = np.dtype([("blocks", [("header", "<u2"), ("rotation", "<u2"), ("returns", [("range", "<u2"), ("reflectivity", "u1")], 32)], BLOCKS), ("revolution", "<u2"), ("status", "u1", 4)])

#: Fixed values of the second sensor family, by channel: elevation in hundredths of a degree, horizontal angle offset in the
#: same, horizontal and vertical offset in metres, ring.
CHANNELS = (
    (-1500, 0.00, 0.021, 0.00506, 0), (100, 1.08, 0.021, -0.00915, 8), (-1300, 2.16, 0.021, 0.00506, 1), (300, 3.24, 0.021, -0.00915, 9),
    (-1100, 4.32, 0.021, 0.00506, 2), (500, 5.40, 0.021, -0.00915, 10), (-900, 6.48, 0.021, 0.00506, 3), (700, 7.56, 0.021, -0.00915, 11),
    (-700, 8.64, -0.021, 0.00915, 4), (900, 9.72, -0.021, -0.00506, 12), (-500, 10.80, -0.021, 0.00915, 5), (1100, 11.88, -0.021, -0.00506, 13),
    (-300, 12.96, -0.021, 0.00915, 6), (1300, 14.04, -0.021, -0.00506, 14), (-100, 15.12, -0.021, 0.00915, 7), (1500, 16.20, -0.021, -0.00506, 15),
)

#: Fixed values of the sixteen-laser family: where a status packet has its vertical angles, the channel of each of its slots, and
#: the factory's angle of each channel.
ANGLES_AT = 834
SLOT_CHANNEL = (0, 2, 4, 6, 8, 10, 12, 14, 1, 3, 5, 7, 9, 11, 13, 15)
FACTORY_ANGLES = (-15, 1, -13, 3, -11, 5, -9, 7, -7, 9, -5, 11, -3, 13, -1, 15)

RETURNS = "sensor string, packet_no long, block int, firing int, laser_id int, azimuth int, raw int, reflectivity int"


def gaps_of(rotation: np.ndarray) -> np.ndarray:
    """The azimuth gap of each block of each packet; a negative one reuses the last, -1 where there is none to reuse."""
    out, last = np.full(rotation.shape, -1, dtype=np.int64), np.zeros(len(rotation), dtype=np.int64)
    for b in range(BLOCKS - 1):
        raw = rotation[:, b + 1].astype(np.int64) - rotation[:, b]
        gap = np.where(raw >= 0, raw, np.where(last > 0, last, -1))
        out[:, b] = gap
        last = np.where(gap >= 0, gap, last)
    out[:, -1] = last
    return out


def _unpacked(packets: DataFrame, names: tuple[str, ...], kernel: Callable[[np.ndarray], tuple], angles: str | None = None) -> DataFrame:
    """Returns of each packet of (sensor, packet_no, data); packets of another size are left out. kernel takes the blocks of some
    packets and gives, for each return, its packet's place among them and the columns named. angles names a struct of a list
    by laser that a packet may have: each return then also has its laser's, and whether its packet has one."""
    schema = pa.schema([("sensor", pa.string()), ("packet_no", pa.int64()), *[(c, pa.int32()) for c in names], *([("angle", pa.float64()), ("turned", pa.bool_())] if angles else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for row in zip(*(c.to_pylist() for c in batch.columns)) if row[2] is not None and len(row[2]) == PACKET_BYTES]
            for at in range(0, len(rows), 256):
                sensor, number, data, *more = zip(*rows[at : at + 256])
                place, *columns = kernel(np.frombuffer(b"".join(data), dtype=DTYPE)["blocks"])
                out = [pa.array(np.array(sensor, dtype=object)[place], pa.string()), pa.array(np.array(number, dtype=np.int64)[place]), *[pa.array(x.astype(np.int32)) for x in columns]]
                if angles:
                    lists = [[*((x and x["angles"]) or ()), *[None] * LASERS][:LASERS] for x in more[0]]
                    own = pa.array([x for row in lists for x in row], pa.float64())
                    out += [own.take(pa.array(place * LASERS + columns[names.index("laser_id")])), pa.array(np.array([x is not None for x in more[0]])[place])]
                yield pa.RecordBatch.from_arrays(out, schema=schema)

    return packets.select("sensor", "packet_no", "data", *([angles] if angles else [])).mapInArrow(run, "sensor string, packet_no long, " + ", ".join(f"{c} int" for c in names) + (", angle double, turned boolean" if angles else ""))


def returns(packets: DataFrame, angles: str | None = None) -> DataFrame:
    """RETURNS of the sixteen-laser family, two firings a block. A block with a wrong header ends its packet."""

    def kernel(blocks: np.ndarray) -> tuple:
        gap = gaps_of(blocks["rotation"])
        good = np.logical_and.accumulate(blocks["header"] == UPPER_BANK, axis=1) & (gap >= 0)
        p, b, f, k = np.meshgrid(np.arange(len(blocks)), np.arange(BLOCKS), np.arange(FIRINGS), np.arange(LASERS), indexing="ij")
        turned = blocks["rotation"][:, :, None, None] + gap[:, :, None, None] * ((k * LASER_US + f * FIRING_US) / BLOCK_US)
        azimuth = np.floor(turned + 0.5).astype(np.int64) % 36000
        keep = np.broadcast_to(good[:, :, None, None], p.shape)
        return tuple(x[keep] for x in (p, b, f, k, azimuth, *(blocks["returns"][c].reshape(p.shape) for c in ("range", "reflectivity"))))

    return _unpacked(packets, ("block", "firing", "laser_id", "azimuth", "raw", "reflectivity"), kernel, angles)


def bank_returns(packets: DataFrame, sectors: tuple[tuple[int, int], ...] = ((0, 36000),)) -> DataFrame:
    """RETURNS of the families of 32 and 64 lasers: 32 lasers a block, those of a lower block from 32 on, at the block's own
    azimuth. Any other header counts as an upper one. Zero ranges and blocks outside all sectors are left out."""

    def kernel(blocks: np.ndarray) -> tuple:
        p, b, k = np.meshgrid(np.arange(len(blocks)), np.arange(BLOCKS), np.arange(2 * LASERS), indexing="ij")
        azimuth, lower = (np.broadcast_to(x[:, :, None], p.shape) for x in (blocks["rotation"], blocks["header"] == LOWER_BANK))
        ranges, light = (blocks["returns"][c] for c in ("range", "reflectivity"))
        inside = np.zeros(p.shape, dtype=bool)
        for low, high in sectors:
            inside |= (azimuth >= low) & (azimuth <= high) if low < high else (low > high) & ((azimuth <= high) | (azimuth >= low))
        keep = (ranges > 0) & inside
        return tuple(x[keep] for x in (p, b, np.zeros_like(b), k + 2 * LASERS * lower, azimuth, ranges, light))

    return _unpacked(packets, ("block", "firing", "laser_id", "azimuth", "raw", "reflectivity"), kernel)


def packet_time(block: Column, firing: Column, laser: Column) -> Column:
    """Seconds of a return after its packet's stamp."""
    return (d(FIRING_US) * (block * 2 + firing) + d(LASER_US) * (laser + 1) - d(TIME_ZERO_US)) / d(1e6)


def two_point(correction: Column, at_near: Column, value: Column, near: float, far: float = 25.04) -> Column:
    """The distance correction between two calibrated distances, less the plain one."""
    return (correction - at_near) * (value - d(near)) / d(far - near) + at_near - correction


def corrected_intensity(reflectivity: Column, raw: Column, integer_ratio: bool) -> Column:
    """With the focal term, within the laser's limits. One family divides the range as an integer, so that it counts only at
    its maximum."""
    offset = d(256) * (d(1) - F.col("focal_distance") / d(13100)) * (d(1) - F.col("focal_distance") / d(13100))
    ratio = F.floor(raw / d(65535)).cast("double") if integer_ratio else raw / d(65535)
    value = reflectivity + F.col("focal_slope") * F.abs(offset - d(256) * (d(1) - ratio) * (d(1) - ratio))
    return F.least(F.greatest(value, F.col("min_intensity").cast("double")), F.col("max_intensity").cast("double"))


def projected(found: DataFrame, calibration: DataFrame, resolution: float = 0.005, integer_ratio: bool = True) -> DataFrame:
    """Returns through a calibration (schemas.CALIBRATION): x, y, z in metres, x ahead; ring, distance, intensity, time. A row
    for each laser of each sensor is little, so it goes to the returns, which are neither shuffled nor sorted. Returns that were
    turned have a vertical angle of their own, in degrees."""
    j = found.join(F.broadcast(calibration), ["sensor", "laser_id"])
    if "turned" in found.columns:
        j = j.withColumn("vert_correction", F.when(F.col("turned"), F.radians("angle")).otherwise(F.col("vert_correction")))
    turn = F.radians(F.col("azimuth") / d(100)) - F.col("rot_correction")
    cos_v, sin_v, cos_r, sin_r = F.cos("vert_correction"), F.sin("vert_correction"), F.cos("_turn"), F.sin("_turn")
    j = j.withColumns({"distance": F.col("raw") * d(resolution) + F.col("dist_correction"), "_turn": turn})
    flat = lambda dist: dist * cos_v - F.col("vert_offset_correction") * sin_v
    side = lambda dist: flat(dist) * sin_r - F.col("horiz_offset_correction") * cos_r
    ahead = lambda dist: flat(dist) * cos_r + F.col("horiz_offset_correction") * sin_r
    dist, has = F.col("distance"), F.col("two_pt_correction_available")
    dx = dist + F.when(has, two_point(F.col("dist_correction"), F.col("dist_correction_x"), F.abs(side(dist)), 2.4)).otherwise(d(0))
    dy = dist + F.when(has, two_point(F.col("dist_correction"), F.col("dist_correction_y"), F.abs(ahead(dist)), 1.93)).otherwise(d(0))
    j = j.withColumns({"x": ahead(dy), "y": -side(dx), "z": dy * sin_v + F.col("vert_offset_correction") * cos_v})
    return j.withColumns({"intensity": corrected_intensity(F.col("reflectivity").cast("double"), F.col("raw"), integer_ratio), "time": packet_time(F.col("block"), F.col("firing"), F.col("laser_id"))}).select("sensor", "packet_no", "block", "firing", "laser_id", "ring", "azimuth", "distance", "x", "y", "z", "intensity", "time")


def decode(packets: DataFrame, calibration: DataFrame) -> DataFrame:
    return projected(returns(packets), calibration)


def decode_banks(packets: DataFrame, calibration: DataFrame, resolution: float = 0.002, sectors: tuple[tuple[int, int], ...] = ((0, 36000),)) -> DataFrame:
    """Points of the families of 32 and 64 lasers, whose firing times are not known: time is 0."""
    return projected(bank_returns(packets, sectors), calibration, resolution, integer_ratio=False).withColumn("time", d(0))


def decode_recalibrated(packets: DataFrame, calibration: DataFrame, statuses: DataFrame, width: float = 60e9) -> DataFrame:
    """As decode, each packet with the vertical angles of its sensor's last status at or before its stamp, or the calibration's
    where there is none; rings stay what they were. packets: also stamp_ns; statuses: sensor, stamp_ns, angles in degrees. The
    packets of a sensor and of width nanoseconds are dated in one task; angles go with them, so no return is shuffled."""
    known = statuses.select("sensor", F.col("stamp_ns").alias("at"), F.struct(F.col("angles").cast("array<double>").alias("angles")).alias("status"))
    dated = as_of(packets.select("sensor", "packet_no", "stamp_ns", "data"), known, "sensor", "stamp_ns", "status", width=width)
    return projected(returns(dated, "status"), calibration)


def decode_channels(packets: DataFrame, min_range: float = 0.2, resolution: float = 0.002) -> DataFrame:
    """The second family: fixed channels, the second firing 0.18 degrees on, near returns NaN with intensity 0."""
    raw = returns_unturned(packets)
    table = F.array(*[F.struct(*[d(v).alias(n) for v, n in zip(c, ("elevation", "angle", "h", "v", "ring"))]) for c in CHANNELS])
    j = raw.withColumn("c", F.get(table, F.col("laser_id"))).withColumns({"distance": F.col("raw") * d(resolution), "azimuth": ((F.col("rotation") + 18 * F.col("firing") + F.col("c.angle")).cast("int") % 36000)})
    omega, alpha = F.radians(F.col("c.elevation") / d(100)), F.radians(F.col("azimuth") / d(100))
    near, nan = F.col("distance") < d(min_range), d(float("nan"))
    right = F.col("distance") * F.cos(omega) * F.sin(alpha) + F.col("c.h") * F.cos(alpha)
    ahead = F.col("distance") * F.cos(omega) * F.cos(alpha) - F.col("c.h") * F.sin(alpha)
    up = F.col("distance") * F.sin(omega) + F.col("c.v")
    time = (51 * (F.col("block") * 2 + F.col("firing")) + 3 * F.col("laser_id")) / d(1e6)
    return j.select("sensor", "packet_no", "block", "firing", "laser_id", F.col("c.ring").cast("int").alias("ring"), "azimuth", F.when(near, nan).otherwise(F.col("distance")).alias("distance"), F.when(near, nan).otherwise(ahead).alias("x"), F.when(near, nan).otherwise(-right).alias("y"), F.when(near, nan).otherwise(up).alias("z"), F.when(near, 0).otherwise(F.col("reflectivity")).cast("double").alias("intensity"), time.alias("time"))


def returns_unturned(packets: DataFrame) -> DataFrame:
    """As returns, with each block's own rotation and without judging headers or gaps."""

    def kernel(blocks: np.ndarray) -> tuple:
        p, b, f, k = (x.ravel() for x in np.meshgrid(np.arange(len(blocks)), np.arange(BLOCKS), np.arange(FIRINGS), np.arange(LASERS), indexing="ij"))
        return p, b, f, k, blocks["rotation"][p, b], blocks["returns"]["range"].ravel(), blocks["returns"]["reflectivity"].ravel()

    return _unpacked(packets, ("block", "firing", "laser_id", "rotation", "raw", "reflectivity"), kernel)


def packet(rotation: int, step: int, range_raw: int, reflectivity: int = 100, header: int = UPPER_BANK) -> bytes:
    """A packet whose blocks turn by a step and whose returns are all alike."""
    out = np.zeros(1, dtype=DTYPE)
    out["blocks"]["header"], out["blocks"]["rotation"] = header, (rotation + step * np.arange(BLOCKS)) % 36000
    out["blocks"]["returns"]["range"], out["blocks"]["returns"]["reflectivity"] = range_raw, reflectivity
    return out.tobytes()


def synthetic(keys: DataFrame) -> DataFrame:
    """A packet for each (sensor, packet_no), made from its number."""
    def make(numbers: pa.Array) -> pa.Array:
        return pa.array([packet(n * 480 % 36000, 40, 1000 + n % 3000) for n in numbers.to_pylist()], pa.binary())

    return keys.withColumn("data", arrow_udf(make, "binary")("packet_no"))


def example_calibration(spark: SparkSession, sensors: tuple[str, ...] = ("0", "1", "2")) -> DataFrame:
    """Sixteen lasers two degrees apart for each sensor."""
    from ..schemas import CALIBRATION

    rows = [(s, i, 0.0, float(np.radians(-15 + 2 * i)), 0.0, False, 0.0, 0.0, 0.0, 0.0, 0, 255, 0.0, 0.0, i) for s in sensors for i in range(LASERS)]
    return spark.createDataFrame(rows, CALIBRATION)


def status_slots(statuses: DataFrame) -> DataFrame:
    """(sensor, stamp_ns, slots) from status packets (sensor, stamp_ns, data): the sixteen little-endian floats of each; packets
    of another size are left out."""

    def run(data: pa.Array) -> pa.Array:
        return pa.array([None if x is None or len(x) != PACKET_BYTES else np.frombuffer(x, dtype="<f4", count=LASERS, offset=ANGLES_AT).tolist() for x in data.to_pylist()], pa.list_(pa.float32()))

    return statuses.select("sensor", "stamp_ns", arrow_udf(run, "array<float>")("data").alias("slots")).where("slots IS NOT NULL")


def channel_angles(slots: Column) -> Column:
    """The vertical angle of each channel, in degrees. A slot whose angle lies in its own window of two degrees gives it to its
    channel; any other puts the factory's angle of the channel with the slot's own number there. Slots are read in order, so of
    two that reach one channel the later counts, and a channel that none reaches has 0."""
    good = [(F.get(slots, F.lit(i)) >= F.lit(-16.0 + 2 * i)) & (F.get(slots, F.lit(i)) <= F.lit(-14.0 + 2 * i)) for i in range(LASERS)]
    out = []
    for channel, factory in enumerate(FACTORY_ANGLES):
        slot = SLOT_CHANNEL.index(channel)
        given, fallen = (good[slot], F.get(slots, F.lit(slot)).cast("double")), (~good[channel], d(float(factory)))
        late, early = (given, fallen) if slot > channel else (fallen, given)
        out.append(F.when(*late).when(*early).otherwise(d(0)))
    return F.array(*out)


def status_angles(statuses: DataFrame) -> DataFrame:
    """(sensor, stamp_ns, angles) from status packets."""
    return status_slots(statuses).select("sensor", "stamp_ns", channel_angles(F.col("slots")).alias("angles"))


def view_sector(low: float, high: float) -> tuple[int, int]:
    """A sector in degrees as hundredths. One that is not a sector is the full circle; an upper end past 360 is taken as given,
    as old files rely on it."""
    return (0, 36000) if not 0 <= low <= 360 or high < 0 or low == high else (int(low * 100), int(high * 100))


def view_of(direction: float, width: float) -> tuple[int, int]:
    """The sector of a direction and a width in radians, in hundredths of a degree of the sensor, which turns the other way; no
    width is the full circle."""
    turn = 2 * math.pi
    low, high = (int(100 * math.degrees(turn - (direction + side * width / 2) % turn) + 0.5) for side in (1, -1))
    return (0, 36000) if low == high else (low, high)


def hidden_rings(text: str) -> list[int]:
    """The rings of a comma-separated text; what is no number counts as 0, as in the files' own reader."""
    return [int(m[0]) if (m := re.match(r"\s*[+-]?\d+", part)) else 0 for part in text.split(",") if part != ""]


#: The ring of each laser of the 64-beam family.
LASER_RING = (
    4, 5, 26, 27, 6, 7, 0, 1, 8, 9, 2, 3, 16, 17, 10, 11, 18, 19, 12, 13, 20, 21, 14, 15, 28, 29, 22, 23, 30, 31, 24, 25,
    36, 37, 58, 59, 38, 39, 32, 33, 40, 41, 34, 35, 48, 49, 42, 43, 50, 51, 44, 45, 52, 53, 46, 47, 60, 61, 54, 55, 62, 63, 56, 57,
)


def laser_ring(laser: Column) -> Column:
    return F.get(F.array(*map(F.lit, LASER_RING)), laser)


def grid(points: DataFrame) -> DataFrame:
    """Places of an organised cloud: a row a firing, a column a laser, in order of the packets."""
    from pyspark.sql import Window as W

    n = F.dense_rank().over(W.partitionBy("sensor").orderBy("packet_no")) - 1
    return points.withColumns({"row": (n * BLOCKS + F.col("block")) * FIRINGS + F.col("firing"), "col": F.col("laser_id")})


def transposed(points: DataFrame) -> DataFrame:
    """An organised cloud with rows and columns exchanged."""
    return points.withColumns({"row": F.col("col"), "col": F.col("row")})
