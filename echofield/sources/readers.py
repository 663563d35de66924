"""Readers: captures of packets, calibration files, transforms, registers, point tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.columns import compose, euler_matrix, finite
from ..schemas import CALIBRATION

#: Fixed value: bytes of the Ethernet, IPv4 and UDP headers before a payload.
HEADERS = 42
PACKET_BYTES = 1206


def datagrams(capture: bytes, port: int, source: str | None = None) -> Iterator[tuple[int, bytes]]:
    """Stamp in nanoseconds and payload of each sensor packet in a capture file, in either byte order and both resolutions."""
    magic = capture[:4]
    order = "<" if magic in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1") else ">"
    unit = 1 if magic in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d") else 1000
    at = 24
    while at + 16 <= len(capture):
        seconds, fraction, size, _ = struct.unpack_from(order + "4I", capture, at)
        frame = capture[at + 16 : at + 16 + size]
        at += 16 + size
        if len(frame) != HEADERS + PACKET_BYTES or frame[23] != 17 or struct.unpack_from(">H", frame, 36)[0] != port:
            continue
        if source is None or ".".join(map(str, frame[26:30])) == source:
            yield seconds * 1_000_000_000 + fraction * unit, frame[HEADERS:]


FILES = "path string, modificationTime timestamp, length long, content binary"


def packets_of(files: DataFrame, port: int, sensor: str, source: str | None = None) -> DataFrame:
    """(sensor, file, packet_no, stamp_ns, data) of capture files (path, content), a task one at a time; packets are numbered in
    a file's order."""
    schema = pa.schema([("sensor", pa.string()), ("file", pa.string()), ("packet_no", pa.int64()), ("stamp_ns", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = list(datagrams(content.as_py(), port, source))
                for a in range(0, len(rows), 5000):
                    part = rows[a : a + 5000]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([sensor] * len(part), [file] * len(part), range(a, a + len(part)), [s for s, _ in part], [d for _, d in part]), schema.types)], schema=schema)

    return files.select("path", "content").mapInArrow(run, "sensor string, file string, packet_no long, stamp_ns long, data binary")


def captured_packets(spark: SparkSession, path: str, port: int, sensor: str, source: str | None = None) -> DataFrame:
    """The packets of the capture files under a path."""
    return packets_of(spark.read.format("binaryFile").load(path), port, sensor, source)


def captured_stream(spark: SparkSession, path: str, port: int, sensor: str, source: str | None = None, files_a_trigger: int = 8) -> DataFrame:
    """The packets of capture files as they arrive in a folder."""
    return packets_of(spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_a_trigger).load(path), port, sensor, source)


def captured_statuses(spark: SparkSession, path: str, port: int, sensor: str, source: str | None = None) -> DataFrame:
    """(sensor, stamp_ns, angles) of the status packets in the capture files under a path, which arrive at a port of their own."""
    from ..operators.packets import status_angles

    return status_angles(captured_packets(spark, path, port, sensor, source).select("sensor", "stamp_ns", "data"))


def replayed(packets: DataFrame, rate: float, times: int = 1, repeat_delay: float = 0.0, paced: bool = True) -> DataFrame:
    """Packets as a replay sends them: `times` passes with a pause between, at so many packets a second, or at the stamps of the
    capture. packets: sensor, packet_no, stamp_ns and others; adds pass and sent_s, seconds since the replay began."""
    span = packets.groupBy("sensor").agg(F.min("stamp_ns").alias("_from"), F.max("stamp_ns").alias("_to"), F.min("packet_no").alias("_first"), F.count("*").alias("_n"))
    offset = (F.col("packet_no") - F.col("_first")) / F.lit(float(rate)) if paced else (F.col("stamp_ns") - F.col("_from")) / F.lit(1e9)
    length = F.col("_n") / F.lit(float(rate)) if paced else (F.col("_to") - F.col("_from")) / F.lit(1e9)
    passes = packets.join(span, "sensor").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return passes.withColumn("sent_s", F.col("pass") * (length + F.lit(float(repeat_delay))) + offset).drop("_from", "_to", "_first", "_n")


def registers_of(answers: DataFrame) -> DataFrame:
    """(ts, address, raw) from recorded answers to register reads (ts, first, answer): a header of seven bytes, function 3, a
    byte count and big-endian registers from address `first` on. An answer that is no such thing, or an exception, has none."""

    def run(answer: pa.Array) -> pa.Array:
        out = []
        for x in answer.to_pylist():
            whole = x is not None and len(x) >= 9 and x[7] == 3 and x[2:4] == b"\0\0" and len(x) >= 9 + x[8] and x[8] % 2 == 0
            out.append(list(struct.unpack_from(f">{x[8] // 2}H", x, 9)) if whole else [])
        return pa.array(out, pa.list_(pa.int32()))

    found = answers.select("ts", "first", F.posexplode(arrow_udf(run, "array<int>")("answer")).alias("i", "raw"))
    return found.select("ts", (F.col("first") + F.col("i")).alias("address"), "raw")


def calibration(spark: SparkSession, path: str, sensor: str) -> DataFrame:
    """schemas.CALIBRATION from a YAML file: lasers, with defaults for the keys that may be missing, and rings by angle."""
    import yaml

    from ..operators.windows import rings

    text = spark.read.text(path, wholetext=True).first()[0]
    rows = []
    for laser in yaml.safe_load(text)["lasers"]:
        number = lambda key, fallback=None: float(laser[key] if fallback is None else laser.get(key, fallback))  # noqa: B023, E731
        rows.append((sensor, int(laser["laser_id"]), number("rot_correction"), number("vert_correction"), number("dist_correction"), bool(laser.get("two_pt_correction_available", False)), number("dist_correction_x"), number("dist_correction_y"), number("vert_offset_correction"), number("horiz_offset_correction", 0.0), int(number("min_intensity", 0.0) // 1), int(number("max_intensity", 255.0) // 1), number("focal_distance"), number("focal_slope"), 0))
    return rings(spark.createDataFrame(rows, CALIBRATION), angle="vert_correction")


def calibration_text(rows: DataFrame) -> str:
    """The YAML text of one sensor's calibration."""
    names = [c for c in rows.columns if c not in ("sensor", "ring")]
    lines = ["lasers:"]
    for r in rows.orderBy("laser_id").collect():
        lines.append("- {" + ", ".join(f"{c}: {str(r[c]).lower() if isinstance(r[c], bool) else repr(r[c])}" for c in names) + "}")
    return "\n".join([*lines, f"num_lasers: {len(lines) - 1}", ""])


def transforms(spark: SparkSession, links: list[tuple[str, str, float, float, float, float, float, float]], root: str) -> DataFrame:
    """(sensor, m00 .. m22, tx, ty, tz) from each frame to the root, composed along the tree of (child, parent, x, y, z, yaw,
    pitch, roll). Frames that do not lead to the root are left out. One row a frame, so it is small."""
    parents = {c: (p, (euler_matrix(*angles), [x, y, z])) for c, p, x, y, z, *angles in links}
    identity = ([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [0.0, 0.0, 0.0])
    rows = []
    for frame in {root, *parents}:
        here, whole, seen = frame, identity, set()
        while here != root and here in parents and here not in seen:
            seen.add(here)
            here, step = parents[here][0], parents[here][1]
            whole = compose(step, whole)
        if here == root:
            rows.append((frame, *[v for r in whole[0] for v in r], *whole[1]))
    return spark.createDataFrame(sorted(rows), "sensor string, " + ", ".join(f"m{i}{j} double" for i in range(3) for j in range(3)) + ", tx double, ty double, tz double")


def register_ranges(registers: DataFrame, by: str = "device") -> DataFrame:
    """One contiguous read for each group of registers: first address and count."""
    return registers.groupBy(by).agg(F.min("address").alias("first"), (F.max("address") - F.min("address") + 1).alias("count"))


def frames(points: DataFrame, least: int = 5, finite_only: bool = True, by: tuple[str, ...] = ("sensor", "frame_no")) -> DataFrame:
    """Decoded frames: points without finite coordinates dropped on demand, and frames of under `least` points."""
    kept = points.where(finite(F.col("x"), F.col("y"), F.col("z"))) if finite_only else points
    return kept.join(kept.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*by), list(by), "left_semi")


# An inertial message's diagonal covariances, and the mark of an orientation that is not measured.
ACCELERATION_VARIANCE, TURN_VARIANCE, NO_ORIENTATION = 0.01, 0.0001, -1.0


def inertial(samples: DataFrame) -> DataFrame:
    """Inertial messages from (sensor, stamp_ns, accel_x .. gyro_z, temperature): the temperature rides in orientation_x, and
    the orientation is marked as not measured."""
    accel, gyro = ([F.col(f"{kind}_{c}").cast("double").alias(f"{name}_{c}") for c in "xyz"] for kind, name in (("accel", "linear_acceleration"), ("gyro", "angular_velocity")))
    fixed = {"acceleration_variance": ACCELERATION_VARIANCE, "turn_variance": TURN_VARIANCE, "orientation_covariance_0": NO_ORIENTATION}
    return samples.select("sensor", "stamp_ns", F.col("temperature").cast("double").alias("orientation_x"), *accel, *gyro, *[F.lit(v).alias(k) for k, v in fixed.items()])


#: The calibration archive's tags, our columns, and what turns the one's unit into the other's.
XML_FIELDS = {
    "rotCorrection_": ("rot_correction", "degrees"), "vertCorrection_": ("vert_correction", "degrees"), "distCorrection_": ("dist_correction", "cm"), "distCorrectionX_": ("dist_correction_x", "cm"), "distCorrectionY_": ("dist_correction_y", "cm"),
    "vertOffsetCorrection_": ("vert_offset_correction", "cm"), "horizOffsetCorrection_": ("horiz_offset_correction", "cm"), "focalDistance_": ("focal_distance", "cm"), "focalSlope_": ("focal_slope", ""),
}


def calibration_from_xml(spark: SparkSession, text: str, sensor: str) -> DataFrame:
    """schemas.CALIBRATION of the enabled lasers of a calibration archive: angles to radians, centimetres to metres, limits of
    intensity where they are given, rings by angle."""
    from math import radians
    from xml.etree import ElementTree

    from ..operators.windows import rings

    root = ElementTree.fromstring(text)
    items = lambda tag: [int(e.text) for e in root.findall(f"DB/{tag}/item")]
    enabled, low, high = items("enabled_"), items("minIntensity_"), items("maxIntensity_")
    units = {"degrees": radians, "cm": lambda v: v * 0.01, "": lambda v: v}
    rows = []
    for point in root.findall("DB/points_/item/px"):
        laser = int(point.findtext("id_"))
        if enabled and not enabled[laser]:
            continue
        value = {name: units[unit](float(point.findtext(tag) or 0)) for tag, (name, unit) in XML_FIELDS.items()}
        rows.append((sensor, laser, value["rot_correction"], value["vert_correction"], value["dist_correction"], False, value["dist_correction_x"], value["dist_correction_y"], value["vert_offset_correction"], value["horiz_offset_correction"], low[laser] if laser < len(low) else 0, high[laser] if laser < len(high) else 255, value["focal_distance"], value["focal_slope"], 0))
    if not rows:
        raise ValueError("no laser is enabled")
    return rings(spark.createDataFrame(rows, CALIBRATION), angle="vert_correction")
