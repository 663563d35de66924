"""Readers, streams and whole flows."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofield.config import Tracker
from echofield.operators import ordered, packets, points
from echofield.plans import flow
from echofield.sources import readers
from echofield.streaming import folds


def capture(payloads, port=2368, source=(192, 168, 1, 200)):
    out = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, data in enumerate(payloads):
        ip = bytes([0x45, 0, 0, 0, 0, 0, 0, 0, 64, 17, 0, 0, *source, 255, 255, 255, 255])
        frame = bytes(12) + b"\x08\x00" + ip + struct.pack(">HHHH", port, port, 8 + len(data), 0) + data
        out += struct.pack("<IIII", 100 + i, 500, len(frame), len(frame)) + frame
    return out


def test_capture_file(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture([packets.packet(0, 40, 2000), b"x" * 10, packets.packet(480, 40, 2000)]))
    got = readers.captured_packets(spark, str(tmp_path), 2368, "0").orderBy("packet_no").collect()
    assert [r["packet_no"] for r in got] == [0, 1] and got[1]["stamp_ns"] == 102_000_500_000
    assert readers.captured_packets(spark, str(tmp_path), 99, "0").count() == 0
    assert readers.captured_packets(spark, str(tmp_path), 2368, "0", source="10.0.0.1").count() == 0


def test_calibration_file(spark, tmp_path):
    pytest.importorskip("yaml")
    laser = "{laser_id: %d, rot_correction: 0.0, vert_correction: %s, dist_correction: 0.0, dist_correction_x: 0, dist_correction_y: 0, vert_offset_correction: 0, focal_distance: 0, focal_slope: 0}"
    (tmp_path / "c.yaml").write_text("lasers:\n" + "".join("- " + laser % (i, v) + "\n" for i, v in enumerate((0.2, -0.1, 0.2))))
    got = readers.calibration(spark, str(tmp_path / "c.yaml"), "a").orderBy("laser_id").collect()
    assert [r["ring"] for r in got] == [1, 0, 0] and got[0]["max_intensity"] == 255
    (tmp_path / "d.yaml").write_text(readers.calibration_text(spark.createDataFrame(got)))
    assert readers.calibration(spark, str(tmp_path / "d.yaml"), "a").orderBy("laser_id").collect() == got


def test_transform_tree(spark):
    t = readers.transforms(spark, [("l1", "base", 1.0, 0, 0, np.pi / 2, 0, 0), ("l2", "l1", 0, 2.0, 0, 0, 0, 0), ("lost", "nowhere", 0, 0, 0, 0, 0, 0)], "base")
    got = {r["sensor"]: r for r in t.collect()}
    assert set(got) == {"base", "l1", "l2"} and (got["l2"]["tx"], got["l2"]["ty"]) == pytest.approx((-1.0, 0.0))
    p = spark.createDataFrame([("l1", 0, 1.0, 0.0, 0.0)], "sensor string, seq long, x double, y double, z double")
    r = points.rigid(p, t).first()
    assert (r["x"], r["y"]) == pytest.approx((1.0, 1.0))


def test_streamed_tracker_is_the_batch_one(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(int(i % 3), int(i), float(i) / 10, bool(rng.random() > 0.3), float(rng.normal(0, 0.3)), 0.0, int(rng.integers(0, 60)), float(rng.uniform(0, 0.06))) for i in range(90)]
    schema = "stream int, seq long, stamp double, detected boolean, cx double, cy double, inliers int, rms double"
    batch = {(r["stream"], r["seq"]): r for r in ordered.tracked(spark.createDataFrame(rows, schema), Tracker()).collect()}
    for k in range(3):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = folds.tracked(source, Tracker()).writeStream.format("memory").queryName("tracks").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("tracks").collect()
    assert len(got) == len(batch)
    for r in got:
        b = batch[r["stream"], r["seq"]]
        assert r["status"] == b["status"] and r["cx"] == pytest.approx(b["cx"])


def test_fused_frames(spark):
    clouds = spark.createDataFrame([(0, s, i, i * 0.1 + d) for s, d in (("a", 0.0), ("b", 0.02)) for i in range(3)], "stream int, sensor string, seq long, stamp double")
    cloud_points = clouds.select("stream", "sensor", F.col("seq").alias("cloud_seq"), F.col("seq").alias("seq"), *[F.lit(1.0).alias(c) for c in ("x", "y", "z", "intensity")], F.lit(1).alias("ring"), F.lit(0.0).alias("time"))
    t = readers.transforms(spark, [("a", "base", 0, 0, 0, 0, 0, 0), ("b", "base", 5.0, 0, 0, 0, 0, 0)], "base")
    got = flow.fused(clouds, cloud_points, t, ["a", "b"]).collect()
    assert len(got) == 6 and {(r["sensor"], r["x"]) for r in got} == {("a", 1.0), ("b", 6.0)}
    assert {round(r["time"], 6) for r in got if r["sensor"] == "b"} == {0.02}


def test_target_track(spark):
    rng = np.random.default_rng(0)
    angle = rng.uniform(np.pi - 0.8, np.pi + 0.8, 300)
    rows = [(0, 1, i, -8.0 - 0.125 * np.cos(a) * 1.0, 0.125 * np.sin(a), float(z), 220.0) for i, (a, z) in enumerate(zip(angle, rng.uniform(-0.5, 0.5, 300)))]
    frames = spark.createDataFrame([(s, f, i, float(x), float(y), z, v) for s, f, i, x, y, z, v in rows], "stream int, frame_no long, seq long, x double, y double, z double, intensity double")
    stamps = spark.createDataFrame([(0, 1, 10.0), (0, 2, 10.1)], "stream int, frame_no long, stamp double")
    got = flow.target_track(frames, stamps).orderBy("seq").collect()
    assert len(got) == 2 and got[0]["cx"] == pytest.approx(-8.0, abs=0.05) and got[1]["status"] == 1


def test_sensor_points(spark):
    raw = spark.createDataFrame([("0", i, packets.packet(480 * i, 40, 2000)) for i in range(3)], "sensor string, packet_no long, data binary")
    got = flow.sensor_points(raw, packets.example_calibration(spark), 0.5, 100.0)
    assert got.groupBy("ring").count().where("count = 69").count() == 16


def test_arrival_synchroniser(spark, tmp_path):
    rows = sorted((t, s, i) for s, ts in (("A", (0.0, 0.1)), ("B", (0.02, 0.11)), ("C", (0.04, 0.2))) for i, t in enumerate(ts))
    schema = "stream int, arrival long, sensor string, seq long, stamp double"
    data = spark.createDataFrame([(0, k, s, i, t) for k, (t, s, i) in enumerate(rows)], schema)
    got = ordered.synchronised(data, ("A", "B", "C"), 0.05).collect()
    assert [(r["group_stamp"], r["seqs"]) for r in got] == [(0.0, [0, 0, 0])]
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = folds.synchronised(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ("A", "B", "C"), 0.05).writeStream.format("memory").queryName("groups").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r["seqs"] for r in spark.table("groups").collect()] == [[0, 0, 0]]


def test_streams_of_captures_and_rates(spark, tmp_path):
    (tmp_path / "caps").mkdir()
    (tmp_path / "caps" / "a.pcap").write_bytes(capture([packets.packet(0, 40, 2000)] * 3))
    s = readers.captured_stream(spark, str(tmp_path / "caps"), 2368, "0").withColumn("ts", F.timestamp_seconds(F.col("stamp_ns") / 1e9))
    query = folds.rates(s, "ts").writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r["n"] for r in spark.table("rates").collect()] == [3]


def test_inertial_and_archive(spark):
    s = spark.createDataFrame([("a", 1, 0.1, 0.2, 9.8, 0.0, 0.0, 0.3, 41.5)], "sensor string, stamp_ns long, accel_x float, accel_y float, accel_z float, gyro_x float, gyro_y float, gyro_z float, temperature float")
    r = readers.inertial(s).first()
    assert r["orientation_x"] == pytest.approx(41.5) and r["orientation_covariance_0"] == -1 and r["linear_acceleration_z"] == pytest.approx(9.8, abs=1e-5)
    px = "<item><px><id_>{}</id_><rotCorrection_>90</rotCorrection_><vertCorrection_>{}</vertCorrection_><distCorrection_>50</distCorrection_></px></item>"
    text = "<b><DB><enabled_><count>3</count><item>1</item><item>0</item><item>1</item></enabled_><minIntensity_><item>3</item><item>0</item><item>0</item></minIntensity_><points_>" + "".join(px.format(i, 10 - i) for i in range(3)) + "</points_></DB></b>"
    got = {r["laser_id"]: r for r in readers.calibration_from_xml(spark, text, "a").collect()}
    assert set(got) == {0, 2} and got[0]["dist_correction"] == 0.5 and got[0]["rot_correction"] == pytest.approx(np.pi / 2) and got[0]["min_intensity"] == 3
    assert (got[0]["ring"], got[2]["ring"]) == (1, 0)


def test_status_recalibrates_and_grids(spark):
    c = packets.example_calibration(spark, ("0",))
    status = spark.createDataFrame([("0", 10, [0.0] * 16), ("0", 20, [float(i) for i in range(16)])], "sensor string, stamp_ns long, angles array<double>")
    dated = spark.createDataFrame([("0", i, i, packets.packet(0, 40, 2000)) for i in (4, 10, 19, 25)], "sensor string, packet_no long, stamp_ns long, data binary")
    z = {r["packet_no"]: r for r in packets.decode_recalibrated(dated, c, status).where("laser_id = 3 AND block = 0 AND firing = 0").collect()}
    assert [z[i]["z"] for i in (4, 10, 19, 25)] == pytest.approx([10 * np.sin(np.radians(x)) for x in (-9, 0, 0, 3)]) and all(r["ring"] == 3 for r in z.values())
    raw = spark.createDataFrame([("0", i, packets.packet(480 * i, 40, 2000)) for i in (4, 9)], "sensor string, packet_no long, data binary")
    g = packets.grid(packets.decode(raw, c))
    assert g.agg(F.max("row"), F.max("col"), F.countDistinct("row", "col")).first()[:] == (47, 15, 768)
    assert packets.transposed(g).agg(F.max("row")).first()[0] == 15


def test_as_of_in_buckets(spark):
    from echofield.operators import joins

    rng = np.random.default_rng(3)
    left = spark.createDataFrame([("k" if i % 4 else "l", i, float(t)) for i, t in enumerate(rng.integers(0, 300, 200))], "key string, seq long, stamp double")
    right = spark.createDataFrame([("k", float(t), float(v)) for t, v in zip(rng.integers(0, 300, 12), rng.random(12))], "key string, at double, value double")
    plain = sorted(map(tuple, joins.as_of(left, right, "key", "stamp", "value").collect()))
    cut = sorted(map(tuple, joins.as_of(left, right, "key", "stamp", "value", width=10.0).collect()))
    assert str(plain) == str(cut)
    rows = [(r["at"], r["value"]) for r in right.collect()]
    for key, _, stamp, value in cut:
        assert value == max((r for r in rows if r[0] <= stamp and key == "k"), default=(0, None))[1]


def test_streams_with_equal_frame_numbers_stay_apart(spark):
    """Two targets, two streams that number their frames alike: each track is what its stream gives alone."""
    from echofield.config import Target, Tracker
    from echofield.plans import flow

    def target(stream, cx, cy):
        turn = np.arctan2(-cy, -cx)
        return [(stream, f, i, float(cx + 0.125 * np.cos(a)), float(cy + 0.125 * np.sin(a)), z, 250.0) for f in range(3) for i, (a, z) in enumerate([(turn + b, z) for b in np.linspace(-0.6, 0.6, 15) for z in (-0.4, 0.0, 0.4)])]

    schema = "stream long, frame_no long, seq long, x double, y double, z double, intensity double"
    rows, stamps = target(1, -8.0, 0.0) + target(2, -6.0, 1.0), [(s, f, f / 10) for s in (1, 2) for f in range(3)]
    cfg = Target(sor_sigma=5.0, tolerance=0.05)

    def track(rows, stamps):
        got = flow.target_track(spark.createDataFrame(rows, schema), spark.createDataFrame(stamps, "stream long, frame_no long, stamp double"), cfg, Tracker())
        return {(r["stream"], r["seq"]): (r["cx"], r["cy"], r["status"]) for r in got.collect()}

    both = track(rows, stamps)
    for s in (1, 2):
        alone = track([r for r in rows if r[0] == s], [r for r in stamps if r[0] == s])
        assert all(both[k] == pytest.approx(v) for k, v in alone.items()) and len(alone) == 3
    assert abs(both[1, 2][0] + 8) < 0.06 and abs(both[2, 2][0] + 6) < 0.06


def test_a_cloud_without_a_pose_drops_its_group(spark):
    from echofield.plans import flow

    clouds = spark.createDataFrame([("s", x, n, n + k / 100) for n in range(4) for k, x in enumerate("ab")], "stream string, sensor string, seq long, stamp double")
    cloud_points = spark.createDataFrame([("s", x, n, i, 1.0, float(i), 0.0, 9.0, 0, 0.0) for n in range(4) for x in "ab" for i in range(2)], "stream string, sensor string, cloud_seq long, seq long, x double, y double, z double, intensity double, ring int, time double")
    poses = spark.createDataFrame([(x, t, 0.0, 0.0, 0.0, 1.0, 10.0 * t, 0.0, 0.0) for x, t in (("a", 0.0), ("a", 0.98), ("a", 2.0), ("a", 3.0), ("b", 1.0), ("b", 2.0), ("b", 2.9))], "sensor string, at double, qx double, qy double, qz double, qw double, tx double, ty double, tz double")
    got = flow.fused_at(clouds, cloud_points, poses, ["a", "b"]).collect()
    assert {(r["out_stamp"], r["sensor"], r["x"]) for r in got} == {(1.0, "a", 10.8), (1.0, "b", 11.0), (2.0, "a", 21.0), (2.0, "b", 21.0)}
    assert all(r["time"] == pytest.approx(0.0 if r["sensor"] == "a" else 0.01) for r in got)


def test_equipment_in_order(spark):
    """Input before the filters: a lost frame leaves the memory alone, and a jump lowers what is not lowered yet."""
    from echofield.config import Equipment, Geometry
    from echofield.plans import flow

    walls = lambda y: [(x, s * y, z) for x in np.arange(-5, 5.1, 0.25) for s in (1, -1) for z in (0.6, 0.8, 1.0, 1.2)]
    ground = [(x, y, -0.8) for x in np.arange(-3, 3.1, 0.3) for y in np.arange(-1.0, 1.01, 0.25)]
    rows = [(f, i, float(x), float(y), float(z)) for f, w in enumerate((1.5, 1.6, 3.0, 1.6)) for i, (x, y, z) in enumerate(ground + walls(w))]
    inputs = spark.createDataFrame([(f, 500 if f != 1 else 0, 0.0, "") for f in range(4)], "frame_no long, n long, age_s double, failure string")
    cfg = Equipment(geometry=Geometry(side_z=(0.5, 1.5), min_distance=3))
    cloud = spark.createDataFrame(rows, "frame_no long, seq long, x double, y double, z double")
    got = {r["frame_no"]: r for r in flow.equipment_track(cloud, inputs, cfg, robust_plane=False).collect()}
    assert got[0]["status"] == "OK" and got[0]["left_front_mm"] == pytest.approx(1500)
    assert (got[1]["status"], got[1]["reason"], got[1]["left_front_valid"]) == ("LOST", "NO_POINTCLOUD", False)
    assert (got[2]["reason"], got[2]["status"], got[2]["left_front_valid"], got[2]["left_front_reason"]) == ("DISTANCE_JUMP_REJECTED", "DEGRADED", False, "DISTANCE_JUMP_REJECTED")
    assert got[3]["left_front_mm"] == pytest.approx(0.3 * 1600 + 0.7 * 1500) and got[3]["status"] == "OK"


def test_captured_statuses_and_registers(spark, tmp_path):
    import struct

    status = bytearray(1206)
    status[834:898] = np.array([-15.0 + 2 * i for i in range(16)], dtype="<f4").tobytes()
    head = bytearray(42)
    head[23], head[36:38] = 17, struct.pack(">H", 7788)
    body = bytes(head) + bytes(status)
    (tmp_path / "a.pcap").write_bytes(b"\xd4\xc3\xb2\xa1" + bytes(20) + struct.pack("<4I", 3, 500, len(body), len(body)) + body)
    r = readers.captured_statuses(spark, str(tmp_path), 7788, "s").collect()
    assert len(r) == 1 and r[0]["stamp_ns"] == 3_000_500_000 and r[0]["angles"][:4] == [-15.0, 1.0, -13.0, 3.0]
    rows = [(1, 10, struct.pack(">HHHBBB2H", 1, 0, 7, 1, 3, 4, 40000, 5)), (2, 10, struct.pack(">HHHBBB", 1, 0, 3, 1, 0x83, 2)), (3, 10, b""), (4, 10, None), (5, 10, struct.pack(">HHHBBBH", 1, 0, 7, 1, 3, 4, 7))]
    got = readers.registers_of(spark.createDataFrame(rows, "ts long, first long, answer binary")).collect()
    assert sorted(map(tuple, got)) == [(1, 10, 40000), (1, 11, 5)]


def test_current_path(spark):
    from echofield.config import Path
    from echofield.operators import ordered

    rows = [("s", i, "a" if i < 4 else "b", "map", float(i), float(i), 0.0, 0.0) for i in range(12)]
    p = spark.createDataFrame(rows, "stream string, seq long, source string, frame_id string, stamp double, x double, y double, z double")
    got = ordered.path(p, Path(min_step_m=1.5, max_points=3)).collect()
    assert sorted(r["seq"] for r in got) == [6, 8, 10]


def test_streams_are_published_and_delivered(spark, tmp_path):
    from echofield.streaming import sinks

    rows = spark.createDataFrame([("a" if i % 3 else "b", i, float(i)) for i in range(30)], "stream string, seq long, v double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    sinks.published(stream, str(tmp_path / "out"), str(tmp_path / "c1"), ("stream",)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30 and (tmp_path / "out" / "stream=a").exists()
    seen = []
    sinks.delivered(stream, lambda batch, n: seen.extend((n, r["stream"], r["seq"]) for r in batch.collect()), str(tmp_path / "c2"), 2).awaitTermination()
    assert sorted(seen) == [(0, "a", 28), (0, "a", 29), (0, "b", 24), (0, "b", 27)]


def test_clouds_are_encoded_under_a_pose(spark):
    from echofield.operators import serving

    p = spark.createDataFrame([(0, 0, 1.0, 2.0, 3.0, 10.0, 1)], "frame_no long, seq long, x double, y double, z double, intensity double, lidar_id int")
    r = serving.decode_clouds(serving.encode_clouds(p, pose=((0.0, 0.0, 2.0, 2.0), (1.0, -2.0, 0.5)))).first()
    assert (r["x"], r["y"], r["z"]) == pytest.approx((-1.0, -1.0, 3.5))
