"""Analytic cases with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofield import config
from echofield.config import PRESETS, Fusion, Geometry, Path, Target, Tracker, resolve
from echofield.functions import columns as C
from echofield.operators import equipment, joins, ordered, packets, points, robust, serving, windows

FAR = 9999


def frame(spark, rows):
    return spark.createDataFrame([(0, i, float(x), float(y), float(z), 0.0) for i, (x, y, z) in enumerate(rows)], "frame_no long, seq long, x double, y double, z double, intensity double")


def patch(x, y, zs=(-0.5, -0.25, 0.0, 0.25, 0.5)):
    return [(x + dx, y, z) for dx in np.arange(-0.15, 0.151, 0.05) for z in zs]


def run_track(rows, cfg):
    state = ordered.Track()
    return [ordered.track(state, dict(stamp=t, detected=d, cx=x, cy=y, inliers=n, rms=r), cfg) for t, d, x, y, n, r in rows]


def test_axis_meets_plane(spark):
    """A direction of any length; an axis along the plane has no place there."""
    point, axis, z = tuple(map(C.d, (-8.0, 0.25, -0.7))), tuple(map(C.d, (0.1, -0.2, 1.0))), C.d(-0.142)
    r = spark.range(1).select(*C.axis_at_height(point, axis, z), *C.axis_at_height(point, (C.d(1), C.d(0), C.d(0)), z), C.radial_residual(tuple(map(C.d, (-7.0, 0.25, 5.0))), point, (C.d(0), C.d(0), C.d(2)), C.d(0.4))).first()
    assert r[:2] == pytest.approx((-7.9442, 0.1384), abs=1e-4) and r[2] == pytest.approx(-0.142, abs=1e-9)
    assert r[3:6] == (None, None, None) and r[6] == pytest.approx(0.6)


def test_tracker_degrades_and_is_lost():
    cfg = Tracker(good_inliers=25, good_rms=0.015, lost_after=3, hold=0.3)
    rows = [(10.0, True, -8.0, 0.0, 42, 0.010), *[(t, False, 0.0, 0.0, 0, 0.0) for t in (10.1, 10.2, 10.3)]]
    assert [r[4] for r in run_track(rows, cfg)] == [0, 1, 1, 2]


def test_tracker_rejects_outliers():
    cfg = Tracker(good_inliers=10, min_inliers=8, max_rms=0.05, max_jump=1.0, max_speed=2.0, lost_after=2, hold=0.3)
    good, held = run_track([(10.0, True, 0.7, -0.1, 20, 0.01), (10.1, True, -21.0, -91.0, 3, 0.01)], cfg)
    assert good[4] == 0 and held[:2] == pytest.approx((0.7, -0.1)) and held[2:] == (0.0, 0.0, 1)


def test_tracker_freezes_when_lost():
    cfg = Tracker(good_inliers=10, min_inliers=8, lost_after=2, hold=0.5)
    out = run_track([(10.0, True, 0.0, 0.0, 20, 0.01), (10.1, True, 0.1, 0.0, 20, 0.01), *[(t, False, 0.0, 0.0, 0, 0.0) for t in (10.2, 10.3, 10.4)]], cfg)
    assert out[2][4] == 1 and out[2][0] > 0.1
    assert out[3][4] == 2 and out[3][2] == 0 and out[4][4] == 2 and out[4][0] == out[3][0]


def test_roll_and_pitch(spark):
    a, b = math.tan(math.radians(-3)), math.tan(math.radians(5))
    rows = [(x, y, a * x - b * y - 0.8) for x in np.arange(-3, 3.01, 0.3) for y in np.arange(-1.8, 1.81, 0.3)]
    r = equipment.geometry(frame(spark, rows), Geometry(min_ground=20, min_wall=FAR)).first()
    assert r["attitude_valid"] and r["roll_deg"] == pytest.approx(5, abs=0.25) and r["pitch_deg"] == pytest.approx(-3, abs=0.25)


def test_yaw(spark):
    t = math.tan(math.radians(8))
    rows = [(x, s * 2 + t * x, z) for x in np.arange(-5, 5.01, 0.25) for s in (1, -1) for z in (-0.5, 0, 0.5, 1, 1.5)]
    r = equipment.geometry(frame(spark, rows), Geometry(min_ground=FAR, min_wall=20)).first()
    assert r["yaw_valid"] and r["yaw_deg"] == pytest.approx(8, abs=0.25)


@pytest.mark.parametrize(("ys", "cfg", "want"), [
    ((1.30, 1.55, -1.80, -2.05), {}, (1300, 1550, 1800, 2050)),
    ((1.25, 1.45, -1.75, -1.95), {"left_sign": -1}, (1250, 1450, 1750, 1950)),
    ((1.70, 1.70, -1.70, -1.70), {"half_width_m": 1.2}, (500, 500, 500, 500)),
])
def test_side_distances(spark, ys, cfg, want):
    g = Geometry(front_m=2.0, rear_m=1.5, window_m=0.4, min_distance=3, **cfg)
    rows = [p for x, y in zip((2, -1.5, 2, -1.5), ys) for p in patch(x, y)]
    got = {r["station"]: r["mm"] for r in robust.side_clearance(frame(spark, rows), g).collect()}
    assert [got[s] for s in equipment.STATIONS] == pytest.approx(want, abs=1)


def test_missing_side_degrades(spark):
    g = Geometry(front_m=2.0, rear_m=1.5, min_distance=3, min_ground=FAR, min_wall=FAR)
    rows = patch(2, 1.30) + patch(-1.5, 1.50) + patch(2, -1.80)
    r = equipment.geometry(frame(spark, rows), g).first()
    assert r["status"] == "DEGRADED" and r["left_front_reason"] == "none" and not r["right_rear_valid"] and r["right_rear_reason"] == "LOW_DISTANCE_POINTS"


def test_negative_clearance(spark):
    rows = [p for x, y in zip((2, -1.5, 2, -1.5), (1.1, 1.1, -1.1, -1.1)) for p in patch(x, y)]
    for least, valid in ((-0.2, True), (-0.05, False)):
        g = Geometry(front_m=2.0, rear_m=1.5, min_distance=3, half_width_m=1.2, min_clearance_m=least)
        r = equipment.geometry(frame(spark, rows), g).first()
        assert r["left_front_mm"] == pytest.approx(-100, abs=1) and r["left_front_valid"] is valid
        if not valid:
            assert r["left_front_reason"] == "CLEARANCE_INVALID" and r["reason"] == "CLEARANCE_INVALID"


def test_registers(spark):
    r = spark.range(1).select(C.scaled_register(F.lit(0x9C40), C.d(0.1), F.lit(True)).alias("a"), C.scaled_register(F.lit(0x9C40), C.d(1), F.lit(False)).alias("b"), C.scaled_register(F.lit(None).cast("int"), C.d(1), F.lit(False)).alias("c")).first()
    assert r["a"] == pytest.approx(-2553.6) and r["b"] == 40000 and r["c"] == 0


def test_ring_denoise(spark):
    rows = spark.createDataFrame([("a", 0, i, float(v)) for i, v in enumerate((5, 5, 5, 5, 9, 5, 5, 5), 1)], "sensor string, ring int, seq long, distance double")
    got = points.ring_denoise(rows, (10.0,) * 4).collect()
    assert sorted(r["seq"] for r in got) == [2, 3]


def test_three_voxels_differ(spark):
    f = frame(spark, [(0.1, 0.1, 0.1), (0.3, 0.3, 0.3), (0.5, 0.5, 0.5), (2.5, 0, 0)])
    first = points.voxel_first(f, 1.0)
    assert sorted(r["seq"] for r in first.collect()) == [0, 3]
    assert sorted(r["seq"] for r in points.voxel_first(first, 1.0).collect()) == [0, 3]
    assert points.voxel_first_capped(f, 1.0, 1).count() == 1 and points.voxel_first_capped(f, 0.0, 3).count() == 3
    mean = points.voxel_centroid(f, 1.0).where("n = 3").first()
    assert mean["x"] == pytest.approx(0.3)


def test_first_voxel_ignores_row_order(spark):
    f = frame(spark, np.random.default_rng(1).normal(0, 2, (200, 3)))
    a, b = (sorted(r["seq"] for r in points.voxel_first(x, 1.0).collect()) for x in (f, f.orderBy(F.rand(3))))
    assert a == b


def test_distance_smoothing():
    state = {}
    out = [ordered.smooth_distance(state, v, 0.3, 300.0) for v in (1000.0, 1000.0, 2000.0, 2000.0)]
    assert [ok for _, ok in out] == [True, True, False, False] and state["last"] == 1000


def test_angle_smoothing_wraps_and_holds():
    state = {}
    out = [ordered.smooth_angle(state, v, 0.1, 3.0, True) for v in (179.0, -179.0, -169.0)]
    assert [v for v, _ in out] == pytest.approx([179.0, 179.2, 179.2]) and out[2][1]


def test_cut_angle(spark):
    rows = spark.createDataFrame([("a", i, az) for i, az in enumerate((35000, 35900, 100, 200))], "sensor string, seq long, azimuth int")
    got = [r["scan_id"] for r in windows.framed_by_angle(rows, 0).orderBy("seq").collect()]
    assert got == [0, 0, 0, 1]


def test_packets_per_scan():
    assert windows.packets_per_scan(848, 600) == 85


def test_sync(spark):
    rows = spark.createDataFrame([(0, s, i, t) for s, ts in (("A", (0.0, 0.1)), ("B", (0.02, 0.11)), ("C", (0.04, 0.2))) for i, t in enumerate(ts)], "stream int, sensor string, seq long, stamp double")
    got = joins.synchronised(rows, ["A", "B", "C"], 0.05).collect()
    assert len(got) == 1 and got[0]["stamp"] == 0.0 and (got[0]["seq_0"], got[0]["seq_1"], got[0]["seq_2"]) == (0, 0, 0)


def test_wire_format():
    data = serving.encode([1, 2, np.nan], [0, 0, 0], [0, 0, 0], [10, 200, 5], [1, 2, 3])
    head, p = serving.decode(data)
    assert len(data) == 24 + 42 and list(p["class_id"]) == [2, 3] and head["point_count"] == 2 and head["fields_mask"] == 15
    with pytest.raises(ValueError):
        serving.decode(data[:-1])


@pytest.mark.parametrize(("n", "why"), [(0, "NO_POINTCLOUD"), (99, "LOW_TOTAL_POINTS"), (100, None)])
def test_input_cascade(spark, n, why):
    from echofield.config import Equipment

    got = spark.range(1).select(equipment.input_reason(F.lit(n), C.d(0.1), F.lit(""), Equipment()).alias("w")).first()["w"]
    assert got == why


def test_laser_scan(spark):
    rows = spark.createDataFrame([(0, 0, 8, 1.0, 0.01, 0.0, 5.0), (0, 1, 8, 2.0, 0.02, 0.0, 6.0), (0, 2, 7, 3.0, 0.0, 0.0, 1.0)], "frame_no long, seq long, ring int, x double, y double, z double, intensity double")
    scan = windows.laser_scan(rows, 8, 2 * math.pi / 90, 90).collect()
    full = [r for r in scan if r["range"] < math.inf]
    assert len(scan) == 90 and len(full) == 1 and full[0]["intensity"] == 6.0


def test_packet_decode(spark):
    raw = spark.createDataFrame([("0", 7, packets.packet(0, 40, 2000)), ("0", 8, b"short"), ("0", 9, packets.packet(0, 40, 2000, header=1))], "sensor string, packet_no long, data binary")
    got = packets.decode(raw, packets.example_calibration(spark)).collect()
    assert len(got) == 384 and all(r["distance"] == pytest.approx(10.0) for r in got)
    first = next(r for r in got if r["block"] == 0 and r["firing"] == 0 and r["laser_id"] == 0)
    assert first["x"] == pytest.approx(10 * math.cos(math.radians(15))) and first["z"] == pytest.approx(-10 * math.sin(math.radians(15)))
    near = packets.decode_channels(raw.where("packet_no = 7")).where("block = 0 AND laser_id = 15").orderBy("firing").collect()
    assert [r["azimuth"] for r in near] == [16, 34] and near[0]["distance"] == pytest.approx(4.0)


def test_azimuth_gap_overflow():
    r = np.array([[35900, 35940, 35980, 20, *range(60, 60 + 8 * 40, 40)]], dtype=np.uint16)
    assert packets.gaps_of(r).tolist()[0][:4] == [40, 40, 40, 40]
    assert packets.gaps_of(np.array([[35990, 30, *range(70, 470, 40)]], dtype=np.uint16)).tolist()[0][0] == -1


def test_ransac_ignores_outliers():
    rng = np.random.default_rng(0)
    v = np.column_stack([rng.uniform(-3, 3, (200, 2)), np.zeros(200)])
    v[:40, 2] = rng.uniform(0.2, 0.5, 40)
    fit = robust.ransac(v, Geometry())
    assert fit["valid"] and fit["inliers"] == 160 and abs(fit["a"]) < 1e-9


def test_trails_reset():
    state, cfg = ordered.Trail(), Path()
    row = dict(source="a", frame_id="map", stamp=0.0, x=0.0, y=0.0, z=0.0)
    out = [ordered.trail(state, {**row, **x}, cfg) for x in ({}, {"x": 0.01}, {"x": 9.0}, {"x": 9.0, "source": "b"}, {"x": 9.0, "source": "b", "stamp": -1.0})]
    assert [o[1] for o in out] == ["", "", "odom_jump_reset", "source_changed", "delta_stamp_regression"] and [o[2] for o in out] == [True, False, True, True, True]


def test_config():
    assert Fusion(slop_s=-1).slop_s == 0.05 and Geometry(percentile=7).percentile == 1.0
    assert resolve("tracker.hold", {"hold": 3}, {"tracker": {"hold": 4}}) == 3 and resolve("x.y", {}, default=5) == 5
    assert PRESETS["runtime"][1].hold == 0 and Target().mean_radius == pytest.approx(0.125)


def test_frames_without_points_stay(spark):
    from echofield.config import Equipment

    frames = spark.createDataFrame([(0,), (1,)], "frame_no long")
    states = equipment.geometry(frame(spark, patch(2, 1.3)), Geometry(min_distance=3), frames=frames)
    inputs = spark.createDataFrame([(0, 500, 0.1, ""), (1, 0, 0.1, "")], "frame_no long, n long, age_s double, failure string")
    got = {r["frame_no"]: r for r in equipment.with_input(states, inputs, Equipment()).collect()}
    assert got[0]["status"] == "DEGRADED" and got[0]["left_front_valid"]
    assert got[1]["status"] == "LOST" and got[1]["reason"] == "NO_POINTCLOUD" and not got[1]["attitude_valid"] and got[1]["left_front_reason"] == "NO_POINTCLOUD"


def test_counters_and_recording(spark, tmp_path):
    rows = spark.createDataFrame([("none",), ("empty",), ("empty",)], "drop_reason string")
    counted, seen = serving.drop_counters(rows)
    assert counted.count() == 3 and seen.get["empty"] == 2 and seen.get["all"] == 3
    p = spark.createDataFrame([("a", 0, 1.0), ("b", 3_700_000_000_000, 2.0)], "sensor string, stamp_ns long, x double")
    serving.record(p, str(tmp_path / "points"))
    assert {(r["sensor"], r["hour"]) for r in spark.read.parquet(str(tmp_path / "points")).collect()} == {("a", 0), ("b", 1)}


def test_stamps(spark):
    r = spark.range(1).select(windows.packet_stamp(C.d(1), C.d(3), 0.5).alias("a"), windows.packet_stamp(C.d(1), C.d(3), 0.5, C.d(9), F.lit(True)).alias("b")).first()
    assert (r["a"], r["b"]) == (2.5, 9.0)
    old = spark.createDataFrame([(1.0, 2.0, 5), (1.0, 9.0, 5), (8.9, 9.0, 0)], "stamp double, now double, n int")
    assert [r["warns"] for r in windows.age_flag(old, 2.0).collect()] == [False, True, True]


def test_status_angles_by_the_rule(spark):
    """Distinct angles in every slot, then slots out of their windows, written one after the other as the sensor's driver does."""

    def driver(slots):
        out = [0.0] * 16
        for i, x in enumerate(slots):
            if -16 + 2 * i <= x <= -14 + 2 * i:
                out[(0, 2, 4, 6, 8, 10, 12, 14, 1, 3, 5, 7, 9, 11, 13, 15)[i]] = x
            else:
                out[i] = (-15, 1, -13, 3, -11, 5, -9, 7, -7, 9, -5, 11, -3, 13, -1, 15)[i]
        return out

    rng = np.random.default_rng(0)
    every = [[-15.0 + 2 * i for i in range(16)], [99.0] * 16, [float("nan")] * 16, *([-15.5 + 2 * i if rng.random() < 0.6 else 50.0 for i in range(16)] for _ in range(30))]
    rows = []
    for n, slots in enumerate(every):
        data = bytearray(1206)
        data[834:898] = np.array(slots, dtype="<f4").tobytes()
        rows.append(("0", n, bytes(data)))
    got = packets.status_angles(spark.createDataFrame([*rows, ("0", 999, b"short"), ("0", 998, None)], "sensor string, stamp_ns long, data binary")).collect()
    assert {r["stamp_ns"]: r["angles"] for r in got} == {n: driver(x) for n, x in enumerate(every)}
    assert got[0]["angles"] == [-15, 1, -13, 3, -11, 5, -9, 7, -7, 9, -5, 11, -3, 13, -1, 15]


def test_views_and_lists():
    assert packets.view_sector(0, 180) == (0, 18000) and packets.view_sector(300, 30) == (30000, 3000) and packets.view_sector(10, 500) == (1000, 50000)
    assert packets.view_sector(5, 5) == packets.view_sector(-1, 9) == packets.view_sector(361, 9) == (0, 36000)
    assert packets.view_of(0.0, np.pi) == (27000, 9000) and packets.view_of(1.0, 0.0) == packets.view_of(1.0, 2 * np.pi) == (0, 36000)
    assert packets.hidden_rings("3, 7,,x,12b") == [3, 7, 0, 12] and packets.hidden_rings("") == []
    assert sorted(packets.LASER_RING) == list(range(64))


def test_banks_keep_what_the_others_drop(spark):
    """An unknown header ends a packet of the one family and not of the others; azimuths that go back are no matter."""
    p = np.frombuffer(bytearray(packets.packet(35980, 40, 100)), dtype=packets.DTYPE)
    p["blocks"]["header"][0, 3], p["blocks"]["header"][0, 5] = 0x1234, packets.LOWER_BANK
    p["blocks"]["returns"]["range"][0, 0, :4] = 0
    raw = spark.createDataFrame([("0", 1, p.tobytes()), ("0", 2, b"x"), ("0", 3, None)], "sensor string, packet_no long, data binary")
    got = packets.bank_returns(raw).collect()
    assert len(got) == 12 * 32 - 4 and {r["laser_id"] for r in got if r["block"] == 5} == set(range(32, 64)) and {r["laser_id"] for r in got if r["block"] == 3} == set(range(32))
    assert {r["azimuth"] for r in got} == {(35980 + 40 * b) % 36000 for b in range(12)}
    assert {r["block"] for r in packets.returns(raw).collect()} == {1, 2}


def test_ring_buckets_change_nothing(spark):
    rng = np.random.default_rng(3)
    rows = [(int(s), int(r), float(rng.normal(5, 0.02 if rng.random() < 0.8 else 1))) for s, r in zip(np.sort(rng.choice(5000, 900, replace=False)), rng.integers(0, 3, 900))]
    p = spark.createDataFrame(rows, "seq long, ring int, distance double")
    whole = sorted(map(tuple, points.ring_denoise(p, (10.0,) * 4, by=("ring",)).collect()))
    for width in (1, 2, 7, 100, 10_000):
        assert sorted(map(tuple, points.ring_denoise(p, (10.0,) * 4, by=("ring",), width=width).collect())) == whole
    assert len(whole) > 100


def test_grid_neighbours_by_brute_force():
    rng = np.random.default_rng(4)
    clouds = [rng.normal(0, 1, (3000, 3)), np.c_[rng.uniform(-20, 20, (4000, 2)), rng.normal(0, 0.01, 4000)], np.vstack([np.zeros((1500, 3)), rng.uniform(-9, 9, (700, 3))]), np.c_[rng.uniform(0, 50, 2500), np.zeros((2500, 2))], np.zeros((1300, 3))]
    for v in clouds:
        got = points.nearest_means(v, 20)
        some = rng.choice(len(v), 60, replace=False)
        want = np.sort(np.sqrt(((v[some][:, None] - v[None]) ** 2).sum(axis=2)), axis=1)[:, :21].sum(axis=1) / 20
        assert np.allclose(got[some], want)


def test_identity_and_missing_poses(spark):
    p = spark.createDataFrame([("base", 1.0, 2.0, 3.0), ("a", 1.0, 2.0, 3.0), ("b", 1.0, 2.0, 3.0)], "sensor string, x double, y double, z double")
    t = spark.createDataFrame([("a", 0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0)], "sensor string, " + ", ".join(f"m{i}{j} double" for i in range(3) for j in range(3)) + ", tx double, ty double, tz double")
    assert sorted(tuple(r) for r in points.rigid(p, t, target="base").collect()) == [("a", -1.0, 1.0, 3.0), ("base", 1.0, 2.0, 3.0)]


def test_families_and_settings():
    assert config.sensor_family("x: 1\n  driver_family: 'tmlidar' # site\n") == "tmlidar" and config.sensor_family("driver_family: tmlidar", "timoo") == "tm16" and config.sensor_family() == "tm16"
    with pytest.raises(ValueError):
        config.sensor_family("driver_family: other")
    for wrong in ({"topics": ("a",)}, {"topics": ("a", "")}, {"output_frame": ""}):
        with pytest.raises(ValueError):
            config.Fusion(**wrong)
    f = config.Fusion(slop_s=-1, leaf=0, tf_wait_s=-3, queue=0, min_points=-5)
    assert (f.slop_s, f.leaf, f.tf_wait_s, f.queue, f.min_points) == (0.05, 0.05, 0.05, 20, 0)
    e = config.Equipment(distance_alpha=3, angle_alpha=-1, geometry=config.Geometry(forward_sign=-7, percentile=2))
    assert (e.distance_alpha, e.angle_alpha, e.geometry.forward_sign, e.geometry.percentile) == (1.0, 0.0, -1, 1.0)
