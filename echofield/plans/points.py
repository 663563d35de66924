"""Queries over points: filters, transforms, voxels, denoising, aggregates, equipment state, display."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Equipment, Geometry, Target
from ..functions import columns as C
from ..operators import equipment, points, robust, serving, windows
from .registry import query
from .views import BIG, PTS, cloud_big, meas, pts

#: Sensor poses: x, y, z, yaw, pitch, roll.
POSES = {0: (0.0, 0.0, 0.0, 0.0, 0.0, 0.0), 1: (1.5, 0.4, 0.1, 0.3, -0.05, 0.02), 2: (-1.2, -0.3, 0.2, -2.8, 0.04, -0.03)}
ROI = Target(roi_x=(-4.0, 4.0), roi_y=(-2.0, 2.0), intensity_above=60.0)
SITE = Geometry(min_ground=3, min_wall=3, min_distance=2, max_rmse=5.0, min_normal_z=0.2, window_m=3.0, max_wall_diff_deg=60.0)


def rounded(frame: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return frame.withColumns({c: F.round(c, digits) for c in names})


def r6(*names: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in names)


def transforms(spark) -> DataFrame:
    rows = []
    for sensor, (x, y, z, *angles) in POSES.items():
        m = C.euler_matrix(*angles)
        rows.append((sensor, *[v for r in m for v in r], x, y, z))
    return F.broadcast(spark.createDataFrame(rows, "sensor int, " + ", ".join(f"m{i}{j} double" for i in range(3) for j in range(3)) + ", tx double, ty double, tz double"))


def _poses_sql() -> str:
    out = []
    for sensor, (x, y, z, *angles) in POSES.items():
        cells = [v for r in C.euler_matrix(*angles) for v in r] + [x, y, z]
        out.append(f"({sensor}, " + ", ".join(f"{v!r}::DOUBLE" for v in cells) + ")")
    return "poses(sensor, " + ", ".join(f"m{i}{j}" for i in range(3) for j in range(3)) + ", tx, ty, tz) AS (VALUES " + ", ".join(out) + ")"


_MOVED = "m00*x + m01*y + m02*z + tx AS x, m10*x + m11*y + m12*z + ty AS y, m20*x + m21*y + m22*z + tz AS z"


@query(f"WITH {PTS} SELECT frame_no, seq, {r6('x', 'y', 'z', 'intensity')} FROM pts WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND x BETWEEN -4 AND 4 AND y BETWEEN -2 AND 2 AND z BETWEEN -1.342::DOUBLE AND 0.858::DOUBLE AND intensity > 60")
def roi_crop(spark, sf_dir):
    return rounded(points.target_region(pts(spark, sf_dir), ROI).select("frame_no", "seq", "x", "y", "z", "intensity"), "x", "y", "z", "intensity")


@query(f"WITH {PTS} SELECT frame_no, seq, round(sqrt(x*x+y*y+z*z), 6) AS distance FROM pts WHERE sqrt(x*x+y*y+z*z) BETWEEN 1 AND 4")
def range_gate(spark, sf_dir):
    return rounded(points.range_gate(pts(spark, sf_dir), 1.0, 4.0).select("frame_no", "seq", "distance"), "distance")


_AZ = "((CAST(floor(degrees(atan2(y, x)) * 100) AS INTEGER) % 36000) + 36000) % 36000"


@query(f"WITH {PTS} SELECT * FROM (SELECT frame_no, seq, ring, {_AZ} AS azimuth FROM pts) WHERE ring NOT IN (3, 7, 11) OR azimuth BETWEEN 3000 AND 9000 OR azimuth >= 33000 OR azimuth <= 1500")
def ring_sector_mask(spark, sf_dir):
    return points.ring_mask(pts(spark, sf_dir), [3, 7, 11], (3000, 9000), (33000, 1500)).select("frame_no", "seq", "ring", "azimuth")


@query(f"WITH {PTS} SELECT frame_no, seq, " + ", ".join(f"CASE WHEN sqrt(x*x+y*y+z*z) BETWEEN 1 AND 4 THEN round({c}, 6) ELSE 'nan'::DOUBLE END AS {c}" for c in "xyz") + " FROM pts")
def organized_nullout(spark, sf_dir):
    return rounded(points.organised(pts(spark, sf_dir), 1.0, 4.0).select("frame_no", "seq", "x", "y", "z"), "x", "y", "z")


@query(f"WITH {PTS}, {_poses_sql()} SELECT frame_no, seq, sensor, {r6('x', 'y', 'z')} FROM (SELECT frame_no, seq, sensor, {_MOVED} FROM pts JOIN poses USING (sensor))")
def rigid_transform(spark, sf_dir):
    return rounded(points.rigid(pts(spark, sf_dir), transforms(spark)).select("frame_no", "seq", "sensor", "x", "y", "z"), "x", "y", "z")


@query(f"WITH {PTS} SELECT frame_no, seq, round(-y + 1, 6) AS x, round(x - 2, 6) AS y, round(z + 0.5, 6) AS z FROM pts")
def quat_transform(spark, sf_dir):
    """A quarter turn about z from a quaternion that is not of unit length."""
    return rounded(points.rotate(pts(spark, sf_dir), (0.0, 0.0, 2.0, 2.0), (1.0, -2.0, 0.5)).select("frame_no", "seq", "x", "y", "z"), "x", "y", "z")


@query(f"WITH {PTS}, {_poses_sql()} SELECT cloud, frame_no, seq, {r6('x', 'y', 'z')} FROM (SELECT sensor AS cloud, frame_no, seq, {_MOVED} FROM pts JOIN poses USING (sensor))")
def fuse_union(spark, sf_dir):
    """Each sensor's cloud moved to the common frame, then all of them as one."""
    p, t = pts(spark, sf_dir), transforms(spark)
    return rounded(points.concatenated([points.rigid(p.where(F.col("sensor") == s), t) for s in POSES]).select("cloud", "frame_no", "seq", "x", "y", "z"), "x", "y", "z")


_CELL = "floor(x / {0}), floor(y / {0}), floor(z / {0})"


@query(f"WITH {PTS} SELECT frame_no, seq, {r6('x', 'y', 'z')} FROM (SELECT *, row_number() OVER (PARTITION BY frame_no, {_CELL.format('2::DOUBLE')} ORDER BY seq) AS n FROM pts) WHERE n = 1")
def voxel_first(spark, sf_dir):
    return rounded(points.voxel_first(pts(spark, sf_dir), 2.0).select("frame_no", "seq", "x", "y", "z"), "x", "y", "z")


@query(f"WITH {PTS} SELECT frame_no, seq FROM (SELECT frame_no, seq, row_number() OVER (PARTITION BY frame_no ORDER BY seq) AS k FROM (SELECT *, row_number() OVER (PARTITION BY frame_no, {_CELL.format('2::DOUBLE')} ORDER BY seq) AS n FROM pts) WHERE n = 1) WHERE k <= 20")
def voxel_first_cap(spark, sf_dir):
    return points.voxel_first_capped(pts(spark, sf_dir), 2.0, 20).select("frame_no", "seq")


@query(f"WITH {PTS} SELECT frame_no, CAST({_CELL.format('2::DOUBLE').split(', ')[0]} AS BIGINT) AS ix, CAST(floor(y / 2::DOUBLE) AS BIGINT) AS iy, CAST(floor(z / 2::DOUBLE) AS BIGINT) AS iz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, round(avg(intensity), 6) AS intensity, count(*) AS n FROM pts GROUP BY ALL")
def voxel_centroid(spark, sf_dir):
    return rounded(points.voxel_centroid(pts(spark, sf_dir), 2.0), "x", "y", "z", "intensity")


@query(f"WITH {BIG} SELECT frame_no, count(*) AS voxels, CAST(sum(first_seq) AS BIGINT) AS seqs FROM (SELECT frame_no, min(seq) AS first_seq FROM big GROUP BY frame_no, {_CELL.format('5::DOUBLE')}) GROUP BY frame_no")
def voxel_first_volume(spark, sf_dir):
    kept = points.voxel_first(cloud_big(spark, sf_dir), 5.0)
    return kept.groupBy("frame_no").agg(F.count("*").alias("voxels"), F.sum("seq").alias("seqs"))


@query(f"WITH {BIG} SELECT frame_no, count(*) AS voxels, round(sum(x), 4) AS sx FROM (SELECT frame_no, avg(x) AS x FROM big GROUP BY frame_no, {_CELL.format('5::DOUBLE')}) GROUP BY frame_no")
def voxel_centroid_volume(spark, sf_dir):
    c = points.voxel_centroid(cloud_big(spark, sf_dir), 5.0)
    return c.groupBy("frame_no").agg(F.count("*").alias("voxels"), F.round(F.sum("x"), 4).alias("sx"))


@query("""WITH src AS (SELECT user_id AS ring, event_id AS seq, value / 20 AS distance FROM events),
lagged AS (SELECT ring, distance AS d0, lag(distance, 1) OVER w AS d1, lag(distance, 2) OVER w AS d2, lag(distance, 3) OVER w AS d3, lag(seq, 2) OVER w AS seq FROM src WINDOW w AS (PARTITION BY ring ORDER BY seq))
SELECT ring, seq, round(d2, 6) AS distance FROM (SELECT *, 0.1::DOUBLE * 10 * CASE WHEN d0 < 2.56 THEN 8 WHEN d0 < 5.12 THEN 26 WHEN d0 < 10.24 THEN 48 ELSE 1024 END AS lim FROM lagged WHERE d3 IS NOT NULL)
WHERE 200 * abs(d3 - d2) < lim AND 200 * abs(d1 - d2) < lim""")
def ring_denoise(spark, sf_dir):
    src = meas(spark, sf_dir).select(F.col("stream").alias("ring"), "seq", (F.col("v") / 20).alias("distance"))
    return rounded(points.ring_denoise(src, (10.0, 10.0, 10.0, 10.0), by=("ring",), width=1000), "distance")


@query(f"WITH {BIG} SELECT frame_no, count(*) AS n, round(sum(x), 4) AS sx, CAST(sum(seq) AS BIGINT) AS seqs FROM big WHERE x BETWEEN 5 AND 45 AND y BETWEEN 1 AND 9 AND z BETWEEN 1 AND 7 AND intensity > 20000 GROUP BY frame_no")
def roi_crop_volume(spark, sf_dir):
    """The region of all lines."""
    kept = points.target_region(cloud_big(spark, sf_dir), Target(roi_x=(5.0, 45.0), roi_y=(1.0, 9.0), roi_z=(1.0, 7.0), intensity_above=20_000.0))
    return kept.groupBy("frame_no").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("sx"), F.sum("seq").alias("seqs"))


@query(f"WITH {BIG}, {_poses_sql()} SELECT frame_no, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM (SELECT frame_no, {_MOVED} FROM (SELECT *, CAST(frame_no % 3 AS INTEGER) AS sensor FROM big) JOIN poses USING (sensor)) GROUP BY frame_no")
def rigid_transform_volume(spark, sf_dir):
    """All lines as points of three sensors, moved to the common frame."""
    moved = points.rigid(cloud_big(spark, sf_dir).withColumn("sensor", (F.col("frame_no") % 3).cast("int")), transforms(spark))
    return moved.groupBy("frame_no").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in "xyz"])


@query(f"""WITH {PTS}, gaps AS (SELECT a.frame_no, a.seq, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS g FROM pts a JOIN pts b ON a.frame_no = b.frame_no AND a.seq <> b.seq),
nearest AS (SELECT frame_no, seq, g, row_number() OVER (PARTITION BY frame_no, seq ORDER BY g) AS n FROM gaps),
mean AS (SELECT frame_no, seq, avg(g) AS m FROM nearest WHERE n <= 5 GROUP BY ALL)
SELECT frame_no, seq FROM (SELECT *, avg(m) OVER (PARTITION BY frame_no) + stddev_samp(m) OVER (PARTITION BY frame_no) AS lim FROM mean) WHERE m <= lim""")
def sor_filter(spark, sf_dir):
    return points.outliers_removed(pts(spark, sf_dir).select("frame_no", "seq", "x", "y", "z"), 5, 1.0).select("frame_no", "seq")


_R = Target(radius=(0.8, 1.2), tolerance=1.5, min_points=1)
_CENTRE = f"""{PTS}, moved AS (SELECT *, CASE WHEN sqrt(x*x+y*y) > 1e-6 THEN x + x / sqrt(x*x+y*y) END AS mx, CASE WHEN sqrt(x*x+y*y) > 1e-6 THEN y + y / sqrt(x*x+y*y) END AS my FROM pts),
centre AS (SELECT frame_no, count(*) AS n, count(mx) AS candidates, list_sort(list(mx))[count(mx) // 2 + 1] AS cx, list_sort(list(my))[count(my) // 2 + 1] AS cy FROM moved GROUP BY frame_no)"""


@query(f"WITH {_CENTRE} SELECT frame_no, candidates, {r6('cx', 'cy')} FROM centre")
def center_median(spark, sf_dir):
    return rounded(robust.target_centre(pts(spark, sf_dir), _R).select("frame_no", "candidates", "cx", "cy"), "cx", "cy")


@query(f"""WITH {_CENTRE}, off AS (SELECT frame_no, n, abs(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)) - 1) AS o FROM pts JOIN centre USING (frame_no))
SELECT frame_no, count(*) FILTER (WHERE o <= 1.5) AS inliers, round(sqrt(avg(o*o) FILTER (WHERE o <= 1.5)), 6) AS rms, CASE WHEN count(*) FILTER (WHERE o <= 1.5) < 3 THEN 'not_enough_front_surface_inliers' ELSE 'none' END AS reason FROM off GROUP BY frame_no""")
def circle_inliers(spark, sf_dir):
    return rounded(robust.target_centre(pts(spark, sf_dir), _R).select("frame_no", "inliers", "rms", "reason"), "rms")


@query(f"WITH {PTS} SELECT frame_no, round(list_sort(list(y))[CAST(floor(0.1::DOUBLE * (count(*) - 1)) AS BIGINT) + 1], 6) AS p10, round(list_sort(list(y))[CAST(floor(0.9::DOUBLE * (count(*) - 1)) AS BIGINT) + 1], 6) AS p90 FROM pts GROUP BY frame_no")
def lower_percentile(spark, sf_dir):
    return rounded(pts(spark, sf_dir).groupBy("frame_no").agg(robust.lower_percentile(F.col("y"), 0.1).alias("p10"), robust.lower_percentile(F.col("y"), 0.9).alias("p90")), "p10", "p90")


def _walls_sql() -> str:
    w = "x BETWEEN -6 AND 6 AND abs(y) BETWEEN 0.8::DOUBLE AND 4 AND z BETWEEN -1 AND 2.5::DOUBLE"
    side = lambda c: f"0.5::DOUBLE * atan2(2 * covar_pop(x, y) FILTER (WHERE {w} AND y {c} 0), var_pop(x) FILTER (WHERE {w} AND y {c} 0) - var_pop(y) FILTER (WHERE {w} AND y {c} 0))"
    n = lambda c: f"count(*) FILTER (WHERE {w} AND y {c} 0)"
    return f"""sides AS (SELECT frame_no, count(*) FILTER (WHERE {w}) AS wall_points, CASE WHEN {n('>=')} >= 3 THEN {side('>=')} END AS lt, CASE WHEN {n('<')} >= 3 THEN {side('<')} END AS rt FROM pts GROUP BY frame_no),
dirs AS (SELECT frame_no, wall_points, CASE WHEN cos(lt) < 0 THEN -cos(lt) ELSE cos(lt) END AS lx, CASE WHEN cos(lt) < 0 THEN -sin(lt) ELSE sin(lt) END AS ly, CASE WHEN cos(rt) < 0 THEN -cos(rt) ELSE cos(rt) END AS rx, CASE WHEN cos(rt) < 0 THEN -sin(rt) ELSE sin(rt) END AS ry FROM sides),
walls AS (SELECT frame_no, wall_points, (lx IS NOT NULL)::INTEGER + (rx IS NOT NULL)::INTEGER AS directions,
  CASE WHEN lx IS NOT NULL AND rx IS NOT NULL THEN degrees(acos(abs(greatest(-1::DOUBLE, least(1::DOUBLE, lx*rx + ly*ry))))) ELSE 0 END AS diff_deg,
  CASE WHEN (lx IS NOT NULL OR rx IS NOT NULL) AND sqrt(power(coalesce(lx,0)+coalesce(rx,0),2)+power(coalesce(ly,0)+coalesce(ry,0),2)) > 1e-6 THEN degrees(atan2(coalesce(ly,0)+coalesce(ry,0), coalesce(lx,0)+coalesce(rx,0))) END AS yaw_deg FROM dirs)"""


@query(f"WITH {PTS}, {_walls_sql()} SELECT frame_no, wall_points, directions, {r6('diff_deg', 'yaw_deg')}, diff_deg <= 60 AS consistent FROM walls")
def wall_pca_yaw(spark, sf_dir):
    return rounded(robust.wall_yaw(pts(spark, sf_dir), SITE).select("frame_no", "wall_points", "directions", "diff_deg", "yaw_deg", "consistent"), "diff_deg", "yaw_deg")


def _plane_sql(where: str) -> str:
    return f"""sums AS (SELECT frame_no, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, count(*)*covar_pop(x,y) AS sxy, count(*)*covar_pop(x,z) AS sxz, count(*)*covar_pop(y,z) AS syz, count(*)*var_pop(x) AS sxx, count(*)*var_pop(y) AS syy FROM pts WHERE {where} GROUP BY frame_no),
coef AS (SELECT *, CASE WHEN n >= 3 AND abs(sxx*syy-sxy*sxy) > 1e-12 THEN (sxz*syy-syz*sxy)/(sxx*syy-sxy*sxy) END AS a, CASE WHEN n >= 3 AND abs(sxx*syy-sxy*sxy) > 1e-12 THEN (syz*sxx-sxz*sxy)/(sxx*syy-sxy*sxy) END AS b FROM sums),
fit AS (SELECT frame_no, n, a, b, mz - a*mx - b*my AS c FROM coef),
plane AS (SELECT f.frame_no, any_value(n) AS n, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, sqrt(avg(power(z - a*x - b*y - c, 2))) AS rmse, 1 / sqrt(any_value(a*a + b*b) + 1) AS normal_z FROM pts JOIN fit f USING (frame_no) WHERE {where} GROUP BY f.frame_no)"""


_GROUND = "x BETWEEN -4 AND 4 AND y BETWEEN -2.5::DOUBLE AND 2.5::DOUBLE AND z BETWEEN -2 AND 0.5::DOUBLE"


@query(f"WITH {PTS}, {_plane_sql(_GROUND)} SELECT frame_no, n, {r6('a', 'b', 'c', 'rmse', 'normal_z')}, round(degrees(atan(a)), 6) AS pitch_deg, round(degrees(atan(-b)), 6) AS roll_deg FROM plane")
def ground_plane_lsq(spark, sf_dir):
    fit = robust.least_squares_plane(robust.ground_region(pts(spark, sf_dir), Geometry()))
    return rounded(fit.withColumns({"pitch_deg": F.degrees(F.atan("a")), "roll_deg": F.degrees(F.atan(-F.col("b")))}), "a", "b", "c", "rmse", "normal_z", "pitch_deg", "roll_deg")


@query()
def ransac_plane(spark, sf_dir):
    return robust.ransac_plane(robust.ground_region(pts(spark, sf_dir), SITE), SITE)


_SIDES = """stations(station, sx, side) AS (VALUES ('left_front', 2::DOUBLE, 1), ('left_rear', -2::DOUBLE, 1), ('right_front', 2::DOUBLE, -1), ('right_rear', -2::DOUBLE, -1)),
hits AS (SELECT frame_no, station, side * y AS w FROM pts JOIN stations ON abs(x - sx) <= 1.5::DOUBLE AND z BETWEEN -1.5::DOUBLE AND 1.5::DOUBLE AND side * y BETWEEN 0.2::DOUBLE AND 5),
counted AS (SELECT frame_no, station, count(*) AS points, list_sort(list(w))[CAST(floor(0.1::DOUBLE * (count(*) - 1)) AS BIGINT) + 1] AS wall FROM hits GROUP BY ALL),
sampled AS (SELECT frame_no, station, coalesce(points, 0) AS points, CASE WHEN points >= 2 THEN wall ELSE 0 END AS clearance_m, coalesce(points >= 2 AND wall >= -0.2::DOUBLE, false) AS valid, CASE WHEN coalesce(points, 0) < 2 THEN 'LOW_DISTANCE_POINTS' WHEN wall < -0.2::DOUBLE THEN 'CLEARANCE_INVALID' ELSE 'none' END AS reason
  FROM (SELECT DISTINCT frame_no FROM pts) CROSS JOIN stations LEFT JOIN counted USING (frame_no, station))"""


@query(f"WITH {PTS}, {_SIDES} SELECT frame_no, station, points, round(clearance_m, 6) AS clearance_m, round(clearance_m * 1000, 3) AS mm, valid, reason FROM sampled")
def side_clearance(spark, sf_dir):
    return robust.side_clearance(pts(spark, sf_dir), SITE).withColumns({"clearance_m": F.round("clearance_m", 6), "mm": F.round("mm", 3)})


_STATUS = f"""WITH {PTS}, {_walls_sql()}, {_plane_sql(_GROUND)}, {_SIDES},
wide AS (SELECT frame_no, bool_and(valid) AS all_valid, bool_or(valid) AS any_valid, bool_or(reason = 'LOW_DISTANCE_POINTS') AS low, bool_or(reason = 'CLEARANCE_INVALID') AS bad FROM sampled GROUP BY frame_no),
state AS (SELECT w.frame_no, coalesce(p.n, 0) AS in_ground, coalesce(p.n >= 3 AND p.rmse <= 5 AND p.normal_z >= 0.2::DOUBLE, false) AS plane, p.rmse, p.normal_z, p.a, p.b, wl.directions, coalesce(wl.yaw_deg IS NOT NULL AND wl.diff_deg <= 60, false) AS yaw_valid, wl.diff_deg, wl.yaw_deg, all_valid, any_valid, low, bad
  FROM wide w LEFT JOIN plane p USING (frame_no) LEFT JOIN walls wl USING (frame_no)),
why AS (SELECT *, CASE WHEN plane THEN 'none' WHEN in_ground < 3 THEN 'LOW_GROUND_POINTS' WHEN rmse > 5 THEN 'HIGH_GROUND_RMSE' WHEN normal_z < 0.2::DOUBLE THEN 'BAD_GROUND_NORMAL' ELSE 'RANSAC_FAILED' END AS ground_reason,
  CASE WHEN yaw_valid THEN 'none' WHEN directions = 0 THEN 'LOW_WALL_POINTS' WHEN diff_deg <= 60 THEN 'PCA_FAILED' ELSE 'PCA_INCONSISTENT' END AS yaw_reason,
  CASE WHEN plane AND yaw_valid AND all_valid THEN 'OK' WHEN plane OR yaw_valid OR any_valid THEN 'DEGRADED' ELSE 'INVALID' END AS status FROM state)
SELECT frame_no, status, CASE WHEN status = 'OK' THEN 'none' WHEN ground_reason <> 'none' THEN ground_reason WHEN yaw_reason <> 'none' THEN yaw_reason WHEN status = 'INVALID' THEN 'NO_VALID_OUTPUT' WHEN low THEN 'LOW_DISTANCE_POINTS' WHEN bad THEN 'CLEARANCE_INVALID' ELSE 'PARTIAL_VALID' END AS reason,
  plane OR yaw_valid AS attitude_valid, all_valid AS distances_valid, ground_reason, yaw_reason, round(CASE WHEN plane THEN degrees(atan(-b)) ELSE 0 END, 6) AS roll_deg, round(CASE WHEN plane THEN degrees(atan(a)) ELSE 0 END, 6) AS pitch_deg, round(coalesce(yaw_deg, 0), 6) AS yaw_deg FROM why"""


@query(_STATUS)
def equipment_status(spark, sf_dir):
    """The status cascade, with the plane by least squares so that SQL can follow it."""
    return rounded(equipment.geometry(pts(spark, sf_dir), SITE, robust=False).select("frame_no", "status", "reason", "attitude_valid", "distances_valid", "ground_reason", "yaw_reason", "roll_deg", "pitch_deg", "yaw_deg"), "roll_deg", "pitch_deg", "yaw_deg")


@query()
def equipment_state(spark, sf_dir):
    """The whole state with RANSAC, and the input cascade over it."""
    p = pts(spark, sf_dir)
    inputs = p.groupBy("frame_no").agg(F.count("*").alias("n")).select("frame_no", "n", (F.col("frame_no") * 0.1).alias("age_s"), F.when(F.col("frame_no") == 4, "FRAME_ID_INVALID").otherwise("").alias("failure"))
    return equipment.with_input(equipment.geometry(p, SITE), inputs, Equipment(geometry=Geometry(min_total=20)))


@query(f"WITH {PTS} SELECT frame_no, CASE WHEN frame_no = 4 THEN 'FRAME_ID_INVALID' WHEN n = 0 THEN 'NO_POINTCLOUD' WHEN n < 45 THEN 'LOW_TOTAL_POINTS' WHEN frame_no * 0.1::DOUBLE > 0.5::DOUBLE THEN 'POINTCLOUD_STALE' END AS why FROM (SELECT frame_no, count(*) AS n FROM pts GROUP BY frame_no)")
def input_quality(spark, sf_dir):
    n = pts(spark, sf_dir).groupBy("frame_no").agg(F.count("*").alias("n"))
    failure = F.when(F.col("frame_no") == 4, "FRAME_ID_INVALID").otherwise("")
    return n.select("frame_no", equipment.input_reason(F.col("n"), F.col("frame_no") * C.d(0.1), failure, Equipment(geometry=Geometry(min_total=45))).alias("why"))


@query(f"WITH {PTS} SELECT frame_no, count(*) AS n, count(*) FILTER (WHERE {_GROUND}) AS ground, count(*) FILTER (WHERE intensity >= 180) AS reflectors, {', '.join(f'round({f}({c}), 6) AS {f}_{c}' for c in 'xyz' for f in ('min', 'max'))}, min(seq) AS first_seq, max(seq) AS last_seq FROM pts GROUP BY frame_no")
def frame_counts(spark, sf_dir):
    """Counts and bounding box of each frame."""
    g = Geometry()
    ground = C.within(F.col("x"), g.ground_x) & C.within(F.col("y"), g.ground_y) & C.within(F.col("z"), g.ground_z)
    return pts(spark, sf_dir).groupBy("frame_no").agg(F.count("*").alias("n"), F.count_if(ground).alias("ground"), F.count_if(F.col("intensity") >= 180).alias("reflectors"), *[F.round(f(c), 6).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))], F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


_BINS, _RES = 90, 2 * math.pi / 90


@query(f"""WITH {PTS}, hit AS (SELECT frame_no, least(CAST(floor((atan2(y, x) + {math.pi!r}::DOUBLE) / {_RES!r}::DOUBLE) AS INTEGER), 89) AS bin, seq, sqrt(x*x+y*y) AS range, intensity FROM pts WHERE ring = 8),
last AS (SELECT frame_no, bin, arg_max(range, seq) AS range, arg_max(intensity, seq) AS intensity FROM hit GROUP BY ALL)
SELECT frame_no, CAST(bin AS INTEGER) AS bin, round(range, 6) AS range, round(intensity, 6) AS intensity FROM last""")
def laser_scan_bins(spark, sf_dir):
    """The bins that hold something; the operator fills the others with +Inf."""
    scan = windows.laser_scan(pts(spark, sf_dir), 8, _RES, _BINS).where(F.col("range") < C.d(math.inf))
    return rounded(scan, "range", "intensity")


@query(f"WITH {PTS}, f AS (SELECT sensor, frame_no, max(ring) + 1 AS n FROM pts GROUP BY ALL) SELECT sensor, arg_min(n, frame_no) AS rings, CASE WHEN arg_min(n, frame_no) > 32 THEN 57 WHEN arg_min(n, frame_no) > 16 THEN 23 ELSE 8 END AS scan_ring FROM f GROUP BY sensor")
def ring_count(spark, sf_dir):
    return windows.ring_count(pts(spark, sf_dir)).withColumn("scan_ring", windows.scan_ring(F.col("rings")))


def _ramp_sql(v: str) -> str:
    t = f"greatest(0::DOUBLE, least(1::DOUBLE, {v}))"
    return f"CASE WHEN {t} < 0.33 THEN [0.05, 0.25 + 0.65 * ({t} / 0.33), 1.0 - 0.55 * ({t} / 0.33)] WHEN {t} < 0.66 THEN [0.05 + 0.85 * (({t} - 0.33) / 0.33), 0.9, 0.45 - 0.35 * (({t} - 0.33) / 0.33)] ELSE [0.9 + 0.1 * (({t} - 0.66) / 0.34), 0.9 - 0.75 * (({t} - 0.66) / 0.34), 0.1] END"


_H = "greatest(0::DOUBLE, least(1::DOUBLE, (z + 2) / 5))"
_MODES = {
    "height": f"CASE WHEN {_H} < 0.5 THEN [0.05, 0.2 + 0.65 * {_H} * 2, 1.0 - 0.75 * {_H} * 2] ELSE [0.1 + 0.9 * ({_H} - 0.5) * 2, 0.85 - 0.55 * ({_H} - 0.5) * 2, 0.1] END",
    "intensity": "[0.12 + 0.88 * (intensity / 255), 0.12 + 0.78 * (intensity / 255), 0.12 + 0.2 * (intensity / 255)]",
    "x-distance": _ramp_sql("abs(x) / 100"), "y-distance": _ramp_sql("abs(y) / 8"), "z-distance": _ramp_sql("abs(z) / 5"),
    "lidar_id": "CASE sensor WHEN 0 THEN [0.15, 0.45, 1.0] WHEN 1 THEN [0.15, 0.95, 0.45] WHEN 2 THEN [0.75, 0.35, 1.0] ELSE [0.55, 0.55, 0.55] END",
    "stable-temporary": "[0.2, 0.62, 1.0]", "reflector": "[0.55, 0.55, 0.55]",
}


def _colour_sql() -> str:
    out = []
    for mode, plain in _MODES.items():
        shown = f"CASE WHEN intensity >= 180 THEN {'[0.1, 1.0, 0.35]' if mode == 'reflector' else '[1.0, 0.86, 0.1]'} ELSE {plain} END"
        out.append(f"SELECT frame_no, seq, '{mode}' AS mode, {shown} AS c FROM pts")
    return f"WITH {PTS} SELECT frame_no, seq, mode, round(CAST(c[1] AS DOUBLE), 6) AS r, round(CAST(c[2] AS DOUBLE), 6) AS g, round(CAST(c[3] AS DOUBLE), 6) AS b FROM (" + " UNION ALL ".join(out) + ")"


@query(_colour_sql())
def colorize(spark, sf_dir):
    """All colour modes at once: the points are exploded to one row a mode."""
    p = pts(spark, sf_dir).withColumn("cls", C.class_id(F.col("intensity")))
    cols = [F.col(c) for c in ("x", "y", "z", "intensity", "sensor", "cls")]
    each = F.array(*[F.struct(F.lit(m).alias("mode"), C.colour(m, *cols, F.lit(2)).alias("c")) for m in _MODES])
    return p.select("frame_no", "seq", F.explode(each).alias("e")).select("frame_no", "seq", "e.mode", *[F.round(F.get("e.c", F.lit(i)), 6).alias(n) for i, n in enumerate("rgb")])


@query(f"WITH {PTS} SELECT frame_no, seq, CASE WHEN intensity >= 180 THEN 3 ELSE 2 END AS class_current, CASE WHEN intensity >= 180 THEN 3 ELSE 1 END AS class_stable, CAST(least(greatest(floor(intensity), 0), 255) AS INTEGER) AS u8 FROM pts")
def classify_points(spark, sf_dir):
    i = F.col("intensity")
    return pts(spark, sf_dir).select("frame_no", "seq", C.class_id(i).alias("class_current"), C.class_id(i, stable=True).alias("class_stable"), C.to_u8(i).alias("u8"))


@query(f"""WITH {_CENTRE}, off AS (SELECT frame_no, abs(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)) - 1) AS o FROM pts JOIN centre USING (frame_no)), res AS (SELECT frame_no, avg(o * o) AS r2 FROM off WHERE o <= {_R.tolerance!r}::DOUBLE GROUP BY frame_no)
SELECT frame_no, round(-8 - cx, 6) AS dx, round(0 - cy, 6) AS dy, round((-8 - cx) * 1000, 3) AS dx_mm, round(r2, 6) AS covariance_xx, 0::DOUBLE AS covariance_xy, round(r2, 6) AS covariance_yy FROM centre LEFT JOIN res USING (frame_no)""")
def target_displacement(spark, sf_dir):
    c = robust.target_centre(pts(spark, sf_dir), _R).withColumns(C.displacement(F.col("cx"), F.col("cy"), F.col("rms"), Target().zero))
    return rounded(c.select("frame_no", "dx", "dy", F.round(F.col("dx") * C.d(1000), 3).alias("dx_mm"), "covariance_xx", "covariance_xy", "covariance_yy"), "dx", "dy", "covariance_xx", "covariance_yy")


@query(f"WITH {_CENTRE} SELECT frame_no, round(cx, 6) AS x, round(cy, 6) AS y, round((-1.342::DOUBLE + 0.858::DOUBLE) / 2, 6) AS z, 2.0::DOUBLE AS diameter, round(0.858::DOUBLE + 1.342::DOUBLE, 6) AS height FROM centre")
def target_marker(spark, sf_dir):
    return rounded(serving.marker(robust.target_centre(pts(spark, sf_dir), _R), _R), "x", "y", "z", "height")


@query(f"WITH {PTS} SELECT frame_no, seq, CASE WHEN isfinite(x) THEN printf('%.3f', x) ELSE '---' END AS x3, CASE WHEN isfinite(z) THEN printf('%.0f', z * 1000) ELSE '---' END AS z_mm FROM pts")
def display_text(spark, sf_dir):
    return pts(spark, sf_dir).select("frame_no", "seq", C.shown(F.col("x"), 3).alias("x3"), C.shown(F.col("z") * 1000, 0).alias("z_mm"))


@query(f"WITH {PTS}, {_poses_sql()}, moved AS (SELECT frame_no, sensor, seq, {_MOVED} FROM pts JOIN poses USING (sensor) WHERE sensor <> 0 UNION ALL SELECT frame_no, sensor, seq, x, y, z FROM pts WHERE sensor = 0), late AS (SELECT frame_no, max(CAST(seq * 10 AS DOUBLE)) AS out_stamp FROM pts GROUP BY frame_no) SELECT frame_no, sensor, seq, {r6('x', 'y', 'z')}, out_stamp FROM moved JOIN late USING (frame_no)")
def fuse_legacy(spark, sf_dir):
    """The older fusion: the first sensor's frame is the target, so its points stay; the latest stamp counts."""
    clouds = pts(spark, sf_dir).select("frame_no", "sensor", "seq", (F.col("seq") * 10).cast("double").alias("stamp"), "x", "y", "z")
    return rounded(points.legacy_union(clouds, transforms(spark), "0", by="frame_no").select("frame_no", "sensor", "seq", "x", "y", "z", "out_stamp"), "x", "y", "z")


@query(f"""WITH {PTS}, f AS (SELECT DISTINCT frame_no, sensor, frame_no * 10 + sensor AS stamp FROM pts), t AS (SELECT sensor, k * 25 + 5 AS at, k FROM range(3) u(sensor), range(5) v(k)),
j AS (SELECT f.frame_no, f.sensor, f.stamp, t.at, t.k FROM f ASOF JOIN t ON f.sensor = t.sensor AND f.stamp >= t.at)
SELECT p.frame_no, p.sensor, p.seq, round(-p.y + j.k, 6) AS x, round(p.x - 2 * j.k, 6) AS y, round(p.z + 0.5::DOUBLE, 6) AS z FROM pts p JOIN j ON p.frame_no = j.frame_no AND p.sensor = j.sensor WHERE j.stamp - j.at <= 20""")
def tf_by_stamp(spark, sf_dir):
    """Each cloud under the pose that held at its stamp; a cloud without a recent pose is dropped."""
    p = pts(spark, sf_dir)
    stamps = p.select("frame_no", "sensor", (F.col("frame_no") * 10 + F.col("sensor")).cast("double").alias("stamp")).distinct()
    k = F.col("k").cast("double")
    poses = spark.createDataFrame([(s, n) for s in range(3) for n in range(5)], "sensor int, k int").select("sensor", (k * 25 + 5).alias("at"), *[C.d(q).alias(c) for c, q in zip(("qx", "qy", "qz", "qw"), (0.0, 0.0, 2.0, 2.0))], k.alias("tx"), (-2 * k).alias("ty"), C.d(0.5).alias("tz"))
    return rounded(points.rigid_at(p, stamps, poses, unit=("frame_no", "sensor"), max_wait=20.0).select("frame_no", "sensor", "seq", "x", "y", "z"), "x", "y", "z")


@query(f"""WITH {PTS}, b AS (SELECT frame_no, sensor, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max, count(*) AS n FROM pts GROUP BY ALL)
SELECT frame_no, {', '.join(f'round({f}({c}_{f}), 6) AS {c}_{f}' for c in 'xyz' for f in ('min', 'max'))}, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY frame_no""")
def scene_box(spark, sf_dir):
    """The box around each frame's layers, a layer a sensor."""
    box = points.union_box(points.boxes(pts(spark, sf_dir), ("frame_no", "sensor")), ("frame_no",))
    return rounded(box, *[f"{c}_{f}" for c in "xyz" for f in ("min", "max")])


@query(f"""WITH {PTS}, u AS (SELECT *, sqrt(0.1::DOUBLE * 0.1::DOUBLE + 0.2::DOUBLE * 0.2::DOUBLE + 1) AS len FROM pts), g AS (SELECT frame_no, seq, x + 1 AS gx, y - 0.25::DOUBLE AS gy, z + 0.7::DOUBLE AS gz, 0.1::DOUBLE / len AS ax, -0.2::DOUBLE / len AS ay, 1 / len AS az, z FROM u),
h AS (SELECT *, gx * ax + gy * ay + gz * az AS t FROM g)
SELECT frame_no, seq, round(sqrt(pow(gx - t * ax, 2) + pow(gy - t * ay, 2) + pow(gz - t * az, 2)) - 0.5::DOUBLE, 6) AS residual, round(-1 + (z + 0.7::DOUBLE) * 0.1::DOUBLE, 6) AS axis_x, round(0.25::DOUBLE - (z + 0.7::DOUBLE) * 0.2::DOUBLE, 6) AS axis_y FROM h""")
def axis_residual(spark, sf_dir):
    """How far points lie from a cylinder, and where its axis passes their height."""
    at, axis = tuple(C.d(v) for v in (-1.0, 0.25, -0.7)), tuple(C.d(v) for v in (0.1, -0.2, 1.0))
    x, y, z = (F.col(c) for c in "xyz")
    ax, ay, _ = C.axis_at_height(at, axis, z)
    return rounded(pts(spark, sf_dir).select("frame_no", "seq", C.radial_residual((x, y, z), at, axis, C.d(0.5)).alias("residual"), ax.alias("axis_x"), ay.alias("axis_y")), "residual", "axis_x", "axis_y")
