"""Ordered stateful operators.

A fold runs over rows that are hashed by stream and sorted inside partitions; a task carries the state of one stream at a
time, so streams may be of any length and are never collected. Steps are plain functions that streaming uses as well.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Path, Tracker


def fold(frame: DataFrame, by: str, order: tuple[str, ...], start: Callable[[], object], step: Callable[[object, dict], tuple | None], schema: str, reads: tuple[str, ...] = ()) -> DataFrame:
    """step(state, row) changes the state and returns the row's results, or None for no row. Result: by, order, schema."""
    columns = [by, *order, *(c for c in reads if c not in order)]
    names = [by, *order]
    rows = frame.select(*columns).repartition(by).sortWithinPartitions(by, *order)
    head = ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in names)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType([*[frame.schema[c] for c in names], *StructType.fromDDL(schema).fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, begun = None, None, False
        for batch in batches:
            out = []
            for values in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                row = dict(zip(columns, values))
                if not begun or row[by] != key:
                    key, state, begun = row[by], start(), True
                if (found := step(state, row)) is not None:
                    out.append((*values[: len(names)], *found))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

    return rows.mapInArrow(run, f"{head}, {schema}")


@dataclass
class Track:
    """A tracker's state; it never becomes uninitialised, so a target that returns far away stays lost."""

    init: bool = False
    stamp: float = 0.0
    cx: float = 0.0
    cy: float = 0.0
    vx: float = 0.0
    vy: float = 0.0
    measured: float = 0.0
    misses: int = 0


#: A target's status.
GOOD, DEGRADED, LOST = 0, 1, 2
STATUS_TEXT = ("GOOD", "DEGRADED", "LOST")


def track(state: Track, row: dict, cfg: Tracker) -> tuple:
    """One measurement or miss: cx, cy, vx, vy, status. A row with a null in its measurement is a miss."""
    t, x, y = row["stamp"], row["cx"], row["cy"]
    usable = bool(row["detected"]) and None not in (x, y, row["inliers"], row["rms"]) and row["inliers"] >= cfg.min_inliers and row["rms"] <= cfg.max_rms and math.isfinite(x) and math.isfinite(y)
    since = t - state.measured
    if usable and state.init:
        jump = math.hypot(x - state.cx, y - state.cy)
        usable = (cfg.max_jump <= 0 or jump <= cfg.max_jump) and (cfg.max_speed <= 0 or since <= 1e-3 or jump / since <= cfg.max_speed)
    if usable:
        if state.init:
            gap = max(1e-3, since)
            state.vx, state.vy = (x - state.cx) / gap, (y - state.cy) / gap
        state.init, state.stamp, state.measured, state.cx, state.cy, state.misses = True, t, t, x, y, 0
        status = GOOD if row["inliers"] >= cfg.good_inliers and row["rms"] <= cfg.good_rms else DEGRADED
    elif not state.init:
        return 0.0, 0.0, 0.0, 0.0, LOST
    else:
        state.misses += 1
        status = LOST if state.misses >= cfg.lost_after else DEGRADED
        if status != LOST and cfg.hold > 0 and since <= cfg.hold:
            ahead = max(0.0, t - state.stamp)
            state.cx, state.cy = state.cx + state.vx * ahead, state.cy + state.vy * ahead
        if status == LOST:
            state.vx = state.vy = 0.0
        state.stamp = t
    return state.cx, state.cy, state.vx, state.vy, status


def tracked(measurements: DataFrame, cfg: Tracker = Tracker()) -> DataFrame:
    """stream, stamp, seq, cx, cy, vx, vy, status for each row of (stream, seq, stamp, detected, cx, cy, inliers, rms)."""
    return fold(measurements, "stream", ("stamp", "seq"), Track, lambda s, r: track(s, r, cfg), "cx double, cy double, vx double, vy double, status int", ("detected", "cx", "cy", "inliers", "rms"))


def smooth_distance(state: dict, value: float, alpha: float, max_jump: float) -> tuple[float, bool]:
    """Exponential smoothing; a jump makes the value invalid and leaves the state alone, however long it lasts."""
    last = state.get("last")
    if last is not None:
        if max_jump > 0 and abs(value - last) > max_jump:
            return value, False
        value = alpha * value + (1 - alpha) * last
    state["last"] = value
    return value, True


def wrapped(degrees: float) -> float:
    """An angle within 180 degrees of zero, by whole turns."""
    return degrees - 360 * math.ceil((degrees - 180) / 360) if degrees > 180 else degrees + 360 * math.ceil((-180 - degrees) / 360) if degrees < -180 else degrees


def smooth_angle(state: dict, value: float, alpha: float, max_jump: float, wrap: bool) -> tuple[float, bool]:
    """Exponential smoothing; a jump gives the last value again, which stays valid. The flag tells of the jump."""
    last = state.get("last")
    if last is None:
        state["last"] = value
        return value, False
    turn = wrapped(value - last) if wrap else value - last
    if max_jump > 0 and abs(turn) > max_jump:
        return last, True
    value = wrapped(last + alpha * turn) if wrap else last + alpha * turn
    state["last"] = value
    return value, False


def ema_jumps(rows: DataFrame, value: str, alpha: float, max_jump: float, by: str = "stream", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    return fold(rows, by, order, dict, lambda s, r: smooth_distance(s, r[value], alpha, max_jump), "smoothed double, valid boolean", (value,))


def angle_holds(rows: DataFrame, value: str, alpha: float, max_jump: float, wrap: bool = True, by: str = "stream", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    return fold(rows, by, order, dict, lambda s, r: smooth_angle(s, r[value], alpha, max_jump, wrap), "smoothed double, held boolean", (value,))


def throttle(rows: DataFrame, stamp: str, rate: float, by: str = "stream", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The rows that are sent: the first, and each that is 1 / rate after the last sent one."""

    def step(state: dict, row: dict) -> tuple | None:
        if "sent" in state and row[stamp] - state["sent"] < 1 / rate:
            return None
        state["sent"] = row[stamp]
        return (row[stamp],)

    return fold(rows, by, order, dict, step, "sent_at double", (stamp,))


def path_steps(rows: DataFrame, min_step: float, by: str = "stream", order: tuple[str, ...] = ("seq",), most: int = 0) -> DataFrame:
    """The rows at least a step away from the last kept one; x, y, z. Of each stream the newest `most`, or all for 0."""

    def step(state: dict, row: dict) -> tuple | None:
        p = row["x"], row["y"], row["z"]
        if "at" in state and math.dist(state["at"], p) < min_step:
            return None
        state["at"] = p
        return p

    kept = fold(rows, by, order, dict, step, "px double, py double, pz double", ("x", "y", "z"))
    return newest(kept, most, (by,), order) if most > 0 else kept


def newest(rows: DataFrame, most: int, by: tuple[str, ...] = ("stream",), order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The newest rows of each key, as a bounded queue that drops the oldest holds them."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_n", rank).where(F.col("_n") <= most).drop("_n")


@dataclass
class Trail:
    segment: int = 0
    source: str | None = None
    frame: str | None = None
    stamp: float | None = None
    at: tuple | None = None


def trail(state: Trail, row: dict, cfg: Path) -> tuple:
    """One pose: the segment it belongs to, why that began, and whether the pose is kept. A new source or frame, a clock that
    goes back, or a jump begins a segment."""
    p, why = (row["x"], row["y"], row["z"]), ""
    if state.source is not None and row["source"] != state.source:
        why = "source_changed"
    elif state.frame is not None and row["frame_id"] != state.frame:
        why = "frame_changed"
    elif state.stamp is not None and row["stamp"] + cfg.regression_s < state.stamp:
        why = "delta_stamp_regression"
    if why:
        state.at = None
        state.segment += 1
    state.source, state.frame, state.stamp = row["source"], row["frame_id"], row["stamp"]
    if state.at is not None and cfg.reset_jump_m > 0 and math.dist(state.at, p) > cfg.reset_jump_m:
        why, state.at = "odom_jump_reset", None
        state.segment += 1
    kept = state.at is None or math.dist(state.at, p) >= cfg.min_step_m
    if kept:
        state.at = p
    return state.segment, why, kept


def trails(rows: DataFrame, cfg: Path = Path(), by: str = "stream", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """segment, reset_reason and kept of each pose."""
    return fold(rows, by, order, Trail, lambda s, r: trail(s, r, cfg), "segment int, reset_reason string, kept boolean", ("source", "frame_id", "stamp", "x", "y", "z"))


def path(rows: DataFrame, cfg: Path = Path(), by: str = "stream", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The poses of each stream's current path: those kept in its last segment, the newest cfg.max_points of them."""
    kept = trails(rows, cfg, by, order).where("kept")
    last = F.max("segment").over(W.partitionBy(by))
    here = kept.withColumn("_last", last).where("segment = _last").drop("_last")
    return newest(here, cfg.max_points, (by,), order) if cfg.max_points > 0 else here


def synchronise(state: dict, row: dict, sensors: tuple[str, ...], slop: float, queue: int = 20) -> tuple | None:
    """Clouds in order of arrival, into groups of one from each sensor whose stamps span at most slop. Each sensor has a queue;
    heads that the latest head has left behind are dropped, as are clouds beyond the queue's length. Gives a group's stamp,
    span and sequence numbers."""
    line = state.setdefault(row["sensor"], [])
    line.append((row["stamp"], row["seq"]))
    line.sort()
    if len(line) > queue:
        line.pop(0)
    while all(state.get(s) for s in sensors):
        heads = [state[s][0] for s in sensors]
        latest, first = max(heads)[0], min(heads)[0]
        if latest - first <= slop:
            for s in sensors:
                state[s].pop(0)
            return first, latest - first, [n for _, n in heads]
        for s in sensors:
            while state[s] and state[s][0][0] < latest - slop:
                state[s].pop(0)
    return None


def synchronised(clouds: DataFrame, sensors: tuple[str, ...], slop: float, queue: int = 20, by: str = "stream", order: tuple[str, ...] = ("arrival",)) -> DataFrame:
    """Groups in order of arrival: by, order of the completing cloud, stamp, span, seqs (one a sensor)."""
    return fold(clouds, by, order, dict, lambda s, r: synchronise(s, r, sensors, slop, queue), "group_stamp double, span double, seqs array<long>", ("sensor", "seq", "stamp"))

