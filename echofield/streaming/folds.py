"""The ordered folds over streams, with the steps that batch uses, and windowed rates with late data."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Tracker
from ..operators.ordered import Track, smooth_distance, synchronise, track


def fold(stream: DataFrame, by: str, order: tuple[str, ...], start: Callable[[], object], step: Callable[[object, dict], tuple | None], schema: str, timeout_ms: int | None = None) -> DataFrame:
    """The rows of a micro-batch in their order, each through step with its key's state, which the state store keeps. A key
    that is silent for timeout_ms is forgotten."""
    key_type = stream.schema[by].dataType.simpleString()
    head = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in order)
    names = [by, *order, *[x.split()[0] for x in schema.split(", ")]]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = pickle.loads(state.get[0]) if state.exists else start()
        rows = pd.concat(list(frames)).sort_values(list(order))
        out = []
        for row in rows.to_dict("records"):
            if (found := step(held, row)) is not None:
                out.append((key[0], *[row[c] for c in order], *found))
        state.update((pickle.dumps(held),))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy(by).applyInPandasWithState(run, f"`{by}` {key_type}, {head}, {schema}", "state binary", "append", timeout)


def tracked(stream: DataFrame, cfg: Tracker = Tracker(), timeout_ms: int | None = None) -> DataFrame:
    return fold(stream, "stream", ("stamp", "seq"), Track, lambda s, r: track(s, r, cfg), "cx double, cy double, vx double, vy double, status int", timeout_ms)


def ema_jumps(stream: DataFrame, value: str, alpha: float, max_jump: float, by: str = "stream", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    return fold(stream, by, order, dict, lambda s, r: smooth_distance(s, r[value], alpha, max_jump), "smoothed double, valid boolean")


def synchronised(stream: DataFrame, sensors: tuple[str, ...], slop: float, queue: int = 20, by: str = "stream", order: tuple[str, ...] = ("arrival",)) -> DataFrame:
    """Groups of one cloud from each sensor as they complete."""
    return fold(stream, by, order, dict, lambda s, r: synchronise(s, r, sensors, slop, queue), "group_stamp double, span double, seqs array<long>")


def rates(stream: DataFrame, ts: str, width: str = "10 seconds", late: str = "5 seconds", by: str = "sensor") -> DataFrame:
    """Rows of each key and window; rows that come later than the watermark are dropped."""
    return stream.withWatermark(ts, late).groupBy(by, F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")
