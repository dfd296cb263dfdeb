"""Live tracks: the cleaning of recorded tracks over a stream of points."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trailforge.operators.tracks import Cleaner, Rules, vincenty

STATE = "x double, y double, t double, part int, has boolean"


def clean_stream(points: DataFrame, key: str, rules: Rules | None = None, measure=vincenty, idle: str = "1 hour") -> DataFrame:
    """A stream of points (key, event_time, x, y) to the kept ones with their part.

    The state of a track is its last kept point. It is dropped after ``idle``
    without points; a later point begins anew. Points of one batch are taken in
    the order of their times; those that come in a later batch though earlier
    are dropped by the rule on times. Parts of a single point are kept, as the
    next point may still come.
    """
    rules = rules or Rules()
    kind = points.schema[key].dataType.simpleString()

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        cleaner = Cleaner(rules, measure)
        if state.exists:
            x, y, t, part, has = state.get
            cleaner.part, cleaner.last = part, (x, y, None if pd.isna(t) else t) if has else None
        frame = pd.concat(list(frames)).sort_values("t")
        frame = frame.assign(part=[cleaner.take(a, b, None if pd.isna(c) else c) for a, b, c in zip(frame.x, frame.y, frame.t)])
        last = cleaner.last
        state.update((*(last or (0.0, 0.0, None))[:2], (last or (0, 0, None))[2], cleaner.part, last is not None))
        state.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1000))
        kept = frame[frame.part.notna()]
        yield kept[[key, "part", "x", "y", "t"]].astype({"part": "int32"})

    own = points.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.unix_micros(F.col("event_time").cast("timestamp")) / 1e6).alias("t"))
    return own.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, part int, x double, y double, t double", STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
