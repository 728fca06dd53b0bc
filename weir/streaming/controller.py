"""Curriculum controller: a state machine over one run's points, in batch and as a stream.

A stage lasts at least MIN_STEPS points; it ends with mastery (the mean of its last WINDOW values reaches MASTERY) or by
timeout after MAX_STEPS points; a value below GUARD holds it back for that point. History is the stage's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_STEPS, MAX_STEPS, WINDOW, MASTERY, GUARD = 5, 20, 3, 60.0, 5.0


def advance(state: tuple, value: float) -> tuple[tuple, str]:
    """state is (stage, points in it, last values)."""
    stage, n, last = state
    n, last = n + 1, [*last, value][-WINDOW:]
    if value < GUARD:
        return (stage, n, last), "hold"
    total = 0.0
    for v in last:  # plain additions in order: since 3.12 Python's sum() compensates rounding, which moves means at the bound
        total += v
    if n >= MIN_STEPS and len(last) == WINDOW and total / WINDOW >= MASTERY:
        return (stage + 1, 0, []), "mastery"
    if n >= MAX_STEPS:
        return (stage + 1, 0, []), "timeout"
    return (stage, n, last), "stay"


def staged(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """event_id, stage and decision of every point; a run is one group (bounded by the run's points)."""

    def run(points: pd.DataFrame) -> pd.DataFrame:
        state, rows = (0, 0, []), []
        for r in points.sort_values(order).itertuples():
            state, what = advance(state, getattr(r, value))
            rows.append((r.event_id, state[0], what))
        return pd.DataFrame(rows, columns=["event_id", "stage", "decision"])

    return df.select(by, *dict.fromkeys([*order, value, "event_id"])).groupBy(by).applyInPandas(run, "event_id long, stage long, decision string")


def stream(df: DataFrame, by: str, value: str) -> DataFrame:
    """The same machine over a stream, keyed by run; rows of a micro-batch are taken in order of event_id."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0, 0, [])
        now = (now[0], now[1], list(now[2]))
        points = pd.concat(list(batches)).sort_values("event_id")
        rows = []
        for r in points.itertuples():
            now, what = advance(now, getattr(r, value))
            rows.append((r.event_id, now[0], what))
        state.update((now[0], now[1], [float(v) for v in now[2]]))
        yield pd.DataFrame(rows, columns=["event_id", "stage", "decision"])

    return df.groupBy(by).applyInPandasWithState(step, "event_id long, stage long, decision string", "stage long, n long, last array<double>", "append", "NoTimeout")


def alert_stream(df: DataFrame, by: str, value: str, high: float, times: int, spike: float, window: int = 20) -> DataFrame:
    """`signals.alerts` over a stream, keyed by run: event_id, streak and alert of every point.

    The state of a run is its streak and its last `window` values; points of a micro-batch are taken in order of event_id.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        streak, last = state.get if state.exists else (0, [])
        last, rows = list(last), []
        for r in pd.concat(list(batches)).sort_values("event_id").itertuples():
            v = float(getattr(r, value))
            streak = streak + 1 if v > high else 0
            odd = len(last) >= 4 and v > spike * sum(last) / len(last)
            rows.append((r.event_id, streak, "STOP" if streak >= times else "WARN" if odd else None))
            last = [*last, v][-window:]
        state.update((streak, last))
        yield pd.DataFrame(rows, columns=["event_id", "streak", "alert"])

    return df.groupBy(by).applyInPandasWithState(step, "event_id long, streak long, alert string", "streak long, last array<double>", "append", "NoTimeout")


def windows(df: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type and tumbling window, with a watermark."""
    return df.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def deduplicated(df: DataFrame, key: str, late: str = "2 hours") -> DataFrame:
    """First row of each key within the watermark: bounded-state deduplication."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
