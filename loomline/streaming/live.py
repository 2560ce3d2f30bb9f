"""Streams of timed rows (ts, user_id, value): sessions, first completions, windowed totals, and folds with a state by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def _timed(rows: DataFrame, late: str) -> DataFrame:
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if rows.isStreaming else rows


def session_totals(stream: DataFrame, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user with their rows and sums; works on a stream and on a table."""
    timed = _timed(stream, late)
    found = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def first_completions(stream: DataFrame, key: str, *, late: str = "1 hour") -> DataFrame:
    """One row for each key."""
    timed = _timed(stream, late)
    return timed.dropDuplicatesWithinWatermark([key]) if stream.isStreaming else timed.dropDuplicates([key])


def rolling_totals(stream: DataFrame, *, window: str = "10 minutes", every: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    timed = _timed(stream, late)
    found = timed.groupBy("event_type", F.window("ts", window, every).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("event_type", F.col("w.start").alias("start"), "n")


LEDGER = "run string, seq long, total_calls long, total_cost double, breach string, paused boolean"


def ledger(stream: DataFrame, *, calls: int, cost: float) -> DataFrame:
    """A running budget for each run of a stream of requests (run, seq, calls, cost): totals, the first limit that a request
    broke, and whether it or one before it broke any. The state of a run is its totals; requests of one batch are taken by seq."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, spent, paused = state.get if state.exists else (0, 0.0, False)
        rows = []
        for request in pd.concat(list(batches)).sort_values("seq").itertuples():
            n, spent = n + int(request.calls), spent + float(request.cost)
            breach = "calls" if n > calls else "cost" if spent > cost else None
            paused = paused or breach is not None
            rows.append((key[0], int(request.seq), n, spent, breach, paused))
        state.update((n, spent, paused))
        yield pd.DataFrame(rows, columns=["run", "seq", "total_calls", "total_cost", "breach", "paused"])

    return stream.groupBy("run").applyInPandasWithState(step, LEDGER, "calls long, cost double, paused boolean", "append", "NoTimeout")


def rolled_up(stream: DataFrame) -> DataFrame:
    """Cues (source, start, end, text) of a stream without rolling repeats: of each source the last cue that was kept is the
    state; one that overlaps it with equal words is left out, a longer one that begins with its words is kept as `replaces`.
    Cues of one batch are taken by (start, end, text)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = []
        for cue in pd.concat(list(batches)).sort_values(["start", "end", "text"]).itertuples():
            words = cue.text.split()
            before = last[1].split() if last is not None and cue.start < last[0] else None
            if before == words:
                continue
            grown = before is not None and len(words) > len(before) and words[: len(before)] == before
            last = (max(last[0], cue.end) if grown else cue.end, cue.text)
            rows.append((key[0], cue.start, last[0], cue.text, grown))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(rows, columns=["source", "start", "end", "text", "replaces"])

    return stream.groupBy("source").applyInPandasWithState(step, "source string, start double, end double, text string, replaces boolean", "end double, text string", "append", "NoTimeout")
