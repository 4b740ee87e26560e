"""Call logs as streams: windowed counts with late data, and the circuit breaker as a stateful operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BREAKER = "judge long, ts_ms long, ok boolean, refused boolean, run int"


def windowed(calls: DataFrame, *, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """(window_start, kind, calls, failures, slowest) of (ts, kind, ok, ms). With `late`, a watermark of so much bounds the state of a stream."""
    if late:
        calls = calls.withWatermark("ts", late)
    out = calls.groupBy(F.window("ts", width), "kind").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failures"), F.max("ms").alias("slowest"))
    return out.select(F.col("window.start").alias("window_start"), "kind", "calls", "failures", "slowest")


def breaker(calls: DataFrame, *, limit: int, cool_off_ms: int) -> DataFrame:
    """The circuit breaker over a stream (judge, ts_ms, ok): the run of failures and when it opened are the state of a judge.

    Calls of one micro-batch are taken in order of time; calls later than a batch already done aren't reordered.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, frames, state: GroupState):
        import pandas as pd

        count, opened = state.get if state.exists else (0, -1)
        pdf = pd.concat(list(frames)).sort_values("ts_ms", kind="stable")
        refused, runs = [], []
        for ts, ok in zip(pdf["ts_ms"], pdf["ok"], strict=True):
            if opened >= 0 and ts - opened >= cool_off_ms:
                count, opened = 0, -1
            refused.append(opened >= 0)
            if opened < 0:
                count = 0 if ok else count + 1
                if not ok and 0 < limit <= count:
                    opened = int(ts)
            runs.append(count)
        state.update((count, opened))
        yield pdf[["judge", "ts_ms", "ok"]].assign(refused=refused, run=runs)

    return calls.select("judge", "ts_ms", "ok").groupBy("judge").applyInPandasWithState(run, BREAKER, "count int, opened long", "append", GroupStateTimeout.NoTimeout)
