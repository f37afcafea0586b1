"""Streaming forms of the event operators: the same semantics over unbounded input.

Each takes and returns a streaming (or static) DataFrame with an event time ``ts``; late
rows beyond the watermark are left out, and state is dropped behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rates(events: DataFrame, by: list[str], window: str, slide: str, late: str) -> DataFrame:
    """Counts and rate per second in sliding windows by key."""
    w = F.window("ts", window, slide)
    n = events.withWatermark("ts", late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"))
    seconds = F.unix_micros(F.col("window.end")) - F.unix_micros(F.col("window.start"))
    return n.select(*by, F.col("window.start").alias("t0"), F.col("window.end").alias("t1"), "n", (F.col("n") / (seconds / F.lit(1e6))).alias("rate"))


def runs(events: DataFrame, by: list[str], gap: str, late: str) -> DataFrame:
    """Runs of events whose gaps stay below ``gap``."""
    s = F.session_window("ts", gap)
    n = events.withWatermark("ts", late).groupBy(s, *by).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    return n.select(*by, "t0", "t1", "n")


def in_intervals(events: DataFrame, intervals: DataFrame, on: str, late: str) -> DataFrame:
    """Stream-stream interval join: events with t0 <= ts < t1 of their key."""
    e, i = events.withWatermark("ts", late), intervals.withWatermark("t0", late).withColumnRenamed(on, "__k")
    return e.join(i, (F.col(on) == F.col("__k")) & (F.col("ts") >= F.col("t0")) & (F.col("ts") < F.col("t1"))).drop("__k")


def latest_value(events: DataFrame, key: str, value: str, late: str) -> DataFrame:
    """As-of state: for each event with a null value, the key's latest value at or before it.

    The state of a key is one pair of time and value.
    """
    kind = events.schema[key].dataType.simpleString()

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for ts, v in zip(rows["ts"], rows[value], strict=True):
            if pd.notna(v):
                if last[0] is None or ts.value // 1000 >= last[0]:
                    last = (ts.value // 1000, float(v))
            else:
                out.append((keys[0], ts, last[1] if last[0] is not None and last[0] <= ts.value // 1000 else None))
        if last[0] is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=[key, "ts", "held"])

    rows = events.withWatermark("ts", late).select(key, "ts", value)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts timestamp, held double", "at long, v double", "append", GroupStateTimeout.NoTimeout)
