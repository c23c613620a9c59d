"""Association risk over a stream: labels count once they are ``delay`` old.

One keyed operator holds, per attribute value, the decayed sums of matured labels and a
queue of labels that are not mature yet. The watermark orders what arrives: rows are
kept until it passes them, so late rows within it change nothing. A value's state is its
queue, whose length is bounded by the rows of ``delay`` plus the watermark's lag.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "row_id long, attr string, value string, t long, pos double, tot double"
STATE = "rows array<struct<t:bigint,row_id:bigint,y:int,asked:boolean>>, clock bigint, pos double, tot double"


def gated_counts(rows: DataFrame, delay: int, tau: float, lateness: str = "0 seconds") -> DataFrame:
    """For rows (row_id, attr, value, t seconds, y, ts event time): sums over the value's rows with ``t_j < t - delay``.

    Equals ``operators.risk.matured_sums`` on the same rows once the watermark has passed them.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, clock, pos, tot = state.get if state.exists else ([], None, 0.0, 0.0)
        queue = [(r["t"], r["row_id"], r["y"], r["asked"]) if not isinstance(r, tuple) else tuple(r) for r in held]
        for b in batches:
            queue += [(int(t), int(i), int(y), False) for t, i, y in zip(b["t"], b["row_id"], b["y"], strict=True)]
        queue.sort()
        ready = state.getCurrentWatermarkMs() // 1000
        out, rest, learnt = [], [], 0
        for j, (t, row_id, y, asked) in enumerate(queue):
            if not asked and t < ready:
                # Everything with t_j < t - delay has arrived and is learnt in order.
                while learnt < len(queue) and queue[learnt][0] < t - delay:
                    tj, yj = queue[learnt][0], queue[learnt][2]
                    fade = math.exp((clock - tj) / tau) if clock is not None else 0.0
                    if clock is not None:
                        pos, tot = pos * fade, tot * fade
                    clock, pos, tot = tj, pos + yj, tot + 1
                    learnt += 1
                fade = math.exp((clock - t) / tau) if clock is not None else 0.0
                out.append((row_id, *key, t, pos * fade, tot * fade))
                queue[j] = (t, row_id, y, True)
        rest = [list(x) for x in queue[learnt:]]
        state.update((rest, clock, pos, tot))
        # Rows of others may move the watermark past those that wait here.
        waiting = [x[0] for x in rest if not x[3]]
        if waiting:
            state.setTimeoutTimestamp(max((min(waiting) + 1) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["row_id", "attr", "value", "t", "pos", "tot"])

    marked = rows.withWatermark("ts", lateness).select("row_id", "attr", "value", "t", "y", "ts")
    return marked.groupBy("attr", "value").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def drift_counts(rows: DataFrame, days: int = 7, lateness: str = "1 day") -> DataFrame:
    """Rows of each regime in tumbling windows of event time ``ts``."""
    return rows.withWatermark("ts", lateness).groupBy(F.window("ts", f"{days} days"), "regime").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "regime", "n")


def trailing_activity(rows: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Rows and amount of each entity in sliding windows of a day, every hour."""
    return rows.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day", "1 hour"), "entity").agg(F.count("*").alias("n"), F.sum("amount").alias("amount")).select(F.col("window.end").alias("until"), "entity", "n", "amount")
