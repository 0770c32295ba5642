"""Stateful operators as streams: label statistics, windows of events, and pyramids of slices that arrive in pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def label_counts(labels: DataFrame) -> DataFrame:
    """Running statistics of each label over the timepoints that have arrived; state is a row a label."""
    return labels.groupBy("label").agg(F.count("*").alias("n_rows"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.sum("x").alias("sum_x"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums in windows of event time; rows later than the watermark are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"))
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


#: Pairs of slices that share a state: one call of Python and one row of state for so many.
PAIRS_IN_BLOCK = 2048


def join_slices(z: np.ndarray, best: np.ndarray, since: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins slices 2k and 2k + 1, in any order: pairs, their larger value, and the rows of slices that stay alone.

    Of a slice that is there more than once the largest value holds, since it first came.
    """
    order = np.lexsort((best, z))
    first = np.flatnonzero(np.diff(z[order], prepend=z[order][:1] - 1))
    since = np.minimum.reduceat(since[order], first) if len(first) else since
    last = order[np.append(first[1:], len(order)) - 1] if len(first) else order
    z, best = z[last], best[last]
    low = np.flatnonzero((z[:-1] >> 1) == (z[1:] >> 1))  # of each whole pair
    alone = np.ones(len(z), bool)
    alone[low] = alone[low + 1] = False
    return z[low] >> 1, np.maximum(best[low], best[low + 1]), np.stack([z, best, since])[:, alone]


def slice_pairs(slices: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """``slices`` (z, best) to (pair, best): one level of a streaming pyramid.

    Slices meet as they arrive, in any order and any batch; a pair is handed on as
    soon as it is whole.  The state is what waits in a block of pairs.  A slice
    without a partner waits for ``idle_ms`` at most where it is given; then it is
    handed on alone, as a batch pyramid has it.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        waits = np.frombuffer(state.get[0], np.int64).reshape(3, -1) if state.exists else np.empty((3, 0), np.int64)
        came = [] if state.hasTimedOut else [np.stack([f["z"].astype(np.int64), f["best"].astype(np.int64), np.full(len(f), now)]) for f in frames]
        pair, best, waits = join_slices(*np.concatenate([waits, *came], 1))
        if idle_ms is not None:
            over = waits[2] + idle_ms <= now
            pair, best, waits = np.append(pair, waits[0, over] >> 1), np.append(best, waits[1, over]), waits[:, ~over]
        if waits.size:
            state.update((waits.tobytes(),))
            if idle_ms is not None:
                state.setTimeoutDuration(int(waits[2].min()) + idle_ms - now)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"pair": pair, "best": best})

    timer = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    keyed = slices.withColumn("block", F.floor(F.col("z") / (2 * PAIRS_IN_BLOCK)))
    return keyed.groupBy("block").applyInPandasWithState(step, "pair int, best int", "waiting binary", "append", timer)
