"""Structured Streaming twins of ingestion and linking: exactly-once by natural key, links as records arrive, daily windows with late data."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.linking import KEYS, TOLERANCE_DAYS, sides


def first_seen(stream: DataFrame, key: list[str], time: str, late: str = "7 days") -> DataFrame:
    """Each natural key once; state is kept for the watermark's span."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def daily_counts(stream: DataFrame, time: str, by: str, late: str = "7 days") -> DataFrame:
    """Counts a day and kind, final once the watermark has passed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 day"), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day_start"), by, "n")


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Processes what is there in micro-batches and stops; a batch number repeats after a failure, so ``each`` must be idempotent."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_LAST = 2**62


def _arrivals(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Links of one key's rows as they arrive by id. The state has days and ids of both sides in order of (day, id)."""
    held = state.get if state.exists else ([], [], [], [])
    apps, outcomes = sorted(zip(held[0], held[1], strict=True)), sorted(zip(held[2], held[3], strict=True))
    rows, out = pd.concat(list(batches)).sort_values("id"), []
    for id_, day, app in zip(rows["id"].tolist(), rows["day"].tolist(), rows["app"].tolist(), strict=True):
        me = ((day - date(1970, 1, 1)).days, id_)
        own, other = (apps, outcomes) if app else (outcomes, apps)
        place = bisect_left(other, (me[0] - TOLERANCE_DAYS, -1)) if app else bisect_right(other, (me[0] + TOLERANCE_DAYS, _LAST)) - 1
        insort(own, me)
        if 0 <= place < len(other):
            it = other[place]
            # what that one would choose now, of my side and with me there
            chosen = own[bisect_right(own, (it[0] + TOLERANCE_DAYS, _LAST)) - 1] if app else own[bisect_left(own, (it[0] - TOLERANCE_DAYS, -1))]
            a, o = (me, it) if app else (it, me)
            out.append((a[1], o[1], "high" if chosen == me else "medium", o[0] - a[0]))
    state.update(tuple(list(x) for side in (apps, outcomes) for x in (zip(*side, strict=True) if side else ((), ()))))
    yield pd.DataFrame(out, columns=["new_app_id", "outcome_id", "confidence", "days_gap"])


def linked(stream: DataFrame) -> DataFrame:
    """(new_app_id, outcome_id, confidence, days_gap) that the records of a stream add as they arrive, micro-batch by micro-batch and by id within each.

    Keyed by license and kind, so a key's state is its records' days and ids; it equals linking.link_new() over the batches one after the other.
    """
    return sides(stream).groupBy(*KEYS).applyInPandasWithState(_arrivals, "new_app_id long, outcome_id long, confidence string, days_gap long", "app_days array<long>, app_ids array<long>, outcome_days array<long>, outcome_ids array<long>", "append", GroupStateTimeout.NoTimeout)
