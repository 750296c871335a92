"""Streams of observations: windowed sums with late data, and detection on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "n long, mean double, m2 double"
OUT = "unique_id string, ds timestamp, y double, score double, anomaly boolean"


def windowed_panel(events: DataFrame, width: str = "1 day", late: str = "2 days", id: str = "event_type", time: str = "ts", value: str = "value") -> DataFrame:
    """(unique_id, ds, y): sums by window and series; rows later than `late` are dropped. Stamps without zone become instants, which watermarks need."""
    own = events.select(F.col(id).cast("string").alias("unique_id"), F.col(time).cast("timestamp").alias("t"), F.col(value).alias("v"))
    by = own.withWatermark("t", late).groupBy(F.window("t", width), "unique_id").agg(F.sum("v").alias("y"))
    return by.select("unique_id", F.col("window.start").alias("ds"), "y")


def running_scores(panel: DataFrame, z: float = 3.0, least: int = 8) -> DataFrame:
    """Each value's distance from its series' running mean, in running deviations (Welford), before it is taken in; the state is three numbers a series."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        out = []
        for ds, y in pd.concat(list(batches)).sort_values("ds")[["ds", "y"]].itertuples(index=False):
            sd = (m2 / (n - 1)) ** 0.5 if n > 1 else 0.0
            score = (y - mean) / sd if n >= least and sd > 0 else None
            out.append((key[0], ds, y, score, bool(score is not None and abs(score) > z)))
            n += 1
            gap = y - mean
            mean += gap / n
            m2 += gap * (y - mean)
        state.update((n, mean, m2))
        yield pd.DataFrame(out, columns=["unique_id", "ds", "y", "score", "anomaly"])

    return panel.groupBy("unique_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def detect_batches(stream: DataFrame, detect: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Runs a batch detector on each micro-batch; a batch that is repeated overwrites its own folder."""

    def one(batch: DataFrame, epoch: int) -> None:
        detect(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
