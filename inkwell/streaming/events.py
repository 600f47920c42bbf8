"""Structured Streaming forms of ordered operators: windows, sessions and carried units.

All take a batch or a streaming DataFrame. Run them with availableNow and a
checkpoint, and the stream gives what the batch gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type; state is dropped once the watermark passes a window."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    g = w.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round("value", 2).cast("decimal(18,2)")).alias("v"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", F.col("v").cast("double").alias("total"))


def sliding(events: DataFrame, size: str = "1 day", slide: str = "6 hours", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late) if events.isStreaming else events
    return w.groupBy(F.window("ts", size, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Per user: runs of events less than ``gap`` apart."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    g = w.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """One row per event id; in a stream ids are forgotten after the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def carried_units(events: DataFrame, opens: str = "signup") -> DataFrame:
    """Stateful chain of units per user: an event of type ``opens`` starts one, others belong to the one in progress.

    The state is a count and the unit's start, so it does not grow with the
    stream. Events of a batch are taken in the order of time and id.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, since = state.get if state.exists else (0, 0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        units, starts = [], []
        for kind, event in zip(rows["event_type"], rows["event_id"], strict=True):
            if kind == opens or n == 0:
                n, since = n + 1, int(event)
            units.append(n), starts.append(since)
        state.update((n, since))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "unit": units, "unit_start": starts})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, unit long, unit_start long", "n long, since long", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, folder: str, name: str, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs a stream over all that is there now, with its checkpoint in ``folder``, and reads what it wrote."""
    out = f"{folder}/{name}"
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True)
    q = w.foreachBatch(sink).start() if sink else w.format("parquet").option("path", out).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
