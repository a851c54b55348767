"""Incremental runs: new records are normalized as they come; a breaker's state over an event log."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from verishelf.operators.products import normalize, with_keys


def new_records(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the JSON files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def normalize_stream(records: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Normalizes and keys each batch of new records and hands it to the sink with its number.

    A batch may come twice after a failure: the sink should write by key or batch number.
    """
    return with_keys(normalize(records)).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def breaker_timeline(events: DataFrame, failures: int = 3, cooldown: float = 900.0) -> DataFrame:
    """event_id, engine, open: whether an engine's breaker is open when each event comes.

    events: event_id, engine, at (seconds), ok. `failures` failures in a row open the breaker for
    `cooldown` seconds, during which events are blocked and don't count; a success resets it. The
    state is two numbers, streamed over an engine's events in order: a task holds a batch. Windows can't
    say it: where a breaker opens depends on which failures before were blocked, and so on where it opened
    before; each event needs the state that the one before left. An engine is one task; engines are few and their events
    numbers, so a hot one costs time and no memory.
    """
    ready = events.select("event_id", "engine", F.col("at").cast("double").alias("at"), "ok").repartition("engine").sortWithinPartitions("engine", "at", "event_id")
    kinds = dict(ready.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine, row, until = object(), 0, float("-inf")
        for f in frames:
            shut = []
            for e, at, ok in zip(f["engine"], f["at"], f["ok"], strict=True):
                if e != engine:
                    engine, row, until = e, 0, float("-inf")
                shut.append(at < until)
                if at >= until:
                    row = 0 if ok else row + 1
                    if row >= failures:
                        row, until = 0, at + cooldown
            yield pd.DataFrame({"event_id": f["event_id"], "engine": f["engine"], "open": shut})

    return ready.mapInPandas(run, f"event_id {kinds['event_id']}, engine {kinds['engine']}, open boolean")
