"""Change classification of streams.

``classify_stream`` keeps the last content and time of every key in Spark's state store, so a batch costs what its own rows
cost, whatever the stream has seen before. Entries leave the store by its time to live. The rows go to a file sink, which
writes every batch exactly once; a stream that is started again on the same folder goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rollcall import fixed_values as fixed
from rollcall.operators.classify import check_ttl, micros
from rollcall.streaming.run import own_checkpoint, settings, start

SETTINGS = {
    # the store that keeps values with a time to live
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # with processing time, Spark would go on with batches without data and never finish what is available
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class LastSeen(StatefulProcessor):
    """Compares each row of a key with the one before it, the first of a batch with the stored one.

    Columns: the keys, ``content``, ``closed``, ``at`` (microseconds), ``place`` (orders rows of one time) and ``row``, which
    is passed through. A key's rows of one micro-batch are sorted in memory.
    """

    def __init__(self, ttl_seconds: int) -> None:
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        # by processing time; twice the time to live, since late rows may still meet an entry
        self.last = handle.getValueState("last", "content STRING, at BIGINT", 2 * self.ttl // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["at", "place"], kind="stable", ignore_index=True)
        known = self.last.get() if self.last.exists() else (None, 0)
        content, at = frame["content"].to_numpy(object), frame["at"].to_numpy(np.int64)
        before = np.concatenate([np.array([known[0]], object), content[:-1]])
        age = at - np.concatenate([[known[1]], at[:-1]])
        new, updated, closed, same = fixed.STATES
        missing = pd.isna(before)
        other = np.where(frame["closed"].fillna(False).to_numpy(bool), closed, updated)
        state = np.where(missing | (age >= self.ttl), new, np.where(before == content, same, other))
        self.last.update((None if pd.isna(content[-1]) else content[-1], int(at[-1])))
        yield pd.DataFrame({"row": frame["row"], "state": state})

    def close(self) -> None:
        pass


def classified(
    observations: DataFrame, *, keys: Sequence[str], content: str, closed: str, ts: str, ordinal: str,
    ttl_seconds: int = fixed.DEFAULT_TTL_SECONDS,
) -> DataFrame:
    """A stream of observations with their ``state``, in (ts, ordinal) order inside a key and batch."""
    check_ttl(ttl_seconds)
    rows = observations.select(
        *[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)], F.col(content).cast("string").alias("content"),
        F.col(closed).alias("closed"), micros(ts).alias("at"), F.col(ordinal).alias("place"), F.struct("*").alias("row"),
    )
    shape = observations.schema.simpleString()
    seen = rows.groupBy(*[f"key_{i}" for i in range(len(keys))]).transformWithStateInPandas(
        LastSeen(ttl_seconds), f"row {shape}, state STRING", "Append", "ProcessingTime")
    return seen.select("row.*", "state")


class Classified:
    """What a stream of ``classify_stream`` has written."""

    def __init__(self, spark, path: str, schema) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def read(self) -> DataFrame:
        """The rows of all finished batches."""
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)


def classify_stream(
    observations: DataFrame, out: str, *, keys: Sequence[str], content: str, closed: str,
    ts: str, ordinal: str, ttl_seconds: int = fixed.DEFAULT_TTL_SECONDS,
    checkpoint: str | None = None, every: str | None = None,
):
    """Start the stream; ``out`` receives the classified rows. The checkpoint is kept below ``out`` unless it is given."""
    rows = classified(observations, keys=keys, content=content, closed=closed, ts=ts, ordinal=ordinal, ttl_seconds=ttl_seconds)
    spark = observations.sparkSession
    result = Classified(spark, f"{out}/classified", rows.schema)
    writer = rows.writeStream.outputMode("append").format("parquet").option("path", result.path)
    place = own_checkpoint(result, out, checkpoint)
    with settings(spark, SETTINGS):  # a stream keeps those it was started with
        return start(writer, place, every=every), result
