"""Streams into tables with a commit log, and first rows of keys with a time limit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructField, StructType

from curata.sources.commits import Table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def write_committed(stream: DataFrame, target: str, checkpoint: str, name: str, key: list[str] | None = None, also: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Append the batches of a stream to a table, each once: a batch is committed under its number.

    After a crash Spark runs the last batch again; if its commit is there, nothing is written, and if only its files
    are, they stay invisible and the batch is written anew.
    """

    def one(rows: DataFrame, number: int) -> None:
        table = Table(rows.sparkSession, target)
        table.append(rows, key, batch=f"{name}-{number}")
        if also:
            also(rows, number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_and_late(stream: DataFrame, key: str, event_time: str, keep: str = "1 hour") -> DataFrame:
    """``stream`` with late: false for the first row of each key, true for others while the key is remembered.

    The first row is the one with the earliest event time in the batch that brings the key. A key is forgotten ``keep``
    after it was last seen (by the clock of the machines), so state is bounded by the keys of that time.
    """
    millis = int(pd.Timedelta(keep).total_seconds() * 1000)
    columns = stream.columns
    schema = StructType([*stream.schema.fields, StructField("late", stream.sparkSession.createDataFrame([], "late boolean").schema[0].dataType)])

    class First(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.seen = handle.getValueState("seen", "there boolean", ttlDurationMs=millis)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            got = pd.concat(list(rows), ignore_index=True).sort_values(event_time, kind="stable")
            late = [True] * len(got)
            late[0] = self.seen.exists()
            self.seen.update((True,))
            yield got[columns].assign(late=late)

        def close(self) -> None:
            pass

    conf = stream.sparkSession.conf  # a query takes these when it starts
    conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # a time limit alone would call for batches without end
    return stream.groupBy(key).transformWithStateInPandas(First(), schema, "append", "processingTime")


def write_first(stream: DataFrame, key: str, event_time: str, target: str, side: str, checkpoint: str, name: str, keep: str = "1 hour") -> StreamingQuery:
    """The first rows of keys to the table ``target``, late ones to the table ``side``, each batch once in both."""

    def one(rows: DataFrame, number: int) -> None:
        rows.persist()
        Table(rows.sparkSession, target).append(rows.where("NOT late").drop("late"), batch=f"{name}-{number}")
        Table(rows.sparkSession, side).append(rows.where("late").drop("late"), batch=f"{name}-{number}")
        rows.unpersist()

    marked = first_and_late(stream, key, event_time, keep)
    return marked.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_folder(spark: SparkSession, path: str, schema: StructType, files: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream, ``files`` of them a batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path).select(*(F.col(f.name) for f in schema))
