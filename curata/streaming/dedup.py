"""Incremental ingestion: new files of a folder to rows whose key has not been seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def new_rows(stream: DataFrame, key: str, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first row of each key. With an event time, state is dropped after ``delay``; else it grows with the keys."""
    if event_time:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def read_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet folder, or a single file, as a stream."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def ingest(spark: SparkSession, source: str, schema: StructType, key: str, target: str, checkpoint: str, event_time: str | None = None) -> StreamingQuery:
    """Append new rows of a folder of Parquet files to ``target``, once for what is there now; a rerun continues."""
    stream = read_stream(spark, source, schema)
    return new_rows(stream, key, event_time).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, event_time: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width)).count()
