"""What the operators of this subpackage share: staging, filters of fixed size, connected components."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"

#: Rows of an Arrow batch, at most.
BATCH_ROWS = 1000

_shipped: set[str] = set()
_staged: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, whatever folder they run in. Once a session."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    # texts are long: batches of the default 10,000 rows would be the largest thing that a task holds
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def _lean():
    """Let freed arrays go back to the system at once: the allocator keeps none of 4 MB or more; returns its trim function."""
    import ctypes

    libc = ctypes.CDLL(None)
    if not hasattr(libc, "malloc_trim"):
        return lambda: None
    libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD; once it is set, the allocator does not raise it
    return lambda: libc.malloc_trim(0)


def tidy(run):
    """``run``, an Arrow function, giving freed memory back to the system: Python workers live on, and what one keeps
    another stage lacks."""

    def tidied(batches):
        import pyarrow as pa

        trim = _lean()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim()

    return tidied


def tidied_table(run):
    """As tidy(), for a function from one or two Arrow tables to one."""

    def tidied(*tables):
        import pyarrow as pa

        _lean()
        out = run(*tables)
        pa.default_memory_pool().release_unused()
        return out

    # Spark tells (group) from (group, other group) by the number of parameters
    return (lambda a: tidied(a)) if run.__code__.co_argcount == 1 else (lambda a, b: tidied(a, b))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session, which has
    no other machines, sets a temporary one; on a cluster that would lose rows, so it is an error there."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Removes the shuffle files of a query when it ends; a staged table has no further use for them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def write_staged(df: DataFrame, label: str, writer=lambda w: w) -> str:
    """Write ``df`` as Parquet into the shared folder, without leaving shuffle files; the path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer(df.write).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    if not _staged:
        atexit.register(_drop_staged)
    _staged.append((spark, path))
    return path


def staged(df: DataFrame, label: str, writer=lambda w: w) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage ends there."""
    path = write_staged(df, label, writer)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def settled(make, label: str) -> DataFrame:
    """What ``make()`` returns, as a staged table; what it staged on the way is deleted."""
    before = {path for _, path in _staged}
    out = staged(make(), label)
    for entry in [e for e in _staged if e[1] not in before and e[1] != out._staged_path]:
        _staged.remove(entry)
        _delete(*entry)
    return out


def packed(writer):
    """For staged(): texts, which the default codec leaves half again as large."""
    return writer.option("compression", "zstd")


def staged_parts(df: DataFrame, label: str, column: str, n: int) -> DataFrame:
    """As staged(), ``df`` apart by ``column``, which has the values 0 to n - 1: to read one reads its files only."""
    spark = df.sparkSession
    before = spark.conf.get(_WRITERS, None)
    spark.conf.set(_WRITERS, str(n))  # a task has a file of each part open and does not sort its rows by part
    try:
        return staged(df, label, lambda w: packed(w).partitionBy(column))
    finally:
        spark.conf.unset(_WRITERS) if before is None else spark.conf.set(_WRITERS, before)


def drop_part(table: DataFrame, column: str, k: int) -> None:
    """Delete one part of a table of staged_parts()."""
    _delete(table.sparkSession, f"{table._staged_path}/{column}={k}")


def drop_staged(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read any more."""
    for table in tables:
        entry = (table.sparkSession, table._staged_path)
        _staged.remove(entry)
        _delete(*entry)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_staged() -> None:
    for spark, path in _staged:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone: its owner cleans the shared folder
            return


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def shards(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class IdFilter:
    """A Bloom filter of a fixed size over integer ids, built on executors and shipped to them.

    It only thins out rows before a join decides: what it lets through in error is dropped there. Its size does not
    follow the data, so its broadcast is bounded; when it is full, all rows reach the join and results stay the same.
    """

    def __init__(self, words: np.ndarray):
        self.words = words
        self.bits = np.uint64(len(words) * 64)

    @staticmethod
    def positions(ids: np.ndarray, bits: np.uint64) -> list[np.ndarray]:
        h = mix64(ids.astype(np.int64).view(np.uint64))
        return [h % bits, mix64(h) % bits]

    @classmethod
    def build(cls, ids: DataFrame, column: str, log2_bits: int = 23) -> IdFilter:
        bits = np.uint64(1 << log2_bits)

        def words(batches):
            import pyarrow as pa

            own = np.zeros(1 << (log2_bits - 6), np.int64)
            for batch in batches:
                for p in IdFilter.positions(batch.column(0).to_numpy(zero_copy_only=False), bits):
                    np.bitwise_or.at(own, (p >> np.uint64(6)).astype(np.int64), (np.uint64(1) << (p & np.uint64(63))).view(np.int64))
            at = np.flatnonzero(own)
            for i in range(0, len(at), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 50_000]), pa.array(own[at[i : i + 50_000]])], ["word", "mask"])

        rows = ids.select(F.col(column).cast("long")).where(F.col(column).isNotNull()).mapInArrow(tidy(words), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        full = np.zeros(1 << (log2_bits - 6), np.uint64)
        full[rows["word"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
        return cls(full)

    def has(self, ids: np.ndarray) -> np.ndarray:
        found = np.ones(len(ids), bool)
        for p in self.positions(ids, self.bits):
            found &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return found

    def _may(self, df: DataFrame, column: str) -> Column:
        kept = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("boolean")
        def may(ids):
            import pandas as pd

            return pd.Series(kept.value.has(ids.to_numpy()))

        return may(F.coalesce(F.col(column).cast("long"), F.lit(0).cast("long")))

    def thin(self, df: DataFrame, column: str) -> DataFrame:
        """Rows of ``df`` whose id may be among the filter's."""
        return df.where(F.col(column).isNotNull()).where(self._may(df, column))

    def split(self, df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        """Rows whose id may be among the filter's, and the others, null ids too."""
        return self.thin(df, column), df.where(F.col(column).isNull() | ~self._may(df, column))


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for all nodes of ``edges`` (hi, lo) but the smallest of each component.

    Alternates small and large stars until nothing changes: each round hangs nodes below smaller ones, so a component
    of n nodes needs about log n rounds. Minima are combined before the shuffle, and a node with very many edges is
    joined, never gathered. Every round is staged, so a lost executor costs one round.
    """
    edges = staged(edges.where(F.col("hi") > F.col("lo")).select("hi", "lo").distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        if now == before or not now["n"]:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        before = now
        least = edges.groupBy("hi").agg(F.min("lo").alias("p"))
        small = edges.join(least, "hi").select(F.explode(F.array(F.struct("hi", F.col("p").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("p").alias("lo")))).alias("e")).select("e.*").where("hi > lo").distinct()
        small = staged(small, "edges")
        drop_staged(edges)
        parent = small.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("p"))
        edges = staged(small.join(parent, "lo", "left").select("hi", F.coalesce("p", "lo").alias("lo")).distinct(), "edges")
        drop_staged(small)
