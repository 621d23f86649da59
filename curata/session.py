"""A session with the settings this library is tuned for."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_temporary: dict[str, str] = {}
_there: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a temporary
    one; on a cluster that would not be shared, so it is an error there."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _temporary:
        _temporary[app] = tempfile.mkdtemp(prefix="shared-")
    return _temporary[app]


def written(rows: DataFrame) -> DataFrame:
    """``rows`` as a table in the shared folder: the lineage ends there."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/written-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    if not _there:
        atexit.register(_delete_all)
    _there.append((spark, path))
    out = spark.read.schema(rows.schema).parquet(path)
    out.written_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that written() made and nothing will read any more."""
    for table in tables:
        entry = (table.sparkSession, table.written_path)
        if entry in _there:
            _there.remove(entry)
            delete(*entry)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _delete_all() -> None:
    for spark, path in _there:
        try:
            delete(spark, path)
        except Exception:  # the session is gone: its owner cleans the shared folder
            return
