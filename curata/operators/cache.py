"""A cache of what is computed for keys: a table bucketed by key, filled shard by shard."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Cache:
    """A table ``name`` at ``path``, bucketed and sorted by ``key`` into ``buckets``.

    A table of inputs that inputs() writes has the same buckets, so both are joined where they lie, without an exchange.
    fill() computes the keys that are not there yet: a rerun after a loss goes on behind the shards that were written.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, key: str = "key", buckets: int = 8):
        self.spark, self.name, self.path, self.key, self.buckets = spark, name, path, key, buckets

    def _write(self, rows: DataFrame, name: str, path: str, mode: str) -> None:
        # one task for each bucket, so each shard adds one file to a bucket
        rows.repartition(self.buckets, self.key).write.bucketBy(self.buckets, self.key).sortBy(self.key).mode(mode).option("path", path).format("parquet").saveAsTable(name)

    def inputs(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` as a table with the cache's buckets."""
        self._write(rows, name, f"{self.path}-{name}", "overwrite")
        return self.spark.table(name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def there(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def missing(self, rows: DataFrame) -> DataFrame:
        """Rows of a table of inputs whose key the cache lacks."""
        return rows.join(self.table().select(self.key), self.key, "left_anti") if self.there() else rows

    def fill(self, rows: DataFrame, compute: Callable[[DataFrame], DataFrame], shards: int = 1) -> int:
        """Compute what is missing, in ``shards`` appends by the key's hash; how many keys that were."""
        before = self.table().count() if self.there() else 0
        for k in range(shards):
            part = rows.where(f"pmod(xxhash64(`{self.key}`), {shards}) = {k}") if shards > 1 else rows
            todo = self.missing(part)
            if self.there() and todo.isEmpty():
                continue
            self._write(compute(todo), self.name, self.path, "append" if self.there() else "overwrite")
        return self.table().count() - before

    def joined(self, rows: DataFrame) -> DataFrame:
        """A table of inputs with what the cache has for its keys."""
        return rows.join(self.table(), self.key)
