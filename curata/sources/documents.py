"""JSON documents of uneven shape as VARIANT columns: fields that some versions lack or keep elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, text and doc (VARIANT; null where the text is not JSON) of each file."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"), F.try_parse_json("value").alias("doc"))


def shape(rows: DataFrame, column: str = "doc") -> str:
    """The schema that all documents of a VARIANT column have together."""
    return rows.agg(F.schema_of_variant_agg(column).alias("s")).first()["s"]


def results_of(texts: DataFrame) -> DataFrame:
    """model, cond, metric and value of results documents (text), whatever their version.

    The model is a text or an object with a name; conditions are an object by name, or a list ``results`` of objects with
    condition and metrics. A metric may be a number or a text of one; others are null. Documents that are not JSON, or
    lack conditions, have no rows.
    """
    spark = texts.sparkSession
    docs = texts.select(F.try_parse_json("text").alias("doc")).where("doc IS NOT NULL")
    return spark.sql(
        """
        WITH docs AS (
            SELECT coalesce(try_variant_get(doc, '$.model.name', 'string'), try_variant_get(doc, '$.model', 'string')) AS model,
                try_variant_get(doc, '$.conditions', 'variant') AS conditions, try_variant_get(doc, '$.results', 'variant') AS results FROM {docs}
        ), cells AS (
            SELECT model, e.key AS cond, e.value AS metrics FROM docs, LATERAL variant_explode(conditions) e WHERE e.key IS NOT NULL
            UNION ALL SELECT model, try_variant_get(e.value, '$.condition', 'string'), try_variant_get(e.value, '$.metrics', 'variant') FROM docs, LATERAL variant_explode(results) e
        )
        SELECT model, cond, e.key AS metric, try_variant_get(e.value, '$', 'double') AS value FROM cells, LATERAL variant_explode(metrics) e
        """,
        docs=docs,
    )


def read_results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """results_of() the files of a folder, in one scan."""
    return results_of(read_documents(spark, path).select("text"))
