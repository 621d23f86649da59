"""Scans and sinks of manifests, scores, hashes and documents, all as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.functions import dims
from curata.functions.seeded import order_key

S, I = T.StringType(), T.IntegerType()
MANIFEST = T.StructType([T.StructField(n, t) for n, t in (("path", S), ("label", I), ("generator", S), ("source", S))])
CANONICAL = T.StructType([T.StructField(n, t) for n, t in (("path", S), ("orig", S), ("label", I), ("generator", S), ("source", S), ("long", I))])
RAW = T.StructType([*MANIFEST.fields, T.StructField("w", I), T.StructField("h", I)])
SEGMENTS = T.StructType([T.StructField(n, t) for n, t in (("path", S), ("mask", S), ("label", I), ("source", S))])

# File name extensions of images.
EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp")
IMAGE_COLUMNS = ("image", "images", "img", "jpg", "png", "image_bytes")


def with_optional(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in order; missing ones as empty text or null, others left out."""
    have = {c.lower() for c in df.columns}
    empty = lambda f: F.lit("") if isinstance(f.dataType, T.StringType) else F.lit(None)
    return df.select(*((F.col(f.name) if f.name.lower() in have else empty(f)).cast(f.dataType).alias(f.name) for f in schema))


def read_manifest(spark: SparkSession, path: str | list[str], schema: T.StructType = CANONICAL, root: str = "") -> DataFrame:
    """CSV with a header; missing text is empty, relative paths are put under ``root``."""
    rows = with_optional(spark.read.option("header", True).csv(path), schema)
    text = {f.name: F.coalesce(F.col(f.name), F.lit("")) for f in schema if isinstance(f.dataType, T.StringType)}
    rows = rows.withColumns(text)
    if root:
        rows = rows.withColumn("path", F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), dims.norm_path(F.col("path")))))
    return rows


def read_manifests(spark: SparkSession, paths: list[str], schema: T.StructType = CANONICAL) -> DataFrame:
    """Several manifests with src_ord, their position: the first wins later."""
    out = None
    for k, p in enumerate(paths):
        one = read_manifest(spark, p, schema).withColumn("src_ord", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_splits(spark: SparkSession, prefix: str, schema: T.StructType = CANONICAL) -> DataFrame:
    """prefix_train.csv, prefix_val.csv and prefix_test.csv as one table with split; missing files are skipped."""
    out = None
    for name in ("train", "val", "test"):
        if exists(spark, f"{prefix}_{name}.csv"):
            one = read_manifest(spark, f"{prefix}_{name}.csv", schema).withColumn("split", F.lit(name))
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise FileNotFoundError(prefix)
    return out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One path a line, blank lines skipped."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path != ''")


def read_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, content: bool = True) -> DataFrame:
    """Files below a folder: path, length, modificationTime and, unless pruned, content; hidden files are skipped."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = rows.where(F.lower("path").rlike(r"\.(" + "|".join(extensions) + ")$") & ~F.substring_index("path", "/", -1).startswith("."))
    return rows if content else rows.drop("content")


def folder_label(rows: DataFrame, root: str, real: list[str]) -> DataFrame:
    """``rows`` with folder (the first one below ``root``) and label: 0 for the folders of reals, 1 for others."""
    folder = F.regexp_extract("path", ".*" + root.strip("/") + "/([^/]+)/", 1)
    return rows.withColumn("folder", folder).withColumn("label", F.when(F.col("folder").isin(*real), 0).otherwise(1))


def read_metadata(spark: SparkSession, glob: str) -> DataFrame:
    """metadata.csv of many folders: image_path (with its folder), target and category."""
    rows = spark.read.option("header", True).csv(glob).withColumn("__file", F.input_file_name())
    folder = F.regexp_replace("__file", r"/[^/]*$", "")
    return with_optional(rows.withColumn("image_path", F.concat_ws("/", folder, F.col("image_path"))), T.StructType([T.StructField(n, S) for n in ("image_path", "target", "category")]))


def image_bytes(df: DataFrame) -> Column:
    """The column of image files in a table that does not say which: by name, a struct's bytes or bytes themselves."""
    for name in IMAGE_COLUMNS:
        for f in df.schema:
            if f.name.lower() == name:
                kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
                c = F.get(f.name, F.lit(0)) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
                return c["bytes"] if isinstance(kind, T.StructType) else c
    raise ValueError(f"no image column in {df.columns}")


def long_scores(wide: DataFrame, ids: list[str], prefix: str = "score_") -> DataFrame:
    """One column for each condition to rows (ids, cond, score)."""
    columns = [c for c in wide.columns if c.startswith(prefix)]
    rows = wide.unpivot(ids, [F.col(f"`{c}`") for c in columns], "cond", "score")
    return rows.withColumn("cond", F.substring("cond", len(prefix) + 1, 1000)).withColumn("score", F.col("score").cast("double"))


def wide_scores(scores: DataFrame, ids: list[str], conditions: list[str]) -> DataFrame:
    out = scores.groupBy(*ids).pivot("cond", conditions).agg(F.first("score"))
    return out.select(*ids, *(F.col(f"`{c}`").alias(f"score_{c}") for c in conditions))


def read_scores(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A CSV of scores (label, score, and path, generator, cond and model if there)."""
    kinds = [("path", S), ("label", I), ("generator", S), ("cond", S), ("model", S), ("score", T.DoubleType())]
    return with_optional(spark.read.option("header", True).csv(path), T.StructType([T.StructField(n, t) for n, t in kinds]))


def folder_sample(rows: DataFrame, root: str, real: list[str], most: int, seed: int | str) -> DataFrame:
    """``folder_label`` with at most ``most`` files of each folder, chosen in seeded order."""
    from curata.operators.curate import stratified_sample

    return stratified_sample(folder_label(rows, root, real), ["folder"], most, seed)


def group_label(rows: DataFrame, labels: dict[str, int]) -> DataFrame:
    """``rows`` of files with group, their folder's name, and the label that ``labels`` gives it; other folders go."""
    known = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    group = F.element_at(F.split("path", "/"), -2)
    return rows.withColumn("group", group).withColumn("label", known[F.col("group")]).where("label IS NOT NULL")


def original_names(rows: DataFrame) -> DataFrame:
    """``rows`` (stem, content) with name: the stem with the extension that the bytes tell. Bytes stay as they are."""
    head = F.hex(F.substring("content", 1, 12))
    kind = F.when(head.startswith("FFD8FF"), "jpg").when(head.startswith("52494646") & F.substring(head, 17, 8).eqNullSafe("57454250"), "webp").otherwise("png")
    return rows.withColumn("name", F.concat_ws(".", "stem", kind))


def console(df: DataFrame, digits: int = 4) -> str:
    """A report's table in columns of fixed width; for results, which are small."""
    cell = lambda v: "n/a" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = [df.columns, *([cell(v) for v in r] for r in df.collect())]
    widths = [max(len(line[k]) for line in lines) for k in range(len(df.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(line, widths)).rstrip() for line in lines)


def write_manifest(df: DataFrame, path: str, schema: T.StructType = CANONICAL, seed: int = 0) -> None:
    """One CSV with a header, its fields only, in seeded order and so never sorted by class. For manifests, which are small."""
    with_optional(df, schema).orderBy(order_key(seed, F.col("path")), "path").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Scores, partitioned by condition: written before any report is made of them."""
    scores.write.mode("overwrite").partitionBy("cond").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """Distinct values, sorted, one a line."""
    df.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct().orderBy(column).write.mode("overwrite").text(path)


def markdown(df: DataFrame, digits: int = 4) -> str:
    """A report's table as text; for results, which are small."""
    cell = lambda v: "n/a" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    rows = [f"| {' | '.join(map(cell, r))} |" for r in df.collect()]
    return "\n".join([f"| {' | '.join(df.columns)} |", "|" + "---|" * len(df.columns), *rows])
