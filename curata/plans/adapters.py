"""The roles of this library's tables, played by the driver's test tables: as DataFrames, and as SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions import dims, hashes as bits
from curata.functions.seeded import unit
from curata.operators import metrics

CONDITIONS = [*metrics.GRID, *(f"stack{k}_rand" for k in range(1, 7))]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: two consecutive ids share a source file, so some files have two labels or splits."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    rows = d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    split = F.when(n % 10 < 8, "train").when(n % 10 == 8, "val").otherwise("test")
    long = F.floor(F.col("n_chars") / 4).cast("int")
    return rows.select("doc_id", F.concat(F.lit("doc/"), n).alias("path"), F.concat(F.lit("src/"), F.floor(n / 2)).alias("orig"), "label", F.when(F.col("label") == 1, F.col("lang")).otherwise("").alias("generator"), "source", long.alias("long"), split.alias("split"), F.sha2("text", 256).alias("sha256"), dims.bucket(long).alias("bucket"), "lang")


M = """m AS (
    SELECT d.doc_id, 'doc/' || d.doc_id AS path, 'src/' || (d.doc_id // 2) AS orig, l.quality AS label, CASE WHEN l.quality = 1 THEN d.lang ELSE '' END AS generator, d.source, (d.n_chars // 4)::INT AS long,
        CASE WHEN d.doc_id % 10 < 8 THEN 'train' WHEN d.doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split, sha256(d.text) AS sha256,
        CASE WHEN n_chars // 4 <= 0 THEN NULL WHEN n_chars // 4 <= 341 THEN '<=341' WHEN n_chars // 4 <= 512 THEN '342-512' WHEN n_chars // 4 <= 768 THEN '513-768' WHEN n_chars // 4 <= 1024 THEN '769-1024' ELSE '>1024' END AS bucket, d.lang
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores cube: each labelled document under each condition; the deeper in the list, the worse."""
    conds = F.array(*(F.struct(F.lit(c).alias("cond"), F.lit(i).alias("i")) for i, c in enumerate(CONDITIONS)))
    rows = manifest(spark, sf_dir).select("path", "label", "generator", "bucket", F.explode(conds).alias("c")).select("path", "label", "generator", "bucket", "c.cond", "c.i")
    u = unit("s", F.col("path"), F.col("cond"))
    raw = u * 0.7 + F.lit(0.3) * F.col("label") * (F.lit(1.0) - F.lit(0.05) * F.col("i"))
    return rows.withColumn("score", F.floor(raw * 1000) / 1000.0).drop("i")


SC = (
    M
    + """, k AS (SELECT * FROM (VALUES """
    + ", ".join(f"('{c}', {i})" for i, c in enumerate(CONDITIONS))
    + """) t(cond, i)), sc AS (
    SELECT path, label, generator, bucket, cond, floor((('0x' || substr(md5('s|' || path || '|' || cond), 1, 8))::BIGINT::DOUBLE / 4294967296::DOUBLE * 0.7::DOUBLE + 0.3::DOUBLE * label * (1::DOUBLE - 0.05::DOUBLE * i)) * 1000) / 1000::DOUBLE AS score
    FROM m, k)"""
)


def hashes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Training hashes of all documents, and probes of all of them with 0 to 6 bits flipped."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 15), 16, 10).cast("long").alias("h"))
    flips = F.expr("shiftleft(shiftleft(1L, cast(doc_id % 7 as int)) - 1, cast(doc_id % 50 as int))")
    return d.select(F.col("doc_id").alias("id"), F.col("h").bitwiseXOR(flips).alias("dhash")), d.select(F.col("doc_id").alias("id"), F.col("h").alias("dhash"))


H = """h AS (SELECT doc_id AS id, ('0x' || substr(md5(text), 1, 15))::BIGINT AS dhash FROM documents),
    pr AS (SELECT id, xor(dhash, ((1::BIGINT << (id % 7)::INT) - 1) << (id % 50)::INT) AS dhash FROM h)"""


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest with dhash, the SimHash of each document's text, and flat: no words."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), bits.simhash(F.col("text")).alias("dhash"))
    # the manifest's own sha256 is left out, as it would move the texts
    return manifest(spark, sf_dir).drop("sha256").join(texts, "doc_id").withColumn("flat", bits.trivial(F.col("dhash")))


AU = (
    M
    + r""", w AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[\x20\x09-\x0D]+')) AS w FROM documents) WHERE w <> ''),
    bits AS (SELECT doc_id, i, 2 * sum((x >> i::INT) & 1) > count(*) AS bit FROM (SELECT doc_id, ('0x' || substr(md5(w), 1, 15))::BIGINT AS x FROM w), (SELECT unnest(range(60)) AS i) GROUP BY doc_id, i),
    f AS (SELECT doc_id, sum(CASE WHEN bit THEN 1::BIGINT << i::INT ELSE 0 END)::BIGINT AS dhash FROM bits GROUP BY doc_id),
    au AS (SELECT m.*, coalesce(dhash, 0) AS dhash, coalesce(dhash, 0) = 0 AS flat FROM m LEFT JOIN f ON f.doc_id = m.doc_id),
    near AS (SELECT DISTINCT p.path FROM au p, au t WHERE p.split IN ('val', 'test') AND t.split = 'train' AND NOT p.flat AND NOT t.flat AND bit_count(xor(p.dhash, t.dhash)) <= 4),
    dup AS (SELECT sha256 FROM m WHERE sha256 IS NOT NULL GROUP BY sha256 HAVING count(*) > 1 AND (count(DISTINCT split) > 1 OR count(DISTINCT label) > 1))"""
)


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored boxes of their order's picture."""
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("img"), (n * 8).alias("x0"), (n * 4).alias("y0"), (n * 8 + 112 + (n % 3) * 14).alias("x1"), (n * 4 + 112 + (n % 3) * 14).alias("y1"), (F.col("l_partkey") % 100 / 100.0).alias("score"))


C = "c AS (SELECT l_orderkey AS img, l_linenumber * 8 AS x0, l_linenumber * 4 AS y0, l_linenumber * 8 + 112 + l_linenumber % 3 * 14 AS x1, l_linenumber * 4 + 112 + l_linenumber % 3 * 14 AS y1, (l_partkey % 100)::DOUBLE / 100::DOUBLE AS score FROM lineitem)"


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pictures with a width and a height."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 20).alias("w"), (F.col("p_size") * 13 + 9).alias("h"))


P = "p AS (SELECT p_partkey AS id, p_size * 20 AS w, p_size * 13 + 9 AS h FROM part)"


def large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a manifest: the large table of the benchmark."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    long = F.floor(F.col("l_extendedprice") / 50).cast("int")
    label = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    return rows.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("path"), label.alias("label"), F.when(label == 1, F.col("p_brand")).otherwise("").alias("generator"), F.concat(F.lit("supp"), F.col("l_suppkey")).alias("source"), long.alias("long"), dims.bucket(long).alias("bucket"), (F.col("l_discount") * 5 + F.col("l_tax")).alias("score"), "l_returnflag")


L = """g AS (
    SELECT l_orderkey || '-' || l_linenumber AS path, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, CASE WHEN l_returnflag = 'R' THEN p_brand ELSE '' END AS generator, 'supp' || l_suppkey AS source, floor(l_extendedprice / 50)::INT AS long, l_discount * 5 + l_tax AS score
    FROM lineitem JOIN part ON p_partkey = l_partkey),
    b AS (SELECT *, CASE WHEN long <= 0 THEN NULL WHEN long <= 341 THEN '<=341' WHEN long <= 512 THEN '342-512' WHEN long <= 768 THEN '513-768' WHEN long <= 1024 THEN '769-1024' ELSE '>1024' END AS bucket FROM g)"""
