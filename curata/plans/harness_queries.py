"""Queries of whole evaluations and builds, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.functions.hashes import simhash
from curata.operators import dedup, harness, metrics
from curata.plans import adapters as a
from curata.plans.queries import AUROC, CURVE, DISTINCT, m, query, sc, seeded
from curata.plans.structure_queries import SIMHASH


def _rounded(df):
    return df.withColumn("value", F.round("value", 6))


def _unfold(section: str, name: str, values: dict[str, str], of: str) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, {name} AS name, '{k}' AS metric, round(({v})::DOUBLE, 6) AS value FROM {of}" for k, v in values.items())


AGAINST = """pr AS (SELECT f.cond, f.generator, avg(CASE WHEN f.score > r.score THEN 1.0::DOUBLE WHEN f.score = r.score THEN 0.5::DOUBLE ELSE 0::DOUBLE END) AS auroc FROM sc f JOIN sc r ON r.cond = f.cond AND r.label = 0 WHERE f.label = 1 AND f.generator <> '' GROUP BY f.cond, f.generator)"""


@query("harness", sc(f"""{CURVE}, th AS (SELECT threshold AS t FROM ro WHERE cond = 'clean' AND tpr IS NOT NULL AND fpr IS NOT NULL ORDER BY tpr - fpr DESC, threshold DESC LIMIT 1),
    c AS (SELECT cond, any_value(ar.auroc) AS auroc, avg((score >= t)::INT) FILTER (label = 1) AS tpr, avg((score >= t)::INT) FILTER (label = 0) AS fpr, avg(((score >= t) = (label = 1))::INT) AS acc FROM sc JOIN ar USING (cond), th GROUP BY cond),
    s AS (SELECT (SELECT t FROM th) AS threshold, {', '.join(f"max({x}) FILTER (cond = 'clean') AS clean_{x}, avg({x}) FILTER (cond <> 'clean') AS mean_{x}" for x in ('auroc', 'tpr', 'fpr'))}, min(auroc) FILTER (cond <> 'clean') AS worst_auroc, min(tpr) FILTER (cond <> 'clean') AS worst_tpr, max(fpr) FILTER (cond <> 'clean') AS worst_fpr FROM c),
    {AGAINST}, ca AS (SELECT cond, generator, avg((score >= t)::INT) AS catch FROM sc, th WHERE label = 1 AND generator <> '' GROUP BY cond, generator),
    g AS (SELECT generator, {', '.join(f"max({x}) FILTER (cond = 'clean') AS clean_{x}, avg({x}) FILTER (cond <> 'clean') AS mean_{x}, min({x}) FILTER (cond <> 'clean') AS worst_{x}" for x in ('auroc', 'catch'))} FROM pr JOIN ca USING (cond, generator) GROUP BY generator)
    {_unfold('condition', 'cond', {x: x for x in ('auroc', 'tpr', 'fpr', 'acc')}, 'c')} UNION ALL {_unfold('summary', "'all'", {x: x for x in ('threshold', *(f'{k}_{x}' for k in ('clean', 'mean', 'worst') for x in ('auroc', 'tpr', 'fpr')))}, 's')}
    UNION ALL SELECT 'summary', cond, 'worst_condition', round(auroc, 6) FROM (SELECT * FROM c WHERE cond <> 'clean' AND auroc IS NOT NULL ORDER BY auroc, cond LIMIT 1)
    UNION ALL {_unfold('generator', 'generator', {f'{k}_{x}': f'{k}_{x}' for k in ('clean', 'mean', 'worst') for x in ('auroc', 'catch')}, 'g')}
    UNION ALL SELECT 'false_positive', path, 'score', round(score, 6) FROM (SELECT path, score FROM sc, th WHERE cond = 'clean' AND label = 0 AND score >= t ORDER BY score DESC, path LIMIT 20)
    UNION ALL SELECT 'false_negative', path, 'score', round(score, 6) FROM (SELECT path, score FROM sc, th WHERE cond = 'clean' AND label = 1 AND score < t ORDER BY score, path LIMIT 20)"""))
def evaluation_harness(spark, d):
    return _rounded(harness.evaluate(a.scores(spark, d)))


#: A set is a source under a condition: reals are those of label 0.
SETS = "e AS (SELECT CASE WHEN label = 0 THEN 'real_' || split_part(cond, '_', 1) ELSE 'fake_' || generator || '_' || split_part(cond, '_', 1) END AS \"set\", label, score, coalesce(bucket, 'none') AS size FROM sc)"


def _quantile(fa: float) -> str:
    place = f"((SELECT count(*) FROM r) - 1) * {1 - fa!r}::DOUBLE"
    at = lambda p: f"(SELECT score FROM r WHERE k = {p})"
    return f"({at(f'floor({place})')} * (1 - ({place} - floor({place}))) + {at(f'ceil({place})')} * ({place} - floor({place})))"


@query("generator_sets", sc(f""", {SETS}, r AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS k FROM e WHERE label = 0), q AS (SELECT {_quantile(0.01)} AS c1, {_quantile(0.05)} AS c5),
    st AS (SELECT "set", count(*) AS n, median(score) AS median, avg(score) AS mean, avg((score >= 0.5)::INT) AS over FROM e GROUP BY "set"),
    rc AS (SELECT score, count(*) AS k FROM e WHERE label = 0 GROUP BY score), fc AS (SELECT "set", score, count(*) AS k FROM e WHERE label = 1 GROUP BY "set", score),
    au AS (SELECT "set", sum(fc.k * rc.k * CASE WHEN fc.score > rc.score THEN 1.0::DOUBLE WHEN fc.score = rc.score THEN 0.5::DOUBLE ELSE 0::DOUBLE END) / sum(fc.k * rc.k) AS auroc, sum(fc.k) AS k FROM fc, rc GROUP BY "set"),
    pw AS (SELECT sum(fc.k * rc.k * CASE WHEN fc.score > rc.score THEN 1.0::DOUBLE WHEN fc.score = rc.score THEN 0.5::DOUBLE ELSE 0::DOUBLE END) / sum(fc.k * rc.k) AS auroc FROM fc, rc),
    p AS (SELECT avg((score >= 0.5)::INT) FILTER (label = 1) AS catch, avg((score >= 0.5)::INT) FILTER (label = 0) AS false_alarms FROM e),
    h AS (SELECT "set", avg((score >= c1)::INT) AS h1, avg((score >= c5)::INT) AS h5 FROM e, q WHERE label = 1 GROUP BY "set")
    {_unfold('set', '"set"', {x: x for x in ('n', 'median', 'mean', 'over')}, 'st')} UNION ALL {_unfold('set', '"set"', {'auroc': 'auroc'}, 'au')}
    UNION ALL SELECT 'size', "set", size, n FROM (SELECT "set", size, count(*) AS n, row_number() OVER (PARTITION BY "set" ORDER BY count(*) DESC, size) AS k FROM e GROUP BY "set", size) WHERE k = 1
    UNION ALL {_unfold('pooled', "'all'", {'auroc': 'auroc'}, 'pw')} UNION ALL {_unfold('pooled', "'all'", {x: x for x in ('catch', 'false_alarms')}, 'p')}
    UNION ALL SELECT 'pooled', 'all', 'cutoff_0.01', round(c1, 6) FROM q UNION ALL SELECT 'pooled', 'all', 'cutoff_0.05', round(c5, 6) FROM q
    UNION ALL SELECT 'pooled', 'all', 'catch_0.01', round(avg((score >= c1)::INT), 6) FROM e, q WHERE label = 1 UNION ALL SELECT 'pooled', 'all', 'catch_0.05', round(avg((score >= c5)::INT), 6) FROM e, q WHERE label = 1
    UNION ALL SELECT * FROM (SELECT 'pooled', "set", 'worst_0.01', round(h1, 6) FROM h ORDER BY h1, "set" LIMIT 1) UNION ALL SELECT * FROM (SELECT 'pooled', "set", 'worst_0.05', round(h5, 6) FROM h ORDER BY h5, "set" LIMIT 1)"""))
def generator_sets(spark, d):
    kind = F.split_part("cond", F.lit("_"), F.lit(1))
    name = F.when(F.col("label") == 0, F.concat(F.lit("real_"), kind)).otherwise(F.concat(F.lit("fake_"), "generator", F.lit("_"), kind))
    rows = a.scores(spark, d).select(name.alias("set"), "label", "score", F.coalesce("bucket", F.lit("none")).alias("size"))
    return _rounded(harness.generator_sets(rows))


#: Pages as a disk of files, documents of a source as a list of labelled paths: some name no file, some name two.
LISTED = """dk AS (SELECT 'disk/p' || (page_id % 13) || '/f' || page_id || '.jpg' AS path, page_id FROM pages UNION ALL SELECT 'disk/copy/p' || (page_id % 13) || '/f' || page_id || '.jpg', page_id FROM pages WHERE page_id % 10 = 0),
    li AS (SELECT 'list' || (page_id % 4) AS list, CASE WHEN page_id % 11 = 3 THEN 'zip/Val2017/' ELSE 'zip/' END || 'p' || (page_id % 13) || '/f' || page_id || '.jpg' AS image_path, page_id, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS is_fake FROM pages UNION ALL SELECT 'list0', 'gone/' || page_id || '.png', page_id, 1 FROM pages WHERE page_id % 7 = 0),
    ok AS (SELECT 'disk/p' || (page_id % 13) || '/f' || page_id || '.jpg' AS path, is_fake AS label, CASE WHEN is_fake = 1 THEN list ELSE '' END AS generator FROM li WHERE image_path LIKE 'zip/%' AND page_id % 10 <> 0 AND list <> 'list3' AND NOT (list = 'list1' AND image_path LIKE '%Val2017%')),"""


@query("labelled_manifest", f"""WITH {LISTED} kp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, generator ORDER BY {seeded(3)}) AS k FROM ok) WHERE k <= 300),
    rs AS (SELECT *, row_number() OVER (ORDER BY {seeded('3|split')}) AS r, count(*) OVER () AS n FROM kp WHERE generator <> 'list2')
    SELECT path, label, generator, 'wild' AS source, CASE WHEN r <= n // 10 THEN 'test' WHEN r <= n // 10 + n // 10 THEN 'val' ELSE 'train' END AS split FROM rs UNION ALL SELECT path, label, generator, 'wild', 'test' FROM kp WHERE generator = 'list2'""")
def labelled_manifest(spark, d):
    n = F.col("page_id")
    pages = a.table(spark, d, "pages").select("page_id")
    tail = F.concat(F.lit("p"), n % 13, F.lit("/f"), n, F.lit(".jpg"))
    disk = pages.select(F.concat(F.lit("disk/"), tail).alias("path")).unionByName(pages.where(n % 10 == 0).select(F.concat(F.lit("disk/copy/"), tail).alias("path")))
    listed = pages.select(F.concat(F.lit("list"), n % 4).alias("list"), F.concat(F.when(n % 11 == 3, "zip/Val2017/").otherwise("zip/"), tail).alias("image_path"), F.when(n % 2 == 0, "1").otherwise("0").alias("is_fake"))
    gone = pages.where(n % 7 == 0).select(F.lit("list0").alias("list"), F.concat(F.lit("gone/"), n, F.lit(".png")).alias("image_path"), F.lit("1").alias("is_fake"))
    return harness.labelled_manifest(listed.unionByName(gone), disk, "wild", 3, 300, held={"list2"}, forbidden={"list3"}, official={"list1": "val2017/"})


@query("data_state", m("""SELECT 'label' AS section, split, label::VARCHAR AS key, count(*) AS n FROM m GROUP BY split, label UNION ALL SELECT 'bucket', split, coalesce(bucket, 'none'), count(*) FROM m GROUP BY ALL
    UNION ALL SELECT 'top_generator', split, generator, n FROM (SELECT split, generator, count(*) AS n, row_number() OVER (PARTITION BY split ORDER BY count(*) DESC, generator) AS k FROM m WHERE label = 1 GROUP BY split, generator) WHERE k <= 10
    UNION ALL SELECT 'top_source', split, source, n FROM (SELECT split, source, count(*) AS n, row_number() OVER (PARTITION BY split ORDER BY count(*) DESC, source) AS k FROM m GROUP BY split, source) WHERE k <= 10
    UNION ALL SELECT 'only_test', 'test', generator, count(*) FROM m WHERE split = 'test' AND label = 1 AND generator NOT IN (SELECT generator FROM m WHERE split = 'train' AND label = 1) GROUP BY generator"""))
def data_state(spark, d):
    return harness.data_state(a.manifest(spark, d))


@query("near_by_prefix_32", f"WITH {SIMHASH} SELECT DISTINCT p.id FROM s p, s t WHERE p.id % 2 = 0 AND t.id % 2 = 1 AND bit_count(xor(p.dhash, t.dhash)) <= 2 AND (p.dhash >> 32 = t.dhash >> 32 OR xor(p.dhash >> 32, 1) = t.dhash >> 32)")
def near_by_prefix_32(spark, d):
    """Rows of one half of the documents (a new set) with a near row in the other (the known set)."""
    docs = a.table(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), simhash(F.col("text")).alias("dhash"))
    new, known = rows.where("id % 2 = 0"), rows.where("id % 2 = 1")
    hit = dedup.near_by_prefix(new.select(F.col("dhash").alias("id"), "dhash").distinct(), known.select("dhash").distinct(), shift=32)
    return new.join(hit.withColumnRenamed("id", "dhash"), "dhash").select("id").distinct()


TWO_SETS = a.SC.replace("sc AS (", "one AS (") + ", " + a.L + ", sc AS (SELECT cond, label, score FROM one WHERE cond <> 'clean' UNION ALL SELECT 'large ' || coalesce(bucket, 'none'), label, score FROM b)"


@query("general_score", f"WITH {TWO_SETS}, {DISTINCT}, {AUROC} SELECT round((avg(auroc) FILTER (cond NOT LIKE 'large %') + avg(auroc) FILTER (cond LIKE 'large %')) / 2, 6) AS general FROM ar")
def general_score(spark, d):
    """The mean of two sets' mean AUROC over their slices: the documents' conditions but clean, and the large table's buckets."""
    one = metrics.auroc(a.scores(spark, d), ["cond"]).where("cond != 'clean'").agg(F.avg("auroc").alias("x"))
    two = metrics.auroc(a.large(spark, d), ["bucket"]).agg(F.avg("auroc").alias("y"))
    return one.join(two).select(F.round((F.col("x") + F.col("y")) / 2, 6).alias("general"))
