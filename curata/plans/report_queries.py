"""Queries over the reports of this library, each with the SQL that says what it computes."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.operators import metrics, reports, votes
from curata.plans import adapters as a
from curata.plans.queries import BALANCE, Q99, query, rounded, sc


def auroc_sql(rows: str, by: str) -> str:
    """by and auroc of a table (by, label, score), as a subquery."""
    return f"""(SELECT {by}, sum(pos * (below + neg * 0.5::DOUBLE)) / nullif(max(p) * max(n), 0)::DOUBLE AS auroc FROM (
        SELECT {by}, pos, neg, coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos) OVER (PARTITION BY {by}) AS p, sum(neg) OVER (PARTITION BY {by}) AS n
        FROM (SELECT {by}, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM {rows} GROUP BY {by}, score)) GROUP BY {by})"""


def rates_sql(cutoff: str) -> str:
    return f"count(*) AS n, count(*) FILTER (label = 0) AS reals, count(*) FILTER (label = 1) AS fakes, avg((score >= {cutoff})::INT) FILTER (label = 1) AS caught, avg((score >= {cutoff})::INT) FILTER (label = 0) AS flagged"


def matrix_sql(cutoff: str) -> str:
    return f"count(*) FILTER (label = 1 AND score >= {cutoff}) AS tp, count(*) FILTER (label = 1 AND score < {cutoff}) AS fn, count(*) FILTER (label = 0 AND score >= {cutoff}) AS fp, count(*) FILTER (label = 0 AND score < {cutoff}) AS tn"


def six(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def sliced(column: str) -> str:
    """SQL of a confusion by slice, where slices of fewer than ten reals borrow all of them."""
    return sc(f""", g AS (SELECT {Q99} AS cut FROM sc), k0 AS (SELECT {column} AS name, count(*) FILTER (label = 0) < 10 AS borrowed FROM sc WHERE {column} IS NOT NULL GROUP BY 1 HAVING count(*) >= 20),
        u AS (SELECT k0.name, borrowed, label, score FROM sc JOIN k0 ON k0.name = {column} AND (label = 1 OR NOT borrowed) UNION ALL SELECT k0.name, borrowed, label, score FROM k0 JOIN sc ON borrowed AND label = 0),
        x AS (SELECT name, bool_or(borrowed) AS borrowed, count(*) AS n, {matrix_sql('(SELECT cut FROM g)')}, {Q99} AS own_cutoff FROM u GROUP BY name)
        SELECT x.name, n, borrowed, round(auroc, 6) AS auroc, tp, fn, fp, tn, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round(fp::DOUBLE / nullif(fp + tn, 0), 6) AS fpr, round(own_cutoff, 6) AS own_cutoff FROM x JOIN {auroc_sql('u', 'name')} r ON r.name = x.name""")


@query("confusion_slices_bucket", sliced("bucket"))
def confusion_slices_bucket(spark, d):
    return rounded(reports.confusion_slices(a.scores(spark, d), "bucket"), "auroc", "recall", "fpr", "own_cutoff")


@query("confusion_slices_generator", sliced("nullif(generator, '')"))
def confusion_slices_generator(spark, d):
    s = a.scores(spark, d).withColumn("generator", F.nullif("generator", F.lit("")))
    return rounded(reports.confusion_slices(s, "generator"), "auroc", "recall", "fpr", "own_cutoff")


@query("deployment_slices", sc(f""", s AS (SELECT 'clean' AS slice, label, score FROM sc WHERE cond = 'clean' UNION ALL SELECT 'augmented', label, score FROM sc WHERE cond <> 'clean' UNION ALL SELECT 'mix', label, score FROM sc WHERE cond = 'clean'
    UNION ALL SELECT 'mix', label, score FROM (SELECT * FROM sc WHERE cond <> 'clean' ORDER BY md5('9|' || path || '|' || cond), path || '|' || cond LIMIT (SELECT count(*) FROM sc WHERE cond = 'clean'))),
    c AS (SELECT slice, {Q99} AS cutoff FROM s GROUP BY slice), x AS (SELECT s.slice, any_value(cutoff) AS cutoff, {matrix_sql('cutoff')} FROM s JOIN c ON c.slice = s.slice GROUP BY s.slice)
    SELECT x.slice, round(cutoff, 6) AS cutoff, round(auroc, 6) AS auroc, tp, fn, fp, tn, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round(fp::DOUBLE / nullif(fp + tn, 0), 6) AS fpr FROM x JOIN {auroc_sql('s', 'slice')} r ON r.slice = x.slice"""))
def deployment_slices(spark, d):
    return rounded(reports.deployment_slices(a.scores(spark, d), 9), "cutoff", "auroc", "recall", "fpr")


FAMILY = "CASE " + " ".join(f"WHEN cond = '{c}' THEN '{f}'" for c, f in metrics.families()) + " ELSE cond END"


@query("robustness_table", sc(f""", g AS (SELECT {Q99} AS cut FROM sc WHERE cond = 'clean'), x AS (SELECT cond, {rates_sql('(SELECT cut FROM g)')} FROM sc GROUP BY cond), y AS (SELECT x.*, auroc FROM x JOIN {auroc_sql('sc', 'cond')} r ON r.cond = x.cond),
    z AS (SELECT {FAMILY} AS family, * FROM y UNION ALL SELECT 'all transformed', * FROM y WHERE cond <> 'clean')
    SELECT family, count(*) AS conds, round(avg(auroc), 6) AS mean_auroc, round(min(auroc), 6) AS worst_auroc, round(avg(caught), 6) AS mean_caught, round(min(caught), 6) AS worst_caught, round(avg(flagged), 6) AS mean_flagged, round(max(flagged), 6) AS worst_flagged FROM z GROUP BY family"""))
def robustness_table(spark, d):
    return rounded(reports.families(a.scores(spark, d)), "mean_auroc", "worst_auroc", "mean_caught", "worst_caught", "mean_flagged", "worst_flagged")


@query("pooled_auroc", sc(f""", s AS (SELECT 'pool ' || bucket AS "group", label, score FROM sc WHERE bucket IS NOT NULL UNION ALL SELECT 'POOLED', label, score FROM sc WHERE bucket IS NOT NULL), x AS (SELECT "group", {rates_sql('0.5')} FROM s GROUP BY 1)
    SELECT x."group", n, round(n::DOUBLE / (SELECT count(*) FROM sc WHERE bucket IS NOT NULL), 6) AS weight, fakes, reals, {six('auroc', 'caught', 'flagged')} FROM x JOIN {auroc_sql('s', '"group"')} r ON r."group" = x."group" """))
def pooled_auroc(spark, d):
    s = a.scores(spark, d).where("bucket IS NOT NULL").withColumn("pool", F.concat(F.lit("pool "), "bucket"))
    return rounded(reports.pooled(s, "pool", 0.5), "weight", "auroc", "caught", "flagged")


MODELS = "mo AS (SELECT 'plain' AS model, * FROM sc UNION ALL SELECT 'squared' AS model, * REPLACE (score * score AS score) FROM sc)"


def models(s):
    return s.withColumn("model", F.lit("plain")).unionByName(s.withColumn("model", F.lit("squared")).withColumn("score", F.col("score") * F.col("score")))


@query("model_card", sc(f""", {MODELS}, ex AS (SELECT * FROM mo WHERE cond = 'crop_80'), cu AS (SELECT model, 'rule' AS policy, {Q99} AS cutoff FROM ex GROUP BY model UNION ALL SELECT DISTINCT model, 'fixed', 0.15::DOUBLE FROM ex),
    o AS (SELECT ex.model, policy, any_value(cutoff) AS cutoff, {rates_sql('cutoff')} FROM ex JOIN cu ON cu.model = ex.model GROUP BY 1, 2), i AS (SELECT mo.model, policy, cond, {rates_sql('cutoff')} FROM mo JOIN cu ON cu.model = mo.model WHERE cond <> 'crop_80' GROUP BY 1, 2, 3),
    t AS (SELECT model, policy, max(caught) FILTER (cond = 'clean') AS clean_caught, max(flagged) FILTER (cond = 'clean') AS clean_flagged, avg(caught) FILTER (cond <> 'clean') AS mean_caught, avg(flagged) FILTER (cond <> 'clean') AS mean_flagged, max(flagged) FILTER (cond <> 'clean') AS worst_flagged FROM i GROUP BY 1, 2)
    SELECT o.model, o.policy, round(cutoff, 6) AS cutoff, round(o.caught, 6) AS external_caught, round(o.flagged, 6) AS external_flagged, {six('auroc', 'clean_caught', 'clean_flagged', 'mean_caught', 'mean_flagged', 'worst_flagged')}
    FROM o JOIN t ON t.model = o.model AND t.policy = o.policy JOIN {auroc_sql('ex', 'model')} r ON r.model = o.model"""))
def model_card(spark, d):
    s = models(a.scores(spark, d))
    card = reports.model_card(s.where("cond != 'crop_80'"), s.where("cond = 'crop_80'"))
    return rounded(card, "cutoff", "external_caught", "external_flagged", "auroc", "clean_caught", "clean_flagged", "mean_caught", "mean_flagged", "worst_flagged")


@query("generator_report", sc(f""", u AS (SELECT cond || '|' || g.generator AS k, label, score FROM (SELECT DISTINCT generator FROM sc WHERE label = 1 AND generator <> '') g JOIN sc ON sc.label = 0 OR sc.generator = g.generator),
    r AS (SELECT split_part(k, '|', 1) AS cond, split_part(k, '|', 2) AS generator, auroc FROM {auroc_sql('u', 'k')}), c AS (SELECT cond, generator, count(*) AS fakes, avg((score >= 0.5)::INT) AS caught FROM sc WHERE label = 1 AND generator <> '' GROUP BY 1, 2)
    SELECT generator, max(fakes) AS fakes, """ + ", ".join(f"round(max({c}) FILTER (cond = 'clean'), 6) AS clean_{c}, round(avg({c}) FILTER (cond <> 'clean'), 6) AS mean_{c}, round(min({c}) FILTER (cond <> 'clean'), 6) AS worst_{c}" for c in ("auroc", "caught")) + " FROM r JOIN c USING (cond, generator) GROUP BY generator"))
def generator_report(spark, d):
    return rounded(reports.generators(a.scores(spark, d), 0.5), *(f"{k}_{c}" for c in ("auroc", "caught") for k in ("clean", "mean", "worst")))


@query("bucket_spread", sc(f""", s AS (SELECT * FROM sc WHERE bucket IS NOT NULL), t AS (SELECT r.bucket, auroc, cutoff FROM {auroc_sql('s', 'bucket')} r JOIN (SELECT bucket, {Q99} AS cutoff FROM s GROUP BY 1) q ON q.bucket = r.bucket WHERE auroc IS NOT NULL)
    SELECT (SELECT bucket FROM t ORDER BY auroc DESC, bucket DESC LIMIT 1) AS best, (SELECT bucket FROM t ORDER BY auroc, bucket LIMIT 1) AS worst, round(max(auroc) - min(auroc), 6) AS spread, round(min(cutoff), 6) AS low_cutoff, round(max(cutoff), 6) AS high_cutoff, round(max(cutoff) - min(cutoff), 6) AS cutoff_span FROM t"""))
def bucket_spread(spark, d):
    return rounded(reports.bucket_spread(a.scores(spark, d)), "spread", "low_cutoff", "high_cutoff", "cutoff_span")


@query("size_matched_auroc", sc(f""", {BALANCE.replace('FROM m)', "FROM sc WHERE cond = 'clean' AND bucket IS NOT NULL)")}, z AS (SELECT bucket, label, score FROM b WHERE k <= n), g AS (SELECT {Q99} AS cut FROM z), v AS (SELECT * FROM z UNION ALL SELECT 'pooled', label, score FROM z),
    w AS (SELECT bucket, label, score FROM sc WHERE cond = 'clean' AND bucket IS NOT NULL UNION ALL SELECT 'pooled', label, score FROM sc WHERE cond = 'clean'), x AS (SELECT bucket, {rates_sql('(SELECT cut FROM g)')} FROM v GROUP BY bucket)
    SELECT x.bucket, n, round(r.auroc, 6) AS auroc, round(caught, 6) AS caught, round(o.auroc, 6) AS unmatched FROM x JOIN {auroc_sql('v', 'bucket')} r ON r.bucket = x.bucket JOIN {auroc_sql('w', 'bucket')} o ON o.bucket = x.bucket"""))
def size_matched_auroc(spark, d):
    return rounded(reports.size_matched(a.scores(spark, d).where("cond = 'clean'"), 100), "auroc", "caught", "unmatched")


@query("external_eval", sc(f""", c AS (SELECT path, label, score, CASE WHEN label = 1 THEN generator || '_' || coalesce(bucket, 'none') ELSE '' END AS generator FROM sc WHERE cond = 'clean'), g AS (SELECT {Q99} AS cut FROM c), tr AS (SELECT DISTINCT generator || '_' || coalesce(bucket, 'none') AS generator FROM m WHERE split = 'val' AND label = 1),
    u AS (SELECT g0.generator, label, score FROM (SELECT DISTINCT generator FROM c WHERE label = 1 AND generator <> '') g0 JOIN c ON c.label = 0 OR c.generator = g0.generator),
    e AS (SELECT CASE WHEN k.generator IN (SELECT generator FROM tr) THEN 'TRAINED' ELSE 'unseen' END AS kind, k.generator AS name, n, auroc, caught FROM (SELECT generator, count(*) AS n, avg((score >= (SELECT cut FROM g))::INT) AS caught FROM c WHERE label = 1 AND generator <> '' GROUP BY 1) k JOIN {auroc_sql('u', 'generator')} r ON r.generator = k.generator),
    f AS (SELECT * FROM e UNION ALL SELECT kind, 'mean', count(*), avg(auroc), avg(caught) FROM e GROUP BY kind UNION ALL SELECT 'all', 'POOLED', (SELECT count(*) FROM c WHERE label = 1), auroc, (SELECT avg((score >= (SELECT cut FROM g))::INT) FROM c WHERE label = 1) FROM {auroc_sql("(SELECT *, 1 AS one FROM c)", 'one')})
    SELECT kind, name, n, {six('auroc', 'caught')} FROM f"""))
def external_eval(spark, d):
    """Generators told apart by bucket; the small split plays the training that saw some of them."""
    fine = F.when(F.col("label") == 1, F.concat_ws("_", "generator", F.coalesce("bucket", F.lit("none")))).otherwise("")
    trained = a.manifest(spark, d).where("split = 'val'").withColumn("generator", fine)
    return rounded(reports.external(a.scores(spark, d).where("cond = 'clean'").withColumn("generator", fine), trained), "auroc", "caught")


@query("error_sheet", sc(""", e AS ((SELECT 'false_positive' AS kind, path, score FROM sc WHERE cond = 'clean' AND label = 0 AND score >= 0.5 ORDER BY score DESC, path LIMIT 20) UNION ALL (SELECT 'false_negative', path, score FROM sc WHERE cond = 'clean' AND label = 1 AND score < 0.5 ORDER BY score, path LIMIT 20))
    SELECT kind, e.path, coalesce(orig, '') AS orig, round(score, 4) AS pred FROM e LEFT JOIN m ON m.path = e.path"""))
def error_sheet(spark, d):
    return reports.worst(a.scores(spark, d).where("cond = 'clean'"), a.manifest(spark, d), 0.5)


@query("condition_order", sc(f" SELECT cond, row_number() OVER (ORDER BY cond <> 'clean', cond NOT IN ({', '.join(repr(c) for c in metrics.GRID)}), cond) AS place, n FROM (SELECT cond, count(*) AS n FROM sc GROUP BY cond)"))
def condition_order(spark, d):
    from pyspark.sql import Window

    rows = a.scores(spark, d).groupBy("cond").agg(F.count("*").alias("n"))  # a few rows
    return rows.select("cond", F.row_number().over(Window.orderBy(*metrics.condition_order(F.col("cond")))).cast("long").alias("place"), "n")


RULES = ["mean", "size_mean", "area", "median", "top3", "trim10"]


@query("crop_rule_auroc", f"""WITH {a.C}, lab AS (SELECT o_orderkey AS img, (o_orderstatus = 'F')::INT AS label FROM orders),
    q AS (SELECT img, score AS s, x1 - x0 AS side, ((x1 - x0) * (y1 - y0))::DOUBLE AS area, row_number() OVER (PARTITION BY img ORDER BY score DESC) AS up, row_number() OVER (PARTITION BY img ORDER BY score) AS lo, count(*) OVER (PARTITION BY img) AS c FROM c),
    z AS (SELECT img, avg(m) AS size_mean FROM (SELECT img, side, avg(s) AS m FROM q GROUP BY 1, 2) GROUP BY img),
    r AS (SELECT q.img, avg(s) AS mean, any_value(size_mean) AS size_mean, sum(s * area) / sum(area) AS area, median(s) AS median, avg(s) FILTER (up <= 3) AS top3, avg(s) FILTER (lo > c // 10 AND lo <= c - c // 10) AS trim10 FROM q JOIN z ON z.img = q.img GROUP BY q.img),
    v AS (SELECT rule, label, round(score, 9) AS score FROM (UNPIVOT (SELECT label, mean, size_mean, area, median, top3, trim10 FROM r JOIN lab ON lab.img = r.img) ON mean, size_mean, area, median, top3, trim10 INTO NAME rule VALUE score))
    SELECT rule, round(auroc, 6) AS auroc FROM {auroc_sql('v', 'rule')}""")
def crop_rule_auroc(spark, d):
    rows = votes.rules(a.crops(spark, d), ["img"])
    labels = a.table(spark, d, "orders").select(F.col("o_orderkey").alias("img"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    exact = rows.withColumns({c: F.round(c, 9) for c in RULES})
    return rounded(reports.rules_auroc(exact.join(labels, "img"), RULES), "auroc")


TOLD = """told AS (SELECT path, split, generator, CASE doc_id % 6 WHEN 0 THEN 'wildfake' WHEN 1 THEN 'wildfake' WHEN 2 THEN 'artifact' WHEN 3 THEN 'omnifake_real' WHEN 4 THEN 'coco_640' ELSE source END AS source, label,
    CASE doc_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 0 WHEN 4 THEN 0 END AS truth,
    CASE doc_id % 6 WHEN 0 THEN 'wildfake:Real folder' WHEN 1 THEN 'wildfake:generator folder' WHEN 2 THEN 'artifact:no metadata match' WHEN 3 THEN 'omnifake:val/real' WHEN 4 THEN 'ext:coco_640' ELSE 'unknown source ' || source END AS rule FROM m)"""


@query("provenance_detail", f"""WITH {a.M}, {TOLD}, s AS (SELECT path, 'rule' AS section, rule AS key FROM told UNION ALL SELECT path, 'disagrees', split || '|' || source || '|' || generator FROM told WHERE truth <> label UNION ALL SELECT path, 'unresolved', split || '|' || source FROM told WHERE truth IS NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY section, key ORDER BY md5('0|' || path), path) AS rn FROM s) SELECT section, key, count(*) AS n, string_agg(path, ' ' ORDER BY rn) FILTER (rn <= 5) AS examples FROM k GROUP BY 1, 2""")
def provenance_detail(spark, d):
    from curata.operators import audit

    n = F.col("doc_id") % 6
    place = F.when(n == 0, "/data/wildfake/Images/Real/").when(n == 1, "/data/wildfake/gan_based/").when(n == 2, "/data/artifact/").when(n == 3, "/data/omnival/val/real/").when(n == 4, "/data/ext/img/coco_640/").otherwise("/data/")
    source = F.when(n < 2, "wildfake").when(n == 2, "artifact").when(n == 3, "omnifake_real").when(n == 4, "coco_640").otherwise(F.col("source"))
    rows = a.manifest(spark, d).withColumn("source", source).withColumn("orig", F.concat(place, "path"))
    targets = rows.where("false").select(F.col("orig").alias("image_path"), F.lit("0").alias("target"))
    return reports.provenance_detail(audit.provenance(rows, targets))


