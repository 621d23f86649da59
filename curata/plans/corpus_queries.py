"""Queries over variants of corpora, contracts, gates and labels, each with the SQL that says what it computes."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.functions import dims, geometry, seeded as draws
from curata.operators import corpora
from curata.plans import adapters as a
from curata.plans.queries import ORACLE_SQL, PROVENANCE_ORIG, SUBJECT, m, query, sc, seeded

TERMS = corpora.Contract(holdout_generators=frozenset({"de"}), partial_edit_generators=frozenset({"es"}), min_bucket=5)


@query("contract_checks", m("""SELECT "check", bad, CASE WHEN bad > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM (
    SELECT 'held-out generators' AS "check", count(*) AS bad FROM m WHERE split <> 'test' AND generator = 'de' UNION ALL SELECT 'partial edits', count(*) FROM m WHERE split <> 'test' AND generator = 'es'
    UNION ALL SELECT 'forbidden slices', count(*) FROM m WHERE split <> 'test' AND doc_id % 7 = 0
    UNION ALL SELECT 'class balance', count(*) FROM (SELECT split FROM m WHERE split <> 'test' GROUP BY split HAVING count(*) FILTER (label = 0) <> count(*) FILTER (label = 1))
    UNION ALL SELECT 'bucket balance', count(*) FROM (SELECT count(*) FILTER (label = 0) AS r, count(*) FILTER (label = 1) AS f FROM m WHERE split <> 'test' AND bucket IS NOT NULL GROUP BY split, bucket) WHERE r + f >= 5 AND (r = 0 OR f = 0 OR r::DOUBLE / f NOT BETWEEN 0.8 AND 1.25)
    UNION ALL SELECT 'one split a file', count(*) FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN 'x/Val2017/' || orig ELSE orig END AS o FROM m GROUP BY 1 HAVING count(DISTINCT split) > 1))"""))
def contract_checks(spark, d):
    rows = a.manifest(spark, d)
    slices = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("x/Val2017/"), "orig")).otherwise(F.col("orig"))
    return corpora.contract(rows.withColumn("orig", slices), TERMS)


def worst_sql(name: str, verdicts: str, caution: str = "WARN") -> str:
    return f"SELECT '{name}' AS gate, CASE WHEN count(*) FILTER (verdict = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (verdict IN ('WARN', 'CAVEAT', 'CHECK')) > 0 THEN '{caution}' WHEN count(*) FILTER (verdict IN ('OK', 'PASS')) > 0 THEN 'PASS' ELSE 'SKIP' END AS verdict FROM ({verdicts})"


@query("gate_orchestrator", " UNION ALL ".join((
    worst_sql("label provenance", ORACLE_SQL["provenance_rules"].replace("SELECT rule, CASE", "SELECT rule, CASE", 1)).replace("FROM (WITH", "FROM (SELECT CASE WHEN state = 'disagrees' THEN 'FAIL' ELSE 'PASS' END AS verdict FROM (WITH") + ")",
    worst_sql("bucket balance", ORACLE_SQL["bucket_balance"].replace("reals + fakes < 20", "reals + fakes < 200")),
    worst_sql("native size", ORACLE_SQL["native_size_gate"].replace("ELSE 'FAIL'", "ELSE 'CAVEAT'"), "CAVEAT"),
    worst_sql("content in buckets", ORACLE_SQL["bucket_content_gate"].replace("n < 50", "n < 500").replace(">= 5 AND", ">= 200 AND")),
)))
def gate_orchestrator(spark, d):
    rows = a.manifest(spark, d).withColumn("orig", F.expr(PROVENANCE_ORIG.replace("\\", "\\\\"))).withColumn("subject", F.expr(SUBJECT))
    n = F.col("doc_id")
    targets = rows.where("doc_id % 12 = 2").select(F.col("orig").alias("image_path"), F.when(n % 5 == 0, "0").otherwise("7").alias("target"))
    return corpora.gates(rows, targets, eval_set=True)


BAD = {"de"}
EVEN = "least(count(*) FILTER (label = 0) OVER (PARTITION BY bucket), count(*) FILTER (label = 1) OVER (PARTITION BY bucket))"


def even_sql(name: str, rows: str, seed: str) -> str:
    return f"SELECT *, CASE WHEN row_number() OVER (PARTITION BY bucket, label ORDER BY {seeded(seed)}) <= {EVEN} THEN '{name}' ELSE 'test' END AS part FROM {rows}"


@query("canon_repair", m(f""", s AS (SELECT * FROM m WHERE NOT (label = 1 AND source = 'src1' AND generator = 'de')), tr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY orig ORDER BY path) AS k FROM s WHERE split = 'train') WHERE k = 1),
    va AS (SELECT * FROM s WHERE split = 'val' AND orig NOT IN (SELECT orig FROM tr)), p AS (SELECT path, orig, label, bucket, part FROM ({even_sql('train', 'tr', '5train')}) UNION ALL SELECT path, orig, label, bucket, part FROM ({even_sql('val', 'va', '5val')})),
    te AS (SELECT path, orig, label, bucket FROM s WHERE split = 'test' UNION ALL SELECT path, orig, label, bucket FROM s WHERE split = 'val' AND orig IN (SELECT orig FROM tr) UNION ALL SELECT path, orig, label, bucket FROM p WHERE part = 'test')
    SELECT path, part AS split, label FROM p WHERE part <> 'test' UNION ALL SELECT path, 'test', label FROM (SELECT *, row_number() OVER (PARTITION BY orig ORDER BY path) AS k FROM te WHERE orig NOT IN (SELECT orig FROM p WHERE part <> 'test')) WHERE k = 1"""))
def canon_repair(spark, d):
    rows = a.manifest(spark, d).withColumn("source", F.when(F.col("source") == "src1", "wildfake").otherwise(F.col("source")))
    return corpora.repair(rows, BAD, 5).select("path", "split", "label")


def tenths_sql(by: str, seed: int) -> str:
    over = f"PARTITION BY {by}" if by else ""
    return f"CASE WHEN row_number() OVER ({over} ORDER BY {seeded(seed)}) <= count(*) OVER ({over}) * 8 // 10 THEN 'train' WHEN row_number() OVER ({over} ORDER BY {seeded(seed)}) <= count(*) OVER ({over}) * 8 // 10 + count(*) OVER ({over}) // 10 THEN 'val' ELSE 'test' END"


@query("canon_merge", m(f""", e AS (SELECT * FROM m WHERE source IN ('src3', 'src4') AND doc_id % 9 <> 0), f AS (SELECT path, label, {tenths_sql('', 4)} AS split FROM e WHERE generator <> 'de' AND doc_id % 8 <> 0)
    SELECT path, label, split FROM m WHERE source NOT IN ('src3', 'src4') UNION ALL SELECT path, label, split FROM f UNION ALL SELECT path, label, 'test' FROM e WHERE generator = 'de' OR doc_id % 8 = 0"""))
def canon_merge(spark, d):
    n = F.col("doc_id")
    place = F.when(n % 9 == 0, "/coco2017/val2017/").when(n % 8 == 0, "/glide-in/").otherwise("/")
    rows = a.manifest(spark, d).withColumn("orig", F.concat(F.lit("data"), place, "orig"))
    here = F.col("source").isin("src3", "src4")
    held = (F.col("generator") == "de") | dims.tampered(F.col("generator"), F.col("orig"))
    return corpora.merge(rows.where(~here), rows.where(here), 4, held).select("path", "label", "split")


@query("canon_merge_sources", m(f""", f AS (SELECT *, {tenths_sql('source', 6)} AS sp FROM m WHERE source IN ('src2', 'src3')), tr AS (SELECT * FROM f WHERE sp = 'train'), va AS (SELECT * FROM f WHERE sp = 'val')
    SELECT path, label, split FROM m WHERE source NOT IN ('src2', 'src3', 'src4', 'src5') UNION ALL SELECT path, label, part FROM ({even_sql('train', 'tr', 106)}) UNION ALL SELECT path, label, part FROM ({even_sql('val', 'va', 107)})
    UNION ALL SELECT path, label, 'test' FROM f WHERE sp = 'test' UNION ALL SELECT path, label, 'test' FROM m WHERE source = 'src4'"""))
def canon_merge_sources(spark, d):
    rows = a.manifest(spark, d)
    extra = F.col("source").isin("src2", "src3", "src4", "src5")
    return corpora.merge_sources(rows.where(~extra), rows.where(extra), 6, {"src4"}, {"src2", "src3", "src4"}).select("path", "label", "split")


@query("official_rebuild", m(f"SELECT path, label, source FROM m WHERE label = 1 AND split = 'test' UNION ALL SELECT path, label, source FROM (SELECT * FROM m WHERE label = 0 AND split <> 'test' ORDER BY {seeded(2)} LIMIT 30)"))
def official_rebuild(spark, d):
    rows = a.manifest(spark, d)
    return corpora.rebuild(rows.where("split = 'test'"), rows.where("label = 0 AND split != 'test'"), 30, 2).select("path", "label", "source")


@query("waterfill_rows", m(f""", c AS (SELECT label, source AS g, count(*) AS n FROM m GROUP BY 1, 2), o AS (SELECT *, n - row_number() OVER () * 0 AS nn FROM c),
    lv AS (SELECT label, max(t) AS t FROM (SELECT label, t, (SELECT sum(least(n, t)) FROM c WHERE c.label = l.label) AS s FROM (SELECT DISTINCT label FROM c) l, (SELECT unnest(range(0, 100000)) AS t) WHERE t <= (SELECT max(n) FROM c)) WHERE s <= 120 GROUP BY label),
    q AS (SELECT c.label, g, n, least(n, t) AS base, t, row_number() OVER (PARTITION BY c.label ORDER BY n DESC, g DESC) AS big, 120 - sum(least(n, t)) OVER (PARTITION BY c.label) AS over FROM c JOIN lv ON lv.label = c.label)
    SELECT path, m.label, source FROM (SELECT *, row_number() OVER (PARTITION BY label, source ORDER BY {seeded(8)}) AS k FROM m) m JOIN q ON q.label = m.label AND q.g = m.source AND k <= base + (n > t AND big <= over)::INT"""))
def waterfill_rows(spark, d):
    rows = a.manifest(spark, d).withColumn("group", F.col("source"))
    return corpora.fill(rows, 120, 8).select("path", "label", "source")


@query("partial_edit_route", m(f"SELECT path, CASE WHEN generator IN ('de', 'es') AND row_number() OVER (PARTITION BY source, generator ORDER BY {seeded(500)}) > floor(count(*) OVER (PARTITION BY source, generator) * 0.5) THEN 'test' ELSE 'split' END AS route FROM m"))
def partial_edit_route(spark, d):
    return corpora.edit_route(a.manifest(spark, d), 500, 0.5, {"de", "es"}).select("path", "route")


@query("condition_subset", sc(" SELECT cond, count(*) AS n, count(DISTINCT path) AS paths FROM sc WHERE cond IN ('clean', 'crop_80') GROUP BY cond"))
def condition_subset(spark, d):
    return corpora.condition_subset(a.scores(spark, d), ["clean", "crop_80"]).groupBy("cond").agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths"))


@query("val_membership", "SELECT vec_id, CASE WHEN vec_id IN (SELECT doc_id FROM documents WHERE lang = 'de') THEN 'val' ELSE 'train' END AS split FROM embeddings")
def val_membership(spark, d):
    ids = a.table(spark, d, "documents").where("lang = 'de'").select(F.col("doc_id").alias("vec_id"))
    return corpora.membership(a.table(spark, d, "embeddings").select("vec_id"), ids, "vec_id")


# --- labels and flags ---------------------------------------------------------------------------------------------


@query("external_labels", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 END AS label, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'flux_sid' WHEN 2 THEN 'sid_tampered' END AS generator, CASE p_size % 4 WHEN 0 THEN 'sid_real' WHEN 1 THEN 'sid_fake' WHEN 2 THEN 'sid_tampered' END AS source,
    CASE p_partkey % 3 WHEN 0 THEN 'sd14' WHEN 1 THEN 'deepfloyd_if' ELSE p_brand END AS model FROM part""")
def external_labels(spark, d):
    n = F.col("p_partkey") % 3
    name = F.when(n == 0, "CompVis/stable-diffusion-v1-4").when(n == 1, "DeepFloyd/IF-II-L-v1.0").otherwise(F.concat(F.lit("org/"), "p_brand"))
    return a.table(spark, d, "part").select("p_partkey", dims.external_class(F.col("p_size") % 4).alias("c"), dims.external_model(name).alias("model")).select("p_partkey", "c.*", "model")


@query("label_names", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN 1 ELSE 0 END AS label FROM orders")
def label_names(spark, d):
    n = F.col("o_orderkey") % 3
    return a.table(spark, d, "orders").select("o_orderkey", dims.named_label(F.when(n == 0, "FAKE").when(n == 1, "Synthetic art").otherwise("Real photo")).alias("label"))


@query("source_topics", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'animal' WHEN 1 THEN 'church' WHEN 2 THEN 'face' WHEN 3 THEN 'landscape' ELSE 'object' END AS topic FROM part")
def source_topics(spark, d):
    n = F.col("p_partkey") % 5
    source = F.when(n == 0, "AFHQ_512").when(n == 1, "lsun_bedroom").when(n == 2, "celebahq_1024").when(n == 3, "Landscape").otherwise(F.col("p_brand"))
    return a.table(spark, d, "part").select("p_partkey", dims.topic(source).alias("topic"))


@query("slice_flags", m("SELECT path, doc_id % 9 = 0 AS official, doc_id % 9 <> 0 AND doc_id % 8 = 0 OR generator = 'es' AS tampered, label = 1 AND source = 'src1' AND generator = 'de' AS bogus FROM m"))
def slice_flags(spark, d):
    n = F.col("doc_id")
    orig = F.when(n % 9 == 0, "data/coco2017/val2017/x").when(n % 8 == 0, "data/glide-in/x").otherwise("data/x")
    return a.manifest(spark, d).select("path", dims.official_slice(orig).alias("official"), dims.tampered(F.col("generator"), orig, {"es"}).alias("tampered"), dims.bogus(F.col("label"), F.col("source"), F.col("generator"), {"de"}, "src1").alias("bogus"))


@query("unseen_tags", m("SELECT generator, CASE WHEN generator IN ('de', 'es') THEN 'TRAINED' ELSE 'unseen' END AS seen, count(*) AS n FROM m WHERE label = 1 GROUP BY generator"))
def unseen_tags(spark, d):
    trained = F.array(F.lit("de"), F.lit("es"))
    return a.manifest(spark, d).where("label = 1").groupBy("generator").agg(F.count("*").alias("n")).select("generator", dims.seen_tag(F.col("generator"), trained).alias("seen"), "n")


def unit_sql(seed: str, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT::DOUBLE / 4294967296::DOUBLE)"


@query("random_boxes", f"""WITH {a.P}, c AS (SELECT *, greatest(8, least((112 + floor({unit_sql('b:size', 'id')} * 65))::INT // 14 * 14, w, h)) AS c FROM p), x AS (SELECT *, floor({unit_sql('b:x', 'id')} * (greatest(0, w - c) + 1))::INT AS x0, floor({unit_sql('b:y', 'id')} * (greatest(0, h - c) + 1))::INT AS y0 FROM c)
    SELECT id, x0, y0, x0 + c AS x1, y0 + c AS y1 FROM x""")
def random_boxes(spark, d):
    return a.pictures(spark, d).select("id", geometry.random_box(F.col("w"), F.col("h"), "b", F.col("id"), step=14).alias("b")).select("id", "b.*")


@query("generation_plan", f"""SELECT doc_id, CASE WHEN {unit_sql('mode', 'doc_id')} < 0.25::DOUBLE THEN 'i2i' ELSE 't2i' END AS mode, (list_value('a', 'b', 'c'))[1 + floor({unit_sql('p:0', 'doc_id')} * 3)::INT] || ', ' || (list_value('x', 'y'))[1 + floor({unit_sql('p:1', 'doc_id')} * 2)::INT] AS prompt,
    (0 + floor({unit_sql('seed', 'doc_id')} * 2147483648))::BIGINT AS draw, (SELECT string_agg(v, '' ORDER BY k, v) FROM (SELECT md5('o|' || doc_id || '|' || i) AS k, (list_value('p', 'q', 'r', 's'))[i + 1] AS v FROM (SELECT unnest(range(4)) AS i))) AS ops FROM documents""")
def generation_plan(spark, d):
    n = F.col("doc_id")
    ops = draws.shuffled(F.array(*(F.lit(x) for x in "pqrs")), "o", n)
    return a.table(spark, d, "documents").select("doc_id", F.when(draws.unit("mode", n) < 0.25, "i2i").otherwise("t2i").alias("mode"), draws.phrase([["a", "b", "c"], ["x", "y"]], "p", n).alias("prompt"), draws.integer("seed", 0, 2147483647, n).alias("draw"), F.array_join(ops, "").alias("ops"))


ORACLE_SQL["corpus_build"] = m(f""", f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY orig ORDER BY path) AS first FROM m WHERE long > 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) WHERE first = 1),
    c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {seeded(10)}) AS nth FROM f) WHERE source <> 'src1' OR nth <= 5), s AS (SELECT *, {tenths_sql('source, generator', 3)} AS sp FROM c WHERE source <> 'src3' AND generator <> 'es'),
    tr AS (SELECT * FROM s WHERE sp = 'train'), va AS (SELECT * FROM s WHERE sp = 'val'), z AS (SELECT * REPLACE (part AS split) FROM (SELECT path, orig, label, generator, source, long, bucket, split, part FROM ({even_sql('train', 'tr', 103)}) UNION ALL SELECT path, orig, label, generator, source, long, bucket, split, part FROM ({even_sql('val', 'va', 104)})))
    SELECT path, orig, label, generator, source, long, bucket, split FROM z UNION ALL SELECT path, orig, label, generator, source, long, bucket, 'test' FROM s WHERE sp = 'test' UNION ALL SELECT path, orig, label, generator, source, long, bucket, 'test' FROM c WHERE source = 'src3' OR generator = 'es'""")
