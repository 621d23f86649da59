"""Queries over the operators of this library, each with the SQL that says what it computes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curata.functions import dims, geometry, hashes
from curata.functions.seeded import order_key
from curata.operators import audit, curate, dedup, groups, learn, metrics, votes
from curata.plans import adapters as a
from curata.session import written
from curata.sources import manifests as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


def m(sql: str) -> str:
    return f"WITH {a.M} {sql}"


def sc(sql: str) -> str:
    return f"WITH {a.SC} {sql}"


def r(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r(c) for c in columns})


def train(spark, d):
    return a.manifest(spark, d).where("split = 'train'")


COUNTS = "count(*) FILTER (label = 0) AS reals, count(*) FILTER (label = 1) AS fakes"


# --- counts, buckets, gates ---------------------------------------------------------------------------------------


@query("class_counts", m(f"SELECT split, {COUNTS} FROM m GROUP BY split"))
def class_counts(spark, d):
    return audit.class_counts(a.manifest(spark, d), ["split"])


@query("bucket_balance", m(f"""SELECT *, greatest(reals, fakes)::DOUBLE / nullif(least(reals, fakes), 0) AS ratio,
    CASE WHEN reals + fakes < 20 OR (least(reals, fakes) > 0 AND greatest(reals, fakes) <= 1.5 * least(reals, fakes)) THEN 'OK' WHEN split = 'test' THEN 'WARN' ELSE 'FAIL' END AS verdict
    FROM (SELECT split, bucket, {COUNTS} FROM m GROUP BY split, bucket)"""))
def bucket_balance(spark, d):
    return audit.bucket_balance(a.manifest(spark, d), min_rows=20)


@query("bucket_pivot", m("SELECT bucket, count(*) FILTER (label = 0) AS label_0, count(*) FILTER (label = 1) AS label_1 FROM m GROUP BY bucket"))
def bucket_pivot(spark, d):
    p = a.manifest(spark, d).groupBy("bucket").pivot("label", [0, 1]).count()
    return p.select("bucket", *(F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(f"label_{k}") for k in (0, 1)))


@query("bucket_variant", m("SELECT CASE WHEN long <= 341 THEN '<=341' WHEN long <= 640 THEN '<=640' ELSE '>640' END AS bucket3, count(*) AS n FROM m WHERE long > 0 GROUP BY 1"))
def bucket_variant(spark, d):
    return a.manifest(spark, d).where("long > 0").groupBy(dims.bucket3(F.col("long")).alias("bucket3")).agg(F.count("*").alias("n"))


@query("bucket_order", m("SELECT bucket, CASE bucket WHEN '<=341' THEN 0 WHEN '342-512' THEN 1 WHEN '513-768' THEN 2 WHEN '769-1024' THEN 3 ELSE 4 END AS bucket_ord, count(*) AS n FROM m WHERE long > 0 GROUP BY 1, 2"))
def bucket_order(spark, d):
    return a.manifest(spark, d).where("long > 0").groupBy("bucket", dims.bucket_order(F.col("bucket")).alias("bucket_ord")).agg(F.count("*").alias("n"))


@query("native_size_gate", m(f"""SELECT *, CASE WHEN reals > 0 AND fakes > 0 AND reals::DOUBLE / fakes BETWEEN 0.8 AND 1.25 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (
    SELECT bucket, {COUNTS}, list_sort(list(long))[count(*) // 2 + 1] AS median_long FROM m GROUP BY bucket)"""))
def native_size_gate(spark, d):
    return audit.native_size(a.manifest(spark, d))


SUBJECTS = [("promo|brushed", "promo"), ("steel|copper", "metal"), ("tin$", "tin")]


def subject_manifest(spark, d):
    p = a.table(spark, d, "part")
    key = F.lower(F.concat_ws("/", "p_brand", "p_type"))
    return p.select(F.when(F.col("p_size") % 2 == 0, 1).otherwise(0).alias("label"), dims.first_match(key, SUBJECTS).alias("subject"), F.col("p_brand").alias("source"), F.when(F.col("p_size") <= 25, "low").otherwise("high").alias("bucket"))


SM = """s AS (SELECT CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS label, p_brand AS source, CASE WHEN p_size <= 25 THEN 'low' ELSE 'high' END AS bucket,
    CASE WHEN regexp_matches(lower(p_brand || '/' || p_type), 'promo|brushed') THEN 'promo' WHEN regexp_matches(lower(p_brand || '/' || p_type), 'steel|copper') THEN 'metal' WHEN regexp_matches(lower(p_brand || '/' || p_type), 'tin$') THEN 'tin' ELSE 'other' END AS subject FROM part)"""


@query("subject_counts", f"WITH {SM} SELECT bucket, subject, {COUNTS} FROM s GROUP BY bucket, subject")
def subject_counts(spark, d):
    return audit.subject_counts(subject_manifest(spark, d), ["bucket"])


@query("subject_one_sided", f"WITH {SM} SELECT * FROM (SELECT bucket, subject, {COUNTS} FROM s GROUP BY bucket, subject) WHERE subject <> 'other' AND greatest(reals, fakes) >= 20 AND least(reals, fakes) < 0.95 * greatest(reals, fakes)")
def subject_one_sided(spark, d):
    return audit.one_sided(subject_manifest(spark, d), ["bucket"], min_rows=20, share=0.95)


@query("source_concentration", m("""SELECT bucket, source, n, n::DOUBLE / total AS share FROM (
    SELECT *, sum(n) OVER (PARTITION BY bucket) AS total, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, source DESC) AS k FROM (SELECT bucket, source, count(*) AS n FROM m GROUP BY bucket, source)) WHERE k = 1 AND n::DOUBLE / total >= 0.05"""))
def source_concentration(spark, d):
    return audit.concentration(a.manifest(spark, d), ["bucket"], "source", 0.05)


SUBJECT = "CASE WHEN label = 1 AND doc_id % 3 = 0 THEN 'church' WHEN doc_id % 5 = 0 THEN 'other' ELSE lang END"


@query("bucket_content_gate", m(f"""SELECT *, CASE WHEN n < 50 THEN 'SKIP' WHEN one_sided > 0 OR notes = 2 THEN 'WARN' ELSE 'PASS' END AS verdict FROM (
    SELECT bucket, count(*) AS n, (SELECT count(*) FROM (SELECT {SUBJECT} AS s, count(*) FILTER (label = 0) AS r, count(*) FILTER (label = 1) AS f FROM m y WHERE y.bucket = m.bucket GROUP BY 1) WHERE s <> 'other' AND r + f >= 5 AND r + f >= 0.1 * count(m.doc_id) AND least(r, f) = 0) AS one_sided,
    (SELECT count(*) FROM (SELECT label, max(n)::DOUBLE / sum(n) AS s FROM (SELECT label, CASE WHEN label = 0 THEN source ELSE generator END AS o, count(*) AS n FROM m x WHERE x.bucket = m.bucket GROUP BY 1, 2) GROUP BY label) WHERE s >= 0.7) AS notes FROM m GROUP BY bucket)"""))
def bucket_content_gate(spark, d):
    return audit.bucket_content(a.manifest(spark, d).withColumn("subject", F.expr(SUBJECT)), min_bucket=50, min_subject=5)


@query("topn_sources", m("SELECT split, source, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY n DESC, source) AS rank FROM (SELECT split, source, count(*) AS n FROM m GROUP BY split, source)) WHERE rank <= 3"))
def topn_sources(spark, d):
    return audit.top_n(a.manifest(spark, d), ["split"], "source", 3)


@query("label_conflicts", m("SELECT orig, count(DISTINCT label) AS labels FROM m GROUP BY orig HAVING count(DISTINCT label) > 1"))
def label_conflicts(spark, d):
    return audit.label_conflicts(a.manifest(spark, d), "orig")


@query("split_leak", m("SELECT orig, string_agg(DISTINCT split, '+' ORDER BY split) AS splits FROM m GROUP BY orig HAVING count(DISTINCT split) > 1"))
def split_leak(spark, d):
    return audit.split_leaks(a.manifest(spark, d), "orig")


PROVENANCE_ORIG = "CASE doc_id % 6 WHEN 0 THEN './data/wildfake/Images/Real/' || doc_id WHEN 1 THEN 'x\\wildfake\\gan_based/' || doc_id WHEN 2 THEN 'data/artifact/' || doc_id WHEN 3 THEN 'data/omnival/val/real/' || doc_id WHEN 4 THEN 'data/ext/img/coco_640/' || doc_id ELSE 'other/' || doc_id END"


def provenance_rows(spark, d):
    n = F.col("doc_id")
    parts = ["./data/wildfake/Images/Real/", "x\\wildfake\\gan_based/", "data/artifact/", "data/omnival/val/real/", "data/ext/img/coco_640/"]
    orig = F.concat(F.lit("other/"), n)
    for k, p in enumerate(parts):
        orig = F.when(n % 6 == k, F.concat(F.lit(p), n)).otherwise(orig)
    rows = a.manifest(spark, d).withColumn("orig", orig)
    targets = rows.where("doc_id % 12 = 2").select(F.col("orig").alias("image_path"), F.when(n % 5 == 0, "0").otherwise("7").alias("target"))
    return audit.provenance(rows, targets)


@query("provenance_rules", m("""SELECT rule, CASE WHEN truth IS NULL THEN 'unresolved' WHEN truth = label THEN 'agrees' ELSE 'disagrees' END AS state, count(*) AS n FROM (
    SELECT label, CASE doc_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN CASE WHEN doc_id % 12 = 2 THEN CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END END WHEN 3 THEN 0 WHEN 4 THEN 0 END AS truth,
    CASE doc_id % 6 WHEN 0 THEN 'wildfake:Real folder' WHEN 1 THEN 'wildfake:generator folder' WHEN 2 THEN CASE WHEN doc_id % 12 = 2 THEN 'artifact:metadata target' ELSE 'artifact:no metadata match' END WHEN 3 THEN 'omnifake:val/real' WHEN 4 THEN 'ext:coco_640' ELSE 'unknown source ' || source END AS rule FROM m) GROUP BY 1, 2"""))
def provenance_rules(spark, d):
    return provenance_rows(spark, d).groupBy("rule", "state").agg(F.count("*").alias("n"))


@query("gate_severity", m("""SELECT max(CASE v WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END) AS severity, count(*) AS gates FROM (
    SELECT CASE WHEN min(c0) = 0 OR min(c1) = 0 OR c0::DOUBLE / c1 NOT BETWEEN 0.8 AND 1.25 THEN 'FAIL' ELSE 'PASS' END AS v FROM (SELECT bucket, count(*) FILTER (label = 0) AS c0, count(*) FILTER (label = 1) AS c1 FROM m GROUP BY bucket) GROUP BY bucket, c0, c1)"""))
def gate_severity(spark, d):
    return audit.severity(audit.native_size(a.manifest(spark, d)).select("verdict"))


@query("corpus_audit", f"""WITH {a.AU} SELECT 'files' AS gate, CASE WHEN count(*) FILTER (sha256 IS NULL OR flat) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM au
    UNION ALL SELECT 'duplicates', CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END FROM dup
    UNION ALL SELECT 'near-duplicates ' || split, CASE WHEN avg((path IN (SELECT path FROM near))::INT) > 0.005 THEN 'FAIL' ELSE 'PASS' END FROM au WHERE split IN ('val', 'test') GROUP BY split""")
def corpus_audit(spark, d):
    """Near duplicates come from a search of the texts' hashes."""
    rows = a.audited(spark, d)
    return audit.corpus_audit(rows, dedup.near_train(rows))


@query("data_state_report", m(f"SELECT split, count(*) AS n, {COUNTS}, count(DISTINCT generator) FILTER (label = 1) AS generators, count(DISTINCT source) AS sources FROM m GROUP BY split"))
def data_state_report(spark, d):
    return a.manifest(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("reals"), F.count_if(F.col("label") == 1).alias("fakes"), F.count_distinct(F.when(F.col("label") == 1, F.col("generator"))).alias("generators"), F.count_distinct("source").alias("sources"))


@query("nested_counts", m("SELECT bucket, label, source, count(*) AS n FROM m GROUP BY ROLLUP (bucket, label, source)"))
def nested_counts(spark, d):
    return a.manifest(spark, d).rollup("bucket", "label", "source").agg(F.count("*").alias("n"))


# --- duplicates and joins -----------------------------------------------------------------------------------------


@query("dup_within_split", m("SELECT split, sum(n - 1)::BIGINT AS copies FROM (SELECT split, sha256, count(*) AS n FROM m GROUP BY split, sha256) GROUP BY split"))
def dup_within_split(spark, d):
    return dedup.extra_copies(a.manifest(spark, d))


@query("dup_across_groups", m("SELECT sha256, count(*) AS n, count(DISTINCT split) AS splits, count(DISTINCT label) AS labels, string_agg(DISTINCT split, ' + ' ORDER BY split) AS signature FROM m GROUP BY sha256 HAVING count(*) > 1"))
def dup_across_groups(spark, d):
    return dedup.duplicate_groups(a.manifest(spark, d))


@query("dup_signature", m("SELECT signature, count(*) AS groups FROM (SELECT string_agg(DISTINCT split, ' + ' ORDER BY split) AS signature FROM m GROUP BY sha256 HAVING count(DISTINCT split) > 1) GROUP BY signature"))
def dup_signature(spark, d):
    return dedup.signatures(a.manifest(spark, d))


@query("drop_list", f"WITH {a.AU} SELECT DISTINCT path FROM au WHERE sha256 IS NULL OR flat OR sha256 IN (SELECT sha256 FROM dup) OR path IN (SELECT path FROM near)")
def drop_list(spark, d):
    """With unreadable and flat rows, and near duplicates found by a search of the texts' hashes."""
    rows = a.audited(spark, d)
    return dedup.drop_list(rows, dedup.near_train(rows).union(rows.where("sha256 IS NULL OR flat").select("path")))


@query("byte_antijoin", m("SELECT path, label FROM m t WHERE split = 'test' AND NOT EXISTS (SELECT 1 FROM m x WHERE x.split = 'train' AND x.sha256 = t.sha256)"))
def byte_antijoin(spark, d):
    rows = a.manifest(spark, d)
    return rows.where("split = 'test'").join(rows.where("split = 'train'").select("sha256").distinct(), "sha256", "left_anti").select("path", "label")


#: Generators as fine as data allow: many are in training, some are not.
FINE = "lang || '_' || source || '_' || coalesce(bucket, 'none')"


def fine(rows: DataFrame) -> DataFrame:
    """The manifest with generators told apart by language, source and bucket."""
    name = F.concat_ws("_", "lang", "source", F.coalesce("bucket", F.lit("none")))
    return rows.withColumn("generator", F.when(F.col("label") == 1, name).otherwise(""))


@query("generator_disjoint", m(f"""SELECT path, {FINE} AS generator FROM m WHERE label = 1 AND split = 'test' AND lower(regexp_replace({FINE}, '[_-]', '', 'g')) NOT IN (SELECT lower(regexp_replace({FINE}, '[_-]', '', 'g')) FROM m WHERE split = 'train' AND label = 1)"""))
def generator_disjoint(spark, d):
    rows = fine(a.manifest(spark, d))
    seen = rows.where("split = 'train' AND label = 1").select(dims.norm_generator(F.col("generator")).alias("g")).distinct()
    fakes = rows.where("label = 1 AND split = 'test'")
    return fakes.join(seen, dims.norm_generator(F.col("generator")) == F.col("g"), "left_anti").select("path", "generator")


@query("benchmark_contamination", "SELECT d.doc_id, b.item_id FROM documents d, benchmark b WHERE contains(d.text, b.text) AND length(b.text) > 0")
def benchmark_contamination(spark, d):
    """Benchmark texts in documents, by equi-joins on hashes of word windows and on letters, then verified.

    A passage may begin or end within a word, so its first and last words do not count: an item of k words meets documents
    by the first of its windows of min(k - 2, 8) words; all widths that items have are cut from a text at once. Items of
    one or two words have no such window: they meet documents by their first letters, three or as many as they have.
    """
    spaced = lambda c: F.array_remove(F.split(c, r"\s+"), "")
    item = a.table(spark, d, "benchmark").where("length(text) > 0").select("item_id", F.col("text").alias("item"), spaced(F.col("text")).alias("w"))
    items = item.withColumn("width", F.least(F.size("w") - 2, F.lit(8))).withColumn("letters", F.least(F.length("item"), F.lit(3)))
    of_words, of_letters = items.where("width > 0"), items.where("width <= 0")
    widths = [r[0] for r in of_words.select("width").distinct().collect()]  # 8 at most
    counts = [r[0] for r in of_letters.select("letters").distinct().collect()]  # 3 at most
    text = a.table(spark, d, "documents").select("doc_id", "text")
    key = lambda kind, k, x: F.xxhash64(F.lit(kind), F.lit(k), x)
    none = F.array().cast("array<bigint>")
    windows = lambda k: F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: key("w", k, F.array_join(F.slice("w", i, k), " ")))).otherwise(none)
    grams = lambda k: F.when(F.length("text") >= k, F.transform(F.sequence(F.lit(1), F.length("text") - k + 1), lambda i: key("l", k, F.substring("text", i, F.lit(k))))).otherwise(none)
    made = [windows(k) for k in widths] + [grams(k) for k in counts]
    if not made:
        return text.limit(0).select("doc_id", F.lit(None).cast(item.schema["item_id"].dataType).alias("item_id"))
    asked = of_words.select("item_id", F.xxhash64(F.lit("w"), "width", F.expr("array_join(slice(w, 2, width), ' ')")).alias("key"))
    asked = asked.unionByName(of_letters.select("item_id", F.xxhash64(F.lit("l"), "letters", F.expr("substring(item, 1, letters)")).alias("key")))
    cut = text.withColumn("w", spaced(F.col("text"))).select("doc_id", F.explode(F.array_distinct(F.concat(*made))).alias("key"))
    hits = cut.join(asked, "key").select("doc_id", "item_id").distinct()
    return hits.join(items.select("item_id", "item"), "item_id").join(text, "doc_id").where("contains(text, item)").select("doc_id", "item_id")


@query("holdout_check", m("SELECT DISTINCT generator FROM m WHERE split = 'train' AND label = 1 AND generator IN ('de', 'fr')"))
def holdout_check(spark, d):
    held = spark.createDataFrame([("de",), ("fr",)], "generator string")
    return train(spark, d).where("label = 1").select("generator").distinct().join(F.broadcast(held), "generator", "left_semi")


@query("forbidden_slice", "SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderkey % 7 = 0 THEN 'x/Val2017/' WHEN o_orderkey % 11 = 0 THEN 'DALLE3/' ELSE 'train2017/dalle2/' END || o_orderpriority SIMILAR TO '.*([vV][aA][lL]2017|[dD][aA][lL][lL][eE]3).*'")
def forbidden_slice(spark, d):
    n = F.col("o_orderkey")
    orig = F.concat(F.when(n % 7 == 0, "x/Val2017/").when(n % 11 == 0, "DALLE3/").otherwise("train2017/dalle2/"), F.col("o_orderpriority"))
    return a.table(spark, d, "orders").where(dims.forbidden_slice(orig)).select("o_orderkey")


@query("scores_manifest_join", sc("SELECT cond, count(*) AS n, count(m.long) AS matched, sum(m.long)::BIGINT AS total_long FROM sc LEFT JOIN m ON m.path = sc.path GROUP BY cond"))
def scores_manifest_join(spark, d):
    s = a.scores(spark, d).withColumn("path", F.concat(F.lit("./"), F.col("path")))
    return curate.scores_by_condition(s, a.manifest(spark, d))


@query("errors_orig_join", sc("SELECT e.path, coalesce(m.orig, '') AS orig FROM (SELECT path FROM sc WHERE cond = 'clean' AND label = 0 AND score >= 0.6) e LEFT JOIN m ON m.path = e.path"))
def errors_orig_join(spark, d):
    e = a.scores(spark, d).where("cond = 'clean' AND label = 0 AND score >= 0.6").select("path")
    return curate.with_orig(e, a.manifest(spark, d))


@query("foreign_key_join", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey")
def foreign_key_join(spark, d):
    c = a.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    joined = a.table(spark, d, "orders").join(c, "o_custkey", "left")
    return curate.require(joined, F.col("c_mktsegment").isNotNull(), "an order without a customer").select("o_orderkey", "c_mktsegment")


#: Every document is a probe.
PAIRS = f"WITH {a.H}, pairs AS (SELECT p.id AS probe_id, t.id AS train_id, bit_count(xor(p.dhash, t.dhash)) AS distance FROM pr p, h t WHERE bit_count(xor(p.dhash, t.dhash)) <= 4)"


@query("hamming_pigeonhole", f"""WITH {a.H}, p AS (SELECT dhash, min(id) AS id, count(*) AS n FROM pr GROUP BY dhash), t AS (SELECT dhash, min(id) AS id, count(*) AS n FROM h GROUP BY dhash)
    SELECT 'pair' AS kind, NULL::BIGINT AS id, p.id AS probe_id, t.id AS train_id, bit_count(xor(p.dhash, t.dhash))::INT AS distance, p.n AS probe_rows, t.n AS train_rows FROM p, t WHERE bit_count(xor(p.dhash, t.dhash)) <= 4
    UNION ALL SELECT 'probe', pr.id, p.id, NULL, NULL, p.n, NULL FROM pr LEFT JOIN p ON p.dhash = pr.dhash
    UNION ALL SELECT 'train', h.id, NULL, t.id, NULL, NULL, t.n FROM h LEFT JOIN t ON t.dhash = h.dhash""")
def hamming_pigeonhole(spark, d):
    probe, known = (written(x) for x in a.hashes(spark, d))  # each is read three times, and a hash reads a whole text
    one, two = (x.select(F.col("dhash").alias("id"), "dhash").distinct() for x in (probe, known))
    return groups.near_classes(probe, known, dedup.near_pairs(one, two, 4))


@query("nearest_hash", PAIRS + " SELECT probe_id, train_id, distance::INT AS distance FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY distance, train_id) AS k FROM pairs) WHERE k = 1")
def nearest_hash(spark, d):
    return dedup.nearest_by_hash(*a.hashes(spark, d), 4)


@query("hamming_prefix", f"WITH {a.H} SELECT DISTINCT p.id FROM pr p, h t WHERE bit_count(xor(p.dhash, t.dhash)) <= 2 AND (p.dhash >> 40 = t.dhash >> 40 OR xor(p.dhash >> 40, 1) = t.dhash >> 40)")
def hamming_prefix(spark, d):
    probe, known = a.hashes(spark, d)
    hit = dedup.near_by_prefix(probe.select(F.col("dhash").alias("id"), "dhash").distinct(), known.select("dhash").distinct())
    return probe.join(hit.withColumnRenamed("id", "dhash"), "dhash").select("id").distinct()


@query("hamming_brute", PAIRS + " SELECT distance::INT AS distance, count(*) AS pairs FROM pairs GROUP BY distance")
def hamming_brute(spark, d):
    return dedup.near_counts(*a.hashes(spark, d), 4)


@query("unseen_reasons", PAIRS + """, tr AS (SELECT sha256(text) AS s, doc_id FROM documents) SELECT p.id, CASE WHEN p.id % 30 = 0 THEN 'unreadable' WHEN EXISTS (SELECT 1 FROM tr x WHERE x.doc_id <> p.id AND x.s = (SELECT s FROM tr y WHERE y.doc_id = p.id)) THEN 'byte-identical'
    WHEN EXISTS (SELECT 1 FROM pairs q WHERE q.probe_id = p.id) THEN 'near-duplicate' END AS reason FROM pr p""")
def unseen_reasons(spark, d):
    probe, known = a.hashes(spark, d)
    docs = a.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"))
    rows = probe.join(docs, "id").select(F.col("id").alias("path"), F.when(F.col("id") % 30 != 0, F.col("sha256")).alias("sha256"))
    near = dedup.nearest_by_hash(probe, known, 4).select(F.col("probe_id").alias("path"))
    twice = docs.groupBy("sha256").agg(F.count("*").alias("n")).where("n > 1")  # so another document has it
    return curate.drop_reasons(rows, twice, near).select(F.col("path").alias("id"), "reason")


SUFFIX = """RECURSIVE t AS (SELECT page_id, 'a/' || page_id % 7 || '/' || page_id AS f FROM pages UNION ALL SELECT page_id, 'b/' || page_id % 7 || '/' || page_id FROM pages WHERE page_id % 10 = 0),
    q AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'zip/x/' || page_id % 7 || '/' || page_id WHEN page_id % 4 = 1 THEN 'root/a/' || page_id % 7 || '/' || page_id ELSE 'gone/' || page_id || '.x' END AS path FROM pages)"""


@query("suffix_join", f"""WITH {SUFFIX} SELECT path, CASE WHEN hits = 1 THEN f END AS match, CASE WHEN hits IS NULL THEN 'missing' WHEN hits > 1 THEN 'ambiguous' ELSE 'resolved' END AS status FROM (
    SELECT q.path, count(t.f) AS h, nullif(count(t.f), 0) AS hits, min(t.f) AS f FROM q LEFT JOIN t ON (q.path = 'root/' || t.f AND q.page_id % 4 = 1) OR (q.page_id % 4 = 0 AND q.page_id = t.page_id) GROUP BY q.path)""")
def suffix_join(spark, d):
    p, n = a.table(spark, d, "pages").select("page_id"), F.col("page_id")
    tail = F.concat_ws("/", (n % 7).cast("string"), n.cast("string"))
    disk = p.select(F.concat(F.lit("a/"), tail).alias("path")).unionByName(p.where(n % 10 == 0).select(F.concat(F.lit("b/"), tail).alias("path")))
    probe = p.select(F.when(n % 4 == 0, F.concat(F.lit("zip/x/"), tail)).when(n % 4 == 1, F.concat(F.lit("root/a/"), tail)).otherwise(F.concat(F.lit("gone/"), n, F.lit(".x"))).alias("path"))
    return dedup.suffix_join(probe, disk)


@query("cosine_pairs", """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.vec_id AS a_id, b.vec_id AS b_id, a.label, round(list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)), 6) AS cosine
    FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= 0.3""")
def cosine_pairs(spark, d):
    return rounded(dedup.cosine_pairs(a.table(spark, d, "embeddings"), 0.3), "cosine")


# --- curation -----------------------------------------------------------------------------------------------------


@query("first_wins_dedup", m("SELECT path, orig, label FROM (SELECT *, row_number() OVER (PARTITION BY orig ORDER BY doc_id DESC) AS k FROM m) WHERE k = 1"))
def first_wins_dedup(spark, d):
    rows = a.manifest(spark, d).withColumn("neg", -F.col("doc_id"))
    return curate.first_wins(rows, ["orig"], ["neg"]).select("path", "orig", "label")


def seeded(seed) -> str:
    return f"md5('{seed}|' || path), path"


@query("source_cap", m(f"SELECT path, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {seeded(7)}) AS k FROM m) WHERE source NOT IN ('src1', 'src2') OR k <= 5"))
def source_cap(spark, d):
    return curate.source_cap(a.manifest(spark, d), {"src1": 5, "src2": 5}, 7).select("path", "source")


@query("split_80_10_10", m(f"SELECT path, CASE WHEN k <= n * 8 // 10 THEN 'train' WHEN k <= n * 8 // 10 + n // 10 THEN 'val' ELSE 'test' END AS split FROM (SELECT path, row_number() OVER (PARTITION BY source, generator ORDER BY {seeded(1)}) AS k, count(*) OVER (PARTITION BY source, generator) AS n FROM m)"))
def split_80_10_10(spark, d):
    return curate.split(a.manifest(spark, d), ["source", "generator"], 1).select("path", "split")


BALANCE = f"b AS (SELECT *, row_number() OVER (PARTITION BY bucket, label ORDER BY {seeded(100)}) AS k, least(count(*) FILTER (label = 0) OVER (PARTITION BY bucket), count(*) FILTER (label = 1) OVER (PARTITION BY bucket)) AS n FROM m)"


@query("balance_keep", m(f", {BALANCE} SELECT path, bucket, label FROM b WHERE k <= n"))
def balance_keep(spark, d):
    return curate.balanced(a.manifest(spark, d), 100).where("kept").select("path", "bucket", "label")


@query("balance_excess", m(f", {BALANCE} SELECT path, bucket, label, 'test' AS split FROM b WHERE k > n"))
def balance_excess(spark, d):
    return curate.balanced(a.manifest(spark, d), 100).where("NOT kept").select("path", "bucket", "label", F.lit("test").alias("split"))


@query("equal_bucket", m(f", {BALANCE} SELECT path, bucket, label FROM b WHERE n >= 2 AND k <= (SELECT min(n) FROM b WHERE n >= 2)"))
def equal_bucket(spark, d):
    return curate.balanced(a.manifest(spark, d), 100, equal=-1, min_bucket=2).where("kept").select("path", "bucket", "label")


@query("first_n_per_generator", m("SELECT path, generator FROM (SELECT *, row_number() OVER (PARTITION BY generator ORDER BY doc_id) AS k FROM m WHERE label = 1) WHERE k <= 10"))
def first_n_per_generator(spark, d):
    return curate.first_n(a.manifest(spark, d).where("label = 1"), ["generator"], 10, ["doc_id"]).select("path", "generator")


@query("waterfill", """WITH RECURSIVE g AS (SELECT source AS grp, count(*) AS available FROM documents GROUP BY source), o AS (SELECT *, row_number() OVER (ORDER BY available, grp) AS i, count(*) OVER () AS n FROM g),
    w AS (SELECT i, grp, available, least(available, 600 // n) AS picks, 600 - least(available, 600 // n) AS rest FROM o WHERE i = 1 UNION ALL SELECT o.i, o.grp, o.available, least(o.available, w.rest // (o.n - o.i + 1)), w.rest - least(o.available, w.rest // (o.n - o.i + 1)) FROM w JOIN o ON o.i = w.i + 1)
    SELECT grp AS "group", available, picks FROM w""")
def waterfill(spark, d):
    return curate.allocate(a.table(spark, d, "documents").groupBy(F.col("source").alias("group")).agg(F.count("*").alias("available")), 600)


@query("stratified_sample", m(f"SELECT path, source FROM (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY {seeded(3)}) AS k FROM m) WHERE k <= 2"))
def stratified_sample(spark, d):
    return curate.stratified_sample(a.manifest(spark, d), ["source", "label"], 2, 3).select("path", "source")


@query("seeded_limit", m(f"SELECT path FROM m ORDER BY {seeded(5)} LIMIT 25"))
def seeded_limit(spark, d):
    return curate.seeded_limit(a.manifest(spark, d), 25, 5).select("path")


@query("mix_50_50", sc("SELECT path, cond, score FROM sc WHERE cond = 'clean' UNION ALL SELECT path, cond, score FROM (SELECT * FROM sc WHERE cond <> 'clean' ORDER BY md5('9|' || path || '|' || cond), path || '|' || cond LIMIT (SELECT count(*) FROM m))"))
def mix_50_50(spark, d):
    s = a.scores(spark, d).withColumn("key", F.concat_ws("|", "path", "cond"))
    return curate.mix_half(s.where("cond = 'clean'"), s.where("cond != 'clean'"), 9, "key").select("path", "cond", "score")


@query("family_holdout", m("SELECT split, generator, count(*) AS n FROM m WHERE NOT (label = 1 AND generator IN ('de', 'es')) OR split = 'test' GROUP BY 1, 2"))
def family_holdout(spark, d):
    return curate.hold_out_school(a.manifest(spark, d), ["de", "es"]).groupBy("split", "generator").agg(F.count("*").alias("n"))


@query("edit_eval_set", m(f""", f AS (SELECT * FROM m WHERE orig NOT IN (SELECT orig FROM m WHERE split = 'train')), e AS (SELECT * FROM f WHERE label = 1 OR orig IN (SELECT orig FROM m WHERE split = 'test')),
    b AS (SELECT *, row_number() OVER (PARTITION BY bucket, label ORDER BY {seeded(11)}) AS k, least(count(*) FILTER (label = 0) OVER (PARTITION BY bucket), count(*) FILTER (label = 1) OVER (PARTITION BY bucket)) AS n FROM e) SELECT path, bucket, label FROM b WHERE k <= n"""))
def edit_eval_set(spark, d):
    rows = a.manifest(spark, d)
    return curate.edit_eval(rows, [rows.where("split = 'train'")], rows.where("split = 'test'"), 11).select("path", "bucket", "label")


@query("disjoint_benchmark", m(f""", f AS (SELECT *, CASE WHEN label = 1 THEN {FINE} ELSE '' END AS fine FROM m)
    SELECT path, fine AS generator FROM (SELECT *, row_number() OVER (PARTITION BY fine ORDER BY doc_id) AS k FROM f WHERE split = 'test' AND NOT (label = 1 AND lower(regexp_replace(fine, '[_-]', '', 'g')) IN (SELECT lower(regexp_replace(fine, '[_-]', '', 'g')) FROM f WHERE split = 'train' AND label = 1))
    AND sha256 NOT IN (SELECT sha256 FROM m WHERE split = 'train')) WHERE k <= 8"""))
def disjoint_benchmark(spark, d):
    rows = fine(a.manifest(spark, d))
    return curate.disjoint_benchmark(rows.where("split = 'test'"), rows.where("split = 'train'"), 8, ["doc_id"]).select("path", "generator")


@query("corpus_build")
def corpus_build(spark, d):
    listed = a.table(spark, d, "labels").where("toxic = 1").select(F.concat(F.lit("./doc//"), "doc_id").alias("path"))
    return curate.build_corpus([a.manifest(spark, d).drop("split", "bucket")], excluded=listed, seed=3, caps={"src1": 5}, test_sources={"src3"}, test_generators={"es"}, min_bucket=5).select("path", "orig", "label", "generator", "source", "long", "bucket", "split")


@query("union_splits", m("SELECT DISTINCT orig FROM m WHERE split = 'train' UNION SELECT orig FROM m WHERE split = 'val'"))
def union_splits(spark, d):
    rows = a.manifest(spark, d)
    return rows.where("split = 'train'").select("orig").union(rows.where("split = 'val'").select("orig")).distinct()


@query("except_generators", m(f"SELECT DISTINCT {FINE} AS generator FROM m WHERE split = 'test' AND label = 1 EXCEPT SELECT {FINE} FROM m WHERE split = 'train' AND label = 1"))
def except_generators(spark, d):
    rows = fine(a.manifest(spark, d)).where("label = 1")
    return rows.where("split = 'test'").select("generator").subtract(rows.where("split = 'train'").select("generator"))


@query("intersect_check", m("SELECT orig FROM m WHERE split = 'val' INTERSECT SELECT orig FROM m WHERE split = 'test'"))
def intersect_check(spark, d):
    rows = a.manifest(spark, d)
    return rows.where("split = 'val'").select("orig").intersect(rows.where("split = 'test'").select("orig"))


@query("conversation_split", """WITH c AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id), k AS (SELECT *, row_number() OVER (ORDER BY md5('4|' || conv_id), conv_id) AS k, count(*) OVER () AS n FROM c)
    SELECT conv_id, turns, CASE WHEN k <= n * 8 // 10 THEN 'train' WHEN k <= n * 8 // 10 + n // 10 THEN 'val' ELSE 'test' END AS split FROM k""")
def conversation_split(spark, d):
    groups = a.table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns")).withColumn("all", F.lit(1))
    return curate.split(groups, ["all"], 4, "conv_id").select("conv_id", "turns", "split")


# --- metrics ------------------------------------------------------------------------------------------------------

AUROC = "ar AS (SELECT cond, (sum(pos * (below + neg * 0.5::DOUBLE)) / nullif(max(p) * max(n), 0)::DOUBLE) AS auroc FROM d GROUP BY cond)"
DISTINCT = """d AS (SELECT cond, score, pos, neg, coalesce(sum(neg) OVER (PARTITION BY cond ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, coalesce(sum(pos) OVER (PARTITION BY cond ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below_pos,
    sum(pos) OVER (PARTITION BY cond) AS p, sum(neg) OVER (PARTITION BY cond) AS n FROM (SELECT cond, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM sc GROUP BY cond, score))"""
CURVE = f", {DISTINCT}, {AUROC}, ro AS (SELECT cond, score AS threshold, (p - below_pos)::DOUBLE / nullif(p, 0) AS tpr, (n - below)::DOUBLE / nullif(n, 0) AS fpr FROM d)"


@query("auroc_by_condition", sc(f"{CURVE} SELECT cond, round(auroc, 6) AS auroc FROM ar"))
def auroc_by_condition(spark, d):
    return rounded(metrics.auroc(a.scores(spark, d), ["cond"]), "auroc")


@query("roc_points", sc(f"{CURVE} SELECT cond, threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM ro UNION ALL SELECT DISTINCT cond, NULL, 0, 0 FROM ro"))
def roc_points(spark, d):
    return rounded(metrics.roc(a.scores(spark, d), ["cond"]), "tpr", "fpr")


@query("youden_threshold", sc(f"{CURVE} SELECT cond, threshold AS cutoff FROM (SELECT *, row_number() OVER (PARTITION BY cond ORDER BY tpr - fpr DESC, threshold DESC) AS k FROM ro) WHERE k = 1"))
def youden_threshold(spark, d):
    return metrics.youden(a.scores(spark, d), ["cond"])


@query("fpr_at_tpr95", sc(f"{CURVE} SELECT cond, round(min(fpr), 6) AS fpr_at_tpr FROM ro WHERE tpr >= 0.95 GROUP BY cond"))
def fpr_at_tpr95(spark, d):
    return rounded(metrics.fpr_at_tpr(a.scores(spark, d), ["cond"]), "fpr_at_tpr")


@query("auroc_per_generator", sc(f"{CURVE}, f AS (SELECT cond, generator, score, count(*) AS k FROM sc WHERE label = 1 AND generator <> '' GROUP BY 1, 2, 3) SELECT f.cond, generator, sum(k)::BIGINT AS fakes, round(sum(k * (below + neg * 0.5::DOUBLE)) / (sum(k) * max(n)), 6) AS auroc FROM f JOIN d ON d.cond = f.cond AND d.score = f.score GROUP BY 1, 2"))
def auroc_per_generator(spark, d):
    return rounded(metrics.by_generator(a.scores(spark, d), ["cond"]), "auroc")


Q99 = "quantile_cont(score, 0.99) FILTER (label = 0)"
CONFUSION = "count(*) FILTER (hit AND label = 1) AS tp, count(*) FILTER (NOT hit AND label = 1) AS fn, count(*) FILTER (hit AND label = 0) AS fp, count(*) FILTER (NOT hit AND label = 0) AS tn"
RATES = "round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round(fp::DOUBLE / nullif(fp + tn, 0), 6) AS fpr, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round((tp::DOUBLE / nullif(tp + fn, 0) + 1 - fp::DOUBLE / nullif(fp + tn, 0)) / 2, 6) AS balanced_acc, round((tp + tn)::DOUBLE / nullif(tp + tn + fp + fn, 0), 6) AS accuracy"


def rates(df: DataFrame) -> DataFrame:
    return rounded(df, "recall", "fpr", "precision", "balanced_acc", "accuracy")


def confused(by: str, where: str = "true", cutoff: str = f"(SELECT {Q99} FROM sc)") -> str:
    return sc(f", h AS (SELECT *, score >= {cutoff} AS hit FROM sc WHERE {where}), x AS (SELECT {by}{', ' if by else ''}{CONFUSION} FROM h {'GROUP BY ' + by if by else ''}) SELECT *, {RATES} FROM x")


def pooled_confusion(spark, d, by: list[str], where: str = "true") -> DataFrame:
    s = a.scores(spark, d)
    return rates(metrics.confusion(s.where(where).join(F.broadcast(metrics.quantile_cutoff(s, []))), by, F.col("cutoff")))


@query("confusion_pooled", confused(""))
def confusion_pooled(spark, d):
    return pooled_confusion(spark, d, [])


@query("confusion_by_condition", confused("cond"))
def confusion_by_condition(spark, d):
    return pooled_confusion(spark, d, ["cond"])


@query("confusion_by_bucket", confused("bucket"))
def confusion_by_bucket(spark, d):
    return pooled_confusion(spark, d, ["bucket"])


@query("confusion_by_generator", confused("generator", "generator <> ''"))
def confusion_by_generator(spark, d):
    return pooled_confusion(spark, d, ["generator"], "generator != ''")


@query("balanced_accuracy", sc("SELECT cond, round((avg(CASE WHEN label = 1 THEN (score >= 0.5)::INT::DOUBLE END) + avg(CASE WHEN label = 0 THEN (score < 0.5)::INT::DOUBLE END)) / 2, 6) AS balanced_acc FROM sc GROUP BY cond"))
def balanced_accuracy(spark, d):
    return rounded(metrics.confusion(a.scores(spark, d), ["cond"], F.lit(0.5)).select("cond", "balanced_acc"), "balanced_acc")


@query("quantile_cutoff", sc(f"SELECT cond, round({Q99}, 6) AS cutoff FROM sc GROUP BY cond"))
def quantile_cutoff(spark, d):
    return rounded(metrics.quantile_cutoff(a.scores(spark, d), ["cond"]), "cutoff")


@query("cutoff_policies", sc(f"""{CURVE} SELECT 'fixed' AS policy, cond, 0.5::DOUBLE AS cutoff FROM k UNION ALL SELECT 'clean', cond, (SELECT round({Q99}, 6) FROM sc WHERE cond = 'clean') FROM k UNION ALL SELECT 'pooled', cond, (SELECT round({Q99}, 6) FROM sc) FROM k
    UNION ALL SELECT 'per_condition', cond, round({Q99}, 6) FROM sc GROUP BY cond UNION ALL SELECT 'youden_clean', cond, (SELECT threshold FROM ro WHERE cond = 'clean' ORDER BY tpr - fpr DESC, threshold DESC LIMIT 1) FROM k"""))
def cutoff_policies(spark, d):
    return rounded(metrics.cutoffs(a.scores(spark, d)), "cutoff")


def ladder(spark, d, policy: str) -> DataFrame:
    s = a.scores(spark, d).withColumn("depth", metrics.depth(F.col("cond"))).where("depth IS NOT NULL")
    cut = metrics.cutoffs(s).where(F.col("policy") == policy).select("cond", "cutoff")
    return rounded(metrics.confusion(s.join(F.broadcast(cut), "cond"), ["depth"], F.col("cutoff")).select("depth", "recall", "fpr", "balanced_acc"), "recall", "fpr", "balanced_acc")


DEPTH = "dp AS (SELECT *, CASE WHEN cond = 'clean' THEN 0 ELSE substr(cond, 6, 1)::INT END AS depth FROM sc WHERE cond = 'clean' OR cond LIKE 'stack%')"


def ladder_sql(cutoff: str) -> str:
    return sc(f", {DEPTH}, h AS (SELECT *, score >= {cutoff} AS hit FROM dp), x AS (SELECT depth, {CONFUSION} FROM h GROUP BY depth) SELECT depth, recall, fpr, balanced_acc FROM (SELECT *, {RATES} FROM x)")


@query("depth_ladder", ladder_sql(f"(SELECT {Q99} FROM dp WHERE depth = 0)"))
def depth_ladder(spark, d):
    return ladder(spark, d, "clean")


@query("recalibrated_ladder", ladder_sql(f"(SELECT {Q99} FROM dp z WHERE z.depth = dp.depth)"))
def recalibrated_ladder(spark, d):
    return ladder(spark, d, "per_condition")


@query("pooled_ladder", ladder_sql(f"(SELECT {Q99} FROM dp)"))
def pooled_ladder(spark, d):
    return ladder(spark, d, "pooled")


#: Every bucket is a column, rows without one, too.
LADDER = {"<=341": "b0", "342-512": "b1", "513-768": "b2", "769-1024": "b3", ">1024": "b4", "none": "b5"}


@query("depth_ladder_pivot", sc(f", {DEPTH} SELECT depth, " + ", ".join(f"round(avg(score) FILTER (coalesce(bucket, 'none') = '{b}'), 6) AS \"{n}\"" for b, n in LADDER.items()) + " FROM dp GROUP BY depth"))
def depth_ladder_pivot(spark, d):
    s = a.scores(spark, d).withColumn("depth", metrics.depth(F.col("cond"))).where("depth IS NOT NULL").withColumn("bucket", F.coalesce("bucket", F.lit("none")))
    p = s.groupBy("depth").pivot("bucket", list(LADDER)).agg(F.round(F.avg("score"), 6))
    return p.select("depth", *(F.col(f"`{k}`").alias(v) for k, v in LADDER.items()))


@query("family_table", sc(f"{CURVE}, fam AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{f}')" for c, f in metrics.families()) + ") t(cond, family)) SELECT family, count(*) AS conds, round(avg(auroc), 6) AS mean_auroc, round(min(auroc), 6) AS worst_auroc FROM ar JOIN fam USING (cond) GROUP BY family"))
def family_table(spark, d):
    fam = spark.createDataFrame(metrics.families(), "cond string, family string")
    return rounded(metrics.auroc(a.scores(spark, d), ["cond"]).join(F.broadcast(fam), "cond").groupBy("family").agg(F.count("*").alias("conds"), F.avg("auroc").alias("mean_auroc"), F.min("auroc").alias("worst_auroc")), "mean_auroc", "worst_auroc")


@query("summary_worst_condition", sc(f"{CURVE}, w AS (SELECT cond, min(fpr) AS f FROM ro WHERE tpr >= 0.95 GROUP BY cond) SELECT round(avg(auroc), 6) AS mean_auroc, round(min(auroc), 6) AS min_auroc, (SELECT cond FROM ar WHERE cond <> 'clean' ORDER BY auroc, cond LIMIT 1) AS worst_cond, round(max(f), 6) AS worst_fpr FROM ar JOIN w USING (cond) WHERE cond <> 'clean'"))
def summary_worst_condition(spark, d):
    return rounded(metrics.summary(metrics.condition_report(a.scores(spark, d), ["cond"]), []), "mean_auroc", "min_auroc", "worst_fpr")


@query("condition_report", sc(f"{CURVE} SELECT ar.cond, round(auroc, 6) AS auroc, (SELECT round(min(fpr), 6) FROM ro WHERE ro.cond = ar.cond AND tpr >= 0.95) AS fpr_at_tpr95, (SELECT count(*) FROM m) AS n FROM ar"))
def condition_report(spark, d):
    return rounded(metrics.condition_report(a.scores(spark, d), ["cond"]), "auroc", "fpr_at_tpr95")


@query("pool_weights", sc("SELECT coalesce(bucket, 'all') AS bucket, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM sc), 6) AS weight FROM sc WHERE bucket IS NOT NULL GROUP BY ROLLUP (bucket)"))
def pool_weights(spark, d):
    s = a.scores(spark, d).where("bucket IS NOT NULL")
    counts = s.rollup("bucket").agg(F.count("*").alias("n")).withColumn("bucket", F.coalesce("bucket", F.lit("all")))
    return counts.select("bucket", "n", r(F.col("n") / F.max("n").over(Window.partitionBy())).alias("weight"))


@query("size_matched", sc(f", {BALANCE.replace('FROM m)', 'FROM m)')}, z AS (SELECT sc.* FROM sc JOIN b ON b.path = sc.path AND b.k <= b.n) SELECT cond, count(*) AS n, round(avg(score) FILTER (label = 1) - avg(score) FILTER (label = 0), 6) AS gap FROM z GROUP BY cond"))
def size_matched(spark, d):
    kept = curate.balanced(a.manifest(spark, d), 100).where("kept").select("path")
    s = a.scores(spark, d).join(kept, "path", "left_semi")
    gap = F.avg(F.when(F.col("label") == 1, F.col("score"))) - F.avg(F.when(F.col("label") == 0, F.col("score")))
    return s.groupBy("cond").agg(F.count("*").alias("n"), r(gap).alias("gap"))


@query("val_by_bucket", sc(f", o AS (SELECT bucket, {Q99} AS own FROM sc GROUP BY bucket) SELECT sc.bucket, round(avg((score >= (SELECT {Q99} FROM sc))::INT::DOUBLE) FILTER (label = 1), 6) AS recall_global, round(avg((score >= own)::INT::DOUBLE) FILTER (label = 1), 6) AS recall_own FROM sc JOIN o ON o.bucket IS NOT DISTINCT FROM sc.bucket GROUP BY sc.bucket"))
def val_by_bucket(spark, d):
    s = a.scores(spark, d)
    own = metrics.quantile_cutoff(s, ["bucket"]).select(F.col("bucket").alias("b"), F.col("cutoff").alias("own"))
    both = s.join(F.broadcast(metrics.quantile_cutoff(s, []))).join(F.broadcast(own), F.col("bucket").eqNullSafe(F.col("b")), "left")
    recall = lambda c: r(F.avg(F.when(F.col("label") == 1, (F.col("score") >= F.col(c)).cast("double"))))
    return both.groupBy("bucket").agg(recall("cutoff").alias("recall_global"), recall("own").alias("recall_own"))


@query("topk_false_positives", sc("SELECT path, cond, score FROM sc WHERE label = 0 AND score >= 0.5 ORDER BY score DESC, path, cond LIMIT 20"))
def topk_false_positives(spark, d):
    return a.scores(spark, d).where("label = 0 AND score >= 0.5").orderBy(F.desc("score"), "path", "cond").limit(20).select("path", "cond", "score")


@query("topk_false_negatives", sc("SELECT path, cond, score FROM sc WHERE label = 1 AND score < 0.5 ORDER BY score, path, cond LIMIT 20"))
def topk_false_negatives(spark, d):
    return a.scores(spark, d).where("label = 1 AND score < 0.5").orderBy("score", "path", "cond").limit(20).select("path", "cond", "score")


@query("unpivot_scores", sc("SELECT path, cond, score FROM sc"))
def unpivot_scores(spark, d):
    return src.long_scores(src.wide_scores(a.scores(spark, d), ["path"], a.CONDITIONS), ["path"])


@query("style_delta", sc(f"{CURVE} SELECT cond, round(auroc - (SELECT auroc FROM ar WHERE cond = 'clean'), 6) AS delta FROM ar"))
def style_delta(spark, d):
    t = metrics.auroc(a.scores(spark, d), ["cond"])
    base = t.where("cond = 'clean'").select(F.col("auroc").alias("base"))
    return t.join(F.broadcast(base)).select("cond", r(F.col("auroc") - F.col("base")).alias("delta"))


@query("score_stats", sc("SELECT cond, round(avg(score), 6) AS mean, round(median(score), 6) AS median, min(score) AS low, max(score) AS high, round(stddev_pop(score), 6) AS sd FROM sc GROUP BY cond"))
def score_stats(spark, d):
    return rounded(a.scores(spark, d).groupBy("cond").agg(F.avg("score").alias("mean"), F.median("score").alias("median"), F.min("score").alias("low"), F.max("score").alias("high"), F.stddev_pop("score").alias("sd")), "mean", "median", "sd")


@query("consistency_loss", sc("SELECT cond, round(sum((1 + label) * -CASE WHEN label = 1 THEN ln(greatest(1e-7, least(1 - 1e-7, score))) ELSE ln(1 - greatest(1e-7, least(1 - 1e-7, score))) END) / sum(1 + label), 6) AS loss FROM sc GROUP BY cond"))
def consistency_loss(spark, d):
    return rounded(votes.weighted_loss(a.scores(spark, d).withColumn("weight", (F.col("label") + 1).cast("double")), ["cond"]), "loss")


@query("predictions", sc("SELECT path, round(score, 6) AS pred, (score >= 0.5)::INT AS label FROM sc WHERE cond = 'clean'"))
def predictions(spark, d):
    return a.scores(spark, d).where("cond = 'clean'").select("path", votes.decided(F.col("score")).alias("p")).select("path", "p.*")


@query("events_auroc", """WITH sc AS (SELECT event_type AS cond, floor(value / (1 + value) * 1000) / 1000::DOUBLE AS score, (user_id % 2)::INT AS label FROM events WHERE value >= 0), """ + DISTINCT + ", " + AUROC + " SELECT cond, round(auroc, 6) AS auroc FROM ar")
def events_auroc(spark, d):
    e = a.table(spark, d, "events").where("value >= 0").select(F.col("event_type").alias("cond"), (F.floor(F.col("value") / (1 + F.col("value")) * 1000) / 1000.0).alias("score"), (F.col("user_id") % 2).cast("int").alias("label"))
    return rounded(metrics.auroc(e, ["cond"]), "auroc")


# --- geometry and votes -------------------------------------------------------------------------------------------


def ladder_numbers(cmin: int, cmax: int, n: int, step: int) -> list[int]:
    return sorted({max(step, round(cmin + i * (cmax - cmin) / (n - 1)) // step * step) for i in range(n)})


@query("size_ladder", f"WITH {a.P} SELECT id, size FROM p, (SELECT unnest([112, 140, 168]) AS size) WHERE size <= least(w, h)")
def size_ladder(spark, d):
    sizes = F.explode(geometry.size_ladder(112, 168, 3, 14)).alias("size")
    return a.pictures(spark, d).select("id", F.least("w", "h").alias("side"), sizes).where("size <= side").select("id", "size")


BOX = "x AS x0, y AS y0, x + c AS x1, y + c AS y1"


@query("grid_boxes", f"WITH {a.P}, s AS (SELECT *, greatest(8, least(112, w, h)) AS c FROM p), t AS (SELECT * FROM s, (VALUES (0), (1), (2)) v(i)), xs AS (SELECT DISTINCT id, c, round_even(i * (w - c) / 2.0::DOUBLE, 0)::INT AS x FROM t), ys AS (SELECT DISTINCT id, round_even(i * (h - c) / 2.0::DOUBLE, 0)::INT AS y FROM t) SELECT xs.id, {BOX} FROM xs JOIN ys ON ys.id = xs.id")
def grid_boxes(spark, d):
    p = a.pictures(spark, d)
    return p.select("id", F.explode(geometry.grid_boxes(F.col("w"), F.col("h"), F.lit(112))).alias("b")).select("id", "b.*")


@query("tile_boxes", f"""WITH {a.P}, s AS (SELECT *, greatest(8, least(112, w, h)) AS c FROM p), o AS (SELECT id, w, h, c, round_even(v.i * c / 2.0::DOUBLE, 0)::INT AS o FROM s, (VALUES (0), (1)) v(i)),
    xs AS (SELECT DISTINCT id, c, x FROM (SELECT id, c, unnest(range(o, w - c + 1, c)) AS x FROM o UNION ALL SELECT id, c, w - c FROM s) q), ys AS (SELECT DISTINCT id, y FROM (SELECT id, unnest(range(o, h - c + 1, c)) AS y FROM o UNION ALL SELECT id, h - c FROM s) q)
    SELECT xs.id, x::INT AS x0, y::INT AS y0, (x + c)::INT AS x1, (y + c)::INT AS y1 FROM xs JOIN ys ON ys.id = xs.id""")
def tile_boxes(spark, d):
    p = a.pictures(spark, d)
    return p.select("id", F.explode(geometry.tile_boxes(F.col("w"), F.col("h"), F.lit(112), 2)).alias("b")).select("id", "b.*")


CANVAS = f"""WITH {a.P}, q AS (SELECT *, CASE WHEN greatest(w, h) > 320 THEN greatest(1, round_even(w * (320::DOUBLE / greatest(w, h)), 0))::INT ELSE w END AS w1, CASE WHEN greatest(w, h) > 320 THEN greatest(1, round_even(h * (320::DOUBLE / greatest(w, h)), 0))::INT ELSE h END AS h1 FROM p),
    z AS (SELECT id, w, h, CASE WHEN least(w1, h1) < 112 THEN greatest(112, round_even(w1 * (112::DOUBLE / least(w1, h1)), 0))::INT ELSE w1 END AS cw, CASE WHEN least(w1, h1) < 112 THEN greatest(112, round_even(h1 * (112::DOUBLE / least(w1, h1)), 0))::INT ELSE h1 END AS ch FROM q)"""


@query("canvas_normalize", f"{CANVAS} SELECT id, cw, ch FROM z")
def canvas_normalize(spark, d):
    p = a.pictures(spark, d)
    return p.select("id", geometry.canvas(F.col("w"), F.col("h")).alias("c")).select("id", F.col("c.w").alias("cw"), F.col("c.h").alias("ch"))


@query("project_boxes", f"{CANVAS} SELECT id, greatest(0, floor(10 * w / cw::DOUBLE))::INT AS x0, greatest(0, floor(20 * h / ch::DOUBLE))::INT AS y0, least(w, ceil(100 * w / cw::DOUBLE))::INT AS x1, least(h, ceil(111 * h / ch::DOUBLE))::INT AS y1 FROM z")
def project_boxes(spark, d):
    p = a.pictures(spark, d).withColumn("c", geometry.canvas(F.col("w"), F.col("h")))
    box = F.struct(F.lit(10).alias("x0"), F.lit(20).alias("y0"), F.lit(100).alias("x1"), F.lit(111).alias("y1"))
    return p.select("id", geometry.project_box(box, F.col("c.w"), F.col("c.h"), F.col("w"), F.col("h")).alias("b")).select("id", "b.*")


@query("pick_grid", f"WITH {a.P} SELECT id, least(7, greatest(3, ceil(least(w, h) / 224.0::DOUBLE)))::INT AS grid FROM p")
def pick_grid(spark, d):
    return a.pictures(spark, d).select("id", geometry.pick_grid(F.col("w"), F.col("h")).alias("grid"))


@query("feasible_masks", f"WITH {a.P} SELECT id FROM p WHERE least(w, h) * 448::DOUBLE / greatest(w, h) >= 294")
def feasible_masks(spark, d):
    return a.pictures(spark, d).where(dims.feasible_mask(F.col("w"), F.col("h"))).select("id")


@query("vote_mean", f"WITH {a.C} SELECT img, round(avg(score), 6) AS vote FROM c GROUP BY img")
def vote_mean(spark, d):
    return rounded(votes.vote(a.crops(spark, d), ["img"]), "vote")


@query("vote_topk", f"WITH {a.C}, k AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score DESC) AS r FROM c) SELECT img, round(avg(score) FILTER (r <= 3) + 0.5 * stddev_pop(score), 6) AS vote FROM k GROUP BY img")
def vote_topk(spark, d):
    return rounded(votes.vote(a.crops(spark, d), ["img"], topk=3, alpha=0.5), "vote")


@query("vote_logit", f"WITH {a.C} SELECT img, round(1 / (1 + exp(-avg(ln((score + 1e-4) / (1 - score + 1e-4))))), 6) AS vote FROM c GROUP BY img")
def vote_logit(spark, d):
    return rounded(votes.vote(a.crops(spark, d), ["img"], logit=True), "vote")


@query("crop_rules", f"""WITH {a.C}, z AS (SELECT img, avg(m) AS size_mean FROM (SELECT img, x1 - x0 AS s, avg(score) AS m FROM c GROUP BY 1, 2) GROUP BY img),
    t AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score DESC) AS r, row_number() OVER (PARTITION BY img ORDER BY score) AS q, count(*) OVER (PARTITION BY img) AS n FROM c)
    SELECT t.img, round(avg(score), 6) AS mean, round(sum(score * (x1 - x0) * (y1 - y0)) / sum((x1 - x0) * (y1 - y0)), 6) AS area, round(median(score), 6) AS median, round(avg(score) FILTER (r <= 3), 6) AS top3, round(avg(score) FILTER (q > n // 10 AND q <= n - n // 10), 6) AS trim10, round(max(size_mean), 6) AS size_mean
    FROM t JOIN z ON z.img = t.img GROUP BY t.img""")
def crop_rules(spark, d):
    return rounded(votes.rules(a.crops(spark, d), ["img"]), "mean", "area", "median", "top3", "trim10", "size_mean")


@query("pixel_coverage", f"""WITH {a.C}, xs AS (SELECT img, x AS xl, lead(x) OVER (PARTITION BY img ORDER BY x) AS xh FROM (SELECT DISTINCT img, unnest([x0, x1]) AS x FROM c)), ys AS (SELECT img, y AS yl, lead(y) OVER (PARTITION BY img ORDER BY y) AS yh FROM (SELECT DISTINCT img, unnest([y0, y1]) AS y FROM c)),
    o AS (SELECT xs.img, xl, yl, any_value((xh - xl) * (yh - yl))::DOUBLE AS area, count(*) AS n, avg(score) AS m FROM xs JOIN ys ON ys.img = xs.img JOIN c ON c.img = xs.img AND x0 <= xl AND x1 >= xh AND y0 <= yl AND y1 >= yh GROUP BY xs.img, xl, yl)
    SELECT img, round(sum(m * area) / sum(area), 6) AS pixel, min(n)::INT AS least, max(n)::INT AS most, round(sum(n * area) / sum(area), 6) AS mean_cover FROM o GROUP BY img""")
def pixel_coverage(spark, d):
    return rounded(votes.coverage(a.crops(spark, d), ["img"]), "pixel", "mean_cover")


# --- scalars ------------------------------------------------------------------------------------------------------


@query("path_norm", r"SELECT page_id, regexp_replace(replace('././a\' || url, '\', '/'), '^(\./)+', '') AS p FROM pages")
def path_norm(spark, d):
    return a.table(spark, d, "pages").select("page_id", dims.norm_path(F.concat(F.lit("././a\\"), F.col("url"))).alias("p"))


@query("generator_norm", "SELECT DISTINCT lower(replace(replace(p_type, '_', ''), '-', '')) AS g FROM part")
def generator_norm(spark, d):
    return a.table(spark, d, "part").select(dims.norm_generator(F.col("p_type")).alias("g")).distinct()


@query("mode_size", f"WITH {a.P} SELECT w, h FROM (SELECT w, h, count(*) AS n FROM p GROUP BY w, h ORDER BY n DESC, w, h LIMIT 1)")
def mode_size(spark, d):
    return a.pictures(spark, d).groupBy("w", "h").count().orderBy(F.desc("count"), "w", "h").limit(1).select("w", "h")


@query("seeded_unit", "SELECT doc_id, ('0x' || substr(md5('u|' || doc_id), 1, 8))::BIGINT::DOUBLE / 4294967296::DOUBLE AS u FROM documents")
def seeded_unit(spark, d):
    from curata.functions.seeded import unit

    return a.table(spark, d, "documents").select("doc_id", unit("u", F.col("doc_id")).alias("u"))


@query("weighted_choice", "SELECT c, count(*) AS n FROM (SELECT CASE WHEN u < 0.5 THEN 'a' WHEN u < 0.8 THEN 'b' ELSE 'c' END AS c FROM (SELECT ('0x' || substr(md5('w|' || doc_id), 1, 8))::BIGINT::DOUBLE / 4294967296::DOUBLE AS u FROM documents)) GROUP BY c")
def weighted_choice(spark, d):
    from curata.functions.seeded import choose, unit

    return a.table(spark, d, "documents").select(choose(unit("w", F.col("doc_id")), [("a", 5), ("b", 3), ("c", 2)]).alias("c")).groupBy("c").agg(F.count("*").alias("n"))


@query("json_props", "SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def json_props(spark, d):
    return a.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("explode_models", "SELECT o_orderkey, k, v FROM (SELECT o_orderkey, unnest(['status', 'priority']) AS k, unnest([o_orderstatus, o_orderpriority]) AS v FROM orders)")
def explode_models(spark, d):
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in (("status", "o_orderstatus"), ("priority", "o_orderpriority"))))
    return a.table(spark, d, "orders").select("o_orderkey", F.explode(pairs).alias("p")).select("o_orderkey", "p.*")


# --- the large manifest -------------------------------------------------------------------------------------------


@query("large_bucket_balance", f"WITH {a.L} SELECT bucket, {COUNTS} FROM b GROUP BY bucket")
def large_bucket_balance(spark, d):
    return audit.class_counts(a.large(spark, d), ["bucket"])


@query("large_auroc", f"WITH {a.L}, sc AS (SELECT label, score, bucket AS cond FROM b), {DISTINCT}, {AUROC} SELECT cond, round(auroc, 6) AS auroc FROM ar")
def large_auroc(spark, d):
    return rounded(metrics.auroc(a.large(spark, d).withColumnRenamed("bucket", "cond"), ["cond"]), "auroc")


@query("large_balance", f"WITH {a.L} SELECT bucket, 2 * least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) AS kept FROM b GROUP BY bucket")
def large_balance(spark, d):
    return curate.balanced(a.large(spark, d), 1).where("kept").groupBy("bucket").agg(F.count("*").alias("kept"))


@query("large_top_sources", f"WITH {a.L} SELECT bucket, source, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, source) AS rank FROM (SELECT bucket, source, count(*) AS n FROM b GROUP BY 1, 2)) WHERE rank <= 5")
def large_top_sources(spark, d):
    return audit.top_n(a.large(spark, d), ["bucket"], "source", 5)


# --- learned and pixel operators: no SQL --------------------------------------------------------------------------


def features(spark, d):
    e = a.table(spark, d, "embeddings")
    return e.select("vec_id", F.when(F.col("label") < 5, 0).otherwise(1).alias("label"), F.col("embedding").cast("array<double>").alias("features"))


@query("lr_shortcut_audit")
def lr_shortcut_audit(spark, d):
    return learn.shortcut_audit(features(spark, d), "vec_id")


@query("mahalanobis_oneclass")
def mahalanobis_oneclass(spark, d):
    return learn.one_class(features(spark, d), "vec_id")


@query("stacker")
def stacker(spark, d):
    return learn.stack(a.scores(spark, d).withColumnRenamed("cond", "model"), "path", a.CONDITIONS)


@query("stacker_choice")
def stacker_choice(spark, d):
    return learn.stack_choice(a.scores(spark, d).withColumnRenamed("cond", "model"), "path", a.CONDITIONS)


@query("linear_head")
def linear_head(spark, d):
    return learn.out_of_fold(features(spark, d), "vec_id")


@query("stream_dedup", "SELECT user_id, event_type FROM events GROUP BY user_id, event_type")
def stream_dedup(spark, d):
    """The stream's rows at its end are the batch's: the query runs over the same folder to its end and reads the result."""
    import uuid

    from curata.session import shared_dir
    from curata.streaming.dedup import new_rows, read_stream

    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = read_stream(spark, f"{d}/events.parquet", a.table(spark, d, "events").schema).select(F.concat_ws("|", "user_id", "event_type").alias("key"), "user_id", "event_type")
    done = new_rows(stream, "key").writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("user_id", "event_type")


from curata.plans import corpus_queries, harness_queries, report_queries, structure_queries  # noqa: E402,F401  register theirs
