"""Queries over groups, order statistics, skips, paths, runs and documents of uneven shape, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.functions import paths
from curata.functions.hashes import simhash
from curata.functions.seeded import order_key
from curata.operators import groups, order_statistics, runs, skips
from curata.plans import adapters as a
from curata.plans.queries import query
from curata.session import written
from curata.sources import documents

SIMHASH = r"""w AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[\x20\x09-\x0D]+')) AS w FROM documents) WHERE w <> ''),
    bits AS (SELECT doc_id, i, 2 * sum((x >> i::INT) & 1) > count(*) AS bit FROM (SELECT doc_id, ('0x' || substr(md5(w), 1, 15))::BIGINT AS x FROM w), (SELECT unnest(range(60)) AS i) GROUP BY doc_id, i),
    s AS (SELECT d.doc_id AS id, coalesce(h, 0) AS dhash FROM documents d LEFT JOIN (SELECT doc_id, sum(CASE WHEN bit THEN 1::BIGINT << i::INT ELSE 0 END)::BIGINT AS h FROM bits GROUP BY doc_id) f ON f.doc_id = d.doc_id)"""


@query("near_groups", f"""WITH RECURSIVE {SIMHASH}, c AS (SELECT dhash, min(id) AS least, count(*) AS copies FROM s WHERE dhash NOT IN (0, -1) GROUP BY dhash),
    l AS (SELECT x.dhash AS a, y.dhash AS b FROM c x, c y WHERE x.dhash <> y.dhash AND bit_count(xor(x.dhash, y.dhash)) <= 4),
    reach AS (SELECT dhash AS node, dhash AS other FROM c UNION SELECT r.node, l.b FROM reach r JOIN l ON l.a = r.other),
    g AS (SELECT node, min(least) AS group_id, sum(copies)::BIGINT AS group_rows FROM reach JOIN c ON c.dhash = other GROUP BY node)
    SELECT id, coalesce(group_id, id) AS group_id, coalesce(group_rows, 1) AS group_rows, coalesce(copies, 1) AS copies, (SELECT count(*) FROM l WHERE l.a = s.dhash) AS links
    FROM s LEFT JOIN c ON c.dhash = s.dhash LEFT JOIN g ON g.node = s.dhash""")
def near_groups(spark, d):
    docs = a.table(spark, d, "documents")
    return groups.near_groups(docs.select(F.col("doc_id").alias("id"), simhash(F.col("text")).alias("dhash")), 4)


@query("upper_median", "SELECT source, list_sort(list(n_chars))[count(*) // 2 + 1] AS upper FROM documents GROUP BY source")
def upper_median(spark, d):
    return order_statistics.upper_median(a.table(spark, d, "documents"), ["source"], "n_chars").withColumnRenamed("value", "upper")


@query("price_order_statistics", """SELECT l_returnflag, l_linestatus, list_sort(list(l_extendedprice))[1 + (count(*) - 1) // 10] AS tenth, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS upper
    FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def price_order_statistics(spark, d):
    rows, by = a.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]
    tenth = order_statistics.order_statistic(rows, by, "l_extendedprice", 1 + F.floor((F.col("n") - 1) / 10)).withColumnRenamed("value", "tenth")
    return tenth.join(order_statistics.upper_median(rows, by, "l_extendedprice").withColumnRenamed("value", "upper"), by)


@query("bottom_sample", "SELECT doc_id, source, n_chars FROM documents ORDER BY md5('7|' || doc_id) LIMIT 150")
def bottom_sample(spark, d):
    return order_statistics.bottom_k(a.table(spark, d, "documents").select("doc_id", "source", "n_chars"), order_key(7, F.col("doc_id")), 150)


#: Documents of a source on the list are excluded; the list has its paths in other forms.
EXCLUDED = "SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'unreadable' WHEN n_chars < 400 THEN 'too small' WHEN source IN (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 1) THEN 'excluded' ELSE 'kept' END AS reason, source FROM documents"


def _skipping(spark, d):
    docs = a.table(spark, d, "documents").select("doc_id", "text", "n_chars", "source").withColumn("path", F.concat(F.lit("in/"), "source", F.lit("/"), "doc_id"))
    top = docs.groupBy("source").count().orderBy(F.desc("count"), "source").limit(1).select(F.col("source").alias("s"))
    listed = docs.join(top, F.col("source") == F.col("s")).select(F.concat(F.lit("./in//x/../"), "source", F.lit("/"), "doc_id").alias("path"))
    marked = skips.excluding(docs, listed)
    reasons = {"unreadable": F.trim(F.coalesce("text", F.lit(""))) == "", "too small": F.col("n_chars") < 400, "excluded": F.col("__excluded")}
    return skips.skipping(marked, reasons)


@query("skip_counts", f"SELECT reason, count(n.doc_id) AS n FROM (VALUES ('kept'), ('unreadable'), ('too small'), ('excluded')) r(reason) LEFT JOIN ({EXCLUDED}) n USING (reason) GROUP BY reason")
def skip_counts(spark, d):
    kept, seen = _skipping(spark, d)
    written(kept.select("doc_id"))
    return skips.counts(spark, seen)


@query("unskipped", f"SELECT doc_id, source FROM ({EXCLUDED}) WHERE reason = 'kept'")
def unskipped(spark, d):
    return _skipping(spark, d)[0].select("doc_id", "source")


def _fold(parts: str, absolute: str) -> str:
    return f"""list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split({parts}, '/'), lambda x: [x])), lambda s, x: CASE WHEN x[1] IN ('', '.') THEN s
        WHEN x[1] = '..' THEN CASE WHEN len(s) > 0 AND s[len(s)] <> '..' THEN s[1:len(s) - 1] WHEN {absolute} THEN s ELSE list_append(s, '..') END ELSE list_append(s, x[1]) END)"""


@query("path_forms", rf"""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '') AS p, url FROM pages),
    q AS (SELECT page_id, p, CASE page_id % 3 WHEN 0 THEN '/srv//./data' || p || '/../../x' || page_id || '.tar.gz' WHEN 1 THEN './a/../..' || p || '/./.h' || page_id ELSE '/../..' || p || '//' END AS path, '/srv/' || (page_id % 5) || '/data' AS start FROM u),
    f AS (SELECT *, {_fold('path', "path LIKE '/%'")} AS s, {_fold('start', 'true')} AS t, {_fold("'/' || p", 'true')} AS us FROM q),
    k AS (SELECT *, CASE WHEN path LIKE '/%' THEN '/' ELSE '' END || array_to_string(s, '/') AS n, coalesce(list_position(list_transform(range(1, least(len(s), len(t)) + 1), lambda i: s[i] = t[i]), false) - 1, least(len(s), len(t))) AS shared FROM f)
    SELECT page_id, CASE WHEN n = '' THEN '.' ELSE n END AS norm, regexp_extract(path, '([^/]*)$', 1) AS base, CASE WHEN regexp_matches(regexp_extract(path, '^(.*/)[^/]*$', 1), '^/*$') THEN regexp_extract(path, '^(.*/)[^/]*$', 1) ELSE regexp_replace(regexp_extract(path, '^(.*/)[^/]*$', 1), '/+$', '') END AS dir,
        regexp_extract(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^\.+', ''), '(\.[^.]*)$', 1) AS ext,
        CASE WHEN path LIKE '/%' THEN CASE WHEN s = t THEN '.' ELSE array_to_string(list_concat(list_transform(range(len(t) - shared), lambda i: '..'), s[shared + 1:]), '/') END END AS rel,
        CASE WHEN len(us) = 0 THEN '/' ELSE '/' || array_to_string(us, '/') END AS url_path FROM k""")
def path_forms(spark, d):
    n, p = F.col("page_id"), F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    path = F.when(n % 3 == 0, F.concat(F.lit("/srv//./data"), p, F.lit("/../../x"), n, F.lit(".tar.gz"))).when(n % 3 == 1, F.concat(F.lit("./a/../.."), p, F.lit("/./.h"), n)).otherwise(F.concat(F.lit("/../.."), p, F.lit("//")))
    rows = a.table(spark, d, "pages").select(n, path.alias("path"), F.concat(F.lit("/srv/"), n % 5, F.lit("/data")).alias("start"), "url")
    c = F.col("path")
    return rows.select("page_id", paths.normpath(c).alias("norm"), paths.basename(c).alias("base"), paths.dirname(c).alias("dir"), paths.extension(c).alias("ext"), paths.relpath(c, F.col("start")).alias("rel"), paths.url_path(F.col("url")).alias("url_path"))


@query("crop_runs", f"""WITH {a.C}, o AS (SELECT img, hit, row_number() OVER w - 1 AS k FROM (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS hit FROM c) WINDOW w AS (PARTITION BY img ORDER BY y0, x0, hit)),
    b AS (SELECT *, CASE WHEN lag(hit) OVER w IS DISTINCT FROM hit THEN 1 ELSE 0 END AS new FROM o WINDOW w AS (PARTITION BY img ORDER BY k)),
    n AS (SELECT *, sum(new) OVER (PARTITION BY img ORDER BY k) - 1 AS run FROM b)
    SELECT img, any_value(hit) AS hit, run::INT AS run, min(k) AS start, count(*) AS length FROM n GROUP BY img, run""")
def crop_runs(spark, d):
    rows = a.crops(spark, d).select("img", "y0", "x0", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("hit"))
    return runs.runs(rows, "img", ["y0", "x0", "hit"], "hit")


#: A document of results for each source, in one of three versions: by condition; as a list; with text for numbers.
RESULTS = """SELECT source, CASE (row_number() OVER (ORDER BY source)) % 3
    WHEN 0 THEN '{"model": "' || source || '", "conditions": {' || string_agg('"' || lang || '": {"n": ' || n || ', "chars": ' || c || '}', ', ') || '}}'
    WHEN 1 THEN '{"version": 2, "model": {"name": "' || source || '"}, "results": [' || string_agg('{"condition": "' || lang || '", "metrics": {"n": ' || n || '}}', ', ') || ']}'
    ELSE '{"version": 3, "model": {"name": "' || source || '", "note": null}, "conditions": {' || string_agg('"' || lang || '": {"n": "' || n || '", "chars": null}', ', ') || '}, "extra": [1, {}]}' END AS j
    FROM (SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS c FROM documents WHERE lang IS NOT NULL GROUP BY source, lang) GROUP BY source"""


@query("result_documents", f"""WITH j AS ({RESULTS}), o AS (
    SELECT coalesce(json_extract_string(j, '$.model.name'), json_extract_string(j, '$.model')) AS model, e.key AS cond, e.value AS m FROM j, json_each(j.j, '$.conditions') e
    UNION ALL SELECT json_extract_string(j, '$.model.name'), json_extract_string(e.value, '$.condition'), json_extract(e.value, '$.metrics') FROM j, json_each(j.j, '$.results') e)
    SELECT model, cond, e.key AS metric, json_extract_string(e.value, '$')::DOUBLE AS value FROM o, json_each(o.m) e""")
def result_documents(spark, d):
    cells = a.table(spark, d, "documents").where("lang IS NOT NULL").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"))
    sources = cells.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("lang", "n", "c"))).alias("x"))
    ranked = sources.selectExpr("source", "x", "row_number() OVER (ORDER BY source) % 3 AS version")  # a row a source
    each = lambda f: F.concat_ws(", ", F.transform("x", f))
    say = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in p))
    one = say('{"model": "', F.col("source"), '", "conditions": {', each(lambda x: say('"', x["lang"], '": {"n": ', x["n"], ', "chars": ', x["c"], "}")), "}}")
    two = say('{"version": 2, "model": {"name": "', F.col("source"), '"}, "results": [', each(lambda x: say('{"condition": "', x["lang"], '", "metrics": {"n": ', x["n"], "}}")), "]}")
    three = say('{"version": 3, "model": {"name": "', F.col("source"), '", "note": null}, "conditions": {', each(lambda x: say('"', x["lang"], '": {"n": "', x["n"], '", "chars": null}')), '}, "extra": [1, {}]}')
    texts = ranked.select(F.when(F.col("version") == 0, one).when(F.col("version") == 1, two).otherwise(three).alias("text"))
    return documents.results_of(texts)
