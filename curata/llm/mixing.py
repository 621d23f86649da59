"""Operator 9 [native]: mixing sources to target weights by Poisson replication.

A source of n documents with weight w of the whole W is to make up the share w / W of ``budget`` rows (all rows of the
table, unless given), so its mean repetition rate is budget * w / (W * n). Each document draws a number in [0, 1) from
the MD5 of (seed, id), and inverts the Poisson distribution with that rate: its count is the number of values of the
cumulative distribution that are not above the draw. The document is exploded by its count and all copies are shuffled
by another MD5, of (seed, id, copy). The draws depend on nothing else, so a rerun or a lost executor gives the same rows.

The cumulative distribution is made once for each source, up to where it rounds to 1; rates over MAX_RATE are drawn as a
sum of several Poisson numbers, since e^-rate would vanish. Weights default to 1 for each source; a source without a
weight in ``weights`` is left out. Null is a source of its own. A row with a null id draws by its text, so that such rows
do not all draw alike; rows that share an id (or, without one, their text) do, and share their place in the order. Texts
of any length and null texts are only carried along. An empty table stays empty. Columns keep their names, but for those
called as the new ones, which mix() replaces. Only DataFrame functions are used, and the rates join the documents as a
table: Spark broadcasts it when it measures it to be small, and splits a hot source's partition otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.common import staged

MAX_RATE = 500.0
SEED = 20240601


def draw(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of the parts joined by bars."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(documents: DataFrame, weights: DataFrame | None = None, budget: float | None = None) -> DataFrame:
    """source, rate, pieces and cdf, the cumulative distribution of a piece of the rate."""
    sizes = staged(documents.groupBy("source").agg(F.count("*").alias("n")), "sizes")
    if weights is None:
        sizes = sizes.withColumn("weight", F.lit(1.0))
    else:
        given = weights.select(F.col("source").alias("__source"), F.col("weight").cast("double").alias("weight")).where("weight > 0")
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    whole = sizes.agg(F.sum("weight").alias("w"), F.sum("n").alias("n")).first()
    total = float(whole["n"] or 0) if budget is None else float(budget)
    rated = sizes.select("source", (F.lit(total) * F.col("weight") / (F.lit(float(whole["w"] or 1)) * F.col("n"))).alias("rate"))
    pieces = rated.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_RATE)).cast("int")).withColumn("part", F.col("rate") / F.col("pieces"))
    cdf = """
        aggregate(
            sequence(1, cast(ceil(part + 12 * sqrt(part) + 24) as int)),
            named_struct('p', exp(-part), 'c', exp(-part), 'all', array(exp(-part))),
            (s, k) -> named_struct('p', s.p * part / k, 'c', s.c + s.p * part / k, 'all', array_append(s.all, s.c + s.p * part / k)),
            s -> s.all)
    """
    return pieces.select("source", "rate", "pieces", F.expr(cdf).alias("cdf"))


def _position(documents: DataFrame, name: str) -> int | None:
    lower = [c.lower() for c in documents.columns]
    return documents.columns.index(name) if name in documents.columns else lower.index(name) if name in lower else None


def _mixed(documents: DataFrame, weights: DataFrame | None, budget: float | None, seed: int) -> DataFrame:
    """The copies with columns c0, c1, .. for those of ``documents``, and copy, copies and order."""
    names = [f"c{k}" for k in range(len(documents.columns))]  # a column may have any name
    rows = documents.toDF(*names)
    at = {c: _position(documents, c) for c in ("source", "doc_id", "text")}
    source, doc_id = (F.col(names[at[c]]) for c in ("source", "doc_id"))
    text = F.col(names[at["text"]]) if at["text"] is not None else F.lit("")
    # a row without an id draws by its text
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("#"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))))
    table = rates(rows.select(source.alias("source")), weights, budget).withColumnRenamed("source", "__source")
    joined = rows.join(table, source.eqNullSafe(F.col("__source")))
    drawn = joined.withColumn("draws", F.transform(F.sequence(F.lit(1), F.col("pieces")), lambda j: draw(F.lit(seed), key, j)))
    counted = drawn.withColumn("copies", F.expr("aggregate(draws, 0L, (n, u) -> n + size(filter(cdf, c -> c <= u)))")).where("copies > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}|order"), key, F.col("copy").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    out = copies.select(*names, "copy", "copies", order.alias("order"))
    return out.repartition("order").sortWithinPartitions("order", "copy")


def mix(documents: DataFrame, weights: DataFrame | None = None, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """``documents`` with __copy (from 1), __copies and __order, shuffled by __order: as many rows as each drew."""
    new = ["__copy", "__copies", "__order"]
    kept = [k for k, c in enumerate(documents.columns) if c.lower() not in new]
    rows = _mixed(documents, weights, budget, seed).select(*(f"c{k}" for k in kept), "copy", "copies", "order")
    return rows.toDF(*(documents.columns[k] for k in kept), *new)


def replicated(documents: DataFrame, weights: DataFrame | None = None, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """The rows of mix() with the columns of ``documents``."""
    return _mixed(documents, weights, budget, seed).drop("copy", "copies", "order").toDF(*documents.columns)


#: DuckDB SQL of mix() with default weights over ``documents``.
SQL = f"""
    WITH RECURSIVE s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
    r AS (SELECT source, (SELECT sum(n) FROM s)::DOUBLE * 1.0::DOUBLE / ((SELECT count(*) FROM s)::DOUBLE * n) AS rate FROM s),
    c AS (
        SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM r
        UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM c WHERE k < ceil(rate + 12 * sqrt(rate) + 24)
    ), d AS (
        SELECT *, ('0x' || substr(md5('{SEED}|' || doc_id || '|1'), 1, 13))::BIGINT::DOUBLE / {1 << 52}::DOUBLE AS u FROM documents
    ), n AS (
        SELECT d.doc_id, any_value(d.source) AS source, count(*) AS n_copies FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND c.c <= d.u GROUP BY d.doc_id
    )
    SELECT n.doc_id, n.source, d.lang, d.n_chars, d.text, e.copy, n.n_copies, ('0x' || substr(md5('{SEED}|order|' || n.doc_id || '|' || e.copy), 1, 15))::BIGINT AS shuffle_order
    FROM n JOIN documents d ON d.doc_id = n.doc_id, LATERAL (SELECT unnest(range(1, n.n_copies + 1)) AS copy) e
"""
