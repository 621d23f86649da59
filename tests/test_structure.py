"""Groups, order statistics, skips, paths, runs and documents, against plain versions of their definitions."""

import itertools
import json
import math
import posixpath
import random

import pytest
from pyspark.sql import functions as F

from curata.functions import paths
from curata.functions.seeded import order_key
from curata.operators import curate, groups, order_statistics, runs, skips
from curata.sources import documents


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def clusters(seed, n=120):
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(n)]
    for k in range(n):  # chains of near hashes
        h = out[k]
        for _ in range(r.choice([0, 0, 1, 3])):
            for b in r.sample(range(64), r.randint(1, 6)):
                h ^= 1 << b
            out.append(h)
    return [signed(h) for h in out]


@pytest.mark.parametrize("distance,blocks", [(4, None), (4, 5), (4, 8), (2, 3), (3, 7), (0, 5)])
def test_near_links(spark, distance, blocks):
    hashes = clusters(1)
    got = groups.near_links(spark.createDataFrame([(h,) for h in set(hashes)], "dhash long"), distance, blocks).collect()
    want = {(a, b): (a ^ b).bit_count() if (a ^ b) >= 0 else ((a ^ b) % (1 << 64)).bit_count() for a, b in itertools.combinations(sorted(set(hashes)), 2)}
    assert sorted(map(tuple, got)) == sorted((a, b, d) for (a, b), d in want.items() if d <= distance)


def test_blocks_grow_with_hashes():
    assert [groups.blocks_for(n, 4) for n in (10, 10**4, 10**6, 10**8, 10**9)] == sorted(groups.blocks_for(n, 4) for n in (10, 10**4, 10**6, 10**8, 10**9))
    assert groups.blocks_for(10, 4) == 5 and groups.blocks_for(10**9, 4) >= 8


def plain_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    least = {}
    for x in list(parent):
        least[find(x)] = min(least.get(find(x), x), x)
    return sorted((x, least[find(x)]) for x in parent)


@pytest.mark.parametrize("edges", [[], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 80)], [(5, 5), (7, 5), (5, 7), (9, 8)], [(a * 7 % 101, b * 13 % 101) for a, b in zip(range(90), range(5, 95))]])
def test_components(spark, edges):
    got = groups.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == plain_components([e for e in edges if e[0] != e[1]])


def test_near_groups_of_copies(spark):
    """Thousands of copies are a row each, and no pairs."""
    rows = [(k, 5) for k in range(3000)] + [(3001, 4), (3002, 1 << 40), (3003, None), (3004, 0), (3005, 0), (3006, -1)]
    got = {r["id"]: tuple(r)[1:] for r in groups.near_groups(spark.createDataFrame(rows, "id long, dhash long"), 2).collect()}
    assert len(got) == len(rows)
    assert all(got[k] == (0, 3002, 3000, 1) for k in range(3000)) and got[3001] == (0, 3002, 1, 2) and got[3002] == (0, 3002, 1, 1)
    assert all(got[k] == (k, 1, 1, 0) for k in range(3003, 3007))
    assert groups.near_groups(spark.createDataFrame([], "id long, dhash long")).count() == 0


def ranked_value(values, k):
    held = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v) if isinstance(v, float) else False, v))
    return held[k - 1] if 1 <= k <= len(held) else None


@pytest.mark.parametrize("kind", ["long", "int", "double", "decimal(20,4)", "date", "float"])
def test_order_statistics(spark, kind):
    from datetime import date, timedelta
    from decimal import Decimal

    r = random.Random(kind)
    make = {
        "long": lambda: r.choice([r.getrandbits(63) - (1 << 62), 2**63 - 1, -(2**63), 2**53 + r.randrange(4), 7]),
        "int": lambda: r.randrange(-9, 9),
        "double": lambda: r.choice([r.gauss(0, 1), 1e308, -1e308, float("inf"), float("-inf"), float("nan"), 1e-300, 0.5, 2.0 ** r.randrange(-900, 900)]),
        "decimal(20,4)": lambda: Decimal(r.randrange(-(10**18), 10**18)).scaleb(-4),
        "date": lambda: date(1900, 1, 1) + timedelta(r.randrange(60_000)),
        "float": lambda: float(r.randrange(100)) / 4,
    }[kind]
    rows = [(g, None if r.random() < 0.1 else make()) for g in (None, "a", "b", "c") for _ in range({None: 30, "a": 400, "b": 1, "c": 77}[g])]
    df = spark.createDataFrame(rows, f"g string, x {kind}")
    if kind == "date":
        df, rows = df.withColumn("x", F.unix_date("x")), [(g, None if x is None else (x - date(1970, 1, 1)).days) for g, x in rows]
    for rank, of in ((F.floor(F.col("n") / 2) + 1, lambda n: n // 2 + 1), (F.lit(3), lambda n: 3), (F.col("n"), lambda n: n)):
        got = {r["g"]: r["value"] for r in order_statistics.order_statistic(df, ["g"], "x", rank, bins=16).collect()}
        for g in (None, "a", "b", "c"):
            values = [x for k, x in rows if k == g]
            n = sum(x is not None for x in values)
            want = ranked_value(values, of(n))
            assert (got.get(g) == want or (want != want and got[g] != got[g])), (kind, g, got.get(g), want)


def test_median_has_no_percentile(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1009).alias("x"))
    out = order_statistics.upper_median(df, ["g"], "x")
    assert "percentile" not in out._jdf.queryExecution().toString().lower()
    plain = {g: sorted(k * 7919 % 1009 for k in range(1000) if k % 3 == g) for g in range(3)}
    assert {r["g"]: r["value"] for r in out.collect()} == {g: v[len(v) // 2] for g, v in plain.items()}


@pytest.mark.parametrize("k", [0, 1, 17, 500, 900])
def test_bottom_k_is_seeded_limit(spark, k):
    rows = spark.range(500).select(F.concat(F.lit("p"), "id").alias("path")).repartition(4)
    out = order_statistics.bottom_k(rows, order_key(5, F.col("path")), k)
    want = {r["path"] for r in curate.seeded_limit(rows, k, 5).collect()}
    assert {r["path"] for r in out.collect()} == want and len(want) == min(k, 500)


def test_shuffle_buffer(spark):
    rows = spark.range(2000, numPartitions=3).select("id", (F.col("id") * 2).alias("v"))
    one, two, other = (order_statistics.shuffle_buffer(rows, 100, seed) for seed in (1, 1, 2))
    a, b, c = ([tuple(r) for r in x.collect()] for x in (one, two, other))
    assert a == b != c and sorted(a) == sorted(c) == [(k, 2 * k) for k in range(2000)] and a != sorted(a)
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    assert [r["id"] for r in order_statistics.shuffle_buffer(rows, 0, 1).collect()] == list(range(2000))


def test_skips_are_counted_in_the_pass_that_drops(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        reads.add(1)
        return x

    rows = spark.range(100).select(seen.asNondeterministic()("id").alias("id"), F.concat(F.lit("a/./"), "id").alias("path"))
    marked = skips.excluding(rows, spark.createDataFrame([("a//7",), ("a/b/../8",), ("a/8",), ("gone",)], "path string"))
    kept, counted = skips.skipping(marked, {"small": F.col("id") < 5, "odd": F.col("id") % 2 == 1, "never": F.lit(None).cast("boolean"), "listed": F.col("__excluded")})
    kept.write.parquet(str(tmp_path / "kept"))
    assert counted.get == {"kept": 46, "small": 5, "odd": 48, "never": 0, "listed": 1} and reads.value == 100
    assert {r["reason"]: r["n"] for r in skips.counts(spark, counted).collect()} == counted.get
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 46


PATHS = ["", ".", "/", "//", "a", "a/", "a//b", "./a", "../a", "a/..", "a/../..", "/..", "/../a/./b/", "a/b/../../../c", "/a/b/c", "/a/x", "é/漢/..", "a/...", ".hidden", "x.tar.gz", "dir.d/name", "..x", "/a/.b.", "a b/c"]


def test_paths(spark):
    pairs = [(p, s) for p in PATHS for s in ("/", "/a/b", "a", "../x", ".", "a/b/../c")]
    c, s = F.col("p"), F.col("s")
    got = spark.createDataFrame(pairs, "p string, s string").select("p", "s", paths.normpath(c).alias("n"), paths.basename(c).alias("b"), paths.dirname(c).alias("d"), paths.extension(c).alias("e"), paths.relpath(c, s).alias("r")).collect()
    for r in got:
        p, start = r["p"], r["s"]
        norm = posixpath.normpath(p)
        assert r["n"] == ("/" + norm.lstrip("/") if norm.startswith("/") else norm), p
        assert (r["d"], r["b"]) == posixpath.split(p) and r["e"] == posixpath.splitext(p)[1], p
        if p.startswith("/") != start.startswith("/"):
            assert r["r"] is None
        elif ".." not in posixpath.normpath(start) and not posixpath.normpath(p).startswith(".."):
            assert r["r"] == posixpath.relpath(p or ".", start), (p, start)
    assert spark.createDataFrame([(None,)], "p string").select(paths.normpath(F.col("p"))).first()[0] is None


def test_urls(spark):
    urls = {"https://x.org/a/b?c=d#e": "/a/b", "http://x.org": "/", "s3://bucket/k%20e/../y": "/y", "a+b/c": "/a+b/c", "file:///tmp/./z": "/tmp/z", "https://x.org/%zz": "/%zz"}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", paths.url_path(F.col("u")).alias("p")).collect()
    assert {r["u"]: r["p"] for r in got} == urls


def test_runs(spark):
    r = random.Random(3)
    rows = [(g, k, r.choice(["x", "y", None])) for g in (1, 2, None) for k in range(50)]
    got = sorted((tuple(x) for x in runs.runs(spark.createDataFrame(rows, "g long, k long, v string"), "g", ["k"], "v").collect()), key=repr)
    want = []
    for g in (1, 2, None):
        at = 0
        for n, (v, run) in enumerate(itertools.groupby(x[2] for x in rows if x[0] == g)):
            size = len(list(run))
            want.append((g, v, n, at, size))
            at += size
    assert got == sorted(want, key=repr)
    with pytest.raises(Exception, match="no column"):
        runs.runs(spark.createDataFrame(rows, "g long, k long, v string"), "g", ["k"], "nothing").collect()


def test_results_of_three_versions(spark, tmp_path):
    texts = [
        {"model": "a", "conditions": {"clean": {"auroc": 0.5, "n": 3}, "blur": {}}},
        {"version": 2, "model": {"name": "b"}, "results": [{"condition": "clean", "metrics": {"auroc": "0.75"}}, {"condition": "x"}]},
        {"version": 3, "model": {"name": "c"}, "conditions": {"clean": {"auroc": None, "note": "none", "list": [1]}}, "extra": 1},
        {"model": "d"},
    ]
    for k, t in enumerate(texts):
        (tmp_path / f"{k}.json").write_text(json.dumps(t, indent=1))
    (tmp_path / "bad.json").write_text("{")
    got = documents.read_results(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("a", "clean", "auroc", 0.5), ("a", "clean", "n", 3.0), ("b", "clean", "auroc", 0.75), ("c", "clean", "auroc", None), ("c", "clean", "note", None), ("c", "clean", "list", None)], key=repr)
    rows = documents.read_documents(spark, str(tmp_path))
    assert rows.where("doc IS NULL").count() == 1 and "results" in documents.shape(rows) and "conditions" in documents.shape(rows)
