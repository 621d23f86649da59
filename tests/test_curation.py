import random

import pytest
from pyspark.sql import functions as F

from curata.functions import dims
from curata.operators import curate, dedup, votes
from curata.plans import adapters, queries


def manifest(spark, n=400):
    r = random.Random(3)
    rows = [(f"p{i}", f"o{i % 390}", int(r.random() < 0.6), r.choice(["g1", "g2"]), r.choice(["s1", "s2", "s3"]), r.choice([0, 100, 341, 342, 700, 2000])) for i in range(n)]
    return spark.createDataFrame(rows, "path string, orig string, label int, generator string, source string, long int")


def test_buckets(spark):
    edges = [0, 1, 341, 342, 512, 513, 768, 769, 1024, 1025]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in edges], "x int").select(dims.bucket(F.col("x"))).collect()]
    assert got == [None, "<=341", "<=341", "342-512", "342-512", "513-768", "513-768", "769-1024", "769-1024", ">1024"]


def test_subject_order(spark):
    rows = spark.createDataFrame([("lsun_bedroom", ""), ("inpainting", ""), ("painting", ""), ("x", "/cat/1"), ("none", "z")], "s string, o string")
    assert [r[0] for r in rows.select(dims.subject(F.col("s"), F.lit(None).cast("string"), F.col("o"))).collect()] == ["bedroom", "other", "painting", "animals", "other"]


def test_corpus_properties(spark):
    rows = manifest(spark)
    out = curate.build_corpus([rows], seed=1, caps={"s1": 40}, test_sources={"s3"}, test_generators={"g2"}, min_bucket=4)
    got = out.collect()
    assert len({r["orig"] for r in got}) == len(got) and all(r["long"] > 0 for r in got)
    assert sum(r["source"] == "s1" for r in got) == 40
    assert all(r["split"] == "test" for r in got if r["source"] == "s3" or r["generator"] == "g2")
    for s in ("train", "val"):
        for b in {r["bucket"] for r in got}:
            labels = [r["label"] for r in got if r["split"] == s and r["bucket"] == b]
            assert labels.count(0) == labels.count(1)
    again = curate.build_corpus([rows.repartition(7)], seed=1, caps={"s1": 40}, test_sources={"s3"}, test_generators={"g2"}, min_bucket=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_first_manifest_wins(spark):
    a = spark.createDataFrame([("x", "o", 1, "", "s", 9)], manifest(spark, 1).schema)
    b = spark.createDataFrame([("a", "o", 0, "", "s", 9)], a.schema)
    assert curate.build_corpus([a, b], caps={}).select("path").collect()[0]["path"] == "x"


def test_allocation(spark):
    t = spark.createDataFrame([("a", 5), ("b", 20), ("c", 1000)], '"group" string, available long'.replace('"', "`"))
    assert {r["group"]: r["picks"] for r in curate.allocate(t, 300).collect()} == {"a": 5, "b": 20, "c": 275}


def test_hamming_joins_agree(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) - (1 << 63) for _ in range(60)]
    signed = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    probes = [(i, signed((b + (1 << 64)) % (1 << 64) ^ sum(1 << k for k in r.sample(range(64), r.randrange(7))))) for i, b in enumerate(base)] + [(900, 0), (901, -1), (902, None)]
    known = [(i, b) for i, b in enumerate(base)] + [(900, 0), (903, None)]
    a, b = (spark.createDataFrame(x, "id long, dhash long") for x in (probes, known))
    got = sorted(map(tuple, dedup.near_pairs(a, b, 4).collect()))
    assert got == sorted(map(tuple, dedup.near_pairs_brute(a, b, 4).collect())) and got


def whole_pairs(rows):
    """All pairs of rows, from pairs of classes and the classes' rows."""
    members = {side: {} for side in ("probe", "train")}
    for r in rows:
        if r["kind"] != "pair":
            members[r["kind"]].setdefault(r[f"{r['kind']}_id"], []).append(r["id"])
    return sorted((i, j, r["distance"]) for r in rows if r["kind"] == "pair" for i in members["probe"][r["probe_id"]] for j in members["train"][r["train_id"]])


def test_classes_keep_every_copy(spark, tmp_path):
    """hamming_pigeonhole: which rows are copies is in its result, so no link of a copy is lost; null texts have no class."""
    texts = {i: f"text {i % 5}" for i in range(35)} | {3: None, 36: "alone"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    probe, known = adapters.hashes(spark, str(tmp_path))
    want = sorted(map(tuple, dedup.near_pairs_brute(probe, known, 4).collect()))
    rows = queries.QUERIES["hamming_pigeonhole"](spark, str(tmp_path)).collect()
    assert whole_pairs(rows) == want and len(want) > 35 and len(rows) < len(want) + 72
    assert {(r["kind"], r["id"]) for r in rows if r["kind"] != "pair"} == {(side, i) for i in texts for side in ("probe", "train")}
    assert [(r["probe_id"], r["train_id"]) for r in rows if r["id"] == 3] == [(None, None)] * 2


def test_every_document_is_a_probe(spark, sf):
    ids = {r[0] for r in adapters.table(spark, sf, "documents").select("doc_id").collect()}
    probe, known = adapters.hashes(spark, sf)
    assert {r[0] for r in probe.select("id").collect()} == ids
    got = sorted(map(tuple, dedup.near_pairs(probe, known, 4).collect()))
    assert got == sorted(map(tuple, dedup.near_pairs_brute(probe, known, 4).collect()))
    assert {p for p, *_ in got} >= {i for i in ids if i % 7 <= 4} and any(p % 3 for p, *_ in got)
    rows = queries.QUERIES["hamming_pigeonhole"](spark, sf).collect()
    classes = [r for r in rows if r["kind"] == "pair"]  # stand for all pairs of rows
    assert sum(r["probe_rows"] * r["train_rows"] for r in classes) == len(got) and {(r["probe_id"], r["train_id"], r["distance"]) for r in classes} <= set(got)
    assert whole_pairs(rows) == got and all({r["id"] for r in rows if r["kind"] == side} == ids for side in ("probe", "train"))
    assert {r["id"] for r in queries.QUERIES["unseen_reasons"](spark, sf).collect()} == ids


def test_near_copies_are_searched(spark, tmp_path):
    r = random.Random(4)
    texts = {i: " ".join(str(r.randrange(5000)) for _ in range(600)) for i in range(30)}
    texts[18] = texts[1] + " end"  # in val; near a row of train
    texts[19] = texts[2].replace(" ", "\n", 5) + " x"  # in test
    texts[28] = texts[29]  # in val and test only
    texts[23] = " "
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, 0) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = adapters.audited(spark, str(tmp_path))
    assert {x[0] for x in dedup.near_train(rows).collect()} == {"doc/18", "doc/19"}
    named = rows.withColumn("id", F.col("path"))
    brute = dedup.near_pairs_brute(named.where("split != 'train'"), named.where("split = 'train'"))
    assert {x["probe_id"] for x in brute.collect()} == {"doc/18", "doc/19"}
    assert {x[0] for x in queries.QUERIES["drop_list"](spark, str(tmp_path)).collect()} == {f"doc/{i}" for i in (18, 19, 23, 28, 29)}
    gates = {x["gate"]: x["verdict"] for x in queries.QUERIES["corpus_audit"](spark, str(tmp_path)).collect()}
    assert gates == {g: "FAIL" for g in ("files", "duplicates", "near-duplicates val", "near-duplicates test")}


def test_the_whole_manifest_is_joined(spark, sf):
    got = queries.QUERIES["scores_manifest_join"](spark, sf).collect()
    assert got and all(x["matched"] == x["n"] for x in got)
    errors = queries.QUERIES["errors_orig_join"](spark, sf).collect()
    assert errors and all(x["orig"] == f"src/{int(x['path'][4:]) // 2}" for x in errors)
    scores = spark.createDataFrame([("./a", "clean"), ("./b", "clean")], "path string, cond string")
    rows = spark.createDataFrame([("a", "o", 7)], "path string, orig string, long int")
    assert [tuple(x) for x in curate.scores_by_condition(scores, rows).collect()] == [("clean", 2, 1, 7)]
    assert sorted(map(tuple, curate.with_orig(spark.createDataFrame([("a",), ("b",)], "path string"), rows).collect())) == [("a", "o"), ("b", "")]


def test_specs():
    s = votes.parse_spec("vote(k=3,a=0.5,L=320)+noise+net:w.bin")
    assert s.base == "net" and s.weights == "w.bin" and s.wrappers == (("vote", (("topk", 3), ("alpha", 0.5), ("long", 320))), ("noise", ()))
    for bad in ("vote(z=1)+net", "zoom+net", "vote(k)+net", ""):
        with pytest.raises(ValueError):
            votes.parse_spec(bad)


def test_coverage(spark):
    rows = spark.createDataFrame([(1, 0, 0, 4, 4, 0.2), (1, 2, 0, 6, 4, 0.8)], "img int, x0 int, y0 int, x1 int, y1 int, score double")
    got = votes.coverage(rows, ["img"]).first()
    assert got["pixel"] == pytest.approx((8 * 0.2 + 8 * 0.5 + 8 * 0.8) / 24) and (got["least"], got["most"]) == (1, 2)


@pytest.mark.parametrize("few", [False, True])
def test_cuts_are_ranks(spark, few):
    """The first rows of strata by comparison with the last one, as by ranks: limits of all kinds, null strata, repeated keys."""
    from pyspark.sql import functions as F

    from curata.functions.seeded import order_key

    r = random.Random(4)
    rows = [(r.choice([None, "a", "b", "c"]), r.choice([0, 1, None]), f"p{r.randrange(150)}", k) for k in range(400)]
    df = spark.createDataFrame(rows, "s string, t int, path string, k long")
    limits = lambda strata: strata.withColumns({"few": F.lit(3), "half": F.floor(F.col("n") / 2), "none": F.lit(0), "all": F.col("n") + 5, "less": F.lit(-1), "null": F.lit(None).cast("long")})
    got = curate.cut(df, ["s", "t"], order_key(1, F.col("path")), limits, few=few).collect()
    ranks = {x["k"]: x["rn"] for x in curate.ranked(df, ["s", "t"], 1).collect()}
    assert sorted(x["k"] for x in got) == list(range(400))
    for stratum in {(x["s"], x["t"]) for x in got}:
        own = [x for x in got if (x["s"], x["t"]) == stratum]
        want = {"few": min(3, len(own)), "half": len(own) // 2, "none": 0, "all": len(own), "less": 0, "null": 0}
        for name, n in want.items():
            assert sum(x[name] for x in own) == n, (stratum, name)
            order = lambda x: sorted(p["path"] for p in own if p[name]) == sorted(p["path"] for p in own if ranks[p["k"]] <= n)
            assert order(None)
        assert all(x["half"] for x in own if x["few"]) or len(own) < 6
    assert curate.cut(df.limit(0), ["s"], order_key(1, F.col("path")), lambda x: x.withColumn("i", F.lit(1)), few=few).count() == 0
    assert sum(x["i"] for x in curate.cut(df, [], order_key(1, F.col("path")), lambda x: x.withColumn("i", F.lit(7)), few=few).collect()) == 7
