"""Variants of corpora, contracts and gates on small tables; draws and labels."""

import pytest
from pyspark.sql import functions as F

from curata.functions import dims, seeded
from curata.operators import audit, corpora, curate, metrics, reports


def test_contract_reads_and_refuses():
    terms = corpora.Contract.from_json('{"holdout_generators": ["x"], "min_bucket": 3}')
    assert terms.holdout_generators == {"x"} and terms.min_bucket == 3
    with pytest.raises(ValueError):
        corpora.Contract.from_json('{"nothing": 1}')


def test_levels_by_loop(spark):
    for sizes, cap in (([3, 9, 9, 2], 15), ([5], 3), ([4, 4, 4], 5), ([1, 1], 100), ([7, 2, 7], 0)):
        rows = spark.createDataFrame([(f"g{i}", n) for i, n in enumerate(sizes)], "group string, available long")
        left, want = cap, {}
        order = sorted((n, f"g{i}") for i, n in enumerate(sizes))
        while order:
            n, name = order[0]
            want[name] = min(n, left // len(order))
            left -= want[name]
            order = order[1:]
        assert {r["group"]: r["picks"] for r in curate.allocate(rows, cap).collect()} == want


def test_gates_skip_and_take_learned_ones(spark):
    rows = spark.createDataFrame([("p", "q", 0, "", "s", "train", 5, "<=341", "other")], "path string, orig string, label int, generator string, source string, split string, long int, bucket string, subject string")
    targets = spark.createDataFrame([], "image_path string, target string")
    worst = spark.createDataFrame([(0.62,), (0.5,)], "auroc double")
    got = {r["gate"]: r["verdict"] for r in corpora.gates(rows, targets, shortcut=worst.limit(1), canary=worst).collect()}
    assert got == {"label provenance": "PASS", "bucket balance": "PASS", "native size": "FAIL", "content in buckets": "SKIP", "shortcut": "CAVEAT", "canary": "PASS"}
    with pytest.raises(RuntimeError):
        audit.enforce(corpora.gates(rows, targets))


def test_labels_and_draws(spark):
    with pytest.raises(Exception, match="no label in the name"):
        spark.createDataFrame([("cat",)], "n string").select(dims.named_label(F.col("n"))).collect()
    with pytest.raises(ValueError):
        corpora.condition_subset(None, ["crop_80"])
    rows = spark.range(300).select(seeded.integer(1, 3, 5, F.col("id")).alias("i"), seeded.shuffled(F.array(*map(F.lit, (1, 2, 3))), 1, F.col("id")).alias("s")).collect()
    assert {r["i"] for r in rows} == {3, 4, 5} and len({tuple(r["s"]) for r in rows}) == 6 and all(sorted(r["s"]) == [1, 2, 3] for r in rows)


def test_slices_that_borrow(spark):
    rows = [("a", 1, 0.9)] * 30 + [("a", 0, 0.2)] * 2 + [("b", 0, k / 100) for k in range(40)] + [("c", 1, 0.9)] * 5 + [(None, 1, 0.1)]
    table = reports.confusion_slices(spark.createDataFrame(rows, "s string, label int, score double"), "s").collect()
    got = {r["name"]: r for r in table}
    assert set(got) == {"a", "b"} and got["a"]["borrowed"] and got["a"]["n"] == 72 and got["a"]["auroc"] == 1.0
    assert not got["b"]["borrowed"] and got["b"]["auroc"] is None and got["b"]["recall"] is None


def test_reports_of_empty_tables(spark):
    empty = spark.createDataFrame([], "path string, cond string, label int, generator string, bucket string, score double")
    for table in (reports.confusion_slices(empty, "bucket"), reports.families(empty), reports.generators(empty, 0.5), reports.deployment_slices(empty, 0), metrics.auroc(empty, ["cond"])):
        assert table.count() == 0
    assert reports.bucket_spread(empty).first()["best"] is None
