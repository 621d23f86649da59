"""Whole evaluations and builds against plain versions of their parts."""

import random

import numpy as np
import pytest

from curata.operators import harness


def auroc(reals, fakes):
    return sum((f > r) + 0.5 * (f == r) for f in fakes for r in reals) / (len(fakes) * len(reals)) if fakes and reals else None


def table(seed, conds=("clean", "blur", "jpeg"), n=120):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        label, generator = k % 2, ["", "g1", "g2", "g3"][k % 4 if k % 2 else 0]
        rows += [(f"p{k:03d}", label, generator, c, float(round(min(1.0, max(0.0, r.gauss(0.4 + 0.2 * label, 0.2))), 2))) for c in conds]
    return rows


SCHEMA = "path string, label int, generator string, cond string, score double"


@pytest.mark.parametrize("threshold", [None, 0.5])
def test_evaluate(spark, threshold):
    rows = table(1)
    got = {(r["section"], r["name"], r["metric"]): r["value"] for r in harness.evaluate(spark.createDataFrame(rows, SCHEMA), threshold, 5).collect()}
    of = lambda c, label, g=None: [s for _, y, gen, cond, s in rows if cond == c and y == label and g in (None, gen)]
    cut = threshold
    if cut is None:
        best = max(sorted({s for *_, c, s in rows if c == "clean"}), key=lambda t: (round(np.mean(np.array(of("clean", 1)) >= t) - np.mean(np.array(of("clean", 0)) >= t), 12), t))
        cut = best
    assert got["summary", "all", "threshold"] == cut
    areas = {c: auroc(of(c, 0), of(c, 1)) for c in ("clean", "blur", "jpeg")}
    for c, a in areas.items():
        assert got["condition", c, "auroc"] == pytest.approx(a)
        assert got["condition", c, "fpr"] == pytest.approx(np.mean(np.array(of(c, 0)) >= cut))
    worst = min(("blur", "jpeg"), key=areas.get)
    assert got["summary", worst, "worst_condition"] == pytest.approx(areas[worst]) and got["summary", "all", "mean_auroc"] == pytest.approx((areas["blur"] + areas["jpeg"]) / 2)
    for g in ("g1", "g3"):
        assert got["generator", g, "clean_auroc"] == pytest.approx(auroc(of("clean", 0), of("clean", 1, g)))
        assert got["generator", g, "worst_catch"] == pytest.approx(min(np.mean(np.array(of(c, 1, g)) >= cut) for c in ("blur", "jpeg")))
    wrong = sorted(((-s, p) for p, y, _, c, s in rows if c == "clean" and y == 0 and s >= cut))[:5]
    assert {(k[1], -v) for k, v in got.items() if k[0] == "false_positive"} == {(p, s) for s, p in wrong}


def test_evaluate_clean_alone_and_one_class(spark):
    """Without other conditions there are no means, and a set of one class has no AUROC; neither is an error."""
    alone = {(r["section"], r["metric"]): r["value"] for r in harness.evaluate(spark.createDataFrame(table(2, ("clean",)), SCHEMA)).collect()}
    assert alone["summary", "mean_auroc"] is None and alone["summary", "clean_auroc"] is not None and ("summary", "worst_condition") not in alone
    reals = [r for r in table(3) if r[1] == 0]
    assert harness.evaluate(spark.createDataFrame(reals, SCHEMA), 0.5).where("metric = 'auroc' AND value IS NOT NULL").count() == 0
    assert harness.evaluate(spark.createDataFrame([], SCHEMA), 0.5).where("section != 'summary'").count() == 0


def test_generator_sets(spark):
    r = random.Random(4)
    rows = [(name, int(name != "real"), float(round(r.random() + (name == "b"), 2)), f"{r.randrange(3)}x1") for name in ("real", "a", "b") for _ in range(41)]
    got = {(x["section"], x["name"], x["metric"]): x["value"] for x in harness.generator_sets(spark.createDataFrame(rows, "set string, label int, score double, size string")).collect()}
    of = lambda name: np.array([s for n, _, s, _ in rows if n == name])
    for name in ("real", "a", "b"):
        assert got["set", name, "median"] == pytest.approx(np.median(of(name))) and got["set", name, "over"] == pytest.approx((of(name) >= 0.5).mean())
    assert got["set", "b", "auroc"] == pytest.approx(auroc(of("real").tolist(), of("b").tolist())) and ("set", "real", "auroc") not in got
    cut = np.quantile(of("real"), 0.95)
    assert got["pooled", "all", "cutoff_0.05"] == pytest.approx(cut) and got["pooled", "a", "worst_0.05"] == pytest.approx((of("a") >= cut).mean())


def test_labelled_manifest(spark):
    disk = spark.createDataFrame([(f"root/{g}/{k}.jpg",) for g in "abcd" for k in range(30)] + [("other/a/3.jpg",)], "path string")
    listed = [(g.upper(), f"zip/{g}/{k}.jpg", str(int(g != "d"))) for g in "abcd" for k in range(35)] + [("D", "zip/VAL2017/d/1.jpg", "0"), ("A", "zip/a/5.jpg", "0")]
    out = harness.labelled_manifest(spark.createDataFrame(listed, "list string, image_path string, is_fake string"), disk, "w", 0, 20, held={"b"}, forbidden={"c"}, official={"d": "val2017"}).collect()
    by = lambda **want: [r for r in out if all(r[k] == v for k, v in want.items())]
    assert len(by(generator="a")) == len(by(generator="b")) == 20 and len(by(label=0)) == 20 and not by(generator="c")
    assert {r["split"] for r in by(generator="b")} == {"test"} and "root/a/3.jpg" not in {r["path"] for r in out}
    rest = [r for r in out if r["generator"] != "b"]
    assert [sum(r["split"] == s for r in rest) for s in ("train", "val", "test")] == [32, 4, 4] and len({r["path"] for r in out}) == len(out)
