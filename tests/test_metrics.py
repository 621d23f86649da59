"""Detector metrics against counts over all pairs and cut-offs of small tables."""

import itertools

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curata.operators import curate, learn, metrics

ROWS = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 1), st.sampled_from([-40.0, -1.5, -0.25, 0.0, 0.125, 0.25, 0.5, 0.75, 1.0, 1.25, 9.0, 300.0])), min_size=1, max_size=40)
SLOW = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, rows):
    return spark.createDataFrame(rows, "g long, label long, score double")


def won(rows):
    """Share of (fake, real) pairs that the fake wins, ties counting half; None without a pair."""
    fakes, reals = ([s for _, y, s in rows if y == k] for k in (1, 0))
    pairs = [(a > b) + (a == b) / 2 for a, b in itertools.product(fakes, reals)]
    return sum(pairs) / len(pairs) if pairs else None


@SLOW
@given(ROWS)
def test_auroc_counts_pairs(spark, rows):
    got = {r["g"]: r["auroc"] for r in metrics.auroc(frame(spark, rows), ["g"]).collect()}
    groups = {g for g, *_ in rows}
    assert set(got) == groups
    for g in groups:
        want = won([r for r in rows if r[0] == g])
        assert got[g] is None if want is None else got[g] == pytest.approx(want)
    whole = metrics.auroc(frame(spark, rows), []).first()["auroc"]
    assert whole is None if won(rows) is None else whole == pytest.approx(won(rows))


@SLOW
@given(ROWS, st.sampled_from([0.0, 0.01, 0.2, 0.5, 1.0]))
def test_quantile_cutoff_interpolates(spark, rows, fa):
    got = {r["g"]: r["cutoff"] for r in metrics.quantile_cutoff(frame(spark, rows), ["g"], fa).collect()}
    for g in {g for g, y, _ in rows if y == 0}:
        assert got[g] == pytest.approx(np.quantile([s for h, y, s in rows if h == g and y == 0], 1 - fa))


@SLOW
@given(ROWS)
def test_points_and_cutoffs(spark, rows):
    rows = [(1, y, s) for _, y, s in rows] + [(1, 0, 0.5), (1, 1, 0.5)]
    df = frame(spark, rows)
    rate = lambda y, t: np.mean([s >= t for _, k, s in rows if k == y])
    points = {r["threshold"]: (r["tpr"], r["fpr"]) for r in metrics.roc(df, ["g"]).collect()}
    assert points.pop(None) == (0, 0) and set(points) == {s for *_, s in rows}
    assert all(points[t] == pytest.approx((rate(1, t), rate(0, t))) for t in points)
    cut = metrics.youden(df, ["g"]).first()["cutoff"]
    gains = {t: rate(1, t) - rate(0, t) for t in points}
    assert gains[cut] == pytest.approx(max(gains.values()))
    low = metrics.fpr_at_tpr(df, ["g"], 0.8).first()["fpr_at_tpr"]
    assert low == pytest.approx(min(rate(0, t) for t in points if rate(1, t) >= 0.8))
    c = metrics.confusion(df, ["g"], F.lit(cut)).first()
    assert (c["tp"], c["fp"]) == (sum(s >= cut for _, y, s in rows if y == 1), sum(s >= cut for _, y, s in rows if y == 0))
    assert c["balanced_acc"] == pytest.approx((rate(1, cut) + 1 - rate(0, cut)) / 2)


def test_each_generator_meets_all_reals(spark):
    rows = [(0, "", x / 8) for x in (1, 2, 2, 5)] + [(1, "north", x / 8) for x in (2, 7)] + [(1, "south", 0.0)]
    df = spark.createDataFrame(rows, "label int, generator string, score double").withColumn("cond", F.lit("clean"))
    got = {r["generator"]: (r["fakes"], r["auroc"]) for r in metrics.by_generator(df, ["cond"]).collect()}
    assert got == {"north": (2, pytest.approx((2 + 4) / 8)), "south": (1, 0.0)}  # 1 + two halves, then 4 of 4


def test_empty_tables(spark):
    none = frame(spark, [(1, 1, 0.5)]).limit(0)
    for of in (metrics.auroc, metrics.roc, metrics.youden, metrics.quantile_cutoff, metrics.fpr_at_tpr):
        assert of(none, ["g"]).count() == 0


def test_condition_names():
    assert metrics.GRID[0] == "clean" and len(set(metrics.GRID + metrics.EXTRA)) == len(metrics.GRID) + len(metrics.EXTRA) == 26


def shrunk(x):
    """Ledoit-Wolf by its definition: the distance of each row's outer product from the covariance."""
    n, d = x.shape
    cov = x.T @ x / n
    target = np.trace(cov) / d * np.eye(d)
    spread = np.sum((cov - target) ** 2)
    noise = sum(np.sum((np.outer(r, r) - cov) ** 2) for r in x) / n**2
    share = min(1.0, noise / spread)
    return (1 - share) * cov + share * target


def test_one_class_is_ledoit_wolf(spark):
    r = np.random.default_rng(11)
    x = r.standard_normal((60, 5)) @ r.standard_normal((5, 5)) + 3
    labels = [0] * 45 + [1] * 15
    x[45:] += 2.5
    df = spark.createDataFrame([(i, y, v.tolist()) for i, (y, v) in enumerate(zip(labels, x))], "id int, label int, features array<double>").repartition(3)
    got = {row["id"]: row["score"] for row in learn.one_class(df, "id").collect()}
    z = (x - x[:45].mean(0)) / (x[:45].std(0) + 1e-8)
    dist = np.einsum("ij,jk,ik->i", z, np.linalg.inv(shrunk(z[:45])), z)
    assert [got[i] for i in range(60)] == pytest.approx(dist / (dist + np.median(dist[:45])), rel=1e-6)


def test_out_of_fold_separates(spark):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(i, float(i % 2), (r.standard_normal(3) + 3 * (i % 2)).tolist()) for i in range(200)], "id int, label double, features array<double>")
    scores = learn.out_of_fold(df, "id").toPandas()
    assert len(scores) == 200 and won([(0, int(y), s) for y, s in zip(scores["label"], scores["score"])]) > 0.99
    long = pd.concat([scores.assign(model="a"), scores.assign(model="b", score=0.5)])
    stacked = learn.stack(spark.createDataFrame(long[["id", "label", "model", "score"]]), "id", ["a", "b"]).toPandas()
    assert won([(0, int(y), s) for y, s in zip(stacked["label"], stacked["score"])]) > 0.99


@SLOW
@given(st.lists(st.tuples(st.sampled_from(["x", "y", None]), st.integers(0, 10**6)), min_size=1, max_size=40, unique_by=lambda t: t[1]), st.integers(1, 6))
def test_ranks_over_bins(spark, rows, most):
    import hashlib

    df = spark.createDataFrame([(s, str(k)) for s, k in rows], "s string, path string").repartition(3)
    order = lambda path: (hashlib.md5(f"5|{path}".encode()).hexdigest(), path)
    want = {}
    for s in {s for s, _ in rows}:
        for k, path in enumerate(sorted((str(p) for t, p in rows if t == s), key=order)):
            want[path] = k + 1
    assert {r["path"]: r["rn"] for r in curate.ranked(df, ["s"], 5).collect()} == want
    assert {r["path"] for r in curate.stratified_sample(df, ["s"], most, 5).collect()} == {p for p, k in want.items() if k <= most}


def fitted(x, y, w, reg):
    """Weighted logistic regression with an L2 penalty on coefficients of standardised features, by Newton's method."""
    mean = np.average(x, axis=0, weights=w)
    sd = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=w))
    z = np.c_[(x - mean) / np.where(sd > 0, sd, 1), np.ones(len(x))]
    beta, penalty = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], reg), 0.0]
    w = w / w.sum()
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        grad = z.T @ (w * (p - y)) + penalty * beta
        beta = beta - np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) + np.diag(penalty + 1e-12), grad)
    return lambda v: 1 / (1 + np.exp(-np.c_[(v - mean) / np.where(sd > 0, sd, 1), np.ones(len(v))] @ beta))


def test_out_of_fold_values(spark):
    """Each score is that of a regression without its fold, classes weighing alike."""
    from curata.functions.seeded import unit

    rng = np.random.default_rng(5)
    y = (np.arange(200) % 4 == 0).astype(float)
    x = rng.normal(size=(200, 3)) + 0.7 * y[:, None]
    df = spark.createDataFrame([(k, float(a), [float(v) for v in row]) for k, (a, row) in enumerate(zip(y, x))], "id long, label double, features array<double>")
    got = {r["id"]: r["score"] for r in learn.out_of_fold(df, "id").collect()}
    fold = {r["id"]: r["f"] for r in df.select("id", F.floor(unit(0, F.col("id")) * 5).alias("f")).collect()}
    folds = np.array([fold[k] for k in range(200)])
    z = (x - x.mean(0)) / (x.std(0) + 1e-8)
    weight = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (200 - y.sum())))
    for k in range(5):
        out = folds != k
        want = fitted(z[out], y[out], weight[out], 1 / 200)(z[~out])
        assert np.allclose([got[i] for i in np.flatnonzero(~out)], want, atol=5e-3)
    area = metrics.auroc(spark.createDataFrame([(int(a), got[k]) for k, a in enumerate(y)], "label int, score double"), []).first()["auroc"]
    assert learn.shortcut_audit(df, "id").first()["auroc"] == pytest.approx(area)


def test_stack_choice_tells_the_best(spark):
    """The learners' and members' AUROC on held-out keys: members' are those of their scores, the chosen one is the largest."""
    from curata.functions.seeded import unit

    rng = np.random.default_rng(6)
    rows = [(f"p{k}", k % 2, m, float(np.clip(rng.normal(0.4 + s * (k % 2), 0.2), 0, 1))) for k in range(300) for m, s in (("good", 0.4), ("poor", 0.05))]
    df = spark.createDataFrame(rows, "path string, label int, model string, score double")
    got = {r["learner"]: r for r in learn.stack_choice(df, "path", ["good", "poor"]).collect()}
    held = {r["path"] for r in df.select("path").distinct().where(unit(0, F.col("path")) < 0.3).collect()}
    for m in ("good", "poor"):
        reals, fakes = ([s for p, y, n, s in rows if n == m and p in held and y == label] for label in (0, 1))
        want = sum((f > r) + 0.5 * (f == r) for f in fakes for r in reals) / (len(fakes) * len(reals))
        assert got[f"member {m}"]["auroc"] == pytest.approx(want)
    assert got["logistic"]["auroc"] >= got["member poor"]["auroc"] and sum(r["chosen"] for r in got.values()) == 1
    assert max(got.values(), key=lambda r: r["auroc"])["auroc"] == next(r["auroc"] for r in got.values() if r["chosen"])
