"""Output codes against direct minimisation, refits by fold and enumeration of decodings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import output_codes as O


def blobs(spark, n=240, k=4, dims=3, seed=0, spread=0.8):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, k, n)
    x = (np.eye(max(k, dims))[:k, :dims] * 3 + np.arange(k)[:, None] * 0.5)[y] + spread * rng.standard_normal((n, dims))
    rows = [(i, "abcdef"[c], int(i % 3), v.tolist()) for i, (c, v) in enumerate(zip(y, x, strict=True))] + [(n, None, 0, x[0].tolist()), (n + 1, "a", 1, None)]
    return spark.createDataFrame(rows, "id long, label string, fold int, x array<double>").repartition(3)


def test_codings():
    assert O.coding(3).tolist() == [[1, 1, 0], [-1, 0, 1], [0, -1, -1]]
    assert O.coding(3, "onevsall").tolist() == [[1, -1, -1], [-1, 1, -1], [-1, -1, 1]]
    assert O.coding(3, "ordinal").tolist() == [[-1, -1], [1, -1], [1, 1]] and O.coding(1).shape == (1, 0)
    with pytest.raises(ValueError):
        O.coding(3, "other")


@pytest.mark.parametrize("learner", ["svm", "logistic"])
@pytest.mark.parametrize("kind", ["onevsone", "onevsall", "ordinal"])
def test_learners_are_at_their_minimum(spark, learner, kind):
    df = blobs(spark)
    m = O.learn(df, "label", "x", None, kind, learner, ridge=0.05)
    data = [r for r in df.collect() if r.label and r.x]
    x, y = np.array([[*r.x, 1.0] for r in data]), np.array(["abcd".index(r.label) for r in data])
    assert m["classes"] == list("abcd") and m["weights"].shape == (1, m["codes"].shape[1], 4)
    for k, w in enumerate(m["weights"][0]):
        t = m["codes"][y, k]
        z, t = x[t != 0], t[t != 0]

        def value(v, z=z, t=t):
            s = t * (z @ v)
            return (np.maximum(1 - s, 0) ** 2 / 2 if learner == "svm" else np.log1p(np.exp(-s))).mean() + 0.025 * (v[:-1] ** 2).sum()

        slope = [(value(w + d) - value(w - d)) / 2e-5 for d in np.eye(4) * 1e-5]
        assert np.abs(slope).max() < 1e-6
        assert all(value(w) <= value(w + d) + 1e-12 for d in np.random.default_rng(k).normal(0, 0.1, (20, 4)))


def test_folds_are_read_by_learners_that_have_not_seen_them(spark):
    df = blobs(spark, spread=2.5)
    m = O.learn(df, "label", "x", "fold")
    got = {r.id: r.guess for r in O.decode(df, m, "x", "fold").collect()}
    for f in range(3):
        own = O.learn(df.where(F.col("fold") != f), "label", "x")
        want = {r.id: r.guess for r in O.decode(df.where(F.col("fold") == f), own, "x").collect()}
        assert all(got[i] == g for i, g in want.items())
    assert got[241] is None and got[240] is not None


@pytest.mark.parametrize("kind", ["onevsone", "onevsall"])
def test_decoding_and_posteriors(spark, kind):
    df = blobs(spark, dims=4)
    m = O.learn(df, "label", "x", None, kind, "logistic")
    out = [r for r in O.decode(df, m, "x").collect() if r.x and r.label]
    assert np.mean([r.guess == r.label for r in out]) > 0.9
    assert all(abs(sum(r.posterior) - 1) < 1e-9 for r in out) and np.mean([m["classes"][int(np.argmax(r.posterior))] == r.guess for r in out]) > 0.95
    machines = O.decode(df, O.learn(df, "label", "x", None, kind), "x")
    assert machines.where("guess = label").count() > 0.9 * 240 and machines.where("posterior is not null").count() == 0


def test_losses_equal_their_definition():
    rng = np.random.default_rng(3)
    for kind in ("onevsone", "onevsall", "ordinal"):
        codes, s = O.coding(4, kind), rng.standard_normal((30, O.coding(4, kind).shape[1])) * 2
        got = O.losses(s, codes)
        for i in range(30):
            for k in range(4):
                took = [max(0.0, 1 - c * v) / 2 for c, v in zip(codes[k], s[i], strict=True) if c]
                assert abs(got[i, k] - sum(took) / len(took)) < 1e-12


def test_posteriors_come_back_from_consistent_chances():
    p = np.random.default_rng(4).dirichlet(np.ones(4), 20)
    for kind in ("onevsone", "onevsall"):
        codes = O.coding(4, kind)
        plus, minus = (codes == 1).astype(float), (codes == -1).astype(float)
        chances = (p @ plus) / (p @ plus + p @ minus)
        assert np.abs(O.posteriors(chances, codes, 3000) - p).max() < 1e-3


def test_two_classes_one_class_and_no_rows(spark):
    df = blobs(spark, 60, 2)
    assert O.decode(df, O.learn(df, "label", "x"), "x").where("guess = label").count() > 50
    one = df.where("label = 'a'")
    assert O.decode(one.where("x is not null"), O.learn(one, "label", "x"), "x").where("guess <> 'a'").count() == 0
    with pytest.raises(ValueError):
        O.learn(df.where("id < 0"), "label", "x")


def test_cross_table_reads_each_time_by_every_other(spark):
    rng = np.random.default_rng(7)
    y, t = rng.integers(0, 3, 300), rng.integers(0, 2, 300)
    x = np.eye(3)[(y + t) % 3] * 4 + rng.standard_normal((300, 3)) * 0.5  # the code turns between the times
    df = spark.createDataFrame([(i // 5, int(a), "abc"[b], v.tolist()) for i, (a, b, v) in enumerate(zip(t, y, x, strict=True))], "session int, time int, label string, x array<double>").repartition(4)
    rows = O.grouped_folds(df, "session", 4).cache()
    assert rows.select("session", "fold").distinct().count() == 60 and rows.select("fold").distinct().count() == 4
    got = {(r.trained, r.tested): (r.accuracy, r.classes) for r in O.cross_table(rows, "label", "x", "time", "fold").collect()}
    assert got[0, 0][0] > 0.95 and got[1, 1][0] > 0.95 and got[0, 1][0] < 0.05 and got[1, 0][0] < 0.05 and all(c == 3 for _, c in got.values())
    one = O.learn(rows.where("time = 1"), "label", "x", "fold")
    both = O.learn(rows, "label", "x", "fold", time="time")
    assert np.allclose(one["weights"], both["weights"][4:], atol=1e-6)
    part = O.held_out(df, "session", 0.3)
    assert 0.1 < part.where("fold = 0").count() / 300 < 0.5 and part.groupBy("session").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
