import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions import numeric, scalar
from eventloom.operators import demixing, labels, models, scene, stats, sync


def test_distributions():
    assert math.isclose(numeric.beta_inc(2, 3, 0.4), 0.5248, abs_tol=1e-9)
    assert math.isclose(numeric.t_p_value(2.0, 10), 0.0733880347, abs_tol=1e-8)
    assert math.isclose(numeric.f_p_value(3.0, 2, 20), 0.0725381502, abs_tol=1e-8)


def test_gram_and_projection(spark):
    x = np.random.default_rng(0).standard_normal((200, 5)) @ np.diag([5, 3, 1, 0.5, 0.1])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(999, None)], "id long, v array<double>")
    n, mu, cov = models.gram(df, "v")
    assert n == 200 and np.allclose(mu, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T))
    p = models.pca(df, "v")
    assert np.allclose(p["latent"], np.linalg.eigvalsh(np.cov(x.T))[::-1])
    got = {r.id: r.score for r in models.project(df.where("v is not null"), "v", p["coeff"][:, :2], p["mu"]).collect()}
    assert np.allclose(got[7], (x[7] - mu) @ p["coeff"][:, :2])
    back = models.unproject(np.array([got[i] for i in range(200)]), p["coeff"][:, :2], p["mu"])
    assert ((back - x) ** 2).sum() < 0.1 * ((x - mu) ** 2).sum()


def test_subspaces_and_rotations():
    rng = np.random.default_rng(1)
    a = np.linalg.qr(rng.standard_normal((8, 3)))[0]
    r = np.linalg.qr(rng.standard_normal((3, 3)))[0]
    assert math.isclose(models.similarity(a, a @ r), 1) and np.allclose(numeric.principal_angles(a, a @ r), 0, atol=1e-5)
    q = np.array([[0.0, -1], [1, 0]])
    assert math.isclose(numeric.rotation_amount(q), 0.5) and numeric.rotation_amount(np.eye(3)) < 1e-9
    m = rng.standard_normal((12, 4))
    rot = np.linalg.qr(rng.standard_normal((4, 4)))[0]
    assert models.procrustes(m, 2 * m @ rot + 1)["r2"] > 0.999


def test_decoders_find_separated_classes(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 3, i % 4, (np.eye(3)[i % 3] * 4 + rng.standard_normal(3) * [0.3, 3, 0.3]).tolist()) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, label long, fold long, v array<double>")
    out = models.whitened_decoder(df, "id", "label", "fold", "v")
    assert stats.balanced_accuracy(out, "label").first().accuracy > 0.85
    svm = models.svm_one_vs_rest(df, "label", "v", F.col("fold") != 0).where("fold = 0").withColumn("label", F.col("label").cast("long"))
    assert stats.balanced_accuracy(svm, "label").first().accuracy > 0.8


def test_svm_query_scores_rows_of_every_fold(spark, sf, monkeypatch):
    from eventloom.plans import registry

    seen = []
    score = stats.balanced_accuracy
    monkeypatch.setattr(stats, "balanced_accuracy", lambda found, label: seen.append(found) or score(found, label))
    assert registry.queries()["svm_ecoc"](spark, sf).first().classes == 10
    rows = seen[0].collect()
    assert len(rows) == spark.read.parquet(f"{sf}/embeddings.parquet").count() and all(r.guess is not None for r in rows)


@pytest.mark.parametrize("family", ["poisson", "binomial", "gaussian"])
def test_glm_recovers_coefficients(family):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 3))
    eta = x @ [0.5, -0.3, 0.0] + 0.2
    y = {"poisson": rng.poisson(np.exp(eta)), "binomial": rng.random(4000) < 1 / (1 + np.exp(-eta)), "gaussian": eta + rng.standard_normal(4000) * 0.1}[family].astype(float)
    beta, b0, _ = numeric.glm(x, y, family)
    assert np.allclose(beta, [0.5, -0.3, 0], atol=0.12) and abs(b0 - 0.2) < 0.12
    sparse, _, _ = numeric.glm(x, y, family, alpha=0.05)
    assert abs(sparse[2]) < 1e-3


def test_hmm_and_signals():
    rng = np.random.default_rng(4)
    state = np.repeat([0, 1, 0, 1], 150)
    c = rng.poisson(np.array([1.0, 8.0])[state]).astype(float)
    rates, stay, _ = numeric.hmm_fit(c)
    assert abs(rates[0] - 1) < 0.3 and abs(rates[1] - 8) < 0.8 and stay > 0.95
    assert ((numeric.hmm_filter(c, rates, stay)[:, 1] > 0.5) == (state == 1)).mean() > 0.97
    t = np.arange(4000) / 1000
    y = numeric.band_pass(np.sin(2 * np.pi * 10 * t) + np.sin(2 * np.pi * 200 * t), 1000, 100, 300)
    assert np.corrcoef(y[200:-200], np.sin(2 * np.pi * 200 * t)[200:-200])[0, 1] > 0.99
    v = numeric.dpss(64, 2.5, 4)
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-8)


def test_zeta_tells_locked_from_free():
    rng = np.random.default_rng(5)
    events = np.arange(100) * 2.0
    locked = np.sort(np.concatenate([events + rng.normal(0.3, 0.02, 100), rng.uniform(0, 200, 200)]))
    free = np.sort(rng.uniform(0, 200, 300))
    assert numeric.zeta(locked, events, 1.0)[1] < 1e-4 and numeric.zeta(free, events, 1.0)[1] > 0.01


def test_zeta_of_all_events_equals_the_kernel(spark):
    rng = np.random.default_rng(7)
    events = np.sort(rng.integers(0, 4_000_000_000, 2500))
    locked = np.r_[events[2000:] + rng.integers(300_000, 320_000, 500), rng.integers(0, 4_000_000_000, 3000)]
    spikes = [("locked", int(t)) for t in locked] + [("free", int(t)) for t in rng.integers(0, 4_000_000_000, 3000)] + [("far", 10**11)]
    at = spark.createDataFrame([(i, int(e)) for i, e in enumerate(events)], "trigger long, e long")
    got = {r.unit: r for r in models.zeta_test(spark.createDataFrame(spikes, "unit string, t long"), at, "unit", 1_000_000).collect()}
    for unit in ("locked", "free"):
        want = numeric.zeta(np.sort([t / 1e6 for u, t in spikes if u == unit]), events / 1e6, 1.0)
        assert math.isclose(got[unit].zeta, want[0], abs_tol=1e-9) and math.isclose(got[unit].latency, want[2], abs_tol=1e-6)
    assert got["locked"].p < 1e-4 and got["free"].p > 0.01 and tuple(got["far"]) == ("far", 0.0, 1.0, 0.0)


def test_demixing_separates_factors():
    rng = np.random.default_rng(6)
    ua, ub = np.linalg.qr(rng.standard_normal((20, 2)))[0].T
    a, b = np.arange(3), np.arange(4)
    cells = (np.outer(ua, np.repeat(a - 1, 4)) * 5 + np.outer(ub, np.tile(b - 1.5, 3)) * 3) + rng.standard_normal((20, 12)) * 0.01
    x = cells - cells.mean(axis=1, keepdims=True)
    over_a = np.repeat(x.reshape(20, 3, 4).mean(axis=2), 4, axis=1)
    over_b = np.tile(x.reshape(20, 3, 4).mean(axis=1), 3)
    out = numeric.demix(cells, np.zeros((20, 20)), {"a": over_a, "b": over_b}, 1, 1e-4)
    assert abs(out["a"][1][:, 0] @ ua) > 0.99 and abs(out["b"][1][:, 0] @ ub) > 0.99


def test_demixing_chance_is_the_greatest_mean_of_shuffles(spark, sf):
    from eventloom.plans import registry

    rng = np.random.default_rng(8)
    rows = [(i, i % 6, "ab"[i // 6 % 2], "xyz"[i // 12 % 3], float(rng.normal())) for i in range(360)]
    df = spark.createDataFrame(rows, "k long, u long, f string, g string, v double")
    cells = demixing.held_out(df, "u", ("f", "g"), "v", "k", 4, 3).persist()
    assert cells.select("shuffle", "rep").distinct().count() == 12 and cells.count() == 12 * 36
    sums = cells.groupBy("shuffle", "rep").agg(F.sum(F.col("train") * 9 + F.col("test")).alias("s")).collect()
    assert all(math.isclose(r.s, sum(x[4] for x in rows), abs_tol=1e-9) for r in sums)
    each = [{(r.marginal, r.component): r.accuracy for r in demixing.accuracy(cells.where(f"shuffle = {k}"), 2, 1e-5).collect()} for k in range(3)]
    for r in demixing.accuracy(cells, 2, 1e-5).collect():
        assert math.isclose(r.most, max(e[r.marginal, r.component] for e in each))
    found = registry.queries()["dpca_ridge_search"](spark, sf).collect()
    assert len(found) == 26 and all(r.reps == 10 for r in found)


def test_blocks_of_trials_are_drawn_and_permuted_evenly(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(5, 1, 60)
    cell = np.r_[np.zeros(15), np.ones(45)].astype(int)  # one unit, cells of 15 and 45
    df = spark.createDataFrame([(i, 1, int(c), "z", float(x)) for i, (c, x) in enumerate(zip(cell, v, strict=True))] + [(99, 1, 0, "z", None), (98, None, 0, "z", 3.0)], "k long, u long, f long, g string, v double")
    for block in (7, 1000):
        held = demixing.held_out(df, "u", ("f", "g"), "v", "k", 600, block=block).toPandas()
        for c in (0, 1):
            own, want = held[held.a == c], v[cell == c]
            assert sorted(own.rep) == list(range(600))
            assert set(np.round(own.test, 9)) == set(np.round(want, 9))  # every trial is held out at times
            assert np.allclose(own.train * (len(want) - 1) + own.test, want.sum()) and np.allclose(own.e, want.var(ddof=1) / len(want))
            assert own.test.value_counts(bins=np.sort(want)[[0, len(want) // 2, -1]]).min() > 600 * 0.35
        drawn = demixing.held_out(df, "u", ("f", "g"), "v", "k", 1, 800, block).toPandas()
        assert drawn.groupby("a").size().tolist() == [800, 800]
        total = drawn.assign(n=np.where(drawn.a == 0, 15, 45)).pipe(lambda d: d.assign(s=d.train * (d.n - 1) + d.test))
        assert np.allclose(total.groupby("shuffle").s.sum(), v.sum())
        sums = total[total.a == 0].s
        if block == 1000:  # moments of sums of 15 drawn from 60 without putting back
            assert abs(sums.mean() - 15 * v.mean()) < 4 * sums.std() / 800**0.5
            assert abs(sums.var() / (15 * v.var(ddof=1) * 45 / 60) - 1) < 0.25
        else:
            assert sums.nunique() > 700


def test_sync(spark):
    rows = [(float(x), 1.5 * x + 3 + (50.0 if x == 77 else 0.001 * (x % 3))) for x in range(200)]
    pairs = spark.createDataFrame(rows, "x double, y double")
    fit = sync.robust(pairs)
    assert abs(fit["scale"] - 1.5) < 1e-4 and abs(fit["offset"] - 3) < 1e-2
    assert abs(sync.linear(pairs)["offset"] - 3) > abs(fit["offset"] - 3)
    a = [0, 7, 9, 20, 26, 41, 43, 60, 75]
    first, second = (spark.createDataFrame([(t * 1000,) for t in x], "t long") for x in (a, [t + 5 for t in a[1:]]))
    best = sync.best_shift(sync.shift_search(first, second, 3)).first()
    assert best["shift"] == 1 and best["worst"] == 0


def test_scalar_forms(spark):
    df = spark.createDataFrame([("x10", 1.0, 0.0), ("x2", -1.0, 0.0), ("x1", 0.0, 0.0), (None, 3.0, 2.0)], "s string, a double, b double")
    got = df.select(scalar.divide(F.col("a"), F.col("b")).alias("d")).collect()
    assert got[0].d == math.inf and got[1].d == -math.inf and math.isnan(got[2].d) and got[3].d == 1.5
    assert [r.s for r in df.where("s is not null").orderBy(scalar.natural_key(F.col("s"))).collect()] == ["x1", "x2", "x10"]
    f = spark.createDataFrame([("a|b",), ("",), (None,)], "f string").select(scalar.flags_encode(F.col("f"), ["a", "b"]).alias("h"))
    assert [r.h for r in f.collect()] == [[1, 1], [0, 0], [0, 0]]
    with pytest.raises(Exception, match="unknown value"):
        spark.range(3).select(scalar.decode_enum(F.col("id").cast("int"), {0: "x"})).collect()


def test_bases_and_scene(spark):
    b = labels.raised_cosine_basis(5, 0, 20)
    assert all(abs(sum(w for _, o, w in b if o == k) - 2) < 1e-9 for k in range(5, 16))
    h = labels.history_basis(3, 10, 1.0, 5.0)
    assert all(abs(sum(w * w for k, _, w in h if k == j) - 1) < 1e-9 for j in range(3))
    assert labels.flip([(0, 2, 1.0)]) == [(0, -2, 1.0)]
    one = spark.createDataFrame([(1, 3, "v", 1.0)], "key long, bin long, var string, value double")
    assert {(r.basis, r.bin): r.value for r in labels.expand(one, labels.dirac_basis(3), 0, 9).collect()} == {(k, 3 + k): 1.0 for k in range(3)}
    t = spark.createDataFrame([("a", x) for x in (0, 3, 4, 8, 9, 30)], "k string, t long")
    assert sorted(r.t for r in scene.thinned(t, ("k",), 4).collect()) == [0, 8, 30]
    grid = spark.createDataFrame([(0, 1.0), (1, None), (2, 3.0)], "x long, v double")
    mid = labels.smooth(grid, [], ["x"], "v", 1.0).where("x = 1").first().v
    assert abs(mid - 2.0) < 1e-9


def test_balance(spark):
    df = spark.createDataFrame([(i, int(i < 3)) for i in range(10)], "id long, y int")
    for mode, n in (("min", 3), ("max", 7)):
        got = stats.balance(df, "y", "id", mode).groupBy("y").count().collect()
        assert [r["count"] for r in got] == [n, n]


def test_margins_add_up_and_don_t_overlap():
    import pandas as pd

    rng = np.random.default_rng(4)
    columns = pd.MultiIndex.from_product([range(3), range(2), range(4)])
    x = rng.standard_normal((5, 24))
    x -= x.mean(axis=1, keepdims=True)
    parts = models.margins(pd.DataFrame(x, columns=columns), ("a", "b", "c"))
    assert len(parts) == 7 and np.allclose(sum(parts.values()), x)
    names = list(parts)
    assert all(abs((parts[p] * parts[q]).sum()) < 1e-9 for i, p in enumerate(names) for q in names[:i])
    both = models.margins(pd.DataFrame(x, columns=columns), ("a", "b", "c"), [[("a",), ("a", "b")]])
    assert np.allclose(both["a+a*b"], parts["a"] + parts["a*b"]) and len(both) == 6


def test_step_of_clocks(spark):
    rows = [(i * 1000, i * 1002.0 + 50 + (4000 if i >= 60 else 0) + i % 3) for i in range(400)]
    f = sync.with_step(spark.createDataFrame(rows, "x long, y double"))
    assert abs(f["scale"] - 1.002) < 1e-4 and abs(f["step"] - 2000) < 3 and f["at"] == 59_500 and f["r2"] > 0.9999
    g = sync.with_step(spark.createDataFrame([(x, x * 1.002 + 50 + x // 1000 % 3) for x, _ in rows], "x long, y double"))
    assert g["step"] == 0 and abs(g["scale"] - 1.002) < 1e-4
