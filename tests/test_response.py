"""Rates after events and bootstrapped means against planted responses and direct sums."""

import numpy as np
import pytest

from eventloom.operators import response


def spike_rows(rng, events, centre, width, each, noise):
    out = []
    for unit, (c, w) in enumerate(zip(centre, width, strict=True)):
        t = np.concatenate([events + c + rng.normal(0, w, len(events)) for _ in range(each)] + [rng.uniform(0, events[-1] + 2, noise)])
        out += [(unit, int(x * 1e6)) for x in t if x >= 0]
    return out


def test_planted_responses_are_located(spark):
    rng = np.random.default_rng(0)
    events = np.arange(150) * 2.0 + 1
    rows = spike_rows(rng, events, (0.2, 0.5, 0.8), (0.01, 0.03, 0.05), 4, 1500)
    at = spark.createDataFrame([(i, int(e * 1e6)) for i, e in enumerate(events)], "trigger long, e long")
    got = {r.unit: r for r in response.responses(spark.createDataFrame(rows, "unit int, t long").repartition(3), at, "unit", 1_000_000, 500).collect()}
    for unit, (c, w) in enumerate(((0.2, 0.01), (0.5, 0.03), (0.8, 0.05))):
        r = got[unit]
        assert abs(r.peak - c) < w and c - 4 * w - 0.01 < r.onset < c < r.offset < c + 4 * w + 0.01 and r.onset - 0.002 <= r.half_peak <= r.peak
        assert r.peak_rate > 20
    assert got[0].peak_rate > got[2].peak_rate and response.responses(spark.createDataFrame([], "unit int, t long"), at, "unit", 1_000_000).count() == 0


def test_slopes_equal_their_definition(spark):
    rng = np.random.default_rng(1)
    events = np.arange(20) * 3.0
    rows = spike_rows(rng, events, (0.4,), (0.05,), 2, 60)
    at = spark.createDataFrame([(i, int(e * 1e6)) for i, e in enumerate(events)], "trigger long, e long")
    out = response.rates(spark.createDataFrame(rows, "unit int, t long"), at, "unit", 1_000_000, 40).orderBy("t").collect()
    place = [int((t - int(e * 1e6)) * 40 // 1_000_000) for _, t in rows for e in events if 0 <= t - int(e * 1e6) < 1_000_000]
    for b, r in enumerate(out):
        per = []
        for k in response.reaches(40):
            inside = [j for j in range(40) if abs(j - b) <= k]
            per.append(sum(p in inside for p in place) / len(place) / (len(inside) / 40) - 1)
        assert abs(r.slope - np.mean(per)) < 1e-9 and abs(r.rate - (np.mean(per) + 1) * len(place) / 20) < 1e-9 and abs(r.t - (b + 0.5) / 40) < 1e-12
    assert response.reaches(40) == [1, 2, 3] and response.slopes(np.zeros(8), 1.0).tolist() == [0.0] * 8


def test_weights_are_poisson_and_independent():
    w = response.poisson_weights(np.arange(3000), 200)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    for k, p in enumerate((0.3679, 0.3679, 0.1839, 0.0613)):
        assert abs((w == k).mean() - p) < 0.005
    c = np.corrcoef(w[:, :40].T)
    assert np.abs(c[~np.eye(40, dtype=bool)]).max() < 0.1 and np.abs(np.corrcoef(w[:-1, 0], w[1:, 0])[0, 1]) < 0.1
    assert (response.poisson_weights(np.arange(9), 5) == w[:9, :5]).all() and (response.poisson_weights(np.arange(50), 5, 1) != w[:50, :5]).any()


@pytest.mark.parametrize("by", [[], ["key"]])
def test_bootstrap_equals_direct_sums_and_has_the_right_spread(spark, by):
    rng = np.random.default_rng(2)
    x, keys = rng.normal(3, 2, (400, 2)), rng.integers(0, 2, 400)
    rows = [(int(k), i, v.tolist()) for i, (k, v) in enumerate(zip(keys, x, strict=True))] + [(0, None, [1.0, 1.0]), (1, 7000, None)]
    df = spark.createDataFrame(rows, "key int, id long, v array<double>").repartition(4)
    got = response.bootstrap_means(df, by, "id", "v", 300).collect()
    w = response.poisson_weights(np.arange(400), 300)
    groups = [0, 1] if by else [None]
    assert len(got) == 300 * len(groups)
    for r in got:
        own = keys == r.key if by else np.ones(400, bool)
        assert r.n == w[own, r.draw].sum() and np.allclose(r.mean, (w[own, r.draw][:, None] * x[own]).sum(axis=0) / r.n)
    for g in groups:
        own = keys == g if by else np.ones(400, bool)
        means = np.array([r.mean for r in got if not by or r.key == g])
        assert np.allclose(means.std(axis=0), x[own].std(axis=0) / np.sqrt(own.sum()), rtol=0.25)
    assert response.bootstrap_means(df.where("id < 0"), by, "id", "v", 5).count() == 0
