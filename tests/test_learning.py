"""Subspaces over time, matched clocks, shuffles and multivariate shares against enumeration and dense computations."""

import itertools

import numpy as np
import pytest

from eventloom.functions import numeric
from eventloom.operators import stats, subspaces, sync


def planted(spark, n=360, dims=6, seed=0):
    """Four classes apart along two hidden axes, which two times weigh differently."""
    rng = np.random.default_rng(seed)
    axes = np.linalg.qr(rng.standard_normal((dims, 2)))[0]
    y, t = rng.integers(0, 4, n), rng.integers(0, 2, n)
    corner = np.array([[2, 2], [2, -2], [-2, 2], [-2, -2]])[y] * np.where(t == 0, 1, -1)[:, None]
    x = corner @ axes.T + rng.standard_normal((n, dims)) * 0.5
    rows = [(int(a), "abcd"[b], v.tolist()) for a, b, v in zip(t, y, x, strict=True)] + [(0, None, x[0].tolist()), (0, "a", None)]
    return spark.createDataFrame(rows, "time int, label string, x array<double>").repartition(3), axes


@pytest.mark.parametrize("kind", ["softmax", "hinge"])
@pytest.mark.parametrize("sharp", [None, 3.0])
def test_gradients_equal_finite_differences(spark, kind, sharp):
    df, _ = planted(spark, 40)
    rows, times, classes = subspaces.prepared(df, "label", "x", "time")
    assert times == [0, 1] and classes == list("abcd")
    rows = rows.cache()
    rng = np.random.default_rng(1)
    here = subspaces.Weights(rng.standard_normal((6, 2)), rng.standard_normal((2, 2, 4)), rng.standard_normal((2, 4)))
    options = {"kind": kind, "penalty": 0.1, "bias_penalty": 0.2, "tau": 0.7, "sharp": sharp}
    f, g, each = subspaces.objective(rows, here, **options)
    assert len(each) == 2 and (sharp or abs(f - each.sum()) < 1e-12)
    for name, places in (("u", [(0, 0), (5, 1)]), ("w", [(0, 1, 2), (1, 0, 3)]), ("b", [(1, 1)])):
        a = getattr(here, name)
        for p in places:
            own = a[p]
            a[p] = own + 1e-5
            up = subspaces.objective(rows, here, **options)[0]
            a[p] = own - 1e-5
            down = subspaces.objective(rows, here, **options)[0]
            a[p] = own
            assert abs((up - down) / 2e-5 - getattr(g, name)[p]) < 1e-6


@pytest.mark.parametrize("kind", ["softmax", "hinge"])
def test_a_planted_subspace_is_learned(spark, kind):
    df, axes = planted(spark)
    m = subspaces.learn(df, "label", "x", 2, "time", kind, rounds=25)
    assert np.allclose(m["u"].T @ m["u"], np.eye(2), atol=1e-10) and all(b <= a + 1e-12 for a, b in zip(m["history"], m["history"][1:], strict=False)) and m["history"][-1] < 0.5 * m["history"][0]
    assert np.linalg.svd(axes.T @ m["u"])[1].min() > 0.95
    out = subspaces.predict(df, m, "x", "time")
    assert out.where("guess = label").count() > 0.95 * 360 and out.where("x is null and guess is null").count() == 1
    with pytest.raises(ValueError):
        subspaces.learn(df.where("time > 5"), "label", "x", 2, "time")


def pulses(spark, t):
    return spark.createDataFrame([(int(x),) for x in t], "t long")


@pytest.mark.parametrize("width", [None, 500_000])
def test_missing_pulses_on_either_side(spark, width):
    rng = np.random.default_rng(3)
    t = np.cumsum(rng.integers(40_000, 200_000, 120))
    other = t + 7_000 + rng.integers(-200, 201, 120) + t // 1_000_000
    keep, kept = rng.random(120) > 0.1, rng.random(120) > 0.1
    a, b = pulses(spark, t[keep]), pulses(spark, other[kept])
    got = sorted((r.x, r.y) for r in sync.matched_with_gaps(a, b, 500, width).collect())
    assert got == [(int(x), int(y)) for x, y, i, j in zip(t, other, keep, kept, strict=True) if i and j]
    fit, pairs = sync.sync_with(a, b, 500, allow_missing=True, width=width)
    assert pairs.count() == len(got) and abs(fit["scale"] - 1 - 1e-6) < 5e-5 and abs(fit["offset"] - 7_000) < 200
    with pytest.raises(ValueError, match="jitter"):
        sync.sync_with(a, b, 500, width=width)
    back = sorted((r.x, r.y) for r in sync.matched_with_gaps(b, a, 500, width).collect())
    assert back == [(y, x) for x, y in got]


def test_moved_series_need_no_matching(spark):
    t = np.cumsum(np.random.default_rng(4).integers(40_000, 200_000, 60))
    fit, pairs = sync.sync_with(pulses(spark, t), pulses(spark, t[3:] * 2 + 11), 1_000_000_000)
    exact, own = sync.sync_with(pulses(spark, t), pulses(spark, t[3:] + 11), 5)
    assert own.count() == 57 and own.where("y - x <> 11").count() == 0 and abs(exact["offset"] - 11) < 1e-3 and pairs.count() > 50 and fit["scale"] > 1


def test_tables_keep_their_sums_and_have_the_moments_of_permutations():
    table = np.array([[3, 1, 0], [0, 2, 2], [1, 0, 3]])
    drawn = numeric.shuffled_tables(table, 4000, 1)
    assert (drawn.sum(axis=2) == table.sum(axis=1)).all() and (drawn.sum(axis=1) == table.sum(axis=0)).all() and (drawn >= 0).all()
    labels, guesses = np.repeat([0, 1, 2], table.sum(axis=1)), np.concatenate([np.repeat([0, 1, 2], r) for r in table])
    rng = np.random.default_rng(2)
    plain = np.array([(rng.permutation(labels) == guesses).sum() for _ in range(4000)])
    own = np.trace(drawn, axis1=1, axis2=2)
    assert abs(own.mean() - plain.mean()) < 0.1 and abs(own.std() - plain.std()) < 0.1


def test_label_shuffles_equal_enumeration(spark):
    labels, guesses = [0, 0, 1, 1, 2, 2, 2], [0, 0, 1, 2, 2, 2, 0]
    null = [sum(a == b for a, b in zip(p, guesses, strict=True)) / 7 for p in itertools.permutations(labels)]
    df = spark.createDataFrame([("k", a, b) for a, b in zip(labels, guesses, strict=True)] + [("k", None, 1), ("k", 1, None)], "key string, label int, guess int")
    r = stats.label_shuffle(df, ["key"], "label", "guess", 4000).first()
    assert r.n == 7 and abs(r.accuracy - 5 / 7) < 1e-12 and abs(r.expected - np.mean(null)) < 1e-12 and abs(r.sd - np.std(null)) < 1e-12
    assert abs(r.p - np.mean(np.array(null) >= 5 / 7 - 1e-12)) < 0.02
    again = stats.label_shuffle(df.repartition(5), ["key"], "label", "guess", 4000).first()
    assert again == r and stats.label_shuffle(df.where("label > 5"), ["key"], "label", "guess").count() == 0


def test_map_shuffles_equal_enumeration(spark):
    mean, occupancy = [4.0, 1.0, 0.5, None, 2.0], [0.3, 0.2, 0.1, 0.0, 0.4]
    p = np.array([np.nan if m is None else m for m in mean]) / 7.5
    level = np.nansum(p * occupancy)

    def bits(q):
        return sum(a * o * np.log2(a / level) for a, o in zip(q, occupancy, strict=True) if a > 0)

    null = np.array([bits([p[i] for i in order]) for order in itertools.permutations(range(5))])
    maps = spark.createDataFrame([(1, i, 0, m, o) for i, (m, o) in enumerate(zip(mean, occupancy, strict=True))], "region int, bx long, by long, mean double, occupancy double")
    r = stats.map_information_test(maps, ["region"], 4000).first()
    assert abs(r.bits - bits(p)) < 1e-12 and abs(r.bits - stats.mutual_information(maps, ["region"]).first().bits) < 1e-12
    assert abs(r.p - (null >= bits(p) - 1e-12).mean()) < 0.03


@pytest.mark.parametrize("ridge,fraction", [(None, 0.0), (2.0, 0.0), (None, 0.1)])
def test_shares_equal_a_dense_computation(spark, ridge, fraction):
    df, _ = planted(spark, 90, seed=5)
    data = [r for r in df.collect() if r.label is not None and r.x is not None]
    for r in stats.multivariate_shares(df, ["time"], "label", "x", ridge, fraction).collect():
        own = [d for d in data if d.time == r.time]
        x, y = np.array([d.x for d in own]), np.array([d.label for d in own])
        c = x - x.mean(axis=0)
        b = np.stack([np.sqrt((y == k).sum()) * (x[y == k].mean(axis=0) - x.mean(axis=0)) for k in "abcd"], axis=1)
        eps = ridge if ridge is not None else fraction * (c**2).sum() / 6
        roots = np.sort(np.linalg.eigvals(np.linalg.solve(c.T @ c + eps * np.eye(6), b @ b.T)).real)[::-1][:3]
        assert np.allclose([r.trace, r.largest, r.pillai, r.wilks], [(b**2).sum() / (c**2).sum(), roots[0], roots.mean(), 1 - np.prod(1 - roots)])
        assert r.log_det is None if eps == 0 else abs(r.log_det - np.linalg.slogdet(eps * np.eye(6) + b @ b.T)[1]) < 1e-8


def test_low_rank_determinant_either_way():
    rng = np.random.default_rng(6)
    for shape in ((7, 3), (3, 7), (4, 0)):
        x = rng.standard_normal(shape)
        assert abs(numeric.log_det_low_rank(x, 0.3) - np.linalg.slogdet(0.3 * np.eye(shape[0]) + x @ x.T)[1]) < 1e-9
