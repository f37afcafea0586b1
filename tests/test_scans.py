"""Scans over blocks against recursions over whole series."""

import math

import numpy as np
import pytest

from eventloom.functions import filters, state_space
from eventloom.operators import scans

FS = 1000.0


def series(seed=0, keys=(1, 2, None), n=3):
    rng = np.random.default_rng(seed)
    out = {}
    for k in keys:
        t = int(rng.integers(60, 140))
        e = rng.normal(0, 40, (t, n))  # evidence so strong that chances vanish in plain numbers
        a = rng.dirichlet(np.ones(n), (t, n))
        a[rng.random((t, n)) < 0.1] = np.eye(n)[0]
        out[k] = (int(rng.integers(-50, 50)), e, a, rng.dirichlet(np.ones(n)))
    return out


@pytest.mark.parametrize("width,fan", [(7, 3), (7, 4096), (500, 2), (1, 2)])
def test_hidden_states_equal_the_recursion_at_any_width(spark, width, fan):
    data = series()
    rows = [(k, o + i, e[i].tolist(), a[i].ravel().tolist(), s.tolist()) for k, (o, e, a, s) in data.items() for i in range(len(e))]
    df = spark.createDataFrame(rows, "key long, bin long, e array<double>, a array<double>, start array<double>").repartition(5)
    got = {(r.key, r.bin): r for r in scans.hidden_states(df, ("key",), "bin", 3, width, smooth=True, fan=fan).collect()}
    assert len(got) == len(rows)
    for k, (o, e, a, s) in data.items():
        with np.errstate(divide="ignore"):
            la, v, alpha = np.log(a), np.log(s) + e[0], []
        for t in range(len(e)):
            if t:
                v = scans.lse(v[:, None] + la[t], 0) + e[t]
            v = v - scans.lse(v, 0)
            alpha.append(v)
        beta, w = [np.zeros(3)], np.zeros(3)
        for t in range(len(e) - 1, 0, -1):
            w = scans.lse(la[t] + (e[t] + w)[None], 1)
            w = w - w.max()
            beta.append(w)
        beta = beta[::-1]
        for t in range(len(e)):
            r = got[k, o + t]
            assert np.allclose(r.p, np.exp(alpha[t]), atol=1e-9)
            g = alpha[t] + beta[t]
            assert np.allclose(r.both, np.exp(g - scans.lse(g, 0)), atol=1e-9)
            if t == 0:
                assert r.change is None
            else:
                x = (alpha[t - 1][:, None] + la[t] + (e[t] + beta[t])[None]).ravel()
                assert np.allclose(r.change, np.exp(x - scans.lse(x, 0)), atol=1e-9)


def test_smoothing_equals_the_kernel_of_state_space(spark):
    rng = np.random.default_rng(2)
    t, n = 50, 2
    e, a, start = rng.normal(0, 1, (t, n)), rng.dirichlet(np.ones(n), (t, n)), np.array([0.3, 0.7])
    gamma, xi, _ = state_space.smooth(e, a[1:], start)
    df = spark.createDataFrame([(i, e[i].tolist(), a[i].ravel().tolist(), start.tolist()) for i in range(t)], "bin long, e array<double>, a array<double>, start array<double>")
    got = scans.hidden_states(df, (), "bin", n, 9, smooth=True).orderBy("bin").collect()
    assert np.allclose([r.both for r in got], gamma) and np.allclose([r.change for r in got[1:]], xi.reshape(t - 1, -1))
    assert scans.hidden_states(df.where("bin > 99"), (), "bin", n, 9).count() == 0


def warped(f):
    return np.tan(np.pi * np.asarray(f) / FS)


@pytest.mark.parametrize("kind", ["butter", "cheby2"])
@pytest.mark.parametrize("band", [(0, 100), (100, 1e9), (70, 180), (180, 70)])
def test_designs_have_the_closed_form_response(kind, band):
    f = np.linspace(1, 499, 250)
    lo, hi = band
    for order in (1, 2, 3, 6):
        sos = filters.sections(kind, order, band, FS, 20)
        if hi > FS / 2:
            w = warped(lo) / warped(f)
        elif lo == 0:
            w = warped(f) / warped(hi)
        elif lo < hi:
            w = np.abs((warped(f) ** 2 - warped(lo) * warped(hi)) / (warped(f) * (warped(hi) - warped(lo))))
        else:
            w = np.abs(warped(f) * (warped(lo) - warped(hi)) / (warped(f) ** 2 - warped(lo) * warped(hi)))
        if kind == "butter":
            want = 1 / (1 + w ** (2 * order))
        else:
            x = 1 / np.maximum(w, 1e-12)
            c = np.where(x <= 1, np.cos(order * np.arccos(np.minimum(x, 1))), np.cosh(order * np.arccosh(np.maximum(x, 1))))
            want = c * c / (99 + c * c)
        assert np.allclose(np.abs(filters.gain(sos, f, FS)) ** 2, want, atol=1e-7)
        assert all((np.abs(np.roots(s[3:])) < 1).all() for s in sos)


def recursion(sos, x, z):
    z, out = list(z), []
    for u in x:
        for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
            y = b0 * u + z[2 * i]
            z[2 * i], z[2 * i + 1] = b1 * u - a1 * y + z[2 * i + 1], b2 * u - a2 * y
            u = y
        out.append(u)
    return np.array(out)


def test_stretches_equal_the_recursion():
    sos = filters.sections("cheby2", 3, (70, 180), FS)
    c, rng = filters.Cascade(sos), np.random.default_rng(0)
    for n in (1, 63, 64, 65, 333):
        x, z = rng.standard_normal(n), rng.standard_normal(2 * len(sos))
        y, end = c.run(x, z)
        again = rng.standard_normal(9)
        assert np.allclose(np.r_[y, c.run(again, end)[0]], recursion(sos, np.r_[x, again], z))


@pytest.mark.parametrize("width,fan", [(50, 4), (1000, 4096), (3, 5)])
@pytest.mark.parametrize("both", [True, False])
def test_filtered_channels_equal_the_recursion_over_the_whole(spark, width, fan, both):
    sos, rng = filters.sections("butter", 3, (20, 90), FS), np.random.default_rng(1)
    data = {k: (o, rng.standard_normal(n) + 5) for k, o, n in ((1, -7, 200), (2, 40, 333), (None, 0, 90))}
    df = spark.createDataFrame([(k, o + i, float(v)) for k, (o, x) in data.items() for i, v in enumerate(x)], "ch long, sample long, v double").repartition(3)
    out = scans.filtered(df, ("ch",), "sample", "v", sos, both, width=width, fan=fan)
    assert out.columns == ["ch", "sample", "v"]
    got = {(r.ch, r.sample): r.v for r in out.collect()}
    rest = filters.Cascade(sos).rest
    for k, (o, x) in data.items():
        if both:
            r = 6 * len(sos)
            y = np.r_[2 * x[0] - x[r:0:-1], x, 2 * x[-1] - x[-2 : -r - 2 : -1]]
            y = recursion(sos, y, rest * y[0])[::-1]
            y = recursion(sos, y, rest * y[0])[::-1][r : r + len(x)]
        else:
            y = recursion(sos, x, np.zeros(2 * len(sos)))
        assert np.allclose([got[k, o + i] for i in range(len(x))], y, atol=1e-8)


def test_zero_phase_keeps_a_sine_in_place(spark):
    t = np.arange(2000)
    df = spark.createDataFrame([(1, int(i), math.sin(2 * math.pi * 50 * i / FS) + math.sin(2 * math.pi * 300 * i / FS)) for i in t], "ch long, sample long, v double")
    out = np.array([r.v for r in scans.filtered(df, ("ch",), "sample", "v", filters.sections("cheby2", 6, (0, 150), FS, 40), width=256).orderBy("sample").collect()])
    assert np.abs(out[200:-200] - np.sin(2 * math.pi * 50 * t / FS)[200:-200]).max() < 2e-2


def test_no_group_holds_a_series(spark):
    df = spark.range(100).selectExpr("1 as ch", "id as sample", "id * 1.0 as v")
    packed = scans.blocks(df, ("ch",), "sample", {"v": df["v"]}, 8)
    assert packed.count() == 13 and packed.selectExpr("max(size(at)) as m").first().m == 8
