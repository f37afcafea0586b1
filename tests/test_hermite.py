"""Piecewise cubics against their definitions in numpy."""

import numpy as np
import pytest

from eventloom.operators import hermite


def pchip(x, y):
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    if len(x) == 2:
        return np.array([d[0], d[0]])
    m = np.zeros(len(x))
    for i in range(1, len(x) - 1):
        if d[i - 1] * d[i] > 0:
            a, b = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            m[i] = (a + b) / (a / d[i - 1] + b / d[i])
    for i, (p, q) in ((0, (0, 1)), (-1, (-1, -2))):
        e = ((2 * h[p] + h[q]) * d[p] - h[p] * d[q]) / (h[p] + h[q])
        m[i] = 0 if np.sign(e) != np.sign(d[p]) else 3 * d[p] if np.sign(d[p]) != np.sign(d[q]) and abs(e) > 3 * abs(d[p]) else e
    return m


def makima(x, y):
    d = np.diff(y) / np.diff(x)
    if len(d) == 1:
        return np.array([d[0], d[0]])
    d = np.r_[3 * d[0] - 2 * d[1], 2 * d[0] - d[1], d, 2 * d[-1] - d[-2], 3 * d[-1] - 2 * d[-2]]
    m = np.zeros(len(x))
    for i in range(len(x)):
        a, b, c, e = d[i : i + 4]
        w1, w2 = abs(e - c) + abs(e + c) / 2, abs(b - a) + abs(b + a) / 2
        m[i] = (w1 * b + w2 * c) / (w1 + w2) if w1 + w2 else 0.0
    return m


@pytest.mark.parametrize("kind,slope", [("pchip", pchip), ("makima", makima)])
def test_values_follow_the_definition(spark, kind, slope):
    rng = np.random.default_rng(3)
    series = {k: (np.cumsum(rng.uniform(0.2, 2, n)), np.round(rng.standard_normal(n), 1)) for k, n in enumerate((2, 3, 4, 9, 30))}
    series[9] = (np.arange(5.0), np.zeros(5))
    rows = [(k, int(round(t * 1e6)), float(v)) for k, (x, y) in series.items() for t, v in zip(x, y, strict=True)]
    at = [(k, int(round(t * 1e6))) for k, (x, _) in series.items() for t in np.r_[x[0] - 1, np.linspace(x[0], x[-1], 23), x[-1] + 1, x]]
    got = hermite.interpolate(spark.createDataFrame(at, "k long, t long").distinct(), spark.createDataFrame(rows, "k long, t long, v double"), "v", ("k",), kind=kind).collect()
    for r in got:
        x = np.array([t for k, t, _ in rows if k == r.k]) / 1e6
        y, t = series[r.k][1], r.t / 1e6
        if t < x[0] or t > x[-1]:
            assert r.v is None
            continue
        m = slope(x, y)
        i = min(int(np.searchsorted(x, t, "right")) - 1, len(x) - 2)
        h = x[i + 1] - x[i]
        s = (t - x[i]) / h
        want = (1 + 2 * s) * (1 - s) ** 2 * y[i] + s * (1 - s) ** 2 * h * m[i] + s**2 * (3 - 2 * s) * y[i + 1] + s**2 * (s - 1) * h * m[i + 1]
        assert abs(r.v - want) < 1e-8, (kind, r.k, t)
