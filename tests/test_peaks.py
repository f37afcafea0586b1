"""Peaks and ripples against their definitions over whole series."""

import numpy as np
import pytest

from eventloom.functions import filters
from eventloom.operators import peaks, ripples


def turning(o, v):
    first = [i for i in range(len(v)) if i == 0 or v[i] != v[i - 1]]
    return [(o[first[j]], v[first[j]]) for j in range(1, len(first) - 1) if v[first[j]] > v[first[j - 1]] and v[first[j]] > v[first[j + 1]]]


def brute(o, v, height=-np.inf, prominence=0.0, distance=0):
    found = []
    for at, h in turning(o, v):
        i = o.index(at)
        lo = max((j for j in range(i) if v[j] > h), default=0)
        hi = min((j for j in range(i, len(v)) if v[j] > h), default=len(v) - 1)
        p = h - max(min(v[lo : i + 1]), min(v[i : hi + 1]))
        if h > height and p >= prominence:
            found.append((at, h, p))
    kept = []
    for x in sorted(found, key=lambda x: (-x[1], x[0])):
        if not distance or all(abs(x[0] - k[0]) > distance for k in kept):
            kept.append(x)
    return sorted(kept)


@pytest.mark.parametrize("width,fan,span", [(7, 2, None), (64, 3, 50), (1000, 64, None)])
@pytest.mark.parametrize("options", [{}, {"height": 1.0}, {"prominence": 2.0}, {"distance": 6}, {"height": -1.0, "prominence": 1.0, "distance": 30}])
def test_peaks_equal_the_definition(spark, width, fan, span, options):
    rng = np.random.default_rng(width)
    data = {1: np.cumsum(rng.integers(-2, 3, 230)), 2: rng.integers(0, 4, 150), 3: np.arange(60) % 7 + np.arange(60) // 7, None: 60 - (np.arange(60) % 7 + np.arange(60) // 7), 4: np.array([3, 3, 3]), 5: np.array([1])}
    start = {k: i * 13 - 30 for i, k in enumerate(data)}
    rows = [(k, start[k] + i, float(v), 0.0) for k, x in data.items() for i, v in enumerate(x)] + [(1, 5000, None, 0.0), (2, 6000, float("nan"), 0.0)]
    df = spark.createDataFrame(rows, "key long, bin long, n double, h double").repartition(4)
    use = df if span is None else df.where("key is not null")  # buckets of time join by key
    out = peaks.find_peaks(use, ("key",), "bin", "n", width=width, fan=fan, span=span, **options)
    assert out.columns == ["key", "bin", "n", "prominence"]
    want = sorted((k or 0, *p) for k, x in data.items() if span is None or k is not None for p in brute([start[k] + i for i in range(len(x))], [float(v) for v in x], **options))
    assert sorted((r.key or 0, r.bin, r.n, r.prominence) for r in out.collect()) == want


def test_chains_of_near_peaks_and_no_rows(spark):
    n = 400  # rising peaks, each within the distance of the next: every second one stays, from the last on
    rows = [(1, 2 * i, float(i)) for i in range(n)] + [(1, 2 * i + 1, -1.0) for i in range(n)]
    df = spark.createDataFrame(rows, "key long, bin long, n double")
    got = sorted(r.bin for r in peaks.find_peaks(df, ("key",), "bin", "n", distance=2, width=8).collect())
    assert got == sorted(x[0] for x in brute([2 * i + j for i in range(n) for j in (0, 1)], [float(x) for i in range(n) for x in (i, -1)], distance=2))
    assert peaks.find_peaks(df.where("bin > 9999"), ("key",), "bin", "n", distance=2).count() == 0


def recursion(sos, x, z):
    z, out = list(z), []
    for u in x:
        for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
            y = b0 * u + z[2 * i]
            z[2 * i], z[2 * i + 1] = b1 * u - a1 * y + z[2 * i + 1], b2 * u - a2 * y
            u = y
        out.append(u)
    return np.array(out)


def whole_ripples(x, fs, threshold=5.0, least=3.0, cycles=3, band=(70.0, 180.0)):
    """The rules in order over one signal held whole."""
    sos = filters.sections("butter", 3, band, fs)
    r, rest = 6 * len(sos), filters.Cascade(sos).rest
    y = np.r_[2 * x[0] - x[r:0:-1], x, 2 * x[-1] - x[-2 : -r - 2 : -1]]
    y = recursion(sos, y, rest * y[0])[::-1]
    y = recursion(sos, y, rest * y[0])[::-1][r : r + len(x)]
    n = len(y)
    f = np.fft.fft(y)
    f[1 : (n + 1) // 2] *= 2
    f[n // 2 + 1 :] = 0
    env = np.abs(np.fft.ifft(f))
    k = np.arange(100) - 49.5
    g = np.exp(-0.5 * (4 * k / 49.5) ** 2)
    env = np.convolve(env, g / g.sum())[50 : 50 + n]
    z, mx, sx = (env - env.mean()) / env.std(ddof=1), x.mean(), x.std(ddof=1)
    out, ends, half = [], {}, int(0.25 * fs)
    found = brute(list(range(n)), z.tolist(), threshold, threshold, int(0.05 * fs))
    for j, (at, top, _) in enumerate(found):
        if j and at <= ends.get(j - 1, -1):
            continue
        change = [i for i in range(at - half, at + half) if 0 <= i and i + 1 < n and np.sign(z[i] - least) != np.sign(z[i + 1] - least)]
        before, after = [i for i in change if i <= at - 2], [i for i in change if i >= at]
        if not before or not after:
            continue
        a, b = before[-1] + 1, after[0]
        ends[j] = b
        lo, hi = max(at - half, 0), min(at + half, n - 1)
        t = [i for i, _, _ in brute(list(range(lo, hi + 1)), (-x[lo : hi + 1]).tolist(), 0.0, 0.0, int(fs / band[1]))]
        t = [i for i in t if a <= i < b]
        if len(t) < 2 or len(t) < cycles:
            continue
        near = min(t, key=lambda i: (abs(i - at), i))
        if abs(x[near] - mx) / sx > 10:
            continue
        out.append((at, a, b, len(t), near, top, t))
    return out


@pytest.mark.parametrize("width", [1024, 4096])
def test_ripples_equal_the_rules_over_whole_channels(spark, width):
    rng = np.random.default_rng(12)
    t = np.arange(12_000) / 1000
    data = {}
    for k in (0, 1):
        x = rng.standard_normal(len(t)) * 0.3
        for c, size in ((0.05, 5), (2.0, 5), (4.09, 5), (4.2, 6), (4.31, 5.5), (6.6, 5), (8.2, 0.9), (9.0, 5), (11.98, 5)):
            x += np.exp(-(((t - c) / 0.03) ** 2)) * np.sin(2 * np.pi * 120 * t + k) * size
        x[9005] -= 90 * (1 - k)  # an outlier
        data[k] = x
    df = spark.createDataFrame([(k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)], "channel long, sample long, value double").repartition(3)
    out = ripples.find_ripples(df, "channel", "sample", "value", 1000.0, threshold=3.0, least=2.0, width=width, span=3000)
    got = sorted(out.collect(), key=lambda r: (r.channel, r.peak))
    want = [(k, *r) for k, x in data.items() for r in whole_ripples(x, 1000.0, 3.0, 2.0)]
    assert len(got) == len(want) >= 8
    for r, (k, at, a, b, n, near, top, troughs) in zip(got, want, strict=True):
        assert r.channel == k and abs(r.peak - at / 1000) <= 0.0011 and abs(r.onset - a / 1000) <= 0.0011 and abs(r.offset - b / 1000) <= 0.0011
        assert abs(r.amplitude_norm - top) < 0.02 and r.n_cycles == n and abs(r.t - near / 1000) < 1e-9
        assert np.allclose(r.troughs, np.array(troughs) / 1000) and abs(r.freq - 1000 / np.diff(troughs).mean()) < 1e-6 and 100 < r.freq < 140
    assert ripples.find_ripples(df.where("sample < 0"), "channel", "sample", "value", 1000.0).count() == 0
