"""ZETA against brute force: ties, null units, and spectra in place of pairs."""

import numpy as np
import pyarrow as pa

from eventloom.operators import models, zeta


def _brute(t, e, window):
    lag = np.sort((t[None] - e[:, None]).ravel())
    lag = lag[(lag >= 0) & (lag < window)]
    d = np.arange(1, len(lag) + 1) / len(lag) - lag / window
    d = np.abs(d - d.mean())
    return d.max(), lag[np.flatnonzero(d.round(12) == d.max().round(12))[0]] / 1e6


def test_ties_and_null_units_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    e = rng.integers(-50, 50, 60) * 500_000
    t = {None: rng.integers(-50, 50, 400) * 250_000, "a": rng.integers(-25_000_000, 25_000_000, 300)}
    spikes = spark.createDataFrame([(u, int(x)) for u, v in t.items() for x in v] + [("a", None), ("few", int(e[0]))], "unit string, t long")
    events = spark.createDataFrame([*enumerate(map(int, e)), (99, None)], "trigger long, e long")
    got = {r.unit: r for r in models.zeta_test(spikes, events, "unit", 1_000_000, 3).collect()}
    assert set(got) == {None, "a", "few"}
    for u in t:
        want = _brute(t[u], e, 1_000_000)
        assert np.allclose((got[u].zeta, got[u].latency), want, atol=1e-9)


def test_spectra_count_what_pairs_do(monkeypatch):
    rng = np.random.default_rng(4)
    window, e, t = 1_000_000, rng.integers(0, 3_000_000, 200), rng.integers(-2_000_000, 6_000_000, 500)
    h, n = rng.integers(-(2**62), 2**62, 200), rng.integers(1, 4, 500)
    rows = {"unit": ["a"] * 700, "block": [0] * 700, "kind": [1] * 200 + [2] * 500, "a": np.r_[h, t], "b": np.r_[e, n]}

    def counted():
        return pa.Table.from_batches(zeta._counted(window, 5, 0)(iter([pa.RecordBatch.from_pydict(rows)])))

    few = counted()
    monkeypatch.setattr(zeta, "DENSE", -1)
    assert counted().equals(few)
    lag = (t[None] - e[:, None])[(t[None] >= e[:, None]) & (t[None] < e[:, None] + window)]
    weight = np.broadcast_to(n[None], (200, 500))[(t[None] >= e[:, None]) & (t[None] < e[:, None] + window)]
    assert few["n"][0].as_py() == weight.sum() and few["s"][0].as_py() == (weight * lag).sum()


def test_cells_of_many_and_of_few_stretches_are_all_pairs_few_at_once(monkeypatch):
    rng = np.random.default_rng(5)
    window, size, e, t = 1_000_000, 3, rng.integers(0, 3_000_000, 300) // 50_000 * 50_000, np.unique(rng.integers(-2_000_000, 6_000_000, 900))
    n = rng.integers(1, 4, len(t))
    monkeypatch.setattr(zeta, "PAIRS", 500)
    lag = t[None] - e[:, None]
    inside = (lag >= 0) & (lag < window)
    cell, weight = lag * (zeta.PIECES * size) // window, np.broadcast_to(n[None], lag.shape)
    batch = lambda a, b: [pa.RecordBatch.from_pydict({"u": ["a"] * len(a), "b": [0] * len(a), "k": [0] * len(a), "x": a, "y": b})]
    b = zeta._Block(0, {1: batch(np.arange(300), e), 2: batch(t, n)}, window)
    for lo in (np.arange(0, zeta.PIECES * size - 40, 41), np.array([17]), np.arange(1, 4000, 2)):
        hi = lo + (1 if lo[-1] < 4000 else 35)
        made = np.zeros(len(lo), np.int64)
        for place, _, c, k in zeta._cells(b, 0, {"size": size, "hi": hi}, lo // size, (hi - 1) // size + 1, window, 0):
            assert len(place) <= 500 + 900  # as many as asked for, and one event's
            ok = (c >= lo[place]) & (c < hi[place])
            made += np.bincount(place[ok], k[ok], len(lo)).astype(np.int64)
        assert made.tolist() == [int(weight[inside & (cell >= x) & (cell < y)].sum()) for x, y in zip(lo, hi, strict=True)]
