"""Event detectors on planted events, and agreement by definition."""

import numpy as np
import pytest

from eventloom.operators import detector

STEP = 50_000


def recording(spark, seed=0, n=3000):
    """Eight units of which two classes of event move different ones."""
    rng = np.random.default_rng(seed)
    at = np.sort(rng.choice(np.arange(20, n - 20) // 20 * 20 + 7, 90, replace=False))
    at = at[np.r_[True, np.diff(at) > 15]]
    kind = rng.integers(0, 2, len(at))
    x = rng.normal(0, 1, (n, 8))
    for i, k in zip(at, kind, strict=True):
        x[i - 1 : i + 2, 3 * k : 3 * k + 3] += 4
    grid = spark.createDataFrame([(1_000 + i * STEP, v.tolist()) for i, v in enumerate(x)], "t long, x array<double>").repartition(4)
    labels = spark.createDataFrame([(1_000 + int(i) * STEP + int(rng.integers(-20_000, 20_000)), "ab"[k]) for i, k in zip(at, kind, strict=True)], "t long, label string")
    return grid, labels, at, kind


def test_samples_are_near_events_or_far_from_all(spark):
    grid, labels, at, kind = recording(spark)
    rows = detector.samples(grid, labels, STEP, 5 * STEP, 5 * STEP, 3.0, 4, history=40 * STEP).collect()
    got = {(r.t - 1_000) // STEP: r.y for r in rows if r.y != "none"}
    assert got == {int(i): "ab"[k] for i, k in zip(at, kind, strict=True) if i > 40}
    other = [(r.t - 1_000) // STEP for r in rows if r.y == "none"]
    late = at[at > 40]
    assert all(np.abs(late - i).min() >= 5 for i in other) and 2 * len(got) < len(other) < 4 * len(got)
    assert all(r.fold == min(int((r.t - 1_000) * 4 / (2999 * STEP)), 3) for r in rows)
    assert detector.samples(grid.where("t < 0"), labels, STEP, 1, 1).count() == 0


def test_planted_events_are_detected(spark):
    grid, labels, at, kind = recording(spark)
    d = detector.train(detector.samples(grid, labels, STEP, 5 * STEP, 5 * STEP, 5.0))
    read = detector.chances(grid, d)
    found = detector.detections(read, 0.5, 6 * STEP, STEP)
    r = detector.agreement(found, labels.select("t"), 3 * STEP).first()
    assert r.n_events == len(at) and r.precision > 0.9 and r.recall > 0.9 and 0.9 < r.f1 <= 1 and abs(r.lag) < 0.05
    guess = {(x.t - 1_000) // STEP: x.guess for x in read.collect()}
    assert np.mean([guess[int(i)] == "ab"[k] for i, k in zip(at, kind, strict=True)]) > 0.9


@pytest.mark.parametrize("width", [None, 40])
def test_agreement_by_definition(spark, width):
    rng = np.random.default_rng(3)
    a, b = (sorted({int(x) for x in rng.integers(0, 1000, n)}) for n in (40, 30))
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "t long")
    r = detector.agreement(frame(a), frame(b), 8, width).first()
    near = [min(((abs(x - y), y) for y in b)) for x in a]
    assert (r.n_found, r.n_events, r.hits, r.seen) == (len(a), len(b), sum(d <= 8 for d, _ in near), sum(min(abs(x - y) for x in a) <= 8 for y in b))
    assert abs(r.lag * 1e6 - np.mean([x - y for x, (d, y) in zip(a, near, strict=True) if d <= 8])) < 1e-9
    none = detector.agreement(frame(a).where("t < 0"), frame(b), 8, width).first()
    assert none.n_found == 0 and none.hits == 0 and none.precision is None and none.recall == 0 and none.f1 is None
