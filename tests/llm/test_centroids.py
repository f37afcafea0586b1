"""Operators 11 and 13 against direct computations by their definitions."""

import hashlib
import math
import os

import numpy as np
import pytest

from eventloom.llm import centroid_clusters as K
from eventloom.llm import lloyd
from eventloom.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, x string, key string, code string, own int, error string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", "k", "c", 1, "e") for i, v, lab in rows], SCHEMA)


def usable(rows, dim):
    return [(i, np.array(v, "f4").astype("f8"), lab) for i, v, lab in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]


def ordered(rows, first):
    """By first, nulls last, then components."""
    return sorted(rows, key=lambda r: (first(r) is None, first(r) or 0, list(r[1])))


def nearest(x, entries):
    return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(entries))


def moved(members, entries):
    return [[sum(col) // len(m) for col in zip(*m, strict=True)] if m else e for m, e in ((members.get(k), e) for k, e in enumerate(entries))]


def brute_codes(rows, dim=32, parts=16, entries=64, rounds=2):
    rows = ordered(usable(rows, dim), lambda r: r[0])
    w = dim // parts
    cut = [[[math.floor(256 * c) for c in x[p * w : (p + 1) * w]] for p in range(parts)] for _, x, _ in rows]
    books = [[x[p] for x in cut[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for x in cut:
                members.setdefault(nearest(x[p], books[p])[1], []).append(x[p])
            books[p] = moved(members, books[p])
    best = [[nearest(x[p], books[p]) for p in range(parts)] for x in cut]
    error, by_label = [sum(d for d, _ in b) for b in best], {}
    for (_, _, lab), e in zip(rows, error, strict=True):
        by_label[lab] = by_label.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in b), e, by_label[lab], sha) for (i, _, lab), b, e in zip(rows, best, error, strict=True)), key=repr)


def brute_clusters(rows, clusters=8, rounds=10, dim=64):
    rows = usable(rows, dim)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    whole = lambda x: [math.floor(1024 * c) for c in x]
    centres = [whole(x) for _, x, _ in sorted(rows, key=lambda r: (r[0] is None, sha(f"3:{r[0]}"), list(r[1])))[:clusters]]
    x = [whole(v) for _, v, _ in rows]
    for _ in range(rounds):
        members = {}
        for v in x:
            members.setdefault(nearest(v, centres)[1], []).append(v)
        centres = moved(members, centres)
    best = [nearest(v, centres) for v in x]
    part = [sum(d for d, k in best if k == c) for c in range(len(centres))]
    return sorted(((i, k, d, part[k], sum(part), sha(",".join(map(str, centres[k])))) for (i, _, _), (d, k) in zip(rows, best, strict=True)), key=repr)


def odd(rng, n, dim):
    rows = [(i, v, int(lab)) for i, (v, lab) in enumerate(zip((rng.integers(-3, 4, (n, dim)) / 8).astype("f4").tolist(), rng.integers(0, 3, n), strict=True))]  # coarse, so that ties are frequent
    same = rows[0][1]
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [None] + same[1:], 1), (n + 3, [float("nan")] + same[1:], 1), (n + 4, [float("-inf")] + same[1:], 1), (n + 5, same[:-1], 1)]
    return rows + [(n + 6, same, None), (n + 7, same, None), (n + 7, same, 2), (None, rows[1][1], 0), (None, rows[2][1], None), (3, rows[5][1], 1)] + [(n + 10 + i, same, 1) for i in range(n // 2)]


@pytest.mark.parametrize("n,few", [(200, V.FEW), (200, 0), (20, V.FEW)])
def test_codes_equal_the_definition(spark, monkeypatch, n, few):
    monkeypatch.setattr(V, "FEW", few)
    rows = odd(np.random.default_rng(n), n, 32)
    got = V.digest(*V.compress(frame(spark, rows).repartition(5)))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_codes(rows)


@pytest.mark.parametrize("n", [300, 3])
def test_clusters_equal_the_definition(spark, n):
    rows = odd(np.random.default_rng(n), n, 64)
    got = K.digest(*K.cluster(frame(spark, rows).repartition(5)))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_clusters(rows)


def test_no_rows_and_no_usable_rows(spark):
    for rows in (frame(spark, [(1, None, 1)]), frame(spark, [(1, [0.5] * 7, 1)]), frame(spark, [(1, None, 1)]).where("vec_id > 5")):
        assert V.digest(*V.compress(rows)).count() == 0
        assert K.digest(*K.cluster(rows)).count() == 0


def test_bounds_spare_most_scans_and_change_nothing():
    rng = np.random.default_rng(2)
    x = np.floor(1024 * (rng.standard_normal((6, 64))[rng.integers(0, 6, 4000)] + 0.2 * rng.standard_normal((4000, 64)))).astype(np.int64)
    centres = x[:8].copy()
    own, upper, lower = K.scanned(x, centres)
    scans = []
    for _ in range(10):
        after = centres.copy()
        for c in np.unique(own):
            after[c] = x[own == c].sum(axis=0) // (own == c).sum()
        own, upper, lower, n = K.Drift(centres, after).step(x, own, upper, lower)
        centres = after
        scans.append(n)
        far = K.squared(x, centres)
        assert (own == far.argmin(axis=1)).all()
        best = far[np.arange(len(x)), own]
        far[np.arange(len(x)), own] = np.iinfo(np.int64).max
        assert (upper >= np.sqrt(best)).all() and (lower <= np.sqrt(far.min(axis=1))).all()
    assert scans[-1] < len(x) // 10


def test_only_changed_parts_are_sent_and_sums_stay_exact(spark):
    rng = np.random.default_rng(3)
    x, old, new = rng.integers(-50, 50, (90, 4, 2)), rng.integers(0, 5, (90, 4)), rng.integers(0, 5, (90, 4))
    sums = lloyd.Sums(np.zeros((4, 5, 2), np.int64))
    rows = spark.range(90, numPartitions=3)
    pick = lambda b: b.column(0).to_numpy()
    sums.change(rows, lambda b: (x[pick(b)], old[pick(b)], None))
    sums.change(rows, lambda b: (x[pick(b)], new[pick(b)], old[pick(b)]))
    for p in range(4):
        for e in range(5):
            assert sums.count[p, e] == (new[:, p] == e).sum() and (sums.total[p, e] == x[new[:, p] == e, p].sum(axis=0)).all()


def test_former_tables_are_removed(spark, tmp_path):
    kept = lloyd.Table(spark, "probe")
    first = kept.put(spark.range(3)).inputFiles()
    second = kept.put(spark.range(4))
    assert second.count() == 4 and not any(os.path.exists(f.removeprefix("file://")) for f in first)


def test_components_beyond_exact_sums_are_an_error(spark):
    with pytest.raises(ValueError, match="too large"):
        V.compress(frame(spark, [(1, [1e30] * 32, 1)]))
    with pytest.raises(ValueError, match="too large"):
        K.cluster(frame(spark, [(1, [1e30] * 64, 1)]))
