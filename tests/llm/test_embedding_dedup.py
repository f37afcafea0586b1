import math

import numpy as np
import pytest

from eventloom.llm import embedding_dedup as E
from eventloom.llm.components import components

from . import common

SCHEMA = "vec_id long, embedding array<float>, label int, v string, id string, n_links string, p double"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 1, "v", "i", "n", 0.1) for i, v in rows], schema)


def brute(rows, least=0.95):
    ok = {}
    for i, v in rows:
        if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v):
            x = np.array(v, "f4").astype("f8")
            ok[i] = x / np.linalg.norm(x)
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= least]
    root = common.components([i for i, _ in rows], links)
    return sorted((i, sum(i in p for p in links), root[i], root[i] == i) for i, _ in rows)


def vectors(n=400, dim=32, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 4, dim))
    x = np.repeat(base, 4, axis=0) + rng.standard_normal((n, dim)) * rng.choice([0.02, 0.2, 0.35], (n, 1))
    return [(int(i), r.astype("f4").tolist()) for i, r in enumerate(x)]


@pytest.mark.parametrize("size", [4096, 32])
def test_matches_brute_force_with_one_slice_and_with_many(spark, monkeypatch, size):
    monkeypatch.setattr(E, "SLICE", size)
    rows = vectors()
    rows += [(500, None), (501, []), (502, [0.0] * 32), (503, [float("nan")] + [1.0] * 31), (504, [None] + [1.0] * 31), (505, [float("inf")] + [1.0] * 31)]
    rows += [(506, rows[3][1]), (507, rows[3][1]), (508, [c * 2 for c in rows[3][1]]), (509, rows[3][1][:16])]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_vectors(frame(spark, rows)).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("bucket,size", [(100, 4096), (60, 16)])
def test_buckets_by_signs_in_rounds(spark, monkeypatch, bucket, size):
    monkeypatch.setattr(E, "BUCKET", bucket)
    monkeypatch.setattr(E, "SLICE", size)
    rows = vectors(seed=4)
    k, turns = E.rounds(len(rows), 0.95)
    assert k >= 2 and turns > 5
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_vectors(frame(spark, rows)).collect())
    assert got == brute(rows)


def test_rounds_leave_little_chance_of_a_miss():
    for n in (10**4, 10**6, 10**7, 10**9):
        k, turns = E.rounds(n, 0.95)
        assert n / 2**k <= E.BUCKET and (k == 0 or (1 - (1 - math.acos(0.95) / math.pi) ** k) ** turns <= E.MISS)


def test_vectors_that_share_an_id_are_all_compared(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    got = E.near_vectors(frame(spark, [(1, a), (1, b), (2, b), (3, a), (4, c), (None, c), (None, c)])).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in got) == [(0, 1, 0), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 0)]


def test_repeated_and_null_ids_and_no_rows(spark):
    a = [1.0, 0.0]
    got = E.near_vectors(frame(spark, [(1, a), (1, a), (2, a), (None, [0.0, 1.0])])).collect()
    assert sorted((r.vec_id is None, r.n_links) for r in got) == [(False, 1), (False, 1), (True, 0)]
    assert E.near_vectors(frame(spark, [(1, a)]).where("vec_id > 5")).count() == 0


def test_needed_count_loses_few():
    t = E.needed()
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((4000, 64))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = 0.95 * x + math.sqrt(1 - 0.95**2) * y
    half = E.WIDTH * math.sqrt(0.1) / 8
    d = E.directions(64)[:, 1:]
    assert 0 < t < E.PROJECTIONS and ((np.abs((x - near) @ d) <= half).sum(axis=1) >= t).mean() > 0.999


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(5, 5), (3, 2)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = common.components(set(range(41)) | set(range(100, 160)), [x for x in links if x[0] != x[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
