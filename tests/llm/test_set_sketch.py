import random

import numpy as np
import pytest

from eventloom.llm import set_sketch as S

from .common import components, docs_frame, lowered, spaced


def shingles(text, k):
    w = spaced(lowered(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(docs, k, share):
    sets = [(i, shingles(t, k)) for i, t in docs]
    links = [(i, j) for x, (i, a) in enumerate(sets) for j, b in sets[:x] if a and b and 100 * len(a & b) >= share * len(a | b)]
    root = components({i for i, _ in docs}, links)
    return sorted((i, len(s), root[i], i == root[i]) for i, s in sets)


def variants(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    docs, i = [], 0
    for g in range(12):
        base = [f"g{g}w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 5, 6, 12, 60, 200]))]
        for t in variants(rng, base, rng.choice([1, 2, 8, 30]), max(1, len(base) // 12)):
            docs.append((i, t if i % 3 else t.upper()))
            i += rng.randint(1, 3)
    docs += [(i + 1, None), (i + 2, ""), (i + 3, "solo"), (i + 4, "Solo"), (i + 5, "a b c d e"), (i + 6, "a b c d e f")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in S.near_duplicates(docs_frame(spark, docs), 2, 80).collect())
    assert got == brute(docs, 2, 80)


@pytest.mark.parametrize("share", [50, 60, 90])
def test_other_thresholds(spark, share):
    rng = random.Random(share)
    docs = list(enumerate(t for g in range(10) for t in variants(rng, [f"g{g}w{k}" for k in range(rng.choice([6, 20, 50]))], 8, 6)))
    docs += [(500, "a b c d"), (501, "a b c d e"), (502, "x y z"), (503, "x y z w"), (504, "p q"), (505, "p q r")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in S.near_duplicates(docs_frame(spark, docs), 2, share).collect())
    assert got == brute(docs, 2, share)


def test_bands_miss_few_pairs():
    assert S.bands_of(80) == (40, 5)
    for share in range(45, 100, 5):
        bands, rows = S.bands_of(share)
        assert bands * rows <= S.REGISTERS and (1 - (share / 100) ** rows) ** bands <= S.MISS
    with pytest.raises(ValueError):
        S.bands_of(1)


def test_repeated_ids_are_one_node_and_empty_tables(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = S.near_duplicates(docs_frame(spark, [(1, a), (2, a), (2, b), (3, b), (3, b), (None, b)]), 2, 80).collect()
    assert {r.component_id for r in rows} == {None} and len(rows) == 6
    assert S.near_duplicates(docs_frame(spark, [(1, "a")]).where("doc_id > 5"), 2, 80).count() == 0


def test_registers_estimate_and_merge():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = x[:2000], x[400:2400]  # 1600 of 2400
    k = S.sketch(np.r_[a, b, np.unique(np.r_[a, b])], np.array([0, 2000, 4000, 6400]))
    assert (np.maximum(k[0], k[1]) == k[2]).all()
    est = S.joint_estimate(k[:1], k[1:2], np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(est - 2 / 3) < 0.15
    many = [S.joint_estimate(*(s := S.sketch(np.r_[a + np.uint64(j), b + np.uint64(j)], np.array([0, 2000, 4000])))[[[0], [1]]], np.array([2000.0]), np.array([2000.0]))[0] for j in range(1, 30)]
    assert abs(np.mean(many) - 2 / 3) < 0.02


@pytest.mark.parametrize("few", [1, 5, 1000])
def test_large_family_of_near_copies(spark, monkeypatch, few):
    """By cells, by pairs, and by both."""
    monkeypatch.setattr(S, "CELL", 8)
    monkeypatch.setattr(S, "FEW", few)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    docs = list(enumerate(variants(rng, base, 60, 12)))
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in S.near_duplicates(docs_frame(spark, docs), 2, 80).collect())
    assert got == brute(docs, 2, 80)
