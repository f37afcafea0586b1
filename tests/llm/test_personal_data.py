import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.llm import personal_data as P
from eventloom.llm.char_tagger import END, Tagger, classes

from .common import docs_frame

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def checksum(d):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (True, kind == 1 and all(int(x) < 256 for x in m[0].split(".")), 12 <= len(d) <= 19 and checksum(d), 9 <= len(d) <= 15)[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet="a1.@-+ ()é%", max_size=40), st.text(alphabet="1.25 -", max_size=60), st.lists(st.sampled_from(["4111111111111111", "4111 1111-1111 1111", "+1 (743) 555-3824", "a.b@c-d.ef", "1.2.3.4", "256.1.1.1", "007.0.0.01", "@", ".", "+", " ", "x", "٣"]), max_size=9).map("".join)))
def test_base_spans_equal_the_patterns(text):
    assert P.base(text) == brute(text)


def test_base_is_linear_on_long_runs():
    for t in ("a" * 400_000 + "!", "1" * 400_000, "1." * 200_000, "+1" + "(" * 300_000, "a@" * 200_000, "1 " * 200_000, "+" * 300_000, "a@b" + ".c" * 200_000):
        assert len(P.base(t)) < 100_000


def model(seed=3, hidden=4, kinds=4, dtype=np.float64):
    m = Tagger(kinds, hidden, seed, dtype)
    m.weights["move"] = np.random.default_rng(seed).normal(0, 0.5, m.weights["move"].shape)
    m.weights["out"] *= 3
    return m


def test_gradient_equals_finite_differences():
    m = model(kinds=2, hidden=3)
    ids = np.random.default_rng(0).integers(32, 60, (3, 7)).astype(np.uint8)
    tags = np.array([[0, 1, 2, 0, 3, 4, 4], [0, 0, 0, 1, 1, 2, 0], [3, 4, 0, 0, 0, 0, 1]])
    grad = m.gradient(ids, tags)[1]
    for name, w in m.weights.items():
        flat = w.reshape(-1)
        for i in np.flatnonzero(np.abs(grad[name].reshape(-1)) > 1e-9)[:8]:
            own = flat[i]
            flat[i] = own + 1e-5
            up = m.gradient(ids, tags)[0]
            flat[i] = own - 1e-5
            down = m.gradient(ids, tags)[0]
            flat[i] = own
            assert abs((up - down) / 2e-5 - grad[name].reshape(-1)[i]) < 1e-6, name


def direct(m, text):
    """Scores by window in turn, weighted means, one Viterbi path for each stretch of covered blocks, the last one filled up."""
    size = len(text)
    ids = np.r_[classes(np.array([ord(c) for c in text], np.uint32)), np.full(-size % P.BLOCK, END, np.uint8)]
    total, weight = np.zeros((len(ids), m.tags)), np.zeros(len(ids))
    for lo in range(0, len(ids), P.BLOCK):
        part = text[lo : lo + P.WINDOW]
        if re.search("[0-9@]", part):
            own = ids[lo : lo + P.WINDOW]
            e = m.scores(np.r_[own, np.full(P.WINDOW - len(own), END, np.uint8)][None])[0]
            for j in range(len(own)):
                w = min(j + 1, P.WINDOW - j)
                total[lo + j] += w * e[j]
                weight[lo + j] += w
    found, at = [], 0
    move = m.move
    while at < len(ids):
        if not weight[at]:
            at += 1
            continue
        stop = at
        while stop < len(ids) and weight[stop]:
            stop += 1
        e = total[at:stop] / weight[at:stop, None]
        best, came = move[0] + e[0], []
        for s in range(1, len(e)):
            reach = best[:, None] + move
            came.append(reach.argmax(axis=0))
            best = reach.max(axis=0) + e[s]
        path = [int(best.argmax())]
        for c in reversed(came):
            path.append(int(c[path[-1]]))
        path.reverse()
        s = 0
        while s < len(path):
            if path[s] % 2:
                end = s + 1
                while end < len(path) and path[end] == path[s] + 1:
                    end += 1
                gain = sum(e[j, path[j]] + move[path[j - 1] if j else 0, path[j]] - e[j, 0] - move[0, 0] for j in range(s, end))
                if gain >= P.MARGIN and re.search("[0-9@]", text[at + s : at + end]):
                    found.append((at + s, path[s] // 2, min(at + end, size), gain))
                s = end
            else:
                s += 1
        at = stop
    return found


@pytest.mark.parametrize("group", [512, 2])
def test_stretches_come_out_as_one_path(monkeypatch, group):
    monkeypatch.setattr(P, "GROUP", group)
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab 1@+.-é" if rng.random() < 0.6 else "abcdef ") for _ in range(n)) for n in (1, 63, 64, 65, 128, 500, 1000)]
    texts += ["words " * 60 + "+1 555" + " words" * 60 + " 1.2.3.4", "", "none here", "1" * 700, "x" * 64 * 5 + "1"]
    m = model()
    found = P.tagged(m, texts)
    assert sum(map(len, found)) > 10
    for t, got in zip(texts, found, strict=True):
        want = direct(m, t)
        assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want], atol=1e-3)


def text_of(rng):
    words = lambda n: " ".join(rng.choice(["the", "Haus", "señor", "über", "wh1st", "of.", "and,"]) for _ in range(n))
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    what = rng.choice([f"re.{n(2)}@mail{n(1)}.example.com", ".".join(str(rng.randrange(256)) for _ in range(4)), f"+1 ({n(3)}) 555-{n(4)}", n(3), f"{n(2)}.{n(2)}", ""])
    return f"{words(rng.randint(2, 40))} {what} {words(rng.randint(2, 40))}", what


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(1)
    rows = [(i, text_of(rng)[0]) for i in range(1500)]
    return P.fit(docs_frame(spark, rows).repartition(3), per_kind=120, steps=160), rng


def test_held_out_spans_are_found_and_clean_texts_are_left_alone(trained):
    m, rng = trained
    texts = [text_of(rng)[0] for _ in range(300)]
    got, want = [{x[:3] for x in g} for g in P.tagged(m, texts)], [set(brute(t)) for t in texts]
    hit = sum(len(g & w) for g, w in zip(got, want, strict=True))
    assert hit >= 0.9 * sum(map(len, want)) and hit >= 0.9 * sum(map(len, got))


def test_rows_of_every_kind(spark, trained):
    m, _ = trained
    rows = [(1, None), (2, ""), (3, "no such thing"), (4, "é mail re.12@mail3.example.com now"), (4, "é mail re.12@mail3.example.com now"), (None, "call +1 (743) 555-3824"), (5, "4111111111111111 and 1.2.3.4"), (6, "77 " * 100_000), (7, "a 1 (743) 555-3824 b")]
    got = P.find(docs_frame(spark, rows), m, keep=("key", "found", "text")).collect()
    assert len(got) == len(rows) and got[0].row.found == "f"
    by = {(r.doc_id, r.row.text): r for r in got}
    for i, t in rows:
        spans = [(x.start, x.kind, x.end) for x in by[i, t].found]
        assert [x for x in spans if x[1] < 4] == brute(t) and spans == sorted(spans)
        for s, k, e in spans:
            assert k < 4 or not any(b < e and s < c for b, _, c in brute(t)) and re.search("[0-9@]", t[s:e])
    flat = P.digest(P.find(docs_frame(spark, rows), m))
    assert flat.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    for r in flat.where("doc_id in (4, 5)").collect():
        own = ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in brute({4: rows[3][1], 5: rows[6][1]}[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(own.encode()).hexdigest() and set(own.split(",")) <= set(r.spans.split(","))
    assert P.find(docs_frame(spark, rows).where("doc_id > 99")).count() == 0
    assert [len(r.found) for r in P.find(docs_frame(spark, rows[:3])).collect()] == [0, 0, 0]


def test_sample_is_bounded_distinct_and_the_same_for_any_partitioning(spark):
    rng = random.Random(4)
    rows = [(i, text_of(rng)[0]) for i in range(400)] * 2
    docs = docs_frame(spark, rows)
    take = lambda d: [sorted({r.draw for r in P.windows(d, 20).where(f"kind = {k}").collect()})[:20] for k in range(5)]
    one, many = take(docs.coalesce(1)), take(docs.repartition(7))
    assert one == many and all(len(x) == 20 for x in (one[0], one[1], one[3], one[4]))
    assert P.windows(docs.coalesce(1), 20).count() <= 100


def test_given_labels_are_learned(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        t = f"{'word ' * rng.randint(1, 9)}id{rng.randrange(1000, 9999)} {'text ' * rng.randint(1, 9)}"
        at = t.index("id")
        rows.append((i, t, [(at, 1, at + 6)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, own array<struct<start:int,kind:int,end:int>>")
    m = P.fit(docs, per_kind=100, steps=60, labelled="own")
    assert [x[:3] for x in P.tagged(m, ["more text id4711 here"])[0]] == [(10, 1, 16)]
