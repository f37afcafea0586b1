import random
from hashlib import sha256

import pytest

from eventloom.llm import decontaminate as D

from .common import by_id, docs_frame, item_words


def brute(docs, items, length=10):
    out = {}
    for i, text in docs:
        w, hit, names = item_words(text), set(), set()
        for name, t in items:
            if name is None or t is None:
                continue
            v = item_words(t)
            n = min(len(v), length)
            if not n:
                continue
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    names.add(str(name))
        out[i] = (len(w), len(hit), len(names), sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


def make(seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["été", "Ünï", "x1"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 9, 10, 11, 25]))) for k in range(12)]
    items += [(12, items[3][1]), (13, ""), (14, None), (None, text(12)), (15, "  ... "), (16, "Hello, WORLD-again")]
    docs = [(k, text(rng.randint(0, 60))) for k in range(20)]
    docs += [(100 + k, f"{text(5)} {(t or '').upper()} {text(4)} {(t or '')[:20]}") for k, (_, t) in enumerate(items)]
    docs += [(200, None), (201, ""), (202, items[0][1]), (203, "hello world again!"), (204, "x" * 50_000 + " " + (items[5][1] + " ") * 3000)]
    return docs, items


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 200])
def test_matches_brute_force_in_one_block_and_in_many(spark, block):
    docs, items = make()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(D.digest(D.decontaminate(docs_frame(spark, docs), bench, block_bytes=block)))
    want = brute(docs, items)
    for i, w in want.items():
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == w, i


def test_long_items_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(D, "PIECE", 7)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([10, 16, 17, 90])))) for k in range(8)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(5)) + " " + " ".join(items[k % 8][1].split()[k : k + 30])) for k in range(40)]
    got = by_id(D.digest(D.decontaminate(docs_frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_bytes=400)))
    for i, w in brute(docs, items).items():
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == w, i


def test_index_size_is_bounded_by_its_text():
    rng = random.Random(3)
    prose = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(300_000))
    letters = " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))
    for text, most in ((prose, 9), (letters, 25)):
        pieces = [("a", 300_000, text)]
        assert D.Index(pieces, 10).nbytes() < most * len(text)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    rows = D.digest(D.decontaminate(docs_frame(spark, [(None, "x a b c"), (7, "a b c"), (7, "a b c"), (7, "z")]), bench)).collect()
    assert sorted((r.doc_id is None, r.n_hit) for r in rows) == [(False, 0), (False, 3), (False, 3), (True, 3)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert not by_id(D.digest(D.decontaminate(docs_frame(spark, [(1, "a b")]), none)))[1]["contaminated"]
    assert D.decontaminate(docs_frame(spark, [(1, "a")]).where("doc_id > 9"), bench).count() == 0


def test_spans(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    rows = {r.doc_id: r.spans for r in D.decontaminate(docs_frame(spark, [(1, "x a b c y a b c a B c"), (2, "a b"), (3, None)]), bench).collect()}
    assert rows == {1: [1, 4, 5, 11], 2: [], 3: []}


def test_carried_columns_keep_their_names(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    docs = docs_frame(spark, [(1, "a b c")])
    assert D.decontaminate(docs, bench, keep=tuple(docs.columns)).select("row.*").columns == docs.columns
