import random
from hashlib import sha256

from eventloom.llm import substring_dedup as S

from .common import docs_frame, spaced


def brute(docs, k):
    """By document: words, words removed, digest of what stays."""
    first, words = {}, [(i, spaced(t)) for i, t in docs]
    order = lambda i: -(1 << 63) if i is None else i
    for i, w in words:
        for s in range(len(w) - k + 1):
            g = tuple(w[s : s + k])
            first[g] = min(first.get(g, (order(i), s)), (order(i), s))
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - k + 1):
            if first[tuple(w[s : s + k])] < (order(i), s):
                gone |= set(range(s, s + k))
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((i, len(w), len(gone), sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, docs, k):
    got = S.digest(S.remove_repeats(docs_frame(spark, docs), k))
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    phrase = [f"p{i}" for i in range(9)]
    docs = []
    for i in range(60):
        w = [rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = phrase[: rng.randint(3, 9)]
        docs.append((i, rng.choice([" ", "\n", "\t  "]).join(w)))
    docs += [(70, None), (71, ""), (72, "\x0b \r"), (73, "é ü " * 40), (74, "é ü " * 40), (75, "one word " * 12), (None, docs[5][1])]
    assert run(spark, docs, 5) == brute(docs, 5)


def test_repeated_rows_are_one_document(spark):
    docs = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e")]
    assert [(r[0], r[2]) for r in run(spark, docs, 5)] == [(1, 0), (1, 0), (2, 5)]


def test_long_text_and_spans(spark):
    text = " ".join(f"w{i}" for i in range(400_000)) + " " + "y" * 3_000_000
    rows = {r.doc_id: r for r in S.remove_repeats(docs_frame(spark, [(1, text), (2, "start " + " ".join(f"w{i}" for i in range(100, 140)) + " end")]), 20).collect()}
    assert rows[1].n_removed == 0 and rows[2].n_removed == 40 and rows[2].kept == "start end" and rows[2].spans == [1, 41]


def test_empty_table(spark):
    assert S.remove_repeats(docs_frame(spark, [(1, "a")]).where("doc_id > 5"), 20).count() == 0
