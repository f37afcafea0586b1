import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.llm import language_id, queries, toxicity

from .common import by_id, docs_frame

WORDS = {"aa": ["the", "shing", "thou", "with"], "bb": ["der", "schön", "über", "nicht"], "cc": ["que", "señor", "ción", "los"]}


def labelled(spark, n=240):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(WORDS[k]) for _ in range(rng.randint(5, 40))), k) for i in range(n) for k in [rng.choice(list(WORDS))]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), {i: k for i, _, k in rows}


def test_languages_are_told_apart_on_held_out_rows(spark):
    docs, truth = labelled(spark)
    got = by_id(language_id.identify(docs))
    held = [i for i, r in got.items() if r["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert len(held) > 50 and all(got[i]["lang_pred"] == truth[i] for i in held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_of_odd_texts(spark):
    docs, _ = labelled(spark)
    odd = [(900, None), (901, ""), (902, "123 ... !"), (903, "thou the " * 400_000), (904, "x"), (904, "x"), (None, "der über")]
    both = docs.union(spark.createDataFrame([(i, t, None) for i, t in odd], docs.schema))
    rows = language_id.identify(both).where("doc_id >= 900 or doc_id is null").collect()
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "aa", "bb"] and by[900].score == 0
    assert len(rows) == 7
    none = language_id.identify(docs_frame(spark, [(1, "a b")]).where("doc_id > 5"))
    assert none.count() == 0
    unlabelled = spark.createDataFrame([(1, "words here", None)], "doc_id long, text string, lang string")
    assert language_id.identify(unlabelled).first().lang_pred == "und"


def folded(text):
    b = text.lower().encode()
    return {((int.from_bytes(b[i : i + k], "big") + (k << 24)) * 0x9E3779B1 % 2**32) >> 18 for k in (1, 2, 3) for i in range(len(b) - k + 1)}


def test_margins_equal_a_direct_computation(spark):
    """Presence kernel, Nystroem map and balanced ridge regression by their definitions."""
    docs, truth = labelled(spark, 150)
    text = {r.doc_id: r.text for r in docs.collect()}
    train = [i for i in sorted(text) if zlib.crc32(str(i).encode()) % 3 != 1]
    model = language_id.fit(docs, language_id.crc_mod("doc_id", 3) != 1, 10_000, 10_000, "doc_id", "text", "lang")  # every training row is a landmark
    grams = {i: folded(t) for i, t in text.items()}
    kernel = lambda a, b: np.array([[len(grams[i] & grams[j]) / np.sqrt(len(grams[i]) * len(grams[j])) for j in b] for i in a])
    own = kernel(train, train)
    value, vector = np.linalg.eigh(own)
    keep = value > 1e-8 * value[-1]
    half = vector[:, keep] / np.sqrt(value[keep])
    phi = lambda ids: np.c_[kernel(ids, train) @ half, np.ones(len(ids))]
    names = sorted(WORDS)
    y = np.array([[1.0 if truth[i] == n else -1.0 for n in names] for i in train])
    w = np.array([1.0 / sum(truth[j] == truth[i] for j in train) for i in train])
    x = phi(train)
    beta = np.linalg.solve(x.T @ (x * w[:, None]) + 1e-3 * np.eye(x.shape[1]), x.T @ (y * w[:, None]))
    want = phi(sorted(text)) @ beta
    raw = [text[i].lower().encode() for i in sorted(text)]
    rows = language_id.presence(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
    got = rows.astype(np.float32) @ model.weights / np.sqrt(rows.sum(axis=1))[:, None] + model.bias
    assert model.names == names and np.abs(got - want).max() < 1e-3


def test_many_short_rows_stay_small():
    offsets = np.arange(0, 20_002, 2)
    assert max(b - a for a, b in language_id.chunked(offsets, rows=language_id.ROWS)) == language_id.ROWS


def test_presence_is_of_whole_texts_and_apart():
    def grams(t):
        b = t.encode()
        data = np.frombuffer(b, np.uint8)
        return language_id.presence(data, np.array([0, len(b)]))[0]

    a, b = "hello wörld", "ld x"
    data = np.frombuffer((a + b).encode(), np.uint8)
    both = language_id.presence(data, np.array([0, len(a.encode()), len((a + b).encode())]))
    assert (both[0] == grams(a)).all() and (both[1] == grams(b)).all()


def test_held_out_accuracy_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op4_language_id(spark, sf).collect() if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id] for r in rows]) > 0.97
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op6_toxicity(spark, sf).collect()
    known = [(r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    assert np.mean([p == y for p, y in known]) > 0.93 and all(r.predicted == (r.score >= 0.5) for r in rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=14))
def test_segments_are_the_maximal_ones(values):
    """Against repeated extraction: the best segment first, then the best on either side of it."""
    x = np.array(values, float)

    def best(lo, hi):
        top = max(((x[a:b].sum(), -(b - a), -a) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
        if top[0] <= 0:
            return []
        a, b = -top[2], -top[2] - top[1]
        return best(lo, a) + [(a, b, top[0])] + best(b, hi)

    got = toxicity.segments(x)
    assert [s for _, _, s in got] == [s for _, _, s in best(0, len(x))]
    assert all(abs(x[a:b].sum() - s) < 1e-9 for a, b, s in got)


def test_segments_of_long_falling_sequences_take_linear_time():
    n = 500_000
    x = np.tile([1.0, -1.5], n)  # sums fall, so every stretch stays a candidate
    assert len(toxicity.segments(x)) == n
    y = np.tile([1.0, -0.5], n)  # sums rise, so all merge
    assert toxicity.segments(y) == [(0, 2 * n - 1, 0.5 * (n - 1) + 1.0)]


def test_scores_equal_a_direct_computation(spark):
    """Word scores, rate, K, evidence and curve by the docstring's definitions."""
    docs, labels = toxic_rows()
    text = {i: t.lower().split() for i, t in docs}
    train = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 != 0]
    count = {}
    for i, y in train:
        for word in set(text[i]):
            count.setdefault(word, [0, 0])[y] += 1
    n = [sum(c[k] for c in count.values()) for k in (0, 1)]
    total = toxicity.PRIOR * sum(n)
    score = {}
    for word, c in count.items():
        prior = toxicity.PRIOR * sum(c)
        odds = [np.log((c[k] + prior) / (n[k] + total - c[k] - prior)) for k in (0, 1)]
        if odds[1] - odds[0] > max(toxicity.FLOOR, toxicity.Z * np.sqrt(1 / (c[0] + prior) + 1 / (c[1] + prior))):
            score[word] = odds[1] - odds[0]
    assert 3 <= len(score) < 20
    share = {word: (count[word][0] + 0.5) / (n[0] + 1) for word in score}
    mean = lambda v: sum(share[x] * np.exp(v * (score[x] - toxicity.DRIFT)) for x in score) + (1 - sum(share.values())) * np.exp(-v * toxicity.DRIFT)
    lo, hi = 1e-6, 50.0
    for _ in range(80):
        lo, hi = ((lo + hi) / 2, hi) if mean((lo + hi) / 2) < 1 else (lo, (lo + hi) / 2)
    rate = (lo + hi) / 2
    found = {i: [s for _, _, s in toxicity.segments(np.array([score.get(x, 0.0) - toxicity.DRIFT for x in w]))] for i, w in text.items()}
    clean = [i for i, y in train if not y]
    k = max(sum(s >= toxicity.FLOOR - toxicity.DRIFT for i in clean for s in found[i]), 1) * np.exp(rate * toxicity.FLOOR) / sum(len(text[i]) for i in clean)
    evidence = {i: sum(e for s in found[i] if (e := rate * s - np.log(k * max(len(text[i]), 1))) > -np.log(toxicity.ALPHA)) for i in text}
    slope = bias = 0.0
    for _ in range(50):
        g, h = np.array([-0.1 * slope, -0.1 * bias]), np.diag([0.1, 0.1])
        for i, y in train:
            x = np.array([np.log1p(evidence[i]), 1.0])
            p = 1 / (1 + np.exp(-np.clip(slope * x[0] + bias, -50, 50)))
            g, h = g + x * (y - p), h + np.outer(x, x) * p * (1 - p)
        slope, bias = np.array([slope, bias]) + np.linalg.solve(h, g)
    rows = toxicity.score(docs_frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    for r in rows:
        assert abs(r.evidence - evidence[r.doc_id]) < 1e-6 * max(1.0, evidence[r.doc_id])
        assert abs(r.score - 1 / (1 + np.exp(-(slope * np.log1p(evidence[r.doc_id]) + bias)))) < 1e-6


def toxic_rows():
    rng = random.Random(4)
    plain = [f"word{i}" for i in range(80)]
    docs, labels = [], []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        y = int(rng.random() < 0.25)
        if y:
            at = rng.randint(0, len(w))
            w[at:at] = [rng.choice(["vile", "Awful", "nasty"]) for _ in range(3)]
        docs.append((i, " ".join(w)))
        labels.append((i, y))
    return docs, labels


def test_toxicity_finds_planted_passages(spark):
    docs, labels = toxic_rows()
    odd = [(900, None), (901, ""), (902, "vile! awful, NASTY " * 3), (903, "word1 " * 300_000), (904, "word1 vile awful vile"), (904, "word1 vile awful vile"), (None, "x")]
    lab = spark.createDataFrame([*labels, (1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    rows = toxicity.score(docs_frame(spark, docs + odd), lab).collect()
    by = {r.doc_id: r for r in rows}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(rows) == 407 and all(by[i].predicted == dict(labels)[i] for i in held)
    assert [(p.first, p.end) for p in by[904].passages] == [(1, 4)] and not by[900].passages
    assert by[902].predicted == 1 and by[904].predicted == 1 and by[903].predicted == by[900].predicted == 0
    assert all(0 <= r.score <= 1 for r in rows)


def test_capped_classes_keep_the_natural_mix(spark):
    """Passages alone don't tell the class here, so scores must average the share of toxic rows, capped or not."""
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(1500):
        w = [f"word{rng.randrange(80)}" for _ in range(rng.randint(20, 60))]
        y = int(rng.random() < 0.1)
        if rng.random() < (0.9 if y else 0.1):
            w[5:5] = [rng.choice(["vile", "awful", "nasty"]) for _ in range(3)]
        docs.append((i, " ".join(w)))
        labels.append((i, y))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    natural = np.mean([y for _, y in labels])
    for per_class in (100, 8000):
        mean = np.mean([r.score for r in toxicity.score(docs_frame(spark, docs), lab, per_class=per_class).collect()])
        assert abs(mean - natural) < 0.04, (per_class, mean, natural)


def test_toxicity_without_labels_or_documents(spark):
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs_frame(spark, [(1, "a")]), lab).first().score == 0
    assert toxicity.score(docs_frame(spark, [(1, "a")]).where("doc_id > 5"), lab).count() == 0
