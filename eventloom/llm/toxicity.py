"""Operator 6: toxicity by maximum-scoring segments of token log-odds.

Training counts, for each word, the labelled texts of either class that hold it. The word's
log-odds get a Dirichlet prior in proportion to the word's overall frequency; words whose
log-odds exceed ``FLOOR`` and ``Z`` standard errors keep them as their score, and every word pays a small
``DRIFT``, so that scores fall on average. A linear scan finds all maximal-scoring segments
(each positive word and gap is looked at once, but for merges). A segment of score s among
n words has extreme-value significance E = K n exp(-lambda s), with lambda from the
background's score distribution and K from the segments of a word's least score or more
that the background's texts show; segments with E below ``ALPHA`` are passages, and a text's
evidence is the sum of their lambda s - ln(K n). A logistic curve fitted on the training
texts turns evidence into a score.

Training uses at most ``per_class`` labelled rows of each class, the first by hash of their
id; the sample's ids and the words that matter are broadcast, both bounded by it. In the
curve each sampled row weighs as many rows as it stands for (its class's labelled training
rows, counted over all data, over the sampled ones), so a score of 0.5 means the natural mix
at any size.

Defined cases: null and empty texts have no passage and the score of no evidence; an empty
documents table gives an empty one; texts of any length are scanned whole, in linear time;
labels other than 0 and 1, and null ids, are ignored; rows that repeat a label's id count
once by greatest label; without labels of both classes every score is 0; equal sums don't
merge segments; further columns are dropped but for those asked for, in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import as_row, crc_mod, cut, mapped
from .textops import ALNUM, Words, chunked, utf8, words

#: Weight of the prior, as a share of all counts.
PRIOR = 0.1
#: Log-odds count from so many standard errors and this value on; words that are merely
#: a little commoner in the toxic rows, as a whole language may be, count nothing.
Z, FLOOR = 2.5, 1.5
DRIFT = 0.02
#: Greatest E of a passage.
ALPHA = 0.005
_PASSAGES = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score) of a sequence; linear time.

    Candidates are kept with their left and right cumulative sums and a link to the latest
    earlier one of a smaller left sum. A new positive stretch follows links, none of which
    is followed twice, and merges with the candidate found if that ends lower, again and again.
    """
    found: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum after, link
    before = np.r_[0.0, np.cumsum(score)]
    positive = score > 0
    edge = np.flatnonzero(np.diff(np.r_[False, positive, False]))
    sums = before[edge].tolist()
    edge = edge.tolist()
    for a, b, lo, hi in zip(edge[::2], edge[1::2], sums[::2], sums[1::2], strict=True):
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= lo:
                j = found[j][4]
            if j < 0 or found[j][3] >= hi:
                found.append((a, b, lo, hi, j))
                break
            a, lo, link = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = link
    return [(a, b, hi - lo) for a, b, lo, hi, _ in found]


class Model:
    """Scores by word hash, the extreme-value rate and the logistic curve."""

    def __init__(self, hashes: np.ndarray, scores: np.ndarray, background: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.scores = hashes[order], scores[order]
        self.rate = self._rate(scores, background)
        self.k = 0.1
        self.curve = (0.0, -50.0)

    @staticmethod
    def _rate(scores: np.ndarray, share: np.ndarray) -> float:
        """lambda > 0 with mean exp(lambda * score) = 1 over background words."""
        rest = 1.0 - share.sum()
        lo, hi = 1e-6, 50.0
        for _ in range(80):
            mid = (lo + hi) / 2
            with np.errstate(over="ignore"):
                mean = (share * np.exp(mid * (scores - DRIFT))).sum() + rest * np.exp(-mid * DRIFT)
            lo, hi = (mid, hi) if mean < 1 else (lo, mid)
        return (lo + hi) / 2

    def calibrate(self, found: int, n_words: int) -> None:
        """K such that n_words of background are expected to show the segments of FLOOR or more that they do."""
        self.k = max(found, 1) * np.exp(self.rate * FLOOR) / max(n_words, 1)

    def count(self, w: Words) -> np.ndarray:
        """Segments of FLOOR or more of each text."""
        out = np.zeros(len(w.first) - 1, np.int64)
        for r in self._touched(w):
            out[r] = sum(s >= FLOOR - DRIFT for _, _, s in self._segments(w, r))
        return out

    def _touched(self, w: Words) -> list[int]:
        """Texts that hold a scored word."""
        if not len(self.hashes):
            return []
        at = np.searchsorted(self.hashes, w.hash)
        at[at == len(self.hashes)] = 0
        return np.unique(w.row[self.hashes[at] == w.hash]).tolist()

    def _segments(self, w: Words, row: int) -> list[tuple[int, int, float]]:
        a, b = int(w.first[row]), int(w.first[row + 1])
        own = w.hash[a:b]
        at = np.searchsorted(self.hashes, own)
        at[at == len(self.hashes)] = 0
        hit = self.hashes[at] == own
        return segments(np.where(hit, self.scores[at], 0.0) - DRIFT)

    def passages(self, w: Words, row: int) -> list[tuple[int, int, float]]:
        """Significant segments of a text in word positions, with lambda s - ln(K n)."""
        n = int(w.first[row + 1] - w.first[row])
        out = [(x, y, self.rate * s - np.log(self.k * max(n, 1))) for x, y, s in self._segments(w, row)]
        return [p for p in out if p[2] > -np.log(ALPHA)]

    def evidence(self, w: Words) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        found: list[list[tuple[int, int, float]]] = [[] for _ in range(len(w.first) - 1)]
        for r in self._touched(w):
            found[r] = self.passages(w, r)
        return np.array([sum(p[2] for p in f) for f in found], np.float64), found

    def fit_curve(self, evidence: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        """Two-parameter weighted logistic regression on log1p(evidence) by Newton steps, slightly ridged."""
        x = np.c_[np.log1p(evidence), np.ones(len(evidence))]
        beta = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
            hess = x.T @ (x * (weight * p * (1 - p))[:, None]) + np.diag([0.1, 0.1])
            step = np.linalg.solve(hess, x.T @ (weight * (label - p)) - 0.1 * beta)
            beta += step
            if np.abs(step).max() < 1e-9:
                break
        self.curve = (float(beta[0]), float(beta[1]))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * np.log1p(evidence) + self.curve[1], -50, 50)))


def _known(labels: DataFrame, train: Column, key: str, toxic: str) -> DataFrame:
    return labels.where(F.col(key).isNotNull() & F.col(toxic).isin(0, 1) & train).groupBy(key).agg(F.max(toxic).alias("y"))


def _sample(known: DataFrame, key: str, per_class: int) -> DataFrame:
    hashed = known.select(F.col(key).alias("key"), "y", F.xxhash64(F.col(key).cast("string")).alias("h"))
    parts = [hashed.where(f"y = {y}").orderBy("h", "key").limit(per_class) for y in (0, 1)]
    return cut(parts[0].union(parts[1]).select("key", F.col("y").cast("long").alias("y")))


def fit(docs: DataFrame, labels: DataFrame, train: Column, per_class: int, key: str, text: str, toxic: str) -> Model | None:
    known = _known(labels, train, key, toxic)
    chosen = _sample(known, key, per_class)
    size = {r[0]: r[1] for r in chosen.groupBy("y").count().collect()}
    if len(size) < 2:
        return None
    total_of = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    # at most 2 * per_class rows of 16 bytes
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key").select("text", "y")

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = utf8(batch.column(0))
        y = batch.column(1).to_numpy()
        for lo, hi in chunked(offsets):
            w = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ALNUM, lower=True)
            order = np.lexsort((w.row, w.hash))
            h, r = w.hash[order], w.row[order]
            once = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])] if len(h) else np.zeros(0, bool)
            h, label = h[once], y[lo:hi][r[once]]
            own, first = np.unique(h, return_index=True)
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.add.reduceat(1 - label, first)), pa.array(np.add.reduceat(label, first))], ["h", "c0", "c1"])

    counts = cut(mapped(rows, count, "h long, c0 long, c1 long").groupBy("h").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")))
    n0, n1 = counts.agg(F.coalesce(F.sum("c0"), F.lit(0)), F.coalesce(F.sum("c1"), F.lit(0))).first()
    if not n0 or not n1:
        return None
    prior = F.lit(PRIOR) * (F.col("c0") + F.col("c1"))
    total = PRIOR * (n0 + n1)

    def log_odds(c: str, n: int) -> Column:
        return F.log((F.col(c) + prior) / (F.lit(n + total) - F.col(c) - prior))

    scored = counts.select("h", "c0", (log_odds("c1", n1) - log_odds("c0", n0)).alias("d"), F.sqrt(1 / (F.col("c1") + prior) + 1 / (F.col("c0") + prior)).alias("e"))
    kept = scored.where((F.col("d") > FLOOR) & (F.col("d") > Z * F.col("e"))).select("h", "c0", "d").toArrow()
    model = Model(kept.column(0).to_numpy().view(np.uint64), kept.column(2).to_numpy(), (kept.column(1).to_numpy() + 0.5) / (n0 + 1.0))
    plain = docs.sparkSession.sparkContext.broadcast(model)

    def background(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = utf8(batch.column(0))
        for lo, hi in chunked(offsets):
            w = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ALNUM, lower=True)
            yield pa.RecordBatch.from_arrays([pa.array([int(plain.value.count(w).sum())]), pa.array([len(w.row)])], ["found", "n"])

    model.calibrate(*mapped(rows.where("y = 0"), background, "found long, n long").agg(F.coalesce(F.sum("found"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = utf8(batch.column(0))
        for lo, hi in chunked(offsets):
            w = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ALNUM, lower=True)
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.evidence(w)[0]), batch.column(1).slice(lo, hi - lo)], ["evidence", "y"])

    got = mapped(rows, weigh, "evidence double, y long").toArrow()
    label = got.column(1).to_numpy()
    model.fit_curve(got.column(0).to_numpy(), label.astype(np.float64), np.where(label == 1, total_of[1] / size[1], total_of[0] / size[0]))
    return model


def score(docs: DataFrame, labels: DataFrame, train: Column | None = None, per_class: int = 8000, key: str = "doc_id", text: str = "text", toxic: str = "toxic", keep: tuple[str, ...] = ()) -> DataFrame:
    """Of every row: key, held_out, score, predicted, n_passages, evidence, passages (first word, end word, evidence) and a struct ``row`` of the columns in ``keep``."""
    train = crc_mod(key, 5) != 0 if train is None else train
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, train, per_class, key, text, toxic))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m = shared.value
        data, offsets = utf8(batch.column(2))
        for lo, hi in chunked(offsets):
            evidence, found, value = np.zeros(hi - lo), [[] for _ in range(hi - lo)], np.zeros(hi - lo)
            if m is not None:
                w = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ALNUM, lower=True)
                evidence, found = m.evidence(w)
                value = m.score(evidence)
            n = [len(f) for f in found]
            passages = pa.array([[{"first": a, "end": b, "evidence": float(e)} for a, b, e in f] for f in found], _PASSAGES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(value), pa.array((value >= 0.5).astype(np.int32)), pa.array(n, pa.int64()), pa.array(evidence), passages, *(c.slice(lo, hi - lo) for c in batch.columns[3:])],
                ["key", "held_out", "score", "predicted", "n_passages", "evidence", "passages", *(f"kept_{i}" for i in range(len(keep)))],
            )

    own = {"key": key, **{f"kept_{i}": c for i, c in enumerate(keep)}}
    kinds = [f"{name} {docs.schema[c].dataType.simpleString()}" for name, c in own.items()]
    rows = docs.select(docs[key].alias("key"), (~train).alias("held_out"), docs[text].alias("text"), *[docs[f"`{c}`"].alias(f"kept_{i}") for i, c in enumerate(keep)])
    out = mapped(rows, run, ", ".join([kinds[0], "held_out boolean, score double, predicted int, n_passages long, evidence double, passages array<struct<first:long,end:long,evidence:double>>", *kinds[1:]]))
    return out.select(F.col("key").alias(key), "held_out", "score", "predicted", "n_passages", "evidence", "passages", *as_row(keep))
