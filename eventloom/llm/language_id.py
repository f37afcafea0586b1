"""Operator 4: language identification by string kernels.

A text's features are the byte n-grams of 1 to ``ORDERS`` bytes that it holds, present or
not (a blended spectrum), folded into ``DIM`` places. The kernel is the normalised number
of shared n-grams. Nystroem features on landmark texts feed one-versus-rest kernel ridge
regression. With Z the landmarks' presence rows and B the fitted weights, the margins of a
batch with presence rows P are (P Z^T) B; the product Z^T B is made once, so that a batch
costs one matrix product and whole texts of any length one presence row.

Training reads a bounded sample: about ``per_language`` rows of each language by hash of
their id, of which ``landmarks`` in all, one a language at least, are landmarks. The driver
gets the landmarks' presence rows (one bit a place) and sums of feature products that tasks
make over blocks of the sample; neither grows with the sample. Counts by language cover all
training rows.

Defined cases: null texts and texts without a letter get ``und`` and score 0, as does every
text if there is nothing to learn from; an empty table gives an empty one; texts of any
length are read whole and cost one presence row; ties go to the first language in order of
name; repeated rows are scored each; further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import crc_mod, cut, mapped
from .textops import chunked, utf8

ORDERS = 3
DIM = 1 << 14
#: Languages at most; more are an error, since the model is broadcast.
MOST_LANGUAGES = 1000
#: Texts whose presence rows are held at once, and tasks that sum feature products.
ROWS, SUMS = 512, 8
_MIX = np.uint32(0x9E3779B1)
#: Margins are sharpened by this before they become probabilities.
SHARP = 6.0


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of DIM booleans a text."""
    n = len(offsets) - 1
    out = np.zeros((n, DIM), bool)
    flat = out.ravel()
    row = np.repeat(np.arange(n, dtype=np.int64) * DIM, np.diff(offsets))
    end = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(len(data))
    code = np.zeros(len(data), np.uint32)
    for k in range(1, ORDERS + 1):
        if len(data) < k:
            break
        code[: len(data) - k + 1] = code[: len(data) - k + 1] << np.uint32(8) | data[k - 1 :]
        place = (((code + np.uint32(k << 24)) * _MIX) >> np.uint32(32 - 14)).astype(np.int64)
        inside = at + k <= end
        flat[row[inside] + place[inside]] = True
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    return x / np.maximum(np.sqrt(x.sum(axis=1, keepdims=True)), 1.0)


def _unpacked(bits: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(bits), np.uint8)).reshape(len(bits), DIM)


class Landmarks:
    """Nystroem features: products with landmark rows, whitened."""

    def __init__(self, rows: np.ndarray):
        self.rows = _unit(rows)
        value, vector = np.linalg.eigh(self.rows @ self.rows.T)
        keep = value > 1e-8 * value[-1]
        self.half = vector[:, keep] / np.sqrt(value[keep])

    def features(self, rows: np.ndarray) -> np.ndarray:
        phi = _unit(rows) @ self.rows.T @ self.half
        return np.c_[phi, np.ones(len(phi))]


class Model:
    """Weights by place and language; margins by one matrix product.

    ``gram`` sums weighted outer products of features and ``sums`` the weighted features of
    each language, with weights that give every language the same total.
    """

    def __init__(self, names: list[str], marks: Landmarks, gram: np.ndarray, sums: np.ndarray, ridge: float = 1e-3):
        self.names = names
        right = 2 * sums.T - sums.sum(axis=0)[:, None]  # 1 for the own language and -1 for the others
        beta = np.linalg.solve(gram + ridge * np.eye(len(gram)), right)
        self.weights = (marks.rows.T @ (marks.half @ beta[:-1])).astype(np.float32)
        self.bias = beta[-1].astype(np.float32)

    def score(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its probability for presence rows."""
        norm = np.sqrt(np.maximum(rows.sum(axis=1), 1)).astype(np.float32)
        margin = (rows.astype(np.float32) @ self.weights) / norm[:, None] + self.bias
        odds = np.exp(SHARP * (margin - margin.max(axis=1, keepdims=True)))
        best = margin.argmax(axis=1)
        return best, (odds / odds.sum(axis=1, keepdims=True))[np.arange(len(rows)), best]


def _usable(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, train: Column, per_language: int, landmarks: int, key: str, text: str, lang: str) -> Model | None:
    rows = docs.where(train & F.col(lang).isNotNull() & _usable(text))
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return None
    share = F.create_map(*[F.lit(v) for name, n in sorted(counts.items()) for v in (name, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1_000_003)) / F.lit(1_000_003.0)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = utf8(batch.column(1))
        for lo, hi in chunked(offsets, rows=ROWS):
            bits = np.packbits(presence(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([b.tobytes() for b in bits], pa.binary())], ["lang", "draw", "bits"])

    chosen = rows.where(draw < share[F.col(lang)]).select(F.col(lang).alias("lang"), F.lower(text).alias("text"), F.xxhash64(F.col(key).cast("string"), text).alias("draw"))
    sample = cut(mapped(chosen, run, "lang string, draw long, bits binary"))
    each = max(1, landmarks // len(counts))
    first = sample.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "bits"))).where(F.col("place") <= each)
    got = sorted(tuple(r) for r in first.select("lang", "draw", "bits").collect())  # at most landmarks rows, or one a language
    if not got:
        return None
    names = sorted(counts)
    marks = Landmarks(_unpacked([r[2] for r in got]))
    shared = docs.sparkSession.sparkContext.broadcast((marks, {name: (i, 1.0 / min(counts[name], per_language)) for i, name in enumerate(names)}))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, place = shared.value
        m = marks.half.shape[1] + 1
        gram, sums = np.zeros((m, m)), np.zeros((len(place), m))
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                phi = marks.features(_unpacked(part.column(1).to_pylist()))
                at, weight = (np.array(x) for x in zip(*(place[name] for name in part.column(0).to_pylist()), strict=True))
                gram += phi.T @ (phi * weight[:, None])
                np.add.at(sums, at, phi * weight[:, None])
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary())], ["gram", "sums"])

    parts = sample.select("lang", "bits").repartition(SUMS).mapInArrow(total, "gram binary, sums binary").collect()
    m = marks.half.shape[1] + 1
    gram = sum(np.frombuffer(p.gram).reshape(m, m) for p in parts)
    return Model(names, marks, gram, sum(np.frombuffer(p.sums).reshape(len(names), m) for p in parts))


def identify(docs: DataFrame, train: Column | None = None, per_language: int = 400, landmarks: int = 256, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, held_out, lang_pred and score of every row; ``train`` marks the rows to learn from."""
    train = crc_mod(key, 3) != 1 if train is None else train
    model = fit(docs, train, per_language, landmarks, key, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m = shared.value
        data, offsets = utf8(batch.column(2))
        usable = batch.column(3).to_numpy(zero_copy_only=False)
        for lo, hi in chunked(offsets, rows=ROWS):
            if m is None:
                name, score = ["und"] * (hi - lo), np.zeros(hi - lo)
            else:
                best, score = m.score(presence(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
                name = [m.names[b] if u else "und" for b, u in zip(best.tolist(), usable[lo:hi].tolist(), strict=True)]
                score = np.where(usable[lo:hi], score, 0.0).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(name, pa.string()), pa.array(score)], ["key", "held_out", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), (~train).alias("held_out"), F.lower(text).alias("text"), _usable(text).alias("usable"))
    return mapped(rows, run, f"key {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("key", key)
