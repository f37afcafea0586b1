"""Operator 10: token ids in binary shards with Elias-Fano document boundaries.

A shard file holds, little-endian: the magic bytes, a header of seven 64-bit integers
(documents, null ids among them, ids, bytes of an id, least document id, bytes of each of
the two Elias-Fano blocks), the Elias-Fano block of document boundaries, the one of
document ids, and the concatenated id array. Documents are in ascending order of their
id, nulls first; rows that repeat an id stay, ordered by a hash of their text.

Shards are written by tasks into a shared folder under a name of the attempt and renamed,
so a lost or repeated task leaves whole files only, and readers open just the files that
the manifest names. Readers take boundaries from the select structures, a stretch of
documents at a time; no file's boundaries are ever held as a table of 64-bit numbers.

Defined cases: null and empty texts have the end id only; texts of any length are encoded
whole, piece by piece, into one file; an empty table writes no file and an empty manifest;
special strings are one id each, as the vocabulary file's library treats them by default;
further columns are dropped; files of another kind (see ``byte_level``) are an error.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import cut, partitions
from .pretokens import Pretokens
from .token_counts import byte_level, byte_symbols

MAGIC = b"EVLMTOK1"
#: Ids after which a task begins another file.
SHARD_IDS = 4 << 20
#: One in so many set bits has its place sampled for select().
SAMPLE = 512
#: Documents whose boundaries a reader holds at once.
DOCS = 4096


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(u / n) bits a value.

    The low bits of each value are packed; the high parts are a bit vector where the
    i-th set bit stands at high(i) + i. select(i) finds that bit from a sampled place.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        low_bits = max(0, int(values[-1]) // n).bit_length() - 1 if n and int(values[-1]) >= n else 0
        mask = np.uint64((1 << low_bits) - 1)
        bits = ((values & mask)[:, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(places[-1]) + 8) // 8 * 8 if n else 0, np.uint8)
        high[places] = 1
        return cls(n, low_bits, np.packbits(bits.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), places[::SAMPLE].astype("<u4" if not n or places[-1] < 1 << 32 else "<u8"))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high), self.samples.itemsize], "<u8")
        return head.tobytes() + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes | memoryview) -> EliasFano:
        n, low_bits, a, b, width = (int(x) for x in np.frombuffer(raw, "<u8", 5))
        at = 40
        return cls(n, low_bits, np.frombuffer(raw, np.uint8, a, at), np.frombuffer(raw, np.uint8, b, at + a), np.frombuffer(raw, f"<u{width}", -(-n // SAMPLE), at + a + b))

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        at = i * self.low_bits
        word = int.from_bytes(self.low[at // 8 : (at + self.low_bits + 7) // 8].tobytes(), "little")
        return word >> at % 8 & (1 << self.low_bits) - 1

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = place // 8
        window = self.high[byte : byte + 1].copy()
        window[0] &= 0xFF << place % 8 & 0xFF
        step = 64
        while left >= (have := int(np.bitwise_count(window).sum())):  # whole stretches at once
            left -= have
            byte += len(window)
            window = self.high[byte : byte + step]
        place = byte * 8 + int(np.flatnonzero(np.unpackbits(window, bitorder="little"))[left])
        return (place - i) << self.low_bits | self._low(i)

    def slice(self, a: int, b: int) -> np.ndarray:
        """Values a to b; only the bytes that hold them are unpacked."""
        b = min(b, self.n)
        if a >= b:
            return np.zeros(0, np.int64)
        byte = int(self.samples[a // SAMPLE]) // 8  # holds no later value's bit than that of the sample
        stop = int(self.samples[-(-b // SAMPLE)]) // 8 + 1 if -(-b // SAMPLE) < len(self.samples) else len(self.high)
        places = np.flatnonzero(np.unpackbits(self.high[byte:stop], bitorder="little")) + byte * 8
        skip = a - a // SAMPLE * SAMPLE + int(np.searchsorted(places, int(self.samples[a // SAMPLE])))
        out = (places[skip : skip + b - a] - np.arange(a, b)).astype(np.int64) << self.low_bits
        if self.low_bits:
            at = a * self.low_bits
            bits = np.unpackbits(self.low[at // 8 : (b * self.low_bits + 7) // 8], bitorder="little")[at % 8 :][: (b - a) * self.low_bits]
            out |= bits.reshape(b - a, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return out

    def values(self) -> np.ndarray:
        """All values at once."""
        return self.slice(0, self.n)


def shard_bytes(keys: list[int | None], lengths: np.ndarray, ids: bytes, width: int) -> bytes:
    known = np.array([k for k in keys if k is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    bounds = EliasFano.of(np.r_[0, np.cumsum(lengths)]).to_bytes()
    names = EliasFano.of((known - least).astype(np.uint64)).to_bytes()
    head = np.array([len(keys), len(keys) - len(known), int(lengths.sum()), width, least, len(bounds), len(names)], "<i8")
    return MAGIC + head.tobytes() + bounds + names + ids


class Shard:
    """One file's content: document ids, boundaries and id array."""

    def __init__(self, raw: bytes | memoryview):
        if bytes(raw[:8]) != MAGIC:
            raise ValueError("not a token shard")
        n, nulls, total, width, least, a, b = (int(x) for x in np.frombuffer(raw, "<i8", 7, 8))
        at = 64
        self.bounds = EliasFano.from_bytes(memoryview(raw)[at : at + a])
        self.names = EliasFano.from_bytes(memoryview(raw)[at + a : at + a + b])
        self.nulls, self.least = nulls, least
        self.ids = np.frombuffer(raw, f"<u{width}", total, at + a + b)
        self.n = n

    def keys(self, a: int, b: int) -> list[int | None]:
        """Document ids of the documents a to b."""
        known = self.names.slice(max(a - self.nulls, 0), max(b - self.nulls, 0)) + self.least
        return [None] * (max(min(b, self.nulls) - a, 0)) + known.tolist()

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Pretokens:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    byte_level(json.loads(t.to_str()))
    tokenize = t.model.tokenize
    stand_in = str.maketrans(dict(enumerate(byte_symbols())))

    def solve(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens by the library's model, which reads bytes as their stand-ins."""
        ids = [[x.id for x in tokenize(p.encode().decode("latin-1").translate(stand_in))] for p in tokens]
        return np.array(list(chain.from_iterable(ids)), np.uint32), np.array(list(map(len, ids)), np.int64)

    return Pretokens({x.content: i for i, x in t.get_added_tokens_decoder().items()}, solve)


def id_width(path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int, text: str = "text", key: str = "doc_id", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write all documents' ids to ``folder`` and return the manifest: one row a file.

    Each distinct pre-token is encoded once by the tokenizers library. A range partitioning by id puts the files in
    order; only it is a shuffle. The manifest has file, n_docs, n_ids, start and first_doc, the
    ids and documents in all files before it.
    """
    width = id_width(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(folder)
        encoder, kind = _encoder(path), f"<u{width}"
        end, begun = np.array([end_id], kind).tobytes(), []
        shard, part, count = TaskContext.get().partitionId(), 0, 0
        keys, lengths, ids = [], [], []

        def flush():
            raw = shard_bytes(keys, np.array(lengths, np.int64), b"".join(ids), width)
            name = f"{at}/shard-{shard:06d}-{part:04d}.tok"
            fs.create_dir(at, recursive=True)
            with fs.open_output_stream(own := f"{name}.{uuid.uuid4().hex}") as f:
                f.write(raw)
            fs.move(own, name)
            return pa.RecordBatch.from_pydict({"shard": [shard], "part": [part], "file": [f"shard-{shard:06d}-{part:04d}.tok"], "n_docs": [len(keys)], "n_ids": [sum(lengths)]})

        for batch in batches:
            for lo, hi, values, bounds in encoder.chunks(batch.column(1)):
                raw, bounds = values.astype(kind).tobytes(), (bounds * width).tolist()
                if len(bounds) == 1:  # part of a long text
                    begun.append(raw)
                    continue
                for k, a, b in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), bounds[:-1], bounds[1:], strict=True):
                    own = b"".join([*begun, raw[a:b], end])
                    begun.clear()
                    keys.append(k)
                    lengths.append(len(own) // width)
                    ids.append(own)
                    count += lengths[-1]
                    if count >= shard_ids:
                        yield flush()
                        part += 1
                        count, keys, lengths, ids = 0, [], [], []
        if keys:
            yield flush()

    spark = docs.sparkSession
    ranged = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).repartitionByRange(partitions(spark), F.col("key").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("text"))
    manifest = cut(ranged.mapInArrow(run, "shard long, part long, file string, n_docs long, n_ids long"))
    # one row a partition is numbered in one place; the files of a partition are numbered by themselves
    summed = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    parts = manifest.groupBy("shard").agg(F.sum("n_ids").alias("all"), F.sum("n_docs").alias("all_docs"))
    parts = parts.select("shard", summed("all", Window.orderBy("shard")).alias("ids_before"), summed("all_docs", Window.orderBy("shard")).alias("docs_before"))
    own = Window.partitionBy("shard").orderBy("part")
    return manifest.join(parts, "shard").select("shard", "part", "file", "n_docs", "n_ids", (F.col("ids_before") + summed("n_ids", own)).alias("start"), (F.col("docs_before") + summed("n_docs", own)).alias("first_doc"))


def read_shards(manifest: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens and ids_crc32 (of 32-bit ids) of every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(folder)
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{at}/{file}") as f:
                    shard = Shard(f.read())
                for a in range(0, shard.n, DOCS):
                    b = min(a + DOCS, shard.n)
                    bounds = shard.bounds.slice(a, b + 1)
                    wide = shard.ids[bounds[0] : bounds[-1]].astype("<u4")
                    edge = (bounds - bounds[0]).tolist()
                    crc = [zlib.crc32(wide[x:y]) for x, y in zip(edge[:-1], edge[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.keys(a, b), pa.int64()), pa.array(bounds[:-1] + start), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("file", "start").repartition(partitions(manifest.sparkSession))
    return files.mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("key", key)


def read_document(spark: SparkSession, manifest: DataFrame, folder: str, i: int) -> np.ndarray:
    """Ids of the i-th document over all files, by one manifest look-up and two selects."""
    row = manifest.where((F.col("first_doc") <= i) & (F.lit(i) < F.col("first_doc") + F.col("n_docs"))).first()
    fs, at = _open(folder)
    with fs.open_input_file(f"{at}/{row['file']}") as f:
        return Shard(f.read()).document(i - row["first_doc"])
