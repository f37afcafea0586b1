"""Operator 1: benchmark decontamination by winnowing.

A window is ``length`` consecutive words of a benchmark item; an item of fewer words, but
not none, is one window. Fingerprints are minimum k-gram hashes of each sliding run of
length - k + 1 grams, so every shared span of ``length`` words or more shares one. The
documents' fingerprints are joined with the benchmark's; around each hit all windows are
compared word for word, and the words of those that occur are hit.

Items are cut to pieces of ``PIECE`` words that overlap by a window, and pieces are dealt
into blocks of about ``block_bytes`` of text. A block's index holds its words once and four
numbers a window, so a broadcast is some 25 times a block at most, whatever the words and
items (one letter a word is the worst case; ordinary text takes 9 times). Documents are never
shuffled. With one block the whole job is one narrow pass over the documents; with more,
hits are carried as columns from pass to pass and checkpointed between them.

Defined cases: null texts have no words; items without an id or without words are
ignored; items that repeat an id count once; every document row is judged by itself, so
repeated ids and repeated rows each give a row; empty tables give no rows, or documents
without hits; columns other than those named are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import as_row, cut, mapped
from .textops import ALNUM, Words, chunked, utf8, words

#: Words of a gram; shorter windows are grams of their own length.
GRAM = 5
#: Bytes of benchmark text in one broadcast block, and words of a piece of an item.
BLOCK_BYTES, PIECE = 4 << 20, 4096


def minima(grams: np.ndarray, width: int) -> np.ndarray:
    """Least of grams[i : i + width] for each i where it fits."""
    part, size, acc, got, want = grams, 1, None, 0, width
    while True:
        if want & size:
            if acc is None:
                acc, got = part, size
            else:
                m = min(len(acc), len(part) - got)
                acc, got = np.minimum(acc[:m], part[got : got + m]), got + size
            want ^= size
        if not want:
            return acc
        if len(part) <= size:
            return grams[:0]
        part = np.minimum(part[:-size], part[size:])
        size *= 2


def winnow(w: Words, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows, and the fingerprint (minimum k-gram hash) of each."""
    starts = np.flatnonzero(w.spans(length))
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    least = minima(w.grams(k), length - k + 1)
    return starts, least[starts]


class Windows:
    """Distinct windows of one length: sorted hashes, where their words stand, and their items."""

    def __init__(self, w: Words, place: np.ndarray, text: bytes, item: np.ndarray, size: int):
        start, least = winnow(w, size, min(GRAM, size))
        self.prints = np.unique(least)
        h = w.grams(size)[start]
        at = place[start]
        length = place[start + size - 1] + (w.end - w.start)[start + size - 1] - at
        order = np.argsort(h, kind="stable")
        h, at, length, item = h[order], at[order], length[order].astype(np.int32), item[w.row[start[order]]]
        # windows of one hash are one window unless their words differ
        same = np.r_[False, h[1:] == h[:-1]]
        for i in np.flatnonzero(same).tolist():
            same[i] = text[at[i - 1] : at[i - 1] + length[i - 1]] == text[at[i] : at[i] + length[i]]
        first = np.flatnonzero(~same)
        self.hash, self.at, self.length = h[first], at[first], length[first]
        pairs = np.unique(np.c_[np.cumsum(~same) - 1, item], axis=0) if len(h) else np.zeros((0, 2), np.int64)
        self.bound = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1)).astype(np.int32)
        self.item = pairs[:, 1].astype(np.int32)

    def find(self, h: int, words: bytes, text: bytes) -> np.ndarray:
        """Items of the window with this hash and these words."""
        i, out = int(np.searchsorted(self.hash, h)), self.item[:0]
        while i < len(self.hash) and self.hash[i] == h:
            if text[self.at[i] : self.at[i] + self.length[i]] == words:
                out = np.r_[out, self.item[self.bound[i] : self.bound[i + 1]]]
            i += 1
        return out


class Index:
    """A block's windows by their length, over one buffer of all its words."""

    def __init__(self, pieces: list[tuple[str, int, str]], length: int):
        self.names = sorted({name for name, _, _ in pieces})
        number = {name: i for i, name in enumerate(self.names)}
        self.by_size: dict[int, Windows] = {}
        self.text = b""
        if not pieces:
            return
        data, offsets = utf8(pa.array([t for _, _, t in pieces], pa.string()))
        w = words(data, offsets, ALNUM, lower=True)
        self.text = w.text(0, len(w.row))
        width = w.end - w.start
        place = np.cumsum(width + 1) - width - 1
        item = np.array([number[name] for name, _, _ in pieces], np.int64)
        size = np.array([min(n, length) for _, n, _ in pieces], np.int64)
        for n in np.unique(size).tolist():
            own = size[w.row] == n
            row, inside = np.unique(w.row[own], return_inverse=True)
            part = Words(w.data, w.start[own], w.end[own], inside, w.hash[own], np.zeros(0, np.int64))
            self.by_size[n] = Windows(part, place[own], self.text, item[row], n)

    def nbytes(self) -> int:
        return len(self.text) + sum(a.nbytes for x in self.by_size.values() for a in (x.prints, x.hash, x.at, x.length, x.bound, x.item))

    def hits(self, w: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Mask of the words hit, and the items found by row."""
        cover = np.zeros(len(w.row) + 1, np.int32)
        found: dict[int, set[int]] = {}
        for size, windows in self.by_size.items():
            starts, least = winnow(w, size, min(GRAM, size))
            if not len(starts):
                continue
            at = np.searchsorted(windows.prints, least)
            at[at == len(windows.prints)] = 0
            starts = starts[windows.prints[at] == least]
            if not len(starts):
                continue
            for s, h in zip(starts.tolist(), w.grams(size)[starts], strict=True):
                items = windows.find(h, w.text(s, s + size), self.text)
                if len(items):
                    cover[s] += 1
                    cover[s + size] -= 1
                    found.setdefault(int(w.row[s]), set()).update(items.tolist())
        return np.cumsum(cover[:-1]) > 0, {r: {self.names[i] for i in items} for r, items in found.items()}


def _pieces(benchmark: DataFrame, item: str, text: str, length: int) -> DataFrame:
    """item, words of the piece and the piece, for stretches of each item that overlap by length - 1 words."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = utf8(batch.column(1))
        for lo, hi in chunked(offsets):
            w = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ALNUM, lower=True)
            out = []
            for r, name in enumerate(batch.column(0).slice(lo, hi - lo).to_pylist()):
                a, b = int(w.first[r]), int(w.first[r + 1])
                for s in range(a, max(b - length + 1, min(a + 1, b)), PIECE):
                    e = min(s + PIECE + length - 1, b)
                    out.append((name, e - s, w.text(s, e).decode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["i", "n", "t"])

    return mapped(benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")), run, "i string, n long, t string")


def _blocks(benchmark: DataFrame, item: str, text: str, length: int, block_bytes: int) -> Iterator[tuple[list[tuple[str, int, str]], bool]]:
    """Pieces in blocks of about block_bytes, and whether it is the last."""
    pieces = cut(_pieces(benchmark, item, text, length))
    total = pieces.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = -(-2 * total // block_bytes) if total > block_bytes else 1
    for b in range(n):
        part = pieces if n == 1 else pieces.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield [(r.i, r.n, r.t) for r in part.collect()], b == n - 1


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Of every document row: key, n_words, n_hit, items (sorted ids as strings), spans (first and end word of each stretch hit, in turn) and a struct ``row`` of the columns in ``keep``."""
    spark = docs.sparkSession
    own = {"key": key, **{f"kept_{i}": c for i, c in enumerate(keep)}}
    kinds = {name: docs.schema[c].dataType.simpleString() for name, c in own.items()}
    out = docs.select(docs[key].alias("key"), docs[text].alias("text"), F.lit(None).cast("binary").alias("hit"), F.expr("cast(array() as array<string>)").alias("items"), *[docs[f"`{c}`"].alias(f"kept_{i}") for i, c in enumerate(keep)])
    for block, last in _blocks(benchmark, item, item_text, length, block_bytes):
        index = spark.sparkContext.broadcast(Index(block, length))
        out = _pass(out, index, kinds, last)
        if not last:
            out = cut(out)
            index.unpersist()
    return out.select(F.col("key").alias(key), "n_words", "n_hit", "items", "spans", *as_row(keep))


def _pass(docs: DataFrame, shared: Broadcast, kinds: dict[str, str], last: bool) -> DataFrame:
    """Adds one block's hits to those carried; the last pass returns counts instead of texts."""

    extra = [c for c in kinds if c != "key"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        index = shared.value
        texts = batch.column(1)
        data, offsets = utf8(texts)
        for lo, hi in chunked(offsets):
            w = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ALNUM, lower=True)
            mask, found = index.hits(w)
            before = batch.column(2).slice(lo, hi - lo).to_pylist()
            items = batch.column(3).slice(lo, hi - lo).to_pylist()
            for r, names in found.items():
                items[r] = sorted({*items[r], *names})
            for r, raw in enumerate(before):
                if raw is not None:
                    own = slice(w.first[r], w.first[r + 1])
                    mask[own] |= np.unpackbits(np.frombuffer(raw, np.uint8), count=w.first[r + 1] - w.first[r]).astype(bool)
            more = [c.slice(lo, hi - lo) for c in batch.columns[4:]]
            count = np.diff(w.first)
            keys, item_lists = batch.column(0).slice(lo, hi - lo), pa.array(items, pa.list_(pa.string()))
            if last:
                n_hit = np.diff(np.r_[0, np.cumsum(mask)][w.first])
                spans: list[list[int]] = [[] for _ in range(hi - lo)]
                for r in np.flatnonzero(n_hit).tolist():
                    spans[r] = np.flatnonzero(np.diff(np.r_[False, mask[w.first[r] : w.first[r + 1]], False])).tolist()
                yield pa.RecordBatch.from_arrays([keys, pa.array(count), pa.array(n_hit, pa.int64()), item_lists, pa.array(spans, pa.list_(pa.int64())), *more], ["key", "n_words", "n_hit", "items", "spans", *extra])
            else:
                bits = [np.packbits(mask[a:b]).tobytes() if mask[a:b].any() else None for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([keys, texts.slice(lo, hi - lo), pa.array(bits, pa.binary()), item_lists, *more], ["key", "text", "hit", "items", *extra])

    middle = "n_words long, n_hit long, items array<string>, spans array<long>" if last else "text string, hit binary, items array<string>"
    return mapped(docs, run, ", ".join([f"key {kinds['key']}", middle, *(f"{c} {kinds[c]}" for c in extra)]))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The report columns of decontaminate()'s result."""
    return found.select(key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
