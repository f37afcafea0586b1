"""Operator 2: removal of repeated substrings by Rabin-Karp window hashes.

Every window of ``length`` consecutive words of every text gets a rolling polynomial hash.
Windows are grouped by hash in Spark, and a window is repeated if the same hash also
starts earlier: in a smaller document id, or earlier in the same document. Words that a
repeated window covers go; overlapping and touching windows merge into maximal intervals.

Flow: (1) a map task hashes the windows of a batch, keeps each hash's earliest window and
marks the others, so a passage that every document holds is sent once a batch; (2) the
kept hashes are dealt by value into partitions, as byte planes of about 12 bytes a window;
(3) each partition marks all but the earliest window of each hash; (4) marks, packed for
many documents a row, are dealt by document and joined with those texts that a Bloom filter
over marked documents lets pass, which are cut; all other texts are never shuffled.

Two hashes of different bases tell windows apart, 80 bits of them and the partition's
number besides: of n windows in p partitions about n * n / 2**81 / p are taken for repeated
by chance, 4e-5 for 10**12 windows in 10**4 partitions. Words are not compared again.

Defined cases: null and empty texts have no words; an empty table gives an empty one; a
text of any length is hashed whole, piece by piece of a batch; a null document id sorts
before all others; rows with one id and one text are one document (both copies keep and
lose the same words), rows with one id and different texts are judged against each other
only by start; further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bloom, may_hold
from .frames import cut, mapped, partitions
from .textops import SPACED, chunked, mix, planes, unplanes, utf8, words

#: Bytes of text whose windows are grouped before the shuffle.
BATCH = 8 << 20
#: Bytes kept of either hash.
_WIDTH, _WIDTH2 = 7, 3
_LEAST = np.iinfo(np.int64).min


def _earliest(h: np.ndarray, g: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mask of the windows that are the earliest (doc, at) of their two hashes; ties are all earliest."""
    order = np.lexsort((at, doc, g, h))
    hs, gs, ds, ts = h[order], g[order], doc[order], at[order]
    fresh = np.r_[True, (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1])] if len(h) else np.zeros(0, bool)
    group = np.flatnonzero(fresh)
    lead = np.repeat(group, np.diff(np.r_[group, len(h)]))
    out = np.zeros(len(h), bool)
    out[order] = (ds == ds[lead]) & (ts == ts[lead])
    return out


def _bucket(doc: np.ndarray, digest: np.ndarray, n: int) -> np.ndarray:
    """Partition of a document's marks."""
    h = mix(doc.astype(np.uint64) ^ mix(digest.astype(np.uint64)))
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _documents(doc: np.ndarray, digest: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of each document's stretch of sorted marks."""
    begin = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1])]) if len(doc) else np.zeros(0, np.int64)
    return zip(begin.tolist(), np.r_[begin[1:], len(doc)].tolist(), strict=True)


def _marks(doc: np.ndarray, digest: np.ndarray, start: np.ndarray, n_parts: int) -> pa.RecordBatch:
    """Starts of repeated windows, one row for each partition of documents."""
    part = _bucket(doc, digest, n_parts)
    order = np.lexsort((start, digest, doc, part))
    doc, digest, start, part = doc[order], digest[order], start[order], part[order]
    bound = np.searchsorted(part, np.arange(n_parts + 1))
    used = np.flatnonzero(np.diff(bound))
    blobs = []
    for p in used.tolist():
        a, b = int(bound[p]), int(bound[p + 1])
        edges = [x for x, _ in _documents(doc[a:b], digest[a:b], start[a:b])]
        step = np.diff(start[a:b], prepend=0)
        step[edges] = start[a:b][edges]
        own = np.array(edges) + a
        head = np.array([b - a, len(edges)], "<u8").tobytes()
        blobs.append(head + planes(step, 4) + planes(np.diff(np.r_[edges, b - a]), 4) + doc[own].astype("<i8").tobytes() + digest[own].astype("<i8").tobytes())
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "marks"])


def _unmark(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = (int(x) for x in np.frombuffer(raw, "<u8", 2))
    view, at = memoryview(raw), 16
    step = unplanes(view[at:], n, 4).astype(np.int64)
    count = unplanes(view[at + n * 4 :], m, 4).astype(np.int64)
    at += n * 4 + m * 4
    docs, digests = np.frombuffer(raw, "<i8", m, at), np.frombuffer(raw, "<i8", m, at + m * 8)
    total = np.cumsum(step)
    first = np.r_[0, np.cumsum(count)[:-1]]
    return np.repeat(docs, count), np.repeat(digests, count), total - np.repeat(total[first] - step[first], count)


def _merge_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All marks of a partition's documents to one row a document."""
    parts = [_unmark(raw) for batch in batches for raw in batch.column(1).to_pylist()]
    if not parts:
        return
    doc, digest, start = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((start, digest, doc))
    doc, digest, start = doc[order], digest[order], start[order]
    bounds = list(_documents(doc, digest, start))
    own = [a for a, _ in bounds]
    blobs = [planes(np.diff(start[a:b], prepend=0), 4) for a, b in bounds]
    yield pa.RecordBatch.from_arrays([pa.array(doc[own]), pa.array(digest[own]), pa.array(blobs, pa.binary())], ["doc", "digest", "starts"])


def _pack(h, g, row, at, docs, digests) -> bytes:
    """Windows of one batch and partition, in order of document and start."""
    own, first, count = np.unique(row, return_index=True, return_counts=True)
    step = np.diff(at, prepend=0)
    step[first] = at[first]
    head = np.array([len(h), len(own)], "<u8").tobytes()
    return head + planes(h, _WIDTH) + planes(g, _WIDTH2) + planes(step, 4) + planes(count, 4) + docs[own].astype("<i8").tobytes() + digests[own].astype("<i8").tobytes()


def _unpack(raw: bytes):
    n, m = (int(x) for x in np.frombuffer(raw, "<u8", 2))
    view, at = memoryview(raw), 16
    h, g = unplanes(view[at:], n, _WIDTH), unplanes(view[at + n * _WIDTH :], n, _WIDTH2)
    at += n * (_WIDTH + _WIDTH2)
    step = unplanes(view[at:], n, 4).astype(np.int64)
    at += n * 4
    count = unplanes(view[at:], m, 4).astype(np.int64)
    at += m * 4
    docs, digests = np.frombuffer(raw, "<i8", m, at), np.frombuffer(raw, "<i8", m, at + m * 8)
    total = np.cumsum(step)
    first = np.r_[0, np.cumsum(count)[:-1]]
    return h, g, np.repeat(docs, count), np.repeat(digests, count), total - np.repeat(total[first] - step[first], count)


def _hash_windows(length: int, n_parts: int):
    """Batches of (doc, digest, text) to rows for the partition of each hash and, beyond them, marks already known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            digest = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in chunked(offsets, BATCH):
                hashes, others, rows, starts = [], [], [], []
                for a, b in chunked(offsets[lo : hi + 1] - offsets[lo]):
                    a, b = a + lo, b + lo
                    w = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], SPACED)
                    at = np.flatnonzero(w.spans(length))
                    hashes.append(w.grams(length)[at])
                    others.append(w.grams(length, 1)[at] >> np.uint64(64 - 8 * _WIDTH2))
                    rows.append(w.row[at] + a)
                    starts.append(at - w.first[w.row[at]])
                h, g, row, at = (np.concatenate(x) for x in (hashes, others, rows, starts))
                first = _earliest(h, g, doc[row], at)
                part = (h >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)
                again = ~first
                if again.any():
                    known = _marks(doc[row[again]], digest[row[again]], at[again], n_parts)
                    yield pa.RecordBatch.from_arrays([*known.columns, pa.nulls(known.num_rows, pa.binary())], ["part", "marks", "windows"])
                h, g, row, at, part = h[first], g[first], row[first], at[first], part[first].astype(np.int64)
                order = np.argsort(part, kind="stable")
                bound = np.searchsorted(part[order], np.arange(n_parts + 1))
                used = np.flatnonzero(np.diff(bound))
                blobs = [_pack(h[o := order[bound[p] : bound[p + 1]]], g[o], row[o], at[o], doc, digest) for p in used.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.nulls(len(used), pa.binary()), pa.array(blobs, pa.binary())], ["part", "marks", "windows"])

    return run


def _find_repeats(n_parts: int):
    """All of a partition's hashes to marks; marks that came along pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            known = batch.filter(batch.column(1).is_valid())
            if known.num_rows:
                yield known.select(["part", "marks"])
            parts += [_unpack(raw) for raw in batch.column(2).to_pylist() if raw is not None]
        if parts:
            h, g, doc, digest, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            order = order[np.r_[False, same] | np.r_[same, False]]  # those that stand alone need no more
            h, g, doc, digest, at = h[order], g[order], doc[order], digest[order], at[order]
            again = ~_earliest(h, g, doc, at)
            if again.any():
                yield _marks(doc[again], digest[again], at[again], n_parts)

    return run


def cover(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask of n words that windows at the starts cover."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, np.minimum(starts + length, n), 1)
    return np.cumsum(edge[:-1]) > 0


def repeated_windows(docs: DataFrame, length: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, digest and packed starts of every document that has repeated windows."""
    n = partitions(docs.sparkSession)
    base = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LEAST)).alias("doc"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))
    windows = base.mapInArrow(_hash_windows(length, n), "part int, marks binary, windows binary")
    marks = windows.repartitionById(n, F.col("part")).mapInArrow(_find_repeats(n), "part int, marks binary")
    return marks.repartitionById(n, F.col("part")).mapInArrow(_merge_marks, "doc long, digest long, starts binary")


def remove_repeats(docs: DataFrame, length: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed, kept (text of the kept words, joined by one space) and spans of removed words of every row."""

    def removed(keys: pa.Array, texts: pa.Array, starts: list[bytes | None]) -> Iterator[pa.RecordBatch]:
        data, offsets = utf8(texts)
        for lo, hi in chunked(offsets):
            w = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], SPACED)
            count, kept, spans = [], [], []
            for r in range(hi - lo):
                a, b = int(w.first[r]), int(w.first[r + 1])
                gone = np.zeros(b - a, bool)
                if raw := starts[lo + r]:
                    gone = cover(np.cumsum(unplanes(raw, len(raw) // 4, 4).astype(np.int64)), length, b - a)
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                spans.append(edge.tolist())
                count.append(int(gone.sum()))
                kept.append(b" ".join([w.text(a + s, a + e) for s, e in _runs(~gone)]) if count[-1] else (w.text(a, b) if b > a else b""))
            yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), pa.array(np.diff(w.first)), pa.array(count, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.int64()))], ["key", "n_words", "n_removed", "kept", "spans"])

    marks = cut(repeated_windows(docs, length, key, text))
    bits = docs.sparkSession.sparkContext.broadcast(bloom(marks, "doc"))
    base = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.col(key).cast("long"), F.lit(_LEAST)).alias("doc"))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_words long, n_removed long, kept string, spans array<long>"

    def unmarked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        batch = batch.filter(pa.array(~may_hold(bits.value, batch.column(2).to_numpy())))
        yield from removed(batch.column(0), batch.column(1), [None] * batch.num_rows)

    def perhaps(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(may_hold(bits.value, batch.column(2).to_numpy())))

    marked = mapped(base, perhaps, f"key {kind}, text string, doc long").withColumn("digest", F.xxhash64("text"))
    joined = marked.join(marks, ["doc", "digest"], "left").select("key", "text", "starts")
    out = mapped(base, unmarked, schema).union(mapped(joined, lambda batch: removed(batch.column(0), batch.column(1), batch.column(2).to_pylist()), schema))
    return out.withColumnRenamed("key", key)


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False])).tolist()
    return list(zip(edge[::2], edge[1::2], strict=True))


def digest(removed: DataFrame, key: str = "doc_id") -> DataFrame:
    return removed.select(key, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
