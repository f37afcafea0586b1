"""Operator 5: near-duplicate documents by SetSketch registers.

A document's set holds its distinct ``shingle``-word shingles. Register i of its sketch is
floor(1 - log_b(x_i)), cut to a range, where x_i is the least of independent exponential
values that the set's elements draw. An element's draws are the arrivals of a Poisson
process over (time, register), made in order of time and left off once they exceed all of
the document's registers; so a large set costs little more than one draw an element.
Sketches of parts merge by register maxima.

Flow: (1) one scan gives each row its set's size, digest and sketch; equal sets collapse to
one representative, so copies are never paired; (2) bands of registers are keys, and each
key's documents are paired with its least document only; (3) pairs are estimated jointly
by maximum likelihood from sizes and register order, and those within reach of the
threshold are confirmed on full sets, which a second scan rebuilds just for the documents
that a Bloom filter of bounded size lets pass; (4) components of confirmed links; (5) where
a key's documents still fall into several components, they are compared across components,
so that no link of documents with a common key is lost: keys of at most ``FEW`` documents
by the pairs of their documents, estimated and confirmed as before, and larger ones by
full sets in cells of bounded size, as products of membership matrices inside tasks, which
give back a spanning forest of new links. Documents that larger keys tie together are one
family there, so that documents with many common keys meet once.

Bands are the longest of ``REGISTERS`` registers that a pair at the threshold misses with a
chance of ``MISS`` at most: 40 bands of 5 at 0.8, missed with (1 - 0.8**5)**40, about 1e-7.
The estimate may fall 5 standard errors short. Sets are compared as 64-bit hashes of their
shingles, whose windows of words are hashed modulo a prime.

Defined cases: null and empty texts have an empty set and link with nothing; an empty table
gives an empty one; texts of any length are read whole; a text of fewer words than a
shingle is one element; a pair at the threshold itself is linked; rows that repeat an id
are one node, whose links are those of all its rows; a null id is a node below all others;
further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bloom, may_hold
from .components import components
from .frames import cut, dealt_anew, mapped, partitions
from .textops import SPACED, chunked, mix, planes, rolling, unplanes, utf8, words

#: Registers of a sketch, and the chance at most that a pair at the threshold shares no band.
REGISTERS, MISS = 200, 2e-7
#: Base of the registers' exponential spacing, rate of the draws, greatest register value.
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Documents in a slice; a cell compares two slices. Columns of a membership matrix at once.
CELL, COLUMNS = 128, 4096
#: Documents of a key that are compared by pairs; parts in which a family's join is dealt.
FEW, SALTS = 32, 16
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_ALL = (1 << 64) - 1
_LEAST = np.iinfo(np.int64).min
_SET_BYTES = 8


def sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and where each text's begin."""
    w = words(data, offsets, SPACED, lower=True)
    full = rolling(w.hash, shingle)[w.spans(shingle)]
    row = w.row[w.spans(shingle)]
    count = np.diff(w.first)
    for short in np.flatnonzero((count > 0) & (count < shingle)).tolist():
        a, b = w.first[short], w.first[short + 1]
        full = np.append(full, rolling(w.hash[a:b], int(b - a))[0])
        row = np.append(row, short)
    order = np.lexsort((full, row))
    full, row = full[order], row[order]
    fresh = np.r_[True, (full[1:] != full[:-1]) | (row[1:] != row[:-1])] if len(full) else np.zeros(0, bool)
    full, row = full[fresh], row[fresh]
    return full, np.searchsorted(row, np.arange(len(offsets)))


def sketch(elements: np.ndarray, first: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers of each set, one row a set; empty sets have zeros."""
    n = len(first) - 1
    least = np.full((n, m), np.inf)
    row = np.repeat(np.arange(n), np.diff(first))
    flat, time, step = least.ravel(), np.zeros(len(elements)), 0
    while len(elements):
        step += 1
        z = mix(elements + np.uint64(step * int(_GOLDEN) & _ALL))
        time = time - np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (RATE * m)
        register = ((mix(z ^ _GOLDEN) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(flat, row * m + register, time)
        going = time < least.max(axis=1)[row]
        elements, row, time = elements[going], row[going], time[going]
    with np.errstate(divide="ignore"):
        value = np.floor(1.0 - np.log(least) / np.log(BASE))
    return np.clip(value, 0, TOP).astype(np.uint16)


def bands_of(share: int) -> tuple[int, int]:
    """Bands and registers of each for a threshold in percent."""
    for rows in range(REGISTERS, 0, -1):
        bands = REGISTERS // rows
        if (1 - (share / 100) ** rows) ** bands <= MISS:
            return bands, rows
    raise ValueError(f"{REGISTERS} registers can't find pairs at a similarity of {share} percent")


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each sketch."""
    n = len(registers)
    part = registers[:, : bands * rows].reshape(n, bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _GOLDEN, (n, bands)).copy()
    for r in range(rows):
        key = mix(key ^ (part[:, :, r] + np.uint64((r + 1) * int(_GOLDEN) & _ALL)))
    return key.view(np.int64)


def joint_estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches of sets of known sizes."""
    more, less = (x > y).sum(axis=1), (x < y).sum(axis=1)
    same = x.shape[1] - more - less
    u = nx / (nx + ny)
    v = 1.0 - u

    def p(t):
        return -np.log1p(-np.clip(t, 1e-12, 1.0) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        a, b = p(u - v * j), p(v - u * j)
        return more * np.log(a) + less * np.log(b) + same * np.log(np.clip(1 - a - b, 1e-12, 1.0))

    lo, hi = np.zeros(len(x)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one maximum
        c, d = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        up = likelihood(c) < likelihood(d)
        lo, hi = np.where(up, c, lo), np.where(up, hi, d)
    return (lo + hi) / 2


def _signatures(docs: DataFrame, shingle: int, share: int) -> DataFrame:
    """id, n, d1, d2 and sketch of every row; sets too small for a link to another set have no sketch."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = utf8(batch.column(1))
        for lo, hi in chunked(offsets):
            elements, first = sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shingle)
            n = np.diff(first)
            sums = np.r_[np.uint64(0), np.cumsum(elements)]
            other = np.r_[np.uint64(0), np.cumsum(mix(elements ^ _GOLDEN))]
            d1, d2 = sums[first[1:]] - sums[first[:-1]], other[first[1:]] - other[first[:-1]]
            big = n * (100 - share) >= share  # a set and the least one that holds it and more
            keep = np.repeat(big, n)
            registers = sketch(elements[keep], np.r_[0, np.cumsum(n[big])])
            blobs = iter(registers.astype("<u2").view(np.uint8).reshape(-1, REGISTERS * 2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array([next(blobs).tobytes() if b else None for b in big.tolist()], pa.binary())],
                ["id", "n", "d1", "d2", "sketch"],
            )

    return mapped(docs, run, "id long, n long, d1 long, d2 long, sketch binary")


def _banded(reps: DataFrame, share: int) -> DataFrame:
    bands, rows = bands_of(share)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, _ = utf8(batch.column(1))
        keys = band_keys(raw.view("<u2").reshape(-1, REGISTERS), bands, rows)
        return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), bands))], ["key", "id"])

    return mapped(reps.select("id", "sketch"), run, "key long, id long")


def _likely(pairs: DataFrame, reps: DataFrame, share: int) -> DataFrame:
    """Pairs (a, b) whose joint estimate is within five standard errors of the threshold."""
    s = reps.select("id", "n", "sketch")
    joined = pairs.join(s.toDF("a", "na", "sa"), "a").where("na > 0").join(s.toDF("b", "nb", "sb"), "b").where(f"least(na, nb) * 100 >= greatest(na, nb) * {share}").select("a", "b", "na", "nb", "sa", "sb")
    floor = share / 100 - 5 * (share / 100 * (1 - share / 100) / REGISTERS) ** 0.5

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (utf8(batch.column(c))[0].view("<u2").reshape(-1, REGISTERS) for c in (4, 5))
        ok = joint_estimate(x, y, batch.column(2).to_numpy(), batch.column(3).to_numpy()) >= floor
        return pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], ["a", "b"])

    return mapped(joined, run, "a long, b long")


def _full_sets(ids: DataFrame, base: DataFrame, shingle: int) -> DataFrame:
    """id and packed full set, for the documents that a Bloom filter over ids lets pass."""
    bits = ids.sparkSession.sparkContext.broadcast(bloom(ids, "id"))

    def build(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        batch = batch.filter(pa.array(may_hold(bits.value, batch.column(0).to_numpy())))
        data, offsets = utf8(batch.column(1))
        for lo, hi in chunked(offsets):
            elements, first = sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shingle)
            short = elements >> np.uint64(64 - 8 * _SET_BYTES)
            blobs = [planes(np.diff(short[a:b], prepend=np.uint64(0)), _SET_BYTES) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(blobs, pa.binary())], ["id", "elements"])

    return mapped(base, build, "id long, elements binary")


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw, len(raw) // _SET_BYTES, _SET_BYTES))


def _confirmed(pairs: DataFrame, base: DataFrame, shingle: int, share: int) -> DataFrame:
    """Pairs whose full sets reach the threshold; sets are rebuilt for the documents of pairs only."""
    full = _full_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), base, shingle)
    joined = pairs.join(full.select(F.col("id").alias("a"), F.col("elements").alias("ea")), "a").join(full.select(F.col("id").alias("b"), F.col("elements").alias("eb")), "b")

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = _unpacked(x), _unpacked(y)
            s = np.sort(np.r_[x, y])
            both = int((s[1:] == s[:-1]).sum())
            ok.append(100 * both >= share * (len(x) + len(y) - both))
        return pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return mapped(joined.select("a", "b", "ea", "eb"), check, "a long, b long")


def _cell_links(ids: np.ndarray, own: np.ndarray, full: list[np.ndarray], share: int) -> np.ndarray:
    """Links across components among a cell's documents: a spanning forest of them."""
    n = np.array([len(x) for x in full], np.int64)
    vocabulary, place = np.unique(np.concatenate(full), return_inverse=True)
    row = np.repeat(np.arange(len(full)), n)
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    both = np.zeros((len(full), len(full)), np.float32)
    for lo in range(0, len(vocabulary), COLUMNS):
        a, b = np.searchsorted(place, (lo, lo + COLUMNS))
        m = np.zeros((len(full), COLUMNS), np.float32)
        m[row[a:b], place[a:b] - lo] = 1
        both += m @ m.T
    p, q = np.nonzero(np.triu(100 * both >= share * (n[:, None] + n[None, :] - both), 1) & (own[:, None] != own[None, :]))
    root = {c: c for c in own.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for x, y in zip(p.tolist(), q.tolist(), strict=True):
        u, v = find(int(own[x])), find(int(own[y]))
        if u != v:
            root[max(u, v)] = min(u, v)
            out.append((ids[x], ids[y]))
    return np.array(out, np.int64).reshape(-1, 2)


def _across(placed: DataFrame, base: DataFrame, shingle: int, share: int) -> DataFrame:
    """Links across components (c) among the documents (id) of each family, by full sets."""
    spark = placed.sparkSession
    mixed = placed.groupBy("family").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("size")).where("c0 < c1").select("family", F.ceil(F.col("size") / CELL).cast("int").alias("k"))
    # a family may hold most documents, so its join is dealt by a salt too
    salted = mixed.select("family", "k", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    members = placed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["family", "salt"]).drop("salt")
    members = cut(members.withColumn("s", F.pmod(F.xxhash64("id", F.lit(1)), F.col("k")).cast("int")))
    full = members.join(_full_sets(members.select("id").distinct(), base, shingle), "id")
    cells = full.select("family", "id", "c", "s", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("t"), "elements").select("family", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"), "id", "c", "elements")
    dealt = cells.repartition(partitions(spark), "family", "i", "j").sortWithinPartitions("family", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []

        def close():
            own = np.array([c for _, c, _ in rows], np.int64)
            if len(rows) > 1 and (own != own[0]).any():
                got = _cell_links(np.array([i for i, _, _ in rows], np.int64), own, [_unpacked(e) for _, _, e in rows], share)
                if len(got):
                    yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])

        for batch in batches:
            for *at, i, c, e in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if at != cell:
                    yield from close()
                    cell, rows = at, []
                rows.append((i, c, e))
        yield from close()

    return dealt.mapInArrow(run, "a long, b long")


def _placed(rows: DataFrame, found: DataFrame, column: str, name: str) -> DataFrame:
    """Rows with the component of a column's documents, their own id where they have none."""
    own = found.select(F.col("node").alias(column), F.col("component").alias(name))
    return rows.join(own, column, "left").withColumn(name, F.coalesce(name, column))


def _missed(tied: DataFrame, found: DataFrame, reps: DataFrame, base: DataFrame, shingle: int, share: int) -> DataFrame:
    """Links across components among the documents (b) of each key besides its least one (a)."""
    marked = cut(_placed(_placed(tied, found, "a", "ca"), found, "b", "cb"))
    sizes = marked.groupBy("key").agg(F.min(F.least("ca", "cb")).alias("c0"), F.max(F.greatest("ca", "cb")).alias("c1"), F.min("cb").alias("b0"), F.max("cb").alias("b1"), F.count(F.lit(1)).alias("size"))
    mixed = sizes.where("c0 < c1 and b0 < b1").select(dealt_anew("key"), "size")
    members = cut(marked.join(mixed, "key").select("key", "a", F.col("b").alias("id"), F.col("cb").alias("c"), "ca", "size"))
    few = members.where(f"size <= {FEW}").select("key", "id", "c")
    pairs = few.toDF("key", "a", "ca").join(few.toDF("key", "b", "cb"), "key").where("a < b and ca <> cb").select("a", "b").distinct()
    found_few = _confirmed(cut(_likely(pairs, reps, share)), base, shingle, share)
    many = members.where(f"size > {FEW}")
    if not many.take(1):
        return found_few
    ends = many.select("id", "c").union(many.select(F.col("a").alias("id"), F.col("ca").alias("c"))).distinct()
    families = components(many.select("a", F.col("id").alias("b"))).select(F.col("node").alias("id"), F.col("component").alias("family"))
    return found_few.union(_across(cut(ends.join(families, "id").select("family", "id", "c")), base, shingle, share))


def near_duplicates(docs: DataFrame, shingle: int = 2, share: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id of every row.

    Links join documents with 100 * |A & B| >= share * |A | B|; equal sets are linked too.
    """
    base = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LEAST)).alias("id"), F.col(text).alias("text"))
    rows = cut(_signatures(base, shingle, share))
    own = rows.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("n", dealt_anew("d1"), "d2", "rep")
    copies = cut(rows.where("n > 0").join(own, ["n", "d1", "d2"]).where("rep < id").select("rep", "id", "d1", "d2").distinct())
    reps = rows.where("sketch is not null").join(copies.select("id", "d1", "d2"), ["id", "d1", "d2"], "left_anti")
    copies = copies.select(F.col("rep").alias("a"), F.col("id").alias("b"))
    banded = _banded(reps, share)
    leaders = banded.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("key", "a")
    tied = cut(banded.join(leaders, "key").where("a < id").select("key", "a", F.col("id").alias("b")))
    pairs = tied.select("a", "b").distinct()
    links = cut(copies.union(_confirmed(cut(_likely(pairs, reps, share)), base, shingle, share)))
    found = components(links)
    more = cut(_missed(tied, found, reps, base, shingle, share))
    if more.take(1):
        found = components(links.union(more))
    out = rows.select("id", "n").join(found, rows["id"] == found["node"], "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    real = lambda c: F.when(F.col(c) != _LEAST, F.col(c))
    return out.select(real("id").alias(key), "n_shingles", real("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))

