"""Operator 3: near-duplicate vectors by collision-counting projections.

Unit vectors are projected on ``PROJECTIONS`` random directions. Two vectors collide in a
projection if one's value lies in the window centred on the other's; windows are ``WIDTH``
standard deviations of the difference that vectors at the threshold show. Pairs with at
least so many collisions that a pair at the threshold falls short with chance ``MISS`` at
most (a binomial tail) are verified by cosine in double precision.

Vectors are dealt by the order of one further projection into slices; two slices meet in a
cell only if their values come within the greatest distance that linked unit vectors can
have, which loses no pair. A cell counts collisions as arrays, and gives back a number of
links for each vector and a spanning forest of its links, never pairs. Equal vectors
collapse to one weighted representative before, so copies fill no slice.

Beyond ``BUCKET`` vectors, slices are those of buckets: the signs of k further projections
cut the vectors to 2**k buckets of about that size, anew in each of as many rounds as leave
a pair at the threshold a chance of ``MISS`` to share no bucket. A pair is counted in the
first round in which it shares one, which either vector's signs tell. Work then grows with
the number of vectors times the rounds (1 up to 65,536 vectors, 25 at 10**7, 56 at 10**9)
instead of its square. Within a bucket all slices in reach of each other are compared, so
work in it is quadratic unless vectors are clustered.

Defined cases: null, empty and zero vectors and those with null or non-finite components
link with nothing; an empty table gives an empty one; vectors of different lengths aren't
linked; a pair at the threshold itself is linked; rows that repeat id and vector are one
row; rows that repeat an id with different vectors are one node of the components, each
with the number of its own vector's links; a null id is below all others; further columns
are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, erf, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .frames import cut, dealt_anew, mapped, partitions

PROJECTIONS, WIDTH, MISS = 40, 1.75, 1e-6
#: Vectors of a slice, of a bucket, and rows compared with a slice at once.
SLICE, BUCKET, BLOCK = 4096, 65536, 64
SEED = 20240229
_LEAST = np.iinfo(np.int64).min


def directions(dim: int) -> np.ndarray:
    """Random unit directions, the sorted one first."""
    a = np.random.default_rng((SEED, dim)).standard_normal((dim, PROJECTIONS + 1))
    return a / np.linalg.norm(a, axis=0)


def rounds(n: int, threshold: float) -> tuple[int, int]:
    """Signs of a bucket and rounds for n vectors."""
    if n <= BUCKET:
        return 0, 1
    k = ceil(log2(n / BUCKET))
    shared = (1 - acos(threshold) / pi) ** k
    return k, ceil(log(MISS) / log(1 - shared))


def codes(x: np.ndarray, k: int, turns: int) -> np.ndarray:
    """Bucket of each vector in each round: the signs of k projections of its own."""
    if not k:
        return np.zeros((len(x), turns), np.int64)
    a = np.random.default_rng((SEED, x.shape[1], k, turns)).standard_normal((x.shape[1], turns * k))
    return ((x @ a > 0).reshape(len(x), turns, k) * (1 << np.arange(k))).sum(axis=2)


def needed(projections: int = PROJECTIONS, width: float = WIDTH, miss: float = MISS) -> int:
    """Greatest count that a pair at the threshold reaches but with chance ``miss``."""
    p = erf(width / sqrt(2))
    below = 0.0
    for t in range(projections + 1):
        below += comb(projections, t) * p**t * (1 - p) ** (projections - t)
        if below > miss:
            return t
    return projections


def unit(raw: bytes, dim: int, kind: str) -> np.ndarray:
    x = np.frombuffer(raw, kind).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cell_links(x: np.ndarray, first: np.ndarray, weight: np.ndarray, threshold: float, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weighted number of links of each vector and the linked index pairs of a spanning forest.

    ``first`` marks the slice of each row; if both slices occur, only pairs across them count.
    ``before`` has each row's buckets of earlier rounds; pairs that shared one are left out.
    """
    dim = x.shape[1]
    reach = sqrt(2 - 2 * threshold)
    half = WIDTH * reach / sqrt(dim)
    least = needed()
    p = x @ directions(dim)[:, 1:]
    # steps of a sixteenth of the window in one byte: clipped tails and wrapped differences only add collisions
    q = np.clip(np.round(p * (16 / half)) + 128, 0, 255).astype(np.uint8)
    one, two = np.flatnonzero(first), np.flatnonzero(~first)
    same = not len(two)
    two = one if same else two
    links, root, forest = np.zeros(len(x), np.int64), list(range(len(x))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    right = np.ascontiguousarray(q[two].T)
    for a in range(0, len(one), BLOCK):
        rows = one[a : a + BLOCK]
        lo = a if same else 0  # the lower triangle has been done
        count = np.zeros((len(rows), len(two) - lo), np.uint8)
        apart, inside = np.empty_like(count), np.empty(count.shape, bool)
        for j in range(PROJECTIONS):
            np.subtract(right[j, lo:][None, :], (q[rows, j] - np.uint8(17))[:, None], out=apart)
            np.less_equal(apart, 34, out=inside)
            np.add(count, inside.view(np.uint8), out=count)
        i, k = np.nonzero(count >= least)
        i, k = rows[i], two[k + lo]
        if same:
            i, k = i[i < k], k[i < k]
        ok = np.einsum("ij,ij->i", x[i], x[k]) >= threshold
        i, k = i[ok], k[ok]
        if before is not None and before.shape[1]:
            fresh = np.concatenate([~(before[i[c : c + 4096]] == before[k[c : c + 4096]]).any(axis=1) for c in range(0, len(i), 4096)] or [np.zeros(0, bool)])
            i, k = i[fresh], k[fresh]
        np.add.at(links, i, weight[k])
        np.add.at(links, k, weight[i])
        for u, v in zip(i.tolist(), k.tolist(), strict=True):
            r, s = find(u), find(v)
            if r != s:
                root[r] = s
                forest.append((u, v))
    return links, np.array(forest, np.int64).reshape(-1, 2)


def near_vectors(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, n_links, component_id and kept of every vector."""
    spark = vectors.sparkSession
    kind = "<f8" if isinstance(vectors.schema[column].dataType.elementType, T.DoubleType) else "<f4"
    base = vectors.select(F.coalesce(F.col(key).cast("long"), F.lit(_LEAST)).alias("id"), F.col(column).alias("v"))

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Usable vectors as their bytes, with the value of the sorted projection."""
        column = batch.column(1)
        edge = column.offsets.to_numpy().astype(np.int64)
        flat = column.values.slice(int(edge[0]), int(edge[-1] - edge[0]))
        edge = edge - edge[0]
        amiss = flat.is_null().to_numpy(zero_copy_only=False)
        x = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
        amiss |= ~np.isfinite(x)
        size = np.diff(edge)
        wrong, some = (np.r_[0, np.cumsum(m)] for m in (amiss, x != 0))
        ok = column.is_valid().to_numpy(zero_copy_only=False) & (wrong[edge[1:]] == wrong[edge[:-1]]) & (some[edge[1:]] > some[edge[:-1]])
        value = np.full(len(size), np.nan)
        for dim in np.unique(size[ok]).tolist():
            own = np.flatnonzero(ok & (size == dim))
            value[own] = unit(x[(edge[own][:, None] + np.arange(dim)).ravel()].tobytes(), dim, kind) @ directions_first(dim)
        raw = [x[a:b].tobytes() if o else None for a, b, o in zip(edge[:-1].tolist(), edge[1:].tolist(), ok.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(value, mask=~ok)], ["id", "v", "p"])

    rows = cut(mapped(base, pack, "id long, v binary, p double").distinct())
    reps = cut(rows.where("v is not null").groupBy("v", "p").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w")))
    n = reps.count()
    k, turns = rounds(n, threshold)
    cuts = -(-n // SLICE >> k)
    bounds = [] if cuts < 2 else reps.agg(F.percentile_approx("p", [i / cuts for i in range(1, cuts)], 10 * cuts)).first()[0]
    bounds = spark.sparkContext.broadcast(np.unique(np.array(bounds, np.float64)))  # one number a slice of a bucket
    reach = sqrt(2 - 2 * threshold) + 1e-9

    def deal(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Each vector to the cells of its slice with all slices in reach, in every round."""
        edge, p = bounds.value, batch.column(1).to_numpy()
        s = np.searchsorted(edge, p, "right")
        lo, hi = np.r_[-np.inf, edge], np.r_[edge, np.inf]
        left = np.searchsorted(hi, lo[s] - reach)  # slices that reach up to mine
        right = np.searchsorted(lo, hi[s] + reach, "right")
        left[s == 0], right[s == len(edge)] = 0, len(lo)
        count = right - left
        mine = np.repeat(np.arange(len(p)), count)
        other = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(left, count)
        a, b = np.minimum(s[mine], other), np.maximum(s[mine], other)
        taken = batch.take(pa.array(mine))
        bucket = np.zeros((len(p), turns), np.int64)
        if k:
            raw = batch.column(0).to_pylist()
            dims = np.array([len(v) // int(kind[2]) for v in raw])
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                bucket[own] = codes(unit(b"".join([raw[i] for i in own.tolist()]), dim, kind), k, turns)
        for turn in range(turns):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(mine), turn)), pa.array(bucket[mine, turn]), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(s[mine] == a), taken.column(0), taken.column(2), taken.column(3)],
                ["turn", "bucket", "i", "j", "first", "v", "id", "w"],
            )

    dealt = mapped(reps.select("v", "p", "id", "w"), deal, "turn long, bucket long, i long, j long, first boolean, v binary, id long, w long")
    dealt = dealt.repartition(partitions(spark), "turn", "bucket", "i", "j").sortWithinPartitions("turn", "bucket", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def close():
            by_dim: dict[int, list] = {}
            for row in held:
                by_dim.setdefault(len(row[1]) // int(kind[2]), []).append(row)
            for dim, own in by_dim.items():
                first, raw, ids, w = zip(*own, strict=True)
                ids, first = np.array(ids, np.int64), np.array(first)
                if cell[2] != cell[3] and (first.all() or not first.any()):
                    continue
                x = unit(b"".join(raw), dim, kind)
                links, forest = cell_links(x, first, np.array(w, np.int64), threshold, codes(x, k, turns)[:, : cell[0]] if k else None)
                some = np.flatnonzero(links)
                if len(some):
                    a, b = np.r_[ids[some], ids[forest[:, 0]]], np.r_[ids[some], ids[forest[:, 1]]]
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.r_[links[some], np.zeros(len(forest), np.int64)])], ["a", "b", "n"])

        for batch in batches:
            for turn, bucket, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (turn, bucket, i, j) != cell:
                    if held:
                        yield from close()
                    cell, held = (turn, bucket, i, j), []
                held.append(row)
        if held:
            yield from close()

    found = cut(dealt.mapInArrow(run, "a long, b long, n long"))
    count = found.where("a = b").groupBy("a").agg(F.sum("n").alias("n"))
    # different vectors of one id are one node
    split = rows.where("v is not null").groupBy("id").agg(F.min("v").alias("v0"), F.max("v").alias("v1")).where("v0 < v1").select(dealt_anew("id"))
    own = rows.join(split, "id").select("id", "v").join(reps.select("v", F.col("id").alias("b")), "v").select("id", "b")
    tied = own.join(own.groupBy("id").agg(F.min("b").alias("a")), "id").where("a <> b").select("a", "b")
    links = found.where("a <> b").select("a", "b").union(tied)
    placed = reps.join(count, reps["id"] == count["a"], "left").join(components(links), reps["id"] == F.col("node"), "left")
    placed = placed.select("v", (F.coalesce("n", F.lit(0).cast("long")) + F.col("w") - 1).alias("n_links"), F.coalesce("component", reps["id"]).alias("component_id"))
    out = rows.select("id", "v").join(placed, "v", "left").select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    real = lambda c: F.when(F.col(c) != _LEAST, F.col(c))
    return out.select(real("id").alias(key), "n_links", real("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))


def directions_first(dim: int) -> np.ndarray:
    if dim not in _FIRST:
        _FIRST[dim] = directions(dim)[:, 0]
    return _FIRST[dim]


_FIRST: dict[int, np.ndarray] = {}
