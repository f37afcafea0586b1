"""Operator 13: centroid clustering of integer vectors with Hamerly's bounds.

Components become the integers floor(scale * x). Centroids start as the vectors whose salted ids have the least hashes;
each round assigns every vector to the nearest centroid (squared Euclidean distance, ties to the smaller number) and moves
the centroids to the floored means of their members. A vector keeps an upper bound of the distance to its own centroid and
one lower bound of the distance to all others. Both are loosened by what the centroids drifted; a vector stays where it is
if the upper bound is below the lower one, or below half the way from its centroid to the nearest other. Else the upper
bound is made exact, and only vectors that are ambiguous still get a full scan in exact integers. Bounds are rounded
outwards, and only strict inequalities keep a vector, so ties and rounding can't change a result.

Vectors are read once and travel with their bounds from one table in the shared folder to the next, each replacing the one
before; sums are maintained by the plus and minus contributions of vectors that moved (see lloyd.py).

Defined cases: vectors that are null, of another length than ``dim``, or hold null or non-finite components are left out;
rows that repeat an id count each, and come in order of components where their hashes tie for a starting place; null ids
come last there; fewer vectors than clusters make fewer centroids; an empty table gives an empty one; components too large
for exact distances are an error; further columns are dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import mapped
from .lloyd import ROWS, Sums, Table, extent, finite, integers, packed, unpacked, width_for

#: Outward rounding of bounds, relative.
SLACK = 1e-9


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances (n, k) of integers."""
    out = np.empty((len(x), len(centres)), np.int64)
    for c, centre in enumerate(centres):
        d = x - centre
        out[:, c] = np.einsum("ij,ij->i", d, d)
    return out


def scanned(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each vector, and both bounds, by a full scan."""
    own, upper, lower = np.empty(len(x), np.int64), np.empty(len(x)), np.empty(len(x))
    for lo in range(0, len(x), ROWS):
        far = squared(x[lo : lo + ROWS], centres)
        best = far.argmin(axis=1)
        own[lo : lo + ROWS], upper[lo : lo + ROWS] = best, np.sqrt(far[np.arange(len(far)), best])
        far[np.arange(len(far)), best] = np.iinfo(np.int64).max
        lower[lo : lo + ROWS] = np.sqrt(far.min(axis=1)) if len(centres) > 1 else np.inf
    return own, upper * (1 + SLACK), lower * (1 - SLACK)


class Drift:
    """What a move of the centroids does to bounds."""

    def __init__(self, before: np.ndarray, after: np.ndarray):
        self.after = after
        self.own = np.sqrt(((after - before) ** 2).sum(axis=1)) * (1 + SLACK)
        # the farthest drift of any other centroid
        order = np.argsort(self.own)
        self.other = np.full(len(after), self.own[order[-1]])
        self.other[order[-1]] = self.own[order[-2]] if len(after) > 1 else 0.0
        apart = np.sqrt(squared(after, after).astype(np.float64))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(axis=1) / 2 * (1 - SLACK)

    def step(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New centroids and bounds of vectors, and how many were scanned in full."""
        own, upper, lower = own.copy(), upper + self.own[own], lower - self.other[own]
        unsure = np.flatnonzero(upper >= np.maximum(lower, self.half[own]))
        d = x[unsure] - self.after[own[unsure]]
        upper[unsure] = np.sqrt(np.einsum("ij,ij->i", d, d)) * (1 + SLACK)
        unsure = unsure[upper[unsure] >= np.maximum(lower[unsure], self.half[own[unsure]])]
        own[unsure], upper[unsure], lower[unsure] = scanned(x[unsure], self.after)
        return own, upper, lower, len(unsure)


def centroid_sha256(centre: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centre.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, clusters: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, salt: str = "3", key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """key, cluster and squared distance of each vector, and the centroids (clusters, dim)."""
    spark = vectors.sparkSession
    kind = vectors.select(vectors[f"`{key}`"].alias("key")).schema["key"].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("x")).where(finite("x") & (F.size("x") == dim))
    sizes = extent(rows, "x").collect()  # one row: all are of one length
    if not sizes:
        return spark.createDataFrame([], f"key {kind}, cluster int, distance long"), np.zeros((0, dim), np.int64)
    width = width_for(sizes[0].most, scale, dim)
    hashed = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("key").cast("string")), 256)
    first = rows.orderBy(hashed.asc_nulls_last(), "x").limit(clusters).select("x").toArrow().column(0).combine_chunks()
    sums = Sums(integers(first, dim, scale)[None])
    kept = Table(spark, "clusters")
    schema, names = f"key {kind}, x binary, own int, was int, upper double, lower double", ["key", "x", "own", "was", "upper", "lower"]

    def begin(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = integers(batch.column("x"), dim, scale)
        own, upper, lower = scanned(x, start)
        return pa.RecordBatch.from_arrays([batch.column("key"), packed(x, width), pa.array(own.astype(np.int32)), pa.nulls(len(x), pa.int32()), pa.array(upper), pa.array(lower)], names)

    def later(drift: Drift):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, was = unpacked(batch.column("x"), dim, width), batch.column("own")
            own, upper, lower, _ = drift.step(x, *(batch.column(c).to_numpy() for c in ("own", "upper", "lower")))
            return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("x"), pa.array(own.astype(np.int32)), was, pa.array(upper), pa.array(lower)], names)

        return run

    def state(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        column = lambda c: batch.column(c).to_numpy().astype(np.int64)[:, None]
        return unpacked(batch.column("x"), dim, width)[:, None], column("own"), None if batch.column("was").null_count else column("was")

    start = before = sums.centres[0]
    step = begin
    for _ in range(rounds):
        rows = kept.put(mapped(rows.select("key", "x", *([] if step is begin else ["own", "upper", "lower"])), step, schema))
        sums.change(rows.where("was is null or own <> was").select("x", "own", "was"), state)
        before, after = sums.centres[0], sums.move()[0]
        step = later(Drift(before, after))
    centres = sums.centres[0]

    def final(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = step(batch).column("own")
        x = integers(batch.column("x"), dim, scale) if step is begin else unpacked(batch.column("x"), dim, width)
        d = x - centres[own.to_numpy()]
        return pa.RecordBatch.from_arrays([batch.column("key"), own, pa.array(np.einsum("ij,ij->i", d, d))], ["key", "cluster", "distance"])

    return kept.put(mapped(rows, final, f"key {kind}, cluster int, distance long")), centres


def digest(clustered: DataFrame, centres: np.ndarray, key: str = "vec_id") -> DataFrame:
    """The query's columns: cluster, distance, their sums over the cluster and over all, and the digest of the centroid."""
    sums = {r.cluster: r.s for r in clustered.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # one row a cluster
    place = F.col("cluster") + 1
    listed = lambda values, kind: F.element_at(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), place)
    k = range(max(len(centres), 1))
    return clustered.select(
        F.col("key").alias(key), "cluster", "distance", listed([sums.get(c, 0) for c in k], "long").alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"),
        listed([centroid_sha256(c) for c in centres] or [""], "string").alias("centroid_sha256"),
    )
