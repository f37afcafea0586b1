"""Operator 11: vector code compression by product quantisation, its codebooks fitted by delta-maintained Lloyd rounds.

Components become the integers floor(scale * x); a vector is cut into ``parts`` equal consecutive parts, and each part
position has a codebook of at most ``entries`` entries, which start as that part of the vectors of least id. A round
assigns each part to its nearest entry (squared Euclidean distance, ties to the lower index) and moves the entries to the
floored means of their parts. The former assignments and the running integer sums are kept: a round shuffles only plus and
minus contributions of parts whose assignment changed. All arithmetic is exact.

The vectors are read once and travel as narrow integers with their codes from one table in the shared folder to the next,
each replacing the one before, without a join. Errors by label are summed before they are joined back: by broadcast
where the labels are few (they are counted), else by a join over ``SALTS`` parts a label.

Defined cases: vectors that are null, empty or hold null or non-finite components are left out, and so are those whose
length isn't ``dim`` (by default the most frequent multiple of ``parts``, ties to the smaller); rows that repeat an id are
coded each, and where such rows start codebooks they come in order of components; null ids come last in that order; fewer
vectors than entries make smaller codebooks; null labels are one label; an empty table gives an empty one; components too
large for exact sums are an error; further columns are dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import mapped
from .lloyd import ROWS, Sums, Table, binaries, extent, finite, integers, matrix, packed, unpacked, width_for

#: Labels whose error sums are broadcast, and parts of a label where there are more.
FEW, SALTS = 100_000, 32


def nearest(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (n, parts) and its squared distance; doubles, exact by width_for()."""
    n, parts, _ = vectors.shape
    code, error = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
    entries = books.astype(np.float64).transpose(0, 2, 1)
    size = (entries**2).sum(axis=1)[:, None]
    for lo in range(0, n, ROWS):
        x = vectors[lo : lo + ROWS].astype(np.float64).transpose(1, 0, 2)
        far = size - 2 * (x @ entries)
        best = far.argmin(axis=2)
        code[lo : lo + ROWS] = best.T
        error[lo : lo + ROWS] = (np.take_along_axis(far, best[..., None], 2)[..., 0] + (x**2).sum(axis=2)).T
    return code, error


def codebooks_sha256(books: np.ndarray) -> str:
    """Of all components in decimal, by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, dim: int | None = None, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """key, label, code (a byte a part) and error of each vector, and the codebooks (parts, entries, width)."""
    if not 0 < entries <= 256:
        raise ValueError("a code is a byte a part: 1 to 256 entries")
    spark = vectors.sparkSession
    kind = vectors.select(vectors[f"`{key}`"].alias("key"), vectors[f"`{label}`"].alias("label")).schema
    schema = f"key {kind['key'].dataType.simpleString()}, label {kind['label'].dataType.simpleString()}"
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("x")).where(finite("x"))
    sizes = extent(rows, "x").where(f"dim % {parts} = 0" if dim is None else f"dim = {dim}").orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], f"{schema}, code binary, error long"), np.zeros((parts, 0, 1), np.int64)
    dim, part = sizes[0].dim, sizes[0].dim // parts
    width = width_for(sizes[0].most, scale, part)
    rows = rows.where(F.size("x") == dim)
    first = rows.orderBy(F.col("key").asc_nulls_last(), "x").limit(entries).select("x").toArrow().column(0).combine_chunks()
    sums = Sums(integers(first, dim, scale).reshape(-1, parts, part).transpose(1, 0, 2))
    kept = Table(spark, "codes")

    def state(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Vectors, codes and former codes."""
        old = None if batch.column("was").null_count else matrix(batch.column("was"), parts).astype(np.int64)
        return unpacked(batch.column("x"), dim, width).reshape(-1, parts, part), matrix(batch.column("code"), parts).astype(np.int64), old

    def assign(books: np.ndarray):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = batch.column("x")
            x = integers(x, dim, scale) if pa.types.is_list(x.type) else unpacked(x, dim, width)
            code = nearest(x.reshape(-1, parts, part), books)[0].astype(np.uint8)
            was = batch.column("code") if "code" in batch.schema.names else pa.nulls(len(x), pa.binary())
            return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), packed(x, width), binaries(code), was], ["key", "label", "x", "code", "was"])

        return run

    for _ in range(rounds):
        rows = kept.put(mapped(rows.drop("was"), assign(sums.centres), f"{schema}, x binary, code binary, was binary"))
        sums.change(rows.where("was is null or code <> was").select("x", "code", "was"), state)
        books = sums.move()
    books = sums.centres

    def final(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch.column("x")
        x = integers(x, dim, scale) if pa.types.is_list(x.type) else unpacked(x, dim, width)
        code, error = nearest(x.reshape(-1, parts, part), books)
        return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), binaries(code.astype(np.uint8)), pa.array(error.sum(axis=1))], ["key", "label", "code", "error"])

    return kept.put(mapped(rows.select("key", "label", "x"), final, f"{schema}, code binary, error long")), books


def digest(coded: DataFrame, books: np.ndarray, key: str = "vec_id") -> DataFrame:
    """The query's columns: hexadecimal code, error, the error of all vectors of a label, and the digest of the codebooks."""
    by_label = Table(coded.sparkSession, "label-errors").put(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    few = by_label.count() <= FEW
    if few:
        other, joined = F.broadcast(by_label.withColumnRenamed("label", "l")), coded["label"].eqNullSafe(F.col("l"))
    else:
        coded = coded.withColumn("salt", F.pmod(F.xxhash64("key", "code"), F.lit(SALTS)))
        other = by_label.select(F.col("label").alias("l"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
        joined = coded["label"].eqNullSafe(F.col("l")) & (coded["salt"] == F.col("s"))
    return coded.join(other, joined).select(F.col("key").alias(key), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
