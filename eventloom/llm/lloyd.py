"""What the two clusterings of integer vectors share: usable rows, narrow integers, rounds that keep running sums.

A round maps the table of vectors to itself with new assignments and writes it to the shared folder; the vectors
travel as integers of the narrowest width that holds them. The rows whose assignment changed then give plus and
minus contributions, summed in tasks before they are shuffled, and the driver adds at most one row a place of a
centre to its running sums. No join and no shuffle ever moves a vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import fresh_path

#: Rows whose distances are held at once.
ROWS = 2048
_TYPES = {1: np.int8, 2: np.int16, 4: np.int32}


def finite(vector: str) -> Column:
    """The vector is there, holds something, and every component is a finite number."""
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def extent(rows: DataFrame, vector: str) -> DataFrame:
    """Length of vectors, their number and the greatest size of a component; one row a length."""
    return rows.groupBy(F.size(vector).alias("dim")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))).alias("most"))


def width_for(most: float, scale: int, terms: int) -> int:
    """Bytes of an integer component; an error where a squared distance over ``terms`` components would not be exact in a double."""
    top = most * scale + 1
    if terms * (2 * top) ** 2 >= 2.0**53:
        raise ValueError(f"components up to {most:g} are too large for exact distances over {terms} components")
    return next(w for w in _TYPES if top < 2 ** (8 * w - 1))


def integers(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of a list column whose rows all hold ``dim`` numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(-1, dim)


def packed(values: np.ndarray, width: int) -> pa.Array:
    return binaries(np.ascontiguousarray(values.astype(_TYPES[width])).view(np.uint8))


def unpacked(column: pa.Array, dim: int, width: int) -> np.ndarray:
    return matrix(column, dim * width).view(_TYPES[width]).astype(np.int64)


def binaries(rows: np.ndarray) -> pa.Array:
    """Equal-sized rows of bytes as a binary column."""
    n, size = rows.shape
    offsets = (np.arange(n + 1) * size).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """A binary column of equal-sized values as rows of bytes."""
    if not len(column):
        return np.zeros((0, size), np.uint8)
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, np.int32)[column.offset]
    return np.frombuffer(data, np.uint8, len(column) * size, first).reshape(-1, size)


class Table:
    """A table in the shared folder that the next one replaces."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path, self.old = spark, name, None, None

    def put(self, df: DataFrame) -> DataFrame:
        """Write, read back, and remove what was written before the last one."""
        path = fresh_path(self.spark, self.name)
        df.write.parquet(path)
        if self.path:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.path = path
        return self.spark.read.parquet(path)


class Sums:
    """Running counts and sums of the members of each of ``parts`` x ``entries`` centres of ``width`` components."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres  # parts, entries, width
        self.count = np.zeros(centres.shape[:2], np.int64)
        self.total = np.zeros(centres.shape, np.int64)

    def change(self, rows: DataFrame, read: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray | None]]) -> None:
        """Take over the rows' new assignments: read() gives vectors (n, parts, width), new and former ones (n, parts).

        Parts whose assignment stays send nothing; ``read`` gives no former ones in the first round.
        """
        shape = self.centres.shape
        cells, place = shape[0] * shape[1], np.arange(shape[0]) * shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(cells, np.int64), np.zeros((cells, shape[2]), np.int64)
            for batch in batches:
                vectors, new, old = read(batch)
                moved = np.ones(new.shape, bool) if old is None else new != old
                which = vectors[moved]
                for cell, sign in (((new + place)[moved], 1), *(() if old is None else (((old + place)[moved], -1),))):
                    np.add.at(count, cell, sign)
                    np.add.at(total, cell, sign * which)
            touched = np.flatnonzero((count != 0) | total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(touched, shape[2] + 1)), pa.array(np.tile(np.arange(-1, shape[2]), len(touched))), pa.array(np.c_[count[touched, None], total[touched]].ravel())], ["cell", "at", "value"])

        got = rows.mapInArrow(run, "cell long, at long, value long").groupBy("cell", "at").agg(F.sum("value").alias("value")).toArrow()  # a row a place of a centre at most
        cell, at, value = (got.column(i).to_numpy() for i in range(3))
        head = at < 0
        self.count.ravel()[cell[head]] += value[head]
        self.total.reshape(-1, shape[2])[cell[~head], at[~head]] += value[~head]

    def move(self) -> np.ndarray:
        """Centres become the floored means of their members; those without members stay."""
        used = self.count > 0
        self.centres = self.centres.copy()
        self.centres[used] = self.total[used] // self.count[used][:, None]
        return self.centres
