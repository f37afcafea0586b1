"""Small DataFrame helpers that the operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one for local sessions, as in tests, and an error for others."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = known.get() if known.isDefined() else None
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="eventloom-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


#: Rows of a small table in one checkpoint file.
ROWS_A_FILE = 100_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Materialise in the shared folder, so that lost executors cost no recomputation.

    ``rows``, the number of rows at most if it is known, keeps a small table to few files.
    """
    shared_dir(df.sparkSession)
    if rows is not None and (few := max(4, -(-rows // ROWS_A_FILE))) < partitions(df.sparkSession):
        df = df.coalesce(few)
    return df.checkpoint(eager=True)


def dealt_anew(column: str):
    """The column by an expression, so that a join shuffles this side too and Spark may split the other side's large keys.

    An aggregate's own partitioning would else serve the join, and no skewed partition can be split then.
    """
    return F.col(column).bitwiseXOR(F.lit(0).cast("long")).alias(column)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mapped(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch."""

    def run(batches):
        for batch in batches:
            out = f(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; null ids count as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def as_row(keep: tuple[str, ...]) -> list:
    """The carried columns kept_0, kept_1, ... under their own names in one struct, where no name can clash."""
    return [F.struct(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)]).alias("row")] if keep else []
