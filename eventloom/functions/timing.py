"""Time as BIGINT microseconds; seconds only at the edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 3600 * SECOND
DAY = 24 * HOUR


def micros(column: str, origin: str = "2024-01-01 00:00:00") -> Column:
    """Microseconds of a timestamp without zone since an origin."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{origin}', `{column}`)")


def seconds(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column) / F.lit(1e6)


def bucket(column: str | Column, width: int) -> Column:
    """Floor of a BIGINT over a positive width; exact, also below zero."""
    c = F.col(column) if isinstance(column, str) else column
    return ((c - F.pmod(c, F.lit(width).cast("long"))) / F.lit(width)).cast("long")


def centers(edges: Column) -> Column:
    """Midpoints of an array of bin edges."""
    return F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges) - 1), lambda a, b: (a + b) / 2)
