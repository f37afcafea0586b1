"""Running sums, neighbours and as-of look-ups that never sort a whole table in one partition.

With a partitioning key the plain window is used. Without one (then by ``WIDTH`` unless told
otherwise), or where one key may hold much of the table, rows are cut into buckets of time:
each bucket is sorted by itself and takes what the buckets before it add up to from a table
of one row a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.timing import DAY, bucket

_B = "__bucket"
#: Width of buckets where there is neither a key nor a width.
WIDTH = DAY


def _width(on: tuple[str, ...], width: int | None) -> int | None:
    return WIDTH if width is None and not on else width


def running_sum(df: DataFrame, sums: dict[str, str], order: str = "t", on: tuple[str, ...] = (), width: int | None = None) -> DataFrame:
    """Inclusive running sums by ``order`` within ``on``: sums maps new columns to the summed ones.

    Order values must be unique within ``on``.
    """
    width = _width(on, width)
    if width is None:
        w = Window.partitionBy(*on).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(v).over(w).alias(out) for out, v in sums.items()])
    rows = df.withColumn(_B, bucket(order, width))
    totals = rows.groupBy(*on, _B).agg(*[F.sum(v).alias(f"__total_{out}") for out, v in sums.items()])
    before = Window.partitionBy(*on).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*on, _B, *[F.coalesce(F.sum(f"__total_{out}").over(before), F.lit(0)).alias(f"__before_{out}") for out in sums])
    inner = Window.partitionBy(*on, _B).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.sum(v).over(inner).alias(f"__inner_{out}") for out, v in sums.items()]).join(totals, [*on, _B])
    return rows.select(*df.columns, *[(F.col(f"__inner_{out}") + F.col(f"__before_{out}")).alias(out) for out in sums])


def numbered(df: DataFrame, out: str, order: str = "t", on: tuple[str, ...] = (), width: int | None = None) -> DataFrame:
    """Position by ``order`` from 1 within ``on``."""
    return running_sum(df.withColumn("__one", F.lit(1).cast("long")), {out: "__one"}, order, on, width).drop("__one")


def before(df: DataFrame, out: str, column: str, order: str = "t", on: tuple[str, ...] = (), width: int | None = None) -> DataFrame:
    """Adds a column's value in the row before by ``order``, whose values must be unique within ``on``."""
    width = _width(on, width)
    if width is None:
        return df.withColumn(out, F.lag(column).over(Window.partitionBy(*on).orderBy(order)))
    rows = df.withColumn(_B, bucket(order, width))
    ends = rows.groupBy(*on, _B).agg(F.max_by(column, order).alias("__end"))
    ends = ends.select(*on, _B, F.lag("__end").over(Window.partitionBy(*on).orderBy(_B)).alias("__far"))
    inner = F.lag(column).over(Window.partitionBy(*on, _B).orderBy(order))
    return rows.withColumn("__near", inner).join(ends, [*on, _B]).withColumn(out, F.coalesce("__near", "__far")).drop(_B, "__near", "__far")


def carried(df: DataFrame, values: list[str], order: list[Column], on: tuple[str, ...] = (), time: str = "t", width: int | None = None, back: bool = True) -> DataFrame:
    """Each of ``values`` (null where a row has none) filled from the latest row before or at, or the next one.

    ``values`` are taken together, from rows where the first is not null.
    """
    pack = F.when(F.col(values[0]).isNotNull(), F.struct(*values))
    rows = df.withColumn("__v", pack)
    # both ways run from the far end on: a frame up to the last row is summed anew for each row
    frame, sort = (Window.unboundedPreceding, 0), [c.asc() if back else c.desc() for c in order]
    width = _width(on, width)
    if width is None:
        w = Window.partitionBy(*on).orderBy(*sort).rowsBetween(*frame)
        filled = rows.withColumn("__f", F.last("__v", ignorenulls=True).over(w))
    else:
        rows = rows.withColumn(_B, bucket(time, width))
        inner = Window.partitionBy(*on, _B).orderBy(*sort).rowsBetween(*frame)
        rank = F.struct(*[c for c in order]) if len(order) > 1 else order[0]
        ends = rows.where("__v is not null").groupBy(*on, _B).agg((F.max_by if back else F.min_by)("__v", rank).alias("__end"))
        every = rows.select(*on, _B).distinct().join(ends, [*on, _B], "left")
        outer = Window.partitionBy(*on).orderBy(F.col(_B).asc() if back else F.col(_B).desc()).rowsBetween(Window.unboundedPreceding, -1)
        every = every.withColumn("__far", F.last("__end", ignorenulls=True).over(outer)).drop("__end")
        filled = rows.withColumn("__near", F.last("__v", ignorenulls=True).over(inner)).join(every, [*on, _B]).withColumn("__f", F.coalesce("__near", "__far")).drop(_B, "__near", "__far")
    for v in values:
        filled = filled.withColumn(v, F.col("__f")[v])
    return filled.drop("__v", "__f")


def asof(queries: DataFrame, table: DataFrame, values: list[str], mode: str = "previous", on: tuple[str, ...] = (), t: str = "t", width: int | None = None, ends: bool = False) -> DataFrame:
    """For each query row, ``values`` of the table row at or before its time (or at or after).

    Of table rows with one time the first by values is used. ``ends``: queries before the
    first row take the first one (previous), those after the last take the last one (next).
    """
    back = mode == "previous"
    keys = [*on, t]
    first = table.groupBy(*keys).agg(F.min(F.struct(*values)).alias("__s")).select(*keys, F.col("__s.*"))
    if not values or t in values:
        raise ValueError("values are other columns than the time")
    left = queries.withColumn("__q", F.lit(1)).select("*", *[F.lit(None).cast(table.schema[v].dataType).alias(v) for v in values])
    right = first.withColumn("__q", F.lit(0)).select(*keys, "__q", *values)
    rows = left.unionByName(right, allowMissingColumns=True)
    order = [F.col(t), F.col("__q") if back else -F.col("__q")]
    out = carried(rows, values, order, on, t, width, back)
    if ends:
        out = out.withColumn("__miss", F.col(values[0]).isNull() & (F.col("__q") == 1))
        far = first.groupBy(*on).agg((F.min_by if back else F.max_by)(F.struct(*values), F.col(t)).alias("__e"))
        out = (out.join(far, list(on), "left") if on else out.crossJoin(F.broadcast(far)))  # one row without a key
        for v in values:
            out = out.withColumn(v, F.when(F.col("__miss"), F.col("__e")[v]).otherwise(F.col(v)))
        out = out.drop("__miss", "__e")
    return out.where("__q = 1").drop("__q")
