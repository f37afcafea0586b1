"""Scene triples, poses and other slowly changing tables over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators import intervals as iv
from eventloom.operators.ordered import asof


def predicates() -> dict[str, Column]:
    """Kinds of a triple (subject, predicate, object, direct_object) by the parts it has."""
    s, p, o, d = (F.col(c) for c in ("subject", "predicate", "object", "direct_object"))
    return {
        "is_visibility": s.isNotNull() & p.isNull() & d.isNull(),
        "is_attribute": s.isNotNull() & p.isNull() & o.isNotNull(),
        "is_verb": p.isNotNull(),
        "is_direct_verb": p.isNotNull() & o.isNotNull() & d.isNull(),
        "is_indirect_verb": p.isNotNull() & o.isNotNull() & d.isNotNull(),
    }


def sentence() -> Column:
    return F.concat_ws(" ", "subject", "predicate", "object", "direct_object")


def visible_counts(spans: DataFrame, on: tuple[str, ...] = (), width: int | None = None) -> DataFrame:
    """Number of entities that hold from each edge on."""
    return iv.depth(spans, on, width)


def transitions(spans: DataFrame, name: str, on: tuple[str, ...]) -> DataFrame:
    """Each change of the number of entities of a scene: added or gone, counts before and after."""
    e = iv.edges(spans, (*on, name))
    w = Window.partitionBy(*on).orderBy("t", "d", name).rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("new_count", F.sum("d").over(w)).select(*on, "t", name, (F.col("d") > 0).alias("is_add"), (F.col("new_count") - F.col("d")).alias("old_count"), "new_count")


def drop_repeats(df: DataFrame, value: str, on: tuple[str, ...], default: str | None = None) -> DataFrame:
    """Rows whose value differs from the row before."""
    w = Window.partitionBy(*on).orderBy("t")
    v = F.coalesce(F.col(value), F.lit(default)) if default is not None else F.col(value)
    return df.withColumn(value, v).withColumn("__last", F.lag(value).over(w)).withColumn("__n", F.row_number().over(w)).where(~F.col("__last").eqNullSafe(F.col(value)) | (F.col("__n") == 1)).drop("__last", "__n")


def pose_at(queries: DataFrame, poses: DataFrame, values: list[str], on: tuple[str, ...]) -> DataFrame:
    """Values of the pose at or before each time; null outside the object's lifetime."""
    life = poses.groupBy(*on).agg(F.min("t").alias("__a"), F.max("t").alias("__b"))
    found = asof(queries, poses, values, "previous", on).join(life, list(on), "left")
    alive = F.col("t").between(F.col("__a"), F.col("__b"))
    return found.select(*queries.columns, *[F.when(alive, F.col(v)).alias(v) for v in values])


def frames(poses: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """[t, next t) of every visible frame."""
    w = Window.partitionBy(*on).orderBy("t")
    return poses.withColumn("t0", F.col("t")).withColumn("t1", F.lead("t").over(w)).where("visible and t1 is not null").drop("t")


def pair_edges(marks: DataFrame, on: tuple[str, ...], start: str = "Start", end: str = "End") -> DataFrame:
    """Intervals from start marks and the end marks that directly follow them."""
    w = Window.partitionBy(*on).orderBy("t")
    return marks.withColumn("t1", F.lead("t").over(w)).withColumn("__k", F.lead("kind").over(w)).where((F.col("kind") == start) & (F.col("__k") == end)).select(*on, F.col("t").alias("t0"), "t1")


def active_with(queries: DataFrame, spans: DataFrame, key: str, order: str) -> DataFrame:
    """First span (by order) of the same key that holds at each time."""
    found = iv.in_intervals(queries, spans, (key,))
    return found.groupBy(*queries.columns).agg(F.min_by(F.struct(*[c for c in spans.columns if c != key]), F.col(order)).alias("span")).select(*queries.columns, "span.*")


def trial_pivot(log: DataFrame, trial: str, name: str, names: list[str]) -> DataFrame:
    """One row a trial: first time of each named event."""
    return log.groupBy(trial).agg(*[F.min(F.when(F.col(name) == n, F.col("t"))).alias(f"t_{n}") for n in names])


def unpivot_times(trials: DataFrame, trial: str, names: list[str]) -> DataFrame:
    """The reverse: one row for each known time."""
    return trials.unpivot(trial, [f"t_{n}" for n in names], "name", "t").where("t is not null")


def near(df: DataFrame, at: int, before: int, after: int) -> DataFrame:
    """Rows within [at - before, at + after] with their relative time."""
    return df.where(F.col("t").between(at - before, at + after)).withColumn("rel", F.col("t") - F.lit(at).cast("long"))


def thinned(df: DataFrame, on: tuple[str, ...], tolerance: int) -> DataFrame:
    """Rows less those within ``tolerance`` of the row kept before, taken in order of time.

    Groups of close rows are split off by gaps first; only a group of several rows needs
    the greedy walk, which a running fold over the group's own times makes.
    """
    w = Window.partitionBy(*on).orderBy("t")
    g = df.withColumn("__new", F.coalesce((F.col("t") - F.lag("t").over(w)) > tolerance, F.lit(True)))
    g = g.withColumn("__g", F.sum(F.col("__new").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    times = g.groupBy(*on, "__g").agg(F.array_sort(F.collect_set("t")).alias("__t"))
    kept = F.aggregate("__t", F.expr("cast(array() as array<bigint>)"), lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) > tolerance), F.concat(acc, F.array(x))).otherwise(acc))
    return times.select(*on, F.explode(kept).alias("t"))
