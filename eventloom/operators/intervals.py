"""Half-open intervals (t0, t1) in microseconds: joins, algebra and runs.

Joins of times with intervals are equi-joins on buckets of time. An interval is put into
the buckets of a width between a fourth of its own length and the whole, so it has at most
six whatever its length, and at most about three candidates meet for each true pair; times
meet each width that occurs. Algebra sums the changes of depth per distinct time
before it accumulates them, so results don't depend on the order of ties.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.ordered import before, numbered, running_sum

#: Bucket widths are powers of this.
STEP = 4
#: Rows of one time are paired in lists of up to 2 to this many.
PACK_BITS = 10
#: Entries of intervals in buckets that one task of a join without keys takes, and the most tasks.
PER_TASK, MOST_TASKS = 16_384, 10_000


def _levels(intervals: DataFrame) -> DataFrame:
    length = F.greatest(F.col("t1") - F.col("t0"), F.lit(1))
    return intervals.withColumn("__level", F.ceil(F.log(length.cast("double")) / F.log(F.lit(float(STEP)))).cast("int"))


def _bucket(t: str, level: str) -> Column:
    """Bucket of a time at a level, whose width is STEP to one less than it, or 1."""
    return F.expr(f"({t} - pmod({t}, shiftleft(1L, 2 * greatest({level} - 1, 0)))) div shiftleft(1L, 2 * greatest({level} - 1, 0))")


def _packed(rows: DataFrame, keys: list[str], places: list[str], tasks: int | None, out: str) -> DataFrame:
    """Rows of equal ``keys`` as lists of the rest, of at most PACK; partitioned by ``places``, which are among the keys."""
    rest = [c for c in rows.columns if c not in keys]
    dealt = rows.repartition(tasks, *places) if tasks else rows.repartition(*places)
    near = dealt.sortWithinPartitions(*keys).withColumn("__piece", F.shiftright(F.monotonically_increasing_id(), PACK_BITS))
    held = F.struct(*rest) if rest else F.struct(F.lit(1).alias("__one"))
    return near.groupBy(*keys, "__piece").agg(F.collect_list(held).alias(out)).drop("__piece")


def in_intervals(events: DataFrame, intervals: DataFrame, on: tuple[str, ...] = (), right_closed: bool = False, t: str = "t", length: int | None = None, beside: tuple[str, ...] = ()) -> DataFrame:
    """Every (event, interval) with t0 <= t < t1, or t <= t1; columns of both sides.

    One join on level and bucket; an event goes to each level that occurs. If all intervals
    have one known ``length``, no job is needed beforehand; else the few levels that occur are
    counted first (at most 64 numbers).

    Without ``on``, pairs grow with the square of the density. There events of one time, and intervals of
    one start and end, are joined as one row and paired afterwards, so comparisons don't grow with the copies of a
    time, pairs with the same times lie together, and counted intervals set the number of tasks. ``beside`` names
    columns of events that a later filter compares with t0 and t1: they are kept apart, so that it acts before the pairing.
    """
    tasks = None
    if length is not None:
        level = next(k for k in range(64) if STEP**k >= length)
        leveled, used = intervals.withColumn("__level", F.lit(level)), [level]
    else:
        leveled = _levels(intervals)
        counted = leveled.where("__level is not null").groupBy("__level").count().collect()
        used = sorted(r[0] for r in counted) or [0]
        tasks = min(-(-(STEP + 1) * sum(r[1] for r in counted) // PER_TASK), MOST_TASKS) or None
    places = ["__level", "__b"] if len(used) > 1 else ["__b"]
    i = leveled.withColumn("__b", F.explode(F.sequence(_bucket("t0", "__level"), _bucket("t1", "__level"))))
    e = events.withColumn("__level", F.explode(F.array(*map(F.lit, used))) if len(used) > 1 else F.lit(used[0])).withColumn("__b", _bucket(f"`{t}`", "__level"))
    inside = (F.col(t) >= F.col("t0")) & ((F.col(t) <= F.col("t1")) if right_closed else (F.col(t) < F.col("t1")))
    if on:
        return e.join(i, ["__level", "__b", *on]).where(inside).drop("__level", "__b")
    if len(used) == 1:
        e, i = e.drop("__level"), i.drop("__level")
    e = _packed(e.where(F.col(t).isNotNull()), [*places, t, *beside], places, tasks, "__events")
    i = _packed(i, [*places, "t0", "t1"], places, tasks, "__intervals")
    both = e.join(i, places).where(inside)
    both = both.withColumn("__e", F.explode("__events")).withColumn("__i", F.explode("__intervals"))
    of = lambda side, names, keys: [F.col(c) if c in keys else F.col(f"{side}.`{c}`").alias(c) for c in names]
    return both.select(*of("__e", events.columns, (t, *beside)), *of("__i", intervals.columns, ("t0", "t1")))


def counts_in(events: DataFrame, intervals: DataFrame, key: str, on: tuple[str, ...] = (), right_closed: bool = False) -> DataFrame:
    """Every interval with its number of events, empty ones too."""
    n = in_intervals(events, intervals.select(key, "t0", "t1", *on), on, right_closed).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return intervals.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def have_intervals(outer: DataFrame, inner: DataFrame, outer_key: str, inner_key: str, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of keys where an inner interval starts and ends in [t0, t1) of the outer."""
    events = inner.select(F.col("t0").alias("t"), F.col("t1").alias("__end"), inner_key, *on)
    found = in_intervals(events, outer.select(outer_key, "t0", "t1", *on), on, beside=("__end",))
    return found.where((F.col("__end") >= F.col("t0")) & (F.col("__end") < F.col("t1"))).select(outer_key, inner_key)


def edges(intervals: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Distinct times with the change of depth there; empty intervals have none."""
    some = intervals.where("t0 < t1")
    up = some.select(*on, F.col("t0").alias("t"), F.lit(1).cast("long").alias("d"))
    down = some.select(*on, F.col("t1").alias("t"), F.lit(-1).cast("long").alias("d"))
    return up.union(down).groupBy(*on, "t").agg(F.sum("d").alias("d"))


def depth(intervals: DataFrame, on: tuple[str, ...] = (), width: int | None = None) -> DataFrame:
    """Number of intervals that cover the time from each edge on."""
    return running_sum(edges(intervals, on), {"depth": "d"}, "t", on, width).select(*on, "t", "depth")


def _sweep(parts: list[DataFrame], holds: Callable[[list[Column]], Column], on: tuple[str, ...], width: int | None) -> DataFrame:
    """Intervals where a rule of the parts' coverage holds: one pass over the edges of all parts."""
    n, changes = range(len(parts)), None
    for i, p in enumerate(parts):
        e = edges(p, on).select(*on, "t", *[(F.col("d") if i == j else F.lit(0).cast("long")).alias(f"d{j}") for j in n])
        changes = e if changes is None else changes.unionByName(e)
    changes = changes.groupBy(*on, "t").agg(*[F.sum(f"d{j}").alias(f"d{j}") for j in n])
    rows = running_sum(changes, {f"n{j}": f"d{j}" for j in n}, "t", on, width)
    after = holds([F.col(f"n{j}") > 0 for j in n])
    before = holds([F.col(f"n{j}") - F.col(f"d{j}") > 0 for j in n])
    turns = numbered(rows.where(after != before).select(*on, "t"), "k", "t", on, width)  # starts and ends alternate
    return turns.groupBy(*on, F.expr("(k + 1) div 2").alias("k")).agg(F.min("t").alias("t0"), F.max("t").alias("t1")).drop("k")


def union(intervals: DataFrame, on: tuple[str, ...] = (), width: int | None = None) -> DataFrame:
    """Merged intervals; touching ones merge."""
    return _sweep([intervals], lambda c: c[0], on, width)


def intersect(parts: list[DataFrame], on: tuple[str, ...] = (), width: int | None = None) -> DataFrame:
    """Times that every one of the parts covers."""
    return _sweep(parts, lambda c: reduce(lambda a, b: a & b, c), on, width)


def subtract(a: DataFrame, b: DataFrame, on: tuple[str, ...] = (), width: int | None = None) -> DataFrame:
    """Times that a covers and b doesn't, merged."""
    return _sweep([a, b], lambda c: c[0] & ~c[1], on, width)


def complement(intervals: DataFrame, lo: int | None = None, hi: int | None = None, on: tuple[str, ...] = (), width: int | None = None) -> DataFrame:
    """Gaps in [lo, hi), by default from the first start to the last end."""
    ends = intervals.groupBy(*on).agg((F.min("t0") if lo is None else F.lit(lo).cast("long")).alias("t0"), (F.max("t1") if hi is None else F.lit(hi).cast("long")).alias("t1"))
    return subtract(ends, intervals, on, width)


def gaps(intervals: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """Gap before and after each interval in order of start; null where there is none."""
    w = Window.partitionBy(*on).orderBy("t0", "t1")
    return intervals.withColumn("last_gap", F.col("t0") - F.lag("t1").over(w)).withColumn("next_gap", F.lead("t0").over(w) - F.col("t1"))


def _islands(df: DataFrame, new: Column, on: tuple[str, ...], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*on).orderBy(*order)
    return df.withColumn("run", F.sum(F.when(new, 1).otherwise(0).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _runs(times: DataFrame, new: Column, on: tuple[str, ...], width: int | None) -> DataFrame:
    """t0, t1 and n of runs of distinct times (t, n) with the time before in __p, broken where ``new`` holds."""
    rows = before(times, "__p", "t", "t", on, width).withColumn("__new", F.coalesce(new, F.lit(False)).cast("long"))
    rows = running_sum(rows, {"run": "__new"}, "t", on, width)
    return rows.groupBy(*on, "run").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.sum("n").alias("n")).drop("run")


def find_continuous(events: DataFrame, gap: int | None, least: int = 0, on: tuple[str, ...] = (), width: int | None = None) -> DataFrame:
    """Runs of events, split where a gap is at least ``gap``; those shorter than ``least`` go."""
    times = events.groupBy(*on, "t").agg(F.count(F.lit(1)).alias("n"))
    runs = _runs(times, (F.col("t") - F.col("__p")) >= gap if gap is not None else F.lit(False), on, width)
    return runs.where(F.col("t1") - F.col("t0") >= least)


def find_intervals(samples: DataFrame, threshold: float, gap: int | None, least: int = 0, on: tuple[str, ...] = (), value: str = "value", extrapolate: int = 0, width: int | None = None) -> DataFrame:
    """Runs of samples at or over a threshold, split where a gap exceeds ``gap``."""
    times = samples.where(F.col(value) >= threshold).groupBy(*on, "t").agg(F.count(F.lit(1)).alias("n"))
    runs = _runs(times, (F.col("t") - F.col("__p")) > gap if gap is not None else F.lit(False), on, width)
    return runs.withColumn("t1", F.col("t1") + F.lit(extrapolate)).where(F.col("t1") - F.col("t0") >= least)


def find_sequence(intervals: DataFrame, gap: int, on: tuple[str, ...], forced: str | None = None) -> DataFrame:
    """Sequence number, position in it and its length; a new one where the gap exceeds ``gap``."""
    w = Window.partitionBy(*on).orderBy("t0", "t1")
    new = F.coalesce((F.col("t0") - F.lag("t1").over(w)) > gap, F.lit(True))
    if forced is not None:
        new = new | F.col(forced)
    rows = _islands(intervals.withColumn("__new", new), F.col("__new"), on, ["t0", "t1"]).drop("__new").withColumnRenamed("run", "sequence")
    s = Window.partitionBy(*on, "sequence")
    return rows.withColumn("position", F.row_number().over(s.orderBy("t0", "t1")).cast("long")).withColumn("length", F.count(F.lit(1)).over(s))


def combine_sequence(intervals: DataFrame, gap: int, on: tuple[str, ...]) -> DataFrame:
    """Each sequence as one interval from its first start to its last member's end."""
    s = find_sequence(intervals, gap, on)
    return s.groupBy(*on, "sequence").agg(F.min("t0").alias("t0"), F.max_by("t1", "position").alias("t1"), F.count(F.lit(1)).alias("n"))


#: Labels whose depths are columns of one sweep.
LABELS = 64


def state_changes(intervals: DataFrame, label: str, on: tuple[str, ...] = (), width: int | None = None, sep: str = "|") -> DataFrame:
    """The labels that hold from each edge on, in order, joined by ``sep``.

    Changes are summed by time into one column a label, and one sweep turns them into depths. Labels are few by nature; where
    there are more than ``LABELS``, every edge of any label gets each label's state instead, for a moment.
    """
    e = edges(intervals.select(*on, label, "t0", "t1"), (*on, label))
    names = sorted(r[0] for r in e.select(label).where(F.col(label).isNotNull()).distinct().limit(LABELS + 1).collect())
    if 0 < len(names) <= LABELS:
        changes = e.groupBy(*on, "t").agg(*[F.coalesce(F.sum(F.when(F.col(label) == n, F.col("d"))), F.lit(0).cast("long")).alias(f"__d{i}") for i, n in enumerate(names)])
        depths = running_sum(changes, {f"__n{i}": f"__d{i}" for i in range(len(names))}, "t", on, width)
        return depths.select(*on, "t", F.concat_ws(sep, *[F.when(F.col(f"__n{i}") > 0, F.lit(n)) for i, n in enumerate(names)]).alias("state"))
    held = running_sum(e.where(F.col(label).isNotNull()), {"depth": "d"}, "t", (*on, label), width)
    times = e.select(*on, "t").distinct()
    if on:
        grid = times.join(held.select(*on, label).distinct(), list(on))
    else:
        every = held.agg(F.collect_set(label).alias("__l"))  # one row
        grid = times.crossJoin(F.broadcast(every)).select("t", F.explode("__l").alias(label))
    rows = grid.join(held.select(*on, label, "t", "depth"), [*on, label, "t"], "left")
    w = Window.partitionBy(*on, label).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("depth", F.last("depth", ignorenulls=True).over(w))
    state = F.array_join(F.array_sort(F.collect_list(F.when(F.col("depth") > 0, F.col(label)))), sep)
    return rows.groupBy(*on, "t").agg(state.alias("state"))
