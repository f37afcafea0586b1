"""Event detectors: classes of event against none, learned from population vectors on a grid of times, and read along it.

Samples are the grid times nearest to labelled events, and a hashed share of the times outside all events' surroundings.
Folds are stretches of time. Vectors are projected on the axes that tell the classes apart (closed form, from sums that
tasks make), read by logistic output codes that haven't seen the stretch, and detections are the peaks of the chance of any
event. They are held against true events with a tolerance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators import output_codes, peaks, recording
from eventloom.operators.intervals import in_intervals
from eventloom.operators.ordered import asof
from eventloom.operators.scans import stored

NONE = "none"


def _stretch(t: Column, first: int, last: int, folds: int) -> Column:
    return F.least(F.floor((t - F.lit(first)) * F.lit(folds) / F.lit(max(last - first, 1))), F.lit(folds - 1)).cast("int")


def samples(grid: DataFrame, labels: DataFrame, step: int, before: int, after: int, ratio: float = 5.0, folds: int = 3, history: int = 0, seed: int = 0) -> DataFrame:
    """t, y, fold and x of the training samples: grid (t, x; one every ``step`` microseconds) and labels (t, label).

    A labelled time stands for the grid time nearest to it; labels within ``history`` of the grid's begin are left out. Times
    in [e - before, e + after) of an event e are no negatives; of the others about ``ratio`` for each positive are drawn by hash.
    """
    ends = grid.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    if ends.a is None:
        return grid.select("t", F.lit(NONE).alias("y"), F.lit(0).alias("fold"), "x")
    known = labels.where((F.col("label").isNotNull()) & (F.col("t") > ends.a + history))
    place = F.least(F.round((F.col("t") - F.lit(ends.a)) / F.lit(step)).cast("long") * step + F.lit(ends.a), F.lit(ends.b))
    near = known.select(place.alias("t"), F.col("label").alias("y"))
    out = known.select((F.col("t") - F.lit(before).cast("long")).alias("t0"), (F.col("t") + F.lit(after).cast("long")).alias("t1"))
    free = grid.join(in_intervals(grid.select("t"), out, length=before + after).select("t").distinct(), "t", "left_anti")
    share = min(1.0, ratio * near.count() / max(free.count(), 1))
    drawn = F.pmod(F.xxhash64("t", F.lit(seed)), F.lit(1_000_003)) < F.lit(share * 1_000_003)
    rows = grid.join(near, "t").select("t", "y", "x").unionByName(free.where(drawn).select("t", F.lit(NONE).alias("y"), "x"))
    return rows.select("t", "y", _stretch(F.col("t"), ends.a, ends.b, folds).alias("fold"), "x")


def train(rows: DataFrame, dims: int = 3, kind: str = "onevsall", ridge: float = 0.01) -> dict:
    """A detector from samples(): axes (their vectors), and output codes for each fold without its samples."""
    rows = stored(rows.withColumn("x", F.transform("x", lambda v: v.cast("double"))), "detector-samples")
    axes = [r.weights for r in recording.discriminant_subspace(rows.withColumn("all", F.lit(0)), ["all"], "y", "x", dims).orderBy("axis").collect()]
    model = output_codes.learn(_projected(rows, axes), "y", "z", "fold", kind, "logistic", ridge)
    return {"axes": axes, "codes": model}


def _projected(rows: DataFrame, axes: list[list[float]]) -> DataFrame:
    one = lambda w: F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.withColumn("z", F.array(*[one(w) for w in axes]))


def chances(grid: DataFrame, detector: dict, folds: int = 3) -> DataFrame:
    """t, guess and p (the chance of any event) at every time of the grid, by the learners that haven't seen its stretch."""
    ends = grid.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    rows = grid.withColumn("x", F.transform("x", lambda v: v.cast("double"))).withColumn("fold", _stretch(F.col("t"), ends.a or 0, ends.b or 0, folds))
    out = output_codes.decode(_projected(rows, detector["axes"]), detector["codes"], "z", "fold")
    place = detector["codes"]["classes"].index(NONE) + 1 if NONE in detector["codes"]["classes"] else None
    return out.select("t", "guess", (1 - F.element_at("posterior", place) if place else F.lit(1.0)).alias("p"))


def detections(found: DataFrame, least: float = 0.5, distance: int = 0, step: int = 1, span: int | None = None) -> DataFrame:
    """t and p of the peaks of chances above ``least``, none within ``distance`` microseconds of a higher one; grid times stand ``step`` apart."""
    rows = found.select((F.col("t") / F.lit(step)).cast("long").alias("o"), F.pmod("t", F.lit(step)).alias("shift"), "p")
    out = peaks.find_peaks(rows.select("o", "p"), (), "o", "p", least, 0.0, distance // step, span=span)
    shift = rows.agg(F.first("shift").alias("shift"))  # one row: the grid's own phase
    return out.crossJoin(F.broadcast(shift)).select((F.col("o") * F.lit(step) + F.col("shift")).alias("t"), "p")


def agreement(found: DataFrame, events: DataFrame, tolerance: int, width: int | None = None) -> DataFrame:
    """One row: n_found, n_events, hits (detections with an event within the tolerance), seen (events with a detection within it), precision, recall, f1 and lag (mean of detection less nearest event, seconds; the earlier one of two equally near)."""

    def nearest(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select("t", F.col("t").alias("at"))
        both = asof(asof(a.select("t"), b, ["at"], "previous", width=width).withColumnRenamed("at", "p"), b, ["at"], "next", width=width)
        back, ahead = F.col("t") - F.col("p"), F.col("at") - F.col("t")
        gap = F.least(back, ahead)
        lag = F.when(ahead.isNull() | (back <= ahead), back).otherwise(-ahead)
        return both.agg(F.count(F.lit(1)).alias("n"), F.sum((gap <= tolerance).cast("long")).alias("k"), F.avg(F.when(gap <= tolerance, lag)).alias("lag"))

    a = nearest(found, events).select(F.col("n").alias("n_found"), F.coalesce("k", F.lit(0)).alias("hits"), (F.col("lag") / F.lit(1e6)).alias("lag"))
    b = nearest(events, found).select(F.col("n").alias("n_events"), F.coalesce("k", F.lit(0)).alias("seen"))
    out = a.crossJoin(F.broadcast(b))  # one row each
    precision, recall = F.col("hits") / F.nullif(F.col("n_found"), F.lit(0)), F.col("seen") / F.nullif(F.col("n_events"), F.lit(0))
    return out.select("n_found", "n_events", "hits", "seen", precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / F.nullif(precision + recall, F.lit(0.0))).alias("f1"), "lag")
