"""Hidden states of units under a stimulus: designs in Spark, one fit a unit, decoding of single units and of a population.

Designs and decoders cut series into blocks of bins, so that no group holds a series (see scans.py). The population's
evidence is summed over units before its one scan a session. A fit takes a unit's series, which its recording bounds, as one group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import state_space
from eventloom.functions.timing import bucket
from eventloom.operators import scans
from eventloom.operators.labels import history_basis

MODEL = "spiking array<array<double>>, switching array<array<array<double>>>, start array<double>, log_likelihood double"


def design(counts: DataFrame, unit: str, order: str, count: str, stimuli: list[str], lags: list[int], history: int = 0, reach: int = 4, shortest: float = 1.0, longest: float = 4.0, width: int | None = None) -> DataFrame:
    """unit, order, count, s (bias and lagged stimuli) and x (s and the unit's own past through exponentials); zero before the first bin.

    Bins follow one another. They are cut into blocks of ``width``, each of which also takes the bins before it that its lags reach.
    """
    width, deep = width or scans.WIDTH, max([*lags, reach if history else 0])
    b = bucket(order, width)
    reached = F.array(b, *[b + k for k in range(1, -(-deep // width) + 1)])
    counts = counts.withColumn("__own", b).withColumn("__b", F.explode(F.filter(reached, lambda q: F.col(order) >= q * width - deep)))
    w = Window.partitionBy(unit, "__b").orderBy(order)

    def past(column: str, k: int) -> Column:
        return (F.lag(column, k, 0.0).over(w) if k else F.col(column)).cast("double")

    terms = [F.lit(1.0), *[past(c, k) for k in lags for c in stimuli]]
    basis: dict[int, Column] = {}
    for k, j, weight in history_basis(history, reach, shortest, longest) if history else []:
        basis[k] = basis.get(k, F.lit(0.0)) + past(count, j) * F.lit(weight)
    rows = counts.withColumn(count, F.col(count).cast("double"))
    made = rows.select(unit, order, count, "__own", "__b", F.array(*terms).alias("s"), F.array(*basis.values()).cast("array<double>").alias("h"))
    return made.where("__own = __b").select(unit, order, count, "s", F.concat("s", "h").alias("x"))


def _series(pdf: pd.DataFrame, order: str, count: str) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    pdf = pdf.sort_values(order)
    return pdf, pdf[count].to_numpy(float), np.stack(pdf["s"].to_numpy()), np.stack(pdf["x"].to_numpy())


def _fresh(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so that a model made of the rows may meet them again."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def fit(rows: DataFrame, unit: str, order: str, count: str, states: int = 2, dt: float = 1.0, family: str = "poisson", ridge: float = 0.0, rounds: int = 100) -> DataFrame:
    """One model a unit from a design."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, y, s, x = _series(pdf, order, count)
        spiking, switching, start, ll = state_space.fit(y, s, x, states, dt, family, ridge, rounds)
        return pd.DataFrame({unit: [pdf[unit].iloc[0]], "spiking": [spiking.tolist()], "switching": [switching.tolist()], "start": [start.tolist()], "log_likelihood": [ll]})

    return rows.groupBy(unit).applyInPandas(run, f"{unit} {rows.schema[unit].dataType.simpleString()}, {MODEL}")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def _evidence(count: str, spiking: Column, dt: float, family: str) -> Column:
    """Log evidence of each state from x and a count, without the part that all states share."""
    u = F.transform(spiking, lambda k: _dot(k, F.col("x")))
    lam = F.transform(u, lambda v: F.when(v <= 0, F.exp(F.least(v, F.lit(0.0)))).otherwise(1 + v + v * v / 2) * F.lit(float(dt)))
    y, tiny = F.col(count).cast("double"), F.lit(float(np.finfo(float).eps))
    if family == "poisson":
        return F.transform(lam, lambda m: y * F.log(m + tiny) - m)
    return F.transform(lam, lambda m: F.when(y > 0, F.log(F.greatest(-F.expm1(-m), tiny))).otherwise(-m))


def _changes(switching: Column, dt: float) -> Column:
    """Chances of all changes into a row from s, row by row."""
    odds = F.transform(switching, lambda row, i: F.transform(row, lambda k, j: F.when(i == j, F.lit(1.0)).otherwise(F.exp(_dot(k, F.col("s"))) * F.lit(float(dt)))))
    return F.flatten(F.transform(odds, lambda row: F.transform(row, lambda x: x / F.aggregate(row, F.lit(0.0), lambda t, y: t + y))))


def _states(models: DataFrame) -> int:
    found = models.select(F.size("start")).first()
    return found[0] if found else 1


def decode(rows: DataFrame, models: DataFrame, unit: str, order: str, count: str, dt: float = 1.0, family: str = "poisson", smooth: bool = False, width: int | None = None) -> DataFrame:
    """unit, order and p: each unit's chances of its states, filtered forward by a scan over blocks of ``width`` bins.

    With ``smooth`` also the chances given all bins and those of the changes (see scans.hidden_states).
    """
    known = _fresh(models).select(unit, "spiking", "switching", "start")
    ready = rows.join(known, unit).select(unit, order, _evidence(count, F.col("spiking"), dt, family).alias("e"), _changes(F.col("switching"), dt).alias("a"), "start")
    return scans.hidden_states(ready, (unit,), order, _states(models), width, smooth)


def pooled(models: DataFrame, unit: str, pool: str = "mean") -> tuple[list, list[float]]:
    """Switching filters of all units as one (``mean``, ``median`` or ``first`` by unit), and the mean of the first chances; states * states * terms numbers, whatever the number of units."""
    how = {"mean": F.avg("v"), "median": F.median("v"), "first": F.min_by("v", unit)}[pool]
    flat = models.select(unit, F.posexplode("switching").alias("i", "m")).select(unit, "i", F.posexplode("m").alias("j", "r")).select(unit, "i", "j", F.posexplode("r").alias("k", "v"))
    parts = {(r.i, r.j, r.k): r.v for r in flat.groupBy("i", "j", "k").agg(how.alias("v")).collect()}
    start = [r.v for r in models.select(F.posexplode("start").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v")).orderBy("i").collect()]
    terms = 1 + max((k for _, _, k in parts), default=0)
    return [[[parts[i, j, k] for k in range(terms)] for j in range(len(start))] for i in range(len(start))], start


def _literal(v) -> Column:
    return F.array(*[_literal(u) for u in v]) if isinstance(v, (list, tuple)) else F.lit(float(v))


def decode_population(rows: DataFrame, models: DataFrame, unit: str, order: str, count: str, dt: float = 1.0, family: str = "poisson", on: tuple[str, ...] = (), pool: str | list = "mean", event_states: tuple[int, ...] = (), width: int | None = None) -> DataFrame:
    """order and p: chances of the states by all units' evidence together, with pooled switching filters and the mean of the first chances.

    Units share the stimulus; ``on`` names the session, without which all rows are one. ``pool`` is a way of pooled()
    or the filters themselves (from, to, terms). With ``event_states`` p_event is the chance of any of them.
    """
    switching, start = pooled(models, unit, pool if isinstance(pool, str) else "mean")
    switching, n = switching if isinstance(pool, str) else pool, len(start)
    known = _fresh(models).select(unit, "spiking")
    each = rows.join(known, unit).select(*on, order, "s", _evidence(count, F.col("spiking"), dt, family).alias("e"))
    whole = each.groupBy(*on, order).agg(F.first("s").alias("s"), F.array(*[F.sum(F.col("e")[i]) for i in range(n)]).alias("e"))
    ready = whole.select(*on, order, "e", _changes(_literal(switching), dt).alias("a"), _literal(start).alias("start"))
    out = scans.hidden_states(ready, on, order, n, width)
    return out.withColumn("p_event", sum((F.col("p")[i] for i in event_states), F.lit(0.0))) if event_states else out
