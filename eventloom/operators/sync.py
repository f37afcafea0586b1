"""Maps between two clocks: linear fits, robust fits and shift search."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.timing import SECOND
from eventloom.operators.ordered import before, numbered, running_sum


def linear(pairs: DataFrame, x: str = "x", y: str = "y", weight: str | None = None) -> dict[str, float]:
    """scale, offset and r2 of the weighted least-squares line, from one pass of sums."""
    w = F.col(weight) if weight else F.lit(1.0)
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    m = pairs.agg(F.sum(w).alias("w"), (F.sum(w * a) / F.sum(w)).alias("mx"), (F.sum(w * b) / F.sum(w)).alias("my")).first()
    if m["w"] is None:
        raise ValueError("no pairs")
    dx, dy = a - m["mx"], b - m["my"]
    s = pairs.agg(F.sum(w * dx * dx).alias("xx"), F.sum(w * dx * dy).alias("xy"), F.sum(w * dy * dy).alias("yy")).first()
    scale = s["xy"] / s["xx"]
    return {"scale": scale, "offset": m["my"] - scale * m["mx"], "r2": s["xy"] ** 2 / (s["xx"] * s["yy"]) if s["yy"] else 1.0}


def robust(pairs: DataFrame, x: str = "x", y: str = "y", rounds: int = 20) -> dict[str, float]:
    """The line with bisquare weights, reweighted until it stays; each round is two passes of sums."""
    fit = linear(pairs, x, y)
    for _ in range(rounds):
        e = F.col(y) - F.lit(fit["scale"]) * F.col(x) - F.lit(fit["offset"])
        mad = pairs.agg(F.percentile_approx(F.abs(e), 0.5, 10000)).first()[0]
        if not mad:
            break
        u = e / F.lit(4.685 * mad / 0.6745)
        last = fit
        fit = linear(pairs.withColumn("__w", F.when(F.abs(u) < 1, (1 - u * u) ** 2).otherwise(0.0)), x, y, "__w")
        if abs(fit["scale"] - last["scale"]) <= 1e-12 * abs(fit["scale"]) and abs(fit["offset"] - last["offset"]) <= 1e-9 * max(1.0, abs(fit["offset"])):
            break
    return fit


def with_step(pairs: DataFrame, x: str = "x", y: str = "y", most_sd: float = 10.0, width: int | None = None) -> dict[str, float]:
    """The robust line, or where the clocks' gaps differ somewhere by over ``most_sd`` SD, a line with a step there.

    The step lies between the two pairs of the greatest difference (at, in x), and the line
    is fitted with step * sign(x - at) beside it, from one pass of sums. x counts whole numbers.
    """
    rows = pairs.select(F.col(x).cast("long").alias("x"), F.col(y).cast("double").alias("y"))
    near = before(before(rows, "__x", "x", "x", (), width), "__y", "y", "x", (), width)
    gap = near.where("__x is not null").select(((F.col("x") + F.col("__x")) / 2).alias("at"), F.abs((F.col("y") - F.col("__y")) - (F.col("x") - F.col("__x"))).alias("d"), ((F.col("y") - F.col("__y")) - (F.col("x") - F.col("__x"))).alias("g"))
    s = gap.agg(F.avg("g").alias("m"), F.stddev_samp("g").alias("sd"), F.max_by("at", "d").alias("at"), F.max_by("g", "d").alias("g")).first()
    if s["sd"] is None or not s["sd"] or abs(s["g"] - s["m"]) <= most_sd * s["sd"]:
        return {**robust(rows, "x", "y"), "step": 0.0, "at": float("nan")}
    mean = rows.agg(F.avg("x").alias("x"), F.avg("y").alias("y")).first()
    u, v, z = F.col("x") - F.lit(mean["x"]), F.col("y") - F.lit(mean["y"]), F.signum(F.col("x") - F.lit(s["at"]))
    q = rows.agg(F.sum(u * u).alias("uu"), F.sum(u * z).alias("uz"), F.sum(z * z).alias("zz"), F.sum(z).alias("z"), F.sum(u * v).alias("uv"), F.sum(v * z).alias("vz"), F.sum(v * v).alias("vv"), F.count(F.lit(1)).alias("n")).first()
    zz, det = q["zz"] - q["z"] ** 2 / q["n"], q["uu"] * (q["zz"] - q["z"] ** 2 / q["n"]) - q["uz"] ** 2
    scale, step = (q["uv"] * zz - q["vz"] * q["uz"]) / det, (q["vz"] * q["uu"] - q["uv"] * q["uz"]) / det
    left = q["vv"] - scale * q["uv"] - step * q["vz"]
    return {"scale": scale, "offset": mean["y"] - scale * mean["x"] - step * q["z"] / q["n"], "r2": 1 - left / q["vv"] if q["vv"] else 1.0, "step": step, "at": s["at"]}


def forward(t, fit: dict[str, float]):
    return t * F.lit(fit["scale"]) + F.lit(fit["offset"])


def inverse(t, fit: dict[str, float]):
    return (t - F.lit(fit["offset"])) / F.lit(fit["scale"])


def shift_search(first: DataFrame, second: DataFrame, most: int, width: int | None = None) -> DataFrame:
    """shift and worst: the greatest difference between gaps when the second series is moved by shift."""
    def gaps(df: DataFrame, out: str) -> DataFrame:
        n = numbered(df, "i", "t", (), width)
        nxt = n.select((F.col("i") - 1).alias("i"), F.col("t").alias("__n"))
        return n.join(nxt, "i").select("i", (F.col("__n") - F.col("t")).alias(out))

    a = gaps(first, "g1").withColumn("shift", F.explode(F.sequence(F.lit(-most).cast("long"), F.lit(most).cast("long"))))
    b = gaps(second, "g2").withColumnRenamed("i", "j")
    return a.join(b, F.col("j") == F.col("i") - F.col("shift")).groupBy("shift").agg(F.max(F.abs(F.col("g1") - F.col("g2"))).alias("worst"), F.count(F.lit(1)).alias("n"))


def best_shift(found: DataFrame) -> DataFrame:
    return found.agg(F.min_by("shift", F.struct("worst", "shift")).alias("shift"), F.min("worst").alias("worst"))


def _lower_median(df: DataFrame, column: str, n: int) -> int:
    """The least value that half of the n rows don't exceed: values are counted, and the counts summed in buckets of a second."""
    counts = df.groupBy(F.col(column).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return running_sum(counts, {"upto": "n"}, "t", (), SECOND).where(F.col("upto") >= F.lit((n + 1) // 2)).agg(F.min("t")).first()[0]


def matched_with_gaps(first: DataFrame, second: DataFrame, tolerance: float, width: int | None = None) -> DataFrame:
    """Pairs (x, y) of two clocks' pulses (t) either of which may lack some: neighbours of the two series whose distance is within ``tolerance`` of the usual one.

    Both series are ordered as one. Steps from a pulse of the first to one of the second, or the other way round where those
    vary less, are compared with their median (the lower of two middle ones). Times are whole numbers, distinct within a series.
    """
    both = first.select((F.col("t") * 2).alias("o"), "t", F.lit(1).alias("who")).unionByName(second.select((F.col("t") * 2 + 1).alias("o"), "t", F.lit(2).alias("who")))
    both = both.withColumn("__s", F.struct("t", "who"))
    steps = before(both, "__p", "__s", "o", (), None if width is None else 2 * width).where("__p is not null and __p.who <> who")
    steps = steps.select(F.col("__p.who").alias("leads"), F.col("__p.t").alias("a"), F.col("t").alias("b"), (F.col("t") - F.col("__p.t")).alias("d"))
    usual = {r.leads: r for r in steps.groupBy("leads").agg(F.coalesce(F.stddev_samp("d"), F.lit(math.inf)).alias("sd"), F.count(F.lit(1)).alias("n")).collect()}
    if len(usual) < 2:
        raise ValueError("the series don't alternate")
    lead = 1 if usual[1].sd < usual[2].sd else 2
    own = steps.where(F.col("leads") == lead)
    middle = _lower_median(own, "d", usual[lead].n)
    near = own.where(F.abs(F.col("d") - F.lit(middle)) <= tolerance)
    return near.select(F.col("a" if lead == 1 else "b").alias("x"), F.col("b" if lead == 1 else "a").alias("y"))


def sync_with(first: DataFrame, second: DataFrame, tolerance: float, most: int = 6, allow_missing: bool = False, allow_step: bool = False, width: int | None = None) -> tuple[dict[str, float], DataFrame]:
    """The map between two clocks' pulses and the pairs (x, y) it was fitted to.

    Series are moved against each other by up to ``most`` pulses; where the best move leaves gaps that differ by more than
    ``tolerance``, pulses are missing: pairs then come from matched_with_gaps(), or it is an error.
    """
    best = best_shift(shift_search(first, second, most, width)).first()
    if best.worst is not None and best.worst <= tolerance:
        a, b = numbered(first.select("t"), "i", "t", (), width), numbered(second.select("t"), "i", "t", (), width)
        pairs = a.select(F.col("t").alias("x"), (F.col("i") - F.lit(best["shift"])).alias("i")).join(b.select(F.col("t").alias("y"), "i"), "i").select("x", "y")
    elif allow_missing:
        pairs = matched_with_gaps(first, second, tolerance, width)
    else:
        raise ValueError(f"the greatest jitter {best.worst} is larger than the tolerance {tolerance}")
    return (with_step(pairs, width=width) if allow_step else {**robust(pairs), "step": 0.0, "at": float("nan")}), pairs


def debounce(df: DataFrame, on: tuple[str, ...], least: int) -> DataFrame:
    """Rows less those that follow the row before within ``least``."""
    w = Window.partitionBy(*on).orderBy("t")
    return df.withColumn("__d", F.col("t") - F.lag("t").over(w)).where(F.col("__d").isNull() | (F.col("__d") >= least)).drop("__d")
