"""Recording operators: block-wise signals, units, channel maps, trials and gaze calibration."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from eventloom.operators.intervals import in_intervals
from eventloom.operators.ordered import asof


def samples(blocks: DataFrame, channels: list[int] | None, lo: int, hi: int, scale: Column | float = 1.0) -> DataFrame:
    """Samples lo to hi (exclusive) of channels from blocks (channel, first, samples): blocks are pruned before they are unpacked."""
    some = blocks.where((F.col("first") < hi) & (F.col("first") + F.size("samples") > lo))
    if channels is not None:
        some = some.where(F.col("channel").isin(channels))
    rows = some.select("channel", "first", F.posexplode("samples").alias("k", "value")).withColumn("sample", F.col("first") + F.col("k"))
    return rows.where(F.col("sample").between(lo, hi - 1)).select("channel", "sample", (F.col("value") * scale).alias("value"))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """The reverse: samples packed to arrays of ``size``."""
    b = rows.withColumn("__b", F.expr(f"sample div {size}L")).groupBy("channel", "__b").agg(F.array_sort(F.collect_list(F.struct("sample", "value"))).alias("__s"))
    return b.select("channel", F.col("__s")[0]["sample"].alias("first"), F.transform("__s", lambda s: s["value"]).alias("samples"))


def resample(rows: DataFrame, rate: float, new_rate: float, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """Samples on a new uniform grid by linear interpolation, clock-corrected by t = k / rate * scale + offset.

    Each pair of neighbours fills the grid points between them, so nothing but the pair meets.
    """
    w = Window.partitionBy("channel").orderBy("sample")
    t = F.col("sample") / F.lit(rate) * F.lit(scale) + F.lit(offset)
    pairs = rows.select("channel", "sample", (t * F.lit(new_rate)).alias("u"), "value").withColumn("u2", F.lead("u").over(w)).withColumn("v2", F.lead("value").over(w))
    first, last = F.ceil("u").cast("long"), F.when(F.col("u2") == F.ceil("u2"), F.ceil("u2") - 1).otherwise(F.floor("u2")).cast("long")
    inner = pairs.where("u2 is not null").withColumn("__a", first).withColumn("__b", last).where("__a <= __b").withColumn("k", F.explode(F.sequence("__a", "__b")))
    at = F.col("value") + (F.col("v2") - F.col("value")) * (F.col("k") - F.col("u")) / (F.col("u2") - F.col("u"))
    ends = pairs.where("u2 is null and u = ceil(u)").select("channel", F.col("u").cast("long").alias("k"), "value")
    return inner.select("channel", "k", at.alias("value")).union(ends).withColumnRenamed("k", "sample")


def running_median(rows: DataFrame, half: int) -> DataFrame:
    """Median over 2 * half + 1 samples of each channel."""
    w = Window.partitionBy("channel").orderBy("sample").rowsBetween(-half, half)
    return rows.select("channel", "sample", F.percentile("value", 0.5).over(w).alias("value"))


def units(spikes: DataFrame, span: float, bin_seconds: float, tolerance: float) -> DataFrame:
    """Per unit: spikes after removing those within ``tolerance`` of the one before, rate before that, and CV of binned counts."""
    w = Window.partitionBy("unit").orderBy("t")
    kept = spikes.withColumn("__d", F.col("t") - F.lag("t").over(w)).withColumn("fresh", F.col("__d").isNull() | (F.col("__d") > tolerance))
    n_bins = int(-(-span // bin_seconds))
    per = kept.groupBy("unit", F.floor(F.col("t") / F.lit(bin_seconds)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("fresh").cast("long")).alias("k"))
    sums = per.groupBy("unit").agg(F.sum("n").alias("n"), F.sum("k").alias("kept"), F.sum(F.col("n") * F.col("n")).alias("q"))
    mean = F.col("n") / F.lit(n_bins)
    sd = F.sqrt((F.col("q") - F.lit(n_bins) * mean * mean) / F.lit(n_bins - 1))
    return sums.select("unit", "n", "kept", (F.col("n") / F.lit(span)).alias("rate"), (sd / mean).alias("cv"))


def good_units(stats: DataFrame, most_cv: float = 0.5, least_rate: float = 0.2) -> DataFrame:
    return stats.where((F.col("cv") < most_cv) & (F.col("rate") > least_rate))


def channel_groups(groups: DataFrame) -> DataFrame:
    """Running channel range [first, last] of each group in order: groups are few."""
    w = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, 0)
    return groups.withColumn("last", F.sum("n_channels").over(w) - 1).withColumn("first", F.col("last") - F.col("n_channels") + 1)


def locate_channels(channels: DataFrame, groups: DataFrame) -> DataFrame:
    """Group and place in it of global channel numbers from 0."""
    spans = channel_groups(groups).select("group", F.col("first").alias("t0"), (F.col("last") + 1).alias("t1"))
    return in_intervals(channels.withColumn("t", F.col("channel")), spans).select("channel", "group", (F.col("channel") - F.col("t0")).alias("place"))


def rename_regions(df: DataFrame, names: dict[str, str], column: str = "region") -> DataFrame:
    """Side prefix l or r dropped, then names mapped; unknown ones stay."""
    plain = F.regexp_replace(column, r"^[lr](?=[A-Z])", "")
    table = F.create_map(*[F.lit(x) for kv in sorted(names.items()) for x in kv]) if names else None
    return df.withColumn(column, F.coalesce(table[plain], plain) if names else plain)


def trial_table(info: DataFrame, log: DataFrame, names: list[str], pulses: DataFrame, reach: int) -> DataFrame:
    """One row a trial: its last info row, first time of each event, moved to the first pulse in [t, t + reach)."""
    last = info.groupBy("trial").agg(F.max_by("value", "t").alias("value"))
    first = log.where(F.col("name").isin(names)).groupBy("trial", "name").agg(F.min("t").alias("t"))
    moved = asof(first, pulses.select("t", F.col("t").alias("pulse")), ["pulse"], "next", width=reach * 64)
    at = F.when(F.col("pulse") - F.col("t") < reach, F.col("pulse")).otherwise(F.col("t"))
    wide = moved.withColumn("t", at).groupBy("trial").agg(*[F.min(F.when(F.col("name") == n, F.col("t"))).alias(f"t_{n}") for n in names])
    return last.join(wide, "trial", "left")


def calibrate(gaze: DataFrame, dots: DataFrame) -> DataFrame:
    """Weighted plane fit of screen dots (dot, x, y) on median gaze: gx, gy mapped to x, y.

    Medians are one row a dot; the normal equations are solved from their sums.
    """
    m = gaze.groupBy("dot").agg(F.median("gx").alias("gx"), F.median("gy").alias("gy"), F.count(F.lit(1)).alias("w")).join(dots, "dot").toPandas()
    a = np.c_[np.ones(len(m)), m["gx"], m["gy"]].astype(float)
    w = np.sqrt(m["w"].to_numpy(float))[:, None]
    coef, *_ = np.linalg.lstsq(a * w, m[["x", "y"]].to_numpy(float) * w, rcond=None)
    fit = lambda k: F.lit(float(coef[0, k])) + F.lit(float(coef[1, k])) * F.col("gx") + F.lit(float(coef[2, k])) * F.col("gy")
    return gaze.withColumn("x", fit(0)).withColumn("y", fit(1))


def nearest_target(gaze: DataFrame, targets: DataFrame, on: list[str], most_degrees: float) -> DataFrame:
    """Target of the smallest angle to the gaze vector at the same frame; none beyond ``most_degrees``."""
    from eventloom.functions.scalar import vector_angle

    a = gaze.join(targets, on).withColumn("angle", vector_angle(F.col("gaze"), F.col("target")))
    best = a.groupBy(*gaze.columns).agg(F.min_by("name", F.struct("angle", "name")).alias("name"), F.min("angle").alias("angle"))
    return best.withColumn("name", F.when(F.col("angle") <= most_degrees, F.col("name")))


def assets(meta: DataFrame) -> DataFrame:
    """name, path, guid and is_dir of side-car texts (path, value)."""
    guid = F.regexp_extract("value", r"(?m)^guid:\s*([0-9a-f]+)", 1)
    path = F.regexp_replace("path", r"\.meta$", "")
    return meta.select(F.element_at(F.split(path, "/"), -1).alias("name"), path.alias("path"), guid.alias("guid"), F.col("value").rlike(r"(?m)^folderAsset:\s*yes").alias("is_dir"))


def scatter(df: DataFrame, keys: list[str], label: str, column: str) -> DataFrame:
    """keys, label, i and v: sums by tasks over vectors of each group of keys. Under a null label a count and the outer products, under each label its count and sums."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    label_kind = df.schema[label].dataType.simpleString()

    def part(batches):
        for batch in batches:
            pdf = batch.select([*keys, label]).to_pandas()
            rows = batch.column(column)
            x = rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)
            out = []
            for key, own in pdf.groupby(keys).indices.items():
                key, y, z = (key if isinstance(key, tuple) else (key,)), pdf[label].to_numpy()[own], x[own]
                out.append((*key, None, len(z), z.T @ z))
                out += [(*key, c, int((y == c).sum()), z[y == c].sum(axis=0)) for c in pd.unique(y)]
            yield from _sums(out, [*keys, label])

    def _sums(rows, names):
        for *key, n, v in rows:
            v = np.r_[float(n), v.ravel()]
            yield pa.RecordBatch.from_pydict({**{k: [c] * len(v) for k, c in zip(names, key, strict=True)}, "i": np.arange(len(v)), "v": v}, schema=arrow)

    arrow = to_arrow_schema(T.StructType([*[df.schema[k] for k in keys], T.StructField(label, df.schema[label].dataType), T.StructField("i", T.LongType()), T.StructField("v", T.DoubleType())]))
    sums = df.where(F.col(label).isNotNull() & F.col(column).isNotNull()).select(*keys, label, column).mapInArrow(part, f"{kinds}, {label} {label_kind}, i long, v double")
    return sums.groupBy(*keys, label, "i").agg(F.sum("v").alias("v"))


def parted(pdf: pd.DataFrame, label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts and means of the classes, and the outer products of all, from one group's sums."""
    pdf = pdf.sort_values("i")
    whole = pdf[pdf[label].isna()]["v"].to_numpy()
    d = int(np.sqrt(len(whole) - 1))
    classes = np.stack([g["v"].to_numpy() for _, g in pdf[pdf[label].notna()].groupby(label)])
    return classes[:, 0], classes[:, 1:] / classes[:, :1], whole[1:].reshape(d, d)


def discriminant_subspace(df: DataFrame, keys: list[str], label: str, column: str, axes: int, ridge: float = 1e-3) -> DataFrame:
    """Orthonormal axes of greatest between-class against within-class variance, for each group of keys.

    Tasks add up counts, sums and outer products; a group's fit sees those sums only, of
    (classes + dims) * dims numbers.
    """
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        n, means, outer = parted(pdf, label)
        d = len(outer)
        mean = n @ means / n.sum()
        between = (means - mean).T @ ((means - mean) * n[:, None])
        within = outer - means.T @ (means * n[:, None])
        half = np.linalg.cholesky(np.linalg.inv(within + ridge * np.trace(within) / d * np.eye(d)))
        v = np.linalg.eigh(half.T @ between @ half)[1][:, ::-1][:, :axes]
        q = np.linalg.qr(half @ v)[0]
        q = q * np.sign(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])])
        return pd.DataFrame([(*key, k, q[:, k].tolist()) for k in range(q.shape[1])], columns=[*keys, "axis", "weights"])

    return scatter(df, keys, label, column).groupBy(*keys).applyInPandas(fit, f"{kinds}, axis long, weights array<double>")


def event_samples(times: DataFrame, events: DataFrame, reach: int, exclude: int, share: float, folds: int, block: int) -> DataFrame:
    """Positives (within ``reach`` of an event) and a hashed share of negatives outside the exclusion, in time-blocked folds."""
    near = events.select((F.col("t") - F.lit(exclude).cast("long")).alias("t0"), (F.col("t") + F.lit(exclude).cast("long") + 1).alias("t1"), F.col("t").alias("e"))
    found = in_intervals(times, near).groupBy("t").agg(F.min(F.abs(F.col("t") - F.col("e"))).alias("gap"))
    rows = times.join(found, "t", "left").withColumn("y", F.when(F.col("gap") <= reach, 1).when(F.col("gap").isNull(), 0))
    kept = rows.where((F.col("y") == 1) | ((F.col("y") == 0) & (F.pmod(F.xxhash64("t"), F.lit(1000)) < share * 1000)))
    return kept.withColumn("fold", F.pmod(F.expr(f"t div {block}L"), F.lit(folds))).drop("gap")
