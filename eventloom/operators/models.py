"""Linear-algebra models. Sums over rows are made in Spark; matrices that reach one place are
bounded by the number of dimensions, or by one group's own size, and say so.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions import filters, numeric
from eventloom.operators import output_codes, scans
from eventloom.operators.zeta import zeta_test  # noqa: F401


def gram(df: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance of an array column.

    Each batch adds up its own outer products; one row a task of dims * dims numbers
    reaches the merge, which Spark sums place by place.
    """
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, None, None
        for batch in batches:
            rows = batch.column(0).drop_null()
            if len(rows):
                x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
                n, s, q = n + len(x), (0 if s is None else s) + x.sum(axis=0), (0 if q is None else q) + x.T @ x
        if n:
            values = np.r_[n, s, q.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["i", "v"])

    sums = df.select(column).mapInArrow(part, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
    if not len(sums):
        return 0, np.zeros(0), np.zeros((0, 0))
    d = int((-1 + np.sqrt(1 + 4 * (len(sums) - 1))) / 2)
    n, s, q = sums[0], sums[1 : d + 1], sums[d + 1 :].reshape(d, d)
    return int(n), s / n, (q - np.outer(s, s) / n) / max(n - 1, 1)


def pca(df: DataFrame, column: str) -> dict[str, np.ndarray]:
    """coeff, latent, explained (percent) and mu of an array column."""
    _, mu, cov = gram(df, column)
    latent, coeff = numeric.principal(cov)
    return {"coeff": coeff, "latent": latent, "explained": 100 * latent / max(latent.sum(), 1e-300), "mu": mu}


def project(df: DataFrame, column: str, basis: np.ndarray, origin: np.ndarray, out: str = "score", least_squares: bool = True) -> DataFrame:
    """Coordinates of rows in a basis, by least squares or axis by axis."""
    weights = basis @ np.linalg.inv(basis.T @ basis) if least_squares else basis
    shared = df.sparkSession.sparkContext.broadcast((weights, origin))  # dims * axes numbers

    @F.pandas_udf("array<double>")
    def score(x: pd.Series) -> pd.Series:
        w, o = shared.value
        return pd.Series(list((np.stack(x.to_numpy()).astype(np.float64) - o) @ w)) if len(x) else x

    return df.withColumn(out, score(column))


def unproject(coordinates: np.ndarray, basis: np.ndarray, origin: np.ndarray) -> np.ndarray:
    return coordinates @ basis.T + origin


def class_means(df: DataFrame, label: str, column: str) -> pd.DataFrame:
    """Mean vector of each class: classes * dims numbers."""
    long = df.select(label, F.posexplode(column).alias("dim", "x")).groupBy(label, "dim").agg(F.avg("x").alias("x")).toPandas()
    return long.pivot(index=label, columns="dim", values="x").sort_index()


def class_subspace(means: pd.DataFrame, unit: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Axes from class means less their grand mean, and that origin."""
    x = means.to_numpy()
    origin = x.mean(axis=0)
    axes = (x - origin).T
    return (axes / np.maximum(np.linalg.norm(axes, axis=0), 1e-300) if unit else axes), origin


def similarity(a: np.ndarray, b: np.ndarray, kind: str = "projection") -> float:
    """Sum of squared (or plain) singular values of A'B over the number of axes."""
    s = np.linalg.svd(a.T @ b, compute_uv=False)
    return float((s**2).sum() / a.shape[1] if kind == "projection" else s.sum() / a.shape[1])


def share_in_subspace(x: np.ndarray, basis: np.ndarray, origin: np.ndarray) -> float:
    """Chance-corrected share of the variance that a subspace holds."""
    q = np.linalg.qr(basis)[0]
    d = x - origin
    r2 = ((d @ q) ** 2).sum() / max((d**2).sum(), 1e-300)
    k, n = q.shape[1], q.shape[0]
    return float((r2 - k / n) / (1 - k / n))


def procrustes(a: np.ndarray, b: np.ndarray) -> dict[str, float]:
    """Leave-one-class-out alignment of class means a to b: r2, scale and rotation amount."""
    error = total = 0.0
    for i in range(len(a)):
        keep = np.arange(len(a)) != i
        ma, mb = a[keep].mean(axis=0), b[keep].mean(axis=0)
        u, s, v = np.linalg.svd((a[keep] - ma).T @ (b[keep] - mb))
        scale = s.sum() / max(((a[keep] - ma) ** 2).sum(), 1e-300)
        error += ((scale * (a[i] - ma) @ (u @ v) + mb - b[i]) ** 2).sum()
        total += ((b[i] - mb) ** 2).sum()
    u, s, v = np.linalg.svd((a - a.mean(axis=0)).T @ (b - b.mean(axis=0)))
    return {"r2": float(1 - error / max(total, 1e-300)), "scale": float(s.sum() / max(((a - a.mean(axis=0)) ** 2).sum(), 1e-300)), "rotation": numeric.rotation_amount(u @ v)}


def whitened_decoder(df: DataFrame, unit: str, label: str, fold: str, column: str, ridge: float = 1e-3) -> DataFrame:
    """Class of the nearest mean under the pooled residual covariance, learned without each row's own fold.

    Folds are few; for each, means (classes * dims) and a covariance (dims * dims) are broadcast.
    """
    out = None
    for k in sorted(r[0] for r in df.select(fold).distinct().collect()):
        train = df.where(F.col(fold) != k)
        means = class_means(train, label, column)
        _, _, cov = gram(train.select(_residual(df, means)(column, label).alias("r")), "r")
        scale = np.linalg.cholesky(np.linalg.inv(cov + ridge * np.trace(cov) / max(len(cov), 1) * np.eye(len(cov))))
        got = df.where(F.col(fold) == k).select(unit, label, _nearest(df, scale, means)(column).alias("guess"))
        out = got if out is None else out.unionByName(got)
    return out


def _residual(df: DataFrame, means: pd.DataFrame):
    shared = df.sparkSession.sparkContext.broadcast(means)

    @F.pandas_udf("array<double>")
    def residual(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(x.to_numpy()).astype(np.float64) - shared.value.loc[y].to_numpy()))

    return residual


def _nearest(df: DataFrame, scale: np.ndarray, means: pd.DataFrame):
    model = df.sparkSession.sparkContext.broadcast((scale, means.to_numpy() @ scale, means.index.to_numpy()))

    @F.pandas_udf("long")
    def guess(x: pd.Series) -> pd.Series:
        w, centres, names = model.value
        z = np.stack(x.to_numpy()).astype(np.float64) @ w
        return pd.Series(names[((z[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)].astype(np.int64))

    return guess


def svm_one_vs_rest(df: DataFrame, label: str, column: str, train, rounds: int = 100) -> DataFrame:
    """MLlib linear machines, one against the rest, fitted where ``train`` holds; adds ``guess``."""
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("features", array_to_vector(F.transform(column, lambda x: x.cast("double")))).withColumn("label", F.col(label).cast("double"))
    model = OneVsRest(classifier=LinearSVC(maxIter=rounds, regParam=0.01), parallelism=4).fit(rows.where(train).select("features", "label"))
    return model.transform(rows).withColumn("guess", F.col("prediction").cast("long")).drop("features", "prediction", "rawPrediction")


def svm_decoder(df: DataFrame, unit: str, label: str, fold: str, column: str, kind: str = "onevsall") -> DataFrame:
    """Class by linear machines learned without each row's own fold, all machines of all folds together (see output_codes.py)."""
    model = output_codes.learn(df, label, column, fold, kind)
    return output_codes.decode(df, model, column, fold).where(F.col(label).isNotNull()).select(unit, label, "guess")


def glm_poisson(df: DataFrame, predictors: list[str], response: str, family: str = "poisson") -> dict[str, float]:
    """MLlib generalised linear model over all rows: coefficients, intercept and deviance."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = VectorAssembler(inputCols=predictors, outputCol="features").transform(df)
    m = GeneralizedLinearRegression(family=family, labelCol=response, maxIter=25).fit(rows)
    return {**dict(zip(predictors, map(float, m.coefficients), strict=True)), "intercept": float(m.intercept), "deviance": float(m.summary.deviance)}


def by_group(df: DataFrame, keys: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A numpy kernel for each group; the groups are single units or channels, whose size their recording bounds."""
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = f(pdf)
        for k, v in zip(keys, key, strict=True):
            out[k] = v
        return out

    return df.groupBy(*keys).applyInPandas(run, schema)


def lasso_glm(df: DataFrame, key: str, predictors: list[str], response: str, family: str, alpha: float) -> DataFrame:
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        beta, b0, dev = numeric.glm(pdf[predictors].to_numpy(float), pdf[response].to_numpy(float), family, alpha)
        return pd.DataFrame({"coefficients": [beta.tolist()], "intercept": [b0], "deviance": [dev]})

    kind = df.schema[key].dataType.simpleString()
    return by_group(df, [key], fit, f"{key} {kind}, coefficients array<double>, intercept double, deviance double")


def hmm_states(df: DataFrame, key: str, order: str, count: str, states: int = 2) -> DataFrame:
    """Fits a Poisson HMM to each key's counts and filters them: bin and probability of the highest state."""
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        c = pdf[count].to_numpy(float)
        rates, stay, _ = numeric.hmm_fit(c, states)
        return pd.DataFrame({order: pdf[order], "p_high": numeric.hmm_filter(c, rates, stay)[:, -1], "rate_low": rates[0], "rate_high": rates[-1], "stay": stay})

    kind = df.schema[key].dataType.simpleString()
    return by_group(df.select(key, order, count), [key], fit, f"{key} {kind}, {order} long, p_high double, rate_low double, rate_high double, stay double")


def hmm_given(df: DataFrame, key: str, order: str, count: str, rates: list[float], stay: float, width: int | None = None) -> DataFrame:
    """Filters each key's counts through Poisson states of given rates, in rising order, by a scan over blocks of ``width`` bins: bin and probability of the highest state."""
    n = len(rates)
    off = (1 - stay) / max(n - 1, 1)
    y = F.col(count).cast("double")
    e = F.array(*[y * F.lit(math.log(max(r, 1e-12))) - F.lit(float(r)) for r in rates])
    a = F.array(*[F.lit(1.0 if n == 1 else stay if i == j else off) for i in range(n) for j in range(n)])
    rows = df.select(key, order, e.alias("e"), a.alias("a"), F.array_repeat(F.lit(1 / n), n).alias("start"))
    return scans.hidden_states(rows, (key,), order, n, width).select(key, order, F.col("p")[n - 1].alias("p_high"))


def filtered(df: DataFrame, key: str, order: str, value: str, fs: float, band: tuple[float, float], kind: str = "butter", poles: int = 6, ripple: float = 20.0) -> DataFrame:
    """Channels through a Butterworth or Chebyshev (``cheby2``) filter forwards and backwards; bands as in filters.sections()."""
    return scans.filtered(df, (key,), order, value, filters.sections(kind, poles, band, fs, ripple))


def margins(frame: pd.DataFrame, factors: tuple[str, ...], combine: list[list[tuple[str, ...]]] | None = None) -> dict[str, np.ndarray]:
    """Parts of centred cell means (units by cells) that each subset of factors explains, by inclusion and exclusion.

    ``combine`` lists the subsets whose parts are added up to one; subsets that it leaves out are parts of their own.
    """
    subsets = [s for k in range(1, len(factors) + 1) for s in combinations(factors, k)]
    mean = {s: frame.T.groupby(level=[factors.index(f) for f in s]).transform("mean").T.to_numpy() for s in subsets}
    part: dict[tuple[str, ...], np.ndarray] = {}
    for s in subsets:  # smaller ones come first
        part[s] = mean[s] - sum(part[q] for k in range(1, len(s)) for q in combinations(s, k))
    groups = [list(map(tuple, g)) for g in combine or []]
    groups += [[s] for s in subsets if not any(s in g for g in groups)]
    return {"+".join("*".join(s) for s in g): sum(part[s] for s in g) for g in groups}


def demixed(df: DataFrame, unit: str, factors: tuple[str, ...], value: str, components: int = 2, ridge: float = 1e-3, combine: list[list[tuple[str, ...]]] | None = None) -> DataFrame:
    """Demixed components of units by factors: share of variance that each component explains, that those up to it explain
    together, and the first less the share that noise alone would give.

    Cell means are made in Spark; the matrix is units * cells.
    """
    cells = df.groupBy(unit, *factors).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(F.lit(1)).alias("n")).toPandas()
    m = cells.pivot_table(index=unit, columns=list(factors), values="m").sort_index()
    m = m.apply(lambda r: r.fillna(r.mean()), axis=1)
    noise = np.diag(cells.assign(e=(cells.v / cells.n).fillna(0)).groupby(unit)["e"].mean().sort_index().to_numpy())
    x = m.to_numpy() - m.to_numpy().mean(axis=1, keepdims=True)
    found = numeric.demix(m.to_numpy(), noise, margins(pd.DataFrame(x, index=m.index, columns=m.columns), factors, combine), components, ridge)
    total, rows = (x**2).sum(), []
    for name, (w, u, share) in found.items():
        for k in range(len(share)):
            both = 100 - 100 * ((x - u[:, : k + 1] @ np.linalg.lstsq(u[:, : k + 1], x, rcond=None)[0]) ** 2).sum() / total
            chance = 100 * x.shape[1] * float(w[:, k] @ noise @ w[:, k]) / total
            rows.append((name, k, float(share[k]), float(both), float(share[k] - chance)))
    return df.sparkSession.createDataFrame(rows, "marginal string, component long, explained double, cumulative double, above_noise double")
