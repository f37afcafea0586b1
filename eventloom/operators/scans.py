"""Recurrences over ordered rows as scans over blocks of time, so that no group holds a whole series.

Rows are packed to one row a block (a key's orders from b * width on), once. What a block does to whatever comes in from
the block before it is a small matrix; the matrices of a key are chained over the table of blocks, in levels of ``FAN`` if
there are many, which gives each block its entry, and then blocks finish by themselves. Two kinds of products are used: of
matrices of logarithms (chances of hidden states, which never vanish by rounding) and plain ones (states of filters).

A block's part is (a, m): ``a`` leads into its first row from the row before, ``m`` from there to its last row; the first
block of a key needs no ``a``. Keys may be null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from eventloom.functions.timing import bucket
from eventloom.sources.tables import scratch

#: Rows of a block, and blocks that are chained in one group.
WIDTH = FAN = 4096


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def matched(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join by columns of equal name, nulls alike; the left ones stay."""
    other = right.select(*[F.col(n).alias(f"__{n}") for n in names], *[c for c in right.columns if c not in names])
    joined = left.join(other, reduce(lambda a, b: a & b, [left[n].eqNullSafe(other[f"__{n}"]) for n in names]), how)
    return joined.drop(*[f"__{n}" for n in names])


def kinds(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{n}` {df.schema[n].dataType.simpleString()}, " for n in names)


def blocks(rows: DataFrame, on: tuple[str, ...], order: str, columns: dict[str, Column], width: int) -> DataFrame:
    """One row a block: keys, b, at (orders, ascending), and the columns' values end to end. Orders are distinct within a key."""
    packed = F.struct(F.col(order).cast("long").alias("__o"), *[c.alias(n) for n, c in columns.items()])
    rows = rows.select(*on, bucket(order, width).alias("b"), packed.alias("s"))
    nested = {n for n in columns if rows.schema["s"].dataType[n].dataType.typeName() == "array"}
    rows = rows.groupBy(*on, "b").agg(F.array_sort(F.collect_list("s")).alias("s"))
    taken = {n: F.col("s")[n] for n in columns}  # a field of an array of structs: the array of the field
    return rows.select(*on, "b", F.col("s")["__o"].alias("at"), *[(F.flatten(c) if n in nested else c).alias(n) for n, c in taken.items()])


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    """log-sum-exp; minus infinity of nothing but that."""
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def log_times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of (..., n, n) matrices of logarithms, their greatest entry brought to 0."""
    out = lse(x[..., :, :, None] + y[..., None, :, :], -2)
    top = out.max(axis=(-2, -1), keepdims=True)
    return out - np.where(np.isfinite(top), top, 0.0)


def prefixes(m: np.ndarray, times: Callable = log_times) -> np.ndarray:
    """Products of the first 1, 2, ... matrices, by doubling."""
    out, step = m.copy(), 1
    while step < len(out):
        out[step:] = times(out[:-step], out[step:])
        step *= 2
    return out


def product(m: np.ndarray, times: Callable = log_times) -> np.ndarray:
    """Product of all matrices, pair by pair."""
    while len(m) > 1:
        pairs = times(m[: len(m) // 2 * 2 : 2], m[1 : len(m) // 2 * 2 : 2])
        m = np.concatenate([pairs, m[len(m) // 2 * 2 :]])
    return m[0]


def _row(v: np.ndarray, m: np.ndarray, log: bool) -> np.ndarray:
    if not log:
        return v @ m
    out = lse(v[:, None] + m, 0)
    return out - lse(out, 0)


_ENTRY = "b long, v array<double>, u array<double>"


def entries(parts: DataFrame, on: tuple[str, ...], n: int, log: bool, back: bool = False, fan: int | None = None) -> DataFrame:
    """What comes into each block: keys, b, v, and u, which is v before ``a`` (null at a key's first block).

    parts: keys, b, a, m (row by row; no ``a`` stands for the identity) and v, which the first block's start with. ``back``
    goes from the last block to the first: v is then what comes to a block's last row from all later ones, as a column.
    """
    fan = FAN if fan is None else fan
    square = lambda x: np.asarray(x, float).reshape(n, n)
    times = log_times if log else np.matmul

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = v = None
        for pdf in frames:
            out, came = [], pdf["u"] if "u" in pdf else repeat(None)
            for first, a, m, start, own in zip(pdf["__first"], pdf["a"], pdf["m"], pdf["v"], came, strict=False):
                if first:
                    v, u = np.asarray(start, float), None if own is None else np.asarray(own, float)
                else:
                    u, v = before, before
                    if not back and a is not None and len(a):
                        v = _row(v, square(a), log)
                out.append((v, u))
                before = _row(v, square(m).T if back else square(m), log)
                if back and a is not None and len(a):
                    before = _row(before, square(a).T, log)
            got = pdf[[*on, "b"]].reset_index(drop=True)
            got["v"], got["u"] = [v for v, _ in out], [u for _, u in out]
            yield got

    def walked(rows: DataFrame, keys: list[str]) -> DataFrame:
        # blocks of a key in their order, many keys to a task
        w = Window.partitionBy(*keys).orderBy(F.col("b").desc() if back else F.col("b").asc())
        return rows.withColumn("__first", F.row_number().over(w) == 1).mapInPandas(walk, kinds(rows, on) + _ENTRY)

    low, high = parts.agg(F.min("b"), F.max("b")).first()
    if low is None or high - low < fan:
        return walked(parts, [*on])

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b")
        m = np.stack([square(x) for x in pdf["m"]])
        a = [x is not None and len(x) > 0 for x in pdf["a"]]
        m = [m[0], *(times(square(x), y) if has else y for x, y, has in zip(pdf["a"].iloc[1:], m[1:], a[1:], strict=True))]
        got = pdf[[*on, "g"]].iloc[[0]].rename(columns={"g": "b"})
        got["a"], got["m"], got["v"] = [pdf["a"].iloc[0]], [product(np.stack(m), times).ravel()], [pdf["v"].iloc[-1 if back else 0]]
        return got

    grouped = parts.withColumn("g", bucket("b", fan))
    above = stored(grouped.groupBy(*on, "g").applyInPandas(joined, kinds(parts, on) + "b long, a array<double>, m array<double>, v array<double>"), "scan-level")
    above = entries(above, on, n, log, back, fan).withColumnRenamed("b", "g")
    return walked(matched(grouped.drop("v"), above, [*on, "g"]), [*on, "g"])


def _log_elements(e, a, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the changes into each row (rows, blocks, n, n), and of changes and evidence together (the first row's by evidence alone); blocks are of one length."""
    e, a = np.stack(list(e)).astype(float), np.stack(list(a)).astype(float)
    e, a = (np.swapaxes(x.reshape(len(x), -1, *shape), 0, 1) for x, shape in ((e, (n,)), (a, (n, n))))
    with np.errstate(divide="ignore"):
        a = np.log(a)
    m = a + e[..., None, :]
    m[0] = np.where(np.eye(n, dtype=bool), e[0][:, None, :], -np.inf)
    return a, m


#: Numbers of the matrices that are multiplied at once.
CELLS = 1 << 18


def _by_length(lengths: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Places of blocks of one length, not too many at once."""
    for length in np.unique(lengths):
        own, size = np.flatnonzero(lengths == length), max(CELLS // (int(length) * n * n), 1)
        yield from (own[k : k + size] for k in range(0, len(own), size))


def _frames(f: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                yield f(pdf)

    return run


def hidden_states(rows: DataFrame, on: tuple[str, ...], order: str, states: int, width: int | None = None, smooth: bool = False, fan: int | None = None) -> DataFrame:
    """keys, order and p, the chances of the states given the rows up to each one; with ``smooth`` also ``both``, given all rows, and ``change`` (row by row), the chances of changes into each row (null at the first).

    rows have keys, order (distinct whole numbers, one bin after the other), e (log evidence of each state), a (chances of
    changes into the row, row by row, unused in a key's first row) and start (chances before the first row's evidence).
    """
    width, n = width or WIDTH, states
    packed = blocks(rows, on, order, {"e": F.col("e"), "a": F.col("a"), "start": F.col("start")}, width)
    # few bytes may be much work, so their tasks aren't left to the bytes
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    packed = stored(packed.withColumn("start", F.slice("start", 1, n)).repartition(tasks, *on, "b"), "scan-blocks")

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[[*on, "b"]].copy()
        with np.errstate(divide="ignore"):
            out["v"] = [np.log(np.asarray(s, float)) for s in pdf["start"]]
        into, whole = np.zeros((2, len(pdf), n * n))
        for own in _by_length(pdf["at"].str.len().to_numpy(), n):
            a, m = _log_elements(pdf["e"].iloc[own], pdf["a"].iloc[own], n)
            into[own], whole[own] = a[0].reshape(len(own), -1), product(m).reshape(len(own), -1)
        out["a"], out["m"] = list(into), list(whole)
        return out

    parts = stored(packed.mapInPandas(_frames(part), kinds(packed, on) + "b long, v array<double>, a array<double>, m array<double>"), "scan-parts")
    ready = matched(packed.drop("start"), entries(parts, on, n, True, fan=fan), [*on, "b"])
    if smooth:
        later = entries(parts.withColumn("v", F.array_repeat(F.lit(0.0), n)), on, n, True, back=True, fan=fan).select(*on, "b", F.col("v").alias("w"))
        ready = matched(ready, later, [*on, "b"])

    names = ["p", "both", "change"] if smooth else ["p"]
    kind = T.StructType([*[packed.schema[c] for c in on], T.StructField(order, T.LongType()), *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in names]])
    arrow = to_arrow_schema(kind)

    def lists(x: np.ndarray, none: np.ndarray | None = None) -> pa.Array:
        """(rows, blocks, ...) as lists, block by block; ``none`` marks blocks whose first row has none."""
        flat = np.swapaxes(x, 0, 1).reshape(x.shape[0] * x.shape[1], -1)
        offsets = pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32))
        if none is None:
            return pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))
        gone = np.zeros((x.shape[1], x.shape[0]), bool)
        gone[:, 0] = none
        return pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()), mask=pa.array(gone.ravel()))

    def finished(pdf: pd.DataFrame) -> list[pa.Array]:
        a, m = _log_elements(pdf["e"], pdf["a"], n)
        alpha = lse(np.stack(pdf["v"].to_list())[None, :, :, None] + prefixes(m), -2)
        alpha -= lse(alpha, -1)[..., None]
        if not smooth:
            return [lists(np.exp(alpha))]
        w = np.stack(pdf["w"].to_list())
        # products of the matrices after each row, from the end
        after = prefixes(np.swapaxes(m[:0:-1], -2, -1)) if len(m) > 1 else m[:0]
        beta = np.concatenate([lse(w[None, :, :, None] + after, -2)[::-1], w[None]])
        g = alpha + beta
        e = np.swapaxes(np.stack(pdf["e"].to_list()).reshape(len(pdf), -1, n), 0, 1)
        none = pdf["u"].isna().to_numpy()
        first = np.stack([np.full(n, np.nan) if u is None else np.asarray(u, float) for u in pdf["u"]])
        x = np.concatenate([first[None], alpha[:-1]])[..., None] + a + (e + beta)[..., None, :]
        flat = x.reshape(*x.shape[:2], -1)
        with np.errstate(invalid="ignore"):
            flat = np.exp(flat - lse(flat, -1)[..., None])
        return [lists(np.exp(alpha)), lists(np.exp(g - lse(g, -1)[..., None])), lists(flat, none)]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pdf = batch.select(["at", "e", "a", "v", *(["u", "w"] if smooth else [])]).to_pandas()
            lengths = pdf["at"].str.len().to_numpy()
            for own in _by_length(lengths, n) if len(pdf) else ():
                some = pdf.iloc[own]
                keys = [batch.column(c).take(pa.array(np.repeat(own, lengths[own]))) for c in on]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*keys, pa.array(np.concatenate(some["at"].to_list())), *finished(some)], arrow, strict=True)], schema=arrow)

    return ready.repartition(tasks, *on, "b").mapInArrow(finish, kind)


def _mirrored(rows: DataFrame, on: tuple[str, ...], order: str, value: str, reach: int) -> DataFrame:
    """The series of each key with its first and last ``reach`` samples turned around its ends; ``own`` marks the series itself."""
    ends = rows.groupBy(*on).agg(F.min(order).alias("__first"), F.max(order).alias("__last"), F.min_by(value, order).alias("__x"), F.max_by(value, order).alias("__y"))
    at, x = F.col(order), F.col(value)
    both = matched(rows, ends, list(on)) if on else rows.crossJoin(F.broadcast(ends))  # one row without keys
    copies = F.array(
        F.struct(at.alias("o"), x.alias("x"), F.lit(1.0).alias("own")),
        F.when((at > F.col("__first")) & (at <= F.col("__first") + reach), F.struct((2 * F.col("__first") - at).alias("o"), (2 * F.col("__x") - x).alias("x"), F.lit(0.0).alias("own"))),
        F.when((at < F.col("__last")) & (at >= F.col("__last") - reach), F.struct((2 * F.col("__last") - at).alias("o"), (2 * F.col("__y") - x).alias("x"), F.lit(0.0).alias("own"))),
    )
    return both.select(*on, F.explode(F.filter(copies, lambda s: s.isNotNull())).alias("s")).select(*on, F.col("s.o").alias("o"), F.col("s.x").alias("x"), F.col("s.own").alias("own"))


def filtered(df: DataFrame, on: tuple[str, ...], order: str, value: str, sos: np.ndarray, both_ways: bool = True, reach: int | None = None, width: int | None = None, fan: int | None = None) -> DataFrame:
    """keys, order and value of uniformly sampled series (orders are whole numbers, one sample after the other) through second-order sections.

    Both ways (zero phase), the ends are first continued by ``reach`` samples turned around them (three times the number of
    poles) and each pass begins in the state to which its first sample alone would lead; one way, it begins at rest. The
    samples are shuffled once, into blocks; a pass hands each block the state that all blocks before it leave.
    """
    from eventloom.functions.filters import cascade

    coded, n = tuple(map(tuple, np.asarray(sos, float).tolist())), 2 * len(sos) + 1
    rows = df.select(*on, F.col(order).cast("long").alias("o"), F.col(value).cast("double").alias("x"))
    if both_ways:
        rows = _mirrored(rows, on, "o", "x", 3 * (n - 1) if reach is None else reach)
    else:
        rows = rows.withColumn("own", F.lit(1.0))
    packed = stored(blocks(rows, on, "o", {"x": F.col("x"), "own": F.col("own")}, width or WIDTH), "filter-blocks")

    def passed(packed: DataFrame, back: bool) -> DataFrame:
        def samples(x) -> np.ndarray:
            x = np.asarray(x, float)
            return x[::-1] if back else x

        def part(pdf: pd.DataFrame) -> pd.DataFrame:
            f, out = cascade(coded), pdf[[*on]].copy()
            out["b"] = -pdf["b"] if back else pdf["b"]
            m, v = [], []
            for x in map(samples, pdf["x"]):
                whole = np.zeros((n, n))
                whole[:-1, :-1] = np.linalg.matrix_power(f.a, len(x)).T
                whole[-1, :-1], whole[-1, -1] = f.run(x, np.zeros(n - 1))[1], 1.0
                m.append(whole.ravel())
                v.append(np.r_[f.rest * x[0] if both_ways else np.zeros(n - 1), 1.0])
            out["a"], out["m"], out["v"] = [np.zeros(0)] * len(pdf), m, v
            return out

        def finish(pdf: pd.DataFrame) -> pd.DataFrame:
            f = cascade(coded)
            out = pdf[[*on, "b", "at", "own"]].copy()
            out["x"] = [samples(f.run(samples(x), np.asarray(v, float)[:-1])[0]) for x, v in zip(pdf["x"], pdf["v"], strict=True)]
            return out

        parts = stored(packed.mapInPandas(_frames(part), kinds(packed, on) + "b long, a array<double>, m array<double>, v array<double>"), "filter-parts")
        comes = entries(parts, on, n, False, fan=fan).select(*on, (-F.col("b") if back else F.col("b")).alias("b"), "v")
        return matched(packed, comes, [*on, "b"]).mapInPandas(_frames(finish), kinds(packed, on) + "b long, at array<long>, own array<double>, x array<double>")

    out = passed(packed, False)
    if both_ways:
        out = passed(stored(out, "filter-forward"), True)
    out = out.select(*on, F.explode(F.arrays_zip("at", "x", "own")).alias("s")).where("s.own = 1")
    return out.select(*on, F.col("s.at").cast(df.schema[order].dataType).alias(order), F.col("s.x").alias(value))
