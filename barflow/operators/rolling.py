"""
Windows over few, very long series.

A window per instrument would put a whole series into one task. Here rows are first numbered in parallel (counts of time slices give
the offsets), then cut into blocks, and each block gets the rows before it that its windows look back on. Windows are then taken per
block; all of them share one shuffle and one sort.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A block has this many rows at least, and so many times the rows it looks back on: the copies stay a 16th of all rows at most.
BLOCK, TIMES = 1 << 12, 16


def number_rows(df: DataFrame, by: list[str], ts: str = "ts_ms", tie: list[str] | None = None, slice_ms: int = 86_400_000, name: str = "rn") -> DataFrame:
    """Adds `rn`, from 1 in the order of (ts, tie), without bringing a key's rows together: only one row for each time slice meets."""
    sliced = df.withColumn("_slice", F.floor(F.col(ts) / slice_ms))
    counts = sliced.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_slice")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy(ts, *(tie or [])))
    return sliced.join(before, [*by, "_slice"]).withColumn(name, (F.col("_before") + inside).cast("long")).drop("_slice", "_before")


def running(df: DataFrame, by: list[str], ts: str, tie: list[str], value: Column, how: str, name: str, own: bool = True, slice_ms: int = 86_400_000) -> DataFrame:
    """
    Adds `name`: the sum or max (`how`) of `value` over all rows up to this one in the order of (ts, tie), or, unless `own`, over those
    before it. Taken inside time slices, with one row for each slice chained; with `own`, rows that tie have the same value.
    """
    f = {"sum": F.sum, "max": F.max}[how]
    sliced = df.withColumn("_slice", F.floor(F.col(ts) / slice_ms)).withColumn("_v", value)
    totals = sliced.groupBy(*by, "_slice").agg(f("_v").alias("_t"))
    before = totals.select(*by, "_slice", f("_t").over(Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    w = Window.partitionBy(*by, "_slice").orderBy(ts, *tie)
    inside = f("_v").over(w if own else w.rowsBetween(Window.unboundedPreceding, -1))
    both = F.greatest(inside, F.col("_before")) if how == "max" else F.coalesce(inside, F.lit(0)) + F.coalesce("_before", F.lit(0))
    return sliced.join(before, [*by, "_slice"]).withColumn(name, both).drop("_slice", "_v", "_before")


def with_lookback(numbered: DataFrame, rows: int, block: int | None = None, rn: str = "rn", by: list[str] | None = None) -> DataFrame:
    """
    Adds _block, and _halo for the copies of a block's last `rows` rows that the next block looks back on. With `by`, the series' key,
    blocks are dealt out at once, to as many tasks as shuffles have: long windows cost far more than their bytes would tell.
    """
    block = block or max(BLOCK, TIMES * rows)
    own = F.floor((F.col(rn) - 1) / block)
    tail = (F.col(rn) - 1) % block >= block - rows
    if rows >= block:
        raise ValueError("a block is longer than what its windows look back on")
    copies = F.when(tail, F.array(F.struct(own.alias("b"), F.lit(False).alias("h")), F.struct((own + 1).alias("b"), F.lit(True).alias("h")))).otherwise(F.array(F.struct(own.alias("b"), F.lit(False).alias("h"))))
    out = numbered.withColumn("_c", F.explode(copies)).withColumn("_block", F.col("_c.b")).withColumn("_halo", F.col("_c.h")).drop("_c")
    return out.repartition(int(out.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "_block") if by else out


def without_lookback(df: DataFrame) -> DataFrame:
    return df.where(~F.col("_halo")).drop("_block", "_halo")


class Series:
    """Column expressions over a block's rows."""

    def __init__(self, by: list[str], rn: str = "rn"):
        self.w, self.rn = Window.partitionBy(*by, "_block").orderBy(rn), rn

    def lag(self, c: Column, k: int = 1) -> Column:
        return F.lag(c, k).over(self.w)

    def frame(self, n: int):
        return self.w.rowsBetween(-(n - 1), 0)

    def full(self, n: int, value: Column, other=0.0) -> Column:
        """`value` where the series has n rows, else `other`."""
        return F.when(F.col(self.rn) >= n, value).otherwise(F.lit(other) if other is not None else None)

    def mean(self, c: Column, n: int) -> Column:
        return F.avg(c).over(self.frame(n))

    def sd(self, c: Column, n: int) -> Column:
        return F.stddev_samp(c).over(self.frame(n))

    def most(self, c: Column, n: int) -> Column:
        return F.max(c).over(self.frame(n))

    def least(self, c: Column, n: int) -> Column:
        return F.min(c).over(self.frame(n))


def _extreme(x: np.ndarray, n: int) -> np.ndarray:
    """The greatest of the last n: of a segment's running extreme and that of the one before, from its end. NaN is no value."""
    cut = np.full(-(-len(x) // n) * n, -np.inf)
    cut[: len(x)] = np.where(np.isnan(x), -np.inf, x)
    cut = cut.reshape(-1, n)
    begin = np.maximum.accumulate(cut, axis=1).ravel()[: len(x)]
    end = np.maximum.accumulate(cut[:, ::-1], axis=1)[:, ::-1].ravel()
    begin[n - 1 :] = np.maximum(begin[n - 1 :], end[: max(0, len(x) - n + 1)])
    return np.where(np.isinf(begin), np.nan, begin)


class _Moments:
    """Mean and squared deviations of the last n values, by segments as extremes are, so that no window is the difference of long sums. NaN is no value."""

    def __init__(self, x: np.ndarray):
        self.x, self.ok = x, ~np.isnan(x)
        at = np.flatnonzero(self.ok)
        moved = np.zeros(len(x), bool)
        moved[at[1:]] = x[at[1:]] != x[at[:-1]]  # another value than the one before, nulls left out
        run = lambda v: np.concatenate(([0], np.cumsum(v)))
        self.other, self.moved = run(self.ok & (x != 0)), run(moved)
        self.next = np.concatenate((at, [len(x)]))[np.searchsorted(at, np.arange(len(x)))]
        self.known: dict[int, tuple[np.ndarray, ...]] = {}

    def segments(self, n: int) -> tuple[np.ndarray, ...]:
        """Number, mean and sum of squared deviations of each window."""
        if n in self.known:
            return self.known[n]
        size, length = len(self.x), -(-len(self.x) // n) * n
        ok, x = np.zeros(length, bool), np.zeros(length)
        ok[:size], x[:size] = self.ok, np.where(self.ok, self.x, 0.0)
        ok, x = ok.reshape(-1, n), x.reshape(-1, n)
        center = x.sum(axis=1, keepdims=True) / np.maximum(ok.sum(axis=1, keepdims=True), 1)
        off = np.where(ok, x - center, 0.0)

        def moments(v: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, ...]:
            k, s, q = np.cumsum(k, axis=1), np.cumsum(v, axis=1), np.cumsum(v * v, axis=1)
            mean = s / np.maximum(k, 1)
            return k, mean + center, np.maximum(q - s * mean, 0.0)

        k, mean, m2 = (v.ravel()[:size] for v in moments(off, ok))
        k0, mean0, m20 = (v[:, ::-1].ravel() for v in moments(off[:, ::-1], ok[:, ::-1]))
        i = np.arange(n - 1, size)
        i = i[(i + 1) % n != 0]  # others are whole segments
        a, b = k0[i - n + 1], k[i]
        gap, both = mean0[i - n + 1] - mean[i], np.maximum(a + b, 1)
        m2[i] = np.where(a == 0, m2[i], np.where(b == 0, m20[i - n + 1], m2[i] + m20[i - n + 1] + gap * gap * a * b / both))
        mean[i] = np.where(b == 0, mean0[i - n + 1], mean[i] + np.where(a == 0, 0.0, gap * a / both))
        k[i] = a + b
        self.known[n] = k, mean, m2
        return self.known[n]

    def window(self, how: str, n: int) -> np.ndarray:
        k, mean, m2 = self.segments(n)
        i = np.arange(1, len(self.x) + 1)
        lo = np.maximum(0, i - n)
        if how == "mean":  # 0 exactly where all values are 0
            return np.where(k > 0, np.where(self.other[i] == self.other[lo], 0.0, mean), np.nan)
        rest = k if how.endswith("pop") else k - 1
        var = np.where(self.moved[i] == self.moved[np.minimum(self.next[lo] + 1, i)], 0.0, m2) / np.maximum(rest, 1)  # 0 exactly where all are one value
        return np.where(rest > 0, np.sqrt(var) if how.startswith("sd") else var, np.nan)


def sliding(rows: DataFrame, by: list[str], wants: dict[str, tuple[str, str, int | str]], rn: str = "rn") -> DataFrame:
    """
    Adds windows of the last n rows at a cost that doesn't grow with n. rows: with _block, from with_lookback(). wants: new column to
    (how, column, n), taken in order; how is one of mean, var_pop, var_samp, sd_pop, sd_samp, max, min, as Spark's aggregates over a
    frame of n rows, or `minus`, with a second column for n. The column may be one that was wanted before.

    All windows of a block are taken in one task at once: rows are cut into segments of n, a window is the end of one and the beginning
    of the next, and both are running extremes, or running moments, of a segment. Numbers are doubles; NaN counts as null.
    """
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.DoubleType()) for c in wants)])

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by(rn)
        found: dict[str, np.ndarray] = {}
        moments: dict[str, _Moments] = {}

        def column(c: str) -> np.ndarray:
            if c not in found:
                found[c] = table.column(c).to_pandas().astype("float64").to_numpy()
            return found[c]

        for new, (how, c, n) in wants.items():
            if how == "minus":
                found[new] = column(c) - column(n)
            elif how in ("max", "min"):
                found[new] = _extreme(column(c), n) if how == "max" else -_extreme(-column(c), n)
            else:
                moments[c] = moments.get(c) or _Moments(column(c))
                found[new] = moments[c].window(how, n)
        for new in wants:
            table = table.append_column(new, pa.array(found[new], mask=np.isnan(found[new])))
        return table

    return rows.groupBy(*by, "_block").applyInArrow(solve, schema)
