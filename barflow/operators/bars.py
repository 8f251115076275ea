"""Ticks to bars, newest rows, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def spread_bp(bid="bid", ask="ask", mid="mid"):
    return F.when(F.col(mid) > 0, (F.col(ask) - F.col(bid)) / F.col(mid) * 1e4).otherwise(0.0)


def bucket_floor(ts, width: int):
    """Start of the bucket; right for times before 1970 too."""
    return ts - F.pmod(ts, F.lit(width))


def ohlcv_bars(ticks: DataFrame, interval_ms: int = 10_000, tie: str = "event_id") -> DataFrame:
    """Tumbling bars of mid stamped at their end; empty buckets give none. One shuffle of partial bars."""
    at = F.struct("ts_ms", tie)
    end = (bucket_floor(F.col("ts_ms"), interval_ms) + interval_ms).alias("end_ms")
    bars = ticks.groupBy("instrument", end).agg(F.min_by("mid", at).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", at).alias("close"), F.count("*").alias("n_ticks"), F.avg(spread_bp()).alias("spread_bp_avg"))
    return bars.withColumnRenamed("end_ms", "ts_ms")


def on_grid(last: DataFrame, step_ms: int, values: list[str]) -> DataFrame:
    """`last` (instrument, ts_ms on a grid, values) on every step between each instrument's first and last, filled forward."""
    gap = Window.partitionBy("instrument").orderBy("ts_ms")
    upto = F.coalesce(F.lead("ts_ms").over(gap) - step_ms, F.col("ts_ms"))
    return last.withColumn("_upto", upto).withColumn("ts_ms", F.explode(F.sequence("ts_ms", "_upto", F.lit(step_ms)))).select("instrument", "ts_ms", *values)


def resample_last(ticks: DataFrame, step_ms: int = 3000, tie: str = "event_id") -> DataFrame:
    """Last bid and ask of each step, on every step. A quote is repeated until the next, so the fill needs no further sort."""
    at = F.struct("ts_ms", tie)
    last = ticks.groupBy("instrument", bucket_floor(F.col("ts_ms"), step_ms).alias("step")).agg(F.max_by("bid", at).alias("bid"), F.max_by("ask", at).alias("ask")).withColumnRenamed("step", "ts_ms")
    return on_grid(last, step_ms, ["bid", "ask"])


def resample_ohlc(ticks: DataFrame, step_ms: int = 3000, tie: str = "event_id") -> DataFrame:
    bars = ohlcv_bars(ticks, step_ms, tie).withColumn("ts_ms", F.col("ts_ms") - step_ms)
    return on_grid(bars, step_ms, ["open", "high", "low", "close"])


def latest_n(df: DataFrame, n: int, by: list[str], order: list[str], most: int = 10_000) -> DataFrame:
    """The newest n rows of each key, `most` of them where n is larger, as a request limit. Spark limits each partition's groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= max(0, min(n, most))).drop("_rank")


def latest_row(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*by, "_row.*")


def retention_split(df: DataFrame, cap: int, by: list[str], ts: str = "ts_ms") -> DataFrame:
    """Adds kept: whether a row is as new as the cap-th newest of its key; ties at the border stay."""
    counts = df.groupBy(*by, ts).agg(F.count("*").alias("_n"))
    newer = F.sum("_n").over(Window.partitionBy(*by).orderBy(F.desc(ts)).rowsBetween(Window.unboundedPreceding, -1))
    border = counts.withColumn("_newer", F.coalesce(newer, F.lit(0))).where(F.col("_newer") < cap).groupBy(*by).agg(F.min(ts).alias("_cut"))
    return df.join(border, by).withColumn("kept", F.col(ts) >= F.col("_cut")).drop("_cut")
