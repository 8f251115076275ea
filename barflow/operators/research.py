"""Overfitting probability, bootstrap intervals, and the trader's state machine over parameter sets."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pbo(returns: DataFrame, blocks: int = 8) -> DataFrame:
    """
    returns: period (from 0), strategy, r. Probability of backtest overfitting: over all halves of the blocks, how often the best
    strategy inside is below the median outside. Periods beyond whole blocks are left out, as unequal
    blocks can't be compared; 0.5 for fewer than two strategies or two periods a block. Rows are read into a sum, a square sum and a
    count for each block and strategy.
    """
    spark = returns.sparkSession
    n, strategies = returns.agg(F.coalesce(F.max("period") + 1, F.lit(0)), F.count_distinct("strategy")).first()
    if strategies < 2 or n < 2 * blocks or blocks < 2:
        return spark.range(1).select(F.lit(0).cast("long").alias("n_splits"), F.lit(0.5).alias("pbo"))
    blocks -= blocks % 2
    size = n // blocks
    cells = returns.where(F.col("period") < size * blocks).withColumn("block", F.floor(F.col("period") / size).cast("int")).groupBy("block", "strategy").agg(F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"), F.count("*").alias("n"))
    masks = spark.range(1 << blocks).where(F.bit_count("id") == blocks // 2).withColumnRenamed("id", "mask")
    inside = F.call_function("shiftright", F.col("mask"), F.col("block")).bitwiseAND(F.lit(1)) == 1
    halves = masks.crossJoin(F.broadcast(cells)).groupBy("mask", "strategy", inside.alias("inside")).agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))  # masks and cells depend on parameters and strategies only
    mean = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    halves = halves.withColumn("sharpe", F.when(sd > 1e-12, mean / sd).otherwise(0.0))
    best = halves.where("inside").groupBy("mask").agg(F.max_by("strategy", F.struct("sharpe", "strategy")).alias("best"))
    rank = F.row_number().over(Window.partitionBy("mask").orderBy("sharpe", "strategy"))
    count = F.count("*").over(Window.partitionBy("mask"))
    out = halves.where("NOT inside").withColumn("share", rank / (count + 1)).join(best, "mask").where("strategy = best")
    return out.agg(F.count("*").alias("n_splits"), F.avg((F.col("share") < 0.5).cast("double")).alias("pbo"))


def bootstrap(df: DataFrame, value: str, stat: Callable[[str], Column], resamples: int = 200, alpha: float = 0.05, seed: int = 42, key: tuple[str, ...] = ()) -> DataFrame:
    """
    Percentile interval of an aggregate `stat`. Every row enters each resample a Poisson(1) number of times, drawn from a hash, so
    resamples need no random access and no shuffle of rows, and reruns agree however rows are partitioned. `key`: columns that tell rows
    apart (none: all of them, so equal rows are drawn together). stat gets the name of a column to aggregate.
    """
    u = F.pmod(F.xxhash64("_id", "resample", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    steps, total, term = [], 0.0, 2.718281828459045**-1
    for k in range(1, 9):
        total += term
        steps.append(total)
        term /= k
    times = sum(((u >= s).cast("int") for s in steps), F.lit(0))
    rows = df.select(F.col(value), F.xxhash64(*(key or df.columns)).alias("_id"))
    drawn = rows.withColumn("resample", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("_times", times).where("_times > 0")
    drawn = drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    each = drawn.groupBy("resample").agg(stat(value).alias("stat"))
    return each.agg(F.percentile("stat", alpha / 2).alias("low"), F.avg("stat").alias("mean"), F.percentile("stat", 1 - alpha / 2).alias("high"))


#: Least and greatest value of each trader parameter, and whether it is a whole number.
BOUNDS = {
    "long_threshold": (0.50, 0.95, False),
    "short_threshold": (0.50, 0.95, False),
    "take_threshold": (0.40, 0.95, False),
    "min_conf_margin": (0.05, 0.40, False),
    "stop_loss_atr": (0.30, 4.00, False),
    "take_profit_atr": (0.30, 6.00, False),
    "trailing_stop_atr": (0.00, 5.00, False),
    "min_hold_bars": (10, 60, True),
    "max_hold_bars": (60, 360, True),
    "cooldown_bars": (6, 60, True),
    "max_position_frac": (0.01, 1.00, False),
    "daily_loss_limit_bp": (25, 1500, False),
    "max_dd_pause_bp": (50, 5000, False),
    "spread_max_bp": (0.5, 30, False),
    "stale_data_ms": (1000, 120_000, True),
}


def out_of_bounds(grid: DataFrame, bounds: Mapping[str, tuple[float, float, bool]] = BOUNDS) -> Column:
    """The names of a parameter set's values that are missing, outside their bounds, or not whole where they should be; columns without bounds are free."""
    bad = []
    for name in grid.columns:
        if name in bounds:
            low, high, whole = bounds[name]
            c = F.col(f"`{name}`").cast("double")
            right = c.between(low, high) & ((c == F.floor(c)) if whole else F.lit(True))
            bad.append(F.when(~F.coalesce(right, F.lit(False)), F.lit(name)))
    return F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")


def bounded(grid: DataFrame, bounds: Mapping[str, tuple[float, float, bool]] = BOUNDS) -> DataFrame:
    """`grid` with each value moved to the nearest one inside its bounds, whole where it should be; nulls become the least value."""
    def moved(name: str) -> Column:
        low, high, whole = bounds[name]
        c = F.col(f"`{name}`").cast("double")
        return F.coalesce(F.least(F.greatest(F.round(c) if whole else c, F.lit(float(low))), F.lit(float(high))), F.lit(float(low)))

    return grid.select(*(moved(c).alias(c) if c in bounds else F.col(f"`{c}`") for c in grid.columns))


#: side, entry price, bars held, bars left of the cooldown
FLAT = (0, 0.0, 0, 0)


def trade_step(p: Mapping, state: tuple[int, float, int, int], close: float, p_long: float, p_short: float, sigma: float) -> tuple[tuple, tuple]:
    """One bar of the trader's state machine with parameters p: the next state, and (action, reason, realized_r)."""
    side, entry, held, wait = state
    if side:
        held, gain = held + 1, side * (close / entry - 1)
        reason = "stop" if gain <= -p["stop"] * sigma else "target" if gain >= p["target"] * sigma else "max_hold" if held >= p["max_hold"] else "reverse" if side * (p_short - p_long) > p["margin"] else None
        return ((0, 0.0, 0, int(p["cooldown"])), ("close", reason, gain)) if reason else ((side, entry, held, 0), ("skip", "hold", None))
    if wait:
        return (0, 0.0, 0, wait - 1), ("skip", "cooldown", None)
    if max(p_long, p_short) >= p["take"] and abs(p_long - p_short) >= p["margin"]:
        side = 1 if p_long > p_short else -1
        return (side, close, 0, 0), ("open_long" if side > 0 else "open_short", "signal", None)
    return FLAT, ("skip", "flat", None)


def trade_decisions(bars: DataFrame, params: DataFrame) -> DataFrame:
    """
    bars: instrument, ts_ms, close, p_long, p_short, sigma. params: params_id, take, margin, stop, target, max_hold, cooldown (few
    rows, a stated grid). One state machine for each instrument and parameter set; one row for each bar.

    Checks while in a trade, in this order: stop, target, longest hold, reversal. A cooldown counts down before the trader is flat
    again, and the bar on which it ends is still skipped.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts_ms")
        p, state, out = pdf.iloc[0], FLAT, []
        for t, *row in zip(*(pdf[n].tolist() for n in ("ts_ms", "close", "p_long", "p_short", "sigma")), strict=True):
            state, done = trade_step(p, state, *row)
            out.append((key[0], key[1], t, *done))
        return pd.DataFrame(out, columns=["instrument", "params_id", "ts_ms", "action", "reason", "realized_r"])

    return bars.crossJoin(F.broadcast(params)).groupBy("instrument", "params_id").applyInPandas(run, "instrument string, params_id int, ts_ms long, action string, reason string, realized_r double")
