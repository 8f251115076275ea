"""The bar-level feature vector: windows and recurrences over one instrument's bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rolling import Series, number_rows, sliding, with_lookback, without_lookback
from .scan import ordered_scan

BY = ["instrument"]
FLOOR = 1e-12


def price_windows(bars: DataFrame) -> DataFrame:
    """Log returns, rolling deviations, spread z-score, moving averages, bands, true range, range, drawdown, volume terms."""
    rows = with_lookback(number_rows(bars, BY), 301, by=BY)
    s, c = Series(BY), F.col("close")
    log = F.log(F.greatest(c, F.lit(FLOOR)))
    rows = rows.withColumn("r1", F.coalesce(log - s.lag(log), F.lit(0.0))).withColumn("prev", F.coalesce(s.lag(c), c))
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev")), F.abs(F.col("low") - F.col("prev")))
    rows = rows.withColumns({"_tr": tr, "_ticks": F.col("n_ticks").cast("double")} | {f"log_ret_{k}": F.coalesce(log - s.lag(log, k), F.lit(0.0)) for k in (1, 5, 20, 60)})
    wants = {f"_vol_{n}": ("sd_samp", "r1", n) for n in (30, 120, 300)} | {f"_mean_{n}": ("mean", "close", n) for n in (20, 30, 120)}
    wants |= {"_xsd": ("sd_samp", "spread_bp_avg", 120), "_xm": ("mean", "spread_bp_avg", 120), "_sd_20": ("sd_samp", "close", 20), "_atr": ("mean", "_tr", 14), "_volume": ("mean", "_ticks", 60)}
    wants |= {"_high_60": ("max", "close", 60), "_low_60": ("min", "close", 60), "_high_300": ("max", "close", 300)}
    rows = sliding(rows, BY, wants)
    out: dict[str, Column] = {f"vol_{n}": s.full(n, F.col(f"_vol_{n}")) for n in (30, 120, 300)}
    out["spread_z"] = s.full(120, F.when(F.col("_xsd") > FLOOR, (F.col("spread_bp_avg") - F.col("_xm")) / F.col("_xsd")).otherwise(0.0))
    out |= {f"sma_dev_{n}": s.full(n, c / F.col(f"_mean_{n}") - 1) for n in (30, 120)}
    mean, sd = s.full(20, F.col("_mean_20")), s.full(20, F.col("_sd_20"))
    out |= {"bb_upper": (c - (mean + 2 * sd)) / c, "bb_lower": (c - (mean - 2 * sd)) / c}  # 1 while warming up, as mean and sd are 0 then
    out |= {
        "atr_14": s.full(14, F.col("_atr")),
        "force": (c - F.col("prev")) * F.col("_ticks") / F.greatest(F.col("_volume"), F.lit(1.0)),
        "range_60": s.full(60, (F.col("_high_60") - F.col("_low_60")) / c),
        "drawdown_300": s.full(300, c / F.col("_high_300") - 1),
        "log_ticks": F.log1p(F.greatest(F.col("_ticks"), F.lit(0.0))),
    }
    minute = F.floor(F.pmod(F.col("ts_ms"), F.lit(3_600_000)) / 60_000)
    out |= {"minute_sin": F.sin(2 * F.pi() * minute / 60), "minute_cos": F.cos(2 * F.pi() * minute / 60)}
    return without_lookback(rows.withColumns(out)).drop("_tr", "_ticks", *wants)


def donchian(bars: DataFrame, lookback: int = 20) -> DataFrame:
    """1 where close is above the previous `lookback` closes, -1 below, else 0."""
    rows, s = with_lookback(number_rows(bars, BY), lookback + 1), Series(BY)
    before = s.w.rowsBetween(-lookback, -1)
    c = F.col("close")
    side = F.when(F.col("rn") <= lookback, 0).when(c > F.max("close").over(before), 1).when(c < F.min("close").over(before), -1).otherwise(0)
    return without_lookback(rows.withColumn("breakout", side))


def recurrences(bars: DataFrame, adjust_span: int = 12) -> DataFrame:
    """RSI 14 by Wilder in [0, 1], EMA 12 and 26, MACD with signal 9, EWMA volatility, and a bias-corrected mean."""
    rows, s = with_lookback(number_rows(bars, BY), 16), Series(BY)
    c = F.col("close")
    diff = F.coalesce(c - s.lag(c), F.lit(0.0))
    rows = rows.withColumn("diff", diff).withColumn("gain", F.greatest(F.col("diff"), F.lit(0.0))).withColumn("loss", F.greatest(-F.col("diff"), F.lit(0.0)))
    rows = rows.withColumn("ret", F.coalesce(F.log(c) - F.log(s.lag(c)), F.lit(0.0)))
    seed = lambda x: s.mean(F.col(x), 14)  # noqa: E731  the first mean is over rows 2 to 15
    first, n = F.col("rn") == 1, F.col("rn")
    step = lambda alpha, x: {"a": F.when(first, 0.0).otherwise(1 - alpha), "b": F.when(first, x).otherwise(alpha * x)}
    cols: dict[str, Column] = {}
    for side in ("gain", "loss"):
        cols[f"{side}_a"] = F.when(n <= 15, 0.0).otherwise(13 / 14)
        cols[f"{side}_b"] = F.when(n < 15, 0.0).when(n == 15, seed(side)).otherwise(F.col(side) / 14)
    for span in (12, 26):
        cols |= {f"ema{span}_{k}": v for k, v in step(2 / (span + 1), c).items()}
    cols |= {"var_a": F.when(n <= 2, 0.0).otherwise(0.94), "var_b": F.when(n == 1, 0.0).when(n == 2, F.col("ret") * F.col("ret")).otherwise(0.06 * F.col("ret") * F.col("ret"))}
    keep = 1 - 2 / (adjust_span + 1)
    cols |= {"num_a": F.lit(keep), "num_b": c, "den_a": F.lit(keep), "den_b": F.lit(1.0)}
    share = F.when(n == 1, 0.0).when(n == 2, 1.0).otherwise(0.2)
    cols |= {"sig_a": F.when(n <= 2, 0.0).otherwise(0.8), "sig_b": F.lit(0.0), "sig_12": share, "sig_26": -share}
    rows = without_lookback(rows.withColumns(cols)).select("instrument", "ts_ms", "rn", *cols)
    steps = {f"{x}_y": (f"{x}_a", f"{x}_b") for x in ("gain", "loss", "ema12", "ema26", "var", "num", "den")} | {"signal": ("sig_a", "sig_b")}
    done = ordered_scan(rows, steps, BY, chained={"signal": {"ema12_y": "sig_12", "ema26_y": "sig_26"}})
    done = done.withColumn("macd", F.col("ema12_y") - F.col("ema26_y"))
    rs = F.when(F.col("loss_y") == 0, 1.0).otherwise(F.col("gain_y") / (F.col("gain_y") + F.col("loss_y")))
    return done.select("instrument", "ts_ms", "rn", F.when(n < 15, 0.5).otherwise(rs).alias("rsi_14"), F.col("ema12_y").alias("ema_12"), F.col("ema26_y").alias("ema_26"), "macd", "signal", (F.col("macd") - F.col("signal")).alias("macd_hist"), F.sqrt("var_y").alias("ewma_vol"), (F.col("num_y") / F.col("den_y")).alias("ewm_adjusted"))


def bar_features(bars: DataFrame) -> DataFrame:
    """All features of a bar in one row."""
    a, b = price_windows(bars), recurrences(bars)
    return a.drop("rn", "r1", "prev").join(b.drop("rn"), ["instrument", "ts_ms"])
