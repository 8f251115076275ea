"""Feature vectors of ticks and of quotes on a fixed grid: windows over blocks of rows, recurrences by block scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import asof_join
from .rolling import Series, number_rows, sliding, with_lookback, without_lookback
from .scan import ordered_scan

BY = ["instrument"]
TINY = 1e-12
BOOK = ("ob_imbalance", "ob_weighted_mid_bp", "ob_bid_wall", "ob_ask_wall", "ob_size_10bp", "ob_size_50bp")


def ema_step(span: int, x: Column, first: Column) -> tuple[Column, Column]:
    """a and b of the recurrence of an EMA that starts from its first value."""
    alpha = 2 / (span + 1)
    return F.when(first, 0.0).otherwise(1 - alpha), F.when(first, x).otherwise(alpha * x)


def ewm_means(rows: DataFrame, spans: dict[str, tuple[str, int]]) -> DataFrame:
    """
    Bias-corrected exponential means (W13). spans: output column to input column and span. Weights start at a column's first value
    that isn't null; until then the mean is null.
    """
    cols, steps = {}, {}
    for name, (x, span) in spans.items():
        keep = F.lit(1 - 2 / (span + 1))
        cols |= {f"{name}_a": keep, f"{name}_n": F.coalesce(F.col(x), F.lit(0.0)), f"{name}_d": F.col(x).isNotNull().cast("double")}
        steps |= {f"{name}_num": (f"{name}_a", f"{name}_n"), f"{name}_den": (f"{name}_a", f"{name}_d")}
    done = ordered_scan(rows.withColumns(cols), steps, BY)
    means = {name: F.when(F.col(f"{name}_den") > 0, F.col(f"{name}_num") / F.col(f"{name}_den")) for name in spans}
    return done.withColumns(means).select(*rows.columns, *means)


def grid_windows(grid: DataFrame, frames: dict[str, int] | None = None) -> DataFrame:
    """
    grid: instrument, ts_ms, bid, ask on equal steps. For each time frame: volatility, RSI of simple means, mean, bands and their width,
    ATR of the highest ask less the lowest bid, and that over mid (W6, W8, W11). Windows start with one row; a deviation of one is null.
    """
    frames = frames or {"1m": 20, "5m": 100, "15m": 300}
    s, mid = Series(BY), F.col("mid")
    rows = grid.withColumn("mid", (F.col("bid") + F.col("ask")) / 2).withColumn("spread", F.col("ask") - F.col("bid")).withColumn("spread_bp", F.col("spread") / F.col("mid") * 1e4)
    rows = with_lookback(number_rows(rows, BY), 2 * max(frames.values()) + 1, by=BY)
    diff = mid - s.lag(mid)
    rows = rows.withColumns({"log_return": F.log(mid / s.lag(mid)), "gain": F.greatest(diff, F.lit(0.0)), "loss": F.greatest(-diff, F.lit(0.0)), "force": diff * F.col("spread")})
    rows = rows.withColumns({"gain": F.when(diff.isNotNull(), F.col("gain")), "loss": F.when(diff.isNotNull(), F.col("loss"))})
    wants = {f"{m}_{k}": v for k, n in frames.items() for m, v in (("_mean", ("mean", "mid", n)), ("_sd", ("sd_samp", "mid", n)), ("_up", ("mean", "gain", n)), ("_down", ("mean", "loss", n)), ("volatility", ("sd_samp", "log_return", n)), ("_high", ("max", "ask", n)), ("_low", ("min", "bid", n)), ("tr", ("minus", f"_high_{k}", f"_low_{k}")), ("atr", ("mean", f"tr_{k}", n)))}
    rows = without_lookback(sliding(rows, BY, wants))  # what follows is arithmetic
    out: dict[str, Column] = {}
    for k in frames:
        mean, sd, up, down = (F.col(f"{m}_{k}") for m in ("_mean", "_sd", "_up", "_down"))
        out |= {
            f"rsi_{k}": 100 - 100 / (1 + up / F.when(down != 0, down)), f"sma_{k}": mean, f"bb_upper_{k}": mean + 2 * sd, f"bb_lower_{k}": mean - 2 * sd,
            f"bb_width_{k}": 4 * sd / F.nullif(mean, F.lit(0.0)), f"natr_{k}": F.col(f"atr_{k}") / F.nullif(mid, F.lit(0.0)),
        }
    return rows.withColumns(out).drop("gain", "loss", *(f"{m}_{k}" for k in frames for m in ("tr", "_mean", "_sd", "_up", "_down", "_high", "_low")))


def grid_features(grid: DataFrame, frames: dict[str, int] | None = None, macd: tuple[int, int, int] = (240, 520, 180), force: int = 260, books: dict[str, DataFrame] | None = None) -> DataFrame:
    """
    grid_windows() with MACD, force index and its mean; books: prefix to (instrument, ts_ms, values) whose newest row before each step
    is added, 0 where there is none (W31).
    """
    rows = ewm_means(grid_windows(grid, frames), {"fast": ("mid", macd[0]), "slow": ("mid", macd[1]), "force_mean": ("force", force)})
    rows = ewm_means(rows.withColumn("macd", F.col("fast") - F.col("slow")).drop("fast", "slow"), {"macd_signal": ("macd", macd[2])})
    rows = rows.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    for prefix, book in (books or {}).items():
        values = [c for c in book.columns if c not in ("instrument", "ts_ms")]
        rows = asof_join(rows, book, BY, values).withColumns({f"{prefix}_{v}": F.coalesce(v, F.lit(0.0)) for v in values}).drop(*values)
    return rows.drop("rn")


def prefixed(features: DataFrame, instrument: str) -> DataFrame:
    """One instrument's columns under its name without "_"; bid and ask come last."""
    name = instrument.replace("_", "")
    last = [c for c in ("bid", "ask") if c in features.columns]
    rest = [c for c in dict.fromkeys(features.columns) if c not in ("instrument", "ts_ms", *last)]
    return features.where(F.col("instrument") == instrument).select("ts_ms", *(F.col(c).alias(f"{name}_{c}") for c in [*rest, *last]))


def tick_windows(ticks: DataFrame, tie: list[str], exact: bool = False) -> DataFrame:
    """
    ticks: instrument, ts_ms, bid, ask, mid. Adds rn and the windowed part of the tick vector (W9, W22-W24). The deviations over 300
    ticks are those over 60 scaled up and the spread's score is 0; exact=True takes both over 300 ticks.
    """
    s, mid = Series(BY), F.col("mid")
    rows = with_lookback(number_rows(ticks, BY, tie=tie), 362, by=BY)
    ret = lambda k: F.when((F.col("rn") > k) & (mid > 0) & (s.lag(mid, k) > 0), F.log(mid / s.lag(mid, k))).otherwise(0.0)
    rows = rows.withColumns({"log_ret_1": ret(1), "log_ret_10": ret(10), "log_ret_60": ret(60), "spread": F.col("ask") - F.col("bid")})
    safe = F.when(mid == 0, F.lit(2.220446049250313e-16)).otherwise(mid)
    wants = {"_v60": ("var_pop", "log_ret_1", 60), "_m60": ("mean", "mid", 60), "_m300": ("mean", "mid", 300), "_t60": ("min", "ts_ms", 60), "_high": ("max", "mid", 60), "_low": ("min", "mid", 60)}
    if exact:
        wants |= {"_v300": ("var_pop", "log_ret_1", 300), "_sd300": ("sd_pop", "mid", 300), "_ssd": ("sd_pop", "spread", 300), "_sm": ("mean", "spread", 300)}
    rows = sliding(rows, BY, wants)
    var60 = F.when(F.col("rn") > 60, F.col("_v60")).otherwise(0.0)
    long = F.when(F.col("rn") > 300, F.col("_v300")).otherwise(0.0) if exact else var60 * 5
    band = F.col("_sd300") if exact else F.sqrt(var60 * 5)
    rows = rows.withColumns({"realized_vol_60": F.sqrt(var60), "realized_vol_300": F.sqrt(long), "_band": band})
    zero = F.when(F.col("_ssd") > TINY, (F.col("spread") - F.col("_sm")) / F.col("_ssd")).otherwise(0.0) if exact else F.lit(0.0)
    span = (F.col("ts_ms") - F.col("_t60")) / 1000
    minute = F.pmod(F.col("ts_ms"), F.lit(3_600_000))
    theta = 2 * F.pi() * F.floor(minute / 1000) / 3600
    lower = F.col("_m300") - 2 * F.col("_band")
    rows = rows.withColumns({
        "spread_bp": F.when(F.abs(safe) > TINY, F.col("spread") / safe * 1e4).otherwise(0.0), "spread_z_300": zero, "sma60_dev": (mid - F.col("_m60")) / safe, "sma300_dev": (mid - F.col("_m300")) / safe,
        "bollinger_b": F.when(F.col("_band") > 0, (mid - lower) / (4 * F.col("_band"))).otherwise(0.5), "tick_velocity": F.when(span > 1e-9, F.least(F.col("rn"), F.lit(60)) / span).otherwise(0.0),
        "range60": F.when(F.col("rn") >= 60, (F.col("_high") - F.col("_low")) / safe).otherwise(0.0), "minute_sin": F.sin(theta), "minute_cos": F.cos(theta),
    })
    return without_lookback(rows).drop("_band", *wants)


def tick_features(ticks: DataFrame, tie: list[str], books: DataFrame | None = None, exact: bool = False, warm_up: int = 300) -> DataFrame:
    """
    The tick vector (W29), from the `warm_up`-th tick of an instrument on: tick_windows(), RSI 14, MACD 60/300/9, the mean spread, and
    six columns of the newest depth book (`books`: instrument, ts_ms and BOOK), 0 where there is none.
    """
    s, n = Series(BY), F.col("rn")
    rows = with_lookback(tick_windows(ticks, tie, exact), 16)
    diff = F.coalesce(F.col("mid") - s.lag(F.col("mid")), F.lit(0.0))
    rows = rows.withColumns({"gain": F.greatest(diff, F.lit(0.0)), "loss": F.greatest(-diff, F.lit(0.0))})
    cols: dict[str, Column] = {}
    for side in ("gain", "loss"):
        cols |= {f"{side}_a": F.when(n <= 15, 0.0).otherwise(13 / 14), f"{side}_b": F.when(n < 15, 0.0).when(n == 15, s.mean(F.col(side), 14)).otherwise(F.col(side) / 14)}
    for name, x, span in (("fast", "mid", 60), ("slow", "mid", 300), ("atr", "spread", 14)):
        cols[f"{name}_a"], cols[f"{name}_b"] = ema_step(span, F.col(x), n == 1)
    names = ["gain", "loss", "fast", "slow", "atr"]
    keep, _ = ema_step(9, F.lit(0.0), n == 1)  # the signal starts from the first MACD, which is 0
    cols |= {"sig_a": keep, "sig_b": F.lit(0.0), "sig_fast": F.when(n == 1, 1.0).otherwise(0.2), "sig_slow": -F.when(n == 1, 1.0).otherwise(0.2)}
    steps = {f"{x}_y": (f"{x}_a", f"{x}_b") for x in names} | {"signal": ("sig_a", "sig_b")}
    rows = ordered_scan(without_lookback(rows.withColumns(cols)), steps, BY, chained={"signal": {"fast_y": "sig_fast", "slow_y": "sig_slow"}})
    rows = rows.withColumn("macd", F.col("fast_y") - F.col("slow_y"))
    rsi = F.when(n < 15, 50.0).when(F.col("loss_y") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("gain_y") / F.col("loss_y")))
    rows = rows.where(n >= warm_up).withColumns({"rsi_14": rsi, "atr_14": F.col("atr_y"), "macd_gap": F.col("signal") - F.col("macd")})
    rows = rows.drop("gain", "loss", "sig_a", "sig_b", "sig_fast", "sig_slow", "signal", *(f"{x}_{k}" for x in names for k in "aby"))
    if books is None:
        return rows.withColumns({c: F.lit(0.0) for c in BOOK})
    return asof_join(rows, books, BY, list(BOOK)).fillna(0.0, list(BOOK))


def depth_features(book: DataFrame, mid: Column | None = None) -> DataFrame:
    """
    book: bids, asks (arrays of price and size, best first) and other columns; adds BOOK (A17): imbalance of the best sizes, mid
    weighted by the depth of ten levels less mid in basis points, largest over mean size of 20 levels, sizes within 10 and 50 points.
    """
    total = lambda arr, f: F.aggregate(arr, F.lit(0.0), lambda a, x: a + f(x))
    size, worth = (lambda x: x["size"]), (lambda x: x["price"] * x["size"])
    b, a = F.col("bids"), F.col("asks")
    mid = (F.get(b, 0)["price"] + F.get(a, 0)["price"]) / 2 if mid is None else mid
    top = F.get(b, 0)["size"], F.get(a, 0)["size"]
    ten = lambda f: total(F.slice(b, 1, 10), f) + total(F.slice(a, 1, 10), f)
    share = lambda x, y: F.coalesce(F.when(y > 0, x / y), F.lit(0.0))

    def wall(arr: Column) -> Column:
        first = F.slice(arr, 1, 20)
        return share(F.array_max(F.transform(first, size)) * F.size(first), total(first, size))

    near = lambda bp: total(F.filter(F.concat(b, a), lambda x: F.abs(x["price"] / mid - 1) * 1e4 <= bp), size)
    weighted = F.coalesce(F.when((ten(size) > 0) & (mid > 0), (ten(worth) / ten(size) - mid) / mid * 1e4), F.lit(0.0))
    return book.withColumns(dict(zip(BOOK, (share(top[0] - top[1], top[0] + top[1]), weighted, wall(b), wall(a), near(10), near(50)), strict=True)))


def momentum_features(ticks: DataFrame, tie: list[str], long: int = 60, short: int = 20, momentum: int = 10) -> DataFrame:
    """Log change over `momentum` and `long` ticks, deviation of one-tick changes, short less long mean in deviations, relative spread; from the `long`-th tick on."""
    s, mid = Series(BY), F.col("mid")
    rows = with_lookback(number_rows(ticks, BY, tie=tie), long + 1, by=BY)
    log = F.log(mid)
    rows = rows.withColumn("_step", log - s.lag(log))
    wants = {"_sd": ("sd_pop", "mid", long), "_short": ("mean", "mid", short), "_long": ("mean", "mid", long), "_vol": ("sd_pop", "_step", long - 1)}
    rows, sd = sliding(rows, BY, wants), F.col("_sd")
    rows = rows.withColumns({
        "f_momentum": log - s.lag(log, momentum - 1), "f_vol": F.col("_vol"), "f_trend": F.when(sd > 0, (F.col("_short") - F.col("_long")) / sd).otherwise(0.0),
        "f_spread": F.when(mid > 0, (F.col("ask") - F.col("bid")) / mid).otherwise(0.0), "f_long": log - s.lag(log, long - 1),
    })
    return without_lookback(rows.drop("_step", *wants)).where(F.col("rn") >= long)
