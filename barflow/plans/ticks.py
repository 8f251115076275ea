"""Queries on the tick and grid vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import bars, crowd, series_features as S
from ..storage import kept
from .base import Plans, r6
from .market import GRID
from .trades import RATIOS, crowd_rounded, crowd_sql

P = Plans()
STEP = 600_000
FRAMES = {"1m": 20, "5m": 100, "15m": 300}
QUOTES = """quotes AS (SELECT *, (bid + ask) / 2 AS mid, ask - bid AS spread, row_number() OVER (PARTITION BY instrument ORDER BY ts_ms) AS rn FROM (SELECT g.instrument, g.ts_ms, bid, ask FROM grid g ASOF JOIN last l ON g.instrument = l.instrument AND g.ts_ms >= l.step)),
dq AS (SELECT *, mid - lag(mid) OVER w AS diff, ln(mid / lag(mid) OVER w) AS lr FROM quotes WINDOW w AS (PARTITION BY instrument ORDER BY rn)),
tq AS (SELECT *, CASE WHEN diff IS NOT NULL THEN greatest(diff, 0.0) END AS gain, CASE WHEN diff IS NOT NULL THEN greatest(-diff, 0.0) END AS loss, """ + ", ".join(
    f"max(ask) OVER (PARTITION BY instrument ORDER BY rn ROWS {n - 1} PRECEDING) - min(bid) OVER (PARTITION BY instrument ORDER BY rn ROWS {n - 1} PRECEDING) AS tr_{k}" for k, n in FRAMES.items()
) + " FROM dq)"


def _frame(k: str, n: int) -> dict[str, str]:
    o = f"OVER (PARTITION BY instrument ORDER BY rn ROWS {n - 1} PRECEDING)"
    mean, sd = f"avg(mid) {o}", f"stddev_samp(mid) {o}"
    return {f"volatility_{k}": f"stddev_samp(lr) {o}", f"rsi_{k}": f"100 - 100 / (1 + avg(gain) {o} / nullif(avg(loss) {o}, 0))", f"sma_{k}": f"({mean}) / mid - 1", f"bb_upper_{k}": f"({mean} + 2 * {sd}) / mid - 1", f"bb_lower_{k}": f"({mean} - 2 * {sd}) / mid - 1", f"bb_width_{k}": f"4 * {sd} / ({mean})", f"atr_{k}": f"avg(tr_{k}) {o}", f"natr_{k}": f"avg(tr_{k}) {o} / mid"}


WINDOWS = {x: e for k, n in FRAMES.items() for x, e in _frame(k, n).items()}


@P.add("SELECT instrument, ts_ms, " + ", ".join(f"round({e}, 5) + 0.0 AS {x}" for x, e in WINDOWS.items()) + " FROM tq", A.TICKS, GRID, QUOTES)
def w6_w8_w11_grid_windows(spark: SparkSession, d: str) -> DataFrame:
    """Means and bands are given as parts of mid, since they have ties where they are rounded."""
    rows = S.grid_windows(bars.resample_last(A.ticks(spark, d), STEP), FRAMES)
    return rows.select("instrument", "ts_ms", *(r6(F.col(c) / F.col("mid") - 1 if c.startswith(("sma", "bb_upper", "bb_lower")) else F.col(c), c, 5) for c in WINDOWS))


def _ewm(x: str, span: int) -> str:
    """An exponential mean as two running sums of powers, which stay in a double's range for the rows there are."""
    g, o = f"pow({1 - 2 / (span + 1)}, -rn)", "OVER (PARTITION BY instrument ORDER BY rn ROWS UNBOUNDED PRECEDING)"
    return f"sum({x} * {g}) {o} / sum(CASE WHEN {x} IS NOT NULL THEN {g} END) {o}"


@P.add(
    "SELECT instrument, ts_ms, round(macd, 5) + 0.0 AS macd, round(sig, 5) + 0.0 AS macd_signal, round(macd - sig, 5) + 0.0 AS macd_hist, round(force, 5) + 0.0 AS force, round(fm, 5) + 0.0 AS force_mean FROM m2",
    A.TICKS, GRID, QUOTES, f"m1 AS (SELECT *, {_ewm('mid', 240)} - {_ewm('mid', 520)} AS macd, diff * spread AS force, {_ewm('diff * spread', 260)} AS fm FROM dq)", f"m2 AS (SELECT *, {_ewm('macd', 180)} AS sig FROM m1)",
)
def w13_w14_w15_w31_grid_features(spark: SparkSession, d: str) -> DataFrame:
    """The grid vector's recurrences; its windows are checked by w6_w8_w11_grid_windows."""
    return S.grid_features(bars.resample_last(A.ticks(spark, d), STEP), FRAMES).select("instrument", "ts_ms", *(r6(c, digits=5) for c in ("macd", "macd_signal", "macd_hist", "force", "force_mean")))


def _books(d: dict[str, str], name: str) -> str:
    values = ", ".join(f"{e} AS {c}" for c, e in d.items())
    return f"{name} AS (SELECT instrument, ts_ms, {values} FROM at_price GROUP BY 1, 2)"


#: The first price from a book's time on, or else the last one there is.
AT_PRICE = """ends AS (SELECT instrument, last(mid ORDER BY ts_ms) AS mid FROM quotes GROUP BY 1), stamps AS (SELECT DISTINCT instrument, ts_ms FROM priced),
now AS (SELECT s.instrument, s.ts_ms, coalesce(q.mid, e.mid) AS mid FROM stamps s JOIN ends e USING (instrument) ASOF LEFT JOIN quotes q ON s.instrument = q.instrument AND s.ts_ms <= q.ts_ms),
at_price AS (SELECT p.*, n.mid FROM priced p JOIN now n USING (instrument, ts_ms))"""
BOOK_SQL = ", ".join(f"round({f'ln(1 + coalesce({k}.{c}, 0))' if c in RATIOS else f'coalesce({k}.{c}, 0)'}, 6) + 0.0 AS {k}_{c}" for k in crowd.RANGES for c in crowd.CROWD)


@P.add(
    f"SELECT g.instrument, g.ts_ms, {BOOK_SQL} FROM quotes g ASOF LEFT JOIN ob ON g.instrument = ob.instrument AND g.ts_ms >= ob.ts_ms ASOF LEFT JOIN pb ON g.instrument = pb.instrument AND g.ts_ms >= pb.ts_ms",
    A.TICKS, GRID, QUOTES, A.PRICED_BOOKS, AT_PRICE, *(_books(crowd_sql("mid", *r), k) for k, r in crowd.RANGES.items()),
)
def a16_w31_grid_books(spark: SparkSession, d: str) -> DataFrame:
    """The grid vector's columns of the newest book of orders and of positions before each step."""
    grid, books = kept(bars.resample_last(A.ticks(spark, d), STEP)), A.priced_books(spark, d)
    priced = grid.withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    rows = S.grid_features(grid, FRAMES, books={k: crowd.crowd_series(books, priced, *r) for k, r in crowd.RANGES.items()})
    return rows.select("instrument", "ts_ms", *crowd_rounded(*(f"{k}_" for k in crowd.RANGES)))


@P.add(
    "SELECT instrument, ts_ms, CAST(least(ceil((price - mid * (1 - 0.05)) / (mid * 0.05 / 20)) - 1, 39) AS INTEGER) AS bin, round(sum(long - short), 6) + 0.0 AS net FROM (SELECT g.instrument, g.ts_ms, g.mid, b.ts_ms AS book_ms FROM quotes g ASOF JOIN (SELECT DISTINCT instrument, ts_ms FROM priced) b ON g.instrument = b.instrument AND g.ts_ms >= b.ts_ms) n JOIN (SELECT instrument, ts_ms AS book_ms, price, long, short FROM priced) USING (instrument, book_ms) WHERE price > mid * (1 - 0.05) AND price < mid * (1 + 0.05) GROUP BY 1, 2, 3",
    A.TICKS, GRID, QUOTES, A.PRICED_BOOKS,
)
def a18_liquidity_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Forty bins around the price of each step."""
    grid = bars.resample_last(A.ticks(spark, d), STEP).withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    return crowd.liquidity_matrix(A.priced_books(spark, d), grid, 20, 0.05).select("instrument", "ts_ms", "bin", r6("net"))


TN = "tn AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts_ms, event_id) AS rn FROM ticks), tr AS (SELECT *, CASE WHEN rn > 1 THEN ln(mid / lag(mid) OVER w) ELSE 0 END AS r1, ask - bid AS spread FROM tn WINDOW w AS (PARTITION BY instrument ORDER BY rn)), tv AS (SELECT *, CASE WHEN rn > 60 THEN var_pop(r1) OVER w60 ELSE 0 END AS v60, avg(mid) OVER w60 AS m60, avg(mid) OVER w300 AS m300, min(ts_ms) OVER w60 AS t60, max(mid) OVER w60 AS hi, min(mid) OVER w60 AS lo, ln(mid / lag(mid, 10) OVER w) AS r10, ln(mid / lag(mid, 60) OVER w) AS r60 FROM tr WINDOW w AS (PARTITION BY instrument ORDER BY rn), w60 AS (PARTITION BY instrument ORDER BY rn ROWS 59 PRECEDING), w300 AS (PARTITION BY instrument ORDER BY rn ROWS 299 PRECEDING))"
TICK = {
    "log_ret_1": "r1", "log_ret_10": "coalesce(r10, 0)", "log_ret_60": "coalesce(r60, 0)", "realized_vol_60": "sqrt(v60)", "realized_vol_300": "sqrt(5 * v60)", "spread_bp": "spread / mid * 1e4", "sma60_dev": "(mid - m60) / mid", "sma300_dev": "(mid - m300) / mid",
    "bollinger_b": "CASE WHEN v60 > 0 THEN (mid - m300 + 2 * sqrt(5 * v60)) / (4 * sqrt(5 * v60)) ELSE 0.5 END", "tick_velocity": "CASE WHEN ts_ms > t60 THEN least(rn, 60) / ((ts_ms - t60) / 1000) ELSE 0 END", "range60": "CASE WHEN rn >= 60 THEN (hi - lo) / mid ELSE 0 END",
    "minute_sin": "sin(2 * pi() * (ts_ms % 3600000 // 1000) / 3600)", "minute_cos": "cos(2 * pi() * (ts_ms % 3600000 // 1000) / 3600)",
}


@P.add("SELECT event_id, " + ", ".join(f"round({e}, 5) + 0.0 AS {x}" for x, e in TICK.items()) + " FROM tv", A.TICKS, TN)
def w9_w22_w23_w24_tick_windows(spark: SparkSession, d: str) -> DataFrame:
    return S.tick_windows(A.ticks(spark, d), ["event_id"]).select("event_id", *(r6(c, digits=5) for c in TICK))


TREC = """tg AS (SELECT *, greatest(coalesce(mid - lag(mid) OVER w, 0), 0.0) AS gain, greatest(-coalesce(mid - lag(mid) OVER w, 0), 0.0) AS loss FROM tr WINDOW w AS (PARTITION BY instrument ORDER BY rn)),
tm AS (SELECT *, avg(gain) OVER w AS mg, avg(loss) OVER w AS ml FROM tg WINDOW w AS (PARTITION BY instrument ORDER BY rn ROWS 13 PRECEDING)),
ty AS (SELECT instrument, event_id, rn, 0.0::DOUBLE AS ag, 0.0::DOUBLE AS al, mid AS ef, mid AS es, spread AS ea, 0.0::DOUBLE AS sg FROM tm WHERE rn = 1 UNION ALL
SELECT m.instrument, m.event_id, m.rn, CASE WHEN m.rn < 15 THEN 0 WHEN m.rn = 15 THEN mg ELSE ag * 13 / 14 + gain / 14 END, CASE WHEN m.rn < 15 THEN 0 WHEN m.rn = 15 THEN ml ELSE al * 13 / 14 + loss / 14 END, ef + (mid - ef) * 2 / 61, es + (mid - es) * 2 / 301, ea + (spread - ea) * 2 / 15,
0.8 * sg + 0.2 * ((ef + (mid - ef) * 2 / 61) - (es + (mid - es) * 2 / 301)) FROM ty JOIN tm m ON m.instrument = ty.instrument AND m.rn = ty.rn + 1)"""


@P.add("SELECT event_id, round(CASE WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END, 5) AS rsi_14, round(ea, 5) AS atr_14, round(ef - es, 5) + 0.0 AS macd, round(sg - (ef - es), 5) + 0.0 AS macd_gap FROM ty WHERE rn >= 300", A.TICKS, TN, TREC)
def w29_tick_features(spark: SparkSession, d: str) -> DataFrame:
    """The tick vector's recurrences; its windows are checked by w9_w22_w23_w24_tick_windows."""
    return S.tick_features(A.ticks(spark, d), ["event_id"]).select("event_id", *(r6(c, digits=5) for c in ("rsi_14", "atr_14", "macd", "macd_gap")))


@P.add(
    "SELECT event_id, round(ln(mid / m9), 6) + 0.0 AS f_momentum, round(vol, 6) AS f_vol, round(CASE WHEN sd > 0 THEN (m20 - m60) / sd ELSE 0 END, 5) + 0.0 AS f_trend, round(spread / mid, 6) AS f_spread, round(ln(mid / m59), 6) + 0.0 AS f_long FROM (SELECT *, lag(mid, 9) OVER w AS m9, lag(mid, 59) OVER w AS m59, stddev_pop(r1) OVER w59 AS vol, avg(mid) OVER w20 AS m20, avg(mid) OVER w60 AS m60, stddev_pop(mid) OVER w60 AS sd FROM tr WINDOW w AS (PARTITION BY instrument ORDER BY rn), w20 AS (PARTITION BY instrument ORDER BY rn ROWS 19 PRECEDING), w59 AS (PARTITION BY instrument ORDER BY rn ROWS 58 PRECEDING), w60 AS (PARTITION BY instrument ORDER BY rn ROWS 59 PRECEDING)) WHERE rn >= 60",
    A.TICKS, TN,
)
def w26_momentum_features(spark: SparkSession, d: str) -> DataFrame:
    rows = S.momentum_features(A.ticks(spark, d), ["event_id"])
    return rows.select("event_id", r6("f_momentum"), r6("f_vol"), r6("f_trend", digits=5), r6("f_spread"), r6("f_long"))
