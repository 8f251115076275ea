"""Queries on ticks and bars: quotes, resampling, windows, recurrences, as-of joins, labels, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import asof, bar_features, bars, labels, series_features, splits
from ..operators.rolling import Series, number_rows, with_lookback, without_lookback
from ..sinks import tables
from ..storage import kept
from .base import Plans, r6, s6

P = Plans()
B = A.BARS
NUM = B + ", b AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts_ms) AS rn FROM bars)"


@P.add(f"SELECT instrument, ts_ms, {s6('open', 'high', 'low', 'close', 'spread_bp_avg')}, n_ticks FROM bars", B)
def a1_ohlcv_bars(spark: SparkSession, d: str) -> DataFrame:
    return A.bars(spark, d).select("instrument", "ts_ms", *map(r6, ("open", "high", "low", "close", "spread_bp_avg")), "n_ticks")


GRID = """last AS (SELECT instrument, ts_ms - ts_ms % 600000 AS step, last(bid ORDER BY ts_ms, event_id) AS bid, last(ask ORDER BY ts_ms, event_id) AS ask, first(mid ORDER BY ts_ms, event_id) AS open, max(mid) AS high, min(mid) AS low,
last(mid ORDER BY ts_ms, event_id) AS close FROM ticks GROUP BY 1, 2), grid AS (SELECT instrument, unnest(range(min(step), max(step) + 600000, 600000)) AS ts_ms FROM last GROUP BY 1)"""


@P.add(f"SELECT g.instrument, g.ts_ms, round(bid, 9) AS bid, round(ask, 9) AS ask FROM grid g ASOF JOIN last l ON g.instrument = l.instrument AND g.ts_ms >= l.step", A.TICKS, GRID)
def a2_resample_last(spark: SparkSession, d: str) -> DataFrame:
    return bars.resample_last(A.ticks(spark, d), 600_000).select("instrument", "ts_ms", r6("bid", digits=9), r6("ask", digits=9))


@P.add(f"SELECT g.instrument, g.ts_ms, {s6('open', 'high', 'low', 'close')} FROM grid g ASOF JOIN last l ON g.instrument = l.instrument AND g.ts_ms >= l.step", A.TICKS, GRID)
def a3_resample_ohlc(spark: SparkSession, d: str) -> DataFrame:
    return bars.resample_ohlc(A.ticks(spark, d), 600_000).select("instrument", "ts_ms", *map(r6, ("open", "high", "low", "close")))


@P.add(
    f"SELECT event_id, instrument, {s6('mid', 'spread', 'spread_bp', 'log_return')} FROM (SELECT *, ask - bid AS spread, CASE WHEN mid > 0 THEN (ask - bid) / mid * 1e4 ELSE 0 END AS spread_bp, coalesce(ln(mid) - lag(ln(mid)) OVER (PARTITION BY instrument ORDER BY ts_ms, event_id), 0) AS log_return FROM ticks)",
    A.TICKS,
)
def p1_derive_quote(spark: SparkSession, d: str) -> DataFrame:
    rows, s = with_lookback(number_rows(A.ticks(spark, d), ["instrument"], tie=["event_id"]), 1), Series(["instrument"])
    log = F.log("mid")
    out = without_lookback(rows.withColumn("log_return", F.coalesce(log - s.lag(log), F.lit(0.0))))
    return out.withColumn("spread", F.col("ask") - F.col("bid")).withColumn("spread_bp", bars.spread_bp()).select("event_id", "instrument", r6("mid"), r6("spread"), r6("spread_bp"), r6("log_return"))


@P.add("SELECT event_id, instrument, ts_ms FROM ticks WHERE instrument IN ('click', 'purchase') AND ts_ms BETWEEN 1704153600000 AND 1705363200000", A.TICKS)
def p2_p3_p4_filters(spark: SparkSession, d: str) -> DataFrame:
    return A.ticks(spark, d).where(F.col("instrument").isin("click", "purchase") & F.col("ts_ms").between(1704153600000, 1705363200000)).select("event_id", "instrument", "ts_ms")


@P.add("SELECT event_id, status FROM (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 3 = 1 THEN 'tradeable' ELSE 'halted' END AS status FROM events) WHERE status IS NULL OR status = 'tradeable'")
def p5_tradeable(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("user_id") % 3 == 0, None).when(F.col("user_id") % 3 == 1, "tradeable").otherwise("halted")
    return A.table(spark, d, "events").select("event_id", status.alias("status")).where("status IS NULL OR status = 'tradeable'")


@P.add(f"SELECT instrument, ts_ms, {s6('close')} FROM b WHERE rn > 300", NUM)
def p7_warm_up(spark: SparkSession, d: str) -> DataFrame:
    return number_rows(A.bars(spark, d), ["instrument"]).where("rn > 300").select("instrument", "ts_ms", r6("close"))


@P.add(f"SELECT doc_id, {s6('p_long', 'p_short', 'p_take')} FROM (SELECT doc_id, p AS p_long, 1 - p AS p_short, greatest(p, 1 - p) AS p_take FROM (SELECT doc_id, least(greatest(p, 1e-9), 1 - 1e-9) AS p FROM classified))", A.CLASSIFIED)
def p11_probabilities(spark: SparkSession, d: str) -> DataFrame:
    p = F.least(F.greatest(F.col("p"), F.lit(1e-9)), F.lit(1 - 1e-9))
    return A.classified(spark, d).select("doc_id", r6(p, "p_long"), r6(1 - p, "p_short"), r6(F.greatest(p, 1 - p), "p_take"))


@P.add("SELECT c_custkey, CASE WHEN contains(c_mktsegment, 'I') OR c_mktsegment IN ('FURNITURE') THEN 'crypto' ELSE 'fx' END AS venue FROM customer")
def p13_venue(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("c_mktsegment")
    return A.table(spark, d, "customer").select("c_custkey", F.when(F.contains(s, F.lit("I")) | s.isin("FURNITURE"), "crypto").otherwise("fx").alias("venue"))


RET = "ln(greatest(close, 1e-12))"
WIN = (
    NUM
    + f""", r AS (SELECT *, coalesce({RET} - lag({RET}) OVER w, 0) AS r1, coalesce(lag(close) OVER w, close) AS prev FROM b WINDOW w AS (PARTITION BY instrument ORDER BY rn)),
t AS (SELECT *, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr FROM r)"""
)
_frame = lambda n: f"OVER (PARTITION BY instrument ORDER BY rn ROWS {n - 1} PRECEDING)"
_full = lambda n, x, other="0": f"CASE WHEN rn >= {n} THEN {x} ELSE {other} END"
_m20, _s20 = _full(20, f"avg(close) {_frame(20)}"), _full(20, f"stddev_samp(close) {_frame(20)}")
PRICE = {
    **{f"log_ret_{k}": f"coalesce({RET} - lag({RET}, {k}) OVER (PARTITION BY instrument ORDER BY rn), 0)" for k in (1, 5, 20, 60)},
    **{f"vol_{n}": _full(n, f"stddev_samp(r1) {_frame(n)}") for n in (30, 120, 300)},
    "spread_z": _full(120, f"CASE WHEN stddev_samp(spread_bp_avg) {_frame(120)} > 1e-12 THEN (spread_bp_avg - avg(spread_bp_avg) {_frame(120)}) / stddev_samp(spread_bp_avg) {_frame(120)} ELSE 0 END"),
    **{f"sma_dev_{n}": _full(n, f"close / (avg(close) {_frame(n)}) - 1") for n in (30, 120)},
    "bb_upper": f"(close - ({_m20} + 2 * {_s20})) / close",
    "bb_lower": f"(close - ({_m20} - 2 * {_s20})) / close",
    "atr_14": _full(14, f"avg(tr) {_frame(14)}"),
    "force": f"(close - prev) * n_ticks / greatest(avg(n_ticks) {_frame(60)}, 1.0)",
    "range_60": _full(60, f"((max(close) {_frame(60)}) - (min(close) {_frame(60)})) / close"),
    "drawdown_300": _full(300, f"close / (max(close) {_frame(300)}) - 1"),
    "log_ticks": "ln(1 + greatest(n_ticks, 0))",
}


@P.add("SELECT instrument, ts_ms, " + ", ".join(f"round({x}, 6) + 0.0 AS {n}" for n, x in PRICE.items()) + " FROM t", WIN)
def w1_w17_price_windows(spark: SparkSession, d: str) -> DataFrame:
    return bar_features.price_windows(A.bars(spark, d)).select("instrument", "ts_ms", *map(r6, PRICE))


@P.add(
    "SELECT instrument, ts_ms, CASE WHEN rn <= 20 THEN 0 WHEN close > hi THEN 1 WHEN close < lo THEN -1 ELSE 0 END AS breakout FROM (SELECT *, max(close) OVER w AS hi, min(close) OVER w AS lo FROM b WINDOW w AS (PARTITION BY instrument ORDER BY rn ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))",
    NUM,
)
def w20_donchian(spark: SparkSession, d: str) -> DataFrame:
    return bar_features.donchian(A.bars(spark, d)).select("instrument", "ts_ms", "breakout")


RECUR = """d AS (SELECT *, coalesce(close - lag(close) OVER w, 0) AS diff, coalesce(ln(close) - ln(lag(close) OVER w), 0) AS ret FROM b WINDOW w AS (PARTITION BY instrument ORDER BY rn)),
g AS (SELECT *, greatest(diff, 0.0) AS gain, greatest(-diff, 0.0) AS loss FROM d),
q AS (SELECT *, avg(gain) OVER w AS mg, avg(loss) OVER w AS ml FROM g WINDOW w AS (PARTITION BY instrument ORDER BY rn ROWS 13 PRECEDING)),
y AS (SELECT instrument, ts_ms, rn, 0.0::DOUBLE AS ag, 0.0::DOUBLE AS al, close AS e12, close AS e26, 0.0::DOUBLE AS v, close AS num, 1.0::DOUBLE AS den, 0.0::DOUBLE AS sig FROM q WHERE rn = 1 UNION ALL
SELECT q.instrument, q.ts_ms, q.rn, CASE WHEN q.rn < 15 THEN 0 WHEN q.rn = 15 THEN mg ELSE ag * 13 / 14 + gain / 14 END, CASE WHEN q.rn < 15 THEN 0 WHEN q.rn = 15 THEN ml ELSE al * 13 / 14 + loss / 14 END,
e12 * 11 / 13 + close * 2 / 13, e26 * 25 / 27 + close * 2 / 27, CASE WHEN q.rn = 2 THEN ret * ret ELSE 0.94 * v + 0.06 * ret * ret END, num * 11 / 13 + close, den * 11 / 13 + 1,
CASE WHEN q.rn = 2 THEN (e12 * 11 / 13 + close * 2 / 13) - (e26 * 25 / 27 + close * 2 / 27) ELSE 0.8 * sig + 0.2 * ((e12 * 11 / 13 + close * 2 / 13) - (e26 * 25 / 27 + close * 2 / 27)) END
FROM y JOIN q ON q.instrument = y.instrument AND q.rn = y.rn + 1)"""
RSI = "CASE WHEN rn < 15 THEN 0.5 WHEN al = 0 THEN 1 ELSE ag / (ag + al) END"


@P.add(f"SELECT instrument, ts_ms, round({RSI}, 6) + 0.0 AS rsi_14, round(e12, 6) AS ema_12, round(e26, 6) AS ema_26, round(e12 - e26, 6) + 0.0 AS macd, round(sig, 6) + 0.0 AS signal, round(e12 - e26 - sig, 6) + 0.0 AS macd_hist, round(sqrt(v), 6) + 0.0 AS ewma_vol, round(num / den, 6) AS ewm_adjusted FROM y", NUM, RECUR)
def w5_w12_w18_recurrences(spark: SparkSession, d: str) -> DataFrame:
    return bar_features.recurrences(A.bars(spark, d)).select("instrument", "ts_ms", *map(r6, ("rsi_14", "ema_12", "ema_26", "macd", "signal", "macd_hist", "ewma_vol", "ewm_adjusted")))


@P.add(None)
def w28_bar_features(spark: SparkSession, d: str) -> DataFrame:
    return bar_features.bar_features(A.bars(spark, d))


@P.add(f"SELECT instrument, ts_ms, {s6('close')} FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts_ms DESC) AS k FROM bars) WHERE k <= 50", B)
def t1_latest_n(spark: SparkSession, d: str) -> DataFrame:
    return bars.latest_n(A.bars(spark, d), 50, ["instrument"], ["ts_ms"]).select("instrument", "ts_ms", r6("close"))


@P.add("SELECT instrument, max(ts_ms) AS ts_ms, round(last(close ORDER BY ts_ms), 6) AS close FROM bars GROUP BY instrument", B)
def t2_latest_row(spark: SparkSession, d: str) -> DataFrame:
    return bars.latest_row(A.bars(spark, d).select("instrument", "ts_ms", "close"), ["instrument"], ["ts_ms"]).select("instrument", "ts_ms", r6("close"))


@P.add("SELECT instrument, count(*) AS n, count(*) FILTER (ts_ms >= cut) AS n_kept FROM bars JOIN (SELECT instrument, min(ts_ms) AS cut FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts_ms DESC) AS k FROM bars) WHERE k <= 100 GROUP BY 1) USING (instrument) GROUP BY 1", B)
def t3_retention_cap(spark: SparkSession, d: str) -> DataFrame:
    return bars.retention_split(A.bars(spark, d), 100, ["instrument"]).groupBy("instrument").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("long")).alias("n_kept"))


ODD = A.TICKS + ", rt AS (SELECT instrument, ts_ms, last(mid ORDER BY event_id) AS rmid FROM ticks WHERE user_id % 2 = 1 GROUP BY 1, 2), rf AS (SELECT instrument, ts_ms, first(mid ORDER BY event_id) AS rmid FROM ticks WHERE user_id % 2 = 1 GROUP BY 1, 2), le AS (SELECT * FROM ticks WHERE user_id % 2 = 0)"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = A.ticks(spark, d)
    return t.where("user_id % 2 = 0").select("instrument", "ts_ms", "event_id"), t.where("user_id % 2 = 1").select("instrument", "ts_ms", "event_id", F.col("mid").alias("rmid"))


@P.add(f"SELECT event_id, {s6('rmid')} FROM le ASOF LEFT JOIN rt ON le.instrument = rt.instrument AND le.ts_ms >= rt.ts_ms", ODD)
def j4_asof_backward(spark: SparkSession, d: str) -> DataFrame:
    left, right = _sides(spark, d)
    return asof.asof_join(left, right, ["instrument"], ["rmid"], tie=["event_id"]).select("event_id", r6("rmid"))


@P.add(f"SELECT event_id, {s6('rmid')} FROM (SELECT event_id, coalesce(rf.rmid, (SELECT last(rmid ORDER BY ts_ms) FROM rt WHERE rt.instrument = le.instrument)) AS rmid FROM le ASOF LEFT JOIN rf ON le.instrument = rf.instrument AND le.ts_ms <= rf.ts_ms)", ODD)
def j5_asof_forward(spark: SparkSession, d: str) -> DataFrame:
    left, right = _sides(spark, d)
    return asof.asof_join(left, right, ["instrument"], ["rmid"], "forward", tie=["event_id"], clamp=True).select("event_id", r6("rmid"))


@P.add(f"SELECT e.instrument, e.ts_ms, count(*) AS n, round(max(f.high), 6) AS hi FROM b e JOIN b f ON e.instrument = f.instrument AND f.rn > e.rn AND f.rn <= e.rn + 12 GROUP BY 1, 2", NUM)
def j6_forward_range(spark: SparkSession, d: str) -> DataFrame:
    rows = number_rows(A.bars(spark, d), ["instrument"]).select("instrument", "ts_ms", "high", "rn")
    return asof.forward_range(rows.drop("high"), rows, ["instrument"], 12).groupBy("instrument", "ts_ms").agg(F.count("*").alias("n"), r6(F.max("b_high"), "hi"))


@P.add("SELECT instrument, ts_ms, round(rmid, 6) AS odd_close, round(close, 6) AS close FROM bars JOIN (SELECT instrument, ts_ms - ts_ms % 3600000 + 3600000 AS ts_ms, last(mid ORDER BY ts_ms, event_id) AS rmid FROM ticks WHERE user_id % 2 = 1 GROUP BY 1, 2) USING (instrument, ts_ms)", B)
def j8_align(spark: SparkSession, d: str) -> DataFrame:
    odd = bars.ohlcv_bars(A.ticks(spark, d).where("user_id % 2 = 1"), A.HOUR).select("instrument", "ts_ms", r6("close", "odd_close"))
    return odd.join(A.bars(spark, d).select("instrument", "ts_ms", r6("close")), ["instrument", "ts_ms"])


BAR = """e AS (SELECT *, 0.007 AS sigma, close * (1 + 2 * 0.007) AS up, close * (1 - 1.5 * 0.007) AS dn FROM b),
m AS (SELECT e.instrument, e.rn, e.ts_ms, e.close, e.up, e.dn, f.rn AS frn, f.ts_ms AS fts, f.close AS fclose, CASE WHEN f.low <= e.dn THEN 'sl' WHEN f.high >= e.up THEN 'pt' END AS hit FROM e JOIN b f ON e.instrument = f.instrument AND f.rn > e.rn AND f.rn <= e.rn + 20),
k AS (SELECT instrument, rn, ts_ms, any_value(close) AS close, any_value(up) AS up, any_value(dn) AS dn, first(hit ORDER BY frn) FILTER (hit IS NOT NULL) AS h, first(fts ORDER BY frn) FILTER (hit IS NOT NULL) AS ht, last(fclose ORDER BY frn) AS vc, last(fts ORDER BY frn) AS vt FROM m GROUP BY 1, 2, 3),
lab AS (SELECT instrument, ts_ms, coalesce(ht, vt) AS t1_ms, coalesce(h, 'vert') AS barrier_hit, CASE h WHEN 'sl' THEN dn WHEN 'pt' THEN up ELSE vc END / close - 1 AS realized_r FROM k),
labels_ AS (SELECT *, CASE WHEN realized_r >= 0 THEN 1 ELSE -1 END AS side, CASE WHEN abs(realized_r) >= 0.001 THEN 1 ELSE 0 END AS meta_y FROM lab)"""


def _labels(spark: SparkSession, d: str) -> DataFrame:
    rows = number_rows(A.bars(spark, d), ["instrument"])
    return labels.triple_barrier(rows, rows.select("instrument", "rn", "ts_ms", "close").withColumn("sigma", F.lit(0.007)), 2, 1.5, 20, 0.001)


@P.add("SELECT instrument, ts_ms, t1_ms, barrier_hit, round(realized_r, 6) + 0.0 AS realized_r, side, meta_y FROM labels_", NUM, BAR)
def t4_triple_barrier(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("instrument", "ts_ms", "t1_ms", "barrier_hit", r6("realized_r"), "side", "meta_y")


@P.add("SELECT instrument, ts_ms, CASE WHEN side <> 0 AND side * realized_r > 0.005 THEN 1 ELSE 0 END AS y FROM labels_", NUM, BAR)
def t5_meta_label(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("instrument", "ts_ms", labels.meta_label(F.col("side"), F.col("realized_r"), 0.005).alias("y"))


ABLE = """able AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts_ms, t1_ms, realized_r) AS rn, count(*) OVER (PARTITION BY instrument) AS n, CAST(round((abs(realized_r) - 0.001) * 1e9) AS BIGINT) AS score FROM labels_ WHERE t1_ms - ts_ms >= 10000 AND abs(realized_r) > 0.001),
ways AS (SELECT *, greatest(n + 1 - (SELECT count(*) FROM able f WHERE f.instrument = a.instrument AND f.ts_ms >= a.t1_ms), rn + 1) AS nxt FROM able a),
worth AS (SELECT instrument, n + 1 AS rn, n, [0::BIGINT] AS best FROM able GROUP BY instrument, n UNION ALL
SELECT w.instrument, w.rn, w.n, list_append(best, greatest(best[-1], w.score + best[w.n + 2 - w.nxt])) FROM worth JOIN ways w ON w.instrument = worth.instrument AND w.rn = worth.rn - 1),
found AS (SELECT instrument, best FROM worth WHERE rn = 1),
path AS (SELECT instrument, 0::BIGINT AS rn, FALSE AS taken, 1::BIGINT AS nxt FROM found UNION ALL
SELECT w.instrument, w.rn, w.score + best[w.n + 2 - w.nxt] >= best[w.n + 1 - w.rn], CASE WHEN w.score + best[w.n + 2 - w.nxt] >= best[w.n + 1 - w.rn] THEN w.nxt ELSE w.rn + 1 END FROM path JOIN ways w ON w.instrument = path.instrument AND w.rn = path.nxt JOIN found ON found.instrument = path.instrument)"""


@P.add("SELECT instrument, ts_ms, t1_ms, round(realized_r, 6) + 0.0 AS realized_r FROM able JOIN path USING (instrument, rn) WHERE taken", NUM, BAR, ABLE)
def t6_select_labels(spark: SparkSession, d: str) -> DataFrame:
    return labels.select_labels(_labels(spark, d), cost=0.001).select("instrument", "ts_ms", "t1_ms", r6("realized_r"))


@P.add(
    """SELECT instrument, ts_ms, side FROM (SELECT *, row_number() OVER (PARTITION BY instrument, side >= 0 ORDER BY round(abs(realized_r), 12) DESC, ts_ms DESC) AS k FROM labels_) JOIN (SELECT instrument, CASE WHEN up > dn THEN 1 ELSE -1 END AS major, CASE WHEN least(up, dn) > 0 THEN greatest(floor(least(up, dn) / 0.45) - least(up, dn), 0) ELSE greatest(up, dn) END AS room
FROM (SELECT instrument, count(*) FILTER (side >= 0) AS up, count(*) FILTER (side < 0) AS dn FROM labels_ GROUP BY 1)) USING (instrument) WHERE side <> major OR k <= room""",
    NUM, BAR,
)
def t7_balance_minority(spark: SparkSession, d: str) -> DataFrame:
    rows = _labels(spark, d).withColumn("realized_r", F.round("realized_r", 12))
    return labels.balance_minority(rows, 0.45).select("instrument", "ts_ms", "side")


@P.add(None)
def t8_label_pipeline(spark: SparkSession, d: str) -> DataFrame:
    rows = number_rows(A.bars(spark, d), ["instrument"])
    sigma = bar_features.recurrences(A.bars(spark, d)).select("instrument", "ts_ms", F.col("ewma_vol").alias("sigma"))
    ret = bar_features.price_windows(A.bars(spark, d)).select("instrument", "ts_ms", F.col("log_ret_1").alias("ret"))
    inputs = kept(rows.join(sigma, ["instrument", "ts_ms"]).join(ret, ["instrument", "ts_ms"]))
    found = labels.label_pipeline(inputs, max_hold_ms=36 * 3_600_000)
    return found.select("instrument", "ts_ms", "t1_ms", "barrier_hit", r6("realized_r"), "side", "meta_y")


@P.add(None)
def w19_cusum_events(spark: SparkSession, d: str) -> DataFrame:
    rows = bar_features.recurrences(A.bars(spark, d)).select("instrument", "ts_ms", F.col("ewma_vol").alias("sigma"))
    r = bar_features.price_windows(A.bars(spark, d)).select("instrument", "ts_ms", F.col("log_ret_1").alias("ret"))
    return labels.cusum_events(rows.join(r, ["instrument", "ts_ms"]), 2.0).select("instrument", "ts_ms", "event_side")


SPLIT = NUM + ", x AS (SELECT instrument, ts_ms AS t0, ts_ms + 18000000 AS t1, rn, count(*) OVER (PARTITION BY instrument) AS n FROM b)"


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    return A.bars(spark, d).select("instrument", F.col("ts_ms").alias("t0"), (F.col("ts_ms") + 18_000_000).alias("t1"))


FOLDS = lambda k: f"f AS (SELECT *, CAST(least((rn - 1) // greatest(n // {k}, 1), {k - 1}) AS INTEGER) AS fold FROM x), g AS (SELECT instrument, fold, min(t0) AS lo, max(t1) AS hi, max(rn) AS last FROM f GROUP BY 1, 2)"


@P.add(
    "SELECT instrument, t0, split, role FROM (SELECT f.instrument, f.t0, g.fold AS split, CASE WHEN f.fold = g.fold THEN 'test' WHEN (t0 <= hi AND t1 >= lo) OR (rn > last AND rn <= last + round(n * 0.01)) THEN NULL ELSE 'train' END AS role FROM f JOIN g ON f.instrument = g.instrument) WHERE role IS NOT NULL",
    SPLIT, FOLDS(5),
)
def t9_purged_kfold(spark: SparkSession, d: str) -> DataFrame:
    return splits.purged_kfold(_intervals(spark, d), 5, 0.01, ["instrument"], []).select("instrument", "t0", "split", "role")


@P.add(
    """SELECT instrument, t0, CAST(split AS INTEGER) AS split, role FROM (SELECT f.instrument, f.t0, split, CASE WHEN f.fold IN (a, b) THEN 'test' WHEN bool_or(g.fold IN (a, b) AND ((t0 <= hi AND t1 >= lo) OR (rn > last AND rn <= last + round(n * 0.01)))) THEN NULL ELSE 'train' END AS role
FROM f JOIN g ON f.instrument = g.instrument, c GROUP BY f.instrument, f.t0, f.fold, split, a, b) WHERE role IS NOT NULL""",
    SPLIT, FOLDS(6), "c AS (SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS split FROM range(6) p(a), range(6) q(b) WHERE a < b)",
)
def t10_cpcv(spark: SparkSession, d: str) -> DataFrame:
    return splits.cpcv(_intervals(spark, d), 6, 2, 0.01, ["instrument"], []).select("instrument", "t0", "split", "role")


@P.add("SELECT instrument, t0, role FROM (SELECT *, CASE WHEN rn > floor(n * 0.8) THEN 'test' WHEN rn <= floor(n * 0.8) - 15 THEN 'train' END AS role FROM x) WHERE role IS NOT NULL", SPLIT)
def t11_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    return splits.walk_forward(_intervals(spark, d), 0.8, 15, ["instrument"], []).select("instrument", "t0", "role")


@P.add("SELECT instrument, ts_ms, chunk FROM (SELECT instrument, ts_ms, rn - 1 AS i, n, unnest(range(greatest(0, (rn - 1 - 200 + 50) // 50), (rn - 1) // 50 + 1)) AS chunk FROM (SELECT *, count(*) OVER (PARTITION BY instrument) AS n FROM b)) WHERE chunk * 50 <= i AND i < chunk * 50 + 200 AND chunk * 50 + 200 <= n", NUM)
def t12_sliding_chunks(spark: SparkSession, d: str) -> DataFrame:
    size, step = 200, 50
    rows = number_rows(A.bars(spark, d), ["instrument"]).withColumn("i", F.col("rn") - 1)
    rows = rows.join(F.broadcast(rows.groupBy("instrument").agg(F.count("*").alias("n"))), "instrument")
    lo = F.greatest(F.lit(0), F.floor((F.col("i") - size + step) / step))
    rows = rows.withColumn("chunk", F.explode(F.sequence(lo, F.floor(F.col("i") / step))))
    return rows.where((F.col("chunk") * step <= F.col("i")) & (F.col("i") < F.col("chunk") * step + size) & (F.col("chunk") * step + size <= F.col("n"))).select("instrument", "ts_ms", "chunk")


@P.add("SELECT instrument, round(corr(x, y), 6) AS corr FROM (SELECT instrument, close - open AS x, lead(close) OVER (PARTITION BY instrument ORDER BY ts_ms) - close AS y FROM bars) WHERE y IS NOT NULL GROUP BY 1", B)
def a31_next_change_correlation(spark: SparkSession, d: str) -> DataFrame:
    rows = labels.forward_change(A.bars(spark, d), 1, ["instrument"]).select("instrument", (F.col("close") - F.col("open")).alias("x"), (F.col("later") - F.col("close")).alias("y"))
    return rows.groupBy("instrument").agg(r6(F.corr("x", "y"), "corr"))


@P.add("SELECT instrument, ts_ms, round(r, 6) + 0.0 AS r, CASE WHEN r >= 0 THEN 1 ELSE 0 END AS y FROM (SELECT instrument, ts_ms, ln(lead(close, 5) OVER (PARTITION BY instrument ORDER BY ts_ms)) - ln(close) AS r FROM bars) WHERE r IS NOT NULL", B)
def w25_forward_return(spark: SparkSession, d: str) -> DataFrame:
    rows = labels.forward_change(A.bars(spark, d), 5, ["instrument"]).withColumn("r", F.log("later") - F.log("close"))
    return rows.select("instrument", "ts_ms", r6("r"), F.when(F.col("r") >= 0, 1).otherwise(0).alias("y"))


@P.add("SELECT g.ts_ms, round(ask, 9) AS purchase_ask, round(bid, 9) AS purchase_bid FROM grid g ASOF JOIN last l ON g.instrument = l.instrument AND g.ts_ms >= l.step WHERE g.instrument = 'purchase'", A.TICKS, GRID)
def p8_prefixed_columns(spark: SparkSession, d: str) -> DataFrame:
    quotes = bars.resample_last(A.ticks(spark, d), 600_000).select("instrument", "ts_ms", r6("bid", digits=9), r6("ask", digits=9))
    return series_features.prefixed(quotes, "purchase")


@P.add("SELECT o_orderkey AS trade_id, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS instrument, o_custkey AS model_id, CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS exit_reason FROM orders")
def p10_added_columns(spark: SparkSession, d: str) -> DataFrame:
    """Trades written before two columns were added, and after."""
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("trade_id"), F.col("o_custkey").alias("model_id"), F.col("o_orderpriority").alias("instrument"), F.col("o_orderstatus").alias("exit_reason"))
    return tables.evolved(o.where("trade_id % 2 = 0").select("trade_id", "model_id"), o.where("trade_id % 2 = 1"))
