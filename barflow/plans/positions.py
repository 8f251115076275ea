"""Queries on fills, positions, order intents and books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import books, positions as X
from ..operators.rolling import number_rows
from .base import Plans, r6

P = Plans()
FILLS = A.TICKS + ", fills AS (SELECT instrument, ts_ms, event_id, user_id % 7 - 3 AS units, mid AS price, row_number() OVER (PARTITION BY instrument ORDER BY ts_ms, event_id) AS rn FROM ticks WHERE user_id % 7 <> 3)"
HELD = """held AS (SELECT instrument, ts_ms, event_id, rn, units::DOUBLE AS net, price AS av, 0.0::DOUBLE AS gain FROM fills WHERE rn = 1 UNION ALL
SELECT f.instrument, f.ts_ms, f.event_id, f.rn, net + units, CASE WHEN net + units = 0 THEN 0 WHEN net = 0 OR sign(net) * sign(net + units) < 0 THEN price WHEN sign(net) = sign(units) THEN (av * net + price * units) / (net + units) ELSE av END,
CASE WHEN net <> 0 AND sign(net) <> sign(units) THEN least(abs(units), abs(net)) * sign(net) * (price - av) ELSE 0 END FROM held h JOIN fills f ON f.instrument = h.instrument AND f.rn = h.rn + 1)"""


def _fills(spark: SparkSession, d: str) -> DataFrame:
    return A.ticks(spark, d).select("instrument", "ts_ms", "event_id", (F.col("user_id") % 7 - 3).alias("units"), F.col("mid").alias("price"))


@P.add("SELECT h.event_id, net AS net_units, round(av / price - 1, 9) + 0.0 AS avg_price, round(gain / price, 9) + 0.0 AS realized FROM held h JOIN fills f ON f.event_id = h.event_id", FILLS, HELD)
def t21_positions(spark: SparkSession, d: str) -> DataFrame:
    """The average relative to the fill's price: quotients of prices have no ties where they are rounded."""
    return X.positions(_fills(spark, d), ["event_id"]).select("event_id", "net_units", r6(F.col("avg_price") / F.col("price") - 1, "avg_price", 9), r6(F.col("realized") / F.col("price"), "realized", 9))


@P.add("SELECT b.instrument, b.ts_ms, round(coalesce(net * (b.close - av), 0) / b.close, 7) + 0.0 AS unrealized FROM bars b ASOF LEFT JOIN (SELECT instrument, ts_ms, last(net ORDER BY rn) AS net, last(av ORDER BY rn) AS av FROM held GROUP BY 1, 2) h ON b.instrument = h.instrument AND b.ts_ms >= h.ts_ms", FILLS, A.BARS.removeprefix(A.TICKS + ", "), HELD)
def t22_a35_mark_to_market(spark: SparkSession, d: str) -> DataFrame:
    marks = A.bars(spark, d).select("instrument", "ts_ms", F.col("close").alias("mid"))
    return X.mark_to_market(marks, X.positions(_fills(spark, d), ["event_id"]), ["event_id"]).select("instrument", "ts_ms", r6(F.col("unrealized") / F.col("mid"), "unrealized", 7))


SIGNALS = """signals AS (SELECT instrument, ts_ms, event_id, CASE user_id % 3 WHEN 0 THEN 'long' WHEN 1 THEN 'short' ELSE 'flat' END AS direction, (event_id * 37 % 100) / 100 AS confidence, event_id % 7 - 3 AS net FROM ticks),
able AS (SELECT *, CASE direction WHEN 'long' THEN CASE WHEN net >= 3 THEN 0 WHEN net < 0 THEN 1 - net ELSE 1 END WHEN 'short' THEN CASE WHEN net <= -3 THEN 0 WHEN net > 0 THEN -net - 1 ELSE -1 END ELSE -net END AS delta FROM signals WHERE confidence >= 0.55),
kept AS (SELECT instrument, ts_ms, event_id, CASE WHEN abs(net + delta) > 3 THEN CAST(3 * sign(delta) - net AS BIGINT) ELSE delta END AS delta FROM able WHERE delta <> 0),
chosen AS (SELECT * FROM (SELECT instrument, ts_ms, event_id, delta FROM kept WHERE delta <> 0 QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY ts_ms, event_id) = 1) UNION ALL
SELECT * FROM (SELECT k.instrument, k.ts_ms, k.event_id, k.delta FROM chosen c JOIN kept k ON k.instrument = c.instrument AND k.delta <> 0 AND k.ts_ms >= c.ts_ms + 7200000 QUALIFY row_number() OVER (PARTITION BY k.instrument ORDER BY k.ts_ms, k.event_id) = 1))"""


@P.add("SELECT event_id, CAST(delta AS BIGINT) AS units_delta FROM chosen", A.TICKS, SIGNALS)
def t23_w21_order_intents(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id") % 3
    signals = A.ticks(spark, d).select("instrument", "ts_ms", "event_id", F.when(u == 0, "long").when(u == 1, "short").otherwise("flat").alias("direction"), ((F.col("event_id") * 37 % 100) / 100).alias("confidence"), (F.col("event_id") % 7 - 3).alias("net_units"))
    return X.order_intents(signals, ["event_id"], cooldown_ms=7_200_000).select("event_id", "units_delta")


MERGED = """numbered AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts_ms) AS rn FROM bars), found AS (SELECT instrument, rn FROM numbered WHERE close > open UNION SELECT instrument, rn FROM numbered WHERE n_ticks % 2 = 0),
spread_ AS (SELECT instrument, min(rn) AS rn FROM found GROUP BY 1 UNION ALL SELECT * FROM (SELECT s.instrument, f.rn FROM spread_ s JOIN found f ON f.instrument = s.instrument AND f.rn >= s.rn + 5 QUALIFY row_number() OVER (PARTITION BY f.instrument ORDER BY f.rn) = 1))"""


@P.add("SELECT instrument, rn FROM spread_", A.BARS, MERGED)
def w21_merged_events(spark: SparkSession, d: str) -> DataFrame:
    """Rising bars and bars with an even number of ticks, each bar once, five bars apart at least."""
    rows = number_rows(A.bars(spark, d), ["instrument"])
    return X.merged_events([rows.where("close > open"), rows.where("n_ticks % 2 = 0")], 5)


@P.add("SELECT instrument, n AS bars, round(least(n / 400, 1.0), 6) AS fraction, n >= 400 AS due FROM (SELECT b.instrument, count(*) FILTER (f.fired_ms IS NULL OR b.ts_ms > f.fired_ms) AS n FROM bars b LEFT JOIN (SELECT instrument, max(ts_ms) AS fired_ms FROM ticks WHERE user_id % 97 = 0 GROUP BY 1) f ON b.instrument = f.instrument GROUP BY 1)", A.BARS)
def t25_bars_since_retrain(spark: SparkSession, d: str) -> DataFrame:
    fired = A.ticks(spark, d).where("user_id % 97 = 0").select("instrument", F.col("ts_ms").alias("fired_ms"))
    return X.bars_since(A.bars(spark, d), fired, 400).select("instrument", "bars", r6("fraction"), "due")


DELTAS = A.TICKS + """, deltas AS (SELECT instrument, ts_ms, event_id, CASE WHEN user_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, CASE WHEN user_id % 2 = 0 THEN floor(mid) ELSE floor(mid) + 1 END AS price, user_id % 5 AS size FROM ticks),
spans AS (SELECT *, lead(ts_ms) OVER (PARTITION BY instrument, side, price ORDER BY ts_ms, event_id) AS nxt, max(ts_ms) OVER (PARTITION BY instrument) AS fin FROM deltas),
grid_ AS (SELECT instrument, unnest(range(((min(ts_ms) + 21599999) // 21600000) * 21600000, max(ts_ms) + 1, 21600000)) AS book_ms FROM deltas GROUP BY 1),
lv AS (SELECT g.instrument, book_ms, side, price, size, row_number() OVER (PARTITION BY g.instrument, book_ms, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END) AS k FROM grid_ g JOIN spans s ON s.instrument = g.instrument AND s.ts_ms <= book_ms AND (nxt IS NULL OR nxt > book_ms) WHERE size > 0)"""


@P.add("SELECT * FROM (SELECT instrument, book_ms AS ts_ms, count(*) FILTER (side = 'bid') AS n_bids, count(*) FILTER (side = 'ask') AS n_asks, max(price) FILTER (side = 'bid') AS best_bid, min(price) FILTER (side = 'ask') AS best_ask, CAST(sum(k * size) AS BIGINT) AS weight FROM lv WHERE k <= 20 GROUP BY 1, 2) WHERE n_bids > 0 AND n_asks > 0", DELTAS)
def t32_o6_fold_book(spark: SparkSession, d: str) -> DataFrame:
    bid = F.col("user_id") % 2 == 0
    deltas = A.ticks(spark, d).select("instrument", "ts_ms", "event_id", F.when(bid, "bid").otherwise("ask").alias("side"), (F.floor("mid") + F.when(bid, 0).otherwise(1)).cast("double").alias("price"), (F.col("user_id") % 5).alias("size"))
    b = books.fold_book(deltas, 21_600_000, ["event_id"])
    weight = lambda c: F.aggregate(F.transform(c, lambda x, i: (i + 1) * x["size"]), F.lit(0).cast("long"), lambda a, x: a + x)
    return b.select("instrument", "ts_ms", F.size("bids").cast("long").alias("n_bids"), F.size("asks").cast("long").alias("n_asks"), F.get("bids", 0)["price"].alias("best_bid"), F.get("asks", 0)["price"].alias("best_ask"), (weight("bids") + weight("asks")).alias("weight"))


@P.add("SELECT instrument, g.ts_ms, round(bid, 9) AS bid, round(ask, 9) AS ask FROM (SELECT instrument, unnest(range(lo, hi + 1, 300000)) AS ts_ms FROM (SELECT instrument, ((min(ts_ms) + 299999) // 300000) * 300000 AS lo, ((max(ts_ms) + 299999) // 300000) * 300000 AS hi FROM ticks GROUP BY 1)) g ASOF JOIN (SELECT instrument, ts_ms, last(bid ORDER BY event_id) AS bid, last(ask ORDER BY event_id) AS ask FROM ticks GROUP BY 1, 2) t USING (instrument, ts_ms)".replace("USING (instrument, ts_ms)", "ON g.instrument = t.instrument AND g.ts_ms >= t.ts_ms").replace("SELECT instrument, g.ts_ms,", "SELECT g.instrument, g.ts_ms,", 1), A.TICKS)
def t33_sampler(spark: SparkSession, d: str) -> DataFrame:
    return books.sample_last(A.ticks(spark, d), 300_000).select("instrument", "ts_ms", r6("bid", digits=9), r6("ask", digits=9))


RANKS = "x AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, len(embedding) + 1) t(i)), y AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY vec_id, v) - 1) / 2 AS r, count(*) OVER (PARTITION BY vec_id) AS n, count(*) FILTER (v < 0) OVER (PARTITION BY vec_id) AS neg, count(*) FILTER (v > 0) OVER (PARTITION BY vec_id) AS pos FROM x WINDOW w AS (PARTITION BY vec_id ORDER BY v))"


@P.add("SELECT vec_id, i, round(r / n, 6) AS share, round(CASE WHEN v < 0 THEN 0.5 * r / neg WHEN v > 0 THEN 0.5 + 0.5 * (r - (n - pos)) / pos ELSE 0.5 END, 6) AS signed_share FROM y", RANKS)
def w27_row_ranks(spark: SparkSession, d: str) -> DataFrame:
    row = F.transform("embedding", lambda x: x.cast("double"))
    rows = A.table(spark, d, "embeddings").select("vec_id", F.posexplode(F.arrays_zip(books.rank_row(row).alias("p"), books.rank_signed(row).alias("s"))).alias("i", "x"))
    return rows.select("vec_id", (F.col("i") + 1).cast("long").alias("i"), r6(F.col("x.p"), "share"), r6(F.col("x.s"), "signed_share"))
