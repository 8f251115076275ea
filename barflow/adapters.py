"""The given tables seen as market data, in Spark and, for the oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.bars import ohlcv_bars

HOUR = 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instrument, ts_ms, event_id, user_id, mid, bid, ask from events: k of props is the spread in basis points."""
    e = table(spark, sf_dir, "events")
    mid, k = 100 + F.col("value") / 100, F.get_json_object("props", "$.k").cast("double")
    return e.select(F.col("event_type").alias("instrument"), millis(F.col("ts")).alias("ts_ms"), "event_id", "user_id", mid.alias("mid"), (mid * (1 - k / 20000)).alias("bid"), (mid * (1 + k / 20000)).alias("ask"))


TICKS = """ticks AS (SELECT event_type AS instrument, epoch_us(ts) // 1000 AS ts_ms, event_id, user_id, mid, mid * (1 - k / 20000) AS bid, mid * (1 + k / 20000) AS ask
FROM (SELECT *, 100 + value / 100 AS mid, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events))"""


def bars(spark: SparkSession, sf_dir: str, interval_ms: int = HOUR) -> DataFrame:
    return ohlcv_bars(ticks(spark, sf_dir), interval_ms)


BARS = (
    TICKS
    + f""", bars AS (SELECT instrument, ts_ms - ts_ms % {HOUR} + {HOUR} AS ts_ms, first(mid ORDER BY ts_ms, event_id) AS open, max(mid) AS high, min(mid) AS low,
last(mid ORDER BY ts_ms, event_id) AS close, count(*) AS n_ticks, avg(CASE WHEN mid > 0 THEN (ask - bid) / mid * 1e4 ELSE 0 END) AS spread_bp_avg FROM ticks GROUP BY instrument, ts_ms - ts_ms % {HOUR})"""
)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One closed trade for each order with lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trade_id")).agg(F.avg(F.col("l_discount") - F.col("l_tax")).alias("realized_r"))
    o = table(spark, sf_dir, "orders")
    side = F.when(F.col("o_totalprice") >= 250000, 1).otherwise(-1)
    out = o.select(F.col("o_orderkey").alias("trade_id"), F.col("o_orderpriority").alias("instrument"), millis(F.col("o_orderdate")).alias("ts_out_ms"), F.col("o_orderstatus").alias("exit_reason"), side.alias("side"), F.col("o_custkey").alias("model_id"))
    out = out.join(lines, "trade_id").withColumn("realized_r", F.round("realized_r", 9))
    return out.withColumn("entry_px", F.lit(100.0)).withColumn("exit_px", 100 * (1 + F.col("side") * F.col("realized_r"))).withColumn("qty", F.lit(1.0)).withColumn("fee", F.lit(0.01)).withColumn("slip", F.lit(0.005))


LEDGER = """ledger AS (SELECT o_orderkey AS trade_id, o_orderpriority AS instrument, epoch_us(o_orderdate) // 1000 AS ts_out_ms, o_orderstatus AS exit_reason, CASE WHEN o_totalprice >= 250000 THEN 1 ELSE -1 END AS side,
o_custkey AS model_id, r AS realized_r, 100.0 AS entry_px, 100 * (1 + CASE WHEN o_totalprice >= 250000 THEN 1 ELSE -1 END * r) AS exit_px, 1.0 AS qty, 0.01 AS fee, 0.005 AS slip
FROM orders JOIN (SELECT l_orderkey, round(avg(l_discount - l_tax), 9) AS r FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-sample figures of a model for each customer."""
    c = table(spark, sf_dir, "customer")
    x = F.col("c_acctbal")
    return c.select(F.col("c_custkey").alias("model_id"), F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").alias("run_id"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x + 1000) / 11000)), 6).alias("oos_auc"), F.round(F.abs(x) / 10000, 6).alias("oos_log_loss"), F.round(x / 5000, 6).alias("sortino"), F.round(F.abs(x) / 10, 3).alias("max_dd_bp"), (F.col("c_custkey") % 200).alias("n_trades"))


METRICS = """model_metrics AS (SELECT c_custkey AS model_id, c_mktsegment AS kind, c_nationkey AS run_id, round(least(1.0, greatest(0.0, (c_acctbal + 1000) / 11000)), 6) AS oos_auc,
round(abs(c_acctbal) / 10000, 6) AS oos_log_loss, round(c_acctbal / 5000, 6) AS sortino, round(abs(c_acctbal) / 10, 3) AS max_dd_bp, c_custkey % 200 AS n_trades FROM customer)"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optimizer trials, one for each supplier; five studies."""
    x = F.col("l_discount") - F.col("l_tax")
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("trial_id")).agg(F.round(F.avg(x) * 100, 6).alias("sortino"), F.round(F.max("l_tax") * 1e4 + F.avg("l_quantity"), 4).alias("max_dd_bp"), F.round(F.count("*") / 1000, 6).alias("turnover"), F.count("*").alias("n_trades"))
    return t.withColumn("study_id", F.concat(F.lit("study"), (F.col("trial_id") % 5).cast("string"))).withColumn("ts_ms", F.col("trial_id") * 1000).withColumn("pareto_rank", (F.col("trial_id") % 4).cast("int"))


TRIALS = """trials AS (SELECT l_suppkey AS trial_id, round(avg(l_discount - l_tax) * 100, 6) AS sortino, round(max(l_tax) * 1e4 + avg(l_quantity), 4) AS max_dd_bp, round(count(*) / 1000, 6) AS turnover, count(*) AS n_trades,
'study' || (l_suppkey % 5) AS study_id, l_suppkey * 1000 AS ts_ms, CAST(l_suppkey % 4 AS INTEGER) AS pareto_rank FROM lineitem GROUP BY l_suppkey)"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a label y and a score p."""
    d, y = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return y.join(d.select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").alias("y"), F.least(F.col("n_chars") / 20000, F.lit(1.0)).alias("p"), (F.col("doc_id") % 5).cast("int").alias("fold"))


CLASSIFIED = "classified AS (SELECT doc_id, quality AS y, least(n_chars / 20000, 1.0) AS p, CAST(doc_id % 5 AS INTEGER) AS fold FROM labels JOIN documents USING (doc_id))"


def depth_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, bids and asks: arrays of price and size, best first."""
    size = lambda lo: F.transform(F.slice("embedding", lo, 32), lambda x, i: F.struct((F.lit(100.0) + (-1 if lo == 1 else 1) * 0.01 * (i + 1)).alias("price"), F.abs(x.cast("double")).alias("size")))
    return table(spark, sf_dir, "embeddings").select("vec_id", size(1).alias("bids"), size(33).alias("asks"))


LEVELS = """levels AS (SELECT vec_id, i, CASE WHEN i <= 32 THEN 'bid' ELSE 'ask' END AS side, CASE WHEN i <= 32 THEN i ELSE i - 32 END AS lvl, abs(CAST(embedding[i] AS DOUBLE)) AS size,
CASE WHEN i <= 32 THEN 100.0 - 0.01 * i ELSE 100.0 + 0.01 * (i - 32) END AS price FROM embeddings, range(1, 65) t(i))"""


def crowd_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, ts_ms, buckets: price, long and short share."""
    b = F.transform("embedding", lambda x, i: F.struct((95 + 0.15 * (i + 1)).alias("price"), F.greatest(x.cast("double"), F.lit(0.0)).alias("long"), F.greatest(-x.cast("double"), F.lit(0.0)).alias("short")))
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") * 60_000).alias("ts_ms"), b.alias("buckets"))


CROWD = """crowd AS (SELECT vec_id, vec_id * 60000 AS ts_ms, 95 + 0.15 * i AS price, greatest(CAST(embedding[i] AS DOUBLE), 0.0) AS long, greatest(-CAST(embedding[i] AS DOUBLE), 0.0) AS short FROM embeddings, range(1, 65) t(i))"""


KINDS = ("click", "error", "purchase", "signup", "view")


def priced_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crowd's books as snapshots of the instruments over the time of the ticks: instrument, ts_ms (no two of an instrument equal), buckets."""
    n = F.col("vec_id")
    kind = F.element_at(F.array(*(F.lit(k) for k in KINDS)), (n % 5 + 1).cast("int"))
    return crowd_books(spark, sf_dir).select(kind.alias("instrument"), (F.lit(1704067200000) + n * 7_919_000 % 2_592_000_000).alias("ts_ms"), "buckets")


PRICED_BOOKS = CROWD + """, priced AS (SELECT ['click', 'error', 'purchase', 'signup', 'view'][vec_id % 5 + 1] AS instrument, 1704067200000 + vec_id * 7919000 % 2592000000 AS ts_ms, price, long, short FROM crowd)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as decisions of a trader."""
    kind = F.col("event_type")
    action = F.when(kind == "signup", "open_long").when(kind == "error", "open_short").when(kind == "purchase", "close").otherwise("skip")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("instrument"), millis(F.col("ts")).alias("ts_ms"), "event_id", action.alias("action"), kind.alias("reason"), (100 + F.col("value") / 100).alias("price"))


DECISIONS = """decisions AS (SELECT CAST(user_id AS VARCHAR) AS instrument, epoch_us(ts) // 1000 AS ts_ms, event_id, CASE event_type WHEN 'signup' THEN 'open_long' WHEN 'error' THEN 'open_short' WHEN 'purchase' THEN 'close' ELSE 'skip' END AS action,
event_type AS reason, 100 + value / 100 AS price FROM events)"""
