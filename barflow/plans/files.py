"""Round trips: the given tables written through the sinks to the shared folder and read again through the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters as A
from ..operators.rolling import number_rows
from ..sinks import tables as K, versioned as V
from ..sources import frames as F_, json_lines as S
from ..storage import kept, shared_path
from .base import Plans, r6

P = Plans()


def _iso(ms: str):
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


TICK_ROWS = "SELECT instrument, ts_ms, round(mid, 6) AS mid, round(ask - bid, 9) + 0.0 AS spread FROM ticks"


@P.add(TICK_ROWS, A.TICKS)
def s1_k1_hourly_tick_files(spark: SparkSession, d: str) -> DataFrame:
    path, text = shared_path(spark, "ticks"), lambda c: F.col(c).cast("string").alias(c)
    rows = A.ticks(spark, d).select(F.lit("tick").alias("kind"), "ts_ms", _iso("ts_ms").alias("ts"), "instrument", F.when(F.col("mid") > 100, _iso("ts_ms")).alias("source_time"), text("bid"), text("ask"))
    K.write_hourly_jsonl(rows, path)
    return S.read_ticks(spark, path).select("instrument", "ts_ms", r6("mid"), r6("spread", digits=9))


@P.add(TICK_ROWS, A.TICKS)
def s3_price_frames(spark: SparkSession, d: str) -> DataFrame:
    """Ticks as nested frames, a heartbeat with each."""
    side = lambda c: F.array(F.struct(F.col(c).cast("string").alias("price")))
    price = F.to_json(F.struct(F.lit("PRICE").alias("type"), "instrument", _iso("ts_ms").alias("time"), side("bid").alias("bids"), side("ask").alias("asks")))
    beat = F.to_json(F.struct(F.lit("HEARTBEAT").alias("type"), _iso("ts_ms").alias("time")))
    frames = A.ticks(spark, d).select(F.explode(F.array(price, beat)).alias("value"))
    return S.parse_price_frames(frames).select("instrument", "ts_ms", r6("mid"), r6(F.col("ask") - F.col("bid"), "spread", 9))


@P.add("SELECT CAST(vec_id AS VARCHAR) AS instrument, ts_ms, count(*) AS n, round(sum(long), 6) + 0.0 AS long_total, round(sum(short), 6) + 0.0 AS short_total FROM crowd GROUP BY 1, 2", A.CROWD)
def s2_book_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Crowd books as JSON lines with a bucket more that can't be read."""
    path = shared_path(spark, "books")
    text = F.transform("buckets", lambda x: F.struct(x["price"].cast("string").alias("price"), x["long"].cast("string").alias("longCountPercent"), x["short"].cast("string").alias("shortCountPercent")))
    bad = F.array(F.struct(F.lit("none").alias("price"), F.lit("1").alias("longCountPercent"), F.lit("1").alias("shortCountPercent")))
    A.crowd_books(spark, d).select(F.col("vec_id").cast("string").alias("instrument"), _iso("ts_ms").alias("ts"), F.concat(text, bad).alias("buckets")).write.json(path)
    total = lambda f: F.aggregate("buckets", F.lit(0.0), lambda a, x: a + x[f])
    return S.read_book_snapshots(spark, path).select("instrument", "ts_ms", F.size("buckets").cast("long").alias("n"), r6(total("long"), "long_total"), r6(total("short"), "short_total"))


def _feed(spark: SparkSession, d: str) -> DataFrame:
    """Ticks as frames of four items: a quote (each tenth without a bid, each seventh crossed), a trade, a change of a book, and a control item."""
    e, t = F.col("event_id"), _iso("ts_ms").alias("t")
    crossed = e % 7 == 0
    bid, ask = F.when(e % 10 == 0, 0.0).when(crossed, F.col("ask")).otherwise(F.col("bid")), F.when(crossed, F.col("bid")).otherwise(F.col("ask"))
    item = lambda kind, *c: F.to_json(F.struct(F.lit(kind).alias("T"), F.col("instrument").alias("S"), t, *c))
    level = lambda p, s: F.array(F.struct(F.col(p).alias("p"), s.cast("double").alias("s")))
    items = [item("q", bid.alias("bp"), ask.alias("ap")), item("t", F.col("mid").alias("p"), (e % 5).cast("double").alias("s")), item("o", level("bid", e % 3).alias("b"), level("ask", e % 4).alias("a")), F.lit('{"T":"success","msg":"connected"}')]
    return A.ticks(spark, d).select(F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]")).alias("value"))


CROSSED = "crossed AS (SELECT instrument, ts_ms, event_id, mid, CASE WHEN event_id % 7 = 0 THEN ask ELSE bid END AS bid, CASE WHEN event_id % 7 = 0 THEN bid ELSE ask END AS ask FROM ticks)"


@P.add("SELECT instrument, ts_ms, round(bid, 9) AS bid, round(ask, 9) AS ask, round((bid + ask) / 2, 6) AS mid, round(greatest(ask - bid, 0), 9) + 0.0 AS spread, 'tradeable' AS status FROM crossed WHERE event_id % 10 <> 0", A.TICKS, CROSSED)
def s4_quote_frames(spark: SparkSession, d: str) -> DataFrame:
    return F_.parse_quote_frames(_feed(spark, d)).select("instrument", "ts_ms", r6("bid", digits=9), r6("ask", digits=9), r6("mid"), r6("spread", digits=9), "status")


@P.add("SELECT instrument, ts_ms, round(mid, 9) AS price, CAST(event_id % 5 AS DOUBLE) AS size FROM ticks", A.TICKS)
def s4_trade_frames(spark: SparkSession, d: str) -> DataFrame:
    return F_.parse_trade_frames(_feed(spark, d)).select("instrument", "ts_ms", r6("price", digits=9), "size")


@P.add("SELECT instrument, ts_ms, 'bid' AS side, round(bid, 9) AS price, CAST(event_id % 3 AS DOUBLE) AS size FROM ticks UNION ALL SELECT instrument, ts_ms, 'ask', round(ask, 9), CAST(event_id % 4 AS DOUBLE) FROM ticks", A.TICKS)
def s4_book_deltas(spark: SparkSession, d: str) -> DataFrame:
    return F_.parse_book_deltas(_feed(spark, d)).select("instrument", "ts_ms", "side", r6("price", digits=9), "size")


ACCOUNT_ROWS = """SELECT CAST(c_acctbal AS DOUBLE) AS nav, CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE CAST(c_custkey AS DOUBLE) END AS balance, CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE CAST(c_custkey % 7 AS DOUBLE) END AS margin_used,
CAST(c_nationkey AS BIGINT) AS open_trades, CAST(0 AS BIGINT) AS pending_orders, CASE c_custkey % 4 WHEN 1 THEN 50.0 WHEN 2 THEN 30.0 ELSE 0.0 END AS leverage, CASE WHEN c_custkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency FROM customer"""


@P.add(ACCOUNT_ROWS)
def s5_account_frames(spark: SparkSession, d: str) -> DataFrame:
    """Customers as account frames, some without a balance, with a margin that is no number, or with margin rates of 0, of a word and none."""
    k, text = F.col("c_custkey"), lambda c: c.cast("string")
    frame = F.struct(
        text(F.col("c_acctbal")).alias("NAV"), F.when(k % 5 != 0, text(k)).alias("balance"), F.when(k % 3 == 0, "none").otherwise(text(k % 7)).alias("marginUsed"), F.col("c_nationkey").alias("openTradeCount"),
        F.when(k % 4 == 1, "0.02").when(k % 4 == 2, "0.0333").when(k % 8 == 3, "none").when(k % 8 == 7, "0").alias("marginRate"), F.when(k % 2 != 0, "EUR").alias("currency"),
    )
    frames = A.table(spark, d, "customer").select(F.to_json(frame).alias("value"))
    return F_.parse_account_frames(frames).select("nav", "balance", "margin_used", "open_trades", "pending_orders", "leverage", "currency")


@P.add("SELECT CAST(o_orderkey AS VARCHAR) AS id, epoch_us(o_orderdate) // 1000 AS ts_ms, 'ORDER_' || o_orderstatus AS kind, o_orderpriority AS instrument, CASE WHEN o_custkey % 3 > 0 THEN CAST(o_custkey AS DOUBLE) END AS units, CASE WHEN o_orderkey % 2 = 0 THEN round(CAST(o_totalprice AS DOUBLE), 6) END AS price, NULL::DOUBLE AS pl, CAST(o_orderkey AS VARCHAR) AS raw_id FROM orders")
def s6_transactions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as transactions, some without a price or with units that are no number; heartbeats that are neither are left out."""
    text = lambda c: F.col(c).cast("string")
    ms = A.millis(F.col("o_orderdate"))
    frame = F.struct(text("o_orderkey").alias("id"), F.concat(F.lit("ORDER_"), "o_orderstatus").alias("type"), F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("time"), F.col("o_orderpriority").alias("instrument"), F.when(F.col("o_custkey") % 3 == 0, "none").otherwise(text("o_custkey")).alias("units"), F.when(F.col("o_orderkey") % 2 == 0, text("o_totalprice")).alias("price"))
    rows = F_.parse_transactions(A.table(spark, d, "orders").select(F.explode(F.array(F.to_json(frame), F.lit('{"beat": 1}'))).alias("value")))
    return rows.select("id", "ts_ms", "kind", "instrument", "units", r6("price"), "pl", F.get_json_object("raw", "$.id").alias("raw_id"))


@P.add("SELECT trade_id, CASE WHEN trade_id % 50 = 0 THEN 'own' ELSE instrument END AS instrument, CASE WHEN side = 1 THEN 'v1.0.1' ELSE 'v1.0.0' END AS version, round(realized_r, 9) + 0.0 AS realized_r FROM ledger", A.LEDGER)
def s7_trade_logs(spark: SparkSession, d: str) -> DataFrame:
    """The ledger as a tree of versions and instruments; each fiftieth record names an instrument itself."""
    root, rows = shared_path(spark, "logs"), A.ledger(spark, d).withColumn("version", F.when(F.col("side") == 1, "v1.0.1").otherwise("v1.0.0"))
    K.write_trade_logs(rows.select("trade_id", F.when(F.col("trade_id") % 50 == 0, "own").alias("instrument"), "realized_r", "version", F.col("instrument").alias("log")), root)
    return F_.read_trade_logs(spark, root, "*.json", "trade_id long, instrument string, realized_r double").select("trade_id", "instrument", "version", r6("realized_r", digits=9))


@P.add("SELECT instrument, ts_ms, round(close, 6) AS close, n_ticks FROM bars WHERE instrument = (SELECT min(instrument) FROM bars) AND ts_ms // 86400000 = (SELECT max(ts_ms) // 86400000 FROM bars WHERE instrument = (SELECT min(instrument) FROM bars))", A.BARS)
def s8_archived_day(spark: SparkSession, d: str) -> DataFrame:
    """All bars archived, then the last day of the first instrument read, which is what the operator reads."""
    root, rows = shared_path(spark, "archive"), A.bars(spark, d)
    K.archive_daily(rows, root, "bars", [])
    days = spark.read.parquet(f"{root}/bars").groupBy("instrument").agg(F.max("date").cast("string").alias("date"))
    name, date = days.orderBy("instrument").first()
    return F_.read_archive(spark, root, "bars", name, date).select("instrument", "ts_ms", r6("close"), "n_ticks")


@P.add("SELECT instrument, ts_ms, event_id, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS date FROM ticks", A.TICKS)
def k2_daily_archive(spark: SparkSession, d: str) -> DataFrame:
    """Two batches that share the ticks with a mid price from 99 to 101; each tick is archived once."""
    root, rows = shared_path(spark, "archive"), A.ticks(spark, d).select("instrument", "ts_ms", "event_id", "mid")
    K.archive_daily(rows.where("mid <= 101"), root, "ticks", ["event_id"])
    K.archive_daily(rows.where("mid >= 99"), root, "ticks", ["event_id"])
    return spark.read.parquet(f"{root}/ticks").select("instrument", "ts_ms", "event_id", F.col("date").cast("string").alias("date"))


@P.add("SELECT model_id, run_id, round(CASE WHEN run_id < 10 THEN sortino + 1 ELSE sortino END, 6) + 0.0 AS sortino FROM model_metrics", A.METRICS)
def k4_k5_upserts(spark: SparkSession, d: str) -> DataFrame:
    """A table of the models with gains, then new figures of some runs by replacement, then all models, of which only unknown ones enter."""
    path, rows = shared_path(spark, "metrics"), A.model_metrics(spark, d).select("model_id", "run_id", "sortino")
    V.replace_by_key(rows.where("sortino >= 0"), path, ["model_id"], parts=8)
    V.replace_by_key(rows.where("run_id < 10").withColumn("sortino", F.col("sortino") + 1), path, ["model_id"])
    V.insert_ignore(rows, path, ["model_id"])
    return V.read_versioned(spark, path).select("model_id", "run_id", r6("sortino"))


@P.add("SELECT instrument, ts_ms, round(close, 6) AS close FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts_ms DESC) AS k FROM bars) WHERE k <= 100", A.BARS)
def k6_preview(spark: SparkSession, d: str) -> DataFrame:
    """The newest 100 bars of each instrument, which is what a preview is."""
    path = shared_path(spark, "preview")
    K.write_preview(A.bars(spark, d), path, ["instrument"], ["ts_ms"], 100)
    return spark.read.json(path).select("instrument", "ts_ms", r6("close"))


WINDOWED = "numbered AS (SELECT instrument, close, row_number() OVER (PARTITION BY instrument ORDER BY ts_ms) AS rn, count(*) OVER (PARTITION BY instrument) AS n FROM bars)"


@P.add("SELECT instrument, k * 24 || '_' || (k * 24 + 48) || '_48' AS chunk, rn, round(close, 6) AS close FROM (SELECT *, unnest(range(greatest(0, (rn - 25) // 24), (rn - 1) // 24 + 1)) AS k FROM numbered) WHERE rn <= k * 24 + 48 AND k * 24 + 48 <= n", A.BARS, WINDOWED)
def k7_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 48 bars, a new one every 24, as CSV and back."""
    path, rows = shared_path(spark, "chunks"), kept(number_rows(A.bars(spark, d), ["instrument"]).select("instrument", "rn", "close"))
    K.write_chunks(K.chunked(rows, rows.groupBy("instrument").agg(F.count("*").alias("n")), 48, 24), path)
    back = spark.read.option("header", True).schema("rn long, close double, start long, instrument string, chunk string").csv(path)
    return back.select("instrument", "chunk", "rn", r6("close"))


@P.add("SELECT doc_id, instrument, v AS model_version, round(CASE WHEN v = 'v2' THEN p / 2 WHEN instrument = 'fold0' THEN p + 1 ELSE p END, 6) AS p FROM (SELECT doc_id, 'fold' || fold AS instrument, p, unnest(['v1', 'v2']) AS v FROM classified)", A.CLASSIFIED)
def k8_oof(spark: SparkSession, d: str) -> DataFrame:
    """Scores of two versions; one key's first version is written again and replaces itself, and nothing else."""
    path, rows = shared_path(spark, "oof"), A.classified(spark, d).select("doc_id", F.concat(F.lit("fold"), F.col("fold")).alias("instrument"), "p")
    K.write_oof(rows.withColumn("model_version", F.lit("v1")), path)
    K.write_oof(rows.withColumn("p", F.col("p") / 2).withColumn("model_version", F.lit("v2")), path)
    K.write_oof(rows.where("instrument = 'fold0'").withColumn("p", F.col("p") + 1).withColumn("model_version", F.lit("v1")), path)
    return spark.read.parquet(path).select("doc_id", "instrument", "model_version", r6("p"))


@P.add("SELECT trade_id, instrument, ts_out_ms, realized_r + 0.0 AS realized_r FROM ledger", A.LEDGER)
def k9_append_ledger(spark: SparkSession, d: str) -> DataFrame:
    path, rows = shared_path(spark, "ledger"), A.ledger(spark, d)
    for side in (1, -1):
        K.append_ledger(rows.where(F.col("side") == side), path)
    return spark.read.parquet(path).select("trade_id", "instrument", "ts_out_ms", (F.col("realized_r") + F.lit(0.0)).alias("realized_r"))


@P.add("SELECT coalesce(instrument, 'portfolio') AS name, count(*) AS n_trades, round(sum(realized_r), 6) + 0.0 AS cum_r, max(ts_out_ms) AS last_ts FROM ledger GROUP BY GROUPING SETS ((instrument), ())", A.LEDGER)
def k10_summary_json(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "summary")
    K.write_summary_json(A.ledger(spark, d), path)
    rows = spark.read.text(path).select("name", F.from_json("value", "n_trades long, cum_r double, last_ts long").alias("x"))
    return rows.select("name", "x.n_trades", r6("x.cum_r", "cum_r"), "x.last_ts")
