"""Feed frames in JSON text to rows: quotes, trades, book deltas, accounts, transactions; trade logs and archives."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIR = "array<struct<p:double,s:double>>"
ACCOUNT = "NAV string, balance string, unrealizedPL string, pl string, marginUsed string, marginAvailable string, marginRate string, openPositionCount long, openTradeCount long, pendingOrderCount long, currency string"
TRANSACTION = "id string, type string, time string, instrument string, units string, price string, pl string, reason string"
#: The tables that an archive may be read from.
ARCHIVED = ("price_ticks", "bars", "feature_vectors", "signals", "optimizer_trials", "trade_ledger")


def feed_items(frames: DataFrame, value: str = "value") -> DataFrame:
    """The items of frames that are arrays; text that isn't JSON, or no array, gives none. Control items are dropped."""
    f = F.col("f")  # a map, since T and t are different fields
    items = frames.select(F.explode(F.from_json(value, "array<map<string,string>>")).alias("f")).where(f["T"].isin("q", "t", "o"))
    numbers = [f[c].try_cast("double").alias(c) for c in ("bp", "ap", "p", "s")]
    items = items.select(f["T"].alias("kind"), f["S"].alias("instrument"), F.unix_millis(F.try_to_timestamp(f["t"])).alias("ts_ms"), *numbers, *(F.from_json(f[c], PAIR).alias(c) for c in "ab"))
    return items.where("instrument IS NOT NULL AND ts_ms IS NOT NULL")


def parse_quote_frames(frames: DataFrame, value: str = "value") -> DataFrame:
    """Quotes with both sides above 0; the spread is 0 at least."""
    q = feed_items(frames, value).where("kind = 'q' AND bp > 0 AND ap > 0")
    return q.select("instrument", "ts_ms", F.col("bp").alias("bid"), F.col("ap").alias("ask"), ((F.col("bp") + F.col("ap")) / 2).alias("mid"), F.greatest(F.col("ap") - F.col("bp"), F.lit(0.0)).alias("spread"), F.lit("tradeable").alias("status"))


def parse_trade_frames(frames: DataFrame, value: str = "value") -> DataFrame:
    t = feed_items(frames, value).where("kind = 't' AND p IS NOT NULL")
    return t.select("instrument", "ts_ms", F.col("p").alias("price"), F.coalesce("s", F.lit(0.0)).alias("size"))


def parse_book_deltas(frames: DataFrame, value: str = "value") -> DataFrame:
    """instrument, ts_ms, side, price, size: one row for each changed level, as fold_book() takes them."""
    o = feed_items(frames, value).where("kind = 'o'")
    side = lambda c, name: F.transform(F.coalesce(c, F.array().cast(PAIR)), lambda x: F.struct(F.lit(name).alias("side"), x["p"].alias("price"), x["s"].alias("size")))
    return o.select("instrument", "ts_ms", F.explode(F.concat(side(F.col("b"), "bid"), side(F.col("a"), "ask"))).alias("x")).select("instrument", "ts_ms", "x.*").where("price IS NOT NULL AND size IS NOT NULL")


def parse_account_frames(frames: DataFrame, value: str = "value") -> DataFrame:
    """Numbers are strings and 0 where they are missing or none; leverage is one over the margin rate, rounded."""
    f = frames.select(F.from_json(value, ACCOUNT).alias("f")).where("f IS NOT NULL").select("f.*")
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    count = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    rate = number("marginRate")
    return f.select(
        number("NAV").alias("nav"), number("balance").alias("balance"), number("unrealizedPL").alias("unrealized_pl"), number("pl").alias("realized_pl"), number("marginUsed").alias("margin_used"), number("marginAvailable").alias("margin_available"),
        count("openPositionCount").alias("open_positions"), count("openTradeCount").alias("open_trades"), count("pendingOrderCount").alias("pending_orders"), F.when(rate > 0, F.round(1 / rate)).otherwise(0.0).alias("leverage"), F.coalesce("currency", F.lit("USD")).alias("currency"),
    )


def parse_transactions(frames: DataFrame, value: str = "value") -> DataFrame:
    """Transactions with their raw text; what is missing or no number is null."""
    f = frames.select(F.from_json(value, TRANSACTION).alias("f"), F.col(value).alias("raw")).where("f.id IS NOT NULL OR f.type IS NOT NULL").select("f.*", "raw")
    number = lambda c: F.col(c).try_cast("double").alias(c)
    return f.select(F.coalesce("id", F.lit("")).alias("id"), F.unix_millis(F.try_to_timestamp("time")).alias("ts_ms"), F.col("type").alias("kind"), "instrument", number("units"), number("price"), number("pl"), "reason", "raw")


def read_trade_logs(spark: SparkSession, root: str, file: str, schema: str) -> DataFrame:
    """
    root/version/instrument/file as one table; version and instrument come from the path, an instrument in the record wins (S7). Trees
    that sinks.tables.write_trade_logs wrote, whose folders are named version=... and log=..., are read alike.
    """
    decoded = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))  # blanks and more are escaped in paths
    tail = F.substring_index("_metadata.file_path", "/", -3)
    rows = spark.read.schema(schema).json(f"{root}/*/*/{file}").select("*", *(decoded(F.split_part(tail, F.lit("/"), F.lit(i))).alias(c) for i, c in ((1, "version"), (2, "_from_path"))))
    written = F.col("version").startswith("version=") & F.col("_from_path").startswith("log=")
    value = lambda c, name: F.nullif(decoded(F.substring(c, len(name) + 2, 1 << 30)), F.lit("__HIVE_DEFAULT_PARTITION__"))
    rows = rows.withColumns({c: F.when(written, value(c, name)).otherwise(F.col(c)) for c, name in (("version", "version"), ("_from_path", "log"))})
    own = [F.col("instrument")] if "instrument" in rows.columns else []
    return rows.withColumn("instrument", F.coalesce(*own, F.col("_from_path"))).drop("_from_path")


def read_archive(spark: SparkSession, root: str, table: str, instrument: str, date: str) -> DataFrame:
    """One instrument's day of a table; only that partition is listed."""
    if table not in ARCHIVED:
        raise ValueError(f"no archive of {table!r}")
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", date):
        raise ValueError(f"not a date: {date!r}")
    name = instrument.replace("/", "_")
    return spark.read.parquet(f"{root}/{table}").where((F.col("instrument") == name) & (F.col("date") == F.to_date(F.lit(date))))
