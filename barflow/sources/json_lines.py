"""Records from JSON lines: quotes, crowd books, price frames; what can't be read goes to a side table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TICK_JSON = "kind string, ts string, instrument string, source_time string, bid string, ask string, closeoutBid string, closeoutAsk string, status string, _corrupt string"
BOOK_LEVEL = "array<struct<price:string,longCountPercent:string,shortCountPercent:string>>"
BOOK_JSON = f"kind string, ts string, instrument string, buckets {BOOK_LEVEL}, data struct<buckets:{BOOK_LEVEL}>"
FRAME = "type string, instrument string, time string, bids array<struct<price:string>>, asks array<struct<price:string>>, closeoutBid string, closeoutAsk string, status string"


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", "true").json(path)


def _number(c: str):
    """Prices are strings; what isn't a number is null."""
    return F.col(c).try_cast("double")


def ticks_of(raw: DataFrame) -> DataFrame:
    """Event time is source_time, or ts where that is missing; rows without instrument or time are dropped."""
    at = F.unix_millis(F.coalesce(F.try_to_timestamp("source_time"), F.try_to_timestamp("ts")))
    out = raw.select("instrument", at.alias("ts_ms"), _number("bid").alias("bid"), _number("ask").alias("ask"), _number("closeoutBid").alias("closeout_bid"), _number("closeoutAsk").alias("closeout_ask"), "status")
    return out.where("instrument IS NOT NULL AND ts_ms IS NOT NULL").withColumn("mid", (F.col("bid") + F.col("ask")) / 2).withColumn("spread", F.col("ask") - F.col("bid"))


def read_ticks(spark: SparkSession, path: str) -> DataFrame:
    return ticks_of(_lines(spark, path, TICK_JSON))


def stream_ticks(spark: SparkSession, path: str, files_per_trigger: int = 1, kind: str | None = None) -> DataFrame:
    """The same records as a stream, file by file."""
    raw = spark.readStream.schema(TICK_JSON).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return ticks_of(raw if kind is None else raw.where(F.col("kind") == kind))


def split_errors(spark: SparkSession, path: str, length: int = 500) -> DataFrame:
    """source and the first `length` characters of each line that isn't JSON."""
    text = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("source"))
    return text.where((F.trim("value") != "") & F.try_parse_json("value").isNull()).select("source", F.substring("value", 1, length).alias("raw"))


def read_book_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Crowd books in either layout: instrument, ts_ms, buckets of price, long and short share; bad buckets are dropped."""
    raw = spark.read.schema(BOOK_JSON).option("recursiveFileLookup", "true").json(path)
    number = lambda x: x.try_cast("double")
    levels = F.transform(F.coalesce("data.buckets", "buckets"), lambda x: F.struct(number(x["price"]).alias("price"), number(x["longCountPercent"]).alias("long"), number(x["shortCountPercent"]).alias("short")))
    good = F.filter(levels, lambda x: x["price"].isNotNull() & x["long"].isNotNull() & x["short"].isNotNull())
    return raw.select("instrument", F.unix_millis(F.try_to_timestamp("ts")).alias("ts_ms"), good.alias("buckets")).where("instrument IS NOT NULL AND buckets IS NOT NULL")


def parse_price_frames(frames: DataFrame, value: str = "value") -> DataFrame:
    """Nested price frames to ticks; heartbeats are dropped."""
    f = frames.select(F.from_json(value, FRAME).alias("f")).select("f.*").where("type = 'PRICE'")
    price = lambda side: F.get(F.col(side), 0)["price"].try_cast("double")
    return f.select("instrument", F.unix_millis(F.try_to_timestamp("time")).alias("ts_ms"), price("bids").alias("bid"), price("asks").alias("ask"), _number("closeoutBid").alias("closeout_bid"), _number("closeoutAsk").alias("closeout_ask"), "status").where("bid IS NOT NULL AND ask IS NOT NULL").withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
