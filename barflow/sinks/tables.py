"""Writing results: partitioned files, archives, idempotent upserts, exports and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import latest_n
from ..operators.ledger import rollup_columns
from ..storage import kept

DAY = 86_400_000


def hour_key(ts: str):
    return F.date_format(F.timestamp_millis(ts), "yyyyMMdd_HH")


def write_hourly_jsonl(df: DataFrame, path: str, kind: str = "kind", ts: str = "ts_ms", gzip: bool = True) -> None:
    """One set of files for each kind and UTC hour (K1). Rows of an hour are brought together first, large hours in several files."""
    out = df.withColumn("hour", hour_key(ts)).hint("rebalance", kind, "hour")
    out.write.mode("append").partitionBy(kind, "hour").option("compression", "gzip" if gzip else "none").json(path)


def archive_daily(df: DataFrame, root: str, table: str, keys: list[str], ts: str = "ts_ms") -> None:
    """
    Parquet by instrument and UTC day. Days that are there already are merged: their rows stay, and rows with the same keys are stored
    once (K2). Only the days that come are read and written.
    """
    spark, path = df.sparkSession, f"{root}/{table}"
    new = df.withColumn("date", F.date_format(F.timestamp_millis(ts), "yyyy-MM-dd"))
    if _exists(spark, path):
        old = spark.read.schema(new.schema).parquet(path).join(F.broadcast(new.select("instrument", "date").distinct()), ["instrument", "date"], "left_semi")  # one row a day and instrument
        new = kept(old.select(*new.columns).unionByName(new).dropDuplicates(["instrument", "date", *keys]))
    new.hint("rebalance", "instrument", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("instrument", "date").parquet(path)


def trades_for_export(ledger: DataFrame, metrics: DataFrame, start_ms: int, end_ms: int, limit: int, instrument: str | None = None, tie: list[str] | None = None, most: int = 10_000) -> DataFrame:
    """The newest `limit` trades of a time range, ends included, with the figures of their models; `most` where limit is larger, as a request limit (K3)."""
    rows = ledger.where(F.col("ts_out_ms").between(start_ms, end_ms))
    if instrument is not None:
        rows = rows.where(F.col("instrument") == instrument)
    newest = rows.orderBy(F.desc("ts_out_ms"), *(tie or [])).limit(max(0, min(limit, most)))
    return newest.join(metrics.select("model_id", "oos_auc", "oos_log_loss", "sortino"), "model_id", "left")


def export_trades(trades: DataFrame, path: str, fmt: str = "jsonl") -> None:
    if fmt not in ("jsonl", "parquet"):
        raise ValueError(f"unknown format {fmt!r}")
    (trades.write.mode("overwrite").parquet if fmt == "parquet" else trades.write.mode("overwrite").json)(path)


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` without the keys of `new`, and `new` (K4)."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def kept_first(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `new`, one for each key, whose keys `old` doesn't have (K5)."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*new.columns)


def evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of both; columns that only one has are null in the other (P10). Files of both kinds are read with Spark's mergeSchema."""
    return old.unionByName(new, allowMissingColumns=True)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the folder holds a finished table; asked of Spark's own reader, so that any file system will do."""
    try:
        return bool(spark.read.parquet(path).columns)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise


def write_preview(df: DataFrame, path: str, by: list[str], order: list[str], n: int = 2000) -> None:
    """Only the newest n rows of each key, as JSON lines (K6); all n, as a preview is asked for by a caller that knows its size."""
    latest_n(df, n, by, order, n).write.mode("overwrite").partitionBy(*by).json(path)


def chunked(numbered: DataFrame, counts: DataFrame, size: int = 1100, step: int = 100) -> DataFrame:
    """numbered: rn from 1; counts: instrument, n. Each row in every whole window of `size` rows that starts at a multiple of `step`."""
    i = F.col("rn") - 1
    rows = numbered.join(F.broadcast(counts), "instrument")  # one row an instrument
    low = F.greatest(F.lit(0), F.ceil((i - size + 1) / step))
    rows = rows.withColumn("_first", low).withColumn("_last", F.least(F.floor(i / step), F.floor((F.col("n") - size) / step))).where("_first <= _last AND n >= " + str(size))
    rows = rows.withColumn("start", F.explode(F.transform(F.sequence("_first", "_last"), lambda c: c * step)))
    return rows.withColumn("chunk", F.concat_ws("_", "start", F.col("start") + size, F.lit(size))).drop("_first", "_last", "n")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One folder of CSV for each window, its rows in order (K7)."""
    chunks.repartition("instrument", "chunk").sortWithinPartitions("instrument", "chunk", "rn").write.mode("overwrite").option("header", True).partitionBy("instrument", "chunk").csv(path)


def write_oof(df: DataFrame, path: str) -> None:
    """Out-of-fold rows by instrument and model version; a version that comes again replaces itself (K8)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("instrument", "model_version").parquet(path)


def write_trade_logs(trades: DataFrame, root: str, version: str = "version", log: str = "log") -> None:
    """JSON lines by version and log, the instrument whose log it is, all in one pass."""
    trades.withColumnsRenamed({version: "version", log: "log"}).write.partitionBy("version", "log").json(root)


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def summary_json(ledger: DataFrame) -> DataFrame:
    """name, value: a JSON object for each instrument and one, named portfolio, for all of them."""
    rows = ledger.rollup("instrument").agg(*rollup_columns())
    return rows.select(F.coalesce("instrument", F.lit("portfolio")).alias("name"), F.to_json(F.struct(*rows.columns)).alias("value"))


def write_summary_json(ledger: DataFrame, path: str) -> None:
    summary_json(ledger).write.mode("overwrite").partitionBy("name").text(path)


def retention_sweep(df: DataFrame, cap: int, root: str, table: str, keys: list[str], ts: str = "ts_ms") -> DataFrame:
    """Archives the rows beyond each instrument's newest `cap` and returns those that stay."""
    from ..operators.bars import retention_split

    split = kept(retention_split(df, cap, ["instrument"], ts))
    archive_daily(split.where("NOT kept").drop("kept"), root, table, keys, ts)
    return split.where("kept").drop("kept")

