"""Streams joined, fanned out, written once, and watched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..models.training import score
from ..sinks import versioned


def signal_stream(features: DataFrame, model: Model | None) -> DataFrame:
    """p_long, p_short and p_take of each closed bar; a fitted pipeline is applied to a stream as to a table."""
    p = F.col("p_long")
    return score(model, features, "p_long").withColumns({"p_short": 1 - p, "p_take": F.greatest(p, 1 - p)})


def bars_with_signals(bars: DataFrame, signals: DataFrame, late: str = "30 seconds") -> DataFrame:
    """Bars and the signals of their own time (R6, J10). Both sides have watermarks, so the join's state is bounded."""
    at = lambda df: df.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", late)
    return at(bars).join(at(signals), ["instrument", "ts_ms", "at"]).drop("at")


def once(rows: DataFrame, keys: list[str], ts: str = "ts_ms", late: str = "10 minutes") -> DataFrame:
    """Each key once, in a state that the watermark clears."""
    return rows.withColumn("at", F.timestamp_millis(ts)).withWatermark("at", late).dropDuplicatesWithinWatermark(keys).drop("at")


def fan_out(rows: DataFrame, routes: dict[str, str], checkpoint: str, kind: str = "kind") -> DataStreamWriter:
    """
    Each micro-batch's rows to the table of their kind (R13, X6). A batch that runs again after a failure replaces what it wrote
    before: its number is a partition.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for name, path in routes.items():
            batch.where(F.col(kind) == name).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def upsert(rows: DataFrame, path: str, keys: list[str], checkpoint: str, replace: bool = False) -> DataStreamWriter:
    """Micro-batches into a table by key: rows that are there already stay (replace: give way), so a batch may run twice."""
    put: Callable = versioned.replace_by_key if replace else versioned.insert_ignore

    def write(batch: DataFrame, _: int) -> None:
        put(batch, path, keys)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def rejection_alerts(decisions: DataFrame, most: int, window: str = "60 seconds", slide: str = "10 seconds", late: str = "10 seconds") -> DataFrame:
    """Sliding windows with over `most` rejections and their number."""
    at = decisions.where("action = 'skip'").withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", late)
    counts = at.groupBy("instrument", F.window("at", window, slide).alias("w")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > most).select("instrument", F.unix_millis("w.end").alias("end_ms"), "n")
