"""Bars as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bars import spread_bp


def bar_stream(ticks: DataFrame, interval: str = "10 seconds", late: str = "30 seconds") -> DataFrame:
    """
    ohlcv_bars() on a stream: a bar is emitted once the watermark has passed its end. Ticks go to the bar of their own time; those
    later than `late` behind the newest are dropped.
    """
    at = F.struct("ts_ms", "bid", "ask")
    timed = ticks.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", late)
    bars = timed.groupBy("instrument", F.window("at", interval).alias("w")).agg(F.min_by("mid", at).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", at).alias("close"), F.count("*").alias("n_ticks"), F.avg(spread_bp()).alias("spread_bp_avg"))
    return bars.select("instrument", F.unix_millis("w.end").alias("ts_ms"), "open", "high", "low", "close", "n_ticks", "spread_bp_avg")
