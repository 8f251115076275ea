"""Depth books from deltas, quotes repeated on a grid, ranks inside book rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bars import on_grid


def fold_book(deltas: DataFrame, step_ms: int, tie: list[str], levels: int = 20) -> DataFrame:
    """
    deltas: instrument, ts_ms, side (bid, ask), price, size (0 or less deletes). Books at every multiple of step_ms up to the last
    delta: instrument, ts_ms, bids, asks (best first, `levels` at most); only books with both sides (T32).
    A delta holds until the next for its price, so it is put into the books in between and no book is carried from row to row.
    """
    end = deltas.groupBy("instrument").agg(F.max("ts_ms").alias("_end"))
    key = Window.partitionBy("instrument", "side", "price").orderBy("ts_ms", *tie)
    rows = deltas.withColumn("_next", F.lead("ts_ms").over(key)).join(F.broadcast(end), "instrument")  # one row an instrument
    up = lambda t: t + F.pmod(-t, F.lit(step_ms))
    first, last = up(F.col("ts_ms")), F.coalesce(up(F.col("_next")) - step_ms, F.col("_end") - F.pmod("_end", F.lit(step_ms)))
    held = rows.where((F.col("size") > 0) & (first <= last)).withColumn("book_ms", F.explode(F.sequence(first, last, F.lit(step_ms))))
    best = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    rank = F.row_number().over(Window.partitionBy("instrument", "book_ms", "side").orderBy(best))
    top = held.withColumn("_rank", rank).where(F.col("_rank") <= levels)
    side = lambda s: F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("_rank", "price", "size")))), lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size")))
    books = top.groupBy("instrument", F.col("book_ms").alias("ts_ms")).agg(side("bid").alias("bids"), side("ask").alias("asks"))
    return books.where((F.size("bids") > 0) & (F.size("asks") > 0))


def sample_last(ticks: DataFrame, step_ms: int = 1000, tie: str = "event_id") -> DataFrame:
    """At every multiple of step_ms the newest quote at or before it."""
    at = (F.col("ts_ms") + F.pmod(-F.col("ts_ms"), F.lit(step_ms))).alias("step")
    order = F.struct("ts_ms", tie)
    last = ticks.groupBy("instrument", at).agg(F.max_by("bid", order).alias("bid"), F.max_by("ask", order).alias("ask")).withColumnRenamed("step", "ts_ms")
    return on_grid(last, step_ms, ["bid", "ask"])


def rank_row(row: Column) -> Column:
    """Each value's share of its row's ranks, ties averaged; 0.5 where all are 0."""
    order = F.sort_array(row)
    share = F.transform(row, lambda x: (F.array_position(order, x) + (F.size(F.filter(row, lambda y: y == x)) - 1) / 2) / F.size(row))
    return F.when(F.exists(row, lambda x: F.abs(x) > 1e-9), share).otherwise(F.transform(row, lambda x: F.lit(0.5)))


def rank_signed(row: Column) -> Column:
    """Ranks of negative values in (0, 0.5], of positive ones in (0.5, 1], and 0.5 for 0."""
    down, up = F.filter(row, lambda x: x < 0), F.filter(row, lambda x: x > 0)
    place = lambda x, part: (F.array_position(F.sort_array(part), x) + (F.size(F.filter(part, lambda y: y == x)) - 1) / 2) / F.size(part)
    return F.transform(row, lambda x: F.when(x < 0, 0.5 * place(x, down)).when(x > 0, 0.5 + 0.5 * place(x, up)).otherwise(0.5))
