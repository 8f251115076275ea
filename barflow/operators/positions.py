"""Positions from fills, their value, and which signals become orders."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import kept
from .asof import asof_join
from .rolling import Series, number_rows, running, with_lookback, without_lookback
from .scan import ordered_scan

BY = ["instrument"]


def positions(fills: DataFrame, tie: list[str]) -> DataFrame:
    """
    fills: instrument, ts_ms, units (signed), price and `tie`. Adds net_units, avg_price and realized after each fill (T21).
    Fills that add move the average price, fills that reduce realise, and one that crosses zero starts anew at its own price. Given
    the running units the average is a first-order recurrence, so long series are scanned by blocks.
    """
    rows = kept(number_rows(fills.where("units <> 0"), BY, tie=tie).withColumn("_units", F.col("units").cast("double")))
    rows = running(rows, BY, "ts_ms", tie, F.col("_units"), "sum", "net_units")
    now, u = F.col("net_units"), F.col("_units")
    before = now - u
    fresh = (before == 0) | (F.signum(before) * F.signum(now) < 0)
    adds = F.signum(before) == F.signum(u)
    flat = F.lit(0.0)
    rows = rows.withColumns({
        "_a": F.when(fresh | (now == 0), flat).when(adds, before / now).otherwise(1.0),
        "_b": F.when(now == 0, flat).when(fresh, F.col("price")).when(adds, F.col("price") * u / now).otherwise(flat),
        "_closed": F.when(~adds & (before != 0), F.least(F.abs(u), F.abs(before)) * F.signum(before)).otherwise(flat),
    })
    rows = ordered_scan(rows, {"avg_price": ("_a", "_b")}, BY)
    rows, s = with_lookback(rows, 1), Series(BY)
    gain = F.when(F.col("_closed") != 0, F.col("_closed") * (F.col("price") - s.lag(F.col("avg_price")))).otherwise(0.0)
    return without_lookback(rows.withColumn("realized", gain)).drop("_a", "_b", "_closed", "_units")


def mark_to_market(marks: DataFrame, held: DataFrame, tie: list[str]) -> DataFrame:
    """marks: instrument, ts_ms, mid. Adds the newest position before each mark and its unrealised gain."""
    out = asof_join(marks, held, BY, ["net_units", "avg_price"], tie=tie)
    return out.withColumn("unrealized", F.coalesce(F.col("net_units") * (F.col("mid") - F.col("avg_price")), F.lit(0.0)))


def drift_bp(estimate: Column, actual: Column) -> Column:
    return F.when(actual != 0, (estimate - actual) / actual * 1e4).otherwise(0.0)


def unit_delta(action: Column, units: Column | float, position: Column) -> Column:
    """Signed change of units that an action asks for."""
    u = units if isinstance(units, Column) else F.lit(units)
    return F.when(action == "open_long", u).when(action == "open_short", -u).when(action == "close", -position).otherwise(0)


#: Rows of a task's block of events, and blocks that make one of the next level.
EVENTS, FAN = 1 << 16, 16


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's rows, each with where its chain of pointers leaves the block, found by doubling; -1 is the end."""
    pdf = pdf.sort_values("_rn")
    rn, to = pdf["_rn"].to_numpy(), pdf["_to"].to_numpy()
    hop = np.where((to >= 0) & (to <= rn[-1]), np.searchsorted(rn, to), np.arange(len(rn)))
    while not np.array_equal(further := hop[hop], hop):
        hop = further
    return pdf.assign(_to=to[hop])


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a block's rows those that the chain meets which enters at _entry."""
    pdf = pdf.sort_values("_rn")
    rn, to = pdf["_rn"].to_numpy(), pdf["_to"].to_numpy()
    hop, i, met = np.where((to >= 0) & (to <= rn[-1]), np.searchsorted(rn, to), -1).tolist(), int(np.searchsorted(rn, pdf["_entry"].iloc[0])), []
    while i >= 0:
        met.append(i)
        i = hop[i]
    return pdf.iloc[met].drop(columns=["_to", "_block", "_entry"])


def chained(links: DataFrame, by: list[str], length: int, block: int = EVENTS) -> DataFrame:
    """
    links: by, _rn, and _to, a later row or -1. The rows (by, _rn) that the chain of pointers from row 1 meets; `length` is the greatest _rn.

    Pointers are followed inside blocks of rows, to where they leave the block; only rows at which some pointer enters a block go on to
    the next level, whose blocks span FAN times as many. From the top the one chain is then marked downwards.
    """
    levels = []
    at = lambda size: F.floor((F.col("_rn") - 1) / size).alias("_block")
    while block < length:
        levels.append((links, block))
        cut = links.select("*", at(block))
        exits = kept(cut.groupBy(*by, "_block").applyInPandas(_exits, cut.schema).drop("_block"))
        entries = exits.where("_to >= 0").select(*by, F.col("_to").alias("_rn")).unionByName(exits.where("_rn = 1").select(*by, "_rn")).distinct()
        links, block = kept(exits.join(entries, [*by, "_rn"], "left_semi").select(*links.columns)), block * FAN
    taken = links.where("_rn = 1").select(*by, "_rn")
    for links, size in [*reversed([*levels, (links, block)])]:
        entered = taken.select(*by, at(size), "_rn").groupBy(*by, "_block").agg(F.min("_rn").alias("_entry"))
        cut = links.select("*", at(size)).join(entered, [*by, "_block"]).select(*by, "_rn", "_to", "_block", "_entry")
        taken = kept(cut.groupBy(*by, "_block").applyInPandas(_chain, links.select(*by, "_rn").schema))
    return taken


def spaced(events: DataFrame, gap_ms: int, tie: list[str], by: list[str] | None = None, ts: str = "ts_ms", slice_ms: int = 86_400_000, block: int = EVENTS) -> DataFrame:
    """
    Of each key's events, the first, and then always the next that is at least gap_ms after the last one taken (W21, T23).

    Each event points at the first that is late enough after it; the chain of pointers from the first event is followed. A task holds a block's rows, on further levels the
    entries of FAN blocks, which are few unless the gap spans whole blocks. Events without a key or a time take no part; a gap of 0 keeps all.
    """
    by = by or BY
    if gap_ms <= 0:
        return events
    rows = kept(number_rows(events.where(F.col(ts).isNotNull()), by, ts, tie, slice_ms, "_rn"))
    later = rows.select(*by, "_rn", (F.col(ts) + gap_ms).alias(ts))
    links = kept(asof_join(later, rows.select(*by, ts, F.col("_rn").alias("_to")), by, ["_to"], "forward", ts, ["_to"], slice_ms=slice_ms).select(*by, "_rn", F.coalesce("_to", F.lit(-1).cast("long")).alias("_to")))
    taken = chained(links, by, links.agg(F.max("_rn")).first()[0] or 0, block)
    return rows.join(taken, [*by, "_rn"], "left_semi").select(*events.columns)


def merged_events(filters: list[DataFrame], gap: int, by: list[str] | None = None, at: str = "rn") -> DataFrame:
    """The events (by, at) of several filters, each once, and of those the ones at least `gap` apart; a gap of 1 or less keeps all."""
    by = by or BY
    every = reduce(DataFrame.unionByName, [f.select(*by, F.col(at).cast("long").alias(at)) for f in filters]).distinct()
    return every if gap <= 1 else spaced(every, gap, [], by, at, max(1, 1000 * gap))


def order_intents(signals: DataFrame, tie: list[str], least: float = 0.55, cooldown_ms: int = 30_000, units: int = 1, most: int = 3) -> DataFrame:
    """
    signals: instrument, ts_ms, direction (long, short, flat), confidence, net_units (held then). Adds units_delta for the signals that
    become orders: sure enough, not in the cooldown of the one before, and moving the position towards at most `most` units (T23).
    """
    net, d = F.col("net_units"), F.col("direction")
    long = F.when(net >= most, 0).when(net < 0, -net + units).otherwise(units)
    short = F.when(net <= -most, 0).when(net > 0, -net - units).otherwise(-units)
    delta = F.when(d == "long", long).when(d == "short", short).otherwise(-net)
    capped = F.when(F.abs(net + F.col("units_delta")) > most, most * F.signum("units_delta") - net).otherwise(F.col("units_delta")).cast("long")
    able = signals.where(F.col("confidence") >= least).withColumn("units_delta", delta).where("units_delta <> 0").withColumn("units_delta", capped).where("units_delta <> 0")
    return spaced(able, cooldown_ms, tie)


def bars_since(bars: DataFrame, fired: DataFrame, threshold: int) -> DataFrame:
    """fired: instrument, fired_ms. For each key of either: bars after its last firing, that number over the threshold, and due."""
    last = fired.groupBy("instrument").agg(F.max("fired_ms").alias("fired_ms"))
    n = F.count_if(F.col("fired_ms").isNull() | (F.col("ts_ms") > F.col("fired_ms")))
    out = bars.join(F.broadcast(last), "instrument", "left").groupBy("instrument").agg(n.alias("bars"))  # one row an instrument
    return out.withColumn("fraction", F.least(F.col("bars") / threshold, F.lit(1.0))).withColumn("due", F.col("bars") >= threshold)
