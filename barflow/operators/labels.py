"""Labels from bars: events, first-touch barriers, and what makes a fair set of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .asof import forward_range
from .rolling import Series, number_rows, running, with_lookback, without_lookback
from .schedule import BLOCK, best_schedule


def triple_barrier(bars: DataFrame, events: DataFrame, pt: float, sl: float, horizon: int, min_edge: float = 0.0) -> DataFrame:
    """
    bars: instrument, ts_ms, high, low, close, rn. events: instrument, rn, ts_ms, close, sigma, side (+1 or -1: the barrier that is
    profit). First touch of close * (1 + pt * sigma) or close * (1 - sl * sigma) in the next `horizon` bars; both in one bar is a
    stop; none is the sign of the last close's return (0: +1); meta_y: whether |r| is `min_edge` or more. Events without a later bar are dropped.
    """
    sigma = F.greatest("sigma", F.lit(1e-12))
    up, down = F.col("close") * (1 + pt * sigma), F.col("close") * (1 - sl * sigma)
    met = forward_range(events.withColumn("up", up).withColumn("down", down), bars.select("instrument", "rn", "ts_ms", "high", "low", "close"), ["instrument"], horizon)
    hit = F.when(F.col("b_low") <= F.col("down"), "sl").when(F.col("b_high") >= F.col("up"), "pt")
    rows = met.withColumn("hit", hit).groupBy("instrument", "rn", "ts_ms", "close", "up", "down").agg(
        F.min_by(F.struct("hit", "b_ts_ms"), F.when(F.col("hit").isNotNull(), F.col("b_rn"))).alias("touch"), F.max_by(F.struct("b_close", "b_ts_ms"), "b_rn").alias("end")
    )
    barrier = F.coalesce("touch.hit", F.lit("vert"))
    exit_px = F.when(F.col("touch.hit") == "sl", F.col("down")).when(F.col("touch.hit") == "pt", F.col("up")).otherwise(F.col("end.b_close"))
    out = rows.select("instrument", "ts_ms", F.coalesce("touch.b_ts_ms", "end.b_ts_ms").alias("t1_ms"), barrier.alias("barrier_hit"), (exit_px / F.col("close") - 1).alias("realized_r"))
    side = F.when(F.col("realized_r") >= 0, 1).otherwise(-1)
    return out.withColumn("side", side).withColumn("meta_y", (F.abs("realized_r") >= min_edge).cast("int"))


def meta_label(side, r, edge: float):
    return F.when((side != 0) & (side * r > edge), 1).otherwise(0)


def cusum_events(bars: DataFrame, h: float) -> DataFrame:
    """bars: instrument, ts_ms, ret, sigma. Rows where the up or down sum of returns since the last event exceeds h * sigma. Sequential by nature, so one task per instrument and session."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts_ms")
        up = down = 0.0
        side = np.zeros(len(pdf), np.int32)
        for i, (r, s) in enumerate(zip(pdf["ret"].tolist(), pdf["sigma"].tolist(), strict=True)):
            up, down = max(0.0, up + r), min(0.0, down + r)
            if s > 0 and up > h * s:
                side[i], up, down = 1, 0.0, 0.0
            elif s > 0 and down < -h * s:
                side[i], up, down = -1, 0.0, 0.0
        pdf["event_side"] = side
        return pdf[pdf["event_side"] != 0]

    schema = T.StructType([*bars.schema.fields, T.StructField("event_side", T.IntegerType())])
    keys = ["instrument"] + (["session"] if "session" in bars.columns else [])
    return bars.groupBy(*keys).applyInPandas(run, schema)


def overlap_clusters(labels: DataFrame, by: list[str]) -> DataFrame:
    """Adds cluster: labels whose intervals [ts_ms, t1_ms] overlap in a chain. Clusters are independent, so choices in them are too."""
    seen = running(labels, by, "ts_ms", ["t1_ms"], F.col("t1_ms"), "max", "_upto", own=False)
    new = F.when(F.col("_upto").isNull() | (F.col("ts_ms") >= F.col("_upto")), 1).otherwise(0)
    return running(seen, by, "ts_ms", ["t1_ms"], new, "sum", "cluster").drop("_upto")


def forward_change(bars: DataFrame, rows: int, by: list[str]) -> DataFrame:
    """
    The bars that have one `rows` rows later, with that one's close as `later` (W25, A31). Each row finds its earlier one by
    looking back, so blocks need no rows after them.
    """
    found, s = with_lookback(number_rows(bars, by), rows), Series(by)
    back = found.withColumn("_then", s.lag(F.struct("ts_ms", *(c for c in bars.columns if c not in (*by, "ts_ms"))), rows))
    done = without_lookback(back).where(F.col("rn") > rows)
    return done.select(*by, F.col("_then.ts_ms").alias("ts_ms"), *(F.col(f"_then.{c}").alias(c) for c in bars.columns if c not in (*by, "ts_ms")), F.col("close").alias("later"))


#: Parts of one unit of return that sums of scores are counted in; whole numbers, so sums don't depend on the order of adding.
UNITS = 1e9


def select_labels(labels: DataFrame, cost: float = 0.0, min_hold_ms: int = 10_000, max_hold_ms: int = 1 << 60, min_edge: float = 0.0, block: int = BLOCK) -> DataFrame:
    """Of labels inside the hold band and not below the edge, those that don't overlap and have the greatest sum of |r| - cost, rounded to 1e-9 each."""
    hold, r = F.col("t1_ms") - F.col("ts_ms"), F.abs("realized_r")
    able = labels.where(hold.between(min_hold_ms, max_hold_ms) & (r >= min_edge) & (r > cost))
    return best_schedule(able.withColumn("_score", F.round((r - cost) * UNITS).cast("long")), "_score", ["instrument"], tie=["realized_r"], block=block).drop("_score")


def balance_minority(labels: DataFrame, fraction: float = 0.30, by: list[str] | None = None) -> DataFrame:
    """
    Drops the weakest labels of the larger side, of equal ones the earlier, until the smaller one is `fraction` of all or the larger is
    gone (T7). Side 0 counts as long; where both are equal, short is the larger. One side alone stays.
    """
    by = by or ["instrument"]
    up = F.col("side") >= 0
    counts = labels.groupBy(*by).agg(F.count_if(up).alias("_up"), F.count_if(~up).alias("_down"))
    few = F.least("_up", "_down")
    counts = counts.withColumn("_major", F.col("_up") > F.col("_down")).withColumn("_room", F.when(few > 0, F.greatest(F.floor(few / fraction) - few, F.lit(0))).otherwise(F.greatest("_up", "_down")))
    rank = F.row_number().over(Window.partitionBy(*by, up).orderBy(F.desc(F.abs("realized_r")), F.desc("ts_ms")))
    out = labels.withColumn("_rank", rank).join(counts, by)
    return out.where((up != F.col("_major")) | (F.col("_rank") <= F.col("_room"))).select(*labels.columns)


def label_pipeline(bars: DataFrame, h: float = 1.0, pt: float = 2.0, sl: float = 2.0, horizon: int = 36, min_edge: float = 0.0, min_hold_ms: int = 10_000, max_hold_ms: int = 600_000, cost: float = 0.0, fraction: float = 0.30) -> DataFrame:
    """
    bars: instrument, rn, ts_ms, high, low, close, ret, sigma. Labels as training takes them (T8): events of the cumulative sums, first
    touch of their barriers, the best set that doesn't overlap, then the balance of sides.
    """
    events = cusum_events(bars.select("instrument", "rn", "ts_ms", "close", "ret", "sigma"), h)
    raw = triple_barrier(bars, events.select("instrument", "rn", "ts_ms", "close", "sigma"), pt, sl, horizon, min_edge)
    return balance_minority(select_labels(raw, cost, min_hold_ms, max_hold_ms, min_edge), fraction)
