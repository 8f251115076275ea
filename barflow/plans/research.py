"""Queries of the research side: overfitting, bootstrap, parameter sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import bar_features, ledger, research
from ..operators.rolling import number_rows
from .base import Plans, r6
from .market import NUM

P = Plans()


@P.add(
    """SELECT count(*) AS n_splits, round(avg(CASE WHEN share < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS pbo FROM (SELECT m, strategy, rk / (k + 1) AS share FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY sharpe, strategy) AS rk, count(*) OVER (PARTITION BY m) AS k FROM h WHERE NOT ins)) JOIN (SELECT m, last(strategy ORDER BY sharpe, strategy) AS best FROM h WHERE ins GROUP BY m) USING (m) WHERE strategy = best""",
    NUM,
    "rr AS (SELECT rn - 1 AS period, instrument AS strategy, round(close / open - 1, 9) AS r FROM b)",
    "ce AS (SELECT CAST(period // ((SELECT max(period) + 1 FROM rr) // 8) AS INTEGER) AS block, strategy, sum(r) AS s, sum(r * r) AS q, count(*) AS n FROM rr WHERE period < 8 * ((SELECT max(period) + 1 FROM rr) // 8) GROUP BY 1, 2)",
    "hs AS (SELECT m, strategy, (m >> block) & 1 = 1 AS ins, sum(s) AS s, sum(q) AS q, sum(n) AS n FROM range(256) t(m), ce WHERE bit_count(m) = 4 GROUP BY 1, 2, 3)",
    "h AS (SELECT *, CASE WHEN sqrt(greatest(q / n - s / n * s / n, 0)) > 1e-12 THEN (s / n) / sqrt(greatest(q / n - s / n * s / n, 0)) ELSE 0 END AS sharpe FROM hs)",
)
def a26_pbo(spark: SparkSession, d: str) -> DataFrame:
    rows = number_rows(A.bars(spark, d), ["instrument"])
    returns = rows.select((F.col("rn") - 1).alias("period"), F.col("instrument").alias("strategy"), F.round(F.col("close") / F.col("open") - 1, 9).alias("r"))
    return research.pbo(returns, 8).select("n_splits", r6("pbo"))


@P.add(
    """SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN t BETWEEN 0.4 AND 0.95 THEN NULL ELSE 'take_threshold' END, CASE WHEN q BETWEEN 10 AND 60 THEN NULL ELSE 'min_hold_bars' END, CASE WHEN s BETWEEN 0.5 AND 30 THEN NULL ELSE 'spread_max_bp' END], lambda x: x IS NOT NULL), ',') AS wrong,
CAST(greatest(least(round(q), 60), 10) AS DOUBLE) AS hold_inside, round(greatest(least(s, 30), 0.5), 6) AS spread_inside FROM (SELECT l_orderkey, l_linenumber, l_discount * 10 + 0.01 AS t, CAST(l_quantity AS DOUBLE) AS q, l_extendedprice / 2500 AS s FROM lineitem)"""
)
def x4_parameter_bounds(spark: SparkSession, d: str) -> DataFrame:
    sets = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10 + 0.01).alias("take_threshold"), F.col("l_quantity").cast("double").alias("min_hold_bars"), (F.col("l_extendedprice") / 2500).alias("spread_max_bp"))
    checked = sets.withColumn("wrong", F.array_join(research.out_of_bounds(sets), ","))
    return research.bounded(checked).select("l_orderkey", "l_linenumber", "wrong", F.col("min_hold_bars").alias("hold_inside"), r6("spread_max_bp", "spread_inside"))


@P.add(None)
def a27_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return research.bootstrap(A.ledger(spark, d), "realized_r", F.avg, resamples=50)


@P.add(None)
def t19_t30_parameter_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Trades of every parameter set, rolled up."""
    b = bar_features.bar_features(A.bars(spark, d))
    bars = b.select("instrument", "ts_ms", "close", F.col("rsi_14").alias("p_long"), (1 - F.col("rsi_14")).alias("p_short"), F.col("ewma_vol").alias("sigma"))
    grid = spark.createDataFrame([(i, 0.5 + 0.02 * i, 0.05, 1.0 + i % 2, 2.0, 20, 3) for i in range(6)], "params_id int, take double, margin double, stop double, target double, max_hold int, cooldown int")
    closed = research.trade_decisions(bars, grid).where("action = 'close'").withColumn("ts_out_ms", F.col("ts_ms"))
    return ledger.trade_rollup(closed, ["params_id"])
