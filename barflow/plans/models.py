"""Queries that fit and score models on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters as A
from ..models import training as M
from ..operators import bar_features, research, splits
from ..operators.rolling import number_rows
from ..storage import kept
from .base import Plans, r6

P = Plans()
FEATURES = ["log_ret_1", "log_ret_5", "sma_dev_30", "range_60", "log_ticks"]


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Bar features with whether the next close is higher."""
    rows = bar_features.price_windows(A.bars(spark, d)).select("instrument", "ts_ms", "rn", "close", *FEATURES)
    after = rows.select("instrument", (F.col("rn") - 1).alias("rn"), F.col("close").alias("next"), F.col("ts_ms").alias("t1"))
    return rows.join(after, ["instrument", "rn"]).withColumn("r", F.col("next") / F.col("close") - 1).withColumn("y", (F.col("r") > 0).cast("double"))


@P.add(None)
def t26_t27_out_of_fold(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).withColumn("t0", F.col("ts_ms"))
    folds = splits.purged_kfold(rows.select("instrument", "t0", "t1"), 3, 0.01, ["instrument"], []).select("instrument", "t0", "split", "role")
    oof = M.out_of_fold(folds.join(rows, ["instrument", "t0"]), FEATURES, M.chosen("logreg,forest", len(FEATURES)), ["instrument", "ts_ms"])
    return oof.groupBy("model", "split").agg(F.count("*").alias("n"), r6(M.log_loss(), "log_loss"))


@P.add(None)
def t27_x3_search(spark: SparkSession, d: str) -> DataFrame:
    """All four candidates with all their parameter sets on purged folds, and the best set of each."""
    rows = _rows(spark, d).withColumn("t0", F.col("ts_ms"))
    folds = splits.purged_kfold(rows.select("instrument", "t0", "t1"), 3, 0.01, ["instrument"], []).select("instrument", "t0", "split", "role")
    found = M.searched(folds.join(rows, ["instrument", "t0"]).select("split", "role", "y", *FEATURES), FEATURES, M.chosen("", len(FEATURES)))
    return found.select("model", "params", "split", "n", r6("log_loss"), r6("mean_loss"), "best")


@P.add(None)
def t28_t31_calibrated_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = kept(_rows(spark, d))
    half = F.pmod(F.xxhash64("instrument", "ts_ms"), F.lit(3))
    fitted = M.pipeline(FEATURES, M.candidates(len(FEATURES))["logreg"]()).fit(rows.where(half == 0))
    a, b = M.platt(M.score(fitted, rows.where(half == 1)))
    out = M.score(fitted, rows.where(half == 2), history=F.col("rn"), least=60)
    return out.select("instrument", "ts_ms", r6("p"), r6(M.calibrated(F.col("p"), a, b), "calibrated"))


SQL_Y = "f AS (SELECT instrument, ts_ms, rn, ln(close) - lag(ln(close)) OVER w AS x, lead(close) OVER w / close - 1 AS y FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts_ms) AS rn FROM bars) WINDOW w AS (PARTITION BY instrument ORDER BY ts_ms)), g AS (SELECT instrument, ts_ms, rn, coalesce(x, 0) AS x, y FROM f WHERE y IS NOT NULL)"


@P.add(
    "SELECT instrument, ts_ms, round(CASE WHEN rn > 200 THEN my + k * (x - mx) ELSE 0 END, 8) + 0.0 AS prediction FROM (SELECT g.instrument, g.ts_ms, any_value(g.rn) AS rn, any_value(g.x) AS x, avg(h.x) AS mx, avg(h.y) AS my, covar_pop(h.x, h.y) / var_pop(h.x) * count(*) / (count(*) + 1) AS k FROM g LEFT JOIN g h ON h.instrument = g.instrument AND h.rn <= (g.rn - 1) // 50 * 50 AND h.rn > (g.rn - 1) // 50 * 50 - 400 GROUP BY 1, 2)",
    A.BARS, SQL_Y,
)
def t37_walk_forward_ridge(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).select("instrument", "ts_ms", "rn", F.col("log_ret_1").alias("x"), F.col("r").alias("y"))
    return M.walk_forward(rows, ["x"], "y", ["instrument"], first=200, every=50, buffer=400).select("instrument", "ts_ms", r6("prediction", digits=8))


@P.add(None)
def t29_holdout(spark: SparkSession, d: str) -> DataFrame:
    b = bar_features.bar_features(A.bars(spark, d)).select("instrument", "ts_ms", "close", F.col("rsi_14").alias("p_long"), (1 - F.col("rsi_14")).alias("p_short"), F.col("ewma_vol").alias("sigma"))
    grid = spark.createDataFrame([(0, 0.55, 0.05, 1.0, 2.0, 20, 3)], "params_id int, take double, margin double, stop double, target double, max_hold int, cooldown int")
    decide = lambda rows: research.trade_decisions(rows.drop("rn"), grid).where("action = 'close'").withColumn("ts_out_ms", F.col("ts_ms"))
    return M.holdout(number_rows(b, ["instrument"]), decide, 300, 300, {"n_trades": 5, "dsr": 0.5, "max_dd_bp": 500}).select("instrument", "n_trades", r6("sharpe"), r6("dsr"), r6("max_dd_bp"), "reasons", "passed")
