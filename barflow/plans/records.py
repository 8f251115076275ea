"""Queries on records of training runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import records as R
from .base import Plans, r6

P = Plans()
FLOORS = {"oos_auc": (">=", 0.3), "fine_tune_sortino": (">=", 1.0), "max_dd_bp": ("<=", 250.0)}
BLOCKED = "concat_ws(';', " + ", ".join(f"CASE WHEN NOT ({n} {op} {v}) THEN '{n}' END" for n, (op, v) in FLOORS.items()) + ")"


def _model(key: Column) -> Column:
    return F.concat(F.lit("side_m"), (key % 4).cast("string"), F.lit("_"), key.cast("string"))


def _models(spark: SparkSession, d: str) -> DataFrame:
    """Customers as models of five instruments, trained at a time of their nation."""
    m = A.model_metrics(spark, d)
    return m.select((F.col("model_id") % 5).alias("instrument"), _model(F.col("model_id")).alias("model_id"), F.col("run_id").cast("long").alias("ts_ms"), F.col("model_id").cast("long").alias("seq"), "oos_auc", "oos_log_loss", F.col("kind").alias("spec"), (F.col("model_id") % 3 == 0).alias("is_winner"))


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Orders as results of models: figures of the trader and a summary, which not all can be read."""
    s = F.col("o_orderstatus")
    summary = F.when(s == "F", '{"pass": true}').when(s == "O", '{"pass": false}').otherwise("{no")
    return A.table(spark, d, "orders").select(
        _model(F.col("o_custkey")).alias("model_id"), A.millis(F.col("o_orderdate")).alias("ts_ms"), F.col("o_orderkey").cast("long").alias("seq"), F.concat(F.lit("p"), (F.col("o_orderkey") % 9).cast("string")).alias("params_id"),
        F.round(F.col("o_totalprice") / 1e5, 7).alias("fine_tune_sortino"), F.round(F.col("o_totalprice") / 1000, 5).alias("max_dd_bp"), summary.alias("summary_json"),
    )


MODELS = A.METRICS + ", models AS (SELECT model_id % 5 AS instrument, 'side_m' || (model_id % 4) || '_' || model_id AS model_id, run_id AS ts_ms, model_id AS seq, oos_auc, oos_log_loss, kind AS spec, model_id % 3 = 0 AS is_winner FROM model_metrics)"
RESULTS = "results AS (SELECT * FROM (SELECT 'side_m' || (o_custkey % 4) || '_' || o_custkey AS model_id, 'p' || (o_orderkey % 9) AS params_id, round(CAST(o_totalprice AS DOUBLE) / 1e5, 7) AS fine_tune_sortino, round(CAST(o_totalprice AS DOUBLE) / 1000, 5) AS max_dd_bp, CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS passed, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1)"
JUDGED = f"judged AS (SELECT model_id, oos_auc, params_id, fine_tune_sortino, max_dd_bp, {BLOCKED} AS blocked_reasons FROM models JOIN results USING (model_id))"


@P.add("SELECT model_id, round(oos_auc, 6) AS oos_auc, params_id, fine_tune_sortino, max_dd_bp, blocked_reasons, blocked_reasons = '' AS passed_gate FROM judged", MODELS, RESULTS, JUDGED)
def j17_gate_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Each model that has results, with the newest of its trader and the verdict of the gate."""
    rows = R.gated(R.gate_inputs(_models(spark, d).drop("ts_ms", "seq"), _results(spark, d), ["seq"]), FLOORS)
    return rows.select("model_id", r6("oos_auc"), *R.TRADER, "blocked_reasons", "passed_gate")


@P.add(
    "SELECT m.instrument, m.model_id, split_part(m.model_id, '_', 2) AS model_kind, round(m.oos_auc, 6) AS oos_auc, c.candidates, coalesce(j.blocked_reasons = '', FALSE) AS passed_gate, coalesce(j.blocked_reasons, '') AS blocked_reasons, coalesce(j.fine_tune_sortino, 0) AS fine_tune_sortino, r.passed AS holdout_passed, coalesce(r.params_id, '') AS params_id, coalesce(r.max_dd_bp, 0) AS fine_tune_max_dd_bp FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts_ms DESC, seq DESC) AS k FROM models) m JOIN (SELECT instrument, string_agg(spec || ':' || CAST(CAST(round(oos_log_loss * 1e6) AS BIGINT) AS VARCHAR) || ':' || CAST(is_winner AS VARCHAR), ',' ORDER BY k) AS candidates FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts_ms DESC, oos_log_loss, seq DESC) AS k FROM models) WHERE k <= 7 GROUP BY 1) c USING (instrument) LEFT JOIN judged j ON j.model_id = m.model_id LEFT JOIN results r ON r.model_id = m.model_id WHERE m.k = 1",
    MODELS, RESULTS, JUDGED,
)
def j14_run_records(spark: SparkSession, d: str) -> DataFrame:
    """The newest model of each instrument with its seven best rivals, gate, holdout and trader."""
    models, results = _models(spark, d), _results(spark, d)
    gate = R.gated(R.gate_inputs(models.drop("ts_ms", "seq"), results, ["seq"]), FLOORS).select("model_id", "passed_gate", "blocked_reasons", "fine_tune_sortino")
    rows = R.run_records(models.select("instrument", "model_id", "ts_ms", "seq", "oos_auc"), models.drop("model_id"), gate, results, results, tie=["seq"])
    told = F.array_join(F.transform("candidates", lambda x: F.concat_ws(":", x["spec"], F.round(x["oos_log_loss"] * 1e6).cast("long").cast("string"), x["is_winner"].cast("string"))), ",")
    return rows.select("instrument", "model_id", "model_kind", r6("oos_auc"), told.alias("candidates"), "passed_gate", "blocked_reasons", "fine_tune_sortino", "holdout_passed", "params_id", "fine_tune_max_dd_bp")
