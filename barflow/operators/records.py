"""Records of training runs, put together from tables that each hold one side of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import model_kind
from .bars import latest_n, latest_row

TRADER = ["params_id", "fine_tune_sortino", "max_dd_bp"]
CANDIDATE = ["spec", "oos_log_loss", "oos_auc", "is_winner"]


def gate_inputs(metrics: DataFrame, trader: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """metrics: model_id and figures. Each model that has trader figures (model_id, ts_ms, TRADER), with the newest of them."""
    newest = latest_row(trader.select("model_id", "ts_ms", *(tie or []), *TRADER), ["model_id"], ["ts_ms", *(tie or [])])
    return metrics.join(newest.select("model_id", *TRADER), "model_id")


def gated(inputs: DataFrame, floors: dict[str, tuple[str, float]]) -> DataFrame:
    """Adds passed_gate and blocked_reasons: the names, in the order of `floors`, of figures that are below (">=") or above ("<=") their floor or null."""
    holds = lambda n, op, v: F.coalesce(F.col(n) >= v if op == ">=" else F.col(n) <= v, F.lit(False))
    reasons = F.array_compact(F.array(*(F.when(~holds(n, op, v), n) for n, (op, v) in floors.items())))
    return inputs.withColumn("blocked_reasons", F.array_join(reasons, ";")).withColumn("passed_gate", F.size(reasons) == 0)


def passed_in(json: Column) -> Column:
    """The field `pass` of a summary, if it is a truth value; null where it isn't, or where the JSON can't be read."""
    return F.from_json(json, "pass boolean")["pass"]


def run_records(metrics: DataFrame, candidates: DataFrame, gate: DataFrame, holdout: DataFrame, trader: DataFrame, most: int = 7, tie: list[str] | None = None) -> DataFrame:
    """
    One record for each instrument's newest model (J14). metrics: instrument, model_id, ts_ms and figures; candidates: instrument, ts_ms and
    CANDIDATE, of which the newest `most` (of one time those of lower loss) are an array; gate: model_id, passed_gate, blocked_reasons,
    fine_tune_sortino, one row a model; holdout: model_id, ts_ms, summary_json, trader: model_id, ts_ms and TRADER, the newest of each
    count. `tie` (numbers) orders rows of one time in all of them. Without a gate a model hasn't passed, with no reasons and a ratio of 0; without trader
    figures it has no params_id and a drawdown of 0; without a readable verdict holdout_passed is null.

    Each side is brought to one row a key before it is joined.
    """
    tie = tie or []
    newest = latest_row(metrics, ["instrument"], ["ts_ms", *tie])
    models = newest.select("model_id").distinct()
    of = lambda side: side.join(models, "model_id", "left_semi")
    ranked = latest_n(candidates.withColumn("_less", -F.col("oos_log_loss")), most, ["instrument"], ["ts_ms", "_less", *tie])
    line = F.struct((-F.col("ts_ms")).alias("o1"), F.col("oos_log_loss").alias("o2"), *((-F.col(t)).alias(f"o3_{t}") for t in tie), *CANDIDATE)
    lists = ranked.groupBy("instrument").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.struct(*(x[c].alias(c) for c in CANDIDATE))).alias("candidates"))
    verdicts = latest_row(of(holdout), ["model_id"], ["ts_ms", *tie]).select("model_id", passed_in(F.col("summary_json")).alias("holdout_passed"))
    traders = latest_row(of(trader), ["model_id"], ["ts_ms", *tie]).select("model_id", "params_id", F.col("max_dd_bp").alias("fine_tune_max_dd_bp"))
    gates = of(gate).select("model_id", "passed_gate", "blocked_reasons", "fine_tune_sortino")
    rows = newest.join(lists, "instrument", "left").join(gates, "model_id", "left").join(verdicts, "model_id", "left").join(traders, "model_id", "left")
    filled = {"passed_gate": F.lit(False), "blocked_reasons": F.lit(""), "fine_tune_sortino": F.lit(0.0), "params_id": F.lit(""), "fine_tune_max_dd_bp": F.lit(0.0)}
    rows = rows.withColumns({c: F.coalesce(c, v) for c, v in filled.items()})
    return rows.withColumn("model_kind", model_kind(F.col("model_id"), "unknown"))
