"""Queries on ledgers, decisions, model figures, classifier rows and books."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import adapters as A
from ..functions import stats
from ..operators import crowd, ledger as L
from ..operators.series_features import BOOK, depth_features
from .base import Plans, r6

P = Plans()
ROLL = "count(*) AS n_trades, count(*) FILTER (realized_r > 0) AS wins, count(*) FILTER (realized_r < 0) AS losses, count(*) FILTER (realized_r = 0) AS scratched, round(sum(realized_r), 6) + 0.0 AS cum_r, round(coalesce(avg(realized_r) FILTER (realized_r > 0), 0), 6) AS avg_win, round(coalesce(avg(realized_r) FILTER (realized_r < 0), 0), 6) AS avg_loss, round(avg(realized_r), 6) + 0.0 AS expectancy, max(ts_out_ms) AS last_ts"
NUMS = ("cum_r", "avg_win", "avg_loss", "expectancy")


def _rounded(df: DataFrame, names) -> DataFrame:
    return df.select(*(r6(c) if c in names else F.col(c) for c in df.columns))


@P.add(f"SELECT instrument, {ROLL} FROM ledger GROUP BY instrument", A.LEDGER)
def a4_trade_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(L.trade_rollup(A.ledger(spark, d)), NUMS)


@P.add(f"SELECT instrument, {ROLL} FROM ledger GROUP BY GROUPING SETS ((instrument), ())", A.LEDGER)
def a5_portfolio_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(L.portfolio_rollup(A.ledger(spark, d)), NUMS)


BINS = "SELECT instrument, whole, string_agg(v || ':' || n, ';' ORDER BY v) AS bins FROM (SELECT instrument, GROUPING(instrument) AS whole, coalesce({0}, 'unknown') AS v, count(*) AS n FROM lk GROUP BY GROUPING SETS ((instrument, coalesce({0}, 'unknown')), (coalesce({0}, 'unknown')))) GROUP BY 1, 2"


@P.add(
    f"SELECT b.instrument, n_trades, cum_r, newest, x.bins AS reasons, y.bins AS kinds FROM (SELECT instrument, GROUPING(instrument) AS whole, count(*) AS n_trades, round(sum(realized_r), 6) + 0.0 AS cum_r, last(exit_reason ORDER BY ts_out_ms, trade_id) AS newest FROM lk GROUP BY GROUPING SETS ((instrument), ())) b JOIN ({BINS.format('exit_reason')}) x ON x.whole = b.whole AND x.instrument IS NOT DISTINCT FROM b.instrument JOIN ({BINS.format('kind')}) y ON y.whole = b.whole AND y.instrument IS NOT DISTINCT FROM b.instrument",
    A.LEDGER, A.METRICS, "lk AS (SELECT ledger.*, kind FROM ledger LEFT JOIN model_metrics USING (model_id))",
)
def a5_portfolio_book(spark: SparkSession, d: str) -> DataFrame:
    rows = A.ledger(spark, d).join(A.model_metrics(spark, d).select("model_id", "kind"), "model_id", "left")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["value"], x["n"])), ";").alias(c)
    book = L.portfolio_book(rows, ["trade_id"], {"reasons": "exit_reason", "kinds": "kind"})
    return book.select("instrument", "n_trades", r6("cum_r"), "newest", text("reasons"), text("kinds"))


SHARPE = "CASE WHEN count(*) >= 2 AND stddev_samp(realized_r) > 0 THEN avg(realized_r) / stddev_samp(realized_r) ELSE 0 END"
SQ = "sum(CASE WHEN realized_r < 0 THEN realized_r * realized_r ELSE 0 END)"
WON, LOST = "sum(CASE WHEN realized_r > 0 THEN realized_r ELSE 0 END)", "sum(CASE WHEN realized_r < 0 THEN -realized_r ELSE 0 END)"


@P.add(
    f"SELECT instrument, round({SHARPE}, 6) + 0.0 AS sharpe, round(CASE WHEN {SQ} > 0 THEN avg(realized_r) / sqrt({SQ} / count(*)) ELSE 0 END, 6) + 0.0 AS sortino_all, round(CASE WHEN {SQ} > 0 THEN avg(realized_r) / sqrt({SQ} / count(*) FILTER (realized_r < 0)) ELSE 0 END, 6) + 0.0 AS sortino_losers, round(CASE WHEN {LOST} > 0 THEN least({WON} / {LOST}, 999) WHEN {WON} > 0 THEN 999 ELSE 0 END, 6) AS profit_factor, round(count(*) FILTER (realized_r > 0) / count(*) FILTER (realized_r <> 0), 6) AS hit_decided, round(count(*) FILTER (realized_r > 0) / count(*), 6) AS hit_all FROM ledger GROUP BY instrument",
    A.LEDGER,
)
def a6_a21_a23_ratios(spark: SparkSession, d: str) -> DataFrame:
    return A.ledger(spark, d).groupBy("instrument").agg(r6(L.sharpe(), "sharpe"), r6(L.sortino(), "sortino_all"), r6(L.sortino(denominator="losers"), "sortino_losers"), r6(L.profit_factor(), "profit_factor"), r6(L.hit_rate(), "hit_decided"), r6(L.hit_rate(decided=False), "hit_all"))


@P.add("SELECT instrument, round(sum(pl), 4) + 0.0 AS net, round(max(pl), 6) AS best, round(min(pl), 6) AS worst FROM (SELECT instrument, side * qty * (exit_px - entry_px) - fee - slip AS pl FROM ledger) GROUP BY 1", A.LEDGER)
def a7_ledger_summary(spark: SparkSession, d: str) -> DataFrame:
    pl = F.col("side") * F.col("qty") * (F.col("exit_px") - F.col("entry_px")) - F.col("fee") - F.col("slip")
    return A.ledger(spark, d).select("instrument", pl.alias("pl")).groupBy("instrument").agg(r6(F.sum("pl"), "net", 4), r6(F.max("pl"), "best"), r6(F.min("pl"), "worst"))


@P.add("SELECT exit_reason, count(*) AS n, round(sum(realized_r), 6) + 0.0 AS cum_r, round(avg(realized_r), 6) + 0.0 AS avg_r FROM ledger GROUP BY 1 ORDER BY n DESC, 1", A.LEDGER)
def a8_reason_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return A.ledger(spark, d).groupBy("exit_reason").agg(F.count("*").alias("n"), r6(F.sum("realized_r"), "cum_r"), r6(F.avg("realized_r"), "avg_r")).orderBy(F.desc("n"), "exit_reason")


@P.add("SELECT instrument, count(*) AS n, round(sum(realized_r), 6) + 0.0 AS cum_r FROM ledger GROUP BY 1 ORDER BY cum_r DESC, 1", A.LEDGER)
def a9_instrument_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return A.ledger(spark, d).groupBy("instrument").agg(F.count("*").alias("n"), r6(F.sum("realized_r"), "cum_r")).orderBy(F.desc("cum_r"), "instrument")


@P.add("SELECT count(*) AS n, count(*) FILTER (pareto_rank = 1) AS n_first, max(sortino) AS best_sortino, min(max_dd_bp) AS least_dd, last(study_id ORDER BY ts_ms, trial_id) AS newest FROM trials", A.TRIALS)
def a10_trial_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.trials(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("pareto_rank") == 1).alias("n_first"), F.max("sortino").alias("best_sortino"), F.min("max_dd_bp").alias("least_dd"), F.max_by("study_id", F.struct("ts_ms", "trial_id")).alias("newest"))


@P.add("SELECT count(*) AS n, last(reason ORDER BY k, reason) AS top_reason FROM (SELECT reason, count(*) AS k FROM decisions WHERE ts_ms > (SELECT max(ts_ms) FROM decisions) - 86400000 GROUP BY 1) GROUP BY ALL".replace("count(*) AS n", "CAST(sum(k) AS BIGINT) AS n"), A.DECISIONS)
def a12_rejection_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = A.decisions(spark, d)
    end = F.broadcast(rows.agg(F.max("ts_ms").alias("end")))  # one row
    recent = rows.crossJoin(end).where("ts_ms > end - 86400000").groupBy("reason").agg(F.count("*").alias("k"))
    return recent.agg(F.sum("k").alias("n"), F.max_by("reason", F.struct("k", "reason")).alias("top_reason"))


@P.add("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def a13_row_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t in ("orders", "lineitem", "events"):
        one = A.table(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@P.add("SELECT instrument, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM ticks GROUP BY 1", A.TICKS)
def a14_key_ranges(spark: SparkSession, d: str) -> DataFrame:
    return A.ticks(spark, d).groupBy("instrument").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


@P.add(
    "SELECT instrument, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS n FROM (SELECT *, (row_number() OVER (PARTITION BY instrument, island ORDER BY ts_ms, event_id) - 1) // 100 AS part FROM (SELECT *, sum(CASE WHEN action <> 'skip' THEN 1 ELSE 0 END) OVER (PARTITION BY instrument ORDER BY ts_ms, event_id) AS island FROM decisions) WHERE action = 'skip') GROUP BY instrument, island, part",
    A.DECISIONS,
)
def a15_compact_skips(spark: SparkSession, d: str) -> DataFrame:
    return L.compact_skips(A.decisions(spark, d), ["event_id"]).select("instrument", "first_ms", "last_ms", "n")


@P.add("""SELECT instrument, ts_in_ms, ts_out_ms, side, round(side * (price / px - 1), 6) + 0.0 AS realized_r, '["entry:' || why || '","exit:' || reason || '"]' AS decision_chain FROM (SELECT *, lag(reason) OVER w AS why, CASE lag(action) OVER w WHEN 'open_long' THEN 1 WHEN 'open_short' THEN -1 END AS side, lag(ts_ms) OVER w AS ts_in_ms, lag(price) OVER w AS px, ts_ms AS ts_out_ms FROM decisions WHERE action <> 'skip' WINDOW w AS (PARTITION BY instrument ORDER BY ts_ms, event_id)) WHERE action = 'close' AND side IS NOT NULL""", A.DECISIONS)
def t18_round_trips(spark: SparkSession, d: str) -> DataFrame:
    return L.round_trips(A.decisions(spark, d), ["event_id"]).select("instrument", "ts_in_ms", "ts_out_ms", "side", r6("realized_r"), "decision_chain")


CURVE = "c AS (SELECT *, sum(realized_r) OVER (PARTITION BY instrument ORDER BY ts_out_ms, trade_id ROWS UNBOUNDED PRECEDING) AS cum_r FROM ledger), k AS (SELECT *, greatest(max(cum_r) OVER (PARTITION BY instrument ORDER BY ts_out_ms, trade_id ROWS UNBOUNDED PRECEDING), 0) AS peak FROM c)"


@P.add("SELECT trade_id, round(cum_r, 9) + 0.0 AS cum_r, round(peak, 9) + 0.0 AS peak, round(peak - cum_r, 9) + 0.0 AS drawdown FROM k", A.LEDGER, CURVE)
def t13_t14_equity_curve(spark: SparkSession, d: str) -> DataFrame:
    return L.curve(A.ledger(spark, d), ["instrument"], ["trade_id"]).select("trade_id", r6("cum_r", digits=9), r6("peak", digits=9), r6("drawdown", digits=9))


EQUITY = "q AS (SELECT *, sum(ln(1 + realized_r)) OVER (PARTITION BY instrument ORDER BY ts_out_ms, trade_id ROWS UNBOUNDED PRECEDING) AS lg FROM ledger), e AS (SELECT *, exp(lg) AS equity, greatest(max(exp(lg)) OVER (PARTITION BY instrument ORDER BY ts_out_ms, trade_id ROWS UNBOUNDED PRECEDING), 1.0) AS top FROM q)"


@P.add("SELECT trade_id, round(ln(equity), 7) + 0.0 AS log_equity, round(ln(top), 7) + 0.0 AS log_peak, round(ln(equity / top), 9) + 0.0 AS log_depth FROM e", A.LEDGER, EQUITY)
def t14_compounded_equity(spark: SparkSession, d: str) -> DataFrame:
    return L.compounded(A.ledger(spark, d), ["instrument"], ["trade_id"]).select("trade_id", r6(F.log("equity"), "log_equity", 7), r6(F.log("equity_peak"), "log_peak", 7), r6(F.log(1 - F.col("drawdown_bp") / 10_000), "log_depth", 9))


A24_REAL = ("net_return", "sharpe", "sortino", "deflated_sharpe", "calmar", "max_drawdown_bp", "hit_rate", "profit_factor", "avg_win", "avg_loss", "turnover_per_day", "exposure")


@P.add(
    "SELECT instrument, n_trades, n_trades > 0 AS traded, " + ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in A24_REAL) + f" FROM (SELECT *, CASE WHEN max_drawdown_bp > 0 THEN sharpe / (max_drawdown_bp / 1e4) ELSE 0 END AS calmar, CASE WHEN n_trades < 2 THEN 0 ELSE {stats.cdf_sql('(sharpe / sqrt((1 + sharpe * sharpe / 2) / (n_trades - 1)))')} END AS deflated_sharpe FROM (SELECT instrument, count(*) AS n_trades, sum(realized_r) AS net_return, {SHARPE} AS sharpe, CASE WHEN {SQ} > 0 THEN avg(realized_r) / sqrt({SQ} / count(*)) ELSE 0 END AS sortino, max((top - equity) / top * 1e4) AS max_drawdown_bp, count(*) FILTER (realized_r > 0) / count(*) AS hit_rate, CASE WHEN {LOST} > 0 THEN {WON} / {LOST} WHEN {WON} > 0 THEN 1e6 ELSE 0 END AS profit_factor, coalesce(avg(realized_r) FILTER (realized_r > 0), 0) AS avg_win, coalesce(avg(realized_r) FILTER (realized_r <= 0), 0) AS avg_loss, count(*) / ((max(ts_out_ms) - min(ts_out_ms)) / 86400000) AS turnover_per_day, 0.0 AS exposure FROM e GROUP BY 1))",
    A.LEDGER, EQUITY,
)
def a24_trade_summary(spark: SparkSession, d: str) -> DataFrame:
    return L.trade_summary(A.ledger(spark, d), ["instrument"], ["trade_id"]).select("instrument", "n_trades", "traded", *(r6(c, digits=5) for c in A24_REAL))


NORMAL = "n AS (SELECT doc_id, (doc_id * 7919 % 8001) / 1000 - 4 AS x, (doc_id * 104729 % 9973 + 1) / 9975 AS p FROM documents)"


@P.add(f"SELECT doc_id, round({stats.cdf_sql('x')}, 9) AS cdf, round({stats.ppf_sql('p')}, 8) + 0.0 AS ppf, round(1 / (1 + exp(-x)), 9) AS sigmoid, round(exp(x) / (exp(x) + exp(p)), 9) AS share FROM n", NORMAL)
def f2_f3_normal_sigmoid_softmax(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "documents").select("doc_id", (F.col("doc_id") * 7919 % 8001 / 1000 - 4).alias("x"), ((F.col("doc_id") * 104729 % 9973 + 1) / 9975).alias("p"))
    x, p = F.col("x"), F.col("p")
    return rows.select("doc_id", r6(stats.norm_cdf(x), "cdf", 9), r6(stats.norm_ppf(p), "ppf", 8), r6(stats.sigmoid(x), "sigmoid", 9), r6(stats.softmax(x, p)[0], "share", 9))


@P.add(
    f"SELECT trial_id, round(CASE WHEN n_trades < 2 THEN 0 ELSE {stats.cdf_sql('((sortino - top * sd) / sd)')} END, 7) + 0.0 AS dsr FROM (SELECT *, sqrt((1 + 0.5 * sortino + 0.75 * sortino * sortino) / nullif(n_trades - 1, 0)) AS sd, CASE WHEN k <= 1 THEN 0 ELSE (1 - {stats.EULER}) * {stats.ppf_sql('(1 - 1 / greatest(k, 2.0))')} + {stats.EULER} * {stats.ppf_sql('(1 - 1 / (greatest(k, 2.0) * exp(1.0)))')} END AS top FROM (SELECT *, CAST(count(*) OVER (PARTITION BY study_id) AS DOUBLE) AS k FROM trials))",
    A.TRIALS,
)
def a25_deflated_sharpe(spark: SparkSession, d: str) -> DataFrame:
    rows = A.trials(spark, d)
    rows = rows.join(rows.groupBy("study_id").agg(F.count("*").alias("k")), "study_id")
    return rows.select("trial_id", r6(stats.deflated_sharpe(F.col("sortino"), F.col("n_trades"), F.col("k"), -0.5, 4.0), "dsr", 7))


@P.add(
    "SELECT trade_id, round(day_pnl, 6) + 0.0 AS day_pnl, round(greatest(max(day_pnl) OVER w, 0), 6) + 0.0 AS day_peak, CAST(sum(CASE WHEN realized_r < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY instrument, day, wins ORDER BY ts_out_ms, trade_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS loss_streak FROM (SELECT *, sum(realized_r) OVER w AS day_pnl, sum(CASE WHEN realized_r >= 0 THEN 1 ELSE 0 END) OVER w AS wins FROM (SELECT *, ts_out_ms // 86400000 AS day FROM ledger) WINDOW w AS (PARTITION BY instrument, day ORDER BY ts_out_ms, trade_id ROWS UNBOUNDED PRECEDING)) WINDOW w AS (PARTITION BY instrument, day ORDER BY ts_out_ms, trade_id ROWS UNBOUNDED PRECEDING)",
    A.LEDGER,
)
def t20_day_state(spark: SparkSession, d: str) -> DataFrame:
    return L.streaks(A.ledger(spark, d), ["trade_id"]).select("trade_id", r6("day_pnl"), r6("day_peak"), "loss_streak")


@P.add("SELECT trade_id, model_id, kind, oos_auc FROM ledger LEFT JOIN model_metrics USING (model_id)", A.LEDGER, A.METRICS)
def j3_j20_trade_metrics(spark: SparkSession, d: str) -> DataFrame:
    return A.ledger(spark, d).join(A.model_metrics(spark, d), "model_id", "left").select("trade_id", "model_id", "kind", "oos_auc")


@P.add("SELECT model_id, run_id, kind FROM (SELECT *, max(run_id) OVER (PARTITION BY kind) AS newest FROM model_metrics) WHERE run_id = newest", A.METRICS)
def j11_latest_run(spark: SparkSession, d: str) -> DataFrame:
    m = A.model_metrics(spark, d)
    return m.join(m.groupBy("kind").agg(F.max("run_id").alias("run_id")), ["kind", "run_id"], "left_semi").select("model_id", "run_id", "kind")


@P.add("SELECT trade_id FROM ledger WHERE NOT EXISTS (SELECT 1 FROM model_metrics m WHERE m.model_id = ledger.model_id AND m.n_trades >= 100)", A.LEDGER, A.METRICS)
def j13_not_sealed(spark: SparkSession, d: str) -> DataFrame:
    return A.ledger(spark, d).join(A.model_metrics(spark, d).where("n_trades >= 100"), "model_id", "left_anti").select("trade_id")


FLOORS = {"oos_auc": (">=", 0.3), "sortino": (">=", 0.2), "max_dd_bp": ("<=", 600.0), "n_trades": (">=", 20)}


@P.add(
    "SELECT model_id, concat_ws(';', " + ", ".join(f"CASE WHEN NOT ({n} {op} {v}) THEN '{n}' END" for n, (op, v) in FLOORS.items()) + ") AS blocked, " + " AND ".join(f"{n} {op} {v}" for n, (op, v) in FLOORS.items()) + " AS passed FROM model_metrics",
    A.METRICS,
)
def p16_p18_gate(spark: SparkSession, d: str) -> DataFrame:
    fails = [F.when(~(F.col(n) >= v if op == ">=" else F.col(n) <= v), n) for n, (op, v) in FLOORS.items()]
    reasons = F.array_compact(F.array(*fails))
    return A.model_metrics(spark, d).select("model_id", F.array_join(reasons, ";").alias("blocked"), (F.size(reasons) == 0).alias("passed"))


OWN_FLOORS = {"oos_auc": 0.4, "oos_log_loss": 0.5, "fine_tune_max_dd_bp": 300.0}
GATED = "gated AS (SELECT model_id, oos_auc, oos_log_loss, round(least(1.0, 0.2 + oos_auc), 6) AS oos_balanced_acc, sortino AS fine_tune_sortino, max_dd_bp AS fine_tune_max_dd_bp FROM model_metrics)"


@P.add(
    " UNION ALL ".join(f"SELECT model_id, '{n}' AS name, round(CAST({n} AS DOUBLE), 6) + 0.0 AS actual, f AS floor, '{way}' AS direction, {n} {'>=' if way == 'ge' else '<='} f AS passed, round({'' if way == 'ge' else '-'}({n} - f) / f, 9) + 0.0 AS fraction_over FROM (SELECT *, CASE WHEN model_id % 3 = 0 THEN {OWN_FLOORS.get(n, v)}::DOUBLE ELSE {v}::DOUBLE END AS f FROM gated)" for n, (way, v, _) in L.GATE_FLOORS.items()),
    A.METRICS, GATED,
)
def p17_floor_rows(spark: SparkSession, d: str) -> DataFrame:
    """A third of the models has floors of its own, beside a flag, and a third JSON that can't be read."""
    turn, named = F.col("model_id") % 3, {L.GATE_FLOORS[n][2]: v for n, v in OWN_FLOORS.items()}
    models = A.model_metrics(spark, d).withColumns({"oos_balanced_acc": F.round(F.least(F.lit(1.0), 0.2 + F.col("oos_auc")), 6), "fine_tune_sortino": F.col("sortino"), "fine_tune_max_dd_bp": F.col("max_dd_bp")})
    models = models.withColumn("given", F.when(turn == 0, json.dumps(named | {"require_lockbox_pass": True})).when(turn == 1, "{no json"))
    rows = L.floor_rows(models, "model_id", given="given")
    return rows.select("model_id", "name", r6("actual"), "floor", "direction", "passed", r6("fraction_over", digits=9))


@P.add("SELECT model_id, kind, run_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY oos_log_loss, model_id) AS k FROM model_metrics) WHERE k = 1", A.METRICS)
def t17_winner_per_run(spark: SparkSession, d: str) -> DataFrame:
    best = A.model_metrics(spark, d).groupBy("run_id").agg(F.min_by(F.struct("model_id", "kind"), F.struct("oos_log_loss", "model_id")).alias("w"))
    return best.select("w.model_id", "w.kind", "run_id")


@P.add("SELECT trial_id, round(score, 9) + 0.0 AS score FROM (SELECT trial_id, sortino - 0.5 * max_dd_bp / 1000 - 0.25 * turnover AS score FROM trials)", A.TRIALS)
def a32_trial_score(spark: SparkSession, d: str) -> DataFrame:
    return A.trials(spark, d).select("trial_id", r6(F.col("sortino") - 0.5 * F.col("max_dd_bp") / 1000 - 0.25 * F.col("turnover"), "score", 9))


@P.add("SELECT trial_id, pareto_rank FROM trials ORDER BY CASE WHEN pareto_rank > 0 THEN pareto_rank END NULLS LAST, sortino DESC, trial_id LIMIT 20", A.TRIALS)
def t15_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return A.trials(spark, d).orderBy(F.asc_nulls_last(F.when(F.col("pareto_rank") > 0, F.col("pareto_rank"))), F.desc("sortino"), "trial_id").limit(20).select("trial_id", "pareto_rank")


@P.add("SELECT trial_id FROM trials a WHERE NOT EXISTS (SELECT 1 FROM trials b WHERE b.sortino >= a.sortino AND b.max_dd_bp <= a.max_dd_bp AND b.turnover <= a.turnover AND (b.sortino > a.sortino OR b.max_dd_bp < a.max_dd_bp OR b.turnover < a.turnover))", A.TRIALS)
def t16_pareto(spark: SparkSession, d: str) -> DataFrame:
    return L.pareto(A.trials(spark, d), ["sortino"], ["max_dd_bp", "turnover"]).select("trial_id")


@P.add("SELECT trial_id FROM trials a WHERE NOT EXISTS (SELECT 1 FROM trials b WHERE b.sortino >= a.sortino AND b.max_dd_bp <= a.max_dd_bp AND b.turnover <= a.turnover AND (b.sortino > a.sortino OR b.max_dd_bp < a.max_dd_bp OR b.turnover < a.turnover)) ORDER BY n_trades >= 3 DESC, sortino DESC, trial_id LIMIT 1", A.TRIALS)
def t16_choice(spark: SparkSession, d: str) -> DataFrame:
    return L.chosen(L.pareto(A.trials(spark, d), ["sortino"], ["max_dd_bp", "turnover"]), "trial_id")


AUC = "SELECT fold, round(CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) ELSE 0.5 END, 6) AS auc FROM (SELECT *, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2 AS rk FROM classified) GROUP BY fold"


@P.add(AUC, A.CLASSIFIED)
def a19_auc(spark: SparkSession, d: str) -> DataFrame:
    return stats.auc(A.classified(spark, d), "y", "p", ["fold"]).select("fold", r6("auc"))


@P.add(
    "SELECT fold, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier, round((coalesce(avg(CASE WHEN y = 0 THEN CAST((p >= 0.5) = (y = 1) AS DOUBLE) END), 0.5) + coalesce(avg(CASE WHEN y = 1 THEN CAST((p >= 0.5) = (y = 1) AS DOUBLE) END), 0.5)) / 2, 6) AS balanced, round(avg(-(q * ln(q) + (1 - q) * ln(1 - q))), 6) AS entropy FROM (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM classified) GROUP BY fold",
    A.CLASSIFIED,
)
def a19_a20_a28_scores(spark: SparkSession, d: str) -> DataFrame:
    y, p = F.col("y"), F.col("p")
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return A.classified(spark, d).groupBy("fold").agg(r6(stats.log_loss(y, p), "log_loss"), r6(stats.brier(y, p), "brier"), r6(stats.balanced_accuracy(y, p), "balanced"), r6(F.avg(-(q * F.log(q) + (1 - q) * F.log(1 - q))), "entropy"))


@P.add("SELECT doc_id, round(coalesce(p, 0.5), 6) AS p FROM documents LEFT JOIN (SELECT doc_id, avg(p) AS p FROM classified GROUP BY 1) USING (doc_id)", A.CLASSIFIED)
def j2_a30_mean_oof(spark: SparkSession, d: str) -> DataFrame:
    oof = A.classified(spark, d).groupBy("doc_id").agg(F.avg("p").alias("p"))
    return A.table(spark, d, "documents").select("doc_id").join(oof, "doc_id", "left").select("doc_id", r6(F.coalesce("p", F.lit(0.5)), "p"))


DEPTH_MID = 100.003  # no level is just 10 basis points from it


@P.add(
    f"SELECT vec_id, round((b1 - a1) / (b1 + a1), 6) + 0.0 AS ob_imbalance, round(((bw + aw) / (bs + asz) - {DEPTH_MID}::DOUBLE) / {DEPTH_MID}::DOUBLE * 1e4, 6) + 0.0 AS ob_weighted_mid_bp, round(bmax / bavg, 6) AS ob_bid_wall, round(amax / aavg, 6) AS ob_ask_wall, round(near, 6) AS ob_size_10bp, round(wide, 6) AS ob_size_50bp FROM (SELECT vec_id, sum(size) FILTER (side = 'bid' AND lvl = 1) AS b1, sum(size) FILTER (side = 'ask' AND lvl = 1) AS a1, sum(price * size) FILTER (side = 'bid' AND lvl <= 10) AS bw, sum(price * size) FILTER (side = 'ask' AND lvl <= 10) AS aw, sum(size) FILTER (side = 'bid' AND lvl <= 10) AS bs, sum(size) FILTER (side = 'ask' AND lvl <= 10) AS asz, max(size) FILTER (side = 'bid' AND lvl <= 20) AS bmax, avg(size) FILTER (side = 'bid' AND lvl <= 20) AS bavg, max(size) FILTER (side = 'ask' AND lvl <= 20) AS amax, avg(size) FILTER (side = 'ask' AND lvl <= 20) AS aavg, sum(size) FILTER (abs(price / {DEPTH_MID}::DOUBLE - 1) * 1e4 <= 10) AS near, sum(size) FILTER (abs(price / {DEPTH_MID}::DOUBLE - 1) * 1e4 <= 50) AS wide FROM levels GROUP BY 1)",
    A.LEVELS,
)
def a17_depth_features(spark: SparkSession, d: str) -> DataFrame:
    return depth_features(A.depth_books(spark, d), F.lit(DEPTH_MID)).select("vec_id", *(r6(c) for c in BOOK))


def crowd_sql(price: str, near: float, mid: float) -> dict[str, str]:
    """The crowd's values as SQL aggregates over buckets."""
    at = lambda f: f"price BETWEEN {price} * (1 - {f}) AND {price} * (1 + {f})"
    side = lambda f, x: f"coalesce({f}({x[0]}) FILTER ({at(mid)} AND price {x[1]} {price}), 0)"
    bid, ask = ("long", "<"), ("short", ">=")
    return {
        "imbalance_near": f"coalesce(sum(long - short) FILTER ({at(near)}), 0)", "imbalance_mid": f"coalesce(sum(long - short) FILTER ({at(mid)}), 0)",
        "bid_wall": side("max", bid), "ask_wall": side("max", ask), "bid_depth": side("sum", bid), "ask_depth": side("sum", ask), "depth_ratio": f"{side('sum', bid)} / greatest({side('sum', ask)}, 1e-10)",
        "long_total": "sum(long)", "short_total": "sum(short)", "net_total": "sum(long - short)", "ratio_total": "sum(long) / greatest(sum(short), 1e-10)",
    }


RATIOS = ("depth_ratio", "ratio_total")
AT_100 = ", ".join(f"round({f'ln(1 + {e})' if c in RATIOS else e}, 6) + 0.0 AS {c}" for c, e in crowd_sql("100.0", *crowd.RANGES["pb"]).items())


def crowd_rounded(*prefixes: str) -> list:
    """Ratios are given by their logarithm, since those to nothing are very large."""
    names = [(f"{p}{c}", c in RATIOS) for p in prefixes for c in crowd.CROWD]
    return [r6(F.log1p(n) if ratio else F.col(n), n) for n, ratio in names]


@P.add(f"SELECT vec_id, {AT_100} FROM crowd GROUP BY 1", A.CROWD)
def a16_crowd_features(spark: SparkSession, d: str) -> DataFrame:
    """The eleven values of each book, at a price of 100."""
    return crowd.crowd_features(A.crowd_books(spark, d), F.lit(100.0), *crowd.RANGES["pb"]).select("vec_id", *crowd_rounded(""))


@P.add("SELECT event_id, user_id, changed FROM (SELECT event_id, user_id, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS changed FROM events) WHERE changed")
def t34_change_only(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return A.table(spark, d, "events").select("event_id", "user_id", (~F.col("event_type").eqNullSafe(before)).alias("changed")).where("changed")
