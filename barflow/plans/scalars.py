"""Queries on scalar functions, predicates, joins of run records, newest rows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import adapters as A
from ..functions import names as N
from ..operators import ledger as L
from ..operators.asof import asof_join
from ..operators.bars import latest_n, latest_row
from ..operators.quantiles import exact_quantiles
from ..operators.rolling import number_rows
from ..models.selection import feature_scores, top_features
from .base import Plans, r6
from .market import NUM

P = Plans()


@P.add("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) ELSE 0 END AS safe_log, CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE 1 END AS side, json_object('bal', round(c_acctbal / 7, 5)) AS feature, CASE WHEN c_mktsegment LIKE 'side\\_%' ESCAPE '\\' THEN split_part(c_mktsegment, '_', 2) ELSE c_mktsegment END AS no_kind, 'unknown' AS other_kind, 'm' || (c_custkey % 4) AS kind FROM customer")
def p6_p9_p12_p15_projections(spark: SparkSession, d: str) -> DataFrame:
    c, x = A.table(spark, d, "customer"), F.col("c_acctbal")
    legacy = F.when(F.col("c_custkey") % 3 == 0, 0).otherwise(1)
    model = F.concat(F.lit("side_m"), (F.col("c_custkey") % 4).cast("string"), F.lit("_v1"))
    bal = F.round(x / 7, 5)
    feature = F.concat(F.lit('{"bal":'), N.json_number(F.when((bal == 0) & (x < 0), F.lit(-0.0)).otherwise(bal), 5), F.lit("}"))  # a loss that rounds to nothing keeps its sign
    return c.select("c_custkey", F.when(x > 0, F.round(F.log(x), 6)).otherwise(0.0).alias("safe_log"), F.when(legacy == 0, -1).otherwise(legacy).alias("side"), feature.alias("feature"), N.model_kind(F.col("c_mktsegment")).alias("no_kind"), N.model_kind(F.col("c_mktsegment"), "unknown").alias("other_kind"), N.model_kind(model).alias("kind"))


@P.add("SELECT event_id, CAST(CASE action WHEN 'open_long' THEN 5 WHEN 'open_short' THEN -5 WHEN 'close' THEN -(event_id % 3) ELSE 0 END AS BIGINT) AS delta, CASE reason WHEN 'purchase' THEN 'Bought' WHEN 'signup' THEN 'Joined' ELSE reason END AS label, CASE WHEN event_id % 2 = 0 THEN price / 128 ELSE -price / 128 END AS signed_confidence FROM decisions", A.DECISIONS)
def p14_f13_f17_decision_columns(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.positions import unit_delta

    c = F.col("price") / 128
    side = F.when(F.col("event_id") % 2 == 0, "long").otherwise("short")
    return A.decisions(spark, d).select("event_id", unit_delta(F.col("action"), 5, F.col("event_id") % 3).cast("long").alias("delta"), N.labelled(F.col("reason"), {"purchase": "Bought", "signup": "Joined"}).alias("label"), N.signed_confidence(side, c).alias("signed_confidence"))


@P.add("SELECT p_partkey, len(w) AS n_parts, w[1] AS first_part, w[-1] AS last_part FROM (SELECT p_partkey, list_filter(list_transform(string_split(replace(p_name, ' ', ' ; ;'), ';'), lambda x: trim(x)), lambda x: x <> '') AS w FROM part)")
def p19_reason_parts(spark: SparkSession, d: str) -> DataFrame:
    w = N.parts(F.replace(F.col("p_name"), F.lit(" "), F.lit(" ; ;")))
    return A.table(spark, d, "part").select("p_partkey", w.alias("w")).select("p_partkey", F.size("w").cast("long").alias("n_parts"), F.element_at("w", 1).alias("first_part"), F.element_at("w", -1).alias("last_part"))


@P.add("SELECT event_id, CASE WHEN bp > 40 THEN 'spread' WHEN user_id % 50 > 45 THEN 'stale' WHEN pnl <= -20 THEN 'daily_loss' WHEN 10 - pnl >= 25 THEN 'drawdown' END AS block, CASE WHEN greatest(pl, 1 - pl) >= 0.6 AND abs(2 * pl - 1) >= 0.25 AND pl > 0.5 AND pl >= 0.65 THEN 1 WHEN greatest(pl, 1 - pl) >= 0.6 AND abs(2 * pl - 1) >= 0.25 AND pl < 0.5 AND 1 - pl >= 0.7 THEN -1 ELSE 0 END AS side FROM (SELECT event_id, user_id, (ask - bid) / mid * 1e4 AS bp, mid - 102.005 AS pnl, (event_id % 97) / 97 AS pl FROM ticks)", A.TICKS)
def p20_p21_predicates(spark: SparkSession, d: str) -> DataFrame:
    bp, pl = (F.col("ask") - F.col("bid")) / F.col("mid") * 1e4, (F.col("event_id") % 97) / 97
    block = N.risk_block(bp, F.col("user_id") % 50, F.col("mid") - 102.005, F.lit(10.0), 40, 45, 20, 25)
    return A.ticks(spark, d).select("event_id", block.alias("block"), N.entry_side(pl, 1 - pl, 0.6, 0.25, 0.65, 0.7).alias("side"))


@P.add("SELECT c_custkey, CASE WHEN regexp_matches(replace(upper(substr(c_mktsegment, 1, 6)), ' ', ''), '^[A-Z]{6}$') THEN upper(substr(c_mktsegment, 1, 3)) || '_' || upper(substr(c_mktsegment, 4, 3)) ELSE replace(upper(substr(c_mktsegment, 1, 6)), ' ', '') END AS name, CASE WHEN length(c_name) > 8 THEN substr(c_name, 1, 8) || '…' ELSE c_name END AS short, 'lt=' || printf('%.2f', (c_custkey % 7 + 1) / 10.0) || ' st=' || printf('%.0f', c_custkey + 10.0) || ' tt=' || CASE WHEN c_custkey % 97 + 0.25 >= 100 THEN printf('%.0f', c_custkey % 97 + 0.25) WHEN c_custkey % 97 + 0.25 >= 10 THEN printf('%.1f', c_custkey % 97 + 0.3) ELSE printf('%.2f', c_custkey % 97 + 0.25) END || ' ml=' || printf('%.0f', c_custkey % 89 + 100.25) AS snippet FROM customer")
def f9_f10_f12_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return A.table(spark, d, "customer").select("c_custkey", N.normal_instrument(F.concat(F.lit(" "), F.lower(F.substring("c_mktsegment", 1, 3)), F.lit(" "), F.lower(F.substring("c_mktsegment", 4, 3)))).alias("name"), N.short_id(F.col("c_name")).alias("short"), N.snippet({"lt": ((k % 7 + 1) / 10), "st": (k + 10).cast("double"), "tt": F.when(k % 97 < 10, k % 97 + 0.25).otherwise(k % 97 + 0.3), "ml": k % 89 + 100.25}).alias("snippet"))


@P.add("SELECT event_id, ts_ms // 86400000 AS day, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day_key, strftime(make_timestamp(ts_ms * 1000), '%Y%m%d_%H') AS hour_key, CAST(ts_ms % 86400000 // 60000 AS BIGINT) AS minute_of_day FROM ticks", A.TICKS)
def f4_f5_f6_time_keys(spark: SparkSession, d: str) -> DataFrame:
    at = F.timestamp_millis("ts_ms")
    return A.ticks(spark, d).select("event_id", F.expr("ts_ms div 86400000").alias("day"), F.date_format(at, "yyyy-MM-dd").alias("day_key"), F.date_format(at, "yyyyMMdd_HH").alias("hour_key"), F.expr("pmod(ts_ms, 86400000) div 60000").alias("minute_of_day"))


@P.add("SELECT event_id, CAST(coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS BIGINT) AS k, json_extract_string(props, '$.none') AS missing, coalesce(json_extract_string(props, '$.none'), 'default') AS filled FROM events")
def f11_json_fields(spark: SparkSession, d: str) -> DataFrame:
    f = F.from_json("props", "k long, none string")
    return A.table(spark, d, "events").select("event_id", F.coalesce(f["k"], F.lit(0).cast("long")).alias("k"), f["none"].alias("missing"), F.coalesce(f["none"], F.lit("default")).alias("filled"))


@P.add("SELECT CAST(user_id AS VARCHAR) AS instrument, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def f15_reason_histogram(spark: SparkSession, d: str) -> DataFrame:
    counts = A.decisions(spark, d).groupBy("instrument", "reason").agg(F.count("*").alias("n"))
    hist = counts.groupBy("instrument").agg(F.map_from_entries(F.collect_list(F.struct("reason", "n"))).alias("h"))
    total = F.aggregate(F.map_values("h"), F.lit(0).cast("long"), lambda a, x: a + x)
    return hist.select("instrument", F.coalesce(F.col("h")["click"], F.lit(0).cast("long")).alias("clicks"), total.alias("n"), F.size("h").cast("long").alias("kinds"))


RUNS = "runs AS (SELECT o_orderkey AS run_id, o_orderpriority AS command, o_custkey % 5 AS instrument, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'ok' ELSE 'failed' END AS status, epoch_us(o_orderdate) // 1000 AS started, CASE WHEN o_orderstatus <> 'O' THEN CAST(floor(o_totalprice) AS BIGINT) END AS elapsed FROM orders)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    o, s = A.table(spark, d, "orders"), F.col("o_orderstatus")
    status = F.when(s == "O", "running").when(s == "F", "ok").otherwise("failed")
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("command"), (F.col("o_custkey") % 5).alias("instrument"), status.alias("status"), A.millis(F.col("o_orderdate")).alias("started"), F.when(s != "O", F.floor("o_totalprice").cast("long")).alias("elapsed"))


@P.add("SELECT command, count(*) AS n, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'failed') AS failed, max(run_id) FILTER (status = 'running' AND started = m) AS newest_running, max(started) FILTER (status = 'ok') AS last_ok, CAST(sum(coalesce(elapsed, greatest(0, 900000000000 - started))) AS BIGINT) AS elapsed FROM runs JOIN (SELECT command, max(started) FILTER (status = 'running') AS m FROM runs GROUP BY 1) USING (command) GROUP BY 1", RUNS)
def a11_f16_run_summary(spark: SparkSession, d: str) -> DataFrame:
    going = F.col("status") == "running"
    live = F.coalesce("elapsed", F.greatest(F.lit(0), F.lit(900000000000) - F.col("started")))
    return _runs(spark, d).groupBy("command").agg(F.count("*").alias("n"), F.count_if(going).alias("running"), F.count_if(F.col("status") == "failed").alias("failed"), F.max_by("run_id", F.when(going, F.struct("started", "run_id"))).alias("newest_running"), F.max(F.when(F.col("status") == "ok", F.col("started"))).alias("last_ok"), F.sum(live).alias("elapsed"))


@P.add("SELECT instrument, CAST(n AS BIGINT) AS n, round((n - 1) / ((hi - lo) / 1000), 6) AS rate, round(n / ((hi - lo) / 1000), 6) AS rate_all FROM (SELECT instrument, count(*) AS n, max(ts_ms) AS hi, min(ts_ms) AS lo FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts_ms DESC, event_id DESC) AS k FROM ticks) WHERE k <= 60 GROUP BY 1)", A.TICKS)
def a29_tick_rate(spark: SparkSession, d: str) -> DataFrame:
    span = (F.max("ts_ms") - F.min("ts_ms")) / 1000
    return latest_n(A.ticks(spark, d), 60, ["instrument"], ["ts_ms", "event_id"]).groupBy("instrument").agg(F.count("*").alias("n"), r6(F.when(span > 0, (F.count("*") - 1) / span).otherwise(0.0), "rate"), r6(F.when(span > 0, F.count("*") / span).otherwise(0.0), "rate_all"))


CELLS = "cells AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, len(embedding) + 1) t(i))"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.col("v").cast("double").alias("v"))


@P.add("SELECT i, round(avg(v), 6) + 0.0 AS mean, round(greatest(stddev_pop(v), 1e-12), 6) AS sd, var_pop(v) > 1e-8 AS varies FROM cells GROUP BY 1", CELLS)
def a33_feature_moments(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).groupBy("i").agg(r6(F.avg("v"), "mean"), r6(F.greatest(F.stddev_pop("v"), F.lit(1e-12)), "sd"), (F.var_pop("v") > 1e-8).alias("varies"))


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SCORES = (
    "long AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS v, l_returnflag AS y FROM lineitem" for f in FEATURES) + "), "
    "ends AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM long GROUP BY 1), "
    "hist AS (SELECT feature, least(31, floor((v - lo) / (hi - lo) * 32)) AS bin, y, count(*) AS n FROM long JOIN ends USING (feature) GROUP BY ALL), "
    "joint AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS total, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, y) AS ny FROM hist)"
)


@P.add("SELECT feature, round(score, 9) + 0.0 AS score, row_number() OVER (ORDER BY score DESC, feature) AS rank, row_number() OVER (ORDER BY score DESC, feature) <= 2 AS chosen FROM (SELECT feature, sum(n / total * ln(n * total / (nb * ny))) AS score FROM joint GROUP BY feature)", SCORES)
def a33_feature_scores(spark: SparkSession, d: str) -> DataFrame:
    """What figures of an order line tell of its return flag."""
    scores = feature_scores(A.table(spark, d, "lineitem"), FEATURES, "l_returnflag")
    return top_features(scores, 2).select("feature", r6("score", digits=9), "rank", "chosen")


@P.add("SELECT i, round(min(v), 6) AS least, round(max(v), 6) AS most, round(quantile_cont(v, 0.05) FILTER (abs(v) > 1e-9), 6) AS p5, round(quantile_cont(v, 0.5) FILTER (abs(v) > 1e-9), 6) AS p50, round(quantile_cont(v, 0.95) FILTER (abs(v) > 1e-9), 6) AS p95 FROM cells GROUP BY 1", CELLS)
def a34_matrix_quantiles(spark: SparkSession, d: str) -> DataFrame:
    cells, at = _cells(spark, d), {f"p{q}": q / 100 for q in (5, 50, 95)}
    ends = cells.groupBy("i").agg(r6(F.min("v"), "least"), r6(F.max("v"), "most"))
    return ends.join(exact_quantiles(cells.where("abs(v) > 1e-9"), ["i"], "v", at), "i", "left").select("i", "least", "most", *(r6(q) for q in at))


@P.add("SELECT CAST(price AS DOUBLE) AS price, round(long - short, 6) + 0.0 AS net FROM crowd WHERE ts_ms = (SELECT max(ts_ms) FROM crowd)", A.CROWD)
def a36_newest_crowd(spark: SparkSession, d: str) -> DataFrame:
    newest = latest_row(A.crowd_books(spark, d).withColumn("book", F.lit("all")), ["book"], ["ts_ms"])
    return newest.select(F.explode("buckets").alias("x")).select(F.col("x.price").alias("price"), r6(F.col("x.long") - F.col("x.short"), "net"))


@P.add("SELECT round(avg(sharpe), 6) + 0.0 AS mean_sharpe, round(max(sharpe), 6) + 0.0 AS best_sharpe FROM (SELECT fold, avg(r) / stddev_samp(r) AS sharpe FROM (SELECT fold, CASE WHEN p >= 0.05 THEN 1 ELSE -1 END * (y - 0.5) * (1 + doc_id % 3) AS r FROM classified) GROUP BY fold)", A.CLASSIFIED)
def a37_fold_scores(spark: SparkSession, d: str) -> DataFrame:
    r = F.when(F.col("p") >= 0.05, 1).otherwise(-1) * (F.col("y") - 0.5) * (1 + F.col("doc_id") % 3)
    folds = A.classified(spark, d).withColumn("r", r).groupBy("fold").agg(L.sharpe("r").alias("sharpe"))
    return folds.agg(r6(F.avg("sharpe"), "mean_sharpe"), r6(F.max("sharpe"), "best_sharpe"))


@P.add("SELECT doc_id, y, n_chars FROM classified JOIN documents USING (doc_id)", A.CLASSIFIED)
def j1_labels_with_features(spark: SparkSession, d: str) -> DataFrame:
    return A.classified(spark, d).select("doc_id", "y").join(A.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")


@P.add("SELECT coalesce(a.ts_ms, b.ts_ms) AS ts_ms, round(a.close, 6) AS click, round(b.close, 6) AS purchase FROM (SELECT * FROM bars WHERE instrument = 'click') a FULL JOIN (SELECT * FROM bars WHERE instrument = 'purchase') b ON a.ts_ms = b.ts_ms", A.BARS)
def j9_concat_columns(spark: SparkSession, d: str) -> DataFrame:
    one = lambda name: A.bars(spark, d).where(F.col("instrument") == name).select("ts_ms", r6("close", name))
    return one("click").join(one("purchase"), "ts_ms", "full")


@P.add("SELECT instrument, count(*) AS shed FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts_ms DESC, event_id DESC) AS k FROM ticks) WHERE k > 100 GROUP BY 1", A.TICKS)
def j12_capped_delete(spark: SparkSession, d: str) -> DataFrame:
    t = A.ticks(spark, d).select("instrument", "ts_ms", "event_id")
    return t.join(latest_n(t, 100, ["instrument"], ["ts_ms", "event_id"]), "event_id", "left_anti").groupBy("instrument").agg(F.count("*").alias("shed"))


@P.add("SELECT r.run_id, r.command, m.n AS n_models, round(m.best, 6) AS best_auc, round(l.cum, 6) + 0.0 AS cum_r FROM (SELECT instrument, last(run_id ORDER BY started, run_id) AS run_id, last(command ORDER BY started, run_id) AS command FROM runs WHERE status = 'ok' GROUP BY 1) r LEFT JOIN (SELECT run_id % 5 AS instrument, count(*) AS n, max(oos_auc) AS best FROM model_metrics GROUP BY 1) m ON m.instrument = r.instrument LEFT JOIN (SELECT model_id % 5 AS instrument, sum(realized_r) AS cum FROM ledger GROUP BY 1) l ON l.instrument = r.instrument", RUNS, A.METRICS, A.LEDGER)
def j14_j17_run_record(spark: SparkSession, d: str) -> DataFrame:
    """The newest finished run of each instrument with its models and trades; sides are aggregated first, so joins are of a row each."""
    newest = latest_row(_runs(spark, d).where("status = 'ok'").select("instrument", "run_id", "command", "started"), ["instrument"], ["started", "run_id"])
    models = A.model_metrics(spark, d).groupBy((F.col("run_id") % 5).alias("instrument")).agg(F.count("*").alias("n_models"), F.max("oos_auc").alias("best_auc"))
    trades = A.ledger(spark, d).groupBy((F.col("model_id") % 5).alias("instrument")).agg(F.sum("realized_r").alias("cum_r"))
    return newest.join(models, "instrument", "left").join(trades, "instrument", "left").select("run_id", "command", "n_models", r6("best_auc"), r6("cum_r"))


@P.add("SELECT e.instrument, e.rn AS entry, count(*) FILTER (f.rn < e.rn) AS n_before, count(*) FILTER (f.rn BETWEEN e.rn AND e.rn + 5) AS n_inside, count(*) FILTER (f.rn > e.rn + 5) AS n_after, round(max(f.close), 6) AS top FROM b e JOIN b f ON e.instrument = f.instrument AND f.rn BETWEEN e.rn - 50 AND e.rn + 15 GROUP BY 1, 2", NUM)
def j15_trade_context(spark: SparkSession, d: str) -> DataFrame:
    """50 bars before a trade's entry, those inside and 10 after its exit: an equi-join on blocks of bars."""
    width, rows = 66, number_rows(A.bars(spark, d), ["instrument"]).select("instrument", "rn", "close")
    trades = rows.select("instrument", F.col("rn").alias("entry"), (F.col("rn") + 5).alias("exit"))
    block = lambda c: F.floor(c / width)
    near = trades.withColumn("block", F.explode(F.sequence(block(F.col("entry") - 50), block(F.col("exit") + 10))))
    met = near.join(rows.withColumn("block", block(F.col("rn"))), ["instrument", "block"]).where(F.col("rn").between(F.col("entry") - 50, F.col("exit") + 10))
    return met.groupBy("instrument", "entry").agg(F.count_if(F.col("rn") < F.col("entry")).alias("n_before"), F.count_if(F.col("rn").between(F.col("entry"), F.col("exit"))).alias("n_inside"), F.count_if(F.col("rn") > F.col("exit")).alias("n_after"), r6(F.max("close"), "top"))


@P.add("SELECT instrument, ts_ms, event_id FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts_ms DESC) AS k FROM (SELECT instrument, ts_ms, event_id FROM (SELECT instrument, ts_ms, event_id, row_number() OVER (PARTITION BY instrument, ts_ms ORDER BY event_id % 2, event_id) AS j FROM ticks) WHERE j = 1)) WHERE k <= 200", A.TICKS)
def j16_history_and_live(spark: SparkSession, d: str) -> DataFrame:
    """History (even ids) wins over live rows of one time; the newest 200 stay."""
    t = A.ticks(spark, d).select("instrument", "ts_ms", "event_id")
    both = t.where("event_id % 2 = 0").withColumn("live", F.lit(0)).unionByName(t.where("event_id % 2 <> 0").withColumn("live", F.lit(1)))
    once = both.groupBy("instrument", "ts_ms").agg(F.min_by("event_id", F.struct("live", "event_id")).alias("event_id"))
    return latest_n(once, 200, ["instrument"], ["ts_ms"])


@P.add("SELECT instrument, ts_ms, side, round(price, 6) AS price FROM (SELECT l.instrument, l.ts_ms, CASE WHEN user_id % 5 < 2 THEN 1 ELSE -1 END AS side, t.rmid AS price FROM (SELECT * FROM ticks WHERE user_id % 2 = 0 AND user_id % 5 <> 4 AND ts_ms BETWEEN 1704300000000 AND 1705500000000) l ASOF LEFT JOIN (SELECT instrument, ts_ms, last(mid ORDER BY event_id) AS rmid FROM ticks WHERE user_id % 2 = 1 GROUP BY 1, 2) t ON l.instrument = t.instrument AND l.ts_ms >= t.ts_ms) WHERE price IS NOT NULL", A.TICKS)
def j19_label_markers(spark: SparkSession, d: str) -> DataFrame:
    t, k = A.ticks(spark, d), F.col("user_id") % 5
    side = F.when(k == 4, 0).when(k < 2, 1).otherwise(-1)
    labels = t.where("user_id % 2 = 0").withColumn("side", side).where((F.col("side") != 0) & F.col("ts_ms").between(1704300000000, 1705500000000)).select("instrument", "ts_ms", "event_id", "side")
    prices = t.where("user_id % 2 = 1").select("instrument", "ts_ms", "event_id", F.col("mid").alias("price"))
    return asof_join(labels, prices, ["instrument"], ["price"], tie=["event_id"]).where("price IS NOT NULL").select("instrument", "ts_ms", "side", r6("price"))


@P.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def o1_o4_o7_newest(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20).select("o_orderkey", "o_totalprice").orderBy("o_orderkey")


@P.add("SELECT study_id, trial_id, sortino FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY trial_id DESC) AS k FROM trials) WHERE k <= 5", A.TRIALS)
def o5_newest_of_each_study(spark: SparkSession, d: str) -> DataFrame:
    return latest_n(A.trials(spark, d), 5, ["study_id"], ["trial_id"]).select("study_id", "trial_id", "sortino")


@P.add("SELECT 'both' AS part, count(*) AS n FROM (SELECT ts_ms FROM bars WHERE instrument = 'click' INTERSECT SELECT ts_ms FROM bars WHERE instrument = 'view') UNION ALL SELECT 'either', count(*) FROM (SELECT ts_ms FROM bars WHERE instrument = 'click' UNION SELECT ts_ms FROM bars WHERE instrument = 'view') UNION ALL SELECT 'only', count(*) FROM (SELECT ts_ms FROM bars WHERE instrument = 'click' EXCEPT SELECT ts_ms FROM bars WHERE instrument = 'view') UNION ALL SELECT 'all', count(*) FROM bars WHERE instrument IN ('click', 'view')", A.BARS)
def u1_u5_time_sets(spark: SparkSession, d: str) -> DataFrame:
    a, b = (A.bars(spark, d).where(F.col("instrument") == n).select("ts_ms") for n in ("click", "view"))
    sets = {"both": a.intersect(b), "either": a.union(b).distinct(), "only": a.subtract(b), "all": a.unionByName(b)}
    out = None
    for name, s in sets.items():
        one = s.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@P.add("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY instrument, ts_ms ORDER BY event_id) AS k FROM ticks) WHERE k = 1", A.TICKS)
def t35_first_of_each_time(spark: SparkSession, d: str) -> DataFrame:
    return A.ticks(spark, d).groupBy("instrument", "ts_ms").agg(F.min("event_id").alias("event_id")).select("event_id")


@P.add("SELECT vec_id, CASE WHEN (SELECT min(vec_id * 60000) FROM embeddings) + 7200000 > 1800000 THEN vec_id * 60000 + 7200000 - 3600000 ELSE vec_id * 60000 + 7200000 END AS ts_ms FROM embeddings")
def t36_future_skew(spark: SparkSession, d: str) -> DataFrame:
    """Books are an hour back if the first is over 30 minutes ahead of the grid, which starts at 0."""
    books = A.crowd_books(spark, d).select("vec_id", (F.col("ts_ms") + 7_200_000).alias("ts_ms"))
    first = F.broadcast(books.agg(F.min("ts_ms").alias("first")))  # one row
    return books.crossJoin(first).select("vec_id", F.when(F.col("first") > 1_800_000, F.col("ts_ms") - 3_600_000).otherwise(F.col("ts_ms")).alias("ts_ms"))


@P.add("SELECT instrument, ts_out_ms, trade_id, round(side * (exit_px / entry_px - 1) * 1e4 - (0.5 + 2 * (0.3 + 0.2)), 6) + 0.0 AS net_bp FROM ledger", A.LEDGER)
def t24_net_of_costs(spark: SparkSession, d: str) -> DataFrame:
    gross = F.col("side") * (F.col("exit_px") / F.col("entry_px") - 1) * 1e4
    return A.ledger(spark, d).select("instrument", "ts_out_ms", "trade_id", r6(gross - (0.5 + 2 * (0.3 + 0.2)), "net_bp"))


@P.add("SELECT instrument, params_id FROM (SELECT DISTINCT instrument FROM bars), range(12) p(params_id)", A.BARS)
def j18_grid(spark: SparkSession, d: str) -> DataFrame:
    """Instruments with every parameter set: a grid that the parameters bound."""
    grid = spark.range(12).withColumnRenamed("id", "params_id")
    return A.bars(spark, d).select("instrument").distinct().crossJoin(F.broadcast(grid))


@P.add("SELECT trade_id, exit_reason, instrument, ts_out_ms, realized_r + 0.0 AS realized_r, oos_auc FROM (SELECT l.*, m.oos_auc FROM ledger l LEFT JOIN model_metrics m ON l.model_id = m.model_id WHERE ts_out_ms BETWEEN 700000000000 AND 850000000000 ORDER BY ts_out_ms DESC, trade_id LIMIT 500)", A.LEDGER, A.METRICS)
def k3_export_trades(spark: SparkSession, d: str) -> DataFrame:
    from ..sinks.tables import trades_for_export

    return trades_for_export(A.ledger(spark, d), A.model_metrics(spark, d), 700_000_000_000, 850_000_000_000, 500, tie=["trade_id"]).select("trade_id", "exit_reason", "instrument", "ts_out_ms", (F.col("realized_r") + F.lit(0.0)).alias("realized_r"), "oos_auc")
