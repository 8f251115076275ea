"""Trades: rollups, curves, statistics, pairing of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from ..storage import kept
from .rolling import running
from .skyline import skyline

R = "realized_r"


def rollup_columns(r: str = R, ts: str = "ts_out_ms") -> list[Column]:
    """Counts, sums and averages of a group of closed trades (A4)."""
    x = F.col(r)
    win, loss = x > 0, x < 0
    return [
        F.count("*").alias("n_trades"), F.count_if(win).alias("wins"), F.count_if(loss).alias("losses"), F.count_if(x == 0).alias("scratched"), F.sum(x).alias("cum_r"),
        F.coalesce(F.avg(F.when(win, x)), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(F.when(loss, x)), F.lit(0.0)).alias("avg_loss"), F.avg(x).alias("expectancy"), F.max(ts).alias("last_ts"),
    ]


def trade_rollup(ledger: DataFrame, by: list[str] | None = None) -> DataFrame:
    return ledger.groupBy(*(by or ["instrument"])).agg(*rollup_columns())


def portfolio_rollup(ledger: DataFrame) -> DataFrame:
    """One row for each instrument and one, with a null instrument, for all of them."""
    return ledger.rollup("instrument").agg(*rollup_columns())


def portfolio_book(ledger: DataFrame, tie: list[str], counts: dict[str, str]) -> DataFrame:
    """
    portfolio_rollup with the newest trade's exit_reason as `newest` and a histogram, an array of (value, n), for each name in `counts`:
    of how often a column, of few distinct values, has each value (null counts as "unknown") (A5).
    """
    keys = ["whole", "instrument"]
    whole = F.grouping("instrument").alias("whole")
    out = ledger.rollup("instrument").agg(*rollup_columns(), F.max_by("exit_reason", F.struct("ts_out_ms", *tie)).alias("newest"), whole)
    for name, column in counts.items():
        of = ledger.select("instrument", F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("value"))
        each = of.groupBy("instrument", "value").agg(F.count("*").alias("n")).withColumn("whole", F.lit(0))
        total = each.groupBy("value").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("instrument"), "value", "n", F.lit(1).alias("whole"))
        bins = each.unionByName(total).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("value", "n"))).alias(name))
        same = (F.col("a.whole") == F.col("b.whole")) & F.col("a.instrument").eqNullSafe(F.col("b.instrument"))
        out = out.alias("a").join(bins.alias("b"), same, "left").select("a.*", f"b.{name}")
    return out.drop("whole")


def profit_factor(r: str = R, cap: float = 999.0) -> Column:
    x = F.col(r)
    won, lost = F.sum(F.when(x > 0, x).otherwise(0.0)), F.sum(F.when(x < 0, -x).otherwise(0.0))
    return F.when(lost > 0, F.least(won / lost, F.lit(cap))).when(won > 0, cap).otherwise(0.0)


def sharpe(r: str = R, periods: float = 1.0) -> Column:
    sd = F.stddev_samp(r)
    return F.when((F.count(r) >= 2) & (sd > 0), F.avg(r) / sd * F.sqrt(F.lit(periods))).otherwise(0.0)


def sortino(r: str = R, periods: float = 1.0, denominator: str = "all") -> Column:
    """denominator: squares of losses are divided by all rows, or by the losing ones (`losers`)."""
    x = F.col(r)
    squares, n = F.sum(F.when(x < 0, x * x).otherwise(0.0)), F.count(x) if denominator == "all" else F.count_if(x < 0)
    return F.when((F.count(x) >= 2) & (squares > 0), F.avg(x) / F.sqrt(squares / n) * F.sqrt(F.lit(periods))).otherwise(0.0)


def hit_rate(r: str = R, decided: bool = True) -> Column:
    x = F.col(r)
    n = F.count_if(x != 0) if decided else F.count(x)
    return F.when(n > 0, F.count_if(x > 0) / n).otherwise(0.0)


def curve(ledger: DataFrame, by: list[str], tie: list[str], ts: str = "ts_out_ms", start: float = 0.0, slice_ms: int = 30 * 86_400_000, r: str = R) -> DataFrame:
    """
    Adds cum_r, peak and drawdown in the order of (ts, tie): running sums and maxima inside time slices, and one row a slice that
    carries them on. start: the equity before the first trade, which is the first peak.
    """
    rows = ledger.withColumn("_slice", F.floor(F.col(ts) / slice_ms))
    inner = Window.partitionBy(*by, "_slice").orderBy(ts, *tie).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum(r).over(inner)).withColumn("_top", F.max("_sum").over(inner))
    ends = rows.groupBy(*by, "_slice").agg(F.sum(r).alias("_s"), F.max("_top").alias("_t"))
    outer = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_base", F.coalesce(F.sum("_s").over(outer), F.lit(0.0)))
    ends = ends.withColumn("_peak", F.greatest(F.coalesce(F.max(F.col("_base") + F.col("_t")).over(outer), F.lit(0.0)), F.lit(0.0)))
    out = rows.join(ends.select(*by, "_slice", "_base", "_peak"), [*by, "_slice"])
    out = out.withColumn("cum_r", F.lit(start) + F.col("_base") + F.col("_sum")).withColumn("peak", F.lit(start) + F.greatest("_peak", F.col("_base") + F.col("_top")))
    return out.withColumn("drawdown", F.col("peak") - F.col("cum_r")).drop("_slice", "_sum", "_top", "_base", "_peak")


def compounded(ledger: DataFrame, by: list[str], tie: list[str], ts: str = "ts_out_ms") -> DataFrame:
    """
    Adds equity, from 1.0 with each return reinvested, the highest equity so far, 1.0 included, and the drawdown from it in basis points
    (T14). A return of -1 or less leaves 1e-12 of the equity; a null one leaves all.
    """
    log = F.coalesce(F.when(F.col(R) > -1, F.log1p(R)).when(F.col(R) <= -1, F.log(F.lit(1e-12))), F.lit(0.0))
    out = curve(ledger.withColumn("_log", log), by, tie, ts, r="_log")
    return out.select(*ledger.columns, F.exp("cum_r").alias("equity"), F.exp("peak").alias("equity_peak"), ((1 - F.exp(-F.col("drawdown"))) * 10_000).alias("drawdown_bp"))


def trade_summary(ledger: DataFrame, by: list[str], tie: list[str], ts: str = "ts_out_ms", periods: float = 1.0) -> DataFrame:
    """
    The headline figures of each group's trades (A24). periods: trades a year, for Sharpe and Sortino. avg_loss takes trades without a gain,
    scratched ones too; elapsed time runs from the first to the last close; exposure is 0 unless the ledger has ts_in_ms.
    """
    x = F.col(R)
    won, lost = F.sum(F.when(x > 0, x).otherwise(0.0)), F.sum(F.when(x < 0, -x).otherwise(0.0))
    days = (F.max(ts) - F.min(ts)) / 86_400_000
    held = F.sum(F.col(ts) - F.col("ts_in_ms")) / 86_400_000 if "ts_in_ms" in ledger.columns else F.lit(0.0)
    sums = compounded(ledger, by, tie, ts).groupBy(*by).agg(
        F.count("*").alias("n_trades"), F.sum(x).alias("net_return"), sharpe(periods=periods).alias("sharpe"), sortino(periods=periods).alias("sortino"), F.max("drawdown_bp").alias("max_drawdown_bp"),
        hit_rate(decided=False).alias("hit_rate"), F.when(lost > 0, won / lost).when(won > 0, 1e6).otherwise(0.0).alias("profit_factor"),
        F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(F.when(x <= 0, x)), F.lit(0.0)).alias("avg_loss"), days.alias("_days"), held.alias("_held"),
    )
    per_day = lambda c: F.when(F.col("_days") > 0, F.col(c) / F.col("_days")).otherwise(0.0)
    drop = F.col("max_drawdown_bp") / 10_000
    return sums.select(
        *by, "n_trades", "net_return", "sharpe", "sortino", stats.deflated_sharpe(F.col("sharpe"), F.greatest("n_trades", F.lit(1)), F.lit(1)).alias("deflated_sharpe"), F.when(drop > 0, F.col("sharpe") / drop).otherwise(0.0).alias("calmar"),
        "max_drawdown_bp", "hit_rate", "profit_factor", "avg_win", "avg_loss", per_day("n_trades").alias("turnover_per_day"), per_day("_held").alias("exposure"), (F.col("n_trades") > 0).alias("traded"),
    )


def round_trips(decisions: DataFrame, tie: list[str], slice_ms: int = 30 * 86_400_000) -> DataFrame:
    """
    Each close with the last open before it that no other close came after (T18), and in decision_chain, as JSON, why it was opened and
    closed. Inside time slices one window finds the decision before; what a slice hands on to the next is its last decision.
    """
    keys, row = ["instrument", "_slice"], F.struct("action", "ts_ms", "price", "reason", *tie)
    acts = decisions.where("action <> 'skip'").withColumn("_slice", F.floor(F.col("ts_ms") / slice_ms))
    ends = acts.groupBy(*keys).agg(F.max_by(row, F.struct("ts_ms", *tie)).alias("_end"))
    handed = ends.select(*keys, F.lag("_end").over(Window.partitionBy("instrument").orderBy("_slice")).alias("_handed"))
    inner = Window.partitionBy(*keys).orderBy("ts_ms", *tie)
    acts = acts.withColumn("_near", F.lag(row).over(inner)).join(handed, keys).withColumn("_prev", F.coalesce("_near", "_handed"))
    trips = acts.where((F.col("action") == "close") & F.col("_prev.action").isin("open_long", "open_short"))
    side = F.when(F.col("_prev.action") == "open_long", 1).otherwise(-1)
    chain = F.to_json(F.array(F.concat(F.lit("entry:"), F.coalesce("_prev.reason", F.lit(""))), F.concat(F.lit("exit:"), F.coalesce("reason", F.lit("")))))
    return trips.select("instrument", F.col("_prev.ts_ms").alias("ts_in_ms"), F.col("ts_ms").alias("ts_out_ms"), side.alias("side"), F.col("_prev.price").alias("entry_px"), F.col("price").alias("exit_px"), (side * (F.col("price") / F.col("_prev.price") - 1)).alias(R), chain.alias("decision_chain"), *(F.col(t) for t in tie))


def compact_skips(decisions: DataFrame, tie: list[str], most: int = 100, slice_ms: int = 86_400_000) -> DataFrame:
    """
    Runs of skips, cut every `most`: instrument, first_ms, last_ms, n, and reasons as an array of (reason, n) (A15). A skip's place in its
    run is the number of skips so far less that at the last other action, both carried across time slices.
    """
    by, skip = ["instrument"], F.col("action") == "skip"
    rows = kept(running(decisions, by, "ts_ms", tie, skip.cast("long"), "sum", "_skips", slice_ms=slice_ms))
    rows = running(rows, by, "ts_ms", tie, F.when(~skip, F.col("_skips")), "max", "_run", slice_ms=slice_ms).where(skip)
    rows = rows.withColumn("_run", F.coalesce("_run", F.lit(0))).withColumn("_part", F.floor((F.col("_skips") - F.col("_run") - 1) / most))
    keys = ["instrument", "_run", "_part"]
    counts = rows.groupBy(*keys, "reason").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
    return counts.groupBy(*keys).agg(F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("reason", "n"))).alias("reasons")).drop("_run", "_part")


def pareto(trials: DataFrame, better: list[str], worse: list[str]) -> DataFrame:
    """Trials that no other is at least as good as in everything and better in something (`better`: more is better)."""
    return skyline(trials, better, worse)


def chosen(front: DataFrame, key: str, least: int = 3) -> DataFrame:
    """Of the front's trials that with the highest sortino, one of `least` trades or more if there is any; of equals, the smallest key."""
    order = F.struct((F.coalesce("n_trades", F.lit(0)) >= least), F.col("sortino"))
    best = front.groupBy().agg(F.max(order).alias("best"))
    return front.join(best, order == F.col("best")).groupBy().agg(F.min(key).alias(key)).where(F.col(key).isNotNull())


#: Measures of a model, whether they must reach or stay under their floor, its default, and its name in a model's own JSON.
GATE_FLOORS = {
    "oos_auc": ("ge", 0.55, "min_oos_auc"),
    "oos_log_loss": ("le", 0.7, "max_oos_log_loss"),
    "oos_balanced_acc": ("ge", 0.52, "min_oos_balanced_acc"),
    "fine_tune_sortino": ("ge", 0.3, "min_fine_tune_sortino"),
    "fine_tune_max_dd_bp": ("le", 1500.0, "max_fine_tune_dd_bp"),
}


def floor_rows(models: DataFrame, key: str, floors: dict[str, tuple] = GATE_FLOORS, given: str | None = None) -> DataFrame:
    """
    A row for each model and floor: name, actual, floor, direction (ge or le), passed, fraction_over (P17). floors: measure -> (direction,
    value) or (direction, value, name in JSON). given: a column of JSON with values of its own beside others that aren't numbers; what it
    leaves out, or JSON that can't be read, means the default.
    """
    own = F.from_json(given, "map<string,string>") if given else F.lit(None).cast("map<string,string>")

    def view(name: str) -> Column:
        direction, value, asked = (*floors[name], name)[:3]
        actual, floor = F.col(name).cast("double"), F.coalesce(F.try_element_at("_own", F.lit(asked)).try_cast("double"), F.lit(float(value)))
        over = actual - floor if direction == "ge" else floor - actual
        return F.struct(F.lit(name).alias("name"), actual.alias("actual"), floor.alias("floor"), F.lit(direction).alias("direction"), (over >= 0).alias("passed"), F.when(floor > 0, over / floor).otherwise(0.0).alias("fraction_over"))

    rows = models.withColumn("_own", own).select(key, F.explode(F.array(*(view(n) for n in floors))).alias("x"))
    return rows.select(key, "x.*")


def streaks(ledger: DataFrame, tie: list[str], day_ms: int = 86_400_000) -> DataFrame:
    """Per instrument and UTC day: running P&L, its peak, and losses in a row."""
    rows = ledger.withColumn("day", F.floor(F.col("ts_out_ms") / day_ms))
    w = Window.partitionBy("instrument", "day").orderBy("ts_out_ms", *tie)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("day_pnl", F.sum(R).over(upto)).withColumn("day_peak", F.greatest(F.max("day_pnl").over(upto), F.lit(0.0)))
    rows = rows.withColumn("_wins", F.sum((F.col(R) >= 0).cast("int")).over(upto))
    inner = Window.partitionBy("instrument", "day", "_wins").orderBy("ts_out_ms", *tie).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("loss_streak", F.sum((F.col(R) < 0).cast("int")).over(inner).cast("long")).drop("_wins")
