"""Hand cases and invariants."""

import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barflow.functions import stats
from barflow.operators import asof, labels, ledger, positions, quantiles, research, rolling, scan, schedule, skyline
from barflow.operators.bars import bucket_floor


def test_bucket_floor(spark):
    got = spark.createDataFrame([(x,) for x in (0, 1, 9999, 10000, 15500, 19999, 20000, -1)], "x long").select(bucket_floor(F.col("x"), 10000).alias("b"))
    assert [r.b for r in got.collect()] == [0, 0, 0, 10000, 10000, 10000, 20000, -10000]


def test_scan_equals_loop_across_blocks(spark):
    rows = [(k, i, 0.0 if i == 1 else 0.9, float(i % 7)) for k in "ab" for i in range(1, 101)]
    df = spark.createDataFrame(rows, "k string, rn long, a double, b double")
    got = {(r.k, r.rn): r.y for r in scan.ordered_scan(df, {"y": ("a", "b")}, ["k"], block=16).collect()}
    for k in "ab":
        y = 0.0
        for _, i, a, b in (r for r in rows if r[0] == k):
            y = a * y + b
            assert got[k, i] == pytest.approx(y, abs=1e-9)


def test_rows_are_numbered_over_slices(spark):
    df = spark.createDataFrame([("a", t) for t in (5, 3, 100, 1, 250, 99)], "instrument string, ts_ms long")
    got = rolling.number_rows(df, ["instrument"], slice_ms=50).orderBy("rn").collect()
    assert [(r.ts_ms, r.rn) for r in got] == [(1, 1), (3, 2), (5, 3), (99, 4), (100, 5), (250, 6)]


def test_lookback_equals_plain_window(spark):
    df = rolling.number_rows(spark.createDataFrame([("a", i, float(i * i % 11)) for i in range(50)], "instrument string, ts_ms long, x double"), ["instrument"], slice_ms=7)
    s = rolling.Series(["instrument"])
    got = rolling.without_lookback(rolling.with_lookback(df, 5, block=8).withColumn("m", s.mean(F.col("x"), 5))).orderBy("rn").collect()
    xs = [r.x for r in got]
    for i, r in enumerate(got):
        part = xs[max(0, i - 4) : i + 1]
        assert r.m == pytest.approx(sum(part) / len(part))


def test_sliding_equals_plain_frames(spark):
    """Nulls, stretches of one value and of zeros, blocks that are shorter than the series, windows longer than it."""
    rnd = random.Random(2)
    xs = [None if i % 17 == 3 else 0.0 if 60 < i < 90 else 100.0 if 120 < i < 150 else 100 + rnd.random() for i in range(300)]
    rows = [(k, i, xs[(i * 7 if k == "b" else i) % 300]) for k in "ab" for i in range(300)] + [("c", 0, None), ("c", 1, 5.0)]
    df = rolling.with_lookback(rolling.number_rows(spark.createDataFrame(rows, "instrument string, ts_ms long, x double"), ["instrument"]), 40, block=64)
    hows = {"mean": F.avg, "var_pop": F.var_pop, "var_samp": F.var_samp, "sd_pop": F.stddev_pop, "sd_samp": F.stddev_samp, "max": F.max, "min": F.min}
    wants = {f"{how}_{n}": (how, "x", n) for how in hows for n in (1, 2, 7, 40)} | {"range": ("minus", "max_7", "min_7"), "range_mean": ("mean", "range", 5)}
    got = {(r.instrument, r.rn): r for r in rolling.without_lookback(rolling.sliding(df, ["instrument"], wants)).collect()}
    s = rolling.Series(["instrument"])
    plain = df.withColumns({f"{how}_{n}": f("x").over(s.frame(n)) for how, f in hows.items() for n in (1, 2, 7, 40)}).withColumn("range", F.col("max_7") - F.col("min_7"))
    plain = rolling.without_lookback(plain.withColumn("range_mean", F.avg("range").over(s.frame(5)))).collect()
    assert len(plain) == len(got) == 602
    for r in plain:
        for c in wants:
            want, have = r[c], got[r.instrument, r.rn][c]
            assert have == want if want is None or want == 0 else have == pytest.approx(want, rel=1e-8, abs=1e-9), (r.instrument, r.rn, c)


def test_chained_scans_equal_loops(spark):
    """z follows y and x in the same row, w follows z: one pass, blocks of 16 rows."""
    rnd = random.Random(4)
    rows = [(k, i, 0.0 if i == 1 else rnd.random(), rnd.random() - 0.5, rnd.random(), None if i % 9 == 4 else 0.3) for k in "ab" for i in range(1, 90)]
    df = spark.createDataFrame(rows, "k string, rn long, a double, b double, f double, g double")
    steps = {"x": ("a", "b"), "y": ("f", "a"), "z": ("a", "f"), "w": ("g", "b")}
    got = {(r.k, r.rn): r for r in scan.ordered_scan(df, steps, ["k"], block=16, chained={"z": {"x": "f", "y": "b"}, "w": {"z": "a"}}).collect()}
    for k in "ab":
        x = y = z = w = 0.0
        for _, i, a, b, f, g in (r for r in rows if r[0] == k):
            x, y = a * x + b, f * y + a
            z = a * z + f + f * x + b * y
            w = (w if g is None else g * w + b) + a * z
            assert [got[k, i][c] for c in "xyzw"] == pytest.approx([x, y, z, w], abs=1e-9)


def test_skyline_equals_all_pairs(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.randrange(40), float(rnd.randrange(40)), rnd.choice([None, float("nan"), 1.0, 2.0]) if i % 50 == 0 else float(rnd.randrange(12))) for i in range(900)]
    rows += [(2000 + i, float(i), float(i), 0.0) for i in range(30)] + [(3000, 29.0, 29.0, 0.0)]
    rows = [(i, float(a), b, c) for i, a, b, c in rows]

    def beats(p, q):
        cost = lambda r: (-r[1], r[2], r[3])
        return all(x <= y for x, y in zip(cost(p), cost(q), strict=True)) and cost(p) != cost(q)

    sure = [r for r in rows if r[3] is not None and r[3] == r[3]]
    want = {r[0] for r in rows if r not in sure or not any(beats(p, r) for p in sure)}
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(7)
    for ranges in (1, 20):
        got = skyline.skyline(df, ["a"], ["b", "c"], ranges)
        assert {r.id for r in got.collect()} == want
    assert skyline.skyline(df.where("false"), ["a"], ["b", "c"]).count() == 0
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4), st.integers(0, 4)), max_size=60))
def test_skyline_of_small_sets(points):
    import numpy as np

    costs = np.array(points, float).reshape(-1, 3)
    want = [not any(all(q[k] <= p[k] for k in range(3)) and q != p for q in points) for p in points]
    assert skyline.skyline_of(costs).tolist() == want


def test_exact_quantiles_equal_sorted_values(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(quantiles, "FEW", 20)
    rnd = random.Random(7)
    values = {"even": [rnd.random() for _ in range(5000)], "skewed": [10.0 ** rnd.randrange(-300, 300) for _ in range(400)], "ties": [1.0] * 90 + [2.0] * 3, "one": [7.0], "signs": [-1e308, 1e308, 0.0, -0.5]}
    rows = [(k, x) for k, xs in values.items() for x in xs] + [("even", None), ("none", None)]
    at = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.k: r for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "k string, x double").repartition(5), ["k"], "x", at).collect()}
    assert set(got) == set(values)
    for k, xs in values.items():
        xs = sorted(xs)
        for name, q in at.items():
            p = q * (len(xs) - 1)
            low, high = xs[int(np.floor(p))], xs[int(np.ceil(p))]
            assert got[k][name] == pytest.approx(low + (p - np.floor(p)) * (high - low), rel=1e-12)


def _schedules(spark, rows, block):
    """The chosen intervals of rows (k, start, end, score), and what the best set of each key is worth, by a plain recursion."""
    from functools import cache

    df = spark.createDataFrame(rows, "k string, ts_ms long, t1_ms long, score long")
    got = schedule.best_schedule(df, "score", ["k"], tie=["score"], block=block, slice_ms=50).collect()
    worth = {}
    for k in {r[0] for r in rows}:
        mine = sorted(r[1:] for r in rows if r[0] == k)

        @cache
        def best(i, mine=mine):
            if i == len(mine):
                return 0
            after = next((j for j in range(i + 1, len(mine)) if mine[j][0] >= mine[i][1]), len(mine))
            return max(mine[i][2] + best(after), best(i + 1))

        for i in range(len(mine), -1, -1):
            worth[k] = best(i)
    return got, worth


def _free(chosen):
    mine = sorted((r.ts_ms, r.t1_ms) for r in chosen)
    return all(a[1] <= b[0] for a, b in zip(mine, mine[1:]))


def test_interval_choice(spark):
    got, _ = _schedules(spark, [("a", 0, 100_000, 5), ("a", 50_000, 200_000, 12), ("a", 150_000, 250_000, 5)], 4)
    assert [(r.ts_ms, r.t1_ms) for r in got] == [(50_000, 200_000)]


@pytest.mark.parametrize("block,span", [(4096, 9), (4, 9), (8, 60), (2, 300)])
def test_schedule_is_best(spark, block, span, monkeypatch):
    """Intervals that chain over the whole series, of short and very long ones, ties, repeats and those of no length, over several levels of blocks."""
    monkeypatch.setattr(schedule, "FAN", 3)
    rng = random.Random(span)
    rows = [(k, t := rng.randrange(120), t + rng.randrange(span), rng.randrange(9)) for k in "ab" for _ in range(90)]
    rows += rows[:5] + [("c", 5, 9, 3)]
    got, worth = _schedules(spark, rows, block)
    for k, total in worth.items():
        mine = [r for r in got if r.k == k]
        assert _free(mine) and sum(r.score for r in mine) == total


def test_schedule_leaves_out_what_has_no_place(spark):
    """Nulls, ends before starts and negative scores take no part, further columns stay; an empty table has an empty answer."""
    rows = [("a", 0, 5, 1, "x"), ("a", None, 5, 1, "x"), ("a", 0, None, 1, "x"), ("a", 6, 5, 9, "x"), ("a", 6, 7, -1, "x"), ("a", 6, 7, None, "x"), (None, 1, 2, 3, "x")]
    df = spark.createDataFrame(rows, "k string, ts_ms long, t1_ms long, score long, rn string")
    assert [tuple(r) for r in schedule.best_schedule(df, "score", ["k"]).collect()] == [("a", 0, 5, 1, "x")]
    assert schedule.best_schedule(df.limit(0), "score", ["k"]).collect() == []


def test_normal_distribution_and_deflated_sharpe(spark):
    row = spark.range(1).select(stats.norm_cdf(F.lit(1.96)).alias("c"), stats.norm_ppf(F.lit(0.975)).alias("p"), stats.deflated_sharpe(F.lit(1.5), F.lit(252), F.lit(1)).alias("one"), stats.deflated_sharpe(F.lit(0.1), F.lit(252), F.lit(1)).alias("few"), stats.deflated_sharpe(F.lit(0.1), F.lit(252), F.lit(100)).alias("many"), stats.deflated_sharpe(F.lit(1.0), F.lit(1), F.lit(1)).alias("short")).first()
    assert row.c == pytest.approx(0.975, abs=1e-4) and row.p == pytest.approx(1.96, abs=1e-3)
    assert row.one > 0.99 and row.few > row.many and row.short == 0


def test_splits_leak_nothing(spark):
    from barflow.operators import splits

    df = spark.createDataFrame([("a", 10 * i, 10 * (i + 3)) for i in range(60)], "instrument string, t0 long, t1 long")
    rows = splits.cpcv(df, 6, 2, 0.0, ["instrument"], []).collect()
    assert len({r.split for r in rows}) == 15
    for s in range(15):
        test = [(r.t0, r.t1) for r in rows if r.split == s and r.role == "test"]
        for r in rows:
            if r.split == s and r.role == "train":
                assert all(r.t1 < a or r.t0 > b for a, b in test)


def test_running_values_over_slices(spark):
    rng = random.Random(5)
    rows = [(k, t := rng.randrange(400), t + rng.randrange(30)) for k in "ab" for _ in range(120)]
    df = spark.createDataFrame(rows, "k string, ts_ms long, t1_ms long")
    got = rolling.running(df, ["k"], "ts_ms", ["t1_ms"], F.col("t1_ms"), "max", "top", slice_ms=50).collect()
    assert all(r.top == max(b for k, a, b in rows if k == r.k and (a, b) <= (r.ts_ms, r.t1_ms)) for r in got) and len(got) == len(rows)
    number, upto, want = {"a": 0, "b": 0}, {}, set()
    for k, a, b in sorted(rows):
        number[k] += k not in upto or a >= upto[k]
        upto[k] = max(upto.get(k, b), b)
        want.add((k, a, b, number[k]))
    found = {tuple(r) for r in labels.overlap_clusters(df, ["k"]).select("k", "ts_ms", "t1_ms", "cluster").collect()}
    assert {x for x in found if x[1] < x[2]} == {x for x in want if x[1] < x[2]}


def test_balance_minority_of_zero_sides_and_ties(spark):
    """Side 0 counts as long, equal counts make short the larger, the earlier of equal labels goes first, and a fraction above 0.5 can empty a side."""
    def left(rows, fraction):
        df = spark.createDataFrame([("a", t, s, r) for t, s, r in rows], "instrument string, ts_ms long, side int, realized_r double")
        return sorted(r.ts_ms for r in labels.balance_minority(df, fraction).collect())

    assert left([(1, 0, 0.1), (2, 1, 0.1), (3, 1, 0.2), (4, -1, 0.1)], 0.5) == [3, 4]
    assert left([(1, 1, 0.1), (2, -1, 0.1)], 0.8) == [1]
    assert left([(1, 1, 0.1), (2, 1, 0.1)], 0.3) == [1, 2]
    assert left([(1, 1, 0.1), (2, 1, 0.1), (3, -1, 0.3)], 0.5) == [2, 3]


def test_label_pipeline_of_a_sine(spark):
    """Closes of 1 + 0.001 sin(0.015 i): labels don't overlap and hold no longer than the horizon."""
    import math

    close = [1 + 0.001 * math.sin(0.015 * i) for i in range(600)]
    rows = [("a", i + 1, 10_000 * i, c + 1e-4, c - 1e-4, c, math.log(c / close[max(0, i - 1)]), 1e-5) for i, c in enumerate(close)]
    bars = spark.createDataFrame(rows, "instrument string, rn long, ts_ms long, high double, low double, close double, ret double, sigma double")
    got = sorted(labels.label_pipeline(bars).collect(), key=lambda r: r.ts_ms)
    assert got and all(a.t1_ms <= b.ts_ms for a, b in zip(got, got[1:])) and all(10_000 <= r.t1_ms - r.ts_ms <= 360_000 and r.meta_y == 1 for r in got)


def test_pbo_without_enough_to_compare(spark):
    few = spark.createDataFrame([(p, s, 0.1 * p) for p in range(2) for s in "ab"], "period long, strategy string, r double")
    one = spark.createDataFrame([(p, "a", 0.1 * p) for p in range(40)], "period long, strategy string, r double")
    assert [research.pbo(x, 8).first().pbo for x in (few, one)] == [0.5, 0.5]


def test_deflated_sharpe_edges(spark):
    rows = [(1.5, 1, 10, 0.0, 3.0), (1.5, 252, 0, 0.0, 3.0), (2.0, 252, 10, 5.0, 1.0), (1.5, 252, 10, 0.0, 3.0), (0.0, 252, 1, 0.0, 3.0)]
    df = spark.createDataFrame(rows, "sr double, n long, trials long, skew double, kurt double")
    got = [r[0] for r in df.select(stats.deflated_sharpe(*(F.col(c) for c in ("sr", "n", "trials", "skew", "kurt")))).collect()]
    assert got[:3] == [0.0, 0.0, 0.0] and 0 < got[3] <= 1 and abs(got[4] - 0.5) < 1e-6


def test_bootstrap_is_the_same_for_any_partitioning(spark):
    df = spark.range(400).select("id", (F.col("id") % 17).cast("double").alias("v"))
    a, b = (research.bootstrap(df.repartition(n), "v", F.avg, resamples=20).first() for n in (1, 7))
    assert all(abs(x - y) < 1e-9 for x, y in zip(a, b))


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_reads_no_frame_anew_for_each_row(spark, direction):
    """Frames that end at a partition's last row cost its rows squared; ties, gaps of several slices and rows beyond the ends."""
    rng = random.Random(5)
    left, right = ([("ab"[i % 2], rng.randrange(900), i) for i in range(n)] for n in (300, 40))
    a = spark.createDataFrame(left, "instrument string, ts_ms long, event_id long")
    b = spark.createDataFrame([(*r, 10 * r[2]) for r in right], "instrument string, ts_ms long, event_id long, x long")
    out = asof.asof_join(a, b, ["instrument"], ["x"], direction, tie=["event_id"], slice_ms=50)
    plan = out._jdf.queryExecution().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
    got = {r.event_id: r.x for r in out.collect()}
    for key, ts, event in left:
        near = [(t, e) for k, t, e in right if k == key and (t <= ts if direction == "backward" else t >= ts)]
        assert got[event] == (10 * (max if direction == "backward" else min)(near)[1] if near else None)


def test_order_intents_of_copied_events(spark, monkeypatch):
    """Many signals of one time, as copies of a table have; no step on the way reads a frame anew for each row."""
    plans, keep = [], positions.kept
    monkeypatch.setattr(positions, "kept", lambda df: (plans.append(df._jdf.queryExecution().toString().lower()), keep(df))[1])
    rows = [("a", 10 * (i // 6), i, ("long", "short", "flat")[i % 3], 0.5 + (i % 5) / 10, i % 7 - 3) for i in range(240)]
    df = spark.createDataFrame(rows, "instrument string, ts_ms long, event_id long, direction string, confidence double, net_units long")
    got = sorted((r.ts_ms, r.event_id, r.units_delta) for r in positions.order_intents(df, ["event_id"], cooldown_ms=25).collect())
    want, free = [], -1
    for _, ts, event, way, sure, net in rows:
        delta = {"long": 0 if net >= 3 else 1 - net if net < 0 else 1, "short": 0 if net <= -3 else -net - 1 if net > 0 else -1, "flat": -net}[way]
        if sure >= 0.55 and delta and ts >= free:
            want.append((ts, event, delta))
            free = ts + 25
    assert got == want and len(want) > 5
    assert plans and not any("unboundedfollowing" in p for p in plans)


def test_trade_summary_by_hand(spark):
    """One gain, one loss, one scratch; a group without losses; a group of one."""
    day = 86_400_000
    rows = [("a", 1, 0, 0.01), ("a", 2, day, -0.02), ("a", 3, 2 * day, 0.0), ("b", 4, 0, 0.01), ("b", 5, day, 0.03), ("c", 6, 0, -0.5)]
    df = spark.createDataFrame(rows, "instrument string, trade_id long, ts_out_ms long, realized_r double")
    got = {r.instrument: r for r in ledger.trade_summary(df, ["instrument"], ["trade_id"]).collect()}
    a, b, c = (got[k] for k in "abc")
    assert (a.n_trades, round(a.net_return, 9), round(a.max_drawdown_bp, 6), round(a.hit_rate, 6), round(a.profit_factor, 9), a.turnover_per_day) == (3, -0.01, 200.0, 0.333333, 0.5, 1.5)
    assert (round(a.avg_win, 9), round(a.avg_loss, 9), a.exposure, a.traded) == (0.01, -0.01, 0.0, True)
    assert round(a.calmar, 6) == round(a.sharpe / 0.02, 6)
    assert (b.profit_factor, b.max_drawdown_bp, b.calmar, b.sortino) == (1e6, 0.0, 0.0, 0.0)
    assert (c.sharpe, c.deflated_sharpe, c.turnover_per_day, round(c.max_drawdown_bp, 6)) == (0.0, 0.0, 0.0, 5000.0)


def test_compounded_ruin_and_nulls(spark):
    rows = [("a", 1, 1, 0.5), ("a", 2, 2, None), ("a", 3, 3, -0.5), ("a", 4, 4, -2.0)]
    df = spark.createDataFrame(rows, "instrument string, trade_id long, ts_out_ms long, realized_r double")
    got = ledger.compounded(df, ["instrument"], ["trade_id"]).orderBy("trade_id").collect()
    assert [(round(r.equity, 9), round(r.equity_peak, 9), round(r.drawdown_bp, 6)) for r in got] == [(1.5, 1.5, 0.0), (1.5, 1.5, 0.0), (0.75, 1.5, 5000.0), (0.0, 1.5, 10000.0)]


def test_choice_prefers_trials_that_traded(spark):
    df = spark.createDataFrame([(1, 9.0, 2), (2, 3.0, 3), (3, 5.0, 4), (4, 5.0, 9)], "trial_id long, sortino double, n_trades long")
    assert [r.trial_id for r in ledger.chosen(df, "trial_id").collect()] == [3]
    assert [r.trial_id for r in ledger.chosen(df.where("trial_id = 1"), "trial_id").collect()] == [1]
    assert ledger.chosen(df.where("false"), "trial_id").count() == 0


def test_floor_rows_with_own_and_broken_json(spark):
    df = spark.createDataFrame([(1, 0.6, '{"auc": 0.5}'), (2, 0.6, "{no"), (3, 0.6, None), (4, None, '{"auc": 0}')], "model_id long, auc double, given string")
    got = {r.model_id: (r.floor, r.passed, r.fraction_over and round(r.fraction_over, 9)) for r in ledger.floor_rows(df, "model_id", {"auc": ("ge", 0.8)}, "given").collect()}
    assert got == {1: (0.5, True, 0.2), 2: (0.8, False, -0.25), 3: (0.8, False, -0.25), 4: (0.0, None, 0.0)}


def test_floor_rows_by_names_of_their_own(spark):
    """Values under the JSON's own names count, beside a flag and a text; a measure's own name isn't one of them."""
    df = spark.createDataFrame([(1, 0.6, 0.6, 0.6, 0.6, 600.0, '{"min_oos_auc": 0.5, "max_oos_log_loss": "none", "oos_log_loss": 9, "max_fine_tune_dd_bp": 500, "require_lockbox_pass": true}')], "model_id long, oos_auc double, oos_log_loss double, oos_balanced_acc double, fine_tune_sortino double, fine_tune_max_dd_bp double, given string")
    got = {r.name: (r.floor, r.passed) for r in ledger.floor_rows(df, "model_id", given="given").collect()}
    assert got == {"oos_auc": (0.5, True), "oos_log_loss": (0.7, True), "oos_balanced_acc": (0.52, True), "fine_tune_sortino": (0.3, True), "fine_tune_max_dd_bp": (500.0, False)}


@pytest.mark.parametrize(("gap", "step", "block"), [(50, 1, 8), (7, 3, 4), (1000, 1, 16), (5, 20, 4), (0, 1, 4)])
def test_spaced_equals_loop(spark, gap, step, block):
    """Over several levels of blocks, with ties, dense runs, gaps longer than a block, and rows without a key or a time."""
    rnd = random.Random(gap)
    rows, at = [], {"a": 0, "b": 5}
    for i in range(1500):
        k = "a" if i % 3 else "b"
        at[k] += rnd.choice((0, 0, 1, step, 2 * step))
        rows.append((k, at[k], i))
    df = spark.createDataFrame([*rows, (None, 3, -1), ("a", None, -2)], "instrument string, ts_ms long, event_id long")
    got = sorted((r.instrument, r.ts_ms, r.event_id) for r in positions.spaced(df.where("instrument IS NOT NULL AND ts_ms IS NOT NULL") if gap == 0 else df, gap, ["event_id"], slice_ms=100, block=block).collect())
    want = []
    for k in "ab":
        last = None
        for r in sorted(x for x in rows if x[0] == k):
            if last is None or r[1] - last >= gap:
                want.append(r)
                last = r[1]
    assert got == sorted(want)


def test_merged_events(spark):
    one, two = (spark.createDataFrame([("a", x) for x in xs], "instrument string, rn long") for xs in ((1, 4, 9), (4, 5, 12)))
    for gap, want in ((4, [1, 5, 9]), (1, [1, 4, 5, 9, 12]), (100, [1])):
        assert sorted(r.rn for r in positions.merged_events([one, two], gap).collect()) == want
    assert positions.merged_events([one.where("false")], 3).count() == 0


def test_round_trips_and_skips_over_slices(spark):
    """The same trips and runs whether a slice holds all or hardly anything."""
    rnd = random.Random(4)
    rows = [("ab"[rnd.randrange(2)], i // 2, i, rnd.choice(["skip"] * 6 + ["open_long", "open_short", "close"]), rnd.choice(["x", 'say "y"', None]), 100.0 + i) for i in range(400)]
    df = spark.createDataFrame(rows, "instrument string, ts_ms long, event_id long, action string, reason string, price double")
    trips, runs = [], []
    for k in "ab":
        before, run = None, []
        for r in [r for r in rows if r[0] == k] + [(k, 0, 0, "end", None, 0.0)]:
            if r[3] == "skip":
                run.append(r)
                continue
            runs += [(k, run[i][1], run[min(i + 3, len(run)) - 1][1], len(run[i : i + 3])) for i in range(0, len(run), 3)]
            if r[3] == "close" and before and before[3] != "close":
                trips.append((k, before[1], r[1], r[2], json.dumps(["entry:" + (before[4] or ""), "exit:" + (r[4] or "")], separators=(",", ":"))))
            before, run = r, []
    for slice_ms in (3, 10_000):
        assert sorted((r.instrument, r.ts_in_ms, r.ts_out_ms, r.event_id, r.decision_chain) for r in ledger.round_trips(df, ["event_id"], slice_ms).collect()) == sorted(trips)
        assert sorted((r.instrument, r.first_ms, r.last_ms, r.n) for r in ledger.compact_skips(df, ["event_id"], 3, slice_ms).collect()) == sorted(runs)


def test_sigmoid_and_softmax(spark):
    row = spark.range(1).select(stats.sigmoid(F.lit(0.0)).alias("s"), stats.softmax(F.lit(1000.0), F.lit(1000.0)).alias("two"), stats.softmax(F.lit(3.0)).alias("one")).first()
    assert (row.s, row.two, row.one) == (0.5, [0.5, 0.5], [1.0])


def test_portfolio_book_counts_nulls(spark):
    rows = [("x", 1, 5, 0.1, "stop"), ("x", 2, 6, -0.1, None), (None, 3, 7, 0.2, "stop")]
    df = spark.createDataFrame(rows, "instrument string, trade_id long, ts_out_ms long, realized_r double, exit_reason string")
    got = sorted((r.n_trades, r.newest, tuple(map(tuple, r.reasons))) for r in ledger.portfolio_book(df, ["trade_id"], {"reasons": "exit_reason"}).collect())
    assert got == [(1, "stop", (("stop", 1),)), (2, None, (("stop", 1), ("unknown", 1))), (3, "stop", (("stop", 2), ("unknown", 1)))]


def test_feature_scores(spark):
    """A copy of the label tells all of it, noise next to nothing; constants and empty columns score 0."""
    import math

    from barflow.models import selection

    rnd = random.Random(9)
    rows = [(float(i % 2), rnd.random(), 5.0, None, float(i % 2) if i % 3 else rnd.random(), None if i % 100 == 0 else i % 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "same double, noise double, flat double, none double, partly double, y int")
    names = ["noise", "flat", "none", "partly", "same"]
    got = {r.feature: r for r in selection.top_features(selection.feature_scores(df, names, "y"), 2).collect()}
    p = sum(r[5] == 1 for r in rows) / sum(r[5] is not None for r in rows)
    assert got["same"].score == pytest.approx(-p * math.log(p) - (1 - p) * math.log(1 - p))
    assert got["flat"].score == got["none"].score == 0 and got["noise"].score < 0.02 < got["partly"].score < got["same"].score
    assert selection.select_features(df, names, "y", 2) == ["same", "partly"] and {f for f in got if got[f].chosen} == {"same", "partly"}
