"""Stateful streams against their batch twins."""

import uuid

import pytest
from pyspark.sql import functions as F

from barflow.operators import ledger, positions, research, series_features
from barflow.sinks import versioned
from barflow.streaming import flows, state, ticks


@pytest.fixture
def through(spark, tmp_path):
    """Rows written as several files and read back as a stream, one file a batch; the stream's output rows."""

    def run(rows, schema, build, parts=3):
        src = tmp_path / uuid.uuid4().hex
        for k in range(parts):
            part = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
        name = "out_" + uuid.uuid4().hex
        q = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
        return spark.sql(f"SELECT * FROM {name}")

    return run


def test_trades(spark, through):
    rows = [(i, 0, t, 100 + (t * 7 % 13) / 10, (t * 5 % 11) / 10, 1 - (t * 5 % 11) / 10, 0.005) for i in ("a", "b") for t in range(60)]
    schema = "instrument string, params_id int, ts_ms long, close double, p_long double, p_short double, sigma double"
    params = {"take": 0.6, "margin": 0.1, "stop": 1.0, "target": 1.0, "max_hold": 5, "cooldown": 2}
    got = through(sorted(rows, key=lambda r: r[2]), schema, lambda s: state.trade_stream(s, params))
    grid = spark.createDataFrame([(0, *map(float, list(params.values())[:4]), 5, 2)], "params_id int, take double, margin double, stop double, target double, max_hold int, cooldown int")
    want = research.trade_decisions(spark.createDataFrame(rows, schema).drop("params_id"), grid)
    key = lambda df: sorted((r.instrument, r.ts_ms, r.action, r.reason) for r in df.collect())
    assert key(got) == key(want) and len({r[2] for r in key(got)}) > 2


def test_positions_and_cooldown(spark, through):
    rows = [(k, t, t, (t * 5 % 7) - 3, 100 + (t * 3 % 17) / 4) for t in range(80) for k in "ab"]
    schema = "instrument string, ts_ms long, event_id long, units long, price double"
    key = lambda df: sorted((r.instrument, r.event_id, r.net_units, round(r.avg_price, 9), round(r.realized, 9)) for r in df.collect())
    assert key(through(rows, schema, state.position_stream)) == key(positions.positions(spark.createDataFrame(rows, schema), ["event_id"]))
    got = through(rows, schema, lambda s: state.cooldown_stream(s.withColumn("units_delta", F.col("units")), 7))
    want = positions.spaced(spark.createDataFrame(rows, schema).where("units <> 0"), 7, ["event_id"])
    assert sorted((r.instrument, r.event_id) for r in got.collect()) == sorted((r.instrument, r.event_id) for r in want.collect())


def test_books_skips_and_windows(spark, through):
    deltas = [("a", t, t, "bid" if t % 2 else "ask", 100.0 + t % 3 + (0 if t % 2 else 5), t % 4) for t in range(40)]
    books = through(deltas, "instrument string, ts_ms long, event_id long, side string, price double, size long", state.book_stream).collect()
    live = {"bid": {}, "ask": {}}
    want = {}
    for _, t, _, side, px, size in deltas:
        live[side].pop(px, None)
        if size:
            live[side][px] = size
        if live["bid"] and live["ask"]:
            want[t] = (max(live["bid"]), min(live["ask"]))
    assert {r.event_id: (r.bid_px[0], r.ask_px[0]) for r in books} == want
    acts = [("a", t, t, "open_long" if t % 9 == 8 else "skip", f"r{t % 2}") for t in range(45)]
    schema = "instrument string, ts_ms long, event_id long, action string, reason string"
    runs = through(acts, schema, lambda s: state.skip_stream(s, 5)).collect()
    batch = ledger.compact_skips(spark.createDataFrame(acts, schema), ["event_id"], 5).collect()
    assert sorted((r.first_ms, r.last_ms, r.n) for r in runs) == sorted((r.first_ms, r.last_ms, r.n) for r in batch)
    closes = through([("a", t, 100.0 + t % 5) for t in range(30)], "instrument string, ts_ms long, close double", lambda s: state.rolling_stream(s, 10)).collect()
    assert len(closes) == 30 and all(r.drawdown <= 0 for r in closes)


def test_tick_vector_equals_batch(spark, through):
    """Every column of the batch vector, over several batches, with stretches of one price, repeated times and prices of 0."""
    import random

    rnd, rows = random.Random(8), []
    for k in "ab":
        mid = 100.0
        for t in range(900):
            mid = 100.0 if 400 < t < 480 else 0.0 if t in (600, 601) else max(1.0, mid + rnd.choice((-0.5, 0, 0, 0.25, 0.5)))
            rows.append((k, 1_700_000_000_000 + 700 * (t // 2 if 100 < t < 300 else t), t, mid * 0.999, mid * 1.001, mid))
    rows.sort(key=lambda r: (r[1], r[2]))
    schema = "instrument string, ts_ms long, event_id long, bid double, ask double, mid double"
    stream = {(r.instrument, r.event_id): r for r in through(rows, schema, ticks.tick_stream, parts=5).collect()}
    batch = series_features.tick_features(spark.createDataFrame(rows, schema), ["event_id"]).drop("rn")
    assert set(stream[next(iter(stream))].asDict()) == set(batch.columns)
    want = batch.collect()
    assert len(want) == len(stream)
    for r in want:
        for c in batch.columns:
            if c != "instrument":
                assert stream[r.instrument, r.event_id][c] == pytest.approx(r[c], rel=1e-7, abs=1e-7), (r.instrument, r.event_id, c)


def test_joins_alerts_and_writes(spark, through, tmp_path):
    rows = [("a", 1_700_000_000_000 + 10_000 * t, float(t), "bar" if t % 2 else "signal") for t in range(40)]
    schema = "instrument string, ts_ms long, x double, kind string"
    both = through(rows, schema, lambda s: flows.bars_with_signals(s.drop("kind"), s.select("instrument", "ts_ms", (F.col("x") * 2).alias("y"))))
    assert sorted((r.x, r.y) for r in both.collect()) == [(float(t), 2.0 * t) for t in range(40)]
    begin = 1_700_000_000_000 - 1_700_000_000_000 % 60_000
    acts = [("a", begin + 1000 * t, "skip") for t in range(300)]
    alerts = through(acts, "instrument string, ts_ms long, action string", lambda s: flows.rejection_alerts(s, 50)).collect()
    assert alerts and all(r.n == 60 for r in alerts if 60_000 <= r.end_ms - begin <= 200_000)
    src = str(tmp_path / "src")
    spark.createDataFrame(rows + rows[:5], schema).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    routes = {"bar": str(tmp_path / "bar"), "signal": str(tmp_path / "signal")}
    flows.fan_out(stream, routes, str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(routes["bar"]).count() == 20 + 2 and spark.read.parquet(routes["signal"]).count() == 20 + 3
    for run in ("c2", "c3"):  # the second run writes nothing new
        flows.upsert(stream, str(tmp_path / "table"), ["instrument", "ts_ms"], str(tmp_path / run)).trigger(availableNow=True).start().awaitTermination(120)
    assert versioned.read_versioned(spark, str(tmp_path / "table")).count() == 40
