import json

from barflow.operators.bars import ohlcv_bars
from barflow.sources import json_lines as J
from barflow.streaming.bars import bar_stream


def tick(i, bid="1.5", **more):
    return json.dumps({"kind": "pricing_1s", "ts": f"2024-01-01T00:00:{i:02d}Z", "instrument": "EUR_USD", "bid": bid, "ask": "1.7", "status": "tradeable"} | more)


def test_ticks_errors_and_stream(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.jsonl").write_text("\n".join([*(tick(i) for i in range(k * 20, k * 20 + 20)), "{broken" + "x" * 600, tick(59, "n/a") if k else ""]) + "\n")
    rows = J.read_ticks(spark, str(tmp_path)).collect()
    assert len(rows) == 41 and sum(r.bid is None for r in rows) == 1 and rows[0].mid == 1.6
    bad = J.split_errors(spark, str(tmp_path)).collect()
    assert len(bad) == 2 and all(len(r.raw) == 500 for r in bad)
    q = bar_stream(J.stream_ticks(spark, str(tmp_path)).where("bid IS NOT NULL"), late="0 seconds").writeStream.format("memory").queryName("bars_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.ts_ms, r.open, r.n_ticks) for r in spark.sql("SELECT * FROM bars_out").collect()}
    batch = ohlcv_bars(J.read_ticks(spark, str(tmp_path)).where("bid IS NOT NULL"), 10_000, "bid").collect()
    assert got <= {(r.ts_ms, r.open, r.n_ticks) for r in batch} and len(got) >= 3


def test_books_and_frames(spark, tmp_path):
    level = {"price": "1.1", "longCountPercent": "0.5", "shortCountPercent": "x"}
    good = level | {"shortCountPercent": "0.25"}
    rows = [{"instrument": "A", "ts": "2024-01-01T00:00:00Z", "buckets": [level, good]}, {"instrument": "B", "ts": "2024-01-01T00:00:00Z", "data": {"buckets": [good]}}]
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert {(r.instrument, len(r.buckets), r.buckets[0].short) for r in J.read_book_snapshots(spark, str(tmp_path)).collect()} == {("A", 1, 0.25), ("B", 1, 0.25)}
    frames = [{"type": "PRICE", "instrument": "A", "time": "2024-01-01T00:00:00Z", "bids": [{"price": "1.0"}], "asks": [{"price": "2.0"}]}, {"type": "HEARTBEAT", "time": "2024-01-01T00:00:00Z"}]
    got = J.parse_price_frames(spark.createDataFrame([(json.dumps(f),) for f in frames], "value string")).collect()
    assert len(got) == 1 and got[0].mid == 1.5
