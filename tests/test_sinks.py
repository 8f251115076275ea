"""Frames in, tables out, and back."""

import json

import pytest
from pyspark.sql import functions as F

from barflow.functions import names
from barflow.models import training
from barflow.operators.rolling import number_rows
from barflow.sinks import tables, versioned
from barflow.sources import frames

T0 = "2024-01-01T00:00:00Z"


def text(spark, rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string")


def test_feed_frames(spark):
    q = {"T": "q", "S": "BTC/USD", "t": T0, "bp": 2.0, "bs": 1.0, "ap": 1.5, "as": 1.0}
    df = text(spark, [[q, q | {"bp": 0.0}, {"T": "success"}], "{broken", {"T": "q"}, [{"T": "t", "S": "X", "t": T0, "p": 3.0}, {"T": "o", "S": "X", "t": T0, "b": [{"p": 1.0, "s": 0.0}], "a": [{"p": 2.0, "s": 5.0}]}]])
    quotes = frames.parse_quote_frames(df).collect()
    assert len(quotes) == 1 and quotes[0].mid == 1.75 and quotes[0].spread == 0 and quotes[0].ts_ms == 1704067200000
    assert [(r.price, r["size"]) for r in frames.parse_trade_frames(df).collect()] == [(3.0, 0.0)]
    assert sorted((r.side, r.price, r["size"]) for r in frames.parse_book_deltas(df).collect()) == [("ask", 2.0, 5.0), ("bid", 1.0, 0.0)]


def test_accounts_and_transactions(spark):
    a = frames.parse_account_frames(text(spark, [{"NAV": "10.5", "marginRate": "0.03", "pl": "x", "openTradeCount": 2}])).first()
    assert (a.nav, a.leverage, a.realized_pl, a.open_trades, a.currency, a.balance) == (10.5, 33.0, 0.0, 2, "USD", 0.0)
    t = frames.parse_transactions(text(spark, [{"id": "7", "type": "ORDER_FILL", "time": T0, "units": "-5", "price": "n/a"}])).first()
    assert (t.id, t.kind, t.units, t.price, t.pl) == ("7", "ORDER_FILL", -5.0, None, None) and json.loads(t.raw)["id"] == "7"


def test_upserts(spark, tmp_path):
    path, row = str(tmp_path / "t"), lambda *xs: spark.createDataFrame(list(xs), "k long, v string")
    rows = lambda: sorted(map(tuple, versioned.read_versioned(spark, path).collect()))
    with pytest.raises(ValueError):
        rows()
    versioned.insert_ignore(row((1, "a"), (1, "a"), (2, "b")), path, ["k"], parts=5)
    versioned.insert_ignore(row((2, "x"), (3, "c"), (3, "c")), path, ["k"])
    assert rows() == [(1, "a"), (2, "b"), (3, "c")]
    versioned.replace_by_key(row((2, "new"), (4, "d")), path, ["k"])
    assert rows() == [(1, "a"), (2, "new"), (3, "c"), (4, "d")]
    versioned.insert_ignore(row((1, "no"), (4, "no")), path, ["k"])
    versioned.replace_by_key(row((9, "z")).where("false"), path, ["k"])
    assert rows() == [(1, "a"), (2, "new"), (3, "c"), (4, "d")]
    versioned.replace_by_key(spark.createDataFrame([(3, "c", 7)], "k long, v string, more int"), path, ["k"])
    assert {(r.k, r.v, r.more) for r in versioned.read_versioned(spark, path).collect()} == {(1, "a", None), (2, "new", None), (3, "c", 7), (4, "d", None)}


def test_parts_are_rewritten_only_where_touched_or_added_to_often(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versioned, "ADDED", 2)
    path = str(tmp_path / "t")
    add = lambda *ks: versioned.insert_ignore(spark.createDataFrame([(k, k) for k in ks], "k long, v long"), path, ["k"], parts=2)
    for ks in ((1, 2, 3, 4), (5, 6, 7, 8), (9, 10, 11, 12), (13,)):
        add(*ks)
    version, parts, held = versioned._newest(spark, path)
    assert (version, parts) == (4, 2) and max(sum(q == p for q, _ in held) for p, _ in held) <= 3
    assert sorted(r.k for r in versioned.read_versioned(spark, path).collect()) == list(range(1, 14))
    versioned.replace_by_key(spark.createDataFrame([(1, 100)], "k long, v long"), path, ["k"])
    _, _, now = versioned._newest(spark, path)
    assert len([h for h in now if h[1] == 5]) == 1 and set(now) - {h for h in now if h[1] == 5} <= set(held)  # the other part is as it was
    assert {r.k: r.v for r in versioned.read_versioned(spark, path).collect()} == {k: 100 if k == 1 else k for k in range(1, 14)}


@pytest.mark.parametrize("at", ["_write_rows", "list"])
def test_a_job_that_fails_midway_leaves_the_table(spark, tmp_path, monkeypatch, at):
    """It fails while rows are written, or between the rows and the list; the next attempt writes over what is left."""
    path = str(tmp_path / "t")
    old = spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    new = spark.range(100, 300).select(F.col("id").alias("k"), F.lit("new").alias("v"))
    versioned.replace_by_key(old, path, ["k"], parts=8)
    before = sorted(map(tuple, versioned.read_versioned(spark, path).collect()))
    monkeypatch.setattr(versioned, "kept", lambda df: df)
    if at == "list":
        monkeypatch.setattr(versioned.LIST, "fields", None)
        with pytest.raises(TypeError):
            versioned.replace_by_key(new, path, ["k"])
    else:
        broken = new.withColumn("v", F.when((F.col("k") == 250) & F.col("v").isNotNull(), F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("v")))
        with pytest.raises(Exception, match="lost"):
            versioned.replace_by_key(broken, path, ["k"])
    monkeypatch.undo()
    assert sorted(map(tuple, versioned.read_versioned(spark, path).collect())) == before
    versioned.replace_by_key(new, path, ["k"])
    assert sorted(map(tuple, versioned.read_versioned(spark, path).collect())) == sorted([(k, "old") for k in range(100)] + [(k, "new") for k in range(100, 300)])


def test_archive_and_retention(spark, tmp_path):
    root = str(tmp_path / "archive")
    ticks = spark.range(300).select(F.lit("EUR_USD").alias("instrument"), (F.lit(1704067200000) + F.col("id") * 1_000_000).alias("ts_ms"), F.col("id").alias("x"))
    for _ in range(2):  # the second sweep of the same rows adds none
        kept = tables.retention_sweep(ticks, 100, root, "bars", ["ts_ms"])
        assert kept.count() == 100
    day = frames.read_archive(spark, root, "bars", "EUR/USD", "2024-01-02")
    assert day.count() == 86 and spark.read.parquet(f"{root}/bars").count() == 200
    with pytest.raises(ValueError):
        frames.read_archive(spark, root, "secrets", "EUR/USD", "2024-01-02")
    with pytest.raises(ValueError):
        frames.read_archive(spark, root, "bars", "EUR/USD", "2024-1-2")


def test_files(spark, tmp_path):
    df = spark.range(10).select(F.lit("a").alias("kind"), F.lit("EUR_USD").alias("instrument"), (F.lit(1704067200000) + F.col("id") * 1_000_000).alias("ts_ms"), F.col("id").alias("x"))
    tables.write_hourly_jsonl(df, str(tmp_path / "h"))
    assert {p.name for p in (tmp_path / "h" / "kind=a").iterdir()} == {"hour=20240101_00", "hour=20240101_01", "hour=20240101_02"}
    tables.write_preview(df, str(tmp_path / "p"), ["instrument"], ["ts_ms"], 3)
    assert sorted(r.x for r in spark.read.json(str(tmp_path / "p")).collect()) == [7, 8, 9]
    rows = number_rows(df.drop("kind"), ["instrument"])
    chunks = tables.chunked(rows, rows.groupBy("instrument").agg(F.count("*").alias("n")), 4, 3)
    assert sorted((r.chunk, r["count"]) for r in chunks.groupBy("chunk").count().collect()) == [("0_4_4", 4), ("3_7_4", 4), ("6_10_4", 4)]
    tables.write_chunks(chunks, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 12
    for version in ("v1", "v2", "v1"):
        tables.write_oof(df.drop("kind").withColumn("model_version", F.lit(version)), str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 20
    log = tmp_path / "logs" / "v1.0.1" / "EUR_USD"
    log.mkdir(parents=True)
    (log / "trades.jsonl").write_text('{"realized_r": 0.5}\n{"realized_r": -0.25, "instrument": "X"}\n')
    got = frames.read_trade_logs(spark, str(tmp_path / "logs"), "trades.jsonl", "instrument string, realized_r double")
    assert sorted((r.version, r.instrument, r.realized_r) for r in got.collect()) == [("v1.0.1", "EUR_USD", 0.5), ("v1.0.1", "X", -0.25)]
    ledger = got.withColumn("ts_out_ms", F.lit(5))
    assert {r.name: json.loads(r.value)["n_trades"] for r in tables.summary_json(ledger).collect()} == {"EUR_USD": 1, "X": 1, "portfolio": 2}


def test_names(spark):
    df = spark.createDataFrame([("eurusd",), (" btc/usd",), ("side_long_v1",), ("spx",)], "c string")
    assert [r[0] for r in df.select(names.normal_instrument(F.col("c"))).collect()] == ["EUR_USD", "BTC_USD", "SIDE_LONG_V1", "SPX"]
    assert [r[0] for r in df.select(names.model_kind(F.col("c"), "unknown")).collect()] == ["unknown", "unknown", "long", "unknown"]
    assert [r[0] for r in df.select(names.model_kind(F.col("c"))).collect()] == ["eurusd", " btc/usd", "long", "spx"]
    assert [r[0] for r in spark.createDataFrame([("eur usd",), ("eur/ usd",)], "c string").select(names.normal_instrument(F.col("c"))).collect()] == ["EUR_USD", "EUR_USD"]


def test_models(spark):
    rows = spark.range(400).select(F.col("id").alias("rn"), F.lit("a").alias("instrument"), (F.col("id") % 10 / 10).alias("x"), F.lit(1.0).alias("flat"), (F.col("id") % 10 >= 5).cast("double").alias("y"))
    fitted = training.pipeline(["x", "flat"], training.candidates(2)["logreg"]()).fit(rows)
    scored = training.score(fitted, rows, history=F.col("rn"), least=50).collect()
    assert all(r.p == 0.5 for r in scored if r.rn < 50) and all((r.p > 0.5) == (r.y == 1) for r in scored if r.rn >= 50)
    assert training.score(None, rows).select("p").distinct().first().p == 0.5
    a, b = training.platt(rows.withColumn("p", F.col("x")))
    assert a > 0 > b
    with pytest.raises(ValueError):
        training.chosen("logreg, oracle", 2)


def test_trade_logs_in_one_pass(spark, tmp_path, monkeypatch):
    """One write whatever the number of instruments; names with blanks, slashes, signs and none come back; plain trees are read as before."""
    from pyspark.sql import DataFrameWriter

    from barflow.plans.files import P

    names = ["EUR/USD", "4-NOT SPECIFIED", "a+b=c%2F", None]
    rows = [(i, "own" if i % 5 == 0 else None, 0.5 * i, f"v1.0.{i % 2}", names[i % 4]) for i in range(40)]
    df = spark.createDataFrame(rows, "trade_id long, instrument string, realized_r double, version string, of string")
    tables.write_trade_logs(df, str(tmp_path / "logs"), log="of")
    got = frames.read_trade_logs(spark, str(tmp_path / "logs"), "*.json", "trade_id long, instrument string, realized_r double").select("trade_id", "instrument", "realized_r", "version")
    assert sorted(map(tuple, got.collect())) == [(i, own or of, r, v) for i, own, r, v, of in rows]
    plain = tmp_path / "plain" / "version=1" / "EUR USD"
    plain.mkdir(parents=True)
    (plain / "trades.jsonl").write_text('{"realized_r": 0.5}\n')
    assert [(r.version, r.instrument) for r in frames.read_trade_logs(spark, str(tmp_path / "plain"), "trades.jsonl", "realized_r double").collect()] == [("version=1", "EUR USD")]
    writes, write = [], DataFrameWriter.json
    monkeypatch.setattr(DataFrameWriter, "json", lambda self, *a, **k: (writes.append(a), write(self, *a, **k))[1])
    P.queries["s7_trade_logs"](spark, "/root/testdata/sf0.001").count()
    assert len(writes) == 1
