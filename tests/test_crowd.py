"""Books of a crowd by hand."""

import pytest
from pyspark.sql import functions as F

from barflow.operators import crowd

BUCKETS = "array<struct<price:double,long:double,short:double>>"


def test_crowd_features_by_hand(spark):
    """Buckets at the price count as above it; ranges hold their ends; what is null counts nothing."""
    book = [(99.5, 4.0, 1.0), (99.95, 2.0, 0.5), (100.0, 1.0, 3.0), (100.4, 0.5, 5.0), (103.0, 7.0, 9.0), (None, 1.0, 1.0), (100.1, None, 2.0)]
    df = spark.createDataFrame([("a", 100.0, book), ("b", None, book[:1]), ("c", 100.0, None), ("d", 100.0, [])], f"k string, px double, buckets {BUCKETS}")
    got = {r.k: r for r in crowd.crowd_features(df, F.col("px")).collect()}
    want = {"imbalance_near": 3.0 - 5.5, "imbalance_mid": 7.5 - 11.5, "bid_wall": 4.0, "ask_wall": 5.0, "bid_depth": 6.0, "ask_depth": 10.0, "depth_ratio": 0.6, "long_total": 15.5, "short_total": 21.5, "net_total": -6.0, "ratio_total": 15.5 / 21.5}
    assert {c: got["a"][c] for c in crowd.CROWD} == pytest.approx(want)
    assert (got["b"].long_total, got["b"].ratio_total, got["b"].bid_depth, got["b"].imbalance_mid) == (4.0, 4.0, 0.0, 0.0)
    assert all(got[k][c] == 0 for k in "cd" for c in crowd.CROWD)


def test_crowd_series_takes_the_next_price(spark):
    """A book is seen from the first price from its time on, behind the end from the last; one without any price is left out."""
    grid = spark.createDataFrame([("a", 10, 100.0), ("a", 20, 200.0)], "instrument string, ts_ms long, mid double")
    book = [(100.0, 0.0, 1.0), (200.0, 0.0, 2.0)]
    books = spark.createDataFrame([("a", 5, book), ("a", 10, book), ("a", 11, book), ("a", 30, book), ("z", 5, book)], f"instrument string, ts_ms long, buckets {BUCKETS}")
    assert {r.ts_ms: r.ask_depth for r in crowd.crowd_series(books, grid, 0.001, 0.005).collect()} == {5: 1.0, 10: 1.0, 11: 2.0, 30: 2.0}


def test_liquidity_matrix_bins(spark):
    """Two bins to a side of 100, each 1 wide: the lower edge is out, the upper one in, and the top edge out; the newest book counts."""
    grid = spark.createDataFrame([("a", 0, 100.0), ("a", 10, 100.0), ("a", 20, 100.0), ("a", 30, None)], "instrument string, ts_ms long, mid double")
    old = [(p, 1.0, 0.0) for p in (98.0, 98.5, 99.0, 99.5, 100.5, 101.5, 102.0)]
    new = [(99.5, 0.5, 2.0), (99.75, 1.0, None), (None, 1.0, 0.0)]
    books = spark.createDataFrame([("a", 5, old), ("a", 20, new), ("z", 5, old)], f"instrument string, ts_ms long, buckets {BUCKETS}")
    got = {(r.ts_ms, r.bin): r.net for r in crowd.liquidity_matrix(books, grid, 2, 0.02).collect()}
    assert got == {(10, 0): 2.0, (10, 1): 1.0, (10, 2): 1.0, (10, 3): 1.0, (20, 1): pytest.approx(-0.5)}
