"""Cross-validation splits that leak nothing: purged k-fold, combinatorial, walk-forward."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import number_rows


def folds(df: DataFrame, k: int, by: list[str], tie: list[str]) -> DataFrame:
    """Adds rn, n and fold: k runs of equal length in time order, the last with the remainder."""
    rows = number_rows(df, by, "t0", tie)
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    size = F.greatest(F.floor(F.col("n") / k), F.lit(1))
    return rows.join(F.broadcast(n), by).withColumn("fold", F.least(F.floor((F.col("rn") - 1) / size), F.lit(k - 1)).cast("int"))


def bounds(rows: DataFrame, by: list[str]) -> DataFrame:
    """k rows a key, whatever the data's size."""
    return rows.groupBy(*by, "fold").agg(F.min("t0").alias("lo"), F.max("t1").alias("hi"), F.max("rn").alias("last"), F.max("n").alias("n"))


def purged_kfold(df: DataFrame, k: int, embargo: float, by: list[str], tie: list[str]) -> DataFrame:
    """(split, role) for every row: test, or train, but neither if it overlaps the test block (both ends count) or is embargoed after it."""
    rows = folds(df, k, by, tie)
    b = F.broadcast(bounds(rows, by).select(*by, F.col("fold").alias("split"), "lo", "hi", "last"))
    pairs = rows.join(b, by)
    gap = F.round(F.col("n") * embargo)
    clash = (F.col("t0") <= F.col("hi")) & (F.col("t1") >= F.col("lo"))
    held = (F.col("rn") > F.col("last")) & (F.col("rn") <= F.col("last") + gap)
    role = F.when(F.col("fold") == F.col("split"), "test").when(clash | held, None).otherwise("train")
    return pairs.withColumn("role", role).where("role IS NOT NULL").select(*df.columns, "split", "role")


def cpcv(df: DataFrame, groups: int, k: int, embargo: float, by: list[str], tie: list[str]) -> DataFrame:
    """All choices of k test groups of `groups`; train rows are purged against each test group by itself."""
    rows = folds(df, groups, by, tie)
    spark = df.sparkSession
    chosen = spark.createDataFrame([(i, list(c)) for i, c in enumerate(combinations(range(groups), k))], "split int, chosen array<int>")
    b = bounds(rows, by).groupBy(*by).agg(F.collect_list(F.struct("fold", "lo", "hi", "last")).alias("blocks"))
    pairs = rows.join(F.broadcast(b), by).crossJoin(F.broadcast(chosen))  # C(groups, k) rows, a parameter
    gap = F.round(F.col("n") * embargo)
    clash = F.exists("blocks", lambda x: F.array_contains("chosen", x["fold"]) & (((F.col("t0") <= x["hi"]) & (F.col("t1") >= x["lo"])) | ((F.col("rn") > x["last"]) & (F.col("rn") <= x["last"] + gap))))
    role = F.when(F.array_contains("chosen", F.col("fold")), "test").when(clash, None).otherwise("train")
    return pairs.withColumn("role", role).where("role IS NOT NULL").select(*df.columns, "split", "role")


def walk_forward(df: DataFrame, share: float, purge: int, by: list[str], tie: list[str]) -> DataFrame:
    """The first `share` of each key's rows train, but for the last `purge` of them; the rest test."""
    rows = number_rows(df, by, "t0", tie).join(F.broadcast(df.groupBy(*by).agg(F.count("*").alias("n"))), by)
    cut = F.floor(F.col("n") * share)
    role = F.when(F.col("rn") > cut, "test").when(F.col("rn") <= cut - purge, "train")
    return rows.withColumn("role", role).where("role IS NOT NULL").select(*df.columns, "role")
