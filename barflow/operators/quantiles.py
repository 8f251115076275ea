"""Exact quantiles by rank: counts of value ranges, refined only where a wanted rank lies, so that no task holds a key's values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import shared_path

#: Ranges that an interval is cut into in a round; rows of an interval from which on they are ranked themselves.
RANGES, FEW = 1024, 4096


def _table(df: DataFrame) -> DataFrame:
    """`df` written and read again: rounds of checkpoints would carry each other's estimates along."""
    path = shared_path(df.sparkSession, "ranks")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exact_quantiles(rows: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """
    `by`, and a column for each name of `at` (name -> share from 0 to 1): the interpolated quantile of `value`'s numbers, as Spark's
    percentile(). Nulls are left out; a key with nothing else has no row. `rows` is read once a round.

    A round counts, for each interval that a wanted rank lies in, the rows in each of its ranges, with their least and greatest value;
    a rank's range is its interval of the next round, until that holds one value only or few rows. Ranges are equally wide in one round
    and halve towards the interval's lower end in the next, so that values of any orders of magnitude are told apart in a few rounds.
    """
    some = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    whole = some.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    place = F.col("_q") * (F.col("_n") - 1)
    wanted = whole.withColumn("_q", F.explode(F.array(*(F.lit(float(q)) for q in sorted(set(at.values())))))).withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))))
    ranks = _table(wanted.select(*by, "_rank", "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_c")).distinct())
    w = Window.partitionBy(*by, "_lo", "_hi")
    inside = lambda: some.join(ranks.select(*by, "_lo", "_hi").distinct(), by).where("_v BETWEEN _lo AND _hi")
    found, rounds = [], 0
    while True:
        found.append(ranks.where("_lo = _hi").select(*by, "_rank", "_lo"))
        ranks = ranks.where("_lo < _hi")
        few = ranks.where(F.col("_c") <= FEW)
        ranked = some.join(few.select(*by, "_lo", "_hi").distinct(), by).where("_v BETWEEN _lo AND _hi").withColumn("_k", F.row_number().over(w.orderBy("_v")) - 1)
        found.append(few.join(ranked, [*by, "_lo", "_hi"]).where("_k = _rank - _below").select(*by, "_rank", F.col("_v").alias("_lo")))
        ranks = ranks.where(F.col("_c") > FEW)
        if ranks.isEmpty():
            break
        d, span = F.col("_v") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2  # halves, so that no difference overflows
        share = F.when(d > 0, 1 - F.least(F.log2(span / d), F.lit(1023.0)) / 1024).otherwise(0.0) if rounds % 2 else d / span
        counts = inside().withColumn("_range", F.least(F.floor(share * RANGES), F.lit(RANGES - 1))).groupBy(*by, "_lo", "_hi", "_range").agg(F.count("*").alias("_m"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        counts = counts.withColumn("_upto", F.sum("_m").over(w.orderBy("_range")))
        met = ranks.drop("_c").join(counts, [*by, "_lo", "_hi"]).where("_rank - _below >= _upto - _m AND _rank - _below < _upto")
        ranks = _table(met.select(*by, "_rank", F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), (F.col("_below") + F.col("_upto") - F.col("_m")).alias("_below"), F.col("_m").alias("_c")))
        rounds += 1
    values = reduce(DataFrame.unionByName, found).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_lo"))).alias("_m"))  # two entries for each share
    out = whole.join(values, by)

    def quantile(q: float) -> Column:
        p = F.lit(float(q)) * (F.col("_n") - 1)
        low, high = F.element_at("_m", F.floor(p)), F.element_at("_m", F.ceil(p))
        return low + (p - F.floor(p)) * (high - low)

    return out.select(*by, *(quantile(q).alias(name) for name, q in at.items()))
