"""Books of a crowd's orders or positions: shares of long and short by price, seen from the current price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import asof_join

BY = ["instrument"]
#: The values of crowd_features(); ranges around the price of near and mid values, for books of orders and of positions.
CROWD = ("imbalance_near", "imbalance_mid", "bid_wall", "ask_wall", "bid_depth", "ask_depth", "depth_ratio", "long_total", "short_total", "net_total", "ratio_total")
RANGES = {"ob": (0.001, 0.005), "pb": (0.01, 0.05)}
LEAST = 1e-10


def crowd_features(books: DataFrame, price: Column, near: float = 0.001, mid: float = 0.005) -> DataFrame:
    """
    books: buckets (array of price, long, short) and other columns; adds CROWD (A16): long less short within `near` and `mid` of the price,
    the largest and all long shares below it and short shares from it on (within `mid`), their ratio, totals, their difference and ratio.
    A bucket without a price counts in totals only; without a price, or without buckets, everything else is 0, as are shares that are null.
    """
    share = lambda x, c: F.coalesce(x[c].cast("double"), F.lit(0.0))
    within = lambda x, f: F.coalesce(x["price"].between(price * (1 - f), price * (1 + f)), F.lit(False))
    below = lambda x: within(x, mid) & (x["price"] < price)
    above = lambda x: within(x, mid) & (x["price"] >= price)
    long, short = (lambda x: share(x, "long")), (lambda x: share(x, "short"))
    parts = {"near_long": (near, long), "near_short": (near, short), "mid_long": (mid, long), "mid_short": (mid, short)}
    start = F.struct(*(F.lit(0.0).alias(n) for n in (*parts, "bid_wall", "ask_wall", "bid_depth", "ask_depth", "long_total", "short_total")))

    def add(a: Column, x: Column) -> Column:
        bid, ask = F.when(below(x), long(x)).otherwise(0.0), F.when(above(x), short(x)).otherwise(0.0)
        sums = [(a[n] + F.when(within(x, f), of(x)).otherwise(0.0)).alias(n) for n, (f, of) in parts.items()]
        walls = [F.greatest(a["bid_wall"], bid).alias("bid_wall"), F.greatest(a["ask_wall"], ask).alias("ask_wall"), (a["bid_depth"] + bid).alias("bid_depth"), (a["ask_depth"] + ask).alias("ask_depth")]
        return F.struct(*sums, *walls, (a["long_total"] + long(x)).alias("long_total"), (a["short_total"] + short(x)).alias("short_total"))

    def values(s: Column) -> Column:
        over = lambda a, b: a / F.greatest(b, F.lit(LEAST))
        made = {"imbalance_near": s["near_long"] - s["near_short"], "imbalance_mid": s["mid_long"] - s["mid_short"], "depth_ratio": over(s["bid_depth"], s["ask_depth"]), "net_total": s["long_total"] - s["short_total"], "ratio_total": over(s["long_total"], s["short_total"])}
        return F.struct(*((made[c] if c in made else s[c]).alias(c) for c in CROWD))

    found = books.withColumn("_crowd", F.aggregate(F.coalesce("buckets", F.array()), start, add, values))
    return found.withColumns({c: F.col(f"_crowd.{c}") for c in CROWD}).drop("_crowd")


def crowd_series(books: DataFrame, grid: DataFrame, near: float, mid: float) -> DataFrame:
    """
    books: instrument, ts_ms, buckets. grid: instrument, ts_ms, mid. CROWD of each book at the first price from its time on, or the last
    price there is: instrument, ts_ms and values, as grid_features() takes them (W31). Books of instruments without a price are left out.
    """
    priced = asof_join(books.select(*BY, "ts_ms", "buckets"), grid.select(*BY, "ts_ms", F.col("mid").alias("_price")), BY, ["_price"], "forward", clamp=True)
    return crowd_features(priced.where("_price IS NOT NULL"), F.col("_price"), near, mid).select(*BY, "ts_ms", *CROWD)


def liquidity_matrix(books: DataFrame, grid: DataFrame, bins_per_side: int = 20, range_pct: float = 0.005, tie: list[str] | None = None) -> DataFrame:
    """
    Long less short of the newest book of each step of the grid, by bins of equal width around that step's price (A18): instrument, ts_ms,
    bin (0 to 2 * bins_per_side - 1, from low to high) and net, for bins with buckets. A bin holds its upper edge, not its lower one, and
    the top edge belongs to none. Steps before the first book, or without a price, have no rows.
    """
    price = F.col("mid")
    low, width = price * (1 - range_pct), price * range_pct / bins_per_side
    newest = asof_join(grid.select(*BY, "ts_ms", "mid"), books.select(*BY, "ts_ms", *(tie or []), "buckets"), BY, ["buckets"], tie=tie)
    cells = newest.select(*BY, "ts_ms", "mid", F.explode("buckets").alias("_x")).where((F.col("_x.price") > low) & (F.col("_x.price") < price * (1 + range_pct)))
    place = F.least(F.ceil((F.col("_x.price") - low) / width) - 1, F.lit(2 * bins_per_side - 1)).cast("int")
    return cells.groupBy(*BY, "ts_ms", place.alias("bin")).agg(F.sum(F.coalesce("_x.long", F.lit(0.0)) - F.coalesce("_x.short", F.lit(0.0))).alias("net"))
