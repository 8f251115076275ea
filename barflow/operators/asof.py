"""As-of and forward range joins of long series; neither puts a whole series into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY = 86_400_000


def asof_join(left: DataFrame, right: DataFrame, by: list[str], values: list[str], direction: str = "backward", ts: str = "ts_ms", tie: list[str] | None = None, clamp: bool = False, slice_ms: int = DAY) -> DataFrame:
    """
    `left` with `values` of the latest right row at or before its time (forward: the earliest at or after it), null if there is none.
    Of right rows of one time the last by `tie` counts (forward: the first). clamp (forward): beyond the end, the last right row.

    Both sides are cut into time slices; inside a slice one window finds the row, and what earlier slices hand on is one row a slice.
    """
    back = direction == "backward"
    cut = F.floor(F.col(ts) / slice_ms).alias("_slice")
    order = F.struct(ts, *(tie or []))
    row = F.struct(*values)
    both = left.select("*", cut, F.lit(None).cast(right.select(row.alias("v")).schema["v"].dataType).alias("_v"), F.lit(1 if back else 0).alias("_side"))
    marks = right.select(*by, ts, *(tie or []), cut, row.alias("_v"), F.lit(0 if back else 1).alias("_side"), F.lit(True).alias("_right"))
    union = both.withColumn("_right", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    way = F.asc if back else F.desc  # forward reads backwards: a frame that ends at the last row is read anew for every row
    inner = Window.partitionBy(*by, "_slice").orderBy(*(way(c) for c in (ts, "_side", *(tie or []))))
    near = F.last("_v", True).over(inner.rowsBetween(Window.unboundedPreceding, 0))
    found = union.withColumn("_near", near).where(~F.col("_right"))
    ends = right.groupBy(*by, cut).agg((F.max_by if back else F.min_by)(row, order).alias("_end"))
    slices = left.select(*by, cut).distinct().join(ends, [*by, "_slice"], "full")
    outer = Window.partitionBy(*by).orderBy(way("_slice"))
    handed = F.last("_end", True).over(outer.rowsBetween(Window.unboundedPreceding, -1))
    out = found.join(slices.select(*by, "_slice", handed.alias("_handed")), [*by, "_slice"])
    value = F.coalesce("_near", "_handed")
    if clamp and not back:
        last = right.groupBy(*by).agg(F.max_by(row, order).alias("_last"))
        out, value = out.join(F.broadcast(last), by, "left"), F.coalesce("_near", "_handed", "_last")  # one row a key
    return out.withColumn("_got", value).select(*left.columns, *(F.col(f"_got.{v}").alias(v) for v in values))


def forward_range(events: DataFrame, bars: DataFrame, by: list[str], horizon: int, rn: str = "rn") -> DataFrame:
    """Each event (by, rn, ...) with each of the next `horizon` bars (their columns prefixed b_); an equi-join on row buckets."""
    first, last = F.floor((F.col(rn) + 1) / horizon), F.floor((F.col(rn) + horizon) / horizon)
    e = events.withColumn("_bucket", F.explode(F.sequence(first, last)))
    b = bars.select(*by, F.floor(F.col(rn) / horizon).alias("_bucket"), *(F.col(c).alias(f"b_{c}") for c in bars.columns if c not in by))
    return e.join(b, [*by, "_bucket"]).where((F.col(f"b_{rn}") > F.col(rn)) & (F.col(f"b_{rn}") <= F.col(rn) + horizon)).drop("_bucket")
