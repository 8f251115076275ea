"""
Rows that no other row dominates, without comparing all pairs.

Every partition gives up what its own rows dominate, before anything is shuffled. What is left is cut into ranges of the first measure,
and the skylines of neighbouring ranges are merged, eight at a time, until one is left: the front itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are held against the skyline so far at once, and rows of that taken at once; ranges that are merged into one.
ROWS, AGAINST, MERGED = 256, 2048, 8


def _dominated(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), bool)
    for k in range(0, len(by), AGAINST):
        b = by[k : k + AGAINST, None]
        out |= ((b <= rows).all(axis=2) & (b < rows).any(axis=2)).any(axis=0)
    return out


def skyline_of(costs: np.ndarray) -> np.ndarray:
    """Which rows nothing dominates: nothing that is as small in every column and smaller in one. Sorted, a row can only be dominated by rows before it."""
    order = np.lexsort(costs.T[::-1])
    front, places = np.empty((0, costs.shape[1])), []
    for k in range(0, len(order), ROWS):
        block = order[k : k + ROWS]
        block = block[~_dominated(costs[block], front)]
        block = block[~_dominated(costs[block], costs[block])]
        front, places = np.concatenate((front, costs[block])), [*places, block]
    out = np.zeros(len(costs), bool)
    out[np.concatenate(places) if places else []] = True
    return out


def skyline(rows: DataFrame, better: list[str], worse: list[str], ranges: int | None = None) -> DataFrame:
    """
    The rows that no other is at least as good as in all measures and better in one (`better`: more is better, `worse`: less is). Rows
    that are equal in all stay together; rows with a null or NaN measure are compared with none and stay.
    """
    measures = [*((c, -1.0) for c in better), *((c, 1.0) for c in worse)]
    known = F.lit(True)
    for c, _ in measures:
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    first = F.col(measures[0][0]) * measures[0][1]

    def left(table: pa.Table) -> pa.Table:
        costs = np.column_stack([s * table.column(c).to_pandas().astype("float64").to_numpy() for c, s in measures])
        return table.filter(pa.array(skyline_of(costs)))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = None
        for b in batches:
            t = pa.Table.from_batches([b])
            so_far = left(t if so_far is None else pa.concat_tables([so_far, t]))
        yield from so_far.to_batches() if so_far is not None else []

    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = rows.where(known).mapInArrow(local, rows.schema).repartitionByRange(n, first).mapInArrow(local, rows.schema).withColumn("_range", F.spark_partition_id())
    schema = some.schema
    while n > 1:
        n = -(-n // MERGED)
        some = some.withColumn("_range", F.floor(F.col("_range") / MERGED).cast("int")).groupBy("_range").applyInArrow(left, schema)
    return some.drop("_range").unionByName(rows.where(~known))
