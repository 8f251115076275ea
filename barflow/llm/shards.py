"""
Shards of nearly equal size by longest-processing-time scheduling.

Documents with equal texts stay together. Groups of one size are interchangeable, so the heap on the driver takes them by size: how many
groups of each size, largest first, go to the least-loaded shard, one after another. The result is that of scheduling every group by
itself. What the driver handles is one row for each distinct size, at most the square root of twice the table's bytes by arithmetic (k
sizes that differ add up to k * k / 2 at least). Inside a size, groups are numbered and take the shards in turn. A group larger than a
share can't be cut and makes its shard larger than the rest, but no more than it must.

Nulls: a null text has no bytes and belongs with empty texts; its CRC is that of nothing. A null doc_id has a shard and a slot like
any other. Repeated rows have slots of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, skew_join

OVERHEAD = 8


def schedule(classes: list[tuple[int, int]], shards: int) -> list[list[int]]:
    """
    classes: (size, how many items have it), sizes positive. How many of each class every shard takes, when items go from the largest on
    to the least-loaded shard (of several, the lowest).

    A shard with load x takes its next items of one size at the loads x, x + size, x + 2 * size and so on; the lowest of those of all
    shards come first. All below a level are counted at once, the few that are left go through the heap.
    """
    loads, out = [0] * shards, [[]] * len(classes)
    heap = [(0, s) for s in range(shards)]
    for i in sorted(range(len(classes)), key=lambda i: -classes[i][0]):
        size, left = classes[i]
        took = [0] * shards
        if left > 4 * shards:
            below = lambda level, size=size: [max(0, -((x - level) // size)) for x in loads]
            low, high = min(loads), max(loads) + size * left + 1
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if sum(below(middle)) <= left else (low, middle)
            took = below(low)
            left -= sum(took)
            loads = [x + n * size for x, n in zip(loads, took, strict=True)]
            heap = sorted((x, s) for s, x in enumerate(loads))
        for _ in range(left):
            x, s = heap[0]
            heapq.heapreplace(heap, (x + size, s))
            loads[s] = x + size
            took[s] += 1
        out[i] = took
    return out


def sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("text"), text).alias("h2"))


def dealt(classes: list[tuple[int, int]], shards: int) -> pa.Table:
    """Per size the shards that take groups of it and the number at which each of them ends."""
    who, ends = [], []
    for took in schedule(classes, shards):
        at, names, stops = 0, [], []
        for s, n in enumerate(took):
            if n:
                at += n
                names.append(s)
                stops.append(at)
        who.append(names)
        ends.append(stops)
    return pa.table({"bytes": pa.array([c[0] for c in classes], pa.int64()), "who": pa.array(who, pa.list_(pa.int32())), "ends": pa.array(ends, pa.list_(pa.int64()))})


def assign(rows: DataFrame, shards: int) -> DataFrame:
    """rows: h1, h2 (a group's name), size and others, materialised; adds shard."""
    spark = rows.sparkSession
    groups = durable(rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows")))
    classes = [(c["bytes"], c["n"]) for c in groups.groupBy("bytes").agg(F.count("*").alias("n")).orderBy("bytes").collect()]  # distinct sizes
    turns = spark.createDataFrame(dealt(classes, shards))
    parts = max(64, sum(n for _, n in classes) // 20_000)  # a third of all groups may have one size
    groups = groups.withColumn("part", F.pmod("h1", F.lit(parts)).cast("int"))
    cells = groups.groupBy("bytes", "part").agg(F.count("*").alias("n"))
    cells = cells.withColumn("before", F.sum("n").over(Window.partitionBy("bytes").orderBy("part")) - F.col("n")).drop("n").join(turns, "bytes")
    number = F.row_number().over(Window.partitionBy("bytes", "part").orderBy("h1", "h2")) - 1
    placed = groups.withColumn("number", number).join(cells, ["bytes", "part"])
    turn = F.size(F.filter("ends", lambda end: end <= F.col("before") + F.col("number")))
    placed = durable(placed.select("h1", "h2", "n_rows", F.col("who")[turn].alias("shard")))
    return skew_join(rows, placed, ["h1", "h2"], "n_rows", "inner").drop("n_rows")


def slotted(rows: DataFrame, count: int, shards: int, order: list[str]) -> DataFrame:
    """Adds slot: each shard's rows numbered from 0 without gaps, in parts of about 20,000 that are counted first."""
    parts = max(64, count // (shards * 20_000))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    sizes = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = durable(sizes.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).drop("n"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*order)) - 1
    return rows.withColumn("inside", inside).join(before, ["shard", "part"]).withColumn("slot", (F.col("before") + F.col("inside")).cast("long")).drop("part", "inside", "before")


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law (always `bytes`), shard, slot, grown_shard (null: this law moves rows between all shards)."""
    rows = durable(sized(docs))
    placed = durable(assign(rows, shards))
    done = slotted(placed, placed.count(), shards, ["doc_id", "h1", "h2"])
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
