"""
Lines that several documents share are kept in the first of them only.

The hashes seen so far are stored as sorted runs, bucketed by hash, in levels: a new batch is merge-joined with every run, its unseen
hashes become a run of level 0, and as soon as a level has `fanout` runs they are merged into one of the next. A run never needs a
shuffle again; only the batch moves.

Line keys are compared by a 128-bit hash. Nulls: a null text is one empty line; a document whose id is null neither loses lines nor
takes them from others. Rows that repeat a doc_id count as one document. An empty table gives no rows. Other columns stay as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, durable, fresh, let, skew_join, stored

MIN_CHARS = 10


class LineRuns:
    """The levelled store of line hashes: h1, h2 and the document that keeps the line."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.name = f"line_runs_{uuid.uuid4().hex[:12]}"
        self.made = 0

    def _write(self, keys: DataFrame, level: int) -> None:
        self.made += 1
        table = f"{self.name}_{self.made}"
        keys.select("h1", "h2", "owner").repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").saveAsTable(table)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)

    def runs(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def compact(self) -> None:
        """Merges the runs of every full level. Their keys are disjoint, so a run is their union."""
        for level, tables in enumerate(self.levels):
            if len(tables) >= self.fanout:
                whole = self.spark.table(tables[0])
                for t in tables[1:]:
                    whole = whole.unionByName(self.spark.table(t))
                self.levels[level] = []
                self._write(whole, level + 1)
                for t in tables:
                    self.spark.sql(f"DROP TABLE {t}")

    def add(self, keys: DataFrame) -> DataFrame:
        """
        keys: h1, h2, first, last (the least and greatest document of the batch), n; one row a key.
        Returns h1, h2, owner, n of the keys that later documents of the batch lose, and adds the unseen keys as a run.
        """
        self.compact()
        seen = [f"seen{i}" for i in range(len(self.runs()))]
        for name, table in zip(seen, self.runs(), strict=True):
            keys = keys.join(self.spark.table(table).withColumnRenamed("owner", name).hint("merge"), ["h1", "h2"], "left")
        known = F.coalesce(*(F.col(s) for s in seen)) if seen else F.lit(None).cast("long")
        joined = durable(keys.select("h1", "h2", "last", "n", known.alias("known"), F.coalesce(known, "first").alias("owner")))
        self._write(joined.where("known IS NULL"), 0)
        return joined.where("owner < last").select("h1", "h2", "owner", "n")

    def drop(self) -> None:
        for t in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self.levels = []


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def dropped_lines(docs: DataFrame, batches: int = 4, min_chars: int = MIN_CHARS, fanout: int = 2) -> DataFrame:
    """doc_id, row_key, places: the numbers, from 0, of the lines that a document loses. Documents enter in the order of their ids."""
    spark = docs.sparkSession
    cuts = (docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10000)).first()[0] or []) if batches > 1 else []
    batch = sum(((F.col("doc_id") > c).cast("int") for c in cuts), F.lit(0))
    lines = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("row_key"), batch.alias("batch"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    lines = lines.select("batch", "doc_id", "row_key", "place", line_key(F.col("line")).alias("k")).where(F.char_length("k") >= min_chars)
    lines = stored(lines.select("doc_id", "row_key", "place", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("line"), "k").alias("h2"), "batch"), "lines", "batch")
    runs, lost = LineRuns(spark, fanout), None
    for b in range(len(cuts) + 1):
        keys = lines.where(F.col("batch") == b).groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
        found = runs.add(keys).withColumn("batch", F.lit(b))
        lost = found if lost is None else lost.unionByName(found)
    runs.drop()
    hit = skew_join(lines, lost, ["batch", "h1", "h2"], "n", how="inner").where("doc_id > owner")
    return hit.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set("place")).alias("places"))


def without(lines: Column, places: Column) -> Column:
    """The lines but those at `places` (sorted, from 0), joined again; linear in the number of lines."""
    gone = let(places, lambda d: F.flatten(F.transform(d, lambda p, k: F.concat(F.array_repeat(F.lit(False), p - F.coalesce(F.get(d, k - 1), F.lit(-1)) - 1), F.array(F.lit(True))))))
    return F.array_join(F.zip_with(lines, gone, lambda line, g: F.when(g, F.lit(None)).otherwise(line)), "\n")


def drop_repeated_lines(docs: DataFrame, batches: int = 4, min_chars: int = MIN_CHARS, fanout: int = 2, counts: tuple[str, str] | None = None) -> DataFrame:
    """
    `docs` with the text that remains. A key of `min_chars` characters or more stays only in the smallest doc_id that has it.
    counts: names of two further columns, lines before and lines dropped.
    """
    lost = dropped_lines(docs, batches, min_chars, fanout)
    same = (F.col("d.doc_id") == F.col("x.doc_id")) & (F.xxhash64("d.text") == F.col("x.row_key"))
    places = fresh(docs, "places")
    both = docs.alias("d").join(lost.withColumnRenamed("places", places).alias("x"), same, "left").select(*(F.col(f"d.`{c}`") for c in docs.columns), F.col(f"x.{places}"))
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    kept = F.when(F.col(places).isNull(), F.col("text")).otherwise(without(lines, F.col(places)))
    more = [F.size(lines).cast("long").alias(counts[0]), F.coalesce(F.size(places), F.lit(0)).cast("long").alias(counts[1])] if counts else []
    return both.select(*(kept.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns), *more)
