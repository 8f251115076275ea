"""
Mixing sources to target weights without sorting any documents.

Every document has a hash. A source's budget beyond its whole copies is met by a threshold on the hash: words are summed in 1024
buckets of the hash, the bucket in which the budget ends is cut into 1024 again, and so on until it holds one hash. Only that bucket
is looked at again, so after the first pass almost nothing is. Thresholds are nested: a larger budget takes a superset.

Nulls: a null text has no words; a null source is a source of its own and comes last. Rows with the same doc_id have the same hash
and are taken or left together. A source without words has a target of 0. An empty table gives no rows. mixed_documents() keeps other columns, mix() leaves them out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, fresh, n_words_of, skew_join

BITS, STEP = 60, 10
WEIGHTS = (1, 2, 3)


def doc_hash(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id's decimal digits."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """`sources` (src, one row each) with `place`, from 0 in the order of code points, null last; sorted by ranges, not in one task."""
    spark = sources.sparkSession
    dealt = sources.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("is_null"), F.col("src")).withColumn("part", F.spark_partition_id())
    dealt = durable(dealt)
    before = dealt.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")  # one row a partition
    inside = F.row_number().over(Window.partitionBy("part").orderBy("is_null", "src")) - 1
    return dealt.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn("place", F.col("inside") + F.col("before")).drop("part", "inside", "before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = 3) -> DataFrame:
    """
    `sources` has source_size; adds weight and target. The budget, all words there are, is shared by weight; no target exceeds
    `limit` times its source, and what is above is shared by weight among the others until none is.
    """
    place = numbered(sources)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    s = durable(place.withColumn("weight", weight).withColumn("cap", F.col("source_size") * limit).withColumn("full", F.lit(False)).drop("place"))
    budget = s.agg(F.sum("source_size")).first()[0] or 0
    while True:  # each round fills at least one source more; few are needed
        row = s.agg(F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)), F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight")))).first()
        left, open_ = budget - (row[0] or 0), max(row[1] or 0, 1)
        share = F.lit(left) * F.col("weight") / F.lit(open_)
        over = F.col("full") | (share > F.col("cap"))
        if s.where(over & ~F.col("full")).isEmpty():
            break
        s = durable(s.withColumn("full", over))
    return s.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share)).drop("weight", "cap", "full")


def thresholds(docs: DataFrame, wants: DataFrame) -> DataFrame:
    """
    docs: src, size, h. wants: src, members, rest (words to take, less than the source has). Returns src, below: documents with a
    smaller hash are taken; the one at the border is, if that comes closer.
    """
    done, rows = None, docs
    at = durable(wants.select("src", "members", "rest", F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("acc")))
    for shift in range(BITS - STEP, -1, -STEP):
        end = F.col("base") + F.lit(1 << (shift + STEP))
        inside = skew_join(rows, at, ["src"], "members", how="inner").where((F.col("h") >= F.col("base")) & (F.col("h") < end))
        members = F.max("members")
        if shift < BITS - STEP:  # a 1024th of the rows: kept, as all that is still needed
            inside = durable(inside)
            rows, members = inside.select("src", "size", "h"), F.lit(None).cast("long")
        sums = inside.groupBy("src", F.shiftright(F.col("h") - F.col("base"), shift).alias("b")).agg(F.sum("size").alias("words"), F.min("h").alias("least"), F.max("h").alias("most"), F.count("*").alias("n"), members.alias("members"), *(F.max(c).alias(c) for c in ("base", "acc", "rest")))
        upto = sums.withColumn("upto", F.col("acc") + F.sum("words").over(Window.partitionBy("src").orderBy("b")))  # 1024 rows a source at most
        border = upto.where((F.col("words") > 0) & (F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
        border = durable(border.select("src", F.coalesce("members", "n").alias("members"), "rest", "least", "most", "words", (F.col("base") + F.call_function("shiftleft", F.col("b"), F.lit(shift))).alias("base"), (F.col("upto") - F.col("words")).alias("acc")))
        closer = F.col("acc") + F.col("words") - F.col("rest") < F.col("rest") - F.col("acc")
        one = border.where("least = most").select("src", F.when(closer, F.col("least") + 1).otherwise(F.col("least")).alias("below"))
        done = one if done is None else done.unionByName(one)
        at = border.where("least < most").select("src", "members", "rest", "base", "acc")
        if at.isEmpty():
            break
    return done


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = 3, names: tuple[str, ...] = ("size", "source_size", "target", "taken")) -> DataFrame:
    """
    docs: doc_id, text, source. Returns doc_id, source and, named by `names`: words, words of the source, the source's target, and words that the
    mix takes from the document: a whole number of copies of it, 0 to `limit`.
    """
    plan = plan_mix(docs.select("doc_id", "source", n_words_of(F.col("text")).alias("size")), weights, limit)
    size, source_size, target, taken = names
    return plan.select("doc_id", "source", F.col("size").alias(size), F.col("source_size").alias(source_size), F.col("target").alias(target), F.col("taken").alias(taken))


def plan_mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = 3) -> DataFrame:
    """sized: doc_id, source, size and others; adds source_size, target, copies, taken."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("?"))
    rows = durable(sized.withColumn("src", key).withColumn("h", doc_hash(F.col("doc_id"))))
    sources = rows.groupBy("src").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("members"))
    shared = targets(sources.withColumn("is_null", F.col("source").isNull()).drop("source"), weights, limit).drop("is_null")
    size = F.col("source_size")
    whole = F.when(size == 0, 0).otherwise(F.floor(F.col("target") / size)).cast("int")
    wants = durable(shared.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * size))
    cut = durable(wants.join(thresholds(rows.select("src", "size", "h"), wants.where("rest > 0")), "src", "left"))
    joined = skew_join(rows, cut.select("src", "members", "source_size", "target", "whole", "below"), ["src"], "members", how="inner")
    copies = F.col("whole") + F.coalesce(F.col("h") < F.col("below"), F.lit(False)).cast("int")
    return joined.withColumn("copies", copies).withColumn("taken", (F.col("size") * F.col("copies")).cast("long")).drop("src", "h", "members", "whole", "below")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = 3) -> DataFrame:
    """The documents that the mix takes words from, each as often as it is taken, with all their columns; ones without words go."""
    names = [fresh(docs, n) for n in ("doc_key", "copies_taken")]
    plan = plan_mix(docs.select("doc_id", "source", F.xxhash64("text").alias("row_key"), n_words_of(F.col("text")).alias("size")), weights, limit)
    taken = plan.where("taken > 0").select("doc_id", "row_key", "source", "copies").distinct()
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.xxhash64("d.text") == F.col("p.row_key")) & F.col("d.source").eqNullSafe(F.col("p.source"))
    both = docs.alias("d").join(taken.select("doc_id", "row_key", "source", F.col("copies").alias(names[1])).alias("p"), same).select(*(F.col(f"d.`{c}`") for c in docs.columns), F.col(f"p.{names[1]}"))
    return both.withColumn(names[0], F.explode(F.sequence(F.lit(1), F.col(names[1])))).select(*(F.col(f"`{c}`") for c in docs.columns))
