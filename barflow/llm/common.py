"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, which separates words.
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only in local sessions that set none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="barflow-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared folder, so that a lost executor costs nothing but a read."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, for results of which later steps read columns or partitions."""
    path = new_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value), where `value` is computed once however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def n_words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACES))).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() does the same, faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or something like it, that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "left", parts: int = 1000, total: int | None = None, least: int = 0) -> DataFrame:
    """
    `left` joined with `right`, which has one row for each key and in `weight` the number of rows of `left` with that key.

    Keys with more than a `parts`-th of all rows, fewer than `parts` by arithmetic, are broadcast, so their rows stay where they are;
    the other keys meet by a shuffle in which none can be large. Both frames are read twice: pass materialised ones. Keys aren't null.
    With `least`, keys of at most so many rows aren't broadcast either, and where no key has more the join is one shuffle instead of three joins.
    """
    most = total
    if total is None or total > least > 0:
        most, known = right.agg(F.max(weight), F.sum(weight)).first()
        total = (known or 0) if total is None else total
    bound = max(total, least * parts)
    if least and (most or 0) * parts <= bound:
        return left.join(right, keys, how)
    hot = F.broadcast(right.where(F.col(weight) * parts > bound))
    cold = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col(weight) * parts <= bound), keys, how)
    return left.join(hot, keys, "inner").select(*cold.columns).unionByName(cold)


def sifted(df: DataFrame, by: str, among: DataFrame, name: str, positions: int = 1 << 27) -> DataFrame:
    """
    `df` with a boolean column `name`: false where no row of `among` has this value of `by`, true where one has, and where one with the
    same place in a bitmap has. So rows that a join would drop needn't be shuffled for it. The bitmap, which is broadcast, has at most
    positions / 64 rows whatever the data; a fuller one lets more rows through and loses none.
    """
    place = F.pmod(F.xxhash64(by), F.lit(positions).cast("long"))
    word, bit = F.shiftright(place, 6).alias("sieve_word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({by}), 64L) AS int))")
    bits = durable(among.groupBy(word).agg(F.bit_or(bit).alias("sieve_bits")))
    met = df.withColumn("sieve_word", F.shiftright(place, 6)).join(F.broadcast(bits), "sieve_word", "left")
    return met.withColumn(name, F.coalesce(F.col("sieve_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("sieve_word", "sieve_bits")


def null_safe(left: str, right: str, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names))
