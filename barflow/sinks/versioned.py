"""
Tables that are changed by key without being written anew.

Rows lie in parts by a hash of their key. A change writes only the parts it touches, into a folder of its own version, and then one
small file, the list of which part is read from which versions. Readers take the newest list, so a job that fails before that file
leaves the table as it was; what it wrote is in no list, and the next attempt writes over it. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import kept
from .tables import kept_first, replaced

PART, VERSION = "kv_part", "kv_version"
#: Parts of a new table, to be chosen so that one of them fits a task; a part that rows were added to so often is written together.
PARTS, ADDED = 64, 16
LIST = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("parts", T.IntegerType()), T.StructField("version", T.LongType())])


def _newest(spark: SparkSession, path: str) -> tuple[int, int | None, list[tuple[int, int]]]:
    """The newest version (0: none), the number of parts, and which part is read from which version: ADDED rows a part at most."""
    try:
        lists = spark.read.schema(LIST).parquet(f"{path}/list")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return 0, None, []
        raise
    version = lists.agg(F.max("version")).first()[0] or 0
    rows = lists.where(F.col("version") == version).collect()
    return version, rows[0].parts if rows else None, [(r.part, r.at) for r in rows if r.part is not None]


def _read(spark: SparkSession, path: str, held: list[tuple[int, int]]) -> DataFrame:
    chosen: Column = F.lit(False)
    for at in sorted({v for _, v in held}):
        chosen = chosen | ((F.col(VERSION) == at) & F.col(PART).isin([p for p, v in held if v == at]))
    return spark.read.option("mergeSchema", True).parquet(f"{path}/data").where(chosen)


def read_versioned(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows; columns that were added later are null in older ones."""
    version, _, held = _newest(spark, path)
    if not version:
        raise ValueError(f"no table in {path}")
    return _read(spark, path, held).drop(PART, VERSION)


def _write(spark: SparkSession, path: str, version: int, parts: int, rows: DataFrame, held: list[tuple[int, int]]) -> None:
    rows.repartition(F.col(PART)).write.mode("overwrite").partitionBy(PART).parquet(f"{path}/data/{VERSION}={version}")
    schema = T.StructType(LIST.fields[:3])
    spark.createDataFrame([(p, v, parts) for p, v in held] or [(None, None, parts)], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/list/version={version}")


def _placed(new: DataFrame, keys: list[str], parts: int) -> tuple[DataFrame, list[int]]:
    rows = kept(new.withColumn(PART, F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")))
    return rows, sorted(r[0] for r in rows.select(PART).distinct().collect())  # `parts` at most


def replace_by_key(new: DataFrame, path: str, keys: list[str], parts: int = PARTS) -> None:
    """Rows of `new` take the place of those with their keys (K4). Other parts aren't read or written."""
    spark = new.sparkSession
    version, there, held = _newest(spark, path)
    rows, touched = _placed(new, keys, there or parts)
    if not touched:
        return
    own = [(p, v) for p, v in held if p in set(touched)]
    if own:
        rows = replaced(_read(spark, path, own).drop(VERSION), rows, keys)
    _write(spark, path, version + 1, there or parts, rows, [(p, v) for p, v in held if p not in set(touched)] + [(p, version + 1) for p in touched])


def insert_ignore(new: DataFrame, path: str, keys: list[str], parts: int = PARTS) -> None:
    """Adds the rows of `new`, one for each key, whose keys the table doesn't have (K5); of the touched parts only keys are read."""
    spark = new.sparkSession
    version, there, held = _newest(spark, path)
    rows, touched = _placed(new, keys, there or parts)
    own = [(p, v) for p, v in held if p in set(touched)]
    rows = rows if own else rows.dropDuplicates(keys)
    if own:
        rows = kept(kept_first(_read(spark, path, own), rows, keys))
        touched = sorted(r[0] for r in rows.select(PART).distinct().collect())
    if not touched:
        return
    often = {p for p in touched if sum(q == p for q, _ in held) >= ADDED}
    if often:
        rows = rows.unionByName(_read(spark, path, [(p, v) for p, v in held if p in often]).drop(VERSION), allowMissingColumns=True)
    _write(spark, path, version + 1, there or parts, rows, [(p, v) for p, v in held if p not in often] + [(p, version + 1) for p in touched])
