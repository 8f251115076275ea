"""
Near-duplicate documents by SimHash, found by exact comparison in tiles.

A document's fingerprint is taken where its text is read. Equal fingerprints are one node. Two fingerprints that differ in at most
`radius` bits agree in at least one of radius + 1 blocks of bits, so the grid of all pairs is cut, without loss, into squares of
fingerprints that share a block, and squares with many rows are cut by a hash. A task sorts its square's rows by number of set bits
and compares them tile by tile, by numpy exclusive-or and bit counts; a pair of tiles whose numbers of set bits are further apart
than the radius is skipped. Of the links in a square it returns a spanning forest, so a group of n copies gives fewer than n links.

Nulls: a null text, like an empty one, has the fingerprint zero and is linked like any other. A null doc_id is compared, and is never
the name of a component unless all its documents have none. Repeated rows have equal fingerprints, so they are linked. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, skew_join
from .components import connected_components

SHINGLE, RADIUS, SEED = 4, 4, 42
TILE = 512
#: Of all words at once, so that the bits of very long texts need no more memory than this many shingles.
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is set if it is in over half the XXH64 hashes of the text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashed = xxhash.xxh64_intdigest
    hashes = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed number); the text isn't shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64), pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, fp long")


def linked(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two sets of fingerprints (the same set twice: inside it), as pairs of fingerprints."""
    same = a is b
    a = a[np.argsort(np.bitwise_count(a), kind="stable")]
    b = a if same else b[np.argsort(np.bitwise_count(b), kind="stable")]
    pa_, pb = np.bitwise_count(a).astype(int), np.bitwise_count(b).astype(int)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            parent[x] = x = parent.get(y, y)
        return x

    out = []
    for i in range(0, len(a), TILE):
        x, low, high = a[i : i + TILE], pa_[i], pa_[min(i + TILE, len(a)) - 1]
        for j in range(i if same else 0, len(b), TILE):
            if pb[j] > high + radius:
                break
            if pb[min(j + TILE, len(b)) - 1] < low - radius:
                continue
            near = np.bitwise_count(x[:, None] ^ b[None, j : j + TILE]) <= radius
            for r, c in zip(*(k.tolist() for k in np.nonzero(near)), strict=True):
                p, q = int(x[r]), int(b[j + c])
                if p != q and (s := root(p)) != (t := root(q)):
                    parent[t] = s
                    out.append((p, q))
    return out


def near_links(nodes: DataFrame, count: int, radius: int = RADIUS, most: int | None = None) -> DataFrame:
    """nodes: fp, distinct, `count` of them. Returns a, b: links that connect all fingerprints that `radius` or fewer bits divide."""
    most = most or min(50_000, max(2_000, count // 100))
    blocks = radius + 1
    width = 64 // blocks
    bits = max(0, min(width, (count // 2_000).bit_length()))  # agreeing on a block means agreeing on its first bits
    squares = nodes.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", k * width).bitwiseAND((1 << bits) - 1).alias("part")) for k in range(blocks)))).alias("s")).select("fp", "s.*")
    sizes = squares.groupBy("block", "part").agg(F.count("*").alias("n")).where(F.col("n") > most)  # (radius + 1) * 2 ** 12 rows at most
    cut = F.broadcast(sizes.select("block", "part", F.ceil(F.col("n") / F.lit(most)).cast("int").alias("cuts")))
    placed = squares.join(cut, ["block", "part"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    pairs = pairs.select("fp", "block", "part", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        fp, own = table.column("fp").to_numpy().view(np.uint64), table.column("own").to_numpy()
        i, j = key[2].as_py(), key[3].as_py()
        one = fp[own == i]
        found = np.array(linked(one, one if i == j else fp[own == j], radius), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    return pairs.groupBy("block", "part", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links of `radius` or fewer differing bits reach, itself included."""
    rows = durable(fingerprints(docs, shingle))
    nodes = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("members")))
    roots = durable(connected_components(near_links(nodes.select("fp"), nodes.count(), radius)))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = durable(named)
    best = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = durable(skew_join(named, durable(best), ["root"], "n", how="inner").select("fp", "members", "component_id"))
    return skew_join(rows, named, ["fp"], "members", how="inner").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """
    One document of each component, the one with the smallest doc_id, with all its columns. Rows that repeat a doc_id stay together.
    Rows without doc_id go where their component has a document with one; of a component without any, one row stays, that with the
    smallest hash of its text.
    """
    found = durable(near_duplicates(docs, shingle, radius))
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.alias("d").join(kept.alias("k"), F.col("d.doc_id") == F.col("k.doc_id"), "left_semi").select(*(F.col(f"d.`{c}`") for c in docs.columns))
    loose = found.where("doc_id IS NULL AND component_id IS NULL").select("fp").distinct()
    if loose.isEmpty():
        return named

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    # one row of each text, under a number of its own, so that components of these rows get names
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.where("doc_id IS NULL").select(row.alias("row"), F.col("text"), fp("text").alias("fp")).join(loose, "fp", "left_semi")
    rows = durable(rows.groupBy(F.xxhash64(F.coalesce("text", F.lit(""))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).agg(F.min_by("row", F.to_json("row")).alias("row")))
    first = near_duplicates(rows.select("doc_id", "text"), shingle, radius).where("doc_id = component_id").select("doc_id").distinct()
    return named.unionByName(rows.join(first, "doc_id", "left_semi").select("row.*"))
