"""
Exact top-k search by inner product with a bit-sliced index.

Vectors are dealt into blocks of rows. A block's index holds, for each dimension, its components' leading bits as bitmaps over the
rows. For a query, bitmaps are added with carries into the slices of an approximate score, once for each set bit of each query
component; components of negative ones are taken complemented. From the most significant slice downward the k-th largest score is
found by counting bits. The error of leaving out the trailing bits has a bound, so rows whose approximate score reaches the k-th less
that bound are all that can be in the answer; for these the inner product is taken exactly. Every row is indexed, nothing is
sampled, and the answer is exact.

Nulls: vectors that are null or hold a null or a component that isn't finite take no part, nor do rows without an id. Vectors are
compared with those of their own length. Rows that repeat an id and vector count once; one id with several vectors has several
candidates, and as a query gets the best of what its vectors find. Ties go to the smaller id. An empty table gives no rows. Other
columns are ignored. Components beyond 2 ** 61 after scaling count as 2 ** 61, and scores beyond a long as the nearest long; sums that
don't fit 62 bits are taken with whole numbers of any length. The index is built once for each block and stored beside its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable

SCALE, SLICES = 1024, 7
#: Rows of a block, queries of a chunk, and queries whose slices are in memory at once.
ROWS, CHUNK, TOGETHER = 8192, 1024, 32
LARGEST, SAFE = 1 << 61, 1 << 62


def quantised(df: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component, for the vectors that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    held = lambda x: F.least(F.greatest(x, F.lit(-LARGEST).cast("long")), F.lit(LARGEST).cast("long"))
    whole = F.transform(vector, lambda x: held(F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-4e18)), F.lit(4e18))).cast("long")))
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite).select(F.col(key).cast("long").alias("vec_id"), whole.alias("v"))


class Block:
    """The index of some rows: ids, exact components, and bitmaps of the leading bits."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, stored: tuple[int, bytes] | None = None):
        self.ids, self.rows = ids, rows
        n, dims = rows.shape
        self.width = -(-n // 64)
        self.most = max(abs(int(rows.min(initial=0))), int(rows.max(initial=0)))
        if stored:
            self.shift = stored[0]
            self.slices = np.frombuffer(stored[1], np.uint64).reshape(dims, SLICES, self.width)
        else:
            above = rows - (rows.min(axis=0) if dims else np.zeros(0, np.int64))  # at most 2 ** 62
            self.shift = max(0, int(above.max(initial=0)).bit_length() - SLICES)
            above >>= self.shift
            bits = np.zeros((dims, SLICES, self.width * 64), np.uint8)
            for b in range(SLICES):
                bits[:, b, :n] = (above.T >> b) & 1
            self.slices = np.packbits(bits, axis=2, bitorder="little").view(np.uint64)
        valid = np.zeros(self.width * 64, np.uint8)
        valid[:n] = 1
        self.valid = np.packbits(valid, bitorder="little").view(np.uint64)
        self.places: dict[int, list[int]] = {}
        for i, x in enumerate(ids.tolist()):
            self.places.setdefault(x, []).append(i)

    def scores(self, q: np.ndarray) -> np.ndarray:
        """The slices, least first, of each query's approximate score of each row."""
        size = np.abs(q)
        top = (max(map(sum, size.tolist()), default=0) * ((1 << SLICES) - 1)).bit_length() + 1
        acc = np.zeros((top, len(q), self.width), np.uint64)
        flip = np.where(q < 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        for j in range(q.shape[1]):
            x = [self.slices[j, b][None, :] ^ flip[:, j, None] for b in range(SLICES)]
            for t in range(int(size[:, j].max(initial=0)).bit_length()):
                takes = -((size[:, j] >> t) & 1).astype(np.int64)
                if not takes.any():
                    continue
                takes = takes.view(np.uint64)[:, None]
                carry = None
                for b in range(SLICES):
                    add, s = x[b] & takes, acc[t + b]
                    both = s ^ add
                    if carry is None:
                        acc[t + b], carry = both, s & add  # s is a view, so the right side is taken first
                    else:
                        acc[t + b], carry = both ^ carry, (s & add) | (carry & both)
                at = t + SLICES
                while at < top and carry.any():
                    s = acc[at]
                    acc[at], carry = s ^ carry, s & carry
                    at += 1
        return acc

    def search(self, qids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, int, int, int]]:
        """For each query its place in qids and k best rows (all, if fewer): place, vec_id, score."""
        acc = self.scores(q)
        alive = np.repeat(self.valid[None, :], len(q), axis=0)
        for i, x in enumerate(qids.tolist()):
            for p in self.places.get(x, ()):
                alive[i, p // 64] &= ~(np.uint64(1) << np.uint64(p % 64))
        left, got, kth = alive.copy(), np.zeros(len(q), np.int64), [0] * len(q)
        for b in range(len(acc) - 1, -1, -1):
            ones = left & acc[b]
            n = np.bitwise_count(ones).sum(axis=1, dtype=np.int64)
            enough = got + n >= k
            left = np.where(enough[:, None], ones, left & ~acc[b])
            got = np.where(enough, got, got + n)
            for i in np.flatnonzero(enough):
                kth[i] |= 1 << b
        sums = [sum(x) for x in np.abs(q).tolist()]
        least = [max(0, t - (n * ((1 << self.shift) - 1) >> self.shift)) for t, n in zip(kth, sums, strict=True)]
        more, equal = np.zeros_like(alive), alive
        for b in range(len(acc) - 1, -1, -1):
            one = np.array([(t >> b) & 1 for t in least], bool)[:, None]
            more = np.where(one, more, more | (equal & acc[b]))
            equal = np.where(one, equal & acc[b], equal & ~acc[b])
        hits = np.unpackbits((more | equal).view(np.uint8), axis=1, bitorder="little")
        for i in range(len(q)):
            rows = np.flatnonzero(hits[i])
            wide = sums[i] * self.most >= SAFE
            exact = (self.rows[rows].astype(object) @ q[i].astype(object) if wide else self.rows[rows] @ q[i]).tolist()
            for score, x in sorted(zip([-e for e in exact], self.ids[rows].tolist(), strict=True))[:k]:
                yield i, x, min(max(-score, -(1 << 63)), (1 << 63) - 1)


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), dims)
    return out


def _bytes(m: np.ndarray) -> bytes:
    return m.astype(np.int32 if np.abs(m).max(initial=0) < 1 << 31 else np.int64).tobytes()


def _unpacked(raw: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32 if len(raw) == 4 * n * dims else np.int64).astype(np.int64).reshape(n, dims)


def _packed(rows: DataFrame, by: list[str], index: bool) -> DataFrame:
    """One row for each group: its ids and components as bytes, and if `index`, its bitmaps. A group has a bounded number of rows."""
    schema = pa.schema([("dims", pa.int32()), ("part", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary()), ("shift", pa.int32()), ("slices", pa.binary())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        m = _matrix(table.column("v"), key[0].as_py())
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        block = Block(ids[order], m[order]) if index else None
        bitmaps = (block.shift, block.slices.tobytes()) if block else (None, None)
        return pa.table([pa.array([x], f.type) for x, f in zip((key[0].as_py(), key[1].as_py(), ids[order].tobytes(), _bytes(m[order]), *bitmaps), schema, strict=True)], schema=schema)

    return rows.groupBy(*by).applyInArrow(run, "dims int, part int, ids binary, rows binary, shift int, slices binary")


def top_k(vectors: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """
    vectors: vec_id, v (whole numbers). queries: which rows are queries, as a condition. Returns query_id, rank, vec_id, score.
    Every block meets every chunk of queries once, in a task of its own.
    """
    rows = durable(vectors.distinct().withColumn("dims", F.size("v")))
    asked = rows.where(queries)
    blocks, chunks = max(1, -(-rows.count() // ROWS)), max(1, -(-asked.count() // CHUNK))
    if blocks > 1 or chunks > 1:
        blocks = max(blocks, 6)
    deal = lambda df, n: df.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int"))
    index = durable(_packed(deal(rows, blocks), ["dims", "part"], True)).withColumnsRenamed({"part": "block", "ids": "row_ids"}).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    sets = durable(_packed(deal(asked, chunks), ["dims", "part"], False).drop("shift", "slices")).withColumnsRenamed({"part": "chunk", "ids": "query_ids", "rows": "asked"}).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = index.join(sets, ["dims", "block", "chunk"]).select("dims", "row_ids", "rows", "shift", "slices", "query_ids", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids, qids = np.frombuffer(cell["row_ids"], np.int64), np.frombuffer(cell["query_ids"], np.int64)
                block = Block(ids, _unpacked(cell["rows"], len(ids), cell["dims"]), (cell["shift"], cell["slices"]))
                q = _unpacked(cell["asked"], len(qids), cell["dims"])
                for at in range(0, len(q), TOGETHER):
                    found = [(int(qids[at + i]), x, s) for i, x, s in block.search(qids[at : at + TOGETHER], q[at : at + TOGETHER], k)]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    found = cells.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
