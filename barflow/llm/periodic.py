"""
Periodic runs: stretches of words that repeat with one period, as loops in scraped or generated texts.

A run is a stretch of at least max(24, 3 * q) words whose smallest period is q and which no neighbouring word extends. Periods are
taken by octave: s to 2 s - 1 for s = 8, 16, ..., and 1 to 7 together (s = 8). Any run holds a place c, a multiple of s, whose next s
words come again one period on. Hashes of windows of s words, doubled from octave to octave, find such places; only hash hits are
looked at further, so a chance hit costs time and no run is lost. A document is exploded into overlapping tiles for each octave that
has hits, with s words before and 4 s after the places of a tile. Tiles are dealt out by themselves and solved apart: a Z-function
from c gives how far every period goes on to the right, one over the reversed words how far to the left. What a tile's edge cuts is a
fragment. Fragments meet by document and period; those that overlap by a period or more are one run.

Nulls: a null or empty text has no words and no run. Rows without id are taken by their text. Rows that repeat id and text are solved
once and each get the runs; rows with one id and other texts are apart. A text of any length is tiled whole. An empty table gives no
rows. Other columns stay as they are; one that is called `runs` already gives its name to the new column with an underscore added.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, fresh, sifted

#: A run's least length in words, and in periods.
LEAST, TIMES = 24, 3
#: The first octave's step; a tile has the places of this many words, or of eight steps where those are more.
BASE, TILE = 8, 1 << 12
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes: ASCII white space only


def numbered(found: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers, others haven't."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in found), np.int32, len(found))


def _doubled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of windows of 2 k words from those of k words."""
    out = h[: len(h) - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def octaves(ids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each octave: its step s, its least period, and the places, multiples of s, whose next s words come again a period of it on."""
    n = len(ids)
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    for k in (1, 2, 4):
        h = _doubled(h, k) if len(h) > k else h[:0]
    s = BASE
    while 3 * s <= n:
        padded = np.concatenate((h, np.zeros(2 * s, np.uint64)))
        if s == BASE:
            m = (n - s - 1) // s + 1
            hit = (padded[: m * s].reshape(m, s)[:, 1:] == padded[: m * s : s, None]).any(axis=1)
            yield s, 1, np.flatnonzero(hit) * s
        m = (n - 2 * s) // s + 1
        yield s, s, np.flatnonzero((padded[s : s + m * s].reshape(m, s) == padded[: m * s : s, None]).any(axis=1)) * s
        h, s = _doubled(h, s), 2 * s


def tiles_of(ids: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """step, least period, where the tile begins, its places counted from there, and its words' numbers."""
    for s, low, places in octaves(ids):
        core = max(TILE, 8 * s)
        for t in np.unique(places // core):
            own = places[places // core == t]
            at = max(0, int(own[0]) - s)
            yield s, low, at, (own - at).astype(np.int32), ids[at : int(own[-1]) + 4 * s]


def z_function(x: list, upto: int) -> list[int]:
    """For each place before `upto`, how many elements from there equal those from the beginning."""
    n, left, right = len(x), 0, 0
    z = [n] + [0] * (upto - 1)
    for i in range(1, upto):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


@lru_cache(maxsize=1 << 16)
def _divisors(p: int) -> tuple[int, ...]:
    """p over each of its prime factors: a word of length p is a power if one of them is a period of it."""
    out, rest, f = [], p, 2
    while f * f <= rest:
        if rest % f == 0:
            out.append(p // f)
            while rest % f == 0:
                rest //= f
        f += 1
    return (*out, p // rest) if rest > 1 else tuple(out)


def joined(spans: list[tuple[int, int]], period: int) -> list[tuple[int, int]]:
    """Spans of one period; those that overlap by a period are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] - period:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def solve(s: int, low: int, at: int, places: list[int], ids: list[int], n: int) -> list[tuple[int, int, int]]:
    """period, start, end of the tile's runs, or of what the edges of its places' windows leave of them; n: words of the document."""
    spans = defaultdict(list)
    for c in places:
        ahead = ids[c : c + 4 * s]
        z = z_function(ahead, min(2 * s, len(ahead)))
        hits = [p for p in range(low, min(len(z), s if low < s else 2 * s)) if z[p] >= s and not any(z[d] >= p - d for d in _divisors(p))]
        if not hits:
            continue
        back = ids[max(0, c - s) : c][::-1]
        other = ids[max(0, c - s) : c + hits[-1]][::-1]  # ends where the period's next turn begins
        zb = z_function([*back, -1, *other], len(back) + 1 + len(other))
        for p in hits:
            left = zb[len(back) + 1 + hits[-1] - p] if back else 0
            start, end = at + c - left, at + c + p + z[p]
            whole = (left < s or start == 0) and (end < at + c + 4 * s or end == n)
            if not whole or end - start >= max(LEAST, TIMES * p):
                spans[p].append((start, end))
    return [(p, a, b) for p, found in spans.items() for a, b in joined(found, p)]


def tiles(docs: DataFrame, key: str) -> DataFrame:
    """docs: `key`, text. One row for each tile that has a hit, with the document's number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = numbered(words(text.as_py()))
                rows += [(k, s, low, at, len(ids), places.tobytes(), part.astype(np.int32).tobytes()) for s, low, at, places, part in tiles_of(ids)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), *[pa.int64()] * 4, *[pa.binary()] * 2), strict=True)], ["key", "step", "low", "at", "n", "places", "ids"])

    return docs.select(F.col(key).alias("key"), "text").mapInArrow(run, "key string, step long, low long, at long, n long, places binary, ids binary")


def periodic_runs(docs: DataFrame, key: str) -> DataFrame:
    """docs: `key` (string; equal ones have equal texts), text. One row for each key with runs: key, runs (start, length, period in words, sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                places, ids = (np.frombuffer(r[c], np.int32).tolist() for c in ("places", "ids"))
                rows += [(r["key"], *f) for f in solve(r["step"], r["low"], r["at"], places, ids, r["n"])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["key", "period", "start", "end"])

    dealt = tiles(docs, key).groupBy("key", "step", "low", "at").agg(F.first("n").alias("n"), F.first("places").alias("places"), F.first("ids").alias("ids"))
    fragments = dealt.mapInArrow(run, "key string, period long, start long, end long")
    w = Window.partitionBy("key", "period").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = fragments.withColumn("new", F.coalesce(F.col("start") > reach - F.col("period"), F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = new.groupBy("key", "period", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).withColumn("length", F.col("end") - F.col("start"))
    found = found.where(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("period")))
    runs = F.sort_array(F.collect_list(F.struct("start", "period", "length")))  # a text's runs are fewer than its words
    return found.groupBy("key").agg(F.transform(runs, lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))


def kept_words(found: list[bytes], runs: list[dict]) -> list[bytes]:
    """The words that no run holds after its first period."""
    edge = np.zeros(len(found) + 1, np.int64)
    for r in runs:
        edge[r["start"] + r["period"]] += 1
        edge[r["start"] + r["length"]] -= 1
    return [found[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)] if runs else found


def collapse(docs: DataFrame) -> DataFrame:
    """
    docs: doc_id, text and other columns. All rows, with text: its words but for those that a run repeats, joined by one space (null:
    empty), and runs: array of start, length, period, empty where there is none. Only texts that may have runs are shuffled.
    """
    name, key = fresh(docs, "runs"), fresh(docs, "run_key")
    keyed = docs.withColumn(key, F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), F.lit(":"), F.coalesce("text", F.lit("")))))
    runs = durable(periodic_runs(keyed, key)).select(F.col("key").alias(key), F.col("runs").alias(name))
    may = fresh(keyed, "may_run")
    met = sifted(keyed, key, runs, may)
    none = F.array().cast(f"array<{RUN}>")
    all_ = met.where(~F.col(may)).drop(may).withColumn(name, none).unionByName(met.where(may).drop(may).join(runs, key, "left").withColumn(name, F.coalesce(name, none))).drop(key)
    at, by = all_.columns.index("text"), all_.columns.index(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b" ".join(kept_words(words(t.as_py()), r.as_py())).decode("utf-8", "surrogatepass") for t, r in zip(batch.column(at), batch.column(by), strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string()))

    return all_.mapInArrow(run, all_.schema)
