"""
Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

A document's set is that of its two-word shingles, as 64-bit hashes. `groups` collections of `values` minhashes each are taken (24 of
3); a table's key is formed by a pair of collections, so 72 minhashes give 276 tables of six, which would take 1656 minhashes one by
one. Two sets at a similarity of 0.8 agree in less than two collections, and so share no table, with a chance of 9e-7. Only
collections that a document shares with another one go into keys; most documents share less than two and have none.

Equal sets are one node. Nodes that share a table are hung on its least node, and what hangs together is a family, in which every link
is confirmed, or refused, by exact intersections: a family's sets come to one task, which counts common shingles of one set with all
others by an inverted index, until those it hasn't compared are connected. Families too large for a task are dealt out in blocks that
are solved apart, all with the same few sets added, by which copies of one text find each other; then the documents outside of the
family's largest group, which are few in a family of copies, are compared with all of the family, block by block.

Nulls: a document without words or text has the empty set, is linked with nobody and is its own component; one without doc_id is
compared, and names a component only if all its documents have none. Repeated rows have equal sets and are linked, rows without words
aren't. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, sifted, skew_join, stored
from .components import connected_components

GROUPS, VALUES = 24, 3
#: In percent.
SIMILAR = 80
#: Bytes of sets that one task takes at once, of several families or of a block of one; sets that all blocks of a family have; hashes of words that a task remembers.
BLOCK, COMMON, REMEMBERED = 8 << 20, 16, 1 << 18
ODD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """The sorted hashes of a text's distinct two-word shingles; of a single word, its own."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    return np.unique(_mixed(h[:-1] * ODD + _mixed(h[1:]))) if len(h) > 1 else _mixed(h)


SEEDS = _mixed(np.arange(1, GROUPS * VALUES + 1, dtype=np.uint64) * ODD)


def collections_of(shingles: np.ndarray) -> np.ndarray:
    """For each collection one number, made of its minhashes; 4096 shingles at a time."""
    least = np.full(len(SEEDS), np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 4096):
        x = (shingles[None, i : i + 4096] ^ SEEDS[:, None]) * MIX
        x ^= x >> np.uint64(32)
        x *= ODD
        least = np.minimum(least, x.min(axis=1))
    groups = least.reshape(GROUPS, VALUES)
    out = np.zeros(GROUPS, np.uint64)
    for k in range(VALUES):
        out = _mixed(out * ODD + groups[:, k])
    return out.view(np.int64)


def shingled(docs: DataFrame, sets: bool = False) -> DataFrame:
    """doc_id, n_shingles, node (a digest of the set; null for an empty one) and the collections, or, if `sets`, node and set (8 bytes a shingle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            if len(known) > REMEMBERED:
                known.clear()
            found = [shingle_set(t.as_py(), known) for t in batch.column(1)]
            nodes = pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in found], pa.binary())
            if sets:
                yield pa.RecordBatch.from_arrays([nodes, pa.array([x.tobytes() for x in found], pa.binary())], ["node", "shingles"])
            else:
                cs = pa.array([collections_of(x) if len(x) else None for x in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), nodes, cs], ["doc_id", "n_shingles", "node", "collections"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "node binary, shingles binary" if sets else "doc_id long, n_shingles long, node binary, collections array<long>")


def families(nodes: DataFrame) -> DataFrame:
    """nodes: node (distinct), collections; read twice. node, family for nodes that share a table with another one, however indirectly."""
    each = nodes.select("node", F.posexplode("collections").alias("i", "v"))
    common = durable(each.groupBy("i", "v").agg(F.count("*").alias("n")).where("n > 1"))
    shared = skew_join(each, common, ["i", "v"], "n", how="inner", total=nodes.count() * GROUPS)
    own = F.sort_array(F.collect_list(F.struct("i", "v")))  # GROUPS of them at most
    own = shared.groupBy("node").agg(own.alias("c")).where(F.size("c") > 1)
    pairs = F.flatten(F.transform("c", lambda x, k: F.transform(F.slice("c", k + 2, F.size("c")), lambda y: F.xxhash64(x["i"], y["i"], x["v"], y["v"]))))
    keys = stored(own.select("node", F.explode(pairs).alias("key")), "tables")
    least = durable(keys.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1"))
    hung = skew_join(keys, least, ["key"], "n", how="inner", total=keys.count()).where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    return connected_components(hung).withColumnRenamed("root", "family")


class Sets:
    """Shingle sets of a family, with an inverted index, and groups of those that are linked."""

    def __init__(self, shingles: list[bytes], groups: np.ndarray | None = None):
        sets = [np.frombuffer(s, np.uint64) for s in shingles]
        self.size = np.array([len(s) for s in sets])
        self.group = np.arange(len(sets)) if groups is None else groups.copy()
        values, ids = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), self.size)
        self.ids, self.starts = ids, np.concatenate(([0], np.cumsum(self.size)))
        self.owners = owner[np.argsort(ids, kind="stable")]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(ids, minlength=len(values)))))

    def links(self, i: int) -> np.ndarray:
        """Which sets are similar to set i."""
        own = self.ids[self.starts[i] : self.starts[i + 1]]
        begin, count = self.first[own], self.first[own + 1] - self.first[own]
        places = np.arange(count.sum()) + np.repeat(begin - np.cumsum(count) + count, count)
        both = np.bincount(self.owners[places], minlength=len(self.size))  # a set holds a shingle once
        return np.flatnonzero(100 * both >= SIMILAR * (self.size + self.size[i] - both))

    def connect(self, compared: np.ndarray | None = None) -> list[tuple[int, int]]:
        """
        Links that connect all that similar sets connect. compared: which sets have been held against all others of this task already,
        or needn't be. Two sets that were both never compared with all are in one group at the end, so nothing is left open.
        """
        open_ = np.ones(len(self.size), bool) if compared is None else ~compared
        out = []
        while True:
            left = np.flatnonzero(open_)
            names, at, counts = np.unique(self.group[left], return_inverse=True, return_counts=True)
            if len(names) < 2 and (compared is None or not len(left)):
                return out
            i = int(left[np.argmin(counts[at])])
            open_[i] = False
            for j in self.links(i).tolist():
                if (g := self.group[j]) != self.group[i]:
                    self.group[self.group == g] = self.group[i]
                    out.append((i, j))


LINK = "a binary, b binary"


def _pairs(nodes: list[bytes], links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([nodes[i] for i, _ in links], pa.binary()), "b": pa.array([nodes[j] for _, j in links], pa.binary())})


def confirmed(members: DataFrame) -> DataFrame:
    """members: node, family, shingles; a stored table. a, b: similar sets, enough of them to connect all that are connected in a family."""

    def together(table: pa.Table) -> pa.Table:
        table = table.sort_by([("family", "ascending"), ("node", "ascending")])
        families_, nodes, sets = (table.column(c).to_pylist() for c in ("family", "node", "shingles"))
        edges = [k for k in range(len(nodes)) if k == 0 or families_[k] != families_[k - 1]] + [len(nodes)]
        return pa.concat_tables([_pairs(nodes[a:b], Sets(sets[a:b]).connect()) for a, b in zip(edges[:-1], edges[1:], strict=True)])

    size = F.octet_length("shingles")
    sizes = durable(members.groupBy("family").agg(F.count("*").alias("n"), F.ceil(F.sum(size) / BLOCK).cast("int").alias("blocks")))
    total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("blocks"), F.lit(0))).first()
    tasks = members.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] // BLOCK + 1
    sized = skew_join(members, sizes, ["family"], "n", how="inner", total=total)
    links = sized.where("blocks = 1").withColumn("task", F.pmod(F.xxhash64("family"), F.lit(tasks))).select("task", "family", "node", "shingles").groupBy("task").applyInArrow(together, LINK)
    if most < 2:
        return links

    big = sized.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    chosen = F.pmod(F.xxhash64("node", F.lit(1)), F.floor(F.col("n") / COMMON) + 1) == 0
    seeds = durable(big.groupBy("family").agg(F.slice(F.sort_array(F.collect_set(F.when(chosen, F.col("node")))), 1, 2 * COMMON).alias("seeds"), F.count("*").alias("n")))
    dealt = F.when(F.array_contains("seeds", F.col("node")), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    big = big.drop("n")
    seeded = skew_join(big, seeds, ["family"], "n", how="inner", total=total).withColumn("task", F.explode(dealt)).select("family", "task", "node", "shingles")
    own = stored(seeded.groupBy("family", "task").applyInArrow(together, LINK), "block-links")
    big = big.join(connected_components(own).withColumnRenamed("root", "grp"), "node", "left").withColumn("grp", F.coalesce("grp", "node"))
    big = stored(big.select("family", "node", "shingles", "blocks", "block", "grp"), "large-families")
    heads = big.groupBy("family", "grp").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    heads = heads.groupBy("family").agg(F.max_by("grp", F.struct("n", "grp")).alias("head"), F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("bytes").alias("bytes"), F.max_by("bytes", F.struct("n", "grp")).alias("head_bytes"))
    heads = durable(heads.where("most < n").select("family", "head", "n", F.ceil((F.col("bytes") - F.col("head_bytes")) / BLOCK).cast("int").alias("parts")))
    big = skew_join(big, heads, ["family"], "n", how="inner", total=total).withColumn("minor", F.col("grp") != F.col("head"))
    # each part of the others is compared with each block of the family
    part = F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int")
    as_other = F.when(F.col("minor"), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(part.alias("part"), k.alias("task")))).otherwise(F.array().cast("array<struct<part:int,task:int>>"))
    as_all = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(k.alias("part"), F.col("block").alias("task")))
    met = big.withColumn("t", F.explode(F.array_distinct(F.concat(as_other, as_all)))).withColumn("asks", F.col("minor") & (F.col("t.part") == part)).select("family", "t.part", "t.task", "node", "shingles", "grp", "asks")

    def across(table: pa.Table) -> pa.Table:
        nodes, asks = table.column("node").to_pylist(), np.array(table.column("asks").to_pylist(), bool)
        if not asks.any():
            return _pairs([], [])
        groups = np.unique(np.array([g.hex() for g in table.column("grp").to_pylist()]), return_inverse=True)[1]
        return _pairs(nodes, Sets(table.column("shingles").to_pylist(), groups).connect(~asks))

    return links.unionByName(own).unionByName(met.groupBy("family", "part", "task").applyInArrow(across, LINK))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach, itself included; kept: whether that is the document's own."""
    rows = durable(shingled(docs))
    nodes = durable(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("members"), F.first("collections").alias("collections")))
    found = durable(families(nodes.select("node", "collections")))
    sets = sifted(shingled(docs, sets=True), "node", found.select("node"), "met").where("met").drop("met")
    sets = sets.groupBy("node").agg(F.first("shingles").alias("shingles"))
    links = confirmed(stored(found.join(sets, "node"), "families"))
    roots = durable(connected_components(links))
    named = durable(nodes.drop("collections").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    best = durable(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    named = durable(skew_join(named, best, ["root"], "n", how="inner").select("node", "members", "component_id"))
    full = skew_join(rows.where("node IS NOT NULL"), named, ["node"], "members", how="inner").select("doc_id", "n_shingles", "component_id")
    all_ = full.unionByName(rows.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return all_.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
