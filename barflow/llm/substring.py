"""
Passages of over 50 words that repeat across documents, exactly or nearly, wherever lines begin and end.

Texts are cut into paragraphs by what their words are (passages.py). Each paragraph gets a MinHash signature of its five-word shingles
where its text is read; `bands` bands of `rows` values are tuned for recall (12 of 3: at a similarity of 0.8 two paragraphs miss each
other with a chance of 0.0002). Equal paragraphs are one node. Nodes that share a band are verified by the exact Jaccard similarity of
their shingle sets: first each with the band's most frequent node, in joins; then, in bands where that left nodes over, those with all
the others, by tiles, but for pairs that are connected already. Verified links are joined to components; of a component the first
paragraph, by doc_id and place, stays and the others are removed.

Cuts fall elsewhere at the ends of a shared passage, so exact repeats are also found by segments, of which any 51 words in succession
hold one whole. Segments of one document only are dropped; the others are laid on the first document that has them, and those that
overlap on one diagonal are one run. Runs of over 50 words are repeats. Around segments whose runs are shorter, every window of 51
words is compared, by its hash, in all documents that have the segment. So two documents are linked whenever they share over 50 words
in succession, and by exact runs only then. Of a longer run with changed ends up to 21 words on each side may stay.

Nulls: a null or empty text has no passages. Rows without doc_id count as one document that sorts first: its passages stay, it links
nobody. Rows of one doc_id are one document, so what they share with each other isn't a repeat. An empty table gives no rows. Hashes of
texts, segments and windows have 64 bits. Other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, fresh, sifted, skew_join, stored
from .components import connected_components
from .passages import PASSAGE, SEGMENT, SHINGLE, Cutter, hashed, runs, windows, without_passages

SIMILARITY, BANDS, ROWS = 0.8, 12, 3
#: Nodes of a band that one task compares with each other, and words that are cut at once.
TILE, WORDS = 2000, 200_000
#: A key with more rows than this may be joined by broadcast; plans of few joins keep the driver small.
HEAVY = 10_000
NOBODY = -(1 << 63)
CUT = "doc long, row_key long, n_words int, stream long, at array<int>, seg array<bigint>, starts array<int>, ends array<int>, names array<bigint>, sizes array<int>, bands array<bigint>"


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NOBODY)).alias("doc"), F.xxhash64("text").alias("row_key"), F.col("text"))


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    flat = np.concatenate([np.asarray(p).ravel() for p in parts]) if parts else []
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([np.size(p) for p in parts]))), pa.int32()), pa.array(flat, kind))


def cut(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each document: doc, row_key, n_words, stream (a hash of its words), segments and paragraphs; no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(bands, rows)
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            long = [k for k, h in enumerate(held) if len(h[2]) >= PASSAGE]
            none = (np.zeros(0, np.int64),) * 7
            cuts = [none] * len(held)
            if long:
                for k, c in zip(long, cutter.cut([held[k][2] for k in long]), strict=True):
                    cuts[k] = c
            doc, key, words = zip(*held, strict=True)
            columns = [pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array([len(w) for w in words], pa.int32()), pa.array([hashed(w) for w in words], pa.int64())]
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            columns += [_lists([np.array(c[i], np.int64) for c in cuts], kind) for i, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in CUT.split(", ")])

        count = 0
        for batch in batches:
            for doc, key, text in zip(*batch.columns, strict=True):
                held.append((doc.as_py(), key.as_py(), cutter.words(text.as_py())))
                count += len(held[-1][2])
                if count > WORDS or len(held) > 5000:
                    yield out()
                    held, count = [], 0
        if held:
            yield out()

    return _named(docs).mapInArrow(run, CUT)


def distinct_texts(found: DataFrame, several: DataFrame) -> DataFrame:
    """found: cut(). several: stream, first, copies of the streams of several rows. The rows of `found`, of equal texts the first only."""
    rows = sifted(found, "stream", several, "maybe")
    maybe = skew_join(rows.where("maybe"), several, ["stream"], "copies", least=HEAVY).where(F.col("first").isNull() | (F.col("first") == F.struct("doc", "row_key")))
    return rows.where("NOT maybe").select(*found.columns).unionByName(maybe.select(*found.columns).dropDuplicates(["stream"]))


def _paragraphs(nodes: DataFrame, bands: int) -> DataFrame:
    """One row for each paragraph of each node: stream, doc, row_key, start, end, p, size, bands."""
    item = lambda name, i: F.get(name, i)
    each = F.transform(F.sequence(F.lit(0), F.size("names") - 1), lambda i: F.struct(item("starts", i).alias("start"), item("ends", i).alias("end"), item("names", i).alias("p"), item("sizes", i).alias("size"), F.slice("bands", i * bands + 1, F.lit(bands)).alias("bands")))
    return nodes.where(F.size("names") > 0).select("stream", "doc", "row_key", F.explode(each).alias("x")).select("stream", "doc", "row_key", "x.*")


def read_again(docs: DataFrame, wanted: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """
    wanted: doc, row_key, stream, at (segments), paras (p, start, end). Returns rows with win: the windows of PASSAGE words around these
    segments; and rows with sh: the sorted hashes of the paragraphs' shingles. Texts that nothing is wanted of aren't shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(bands, rows)
        seen: set[tuple] = set()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc", "stream", "at", "win", "p", "sh")}
            for doc, stream, text, segments, paras in zip(*batch.columns, strict=True):
                if (row := (doc.as_py(), stream.as_py())) in seen:  # a repeated row
                    continue
                seen.add(row)
                words = cutter.words(text.as_py())
                if segments.is_valid:
                    at, win = windows(words, segments.values.to_numpy(zero_copy_only=False).astype(np.int64))
                    for name, column in (("doc", [doc.as_py()] * len(at)), ("stream", [stream.as_py()] * len(at)), ("at", at.tolist()), ("win", win.tolist()), ("p", [None] * len(at)), ("sh", [None] * len(at))):
                        out[name] += column
                for x in paras.as_py() or ():
                    for name, value in (("doc", doc.as_py()), ("stream", stream.as_py()), ("at", None), ("win", None), ("p", x["p"]), ("sh", np.unique(runs(words[x["start"] : x["end"]], SHINGLE)).view(np.int64))):
                        out[name].append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out.values(), kinds, strict=True)], list(out))

    both = sifted(_named(docs), "row_key", wanted, "maybe").where("maybe").join(wanted, ["doc", "row_key"]).select("doc", "stream", "text", "at", "paras")
    return both.mapInArrow(run, "doc long, stream long, at int, win long, p long, sh array<bigint>")


def band_members(paras: DataFrame) -> DataFrame:
    """paras: p, n, size, bands. Returns band, p, size, rep and rep_size (its most frequent node), m (its number of nodes), for bands of several nodes."""
    by_band = paras.select("p", "n", "size", F.explode("bands").alias("band"))
    several = durable(by_band.groupBy("band").agg(F.count("*").alias("m")).where("m > 1"))
    kept = sifted(by_band, "band", several, "maybe").where("maybe")
    reps = durable(kept.groupBy("band").agg(F.count("*").alias("m"), F.max(F.struct("n", "p", "size")).alias("rep")).where("m > 1"))
    return skew_join(kept.select("p", "size", "band"), reps, ["band"], "m", how="inner", least=HEAVY).select("band", "p", "size", F.col("rep.p").alias("rep"), F.col("rep.size").alias("rep_size"), "m")


def with_frequent(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """pairs: p, rep of a band's node and its most frequent one. Those that have `similarity` or more."""
    reps = durable(pairs.groupBy("rep").agg(F.count("*").alias("n")).join(sets.select(F.col("p").alias("rep"), F.col("sh").alias("rep_sh")), "rep"))
    met = skew_join(pairs.join(sets, "p"), reps, ["rep"], "n", how="inner", least=HEAVY)
    both = F.size(F.array_intersect("sh", "rep_sh"))
    return met.where(both >= similarity * (F.size("sh") + F.size("rep_sh") - both)).select("p", "rep")


def verified(one: list[tuple], two: list[tuple] | None, similarity: float) -> Iterator[tuple[int, int]]:
    """Links inside `one`, or between `one` and `two`, that connect more than is connected. Items: node, shingles, whether linked with the band's most frequent node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            parent[x] = x = parent.get(y, y)
        return x

    linked = [a for a, _, ok in one + (two or []) if ok]
    for a in linked[1:]:
        parent[root(a)] = root(linked[0])
    for k, (a, x, _) in enumerate(one):
        for b, y, _ in one[:k] if two is None else two:
            if root(a) != root(b) and min(len(x), len(y)) >= similarity * max(len(x), len(y)):
                both = len(x & y)
                if both >= similarity * (len(x) + len(y) - both):
                    parent[root(a)] = root(b)
                    yield a, b


def with_others(members: DataFrame, sets: DataFrame, links: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The links, p and rep, of nodes that with_frequent() left over in bands of three nodes or more; bands with the same nodes are looked at once."""
    flagged = durable(members.where("m > 2").join(links.withColumn("ok", F.lit(True)), ["p", "rep"], "left").select("band", "p", "m", (F.coalesce("ok", F.lit(False)) | (F.col("p") == F.col("rep"))).alias("ok")))
    open_ = flagged.groupBy("band", "m").agg(F.count_if(~F.col("ok")).alias("over"), F.bit_xor("p").alias("x"), F.sum(F.shiftright("p", 20)).alias("s")).where("over > 0")
    open_ = durable(open_.groupBy("m", "x", "s").agg(F.min("band").alias("band")).select("band", "m"))
    total = open_.agg(F.sum("m")).first()[0] or 0
    chosen = skew_join(flagged.drop("m"), open_, ["band"], "m", how="inner", total=total, least=HEAVY)
    cuts = F.ceil(F.col("m") / F.lit(TILE)).cast("int")
    chosen = chosen.withColumn("cuts", cuts).withColumn("own", F.pmod(F.xxhash64("p"), F.col("cuts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    cell = F.when(F.col("cuts") == 1, F.pmod(F.xxhash64("band"), F.lit(max(1, total // 500)))).otherwise(F.col("band"))
    chosen = chosen.select("p", "band", "ok", "own", cell.alias("cell"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cuts")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        bands: dict[int, list] = {}
        sets: dict[int, frozenset] = {}
        for p, band, ok, own, sh in zip(*(table.column(c) for c in ("p", "band", "ok", "own", "sh")), strict=True):
            if (node := p.as_py()) not in sets:
                sets[node] = frozenset(sh.values.to_pylist())
            bands.setdefault(band.as_py(), []).append((node, ok.as_py(), own.as_py()))
        out = []
        for nodes in bands.values():
            one = [(p, sets[p], ok) for p, ok, own in sorted(nodes) if own == i]
            out += verified(one, None if i == j else [(p, sets[p], ok) for p, ok, own in sorted(nodes) if own == j], similarity)
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"p": pa.array(a, pa.int64()), "rep": pa.array(b, pa.int64())})

    return chosen.join(sets, "p").groupBy("cell", "i", "j", "cuts").applyInArrow(run, "p long, rep long")


def segment_runs(occurrences: DataFrame) -> DataFrame:
    """occurrences: stream, doc, at, seg, n, kept_in, kept_at. Returns stream, doc, kept_in, start, end and segs of the runs that segments make on one diagonal."""
    diagonal = (F.col("kept_at") - F.col("at")).alias("diagonal")
    w = Window.partitionBy("stream", "kept_in", "diagonal").orderBy("at")
    rows = occurrences.where("doc <> kept_in").select("stream", "doc", "at", "seg", "n", "kept_in", diagonal)
    rows = rows.withColumn("new", F.coalesce(F.col("at") - F.lag("at").over(w) > SEGMENT, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w))
    return rows.groupBy("stream", "kept_in", "diagonal", "run").agg(F.max("doc").alias("doc"), F.min("at").alias("start"), (F.max("at") + SEGMENT).alias("end"), F.collect_list(F.struct("seg", "n")).alias("segs"))


def window_runs(found: DataFrame) -> DataFrame:
    """found: stream, doc, at, win. Returns stream, kept_in, start, end of the words in windows that an earlier document has."""
    keepers = found.groupBy("win").agg(F.min("doc").alias("kept_in"), F.max("doc").alias("high"), F.count("*").alias("n"))
    keepers = durable(keepers.where("kept_in < high").select("win", "kept_in", "n"))
    gone = skew_join(found, keepers, ["win"], "n", how="inner", least=HEAVY).where("doc <> kept_in").select("stream", "at", "kept_in").distinct()
    run = F.col("at") - F.row_number().over(Window.partitionBy("stream", "kept_in").orderBy("at"))
    return gone.withColumn("run", run).groupBy("stream", "kept_in", "run").agg(F.min("at").alias("start"), (F.max("at") + PASSAGE).alias("end")).drop("run")


def _ranges() -> Column:
    return F.sort_array(F.collect_set(F.struct("start", "end", "kept_in"))).alias("passages")


def passages(docs: DataFrame, found: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS) -> DataFrame:
    """
    found: cut(docs), materialised. For each document with a passage that an earlier one has: doc, row_key and passages, its ranges of
    words (start, end: from 0, end not included) with kept_in, the document that keeps them. Ranges may overlap.
    """
    long = found.where(F.col("n_words") >= PASSAGE)
    several = durable(long.groupBy("stream").agg(F.min(F.struct("doc", "row_key")).alias("first"), F.count("*").alias("copies")).where("copies > 1"))
    nodes = distinct_texts(long, several)
    where = nodes.select("stream", "doc", "row_key")

    placed = nodes.select("stream", "doc", F.explode(F.arrays_zip("at", "seg")).alias("x")).select("stream", "doc", "x.*")
    twice = durable(placed.groupBy("seg").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("seg"))
    placed = sifted(placed, "seg", twice, "maybe").where("maybe").drop("maybe")
    shared = placed.groupBy("seg").agg(F.min(F.struct("doc", "at")).alias("keep"), F.max("doc").alias("high"), F.count("*").alias("n"))
    shared = durable(shared.where(F.col("keep.doc") < F.col("high")).select("seg", "keep", "n"))
    met = durable(skew_join(placed, shared, ["seg"], "n", how="inner", least=HEAVY).select("stream", "doc", "at", "seg", "n", F.col("keep.doc").alias("kept_in"), F.col("keep.at").alias("kept_at")))
    straight = durable(segment_runs(met))
    short = straight.where(F.col("end") - F.col("start") < PASSAGE).select(F.explode("segs").alias("x")).select("x.*").groupBy("seg").agg(F.max("n").alias("n"))
    around = skew_join(met.select("stream", "seg", "at"), durable(short), ["seg"], "n", how="inner", least=HEAVY).groupBy("stream").agg(F.collect_set("at").alias("at"))

    paras = _paragraphs(nodes, bands)
    kinds = durable(paras.groupBy("p").agg(F.count("*").alias("n"), F.min(F.struct("doc", "row_key", "stream", "start", "end")).alias("place"), F.max("size").alias("size"), F.max("bands").alias("bands")))
    members = durable(band_members(kinds))
    alike = F.least("size", "rep_size") >= similarity * F.greatest("size", "rep_size")
    pairs = durable(members.where((F.col("p") != F.col("rep")) & alike).select("p", "rep").distinct())
    needed = durable(pairs.select("p").unionByName(pairs.select(F.col("rep").alias("p"))).unionByName(members.where("m > 2").select("p")).distinct())
    compared = sifted(kinds.select("p", "place"), "p", needed, "maybe").where("maybe").join(needed, "p").select("p", "place.*").groupBy("doc", "row_key", "stream").agg(F.collect_list(F.struct("p", "start", "end")).alias("paras"))
    none = F.lit(None)
    wanted = around.join(where, "stream").select("doc", "row_key", "stream", "at", none.alias("paras")).unionByName(compared.select("doc", "row_key", "stream", none.alias("at"), "paras"))
    wanted = durable(wanted.groupBy("doc", "row_key", "stream").agg(F.max("at").alias("at"), F.max("paras").alias("paras")))
    again = stored(read_again(docs, wanted), "windows-and-sets")

    sets = again.where("p IS NOT NULL").select("p", "sh")
    links = durable(with_frequent(pairs, sets, similarity))
    links = links.unionByName(with_others(members, sets, links, similarity))
    near = kinds.select("p", "n", "place.doc").join(connected_components(links.withColumnsRenamed({"p": "a", "rep": "b"})).withColumnRenamed("node", "p"), "p")
    near = durable(near.select("p", "n", "doc", "root"))
    keeper = durable(near.groupBy("root").agg(F.min("doc").alias("kept_in"), F.count("*").alias("nodes")))
    near = durable(skew_join(near, keeper, ["root"], "nodes", how="inner", least=HEAVY).select("p", "n", "kept_in"))
    changed = durable(skew_join(sifted(paras.drop("bands"), "p", near, "maybe").where("maybe"), near, ["p"], "n", how="inner", least=HEAVY).where("doc <> kept_in").select("stream", "kept_in", "start", "end"))

    exact = straight.where(F.col("end") - F.col("start") >= PASSAGE).select("stream", "kept_in", "start", "end")
    around = durable(window_runs(again.where("win IS NOT NULL").select("stream", "doc", "at", "win")))
    parts = durable(exact.unionByName(around).unionByName(changed).groupBy("stream").agg(_ranges()))
    parts = parts.join(where, "stream").select("doc", "row_key", "passages")
    twice = sifted(long.select("doc", "row_key", "stream", "n_words"), "stream", several, "maybe").where("maybe")
    copies = skew_join(twice, several, ["stream"], "copies", how="inner", least=HEAVY).where(F.col("doc") != F.col("first.doc"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").alias("end"), F.col("first.doc").alias("kept_in")))
    return parts.unionByName(copies.select("doc", "row_key", whole.alias("passages")).distinct())


def classified(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """
    One row for each document: doc_id, n_words, n_removed (words in passages that an earlier document keeps), passages (start, end,
    kept_in), and component_id: the smallest doc_id of the documents that such passages connect it with, itself included.
    """
    found = stored(cut(docs), "cut")
    gone = durable(passages(docs, found, similarity))
    edges = gone.select(F.col("doc").alias("a"), F.explode("passages.kept_in").alias("b")).where(F.col("b") != NOBODY).distinct()
    roots = connected_components(edges).withColumnsRenamed({"node": "doc", "root": "component_id"})
    none = F.array().cast(gone.schema["passages"].dataType)
    rows = found.select("doc", "row_key", "n_words").join(gone, ["doc", "row_key"], "left").join(roots, "doc", "left")
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    union = F.aggregate(F.coalesce("passages", none), state, lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["upto"]), F.lit(0))).alias("n"), F.greatest(x["end"], s["upto"]).alias("upto")), lambda s: s["n"])
    known = lambda c: F.nullif(c, F.lit(NOBODY))
    ranges = F.transform(F.coalesce("passages", none), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), known(x["kept_in"]).alias("kept_in")))
    return rows.select(known(F.col("doc")).alias("doc_id"), F.col("n_words").cast("long"), union.cast("long").alias("n_removed"), ranges.alias("passages"), F.coalesce("component_id", known(F.col("doc"))).alias("component_id"))


def drop_repeats(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` without the words in passages that an earlier document keeps; what passages() says takes effect on the texts."""
    gone = passages(docs, stored(cut(docs), "cut"), similarity)
    shorten, ranges = F.udf(without_passages, "string", useArrow=False), fresh(docs, "ranges")
    same = (F.coalesce(F.col("d.doc_id").cast("long"), F.lit(NOBODY)) == F.col("g.doc")) & (F.xxhash64("d.text") == F.col("g.row_key"))
    both = docs.alias("d").join(gone.alias("g"), same, "left").select(*(F.col(f"d.`{c}`") for c in docs.columns), F.col("g.passages").alias(ranges))
    return both.select(*(shorten(F.col("text"), F.col(ranges)).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns))
