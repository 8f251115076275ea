"""
Spelling variants: words that one inserted, deleted or replaced letter divides, grouped under the form that is written most.

Words are counted where texts are read; a task adds up before anything is shuffled. Two words are near if their common prefix and
their common suffix together reach the longer one's length less one. So one half of the longer word is common: the words of length m
and m - 1 that share their first m // 2 letters, or their last m - m // 2, are a strip, and the grid of all pairs is
cut, without loss, into the squares of strips on themselves. A strip is a padded matrix of code points, compared block by block:
running comparisons of columns give prefix and suffix lengths of all pairs of two blocks at once. Blocks of two words that are both
shorter than m, and so belong to the next strip, are skipped, and pairs that share both halves count in one strip only. A task gives
back sums and the best form of each word, never pairs. Strips with very many words are cut by a hash into pieces that meet in pairs.

Nulls: a null or empty text has no words. Repeated rows count each. Of equal counts the form that is smaller by code points is taken. A
word without a near word has n_near 0 and is its own root. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, skew_join

LETTERS = "[A-Za-zÀ-ÿ]+"
#: Words of a block on one side and on the other; of a strip's piece; of the strips that one task takes together, at about; and distinct words that a counting task holds at once.
ROWS, COLUMNS, PIECE, TOGETHER, HELD = 128, 2048, 20_000, 8_000, 1 << 19


def word_counts(docs: DataFrame, pattern: str = LETTERS, change: Callable[[str | None, str], str] | None = None) -> DataFrame:
    """docs: doc_id, text. word, n: how often each word, A-Z lower-cased, occurs; `change` (doc_id as decimal, word) rewrites them first."""

    def out(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = re.compile(pattern).findall, Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                here = Counter(find((text.as_py() or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                for word, n in here.items():
                    total[change(doc_id, word) if change else word] += n
                if len(total) >= HELD:
                    yield out(total)
                    total = Counter()
        yield out(total)

    return docs.select(F.col("doc_id").cast("string"), F.col("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _codes(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points padded at the end, and padded at the front; one byte each where that is enough."""
    points = np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)
    lengths = np.array([len(w) for w in words], np.int64)
    points = points.astype(np.uint8) if points.size == 0 or points.max() < 256 else points
    return points, np.take_along_axis(points, (np.arange(width) - (width - lengths[:, None])) % width, axis=1)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many columns from the first on all pairs of rows have in common."""
    same = np.ones((len(a), len(b)), bool)
    out = np.zeros((len(a), len(b)), np.uint8 if a.shape[1] < 128 else np.int64)
    for k in range(a.shape[1]):
        same &= a[:, k, None] == b[None, :, k]
        out += same
    return out


def near_in_strip(words: list[str], m: int, suffix: bool, other: list[str] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """
    Pairs of near words of which the longer one has m letters, as places in `words`, and in `other` where that is another piece of the
    strip; `suffix`: the strip shares last letters, and pairs that share the first ones too are left to the other strip.
    """
    same = other is None
    other = words if same else other
    half = m // 2
    head, tail = _codes(words, m)
    head2, tail2 = (head, tail) if same else _codes(other, m)
    full, full2 = (np.array([len(w) == m for w in x], bool) for x in (words, other))

    def blocks(rows: np.ndarray, columns: np.ndarray, triangle: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, len(rows), ROWS):
            r = rows[i : i + ROWS]
            for j in range(i if triangle else 0, len(columns), COLUMNS):
                c = columns[j : j + COLUMNS]
                prefix = _common(head[r], head2[c]) if suffix else half + _common(head[r, half:], head2[c, half:])
                # words of m letters hold no padding, so suffixes of two words are compared over as many letters as the shorter has
                near = prefix + _common(tail[r, ::-1], tail2[c, ::-1]) >= m - 1
                if suffix:
                    near &= prefix < half
                x, y = np.nonzero(near)
                x, y = r[x], c[y]
                ok = x < y if triangle else slice(None)
                yield x[ok], y[ok]

    long, long2, short, short2 = np.flatnonzero(full), np.flatnonzero(full2), np.flatnonzero(~full), np.flatnonzero(~full2)
    yield from blocks(long, long2, same)
    yield from blocks(long, short2, False)
    if not same:
        yield from blocks(short, long2, False)


def near_words(counts: DataFrame) -> DataFrame:
    """counts: word (distinct), n; read twice. word, n_near and best (n, form) of each word that has near ones."""
    length = F.char_length("word")
    strips = counts.withColumn("m", F.explode(F.array(length, length + 1))).withColumn("half", F.floor(F.col("m") / 2).cast("int"))
    strips = strips.withColumn("s", F.explode(F.array(F.struct(F.lit(False).alias("suffix"), F.substring("word", F.lit(1), F.col("half")).alias("part")), F.struct(F.lit(True).alias("suffix"), F.expr("right(word, m - half)").alias("part")))))
    strips = strips.select("word", "n", "m", "s.*")
    sizes = strips.groupBy("m", "suffix", "part").agg(F.count("*").alias("size")).where("size > 1")  # who is alone in a strip meets nobody
    sizes = durable(sizes.withColumn("pieces", F.ceil(F.col("size") / PIECE).cast("int")))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    tasks = total // TOGETHER + 1
    placed = skew_join(strips, sizes, ["m", "suffix", "part"], "size", how="inner", total=total)
    placed = placed.withColumn("own", F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    strip = F.xxhash64("m", "suffix", "part")
    group = F.when(F.col("pieces") > 1, F.struct(strip.alias("g"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))).otherwise(F.struct(F.pmod(strip, F.lit(tasks)).alias("g"), F.lit(-1).alias("i"), F.lit(-1).alias("j")))
    placed = placed.withColumn("group", group).select("group.*", "m", "suffix", "part", "own", "word", "n")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        t = table.to_pandas().sort_values(["m", "suffix", "part"], kind="stable", ignore_index=True)
        words, n = t["word"].to_numpy(object), t["n"].to_numpy()
        order = np.array(sorted(range(len(t)), key=lambda k: (-n[k], words[k])), np.int64)
        rank = np.empty(len(t), np.int64)
        rank[order] = np.arange(len(t))
        count, best = np.zeros(len(t), np.int64), np.full(len(t), len(t), np.int64)
        change = (t[["m", "suffix", "part"]] != t[["m", "suffix", "part"]].shift()).any(axis=1).to_numpy()
        edges = [*np.flatnonzero(change), len(t)]
        i, j = key[1].as_py(), key[2].as_py()
        own = t["own"].to_numpy()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            m, suffix = int(t["m"].iloc[a]), bool(t["suffix"].iloc[a])
            at = a + np.arange(b - a)
            left, right = (at, None) if i == j else (at[own[a:b] == i], at[own[a:b] == j])
            for x, y in near_in_strip(list(words[left]), m, suffix, None if right is None else list(words[right])):
                x, y = left[x], (left if right is None else right)[y]
                for p, q in ((x, y), (y, x)):
                    np.add.at(count, p, 1)
                    np.minimum.at(best, p, rank[q])
        some = np.flatnonzero(count)
        form = order[best[some]]
        return pa.table({"word": pa.array(words[some], pa.string()), "n_near": pa.array(count[some]), "form_n": pa.array(n[form]), "form": pa.array(words[form], pa.string())})

    found = placed.groupBy("g", "i", "j").applyInArrow(run, "word string, n_near long, form_n long, form string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form"))).alias("b")).select("word", "n_near", F.struct((-F.col("b.less")).alias("n"), F.col("b.form").alias("form")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """forms: word (distinct), form, without cycles. word, root: where following forms ends. Pointers double, so rounds grow with the logarithm of the longest chain."""
    ahead, ended = durable(forms.select("word", F.col("form").alias("at"))), None
    step = ahead
    while True:
        ends = ahead.groupBy("at").agg(F.count("*").alias("n"))
        ends = durable(ends.join(step.select(F.col("word").alias("at"), F.col("at").alias("next")), "at", "left"))
        met = durable(skew_join(ahead, ends, ["at"], "n", how="inner").select("word", "at", "next"))
        done = met.where("next IS NULL").select("word", F.col("at").alias("root"))
        ended = done if ended is None else ended.unionByName(done)
        ahead = met.where("next IS NOT NULL").select("word", F.col("next").alias("at"))
        if ahead.isEmpty():
            return ended
        # words that have ended point to their root for good; the others now point twice as far
        step = durable(ahead.unionByName(ended.select("word", F.col("root").alias("at"))))


def variant_groups(counts: DataFrame, min_chars: int = 5, min_count: int = 3, times: int = 2) -> DataFrame:
    """
    counts: word, n. For each word of enough letters and occurrences: word, n, n_near, form and form_n (its near word that is written
    most, if at least `times` as often as the word itself; else null), root (where forms lead).
    """
    vocabulary = durable(counts.where((F.col("n") >= min_count) & (F.char_length("word") >= min_chars)))
    met = vocabulary.join(near_words(vocabulary), "word", "left")
    is_form = F.col("best.n") >= times * F.col("n")
    met = durable(met.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, F.col("best.n")).alias("form_n")))
    found = met.join(roots(met.where("form IS NOT NULL")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
