"""
Quality rules whose limits come from the corpus itself.

For every text a few measures are taken. Each language and source gets a quantile sketch of each measure: counts in buckets whose
width is a 32nd of their value, so a quantile is off by 3 % at most. Sketches are merged by adding counts, which is a plain grouped
sum: partial on every task, exact in any order, the same in every run. A document is dropped where a measure lies far outside the
middle half of its own group, whose quartiles are drawn towards those of its language and of the corpus the more, the smaller it is. A
large source of which over a quarter is junk sets its limits by that junk.

Nulls: a null text has no words and fails; a null language or source is a group of its own. A text of white space fails like an
empty one. Repeated rows are judged each for itself. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, durable, let, skew_join, stored, words_of

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


@dataclass(frozen=True)
class Limits:
    """
    A measure fails beyond `reach` times the distance between its group's quartiles above the third (mean word length also below the
    first). Measures are thousandths. Quartiles of repetition, which most documents have none of, are those of the documents that have
    some. Symbols are too rare for that: in most groups only junk has any. So their quartiles are those of the rate that a text's length
    leaves open (three symbols more than it has, the rule of three), and held against the limit is the rate with one symbol less; a
    limit depends on how long a group's texts are and how many symbols they have, and one symbol alone fails nobody. A group's
    quartiles are the mean of its own and its language's, weighted with its number of documents and `weight`; the language's are so
    drawn towards the whole corpus's. Word length is judged from `min_words` words on.
    """

    min_words_base: int = 10
    repeat_percent: int = 20
    reach: int = 4
    weight: int = 200
    min_words: int = 50
    measures: tuple[str, ...] = ("symbols", "length", "lines", "repeats")
    where_any: tuple[str, ...] = ("lines", "repeats")


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of five words that the text has twice or more."""
    n = F.size(words)
    hashes = F.when(n < WINDOW + 1, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW)))))

    def covered(h: Column) -> Column:
        places = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        marked = let(places, lambda s: F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), (F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"])).alias("twice"))))
        starts = F.sort_array(F.transform(F.filter(marked, lambda x: x["twice"]), lambda x: x["i"]))
        new = let(starts, lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def measure(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, lang, source and the measures of each text; if `whole`, also the row itself, as a struct of that name."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = ["doc_id", "lang", "source", *(["whole"] if whole else [])]
    rows = docs.select("doc_id", "lang", "source", "text", *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")] if whole else []))
    cut = rows.select(*kept, text.alias("t"), words_of(F.col("text")).alias("w"), F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("l"))
    n = lambda c: c.cast("long")
    return cut.select(
        *kept,
        n(F.size("w")).alias("n_words"), n(F.char_length(F.array_join("w", ""))).alias("word_chars"), n(F.regexp_count("t", F.lit(SYMBOLS))).alias("n_symbols"),
        n(F.size("l")).alias("n_lines"), n(F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"), repeated_words(F.col("w")).alias("n_repeat_words"),
    )


def bucket(v: Column) -> Column:
    """The lower end of a value's bucket: its six leading bits, so exact below 64."""
    low = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, low), low)


def sketches(values: DataFrame, by: list[str]) -> DataFrame:
    """values: `by`, name, v. The sketch of each name in each group: bucket and count, mergeable by adding counts."""
    return values.groupBy(*by, "name", bucket(F.col("v")).alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    return sketch.groupBy(*by, "name", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """For each group and name: docs, q1, q3; a group's sketch has a few hundred buckets, whatever its size."""
    w = Window.partitionBy(*by, "name")
    ranked = sketch.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("docs", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("docs") * q, F.col("bucket")))
    return ranked.groupBy(*by, "name").agg(F.max("docs").alias("docs"), at(1).alias("q1"), at(3).alias("q3"))


def _key(*names: str) -> Column:
    return F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(n)), F.lit("?")) for n in names))


def thresholds(measured: DataFrame, limits: Limits) -> DataFrame:
    """One row for each language and source: grp, members, and low_ and high_ of each measure."""
    passed = measured.where(~F.col("base_failed"))
    values = passed.select("grp", "lang_key", F.explode(F.array(*(F.struct(F.lit(m).alias("name"), F.col(m).alias("v")) for m in limits.measures))).alias("x")).select("grp", "lang_key", "x.*").where(~F.col("name").isin(*limits.where_any) | (F.col("v") > 0))
    fine = durable(sketches(values, ["grp", "lang_key"]))
    coarse = durable(merged(fine, ["lang_key"]))
    own, lang, all_ = quartiles(fine, ["grp"]), quartiles(coarse, ["lang_key"]), quartiles(merged(coarse, []), [])
    groups = measured.groupBy("grp", "lang_key").agg(F.count("*").alias("members"))
    cells = groups.crossJoin(F.broadcast(all_.select("name", F.col("q1").alias("a1"), F.col("q3").alias("a3"))))  # four rows, one for each measure
    cells = cells.join(lang.select("lang_key", "name", F.col("docs").alias("ld"), F.col("q1").alias("l1"), F.col("q3").alias("l3")), ["lang_key", "name"], "left")
    cells = cells.join(own.select("grp", "name", F.col("docs").alias("od"), F.col("q1").alias("o1"), F.col("q3").alias("o3")), ["grp", "name"], "left")
    drawn = lambda n, q, to: F.expr(f"(coalesce({n} * {q}, 0) + {limits.weight} * {to}) div (coalesce({n}, 0) + {limits.weight})")
    cells = cells.withColumns({"m1": drawn("ld", "l1", "a1"), "m3": drawn("ld", "l3", "a3")}).withColumns({"q1": drawn("od", "o1", "m1"), "q3": drawn("od", "o3", "m3")})
    reach = (F.col("q3") - F.col("q1")) * limits.reach
    return cells.groupBy("grp").agg(F.max("members").alias("members"), *(F.max(F.when(F.col("name") == m, f)).alias(f"{end}_{m}") for m in limits.measures for end, f in (("low", F.col("q1") - reach), ("high", F.col("q3") + reach))))


def rated(docs: DataFrame, limits: Limits, whole: bool = False) -> DataFrame:
    """The measures with base_failed, in thousandths what the limits hold for, and the keys of group and language."""
    n = F.col("n_words")
    per = lambda a, b: F.expr(f"coalesce({a} * 1000 div {b}, 0)")
    measured = measure(docs, whole).withColumn("base_failed", (n < limits.min_words_base) | (F.col("n_repeat_words") * 100 > n * limits.repeat_percent))
    return measured.withColumns({"symbols": per("(n_symbols + 3)", "nullif(n_words, 0)"), "symbols_held": per("greatest(n_symbols - 1, 0)", "nullif(n_words, 0)"), "length": per("word_chars", "nullif(n_words, 0)"), "lines": per("n_dup_lines", "nullif(n_lines, 0)"), "repeats": per("n_repeat_words", "nullif(n_words, 0)"), "grp": _key("lang", "source"), "lang_key": _key("lang")})


def judged(measured: DataFrame, limits: Limits) -> DataFrame:
    """`measured`, which is read several times, with kept: whether a row passes the base rules and its group's limits. Quantiles are lower ends of buckets, so a value is held against an upper limit by its bucket's."""
    met = skew_join(measured, durable(thresholds(measured, limits)), ["grp"], "members")
    held = {"symbols": "symbols_held"}
    ok = [F.coalesce(bucket(F.col(held.get(m, m))) <= F.col(f"high_{m}"), F.lit(True)) for m in limits.measures if m != "length"]
    ok.append((F.col("n_words") < limits.min_words) | ((F.col("length") >= F.col("low_length")) & (bucket(F.col("length")) <= F.col("high_length"))))
    fine = ok[0]
    for x in ok[1:]:
        fine = fine & x
    return met.withColumn("kept", ~F.col("base_failed") & F.coalesce(fine, F.lit(True)))


def judge(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """
    One row for each document: the measures, base_failed, and kept: whether it passes the base rules and its group's limits.

    The measures are taken once and kept in the shared folder; the text is never shuffled.
    """
    limits = limits or Limits()
    return judged(durable(rated(docs, limits)), limits)


def keep_good(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """
    The documents that judge() keeps, with all their columns.

    Rows are stored beside their measures, which thresholds() reads alone, so verdicts need no join back to the texts: rows of large
    groups stay where they are, and only the texts of groups with less than a thousandth of all rows are shuffled.
    """
    limits = limits or Limits()
    good = judged(stored(rated(docs, limits, whole=True), "measured"), limits).where("kept")
    return good.select(*(F.col("whole").getField(c).alias(c) for c in docs.columns))
