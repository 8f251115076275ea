"""
Secret scans: patterns find candidates, a random forest removes the false ones.

Candidates are values of 5 characters or more assigned to names like password or token (in quotes with all that they hold, blanks and commas too), those of bearer and authorization headers and of URLs with a password,
signed web tokens, bodies of private keys in PEM form, and runs of 20 token characters or more. Their features are length,
transitions between character classes, entropy, how much of them words of the corpus's own dictionary cover, the path (source) and the
words beside them. The forest is trained here, from labelled findings: a table given by the caller, or planted ones in the usual forms
(planted.py) with those of the corpus that review() is sure of, so that its own dictionary and neighbours count. Training takes
`most_labels` findings of the corpus at most (a documented bound, chosen by hash) and `lines` planted ones; the dictionary is counted over all documents, and every candidate of every text is scored.

Nulls: a null text has no candidates; a null doc_id is carried along; a null source is an empty path. Repeated rows give repeated
findings. Without labels of both kinds candidates are judged by review() alone. Other columns are ignored. labels of rows without doc_id
meet candidates of rows without doc_id at the same place.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .planted import planted

#: Names to which secrets are assigned, and words that speak against one.
NAMES = "password passwd pwd passphrase secret token apikey api_key access_key auth credential private_key bearer"
AGAINST = "example sample test dummy placeholder fake checksum sha1 sha256 md5 commit uuid hash digest"
SCHEMES = "bearer basic digest token".split()
TELLING = re.compile("|".join(NAMES.split()) + r"|(?:^|[_.-])(?:key|pass)$")
#: A name and an operator (the value is read apart, so that a value may be a name too), and forms without one: headers and URLs.
ASSIGNED = re.compile(r"(?<![\w.-])(?P<name>[\w.-]++)[\"']?\s*+(?::=|=>|:|=|>)\s*+[\"']?")
#: A value in quotes runs to the same quote; another to a blank, a quote or an angle bracket, or to a comma or semicolon that ends it.
LEAST = 5
QUOTED = {q: re.compile(rf"[^{q}\n]{{{LEAST},}}(?={q})") for q in "\"'"}
VALUE = re.compile(rf"(?:[^\s\"',;<>]|[,;](?!\s|$|[\w.-]{{1,40}}[\"']?\s*[:=])){{{LEAST},}}")
BARE = [re.compile(x) for x in (r"(?i)\bbearer[ \t]+(?P<value>[^\s\"',;<>]{8,})", r"(?i)\bauthorization[\"']?\s*+[:=]\s*+[\"']?\w+[ \t]+(?P<value>[^\s\"',;<>]{8,})", r"://[^\s/:@\"'<>]*+:(?P<value>[^\s/@\"'<>]+)@", r"(?P<value>\beyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]*)", r"-----BEGIN [A-Z ]*PRIVATE KEY-----\s*(?P<value>[A-Za-z0-9+/=\s]{40,}?)\s*-----END")]
RUN = re.compile(r"[A-Za-z0-9_+/=-]{20,}")
NAMED = re.compile(r"[A-Za-z_][\w-]*+=+(?=[^=])")
PARTS = re.compile(r"[^\W\d_]{3,}")
NEAR = 40
CLASSES = "adUo"
FIELDS = ["length", "entropy", "digits", "upper", "hexes", "covered", "assigned", "quoted", "named", "against", "path_against", *(f"{a}{b}" for a in CLASSES for b in CLASSES)]
SCHEMA = "doc_id long, source string, start long, length long, kind string, secret_sha256 string, features array<double>"
DICTIONARY_SHARE, HELD = 1000, 200_000


def kind_of(c: str) -> str:
    return "d" if c.isdigit() else "U" if c.isupper() else "a" if c.isalpha() else "o"


def features(value: str, before: str, after: str, source: str, assigned: bool, dictionary: frozenset[str]) -> list[float]:
    n, counts = len(value), Counter(value)
    kinds = [kind_of(c) for c in value]
    moves, near = Counter(zip(kinds, kinds[1:], strict=False)), (before + " " + after).lower()
    covered = sum(len(w) for w in PARTS.findall(value) if w.lower() in dictionary)
    beside = set(re.findall(r"\w+", near))
    return [
        math.log2(n), -sum(k / n * math.log2(k / n) for k in counts.values()), kinds.count("d") / n, kinds.count("U") / n, sum(c in "0123456789abcdefABCDEF" for c in value) / n, covered / n,
        float(assigned), float(before[-1:] in "\"'" and before[-1:] != ""), float(any(w in near for w in NAMES.split())), float(any(w in beside for w in AGAINST.split())), float(any(w in source.lower() for w in AGAINST.split())),
        *(moves[a, b] / max(1, n - 1) for a in CLASSES for b in CLASSES),
    ]


def found_in(text: str) -> Iterator[tuple[int, str, bool]]:
    """Start, value and whether it is assigned to a telling name; overlapping candidates count once, assigned ones first."""
    spans: dict[int, tuple[int, str, bool]] = {}
    for m in ASSIGNED.finditer(text):
        if TELLING.search(m["name"].lower()) and (v := QUOTED.get(m[0][-1], VALUE).match(text, m.end()) or VALUE.match(text, m.end())) and v[0].lower() not in SCHEMES:
            spans[v.start()] = (v.start(), v[0], True)
    for pattern in BARE:
        for m in pattern.finditer(text):
            spans[m.start("value")] = (m.start("value"), m["value"], True)
    taken, reached = [], 0
    for s, v, _ in sorted(spans.values()):
        if s < reached:
            del spans[s]
        else:
            reached = s + len(v)
            taken.append((s, reached))
    k = 0
    for m in RUN.finditer(text):
        named = NAMED.match(m[0])
        parts = [(m.start(), named[0].rstrip("=")), (m.start() + named.end(), m[0][named.end() :])] if named else [(m.start(), m[0])]
        for start, value in parts:
            while k < len(taken) and taken[k][1] <= start:
                k += 1
            free = k == len(taken) or taken[k][0] >= start + len(value)
            if free and len(value) >= (8 if named and start > m.start() else 20):
                spans.setdefault(start, (start, value, False))
    return iter(sorted(spans.values()))


def dictionary(docs: DataFrame) -> frozenset[str]:
    """
    Lower-case words of letters that are a thousandth of a thousandth of all the corpus's words or more: fewer than a million by
    arithmetic, and in practice thousands. Counted over all texts; tasks send sums, and only the frequent words come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                held.update(w.strip(".,!?;:|*#$%&\"'()") for w in (text.as_py() or "").lower().split())
                if len(held) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    counted = durable(docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    frequent = counted.where((F.col("n") * DICTIONARY_SHARE * DICTIONARY_SHARE >= total) & F.col("word").rlike(r"^\p{L}{3,24}$")).select("word")
    return frozenset(r.word for r in frequent.collect())


def candidates(docs: DataFrame, words: frozenset[str]) -> DataFrame:
    """All candidates of all texts, with their features; the secret itself isn't kept, only its hash."""
    held = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, source in zip(*batch.columns, strict=True):
                text, source = text.as_py() or "", source.as_py()
                for start, value, assigned in found_in(text):
                    end = start + len(value)
                    out.append((doc.as_py(), source, start, len(value), "assigned" if assigned else "run", hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest(), features(value, text[max(0, start - NEAR) : start], text[end : end + NEAR], source or "", assigned, held.value)))
            if out:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "source", "start", "length", "kind", "secret_sha256", "features"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.col("source").cast("string")).mapInArrow(run, SCHEMA)


def review(found: DataFrame) -> DataFrame:
    """Adds label: 1 for values that are surely secrets, 0 for those that surely aren't, else null."""
    f = {name: F.col("features")[i] for i, name in enumerate(FIELDS)}
    mixed = (f["digits"] > 0.1) & (f["entropy"] > 2.5)
    sure = mixed & ((f["assigned"] == 1) | (f["named"] == 1)) & (f["covered"] == 0) & (f["against"] == 0) & (f["path_against"] == 0)
    never = (f["digits"] == 0) | (f["covered"] > 0.5) | ((f["against"] == 1) & (f["assigned"] == 0)) | (f["entropy"] < 2)
    open_ = (f["digits"] == 0) & (f["assigned"] == 1)  # a passphrase, perhaps
    return found.withColumn("label", F.when(sure, 1.0).when(never & ~open_, 0.0))


def forest(train: DataFrame, trees: int = 30, depth: int = 6, seed: int = 7):
    """A random forest of features and label."""
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(train.select(array_to_vector("features").alias("x"), "label"))


def scan(docs: DataFrame, labels: DataFrame | None = None, most_labels: int = 20_000, lines: int = 4000, trees: int = 30, depth: int = 6, seed: int = 7) -> DataFrame:
    """
    doc_id, start, length, kind, secret_sha256, probability, is_secret for every candidate. labels: doc_id, start, is_secret of
    findings that were looked at (1 where two verdicts differ); without them the forest learns from planted lines and what review() is sure of.
    """
    words = dictionary(docs)
    found = durable(review(candidates(docs, words)))
    if labels is not None:
        known = labels.select("doc_id", "start", F.col("is_secret").cast("double").alias("label")).groupBy("doc_id", "start").agg(F.max("label").alias("label"))
        same = F.col("c.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("c.start") == F.col("k.start"))
        found = durable(found.drop("label").alias("c").join(known.alias("k"), same, "left").select("c.*", "k.label"))
    known = found.where("label IS NOT NULL")
    half = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id", "start", "secret_sha256")).limit(most_labels // 2) for k in (0.0, 1.0)]
    train = half[0].unionByName(half[1]).select("features", "label")
    if labels is None and lines:
        made = planted(docs.sparkSession, lines)
        train = train.unionByName(candidates(made, words).join(made.select("doc_id", "start", "label"), ["doc_id", "start"]).select("features", "label"))
    train = durable(train)
    plain = ["doc_id", "start", "length", "kind", "secret_sha256"]
    if train.select("label").distinct().count() < 2:
        return found.select(*plain, F.coalesce("label", F.lit(0.5)).alias("probability"), (F.coalesce("label", F.lit(1.0)) > 0.5).alias("is_secret"))
    scored = forest(train, trees, depth, seed).transform(found.select(*plain, array_to_vector("features").alias("x")))
    p = vector_to_array("probability")[1]
    return scored.select(*plain, p.alias("probability")).withColumn("is_secret", F.col("probability") > 0.5)
