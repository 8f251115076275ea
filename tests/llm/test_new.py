"""Periodic runs, spelling variants and MinHash near-dedup against brute force, on the given tables and on awkward rows."""

import random
import sys
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute
from conftest import DATA
from test_corpus import LONG, ROWS, SCHEMA, sort

from barflow.llm import minhash, periodic, variants
from barflow.llm.common import durable
from barflow.llm.queries import QUERIES, looped, one_letter_less

MORE = [
    (20, " ".join(["abc de f"] * 50), "en", "a", 1, "p", "i"),
    (21, "w " * 23, "en", "a", 1, "p", "i"),
    (22, "w " * 24 + "v", "en", "a", 1, "p", "i"),
    (None, LONG + " " + LONG + " " + LONG, None, None, 1, None, None),
    (23, " ".join(f"x{i % 7} y{i % 11}" for i in range(900)), "en", "a", 1, "p", "i"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS + MORE, SCHEMA)


def table(spark, name="documents", path=DATA):
    return [tuple(r) for r in spark.read.parquet(f"{path}/{name}.parquet").select("doc_id", "text").collect()]


def test_periodic_runs_of_table(spark):
    got = sort(QUERIES["op11_periodic_runs"](spark, DATA).collect())
    assert got == sort(brute.periodic(d, t) for d, t in table(spark))
    assert any(r[1] for r in got)


def test_collapse_keeps_rows_and_columns(spark, docs):
    clash = docs.withColumn("runs", F.lit("own")).withColumn("run_key", F.lit(1))
    got = periodic.collapse(clash)
    assert got.columns == [*clash.columns, "runs_"]
    want = [(r[0], brute.collapsed(brute.words(r[1]), brute.runs(brute.words(r[1])))) for r in ROWS + MORE]
    assert sort(got.select("doc_id", "text").collect()) == sort(want)
    assert periodic.collapse(docs.where("false")).count() == 0
    assert {r.doc_id: [tuple(x) for x in r.runs] for r in periodic.collapse(docs).where("doc_id IN (20, 21, 22)").collect()} == {20: [(0, 150, 3)], 21: [], 22: [(0, 24, 1)]}


def test_looped_as_stated(spark, docs):
    got = looped(docs.select("doc_id", "text").where("doc_id IS NOT NULL")).collect()
    assert sort((r.doc_id, tuple(brute.words(r.text))) for r in got) == sort((r[0], tuple(brute.looped(r[0], brute.words(r[1])))) for r in ROWS + MORE if r[0] is not None)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd"), min_size=1, max_size=40), st.integers(1, 12)), max_size=5), st.randoms())
def test_tiles_and_fragments(parts, rnd):
    """Tiles solved apart, with fragments joined by period, give every run."""
    w = [x for part, times in parts for x in part * times]
    for _ in range(rnd.randint(0, 3)):
        if w:
            w[rnd.randrange(len(w))] = "z"
    ids = periodic.numbered([x.encode() for x in w])
    spans = {}
    for s, low, at, places, part in periodic.tiles_of(ids):
        for k in range(0, len(places), 3):  # as if tiles were very short
            for p, a, b in periodic.solve(s, low, at, places[k : k + 3].tolist(), part.tolist(), len(w)):
                spans.setdefault(p, []).append((a, b))
    got = [(a, b - a, p) for p, found in spans.items() for a, b in periodic.joined(found, p) if b - a >= max(24, 3 * p)]
    assert sorted(got) == sorted(brute.runs(w))


def test_long_text_over_many_tiles(spark):
    rnd = random.Random(5)
    loop = [f"u{rnd.randrange(500)}" for _ in range(2111)]
    w = [f"v{rnd.randrange(9000)}" for _ in range(7000)] + loop * 7 + loop[:900] + ["k", "l"] * 9000 + [f"v{rnd.randrange(9000)}" for _ in range(3000)]
    docs = spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")
    keyed = docs.withColumn("k", F.lit("x"))
    assert periodic.tiles(keyed, "k").count() > 5
    (row,) = periodic.periodic_runs(keyed, "k").collect()
    assert [(r.start, r.length, r.period) for r in row.runs] == [(7000, 15677, 2111), (22677, 18000, 2)]


def test_spelling_variants_of_table(spark):
    got = sort(QUERIES["op12_spelling_variants"](spark, DATA).collect())
    assert got == sort(brute.variants(table(spark)))
    assert any(r[1] for r in got)


def test_spelling_variants_of_awkward_rows(spark, docs, monkeypatch):
    text = " ".join(["grösse"] * 9 + ["groesse"] * 3 + ["grosse"] * 4 + ["GRÖSSE", "Grösse"] + ["aaaaa"] * 3 + ["aaaaaa"] * 6 + ["aaaaaaa"] * 12 + ["b" * 300] * 3 + ["b" * 301] * 6 + ["five5"] * 3 + ["strasse"] * 3 + ["strbsse"] * 3 + ["strcsse"] * 6 + ["strdsse"] * 6)
    rows = [(40, text), (None, text), (None, None), (41, ""), (42, " \n")]
    more = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash"))
    got = lambda df: sort(variants.variant_groups(variants.word_counts(df, change=one_letter_less)).collect())
    assert got(more) == sort(brute.variants(rows))
    assert got(docs) == sort(brute.variants([r[:2] for r in ROWS + MORE]))
    assert got(docs.where("false")) == []
    monkeypatch.setattr(variants, "PIECE", 5)  # strips cut into pieces that meet in pairs
    monkeypatch.setattr(variants, "ROWS", 2)
    monkeypatch.setattr(variants, "COLUMNS", 3)
    assert got(more) == sort(brute.variants(rows))
    assert sort(QUERIES["op12_spelling_variants"](spark, DATA).collect()) == sort(brute.variants(table(spark)))


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abcÿ", min_size=1, max_size=6), min_size=2, max_size=30))
def test_strips_find_each_pair_once(words):
    found = []
    for m in range(1, 8):
        for suffix in (False, True):
            strips = {}
            for w in words:
                if m - 1 <= len(w) <= m:
                    strips.setdefault(w[len(w) - (m - m // 2) :] if suffix else w[: m // 2], []).append(w)
            for part, own in strips.items():
                if not suffix or m - m // 2 <= len(part):
                    found += [tuple(sorted((own[i], own[j]))) for x, y in variants.near_in_strip(own, m, suffix) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
    assert sorted(found) == sorted((a, b) for a in words for b in words if a < b and brute.near_words(a, b))


def test_minhash_of_table(spark):
    got = sort(QUERIES["op13_minhash"](spark, DATA).collect())
    assert got == sort(brute.minhash(table(spark)))
    assert not all(r[3] for r in got)


def test_minhash_of_awkward_rows(spark, docs):
    got = minhash.near_duplicates(docs.withColumn("node", F.lit(1)).withColumn("family", F.lit(2)))
    assert sort(got.collect()) == sort(brute.minhash([r[:2] for r in ROWS + MORE]))
    assert minhash.near_duplicates(docs.where("false")).count() == 0
    assert minhash.near_duplicates(docs.where("doc_id IN (3, 4)")).count() == 2


def test_minhash_of_a_large_family(spark, monkeypatch):
    """Copies of one text, each changed elsewhere, most of them linked through a few; blocks of a family find each other."""
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(160):
        w = list(base)
        for k in rnd.sample(range(60), rnd.randint(1, 5)):
            w[k] = f"c{rnd.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    want = sort(brute.minhash(rows))
    df = durable(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sort(minhash.near_duplicates(df).collect()) == want
    monkeypatch.setattr(minhash, "BLOCK", 8 * 60 * 30)
    monkeypatch.setattr(minhash, "COMMON", 2)
    assert sort(minhash.near_duplicates(df).collect()) == want


def test_tensored_tables_miss_as_seldom_as_stated():
    """The chance that two sets at a similarity of 0.8 agree in less than two collections, and what is measured at 0.8."""
    from math import comb

    import numpy as np

    p, n = 0.8**minhash.VALUES, minhash.GROUPS
    assert sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in (0, 1)) < 1e-6
    rng = np.random.default_rng(1)
    agreed = []
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 110, dtype=np.uint64)
        a, b = (minhash.collections_of(np.unique(s)) for s in (x[:99], x[11:]))
        agreed.append(int((a == b).sum()))
    assert min(agreed) >= 2 and abs(np.mean(agreed) / n - p) < 0.05
