"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, linededup, minhash, mixing, periodic, quality, secrets, shards, simhash, substring, topk, variants, warc
from .common import let, new_path, words_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    from public_tokenizers import path

    return path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    return warc.page_records(warc.read_warc(spark, path, payloads=False))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.drop_repeated_lines(docs, counts=("n_lines", "n_dropped"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode_decode(docs, tokenizer_path())).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.classified(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def looped(docs: DataFrame) -> DataFrame:
    """Every tenth document, by a hash of its doc_id, repeats a stretch of its own words from some word on to its end; those without doc_id stay."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(w):
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.concat(F.slice(w, F.lit(1), a.cast("int")), F.transform(F.sequence(a, n - 1), lambda i: F.get(w, (a + (i - a) % p).cast("int"))))

    text = let(words_of(F.col("text")), lambda w: F.when(F.size(w) > 0, F.array_join(repeated(w), " ")).otherwise(F.lit("")))
    return docs.withColumn("text", F.when(h % 10 == 0, text).otherwise(F.col("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse(looped(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    # the first of the greatest, in the order of start and period; products of longs, so exact
    best = F.aggregate("runs", F.lit(None).cast(periodic.RUN), lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


def one_letter_less(doc_id: str | None, word: str) -> str:
    """Every 97th pair of document and word, by a hash, loses a letter; words of rows without doc_id stay."""
    h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{word}".encode())
    return word if h % 97 else word[: h % len(word)] + word[h % len(word) + 1 :]


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_groups(variants.word_counts(_table(spark, sf_dir, "documents"), change=one_letter_less))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_warc, op3_line_dedup, op4_sharding, op5_bpe, op6_substring_dedup, op7_simhash, op8_mixing, op9_top_k, op10_secret_scan, op11_periodic_runs, op12_spelling_variants, op13_minhash)}

ORACLES = {
    "op1_quality_rules": r"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS five FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS c FROM p), range(5) x(k) WHERE c >= 2 GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
v AS (SELECT *, v // CAST(pow(2, greatest(length(bin(v)) - 6, 0)) AS BIGINT) * CAST(pow(2, greatest(length(bin(v)) - 6, 0)) AS BIGINT) AS bucket, x // CAST(pow(2, greatest(length(bin(x)) - 6, 0)) AS BIGINT) * CAST(pow(2, greatest(length(bin(x)) - 6, 0)) AS BIGINT) AS held FROM (SELECT doc_id, lang, source, n_words, unnest(['symbols', 'length', 'lines', 'repeats']) AS name, unnest([(n_symbols + 3) * 1000 // n_words, word_chars * 1000 // n_words, n_dup_lines * 1000 // n_lines, n_repeat_words * 1000 // n_words]) AS v, unnest([greatest(n_symbols - 1, 0) * 1000 // n_words, word_chars * 1000 // n_words, n_dup_lines * 1000 // n_lines, n_repeat_words * 1000 // n_words]) AS x FROM f WHERE NOT base_failed)),
b AS (SELECT lang, source, name, bucket, count(*) AS n FROM v WHERE v > 0 OR name NOT IN ('lines', 'repeats') GROUP BY ALL),
o AS (SELECT lang, source, name, max(docs) AS docs, min(bucket) FILTER (upto * 4 >= docs) AS q1, min(bucket) FILTER (upto * 4 >= docs * 3) AS q3 FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source, name ORDER BY bucket RANGE UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY lang, source, name) AS docs FROM b) GROUP BY ALL),
g AS (SELECT lang, name, max(docs) AS docs, min(bucket) FILTER (upto * 4 >= docs) AS q1, min(bucket) FILTER (upto * 4 >= docs * 3) AS q3 FROM (SELECT *, sum(n) OVER (PARTITION BY lang, name ORDER BY bucket RANGE UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY lang, name) AS docs FROM b) GROUP BY ALL),
a AS (SELECT name, min(bucket) FILTER (upto * 4 >= docs) AS q1, min(bucket) FILTER (upto * 4 >= docs * 3) AS q3 FROM (SELECT *, sum(n) OVER (PARTITION BY name ORDER BY bucket RANGE UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY name) AS docs FROM b) GROUP BY ALL),
m1 AS (SELECT k.lang, a.name, (coalesce(g.docs * g.q1, 0) + 200 * a.q1) // (coalesce(g.docs, 0) + 200) AS q1, (coalesce(g.docs * g.q3, 0) + 200 * a.q3) // (coalesce(g.docs, 0) + 200) AS q3 FROM (SELECT DISTINCT lang FROM f) k CROSS JOIN a LEFT JOIN g ON g.name = a.name AND g.lang IS NOT DISTINCT FROM k.lang),
c AS (SELECT k.lang, k.source, m1.name, (coalesce(o.docs * o.q1, 0) + 200 * m1.q1) // (coalesce(o.docs, 0) + 200) AS q1, (coalesce(o.docs * o.q3, 0) + 200 * m1.q3) // (coalesce(o.docs, 0) + 200) AS q3 FROM (SELECT DISTINCT lang, source FROM f) k JOIN m1 ON m1.lang IS NOT DISTINCT FROM k.lang LEFT JOIN o ON o.name = m1.name AND o.lang IS NOT DISTINCT FROM k.lang AND o.source IS NOT DISTINCT FROM k.source),
bad AS (SELECT DISTINCT v.doc_id FROM v JOIN c ON c.name = v.name AND c.lang IS NOT DISTINCT FROM v.lang AND c.source IS NOT DISTINCT FROM v.source WHERE (v.name <> 'length' AND held > q3 + 4 * (q3 - q1)) OR (v.name = 'length' AND n_words >= 50 AND (v < q1 - 4 * (q3 - q1) OR bucket > q3 + 4 * (q3 - q1))))
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept FROM f LEFT JOIN bad ON bad.doc_id = f.doc_id""",
    "op2_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages), g AS (SELECT h, max(page_id) AS m FROM p GROUP BY h)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5))::INTEGER >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM p JOIN g USING (h)""",
    "op3_line_dedup": """WITH l AS (SELECT doc_id, i, a[i] AS line, translate(trim(a[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))),
f AS (SELECT k, min(doc_id) AS owner FROM l GROUP BY k), j AS (SELECT l.*, length(k) >= 10 AND owner < doc_id AS gone FROM l JOIN f USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id""",
    "op8_mixing": """WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM d GROUP BY source)),
o AS (SELECT *, coalesce(sum(3 * ss) OVER (ORDER BY 3 * ss / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped, sum(w) OVER (ORDER BY 3 * ss / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_, sum(ss) OVER () AS total FROM s),
k AS (SELECT first(total - capped ORDER BY 3 * ss / w, source) AS rest, first(open_ ORDER BY 3 * ss / w, source) AS open_ FROM o WHERE (total - capped) * w / open_ <= 3 * ss),
t AS (SELECT source, ss, CASE WHEN rest * w / open_ > 3 * ss THEN CAST(3 * ss AS DOUBLE) ELSE CAST(rest * w AS DOUBLE) / open_ END AS target FROM s, k),
u AS (SELECT *, CASE WHEN ss = 0 THEN 0 ELSE floor(target / ss) END AS whole FROM t),
c AS (SELECT source, h, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h),
b AS (SELECT c.source, h, upto <= target - whole * ss OR (upto - n < target - whole * ss AND upto - (target - whole * ss) < target - whole * ss - (upto - n)) AS more FROM c JOIN u ON c.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, ss AS source_size, target, CAST(size * (whole + CASE WHEN more AND target > whole * ss THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source JOIN b ON b.source IS NOT DISTINCT FROM d.source AND b.h = d.h""",
    "op9_top_k": """WITH g AS (SELECT vec_id, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, i, CAST(floor(1024 * CAST(e[i] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT vec_id, e, unnest(range(1, len(e) + 1)) AS i FROM g)),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10""",
}

#: CRC-32 of bytes in SQL: its table of 256 from its rule, then one step a byte.
CRC_TABLE = "ct AS (SELECT list(c ORDER BY k) AS tab FROM (SELECT k, list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM range(256) t(k)))"


def _crc(s: str) -> str:
    codes = f"list_transform(range(strlen({s})), lambda i: CAST('0x' || substr(hex(encode({s})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES |= {
    "op11_periodic_runs": f"""WITH {CRC_TABLE}, d AS (SELECT doc_id, {WORDS} AS w, {_crc("CAST(doc_id AS VARCHAR)")} AS h FROM documents, ct),
a AS (SELECT *, len(w) AS n, h // 10 AS g FROM d), b AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM a),
x AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END) AS word FROM b),
e AS (SELECT x.doc_id, y.i - x.i AS p, x.i FROM x JOIN x y ON y.doc_id = x.doc_id AND y.word = x.word AND y.i > x.i AND (y.i - x.i) * 3 <= x.n),
c AS (SELECT doc_id, p, min(i) AS s, count(*) + p AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k FROM e) GROUP BY doc_id, p, k HAVING count(*) + p >= greatest(24, 3 * p)),
r AS (SELECT * FROM c WHERE NOT EXISTS (FROM c q WHERE q.doc_id = c.doc_id AND q.p < c.p AND c.p % q.p = 0 AND q.s <= c.s AND q.s + q.len >= c.s + c.len)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + len)) AS i FROM r),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS t FROM x ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i GROUP BY x.doc_id),
t AS (SELECT doc_id, count(*) AS n_runs, first({{'s': s, 'len': len, 'p': p}} ORDER BY len::DOUBLE / p DESC, s, p) AS best, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS l FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.len AS length, best.p AS period, 1000 * best.len // best.p AS exponent_milli, sha256(coalesce(l, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op12_spelling_variants": f"""WITH RECURSIVE {CRC_TABLE}, r AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all({ASCII_LOWER.format('text')}, '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY doc_id, w),
h AS (SELECT w, c, {_crc("(doc_id || ':' || w)")} AS h FROM r, ct),
v AS (SELECT w, CAST(sum(c) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, c FROM h) GROUP BY w HAVING sum(c) >= 3 AND length(w) >= 5),
e AS (SELECT w, n, i, left(w, i - 1) || substr(w, i + 1) AS less FROM (SELECT *, unnest(range(1, length(w) + 1)) AS i FROM v)),
near AS (SELECT a.w, b.w AS f, b.n FROM e a JOIN e b ON a.less = b.less AND a.i = b.i AND a.w <> b.w UNION SELECT e.w, v.w, v.n FROM e JOIN v ON v.w = e.less UNION SELECT v.w, e.w, e.n FROM e JOIN v ON v.w = e.less),
b AS (SELECT w, count(*) AS n_near, first(f ORDER BY n DESC, f) AS f, max(n) AS fn FROM near GROUP BY w),
g AS (SELECT v.w, n, coalesce(n_near, 0) AS n_near, CASE WHEN fn >= 2 * n THEN f END AS form, CASE WHEN fn >= 2 * n THEN fn END AS form_n FROM v LEFT JOIN b ON b.w = v.w),
chain AS (SELECT w, w AS x, 0 AS k FROM g UNION ALL SELECT chain.w, g.form, k + 1 FROM chain JOIN g ON g.w = chain.x WHERE g.form IS NOT NULL)
SELECT g.w AS word, form, root, n, n_near, form_n FROM g JOIN (SELECT w, max_by(x, k) AS root FROM chain GROUP BY w) c ON c.w = g.w""",
    "op13_minhash": f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", ASCII_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS x FROM (SELECT *, unnest(range(1, greatest(len(w), least(len(w), 1) + 1))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT p.a, p.b FROM (SELECT s.doc_id AS a, t.doc_id AS b, count(*) AS k FROM s JOIN s t ON t.x = s.x AND t.doc_id <> s.doc_id GROUP BY ALL) p JOIN n ON n.doc_id = a JOIN n m ON m.doc_id = b WHERE 100 * k >= 80 * (n.n + m.n - k)),
reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least_, d.doc_id)) AS component_id, least(d.doc_id, coalesce(c.least_, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS least_ FROM reach GROUP BY a) c ON c.a = d.doc_id""",
}
