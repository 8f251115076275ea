"""
Byte-level BPE by a pair occurrence index.

All words of a block of texts that haven't been met yet are laid out in one array of symbols. An index maps each mergeable pair to all
its positions in that array; the active ranks wait in a heap. The least rank is applied to all its positions at once, which gives new
pairs only beside them, and those positions are added to their pairs' lists. A position that has changed meanwhile is recognised when
its pair's turn comes. Words are independent, so ascending ranks over the whole block are ascending ranks in each word.

The tokenizer file is read by the driver (its path is a parameter) and broadcast; its size is fixed. Nulls: a null text is encoded
as an empty one, to no tokens. Very long texts are cut between words, where no token can reach across, and give the same tokens.
Repeated rows are encoded each for itself; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

#: How byte-level BPE of this family cuts a text into words; the first for any text, the second for ASCII alone.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
GAP = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
#: Characters of text whose words are held at once, and words whose tokens are remembered.
BLOCK, MEMORY = 1 << 20, 500_000


def byte_chars() -> list[str]:
    """The character by which the vocabulary file writes each byte: itself if it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in prints else next(rest)) for b in range(256)]


class Codec:
    def __init__(self, spec: str):
        spec = json.loads(spec)
        vocab, merges = spec["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        chars = byte_chars()
        self.first = np.array([vocab[c] for c in chars], np.int64)
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64)
        self.left, self.right, self.made = pairs.T
        keys = self.left << 32 | self.right
        self.by_key = np.argsort(keys)
        self.keys = keys[self.by_key]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")) or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only plain byte-level files are read")
        self.special = {s: np.array([i], np.int32).tobytes() for s, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        byte = {c: b for b, c in enumerate(chars)}
        self.bytes = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(byte[c] for c in token)
        for token, i in special.items():
            self.bytes[i] = token.encode()
        self.known: dict[str, bytes] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (a >= 0) & (b >= 0), self.by_key[at], -1)

    def learn(self, words: list[str]) -> None:
        """Encodes `words` together and remembers their tokens."""
        if not words:
            return
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        ends = np.cumsum([len(r) for r in raw])
        n = int(ends[-1])
        none = n  # stands for no neighbour
        symbol = np.append(self.first[np.frombuffer(b"".join(raw), np.uint8)], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1] = none
        after[none] = none
        before[0] = none
        before[ends[:-1]] = none
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray) -> None:
            rank = self.ranks(symbol[places], symbol[after[places]])
            places, rank = places[rank >= 0], rank[rank >= 0]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            starts = np.flatnonzero(np.diff(rank, prepend=-1))
            for r, part in zip(rank[starts].tolist(), np.split(places, starts[1:]), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        enter(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            p = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.unique(lists[0])
            a, b = self.left[r], self.right[r]
            p = p[(symbol[p] == a) & (symbol[after[p]] == b)]
            if not len(p):
                continue
            if a == b:  # of a run of equal symbols, every second one
                k = np.arange(len(p))
                start = np.append(True, after[p[:-1]] != p[1:])
                p = p[(k - np.maximum.accumulate(np.where(start, k, 0))) % 2 == 0]
            gone = after[p]
            beyond = after[gone]
            symbol[p], symbol[gone] = self.made[r], -1
            after[p], before[beyond] = beyond, p
            before[none] = none
            near = before[p]
            enter(np.concatenate((near[near != none], p)))
        left = np.flatnonzero(symbol[:n] >= 0)
        tokens = symbol[left].astype(np.int32).tobytes()
        upto = (np.searchsorted(left, ends) * 4).tolist()
        for w, i, j in zip(words, [0, *upto], upto, strict=False):
            self.known[w] = tokens[i:j]

    @staticmethod
    def words(text: str) -> Iterator[list[str]]:
        """The words of a text without special tokens, at most about BLOCK characters of them at once."""
        find = ASCII_WORDS.findall if text.isascii() else WORDS.findall
        at = 0
        while at < len(text):
            gap = GAP.search(text, at + BLOCK) if len(text) - at > BLOCK else None
            end = gap.start() if gap else len(text)
            yield find(text[at:end] if at or gap else text)
            at = end

    def encode(self, text: str) -> bytes:
        """The tokens as 32-bit integers."""
        out = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            for words in self.words(part):
                try:
                    out.append(b"".join(map(self.known.__getitem__, words)))
                except KeyError:
                    if len(self.known) > MEMORY:
                        self.known.clear()
                    self.learn([w for w in dict.fromkeys(words) if w not in self.known])
                    out.append(b"".join(map(self.known.__getitem__, words)))
        return b"".join(out)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Texts are taken in blocks, so that the index spans the new words of many of them."""
        at = 0
        while at < len(texts):
            new: dict[str, None] = {}
            end, size = at, 0
            while end < len(texts) and size < BLOCK:
                size += len(texts[end])
                if len(texts[end]) <= BLOCK:
                    for part in self.cut.split(texts[end]) if self.cut else [texts[end]]:
                        if part not in self.special:
                            for words in self.words(part):
                                new.update(dict.fromkeys(words))
                end += 1
            if len(self.known) > MEMORY:
                self.known.clear()
            self.learn([w for w in new if w not in self.known])
            yield from map(self.encode, texts[at:end])
            at = end

    def decode(self, tokens: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, tokens)).decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def _codec(spec) -> Codec:
    """One a Python worker: workers are used again by later tasks."""
    if spec.id not in _codecs:
        _codecs.clear()
        _codecs[spec.id] = Codec(spec.value)
    return _codecs[spec.id]


class _Spec:
    def __init__(self, spark, path: str):
        text = Path(path).read_text(encoding="utf-8")
        self.id, self.held = hash(text), spark.sparkContext.broadcast(text)

    @property
    def value(self) -> str:
        return self.held.value


def _lists(tokens: list[bytes]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(t) // 4 for t in tokens]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(tokens), np.int32)))


def _added(df: DataFrame, name: str, kind: T.DataType, run) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                yield pa.RecordBatch.from_arrays([*part.columns, run(part)], names=schema.names)

    return df.mapInArrow(each, schema)


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`df` with the tokens of `text` in a further column (`ids`, array<int>). tokenizer: path of a byte-level BPE file."""
    spec, k = _Spec(df.sparkSession, tokenizer), df.columns.index(text)
    return _added(df, fresh(df, ids), T.ArrayType(T.IntegerType()), lambda part: _lists([*_codec(spec).encode_all([t or "" for t in part.column(k).to_pylist()])]))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`df` with the text of the tokens in `ids`; null tokens give null."""
    spec, k = _Spec(df.sparkSession, tokenizer), df.columns.index(ids)
    return _added(df, fresh(df, text), T.StringType(), lambda part: pa.array([None if t.as_py() is None else _codec(spec).decode(t.values.to_pylist()) for t in part.column(k)], pa.string()))


def _renamed(df: DataFrame, name: str, added: set[str]) -> str:
    taken = {c.lower() for c in df.columns} | added
    while name.lower() in taken:
        name += "_"
    return name


def encode_decode(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """
    encode() and decode() in one pass over `df`, whose other columns aren't touched; adds ids and decoded, drops the text. Columns of
    `df` that have the names of what this or digests() adds are kept as ids_, decoded_ and so on.
    """
    added = {"ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"}
    df = df.withColumnsRenamed({c: _renamed(df, c, added) for c in df.columns if c.lower() in added})
    spec, rest = _Spec(df.sparkSession, tokenizer), [c for c in df.columns if c != text]
    schema = df.select(*(f"`{c}`" for c in rest)).schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codec = _codec(spec)
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                tokens = [*codec.encode_all([t or "" for t in part.column(text).to_pylist()])]
                decoded = pa.array([codec.decode(np.frombuffer(t, np.int32).tolist()) for t in tokens], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), _lists(tokens), decoded], names=schema.names)

    return df.mapInArrow(each, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """encode_decode()'s result with n_tokens, ids_sha256 and decoded_sha256 in place of the decoded text."""
    return encoded.select(
        *(F.col(f"`{c}`") for c in encoded.columns if c != "decoded"),
        F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
