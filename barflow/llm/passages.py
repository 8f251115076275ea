"""
What op6 cuts a text's stream of words into, in numpy, many texts at once.

A text is its words, compared without regard to the case of A-Z or to white space. Two kinds of pieces are taken from it, both chosen
by what the words are and not by where lines begin, so that equal stretches of different texts are cut alike:

* Paragraphs: a cut is a five-word shingle whose hash is the least within 51 words on both sides, so whole paragraphs have over 50
  words, 103 in the mean. Pieces at a text's ends are paragraphs if they have over 50 words, and so is a text of at most 204 words as a
  whole, since a changed word can move a cut. Each has its MinHash bands.
* Segments: runs of 30 words whose least eight-word hash stands first or last among their 23 (closed syncmers). Any 51 words in
  succession hold one whole segment at least, whatever stands beside them; there is about one in 11 words.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash

SHINGLE, PASSAGE, SEGMENT, INNER, WHOLE = 5, 51, 30, 8, 204
FACTOR = 0x9E3779B97F4A7C15
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def runs(w: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words; runs of a power of two are put together from halves."""
    if len(w) < n:
        return np.zeros(0, np.uint64)
    whole, done, part, size = None, 0, w, 1
    while True:
        if n & size:
            if whole is None:
                whole = part
            else:
                m = len(w) - done - size + 1
                whole = whole[:m] * np.uint64(pow(FACTOR, size, 1 << 64)) + part[done : done + m]
            done += size
        if done == n:
            return mixed(whole[: len(w) - n + 1])
        part = part[: len(part) - size] * np.uint64(pow(FACTOR, size, 1 << 64)) + part[size:]
        size *= 2


def least(h: np.ndarray, n: int) -> np.ndarray:
    """The least of every n values."""
    part, size = h, 1
    while size * 2 <= n:
        part = np.minimum(part[:-size], part[size:])
        size *= 2
    return np.minimum(part[: len(h) - n + 1], part[n - size : len(h) - size + 1])


class Cutter:
    """Segments, paragraphs and MinHash bands of texts."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        draw = np.random.default_rng(20_250)
        self.times = draw.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        self.known: dict[bytes, int] = {}

    def words(self, text: str | None) -> np.ndarray:
        """A hash of each word."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
        if len(self.known) > 1_000_000:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, 11)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def segments(self, w: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """w: words of texts one after another; left: how many words its text has from each word on. Places and hashes."""
        inner = SEGMENT - INNER
        if len(w) < SEGMENT:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = runs(w, INNER)
        low = least(h, inner + 1)
        at = np.flatnonzero(((h[: len(low)] == low) | (h[inner : inner + len(low)] == low)) & (left[: len(low)] >= SEGMENT))
        return at, runs(w, SEGMENT)[at].view(np.int64)

    def cuts(self, w: np.ndarray, left: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Where paragraphs begin inside texts; text: the number of the text of each word."""
        if len(w) < SHINGLE:
            return np.zeros(0, np.int64)
        h = np.full(len(w), MOST)
        h[: len(w) - SHINGLE + 1] = runs(w, SHINGLE)
        h[left < SHINGLE] = MOST
        where = np.arange(len(w)) + PASSAGE * (text + 1)
        padded = np.full(len(w) + PASSAGE * (int(text[-1]) + 2), MOST)
        padded[where] = h
        low = least(padded, PASSAGE)
        return np.flatnonzero((h < low[where - PASSAGE]) & (h <= low[where + 1]) & (h < MOST))

    def signed(self, w: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """An array of paragraphs by bands."""
        out = np.zeros((len(starts), self.bands), np.uint64)
        if not len(starts):
            return out.view(np.int64)
        h = np.append(runs(w, SHINGLE), MOST)
        edges = np.stack((starts, ends - SHINGLE + 1), axis=1).ravel()
        for b in range(self.bands):
            out[:, b] = b + 1
            for k in range(b * self.rows, (b + 1) * self.rows):
                out[:, b] = mixed(out[:, b] * np.uint64(FACTOR) + np.minimum.reduceat(h * self.times[k] + self.plus[k], edges)[::2])
        return out.view(np.int64)

    def cut(self, texts: list[np.ndarray]) -> list[tuple]:
        """For each text (its words' hashes): places and hashes of segments, starts, ends, hashes, sizes (distinct shingles) and bands of paragraphs."""
        n = np.array([len(t) for t in texts])
        w, begins = np.concatenate(texts), np.concatenate(([0], np.cumsum(n)))
        text = np.repeat(np.arange(len(n)), n)
        left = np.repeat(begins[1:], n) - np.arange(len(w))
        at, seg = self.segments(w, left)
        edges = np.union1d(self.cuts(w, left, text), begins)
        short = n <= WHOLE
        pieces = np.unique(np.concatenate((np.stack((edges[:-1], edges[1:]), axis=1), np.stack((begins[:-1][short], begins[1:][short]), axis=1))), axis=0)
        starts, ends = pieces[pieces[:, 1] - pieces[:, 0] >= PASSAGE].T
        bands = self.signed(w, starts, ends)
        grams, places = runs(w, SHINGLE), list(zip(starts.tolist(), ends.tolist(), strict=True))
        names = [hashed(w[s:e]) for s, e in places]
        sizes = np.array([distinct(grams[s : e - SHINGLE + 1]) for s, e in places], np.int64)
        a, p = np.searchsorted(at, begins), np.searchsorted(starts, begins)
        return [(at[a[i] : a[i + 1]] - b, seg[a[i] : a[i + 1]], starts[p[i] : p[i + 1]] - b, ends[p[i] : p[i + 1]] - b, names[p[i] : p[i + 1]], sizes[p[i] : p[i + 1]], bands[p[i] : p[i + 1]]) for i, b in enumerate(begins[:-1])]


def distinct(x: np.ndarray) -> int:
    x = np.sort(x)
    return 1 + int(np.count_nonzero(x[1:] != x[:-1]))


def hashed(words: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(words.tobytes()) - (1 << 63)


def windows(w: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the runs of PASSAGE words that hold one of the segments at `wanted`."""
    at = np.unique((wanted[:, None] - np.arange(PASSAGE - SEGMENT + 1)[None, :]).ravel())
    at = at[(at >= 0) & (at <= len(w) - PASSAGE)]
    return at, runs(w, PASSAGE)[at].view(np.int64)


def without_passages(text: str | None, ranges: list | None) -> str | None:
    """The text without the words in ranges; a line that loses all its words goes too."""
    if text is None or not ranges:
        return text
    ends = Counter()
    for start, end, *_ in ranges:
        ends[start] += 1
        ends[end] -= 1
    out, word, depth = [], 0, 0
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        kept, taken, cut = [], 0, False
        places = [m.start() for m in WORD.finditer(line)]
        for a, b in zip(places, [*places[1:], len(line)], strict=False):
            depth += ends[word]
            word += 1
            if depth:
                kept.append(line[taken:a])
                taken, cut = b, True
        kept.append(line[taken:])
        rest = b"".join(kept)
        if not cut or rest.strip():
            out.append(rest)
    return b"\n".join(out).decode("utf-8", "surrogatepass")
