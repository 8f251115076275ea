"""Brute-force versions, in plain Python, of what the corpus operators return."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import xxhash

WS = " \t\n\x0b\x0c\r"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def measures(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if x.strip(WS)]
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    inside = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def ascii_lower(text):
    return text.encode().lower().decode()


def line_dedup(docs, min_chars=10):
    """docs: (doc_id, text). The remaining texts, with lines and dropped lines."""
    first = {}
    key = lambda line: ascii_lower(line.strip(WS))
    for d, t in docs:
        if d is not None and t is not None:
            for line in t.split("\n"):
                k = key(line)
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(key(x)) < min_chars or first.get(key(x), d) >= d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def fingerprint(text, k=4):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    if not w:
        return 0
    n = min(k, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(len(w) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(docs, radius=4):
    fps = [fingerprint(t) for _, t in docs]
    by = defaultdict(list)
    for (d, _), f in zip(docs, fps, strict=True):
        by[f].append(d)
    root = {f: f for f in by}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    f = sorted(by)
    for i, a in enumerate(f):
        for b in f[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(b)] = find(a)
    least = {}
    for x in f:
        own = [d for d in by[x] if d is not None]
        if own:
            least[find(x)] = min([least.get(find(x), own[0]), *own])
    return [(d, format(x, "016x"), least.get(find(x))) for (d, _), x in zip(docs, fps, strict=True)]


def doc_hash(doc_id):
    return int(hashlib.md5(("null" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16)


def mix(docs, limit=3):
    """docs: (doc_id, source, text)."""
    total = Counter()
    for _, s, t in docs:
        total[s] += len(words(t))
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode("utf-8")) + [s for s in total if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    budget, full = sum(total.values()), set()
    while True:
        left, open_ = budget - sum(limit * total[s] for s in full), max(sum(weight[s] for s in order if s not in full), 1)
        more = {s for s in order if s not in full and left * weight[s] / open_ > limit * total[s]}
        if not more:
            break
        full |= more
    target = {s: float(limit * total[s]) if s in full else left * weight[s] / open_ for s in order}
    by = defaultdict(Counter)
    for d, s, t in docs:
        by[s][doc_hash(d)] += len(words(t))
    below, whole = {}, {}
    for s in order:
        whole[s] = int(target[s] // total[s]) if total[s] else 0
        rest, acc, below[s] = target[s] - whole[s] * total[s], 0, 0
        if rest > 0:
            for h, n in sorted(by[s].items()):
                if n and acc + n > rest:
                    below[s] = h + 1 if acc + n - rest < rest - acc else h
                    break
                acc += n
    return [(d, len(words(t)), total[s], target[s], len(words(t)) * (whole[s] + (doc_hash(d) < below[s]))) for d, s, t in docs]


def warc(pages):
    """pages: (page_id, html)."""
    import base64

    best = {}
    for p, h in pages:
        best[h or ""] = max(best.get(h or "", p), p)
    out = []
    for p, h in pages:
        raw = (h or "").encode()
        own = best[h or ""] == p
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if own else "revisit", None if own else best[h or ""]))
    return out


def top_k(vectors, every=100, k=10):
    """vectors: (vec_id, list or None)."""
    import math

    good = {(i, tuple(math.floor(float(x) * 1024) for x in v)) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, v in good:
        if i % every == 0:
            scores = sorted((-min(max(sum(a * b for a, b in zip(v, w, strict=True)), -(1 << 63)), (1 << 63) - 1), j) for j, w in good if j != i and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return out


def lpt(docs, shards=24):
    """docs: (doc_id, text). Loads of the shards when whole groups go one by one to the least-loaded shard."""
    size = Counter()
    for _, t in docs:
        size[t or ""] += len((t or "").encode()) + 8
    return lpt_sizes(size.values(), shards)


def lpt_sizes(sizes, shards):
    load = [0] * shards
    for n in sorted(sizes, reverse=True):
        load[load.index(min(load))] += n
    return sorted(load)


def paragraphs(text, size=51, k=5):
    """(start, end, words) of a short text and of the pieces that shingles of the least hash cut any text into, if they have `size` words."""
    import numpy as np
    from barflow.llm.passages import Cutter, runs

    w, known = ascii_lower(text or "").encode().split(), Cutter(1, 1)
    h = runs(np.array(known.words(text), np.uint64), k).tolist()
    cuts = [i for i in range(1, len(h)) if h[i] < min(h[max(0, i - size) : i]) and h[i] <= min(h[i + 1 : i + size + 1], default=1 << 64)]
    edges = [0, *cuts, len(w)]
    return [(s, e, tuple(w[s:e])) for s, e in {*zip(edges, edges[1:], strict=False), *([(0, len(w))] if len(w) <= 204 else [])} if e - s >= size]


def near_paragraphs(docs, similarity=0.8, k=5):
    """docs: (doc_id, text). The component of each document by changed paragraphs, all compared with all, and the words an earlier one has."""
    places = defaultdict(list)
    for d, t in docs:
        for s, e, w in paragraphs(t):
            places[w].append((d, s, e))
    sets = {w: {w[i : i + k] for i in range(len(w) - k + 1)} for w in places}
    index, root = defaultdict(list), {w: w for w in places}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for w in places:
        for v in {v for g in sets[w] for v in index[g]}:
            both = len(sets[w] & sets[v])
            if both >= similarity * (len(sets[w]) + len(sets[v]) - both):
                root[find(w)] = find(v)
        for g in sets[w]:
            index[g].append(w)
    groups = defaultdict(list)
    for w in places:
        groups[find(w)].append(w)
    gone, links = {d: set() for d, _ in docs}, []
    for members in groups.values():
        first = min(d for w in members for d, _, _ in places[w])
        for d, s, e in (x for w in members for x in places[w] if len(members) > 1):
            if d != first:
                gone[d].update(range(s, e))
                links.append({d: first})
    return joined({d: d for d, _ in docs}, *links), gone


def joined(*parts):
    """The least id of each component of several partitions together; each is a dict of id to representative."""
    up = {d: d for p in parts for d in p}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for p in parts:
        for d, r in p.items():
            a, b = top(d), top(r)
            up[max(a, b)] = min(a, b)
    return {d: top(d) for d in up}


def passages(docs, size=51):
    """docs: (doc_id, text). The component of each document by shared runs of `size` words, and the words that an earlier one has."""
    at, gone, links = defaultdict(list), {d: set() for d, _ in docs}, []
    for d, t in docs:
        w = ascii_lower(t or "").encode().split()
        for i in range(len(w) - size + 1):
            at[tuple(w[i : i + size])].append((d, i))
    for places in at.values():
        first = min(places)[0]
        for d, i in places:
            if d != first:
                gone[d].update(range(i, i + size))
                links.append({d: first})
    return joined({d: d for d, _ in docs}, *links), gone


def looped(d, w):
    """The words of a document as op11 changes them."""
    if d is None:
        return w
    h, n = zlib.crc32(str(d).encode()), len(w)
    g = h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def runs(w, least=24, times=3):
    """Every stretch, for every period, that no neighbour extends; those of a smaller period are left out."""
    ids = np.unique(np.array(w, object), return_inverse=True)[1] if w else np.array([], int)
    found = []
    for p in range(1, len(w) // times + 1):
        same = np.concatenate(([0], (ids[:-p] == ids[p:]).astype(int), [0]))
        step = np.diff(same)
        for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
            length = int(b - a + p)
            if length >= max(least, times * p) and not any(p % q == 0 and s <= a and s + n >= a + length for s, n, q in found):
                found.append((int(a), length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic(d, text):
    w = looped(d, words(text))
    found = runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
    return (d, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest, sha(collapsed(w, found)))


def near_words(a, b):
    """Whether one edit divides two words."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(docs):
    """docs: (doc_id, text). What op12 returns; only words with a common deletion or equal to one are compared in full."""
    total = Counter()
    for d, t in docs:
        for x in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            x = ascii_lower(x)
            h = zlib.crc32(f"{d}:{x}".encode())
            if d is not None and h % 97 == 0:
                x = x[: h % len(x)] + x[h % len(x) + 1 :]
            total[x] += 1
    n = {x: c for x, c in total.items() if len(x) >= 5 and c >= 3}
    meet = defaultdict(set)
    for x in n:
        for y in {x, *(x[:i] + x[i + 1 :] for i in range(len(x)))}:
            meet[y].add(x)
    near = defaultdict(set)
    for xs in meet.values():
        for a in xs:
            near[a] |= {b for b in xs if a != b and near_words(a, b)}
    form = {}
    for x in n:
        best = min(near[x], key=lambda y: (-n[y], y), default=None)
        if best is not None and n[best] >= 2 * n[x]:
            form[x] = best

    def root(x):
        while x in form:
            x = form[x]
        return x

    return [(x, form.get(x), root(x), c, len(near[x]), n.get(form.get(x))) for x, c in n.items()]


def shingle_sets(docs):
    for d, t in docs:
        w = ascii_lower(t or "").encode().split()
        yield d, frozenset([(*w,)] if len(w) == 1 else zip(w, w[1:], strict=False))


def minhash(docs):
    """What op13 returns, by comparing all pairs."""
    rows = list(shingle_sets(docs))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(a), least.get(find(i)) if a else d, (least.get(find(i)) if a else d) == d) for i, (d, a) in enumerate(rows)]
