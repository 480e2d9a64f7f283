"""Plain single-machine versions of what the operators promise."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def fingerprint(t):
    w = words((t or "").translate(UP))
    g = [" ".join(w)] if len(w) < 3 else [" ".join(w[i:i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g if w]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, radius=3):
    """Index of the class of each fingerprint."""
    v = np.array(prints, np.uint64)
    up = list(range(len(v)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= radius):
            a, b = root(i), root(int(j))
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(v))]


def without_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def contamination(texts, items, window=13):
    """items: (id, text) pairs."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))
    win = defaultdict(set)
    for i, t in items:
        w = cut(t)
        m = min(window, len(w))
        for j in range(len(w) - m + 1 if w else 0):
            win[tuple(w[j:j + m])].add("" if i is None else str(i))
    out = []
    for t in texts:
        w, hit, ids = cut(t), set(), set()
        for m in {len(x) for x in win}:
            for j in range(len(w) - m + 1):
                if found := win.get(tuple(w[j:j + m])):
                    hit.update(range(j, j + m))
                    ids |= found
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def secrets(t):
    t = t or ""
    either = lambda s: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s)
    names = "|".join(map(either, ("password", "passwd", "secret", "token"))) + "|" + either("api") + "_?" + either("key")
    a = [(m.start(), m.end(), 0) for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    b = [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    c = [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, e, k in sorted(a + b + c, key=lambda x: (x[0], x[2])))
    return len(a), len(b), len(c), hashlib.sha256(joined.encode()).hexdigest()


def targets(sizes, weights=(5.0, 2.0, 1.0), cap=3.0):
    """{source: target}: resharing the excess by weight until none is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, done = sum(sizes.values()), {}
    while len(done) < len(order):
        free = [s for s in order if s not in done]
        level = (total - sum(done.values())) / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > cap * sizes[s]]
        if not over:
            return done | {s: level * w[s] for s in free}
        done |= {s: cap * sizes[s] for s in over}
    return done


def taken(rows, weights=(5.0, 2.0, 1.0), cap=3.0, seed=4201):
    """rows: (id, source, size, weight, text) -> words taken of each."""
    sizes = Counter()
    for _, s, n, _, _ in rows:
        sizes[s] += n
    goal, out = targets(sizes, weights, cap), {}
    for source in sizes:
        mine, seen = [], Counter()
        for i, (key, s, n, q, text) in enumerate(rows):
            if s == source:
                mark = hashlib.md5((text or "").encode()).hexdigest()
                drawn = f"{seed}|{'' if key is None else key}|{mark}|{seen[key, mark]}"
                seen[key, mark] += 1
                u = (int(hashlib.md5(drawn.encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
                mine.append((-math.log(u) / q, "" if key is None else str(key), n, i))
        epochs = math.floor(goal[source] / sizes[source]) if sizes[source] else 0
        left, before = goal[source] - epochs * sizes[source], 0
        for _, _, n, i in sorted(mine):
            out[i] = min(epochs + (before + n / 2 <= left), cap) * n
            before += n
    return [int(out[i]) for i in range(len(rows))]


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _chain(values, widths):
    h = 42
    for v, n in zip(values, widths):
        h = xxhash.xxh64_intdigest((v % (1 << 8 * n)).to_bytes(n, "little"), h)
    return h


def order_signature(t, k=3, slots=32, pick=2, bits=26):
    """The values of the slots, None where empty, from the definition alone."""
    w = [xxhash.xxh64_intdigest(x.encode(), 42) for x in words(t)]
    grams = [_signed(_chain(w[i:i + k], [8] * k)) >> bits for i in range(max(1, len(w) - k + 1))] if w else []
    seen, pairs = Counter(), defaultdict(list)
    for i, g in enumerate(grams):
        h = _chain([g, seen[g]], [8, 4])
        seen[g] += 1
        pairs[h >> (64 - (slots.bit_length() - 1))].append((_signed(h) >> bits, i, g))
    return [_signed(_chain([g for _, _, g in sorted(sorted(pairs[s])[:pick], key=lambda x: x[1])],
                           [8] * len(pairs[s][:pick]))) if pairs[s] else None for s in range(slots)]
