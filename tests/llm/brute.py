"""Brute-force versions of the operators, from their definitions."""

import hashlib
import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")


def word_windows(rows, length=35):
    """{(doc_id, text): (n_words, n_removed, sha)} by counting every window."""
    split = [(d, t, WORD.findall(t or "")) for d, t in rows]
    seen = Counter(tuple(w[i:i + length]) for _, _, w in split for i in range(len(w) - length + 1))
    out = []
    for d, _, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i:i + length])] > 1:
                gone[i:i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
    return out


def byte_strings(rows, length=200):
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(hash(b[i:i + length]) for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[hash(b[i:i + length])] > 1:
                gone[i:i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def line_chunks(rows, divisor):
    """[(doc_id, kept text)] of rows in the operator's order: a chunk stays at its first place only."""
    from slotwise.llm import line_dedup
    docs = sorted({(d, t) for d, t in rows if t is not None}, key=lambda r: r[0])
    chunks = [(d, t, [tuple(t.split("\n")[lo:hi]) for lo, hi in line_dedup.line_chunks(t, divisor)]) for d, t in docs]
    seen, out = set(), {}
    for d, t, cs in chunks:
        kept = []
        for c in cs:
            if len(c) >= line_dedup.MIN_LINES:
                if c in seen:
                    continue
                seen.add(c)
            kept += c
        out[(d, t)] = "\n".join(kept)
    return [(d, out.get((d, t))) for d, t in rows]


def weighted_jaccard_classes(rows, similarity=0.8):
    """{doc_id: smallest doc_id of its class} from all pairs of texts."""
    import math
    docs = [(d, WORD.findall(t or "")) for d, t in rows if d is not None]
    texts = [WORD.findall(t) for _, t in rows if t is not None]
    df = Counter(w for t in texts for w in set(t))
    idf = lambda w: 1 + math.log1p(math.log((len(texts) + 2) / (df[w] + 1)))
    bags = []
    for d, w in docs:
        c = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        bags.append((d, " ".join(w), {s: n * sum(map(idf, s)) / 5 for s, n in c.items()}))
    root = {d: d for d, _, _ in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, (a, ta, x) in enumerate(bags):
        for b, tb, y in bags[:i]:
            shared = sum(min(v, y[k]) for k, v in x.items() if k in y)
            both = sum(x.values()) + sum(y.values()) - shared
            if ta == tb or both and shared / both >= similarity:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {d: find(d) for d, _, _ in bags}


def filter_audit(rows, labels):
    """Result rows from the definition: every order is applied, filter by filter, to the documents themselves.

    rows: (doc_id, text, source); labels: (doc_id, quality, toxic).
    """
    from itertools import permutations
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    fails = []
    for d, t, source in rows:
        t = t or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)),
             "E": d is not None and least[t] < d}
        known = [x for x in labels if d is not None and x[0] == d]
        fails.append((source or "", {k for k, v in f.items() if v}, any(x[1] == 1 for x in known), any(x[2] == 1 for x in known)))
    out, shapley = [], Counter()
    for part in {p for p, *_ in fails}:
        docs = [x[1:] for x in fails if x[0] == part]
        for order in permutations("ABCDE"):
            left = docs
            for step, name in enumerate(order, 1):
                gone, left = [x for x in left if name in x[0]], [x for x in left if name not in x[0]]
                failing = sum(name in x[0] for x in docs)
                out.append((part, "".join(order), step, name, len(left), len(gone), failing - len(gone), sum(x[0] == {name} for x in docs), sum(x[1] for x in gone), sum(x[2] for x in gone)))
                shapley[part, name] += len(gone)
    return sorted((*r, shapley[r[0], r[3]]) for r in out)


def simhash(rows, distance=2):
    """[(doc_id, fingerprint, component_id)] by all pairs of distinct fingerprints."""
    import xxhash
    found = []
    for d, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
        found.append((d, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    fps = sorted({f for _, f in found})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= distance:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    least = {}
    for d, f in found:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [(d, f"{f:016x}", least.get(find(f))) for d, f in found]


def importance_draw(rows, target):
    """[(doc_id, n_features, weight, score, rank)] by sorting all rows at once."""
    import math
    import zlib
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    split = [(d, list(map(bucket, word.findall(lower(t))))) for d, t in rows]
    s, t = Counter(b for _, bs in split for b in bs), Counter(bucket(w) for x in target for w in word.findall(lower(x)))
    S, T = float(s.total()), float(t.total())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000) / ((s[b] + 1.0) * (T + 10000))))
    scored = []
    for d, bs in split:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, bs))
        scored.append((d, len(bs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in scored if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = [(*r, i) for i, r in enumerate(able[:10 * len(able) // 100], 1)]
    return drawn + [(*r, None) for r in able[len(drawn):]] + [(*r, None) for r in scored if r[1] < 20]
