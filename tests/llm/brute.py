"""Plain-Python versions of the corpus operators' contracts."""

import hashlib
import re
from collections import defaultdict

import xxhash

SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def substring(rows):
    """rows of (doc_id, text) -> (doc_id, n_words, n_removed, kept text)."""
    words = [(i, SPACED.findall(t or "")) for i, t in rows]
    rank = lambda i: (i is None, i or 0)
    first = {}
    for i, w in words:
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            first[k] = min(first.get(k, (rank(i), s)), (rank(i), s))
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (rank(i), s):
                gone.update(range(s, s + 20))
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((i, len(w), len(w) - len(kept), " ".join(kept)))
    return out


def fingerprint(text):
    w = SPACED.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def contamination(rows, items):
    """rows, items of (id, text) -> (id, n_words, n_hit, n_items, digest, contaminated)."""
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        k = min(13, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[s : s + k])].add(str(i))
    sizes = {len(k) for k in windows}
    out = []
    for i, t in rows:
        w, hit, names = ALNUM.findall((t or "").translate(LOWER)), set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                found = windows.get(tuple(w[s : s + k]))
                if found:
                    hit.update(range(s, s + k))
                    names |= found
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def segmentations(v, s):
    """All segmentations of s as (score, ids), best first."""
    out = []

    def go(i, ids, score):
        if i == len(s):
            out.append((score, ids))
            return
        alone = False
        for j in range(i + 1, len(s) + 1):
            hit = v.pieces.get(s[i:j])
            if hit:
                go(j, ids + (hit[0],), score + hit[1])
                alone |= j == i + 1
        if not alone:
            go(i + 1, ids + v.spelled(s[i]), score + v.fallback)

    go(0, (), 0.0)
    return sorted(out, key=lambda x: (-x[0], x[1]))
