"""Plain versions of the operators' results, for small tables."""

import hashlib
from collections import Counter


def windows_removed(units, size, everything):
    """Flags of the units covered by a window that occurs more than once in everything."""
    gone = [False] * len(units)
    for i in range(len(units) - size + 1):
        if everything[tuple(units[i:i + size])] > 1:
            gone[i:i + size] = [True] * size
    return gone


def substring(texts, size):
    units = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(u[i:i + size]) for u in units for i in range(len(u) - size + 1))
    out = []
    for u in units:
        gone = windows_removed(u, size, seen)
        kept = b" ".join(w for w, g in zip(u, gone, strict=True) if not g)
        out.append((len(u), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def byte_spans(texts, size):
    units = [(t or "").encode() for t in texts]
    seen = Counter(u[i:i + size] for u in units for i in range(len(u) - size + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - size + 1):
            if seen[u[i:i + size]] > 1:
                gone[i:i + size] = [True] * size
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(u), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(u, gone, strict=True) if not g)).hexdigest()))
    return out


def near_groups(rows, size, percent):
    """(n_shingles, component_id, kept) of (doc_id, text) rows, all pairs compared."""
    sets = []
    for _, text in rows:
        words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        sets.append({tuple(words[i:i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_size = sorted(range(len(rows)), key=lambda i: len(sets[i]))
    for n, i in enumerate(by_size):
        for j in by_size[n + 1:]:
            if not sets[i] or 100 * len(sets[i]) < percent * len(sets[j]):
                if sets[i]:
                    break
                continue
            shared = len(sets[i] & sets[j])
            if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((root(i), root(j)), key=lambda k: rows[k][0])
                parent[b] = a
    ids = {}
    for i in range(len(rows)):
        ids[root(i)] = min(ids.get(root(i), rows[i][0]), rows[i][0])
    return [(len(sets[i]), ids[root(i)], rows[i][0] == ids[root(i)]) for i in range(len(rows))]
