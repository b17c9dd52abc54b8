"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re


def words(text):
    return (text or "").encode().split()


def repeats(rows, size, units, join):
    """Rows (id, text): what stays when units covered by a run that starts in a smaller id are removed."""
    first = {}
    for i, t in rows:
        u = units(t)
        for p in range(len(u) - size + 1):
            k = tuple(u[p : p + size])
            first[k] = min(first.get(k, float("inf")), float("inf") if i is None else i)
    out = []
    for i, t in rows:
        u, gone = units(t), set()
        for p in range(len(u) - size + 1):
            if first[tuple(u[p : p + size])] < (float("inf") if i is None else i):
                gone.update(range(p, p + size))
        spans = sum(1 for g in gone if g - 1 not in gone)
        out.append((i, len(u), len(gone), spans, hashlib.sha256(join(x for k, x in enumerate(u) if k not in gone)).hexdigest()))
    return out


def shingles(text):
    w = [x.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) for x in words(text)]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near(rows, percent):
    """Rows (id, text) of distinct ids: (id, set size, component, kept)."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                old, new = root[j], root[i]
                root = [new if r == old else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, i), i)
    return [(i, len(s), least[r], least[r] == i) for (i, _), s, r in zip(rows, sets, root, strict=True)]


def base_quality(text):
    w = words(text)
    windows = {}
    for p in range(len(w) - 7):
        windows.setdefault(tuple(w[p : p + 8]), []).append(p)
    covered = {k for at in windows.values() if len(at) > 1 for p in at for k in range(p, p + 8)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    chars = sum(len(x.decode()) for x in w)
    return (len(w), chars, len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w))
