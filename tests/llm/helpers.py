"""Plain Python versions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

ODD_SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, label int, score double, shard string, "
    "slot string, doc long, print long, v long, n long, off long, kept boolean, url string"
)


def odd_rows(*texts, first=0):
    """Rows with extra columns whose names operators use inside; some of their values are null."""
    extra = (None, 0.5, "x", None, 1, None, 3, None, 5, True, None)
    return [(first + i, t, None if i % 2 else "en", None if i % 3 == 1 else f"s{i % 3}", None, *extra) for i, t in enumerate(texts)]


def words(text):
    return WORD.findall(text or "")


def shingle_set(text, size):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def groups(rows, size, percent):
    """doc_id -> least doc_id reachable; ids are unique."""
    sets = {i: shingle_set(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, sets


def repeats(rows, window=100):
    """doc_id -> (bytes, removed, spans, sha256 of the rest); ids are unique."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        body = (text or "").encode()
        gone = bytearray(len(body))
        for p in range(len(body) - window + 1):
            piece = body[p : p + window]
            if piece in seen:
                gone[p : p + window] = b"\1" * window
            seen.add(piece)
        kept = bytes(c for c, g in zip(body, gone) if not g)
        spans = sum(1 for p in range(len(gone)) if gone[p] and (not p or not gone[p - 1]))
        out[i] = (len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def contained(docs, items, size=5, share=0.8):
    """(doc_id, item_id, shared) of every pair."""
    wanted = {i: s for i, t in items if (s := shingle_set(t, size))}
    out = set()
    for d, text in docs:
        have = shingle_set(text, size)
        for i, s in wanted.items():
            n = len(s & have)
            if n >= share * len(s) - 1e-9:
                out.add((d, i, n))
    return out
