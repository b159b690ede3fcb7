"""Brute-force versions that the operators are held against."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np


def edge_rows(n=40, seed=1):
    """(doc_id, text, lang, source, n_chars): nulls, empty and long texts, ties, copies and near copies."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    rows = [(i, prose(rng.randint(60, 200)), rng.choice(["en", "fr"]), f"s{i % 3}", 5) for i in range(n)]
    near = prose(100).split()
    for i in range(6):
        copy = list(near)
        copy[10 * i] = "changed"
        rows.append((100 + i, " ".join(copy), "en", "s0", 1))
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, " \n\t ", None, "s1", 4),
             (203, "one two", "en", None, 7), (204, "One TWO\nthree four five", "en", "s0", 9),
             (205, "token = \"" + "0123456789abcdef" * 2 + "\" tail", "en", "s0", 9), (None, prose(80), "fr", "s2", 3),
             (206, "z" * 30_000, "en", "s0", 30_000), (207, "word " * 20_000, "fr", "s2", 100_000)]
    rows += [rows[3], rows[3], (300, rows[4][1], "en", "s9", 2)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1)))


def components(rows):
    """row number -> (set size, least id of the component) with links at 75 %."""
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [(len(s), least.get(root(i))) for i, s in enumerate(sets)]


def without_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, int)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0 if len(r) else np.zeros(0, bool)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        left = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
