"""Token ids of texts by way of their distinct chunks, so that a repeated word is tokenised once for each worker.

A chunk is a run of separators and the run of other bytes behind it, cut once more between two bytes of ``cuts``. The caller promises that the ids of a text are
the ids of its chunks in a row. Chunks are told apart by a 64-bit hash of their bytes and their length.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np
import pandas as pd

#: Distinct chunks that a worker remembers, and ids for each of them; beyond either it forgets all and starts anew.
MOST_CHUNKS, IDS_EACH = 1_000_000, 7
_BASE, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def run_hashes(raw: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of bytes raw[at[k]:at[k] + lengths[k]]; they cover raw without gaps."""
    longest = int(lengths.max())
    powers = np.cumprod(np.full(longest, _BASE, np.uint64), dtype=np.uint64)
    inside = np.arange(len(raw), dtype=np.int32) - np.repeat(at.astype(np.int32), lengths)
    made = np.add.reduceat(_BYTES[raw] * powers[inside], at)
    return (made ^ made >> np.uint64(29)) + lengths.astype(np.uint64) * _SALT


class ChunkCache:
    """``learn(chunks)`` gives, for a list of chunks (bytes), their ids in a row, the byte size of each id, and the
    number of ids of each chunk."""

    def __init__(self, separators: bytes, learn: Callable, cuts: tuple[bytes, bytes] = (b"", b""),
                 most: int = MOST_CHUNKS):
        self.most = most
        self.separator = np.zeros(256, bool)
        self.separator[list(separators)] = True
        self.left, self.right = np.zeros(256, bool), np.zeros(256, bool)
        self.left[list(cuts[0])] = self.right[list(cuts[1])] = True
        self.learn = learn
        self._clear()

    def _clear(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)    # sorted hashes and their entries
        self.ids, self.sizes = array("I"), array("I")
        self.first, self.count = array("q"), array("q")

    def encode_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.encode(b"".join(texts), np.cumsum([0] + [len(t) for t in texts]))

    def encode(self, data: bytes, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, the byte size of each id, and the borders between texts.

        ``data`` holds the texts in a row, text k from text_at[k] to text_at[k + 1].
        """
        if not data:
            return np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(len(text_at), np.int64)
        if len(self.keys) > self.most or len(self.ids) > self.most * IDS_EACH:
            self._clear()
        raw = np.frombuffer(data, np.uint8)
        gap = self.separator[raw]
        begins = gap.copy()
        begins[1:] &= ~gap[:-1]
        begins[1:] |= self.left[raw[:-1]] & self.right[raw[1:]]
        begins[text_at[:-1][np.diff(text_at) > 0]] = True
        at = np.flatnonzero(begins)
        ends = np.append(at[1:], len(raw))
        codes, distinct = pd.factorize(run_hashes(raw, at, ends - at))
        near = np.searchsorted(self.keys, distinct)
        known = near < len(self.keys)
        known[known] = self.keys[near[known]] == distinct[known]
        entry = np.empty(len(distinct), np.int64)
        entry[known] = self.place[near[known]]
        new = np.flatnonzero(~known)
        if len(new):
            seen = np.empty(len(distinct), np.int64)
            seen[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            ids, sizes, counts = self.learn([data[a:b] for a, b in zip(at[seen[new]].tolist(),
                                                                      ends[seen[new]].tolist())])
            firsts = len(self.ids) + np.cumsum(counts) - counts
            entry[new] = len(self.first) + np.arange(len(new))
            for held, values in ((self.ids, ids), (self.sizes, sizes)):
                held.frombytes(np.ascontiguousarray(values, np.uint32).tobytes())
            for held, values in ((self.first, firsts), (self.count, counts)):
                held.frombytes(np.ascontiguousarray(values, np.int64).tobytes())
            new = new[np.argsort(distinct[new])]
            self.place = np.insert(self.place, near[new], entry[new])
            self.keys = np.insert(self.keys, near[new], distinct[new])
        where = entry[codes]
        first, count = np.frombuffer(self.first, np.int64)[where], np.frombuffer(self.count, np.int64)[where]
        upto = np.cumsum(count)
        take = np.repeat(first - upto + count, count) + np.arange(upto[-1])
        borders = np.concatenate([[0], upto])[np.searchsorted(at, text_at)]
        return np.frombuffer(self.ids, np.uint32)[take], np.frombuffer(self.sizes, np.uint32)[take], borders
