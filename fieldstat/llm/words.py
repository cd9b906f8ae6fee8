"""Words of Arrow text batches, and tables that keep something for each distinct word of a Python worker."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import mix64

#: Texts looked at together: the more, the fewer of their words are distinct.
ROWS = 2048


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of ``size`` each, one range after the other."""
    ends = np.cumsum(size)
    out = np.repeat(start - (ends - size), size)
    out += np.arange(len(out))
    return out


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word in them, bounds): text i has words[bounds[i]:bounds[i + 1]], null none.

    Words stand between ASCII white space; A-Z are lower-cased if ``lower``. Among them may be the empty one.
    """
    # copied, so that its bytes begin at 0: lower-casing takes that for granted in an array that was cast from a slice
    texts = pa.concat_arrays([texts, texts.slice(0, 0)]).cast(pa.large_string())
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    each = words.values.dictionary_encode()
    return each.dictionary, each.indices.to_numpy(), words.offsets.to_numpy()


def keys(words: pa.Array) -> np.ndarray:
    """A 128-bit name of each word: its bytes and their number up to 15 bytes, a 120-bit hash of longer ones."""
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    if not len(words):
        return np.empty((0, 2), np.uint64)
    ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    first, last = int(ends[0]), int(ends[-1])
    at, size = ends[:-1] - first, np.diff(ends)
    eight = np.zeros(last - first + 16, np.uint64)
    if data is not None:
        eight[: last - first] = np.frombuffer(data, np.uint8)[first:last]
    for k in (1, 2, 4):  # 2, 4, then 8 bytes from each on
        eight[:-k] |= eight[k:] << np.uint64(8 * k)
    out = np.empty((len(words), 2), np.uint64)
    for lane in (0, 1):
        spare = (64 - 8 * np.clip(size - 8 * lane, 1, 8)).astype(np.uint64)
        out[:, lane] = np.where(size > 8 * lane, eight[at + np.minimum(8 * lane, size)] << spare >> spare, np.uint64(0))
    out[:, 1] |= size.astype(np.uint64) << np.uint64(56)
    long = np.nonzero(size > 15)[0]
    if len(long):
        raw = b"".join(map(xxhash.xxh3_128_digest, words.take(pa.array(long)).to_pylist()))
        out[long] = np.frombuffer(raw, np.uint64).reshape(-1, 2)
        out[long, 1] |= np.uint64(0xFF << 56)
    return out


def folded(key: np.ndarray) -> np.ndarray:
    """64 bits of a 128-bit name."""
    return mix64(key[:, 0] ^ mix64(key[:, 1]))


class KeyTable:
    """Open-addressed table of 128-bit names; subclasses keep arrays of one row a name, listed in ``arrays``.

    At ``limit`` names the half that is used most stays, which bounds memory and changes no result.
    """

    arrays = ("key", "uses")

    def __init__(self, limit: int):
        self.limit = limit
        self._new(1024)

    def _new(self, room: int) -> None:
        self.n, self.key, self.uses = 0, np.zeros((room, 2), np.uint64), np.zeros(room, np.float32)
        self.slots = np.full(4 * room, -1, np.int32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Row of each name, -1 for those that are not held."""
        row = np.full(len(key), -1, np.int64)
        todo, mask = np.arange(len(key)), np.uint64(len(self.slots) - 1)
        at = folded(key) & mask
        while len(todo):
            r = self.slots[at]
            held = r >= 0
            todo, at, r = todo[held], at[held], r[held]
            same = (self.key[r] == key[todo]).all(1)
            row[todo[same]] = r[same]
            todo, at = todo[~same], (at[~same] + np.uint64(1)) & mask
        return row

    def _place(self, rows: np.ndarray) -> None:
        mask = np.uint64(len(self.slots) - 1)
        at = folded(self.key[rows]) & mask
        while len(rows):
            free = self.slots[at] < 0
            self.slots[at[free]] = rows[free]  # of several rows that want a slot one gets it
            lost = self.slots[at] != rows
            rows, at = rows[lost], (at[lost] + np.uint64(1)) & mask

    def new_rows(self, key: np.ndarray) -> np.ndarray:
        """Rows for new, distinct names."""
        n, k = self.n + len(key), len(self.key)
        if n > k:
            k = max(n, 2 * k)
            for name in self.arrays:
                old = getattr(self, name)
                new = np.zeros((k, *old.shape[1:]), old.dtype)
                new[: self.n] = old[: self.n]
                setattr(self, name, new)
        rows = np.arange(self.n, n)
        self.key[rows], self.n = key, n
        if 2 * n > len(self.slots):
            self.slots = np.full(1 << (4 * n - 1).bit_length(), -1, np.int32)
            self._place(np.arange(n))
        else:
            self._place(rows)
        return rows

    def used_most(self, more: int) -> np.ndarray | None:
        """The rows to keep if ``more`` names would not fit; None if they do."""
        if self.n + more <= self.limit or not self.n:
            return None
        return np.argsort(-self.uses[: self.n], kind="stable")[: max(0, min(self.n // 2, self.limit - more))]

    def make_room(self, more: int) -> bool:
        """Drop the less used half if ``more`` names would not fit; rows change."""
        rows = self.used_most(more)
        if rows is None:
            return False
        kept = {name: getattr(self, name)[rows] for name in self.arrays}
        self._new(1024)
        rows = self.new_rows(kept["key"])
        for name, values in kept.items():
            getattr(self, name)[rows] = values
        self.uses[rows] /= 2
        return True
