"""Best-fit packing of documents into training sequences, with a bounded number of open ones."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, kept_whole, small_batches
from .tokens import default_tokenizer, shared_ids
from .words import ROWS

LENGTH, END, OPEN = 4096, 1, 64
#: Pieces packed by one task; the open sequences left at its end are all that more tasks cost.
PIECES_PER_TASK = 200_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces_of(ids: np.ndarray, length: int = LENGTH, end: int = END):
    """(piece, start, length, crc32) of a document's ids and the end id, cut only where longer than ``length``."""
    n = len(ids) + 1
    for k, i in enumerate(range(0, n, length)):
        crc = zlib.crc32(ids[i : i + length])
        if i + length >= n:
            crc = zlib.crc32(end.to_bytes(4, "little"), crc)
        yield k, i, min(length, n - i), crc


def _cut(path: str, length: int):
    def run(batches):
        known = shared_ids(path)
        for b in small_batches(batches, ROWS):
            ids, bounds = known.encode(b.column(1))
            ids, bounds = ids.astype("<u4", copy=False), bounds.tolist()
            rows = [(d, *p) for d, i, j in zip(b.column(0).to_pylist(), bounds[:-1], bounds[1:]) for p in pieces_of(ids[i:j], length)]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class OpenBins:
    """Online best fit: the fullest open sequence with room takes a piece.

    Bit f of ``free`` says that some open sequence has f places left, so the best fit for n is the lowest bit
    from n on. If none fits and ``most`` are open, the fullest closes.
    """

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.free, self.by_free, self.open, self.next = 0, {}, 0, 0

    def _take(self, f: int) -> int:
        stack = self.by_free[f]
        s = stack.pop()
        if not stack:
            self.free &= ~(1 << f)
        self.open -= 1
        return s

    def put(self, n: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of n tokens."""
        fits = self.free >> n
        if fits:
            f = n + (fits & -fits).bit_length() - 1
            s = self._take(f)
        else:
            if n < self.length and self.open == self.most:  # a piece that fills its sequence never keeps one open
                self._take((self.free & -self.free).bit_length() - 1)
            f, s = self.length, self.next
            self.next += 1
        left = f - n
        if left:
            self.by_free.setdefault(left, []).append(s)
            self.free |= 1 << left
            self.open += 1
        return s, self.length - f


def _pack(length: int, most: int):
    def run(batches):
        bins, base = OpenBins(length, most), TaskContext.get().partitionId() << 40
        for b in batches:
            placed = [bins.put(n) for n in b.column("length").to_pylist()]
            if placed:
                s, o = zip(*placed)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([base + x for x in s], pa.int64()), pa.array(o, pa.int64())], [*b.schema.names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, most_open: int = OPEN) -> DataFrame:
    """Pieces of every document and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    docs: doc_id bigint, text string (null and empty: only the end id; a null doc_id stays null). Texts are
    encoded whole, in the place where they are read; what is shuffled is one short row a piece. Each task packs its share, taken in an
    order fixed by a hash of the ids, so a task run again gives the same sequences. Repeated rows are packed
    each. Other columns are not read. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    rows = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_cut(tokenizer or default_tokenizer(), length), PIECES)
    rows = scratch.write(rows, "pieces")
    tasks = max(1, -(-rows.count() // PIECES_PER_TASK))
    mixed = rows.repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32"))
    mixed = mixed.sortWithinPartitions(F.xxhash64("doc_id", "piece", F.lit(3)), "doc_id", "piece", "length", "ids_crc32")
    out = kept_whole(mixed.mapInArrow(_pack(length, most_open), PIECES + ", sequence_id bigint, offset bigint"))
    scratch.drop()
    return out
