"""Token-id output with best-fit-decreasing packing (operator 7).

Every partition packs its own documents, so nothing is shuffled.  Documents
over ``length`` tokens are split without loss; their full parts are sequences,
their remainders join the other documents.  These go, longest first, to the
open sequence with the least room that still fits them, found by a segment
tree over capacities.  A partition is packed in windows of ``window`` tokens; sequences that a window
leaves with more than SLACK of their room, the emptiest first and up to a quarter of a window, are opened again in the next.

Written are Parquet rows of one sequence each: the padded ids, the cumulative
segment lengths, the places where positions restart, and the segments' origins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import only, prepare
from ._tokens import vocabulary, word_bpe
from ._words import BLANK, words

LENGTH, END, PAD, WINDOW = 2048, 1, 0, 4_000_000
SLACK = 0.002  #: share of a sequence that may stay empty
_PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64())])
_SQL = "sequence_id long, ids binary, cu_seqlens array<int>, position_resets array<int>, pieces array<struct<doc_id: bigint, start: bigint, length: bigint, doc_tokens: bigint>>"


class CapacityTree:
    """Bins by remaining capacity 0..length: a segment tree of how many bins each range of capacities holds."""

    def __init__(self, length: int) -> None:
        self.leaves = 1 << (length + 1 - 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def _change(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def add(self, capacity: int, bin_: int) -> None:
        self.bins[capacity].append(bin_)
        self._change(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (capacity, bin) of the smallest capacity >= least; of equal ones the last added."""
        at, count = least + self.leaves, self.count
        if least >= len(self.bins):
            return None
        while not count[at]:  # up to the first right neighbour that holds a bin
            while at & 1:
                at >>= 1
                if not at:
                    return None
            at += 1
        while at < self.leaves:
            at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        self._change(capacity, -1)
        return capacity, self.bins[capacity].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Bins of at most ``length``, as lists of places in sizes; on ties the first place goes first."""
    tree, bins = CapacityTree(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        if found is None:
            found = (length, len(bins))
            bins.append([])
        bins[found[1]].append(i)
        tree.add(found[0] - sizes[i], found[1])
    return bins


def _pack(path: str, length: int, end: int, pad: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[int | None, np.ndarray]] = []
        opened: list[tuple[int | None, int, int, np.ndarray, int]] = []  # document, start, length, ids, all ids
        tokens = 0

        def packed(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number
            parts = opened + [(d, s, min(length, len(ids) - s), ids[s : s + length], len(ids)) for d, ids in held for s in range(0, len(ids), length)]
            opened.clear()
            bins = best_fit_decreasing([p[2] for p in parts], length)
            if not last:
                used = [sum(parts[i][2] for i in b) for b in bins]
                left, again = window // 4, set()
                for j in sorted(range(len(bins)), key=lambda j: (used[j], j)):
                    if length - used[j] <= SLACK * length or used[j] > left:
                        break
                    left -= used[j]
                    again.add(j)
                opened.extend(parts[i][:3] + (parts[i][3].copy(), parts[i][4]) for j in sorted(again) for i in bins[j])
                bins = [b for j, b in enumerate(bins) if j not in again]
            for at in range(0, len(bins), 500):
                rows = bins[at : at + 500]
                ids, cu, resets, made = [], [], [], []
                for members in rows:
                    row, ends = np.full(length, pad, dtype="<u4"), [0]
                    for i in members:
                        _, _, n, x, _ = parts[i]
                        row[ends[-1] : ends[-1] + n] = x
                        ends.append(ends[-1] + n)
                    ids.append(row.tobytes())
                    cu.append(ends)
                    resets.append(ends[:-1])
                    made.append([{"doc_id": parts[i][0], "start": parts[i][1], "length": parts[i][2], "doc_tokens": parts[i][4]} for i in members])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(number, number + len(rows)), pa.int64()), pa.array(ids, pa.binary()), pa.array(cu, pa.list_(pa.int32())), pa.array(resets, pa.list_(pa.int32())), pa.array(made, pa.list_(_PIECE))],
                    names=["sequence_id", "ids", "cu_seqlens", "position_resets", "pieces"],
                )
                number += len(rows)

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for w in words(batch.column("text"), BLANK):
                ids, off = bpe.documents(w, end)
                held += [(names[w.row + i], ids[off[i] : off[i + 1]]) for i in range(len(w))]
                tokens += len(ids)
                if tokens >= window:
                    yield from packed(False)
                    held.clear()
                    tokens = sum(p[2] for p in opened)
        yield from packed(True)

    return run


def pack_best_fit(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END, pad: int = PAD, window: int = WINDOW) -> DataFrame:
    """One row per sequence: sequence_id, ids (``length`` little-endian unsigned 32-bit ids), cu_seqlens, position_resets, pieces.

    docs: doc_id (a whole number), text; more columns are ignored.  tokenizer: path of a
    ``tokenizers`` file whose ids never span white space (word_bpe_49k.json if left out).  A document is its ids and
    then ``end``; a null, empty or blank text is ``end`` alone.  cu_seqlens runs from
    0 to the used length; what follows is ``pad``.  Each id of each document
    lies in exactly one piece.  Rows that repeat a doc_id, or have none, are documents of
    their own.  An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    path = tokenizer or vocabulary("word_bpe_49k.json")
    docs = only(docs, ("doc_id", "bigint"), ("text", "string"))
    return docs.mapInArrow(_pack(path, length, end, pad, window), _SQL)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for whole in batches:
        for first in range(0, whole.num_rows, 500):
            batch, rows = whole.slice(first, 500), []
            for i, (seq, cu, pieces) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("sequence_id", "cu_seqlens", "pieces")), strict=True)):
                raw = memoryview(batch.column("ids")[i].as_buffer())
                for at, p in zip(cu, pieces, strict=False):
                    rows.append((p["doc_id"], p["start"], p["length"], zlib.crc32(raw[4 * at : 4 * (at + p["length"])]), p["doc_tokens"], seq, at))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def segments(packed: DataFrame) -> DataFrame:
    """A row per piece of packed sequences, with the checksum of its ids as they are stored."""
    prepare(packed.sparkSession)
    return packed.select("sequence_id", "ids", "cu_seqlens", F.col("pieces")).mapInArrow(_segments, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
