"""Packing along a space-filling curve (operator 4).

Each document's tokens are hashed to vectors of DIMS random signs, whose scaled
mean is a grid cell; the cell's place on the Hilbert curve is the document's key.  Documents are range-sorted by key, and the curve's token stream is cut every
``length`` tokens: neighbours on the curve share sequences, every sequence but
the very last is full, and no document waits for another to fit.

A document's place in the stream is a prefix sum over the sorted, narrow table (key, tokens);
only one number for each partition passes the driver.  Ids travel once, when joined to their place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import drop, only, prepare, save
from ._tokens import vocabulary, word_bpe
from ._words import BLANK, mix, words

LENGTH, END, DIMS, BITS = 2048, 1, 4, 10


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of cells (uint64[n, dims], each below 2**bits), by Skilling's transposition."""
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        p = q - one
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        t ^= np.where((x[dims - 1] & q) != 0, q - one, np.uint64(0))
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


def curve_cells(ids: np.ndarray, off: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Grid cells of documents (ids of each from off[i] on): the mean of their tokens' vectors, scaled by the root of their number."""
    total = np.add.reduceat(signs[ids], off[:-1], axis=0)
    v = total / np.sqrt(np.diff(off))[:, None]
    return np.clip((np.tanh(v / 3) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint64)


def token_signs(n: int, dims: int = DIMS) -> np.ndarray:
    """A hashed vector of random signs for each token id; early merges, which are in all texts, weigh less."""
    h = mix(np.arange(1, n * dims + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    weight = np.minimum(1.0, np.arange(n) / (n / 8))
    return (np.where(h >> np.uint64(63), 1.0, -1.0).reshape(n, dims) * weight[:, None]).astype(np.float32)


def _tokenize(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        signs = token_signs(bpe.size)
        for batch in batches:
            for w in words(batch.column("text"), BLANK):
                ids, off = bpe.documents(w, end)
                cells = curve_cells(ids, off, signs)
                raw = pa.Array.from_buffers(pa.large_binary(), len(w), [None, pa.py_buffer(off * bpe.kind.itemsize), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(w.row, len(w)), pa.array(hilbert_key(cells).astype(np.int64)), pa.array(np.diff(off)), raw.cast(pa.binary())], names=["doc_id", "curve", "doc_tokens", "ids"])

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running token count within a partition, in its order."""
    at = 0
    for batch in batches:
        n = np.asarray(batch.column("doc_tokens"))
        total = np.cumsum(n)
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("part"), pa.array(at + total - n), batch.column("doc_tokens")], names=["uid", "part", "place", "doc_tokens"])
        at += int(total[-1]) if len(total) else 0


def _cut(length: int, width: int, with_ids: bool):
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {c: [] for c in ("row", "start", "length", "crc", "seq", "offset", "ids")}
            cols = (batch.column(c).to_pylist() for c in ("place", "ids"))
            for row, (place, raw) in enumerate(zip(*cols, strict=True)):
                ids = np.frombuffer(raw, kind).astype("<u4")
                start = 0
                while start < len(ids):
                    seq, offset = divmod(place + start, length)
                    n = min(length - offset, len(ids) - start)
                    piece = ids[start : start + n]
                    crc = zlib.crc32(piece)
                    for c, v in zip(rows, (row, start, n, crc, seq, offset, piece.tobytes() if with_ids else None), strict=True):
                        rows[c].append(v)
                    start += n
            take = batch.take(pa.array(rows["row"], pa.int64()))
            long = lambda c: pa.array(rows[c], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [take.column("doc_id"), long("start"), long("length"), long("crc"), take.column("doc_tokens"), long("seq"), long("offset"), pa.array(rows["ids"], pa.binary())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return run


def pack_along_curve(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    docs: doc_id (a whole number), text; more columns are ignored.  tokenizer: path of a
    ``tokenizers`` file whose ids never span white space (word_bpe_49k.json if left out).  A document is its ids and
    then ``end``; a null, empty or blank text is ``end`` alone.  A piece is a
    part of one document in one sequence; pieces of a sequence lie at offset
    0 on without gaps, and only the last sequence has less than ``length``
    tokens, to be padded.  ids: little-endian unsigned 32-bit (null without ``with_ids``).
    Rows that repeat a doc_id, or have none, are documents of their own.
    An empty table gives no rows.  Equal texts are neighbours on the curve.
    """
    spark = docs.sparkSession
    prepare(spark)
    path = tokenizer or vocabulary("word_bpe_49k.json")
    width = word_bpe(path).kind.itemsize
    docs = only(docs, ("doc_id", "bigint"), ("text", "string"))
    made = docs.mapInArrow(_tokenize(path, end), "doc_id long, curve long, doc_tokens long, ids binary")
    made = save(made.withColumn("uid", F.monotonically_increasing_id()), "tokens")
    order = made.select("uid", "doc_id", "curve", "doc_tokens").repartitionByRange("curve", "doc_id", "uid").sortWithinPartitions("curve", "doc_id", "uid")
    placed = save(order.withColumn("part", F.spark_partition_id()).mapInArrow(_places, "uid long, part int, place long, doc_tokens long"), "places")
    sums = sorted((r.part, r.n) for r in placed.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect())  # a number for each partition
    before, bases = 0, []
    for part, n in sums:
        bases.append((part, before))
        before += n
    base = spark.createDataFrame(bases, "part int, base long")
    places = placed.join(F.broadcast(base), "part").select("uid", (F.col("place") + F.col("base")).alias("place"))
    places = save(places, "places")
    drop(placed)
    out = made.select("uid", "doc_id", "doc_tokens", "ids").join(places.hint("merge"), "uid").select("doc_id", "doc_tokens", "ids", "place")
    return out.mapInArrow(_cut(length, width, with_ids), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
