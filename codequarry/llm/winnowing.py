"""Benchmark decontamination by winnowing (operator 6).

Of the GRAM-word grams in every WINDOW consecutive words, the smallest hash (the
leftmost on a tie) is the window's fingerprint, for documents and items alike.
A shared run of WINDOW words or more has a window in common, and with it the
fingerprint, so none is missed.  Where a document's fingerprint is one of the
items', the windows that have it are verified by the hash of their words, and
hits are extended: neighbouring windows join into maximal shared runs.
An item of fewer words is one window and its own fingerprint.

The items' fingerprints go to every task if there are at most ``most_broadcast``
of their windows (checked, 24 bytes each); beyond that both sides are joined by
fingerprint in a shuffle.  Both ways give the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import carried_part, drop, only, prepare, save, with_carried
from ._words import ALNUM_LOWER, Words, spread, windows, words
from .substring import _smallest

WINDOW, GRAM = 8, 4
_KEYS = "fp long, h long"
_OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, items array<string>, runs array<array<long>>"


def _long_windows(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and fingerprint of every full window."""
    if len(w.hash) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = windows(w.hash, gram)[: len(w.hash) - gram + 1]
    first = np.flatnonzero(w.room(window))
    return first, g[_smallest(g, window - gram + 1)[first]]


def _item_windows(window: int, gram: int):
    """item, fingerprint, hash and number of words of each window of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id")
            for w in words(batch.column("text"), ALNUM_LOWER):
                first, fp = _long_windows(w, window, gram)
                doc, h, n = w.doc()[first], windows(w.hash, window)[first], np.full(len(first), window)
                size = np.diff(w.off)
                for i in np.flatnonzero((size > 0) & (size < window)):
                    whole = windows(w.hash[w.off[i] : w.off[i + 1]], int(size[i]))[:1]
                    doc, fp, h, n = np.append(doc, i), np.append(fp, whole), np.append(h, whole), np.append(n, size[i])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc + w.row)), pa.array(fp.view(np.int64)), pa.array(h.view(np.int64)), pa.array(n, pa.int32())], names=["item_id", "fp", "h", "n"])

    return run


class _Known:
    """The items' windows, sorted for lookup: fingerprints with a bit map before them, and items by (fingerprint, hash)."""

    def __init__(self, fp: np.ndarray, h: np.ndarray, item: list[str | None], n: np.ndarray, window: int) -> None:
        order = np.lexsort((h, fp))
        self.fp, self.h, self.item = fp[order], h[order], [item[i] for i in order]
        self.short = sorted({int(x) for x in n if x < window})
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[self.fp & np.uint64((1 << 20) - 1)] = True

    def find(self, fp: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list[list[str | None]]]:
        """Of windows, which are known, and the items of each of those."""
        maybe = np.flatnonzero(self.bits[fp & np.uint64((1 << 20) - 1)])
        if not len(maybe) or not len(self.fp):
            return maybe[:0], []
        lo, hi = np.searchsorted(self.fp, fp[maybe]), np.searchsorted(self.fp, fp[maybe], side="right")
        at, items = [], []
        for i, a, b in zip(maybe[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
            c, d = a + np.searchsorted(self.h[a:b], h[i]), a + np.searchsorted(self.h[a:b], h[i], side="right")
            if d > c:
                at.append(i)
                items.append(self.item[c:d])
        return np.array(at, dtype=np.int64), items


def _row(n_words: int, start: np.ndarray, length: np.ndarray, items: set) -> tuple:
    step = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + length, -1)
    hit = np.cumsum(step[:-1]) > 0
    names = sorted(x for x in items if x is not None)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return n_words, int(hit.sum()), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), names, edge.reshape(-1, 2).tolist()


def _batch(batch: pa.RecordBatch, start: int, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64())))
    more, names = carried_part(batch, start, len(rows), ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "items", "runs"])
    return pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(rows)), *(pa.array(c, t) for c, t in zip(cols, types, strict=True)), *more], names=names)


def _by_broadcast(known, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = known.value
        for batch in batches:
            for w in words(batch.column("text"), ALNUM_LOWER):
                first, fp = _long_windows(w, window, gram)
                at, items = k.find(fp, windows(w.hash, window)[first])
                found = [(first[at], np.full(len(at), window), items)]
                for n in k.short:
                    start = np.flatnonzero(w.room(n))
                    h = windows(w.hash, n)[start]
                    at, items = k.find(h, h)
                    found.append((start[at], np.full(len(at), n), items))
                start, length = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                items = [x for f in found for x in f[2]]
                doc = w.doc()[start] if len(start) else start
                order = np.argsort(doc, kind="stable")
                cut = np.searchsorted(doc[order], np.arange(len(w) + 1))
                rows = []
                for i in range(len(w)):
                    mine = order[cut[i] : cut[i + 1]]
                    rows.append(_row(int(w.off[i + 1] - w.off[i]), start[mine] - w.off[i], length[mine], {x for j in mine for x in items[j]}))
                yield _batch(batch, w.row, rows)

    return run


def _doc_windows(window: int, gram: int, short: list[int]):
    """Of each document, number of words, and of each window fingerprint, hash, first word and number of words."""
    one = pa.struct([("fp", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column("text"), ALNUM_LOWER):
                first, fp = _long_windows(w, window, gram)
                got = [(first, fp, windows(w.hash, window)[first], np.full(len(first), window))]
                for n in short:
                    start = np.flatnonzero(w.room(n))
                    h = windows(w.hash, n)[start]
                    got.append((start, h, h, np.full(len(start), n)))
                start, fp, h, n = (np.concatenate(x) for x in zip(*got, strict=True))
                doc = w.doc()[start] if len(start) else start
                order = np.argsort(doc, kind="stable")
                off = np.searchsorted(doc[order], np.arange(len(w) + 1))
                of = pa.StructArray.from_arrays([pa.array(fp[order].view(np.int64)), pa.array(h[order].view(np.int64)), pa.array((start - w.off[doc])[order], pa.int32()), pa.array(n[order], pa.int32())], fields=list(one))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(w.row, len(w)), batch.column("text_hash").slice(w.row, len(w)), pa.array(np.diff(w.off)), pa.ListArray.from_arrays(pa.array(off, pa.int32()), of)],
                    names=["doc_id", "text_hash", "n_words", "windows"],
                )

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for n, hits, items in zip(*(batch.column(c).to_pylist() for c in ("n_words", "hits", "items")), strict=True):
            at = np.array([(x["start"], x["n"]) for x in hits or []], dtype=np.int64).reshape(-1, 2)
            rows.append(_row(n, at[:, 0], at[:, 1], set(items or [])))
        yield _batch(batch, 0, rows)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, least_items: int = 2, most_broadcast: int = 500_000, carry: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, runs (word ranges shared with items).

    docs: doc_id (a whole number), text; benchmark: item_id, text; more columns are ignored.
    A-Z is lowered; words are runs of a-z, 0-9 and non-ASCII characters.  A word
    is hit if it lies in any occurrence of an item's window.  A document is
    contaminated if it has windows of ``least_items`` items or more.

    A null, empty or wordless text has no words and no hits; an item without words
    has no windows.  Items with a null item_id hit words but are not listed;
    rows that repeat an item_id are one item.  Rows that repeat a doc_id are
    judged each by its own text.  Empty tables: no rows, or no hits.
    carry: add all columns of docs, as a struct ``carried``.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs, more = with_carried(docs, carry, ("doc_id", "bigint"), ("text", "string"))
    items = only(benchmark, ("item_id", "string"), ("text", "string"))
    known = save(items.mapInArrow(_item_windows(window, gram), f"item_id string, {_KEYS}, n int").distinct(), "items")
    n = known.count()
    if n <= most_broadcast:
        got = known.toArrow()
        fp, h = (np.asarray(got.column(c)).view(np.uint64) for c in ("fp", "h"))
        b = spark.sparkContext.broadcast(_Known(fp, h, got.column("item_id").to_pylist(), np.asarray(got.column("n")), window))
        drop(known)
        out = docs.mapInArrow(_by_broadcast(b, window, gram), _OUT + more)
    else:
        short = sorted(r[0] for r in known.filter(F.col("n") < window).select("n").distinct().collect())  # at most window - 1 numbers
        docs = docs.withColumn("text_hash", F.xxhash64("text"))
        found = save(docs.mapInArrow(_doc_windows(window, gram, short), "doc_id long, text_hash long, n_words long, windows array<struct<fp: bigint, h: bigint, start: int, n: int>>"), "windows")
        each = found.select("doc_id", "text_hash", F.explode("windows").alias("w")).select("doc_id", "text_hash", "w.*")
        hits = save(each.join(known.withColumnRenamed("n", "n_item"), ["fp", "h"]).filter("n = n_item").select("doc_id", "text_hash", "start", "n", "item_id"), "hits")
        per = hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "n")).alias("hits"), F.collect_set("item_id").alias("items"))
        on = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & F.col("l.text_hash").eqNullSafe(F.col("r.text_hash"))
        counts = found.select("doc_id", "text_hash", "n_words").distinct()
        per = counts.alias("l").join(per.alias("r"), on, "left").select("l.doc_id", "l.text_hash", "l.n_words", "r.hits", "r.items")
        out = docs.drop("text").alias("l").join(per.alias("r"), on).select("l.doc_id", "r.n_words", "r.hits", "r.items", *["l.carried"] * carry).mapInArrow(_finish, _OUT + more)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_items") >= least_items).alias("contaminated"), "items", "runs", *["carried"] * carry)
