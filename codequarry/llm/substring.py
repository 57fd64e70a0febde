"""Substring deduplication over a log-structured fingerprint index (operator 10).

A window is WINDOW consecutive words.  Its fingerprint is the smallest hash of
the GRAM-word grams in it (the leftmost on a tie), so equal windows have equal
fingerprints, and the windows of one document that share one gram are
neighbours: a *span*.  Only spans are stored, about one for every 21 words.

The index is a folder that outlives the session: immutable runs, and manifests of which the last names the
live runs.  A batch of documents adds a run: a row for each different span of a fingerprint, with its smallest and
largest doc_id and a place where its words stand.  Runs are bucketed and sorted by fingerprint, so a batch is
merge-joined with each of them and no history is shuffled or sorted again.  After FANOUT runs of a level they are
compacted into one of the next, bucket by bucket, so a batch meets a number of runs that grows with the
logarithm of the history.

A fingerprint of one document settles all its spans at once.  One that documents share is verified: where all
its spans are the same words, by the hash of those words; else window by window, for one document of each
different span, whose text is read again (the batch's own text wherever it has the span).  No pairs of documents
are made, so a passage that a third of all documents share costs a row for each of them.  A fingerprint that is
frequent within a piece of the batch is spread over SALTS buckets.

A window's identity is its fingerprint with its own 64-bit hash (128 bits in all).
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import carried_part, drop, list_names, new_path, prepare, read_text, save, with_carried, write_text
from ._words import _WORD_BASE, _WORD_BASE_INV, BLANK, Words, chunks, mix, powers, spread, text_bytes, windows, words

WINDOW, GRAM = 50, 10
FANOUT = 2  #: runs of a level that are compacted into one of the next
BATCHES = 3  #: batches that cut_duplicates feeds a table in
CHUNK = 1 << 20  #: bytes of text that are worked on at once
SALTS, FREQUENT = 32, 16  #: a fingerprint that a chunk has so often goes to one of so many buckets, by document
_SPAN = "struct<fp: bigint, span: bigint, start: int, count: int, hot: boolean>"
_SPANS_ARROW = pa.list_(pa.struct([("fp", pa.int64()), ("span", pa.int64()), ("start", pa.int32()), ("count", pa.int32()), ("hot", pa.bool_())]))


def _smallest(g: np.ndarray, n: int) -> np.ndarray:
    """Of each n neighbours, the place of the smallest, the leftmost on a tie."""
    value, place, width = g, np.arange(len(g)), 1
    while width < n:
        step = min(width, n - width)
        right, right_place = value[step:], place[step:]
        left, left_place = value[: len(right)], place[: len(right)]
        take = left <= right
        value, place, width = np.where(take, left, right), np.where(take, left_place, right_place), width + step
    return place


def spans(w: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of all windows of some documents: document, fingerprint, hash of the span's words, first window, number of windows."""
    none = np.zeros(0, np.int64)
    if len(w.hash) < window:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    g = windows(w.hash, gram)[: len(w.hash) - gram + 1]
    place = _smallest(g, window - gram + 1)
    first = np.flatnonzero(w.room(window))
    if not len(first):
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    place, doc = place[first], w.doc()[first]
    new = np.ones(len(first), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(first)))
    start, length = first[at], count + window - 1
    total = np.zeros(len(w.hash) + 1, dtype=np.uint64)
    np.cumsum(w.hash * powers(_WORD_BASE, len(w.hash)), out=total[1:])
    span = mix((total[start + length] - total[start]) * powers(_WORD_BASE_INV, len(w.hash) + 1)[start] + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    # The gram's place in its span is part of the fingerprint's meaning only through the words, which the span's hash covers.
    return doc[at], g[place[at]], span, start - w.off[doc[at]], count


def _find_spans(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column("text"), BLANK, CHUNK):
                doc, fp, span, start, count = spans(w, window, gram)
                off = np.searchsorted(doc, np.arange(len(w) + 1))
                _, back, often = np.unique(fp, return_inverse=True, return_counts=True)
                cols = [pa.array(fp.view(np.int64)), pa.array(span.view(np.int64)), pa.array(start, pa.int32()), pa.array(count, pa.int32()), pa.array(often[back] >= FREQUENT)]
                of = pa.StructArray.from_arrays(cols, fields=list(_SPANS_ARROW.value_type))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(w.row, len(w)) for c in ("doc_id", "text_hash")] + [pa.ListArray.from_arrays(pa.array(off, pa.int32()), of)],
                    names=["doc_id", "text_hash", "spans"],
                )

    return run


def _window_hashes(window: int):
    """Of each wanted span of a text: fp, span, least and the hashes of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted")
            for w in words(batch.column("text"), BLANK, CHUNK):
                part = wanted.slice(w.row, len(w))
                flat, size = part.flatten(), np.asarray(part.value_lengths(), dtype=np.int64)
                doc = np.repeat(np.arange(len(w)), size)
                start = np.asarray(flat.field("start"), dtype=np.int64) + w.off[doc]
                count = np.asarray(flat.field("count"), dtype=np.int64)
                h = windows(w.hash, window)[spread(start, count)].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(h))
                out = pa.RecordBatch.from_arrays([flat.field("fp"), flat.field("span"), flat.field("least"), lists], names=["fp", "span", "least", "hashes"])
                for at in range(0, out.num_rows, 20_000):
                    yield out.slice(at, 20_000)

    return run


def _rebuild(window: int):
    """Cut the removed windows' words out; what is left as it stood, the hash of its words and the removed word ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.asarray(pa.compute.binary_length(whole.column("text")).fill_null(0), dtype=np.int64)
            for lo, hi in chunks(np.concatenate(([0], np.cumsum(sizes))), 4 * CHUNK):  # results are of the texts' size
                yield rebuilt(whole.slice(lo, hi - lo))

    def rebuilt(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        cuts = batch.column("cuts")
        texts = batch.column("text")
        _, bytes_ = text_bytes(texts)
        for w in words(texts, BLANK, CHUNK):
            part = cuts.slice(w.row, len(w))
            size = np.asarray(part.value_lengths().fill_null(0), dtype=np.int64)
            flat = part.flatten()
            doc = np.repeat(np.arange(len(w)), size)
            step = np.zeros(len(w.hash) + 1, dtype=np.int64)
            start = np.asarray(flat.field("start"), dtype=np.int64) + w.off[doc]
            np.add.at(step, start, 1)
            np.add.at(step, start + np.asarray(flat.field("count"), dtype=np.int64) + window - 1, -1)
            gone = np.cumsum(step[:-1]) > 0
            for i in range(len(w)):
                a, b = w.off[i], w.off[i + 1]
                g = gone[a:b]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], g.astype(np.int8), [0])))).reshape(-1, 2)
                lo, hi = bytes_[w.row + i : w.row + i + 2] - bytes_[w.row]
                if len(edge):
                    keep = np.flatnonzero(~g) + a
                    digest = hashlib.sha256(b" ".join([w.data[s:e].tobytes() for s, e in zip(w.start[keep], w.end[keep], strict=True)]))
                    left = np.ones(hi - lo, dtype=bool)
                    for s, e in edge + a:  # up to the next word, or of the last word its end
                        left[w.start[s] - lo : (w.start[e] if e < b else w.end[e - 1]) - lo] = False
                    kept = w.data[lo:hi][left].tobytes()
                else:
                    digest, kept = hashlib.sha256(w.text(i)), w.data[lo:hi].tobytes()
                rows.append((int(b - a), int(g.sum()), digest.hexdigest(), kept.decode(), edge.tolist()))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        made = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.list_(pa.int64()))), strict=True)]
        more, names = carried_part(batch, 0, batch.num_rows, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "removed"])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *made, *more], names=names)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """A row's identity is doc_id with its text's hash; equal rows get equal results."""
    return with_carried(docs, False, ("doc_id", "bigint"), ("text", "string"))[0].withColumn("text_hash", F.xxhash64("text"))


_ROW = "b BIGINT, fp BIGINT, span BIGINT, doc_id BIGINT, last BIGINT, text_hash BIGINT, start INT, count INT"
_KEYS = ("first", "last", "low", "high")


def _keys(first: str = "doc_id", low: str = "span", high: str = "span") -> list[Column]:
    """Of the spans of a fingerprint: smallest and largest document, smallest and largest hash of the words."""
    return [F.min(first).alias("first"), F.max("last").alias("last"), F.min(low).alias("low"), F.max(high).alias("high")]


class SubstringIndex:
    """Log-structured index of window fingerprints in a folder; see the module's description.

    ``add`` takes batches in any order and gives each a run; ``duplicates`` judges a batch, and that batch alone,
    against everything added so far, by doc_id.  A later batch with smaller ids can make more of an earlier
    batch's windows duplicates: ask ``duplicates`` for that one again.  Texts aren't stored: to judge a batch
    by history, ``duplicates`` is given the documents that were added before, of which it reads those that have
    other words around a fingerprint of the batch; if it lacks one of them, that is an error.

    An index that exists in ``root`` is opened with the parameters it was made with.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, window: int = WINDOW, gram: int = GRAM, buckets: int | None = None, fanout: int = FANOUT) -> None:
        prepare(spark)
        self._spark, self.root = spark, (root or new_path(spark, "index")).rstrip("/")
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # a run's bucket is one sorted file
        self._table = "codequarry_" + hashlib.md5(self.root.encode()).hexdigest()
        have = sorted(int(n.removesuffix(".json")) for n in list_names(spark, f"{self.root}/manifest") if n.endswith(".json"))
        if have:
            self._at = have[-1]
            m = json.loads(read_text(spark, f"{self.root}/manifest/{self._at}.json"))
        else:
            self._at = -1
            m = {"window": window, "gram": gram, "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "fanout": fanout, "runs": []}
        self.window, self.gram, self.buckets, self.fanout, self.runs = (m[k] for k in ("window", "gram", "buckets", "fanout", "runs"))
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._table} ({_ROW}, run STRING, hot INT) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY (run, hot) "
            f"CLUSTERED BY (b) SORTED BY (b) INTO {self.buckets} BUCKETS LOCATION '{self.root}/runs'"
        )
        if have:
            spark.sql(f"ALTER TABLE {self._table} RECOVER PARTITIONS")
        self._found: dict[str, DataFrame] = {}

    def _publish(self, runs: list[dict]) -> None:
        """A manifest of its own number, written last; two writers at once can't both succeed."""
        m = {"window": self.window, "gram": self.gram, "buckets": self.buckets, "fanout": self.fanout, "runs": runs}
        write_text(self._spark, f"{self.root}/manifest/{self._at + 1}.json", json.dumps(m))
        self._at, self.runs = self._at + 1, runs

    def _rows(self, hot: int, *runs: str) -> DataFrame:
        return self._spark.table(self._table).filter((F.col("hot") == hot) & F.col("run").isin(*runs))

    def _live(self) -> list[str]:
        return [r["id"] for r in self.runs]

    def _write(self, rows: DataFrame, run: str) -> None:
        place = F.min(F.struct("doc_id", "text_hash", "start", "count")).alias("r")
        one = rows.groupBy("b", "hot", "fp", "span").agg(place, F.max("last").alias("last"))
        one.select("b", "fp", "span", "r.doc_id", "last", "r.text_hash", "r.start", "r.count", F.lit(run).alias("run"), "hot").write.insertInto(self._table)

    def _find(self, docs: DataFrame) -> DataFrame:
        docs = _keyed(docs).filter(F.col("doc_id").isNotNull())
        return save(docs.mapInArrow(_find_spans(self.window, self.gram), f"doc_id long, text_hash long, spans array<{_SPAN}>"), "spans")

    def add(self, docs: DataFrame) -> str:
        """An immutable run for a batch; its id.  Compacts where a level is full."""
        found, run = self._find(docs), uuid.uuid4().hex
        flat = found.select("doc_id", "text_hash", F.explode("spans").alias("s")).select("doc_id", "text_hash", "s.*", F.col("doc_id").alias("last"))
        salted = F.xxhash64("fp", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))  # copies have one text, not one id
        flat = flat.withColumn("b", F.when(F.col("hot"), salted).otherwise(F.col("fp"))).withColumn("hot", F.col("hot").cast("int"))
        self._write(flat.repartition(self.buckets, "b"), run)
        self._publish([*self.runs, {"id": run, "level": 0}])
        self._found[run] = found
        return run

    def compact(self, whole: bool = False) -> None:
        """Merge the newest runs of each full level into one of the next (whole: all runs into one)."""
        while True:
            levels = [r["level"] for r in self.runs]
            full = [x for x in sorted(set(levels)) if levels.count(x) >= self.fanout]
            if not (full or whole and len(self.runs) > 1):
                return
            old = self.runs if whole else [r for r in self.runs if r["level"] == full[0]]
            run = uuid.uuid4().hex
            self._write(self._spark.table(self._table).filter(F.col("run").isin(*[r["id"] for r in old])), run)  # bucket by bucket, no shuffle
            self._publish([r for r in self.runs if r not in old] + [{"id": run, "level": max(r["level"] for r in old) + 1, "of": [r["id"] for r in old]}])
            for r in old:
                for hot in (0, 1):
                    self._spark.sql(f"ALTER TABLE {self._table} DROP IF EXISTS PARTITION (run = '{r['id']}', hot = {hot})")
                drop(f"{self.root}/runs/run={r['id']}", anyway=self._spark)

    def forget(self, run: str) -> None:
        """Drop what was kept of a batch for judging it."""
        if run in self._found:
            drop(self._found.pop(run))

    def close(self) -> None:
        """Forget the batches and the session's table; the index stays in its folder."""
        for run in list(self._found):
            self.forget(run)
        self._spark.sql(f"DROP TABLE IF EXISTS {self._table}")

    def destroy(self) -> None:
        self.close()
        drop(self.root, anyway=self._spark)

    def _shared(self, mine: str) -> DataFrame:
        """(fp, first, same) of fingerprints of a batch's run that several documents have."""
        live = self._live()
        own = self._rows(0, mine).groupBy("b").agg(*_keys())
        parts = [own.filter("first < last")]
        for r in live:
            if r != mine:
                theirs = self._rows(0, r).select("b", "doc_id", "last", "span")
                both = own.withColumnRenamed("last", "own_last").join(theirs, "b").groupBy("b").agg(
                    F.min(F.least("first", "doc_id")).alias("first"), F.max(F.greatest("own_last", "last")).alias("last"),
                    F.min(F.least("low", "span")).alias("low"), F.max(F.greatest("high", "span")).alias("high"),
                )
                parts.append(both)
        # Spread fingerprints: what their buckets say of them, and the rows of other places.
        hot = save(self._rows(1, *live).groupBy("fp").agg(*_keys()).withColumnRenamed("fp", "b"), "hot")
        if not hot.isEmpty():
            parts.append(hot)
            parts += [self._rows(0, r).join(hot.select("b"), "b").groupBy("b").agg(*_keys()) for r in live]
        keys = reduce(DataFrame.unionByName, [p.select("b", *_KEYS) for p in parts]).groupBy("b").agg(*_keys("first", "low", "high"))
        out = save(keys.filter("first < last").select(F.col("b").alias("fp"), "first", (F.col("low") == F.col("high")).alias("same")), "shared")
        drop(hot)
        return out

    def _places(self, fps: DataFrame, mine: str) -> DataFrame:
        """(fp, span, least, far, doc_id, text_hash, start, count) of every different span of some fingerprints: a place of its words, in the batch if it has them."""
        cols = ["fp", "span", "doc_id", "text_hash", "start", "count", (F.col("run") != mine).alias("far")]
        by_b = fps.withColumnRenamed("fp", "b")
        parts = [self._rows(0, r).join(by_b, "b", "left_semi").select(*cols) for r in self._live()]
        parts.append(self._rows(1, *self._live()).join(fps, "fp", "left_semi").select(*cols))
        place = F.min(F.struct("far", "doc_id", "text_hash", "start", "count")).alias("r")
        return reduce(DataFrame.unionByName, parts).groupBy("fp", "span").agg(F.min("doc_id").alias("least"), place).select("fp", "span", "least", "r.*")

    def duplicates(self, docs: DataFrame, texts: DataFrame | None = None, run: str | None = None) -> DataFrame:
        """Cuts of a batch that was added: runs of windows that also start in an added document of smaller doc_id.

        docs: the batch; run: what ``add`` returned for it (the last run, if left out); texts: the documents of other batches.
        Returns doc_id, text_hash, cuts array<struct<start, count>>; rows without cuts are left out.
        """
        run = run or self.runs[-1]["id"]
        mine = next(r["id"] for r in self.runs if r["id"] == run or run in r.get("of", ()))
        found = self._found[run] if run in self._found else self._find(docs)
        self._found[run] = found
        shared = self._shared(mine)
        flat = found.select("doc_id", "text_hash", F.explode("spans").alias("s")).select("doc_id", "text_hash", "s.fp", "s.span", "s.start", "s.count")
        hits = save(flat.join(shared, "fp").filter("not same or first < doc_id"), "hits")
        # Different words around a shared gram: window by window, one place of each span.
        unsure = hits.filter("not same")
        fps = save(unsure.select("fp").distinct(), "unsure")
        places = save(self._places(fps, mine), "places")
        wanted = places.groupBy("far", "doc_id", "text_hash").agg(F.collect_list(F.struct("fp", "span", "start", "count", "least")).alias("wanted"))
        wanted = save(wanted, "wanted")

        def hashes_of(source: DataFrame, far: bool) -> DataFrame:
            # A text that stands twice under one doc_id gives its windows twice, which a minimum doesn't mind.
            mine = wanted.filter(F.col("far") == far).drop("far").hint("merge")  # one plan at every size
            of = _keyed(source).join(mine, ["doc_id", "text_hash"]).select("doc_id", "text", "wanted")
            return of.mapInArrow(_window_hashes(self.window), "fp long, span long, least long, hashes array<long>")

        others = None if texts is None else texts.select("doc_id", "text")
        # In a run that was compacted since, the batch's places can't be told from the others'.
        near = docs if mine == run or others is None else docs.select("doc_id", "text").unionByName(others)
        hashes = hashes_of(near, False)
        if others is not None and len(self.runs) > 1:
            hashes = hashes.unionByName(hashes_of(others, True))
        hashes = save(hashes.dropDuplicates(["fp", "span"]), "hashes")
        if hashes.count() < places.count():
            raise ValueError("texts lacks documents that were added and share fingerprints with the batch")
        each = hashes.select("fp", "span", "least", F.posexplode("hashes").alias("j", "h"))
        least = save(each.groupBy("fp", "h").agg(F.min("least").alias("first")), "least")
        firsts = each.select("fp", "span", "j", "h").join(least, ["fp", "h"]).groupBy("fp", "span").agg(F.collect_list(F.struct("j", "first")).alias("firsts"))
        firsts = save(firsts, "firsts")
        sure = hits.filter("same").select("doc_id", "text_hash", F.array(F.struct(F.col("start"), F.col("count"))).alias("cuts"))
        cut = F.transform(F.filter("firsts", lambda x: x["first"] < F.col("doc_id")), lambda x: F.struct((F.col("start") + x["j"]).cast("int").alias("start"), F.lit(1).alias("count")))
        seen = unsure.join(firsts, ["fp", "span"]).select("doc_id", "text_hash", cut.alias("cuts")).filter(F.size("cuts") > 0)
        cuts = sure.unionByName(seen).groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))
        cuts = save(cuts, "cuts")
        drop(shared, hits, fps, places, wanted, hashes, least, firsts)
        return cuts


def batches_of(docs: DataFrame, n: int) -> list[DataFrame]:
    """A table as about n batches of rising doc_id; rows of one doc_id stay together, those with a null one are in none."""
    ids = docs.select(F.col("`doc_id`").cast("bigint").alias("id"))
    # Cuts at equal shares of the ids' range of ranks, from a bounded sketch: only the batches' sizes depend on it.
    marks = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 1000)).first()[0] if n > 1 else None
    cuts = sorted(set(marks or []))
    key = F.col("`doc_id`").cast("bigint")
    bounds = [None, *cuts, None]
    return [docs.filter(key.isNotNull() & (F.lit(True) if lo is None else key > lo) & (F.lit(True) if hi is None else key <= hi)) for lo, hi in zip(bounds, bounds[1:], strict=False)]


def cut_duplicates(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, carry: bool = False, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text, removed (word ranges) of every document.

    docs: doc_id (a whole number), text; more columns are ignored.  Words are
    runs of non-blank characters, unchanged.  A word goes if a window over it
    also starts in a document of smaller doc_id, in the input as it came.  kept_sha256 is the hash of
    the kept words, joined by one space; kept_text is the text as it stood without the removed words and what
    follows each up to the next word.  A null, empty or blank text has no words.
    Rows of one doc_id never cut each other; a row with a null doc_id is kept whole
    and cuts none.  Fewer than ``window`` words: nothing goes.
    An empty table gives an empty result.  carry: add all columns of docs, as a struct ``carried``.

    The table goes through an index of its own in so many batches of rising doc_id: each is added, judged against
    those before it, and full levels are compacted.
    """
    spark = docs.sparkSession
    prepare(spark)
    index = SubstringIndex(spark, None, window, gram)
    cuts, before = [], None
    for batch in batches_of(docs, batches):
        run = index.add(batch)
        cuts.append(index.duplicates(batch, before, run))
        index.forget(run)
        index.compact()
        before = batch if before is None else before.unionByName(batch)
    index.destroy()
    whole = reduce(DataFrame.unionByName, cuts)
    return apply_cuts(docs, whole, window, carry)


def apply_cuts(docs: DataFrame, cuts: DataFrame, window: int = WINDOW, carry: bool = False) -> DataFrame:
    """What ``cut_duplicates`` returns, from the cuts of SubstringIndex.duplicates."""
    docs, more = with_carried(docs, carry, ("doc_id", "bigint"), ("text", "string"))
    out = docs.withColumn("text_hash", F.xxhash64("text")).join(cuts.hint("merge"), ["doc_id", "text_hash"], "left").drop("text_hash")
    return out.mapInArrow(_rebuild(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, removed array<array<long>>" + more)
