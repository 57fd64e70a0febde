"""SuperMinHash near-duplicate grouping (operator 9).

Shingles are hashed; every element gives each of the M slots one rank (a
permutation of 0..M-1) plus a fraction.  Ranks of one element are all
different, which is what lowers the variance against plain MinHash.  Rounds run
over ranks: in round j each element offers j + fraction to one slot, so a slot
filled in an earlier round is final and a document stops as soon as all its
slots are filled.

Texts with equal shingle sets form a class, and all further work is on classes.
Signatures are cut into bands; classes that share a band are candidates.

* A bucket of at most ``small`` classes is compared pair by pair: pairs whose
  signatures agree in too few slots go, the others are verified on full sets.
* A larger bucket is compared block by block, and a block returns a spanning
  forest of its verified links, never all pairs: first all classes against
  some centres, then each class that is still outside the component of the
  bucket's centre against the whole bucket.  No class or link is dropped.

Verified links are grouped by union-find within partitions and then by
minimum-label rounds over the contracted forest, all as tables.

Chance to miss one pair at the threshold of 0.8: (1 - 0.8**4)**32 < 1e-7 by the
bands, and < 1e-7 by the slot filter (88 of 128 slots wanted less 5 sigma).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import drop, only, prepare, save
from ._words import BLANK_LOWER, mix, spread, windows, words

SLOTS, ROWS = 128, 4
BANDS = SLOTS // ROWS
LEAST_SLOTS = 79  #: of 128; at 0.8 the mean is 102.4 and sigma 4.5
SMALL, BLOCK, CENTRES = 64, 384, 64
BLOCK_SHINGLES = 800_000  #: of one side of a block, on the mean: long texts make smaller blocks
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(col: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, offsets and sorted distinct shingle hashes, for chunks of whole documents."""
    for w in words(col, BLANK_LOWER):
        h, doc = windows(w.hash, k), w.doc()
        full = w.room(k)
        got_doc, got = doc[full], h[full]
        n = np.diff(w.off)
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            whole = np.array([windows(w.hash[w.off[i] : w.off[i + 1]], int(n[i]))[0] for i in short], dtype=np.uint64)
            got_doc, got = np.concatenate([got_doc, short]), np.concatenate([got, whole])
        order = np.lexsort((got, got_doc))
        got_doc, got = got_doc[order], got[order]
        new = np.ones(len(got), dtype=bool)
        new[1:] = (got[1:] != got[:-1]) | (got_doc[1:] != got_doc[:-1])
        got_doc, got = got_doc[new], got[new]
        yield w.row, np.searchsorted(got_doc, np.arange(len(w) + 1)).astype(np.int64), got


def signatures(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """SuperMinHash of each set: uint64[sets, SLOTS], rank in the high byte, fraction below. All ones for an empty set."""
    n = len(off) - 1
    sig = np.full((n, SLOTS), np.iinfo(np.uint64).max, dtype=np.uint64)
    live = np.flatnonzero(np.diff(off) > 0)
    flat = sig.reshape(-1)
    key1 = mix(sets ^ np.uint64(0x5851F42D4C957F2D))
    for j in range(SLOTS):
        if not len(live):
            break
        size = np.diff(off)[live]
        at = spread(off[live], size)
        h, key = sets[at], key1[at]
        slot = _place(key, j)
        worth = (mix(h + np.uint64(int(_STEP) * (j + 1) % (1 << 64))) >> np.uint64(8)) | np.uint64(j << 56)
        np.minimum.at(flat, np.repeat(live, size) * SLOTS + slot, worth)
        live = live[(sig[live] == np.iinfo(np.uint64).max).any(axis=1)]
    return sig


def _place(key: np.ndarray, j: int) -> np.ndarray:
    """Slot that the element's own permutation of the SLOTS (a power of two) gives rank j: four keyed rounds of a bijection."""
    m = np.uint64(SLOTS - 1)
    x = np.full(len(key), j, dtype=np.uint64)
    for r in range(4):
        k = key >> np.uint64(15 * r)
        x = (x * ((k << np.uint64(1)) | np.uint64(1)) + (k >> np.uint64(7))) & m
        x ^= x >> np.uint64(3)
    return x.astype(np.int64)


def bands(sig: np.ndarray) -> np.ndarray:
    """int64[sets, BANDS]; the band's number is part of its hash."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP
    for r in range(ROWS):
        h = mix(h ^ parts[:, :, r]) * np.uint64(0xD1342543DE82EF95)
    return mix(h).view(np.int64)


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, off, sets in shingle_sets(batch.column("text"), k):
                n = np.diff(off)
                sig = signatures(sets, off)
                band, low = bands(sig), sig.astype(np.uint8)
                used = [None if not n[i] else band[i] for i in range(len(n))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, len(n)),
                        batch.column("text_hash").slice(row, len(n)),
                        pa.array([set_digest(sets[a:b]) if b > a else None for a, b in zip(off, off[1:], strict=False)], pa.binary()),
                        pa.array(n, pa.int64()),
                        pa.array(used, pa.list_(pa.int64())),
                        pa.array([low[i].tobytes() if n[i] else None for i in range(len(n))], pa.binary()),
                    ],
                    names=["doc_id", "text_hash", "cid", "n_shingles", "bands", "sig"],
                )

    return run


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree in LEAST_SLOTS slots (by their low bytes, so never less than in truth)."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SLOTS) for c in ("sig_a", "sig_b"))
            yield batch.filter(pa.array((a == b).sum(axis=1) >= LEAST_SLOTS)).select(["a", "b"])


def _chosen_texts(k: int):
    """Of rows found by doc_id, those whose set has the wanted digest (doc_id may repeat)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            want = batch.column("cid").to_pylist()
            for row, off, sets in shingle_sets(batch.column("text"), k):
                for i in range(len(off) - 1):
                    keep[row + i] = off[i + 1] > off[i] and set_digest(sets[off[i] : off[i + 1]]) == want[row + i]
            yield batch.filter(pa.array(keep)).select(["cid", "text"])

    return run


def _verified(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            keep = np.zeros(n, dtype=bool)
            step = 256
            for at in range(0, n, step):
                part = batch.slice(at, step)
                (offa, a), (offb, b) = _joined(part.column("text_a"), k), _joined(part.column("text_b"), k)
                for i in range(part.num_rows):
                    x, y = a[offa[i] : offa[i + 1]], b[offb[i] : offb[i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[at + i] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    return run


def _joined(col: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    offs, sets, base = [np.zeros(1, np.int64)], [], 0
    for _, off, got in shingle_sets(col, k):
        offs.append(off[1:] + base)
        sets.append(got)
        base += len(got)
    return np.concatenate(offs), np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def _block(k: int, percent: int):
    """Spanning forest of the verified links between a block's two sides, leaving out those within a component."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        left = np.asarray(t.column("left").to_pylist(), dtype=bool)
        cid, comp = np.array(t.column("cid").to_pylist(), dtype=object), t.column("comp").to_pylist()
        off, sets = _joined(t.column("text").combine_chunks() if t.num_rows else pa.array([], pa.string()), k)
        n = np.diff(off)
        owner = np.repeat(np.arange(len(n)), n)
        values, index = np.unique(sets, return_inverse=True)
        rows_l, rows_r = np.flatnonzero(left), np.flatnonzero(~left)
        have_l, have_r = np.zeros(len(values), bool), np.zeros(len(values), bool)
        have_l[index[left[owner]]] = True
        have_r[index[~left[owner]]] = True
        both = np.flatnonzero(have_l & have_r)
        place = np.full(len(values), -1)
        place[both] = np.arange(len(both))
        row_in = np.empty(len(n), dtype=np.int64)
        row_in[rows_l], row_in[rows_r] = np.arange(len(rows_l)), np.arange(len(rows_r))
        shared = np.zeros((len(rows_l), len(rows_r)), dtype=np.float32)
        col = place[index]
        for at in range(0, len(both), 4096):  # matrices of 4096 shingles, whatever the texts' length
            mine = (col >= at) & (col < at + 4096)
            dense = [np.zeros((m, 4096), dtype=np.float32) for m in (len(rows_l), len(rows_r))]
            for side, d in ((True, dense[0]), (False, dense[1])):
                of = mine & (left[owner] == side)
                d[row_in[owner[of]], col[of] - at] = 1
            shared += dense[0] @ dense[1].T
        both_n = shared.astype(np.int64)
        union = n[rows_l][:, None] + n[rows_r][None, :] - both_n
        hit_l, hit_r = np.nonzero((both_n > 0) & (100 * both_n >= percent * union))
        roots: dict = {}

        def root(x):
            while roots.get(x, x) != x:
                roots[x] = roots.get(roots[x], roots[x])
                x = roots[x]
            return x

        out = []
        for i, j in zip(rows_l[hit_l], rows_r[hit_r], strict=True):
            x, y = root(comp[i]), root(comp[j])
            if x != y:
                roots[x] = y
                out.append((cid[i], cid[j]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    return run


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's links: each node once, with its root (the smallest)."""
    up: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        top = x
        while (y := up.setdefault(top, top)) != top:
            top = y
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    done = [(x, root(x)) for x in list(up)]
    done = [(x, y) for x, y in done if x != y]
    for at in range(0, len(done), 50_000):
        part = done[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.binary()), pa.array([y for _, y in part], pa.binary())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(cid, comp) of every node of the links (a, b: binary); comp is the smallest cid of its component.

    Each partition is contracted to a forest of stars, then labels take the
    minimum over neighbours and jump to their label's label until none changes.
    """
    prepare(links.sparkSession)
    forest = save(links.mapInArrow(_forest, "a binary, b binary").distinct(), "forest")
    edges = save(forest.union(forest.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = save(edges.groupBy(F.col("a").alias("cid")).agg(F.min("b").alias("near")).select("cid", F.least("cid", "near").alias("comp")), "labels")
    while True:
        near = edges.join(labels.select(F.col("cid").alias("b"), "comp"), "b").groupBy(F.col("a").alias("cid")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "cid").select("cid", "comp", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("cid").alias("next"), F.col("comp").alias("far"))
        step = save(step.join(jump, "next", "left").select("cid", "comp", F.least("next", F.coalesce("far", "next")).alias("next")), "labels")
        changed = not step.filter("next <> comp").isEmpty()
        drop(labels)
        labels = step.select("cid", F.col("next").alias("comp"))
        labels.scratch_path = step.scratch_path
        if not changed:
            drop(forest, edges)
            return labels


def _pairs_in_small(members: DataFrame, classes: DataFrame) -> DataFrame:
    m = members.filter(F.col("size") <= SMALL).select("key", "cid")
    pairs = m.select("key", F.col("cid").alias("a")).join(m.select("key", F.col("cid").alias("b")), "key").filter("a < b").select("a", "b").distinct()
    sig = lambda x: classes.select(F.col("cid").alias(x), F.col("sig").alias(f"sig_{x}"))
    return pairs.join(sig("a"), "a").join(sig("b"), "b").mapInArrow(_alike, "a binary, b binary")


def _blocks(left: DataFrame, right: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """left, right: (key, cid, comp, n_left, n_right blocks of that bucket)."""
    number = lambda n: F.pmod(F.xxhash64("cid", "key"), F.col(n))
    sides = [
        left.select("key", "cid", "comp", number("n_left").alias("l"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_right") - 1)).alias("r"), F.lit(True).alias("left")),
        right.select("key", "cid", "comp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_left") - 1)).alias("l"), number("n_right").alias("r"), F.lit(False).alias("left")),
    ]
    rows = sides[0].select("key", "l", "r", "left", "cid", "comp").union(sides[1].select("key", "l", "r", "left", "cid", "comp"))
    return rows.join(texts, "cid").groupBy("key", "l", "r").applyInArrow(_block(k, percent), "a binary, b binary")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, text_hash (xxhash64 of its text).

    docs: doc_id (a whole number), text; more columns are ignored.  Words are runs of
    non-blank characters, A-Z lowered; a set has the distinct k-word shingles,
    or the whole text's words if there are fewer.  Links are pairs of sets
    with 100 * |intersection| >= percent * |union|, verified on full sets.

    A null, empty or blank text has n_shingles 0 and is a component of its own.
    Rows that repeat a doc_id are documents of their own; component_id is the
    smallest doc_id in reach.  A null doc_id is ignored in that minimum, and
    its row is kept only if it has no other document in reach.  An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    docs = only(docs, ("doc_id", "bigint"), ("text", "string"))
    feats = save(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_features(k), "doc_id long, text_hash long, cid binary, n_shingles long, bands array<long>, sig binary"), "features")
    classes = save(feats.filter("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n")), "classes")
    spread_ = classes.select(F.explode("bands").alias("key"), "cid", "n")
    crowd = spread_.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles")).filter("size > 1")
    members = save(spread_.drop("n").join(crowd, "key"), "members")

    pairs = save(_pairs_in_small(members, classes), "pairs")
    hot = members.filter(F.col("size") > SMALL)
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).union(hot.select("cid")).distinct()
    wanted = classes.select("cid", "first_id").join(wanted, "cid")
    found = docs.select(F.col("doc_id").alias("id"), "text").join(wanted, F.col("id").eqNullSafe(F.col("first_id"))).select("cid", "text")
    texts = save(found.mapInArrow(_chosen_texts(k), "cid binary, text string").dropDuplicates(["cid"]), "texts")

    text = lambda x: texts.select(F.col("cid").alias(x), F.col("text").alias(f"text_{x}"))
    checked = pairs.join(text("a"), "a").join(text("b"), "b").mapInArrow(_verified(k, percent), "a binary, b binary")
    links = save(checked, "links")
    drop(pairs)
    if not hot.isEmpty():
        links = _hot_links(hot, links, texts, k, percent)
    comps = components(links)
    drop(members, texts, links)
    label = classes.select("cid", "first_id").join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    least = save(label.groupBy("comp").agg(F.min("first_id").alias("component_id")), "least")
    label = save(label.join(least, "comp").select("cid", "component_id"), "label")
    drop(classes, least, comps)
    out = feats.select("doc_id", "text_hash", "n_shingles", "cid").join(label, "cid", "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"), "text_hash")


def _hot_links(hot: DataFrame, links: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links of the large buckets, added to those known."""

    def labelled(known: DataFrame) -> tuple[DataFrame, DataFrame]:
        comps = components(known)
        return hot.join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")), comps

    count = lambda c, per: F.ceil(F.col(c) / F.lit(per)).cast("long")
    by_text = count("shingles", BLOCK_SHINGLES)
    # Centres: some of each bucket, even by hash. All members are compared with them.
    rows, comps = labelled(links)
    rows = rows.withColumn("n_left", F.greatest(count("size", BLOCK), by_text)).withColumn("n_right", F.ceil(by_text / count("size", CENTRES)).cast("long"))
    centre = F.pmod(F.xxhash64("key", "cid"), count("size", CENTRES)) == 0
    first = save(_blocks(rows, rows.filter(centre), texts, k, percent).distinct(), "links")
    merged = save(links.unionByName(first), "links")
    drop(first, comps, links)
    # What is outside the component of its bucket's largest part is compared with the whole bucket.
    rows, comps = labelled(merged)
    parts = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.max("shingles").alias("shingles"))
    main = parts.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("size2"), F.max("shingles").alias("shingles")).select("key", F.col("m.comp").alias("main"), (F.col("size2") - F.col("m.n")).alias("outside"), "size2", "shingles")
    share = F.ceil(by_text * F.col("outside") / F.col("size2")).cast("long")
    main = save(main.filter("outside > 0").withColumn("n_left", F.greatest(count("outside", BLOCK), share)).select("key", "main", "n_left"), "main")
    rows = rows.join(main, "key").withColumn("n_right", F.greatest(count("size", BLOCK), by_text))
    second = save(_blocks(rows.filter("comp <> main"), rows, texts, k, percent).distinct(), "links")
    both = save(merged.unionByName(second), "links")
    drop(second, comps, merged, main)
    return both
