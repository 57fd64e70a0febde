"""Language identification with spans (operator 2).

A word's script (by its letters' code points) narrows the languages to those that
were seen in that script.  Each of those scores the word by the log
probabilities of its byte trigrams, word ends included.  Over a text's words a
Viterbi path with a switching penalty picks a language per word; equal
neighbours form spans.

The path is found exactly but seldom step by step: where no run of words
favours another language over the text's best one by half the penalty, the
best path never switches (each stay elsewhere would have to win back at least half
of its switches).  Only other texts are stepped through, side by side.

The model is a table of TRIGRAMS hashed trigram counts per language, so its
size is bounded by the number of languages.  It is learned from about
``most_rows`` labelled rows at most, of each language all or as many as an equal bound allows, drawn by a hash of doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import held_out, only, prepare
from ._words import BLANK_LOWER, Words, scripts_of_bytes, spread, words

TRIGRAMS = 1 << 16
PENALTY = 12.0  #: nats, for a change of language between two words
WEIGHT = 0.5  #: of a word's log probability; trigrams overlap and so count twice
LEAST_SHARE = 0.01  #: of a language's letters, for a script to be one of its own
MOST_ROWS = 30_000
LEAST_ROWS = 100  #: of a language, below which the bound never goes
_ASCII_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])


def _distinct(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place of each different word, which one each word is, and how often it stands."""
    _, first, back, count = np.unique(w.hash, return_index=True, return_inverse=True, return_counts=True)
    return first, back, count


def _trigrams(w: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of some words, blanks around each included, and how many each has."""
    n = w.end[which] - w.start[which]
    padded = np.zeros(int(n.sum()) + 2 * len(n), dtype=np.uint32)
    first = np.concatenate(([0], np.cumsum(n + 2)[:-1])) if len(n) else np.zeros(0, np.int64)
    padded[spread(first + 1, n)] = BLANK_LOWER[w.data[spread(w.start[which], n)]]
    code = (padded[:-2] << np.uint32(16)) | (padded[1:-1] << np.uint32(8)) | padded[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(16)
    return code[spread(first, n)], n


def _scripts(w: Words, which: np.ndarray) -> np.ndarray:
    n = w.end[which] - w.start[which]
    if not len(n):
        return np.zeros(0, np.uint8)
    return np.maximum.reduceat(scripts_of_bytes(w.data[spread(w.start[which], n)]), np.concatenate(([0], np.cumsum(n)[:-1])))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's trigram counts of each language; bucket TRIGRAMS + s counts the letters of script s."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for w in words(batch.column("text"), BLANK_LOWER):
            of = langs[w.row : w.row + len(w)]
            doc = w.doc()
            for lang in set(of):
                mine = np.flatnonzero((of == lang)[doc])
                code, _ = _trigrams(w, mine)
                script, size = _scripts(w, mine), w.end[mine] - w.start[mine]
                have = total.setdefault(lang, np.zeros(TRIGRAMS + 256))
                keep = np.repeat(script > 0, size)
                have[:TRIGRAMS] += np.bincount(code[keep], minlength=TRIGRAMS)
                have[TRIGRAMS:] += np.bincount(script, weights=size, minlength=256)
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at].astype(np.int64))], names=["lang", "bucket", "n"])


class LanguageModel:
    """Log probability of each trigram in each language, and the scripts each language is written in."""

    def __init__(self, rows: pa.Table, labelled: dict[str, int]) -> None:
        lang = rows.column("lang").to_pylist()
        self.langs = sorted(set(lang))
        self.common = int(np.argmax([labelled.get(x, 0) for x in self.langs])) if self.langs else -1
        counts = np.zeros((TRIGRAMS + 256, len(self.langs)))
        place = {x: i for i, x in enumerate(self.langs)}
        counts[np.asarray(rows.column("bucket")), [place[x] for x in lang]] = np.asarray(rows.column("n"))
        grams, scripts = counts[:TRIGRAMS] + 0.5, counts[TRIGRAMS:]
        self.log = (WEIGHT * np.log(grams / grams.sum(axis=0))).astype(np.float32)
        scripts[0] = 0
        self.written = scripts / np.maximum(scripts.sum(axis=0), 1) >= LEAST_SHARE
        self.known = self.written.any(axis=1)
        self.written[~self.known] = True  # a script of none narrows nothing

    def scores(self, w: Words) -> np.ndarray:
        """float64[words, languages]; 0 for a word without letters of a learned script, very low outside the language's scripts."""
        first, back, _ = _distinct(w)
        code, n = _trigrams(w, first)
        script = _scripts(w, first)
        if not len(first):
            return np.zeros((0, len(self.langs)))
        s = np.add.reduceat(self.log[code], np.concatenate(([0], np.cumsum(n)[:-1])), axis=0).astype(np.float64)
        s[~self.written[script]] = -1e3
        s[~self.known[script]] = 0
        s -= s.max(axis=1, keepdims=True)
        return s[back]


def best_path(s: np.ndarray, off: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Language per word that maximises the scores' sum less a penalty for each change, for each document apart."""
    n, k = s.shape
    if not n:
        return np.zeros(0, dtype=np.int64)
    size = np.diff(off)
    doc = np.repeat(np.arange(len(size)), size)
    total = np.zeros((len(size), k))
    full = size > 0
    total[full] = np.add.reduceat(s, off[:-1][full], axis=0)
    best = total.argmax(axis=1)
    path = best[doc]
    rise = s - s[np.arange(n), path][:, None]
    run = np.cumsum(rise, axis=0)
    # The lowest sum so far, of the same document: each document is lowered below all earlier ones.
    deep = (run.max() - run.min() + 1.0) * doc
    before = np.zeros((n, k))
    before[1:] = run[:-1]
    low = np.minimum.accumulate(before - deep[:, None], axis=0) + deep[:, None]
    most = np.zeros(len(size))
    most[full] = np.maximum.reduceat((run - low).max(axis=1), off[:-1][full])
    todo = np.flatnonzero(most > penalty / 2)
    if len(todo):
        todo = todo[np.argsort(-size[todo], kind="stable")]
        _step_through(s, off[:-1][todo], size[todo], path, penalty)
    return path


def _step_through(s: np.ndarray, start: np.ndarray, size: np.ndarray, path: np.ndarray, penalty: float) -> None:
    """Viterbi over documents side by side, the longest first; writes their words' languages to path."""
    k = s.shape[1]
    came = np.empty(s.shape, dtype=np.int32)
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # documents with more than t words
    v = s[start]
    ends = np.empty(len(start), dtype=np.int64)
    ends[:] = v.argmax(axis=1)
    for t in range(1, int(size[0])):
        m = live[t]
        at = start[:m] + t
        top = v[:m].argmax(axis=1)
        jump = v[np.arange(m), top] - penalty
        stay = v[:m] >= jump[:, None]
        came[at] = np.where(stay, np.arange(k), top[:, None])
        v = np.where(stay, v[:m], jump[:, None]) + s[at]
        ends[:m] = v.argmax(axis=1)
    state = ends
    for t in range(int(size[0]) - 1, -1, -1):
        m = live[t]
        at = start[:m] + t
        path[at] = state[:m]
        if t:
            state[:m] = came[at, state[:m]]


def _predict(model):
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModel = model.value
        names = np.array([*m.langs, "und"], dtype=object)
        for batch in batches:
            for w in words(batch.column("text"), BLANK_LOWER):
                k = len(m.langs)
                path = best_path(m.scores(w), w.off) if k else np.zeros(len(w.hash), np.int64)
                letters = np.where(m.known[_scripts(w, np.arange(len(w.hash)))] if k else False, w.end - w.start, 0)
                share = np.bincount(w.doc() * max(k, 1) + path, weights=letters, minlength=len(w) * max(k, 1)).reshape(len(w), -1)
                total = share.sum(axis=1)
                pred = np.where(total > 0, share.argmax(axis=1), m.common) if k else np.full(len(w), -1)
                score = np.where(total > 0, share.max(axis=1) / np.maximum(total, 1), 0.0)
                ascii_ = np.concatenate(([0], np.cumsum(_ASCII_LETTER[w.data])))
                first = np.append(w.start, len(w.data))[w.off[:-1]]
                last = np.where(np.diff(w.off) > 0, np.append(w.end, 0)[w.off[1:] - 1], first)
                for i in np.flatnonzero(ascii_[last] == ascii_[first]):  # no letter of ASCII: ask Unicode for others
                    if not any(map(str.isalpha, w.text(i).decode())):
                        pred[i], score[i] = -1, 0.0
                doc = w.doc()
                new = np.ones(len(path), dtype=bool)
                new[1:] = (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                end = np.append(at[1:], len(path)) if len(at) else at
                base = w.off[doc[at]] if len(at) else at
                item = pa.StructArray.from_arrays([pa.array(at - base, pa.int32()), pa.array(end - base, pa.int32()), pa.array(names[path[at]] if k else ["und"] * len(at), pa.string())], fields=list(spans_type.value_type))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[at], np.arange(len(w) + 1)), pa.int32()), item)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(w.row, len(w)), pa.array(names[pred], pa.string()), pa.array(score), lists], names=["doc_id", "lang_pred", "score", "spans"])

    return run


def _bound(labelled: dict[str, int], most_rows: int) -> int:
    """The rows of a language to draw at most, so that all draws sum to most_rows at most."""
    left, sizes = most_rows, sorted(labelled.values())
    for i, n in enumerate(sizes):
        share = left // (len(sizes) - i)
        if n > share:
            return max(share, LEAST_ROWS)
        left -= n
    return max(sizes, default=0)


def learn_languages(docs: DataFrame, most_rows: int = MOST_ROWS) -> LanguageModel:
    """From the text and lang of rows that aren't held out and have both; of more than ``most_rows``, a draw by hash of about that many, with all rows of rare languages."""
    prepare(docs.sparkSession)
    rows = only(docs, ("doc_id", "bigint"), ("text", "string"), ("lang", "string")).filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    labelled = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    n = sum(labelled.values())
    if n > most_rows:
        most = _bound(labelled, most_rows)
        large = [F.lit(v) for x, c in sorted(labelled.items()) if c > most for v in (x, c)]
        if large:
            of = F.coalesce(F.try_element_at(F.create_map(*large), F.col("lang")), F.lit(1))
            rows = rows.filter(F.pmod(F.xxhash64("doc_id"), of) < most)
    counts = rows.select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return LanguageModel(counts.toArrow(), labelled)  # at most TRIGRAMS + 256 numbers for each language


def identify_languages(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans (word ranges with their language).

    docs: doc_id (a whole number), text, lang (read by learning alone); more columns are ignored.
    lang_pred is the language of most letters; score is its share of them.  ``und`` if the text is null or
    has no letter, or nothing could be learned.  Letters of a script that no
    learned language has: the commonest language, score 0.  Ties go to
    the language first by name.  Rows that repeat a doc_id are judged each by its own
    text.  A null doc_id is not held out.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    model = model or learn_languages(docs)
    prepare(spark)
    got = only(docs, ("doc_id", "bigint"), ("text", "string")).mapInArrow(_predict(spark.sparkContext.broadcast(model)), "doc_id long, lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")
