"""Quality rules on tokeniser fertility (operator 8).

Public vocabularies encode every word of a text: a sentencepiece one with byte fallback, and a byte-level one
for many languages.  Figures tell prose from junk without a model: characters, and letters and digits, per token
of the vocabulary that suits the text best (foreign words are long in one vocabulary and not in the other,
junk is long in both); the share of byte-fallback tokens; and the tokens' entropy over its largest
possible value.  Entropy levels off while that value grows with the length, so a long text is judged by the
mean over equal blocks of all of it.  Each script has a band for each; a figure outside its band rejects the text.
A few plain counts (symbols, repeated lines and windows) go with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import carried_part, prepare, with_carried
from ._tokens import byte_level, pieces, vocabulary
from ._words import BLANK, Words, mix, script_names, scripts_of_bytes, text_bytes, windows, words

LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
CHUNK = 1 << 19  #: bytes of text that are worked on at once
BLOCK = 4096  #: tokens of a block of entropy at most; a shorter text is one block
FIGURES = ("chars_per_token", "letters_per_token", "byte_share", "entropy")


@dataclass(frozen=True)
class Band:
    """Closed ranges outside which a text is rejected."""

    chars_per_token: tuple[float, float]
    letters_per_token: tuple[float, float]
    byte_share: tuple[float, float]
    entropy: tuple[float, float]


def _band(chars: float, letters: float, byte_share: float = 0.5, entropy: float = 0.35) -> Band:
    return Band((chars, 12.0), (letters, 12.0), (0.0, byte_share), (entropy, 1.0))


#: Of prose in each script the least characters and letters per token, less about a third: prose in Latin letters has
#: 1.9 letters per token or more in the better vocabulary, shouted or decorated words 1.55 at most.  Scripts of
#: which the vocabularies know few letters have about one token per letter; unknown scripts are all bytes.
BANDS = {
    "latin": _band(1.6, 1.6, 0.1, 0.45), "greek": _band(1.2, 1.1), "cyrillic": _band(1.5, 1.4), "hebrew": _band(1.0, 0.95), "arabic": _band(1.0, 0.95),
    "han": _band(0.6, 0.5), "kana": _band(0.6, 0.55), "hangul": _band(0.65, 0.6), "devanagari": _band(0.5, 0.45), "bengali": _band(0.5, 0.45),
    "tamil": _band(0.7, 0.6), "thai": _band(0.65, 0.55), "georgian": _band(0.55, 0.5), "armenian": _band(0.55, 0.5), "other": _band(0.2, 0.2, 1.0),
}
_SYMBOLS = np.zeros(256, dtype=np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1
_LETTERS = np.zeros(256, dtype=np.int64)  #: ASCII letters and digits, and the lead byte of any other character
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(0xC2, 0xF5)]] = 1
_ARROW = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "script": pa.string(),
    "n_tokens": pa.int64(), **{k: pa.float64() for k in FIGURES},
}
_SQL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, n_tokens long, " + ", ".join(f"{k} double" for k in FIGURES)


def repeated(w: Words, n: int = WINDOW) -> np.ndarray:
    """Of each document, how many words lie in n-word windows that it has twice or more."""
    first = np.flatnonzero(w.room(n))
    if not len(first):
        return np.zeros(len(w), dtype=np.int64)
    key = windows(w.hash, n)[first] ^ mix(w.doc()[first].astype(np.uint64) + np.uint64(1))
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    start = first[count[back] > 1]
    step = np.zeros(len(w.hash) + 1, dtype=np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + n, -1)
    gone = np.concatenate(([0], np.cumsum(np.cumsum(step[:-1]) > 0)))
    return gone[w.off[1:]] - gone[w.off[:-1]]


def _dup_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            n += line in seen
            seen.add(line)
    return n


def entropies(ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of each document, the mean over equal blocks of its ids of a block's entropy over its largest possible value, log2 of its length."""
    n = np.diff(off)
    blocks = -(-n // BLOCK)
    base = np.concatenate(([0], np.cumsum(blocks)))
    # The first n % blocks blocks have one id more than the others.
    with np.errstate(divide="ignore", invalid="ignore"):
        size, larger = np.where(blocks, n // np.maximum(blocks, 1), 0), np.where(blocks, n % np.maximum(blocks, 1), 0)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(ids)) - np.repeat(off[:-1], n)
    edge = (larger * (size + 1))[doc]
    which = np.where(place < edge, place // (size[doc] + 1), larger[doc] + (place - edge) // np.maximum(size[doc], 1))
    block = base[doc] + which
    key, count = np.unique((block << 20) | ids.astype(np.int64), return_counts=True)
    length = np.bincount(block, minlength=base[-1]).astype(np.float64)
    total = np.bincount(key >> 20, weights=count * np.log2(count), minlength=base[-1])
    one = np.where(length > 1, (np.log2(np.maximum(length, 1)) - total / np.maximum(length, 1)) / np.log2(np.maximum(length, 2)), 0.0)
    mean = np.bincount(np.repeat(np.arange(len(n)), blocks), weights=one, minlength=len(n)) / np.maximum(blocks, 1)
    return np.minimum(np.maximum(mean, 0.0), 1.0)  # ids that all differ may round to more


def text_statistics(col: pa.Array, piece_path: str, byte_path: str) -> Iterator[tuple[int, dict[str, list]]]:
    """First row, and the columns of _ARROW, for chunks of whole documents."""
    first, second, names = pieces(piece_path), byte_level(byte_path), script_names()
    data, off = text_bytes(col)
    for w in words(col, BLANK, CHUNK):
        at = off[w.row : w.row + len(w) + 1] - off[w.row]

        def sums(x: np.ndarray, edge: np.ndarray = at) -> np.ndarray:
            s = np.concatenate(([0], np.cumsum(x)))
            return s[edge[1:]] - s[edge[:-1]]

        blank = (w.data == 32) | ((w.data >= 9) & (w.data <= 13))
        chars, letters = sums(~blank & ((w.data & 0xC0) != 0x80)), sums(_LETTERS[w.data])
        ids, n = first.encode(w)
        tok = np.concatenate(([0], np.cumsum(n)))[w.off]
        n_tokens, others = np.diff(tok), sums(second.encode(w)[1], w.off)
        least = np.maximum(np.minimum(n_tokens, np.where(others > 0, others, n_tokens)), 1)
        doc = np.repeat(np.arange(len(w)), np.diff(at))
        by = np.bincount(doc * 256 + scripts_of_bytes(w.data), minlength=256 * len(w)).reshape(len(w), 256)[:, 1:]
        script = np.where(by.max(axis=1) > 0, by.argmax(axis=1), -1)
        lines = [_dup_lines(w.data[at[i] : at[i + 1]].tobytes()) for i in range(len(w))]
        yield w.row, {
            "n_words": np.diff(w.off), "word_chars": chars, "n_symbols": sums(_SYMBOLS[w.data]), "n_dup_lines": lines, "n_repeat_words": repeated(w),
            "script": [names[i] if i >= 0 else "other" for i in script], "n_tokens": n_tokens, "chars_per_token": chars / least, "letters_per_token": letters / least,
            "byte_share": sums(first.is_byte[ids], tok) / np.maximum(n_tokens, 1), "entropy": entropies(ids, tok),
        }


def _measure(piece_path: str, byte_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, cols in text_statistics(batch.column("text"), piece_path, byte_path):
                made = [pa.array(cols[k], t) for k, t in _ARROW.items()]
                n = len(cols["n_words"])
                more, names = carried_part(batch, row, n, ["doc_id", *_ARROW])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, n), *made, *more], names=names)

    return run


def quality_rules(docs: DataFrame, vocab: str | None = None, bands: dict[str, Band] = BANDS, carry: bool = False, byte_vocab: str | None = None) -> DataFrame:
    """doc_id, the counts, base_failed, kept, script, n_tokens, the four figures and ``rejected_by`` (names of failed rules).

    docs: doc_id (a whole number), text; more columns are ignored.  vocab: path of a
    sentencepiece model with byte fallback (piece_bpe_32k.model if left out), which n_tokens, byte_share and entropy
    are of; byte_vocab: of tiktoken ranks (byte_bpe_multi_50k.tiktoken), which takes words of over 1000 characters in parts of so many.  Words are runs of non-blank characters.
    base_failed: fewer than 20 words, or over 30 % of the words in 8-word windows
    that the text has twice or more.  kept: not base_failed, and all figures in the band of the script of
    most letters (of ``other``, if it has none of its own).
    A null, empty or blank text has no words, so it fails.  Rows that repeat a doc_id
    are judged each on its own text.  An empty table gives an empty result.
    carry: add all columns of docs, as a struct ``carried``.
    """
    prepare(docs.sparkSession)
    docs, more = with_carried(docs, carry, ("doc_id", "bigint"), ("text", "string"))
    paths = vocab or vocabulary("piece_bpe_32k.model"), byte_vocab or vocabulary("byte_bpe_multi_50k.tiktoken")
    got = docs.mapInArrow(_measure(*paths), _SQL + more)
    failed = [F.when(F.col("n_words") < LEAST_WORDS, "few_words"), F.when(100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"), "repeats")]
    base = F.coalesce(F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words"), F.lit(False))
    known = [s for s in bands if s != "other"]
    for name in FIGURES:
        out = F.lit(False)
        for script, band in bands.items():
            low, high = getattr(band, name)
            mine = F.col("script") == script if script in known else ~F.col("script").isin(*known)
            out = out | (mine & ~F.col(name).between(low, high))
        failed.append(F.when(out, name))
    got = got.withColumn("rejected_by", F.array_compact(F.array(*failed))).withColumn("base_failed", base)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return got.select("doc_id", *counts, "base_failed", (F.size("rejected_by") == 0).alias("kept"), "script", "n_tokens", *FIGURES, "rejected_by", *["carried"] * carry)
