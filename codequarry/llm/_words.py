"""Vectorised words, word hashes and word-window hashes over Arrow text columns.

Texts are handled as UTF-8 bytes: every separator these operators use is
ASCII, so a word is a run of non-separator bytes.  No Python object is made per
word.  A batch is cut into chunks of about ``CHUNK_BYTES`` whole documents, so
memory follows the longest document, never the batch.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_MIX1, _MIX2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BYTE_BASE = np.uint64(0xD6E8FEB86659FD93)
_WORD_BASE, _WORD_BASE_INV = np.uint64(0xCA5A826395121157), np.uint64(pow(0xCA5A826395121157, -1, 1 << 64))


def separators(is_word: str, lower: bool = False) -> np.ndarray:
    """Byte table: 0 where a byte separates words, else the byte to hash.

    ``is_word`` is "blank" (words are runs of bytes outside space and
    \\t..\\r) or "alnum" (runs of 0-9, a-z and non-ASCII; use with ``lower``).
    """
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    if is_word == "blank":
        t[[32, 9, 10, 11, 12, 13]] = 0
        t[0] = 255  # NUL is a word byte; 255 never occurs in UTF-8
    else:
        keep = np.zeros(256, dtype=bool)
        keep[48:58] = keep[97:123] = keep[128:] = True
        t = np.where(keep[t], t, 0).astype(np.uint8)
    return t


BLANK, BLANK_LOWER, ALNUM_LOWER = separators("blank"), separators("blank", True), separators("alnum", True)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64; kept and grown by doubling."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(1024, 1 << int(n - 1).bit_length()), base, dtype=np.uint64)
        have[0] = 1
        _powers[int(base)] = have = np.multiply.accumulate(have)
    return have[:n]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, .. start+length-1 of each range, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total, dtype=np.int64) + shift


@dataclass
class Words:
    """Words of some whole documents: document i has words off[i] .. off[i+1]-1."""

    row: int  #: the first document's row in its batch
    data: np.ndarray  #: the documents' bytes
    start: np.ndarray  #: byte range of each word
    end: np.ndarray
    off: np.ndarray
    hash: np.ndarray

    def __len__(self) -> int:
        return len(self.off) - 1

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.off))

    def room(self, n: int) -> np.ndarray:
        """Of each word, whether a window of n words of its document starts there."""
        last = np.repeat(self.off[1:], np.diff(self.off))
        return np.arange(len(self.hash)) + n <= last

    def text(self, i: int) -> bytes:
        """Document i's words, joined by one space."""
        data = self.data
        return b" ".join([data[s:e].tobytes() for s, e in zip(self.start[self.off[i] : self.off[i + 1]], self.end[self.off[i] : self.off[i + 1]], strict=True)])


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a text column; null counts as empty."""
    col = col.cast(pa.large_binary()).fill_null(b"") if col.null_count else col.cast(pa.large_binary())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=len(col) + 1 + col.offset)[col.offset :] if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def chunks(off: np.ndarray, most: int = 0) -> Iterator[tuple[int, int]]:
    """Row ranges of about so many bytes (CHUNK_BYTES); a longer document is a range of its own."""
    most, a, n = most or CHUNK_BYTES, 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def hash_runs(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes; the runs lie one after another in values."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(values), dtype=np.int64) - np.repeat(first, lengths)
    terms = powers(_BYTE_BASE, int(lengths.max()))[place]
    terms *= values.astype(np.uint64)
    return mix(np.add.reduceat(terms, first) ^ lengths.astype(np.uint64) * _GOLD)


def words(col: pa.Array, table: np.ndarray, most: int = 0) -> Iterator[Words]:
    """The words of a text column, in chunks of whole documents of about ``most`` bytes."""
    data, off = text_bytes(col)
    for a, b in chunks(off, most):
        lo, hi = int(off[a]), int(off[b])
        part, at = data[lo:hi], (off[a : b + 1] - lo).astype(np.int64)
        seen = table[part]
        is_word = seen != 0
        before = np.zeros(len(part), dtype=bool)
        before[1:] = is_word[:-1]
        edge = at[:-1][at[:-1] < len(part)]
        before[edge] = False
        start = np.flatnonzero(is_word & ~before)
        after = np.zeros(len(part), dtype=bool)
        after[:-1] = is_word[1:]
        edge = at[1:][at[1:] > 0] - 1
        after[edge] = False
        end = np.flatnonzero(is_word & ~after) + 1
        yield Words(a, part, start, end, np.searchsorted(start, at).astype(np.int64), hash_runs(seen[is_word], end - start))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on; of the last n-1, no meaning. Callers mask with Words.room."""
    k = len(h)
    out = np.zeros(k, dtype=np.uint64)
    if k < n:
        return out
    total = np.zeros(k + 1, dtype=np.uint64)
    np.cumsum(h * powers(_WORD_BASE, k), out=total[1:])
    out[: k - n + 1] = mix((total[n:] - total[: k - n + 1]) * powers(_WORD_BASE_INV, k - n + 1) + np.uint64(n))
    return out


#: UTF-8 lead bytes whose characters are of one script (fixed by Unicode's blocks); letters of ASCII count as Latin.
_LEADS = {
    "latin": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)], "greek": [0xCE, 0xCF], "cyrillic": [*range(0xD0, 0xD4)],
    "hebrew": [0xD7], "arabic": [*range(0xD8, 0xDC)], "han": [*range(0xE4, 0xEA)], "hangul": [0xEB, 0xEC], "kana": [],
}
_BY_LEAD = np.zeros(256, dtype=np.uint8)
for _n, _bytes in enumerate(_LEADS.values(), 1):
    _BY_LEAD[_bytes] = _n
#: Lead bytes that tell no script alone: the code point is looked up.
_BY_CODE = (_BY_LEAD == 0) & (np.arange(256) >= 0xC3)


@lru_cache(1)
def _scripts() -> tuple[np.ndarray, list[str]]:
    """Script number of each letter by code point (0: no letter), and the scripts' names from number 1 on.

    A script is the first word of a letter's Unicode name; no letter is without one.
    """
    known = {x.upper(): i for i, x in enumerate(_LEADS, 1)}
    number = known | dict.fromkeys(("HIRAGANA", "KATAKANA", "HALFWIDTH"), known["KANA"]) | dict.fromkeys(("CJK", "KANGXI", "IDEOGRAPHIC", "BOPOMOFO"), known["HAN"])
    number["FULLWIDTH"] = known["LATIN"]
    names, out = [*_LEADS], np.zeros(0x110000, dtype=np.uint8)
    for c in [*range(0x250, 0x4000), *range(0xA000, 0xAC00), *range(0xD000, 0x32400)]:
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            name = unicodedata.name(chr(c), "OTHER").split(" ")[0]
            if name not in number:
                number[name] = min(len(names) + 1, 255)
                names = [*names, name.lower()][:255]
            out[c] = number[name]
    return out, names


def script_names() -> list[str]:
    return _scripts()[1]


def scripts_of_bytes(data: np.ndarray) -> np.ndarray:
    """Script number of the character that starts at each byte; 0 where none does, or it is no letter."""
    out = _BY_LEAD[data]
    at = np.flatnonzero(_BY_CODE[data])
    if len(at):
        b = np.append(data, np.zeros(3, np.uint8)).astype(np.uint32)
        x, y, z, u = (b[at + k] for k in range(4))
        y, z, u = y & 63, z & 63, u & 63
        code = np.where(x < 0xE0, (x & 31) << 6 | y, np.where(x < 0xF0, (x & 15) << 12 | y << 6 | z, (x & 7) << 18 | y << 12 | z << 6 | u))
        out[at] = _scripts()[0][np.minimum(code, 0x10FFFF)]
    return out
