"""Public tokenizers by their files, over whole chunks of documents.

Their ids never span white space, so a text's ids are its blank-separated
words' ids, one after another, and each different word of a chunk is encoded once.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from ._words import Words, hash_runs, spread



def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; callers may give their own paths instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


_NONE = np.int32(np.iinfo(np.int32).max)
LONG = 1000  #: characters of a word that a byte-level vocabulary encodes at once, its merging being quadratic in them
KNOWN = 300_000  #: different words that an encoder remembers, the first it meets; about 20 MB


class _Merges:
    """Merge rank and result of a pair of ids, in a hash table that is read for whole arrays."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray, results: np.ndarray) -> None:
        self.bits = max(4, int(len(pairs) * 8 - 1).bit_length())
        size = 1 << self.bits
        self.key, self.rank = np.full(size, -1, dtype=np.int64), np.full(size, _NONE, dtype=np.int32)
        self.result = np.zeros(len(pairs), dtype=np.int32)
        self.result[ranks] = results
        todo, value, self.probes = pairs, ranks, 0
        while len(todo):  # each round places those whose slot is free, the rest moves on by one
            at = (self._slot(todo) + self.probes) & (size - 1)
            free = self.key[at] < 0
            at, idx = at[free], np.flatnonzero(free)
            _, first = np.unique(at, return_index=True)
            self.key[at[first]], self.rank[at[first]] = todo[idx[first]], value[idx[first]]
            rest = np.ones(len(todo), dtype=bool)
            rest[idx[first]] = False
            todo, value = todo[rest], value[rest]
            self.probes += 1

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or _NONE; ids of -1 have no merge."""
        pairs = (left.astype(np.int64) << 20) | right
        slot = self._slot(pairs)
        key = self.key[slot]
        hit = (key == pairs) & (left >= 0) & (right >= 0)
        out = np.where(hit, self.rank[slot], _NONE)
        todo = np.flatnonzero((key >= 0) & ~hit)  # an empty slot ends the search
        for p in range(1, self.probes):
            if not len(todo):
                break
            at = (slot[todo] + p) & ((1 << self.bits) - 1)
            key, want = self.key[at], pairs[todo]
            hit = key == want
            out[todo[hit]] = self.rank[at[hit]]
            todo = todo[(key >= 0) & ~hit]
        return out


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte (a fixed rule)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class WordBpe:
    """A ``tokenizers`` BPE file with word ends, lower case and dropped white space, applied to chunks of words.

    Words of ASCII and Latin-1 letters, digits and plain punctuation are cut
    and merged as arrays, by the file's own merge ranks; every other word goes through the library.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.size = self.lib.get_vocab_size()
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], dtype=np.int32)
        self.last = np.array([vocab.get(c + end, -1) for c in letters], dtype=np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        pairs = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], dtype=np.int64)
        pairs, first = np.unique(pairs, return_index=True)
        self.merges = _Merges(pairs, np.argsort(np.argsort(first)), np.array([vocab[merges[i][0] + merges[i][1]] for i in first], dtype=np.int64))
        plain = np.zeros(256, dtype=bool)
        plain[33:127] = plain[0x80:0xC0] = True
        plain[[0x27, 0x3C]] = False  # contractions and special tokens start so
        plain[0xC3] = True  # the lead byte of U+00C0 to U+00FF
        self.plain = plain
        self.known = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)  # sorted hashes, offsets, counts, ids

    def _library(self, word: bytes) -> np.ndarray:
        return np.array(self.lib.encode(word.decode(), add_special_tokens=False).ids, dtype=np.int64)

    def _merge(self, data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of bytes that lie one after another, and how many each run has."""
        start = np.cumsum(length) - length
        count, flat = np.zeros(len(length), np.int64), np.zeros(len(data), np.int32)  # never more ids than bytes
        order = np.argsort(length, kind="stable")
        at = 0
        while at < len(order):
            width = max(4, 1 << int(length[order[at]] - 1).bit_length())
            to = int(np.searchsorted(length[order], width, side="right"))
            for part in np.array_split(order[at:to], max(1, (to - at) * width // (1 << 19))):
                self._merge_block(data, start, length, part, int(length[part].max()), flat, count)
            at = to
        keep = spread(start, count)
        return flat[keep], count

    def _merge_block(self, data, start, length, rows, width, flat, count) -> None:
        n, cols = length[rows], np.arange(width, dtype=np.int32)
        place = np.minimum(start[rows][:, None] + cols, len(data) - 1)
        raw = data[place]
        ids = np.where(cols == n[:, None] - 1, self.last[raw], self.inner[raw])
        ids[cols >= n[:, None]] = -1
        got = np.empty((len(rows), width), np.int32)
        size = n.copy()
        live = np.arange(len(rows))
        rank = self.merges.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1) if width > 1 else np.zeros((len(rows), 0), np.int32)
        while len(live):
            if rank.shape[1]:
                spot = rank.argmin(axis=1)
                best = rank[np.arange(len(live)), spot]
                done = best == _NONE
            else:
                done = np.ones(len(live), bool)
            if done.any():
                got[live[done]] = ids[done]
                go = ~done
                live, ids, rank = live[go], ids[go], rank[go]
                if not len(live):
                    break
                spot, best = spot[go], best[go]
            r = np.arange(len(live))
            ids[:, :-1] = np.where(cols[None, :-1] > spot[:, None], ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ids[r, spot] = self.merges.result[best]
            rank[:, :-1] = np.where(cols[None, : width - 2] >= spot[:, None], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = _NONE
            for side in (spot - 1, spot):  # the pairs that the new id is part of
                ok = (side >= 0) & (side < width - 1)
                rank[r[ok], side[ok]] = self.merges.find(ids[r[ok], side[ok]], ids[r[ok], side[ok] + 1])
            size[live] -= 1
        flat[spread(start[rows], size)] = got[cols < size[:, None]]
        count[rows] = size

    def _plain_words(self, data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and how many, of plain words that lie one after another."""
        low = data.copy()
        low[(low >= 65) & (low < 91)] += 32
        high = np.zeros(len(low), bool)
        high[1:] = low[:-1] == 0xC3
        low[high & (low >= 0x80) & (low < 0x9F)] += 32
        digit = (low >= 48) & (low < 58)
        kind = np.where(((low >= 97) & (low < 123)) | (low >= 128), 1, np.where(digit, 2, 3))
        start = np.cumsum(length) - length
        first = np.zeros(len(low), bool)
        first[start] = True
        first[1:] |= (kind[1:] != kind[:-1]) | digit[1:]
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, len(low)))
        h, one, back = np.unique(hash_runs(low, size), return_index=True, return_inverse=True)
        known, at, have, flat = self.known
        spot = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
        old = known[spot] == h if len(known) else np.zeros(len(h), bool)
        new = np.flatnonzero(~old)
        made, count = self._merge(low[spread(begin[one[new]], size[one[new]])], size[one[new]])
        n, off = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        n[old], off[old] = have[spot[old]], at[spot[old]]
        n[new], off[new] = count, len(flat) + np.cumsum(count) - count
        flat = np.concatenate([flat, made])
        ids = flat[spread(off[back], n[back])]
        if len(known) < KNOWN and len(new):
            order = np.argsort(merged := np.concatenate([known, h[new]]))
            self.known = merged[order], np.concatenate([at, off[new]])[order], np.concatenate([have, count])[order], flat
        per_word = np.add.reduceat(n[back], np.searchsorted(begin, start)) if len(start) else start
        return ids, per_word

    def encode(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of a chunk, one after another, and how many each word has."""
        if not len(w.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        _, one, back = np.unique(w.hash, return_index=True, return_inverse=True)
        start, length = w.start[one], w.end[one] - w.start[one]
        data = w.data[spread(start, length)]
        off = np.cumsum(length) - length
        odd = ~self.plain[data]
        odd[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        # A continuation byte is plain only after 0xC3; other lead bytes aren't plain themselves.
        is_plain = ~np.logical_or.reduceat(odd, off) & (length <= 2 * LONG)  # merging as arrays is quadratic in a word's length
        yes, no = np.flatnonzero(is_plain), np.flatnonzero(~is_plain)
        ids, count = self._plain_words(data[spread(off[yes], length[yes])], length[yes]) if len(yes) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        slow = [self._library(data[off[i] : off[i] + length[i]].tobytes()) for i in no]
        n = np.zeros(len(one), np.int64)
        n[yes], n[no] = count, [len(x) for x in slow]
        at = np.zeros(len(one), np.int64)
        at[yes] = np.cumsum(count) - count
        at[no] = len(ids) + np.cumsum(n[no]) - n[no]
        ids = np.concatenate([ids, *slow]) if slow else ids
        return ids[spread(at[back], n[back])], n[back]

    def documents(self, w: Words, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each document followed by ``end``, one after another, and their offsets."""
        ids, n = self.encode(w)
        total = np.concatenate(([0], np.cumsum(n)))
        size = total[w.off[1:]] - total[w.off[:-1]] + 1
        off = np.concatenate(([0], np.cumsum(size)))
        out = np.full(int(off[-1]), end, dtype=self.kind)
        inside = np.ones(len(out), bool)
        inside[off[1:] - 1] = False
        out[inside] = ids
        return out, off


class Remembered:
    """An encoder of single words with a memory of the first KNOWN different ones; each word of a chunk is encoded once."""

    kind = np.dtype("<u2")

    def __init__(self) -> None:
        self.known = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)  # sorted hashes, offsets, counts, ids

    def some(self, new: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def encode(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of a chunk, one after another, and how many each word has."""
        if not len(w.hash):
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        h, one, back = np.unique(w.hash, return_index=True, return_inverse=True)
        known, at, have, flat = self.known
        spot = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
        old = known[spot] == h if len(known) else np.zeros(len(h), bool)
        new = np.flatnonzero(~old)
        data = w.data.tobytes()
        made = self.some([data[a:b].decode() for a, b in zip(w.start[one[new]].tolist(), w.end[one[new]].tolist(), strict=True)])
        count = np.array([len(x) for x in made], dtype=np.int64)
        n, off = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        n[old], off[old] = have[spot[old]], at[spot[old]]
        n[new], off[new] = count, len(flat) + np.cumsum(count) - count
        flat = np.concatenate([flat, np.fromiter((i for x in made for i in x), self.kind, int(count.sum()))])
        if len(known) < KNOWN and len(new):
            order = np.argsort(merged := np.concatenate([known, h[new]]), kind="stable")  # two sorted runs
            self.known = merged[order], np.concatenate([at, off[new]])[order], np.concatenate([have, count])[order], flat
        return flat[spread(off[back], n[back])], n[back]


class Pieces(Remembered):
    """A sentencepiece model of under 65,536 ids, of words on their own."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        super().__init__()
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.lib.is_byte(i) for i in range(self.lib.vocab_size())])

    def some(self, new: list[str]) -> list[list[int]]:
        return self.lib.encode(new, num_threads=1) if new else []


class ByteLevel(Remembered):
    """A byte-level vocabulary by a file of ranks, of words with a blank before them."""

    def __init__(self, path: str) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.lib = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def some(self, new: list[str]) -> list[list[int]]:
        one = self.lib.encode_ordinary
        return [one(f" {x}") if len(x) <= LONG else [i for at in range(0, len(x), LONG) for i in one(f" {x[:LONG]}" if not at else x[at : at + LONG])] for x in new]


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=4)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)
