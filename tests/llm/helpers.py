"""Brute-force versions of the llm operators' contracts."""

import hashlib
import re
from collections import Counter, defaultdict

BLANK, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def near_groups(docs, k, percent):
    """[(doc_id, text)] -> rows (doc_id, n_shingles, component_id)."""
    sets = []
    for _, text in docs:
        w = BLANK.findall(low(text))
        sets.append({tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= percent * (len(a) + len(sets[j]) - n):
                up[root(i)] = root(j)
    least = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least[root(i)], d)
    return [(d, len(sets[i]), least[root(i)] if root(i) in least else None) for i, (d, _) in enumerate(docs)]


def cut(docs, n=50):
    """[(doc_id, text)] -> rows (doc_id, n_words, n_removed, kept_sha256)."""
    first, out = {}, []
    toks = [BLANK.findall(t or "") for _, t in docs]
    for (d, _), w in zip(docs, toks, strict=True):
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    for (d, _), w in zip(docs, toks, strict=True):
        gone = set()
        for i in range(len(w) - n + 1):
            if d is not None and first[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def hits(docs, items, n=8):
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    known, lengths = defaultdict(set), set()
    for i, t in items:
        w = ALNUM.findall(low(t))
        m = min(n, len(w))
        if m:
            lengths.add(m)
            for a in range(len(w) - m + 1):
                known[tuple(w[a : a + m])].add(i)
    out = []
    for d, t in docs:
        w, hit, its = ALNUM.findall(low(t)), set(), set()
        for m in lengths:
            for a in range(len(w) - m + 1):
                if (x := known.get(tuple(w[a : a + m]))) is not None:
                    hit.update(range(a, a + m))
                    its |= {str(i) for i in x if i is not None}
        out.append((d, len(w), len(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(), len(its) >= 2))
    return out


def base_rules(docs):
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    out = []
    for d, t in docs:
        t = t or ""
        w = BLANK.findall(t)
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        rep = {k for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if BLANK.search(line):
                dup += line in seen
                seen.add(line)
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)))
    return out
