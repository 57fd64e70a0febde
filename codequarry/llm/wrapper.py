"""HTML main text by union-free wrappers (operator 1).

A page is a tree of block elements and text slots.  Wrappers are trees of the same kind whose members
may be optional or repeated and whose texts are slots; no member is an alternative of another, so a
wrapper is a union-free regular expression over tags and texts (``show`` writes it).

1. *Constants.*  A text that stands at one place (path of elements) on three different pages of a host or more,
   and on three quarters of those that have the place, is a constant of the host's template; any other is a slot.
2. *Folding.*  Siblings of one page that are alike become one repeated member, what only some of them
   have becomes optional; members between two of them become one repeated group with them.
3. *Alignment.*  The different folded streams of a host are aligned with one another, best fit first, the
   commonest stream first: what both have is kept, what one lacks becomes optional, a member that comes
   in another order or again joins a repeated group, and different words of one element's class give way
   to those both have.  Each slot sums up how much text and how much link text all its pages have there.
4. *Choice*, once for a host and on the wrapper alone: the main region is the element that holds the
   repeated slots of most running text (an element that calls itself article or main comes first), its slots
   are main text, its constants and its repeated slots of links aren't.
5. *Extraction.*  Each page is folded and laid on its host's wrapper, and its texts in main slots are its text.

Elements that name themselves as no part of an article (nav, footer, class="ad", ...) are a fixed list of
names and words; they are left out of streams, so it is the wrapper that judges all other parts.

Streams are counted before they are gathered and merged in two steps (parts of a host, then hosts): no
task holds all pages of a large host.  A page of any size takes part: deeper elements than DEPTH are
siblings, as browsers have it, and no path is kept as text, so memory follows the page's length.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import drop, only, prepare, save

PARTS = 32  #: of a host, merged on their own first
DEPTH = 200  #: open elements; deeper ones are siblings
ALIKE = 0.5  #: share of children and grandchildren that siblings have in common to be repeats of one member
COMBINED = 5000  #: streams that a task counts at once

#: Comments and raw-text elements, which run to the page's end if nothing closes them.
_RAW = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?\]\]>|<(script|style|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I
)
DROPPED = frozenset("noscript template svg iframe select object canvas".split())
_ANY_DROPPED = re.compile(rf"<(?:{'|'.join(sorted(DROPPED))})\b", re.I)
_SELF_CLOSED = re.compile(r"(?:[\s\"']|<[a-zA-Z][a-zA-Z0-9-]*)/>$")
_TAG = re.compile(r"(<(?:/?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*|[!?][^>]*)>)")
_PARTS = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9-]*)")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_ARTICLE = frozenset("nav header footer aside form head title button dialog menu".split())
_BAD_WORDS = re.compile(
    r"(?:^|[\s._-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|header|masthead|footer|foot"
    r"|side-?bar|aside|cookies?|consent|notices?|gdpr|popup|modal|newsletter|subscribe|signup|login|share|sharing|social"
    r"|related|recommend\w*|comments?|commentlist|disqus|respond|reviews?|replies|widget|toolbar|skip|search|pagination"
    r"|pager|copyright)(?=$|[\s._-]|\d)",
    re.I,
)
_SERIAL = re.compile(r"[0-9a-f]*\d[0-9a-f]{5,}|\d+", re.I)  #: numbers and long hexadecimal keys
_SAYS_NOT = re.compile(r"(?:^|(?<=\.))(?:has|no|with|without|is)-[\w-]+", re.I)
_CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li"]), "tr": frozenset("tr td th".split()), "td": frozenset("td th".split()),
    "th": frozenset("td th".split()), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "option": frozenset(["option"]),
}
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "nav ol p pre section table ul".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_FLOW = _HEADING | frozenset("p ul ol dl li dt dd blockquote pre figure".split())  #: parts of a text, no places for one

REPEATED, OPTIONAL, GROUPED = 1, 2, 4  #: marks of a member; neighbours that are GROUPED are one repeated group
NO, MAIN, TEMPLATE = 0, 1, 2  #: verdicts on slots; TEMPLATE: a constant within the main region


@lru_cache(100_000)
def _about(sign: str) -> tuple[str, bool, bool]:
    """Of an element (name.words): its name, whether it calls itself an article, and whether it is no part of one."""
    name, _, words = sign.partition(".")
    article = name in ("article", "main") or "articlebody" in words
    page_wide = name in ("html", "body", "article", "main")
    wrong = name in NOT_ARTICLE or not page_wide and bool(words) and bool(_BAD_WORDS.search(_SAYS_NOT.sub("", words)))
    return name, article, wrong


@lru_cache(100_000)
def _number(text: str) -> int:
    """A stable 63-bit number of a text."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big") >> 1


class Node:
    """An element or a text slot, of a page or of a wrapper.

    sign: ``name.words`` of an element, ``#`` of a slot, ``=`` with a number of a constant.
    at: numbers of the page's texts that stand here.
    """

    __slots__ = ("sign", "name", "mark", "kids", "key", "has", "at", "chars", "links", "verdict")

    def __init__(self, sign: str, mark: int = 0, kids: list[Node] | None = None) -> None:
        self.sign, self.mark, self.kids, self.at = sign, mark, kids or [], []
        self.name = sign if sign[0] in "#=" else _about(sign)[0]
        self.chars = self.links = self.verdict = 0

    @property
    def is_text(self) -> bool:
        return self.sign[0] in "#="

    def finish(self) -> Node:
        """Shape, and what siblings are compared by: children and grandchildren."""
        self.key = hash((self.sign, *[k.key for k in self.kids]))
        self.has = frozenset([k.name for k in self.kids] + [f"{k.name}>{g.name}" for k in self.kids for g in k.kids])
        return self

    def texts(self) -> Iterator[Node]:
        """Slots and constants in order."""
        todo = [self]
        while todo:
            x = todo.pop()
            if x.is_text:
                yield x
            todo.extend(reversed(x.kids))


def _without_dropped(tokens: list[str]) -> list[str]:
    """Texts and tags without the elements of DROPPED: those that end themselves, or whose parent ends before them, are empty."""
    open_: list[tuple[str, int]] = []
    count: dict[str, int] = {}
    gone: list[tuple[int, int]] = []
    for i in range(1, len(tokens), 2):
        m = _PARTS.match(tokens[i])
        if not m:
            continue
        name = m[1].lower()
        if tokens[i][1] == "/":
            while count.get(name):
                last, at = open_.pop()
                count[last] -= 1
                if last == name:
                    if name in DROPPED:
                        gone.append((at, i))
                    break
        elif name in DROPPED and not _SELF_CLOSED.search(tokens[i]) or name not in DROPPED and name not in VOID:
            open_.append((name, i))
            count[name] = count.get(name, 0) + 1
    keep, at = [], 0
    for first, last in sorted(gone):
        if first >= at:
            keep += [*tokens[at : first - 1], tokens[first - 1] + " ", ""]
            at = last + 1
    keep += tokens[at:]
    for i in range(1, len(keep), 2):
        m = _PARTS.match(keep[i])
        if m and m[1].lower() in DROPPED:
            keep[i - 1 : i + 1] = [keep[i - 1] + " ", ""]
    return keep


class Page:
    """A page's tree, its texts as they came, how much of each is in links, and the place of each (its path's number)."""

    def __init__(self, page: str) -> None:
        self.root = Node("page")
        self.texts: list[list[str]] = []
        self.links: list[int] = []
        self.places: list[int] = []
        stack: list[tuple[str, Node | None, int]] = [("", self.root, 0)]  # name, node (None: left out), place
        open_: dict[str, int] = {}
        slot, node, links = None, self.root, 0
        page = _RAW.sub(" ", page)
        tokens = _TAG.split(page)

        def close(n: int) -> None:
            for name, _, _ in stack[n:]:
                open_[name] -= 1
            del stack[n:]

        def end_slot() -> None:
            if any(x.strip() for x in slot):
                text = Node("#")
                text.at = [len(self.texts)]
                node.kids.append(text)
                self.texts.append(slot)
                self.links.append(linked)
                self.places.append(place)

        place = linked = 0
        for i, token in enumerate(_without_dropped(tokens) if _ANY_DROPPED.search(page) else tokens):
            if not i % 2:
                if token and stack[-1][1] is not None:
                    if slot is None:
                        _, node, place = stack[-1]
                        slot, linked = [], 0
                    slot.append(token)
                    if links and token.strip():
                        linked += len(token)
                continue
            m = _PARTS.match(token)
            if not m:
                continue
            name = m[1].lower()
            if name in INLINE:
                links = max(0, links + (-1 if token[1] == "/" else 1)) if name == "a" else links
                continue
            if slot is not None:
                if name == "br":
                    slot.append(" ")
                    continue
                end_slot()
                slot = None
            if token[1] == "/":
                if open_.get(name):
                    at = len(stack) - 1
                    while stack[at][0] != name:
                        at -= 1
                    close(at)
                links = 0
                continue
            if name in VOID:
                continue
            shut = _CLOSES.get(name, ())
            top = stack[-1][0]
            if len(stack) > 1 and (top in shut or top == "p" and name in _ENDS_P):
                close(len(stack) - 1)
            elif len(stack) > 2 and top == "p" and stack[-2][0] in shut:
                close(len(stack) - 2)
            if len(stack) > DEPTH:
                close(DEPTH)
            words = " ".join(a or b or c for a, b, c in _NAMES.findall(token)).strip()
            sign = re.sub(r"\d+", "0", name) if "-" in name else name
            if words:
                words = ".".join(dict.fromkeys(re.sub(r"[^\w-]+", ".", _SERIAL.sub("0", words.lower())).strip(".").split(".")))
                sign += f".{words}"
            _, parent, above = stack[-1]
            mine = None
            if parent is not None:
                mine = Node(sign)
                parent.kids.append(mine)
                if _about(sign)[2]:
                    mine = None
            stack.append((name, mine, (above * 1000003 + _number(sign)) & 0x7FFFFFFFFFFFFFFF))
            open_[name] = open_.get(name, 0) + 1
        if slot is not None:
            end_slot()

    def text(self, i: int) -> str:
        return _squeeze("".join(self.texts[i]))

    def said(self, i: int) -> int:
        """What text i says, and where, as a number."""
        return (self.places[i] * 31 + _number(self.text(i))) & 0x7FFFFFFFFFFFFFFF


def _squeeze(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def _post_order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo.extend(x.kids)
    return out[::-1]


def fold(root: Node) -> Node:
    """A page's tree with alike siblings as repeated members, from the inside out; in place."""
    for x in _post_order(root):
        if x.kids:
            x.kids = absorb(x.kids)
        x.finish()
    return root


def similar(a: Node, b: Node) -> float:
    """Share of children and grandchildren that two elements have in common."""
    if a.key == b.key or a.has == b.has:
        return 1.0
    return len(a.has & b.has) / len(a.has | b.has)


def fit(a: Node, b: Node) -> float:
    """How well two members go together; 0: they can't."""
    if a.key == b.key:
        return 4.0
    if a.name != b.name or a.is_text or _about(a.sign)[1:] != _about(b.sign)[1:]:
        return 0.0
    s = similar(a, b)
    return 1 + 2 * s if a.sign == b.sign else s if s >= ALIKE else 0.0


def absorb(kids: list[Node]) -> list[Node]:
    """Members that are alike as one repeated member; what lies between two of them joins a repeated group."""
    out: list[Node] = []
    by: dict[str, list[int]] = {}
    for x in kids:
        best, at = 0.0, -1
        for i in by.get(x.name, ()):
            f = fit(out[i], x)
            if f > best and (f >= 4 or similar(out[i], x) >= ALIKE):
                best, at = f, i
        if at < 0:
            by.setdefault(x.name, []).append(len(out))
            out.append(x)
            continue
        if at < len(out) - 1 and not (out[at].mark & GROUPED and out[-1].mark & GROUPED):
            for y in out[at:]:
                y.mark |= GROUPED
        merge(out[at], x)
        out[at].mark |= REPEATED
    return out


def merge(a: Node, b: Node) -> None:
    """b's members, marks, texts and sums added to a."""
    a.mark |= b.mark
    if a.is_text:
        a.at += b.at
        a.chars += b.chars
        a.links += b.links
    elif a.key == b.key:
        for x, y in zip(a.kids, b.kids, strict=True):
            merge(x, y)
    else:
        if a.sign != b.sign:
            both = [w for w in a.sign.split(".")[1:] if w in b.sign.split(".")[1:]]
            common = ".".join([a.name, *both])
            a.sign = common if _about(common) == _about(a.sign) else a.sign
        a.kids = align(a.kids, b.kids)
        a.finish()


def align(x: list[Node], y: list[Node]) -> list[Node]:
    """Two lists of members as one: pairs that fit best first, the rest optional."""
    by: dict[str, list[int]] = {}
    for i, a in enumerate(x):
        by.setdefault(a.name, []).append(i)
    pairs = sorted((-f, abs(i - j), i, j) for j, b in enumerate(y) for i in by.get(b.name, ()) if (f := fit(x[i], b)) > 0)
    at_x: dict[int, int] = {}
    at_y: dict[int, int] = {}
    for _, _, i, j in pairs:
        if i not in at_x and j not in at_y:
            at_x[i], at_y[j] = j, i
    last, high = -1, -1
    after: dict[int, list[Node]] = {}
    for j, b in enumerate(y):
        i = at_y.get(j)
        if i is None:
            b.mark |= OPTIONAL
            after.setdefault(last, []).append(b)
            continue
        if i < high:
            for k in range(i, high + 1):
                x[k].mark |= GROUPED
        last, high = i, max(high, i)
        merge(x[i], b)
    out = after.get(-1, [])
    for i, a in enumerate(x):
        if i not in at_x:
            a.mark |= OPTIONAL
        out = [*out, a, *after.get(i, ())] if i in after else out + [a]
    return absorb(out) if after else out


def pack(x: Node, sums: bool = False) -> list:
    if x.is_text:
        return [x.sign, x.mark, x.chars, x.links, x.verdict] if sums else [x.sign, x.mark]
    return [x.sign, x.mark, *[pack(k, sums) for k in x.kids]]


def unpack(got: list) -> Node:
    x = Node(got[0], got[1])
    if not x.is_text:
        x.kids = [unpack(k) for k in got[2:]]
    elif len(got) > 2:
        x.chars, x.links, x.verdict = got[2:]
    return x.finish()


def show(x: Node) -> str:
    """A wrapper as a regular expression: ``<name.words>`` tags, ``#`` slots, ``'...'`` constants, ``?`` ``+`` ``*`` and groups."""
    core = "#" if x.sign == "#" else f"'{x.sign[1:]}'" if x.is_text else f"<{x.sign}>{_show_all(x.kids)}</{x.name}>"
    mark = ("", "+", "?", "*")[x.mark & 3]
    return f"({core}){mark}" if mark else core


def _show_all(kids: list[Node]) -> str:
    out, group = "", []
    for k in [*kids, None]:
        if k is not None and k.mark & GROUPED:
            group.append(show(k) if k.mark & OPTIONAL else f"({show(k)})?")
            continue
        if group:
            out, group = f"{out}({''.join(group)})+", []
        out += show(k) if k is not None else ""
    return out


def choose(root: Node) -> None:
    """Set each slot's verdict, from the tree's marks and sums."""
    prose: dict[int, int] = {}
    repeated: dict[int, bool] = {}  # whether running text stands in a repeated member
    order = _post_order(root)
    for x in order:
        x.verdict = NO
        if x.is_text:
            prose[id(x)] = x.chars - x.links if x.sign == "#" and 2 * x.links < x.chars else 0
            repeated[id(x)] = False
        else:
            prose[id(x)] = sum(prose[id(k)] for k in x.kids)
            repeated[id(x)] = any(repeated[id(k)] or k.mark & REPEATED and prose[id(k)] for k in x.kids)
    for x in order:  # an element without text of any kind but constants counts by those
        if not prose[id(root)] and x.is_text:
            x.verdict = TEMPLATE
    if not prose[id(root)]:
        return
    named = _named(root, prose)
    for top in named or [_region(root, prose, repeated)]:
        todo = [(top, False, False)]
        while todo:
            x, again, heading = todo.pop()
            again = again or bool(x.mark & (REPEATED | GROUPED)) and x is not top
            if x.is_text:
                links = not named and again and not heading and 2 * x.links >= x.chars > 0
                x.verdict = TEMPLATE if x.sign != "#" and not heading else NO if links else MAIN
            for k in x.kids:
                todo.append((k, again, heading or x.name in _HEADING))


def _named(root: Node, prose: dict[int, int]) -> list[Node]:
    """The outermost elements that call themselves article or main and have running text; articles in a main that hold half of it come before it."""
    out: list[Node] = []
    todo = [root]
    while todo:
        x = todo.pop()
        if not x.is_text and _about(x.sign)[1] and prose[id(x)]:
            inner = [y for k in x.kids for y in _named(k, prose)] if x.name == "main" else []
            out += inner if inner and 2 * sum(prose[id(y)] for y in inner) >= prose[id(x)] else [x]
        else:
            todo.extend(x.kids)
    return out


def _region(root: Node, prose: dict[int, int], repeated: dict[int, bool]) -> Node:
    """The innermost element that holds the repeated running text, with what stands beside it."""
    at = root
    while True:
        inner = [k for k in at.kids if k.kids and k.name not in _FLOW]
        best = max(inner, key=lambda k: prose[id(k)], default=None)
        if best is None or 2 * prose[id(best)] <= prose[id(at)] or best.mark & REPEATED and not repeated[id(best)]:
            return at
        rival = any(k is not best and repeated[id(k)] and 4 * prose[id(k)] >= prose[id(best)] for k in inner)
        beside = sum(prose[id(k)] for k in at.kids if k.name in _FLOW)
        if rival or 10 * beside > prose[id(at)]:
            return at
        at = best


def place(page: Node, wrapper: Node) -> None:
    """Give each slot of a folded page the verdict of the wrapper's slot that it lies on; what fits nowhere is no main text."""
    todo = [(page, wrapper)]
    while todo:
        a, b = todo.pop()
        for k in a.kids:
            fits = [(f, -i) for i, w in enumerate(b.kids) if (f := fit(w, k) or (1.0 if w.is_text and k.is_text else 0)) > 0]
            if fits:
                at = b.kids[-max(fits)[1]]
                if k.is_text:
                    k.verdict = at.verdict
                else:
                    todo.append((k, at))


def _mark_constants(page: Page, constants: frozenset[int]) -> None:
    if constants:
        for t in page.root.texts():
            said = page.said(t.at[0])
            if said in constants:
                t.sign = t.name = f"={said:x}"


def main_text(html: str | None, wrapper: list | None = None, constants: frozenset[int] = frozenset()) -> str:
    """Main text of a page by its host's packed wrapper.

    A page without text in the wrapper's main slots (or without a wrapper) is its own wrapper.  Constants of the
    main region are left out unless they are all of its text: then the page is a copy of others.
    """
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))
    page = Page(html or "")
    if not page.texts:
        return ""
    _mark_constants(page, constants)
    root = fold(page.root)

    def chosen() -> str:
        own, fixed = [], []
        for t in root.texts():
            if t.verdict:
                (own if t.verdict == MAIN else fixed).extend(t.at)
        kept = [page.text(i) for i in sorted(own)]
        if not any(kept):
            kept = [page.text(i) for i in sorted(fixed)]
        return " ".join(t for t in kept if t)

    if wrapper is not None:
        place(root, unpack(wrapper) if isinstance(wrapper, list) else wrapper)
        if text := chosen():
            return text
    for t in root.texts():
        t.chars, t.links = sum(len(page.text(i)) for i in t.at), sum(page.links[i] for i in t.at)
    choose(root)
    return chosen()


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


_TREE = "host string, tree string, said array<bigint>, places array<bigint>, chars array<bigint>, links array<bigint>, key bigint"


def _tree(x: Node) -> list | int:
    return 0 if x.is_text else [x.sign, *[_tree(k) for k in x.kids]]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Host and tree of each page, and of its texts what they say, where, how long they are and how much of that is in links."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))
    longs = pa.list_(pa.int64())
    for batch in batches:
        hosts, trees, said, places, chars, links, keys = ([] for _ in range(7))
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            p = Page(html or "")
            n = range(len(p.texts))
            hosts.append(host_of(url))
            trees.append(json.dumps(_tree(p.root), separators=(",", ":")))
            said.append([p.said(i) for i in n])
            places.append(p.places)
            chars.append([len(p.text(i)) for i in n])
            links.append(p.links)
            keys.append(_number(repr(said[-1])))
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(trees, pa.string()), *[pa.array(c, longs) for c in (said, places, chars, links)], pa.array(keys, pa.int64())],
            names=["host", "tree", "said", "places", "chars", "links", "key"],
        )


def constants_of(described: DataFrame) -> DataFrame:
    """(host, constants): what a place says on three different pages or more, and three quarters of those that have it.

    Hosts most of whose text that would be have none: their pages are copies.
    """
    pages = described.filter("size(said) > 0").groupBy("host", "key").agg(F.first("said").alias("said"), F.first("places").alias("places"), F.first("chars").alias("chars"))
    first = F.transform("places", lambda p, i: (F.array_position("places", p) == i + 1).cast("int"))
    fresh = F.transform("said", lambda s, i: (F.array_position("said", s) == i + 1).cast("int"))
    each = pages.select("host", F.explode(F.arrays_zip("said", "places", "chars", first.alias("first"), fresh.alias("fresh"))).alias("s"))
    each = each.select("host", F.col("s.said").alias("said"), F.col("s.places").alias("place"), F.col("s.chars").alias("chars"), F.col("s.first").alias("first"), F.col("s.fresh").alias("fresh"))
    texts = save(each.groupBy("host", "place", "said").agg(F.sum("fresh").alias("n"), F.sum("first").alias("first"), F.sum("chars").alias("chars")), "texts")
    places = texts.groupBy("host", "place").agg(F.sum("first").alias("pages")).filter("pages >= 3")
    common = texts.filter("n >= 3").join(places, ["host", "place"]).filter("4 * n >= 3 * pages")
    common = common.groupBy("host").agg(F.sort_array(F.collect_set("said")).alias("constants"), F.sum("chars").alias("fixed"))  # at most one of a place that a page has once
    whole = texts.groupBy("host").agg(F.sum("chars").alias("chars"))
    out = save(common.join(whole, "host").filter("2 * fixed <= chars").select("host", "constants"), "constants")
    drop(texts)
    return out


def _grow(tree: list | int, count: list[int]) -> Node:
    if not tree:
        x = Node("#")
        x.at = [count[0]]
        count[0] += 1
        return x
    return Node(tree[0], 0, [_grow(k, count) for k in tree[1:]])


def _fold_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, stream, pages, and of each slot its text and link text: summed up over the pages of a task that have one stream."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))
    total: dict[tuple[str, str], np.ndarray] = {}
    pages: dict[tuple[str, str], int] = {}

    def rows() -> pa.RecordBatch:
        longs = pa.list_(pa.int64())
        keys = list(total)
        sums = [[total[k][i].tolist() for k in keys] for i in (0, 1)]
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([pages[k] for k in keys], pa.int64()), *[pa.array(s, longs) for s in sums]],
            names=["host", "stream", "n", "chars", "links"],
        )

    for batch in batches:
        for host, tree, said, chars, links, fixed in zip(*(batch.column(c).to_pylist() for c in ("host", "tree", "said", "chars", "links", "constants")), strict=True):
            root = _grow(json.loads(tree), [0])
            if fixed:
                known = frozenset(fixed)
                for t in root.texts():
                    if said[t.at[0]] in known:
                        t.sign = t.name = f"={said[t.at[0]]:x}"
            fold(root)
            slots = list(root.texts())
            key = (host, json.dumps(pack(root), separators=(",", ":")))
            sums = np.array([[sum(col[i] for i in t.at) for t in slots] for col in (chars, links)], dtype=np.int64).reshape(2, -1)
            total[key] = total[key] + sums if key in total else sums
            pages[key] = pages.get(key, 0) + 1
            if len(total) >= COMBINED:
                yield rows()
                total.clear()
                pages.clear()
    if total:
        yield rows()


def _merge(last: bool):
    def run(t: pa.Table) -> pa.Table:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("n", "stream", "sums")), strict=True), key=lambda r: (-r[0], r[1]))
        wrapper: Node | None = None
        for _, stream, sums in rows:
            root = unpack(json.loads(stream))
            for x, s in zip(root.texts(), sums, strict=True):
                x.chars, x.links = s["chars"], s["links"]
            if wrapper is None:
                wrapper = root
            else:
                merge(wrapper, root)
        if last:
            choose(wrapper)
        slots = list(wrapper.texts())
        kind = t.schema.field("sums").type
        return pa.table(
            {
                "host": pa.array([t.column("host")[0].as_py()], pa.string()), "n": pa.array([sum(r[0] for r in rows)], pa.int64()),
                "stream": pa.array([json.dumps(pack(wrapper, last), separators=(",", ":"))], pa.string()),
                "sums": pa.array([[{"pos": i, "chars": x.chars, "links": x.links} for i, x in enumerate(slots)]], kind),
            }
        )

    return run


_SUMS = "host string, n long, stream string, sums array<struct<pos: int, chars: bigint, links: bigint>>"


def wrappers(described: DataFrame, constants: DataFrame) -> DataFrame:
    """(host, n pages, stream): each host's wrapper with its verdicts, from described pages."""
    some = described.join(constants, "host", "left").select("host", "tree", "said", "chars", "links", "constants")
    streams = save(some.mapInArrow(_fold_streams, "host string, stream string, n long, chars array<bigint>, links array<bigint>"), "streams")
    pages = streams.groupBy("host", "stream").agg(F.sum("n").alias("n"))
    slots = streams.select("host", "stream", F.posexplode(F.arrays_zip("chars", "links")).alias("pos", "s"))
    slots = slots.groupBy("host", "stream", "pos").agg(F.sum("s.chars").alias("chars"), F.sum("s.links").alias("links"))
    slots = slots.groupBy("host", "stream").agg(F.sort_array(F.collect_list(F.struct("pos", "chars", "links"))).alias("sums"))  # a stream's slots
    none = F.expr("cast(array() as array<struct<pos: int, chars: bigint, links: bigint>>)")
    whole = pages.join(slots, ["host", "stream"], "left").select("host", "n", "stream", F.coalesce("sums", none).alias("sums"))
    part = whole.withColumn("part", F.pmod(F.xxhash64("stream"), F.lit(PARTS)))
    parts = part.groupBy("host", "part").applyInArrow(_merge(False), _SUMS)
    out = save(parts.groupBy("host").applyInArrow(_merge(True), _SUMS).select("host", "n", "stream"), "wrappers")
    drop(streams)
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))
    known: dict[str, tuple[Node, frozenset[int]]] = {}
    for batch in batches:
        texts = []
        for html, host, stream, fixed in zip(*(batch.column(c).to_pylist() for c in ("html", "host", "stream", "constants")), strict=True):
            if host not in known:
                if len(known) > 200:
                    known.clear()
                known[host] = (unpack(json.loads(stream)) if stream else None, frozenset(fixed or ()))
            texts.append(main_text(html, *known[host]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page.

    pages: page_id (a whole number), url, html; more columns are ignored.  Character references are
    decoded, white space within a block is one space, blocks are joined by one space in the page's order.
    A null or empty html, or a page without main text, gives an empty text.
    Pages whose url is null or has no host are a host of their own.  Repeated rows are
    extracted each, and count once as evidence for constants.  An empty table gives an empty result.
    """
    prepare(pages.sparkSession)
    pages = only(pages, ("page_id", "bigint"), ("url", "string"), ("html", "string"))
    described = save(pages.select("url", "html").mapInArrow(_describe, _TREE), "described")
    constants = constants_of(described)
    wrapped = wrappers(described, constants)
    hosts = save(wrapped.join(constants, "host", "left").select("host", "stream", "constants"), "hosts")
    drop(described, constants, wrapped)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
    rows = pages.withColumn("host", host).join(hosts, "host", "left")
    return rows.select("page_id", "url", "html", "host", "stream", "constants").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
