"""Symbols, references and blocks of source files.

Python goes through the standard library's parser; the brace languages go through a small lexer that blanks
strings and comments, matches braces in one pass, and reads declarations by pattern.  A row knows the symbol
that it stands in by kind and name (two methods of one name are one node with two parents), so the ids of
edges' sources need no join; ``resolve`` joins targets by name.
"""

from __future__ import annotations

import ast
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.workers import prepare

#: src: the symbol around a row (of a node: its type; of a reference or block: its callable); null: the file.
_ROW = (
    "path string, lang string, what string, kind string, name string, src_kind string, src_name string, start_line int, end_line int, start_byte bigint, end_byte bigint, "
    "signature string, return_type string, target string, dep_kind string, depth int, captures array<string>, code_hash string"
)
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_BLOCK_NODES = {ast.If: "if", ast.For: "for", ast.AsyncFor: "for", ast.While: "while", ast.Try: "try", ast.With: "with", ast.AsyncWith: "with", ast.Match: "match", ast.Lambda: "lambda"}
TYPE_KINDS = ["Class", "Interface", "Struct", "Enum", "Trait"]
WHAT = ("node", "ref", "block")  #: what a row is


def _row(path: str, lang: str, what: str, **more) -> dict:
    return {"path": path, "lang": lang, "what": what} | more


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:24]


class _Lines:
    """Line numbers and byte offsets of a text's characters."""

    def __init__(self, text: str) -> None:
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.plain, self.text = text.isascii(), text
        self.bytes = [0]
        if not self.plain:
            for a, b in zip(self.starts, [*self.starts[1:], len(text)], strict=True):
                self.bytes.append(self.bytes[-1] + len(text[a:b].encode("utf-8", "surrogatepass")))

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def byte(self, at: int) -> int:
        if self.plain:
            return at
        n = self.line(at) - 1
        return self.bytes[n] + len(self.text[self.starts[n] : at].encode("utf-8", "surrogatepass"))


_DEFS, _IMPORT = (ast.FunctionDef, ast.AsyncFunctionDef), (ast.Import, ast.ImportFrom)
_LEAVES = (ast.Name, ast.Constant, ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop, ast.alias)


def _children(x: ast.AST) -> list[ast.AST]:
    """Nodes right below x, the last one first, without those that neither make a row nor hold one that does."""
    out: list[ast.AST] = []
    for f in x._fields:
        v = getattr(x, f, None)
        if type(v) is list:
            out += [y for y in v if isinstance(y, ast.AST) and not isinstance(y, _LEAVES)]
        elif isinstance(v, ast.AST) and not isinstance(v, _LEAVES):
            out.append(v)
    out.reverse()
    return out


def _python(path: str, text: str, want: tuple[str, ...] = WHAT) -> Iterator[dict]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    lines = text.encode("utf-8", "surrogatepass").splitlines(keepends=True)
    at = [0]
    for x in lines:
        at.append(at[-1] + len(x))
    raw = b"".join(lines)
    put = lambda what, **m: _row(path, "python", what, **m)
    node, ref, block = (w in want for w in WHAT)

    def span(node) -> dict:
        a, b = at[node.lineno - 1] + node.col_offset, at[node.end_lineno - 1] + node.end_col_offset
        return {"start_line": node.lineno, "end_line": node.end_lineno, "start_byte": a, "end_byte": b, "code_hash": hashlib.sha256(raw[a:b]).hexdigest()[:24]}

    def params(a: ast.arguments) -> list[str]:
        return [x.arg for x in [*a.posonlyargs, *a.args, *filter(None, [a.vararg]), *a.kwonlyargs, *filter(None, [a.kwarg])]]

    # node, enclosing class, enclosing function, depth of blocks in that function
    todo: list[tuple] = [(x, None, None, 0) for x in _children(tree)]
    while todo:
        x, owner, fn, depth = todo.pop()
        src = {"src_kind": "Function" if fn else None, "src_name": fn}
        inner = (owner, fn, depth)
        if isinstance(x, ast.ClassDef):
            if node:
                yield put("node", kind="Class", name=x.name, src_kind="Class" if owner else None, src_name=owner, **span(x))
            for base in x.bases if ref else ():
                yield put("ref", kind="INHERITS", src_kind="Class", src_name=x.name, start_line=x.lineno, target=ast.unparse(base).split("[")[0].split(".")[-1])
            for y in x.body if node else ():
                if isinstance(y, ast.AnnAssign) and isinstance(y.target, ast.Name):
                    yield put("node", kind="Field", name=y.target.id, src_kind="Class", src_name=x.name, **span(y))
            inner = (x.name, fn, depth)
        elif isinstance(x, _DEFS):
            if node:
                returns = ast.unparse(x.returns) if x.returns else None
                yield put("node", kind="Function", name=x.name, src_kind="Class" if owner else None, src_name=owner, signature=f"{x.name}({ast.unparse(x.args)})", return_type=returns, **span(x))
            inner = (owner, x.name, 0)
        elif ref and isinstance(x, _IMPORT):
            module = "." * getattr(x, "level", 0) + (getattr(x, "module", None) or "")
            for a in x.names:
                yield put("ref", kind="IMPORTS", start_line=x.lineno, target=a.name if isinstance(x, ast.Import) else module, name=a.asname or a.name)
        elif ref and isinstance(x, ast.Call):
            f = x.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            if name and fn:
                yield put("ref", kind="CALLS", start_line=x.lineno, target=name, **src)
        kind = _BLOCK_NODES.get(type(x))
        if kind and fn:
            name, caught = None, []
            if kind == "lambda":
                own = params(x.args)
                name = f"lambda({', '.join(own)})"
                caught = sorted({y.id for y in ast.walk(x.body) if isinstance(y, ast.Name) and isinstance(y.ctx, ast.Load)} - set(own))
            if block:
                yield put("block", kind=kind, name=name, depth=depth + 1, captures=caught, **src, **span(x))
            inner = (owner, fn, depth + 1)
        todo += [(y, *inner) for y in _children(x)]


_NOISE = re.compile(r'//[^\n]*|/\*.*?\*/|r#*".*?"#*|`(?:\\.|[^`\\])*`|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])\'', re.S)


def blank(text: str) -> str:
    """Comments and string contents replaced by blanks, lines and lengths kept."""
    def gap(m: re.Match) -> str:
        s = m[0]
        if s[0] in "\"`" or s.startswith("r"):
            return s[0] + re.sub(r"[^\n]", " ", s[1:-1]) + s[-1] if len(s) > 1 else s
        return re.sub(r"[^\n]", " ", s)

    return _NOISE.sub(gap, text)


_TYPES = {
    "java": r"\b(class|interface|enum|record)\s+(\w+)(?:<[^{]*?>)?\s*(?:extends\s+([\w.<>, ]+?))?\s*(?:implements\s+([\w.<>, ]+?))?\s*\{",
    "cpp": r"\b(class|struct|enum(?:\s+class)?|namespace)\s+(\w+)\s*(?:final\s*)?(?::\s*([^{;]+?))?\s*\{",
    "rust": r"\b(struct|enum|trait)\s+(\w+)",
    "typescript": r"\b(class|interface|enum)\s+(\w+)(?:<[^{]*?>)?\s*(?:extends\s+([\w.<>, ]+?))?\s*(?:implements\s+([\w.<>, ]+?))?\s*\{",
    "go": r"\btype\s+(\w+)\s+(struct|interface)\s*\{",
}
_FUNCS = {
    "java": r"(?:^|[;{}\s])(?:[\w<>\[\],.?]+\s+)?(\w+)\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?:throws\s+[\w., ]+)?\s*\{",
    "cpp": r"(?:^|[;{}\s*&])(?:(\w+)::)?(~?\w+)\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?(?:->\s*[\w:<>]+\s*)?\{",
    "rust": r"\bfn\s+(\w+)\s*(?:<[^>]*>)?\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?:->\s*([^{;]+?))?\s*(?:where[^{]*)?[{;]",
    "typescript": r"\b(?:async\s+)?function\s+(\w+)\s*(?:<[^>]*>)?\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?::\s*([^{]+?))?\s*\{",
    "go": r"\bfunc\s+(?:\(\s*\w*\s*\*?(\w+)[^)]*\)\s*)?(\w+)\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*([^{\n]*?)\s*\{",
}
_KINDS = {"class": "Class", "interface": "Interface", "enum": "Enum", "record": "Class", "struct": "Struct", "trait": "Trait", "namespace": "Namespace", "enum class": "Enum"}
_NO_CALL = frozenset("if for while switch catch return sizeof new match fn func function def class struct enum else do try throw super this assert typeof await synchronized unsafe loop in as let var const make".split())
_IMPORTS = {"java": r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", "cpp": r'^\s*#\s*include\s*[<"]([^>"]+)[>"]', "rust": r"^\s*(?:pub\s+)?use\s+([^;]+);", "typescript": r"""^\s*import\s+(?:[^'"\n]*?from\s+)?['"]([^'"]+)['"]""", "go": r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"]+)"\s*$'}
_MORE_FUNCS = {  # typescript: arrow functions with a name, and methods
    "arrow": r"\b(?:const|let|var)\s+(\w+)\s*(?::[^=;{}]+)?=\s*(?:async\s+)?\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?::\s*([^=;{}]+?))?\s*=>\s*\{",
    "method": r"(?:^|[;{}\n])\s*(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(\w+)\s*(?:<[^<>()]*>)?\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?::\s*([^{};=]+?))?\s*\{",
}
_BLOCKS = re.compile(r"\b(if|for|while|try|match|switch|loop)\b")
_CLOSURE = re.compile(r"(?<![\w)\]|&])\s*(?:move\s+)?\|([^|;{}\n]*)\|(?!\|)")
_QUALIFIED = {"cpp": re.compile(r"^[A-Za-z_]\w*(?:::\w+)+$"), "rust": re.compile(r"^[A-Za-z_]\w*(?:::\w+)+$"), "java": re.compile(r"^[A-Za-z_]\w*(?:\.\w+)+$")}
_HEADERS = ("stdio.h", "stdlib.h", "string.h", "vector", "iostream")  # fixed values: names that count as another file's in C++
_INJECT = re.compile(r"@(Autowired|Inject|Resource)\b")


def cross_file(symbol: str, lang: str) -> bool:
    """Whether a name stands for something of another file."""
    if lang == "cpp":
        return "::" in symbol or symbol in _HEADERS
    if lang == "java":
        return "." in symbol and not symbol.startswith("java.")
    return lang == "rust" and "::" in symbol and not symbol.startswith("crate::")


class _Nest:
    """Nested spans (start, end, value): the innermost around a place, found by search."""

    def __init__(self, spans: list[tuple]) -> None:
        self.spans = sorted(spans, key=lambda s: (s[0], -s[1]))
        self.starts, self.up, open_ = [s[0] for s in self.spans], [], []
        for i, s in enumerate(self.spans):
            while open_ and self.spans[open_[-1]][1] < s[0]:
                open_.pop()
            self.up.append(open_[-1] if open_ else -1)
            open_.append(i)

    def around(self, at: int, but: int = -1):
        """The innermost span that holds a place and doesn't start at ``but``."""
        i = bisect_right(self.starts, at) - 1
        while i >= 0 and (self.spans[i][1] < at or self.spans[i][0] == but):
            i = self.up[i]
        return self.spans[i] if i >= 0 else None

    def depth(self, at: int, within: int) -> int:
        """How many spans that start after ``within`` hold a place."""
        i, n = bisect_right(self.starts, at) - 1, 0
        while i >= 0 and self.spans[i][0] > within:
            n += self.spans[i][1] >= at
            i = self.up[i]
        return n


def _structure(clean: str) -> tuple[dict[int, int], list[int]]:
    """Place of the brace that closes each opening one; places of ``; { }`` outside of parentheses."""
    close, open_, ends, round_ = {}, [], [], [0]
    for m in re.finditer(r"[(){};]", clean):
        c, at = m[0], m.start()
        if c == "(":
            round_[-1] += 1
        elif c == ")":
            round_[-1] = max(0, round_[-1] - 1)
        else:
            if c == "{":
                if not round_[-1]:
                    ends.append(at)
                open_.append(at)
                round_.append(0)
                continue
            if c == "}":
                if open_:
                    close[open_.pop()] = at
                    round_.pop()
            if not round_[-1]:
                ends.append(at)
    for at in open_:
        close[at] = len(clean) - 1
    return close, ends


def _split_types(text: str) -> list[str]:
    """Parts at commas outside of angle brackets and parentheses."""
    out, depth, now = [], 0, ""
    for c in text:
        depth += (c in "<([") - (c in ">)]")
        if c == "," and depth <= 0:
            out.append(now)
            now = ""
        else:
            now += c
    return [x.strip() for x in [*out, now] if x.strip()]


def _braces(path: str, lang: str, text: str, want: tuple[str, ...] = WHAT) -> Iterator[dict]:
    family = "typescript" if lang == "tsx" else lang
    clean = blank(text)
    lines = _Lines(text)
    close, ends = _structure(clean)
    line = lines.line
    put = lambda what, **m: _row(path, lang, what, **m)
    node, ref, block = (w in want for w in WHAT)

    def span(a: int, b: int) -> dict:
        return {"start_line": line(a), "end_line": line(b), "start_byte": lines.byte(a), "end_byte": lines.byte(b + 1), "code_hash": _hash(text[a : b + 1])}

    def before(at: int) -> str:
        """What stands between the last statement's end and a place."""
        i = bisect_left(ends, at) - 1
        return clean[ends[i] + 1 if i >= 0 else 0 : at]

    found = []
    for m in re.finditer(_TYPES[family], clean):
        name, word = (m[1], m[2]) if family == "go" else (m[2], " ".join(m[1].split()))
        i = bisect_left(ends, m.end() - 1)
        brace = ends[i] if i < len(ends) and clean[ends[i]] == "{" else -1
        found.append((m.start(), close.get(brace, m.end() - 1) if brace >= 0 else m.end() - 1, (_KINDS[word], name, m, brace)))
    types = _Nest(found)

    def owner_of(at: int, but: int = -1) -> tuple[str | None, str | None]:
        t = types.around(at, but)
        return t[2][:2] if t else (None, None)

    for start, end, (kind, name, m, brace) in types.spans if node or ref else ():
        if node:
            above = owner_of(start, start)
            yield put("node", kind=kind, name=name, src_kind=above[0], src_name=above[1], **span(start, end))
        supers = [] if not ref or family in ("go", "rust") else [m[3], m[4] if family != "cpp" else None]
        for group, edge in zip(supers, ("EXTENDS" if family == "java" and kind == "Class" else "INHERITS", "IMPLEMENTS"), strict=False):
            for part in _split_types(group or ""):
                base = re.sub(r"<.*|\b(public|private|protected|virtual)\b", "", part, flags=re.S).strip().split("::")[-1].split(".")[-1]
                if base:
                    yield put("ref", kind=edge, src_kind=kind, src_name=name, start_line=line(start), target=base)
        if family in ("java", "go", "cpp") and kind in ("Class", "Struct") and brace >= 0:
            field = r"^\s*(\w+)\s+[*\[\]\w.]+\s*(?:`.*)?$" if family == "go" else r"^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|const)\s+)*([\w<>\[\], .:*]+?)\s+(\w+)\s*(?:=[^;]*)?;\s*$"
            depth, pos, above_line = 0, brace + 1, ""
            for raw in clean[brace + 1 : end].split("\n"):
                f = re.match(field, raw) if depth == 0 else None
                if f and (family == "go" or f[1] not in ("return", "throw", "package", "import", "using", "typedef")):
                    field_name = f[1] if family == "go" else f[2]
                    if node:
                        yield put("node", kind="Field", name=field_name, src_kind=kind, src_name=name, **span(pos, pos + len(raw) - 1))
                    if ref and family == "java":
                        src = {"src_kind": "Field", "src_name": field_name, "start_line": line(pos), "target": f[1].strip()}
                        yield put("ref", kind="TYPES", **src)
                        if a := _INJECT.search(above_line + raw):
                            yield put("ref", kind="INJECTS", dep_kind=a[1].lower(), **src)
                depth += raw.count("{") - raw.count("}")
                pos += len(raw) + 1
                above_line = raw if raw.lstrip().startswith("@") and ";" not in raw else ""
    made, names = [], set()
    patterns = [_FUNCS[family]] + ([_MORE_FUNCS["arrow"], _MORE_FUNCS["method"]] if family == "typescript" else [])
    for k, pattern in enumerate(patterns):
        for m in re.finditer(pattern, clean):
            at_name = 2 if family in ("cpp", "go") else 1
            name, start = m[at_name], m.start(at_name)
            if not name or name in _NO_CALL or start in names:
                continue
            kind_of, owner = owner_of(start)
            if k == 2 and (owner is None or name == "function"):
                continue
            if owner is None and family in ("cpp", "go") and m[1]:
                kind_of, owner = ("Struct" if family == "go" else "Class"), m[1]
            names.add(start)
            brace = m.end() - 1
            end = close.get(brace, brace) if clean[brace] == "{" else brace
            kind = "Destructor" if name.startswith("~") else "Constructor" if (owner == name and family in ("java", "cpp")) or (k == 2 and name == "constructor") else "Method" if owner and family != "rust" else "Function"
            head = before(start)
            first = m.start() if family in ("rust", "go") or k == 1 else start
            made.append((first, end, (kind, name, m, start, brace, kind_of, owner, head)))
    functions = _Nest(made)
    params = {"cpp": 3, "go": 3}.get(family, 2)
    returns = {"rust": 3, "typescript": 3, "go": 4}.get(family)
    braced = [(b.start(), b[1], b.end()) for b in _BLOCKS.finditer(clean)] if block else []
    blocks = []
    for at, word, after in braced:
        i = bisect_left(ends, after)
        if i < len(ends) and clean[ends[i]] in "{;":
            blocks.append((at, close.get(ends[i], ends[i]), (word, None, [])))
    if block and family == "rust":
        for m in _CLOSURE.finditer(clean):
            if functions.around(m.start(1)) is None:
                continue
            body = m.end() + len(clean[m.end() :]) - len(clean[m.end() :].lstrip()) if clean[m.end() : m.end() + 1].isspace() else m.end()
            stop = close[body] if body in close else next((x.start() - 1 for x in _stops(clean, body)), len(clean) - 1)
            own = [p.split(":")[0].strip().lstrip("&").removeprefix("mut ").strip() for p in _split_types(m[1])]
            used = {x for x in re.findall(r"(?<![\w.:])([a-z_]\w*)(?!\w|\s*[(!:])", clean[body : stop + 1])} - set(own) - _NO_CALL - {"true", "false", "self", "mut", "ref", "move"}
            blocks.append((m.start(1) - 1, stop, ("lambda", f"|{', '.join(own)}|", sorted(used))))
    nested = _Nest(blocks)
    for first, end, (kind, name, m, start, _brace, kind_of, owner, head) in functions.spans if node or ref else ():
        if node:
            sig = f"{name}({' '.join(text[m.start(params) : m.end(params)].split())})"
            yield put("node", kind=kind, name=name, src_kind=kind_of, src_name=owner, signature=sig, return_type=((m[returns] or "").strip() or None) if returns else None, **span(first, end))
        if ref and family == "java" and re.search(r"@Override\b", head):
            yield put("ref", kind="OVERRIDES", src_kind=kind, src_name=name, start_line=line(start), target=name, name=owner)
        if ref and family == "java" and kind == "Constructor" and (a := _INJECT.search(head)):
            for p in _split_types(m[params]):
                words = re.sub(r"@\w+(?:\([^)]*\))?|\bfinal\b", "", p).split()
                if len(words) > 1:
                    yield put("ref", kind="INJECTS", src_kind=kind, src_name=name, start_line=line(start), target=" ".join(words[:-1]), dep_kind=a[1].lower())
    for at, end, (word, name, caught) in nested.spans:
        fn = functions.around(at)
        if fn and fn[2][4] < at:
            yield put("block", kind=word, name=name, src_kind=fn[2][0], src_name=fn[2][1], depth=nested.depth(at, fn[2][4]), captures=caught, **span(at, end))
    if not ref:
        return
    for m in re.finditer(r"(?:(?<=\.)|(?<=->)|(?<=::)|(?<!~)\b)([A-Za-z_]\w*)\s*\(", clean):
        if m[1] in _NO_CALL or m.start(1) in names:
            continue
        fn = functions.around(m.start())
        if fn and fn[2][4] < m.start():
            yield put("ref", kind="CALLS", src_kind=fn[2][0], src_name=fn[2][1], start_line=line(m.start()), target=m[1])
    if family == "rust":
        for m in re.finditer(r"\bimpl(?:<[^>]*>)?\s+(?:\w+::)*(\w+)(?:<[^>]*>)?\s+for\s+(\w+)", clean):
            kind = next((k for _, _, (k, n, *_) in types.spans if n == m[2]), "Struct")
            yield put("ref", kind="IMPLEMENTS", src_kind=kind, src_name=m[2], start_line=line(m.start()), target=m[1])
    for m in re.finditer(_IMPORTS[family], text, re.M):
        yield put("ref", kind="INCLUDES" if family == "cpp" else "IMPORTS", start_line=line(m.start(1)), target=m[1].strip())
    if family in _QUALIFIED:  # statements at the file's top that are one qualified name
        depth, at = 0, 0
        for e in ends:
            if depth == 0:
                part = clean[at:e].strip()
                if _QUALIFIED[family].match(part) and cross_file(part, family):
                    yield put("ref", kind="CROSS_FILE_CALL", start_line=line(e), target=part)
            depth += (clean[e] == "{") - (clean[e] == "}")
            at = e + 1


def _stops(clean: str, at: int) -> Iterator[re.Match]:
    """The places at which an expression that starts at ``at`` ends: a comma, semicolon or closing bracket outside of its own brackets."""
    depth = 0
    for m in re.compile(r"[(){}\[\],;]").finditer(clean, at):
        if m[0] in "({[":
            depth += 1
        elif depth == 0:
            yield m
            return
        elif m[0] in ")}]":
            depth -= 1


def extract_text(path: str, lang: str, text: str, want: tuple[str, ...] = WHAT) -> list[dict]:
    """All rows of a file: nodes, references and blocks, told apart by ``what``; of these, the ones that are wanted."""
    if not text.strip():
        return []
    return list(_python(path, text, want) if lang == "python" else _braces(path, lang, text, want) if lang in (*_TYPES, "tsx") else ())


def _extract(want: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = [pa.string()] * 7 + [pa.int32()] * 2 + [pa.int64()] * 2 + [pa.string()] * 4 + [pa.int32(), pa.list_(pa.string()), pa.string()]

    def made(rows: list[dict]) -> pa.RecordBatch:
        have = set().union(*rows)
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) if n in have else pa.nulls(len(rows), t) for n, t in zip(_NAMES, kinds, strict=True)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for path, lang, content in zip(*(batch.column(c).to_pylist() for c in ("path", "lang", "content")), strict=True):
                rows += extract_text(path, lang, (content or b"").decode("utf-8", "replace"), want)
                while len(rows) >= 2000:
                    yield made(rows[:2000])
                    rows = rows[2000:]
        if rows:
            yield made(rows)

    return run


FILES_PER_TASK = 10_000


def spread(keys: DataFrame, key: str, files: int = FILES_PER_TASK) -> DataFrame:
    """Rows from which source texts are made, dealt out by a key, about ``files`` to a task.

    One file of a column store, which one task reads, can hold the keys of millions of sources.
    """
    return keys.repartition(max(1, -(-keys.count() // files)), key)


def extract(files: DataFrame, *want: str) -> DataFrame:
    """Raw rows of files (path, lang, content): those of ``want`` (node, ref, block) alone, or all.

    The others are neither made nor sent to the JVM, which is most of the work.
    """
    if unknown := set(want) - set(WHAT):
        raise ValueError(f"unknown rows {sorted(unknown)}")
    prepare(files.sparkSession)
    return files.select("path", "lang", "content").mapInArrow(_extract(want or WHAT), _ROW)


def _symbol(project: str, kind: Column, name: Column) -> Column:
    """Id of a symbol of the row's file: qualified by the file's stem."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return S.node_id(F.lit(project), F.col("path"), kind, F.concat(stem, F.lit("."), name))


def file_id(project: str, path: Column | None = None) -> Column:
    path = F.col("path") if path is None else path
    return S.node_id(F.lit(project), path, F.lit("File"), path)


def _source(project: str) -> Column:
    return F.when(F.col("src_name").isNull(), file_id(project)).otherwise(_symbol(project, F.col("src_kind"), F.col("src_name")))


def nodes_of(raw: DataFrame, project: str, commit: str) -> DataFrame:
    """Nodes, one per id (the last in the file): qualified by the file's stem."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    n = raw.filter("what = 'node'").withColumn("qualified_name", F.concat(stem, F.lit("."), "name"))
    n = n.withColumn("id", _symbol(project, F.col("kind"), F.col("name")))
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("start_byte")))
    n = n.withColumn("_n", last).filter("_n = 1")
    return n.select(
        "id", "kind", "name", "qualified_name", "lang", F.col("path").alias("file_path"), "start_line", "end_line", "start_byte", "end_byte", "code_hash", "signature", "return_type",
        F.lit(project).alias("project_id"), F.lit(commit).alias("valid_from"), F.lit(None).cast("string").alias("valid_to"),
    )


def file_nodes(files: DataFrame, project: str, commit: str) -> DataFrame:
    path = F.col("path")
    text = F.decode(F.col("content"), "UTF-8")
    return files.select(
        file_id(project).alias("id"), F.lit("File").alias("kind"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), path.alias("qualified_name"), "lang", path.alias("file_path"),
        S.content_hash(text).alias("code_hash"), F.lit(project).alias("project_id"), F.lit(commit).alias("valid_from"),
    )


def _edges(rows: DataFrame, commit: str) -> DataFrame:
    """Rows (from_id, kind, to_id and what else they have) in the columns of schema.EDGES, one per id."""
    have = set(rows.columns)
    out = rows.filter(F.col("from_id").isNotNull() & F.col("to_id").isNotNull())
    for f in S.EDGES:
        if f.name not in have:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    out = out.withColumn("valid_from", F.lit(commit)).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    out = out.withColumn("id", S.edge_id(F.col("from_id"), F.col("kind"), F.col("to_id"), F.col("dep_kind"), F.col("raw_type_string"), F.col("confidence")))
    rest = [f.name for f in S.EDGES if f.name != "id"]
    return out.groupBy("id").agg(*[F.min(c).alias(c) for c in rest]).select(*[f.name for f in S.EDGES])


def resolve(raw: DataFrame, nodes: DataFrame, project: str, commit: str) -> DataFrame:
    """Edges of references to symbols: the target's name within the file first, else the project's first definition of the language, by path and place.

    Calls have a confidence of 0.7.  OVERRIDES goes to the method of that name in the nearest of up to three
    levels of the class's supertypes, where one is known.
    """
    refs = raw.filter("what = 'ref' and kind not in ('IMPORTS', 'INCLUDES', 'CROSS_FILE_CALL')")
    call = F.col("kind") == "CALLS"
    group = F.when(F.col("kind").isin(*S.CALLABLE_KINDS), "callable").when(F.col("kind").isin(*TYPE_KINDS), "type")
    defs = nodes.select("id", F.col("name").alias("target"), F.col("file_path").alias("path"), "lang", "start_byte", group.alias("group")).filter("group is not null")
    first = F.min(F.struct("path", "start_byte", "id"))
    local = defs.groupBy("path", "target", "group").agg(F.min(F.struct("start_byte", "id")).alias("l"))
    far = defs.groupBy("lang", "target", "group").agg(first.alias("g"))
    plain = refs.filter("kind <> 'OVERRIDES'").withColumn("group", F.when(call, "callable").otherwise("type")).withColumn("from_id", _source(project))
    plain = plain.withColumn("raw", F.col("target")).withColumn("target", F.regexp_replace(F.regexp_replace("target", r"(?s)<.*|\[\]", ""), r"^.*\.", ""))
    hit = plain.join(local, ["path", "target", "group"], "left").join(far, ["lang", "target", "group"], "left")
    own = F.col("kind") == "CALLS"  # a function may call itself
    near = F.when(own | (F.col("l.id") != F.col("from_id")), F.col("l.id"))
    to = F.coalesce(near, F.when(own | (F.col("g.id") != F.col("from_id")), F.col("g.id")))
    found = hit.select("from_id", "kind", to.alias("to_id"), "dep_kind", F.when(F.col("kind") == "TYPES", F.col("raw")).alias("raw_type_string"), F.when(own, 0.7).alias("confidence"))
    return _edges(found.unionByName(_overrides(raw, project), allowMissingColumns=True), commit)


def _overrides(raw: DataFrame, project: str) -> DataFrame:
    wanted = raw.filter("what = 'ref' and kind = 'OVERRIDES'").select(_source(project).alias("from_id"), "lang", F.col("name").alias("owner"), F.col("target").alias("method")).distinct()
    supers = raw.filter("what = 'ref' and kind in ('EXTENDS', 'IMPLEMENTS', 'INHERITS')").select("lang", F.col("src_name").alias("owner"), F.col("target").alias("above")).distinct()
    methods = raw.filter("what = 'node' and kind = 'Method'").select("lang", F.col("src_name").alias("above"), F.col("name").alias("method"), "path", _symbol(project, F.col("kind"), F.col("name")).alias("to_id"))
    methods = methods.groupBy("lang", "above", "method").agg(F.min(F.struct("path", "to_id")).alias("m"))
    levels, at = [], wanted
    for level in range(3):
        at = at.join(supers, ["lang", "owner"]).select("from_id", "lang", F.col("above").alias("owner"), "method").distinct()
        hit = at.withColumnRenamed("owner", "above").join(methods, ["lang", "above", "method"])
        levels.append(hit.select("from_id", F.lit(level).alias("level"), F.col("m.to_id").alias("to_id")))
    best = reduce(DataFrame.unionByName, levels).filter("from_id <> to_id").groupBy("from_id").agg(F.min(F.struct("level", "to_id")).alias("m"))
    return best.select("from_id", F.lit("OVERRIDES").alias("kind"), F.col("m.to_id").alias("to_id"))


def outward_edges(raw: DataFrame, project: str, commit: str) -> DataFrame:
    """Edges to what has no node: imports, includes, what a file depends on, types of fields, names of other files."""
    refs = raw.filter("what = 'ref'").withColumn("from_id", _source(project))
    label = F.trim(F.regexp_replace("target", "^[\"'<>`]+|[\"'<>`]+$", ""))
    refs = refs.withColumn("label", label).filter("label <> ''")
    to = lambda prefix: S.content_hash(F.concat(F.lit(prefix), "label"))
    one = lambda when, kind, to_id, label=F.col("label"), confidence=F.lit(None): F.when(when, F.struct(kind.alias("kind"), to_id.alias("to_id"), label.alias("label"), confidence.cast("double").alias("confidence")))
    kind, cpp = F.col("kind"), F.col("lang") == "cpp"
    each = F.array(  # of a reference; the rows are read once
        one(kind.isin("IMPORTS", "INCLUDES"), kind, to("import:")),
        one(cpp & (kind == "INCLUDES") | (F.col("lang") == "java") & (kind == "IMPORTS"), F.lit("DEPENDS_ON"), F.when(cpp, to("include:")).otherwise(to("import:"))),
        one(kind == "TYPES", kind, S.content_hash(F.concat(F.lit("type:"), "target")), F.col("target")),
        one(kind == "CROSS_FILE_CALL", kind, to("crossfile:"), confidence=F.lit(0.3)),
    )
    return _edges(refs.select("from_id", F.explode(F.array_compact(each)).alias("_e")).select("from_id", "_e.*"), commit)


def containment(raw: DataFrame, project: str, commit: str) -> DataFrame:
    """The file contains its types and free functions; the innermost type around them, its methods and fields. A method of two types has two parents."""
    n = raw.filter("what = 'node'").withColumn("to_id", _symbol(project, F.col("kind"), F.col("name")))
    is_type, is_field = F.col("kind").isin(*TYPE_KINDS, "Namespace"), F.col("kind") == "Field"
    kept = n.filter(is_type | F.col("kind").isin(*S.CALLABLE_KINDS) | is_field & F.col("src_name").isNotNull())
    kind = F.when(is_type, "CONTAINS_CLASS").when(is_field, "CONTAINS_FIELD").when(F.col("src_name").isNull(), "CONTAINS_FUNCTION").otherwise("CONTAINS_METHOD")
    return _edges(kept.select(F.when(is_type, file_id(project)).otherwise(_source(project)).alias("from_id"), kind.alias("kind"), "to_id"), commit)


def blocks_of(raw: DataFrame, project: str, commit: str) -> DataFrame:
    b = raw.filter("what = 'block'").withColumn("parent_function_id", _source(project))
    made = S.block_id(F.col("path"), F.col("kind"), F.col("parent_function_id"), F.col("start_line"))
    out = b.select(
        made.alias("id"), F.col("kind").alias("block_type"), "name", "parent_function_id", "lang", F.col("path").alias("file_path"), "start_line", "end_line", "start_byte", "end_byte",
        F.col("depth").alias("nesting_depth"), "code_hash", F.col("captures").alias("captured_variables"), F.lit(commit).alias("valid_from"), F.lit(None).cast("string").alias("valid_to"),
    )
    first = F.row_number().over(Window.partitionBy("id").orderBy("start_byte", "end_byte"))
    return out.withColumn("_n", first).filter("_n = 1").drop("_n")


def block_edges(blocks: DataFrame, commit: str) -> DataFrame:
    return _edges(blocks.select(F.col("parent_function_id").alias("from_id"), F.lit("CONTAINS_BLOCK").alias("kind"), F.col("id").alias("to_id"), F.col("block_type").alias("label")), commit)
