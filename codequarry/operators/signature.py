"""Signature search: a pattern like ``get*(int, map<K,V>) -> T`` becomes one anchored regular expression."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import current


@dataclass(frozen=True)
class Pattern:
    name: str = ""
    params: list[str] = field(default_factory=list)
    returns: str = ""


def split_params(text: str) -> list[str]:
    """Split at commas outside angle brackets; blank parts go."""
    out, depth, part = [], 0, ""
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and depth <= 0:
            out.append(part)
            part = ""
        else:
            part += c
    return [x.strip() for x in [*out, part] if x.strip()]


def parse_pattern(text: str) -> Pattern:
    """Name before the first parenthesis, parameters up to the last one, return type after the arrow."""
    left, _, returns = text.partition("->")
    name, paren, rest = left.partition("(")
    return Pattern(name.strip(), split_params(rest.rpartition(")")[0] if ")" in rest else rest) if paren else [], returns.strip())


def _literal(text: str) -> str:
    return ".*".join(re.escape(x) for x in text.split("*"))


def to_regex(p: Pattern) -> str:
    """Whole-string expression; ``*`` is any text, no parameters means any parameters, an empty name any name."""
    params = r",\s*".join(f"{_literal(x)}.*" for x in p.params) if p.params else ".*"
    return rf"(?s)^.*{_literal(p.name or '*')}\({params}\).*{_literal(p.returns)}{'.*' if p.returns else ''}$"


def search_by_signature(nodes: DataFrame, pattern: str, lang: str | None = None, limit: int = 20) -> DataFrame:
    """Live functions and methods whose signature (with its return type, if stored) matches."""
    p = parse_pattern(pattern)
    text = F.col("signature")
    if p.returns and "return_type" in nodes.columns:
        text = F.concat(text, F.lit(" -> "), F.coalesce("return_type", F.lit("")))
    found = current(nodes).filter(F.col("kind").isin("Function", "Method") & text.rlike(to_regex(p)))
    found = found if lang is None else found.filter(F.col("lang") == lang)
    return found.orderBy("qualified_name", "id").limit(min(limit, 100))


def search_by_name_pattern(nodes: DataFrame, pattern: str, lang: str | None = None, limit: int = 20) -> DataFrame:
    """Live callables whose name matches the wildcard before the parenthesis, and whose signature has the parenthesis's text."""
    name, paren, rest = pattern.partition("(")
    name = name.strip()
    found = current(nodes).filter(F.col("kind").isin("Function", "Method", "Constructor"))
    if "*" in name:
        found = found.filter(F.col("name").rlike(f"^{_literal(name)}$"))
    elif name:
        found = found.filter(F.col("name") == name)
    if paren:
        found = found.filter(F.col("signature").contains(paren + rest))
    found = found if lang is None else found.filter(F.col("lang") == lang)
    return found.orderBy("qualified_name", "id").limit(min(limit, 100))
