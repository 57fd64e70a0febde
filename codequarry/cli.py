"""Command line: ``python -m codequarry.cli <command> ...``; results as JSON lines, a table or Markdown."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .api import CodeGraph
from .config import load
from .operators import output
from .operators.traces import report_markdown


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codequarry")
    p.add_argument("--config")
    p.add_argument("--format", choices=["json", "table", "markdown"], default="table")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **options: object) -> None:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for key, value in options.items():
            flag = f"--{key.replace('_', '-')}"
            if isinstance(value, bool):
                c.add_argument(flag, action="store_true")
            else:
                c.add_argument(flag, type=type(value) if value is not None else str, default=value)

    add("index", "root", commit="INIT")
    add("index-folder", "root", commit="INIT")
    add("update", "repo", "old", "new", dry_run=False)
    add("workspace", "repo")
    add("goto", "name", kind=None, lang=None, limit=50)
    add("refs", "name", kind=None, lang=None, limit=50, offset=0)
    add("callers", "name", depth=1)
    add("callees", "name", depth=1)
    add("sig", "pattern", lang=None, limit=20)
    add("query", "text", lang=None, kind=None, limit=10)
    add("blocks", type=None, min_nesting=1, lang=None, limit=50)
    add("lambdas", captures=False, lang=None, limit=50)
    add("stats")
    add("trace", "file")
    add("validate")
    add("rollback", "commit")
    add("sql", "statement")
    return p


def _show(rows: DataFrame, form: str) -> None:
    if form == "json":
        rows, most = output.json_lines(rows), 1_000_000
    elif form == "markdown" and "qualified_name" in rows.columns and "score" in rows.columns:
        rows, most = output.markdown(rows), 1_000_000
    else:
        rows.show(1000, truncate=80)
        return
    for r in rows.limit(most).toLocalIterator():
        print(r.value)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("codequarry").getOrCreate()
    g = CodeGraph(spark, load(a.config))
    c = a.command
    if c in ("index", "index-folder"):
        for name, n in g.index(a.root, a.commit, folder=c == "index-folder").items():
            print(f"{name}: {n}")
    elif c == "validate":
        for what, missing in g.store.validate().items():
            print(f"{what}: {', '.join(missing)}")
    elif c == "rollback":
        g.store.rollback(a.commit)
    elif c == "trace":
        text = sys.stdin.read() if a.file == "-" else open(a.file, encoding="utf-8").read()
        rows = g.trace(text)
        for r in (report_markdown(rows) if a.format != "json" else output.json_lines(rows)).collect():  # one trace
            print(r.value)
    else:
        rows = {
            "update": lambda: g.dry_run(a.repo, a.old, a.new) if a.dry_run else g.update(a.repo, a.old, a.new), "workspace": lambda: g.update_workspace(a.repo),
            "goto": lambda: g.definition(a.name, a.kind, a.lang, a.limit), "refs": lambda: g.references(a.name, a.kind, a.lang, a.limit, a.offset),
            "callers": lambda: g.callers(a.name, a.depth), "callees": lambda: g.callees(a.name, a.depth), "sig": lambda: g.signature(a.pattern, a.lang, a.limit),
            "query": lambda: g.search(a.text, a.limit, a.lang, a.kind), "blocks": lambda: g.find_blocks(a.type, a.min_nesting, a.lang, a.limit),
            "lambdas": lambda: g.lambdas(a.captures, a.lang, a.limit), "stats": g.stats, "sql": lambda: g.store.query(a.statement),
        }[c]()
        _show(rows, a.format)
    return 0


if __name__ == "__main__":
    sys.exit(main())
