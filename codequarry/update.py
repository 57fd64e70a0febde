"""Incremental updates: what changed between two commits, or in the working tree, applied to a stored graph.

Only changed files are read and extracted, on both sides of the change; names of other files come from the
store.  The list of changed paths is the one thing that the driver holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .index import from_raw
from .operators.lookup import current
from .operators.versioning import apply_changes, dry_run_estimate, snapshot_diff
from .sources import extract as X
from .sources import git
from .sources.walk import language
from .store import GraphStore

WORKSPACE = "WORKSPACE"


class TooLarge(ValueError):
    """An update is estimated to touch more nodes than allowed."""


def changed(spark: SparkSession, repo: str, old: str, new: str | None = None) -> DataFrame:
    """(path, change, lang) of changed source files: added, updated or deleted."""
    d = git.diff(spark, repo, old, new).withColumn("lang", language(F.col("path"))).filter(F.col("lang").isNotNull())
    return d.select("path", F.when(F.col("status") == "A", "added").when(F.col("status") == "D", "deleted").otherwise("updated").alias("change"), "lang")


def _files(blobs: DataFrame) -> DataFrame:
    return blobs.select("path", language(F.col("path")).alias("lang"), "content").filter(F.decode("content", "ISO-8859-1").rlike(r"\S"))


class Diff:
    """old and new (nodes, edges, blocks) of the changed files, and ``changes`` (entity, change, id)."""

    def __init__(self, old: dict[str, DataFrame], new: dict[str, DataFrame]) -> None:
        self.old, self.new = old, new
        parts = [snapshot_diff(old["nodes"], new["nodes"]), snapshot_diff(old["edges"], new["edges"], None, "edge"), snapshot_diff(old["blocks"], new["blocks"], "code_hash", "block")]
        self.changes = reduce(DataFrame.unionByName, parts)

    def of(self, entity: str) -> DataFrame:
        return self.changes.filter(F.col("entity") == entity)


def _graph(files: DataFrame, project: str, commit: str, known: DataFrame | None) -> dict[str, DataFrame]:
    return from_raw(X.extract(files), files, project, commit, known)


def compute_diff(spark: SparkSession, repo: str, old: str, new: str | None, project: str, nodes: DataFrame | None = None) -> Diff:
    """Read-only; new=None: the working tree.  nodes: the stored nodes, which other files' names come from."""
    paths = [r.path for r in changed(spark, repo, old, new).collect()]  # changed source files
    before = _files(git.snapshot(spark, repo, old, paths)) if git.has_commits(repo) else _files(git.working_tree(spark, repo, []))
    after = _files(git.working_tree(spark, repo, paths) if new is None else git.snapshot(spark, repo, new, paths))
    known = None if nodes is None else current(nodes).filter(~F.col("file_path").isin(*paths) if paths else F.lit(True))
    return Diff(_graph(before, project, old, known), _graph(after, project, new or WORKSPACE, known))


def dry_run(spark: SparkSession, repo: str, old: str, new: str | None = None, most: int = 100_000) -> DataFrame:
    """One row: changed files, estimated nodes, whether that exceeds the limit, and a warning or null."""
    d = dry_run_estimate(changed(spark, repo, old, new), most=most)
    return d.withColumn("warning", F.when(F.col("exceeds"), F.format_string("about %d nodes, more than %d", "estimated_nodes", F.lit(most))))


def apply_diff(store: GraphStore, diff: Diff, commit: str) -> None:
    """Close what was deleted or updated and add what is new in one version, whose pointer moves last."""
    tables = {}
    for name, entity, wanted in (("nodes", "node", S.NODES), ("edges", "edge", S.EDGES), ("blocks", "block", S.BLOCKS)):
        history, fresh = store.table(name), diff.new[name]
        if history is None:
            tables[name] = fresh.withColumn("valid_from", F.lit(commit)).withColumn("valid_to", F.lit(None).cast("string"))
            continue
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in history.schema if f.name not in fresh.columns]
        tables[name] = apply_changes(history, fresh.select("*", *rest), diff.of(entity), commit)
    store.write(commit, **tables)


def update_from_git(store: GraphStore, repo: str, old: str, new: str, project: str, most: int = 100_000) -> Diff:
    """Bring a stored graph from one commit to another; an error, and nothing written, if it is estimated too large."""
    spark = store.spark
    estimate = dry_run(spark, repo, old, new, most).first()
    if estimate.exceeds:
        raise TooLarge(estimate.warning)
    diff = compute_diff(spark, repo, old, new, project, store.table("nodes"))
    apply_diff(store, diff, new)
    return diff


def workspace_diff(store: GraphStore, repo: str, project: str) -> Diff:
    """HEAD against the working tree."""
    return compute_diff(store.spark, repo, "HEAD", None, project, store.table("nodes"))


def apply_workspace_diff(store: GraphStore, repo: str, project: str) -> Diff:
    """Apply the working tree's changes under the commit that the store is at: its name doesn't move."""
    diff = workspace_diff(store, repo, project)
    now = store.current()
    apply_diff(store, diff, now[0] if now else WORKSPACE)
    return diff


def results(diff: Diff) -> DataFrame:
    """Changed nodes in the unified result's columns; edge_type is ADDED, UPDATED or DELETED."""
    from .operators.output import standard

    kind = F.upper("change")
    new = diff.new["nodes"].join(diff.of("node").filter("change <> 'deleted'").select("id", "change"), "id")
    old = diff.old["nodes"].join(diff.of("node").filter("change = 'deleted'").select("id", "change"), "id")
    return standard(new, edge_type=kind).unionByName(standard(old, edge_type=kind))
