"""From source files to a graph: the full-index pipeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from .sources import extract as X


def index(files: DataFrame, project: str, commit: str) -> dict[str, DataFrame]:
    """nodes, edges_raw, edges and blocks of files (path, lang, content), in the columns of ``schema``; names are resolved over the whole project.

    edges: those of edges_raw whose ends are nodes, and CONTAINS_BLOCK edges of blocks.
    ``raw`` is read several times; persist or write ``extract(files)`` first for large trees and pass it through ``from_raw``.
    """
    return from_raw(X.extract(files), files, project, commit)


def from_raw(raw: DataFrame, files: DataFrame, project: str, commit: str, known: DataFrame | None = None) -> dict[str, DataFrame]:
    """known: nodes of other files, which names may also stand for."""
    symbols = X.nodes_of(raw, project, commit)
    nodes = symbols.unionByName(X.file_nodes(files, project, commit), allowMissingColumns=True)
    blocks = X.blocks_of(raw, project, commit)
    own = X.block_edges(blocks, commit)
    every = symbols if known is None else symbols.unionByName(known.select(*[c for c in symbols.columns if c in known.columns]), allowMissingColumns=True)
    parts = [X.resolve(raw, every, project, commit), X.containment(raw, project, commit), X.outward_edges(raw, project, commit)]
    edges = reduce(DataFrame.unionByName, parts)
    ids = nodes.select("id") if known is None else nodes.select("id").unionByName(known.select("id"))
    whole = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return {"nodes": nodes, "edges_raw": edges.unionByName(own), "edges": whole.select(*edges.columns).unionByName(own), "blocks": blocks}
