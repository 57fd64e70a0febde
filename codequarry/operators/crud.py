"""Rows of nodes and edges by key: insert, update, delete, and edges at a node. Every function returns the new table, or the rows asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EDGE_KINDS
from .versioning import upsert_edges


def insert(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Rows and new ones whose id isn't there yet; columns that ``new`` lacks are null."""
    fresh = new.join(rows.select("id"), "id", "left_anti").dropDuplicates(["id"])
    return rows.unionByName(fresh.select(*[c for c in rows.columns if c in fresh.columns]), allowMissingColumns=True)


def update_properties(rows: DataFrame, node_id: str, properties: dict[str, object]) -> DataFrame:
    """Some columns of one row set, the others as they were; unknown columns are an error."""
    unknown = set(properties) - set(rows.columns)
    if unknown or "id" in properties:
        raise ValueError(f"cannot set {sorted(unknown | ({'id'} & set(properties)))}")
    hit = F.col("id") == node_id
    return rows.select(*[F.when(hit, F.lit(properties[c]).cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in properties else F.col(c) for c in rows.columns])


def delete_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id").distinct(), "id", "left_anti").select(*rows.columns)


def create_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with new ones whose ends are nodes; of an id that is there, the new values count."""
    return upsert_edges(edges, new, nodes)


def get_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select("id").distinct(), "id", "left_semi")


def get_edge(edges: DataFrame, edge_id: str) -> DataFrame:
    return edges.filter(F.col("id") == edge_id).limit(1)


def edge_exists(edges: DataFrame, edge_id: str) -> bool:
    return not edges.filter(F.col("id") == edge_id).isEmpty()


def _kind(kind: str | None) -> Column:
    if kind is None:
        return F.lit(True)
    if kind not in EDGE_KINDS:
        raise ValueError(f"unknown edge kind {kind!r}")
    return F.col("kind") == kind


def edges_between(edges: DataFrame, from_id: str, to_id: str, kind: str | None = None) -> DataFrame:
    return edges.filter((F.col("from_id") == from_id) & (F.col("to_id") == to_id) & _kind(kind)).orderBy("id")


def out_edges(edges: DataFrame, node_id: str, kind: str | None = None, limit: int | None = None) -> DataFrame:
    found = edges.filter((F.col("from_id") == node_id) & _kind(kind)).orderBy("id")
    return found if limit is None else found.limit(limit)


def in_edges(edges: DataFrame, node_id: str, kind: str | None = None, limit: int | None = None) -> DataFrame:
    found = edges.filter((F.col("to_id") == node_id) & _kind(kind)).orderBy("id")
    return found if limit is None else found.limit(limit)
