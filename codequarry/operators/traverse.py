"""Bounded-depth traversal: one kernel, and the queries that it serves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CALL_KINDS, SUPER_KINDS
from ..scratch import save
from .lookup import current, find_definition


def reach(edges: DataFrame, seeds: DataFrame, kinds: list[str] | None, direction: str, max_depth: int) -> DataFrame:
    """(seed_id, id, depth): all ends of walks of 1..max_depth edges from each seed (seed_id), at their least depth.

    direction: "out", "in" or "both".  A seed is among its own results if a cycle leads back.
    Hops are unrolled and made distinct, so the plan is lazy and rows per
    hop are bounded by seeds times reachable nodes.
    """
    e = edges if kinds is None else edges.filter(F.col("kind").isin(*kinds))
    out, back = e.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")), e.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"))
    hop = (out if direction == "out" else back if direction == "in" else out.unionByName(back)).distinct()
    front, levels = seeds.select("seed_id", F.col("seed_id").alias("id")).distinct(), []
    for depth in range(1, max_depth + 1):
        front = front.join(hop, front["id"] == hop["a"]).select("seed_id", F.col("b").alias("id")).distinct()
        levels.append(front.withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.unionByName, levels).groupBy("seed_id", "id").agg(F.min("depth").alias("depth"))


def live_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Live edges between live nodes."""
    ids = current(nodes).select("id")
    e = current(edges)
    e = e.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
    return e.join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def reach_live(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, kinds: list[str] | None, direction: str, max_depth: int, ends_only: bool = False) -> DataFrame:
    """(seed_id, id, depth) as ``reach`` over live edges between live nodes, from live seeds (seed_id).

    The frontier comes first, and is written after each hop: a hop meets the edge table once, filtered by kind and liveness,
    and only what it finds is looked up among the nodes; a short frontier goes to the tasks whole, so that neither edges nor
    nodes are moved.  What was found before is not walked from again.  ends_only: dead edges and nodes may lie on the way.
    """
    e = edges if ends_only else current(edges)
    e = e if kinds is None else e.filter(F.col("kind").isin(*kinds))
    out, back = e.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")), e.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"))
    hop = out if direction == "out" else back if direction == "in" else out.unionByName(back)
    alive = current(nodes).select("id")
    front, found = save(seeds.select("seed_id", F.col("seed_id").alias("id")).distinct(), "front"), None
    for depth in range(1, max_depth + 1):
        ends = hop.join(front, hop["a"] == front["id"]).select("seed_id", F.col("b").alias("id")).distinct()
        if found is not None:
            ends = ends.join(found, ["seed_id", "id"], "left_anti")
        if not ends_only:
            ends = alive.join(save(ends, "ends"), "id").select("seed_id", "id").distinct()
        front = save(ends, "front")
        level = front.withColumn("depth", F.lit(depth))
        found = level if found is None else found.unionByName(level)
        if front.isEmpty():
            break
    return found


def among(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes whose id is among ids (id), which are written first, so that a short list moves no nodes."""
    return nodes.join(save(ids.select("id").distinct(), "ids"), "id", "left_semi")


def _related(nodes: DataFrame, edges: DataFrame, node_id: str, kinds: list[str], direction: str, depth: int, limit: int, base_kinds: tuple[str, ...] = (), ends_only: bool = False) -> DataFrame:
    """ends_only: dead edges and nodes may lie on the way; only the start and what is found must be live."""
    seed = current(nodes).filter(F.col("id") == node_id)
    seed = seed.filter(F.col("kind").isin(*base_kinds)) if base_kinds else seed
    found = reach_live(nodes, edges, seed.select(F.col("id").alias("seed_id")), kinds, direction, max(1, min(depth, 5)), ends_only)
    return current(nodes).join(found.select("id", "depth"), "id").orderBy("qualified_name", "id").limit(limit)


def find_callers(nodes: DataFrame, edges: DataFrame, node_id: str, max_depth: int = 1, ends_only: bool = False) -> DataFrame:
    return _related(nodes, edges, node_id, CALL_KINDS, "in", max_depth, 200, ends_only=ends_only)


def find_callees(nodes: DataFrame, edges: DataFrame, node_id: str, max_depth: int = 1, ends_only: bool = False) -> DataFrame:
    return _related(nodes, edges, node_id, CALL_KINDS, "out", max_depth, 200, ends_only=ends_only)


def find_subclasses(nodes: DataFrame, edges: DataFrame, node_id: str, max_depth: int = 3) -> DataFrame:
    return _related(nodes, edges, node_id, SUPER_KINDS, "in", max_depth, 100)


def find_superclasses(nodes: DataFrame, edges: DataFrame, node_id: str, max_depth: int = 3) -> DataFrame:
    return _related(nodes, edges, node_id, SUPER_KINDS, "out", max_depth, 100)


def find_overrides(nodes: DataFrame, edges: DataFrame, node_id: str, max_depth: int = 3) -> DataFrame:
    return _related(nodes, edges, node_id, ["OVERRIDES"], "in", max_depth, 100, ("Method", "Function"))


def call_graph(nodes: DataFrame, edges: DataFrame, node_id: str, max_depth: int = 1, top: int = 20) -> DataFrame:
    """Callers and callees, ``top`` of each, told apart by ``direction``."""
    callers = find_callers(nodes, edges, node_id, max_depth).limit(top).withColumn("direction", F.lit("caller"))
    return callers.unionByName(find_callees(nodes, edges, node_id, max_depth).limit(top).withColumn("direction", F.lit("callee")))


def expand_neighbourhood(nodes: DataFrame, edges: DataFrame, node_id: str, depth: int = 1, edge_kinds: list[str] | None = None, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) within ``depth`` undirected hops; an edge belongs if one end is less than ``depth`` away.

    Of the edges the ``limit`` first by id are returned, of the nodes the start and all in reach.
    """
    depth = max(1, min(depth, 4))
    start = current(nodes).filter(F.col("id") == node_id).select(F.col("id").alias("seed_id"))
    near = reach_live(nodes, edges, start, edge_kinds, "both", depth).select("id", "depth").unionByName(start.select(F.col("seed_id").alias("id"), F.lit(0).alias("depth"))).groupBy("id").agg(F.min("depth").alias("depth"))
    near = save(near, "near")
    inner = near.filter(F.col("depth") < depth).select(F.col("id").alias("_end"))
    live = current(edges) if edge_kinds is None else current(edges).filter(F.col("kind").isin(*edge_kinds))
    at = lambda c: inner.select(F.col("_end").alias(c), F.lit(True).alias(f"_{c}"))
    touching = live.join(at("from_id"), "from_id", "left").join(at("to_id"), "to_id", "left").filter("_from_id or _to_id")
    touching = save(touching.select(*edges.columns).distinct(), "touching")
    alive = among(current(nodes).select("id"), touching.select(F.explode(F.array("from_id", "to_id")).alias("id")))
    alive = save(alive, "alive")
    touching = touching.join(alive.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(alive.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return among(current(nodes), near), touching.select(*edges.columns).orderBy("id").limit(limit)


def call_confidence(edges: DataFrame, edge_id: str) -> DataFrame:
    return edges.filter((F.col("id") == edge_id) & F.col("kind").isin(*CALL_KINDS)).select("id", "confidence").limit(1)


def call_confidences(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, confidence) of those of some edges (id) that are calls."""
    return edges.filter(F.col("kind").isin(*CALL_KINDS)).join(ids.select("id").distinct(), "id", "left_semi").select("id", "confidence")


def call_confidence_between(edges: DataFrame, from_id: str, to_id: str) -> DataFrame:
    return edges.filter((F.col("from_id") == from_id) & (F.col("to_id") == to_id) & F.col("kind").isin(*CALL_KINDS)).select("id", "confidence").orderBy("id")


def callers_by_name(nodes: DataFrame, edges: DataFrame, name: str, max_depth: int = 1, kind: str | None = None, lang: str | None = None) -> DataFrame:
    """Callers of the first definition of a name."""
    return _by_name(nodes, edges, name, max_depth, kind, lang, "in")


def callees_by_name(nodes: DataFrame, edges: DataFrame, name: str, max_depth: int = 1, kind: str | None = None, lang: str | None = None) -> DataFrame:
    return _by_name(nodes, edges, name, max_depth, kind, lang, "out")


def _by_name(nodes: DataFrame, edges: DataFrame, name: str, depth: int, kind: str | None, lang: str | None, direction: str) -> DataFrame:
    first = find_definition(nodes, name, kind, lang, 1).select(F.col("id").alias("seed_id"))
    found = reach_live(nodes, edges, first, CALL_KINDS, direction, max(1, min(depth, 5)))
    return current(nodes).join(found.select("id", "depth"), "id").orderBy("qualified_name", "id").limit(200)


def symbol_impact(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """One row: references, direct callers and direct callees of a node."""
    live = live_edges(edges.filter((F.col("to_id") == node_id) | (F.col("from_id") == node_id)), nodes)
    into, out = F.col("to_id") == node_id, F.col("from_id") == node_id
    call = F.col("kind").isin(*CALL_KINDS)
    ref = F.col("kind").isin("CALLS", "TYPES", *SUPER_KINDS)
    pick = lambda cond, c: F.count_distinct(F.when(cond, F.col(c)))
    return live.filter(into | out).agg(F.count_if(into & ref).alias("n_references"), pick(into & call, "from_id").alias("n_callers"), pick(out & call, "to_id").alias("n_callees"))
