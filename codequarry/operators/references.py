"""References to definitions: counts, and one ranked union that is paged as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SUPER_KINDS
from .lookup import current
from .traverse import live_edges


def ranked_references(definitions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All references to the definitions, in order: definition (by qualified name), branch (calls, types, supertypes), the referring node."""
    # Definitions are a limited lookup's result, so their rank needs no partitions.
    ranked = definitions.select(F.col("id").alias("to_id"), F.row_number().over(Window.orderBy("qualified_name", "id")).alias("def_rank"))
    branch = F.when(F.col("kind") == "CALLS", 0).when(F.col("kind") == "TYPES", 1).when(F.col("kind").isin(*SUPER_KINDS), 2)
    live = current(nodes).select(F.col("id").alias("to_id"))
    refs = current(edges).withColumn("branch", branch).filter(F.col("branch").isNotNull())
    src = current(nodes).select(F.col("id").alias("from_id"), "qualified_name", "file_path", "start_line")
    # The few definitions meet the edges first, and only what refers to them is looked up.
    out = ranked.join(live, "to_id", "left_semi").join(refs, "to_id").join(src, "from_id")
    return out.select("def_rank", "branch", "qualified_name", F.col("id").alias("edge_id"), F.col("kind").alias("edge_kind"), "from_id", "to_id", "file_path", "start_line")


def find_references(definitions: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    limit, offset = max(1, min(limit, 500)), max(0, offset)
    return ranked_references(definitions, nodes, edges).orderBy("def_rank", "branch", "qualified_name", "edge_id").offset(offset).limit(limit)


def reference_total(definitions: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One row: total, and whether more follow the page."""
    return ranked_references(definitions, nodes, edges).agg(F.count(F.lit(1)).alias("total")).withColumn("has_more", F.col("total") > offset + limit)


def references_tool(definitions: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """The tool's page: at most 1000 are asked for, at most 500 given."""
    return find_references(definitions, nodes, edges, min(limit, 1000), offset)


def reference_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(to_id, n) for every referenced live node."""
    return live_edges(edges, nodes).filter(F.col("kind").isin("CALLS", "TYPES", *SUPER_KINDS)).groupBy("to_id").agg(F.count(F.lit(1)).alias("n"))


def references_by_file(refs: DataFrame, top: int = 10) -> DataFrame:
    """The first ``top`` references of each file."""
    n = F.row_number().over(Window.partitionBy("file_path").orderBy("def_rank", "branch", "qualified_name", "edge_id"))
    return refs.withColumn("n", n).filter(F.col("n") <= top)
