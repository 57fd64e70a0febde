"""Index statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_by(df: DataFrame, column: str, group: str) -> DataFrame:
    """(stat, key, n), commonest first."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(group).alias("stat"), "key", "n")


def index_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(stat, key, n): nodes by kind and language, edges by kind, distinct files and totals; the version pointer isn't counted.

    Each table is read once: all figures come from its counts by kind, language and file, whose exchange is reused.
    """
    n = nodes.filter(F.col("kind") != "CurrentVersion").groupBy("kind", "lang", "file_path").agg(F.count(F.lit(1)).alias("m"))
    e = edges.groupBy("kind").agg(F.count(F.lit(1)).alias("m"))

    def by(df: DataFrame, column: str, stat: str) -> DataFrame:
        return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.sum("m").alias("n")).select(F.lit(stat).alias("stat"), "key", "n")

    def one(df: DataFrame, value: Column, stat: str) -> DataFrame:
        return df.agg(value.alias("n")).select(F.lit(stat).alias("stat"), F.lit("all").alias("key"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))

    parts = [by(n, "kind", "node_kind"), by(n, "lang", "lang"), by(e, "kind", "edge_kind"), one(n, F.count_distinct("file_path"), "files"), one(n, F.sum("m"), "nodes"), one(e, F.sum("m"), "edges")]
    return reduce(DataFrame.unionByName, parts)
