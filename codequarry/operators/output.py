"""Result rows as JSON lines, Markdown and the unified result columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STANDARD = ["id", "name", "qualified_name", "kind", "lang", "file_path", "start_line", "end_line", "score", "edge_type", "metadata"]


def standard(nodes: DataFrame, score: Column | None = None, edge_type: Column | None = None) -> DataFrame:
    """Nodes in the unified result's columns; metadata is a map of the rest that has a value."""
    rest = [c for c in ("signature", "code_hash", "valid_from") if c in nodes.columns]
    pairs = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in rest]), lambda x: x["value"].isNotNull())) if rest else F.create_map().cast("map<string,string>")
    end = F.col("end_line") if "end_line" in nodes.columns else F.col("start_line")
    return nodes.select("id", "name", "qualified_name", "kind", "lang", "file_path", "start_line", end.alias("end_line"), (F.lit(0.0) if score is None else score).alias("score"), (F.lit(None).cast("string") if edge_type is None else edge_type).alias("edge_type"), pairs.alias("metadata"))


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON object per row; scores have three decimals."""
    out = rows.withColumn("score", F.round("score", 3)) if "score" in rows.columns else rows
    return out.select(F.to_json(F.struct(*[F.col(c) for c in out.columns])).alias("value"))


def markdown(rows: DataFrame) -> DataFrame:
    """One Markdown item per row of ``standard``; a score of 0 is left out."""
    where = F.concat(F.lit("`"), "file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("`"))
    score = F.when(F.col("score") > 0, F.concat(F.lit("score "), F.format_number("score", 3)))
    return rows.select(F.concat(F.lit("- "), F.concat_ws(" ", F.concat(F.lit("**"), "qualified_name", F.lit("**")), F.concat(F.lit("("), "kind", F.lit(")")), where, score)).alias("value"))


def table_lines(rows: DataFrame, width: int = 40) -> DataFrame:
    """One aligned line per row for people: every column cut or padded to ``width``."""
    return rows.select(F.rtrim(F.concat_ws(" ", *[F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), width, " ") for c in rows.columns])).alias("value"))
