"""Nested blocks of functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import current


def blocks_for_function(blocks: DataFrame, function_id: str, block_type: str | None = None, limit: int = 100) -> DataFrame:
    found = current(blocks).filter(F.col("parent_function_id") == function_id)
    found = found if block_type is None else found.filter(F.col("block_type") == block_type)
    return found.orderBy("start_line", "id").limit(limit)


def search_blocks(blocks: DataFrame, block_type: str | None = None, min_nesting: int = 1, lang: str | None = None, limit: int = 50, by_file: bool = False) -> DataFrame:
    found = current(blocks).filter(F.col("nesting_depth") >= min_nesting)
    found = found if block_type is None else found.filter(F.col("block_type") == block_type)
    found = found if lang is None else found.filter(F.col("lang") == lang)
    order = ["file_path", "start_line", "id"] if by_file else [F.desc("nesting_depth"), "start_line", "id"]
    return found.orderBy(*order).limit(limit)


def lambda_blocks(blocks: DataFrame, with_captures: bool = False, lang: str | None = None, limit: int = 50) -> DataFrame:
    found = current(blocks).filter(F.col("block_type") == "lambda")
    found = found.filter(F.size("captured_variables") > 0) if with_captures else found
    found = found if lang is None else found.filter(F.col("lang") == lang)
    return found.orderBy(F.desc(F.size("captured_variables")), "start_line", "id").limit(limit)


def block_statistics(blocks: DataFrame, function_id: str | None = None) -> DataFrame:
    """One row: total, a count of each of seven types, average and largest nesting (zeros without blocks)."""
    found = current(blocks) if function_id is None else current(blocks).filter(F.col("parent_function_id") == function_id)
    types = ["if", "for", "while", "try", "lambda", "with", "match"]
    by = [F.count_if(F.col("block_type") == t).alias(f"n_{t}") for t in types]
    return found.agg(F.count(F.lit(1)).alias("total"), *by, F.round(F.coalesce(F.avg("nesting_depth"), F.lit(0.0)), 6).alias("avg_nesting"), F.coalesce(F.max("nesting_depth"), F.lit(0)).alias("max_nesting"))


def expire_blocks(blocks: DataFrame, function_id: str, commit: str) -> DataFrame:
    hit = (F.col("parent_function_id") == function_id) & F.col("valid_to").isNull()
    return blocks.withColumn("valid_to", F.when(hit, F.lit(commit)).otherwise(F.col("valid_to")))


def snippet(files: DataFrame, context: int = 0) -> DataFrame:
    """Adds ``snippet`` to rows (text, start_line, end_line): the lines asked for, clamped, and ``context`` lines around.

    With context, or over 20 lines, lines are numbered and those asked for marked by ``>``.  Binary text (a NUL in its first 8192 characters) gives ''.
    """
    lines = F.split("text", "\n")
    n = F.size(lines)
    first = F.greatest(F.lit(1), F.least(F.col("start_line"), n))
    last = F.greatest(first, F.least(F.col("end_line"), n))
    lo, hi = F.greatest(F.lit(1), first - context), F.least(n, last + context)
    part = F.slice(lines, lo, hi - lo + 1)
    numbered = F.transform(part, lambda x, i: F.concat(F.when((i + lo).between(first, last), ">").otherwise(" "), F.lpad((i + lo).cast("string"), 4, " "), F.lit(" "), x))
    plain = F.when(F.lit(context > 0) | (last - first + 1 > 20), F.array_join(numbered, "\n")).otherwise(F.array_join(part, "\n"))
    return files.withColumn("snippet", F.when(F.instr(F.substring("text", 1, 8192), "\x00") > 0, "").otherwise(plain))


def block_source(blocks: DataFrame, files: DataFrame, block_id: str) -> DataFrame:
    found = current(blocks).filter(F.col("id") == block_id).limit(1)
    return snippet(found.join(files.select("file_path", "text"), "file_path")).select("id", "snippet")


def to_standard(blocks: DataFrame) -> DataFrame:
    """Blocks in the columns of the unified result."""
    name = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.concat("block_type", F.lit("_block")))
    label = F.concat("parent_function_id", F.lit("."), "block_type", F.lit("@"), F.col("start_line").cast("string"))
    return blocks.select("id", name.alias("name"), label.alias("qualified_name"), F.lit("Block").alias("kind"), "lang", "file_path", "start_line", "end_line")
