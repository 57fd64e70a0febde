"""Training-corpus pipeline: each stage reads what the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, with the columns of ``docs`` for all stages but the last, which returns packed pieces.
No stage's verdict can be written in SQL (the first needs a tokeniser), so ORACLE_SQL
is None and tests/llm/test_pipeline.py holds run() against brute force.

Repeated rows: the near-duplicate stage keeps one.  Null texts have no words, so the first stage drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm._spark import drop, save, table
from codequarry.llm.fertility import quality_rules
from codequarry.llm.hilbert import pack_along_curve
from codequarry.llm.substring import cut_duplicates
from codequarry.llm.superminhash import near_duplicates
from codequarry.llm.winnowing import contamination


def _with_text(rows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The carried columns of docs with a new text, and its length where docs has one."""
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col(text).alias(c))
        elif c == "n_chars":
            cols.append(F.char_length(text).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(f"carried.`{c}`"))
    return rows.select(*cols)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules(docs, carry=True).filter("kept").select("carried.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest doc_id; of repeated rows, one.

    Shingles have five words, as everywhere but in query op9, whose contract has four.
    """
    got = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    mine = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("carried"), F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("hash"))
    kept = mine.join(got, F.col("id").eqNullSafe(F.col("kept_id")) & F.col("hash").eqNullSafe(F.col("kept_hash")))
    return kept.dropDuplicates(["id", "hash"]).select("carried.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of smaller doc_id has; what is left keeps its lines, and texts that lose no word stay as they are."""
    got = cut_duplicates(docs, carry=True)
    got = got.withColumn("_text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("carried.text")))
    return _with_text(got, docs, "_text")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others any benchmark passage is cut, by the words of the document's text."""
    got = contamination(docs, table(spark, sf_dir, "benchmark"), carry=True).filter("not contaminated")
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    # Each word with what follows it is a part; the text before the first word is part 0.
    parts = F.expr(f"regexp_extract_all(carried.text, r'(?s)^[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+|{word}[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*', 0)")
    got = got.withColumn("_parts", F.when(F.col("n_hit") > 0, parts))
    lead = (F.size("_parts") - F.col("n_words")).cast("long")
    keep = F.filter("_parts", lambda x, i: ~F.exists("runs", lambda r: (i >= r[0] + lead) & (i < r[1] + lead)))
    got = got.withColumn("_text", F.when(F.col("n_hit") > 0, F.array_join(keep, "")).otherwise(F.col("carried.text")))
    return _with_text(got, docs, "_text")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of all that is left."""
    return pack_along_curve(docs, with_ids=False).drop("ids")


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontaminate), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what passes between two stages is written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
        drop(*[before] * (before is not None))
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
