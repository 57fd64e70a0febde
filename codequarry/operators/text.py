"""From free text to code: identifiers, and what they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookup import current

#: Words that are no identifiers (fixed values).
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might can this that these those i you he she it we they what which who when where why how all each every both few more most other "
    "some such no nor not only own same so than too very just because but and or if while for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "error exception failed failure success warning info debug trace log message code line file function method class module package import return value"
).split()
WORD, IDENTIFIER = r"[\p{L}\p{N}_]+", r"^[a-zA-Z_][a-zA-Z0-9_]*$"


def identifiers(text: Column, most: int = 10, longer_than: int = 2) -> Column:
    """The first ``most`` different identifiers that are no stop words, in order: whole words of ASCII letters, digits and underscores."""
    found = F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda x: x.rlike(IDENTIFIER))
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.slice(F.array_distinct(F.filter(found, lambda x: (F.length(x) > longer_than) & ~F.array_contains(stops, F.lower(x)))), 1, most)


def code_names(text: Column, scan: int = 2000, most: int = 20) -> Column:
    """Camel-case and dotted names in the first ``scan`` characters."""
    pattern = r"([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+|[A-Z][a-z0-9]+(?:[A-Z][A-Za-z0-9]*)+|[a-z]+(?:[A-Z][A-Za-z0-9]*)+)"
    return F.slice(F.array_distinct(F.regexp_extract_all(F.substring(text, 1, scan), F.lit(pattern), F.lit(1))), 1, most)


def enriched_query(text: Column, keep: int = 500) -> Column:
    """The names found, then the text's start: what is embedded for a search by text."""
    return F.concat_ws(" | ", F.nullif(F.array_join(code_names(text), " "), F.lit("")), F.substring(text, 1, keep))


def analyze_text(texts: DataFrame, nodes: DataFrame, limit: int = 10, per_name: int = 5, score: float = 0.7) -> DataFrame:
    """For texts (text_id, text): live nodes that one of their identifiers names, ``per_name`` each at a fixed score, the first ``limit``."""
    names = texts.select("text_id", F.posexplode(identifiers(F.col("text"))).alias("place", "name"))
    n = F.row_number().over(Window.partitionBy("name").orderBy("qualified_name", "id"))
    hit = names.join(current(nodes).withColumn("n", n).filter(F.col("n") <= per_name), "name")
    rank = F.row_number().over(Window.partitionBy("text_id").orderBy("place", "n", "id"))
    return hit.withColumn("rank", rank).filter(F.col("rank") <= limit).select("text_id", "rank", "name", "id", F.lit(score).alias("score"))


def text_to_code(texts: DataFrame, nodes: DataFrame, semantic: DataFrame, limit: int = 10) -> DataFrame:
    """analyze_text, filled up from semantic hits (text_id, id, score): names first, then hits not named, by score."""
    named = analyze_text(texts, nodes, limit).select("text_id", "rank", "id", "score").withColumn("tier", F.lit(0))
    rest = semantic.select("text_id", "id", "score").join(named.select("text_id", "id"), ["text_id", "id"], "left_anti").withColumn("tier", F.lit(1)).withColumn("rank", F.lit(0))
    n = F.row_number().over(Window.partitionBy("text_id").orderBy("tier", "rank", F.desc("score"), "id"))
    return named.unionByName(rest.select(*named.columns)).withColumn("rank", n).filter(F.col("rank") <= limit).select("text_id", "rank", "id", "score", F.when(F.col("tier") == 0, "name").otherwise("semantic").alias("how"))
