"""Summaries of nodes: prompt context, reading a model's answer, and the cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CALL_KINDS
from .lookup import current
from .traverse import live_edges

ANSWER = "summary STRING, purpose STRING, inputs ARRAY<MAP<STRING,STRING>>, outputs ARRAY<MAP<STRING,STRING>>, side_effects ARRAY<STRING>, complexity STRING, tags ARRAY<STRING>, notes STRING"


def contexts(nodes: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """(id, callers, callees): up to ``most`` names each as '- name' lines, or '- (none)'."""
    calls = live_edges(edges, nodes).filter(F.col("kind").isin(*CALL_KINDS)).select("from_id", "to_id").distinct()
    names = current(nodes).select("id", "qualified_name")

    def side(mine: str, other: str, name: str) -> DataFrame:
        j = calls.join(names, F.col(other) == F.col("id")).select(F.col(mine).alias("node"), "qualified_name", F.col(other).alias("o"))
        n = F.row_number().over(Window.partitionBy("node").orderBy("qualified_name", "o"))
        top = j.withColumn("n", n).filter(F.col("n") <= most).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "qualified_name"))).alias("l"))
        return top.select(F.col("node").alias("id"), F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x["qualified_name"])), "\n").alias(name))

    none = F.lit("- (none)")
    out = current(nodes).select("id").join(side("to_id", "from_id", "callers"), "id", "left").join(side("from_id", "to_id", "callees"), "id", "left")
    return out.select("id", F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"))


def parse_answer(text: Column) -> Column:
    """The JSON object in a model's answer, fenced or with words around it; null if there is none."""
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.from_json(F.nullif(inner, F.lit("")), ANSWER)


def still_valid(cache: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cached summaries (node_id, code_hash, ...) whose node's code hasn't changed."""
    n = current(nodes).select(F.col("id").alias("node_id"), "code_hash")
    return cache.join(n, ["node_id", "code_hash"], "left_semi")


def to_summarise(nodes: DataFrame, cache: DataFrame) -> DataFrame:
    n = current(nodes).filter(F.col("kind").isin("Class", "Interface", "Struct", "Enum", "Trait", "Function", "Method", "Constructor"))
    return n.join(cache.select(F.col("node_id").alias("id"), "code_hash"), ["id", "code_hash"], "left_anti")


def extractive(nodes: DataFrame) -> DataFrame:
    """A summary without a model: kind, name and signature in a sentence."""
    text = F.concat("kind", F.lit(" "), "qualified_name", F.coalesce(F.concat(F.lit(" with signature "), "signature"), F.lit("")), F.lit("."))
    return nodes.select(F.col("id").alias("node_id"), "code_hash", text.alias("summary"))


PROMPT = (
    "Describe this {kind} of a {lang} code base as one JSON object with the fields summary, purpose, inputs, outputs, side_effects, complexity, tags and notes.\n"
    "Name: {qualified_name}\nSignature: {signature}\nFile: {file_path}\nCallers:\n{callers}\nCallees:\n{callees}\nCode:\n{code}\n"
)


def prompts(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node_id, code_hash, prompt) of live nodes; sources: (id, code)."""
    n = current(nodes).join(contexts(nodes, edges), "id").join(sources.select("id", "code"), "id", "left")
    parts, out = PROMPT.replace("{", "\0{").replace("}", "}\0").split("\0"), []
    for p in parts:
        out.append(F.coalesce(F.col(p[1:-1]), F.lit("")) if p.startswith("{") else F.lit(p))
    return n.select(F.col("id").alias("node_id"), "code_hash", F.concat(*out).alias("prompt"))


def summarise(prompts_: DataFrame, nodes: DataFrame, model) -> DataFrame:
    """(node_id, code_hash, summary, purpose, ..., failed) by ``model``, a function from a list of prompts to a list of answers (None: no answer).

    The model is called once for an Arrow batch of prompts.  Where it gives no answer, or none that can be read, the record is ``extractive``'s.
    """
    import pyarrow as pa

    def ask(batches):
        for b in batches:
            got = model(b.column("prompt").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("node_id"), b.column("code_hash"), pa.array(got, pa.string())], names=["node_id", "code_hash", "answer"])

    read = prompts_.select("node_id", "code_hash", "prompt").mapInArrow(ask, "node_id string, code_hash string, answer string").withColumn("a", parse_answer(F.col("answer")))
    plain = extractive(nodes).select("node_id", F.col("summary").alias("_plain"))
    fields = [x.split(" ")[0] for x in ANSWER.split(", ")][1:]
    out = read.join(plain, "node_id", "left")
    return out.select("node_id", "code_hash", F.coalesce("a.summary", "_plain").alias("summary"), *[F.col(f"a.{f}").alias(f) for f in fields], F.col("a.summary").isNull().alias("failed"))
