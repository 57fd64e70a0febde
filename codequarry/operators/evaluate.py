"""Retrieval quality: precision, recall, F1, DCG and NDCG, and a grid of weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prf(truth: DataFrame, returned: DataFrame, on: list[str], queries: DataFrame | None = None) -> DataFrame:
    """(query_id, tp, fp, fn, precision, recall, f1), truth and returned being sets of (query_id, *on).

    queries: (query_id) of all that were asked: one with nothing expected and nothing returned has precision and recall 1.
    Nothing expected but something returned, or the other way round, gives 0.
    """
    keys = ["query_id", *on]
    t, r = truth.select(*keys).distinct().withColumn("_t", F.lit(1)), returned.select(*keys).distinct().withColumn("_r", F.lit(1))
    both = t.join(r, keys, "full_outer")
    n = both.groupBy("query_id").agg(F.count_if(F.col("_t").isNotNull() & F.col("_r").isNotNull()).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"), F.count_if(F.col("_r").isNull()).alias("fn"))
    if queries is not None:
        n = queries.select("query_id").distinct().join(n, "query_id", "left").fillna(0, ["tp", "fp", "fn"])
        none = (F.col("tp") + F.col("fp") + F.col("fn")) == 0
        ratio = lambda d: F.when(none, 1.0).otherwise(F.coalesce(F.col("tp") / F.nullif(d, F.lit(0)), F.lit(0.0)))
        n = n.withColumn("precision", ratio(F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp") + F.col("fn")))
        return n.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))
    part = lambda d: F.coalesce(F.col("tp") / F.nullif(d, F.lit(0)), F.lit(0.0))
    n = n.withColumn("precision", part(F.col("tp") + F.col("fp"))).withColumn("recall", part(F.col("tp") + F.col("fn")))
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return n.withColumn("f1", f1)


def averages(scores: DataFrame, limits: DataFrame) -> DataFrame:
    """Macro averages and pass rate; limits: (query_id, min_precision, min_recall)."""
    j = scores.join(limits, "query_id")
    ok = (F.col("precision") >= F.col("min_precision")) & (F.col("recall") >= F.col("min_recall"))
    return j.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.avg(ok.cast("double")).alias("pass_rate"))


def ndcg(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, dcg, ideal, ndcg) of ranked (query_id, id, rank from 1) and relevant (query_id, id, gain)."""
    gain = lambda place: F.col("gain") / F.log2(F.col(place) + 1.0)
    got = ranked.filter(F.col("rank") <= k).join(relevant, ["query_id", "id"]).groupBy("query_id").agg(F.sum(gain("rank")).alias("dcg"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "id"))
    best = relevant.withColumn("n", n).filter(F.col("n") <= k).groupBy("query_id").agg(F.sum(gain("n")).alias("ideal"))
    out = best.join(got, "query_id", "left").withColumn("dcg", F.coalesce("dcg", F.lit(0.0)))
    return out.select("query_id", "dcg", "ideal", F.coalesce(F.col("dcg") / F.nullif(F.col("ideal"), F.lit(0.0)), F.lit(0.0)).alias("ndcg"))


def spread(scores: DataFrame, column: str = "ndcg") -> DataFrame:
    c = F.col(column)
    return scores.agg(F.avg(c).alias("avg"), F.min(c).alias("min"), F.max(c).alias("max"), F.stddev_pop(c).alias("std"))


def weight_grid(spark, steps: int = 10) -> DataFrame:
    """(vector_weight, keyword_weight) in steps, without both 0."""
    n = steps + 1
    both = spark.range(1, n * n).select(F.expr(f"id div {n}").alias("v"), (F.col("id") % n).alias("k"))
    return both.select((F.col("v") / steps).alias("vector_weight"), (F.col("k") / steps).alias("keyword_weight"))


def resolve_expected(expected: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, id) of expected (query_id, qualified_name, file_path): by qualified name and file, else by qualified name alone; the first by id."""
    n = nodes.select("id", "qualified_name", "file_path")
    e = expected.select("query_id", "qualified_name", "file_path").withColumn("_e", F.monotonically_increasing_id())
    both = e.join(n, ["qualified_name", "file_path"]).groupBy("_e", "query_id").agg(F.min("id").alias("id"))
    rest = e.join(both.select("_e"), "_e", "left_anti").drop("file_path").join(n.drop("file_path"), "qualified_name").groupBy("_e", "query_id").agg(F.min("id").alias("id"))
    return both.unionByName(rest).select("query_id", "id")


def sides(vector: DataFrame, keyword: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, vector, keyword): NDCG of each pure ranking."""
    a, b = ndcg(vector, relevant, k).select("query_id", F.col("ndcg").alias("vector")), ndcg(keyword, relevant, k).select("query_id", F.col("ndcg").alias("keyword"))
    return a.join(b, "query_id", "full_outer")


def run_queries(queries: list[dict], nodes: DataFrame, edges: DataFrame, semantic=None) -> DataFrame:
    """(query_id, id) of what the tools return for benchmark queries (id, expected_tool, expected_params); names of tools and parameters are normalised.

    semantic: a function (text, limit, lang, kind) -> DataFrame with id, for the semantic tool.
    """
    from . import lookup, references, signature, traverse

    found = None
    for q in queries:  # a benchmark's few queries, each a plan of its own
        p = {_PARAMS.get(k, k): v for k, v in q["expected_params"].items()}
        tool = _TOOLS.get(q["expected_tool"], q["expected_tool"])
        limit = int(p.get("limit", 20))
        name, lang, kind = p.get("name"), p.get("lang"), p.get("kind")
        if tool == "definition":
            out = lookup.find_definition(nodes, name, kind, lang, limit)
        elif tool == "references":
            out = references.find_references(lookup.find_definition(nodes, name, kind, lang), nodes, edges, limit).select(F.col("from_id").alias("id"))
        elif tool == "callers":
            out = traverse.callers_by_name(nodes, edges, name, int(p.get("depth", 1)), kind, lang)
        elif tool == "signature":
            out = signature.search_by_signature(nodes, p["signature"], lang, limit)
        elif tool == "semantic" and semantic is not None:
            out = semantic(p.get("query", ""), limit, lang, kind)
        else:
            raise ValueError(f"unknown tool {q['expected_tool']!r}")
        one = out.select(F.lit(q["id"]).alias("query_id"), "id")
        found = one if found is None else found.unionByName(one)
    return found


_TOOLS = {"find_definition": "definition", "goto": "definition", "find_references": "references", "refs": "references", "find_callers": "callers", "search_by_signature": "signature", "sig": "signature", "semantic_search": "semantic", "query": "semantic"}
_PARAMS = {"symbol": "name", "symbol_name": "name", "function_name": "name", "search": "signature", "pattern": "signature", "text": "query", "max_depth": "depth", "language": "lang", "top_k": "limit"}
