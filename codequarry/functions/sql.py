"""Functions for SQL users: ids, cosine, and extraction as table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .workers import prepare

_SQL = {
    "node_id(project STRING, path STRING, kind STRING, qualified STRING) RETURNS STRING": "substr(sha2(concat_ws(':', project, path, kind, qualified), 256), 1, 24)",
    "edge_id(from_id STRING, kind STRING, to_id STRING, dep_kind STRING, raw_type STRING, confidence DOUBLE) RETURNS STRING": "substr(sha2(concat_ws(':', from_id, kind, to_id, coalesce(dep_kind, ''), coalesce(raw_type, ''), cast(coalesce(confidence, 0D) as string)), 256), 1, 24)",
    "block_id(path STRING, block_type STRING, parent STRING, start_line INT) RETURNS STRING": "substr(sha2(concat_ws(':', path, block_type, parent, cast(start_line as string)), 256), 1, 24)",
    "content_hash(text STRING) RETURNS STRING": "substr(sha2(text, 256), 1, 24)",
    "dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "dot(a, b) / nullif(sqrt(dot(a, a)) * sqrt(dot(b, b)), 0D)",
}


@udtf(returnType="what string, kind string, name string, owner string, start_line int, end_line int, signature string, target string, depth int")
class ExtractSymbols:
    """extract_symbols(path, lang, text): nodes, references and blocks of one source text."""

    def eval(self, path: str, lang: str, text: str):
        from codequarry.sources.extract import extract_text

        for r in extract_text(path, lang, text or ""):
            yield tuple(r.get(k) for k in ("what", "kind", "name", "src_name", "start_line", "end_line", "signature", "target", "depth"))


@udtf(returnType="block_type string, name string, owner string, start_line int, end_line int, depth int, captures array<string>")
class ExtractBlocks:
    """extract_blocks(path, lang, text): the nested blocks of one source text."""

    def eval(self, path: str, lang: str, text: str):
        from codequarry.sources.extract import extract_text

        for r in extract_text(path, lang, text or ""):
            if r["what"] == "block":
                yield r["kind"], r.get("name"), r.get("src_name"), r["start_line"], r["end_line"], r["depth"], r.get("captures")


@udtf(returnType="kind string, source string, target string, line int")
class ExtractReferences:
    """extract_references(path, lang, text): who refers to what by name in one source text."""

    def eval(self, path: str, lang: str, text: str):
        from codequarry.sources.extract import extract_text

        for r in extract_text(path, lang, text or ""):
            if r["what"] == "ref":
                yield r["kind"], r.get("src_name"), r.get("target"), r["start_line"]


@udtf(returnType="place int, name string")
class Identifiers:
    """identifiers(text): the identifiers of a text that are no stop words, in order."""

    def eval(self, text: str):
        import re

        from codequarry.operators.text import STOP_WORDS

        stops, seen = set(STOP_WORDS), set()
        for x in re.findall(r"\b[a-zA-Z_][a-zA-Z0-9_]*\b", text or ""):
            if len(x) > 2 and x.lower() not in stops and x not in seen and len(seen) < 10:
                seen.add(x)
                yield len(seen), x


def encode_udf(encode):
    """A vectorised SQL function text -> vector by ``encode``, a function from a list of texts to a list of vectors."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def run(texts):
        return pd.Series(encode(texts.fillna("").tolist()))

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return pandas_udf(run, "array<double>")


def register(spark: SparkSession, encode=None) -> None:
    """Make all of them known to a session; encode: what the function encode_text is by."""
    prepare(spark)
    for head, body in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for name, table in (("extract_symbols", ExtractSymbols), ("extract_blocks", ExtractBlocks), ("extract_references", ExtractReferences), ("identifiers", Identifiers)):
        spark.udtf.register(name, table)
    if encode is not None:
        spark.udf.register("encode_text", encode_udf(encode))
