"""Vector, keyword and hybrid ranking."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.workers import prepare
from ..schema import EMBEDDABLE_KINDS

K1, B = 1.2, 0.75


def dot(a: Column, b: Column) -> Column:
    wide = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(wide, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def vector_topk(vectors: DataFrame, query: list[float], k: int = 10, where: Column | None = None) -> DataFrame:
    """The ``k`` vectors (id, embedding) nearest by cosine, after the filter; ties by id."""
    found = vectors if where is None else vectors.filter(where)
    literal = F.array(*[F.lit(float(x)) for x in query])
    return found.withColumn("score", cosine(F.col("embedding"), literal)).orderBy(F.desc("score"), "id").limit(k)


def vector_topk_with_fallback(vectors: DataFrame, query: list[float], k: int, where: Column) -> DataFrame:
    """As vector_topk; if the filter leaves fewer than ``k``, the rest comes from the unfiltered top k."""
    first = vector_topk(vectors, query, k, where)
    rest = vector_topk(vectors, query, k).join(first.select("id"), "id", "left_anti")
    both = first.withColumn("tier", F.lit(0)).unionByName(rest.withColumn("tier", F.lit(1)))
    return both.orderBy("tier", F.desc("score"), "id").limit(k)


QUERY_BLOCK = 2_000  #: queries that tasks hold at once
SCORES = 1_000_000  #: scores that a task holds at once
PLACES = 12  #: decimals by which scores are ranked: less is the noise of sums in another order


def _block_top(block, k: int):
    def run(batches):
        ids, q = block.value
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        step, least = max(1, SCORES // len(q)), np.full(len(q), -np.inf)
        best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)  # query's place, id, score
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                name = np.asarray(part.column("id"))
                flat = np.asarray(part.column("embedding").flatten(), dtype=np.float64).reshape(len(name), -1)
                size = np.linalg.norm(flat, axis=1, keepdims=True)
                score = q @ (flat / np.maximum(size, 1e-300)).T
                score[:, size[:, 0] == 0] = -np.inf
                near = np.round(score, PLACES)
                if len(name) > k:  # what is below the k-th is none of the k first
                    least = np.maximum(least, np.partition(near, len(name) - k, axis=1)[:, len(name) - k])
                i, j = np.nonzero((near >= least[:, None]) & np.isfinite(near))
                i, name, score = np.concatenate([best[0], i]), np.concatenate([best[1], name[j]]), np.concatenate([best[2], score[i, j]])
                order = np.lexsort((name, -np.round(score, PLACES), i))
                i, name, score = i[order], name[order], score[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                best = i[place < k], name[place < k], score[place < k]
                full = place == k - 1
                least[i[full]] = np.round(score[full], PLACES)
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", "id", "score"])

    return run


def vector_topk_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, score, rank) of queries (query_id, embedding) against all vectors (id, embedding), by cosine; ties by id.

    Ids are whole numbers, embeddings of one length.  Queries go to the tasks in blocks of at most ``block`` rows; each task
    keeps the best ``k`` of its vectors for each, so k rows per query and task are shuffled, and at most ``SCORES`` scores at once.
    Scores are ranked by ``PLACES`` decimals.  Vectors of length 0 match nothing.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = queries.select(F.col("query_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    parts = max(1, -(-rows.count() // block))
    blocks = rows.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    found = None
    for i in range(parts):
        got = blocks.filter(F.col("_b") == i).drop("_b").toArrow()  # about ``block`` rows
        if not got.num_rows:
            continue
        q = np.array(got.column("embedding").to_pylist(), dtype=np.float64)
        b = spark.sparkContext.broadcast((np.asarray(got.column("query_id")), q))
        one = vectors.select(F.col("id").cast("bigint"), F.col("embedding").cast("array<double>")).mapInArrow(_block_top(b, k), "query_id long, id long, score double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "query_id long, id long, score double, rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", PLACES)), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def update_vectors(vectors: DataFrame, fresh: DataFrame, gone: DataFrame) -> DataFrame:
    """Vectors without those deleted (id) or embedded anew, and the new ones."""
    stale = fresh.select("id").unionByName(gone.select("id")).distinct()
    return vectors.join(stale, "id", "left_anti").unionByName(fresh.select(*vectors.columns))


def nearest_by_lsh(vectors: DataFrame, query: list[float], k: int = 10, length: float = 0.5, tables: int = 8, seed: int = 1) -> DataFrame:
    """About the ``k`` nearest by cosine, from random-projection buckets: (id, score). Larger ``length`` and ``tables`` raise recall."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    unit = Normalizer(inputCol="v", outputCol="u").transform(vectors.select("id", array_to_vector("embedding").alias("v")))
    norm = sum(x * x for x in query) ** 0.5 or 1.0
    model = BucketedRandomProjectionLSH(inputCol="u", outputCol="h", bucketLength=length, numHashTables=tables, seed=seed).fit(unit)
    near = model.approxNearestNeighbors(unit, Vectors.dense([x / norm for x in query]), k, "d")
    return near.select("id", (1 - F.col("d") * F.col("d") / 2).alias("score")).orderBy(F.desc("score"), "id")


def above(scored: DataFrame, least: float) -> DataFrame:
    return scored.filter(F.col("score") >= least)


def tokens(text: Column) -> Column:
    """Lower-case words of ASCII letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]+)"), F.lit(1))


def inverted_index(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(term, id, tf, length): the full-text index of the fields, joined by blanks; a document's own row has the term ''."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields])
    words = docs.select("id", tokens(text).alias("w"))
    flat = words.select("id", F.size("w").alias("length"), F.explode(F.array_append("w", F.lit(""))).alias("term"))
    return flat.groupBy("term", "id", "length").agg(F.count(F.lit(1)).alias("tf"))


def bm25_of_index(index: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(id, score) as ``bm25``, from a stored inverted index: only the query's terms and the documents' own rows are read."""
    terms = sorted(set(_words(query)))
    corpus = index.filter("term = ''").agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"))
    hit = index.filter(F.col("term").isin(*terms)) if terms else index.limit(0)
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    one = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = hit.join(F.broadcast(df), "term").join(F.broadcast(corpus))  # a row for each of the query's words; one row
    return scored.groupBy("id").agg(F.sum(one).alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def bm25(docs: DataFrame, query: str, fields: list[str], limit: int = 20) -> DataFrame:
    """(id, score): BM25 of the query's different words; ties by id.

    Only the query's words leave the scan: other words count for lengths alone.
    """
    terms = sorted(set(_words(query)))
    text = F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields])
    base = docs.select("id", tokens(text).alias("w")).select("id", F.size("w").alias("n"), *[F.size(F.filter("w", _is(t))).alias(f"tf_{i}") for i, t in enumerate(terms)])
    freq = [F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))]
    corpus = base.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *freq)
    scored = base.join(F.broadcast(corpus))  # one row
    parts = []
    for i in range(len(terms)):
        tf, df = F.col(f"tf_{i}"), F.col(f"df_{i}")
        idf = F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
        parts.append(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / F.col("mean"))))
    score = reduce(Column.__add__, parts) if parts else F.lit(0.0)
    return scored.select("id", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def _is(term: str):
    return lambda x: x == term


def _words(text: str) -> list[str]:
    import re

    return re.findall(r"[a-z0-9_]+", text.lower())


def normalised(scored: DataFrame) -> DataFrame:
    """Scores of a ranked list (id, score; a top k, so small) moved to 0..1 by their range; all equal gives 1."""
    whole = scored.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"), F.collect_list(F.struct("id", "score")).alias("_l"))
    out = whole.select("_lo", "_hi", F.explode("_l").alias("_x"))
    share = F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise((F.col("_x.score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return out.select(F.col("_x.id").alias("id"), share.alias("score"))


def fuse(vector: DataFrame, keyword: DataFrame, vector_weight: float = 0.7, keyword_weight: float = 0.3, limit: int = 20) -> DataFrame:
    """(id, score) of two ranked lists (id, score): each normalised, weighted by its share, absent counting 0."""
    total = vector_weight + keyword_weight
    if total <= 0:
        raise ValueError("weights must not both be 0")
    v = normalised(vector.select("id", "score")).withColumnRenamed("score", "v")
    k = normalised(keyword.select("id", "score")).withColumnRenamed("score", "k")
    part = lambda c, w: F.coalesce(F.col(c), F.lit(0.0)) * (w / total)
    return v.join(k, "id", "full_outer").select("id", (part("v", vector_weight) + part("k", keyword_weight)).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def hybrid_search(vectors: DataFrame, docs: DataFrame, query_vector: list[float], query_text: str, fields: list[str], limit: int = 10, vector_weight: float = 0.7, keyword_weight: float = 0.3, where: Column | None = None) -> DataFrame:
    return fuse(vector_topk(vectors, query_vector, 2 * limit, where), bm25(docs, query_text, fields, 2 * limit), vector_weight, keyword_weight, limit)


def hybrid_search_of_index(vectors: DataFrame, index: DataFrame, query_vector: list[float], query_text: str, limit: int = 10, vector_weight: float = 0.7, keyword_weight: float = 0.3, where: Column | None = None) -> DataFrame:
    """As hybrid_search, with keywords from a stored inverted index."""
    return fuse(vector_topk(vectors, query_vector, 2 * limit, where), bm25_of_index(index, query_text, 2 * limit), vector_weight, keyword_weight, limit)


def semantic_search(vectors: DataFrame, query_vector: list[float], limit: int = 10, lang: str | None = None, kind: str | None = None, index: DataFrame | None = None, query_text: str = "", fallback: bool = True, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """The entry to semantic search over vectors (id, embedding, lang, kind): at most 50 (id, score).

    Hybrid if a keyword index is given; else by vectors, and if the filter leaves fewer than asked for, filled up from all vectors.
    """
    limit = max(1, min(limit, 50))
    where = None
    for column, value in (("lang", lang), ("kind", kind)):
        if value is not None:
            one = F.col(column) == value
            where = one if where is None else where & one
    if index is not None:
        return hybrid_search_of_index(vectors, index, query_vector, query_text, limit, *weights, where)
    if where is not None and fallback:
        return vector_topk_with_fallback(vectors, query_vector, limit, where).select("id", "score")
    return vector_topk(vectors, query_vector, limit, where).select("id", "score")


def summary_text(nodes: DataFrame) -> Column:
    """What a node is embedded by: language, kind, name, signature, place."""
    place = F.concat(F.lit("file: "), F.col("file_path"), F.lit(":"), F.col("start_line").cast("string"))
    head = F.concat("lang", F.lit(" "), "kind", F.lit(": "), "qualified_name")
    return F.concat_ws(" | ", head, F.concat(F.lit("signature: "), F.nullif(F.col("signature"), F.lit(""))), place)


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """Deterministic vector of unit length: words hashed to signed dimensions."""
    h = F.transform(tokens(text), lambda w: F.xxhash64(w))
    at = lambda i: F.aggregate(F.filter(h, lambda x: F.pmod(x, F.lit(dims)) == i), F.lit(0.0), lambda s, x: s + F.when(F.shiftrightunsigned(x, 63) == 1, -1.0).otherwise(1.0))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: at(i))
    return F.transform(raw, lambda x: x / F.greatest(F.sqrt(dot(raw, raw)), F.lit(1e-12)))


def embed(texts: DataFrame, encode, batch: int = 32) -> DataFrame:
    """(id, embedding) of texts (id, text) by ``encode``, a function from a list of texts to a list of vectors (a local model or a remote encoder), called for at most ``batch`` at once; vectors are scaled to length 1."""

    def run(batches):
        for b in batches:
            ids, rows = b.column("id"), b.column("text").to_pylist()
            for at in range(0, len(rows), batch):
                v = np.asarray(encode([t or "" for t in rows[at : at + batch]]), dtype=np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(v)), pa.array(v.tolist(), pa.list_(pa.float64()))], names=["id", "embedding"])

    prepare(texts.sparkSession)
    return texts.select(F.col("id").cast("string"), "text").mapInArrow(run, "id string, embedding array<double>")


def http_encoder(url: str, protocol: str = "embed", model: str = "", timeout: float = 60.0):
    """An ``encode`` that asks a server: ``embed`` posts {"texts": [...]} and reads "embeddings"; ``openai`` posts {"input", "model"} and reads "data"."""
    if protocol not in ("embed", "openai"):
        raise ValueError(f"unknown protocol {protocol!r}")

    def encode(texts: list[str]) -> list[list[float]]:
        import json
        from urllib.request import Request, urlopen

        body = {"texts": texts} if protocol == "embed" else {"input": texts, "model": model}
        with urlopen(Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"}), timeout=timeout) as r:
            got = json.loads(r.read())
        return got["embeddings"] if protocol == "embed" else [x["embedding"] for x in sorted(got["data"], key=lambda x: x["index"])]

    return encode


def build_vectors(nodes: DataFrame, encode=None) -> DataFrame:
    """(id, embedding, lang, kind) of live nodes of the kinds that are embedded, from their summary texts; without an encoder, hashed vectors."""
    some = nodes.filter(F.col("valid_to").isNull() & F.col("kind").isin(*EMBEDDABLE_KINDS))
    texts = some.select("id", summary_text(some).alias("text"), "lang", "kind")
    if encode is None:
        return texts.select("id", hashed_embedding(F.col("text")).alias("embedding"), "lang", "kind")
    return embed(texts, encode).join(texts.select("id", "lang", "kind"), "id")


def check_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    """Vectors of another length than the collection's, or of none (id)."""
    return vectors.filter(F.col("embedding").isNull() | (F.size("embedding") != dims)).select("id")
