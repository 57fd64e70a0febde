"""The queries of the llm operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ._spark import new_path, save, table
from .bestfit import pack_best_fit, segments
from .fertility import quality_rules
from .hilbert import pack_along_curve
from .language import identify_languages
from .quadratic import quality_scores
from .substring import cut_duplicates
from .superminhash import near_duplicates
from .warc import write_archives
from .winnowing import contamination
from .wrapper import main_texts

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op2_language_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op3_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_along_curve(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op5_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_best_fit_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(save(pack_best_fit(table(spark, sf_dir, "documents")), "packed"))


def op8_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op10_substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_html_wrapper, op2_language_viterbi, op3_warc_normaliser, op4_hilbert_packing, op5_quadratic_quality, op6_winnowing, op7_best_fit_binary, op8_fertility_rules, op9_superminhash, op10_substring_index)}
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_BLANK = r"'[^\x20\x09-\x0D]+'"

#: For the operators whose results SQL can express; the others need tokenisers or models.
ORACLE_SQL: dict[str, str] = {
    "op3_warc_normaliser": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x FROM p),
k AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS least,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS b32 FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, b32 AS payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to FROM k""",
    "op6_winnowing": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOW}, {_ALNUM}), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM benchmark), c AS (SELECT item_id, w, least(8, len(w)) AS n FROM b WHERE len(w) > 0),
known AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM c)),
windows AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM known) WHERE len(w) >= n)),
hits AS MATERIALIZED (SELECT r, n, i, item_id FROM windows JOIN known USING (n, k)),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS list FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op10_substring_index": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, {_BLANK}), []) AS w FROM documents),
windows AS MATERIALIZED (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS j FROM windows JOIN least USING (k) WHERE first < doc_id),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY j) AS t, count(*) AS n FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d) ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)""",
    "op9_superminhash": f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOW}, {_BLANK}), []) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS k FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.r <> b.r GROUP BY a.r, b.r),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN n AS nx ON nx.r = x JOIN n AS ny ON ny.r = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
walk(r, m) AS (SELECT r, r FROM d UNION SELECT walk.r, y FROM walk JOIN links ON x = m)
SELECT any_value(d.doc_id) AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(e.doc_id) AS component_id, any_value(d.doc_id) = min(e.doc_id) AS kept
FROM walk JOIN d ON d.r = walk.r JOIN d AS e ON e.r = walk.m LEFT JOIN n ON n.r = d.r GROUP BY walk.r""",
}
