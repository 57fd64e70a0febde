"""One object over a stored graph: what a user asks, by name, as DataFrames in the unified result's columns."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import update as U
from .config import Config
from .index import from_raw
from .operators import blocks as B
from .operators import lookup as L
from .operators import rank as K
from .operators import references as R
from .operators import signature as S
from .operators import stats as T
from .operators import traces as C
from .operators import traverse as G
from .operators.output import standard
from .scratch import delete, new_path
from .sources import extract as X
from .sources import walk as W
from .store import GraphStore


class CodeGraph:
    """Index a source tree, keep it up to date, and query it."""

    def __init__(self, spark: SparkSession, config: Config | None = None) -> None:
        self.spark, self.config = spark, config or Config()
        self.store = GraphStore(spark, self.config.store)

    def _table(self, name: str) -> DataFrame:
        df = self.store.table(name)
        if df is None:
            raise LookupError(f"the store has no {name}: index a project first")
        return df

    @property
    def nodes(self) -> DataFrame:
        return self._table("nodes")

    @property
    def edges(self) -> DataFrame:
        return self._table("edges")

    @property
    def blocks(self) -> DataFrame:
        return self._table("blocks")

    def _encode(self):
        c = self.config
        return K.http_encoder(c.encoder_url, c.encoder_protocol, c.encoder_model) if c.encoder_url else None

    def index(self, root: str | None = None, commit: str = "INIT", folder: bool = False) -> dict[str, int]:
        """Index a tree from scratch: nodes, edges, blocks, vectors and the full-text index. Returns row counts."""
        root = root or self.config.root
        if folder:
            files = W.index_folder_files(self.spark, root)
        else:
            path = Path(self.config.ignore_file or f"{root}/.ignore")
            rules = W.ignore_rules(path.read_text(encoding="utf-8") if path.exists() else None)
            files = W.walk(self.spark, root, rules, tuple(self.config.exclude_dirs))
        at = new_path(self.spark, "raw")
        X.extract(files).write.parquet(at)  # read by several branches
        g = from_raw(self.spark.read.parquet(at), files, self.config.project, commit)
        self.store.load(commit, nodes=g["nodes"], edges=g["edges"], edges_raw=g["edges_raw"], blocks=g["blocks"])
        delete(self.spark, at)
        self.embed(commit)
        return self.store.counts()

    def embed(self, commit: str | None = None) -> None:
        """Vectors and full-text index of the live nodes."""
        commit = commit or self.store.current()[0]
        nodes = L.current(self.nodes)
        terms = K.inverted_index(nodes, ["name", "qualified_name", "signature"])
        self.store.write(commit, vectors=K.build_vectors(self.nodes, self._encode()), terms=terms.repartition("term").sortWithinPartitions("term"))

    def update(self, repo: str, old: str, new: str) -> DataFrame:
        return U.results(U.update_from_git(self.store, repo, old, new, self.config.project, self.config.max_changed_nodes))

    def update_workspace(self, repo: str) -> DataFrame:
        return U.results(U.apply_workspace_diff(self.store, repo, self.config.project))

    def dry_run(self, repo: str, old: str, new: str | None = None) -> DataFrame:
        return U.dry_run(self.spark, repo, old, new, self.config.max_changed_nodes)

    def definition(self, name: str, kind: str | None = None, lang: str | None = None, limit: int = 50) -> DataFrame:
        return standard(L.find_definition(self.nodes, name, kind, lang, limit))

    def references(self, name: str, kind: str | None = None, lang: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        return R.references_tool(L.find_definition(self.nodes, name, kind, lang), self.nodes, self.edges, limit, offset)

    def callers(self, name: str, depth: int = 1) -> DataFrame:
        return standard(G.callers_by_name(self.nodes, self.edges, name, depth))

    def callees(self, name: str, depth: int = 1) -> DataFrame:
        return standard(G.callees_by_name(self.nodes, self.edges, name, depth))

    def signature(self, pattern: str, lang: str | None = None, limit: int = 20) -> DataFrame:
        return standard(S.search_by_signature(self.nodes, pattern, lang, limit))

    def neighbourhood(self, node_id: str, depth: int = 1, kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        return G.expand_neighbourhood(self.nodes, self.edges, node_id, depth, kinds)

    def search(self, text: str, limit: int = 10, lang: str | None = None, kind: str | None = None) -> DataFrame:
        """Hybrid search by vectors and keywords."""
        encode = self._encode()
        if encode:
            query = encode([text])[0]
        else:
            query = self.spark.range(1).select(K.hashed_embedding(F.lit(text), self.config.dims).alias("v")).first().v
        hits = K.semantic_search(self._table("vectors"), query, limit, lang, kind, self._table("terms"), text, weights=(self.config.vector_weight, self.config.keyword_weight))
        found = L.current(self.nodes).join(hits, "id").orderBy(F.desc("score"), "id")
        return standard(found, score=F.col("score"))

    def find_blocks(self, block_type: str | None = None, min_nesting: int = 1, lang: str | None = None, limit: int = 50) -> DataFrame:
        return B.to_standard(B.search_blocks(self.blocks, block_type, min_nesting, lang, limit))

    def lambdas(self, with_captures: bool = False, lang: str | None = None, limit: int = 50) -> DataFrame:
        return B.to_standard(B.lambda_blocks(self.blocks, with_captures, lang, limit))

    def stats(self) -> DataFrame:
        return T.index_stats(self.nodes, self.edges)

    def trace(self, text: str) -> DataFrame:
        return C.report(self.spark.createDataFrame([("0", text)], "trace_id string, text string"), self.nodes)
