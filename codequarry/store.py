"""Tables of a graph on disk, with a version pointer that is moved last."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = ("nodes", "edges", "edges_raw", "blocks", "vectors", "files", "terms", "summaries")


_POINTER = "at BIGINT, commit STRING, tables MAP<STRING, STRING>, schemas MAP<STRING, STRING>"


class GraphStore:
    """Versions under one root: each commit writes the tables it changes, then appends the pointer, which names every table's folder.

    A reader follows the newest pointer, so it sees all tables of a commit or none; tables that a commit doesn't
    give stay where they are.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _pointers(self) -> DataFrame:
        return self.spark.read.schema(_POINTER).parquet(f"{self.root}/current_version")

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def current(self) -> tuple[str, dict[str, str], dict[str, str]] | None:
        """(commit, folder and schema of each table) of the newest version; None before the first."""
        if not self._exists(f"{self.root}/current_version"):
            return None
        r = self._pointers().orderBy(F.desc("at")).first()
        return (r.commit, r.tables, r.schemas) if r else None

    def write(self, commit: str, **tables: DataFrame) -> None:
        """Write a version; tables that aren't given are those of the version before."""
        unknown = set(tables) - set(TABLES)
        if unknown:
            raise ValueError(f"unknown tables {sorted(unknown)}")
        before = self.current()
        folders, schemas = (dict(before[1]), dict(before[2])) if before else ({}, {})
        version = uuid.uuid4().hex
        for name, df in tables.items():
            folders[name], schemas[name] = f"{self.root}/{name}/v-{version}", df.schema.json()
            w = df.write.mode("errorifexists").option("compression", "zstd")
            (w.partitionBy("lang") if name == "nodes" and "lang" in df.columns else w).parquet(folders[name])
        at = (self._pointers().agg(F.max("at")).first()[0] + 1) if before else 0
        self.spark.createDataFrame([(at, commit, folders, schemas)], _POINTER).coalesce(1).write.mode("append").parquet(f"{self.root}/current_version")

    def load(self, commit: str, **tables: DataFrame) -> None:
        """A full load: every row is stamped with the commit and live."""
        fresh = {}
        for name, df in tables.items():
            if name in ("nodes", "edges", "edges_raw", "blocks"):
                df = df.withColumn("valid_from", F.lit(commit)).withColumn("valid_to", F.lit(None).cast("string"))
            fresh[name] = df
        self.write(commit, **fresh)

    def table(self, name: str) -> DataFrame | None:
        now = self.current()
        if now is None or name not in now[1]:
            return None
        return self.spark.read.schema(StructType.fromJson(json.loads(now[2][name]))).parquet(now[1][name])

    def changes(self, table: str, rows: DataFrame, commit: str) -> None:
        """Replace one table, as a commit of its own."""
        self.write(commit, **{table: rows})

    def register_views(self) -> None:
        for name in TABLES:
            if (df := self.table(name)) is not None:
                df.createOrReplaceTempView(name)

    def query(self, sql: str, **params) -> DataFrame:
        """SQL over the current version's tables, with named parameters."""
        self.register_views()
        return self.spark.sql(sql, args=params)

    def run_script(self, text: str, skip_failed: bool = False) -> dict[str, int]:
        """Statements separated by semicolons; how many ran and failed."""
        done = {"ok": 0, "failed": 0}
        for statement in filter(None, (s.strip() for s in text.split(";"))):
            try:
                self.spark.sql(statement)
                done["ok"] += 1
            except Exception:
                if not skip_failed:
                    raise
                done["failed"] += 1
        return done

    def schema_info(self) -> dict[str, list[str]]:
        return {name: df.columns for name in TABLES if (df := self.table(name)) is not None}

    def violations(self, name: str, key: str = "id") -> DataFrame:
        """Keys that stand more than once: what a uniqueness constraint would refuse."""
        return self.table(name).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")

    def counts(self) -> dict[str, int]:
        return {name: df.count() for name in TABLES if (df := self.table(name)) is not None}

    # Keys and lookup structures are declared in a small table; what they promise is checked, not enforced on write.

    def _declared(self) -> DataFrame:
        schema = "name STRING, what STRING, on_table STRING, columns ARRAY<STRING>, dropped BOOLEAN, at BIGINT"
        path = f"{self.root}/declared"
        return self.spark.read.schema(schema).parquet(path) if self._exists(path) else self.spark.createDataFrame([], schema)

    def declarations(self) -> DataFrame:
        """(name, what, on_table, columns) of indexes and constraints that are declared now."""
        last = self._declared().groupBy("name").agg(F.max_by(F.struct("what", "on_table", "columns", "dropped"), "at").alias("d"))
        return last.select("name", "d.*").filter("not dropped").drop("dropped")

    def declare(self, name: str, what: str, on_table: str, columns: list[str], dropped: bool = False) -> None:
        """what: index, full-text index, vector index or unique constraint; a unique constraint must hold."""
        if what not in ("index", "fulltext", "vector", "unique"):
            raise ValueError(f"unknown kind {what!r}")
        if what == "unique" and not dropped and (df := self.table(on_table)) is not None:
            if not df.groupBy(*columns).count().filter("count > 1").isEmpty():
                raise ValueError(f"{on_table} has rows that share {columns}")
        at = (self._declared().agg(F.max("at")).first()[0] or 0) + 1
        row = [(name, what, on_table, columns, dropped, at)]
        self.spark.createDataFrame(row, self._declared().schema).coalesce(1).write.mode("append").parquet(f"{self.root}/declared")

    def undeclare(self, name: str) -> None:
        d = self.declarations().filter(F.col("name") == name).first()
        if d is not None:
            self.declare(name, d.what, d.on_table, list(d.columns), dropped=True)

    def is_declared(self, name: str) -> bool:
        return not self.declarations().filter(F.col("name") == name).isEmpty()

    def declare_standard(self) -> None:
        """What a code graph is looked up by."""
        have = {r.name for r in self.declarations().collect()}  # one per declaration
        for name, what, on, columns in STANDARD:
            if name not in have:
                self.declare(name, what, on, columns)

    def validate(self) -> dict[str, list[str]]:
        """What is missing: columns of tables, standard declarations, and constraints that don't hold."""
        from .schema import BLOCKS, EDGES, NODES, schema_gaps

        gaps = {t: schema_gaps(df.schema, want) for t, want in (("nodes", NODES), ("edges", EDGES), ("blocks", BLOCKS)) if (df := self.table(t)) is not None}
        declared = self.declarations().collect()
        gaps["declarations"] = sorted({s[0] for s in STANDARD} - {d.name for d in declared})
        broken = [d.name for d in declared if d.what == "unique" and (df := self.table(d.on_table)) is not None and not df.groupBy(*d.columns).count().filter("count > 1").isEmpty()]
        return {k: v for k, v in {**gaps, "broken": broken}.items() if v}

    def history(self) -> DataFrame:
        return self._pointers().orderBy("at")

    def rollback(self, commit: str) -> None:
        """Point at the newest version of an earlier commit again; nothing is rewritten."""
        r = self._pointers().filter(F.col("commit") == commit).orderBy(F.desc("at")).first()
        if r is None:
            raise ValueError(f"no version of {commit!r}")
        at = self._pointers().agg(F.max("at")).first()[0] + 1
        self.spark.createDataFrame([(at, commit, r.tables, r.schemas)], _POINTER).coalesce(1).write.mode("append").parquet(f"{self.root}/current_version")


#: What a code graph is looked up by: name, kind, table, columns.
STANDARD = [
    ("node_id", "unique", "nodes", ["id"]), ("edge_id", "unique", "edges", ["id"]), ("node_name", "index", "nodes", ["name"]), ("node_qualified_name", "index", "nodes", ["qualified_name"]),
    ("node_file", "index", "nodes", ["file_path"]), ("edge_from", "index", "edges", ["from_id"]), ("edge_to", "index", "edges", ["to_id"]), ("node_text", "fulltext", "nodes", ["name", "qualified_name", "signature"]),
]
