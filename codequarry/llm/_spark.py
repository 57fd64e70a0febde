"""Session plumbing of the llm operators: shared scratch tables and Python workers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parents[2])
_left: dict[str, SparkSession] = {}


def prepare(spark: SparkSession) -> None:
    """Let local Python workers import this package; a cluster ships it with --py-files."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *filter(None, paths)])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, in local mode alone, one set here if that is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), f"codequarry-{os.getuid()}")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/codequarry-{name}-{uuid.uuid4().hex}"
    _left[path] = spark
    return path


def save(df: DataFrame, name: str, **write) -> DataFrame:
    """Cut the lineage: write df to the shared folder as Parquet, once, and read it from there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression="zstd", **write)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def drop(*tables: DataFrame | str, anyway: SparkSession | None = None) -> None:
    """Delete scratch tables that nothing reads any more (anyway: also a path that isn't scratch, by this session)."""
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "scratch_path", None)
        spark = _left.pop(path, None) or anyway
        if path and spark:
            fs, at = _path(spark, path)
            fs.delete(at, True)


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, at = _path(spark, folder)
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all; an error if it is there."""
    fs, at = _path(spark, path)
    _, aside = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(at) or not fs.rename(aside, at):
        fs.delete(aside, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _path(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


@atexit.register
def _drop_all() -> None:
    for path in list(_left):
        try:
            drop(path)
        except Exception:  # the session may be gone
            _left.clear()
            return


def only(df: DataFrame, *types: tuple[str, str]) -> DataFrame:
    """The named columns with these types; other columns, however named, are left out."""
    return df.select(*[F.col(f"`{n}`").cast(t).alias(n) for n, t in types])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_carried(df: DataFrame, carry: bool, *types: tuple[str, str]) -> tuple[DataFrame, str]:
    """only(), and with ``carry`` also all columns of df as one struct ``carried``, and that struct's part of a DDL schema."""
    if not carry:
        return only(df, *types), ""
    every = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("carried")
    out = df.select(*[F.col(f"`{n}`").cast(t).alias(n) for n, t in types], every)
    return out, f", carried {out.schema['carried'].dataType.simpleString()}"


def carried_part(batch, start: int, n: int, names: list[str]) -> tuple[list, list[str]]:
    """The carried struct's slice, if the batch has one, and the names of a record batch that ends with it."""
    if "carried" in batch.schema.names:
        return [batch.column("carried").slice(start, n)], [*names, "carried"]
    return [], names


def held_out(doc_id: Column) -> Column:
    """The rows that no model learns from: crc32 of doc_id as text, modulo 5, is 0. Null counts as learnable."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)
