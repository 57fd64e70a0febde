"""Source-tree walk with ignore rules and language detection."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.workers import prepare

#: File extension -> language (fixed values).
EXTENSIONS = {"cpp": "cpp", "cxx": "cpp", "cc": "cpp", "c": "cpp", "hpp": "cpp", "hxx": "cpp", "hh": "cpp", "h": "cpp", "java": "java", "rs": "rust", "go": "go", "py": "python", "ts": "typescript", "tsx": "tsx", "jsx": "tsx"}
#: Directories that no walk enters (fixed values).
EXCLUDED = (".git", "__pycache__", "node_modules", "target", "build", "dist", ".gradle", ".idea", ".vscode")
#: Directories that a folder scan leaves out; it enters other dot directories and reads no ignore file (fixed values).
FOLDER_EXCLUDED = (".git", ".venv", "venv", "__pycache__", "node_modules", "target", "build", "dist", ".idea", ".vscode", ".pytest_cache")
#: Ignore rules where a tree has no ignore file (fixed values).
DEFAULT_RULES = [".git/", ".svn/", ".hg/", "__pycache__/", "node_modules/", "target/", "build/", "dist/", ".gradle/", ".idea/", ".vscode/", "venv/", ".venv/", "*.pyc", "*.pyo", "*.class", "*.o", "*.so", "*.dll"]


@dataclass(frozen=True)
class Rule:
    regex: str
    negated: bool
    dir_only: bool


def _glob(text: str) -> str:
    out, i = "", 0
    while i < len(text):
        c = text[i]
        if text.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif text.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in text[i + 2 :]:
            end = text.index("]", i + 2)
            inner = text[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return out


def parse_rules(text: str) -> list[Rule]:
    """Ordered rules of an ignore file: comments and blanks go, ``!`` negates, a last ``/`` means directories only, a slash elsewhere anchors at the root."""
    rules = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        dir_only = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        body = _glob(line.lstrip("/"))
        rules.append(Rule(f"^{'' if anchored else '(?:.*/)?'}{body}$", negated, dir_only))
    return rules


def ignore_rules(text: str | None) -> list[Rule]:
    """The file's rules; the defaults if there is no file (an empty file has no rules)."""
    return parse_rules("\n".join(DEFAULT_RULES) if text is None else text)


def should_ignore(rules: list[Rule], path: str, is_dir: bool) -> bool:
    """The last rule that matches the path, or a directory above it, decides; paths outside the root are never ignored."""
    if path.startswith(("..", "/")):
        return False
    parts = path.strip("/").split("/")
    verdict = False
    for r in rules:
        for n in range(1, len(parts) + 1):
            if (n < len(parts) or is_dir or not r.dir_only) and re.search(r.regex, "/".join(parts[:n])):
                verdict = not r.negated
                break
    return verdict


def ignored(path: Column, rules: list[Rule]) -> Column:
    """should_ignore for files, as an expression."""
    out = F.lit(False)
    for r in rules:
        body = r.regex[1:-1]
        pattern = f"^{body}/" if r.dir_only else f"^{body}(?:/|$)"
        out = F.when(path.rlike(pattern), F.lit(not r.negated)).otherwise(out)
    return F.when(path.rlike(r"^(?:\.\.|/)"), F.lit(False)).otherwise(out)


def language(path: Column) -> Column:
    """By the lower-cased extension; null if it isn't known."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    pairs = [F.lit(x) for kv in EXTENSIONS.items() for x in kv]
    return F.element_at(F.create_map(*pairs), ext)


def extensions_by_language(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(sorted(EXTENSIONS.items()), "ext string, lang string")
    return rows.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_list("ext")), ", ").alias("extensions"))


def unsupported(path: Column) -> Column:
    """Whether a path's extension is no known one."""
    return language(path).isNull()


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _TreeReader(DataSourceReader):
    """The driver lists names, entering no directory that is left out; tasks read contents, of known extensions alone."""

    def __init__(self, options: dict) -> None:
        self.root, self.per_task = options["root"], int(options.get("files_per_task", 200))
        self.excluded, self.dot_dirs, self.recursive = set(json.loads(options.get("excluded", "[]"))), options.get("dot_dirs") == "true", options.get("recursive", "true") == "true"

    def _fs(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("file:") else "file://" + self.root)

    def partitions(self) -> list[_Files]:
        from pyarrow.fs import FileSelector, FileType

        fs, top = self._fs()
        todo, found = [top], []
        while todo:
            for x in fs.get_file_info(FileSelector(todo.pop())):
                if x.type == FileType.Directory:
                    if self.recursive and x.base_name not in self.excluded and (self.dot_dirs or not x.base_name.startswith(".")):
                        todo.append(x.path)
                elif x.extension.lower() in EXTENSIONS:
                    found.append(x.path)
        found.sort()
        return [_Files(found[i : i + self.per_task]) for i in range(0, len(found), self.per_task)] or [_Files([])]

    def read(self, part: _Files):
        fs, top = self._fs()
        for p in part.paths:
            with fs.open_input_stream(p) as f:
                content = f.read()
            yield p[len(top) :].lstrip("/"), len(content), content


class SourceTree(DataSource):
    """Files of known extensions under a root, also those that start with an underscore: options root, excluded (a JSON list), dot_dirs, recursive, files_per_task."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, length bigint, content binary"

    def reader(self, schema) -> _TreeReader:
        return _TreeReader(dict(self.options))


def chosen(files: DataFrame, rules: list[Rule] | None = None, excluded: tuple[str, ...] = EXCLUDED, dot_dirs: bool = False, lang: str | None = None, exclude_globs: tuple[str, ...] = ()) -> DataFrame:
    """Files (path, ...) that a walk keeps, with ``lang``: known extensions, no excluded directories, nothing ignored."""
    files = files.withColumn("lang", language(F.col("path"))).filter(F.col("lang").isNotNull())
    skip = "|".join(re.escape(x) for x in excluded)
    names = skip if dot_dirs else rf"\.[^/]+|{skip}"
    files = files.filter(~F.col("path").rlike(rf"(?:^|/)(?:{names})/")) if names else files
    files = files.filter(~ignored(F.col("path"), ignore_rules(None) if rules is None else rules))
    for g in exclude_globs:  # of whole paths or of names, as fnmatch has it: * crosses slashes
        rx = re.escape(g).replace(r"\*", ".*").replace(r"\?", ".")
        files = files.filter(~(F.col("path").rlike(f"^{rx}$") | F.regexp_extract("path", r"([^/]+)$", 1).rlike(f"^{rx}$")))
    return files if lang is None else files.filter(F.col("lang") == lang)


def walk(
    spark: SparkSession, root: str, rules: list[Rule] | None = None, excluded: tuple[str, ...] = EXCLUDED, lang: str | None = None, recursive: bool = True, keep_empty: bool = False,
    exclude_globs: tuple[str, ...] = (), dot_dirs: bool = False,
) -> DataFrame:
    """files(path relative to root, lang, content): known extensions, no excluded or dot directories, nothing ignored; blank files go.

    No file of another extension, and none in a directory that is left out, is opened.
    """
    prepare(spark)
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree").option("root", root).option("excluded", json.dumps(list(excluded)))
    files = reader.option("dot_dirs", str(dot_dirs).lower()).option("recursive", str(recursive).lower()).load()
    files = chosen(files, rules, excluded, dot_dirs, lang, exclude_globs)
    if not keep_empty:
        files = files.filter((F.col("length") > 0) & F.decode("content", "ISO-8859-1").rlike(r"\S"))
    return files.select("path", "lang", "content")


def index_folder_files(spark: SparkSession, root: str) -> DataFrame:
    """The folder scan: its own list of directories, dot directories included, no ignore file."""
    return walk(spark, root, rules=[], excluded=FOLDER_EXCLUDED, dot_dirs=True)


def parse_file(spark: SparkSession, path: str) -> DataFrame:
    """One file as files(path, lang, content); an error if it is missing or of an unknown extension."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        raise FileNotFoundError(path)
    ext = path.rpartition("/")[2].rpartition(".")[2].lower()
    if ext not in EXTENSIONS:
        raise ValueError(f"unsupported extension of {path!r}; languages: {', '.join(sorted(set(EXTENSIONS.values())))}")
    return spark.read.format("binaryFile").load(path).select(F.lit(path).alias("path"), F.lit(EXTENSIONS[ext]).alias("lang"), "content")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
