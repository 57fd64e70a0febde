"""Git trees as tables, by a Python data source that calls the ``git`` command."""

from __future__ import annotations

import json
import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.workers import prepare


def _git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], check=True, capture_output=True).stdout


def has_commits(repo: str) -> bool:
    return subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, "rev-parse", "--verify", "-q", "HEAD"], capture_output=True).returncode == 0


def head(repo: str) -> str | None:
    return _git(repo, "rev-parse", "HEAD").decode().strip() if has_commits(repo) else None


class _Part(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Snapshot(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.repo, self.commit, self.per_task = options["repo"], options.get("commit", "HEAD"), int(options.get("files_per_task", 200))
        self.only = json.loads(options["paths"]) if "paths" in options else None

    def partitions(self) -> list[_Part]:
        paths = [p.decode() for p in _git(self.repo, "ls-tree", "-rz", "--name-only", self.commit).split(b"\0") if p]
        paths = paths if self.only is None else sorted(set(paths) & set(self.only))
        return [_Part(paths[i : i + self.per_task]) for i in range(0, len(paths), self.per_task)] or [_Part([])]

    def read(self, part: _Part):
        """One git process for all blobs of a task."""
        args = ["git", "-c", "safe.directory=*", "-C", self.repo, "cat-file", "--batch"]
        with subprocess.Popen(args, stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
            for p in part.paths:
                git.stdin.write(f"{self.commit}:{p}\n".encode())
                git.stdin.flush()
                head = git.stdout.readline().split()
                if head[-1] == b"missing" or len(head) < 3 or head[1] != b"blob":
                    if len(head) == 3 and head[-1] != b"missing":
                        git.stdout.read(int(head[2]) + 1)
                    continue
                content = git.stdout.read(int(head[2]))
                git.stdout.read(1)
                yield p, content


class GitSnapshot(DataSource):
    """Blobs of a commit: options repo, commit, files_per_task, and paths (a JSON list; all if left out)."""

    @classmethod
    def name(cls) -> str:
        return "git_snapshot"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema) -> _Snapshot:
        return _Snapshot(dict(self.options))


class _Diff(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.repo, self.old, self.new = options["repo"], options["old"], options.get("new")

    def read(self, part):
        if not has_commits(self.repo):  # nothing to compare with: every file is new
            yield from ((p.decode(), "A") for p in _git(self.repo, "ls-files", "-zco", "--exclude-standard").split(b"\0") if p)
            return
        args = ["diff", "--no-renames", "--name-status", "-z", self.old, *([self.new] if self.new else [])]
        got = [x.decode() for x in _git(self.repo, *args).split(b"\0") if x]
        yield from ((path, status[0]) for status, path in zip(got[::2], got[1::2], strict=True))
        if not self.new:
            yield from ((p.decode(), "A") for p in _git(self.repo, "ls-files", "-zo", "--exclude-standard").split(b"\0") if p)


class _Tree(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.repo, self.per_task = options["repo"], int(options.get("files_per_task", 200))
        self.only = json.loads(options["paths"])

    def partitions(self) -> list[_Part]:
        return [_Part(self.only[i : i + self.per_task]) for i in range(0, len(self.only), self.per_task)] or [_Part([])]

    def read(self, part: _Part):
        for p in part.paths:
            at = os.path.join(self.repo, p)
            if os.path.isfile(at):
                with open(at, "rb") as f:
                    yield p, f.read()


class GitTree(DataSource):
    """Files of the working tree, as they are: options repo, paths (a JSON list), files_per_task."""

    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema) -> _Tree:
        return _Tree(dict(self.options))


class GitDiff(DataSource):
    """Changed paths between two commits, or a commit and the working tree: options repo, old, new. A rename is a deletion and an addition."""

    @classmethod
    def name(cls) -> str:
        return "git_diff"

    def schema(self) -> str:
        return "path string, status string"

    def reader(self, schema) -> _Diff:
        return _Diff(dict(self.options))


def register(spark: SparkSession) -> None:
    prepare(spark)
    for source in (GitSnapshot, GitDiff, GitTree):
        spark.dataSource.register(source)


def snapshot(spark: SparkSession, repo: str, commit: str = "HEAD", paths: list[str] | None = None) -> DataFrame:
    """(path, content) of a commit's files; paths: of these alone, as far as the commit has them."""
    register(spark)
    r = spark.read.format("git_snapshot").option("repo", repo).option("commit", commit)
    return (r if paths is None else r.option("paths", json.dumps(paths))).load()


def working_tree(spark: SparkSession, repo: str, paths: list[str]) -> DataFrame:
    register(spark)
    return spark.read.format("git_tree").option("repo", repo).option("paths", json.dumps(paths)).load()


def diff(spark: SparkSession, repo: str, old: str, new: str | None = None) -> DataFrame:
    """(path, status) between two commits, or a commit and the working tree with its new files."""
    register(spark)
    r = spark.read.format("git_diff").option("repo", repo).option("old", old)
    return (r if new is None else r.option("new", new)).load()
