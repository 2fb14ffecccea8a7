"""Repository trees as a table: a Python data source that reads one directory per partition.

Spark's binaryFile source skips names that begin with ``_`` or ``.``; this one keeps them.  It is a loader for
mounted folders; at scale the input is a Parquet snapshot of the same columns.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codetables.functions import languages, paths, text


class _Directory(InputPartition):
    def __init__(self, folder: str):
        self.folder = folder


class RepoTree(DataSource):
    """Options: path (a folder whose subfolders are repositories), prune (true: ignored directories aren't entered)."""

    @classmethod
    def name(cls) -> str:
        return "repo_tree"

    def schema(self) -> str:
        return "repo_id string, path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("prune", "true").lower() == "true")


class _Reader(DataSourceReader):
    def __init__(self, root: str, prune: bool):
        self.root, self.prune = root.rstrip("/"), prune

    def partitions(self) -> list[_Directory]:
        found = []
        for folder, below, _ in os.walk(self.root):
            below[:] = sorted(d for d in below if not (self.prune and d in paths.IGNORED_DIRS))
            if folder != self.root:
                found.append(_Directory(folder))
        return found or [_Directory("")]

    def read(self, partition: _Directory) -> Iterator[tuple]:
        if not partition.folder:
            return
        repo, _, inner = os.path.relpath(partition.folder, self.root).partition(os.sep)
        for entry in sorted(os.scandir(partition.folder), key=lambda e: e.name):
            if entry.is_file():
                try:
                    with open(entry.path, "rb") as f:
                        content = f.read()
                except OSError:
                    content = None  # counted, but not a row of files
                yield repo, f"{inner}/{entry.name}" if inner else entry.name, content


def read_tree(spark: SparkSession, path: str, prune: bool = True) -> DataFrame:
    spark.dataSource.register(RepoTree)
    return spark.read.format("repo_tree").option("path", path).option("prune", str(prune).lower()).load()


def scanned(tree: DataFrame) -> DataFrame:
    """repo_id, files_scanned: every file, ignored ones too."""
    return tree.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files_scanned"))


def source_files(tree: DataFrame) -> DataFrame:
    """repo_id, path, language, grammar, content (text), line_count of files that aren't excluded.

    An unreadable file keeps null content, so it counts in histograms; readable() drops it.
    """
    kept = tree.where(~paths.is_excluded(F.col("path")))
    content = text.decoded(F.col("content"))
    return kept.select("repo_id", "path", languages.language(F.col("path")).alias("language"), languages.grammar(F.col("path")).alias("grammar"), content.alias("content"), F.when(F.col("content").isNotNull(), text.line_count(content)).alias("line_count"))


def readable(files: DataFrame) -> DataFrame:
    return files.where("content IS NOT NULL")
