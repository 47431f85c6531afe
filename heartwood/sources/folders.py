"""Folders of files: listed level by level, read by path, and written with a file for each document.

Spark's own file sources leave out names that begin with `_` or `.`, and empty
files; repositories have both. File systems are those that pyarrow knows by a
path's scheme.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions import paths
from ..functions.text import safe_name
from .state import Store, cut

#: Bytes of files after which a task hands on what it has read.
STEP = 16 << 20
_LISTED = "path string, length bigint, folder boolean"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """A path's file system, and the path within it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def listing(spark: SparkSession, root: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, length) of the files under root, paths relative to it. Names to ignore are left out with what is below them, and links to folders are not followed.

    One job for each level of folders; a folder's own entries are listed by one task.
    """

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = opened(root)
        for pdf in batches:
            for own in pdf["path"]:
                rows = []
                for info in system.get_file_info(pafs.FileSelector(posixpath.join(top, own) if own else top)):
                    if info.base_name in ignore:
                        continue
                    name = posixpath.join(own, info.base_name) if own else info.base_name
                    if info.type == pafs.FileType.Directory:
                        link = isinstance(system, pafs.LocalFileSystem) and os.path.islink(info.path)
                        if not link:
                            rows.append((name, None, True))
                    elif info.type == pafs.FileType.File:
                        rows.append((name, info.size, False))
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "length", "folder"]).astype({"length": "Int64"})

    level = spark.createDataFrame([("",)], "path string")
    files = spark.createDataFrame([], "path string, length bigint")
    while True:
        below = cut(level.mapInPandas(entries, _LISTED))
        files = files.unionByName(below.where("NOT folder").select("path", "length"))
        folders = below.where("folder").select("path")
        if folders.isEmpty():
            return files
        level = folders.repartition("path")


def contents(files: DataFrame, root: str) -> DataFrame:
    """files (path, length) with their `content`. Files that are gone by then have none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(root)
        for batch in batches:
            held, size, start = [], 0, 0
            names = batch.column("path").to_pylist()
            for i, name in enumerate(names):
                try:
                    with system.open_input_stream(posixpath.join(top, name)) as f:
                        held.append(f.read())
                except FileNotFoundError:
                    held.append(None)
                size += len(held[-1] or b"")
                if size >= STEP or i == len(names) - 1:
                    part = batch.slice(start, len(held))
                    yield pa.RecordBatch.from_arrays([part.column("path"), part.column("length"), pa.array(held, pa.binary())], names=["path", "length", "content"])
                    held, size, start = [], 0, i + 1

    return files.select("path", "length").mapInArrow(read, "path string, length bigint, content binary")


@dataclass
class Written(WriterCommitMessage):
    files: int


class Documents(DataSource):
    """A file for each row (target, text), its target relative to the path that is saved to.

    A task writes each file under another name, in a folder beside the path, and then gives it
    its own. mode("overwrite") puts all files in a new folder, which takes the old one's place
    when every task has ended; mode("append") puts each in its place at once, and leaves files
    of other targets. Either way what a killed task had begun goes at the end.
    """

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if [f.name for f in schema.fields] != ["target", "text"]:
            raise ValueError("documents have the columns target and text")
        return _Writer(self.options["path"], overwrite)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.beside = f"{self.path}.writing-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        system, beside = opened(self.beside)
        top = f"{beside}/files" if self.overwrite else opened(self.path)[1]
        mine, n, made = f"{beside}/begun/{uuid.uuid4().hex}", 0, None
        system.create_dir(posixpath.dirname(mine), recursive=True)
        for target, text in rows:
            parts = (target or "").split("/")
            if any(p in ("", ".", "..") or "\0" in p for p in parts):
                raise ValueError(f"a document can't be written to {target!r}")
            own = f"{top}/{target}"
            if posixpath.dirname(own) != made:
                made = posixpath.dirname(own)
                system.create_dir(made, recursive=True)
            with system.open_output_stream(mine) as f:
                f.write((text or "").encode())
            try:
                system.move(mine, own)
            except OSError:  # some file systems do not move onto a file
                system.delete_file(own)
                system.move(mine, own)
            n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        system, beside = opened(self.beside)
        if self.overwrite:
            path = opened(self.path)[1]
            system.create_dir(f"{beside}/files", recursive=True)
            if system.get_file_info(path).type != pafs.FileType.NotFound:
                system.move(path, f"{beside}/before")
            system.move(f"{beside}/files", path)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, beside = opened(self.beside)
        if system.get_file_info(beside).type != pafs.FileType.NotFound:
            system.delete_dir(beside)


def pages(docs: DataFrame, project: Column | str, by_repo: bool = True) -> DataFrame:
    """(target, text) of documents (repo, node_id, kind, doc): Markdown under a title, in a folder for each repository.

    Documents that are null have no page; of two for one target the greater text counts.
    """
    name = F.lit(project) if isinstance(project, str) else project
    leaf = F.col("kind") == "leaf"
    title = F.when(~leaf & (F.col("node_id") == paths.ROOT), F.concat(name, F.lit(" — repository overview"))).otherwise(F.col("node_id"))  # fixed value
    target = paths.export_path(F.col("node_id"), F.col("kind"))
    text = F.concat(F.lit("# "), title, F.lit("\n\n"), F.col("doc"), F.lit("\n"))
    rows = docs.where("doc IS NOT NULL").select((F.concat(safe_name(F.col("repo")), F.lit("/"), target) if by_repo else target).alias("target"), text.alias("text"))
    return rows.groupBy("target").agg(F.max("text").alias("text"))


def export(rows: DataFrame, path: str, replace: bool = True) -> None:
    """Write pages (target, text) as files under path, in place of what is there or into it."""
    rows.sparkSession.dataSource.register(Documents)
    rows.select("target", "text").sortWithinPartitions("target").write.format("document_files").mode("overwrite" if replace else "append").save(path)


def export_store(store: Store, path: str, project: Column | str, by_repo: bool = True) -> None:
    """Write all documents of a store's newest version, of leaves and of folders."""
    store.refresh()
    kind = lambda df, key, k: df.select("repo", F.col(key).alias("node_id"), F.lit(k).alias("kind"), "doc")
    leaf = kind(store.read("unit_doc", "repo string, path string, doc string"), "path", "leaf")
    export(pages(leaf.unionByName(kind(store.read("folder_doc", "repo string, node_id string, doc string"), "node_id", "folder")), project, by_repo), path)
