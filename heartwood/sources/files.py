"""Scans of files and of manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, paths
from ..functions.text import is_blank
from . import folders

# Folders that a scan leaves out.
IGNORED = (".git", ".github", "__pycache__", "node_modules", ".venv", "venv", ".tox", ".pytest_cache", "dist", "build")
#: Sizes below which the pipeline reads a file, and up to which a processor does.
PIPELINE_BYTES, PROCESSOR_BYTES = 100_000, 2 * 1024 * 1024


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = (), ignore: tuple[str, ...] = IGNORED, below: int | None = None, ordered: bool = False) -> DataFrame:
    """(path, length, text) of files under root, paths relative to it; folders to ignore are looked for below root only. Names that begin with `_` or `.` and empty files count. Malformed bytes become replacement characters. ordered: by the parts of paths."""
    own = folders.listing(spark, root, ignore)
    if below is not None:
        own = own.where(F.col("length") < below)
    if extensions:
        own = own.where(paths.suffix(F.col("path")).isin(*extensions))
    read = folders.contents(own, root).where("content IS NOT NULL")
    out = read.select("path", "length", F.decode("content", "UTF-8").alias("text"))
    return out.orderBy(F.split("path", "/")) if ordered else out


def snapshot(files: DataFrame, repo: Column | str = "", keep: Column | None = None) -> DataFrame:
    """(repo, path, blob_sha) of files with texts."""
    own = files if keep is None else files.where(keep)
    name = F.lit(repo) if isinstance(repo, str) else repo
    return own.select(name.alias("repo"), "path", hashing.content_id(F.col("text")).alias("blob_sha"))


def pipeline_files(files: DataFrame) -> DataFrame:
    """Files that the pipeline documents: of a known language, below its size, not blank."""
    ext = paths.suffix(F.col("path"))
    return files.where((paths.language(ext, paths.EXPORT) != "unknown") & (F.octet_length("text") < PIPELINE_BYTES) & ~is_blank(F.col("text")))
