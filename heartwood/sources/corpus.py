"""Logical tables of the engine, derived from a corpus of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import snapshot

EDITED = ("src1", "src3")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """rows in as many tasks as there are shuffle partitions: for work a row that takes far longer than its bytes on disk, by which a scan deals them, suggest."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, text, doc_id, source): every document as a file."""
    i = F.col("doc_id")
    ext = F.element_at(F.array(*map(F.lit, (".py", ".v", ".md", ".js"))), (i % 4 + 1).cast("int"))
    path = F.concat("source", F.lit("/b"), (i % 10).cast("string"), F.lit("/"), i.cast("string"), ext)
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("repo"), path.alias("path"), "text", "doc_id", "source")


def current_files(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    gone = F.col("doc_id") % 13 == 0
    return files(spark, sf_dir).where(~(gone & F.col("source").isin(*EDITED)) if sparse else ~gone)


def previous_files(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    """The snapshot before: some documents not yet there, some with another text; with sparse, in a few sources only."""
    here = F.col("source").isin(*EDITED) if sparse else F.lit(True)
    own = files(spark, sf_dir).where(~((F.col("doc_id") % 11 == 0) & here))
    return own.withColumn("text", F.when((F.col("doc_id") % 7 == 0) & here, F.concat("text", F.lit(" v0"))).otherwise(F.col("text")))


def leaves(files: DataFrame) -> DataFrame:
    return snapshot(files, F.col("repo"))
