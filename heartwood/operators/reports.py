"""Listings and rollups over files and their documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent


def doc_listing(files: DataFrame, documents: DataFrame, url: str | None = None, **equal: str | None) -> DataFrame:
    """Documents with their files, newest first (ties by id); of one repository, and of equal columns, where given."""
    both = documents.join(files.withColumnRenamed("id", "file_id"), "file_id")
    if url:
        both = both.where(F.get_json_object("metadata", "$.repository_url") == url)
    for name, value in equal.items():
        if value:
            both = both.where(F.col(name) == value)
    return both.orderBy(F.desc("generated_at"), "id")


def coverage(files: DataFrame, documents: DataFrame, distinct: bool = False) -> DataFrame:
    """(repo_url, total_files, documented_files, last_update, coverage) by repository.

    Rows of the join are counted, so that a file of two documents counts twice,
    unless distinct is set.
    """
    docs = documents.select("file_id", F.col("id").alias("doc_id"))
    own = files.select(F.col("id").alias("file_id"), F.get_json_object("metadata", "$.repository_url").alias("repo_url"), "updated_at").where("repo_url IS NOT NULL")
    if distinct:
        docs = docs.groupBy("file_id").agg(F.min("doc_id").alias("doc_id"))
    out = own.join(docs, "file_id", "left").groupBy("repo_url").agg(F.count("*").alias("total_files"), F.count("doc_id").alias("documented_files"), F.max("updated_at").alias("last_update"))
    return out.withColumn("coverage", percent(F.col("documented_files"), F.col("total_files")))


def dashboard(status: DataFrame, active: tuple[str, ...] = ("analyzing", "processing")) -> DataFrame:
    """One row: repositories, those at work, and the mean of their coverage."""
    return status.agg(F.count("*").alias("total"), F.count_if(F.col("status").isin(*active)).alias("active"), F.round(F.coalesce(F.avg("coverage"), F.lit(0.0)), 1).alias("avg_coverage"))


def error_head(rows: DataFrame, by: str, order: str, error: str, n: int = 10) -> DataFrame:
    """The first errors of each group, in order. The heap is bounded: ranks are cut before lists are made."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(order)
    first = rows.where(F.col(error).isNotNull()).withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    return first.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", error))), lambda x: x[error]), ",").alias("errors"), F.count("*").alias("n_errors"))


def outcome_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("repo", "outcome").agg(F.count("*").alias("n"))
