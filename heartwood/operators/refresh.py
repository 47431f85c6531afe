"""Recomputing documents of stale leaves and folders, and reuse of all others."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..sources.state import cut
from .calls import called

#: Characters of a child's document that its folder sees.
CHILD_CHARS = 1500


def generated(leaves: DataFrame, generator: Callable[[str, str], str], retries: int = 0, **pace) -> DataFrame:
    """(repo, path, doc, error) from a function of (path, text). A failure, or an empty answer, is an error, not a document. pace: as called() takes it."""
    return called(leaves, generator, ("path", "text"), ("repo", "path"), retries=retries, **pace)


def refresh_leaves(leaves: DataFrame, diff: DataFrame, cache: DataFrame, generator: Column | Callable[[str, str], str], retries: int = 0, **pace) -> DataFrame:
    """(repo, path, doc, outcome, error) of all live leaves: regenerated where stale, else reused from the cache; deleted ones go.

    A Column as generator stays in the JVM; a function goes through Arrow batches.
    """
    keys = ["repo", "path"]
    live = diff.where("NOT deleted")
    todo = leaves.join(live.where("stale").select(*keys, "current_sha"), keys)
    if isinstance(generator, Column):
        new = todo.select(*keys, generator.alias("doc"), F.lit(None).cast("string").alias("error"))
    else:
        new = cut(generated(todo, generator, retries, **pace))  # once: a plan may read it twice
    new = new.withColumn("outcome", F.when(F.col("error").isNull(), "regenerated").otherwise("failed"))
    old = cache.join(live.where("NOT stale").select(*keys), keys, "left_semi").select(*keys, "doc", F.lit(None).cast("string").alias("error"), F.lit("reused").alias("outcome"))
    return new.select(*keys, "doc", "outcome", "error").unionByName(old.select(*keys, "doc", "outcome", "error"))


def refresh_nodes(nodes: DataFrame, stale: DataFrame, leaf_docs: DataFrame, cache: DataFrame, synthesizer: Callable[[Column, Column], Column] | Callable[[str, dict[str, str]], str], native: bool = True) -> DataFrame:
    """(repo, node_id, doc, outcome) of all live folders, deepest first, so that a folder sees its children's fresh documents.

    nodes: (repo, node_id) of live folders. A native synthesizer maps the folder's id and its
    sorted array of (id, doc) to a Column; another is called with the id and a dict.
    Folders that are gone from the tree leave the cache.
    """
    every = nodes.select("repo", "node_id", paths.depth(F.col("node_id")).alias("depth"))
    todo = every.join(stale.select("repo", "node_id"), ["repo", "node_id"], "left_semi")
    kept = cache.join(every, ["repo", "node_id"], "left_semi").join(todo, ["repo", "node_id"], "left_anti").select("repo", "node_id", "doc")
    deepest = todo.agg(F.max("depth")).first()[0]
    as_kids = lambda df: df.where(F.col("node_id") != paths.ROOT).select("repo", paths.parent(F.col("node_id")).alias("node_id"), F.col("node_id").alias("id"), "doc")
    kids_of = leaf_docs.where("doc IS NOT NULL").select("repo", paths.parent(F.col("path")).alias("node_id"), F.col("path").alias("id"), "doc").unionByName(as_kids(kept))
    # documents that a folder to be made will see, once, by their folder's level
    kids_of = cut(kids_of.join(todo.select("repo", "node_id", F.col("depth").alias("at")), ["repo", "node_id"])) if deepest is not None else kids_of
    below, out = None, kept.withColumn("outcome", F.lit("reused"))
    for level in range(deepest, -2, -1) if deepest is not None else []:
        own = todo.where(F.col("depth") == level).select("repo", "node_id")
        # a folder's children are leaves, reused folders and those that the level below has made
        here = kids_of.where(F.col("at") == level).drop("at")
        kids = own.join(here if below is None else here.unionByName(as_kids(below)), ["repo", "node_id"], "left")
        packed = kids.groupBy("repo", "node_id").agg(F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("id", "doc")))).alias("kids"))
        if native:
            made = packed.select("repo", "node_id", synthesizer(F.col("node_id"), F.col("kids")).alias("doc"))
        else:

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    docs = [synthesizer(n, {k["id"]: k["doc"] for k in kids}) for n, kids in zip(pdf["node_id"], pdf["kids"], strict=True)]
                    yield pdf[["repo", "node_id"]].assign(doc=docs)

            made = packed.mapInPandas(run, "repo string, node_id string, doc string")
        below = cut(made)
        out = out.unionByName(below.withColumn("outcome", F.lit("resynthesized")))
    return out


def child_listing(kids: Column, n: int = CHILD_CHARS) -> Column:
    """Children's documents under their ids, as a folder's prompt holds them."""
    return F.array_join(F.transform(kids, lambda k: F.concat(F.lit("### "), k["id"], F.lit("\n"), F.left(k["doc"], F.lit(n)))), "\n\n")
