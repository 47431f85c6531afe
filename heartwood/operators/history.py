"""Commits and their parents: what is reachable, and what changed between two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.state import cut, release
from .diff import name_status


def ancestors(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, sha, distance) of the commits that starts (start, sha) lead to over edges (sha, parent), themselves at 0.

    A frontier join a step: each commit is entered once for each start, at its
    least distance, so that work follows the edges that are reached.
    """
    front = cut(starts.select("start", "sha").distinct().withColumn("distance", F.lit(0)))
    seen, step = front, 0
    own = edges.select("sha", "parent")
    while not front.isEmpty():
        step += 1
        # never broadcast: a small frontier on disk would pass through the driver at each step
        up = front.join(own.hint("merge"), "sha").select("start", F.col("parent").alias("sha")).where("sha IS NOT NULL").distinct()
        front = cut(up.join(seen.select("start", "sha").hint("merge"), ["start", "sha"], "left_anti").withColumn("distance", F.lit(step)))
        old, seen = seen, cut(seen.unionByName(front))
        if step > 1:
            release(old)
    return seen


def is_ancestor(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (base, head) with `known`: whether base is head or one of its ancestors."""
    reach = ancestors(edges, pairs.select(F.col("head").alias("start"), F.col("head").alias("sha")))
    hit = reach.select(F.col("start").alias("head"), F.col("sha").alias("base"), F.lit(True).alias("known"))
    return pairs.join(hit, ["head", "base"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def between(edges: DataFrame, lines: DataFrame, base: str | None, head: str) -> DataFrame:
    """(path, change) that commits reachable from head, but not from base, make by their name-status lines (sha, line).

    Where several commits touch a path, the one nearest to head counts (of equal ones a change before a deletion).
    """
    spark = edges.sparkSession
    names = [("head", head)] + ([("base", base)] if base is not None else [])
    kind = edges.schema["sha"].dataType.simpleString()
    reach = cut(ancestors(edges, spark.createDataFrame(names, f"start string, sha {kind}")))
    own = reach.where("start = 'head'").join(reach.where("start = 'base'").select("sha"), "sha", "left_anti")
    each = name_status(lines.join(own.select("sha", "distance"), "sha"), keep=("distance",))
    return each.groupBy("path").agg(F.min(F.struct("distance", "change")).alias("m")).select("path", "m.change")
