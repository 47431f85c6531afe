"""What a run has to do: leaves to regenerate or delete, folders to resynthesize."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import diff as d
from ..operators import tree


def refresh_plan(current: DataFrame, previous: DataFrame, committed: DataFrame | None = None, keep: Column | None = None, by_hash: bool = False, recorded: DataFrame | None = None) -> DataFrame:
    """(repo, id, action, phase) from two snapshots; action is regen, resynth or delete.

    Folders come from the ancestors of changed leaves, or from a comparison of
    tree hashes; both give the same folders. With recorded, the (repo, node_id,
    node_hash) of folders that have been made, these count instead of the previous
    leaves' tree, so that folders which an earlier run left undone are found.
    """
    diff = d.snapshot_diff(current, previous, committed, keep)
    cur, old = (x if keep is None else x.where(keep) for x in (current, previous))
    changed = diff.where("stale")
    leaf = changed.select("repo", F.col("path").alias("id"), F.when(F.col("deleted"), "delete").otherwise("regen").alias("action"), F.lit(1).alias("phase"))
    if recorded is not None:
        stale = tree.stale_nodes(tree.node_hashes(cur), recorded.withColumn("kind", F.lit("folder")))
    else:
        stale = tree.stale_nodes(tree.node_hashes(cur), tree.node_hashes(old)) if by_hash else tree.ancestor_closure(changed, cur)
    return leaf.unionByName(stale.select("repo", F.col("node_id").alias("id"), F.lit("resynth").alias("action"), F.lit(2).alias("phase")))


def summary(plan: DataFrame) -> DataFrame:
    """(repo, stale_leaves, stale_nodes, deleted) by repository."""
    n = lambda a, c: F.count_if(F.col("action") == a).alias(c)
    return plan.groupBy("repo").agg(n("regen", "stale_leaves"), n("resynth", "stale_nodes"), n("delete", "deleted"))


def in_order(plan: DataFrame) -> DataFrame:
    """Work in the order of a run, with `ord`: leaves by path, then folders deepest first, of equal depth by falling id."""
    work = plan.where("action <> 'delete'").withColumn("depth", F.when(F.col("phase") == 2, paths.depth(F.col("id"))).otherwise(F.lit(0)))
    from pyspark.sql import Window

    order = [F.col("phase"), F.desc("depth"), F.when(F.col("phase") == 1, F.col("id")), F.desc("id")]
    return work.withColumn("ord", F.row_number().over(Window.partitionBy("repo").orderBy(*order)))
