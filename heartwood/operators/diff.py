"""Snapshots of files against one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["repo", "path"]


def snapshot_diff(current: DataFrame, previous: DataFrame, committed: DataFrame | None = None, keep: Column | None = None) -> DataFrame:
    """(repo, path, current_sha, recorded_sha, stale, deleted) of leaves of either snapshot.

    One full outer join on (repo, path). A leaf that was never recorded is held
    against its committed identifier, if a table of them is given. keep, a
    condition on (repo, path), applies to both sides before the join.
    """
    cur, rec = (df if keep is None else df.where(keep) for df in (current, previous))
    cur = cur.select(*KEYS, F.col("blob_sha").alias("current_sha"))
    rec = rec.select(*KEYS, F.col("blob_sha").alias("recorded_sha"))
    both = cur.join(rec, KEYS, "full_outer")
    if committed is not None:
        old = committed.select(*KEYS, F.col("blob_sha").alias("old_sha"))
        both = both.join(old, KEYS, "left").withColumn("recorded_sha", F.coalesce("recorded_sha", "old_sha")).drop("old_sha")
    deleted = F.col("current_sha").isNull()
    return both.select(*KEYS, "current_sha", "recorded_sha", (~F.col("current_sha").eqNullSafe(F.col("recorded_sha"))).alias("stale"), deleted.alias("deleted"))


def since(current: DataFrame, recorded: DataFrame, base: str | None, ancestors: DataFrame, sha: str = "sha") -> DataFrame:
    """snapshot_diff against what was recorded at base; where base is not among the ancestors, all of current is
    stale and nothing deleted."""
    known = base is not None and not ancestors.where(F.col(sha) == base).isEmpty()
    return snapshot_diff(current, recorded if known else recorded.limit(0))


def changes(diff: DataFrame) -> DataFrame:
    """(repo, path, change): added, modified or deleted leaves."""
    kind = F.when(F.col("deleted"), "deleted").when(F.col("recorded_sha").isNull(), "added").otherwise("modified")
    return diff.where("stale").select(*KEYS, kind.alias("change"))


def name_status(lines: DataFrame, line: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, change), with columns of keep, from lines of a name-status listing: the old name of a rename is deleted, its new one changed."""
    parts = F.split(F.col(line), "\t")
    kind = F.substring(parts[0], 1, 1)
    last = F.element_at(parts, -1)
    item = lambda p, c: F.struct(p.alias("path"), F.lit(c).alias("change"))
    rows = (
        F.when(kind == "D", F.array(item(last, "deleted")))
        .when((kind == "R") & (F.size(parts) >= 3), F.array(item(parts[1], "deleted"), item(last, "changed")))
        .otherwise(F.array(item(last, "changed")))
    )
    return lines.where(F.size(parts) >= 2).select(*keep, F.explode(rows).alias("r")).select(*keep, "r.path", "r.change").distinct()
