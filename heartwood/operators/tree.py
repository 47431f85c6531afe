"""The tree of folders above leaves: its hashes, and which nodes are out of date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, paths
from ..sources.state import cut

#: Levels folded in one plan; deeper trees cut it, level by level.
PLAN_LEVELS = 4


def live_nodes(leaves: DataFrame) -> DataFrame:
    """(repo, node_id) of every folder above a leaf."""
    return leaves.select("repo", F.explode(paths.ancestors(F.col("path"))).alias("node_id")).distinct()


def node_hashes(leaves: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """(repo, node_id, parent_id, depth, kind, node_hash) of leaves and folders.

    repos, a table of `repo`, names those that have a root even without leaves: its
    hash is that of its id alone. Folded level by level from the deepest folders: one aggregation by parent
    each, over leaves and the level below.
    """
    flat = leaves.select("repo", F.col("path").alias("node_id"), paths.parent(F.col("path")).alias("parent_id"), F.col("blob_sha").alias("node_hash"))
    flat = cut(flat.withColumn("at", paths.depth(F.col("parent_id"))))  # the items' contents are read and hashed once
    deepest = flat.agg(F.max("at")).first()[0]
    out = _folded(flat, deepest)
    if repos is None:
        return out
    none = F.lit(None).cast("string")
    bare = repos.select("repo").distinct().join(flat.select("repo").distinct(), "repo", "left_anti")
    roots = bare.select("repo", F.lit(paths.ROOT).alias("node_id"), none.alias("parent_id"), F.lit(-1).alias("depth"), F.lit("project").alias("kind"), F.sha2(F.lit(paths.ROOT), 256).alias("node_hash"))
    return out.unionByName(roots)


def _folded(flat: DataFrame, deepest: int | None) -> DataFrame:
    out = flat.select("repo", "node_id", "parent_id", paths.depth(F.col("node_id")).alias("depth"), F.lit("leaf").alias("kind"), "node_hash")
    if deepest is None:
        return out
    below = None
    for level in range(deepest, -2, -1):
        own = flat.where(F.col("at") == level).select("repo", "parent_id", "node_id", "node_hash")
        kids = own if below is None else own.unionByName(below.select("repo", "parent_id", "node_id", "node_hash"))
        folded = kids.groupBy("repo", F.col("parent_id").alias("node")).agg(F.collect_list(F.concat_ws(":", "node_id", "node_hash")).alias("kids"))
        kind = "project" if level == -1 else "folder"
        up = F.lit(None).cast("string") if level == -1 else paths.parent(F.col("node"))
        below = folded.select("repo", F.col("node").alias("node_id"), up.alias("parent_id"), F.lit(level).alias("depth"), F.lit(kind).alias("kind"), hashing.fold(F.col("node"), F.col("kids")).alias("node_hash"))
        if deepest - level >= PLAN_LEVELS:
            below = cut(below)
        out = out.unionByName(below)
    return out


def stale_nodes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(repo, node_id) of folders that are new or whose hash differs, from two tables of node_hashes()."""
    cur = current.where("kind <> 'leaf'").select("repo", "node_id", "node_hash")
    old = previous.where("kind <> 'leaf'").select("repo", "node_id", F.col("node_hash").alias("old"))
    return cur.join(old, ["repo", "node_id"], "left").where(~F.col("node_hash").eqNullSafe(F.col("old"))).select("repo", "node_id")


def ancestor_closure(changed: DataFrame, leaves: DataFrame) -> DataFrame:
    """(repo, node_id) of live folders above changed paths: the same nodes as stale_nodes(), without hashes."""
    return live_nodes(changed).join(live_nodes(leaves), ["repo", "node_id"], "left_semi")


# the tree as a document


NODE = "node_id string, kind string, node_hash string, children array<string>"


def _quoted(text: Column) -> Column:
    """A string as JSON writes it."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def to_documents(nodes: DataFrame) -> DataFrame:
    """(repo, doc): the whole tree of node_hashes() as nested JSON, with keys sorted and children by id.

    Built from the deepest level up, one aggregation by parent each, as the hashes are.
    """
    own = cut(nodes.select("repo", "node_id", "parent_id", "depth", "kind", "node_hash").withColumn("level", F.coalesce(paths.depth(F.col("parent_id")) + 1, F.lit(-1))))
    deepest = own.agg(F.max("level")).first()[0]
    none = F.array().cast("array<struct<node_id:string,doc:string>>")
    below = None
    for level in range(deepest if deepest is not None else -2, -2, -1):
        here = own.where(F.col("level") == level)
        if below is None:
            here = here.withColumn("kids", none)
        else:
            kids = below.groupBy("repo", F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("node_id", "doc"))).alias("kids"))
            # a leaf and a folder never share an id below one parent
            here = here.join(kids, ["repo", "node_id"], "left").withColumn("kids", F.coalesce("kids", none))
        doc = F.concat(F.lit('{"children":['), F.array_join(F.transform("kids", lambda k: k["doc"]), ","), F.lit('],"kind":'), _quoted(F.col("kind")), F.lit(',"node_hash":'), _quoted(F.col("node_hash")), F.lit(',"node_id":'), _quoted(F.col("node_id")), F.lit("}"))
        below = cut(here.select("repo", "node_id", "parent_id", doc.alias("doc")))
    if below is None:
        return nodes.sparkSession.createDataFrame([], "repo string, doc string")
    return below.select("repo", "doc")


def from_documents(docs: DataFrame) -> DataFrame:
    """(repo, node_id, parent_id, kind, node_hash) of every node of nested trees, taken apart level by level."""
    front = docs.select("repo", F.lit(None).cast("string").alias("parent_id"), "doc")
    out = None
    while True:
        level = cut(front.select("repo", "parent_id", F.from_json("doc", NODE).alias("n")).where("n.node_id IS NOT NULL").select("repo", "parent_id", "n.*"))
        if level.isEmpty():
            rows = level if out is None else out
            return rows.select("repo", "node_id", "parent_id", "kind", "node_hash")
        out = level if out is None else out.unionByName(level)
        front = level.select("repo", F.col("node_id").alias("parent_id"), F.explode("children").alias("doc"))


def find(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(repo, node_id, kind, node_hash) of nodes wanted (repo, node_id), found along their paths in nested trees; absent ones give no row.

    A tree's nodes are taken apart once, whatever number of wanted ones lies below them, and only where some do.
    """
    want = cut(wanted.select("repo", "node_id").distinct())
    parts = F.split("node_id", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    along = cut(want.select("repo", F.explode(above).alias("child")).distinct())
    front = docs.select("repo", "doc").join(want.select("repo").distinct(), "repo", "left_semi")
    out, top = None, True
    while True:
        level = cut(front.select("repo", F.from_json("doc", NODE).alias("n")).where("n.node_id IS NOT NULL").select("repo", "n.*"))
        hit = level.join(want, ["repo", "node_id"], "left_semi").select("repo", "node_id", "kind", "node_hash")
        out = hit if out is None else out.unionByName(hit)
        if level.isEmpty():
            return out
        kids = level.select("repo", "node_id", F.explode("children").alias("doc")).withColumn("child", F.get_json_object("doc", "$.node_id"))
        # a root has any id, other nodes' children lie below them
        below = F.col("child") != F.col("node_id") if top else F.startswith("child", F.concat("node_id", F.lit("/")))
        front, top = kids.where(below).join(along, ["repo", "child"], "left_semi").select("repo", "doc"), False
