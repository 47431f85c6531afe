"""A run: plan, refresh within a budget, and commit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import budget, refresh, tree
from ..operators import diff as d
from ..sources.files import snapshot
from ..sources.state import Store, cut
from . import plan as p

LEAF, DOC, NODE_DOC, TREE = "repo string, path string, blob_sha string", "repo string, path string, doc string", "repo string, node_id string, doc string", "repo string, node_id string, node_hash string"


@dataclass
class Result:
    """What a run did. The tables are lazy."""

    sha: str
    noop: bool
    plan: DataFrame
    leaf_docs: DataFrame
    node_docs: DataFrame
    calls: int = 0
    spent: float = 0.0
    halted: bool = False
    failed: bool = False


def run(store: Store, files: DataFrame, sha: str, generator: Column | Callable[[str, str], str], synthesizer: Callable, keep: Column | None = None, ceiling: float | None = None, price: float = budget.PRICE, workers: int | None = None, native: bool = True, retries: int = 0, repos: DataFrame | None = None, name: str = "*", **pace) -> Result:
    """Bring the documents of files (repo, path, text) up to date.

    An empty plan calls nothing and only moves the base. Under a ceiling, work
    is admitted in order before any of it runs; where it does not suffice, what
    was admitted is made and kept, leaves and folders, and the base stays. Beside
    the leaves, the hashes of the folders that have been made are stored, so that
    the next run finds those that were left undone and goes on from there.
    Leaves whose function fails keep their old document and record, and the base
    stays then too. `calls` are the leaves and folders that functions were called
    for. repos, a table of `repo`, limits the run to these repositories of a store
    that holds more; name is what the store files the base under.
    pace: calls under way in a task, their rate and back-off, as calls.called() takes them
    (its workers by the name `concurrent`).
    """
    own = files if keep is None else files.where(keep)
    if "concurrent" in pace:
        pace["workers"] = pace.pop("concurrent")
    store.refresh()
    current = cut(snapshot(own, F.col("repo")))
    here = (lambda df: df) if repos is None else (lambda df: df.join(repos.select("repo"), "repo", "left_semi"))
    previous, cached, folders, made = (here(store.read(n, s)) for n, s in (("leaf_sha", LEAF), ("unit_doc", DOC), ("folder_doc", NODE_DOC), ("tree", TREE)))
    todo = cut(p.refresh_plan(current, previous, recorded=made))
    if todo.isEmpty():
        store.advance(sha, name)
        return Result(sha, True, todo, cached, folders)
    work = cut(p.in_order(todo))
    halted, calls, spent = False, work.count(), 0.0
    admitted = work
    if ceiling is not None:
        marked = cut(budget.admit_all(work.withColumn("cost", F.lit(price)), "cost", ceiling, ("phase", "repo", "ord")))
        halted = not marked.where("NOT admitted").isEmpty()
        admitted = marked.where("admitted")
        row = budget.spend(marked).first()
        calls, spent = row["calls"], row["spent"]
    diff = d.snapshot_diff(current, previous)
    some = admitted.where("phase = 1").select("repo", F.col("id").alias("path"))
    texts = own if workers is None else own.repartition(workers)
    part = diff.join(some, ["repo", "path"], "left_semi").unionByName(diff.where("NOT stale AND NOT deleted"))
    docs = cut(refresh.refresh_leaves(texts, part, cached, generator, retries, **pace))
    good, bad = docs.where("outcome <> 'failed'").select("repo", "path", "doc"), docs.where("outcome = 'failed'").select("repo", "path")
    # a failed leaf keeps what was recorded of it, hash and document, so that it stays stale and its folder still sees it
    kept = bad.join(previous, ["repo", "path"])
    fresh = cut(current.join(good.select("repo", "path"), ["repo", "path"], "left_semi").unionByName(kept))
    shown = cut(good.unionByName(cached.join(kept.select("repo", "path"), ["repo", "path"], "left_semi")))
    failed = not bad.isEmpty()
    # folders are admitted after all leaves; one that waits keeps its document and the hash that was recorded of it
    now = admitted.where("phase = 2").select("repo", F.col("id").alias("node_id"))
    live = tree.live_nodes(current)
    nodes = cut(refresh.refresh_nodes(live, now, shown, folders, synthesizer, native))
    waits = todo.where("phase = 2").select("repo", F.col("id").alias("node_id")).join(now, ["repo", "node_id"], "left_anti")
    hashes = tree.node_hashes(fresh).where("kind <> 'leaf'").select("repo", "node_id", "node_hash").join(waits, ["repo", "node_id"], "left_anti")
    tables = {"folder_doc": nodes.select("repo", "node_id", "doc"), "tree": hashes.unionByName(made.join(waits, ["repo", "node_id"], "left_semi"))}
    if halted:
        tables |= {
            "leaf_sha": previous.join(fresh, ["repo", "path"], "left_anti").unionByName(fresh),
            "unit_doc": cached.join(shown, ["repo", "path"], "left_anti").unionByName(shown),
        }
    else:
        tables |= {"leaf_sha": fresh, "unit_doc": shown}
    # the base stays where work is left undone or has failed
    store.commit(tables, (store.state(name)[2] or "-") if halted or failed else sha, name, repos)
    return Result(sha, False, todo, docs, nodes, calls, spent, halted, failed)
