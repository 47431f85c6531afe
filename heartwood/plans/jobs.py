"""Ways into a run: a look at its plan, a preview that keeps nothing, and jobs for repositories that events name."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import safe_name
from ..operators import budget
from ..sources.files import snapshot
from ..sources.state import Store, cut, remove, shared_dir
from ..streaming import events as ev
from . import plan as p
from . import run as r

MOST = 6  # fixed value: files of a preview
STATUS = "repo string, sha string, status string, regenerated bigint, reused bigint, resynthesized bigint, error string"


def outlook(store: Store, files: DataFrame, committed: DataFrame | None = None, keep: Column | None = None, ceiling: float = budget.CEILING, price: float = budget.PRICE) -> DataFrame:
    """(repo, id, action, phase, ord, running, admitted): what a run would do, of which nothing is done.

    committed, the (repo, path, blob_sha) of the version that an outside record
    names as the last one, counts for leaves where the store holds no version
    yet. Deletions cost nothing; they have no place in the order and are admitted.
    """
    own = files if keep is None else files.where(keep)
    known = store.state()[0] > 0
    todo = p.refresh_plan(snapshot(own, F.col("repo")), store.read("leaf_sha", r.LEAF), None if known else committed, recorded=store.read("tree", r.TREE))
    todo = cut(todo)
    return planned(todo, ceiling, price)


def planned(todo: DataFrame, ceiling: float = budget.CEILING, price: float = budget.PRICE, by: tuple[str, ...] = ()) -> DataFrame:
    """A plan in the order of a run, with the running cost and what the ceiling admits."""
    work = budget.admit(p.in_order(todo).withColumn("cost", F.lit(price)), "cost", ceiling, ("phase", "repo", "ord"), by)
    none = todo.where("action = 'delete'").withColumns({"ord": F.lit(None).cast("int"), "running": F.lit(None).cast("double"), "admitted": F.lit(True)})
    return work.select(*none.columns).unionByName(none)


@dataclass
class Preview:
    result: r.Result
    total: int
    capped: int
    truncated: bool


def preview(files: DataFrame, generator, synthesizer, most: int = MOST, **options) -> Preview:
    """A run over the first code files by path, whose state is deleted. Files without code are an error."""
    code = files.where(paths.is_code(F.col("path")))
    total = code.count()
    if not total:
        raise ValueError("there are no files of a known language")
    some = cut(code.orderBy("repo", "path").limit(most))  # the limit is the feature
    base = f"{shared_dir(files.sparkSession)}/heartwood-preview-{uuid.uuid4().hex}"
    try:
        result = r.run(Store(files.sparkSession, base), some, "preview", generator, synthesizer, **options)
    finally:
        remove(files.sparkSession, base)
    return Preview(result, total, min(total, most), total > most)


def job(store: Store, files: Callable[[], DataFrame], repo: str, sha: str, generator, synthesizer, **options) -> tuple:
    """Run one repository; a row of STATUS. An error is a row too, and the base stays."""
    try:
        done = r.run(store, files(), sha, generator, synthesizer, **options)
        if done.noop:
            return (repo, sha, "noop", 0, 0, 0, None)
        n = {x["outcome"]: x["n"] for x in done.leaf_docs.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
        made = done.node_docs.where("outcome = 'resynthesized'").count()
        return (repo, sha, "halted" if done.halted else "generated", n.get("regenerated", 0), n.get("reused", 0), made, None)
    except Exception as e:  # noqa: BLE001
        return (repo, sha, "error", 0, 0, 0, str(e)[:300])


def wanted(events: DataFrame, branches: Column, docs_branch: Column) -> DataFrame:
    """(repo, ts, sha): the newest commit of each repository among events (type, repo, enabled, ts, payload) that start a run."""
    at = lambda path: F.get_json_object("payload", path)
    g = ev.gate(F.col("type"), F.col("enabled"), at("$.ref"), at("$.action"), at("$.pull_request.base.ref"), branches, docs_branch)
    rows = events.where(g["process"]).select("repo", "ts", ev.commit_sha(F.col("type"), F.col("payload")).alias("sha"))
    return ev.latest_by_repo(rows.where("sha IS NOT NULL"))


def together(base: str, load: Callable[[DataFrame], DataFrame], generator, synthesizer, branches: tuple[str, ...] = ev.BRANCHES, docs_branch: str = "docs", **options) -> Callable[[DataFrame, int], None]:
    """For events.on_batches(): one run for all repositories that a batch names, in one store under base/store.

    load gives the files (repo, path, text) of a table (repo, ts, sha) of repositories at commits. The run's tables are keyed
    by repository, and the commit leaves those of others as they are. Rows of STATUS go to base/status under the batch's
    number, so that a batch which is run again replaces them. A failed leaf makes its repository's row an error.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        todo = cut(wanted(batch, F.array(*map(F.lit, branches)), F.lit(docs_branch)))
        if todo.isEmpty():
            return
        store = Store(spark, f"{base}/store")
        done = r.run(store, load(todo), f"batch {batch_id}", generator, synthesizer, repos=todo, **options)
        n = lambda outcome, name: F.count_if(F.col("outcome") == outcome).alias(name)
        if done.noop:
            rows = todo.select("repo", "sha", F.lit("noop").alias("status"), *(F.lit(0).cast("bigint").alias(c) for c in ("regenerated", "reused", "resynthesized")), F.lit(None).cast("string").alias("error"))
        else:
            leaf = done.leaf_docs.groupBy("repo").agg(n("regenerated", "regenerated"), n("reused", "reused"), F.min("error").alias("error"))
            node = done.node_docs.groupBy("repo").agg(n("resynthesized", "resynthesized"))
            work = done.plan.select("repo").distinct().withColumn("work", F.lit(True))
            both = todo.join(leaf, "repo", "left").join(node, "repo", "left").join(work, "repo", "left")
            status = F.when(F.col("error").isNotNull(), "error").when(F.col("work").isNull(), "noop").when(F.lit(done.halted), "halted").otherwise("generated")
            zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
            rows = both.select("repo", "sha", status.alias("status"), zero("regenerated"), zero("reused"), zero("resynthesized"), F.left("error", F.lit(300)).alias("error"))
        rows.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{base}/status/{batch_id}")

    return handle


def handler(base: str, load: Callable[[str, str], DataFrame], generator, synthesizer, branches: tuple[str, ...] = ev.BRANCHES, docs_branch: str = "docs", **options) -> Callable[[DataFrame, int], None]:
    """For events.on_batches(): a run for each repository that a batch names, each with a store of its own, and
    their rows of STATUS appended to base/status. load gives a repository's files (repo, path, text) at a commit.
    A batch's repositories come one after another; each run is distributed."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        todo = cut(wanted(batch, F.array(*map(F.lit, branches)), F.lit(docs_branch)).withColumn("folder", safe_name(F.col("repo"))))
        for x in todo.toLocalIterator():
            row = job(Store(spark, f"{base}/{x['folder']}"), lambda x=x: load(x["repo"], x["sha"]), x["repo"], x["sha"], generator, synthesizer, **options)
            spark.createDataFrame([row], STATUS).withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(f"{base}/status")

    return handle
