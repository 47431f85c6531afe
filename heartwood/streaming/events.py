"""Repository events: which of them start a run, and streams of them."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType

BRANCHES = ("main", "master")  # fixed values: branches that are followed where none are configured
_HEADS = "refs/heads/"
COMMITS = "array<struct<added:array<string>,modified:array<string>,message:string>>"


def branch(ref: Column) -> Column:
    return F.when(F.startswith(ref, F.lit(_HEADS)), F.substring(ref, len(_HEADS) + 1, 1_000_000))


def gate(event_type: Column, enabled: Column, ref: Column, action: Column, base: Column, branches: Column, docs_branch: Column) -> Column:
    """(process, reason) of an event. A push of something other than a branch passes."""
    b = branch(ref)
    reason = (
        F.when(~F.coalesce(event_type.isin("push", "pull_request"), F.lit(False)), "unsupported")
        .when(~F.coalesce(enabled, F.lit(False)), "disabled")
        .when((event_type == "push") & b.isNotNull() & ~F.coalesce(F.array_contains(branches, b), F.lit(False)), "branch")
        .when((event_type == "push") & b.isNotNull() & F.coalesce(b == docs_branch, F.lit(False)), "docs branch")
        .when((event_type == "pull_request") & ~F.coalesce(action.isin("opened", "synchronize"), F.lit(False)), "action")
        .when((event_type == "pull_request") & ~F.coalesce(F.array_contains(branches, base), F.lit(False)), "base")
        .otherwise("process")
    )
    return F.struct((reason == "process").alias("process"), reason.alias("reason"))


def commit_sha(event_type: Column, payload: Column) -> Column:
    """The commit that an event is about."""
    return F.when(event_type == "push", F.get_json_object(payload, "$.after")).when(event_type == "pull_request", F.get_json_object(payload, "$.pull_request.head.sha"))


def changed_files(events: DataFrame, key: str = "delivery_id", payload: str = "payload") -> DataFrame:
    """(key, path): distinct files that an event's commits add or modify; removed ones don't count."""
    commits = F.from_json(F.get_json_object(payload, "$.commits"), COMMITS)
    each = events.select(key, F.explode(commits).alias("c"))
    none = F.array().cast("array<string>")
    return each.select(key, F.explode(F.concat(F.coalesce("c.added", none), F.coalesce("c.modified", none))).alias("path")).distinct()


@F.pandas_udf(BooleanType())
def signed(body: pd.Series, signature: pd.Series, secret: pd.Series) -> pd.Series:
    """Whether an event's signature is that of its body; no without a secret or a signature."""

    def ok(b: bytes | None, s: str | None, k: str | None) -> bool:
        if not k or not s or b is None:
            return False
        return hmac.compare_digest("sha256=" + hmac.new(k.encode(), bytes(b), hashlib.sha256).hexdigest(), s)

    return pd.Series([ok(*x) for x in zip(body, signature, secret, strict=True)])


def latest_by_repo(events: DataFrame, repo: str = "repo", ts: str = "ts", value: str = "sha") -> DataFrame:
    """The newest value of each repository (ties by the greater value): one partial aggregation."""
    return events.groupBy(repo).agg(F.max(F.struct(ts, value)).alias("m")).select(repo, f"m.{ts}", f"m.{value}")


def once(events: DataFrame, delivery: str = "delivery_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A stream without redeliveries."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([delivery])


def windowed_counts(events: DataFrame, ts: str = "ts", by: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def on_batches(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call handle with each micro-batch of what has arrived, then stop; state of the stream is in checkpoint."""
    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
