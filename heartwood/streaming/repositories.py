"""State of each repository in a stream: its newest commit, what is pending, and how its last run ended.

Rows are (repo, ts, kind, sha, ...), kind being commit, done or failed. State
does not depend on the order in which rows come: a result settles all commits
up to its time. Each batch's new states are written under the batch's number, so
that a batch which is run again replaces its rows; the newest state of a
repository is that with most rows seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

STATE = "repo string, seen bigint, last_ts bigint, sha string, status string, pending bigint"
SETTING = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Repository(StatefulProcessor):
    """A repository's state; pending commits wait in a map until a result settles them, or a timer finds them stalled."""

    def __init__(self, patience_ms: int | None):
        self.patience_ms = patience_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.own = handle.getValueState("own", "seen bigint, ts bigint, sha string, result_ts bigint, result string, timer bigint")
        self.pending = handle.getMapState("pending", "sha string", "ts bigint")

    def _row(self, repo: str, own: tuple, waiting: int, status: str | None = None) -> pd.DataFrame:
        return pd.DataFrame([(repo, own[0], own[1], own[2], status or ("pending" if waiting else own[4] or "idle"), waiting)], columns=["repo", "seen", "last_ts", "sha", "status", "pending"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen, ts, sha, result_ts, result, timer = self.own.get() or (0, None, None, None, None, None)
        new: dict[str, int] = {}
        for pdf in rows:
            seen += len(pdf)
            is_commit = pdf["kind"] == "commit"
            for s, t in zip(pdf["sha"][is_commit], pdf["ts"][is_commit], strict=True):
                new[s] = max(new.get(s, t), int(t))
            done = pdf[~is_commit]
            if len(done):
                t, k = max(zip(done["ts"].astype(int), done["kind"], strict=True))
                if result_ts is None or (t, k) > (result_ts, result):
                    result_ts, result = int(t), k
        if new:
            t, s = max((t, s) for s, t in new.items())
            if ts is None or (t, s) > (ts, sha):
                ts, sha = t, s
        for s, t in new.items():
            old = self.pending.getValue((s,))
            if (result_ts is None or t > result_ts) and (old is None or t > old[0]):
                self.pending.updateValue((s,), (t,))
        waiting = 0
        for (s,), (t,) in list(self.pending.iterator()):
            if result_ts is not None and t <= result_ts:
                self.pending.removeKey((s,))
            else:
                waiting += 1
        if self.patience_ms is not None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = ts // 1000 + self.patience_ms if waiting else None
            if timer is not None:
                self.handle.registerTimer(timer)
        own = (seen, ts, sha, result_ts, result, timer)
        self.own.update(own)
        yield self._row(key[0], own, waiting)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        own = self.own.get()
        waiting = sum(1 for _ in self.pending.iterator())
        if own is not None and waiting and expiredTimerInfo.getExpiryTimeInMs() == own[5]:
            own = (own[0] + 1, *own[1:5], None)  # a state of its own, later than the last
            self.own.update(own)
            yield self._row(key[0], own, waiting, "stalled")

    def close(self) -> None:
        pass


def track(rows: DataFrame, out: str, checkpoint: str, patience_ms: int | None = None) -> StreamingQuery:
    """Bring the states in the folder out up to date with what a stream of rows (ts a timestamp) has; then stop.

    Event time moves timers: with patience_ms, a repository whose newest commit is
    that old with no result becomes stalled. Rows that come late count as any other.
    """
    spark = rows.sparkSession
    marked = rows.withWatermark("ts", "0 seconds")
    plain = marked.select("repo", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "kind", "sha")
    states = plain.groupBy("repo").transformWithStateInPandas(Repository(patience_ms), STATE, "Update", "EventTime")
    write = lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/{batch}")
    before = spark.conf.get(SETTING, None)
    spark.conf.set(SETTING, PROVIDER)  # a query takes the settings of its start
    try:
        return states.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(SETTING) if before is None else spark.conf.set(SETTING, before)


def states(spark: SparkSession, out: str) -> DataFrame:
    """The newest state of each repository."""
    rows = spark.read.schema(STATE).option("recursiveFileLookup", "true").parquet(out)
    return rows.groupBy("repo").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "repo")), "seen").alias("s")).select("repo", "s.*")
