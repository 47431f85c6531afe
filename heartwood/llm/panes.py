"""Window panes with revisions, as a stateful stream that is started anew for each batch.

Clicks are cut into batches by their day of arrival and a delay, and each batch
is written and moved into the stream's folder before the query starts on its
checkpoint. Within a task, rows of a pane (kind, hour) are added up before the
shuffle, so that a pane of many rows is one row a task. The stateful operator
keeps a pane's totals and those it has published in one value, and two
event-time timers: at the first (grace) the pane is emitted, at the second
(close) it is forgotten. New rows of an emitted pane retract and replace it.
Rows of a closed pane do not become state: they go through the operator under
keys of their own, dealt by click, and come out one by one.

The watermark has no delay and moves between starts only, so in each batch it is
the greatest event time of the batches before. It rides on a column of its own,
shifted by SHIFT so that times before 1970 are above the watermark's start at 0,
and left out before the operator, which so gets late rows too. A sentinel in
the last batch moves it past all timers; one more start then emits what is left.

Defined cases: rows without ts are dropped; of rows with one click_id the least
by (ts, arrived_at, kind, value) counts, and all rows without one are one row;
a null arrived_at is the day of ts; a null kind is `none`; a null or infinite
value counts as 0 cents, amounts outside of 64 bits as the nearest; an empty
table gives no rows; extra columns are not read. A start that fails writes its
batch's rows again, in place of the first ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sources.state import remove, shared_dir

BATCHES = 12
HOUR, DAY = 3_600_000, 86_400_000  # ms
GRACE, CLOSE = 2 * HOUR, 3 * DAY
#: Event times are shifted by 2,000 years of 365 days, the sentinel is later than any.
SHIFT = 2000 * 365 * DAY
SENTINEL = 200_000 * 365 * DAY
#: Keys that late rows are dealt to.
LATE_KEYS = 256
#: Of the stream: the operator's store; a batch's watermark counts from the next start; as each start
#: loads its stores anew, executors keep none after a commit, whose folders would stay on their disks; and a
#: commit writes what has changed.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
ROWS = "record string, kind string, hour bigint, click_id bigint, n_rows bigint, cents bigint"
FEED = "click_id bigint, kind string, hour bigint, cents bigint, mark timestamp, batch int"
MICROS = 1_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    clock = (F.hour(ts) * 60 + F.minute(ts)).cast("bigint") * 60 * MICROS + (F.extract(F.lit("SECOND"), ts) * MICROS).cast("bigint")
    return F.unix_date(F.to_date(ts)).cast("bigint") * (DAY * 1000) + clock


def batch_rows(clicks: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(click_id, kind, hour, cents, mark, batch): each click once, in its batch."""
    order = F.struct("ts", "arrived_at", "kind", "value")
    one = clicks.where("ts IS NOT NULL").select("click_id", order.alias("r")).groupBy("click_id").agg(F.min("r").alias("r")).select("click_id", "r.*")
    day = F.unix_date(F.to_date(F.coalesce("arrived_at", "ts")))
    q = F.pmod(day, F.lit(batches))
    late = F.greatest(F.lit(0), F.crc32(F.coalesce(F.col("click_id").cast("string"), F.lit("")).cast("binary")) % 30 - 23)
    at = micros(F.col("ts")) - (day - q).cast("bigint") * (DAY * 1000)
    amount = F.floor(F.col("value") * 100 + 0.5)
    cents = F.when(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")), 0).otherwise(amount).cast("bigint")
    return one.select(
        "click_id", F.coalesce("kind", F.lit("none")).alias("kind"), F.floor(at / F.lit(HOUR * 1000)).cast("bigint").alias("hour"), cents.alias("cents"),
        F.timestamp_micros(at + F.lit(SHIFT * 1000)).alias("mark"), F.least(F.lit(batches - 1), q + late).cast("int").alias("batch"),
    )


class Panes(StatefulProcessor):
    """Totals of a pane (kind, hour): what has come, and what has been published."""

    def __init__(self, due: str):
        self.due = due  # the record that a due pane becomes

    def init(self, handle) -> None:
        self.handle = handle
        self.pane = handle.getValueState("pane", "n_rows bigint, cents bigint, shown boolean, shown_rows bigint, shown_cents bigint")

    def _out(self, key: tuple, *rows: tuple) -> pd.DataFrame:
        return pd.DataFrame([(r, key[0], key[1], -1, n, c) for r, n, c in rows], columns=["record", "kind", "hour", "click_id", "n_rows", "cents"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[2]:  # late rows: no state
            for pdf in rows:
                yield pdf[["kind_", "hour_", "click_id", "n_rows", "cents"]].rename(columns={"kind_": "kind", "hour_": "hour"}).assign(record="late")[["record", "kind", "hour", "click_id", "n_rows", "cents"]]
            return
        n = cents = 0
        for pdf in rows:
            n, cents = n + int(pdf["n_rows"].sum()), cents + int(pdf["cents"].sum())
        old = self.pane.get()
        if old is None:
            ends = (int(key[1]) + 1) * HOUR + SHIFT
            self.handle.registerTimer(ends + GRACE)
            self.handle.registerTimer(ends + CLOSE)
            self.pane.update((n, cents, False, 0, 0))
        elif not old[2]:
            self.pane.update((old[0] + n, old[1] + cents, False, 0, 0))
        else:
            new = (old[0] + n, old[1] + cents)
            self.pane.update((*new, True, *new))
            yield self._out(key, ("retract", old[3], old[4]), ("replace", *new))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closes = (int(key[1]) + 1) * HOUR + SHIFT + CLOSE
        old = self.pane.get()
        if old is not None and not old[2]:
            yield self._out(key, (self.due, old[0], old[1]))
            self.pane.update((old[0], old[1], True, old[0], old[1]))
        if old is not None and expiredTimerInfo.getExpiryTimeInMs() >= closes:
            self.pane.clear()

    def close(self) -> None:
        pass


def _added(closed_before: int):
    """Rows of each pane added up in the task; rows of panes that end before an hour stay, under a key by click."""
    schema = pa.schema([("kind", pa.string()), ("hour", pa.int64()), ("salt", pa.int32()), ("kind_", pa.string()), ("hour_", pa.int64()), ("click_id", pa.int64()), ("n_rows", pa.int64()), ("cents", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            batch = batch.filter(batch["kind"].is_valid())
            pdf = batch.to_pandas()
            is_late = pdf["hour"] < closed_before
            if is_late.any():
                own = pdf[is_late]
                salt = own["click_id"].fillna(0).astype("int64") % LATE_KEYS + 1
                yield pa.RecordBatch.from_pandas(own.rename(columns={"kind": "kind_", "hour": "hour_"}).assign(kind="", hour=0, salt=salt, n_rows=1), schema, preserve_index=False)
            rest = pa.table({"kind": batch["kind"], "hour": batch["hour"], "cents": batch["cents"]}).filter(pa.array(~is_late))
            parts = rest.append_column("n_rows", pa.repeat(pa.scalar(1, pa.int64()), len(rest)))
            if held is not None:
                parts = pa.concat_tables([held, parts.select(held.column_names)])
            held = parts.group_by(["kind", "hour"]).aggregate([("n_rows", "sum"), ("cents", "sum")]).rename_columns(["kind", "hour", "n_rows", "cents"])
            if len(held) > 1 << 16:  # bounded; what comes later is added up after the shuffle
                yield from _whole(held, schema)
                held = None
        if held is not None:
            yield from _whole(held, schema)

    return run


def _whole(held: pa.Table, schema: pa.Schema) -> list[pa.RecordBatch]:
    n = len(held)
    none = {"salt": pa.repeat(pa.scalar(0, pa.int32()), n), "kind_": pa.nulls(n, pa.string()), "hour_": pa.nulls(n, pa.int64()), "click_id": pa.nulls(n, pa.int64())}
    return pa.table({f.name: none[f.name] if f.name in none else held[f.name] for f in schema}, schema).to_batches()


def _move(spark: SparkSession, source: str, to: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.rename(path(source), path(to)):
        raise OSError(f"{source} can't be moved to {to}")


def revisions(clicks: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(batch, record, kind, hour, click_id, n_rows, cents): what the stream writes for each batch."""
    spark = clicks.sparkSession
    base = f"{shared_dir(spark)}/heartwood-panes-{uuid.uuid4().hex}"
    beats = spark.range(batches + 1, numPartitions=1).select(*(F.lit(None).cast(t).alias(c) for c, t in (("click_id", "bigint"), ("kind", "string"), ("hour", "bigint"), ("cents", "bigint"))), F.timestamp_millis(F.when(F.col("id") == batches - 1, F.lit(SENTINEL)).otherwise(F.lit(0))).alias("mark"), F.col("id").cast("int").alias("batch"))
    # as many files as shuffle partitions in all; a batch has several, so that none gathers in one task
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    deal = F.pmod(F.xxhash64("click_id"), F.lit(max(2, parts // batches)))
    rows = batch_rows(clicks, batches).repartition(F.col("batch"), deal)
    rows.unionByName(beats).write.partitionBy("batch").parquet(f"{base}/feed")
    # a row for each batch: the greatest time of those before it, which is the stream's watermark there
    feed = spark.read.schema(FEED).parquet(f"{base}/feed")
    most = {r["batch"]: r["m"] for r in feed.where("kind IS NOT NULL").groupBy("batch").agg(F.max(F.unix_micros("mark")).alias("m")).collect()}
    spark._jvm.org.apache.hadoop.fs.Path(f"{base}/in").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/in"))
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        for b in range(batches + 1):
            _move(spark, f"{base}/feed/batch={b}", f"{base}/in/batch={b}")
            _start(spark, base, b, batches, max((m for k, m in most.items() if k < b), default=None))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    remove(spark, f"{base}/in")
    remove(spark, f"{base}/state")
    return spark.read.schema(f"batch bigint, {ROWS}").parquet(*(f"{base}/out/{b}" for b in range(batches + 1)))


def _start(spark: SparkSession, base: str, b: int, batches: int, watermark: int | None) -> None:
    """One start of the query, over the batch that has just come."""
    last = b == batches
    # a pane is closed if its hour's end and three days are not after the watermark
    closed_before = -(1 << 62) if watermark is None else (watermark // 1000 - SHIFT - CLOSE) // HOUR
    stream = spark.readStream.schema(FEED).parquet(f"{base}/in").withWatermark("mark", "0 seconds")
    # beats are left out in the map: a condition on the stream would be put before its watermark, and take the sentinel away
    clicks = stream.select("click_id", "kind", "hour", "cents")
    parts = clicks.mapInArrow(_added(closed_before), "kind string, hour bigint, salt int, kind_ string, hour_ bigint, click_id bigint, n_rows bigint, cents bigint")
    out = parts.groupBy("kind", "hour", "salt").transformWithStateInPandas(Panes("final" if last else "emit"), ROWS, "Append", "EventTime")

    def write(df: DataFrame, _: int) -> None:
        df.select(F.lit(min(b, batches - 1)).cast("bigint").alias("batch"), "*").write.mode("overwrite").parquet(f"{base}/out/{b}")

    q = out.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
