"""Panes of a stream against a plain version, batch by batch."""

import collections
import datetime as dt
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from heartwood.llm import panes, queries

CLICKS = "click_id bigint, ts timestamp_ntz, arrived_at timestamp_ntz, kind string, value double"
EPOCH = dt.datetime(1970, 1, 1)


def plain(rows, batches=12):
    """What the stream writes, from rows in any order."""
    best = {}
    for r in rows:
        if r[1] is not None:
            key = tuple((x is not None, x if x is not None else 0) for x in (r[1], r[2], r[3], r[4]))
            if r[0] not in best or key < best[r[0]][0]:
                best[r[0]] = key, r
    us = lambda t: (t - EPOCH) // dt.timedelta(microseconds=1)
    by = collections.defaultdict(list)
    for _, (i, ts, arrived, kind, value) in best.values():
        day = us(arrived or ts) // 86_400_000_000
        q = day % batches
        b = min(batches - 1, q + max(0, zlib.crc32(("" if i is None else str(i)).encode()) % 30 - 23))
        at = us(ts) - (day - q) * 86_400_000_000
        cents = 0 if value is None or not math.isfinite(value) else math.floor(100 * value + 0.5)
        by[b].append((i, "none" if kind is None else kind, at // 3_600_000_000, at, cents))
    out, w, pane = [], -math.inf, {}
    hour = 3_600_000_000
    for b in range(batches):
        fresh = set()
        for i, kind, h, _, cents in by[b]:
            if w >= (h + 1) * hour + 72 * hour:
                out.append((b, h, i, 1, cents, "late", kind))
                continue
            p = pane.setdefault((kind, h), [0, 0, None])
            p[0], p[1] = p[0] + 1, p[1] + cents
            fresh.add((kind, h))
        for (kind, h), p in list(pane.items()):
            if p[2] is not None and (kind, h) in fresh:
                out += [(b, h, -1, *p[2], "retract", kind), (b, h, -1, p[0], p[1], "replace", kind)]
                p[2] = p[0], p[1]
            elif p[2] is None and w >= (h + 1) * hour + 2 * hour:
                out.append((b, h, -1, p[0], p[1], "emit", kind))
                p[2] = p[0], p[1]
            if w >= (h + 1) * hour + 72 * hour:
                del pane[kind, h]
        w = max([w, *(x[3] for x in by[b])])
    out += [(batches - 1, h, -1, p[0], p[1], "final", kind) for (kind, h), p in pane.items() if p[2] is None]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("batch", "hour", "click_id", "n_rows", "cents", "record", "kind").collect()), key=repr)


def test_clicks(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/clicks.parquet").select("click_id", "ts", "arrived_at", "kind", "value").collect()]
    expect = plain(rows)
    assert {r[5] for r in expect} == {"late", "emit", "retract", "replace", "final"}
    assert got(queries.op13_panes(spark, sf)) == expect


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_odd_rows(spark, zone):
    """Nulls, repeated rows, times long before and after 1970, edges of panes, batches without rows, and clashing columns."""
    rng = random.Random(3)
    day = dt.timedelta(days=1)
    rows = [(i, EPOCH + rng.randrange(-3, 9) * day + dt.timedelta(seconds=rng.randrange(86400)), EPOCH + rng.choice([0, 1, 4, 9]) * day, rng.choice(["a", "b", None, ""]), rng.choice([0.005, -1.5, None, 7.25])) for i in range(150)]
    rows += [rows[5], rows[5], (7, EPOCH, EPOCH, "a", 1.0), (None, EPOCH, None, None, None), (None, EPOCH + day, None, "a", 1.0), (900, None, EPOCH, "a", 1.0), (901, EPOCH, None, "a", float("nan")), (902, EPOCH, EPOCH, "a", float("inf"))]
    rows += [(1000 + k, EPOCH + 2 * day + dt.timedelta(hours=k), EPOCH + 2 * day, "edge", 1.0) for k in range(24)] + [(1100, EPOCH + dt.timedelta(microseconds=-1), EPOCH, "edge", 1.0), (1200, dt.datetime(1890, 1, 1), EPOCH + 3 * day, "old", 1.0)]
    df = spark.createDataFrame(rows, CLICKS).withColumns({c: F.lit("x") for c in ("batch", "mark", "hour", "Record", "salt")})
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert got(panes.revisions(df)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_no_rows(spark):
    before = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    assert got(panes.revisions(spark.createDataFrame([], CLICKS), batches=2)) == []
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == before
