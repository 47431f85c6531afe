"""WARC archives: round trips, odd pages and hostile payloads."""

import gzip
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from heartwood.llm import queries, warc

PAGES = "page_id bigint, url string, html string"


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def plain(rows, least=warc.REVISIT):
    """What read_back() gives for rows (id, url, html)."""
    out, groups = [], {}
    for i, u, h in rows:
        b = (h or "").encode()
        groups.setdefault(b, []).append((i is not None, i or 0, u or ""))
    taken = set()
    for i, u, h in rows:
        b = (h or "").encode()
        best = max(groups[b])
        own = (i is not None, i or 0, u or "")
        again = len(b) >= least and (own[:2] != best[:2] or b in taken)
        if len(b) >= least and own[:2] == best[:2]:
            taken.add(b)
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", best[1] if again else None))
    return sorted(out, key=repr)


def back(spark, folder, kind="bigint"):
    return sorted(map(tuple, warc.read_back(spark, folder, kind).collect()), key=repr)


def test_pages_against_plain(spark, sf):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, queries.op11_warc(spark, sf).collect()), key=repr) == plain(rows)


def test_odd_pages(spark, folder):
    """Nulls, repeated rows, ties, blank lines and separators inside payloads, and clashing columns."""
    long = "x" * 1200
    nested = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\n\r\n" * 30
    rows = [
        (1, "http://a/", None), (2, "http://a/", ""), (3, None, "\r\n\r\n"), (None, "http://n/", "null id"), (4, "http://b/ c\r\nX: y", "\r\n\r\nWARC/"),
        (5, "http://c/", long), (6, "http://d/", long), (6, "http://d/", long), (6, "http://d/", long), (7, "http://e/", "short"), (7, "http://e/", "short"), (None, "http://f/", long),
        (8, "http://g/", nested), (9, "http://h/", nested), (10, "http://i/", "é€😀" * 500 + "\r\n"), (11, "http://j/", "\r\n" * 40_000), (12, "http://k/", "\x00\x01" * 700),
    ]
    df = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit(1) for c in ("rid", "Body", "digest", "value", "copies")})
    warc.write_archives(df.repartition(3), folder)
    assert back(spark, folder) == plain(rows)
    records = warc.read_records(spark, folder, payload=True).collect()
    assert not [r for r in records if r["error"] or r["digest_ok"] is False]
    assert sum(r["type"] == "request" for r in records) == len(rows) == sum(r["type"] == "metadata" for r in records)
    assert len({r["record_id"] for r in records}) == len(records)
    assert {bytes(r["payload"]).decode() for r in records if r["type"] == "response"} == {h or "" for _, _, h in rows}


def test_archives_are_read_by_others(spark, folder):
    """Every header's length leads to the next record."""
    warc.write_archives(spark.createDataFrame([(i, f"http://a/{i}", "y" * i) for i in range(30)], PAGES), folder, archives=2)
    from pathlib import Path

    n = 0
    for f in Path(folder.removeprefix("file://")).glob("*.gz"):
        data, types = gzip.open(f).read(), []
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            named = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            types.append(named[b"WARC-Type"])
            size = int(named[b"Content-Length"])
            assert data[size : size + 4] == b"\r\n\r\n"
            data = data[size + 4 :]
        assert types[0] == b"warcinfo" and types[1:4] == [b"request", b"response", b"metadata"]
        n += types.count(b"response")
    assert n == 30


def test_empty(spark, folder):
    warc.write_archives(spark.createDataFrame([], PAGES), folder)
    assert back(spark, folder) == []


def record(kind, rid, block=b"", *more):
    head = [b"WARC/1.0", b"warc-type: " + kind, b"WARC-Record-ID: <" + rid + b">", *more, b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """Links of either direction and over other records, members, digests, cut-off and broken records."""
    http, mime = b"HTTP/1.1 200 OK\r\n\r\nbody", b"Content-Type: application/http"
    to = lambda x: b"WARC-Concurrent-To: <" + x + b">"
    digest = b"WARC-Payload-Digest: sha1:" + __import__("base64").b32encode(hashlib.sha1(b"body").digest())
    records = [
        record(b"metadata", b"m2", b"far: yes\r\n", to(b"q1"), b"Content-Type: application/warc-fields"), record(b"response", b"r1", http, mime, digest), record(b"request", b"q1", b"GET", to(b"r1")),
        record(b"response", b"r2", http, to(b"q2"), mime, b"WARC-Payload-Digest: sha1:" + b"0" * 40), record(b"request", b"q2", b"GET"), record(b"metadata", b"m9", b"", to(b"gone")),
        record(b"revisit", b"v1", b"", b"WARC-Refers-To: <r1>", digest), record(b"revisit", b"v2", b"", b"WARC-Refers-To: <lost>"), record(b"request", b"q1", b"GET", to(b"r1")),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"WARC/1.0\r\nno length\r\n\r\n\r\n\r\n" + record(b"resource", b"s1", b"kept") + record(b"response", b"cut", http)[:-12]))
    rows = warc.read_records(spark, f"file://{tmp_path}").cache()
    assert rows.where("error IS NOT NULL").count() == 2
    assert {r["record_id"]: r["digest_ok"] for r in rows.where("digest_ok IS NOT NULL").collect()} == {"r1": True, "r2": False}
    got = {r["capture_id"]: r for r in warc.resolved(warc.transactions(rows)).collect()}
    assert set(got) == {"r1", "r2", "v1", "v2", "s1", "m9"}
    assert (got["r1"]["request"]["record_id"], [m["record_id"] for m in got["r1"]["metadata"]]) == ("q1", ["m2"])
    assert got["r2"]["request"]["record_id"] == "q2" and got["m9"]["capture"] is None
    assert got["v1"]["response"]["capture"]["record_id"] == "r1" and got["v2"]["response"] is None
    assert got["v1"]["capture"]["payload_digest"] == hashlib.sha1(b"body").hexdigest()
    assert warc.transactions(rows).select(warc.noted(F.col("metadata"), "far").alias("x")).where("x = 'yes'").count() == 1
