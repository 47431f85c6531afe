"""WARC archives: writing captures, reading records, and putting transactions together.

Writing: a page becomes a request, a response or revisit, and a metadata record,
tied by WARC-Concurrent-To. The text writer writes them, with the blank lines
that end a record as its line separator, so that Spark's commit protocol guards
the archives and any file system of Spark's serves. Of pages with equal payloads
of at least REVISIT bytes, the one of the largest id is the response and the
others are revisits without the payload. Which page that is, is settled over
small columns; payloads are shuffled once, by record, so that neither a payload
that many pages share nor a repeated row gathers in a task.

Reading: an archive is a gzip file, which one task streams. The text reader cuts
it between records; where a payload holds what looks like the start of a record,
Content-Length puts its parts together again, so no content can break records,
and no more than one record is held.

Assembly: request and metadata records find their capture along concurrent-to
links of either direction, over further records if need be, and each capture is
one nested row. A revisit finds its response by WARC-Refers-To.

Defined cases: a null payload is empty; a null id sorts before all others; rows
equal in id, address and payload are one response and, at REVISIT bytes or more,
revisits of it (smaller ones are all responses); a null address has no target
URI; control characters and spaces of an address are written as %20; an empty
table gives no captures; extra columns of pages are left out. A record that is
cut off or whose header can't be read is a row with `error`, which no
transaction holds; a file's later records stay readable after a bad header.
Records with one id are one record. Whole archives are one gzip member each.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle

#: Bytes from which equal payloads are written once.
REVISIT = 1000
END, START = "\r\n\r\n", "WARC/"
_CUT = (END + START).encode()
#: Record types that stand for a capture, and the profile of revisits.
HEADS = ("response", "revisit", "resource", "conversion")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _uuid(digest: Column) -> Column:
    """32 hexadecimal digits in the form of a UUID."""
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))


def _urn(uuid: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))


def _record(kind: str | Column, uuid: Column, date: str, mime: str, block: Column, length: Column, *more: Column) -> Column:
    """A record without its final blank lines, as bytes; fields of more that are null are left out."""
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    lines = [
        F.lit("WARC/1.1"), field("WARC-Type", F.lit(kind) if isinstance(kind, str) else kind), field("WARC-Record-ID", _urn(uuid)), F.lit(f"WARC-Date: {date}"),
        *more, F.lit(f"Content-Type: {mime}"), field("Content-Length", length.cast("string")),
    ]
    head = F.concat(F.concat_ws("\r\n", *lines), F.lit(END))
    return F.concat(F.encode(head, "UTF-8"), block)


def captures(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = REVISIT) -> DataFrame:
    """(rid, key, uri, body, digest, bytes, type, refers): a row per page, body null for revisits.

    rid is the record's UUID, made of the page's values; refers is that of the response.
    """
    uri = F.regexp_replace(F.col(url).cast("string"), r"[\x00-\x20\x7f]", "%20")
    own = pages.select(F.col(key).alias("key"), uri.alias("uri"), F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary")).alias("body"))
    own = own.withColumn("same", F.sha2("body", 256))
    own = own.withColumn("rid", F.md5(F.concat_ws("|", F.to_json(F.struct(F.col("key").cast("string").alias("k"), F.col("uri").alias("u"))), "same").cast("binary")))
    small = settle(own.groupBy("rid").agg(F.first("key").alias("key"), F.first("same").alias("same"), F.first(F.octet_length("body")).alias("bytes"), F.count("*").alias("copies")))
    of = small.where(F.col("bytes") >= least).groupBy("same").agg(F.max(F.struct("key", "rid")).alias("m"), F.sum("copies").alias("n"))
    best = settle(of.where("n > 1").select("same", F.col("m.rid").alias("refers")))
    plan = small.join(best, "same", "left").select("rid", "copies", "refers")
    # each page's payload goes to its record; repeated rows meet before that shuffle
    whole = own.groupBy("rid").agg(*(F.first(c).alias(c) for c in ("key", "uri", "body")))
    each = whole.join(plan, "rid").withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    revisit = F.col("refers").isNotNull() & ((F.col("refers") != F.col("rid")) | (F.col("k") > 0))
    rid = F.when(F.col("k") == 0, F.col("rid")).otherwise(F.md5(F.concat_ws("|", "rid", "k").cast("binary")))
    return each.select(
        rid.alias("rid"), "key", "uri", F.when(~revisit, F.col("body")).alias("body"), F.sha1("body").alias("digest"), F.octet_length("body").cast("bigint").alias("bytes"),
        F.when(revisit, "revisit").otherwise("response").alias("type"), F.when(revisit, F.col("refers")).alias("refers"),
    )


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = REVISIT, archives: int | None = None) -> None:
    """Write pages to gzip archives in the folder path. archives: their number, where shuffle partitions do not give it."""
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = captures(pages, key, url, payload, least)
    if archives is not None:
        rows = rows.repartition(archives, "rid")
    text = lambda *parts: F.encode(F.concat(*parts), "UTF-8")
    rid, uri, body = _uuid(F.col("rid")), F.concat(F.lit("WARC-Target-URI: "), "uri"), F.coalesce("body", F.lit("").cast("binary"))
    other = lambda name: _uuid(F.md5(F.concat(F.lit(name), "rid").cast("binary")))
    beside = F.concat(F.lit("WARC-Concurrent-To: "), _urn(rid))
    http = F.concat(F.encode(F.format_string(HTTP, "bytes"), "UTF-8"), body)
    asked = text(F.lit("GET "), F.coalesce("uri", F.lit("/")), F.lit(" HTTP/1.1\r\nAccept: */*\r\n\r\n"))
    about = text(F.coalesce(F.concat(F.lit("page-id: "), F.col("key").cast("string"), F.lit("\r\n")), F.lit("")))
    size = lambda c: F.octet_length(c)
    is_revisit = F.col("type") == "revisit"
    refers = F.concat(F.lit("WARC-Refers-To: "), _urn(_uuid(F.col("refers"))))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest")
    main = _record(F.col("type"), rid, date, "application/http;msgtype=response", http, size(http), uri, digest, F.when(is_revisit, refers), F.when(is_revisit, F.lit(f"WARC-Profile: {PROFILE}")))
    request = _record("request", other("request"), date, "application/http;msgtype=request", asked, size(asked), uri, beside)
    note = _record("metadata", other("metadata"), date, "application/warc-fields", about, size(about), uri, beside)
    info = text(F.lit("software: heartwood\r\nformat: WARC File Format 1.1\r\n"))
    head = _record("warcinfo", _uuid(F.md5(F.concat(F.lit("info"), "rid").cast("binary"))), date, "application/warc-fields", info, size(info))
    end = F.lit(END).cast("binary")
    first = F.monotonically_increasing_id() % (1 << 33) == 0  # of an archive's rows
    value = F.concat(F.when(first, F.concat(head, end)).otherwise(F.lit("").cast("binary")), request, end, main, end, note)
    rows.select(value.cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def _hex(digest: str | None) -> str | None:
    """A labelled SHA-1 as hexadecimal digits, from those or from base 32."""
    bare = (digest or "").rpartition(":")[2].strip()
    if len(bare) == 32:
        try:
            return base64.b32decode(bare.upper()).hex()
        except ValueError:
            return bare.lower()
    return bare.lower() or None


def _blocks(parts: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, bytes | None, bytes]]:
    """(file, header, block) of records from what lies between their separators; header None for what can't be read."""
    file: str | None = None
    held: list[bytes] = []  # of the record that is not yet whole
    have = need = 0
    header: bytes | None = None
    for at, part in parts:
        if at != file:
            if held:
                yield file, None, b"".join(held)
            file, held, header = at, [], None
            part = part.removeprefix(START.encode())
        while True:
            if header is None:
                if not held and not part.strip():
                    break
                cut = part.find(END.encode())
                length = _length(part[:cut]) if cut >= 0 else None
                if length is None:
                    yield file, None, part
                    break
                header, part = part[:cut], part[cut + 4 :]
                held, have, need = [part], len(part), length
            else:
                held += [_CUT, part]
                have += len(_CUT) + len(part)
            if have < need:
                break
            block = b"".join(held)
            yield file, header, block[:need]
            # the reader may miss a separator after blank lines: then another record follows
            part, held, header = block[need:], [], None
            if not part.startswith(_CUT):
                if part.strip():
                    yield file, None, part
                break
            part = part[len(_CUT) :]
    if held:
        yield file, None, b"".join(held)


def _length(header: bytes) -> int | None:
    for line in header.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    return None


_REF = "array<string>"
_FIELDS = [
    ("file", pa.string()), ("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("fields", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("error", pa.string()), ("payload", pa.binary()),
]
_SCHEMA = f"file string, record_id string, type string, uri string, date string, concurrent_to {_REF}, refers_to string, payload_bytes bigint, payload_digest string, digest_ok boolean, fields array<struct<name:string,value:string>>, error string, payload binary"
#: Bytes of payload after which a batch of records is passed on.
_BATCH = 4 << 20


def _parse(file: str, header: bytes | None, block: bytes, payload: bool) -> tuple:
    if header is None:
        return (file, None, None, None, None, [], None, len(block), None, None, [], "record cut off or header not read", None)
    named: dict[str, list[str]] = {}
    for line in header.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        named.setdefault(name.strip().lower(), []).append(value.strip())
    one = lambda name: named.get(name, [None])[0]
    bare = lambda v: v.strip("<>") if v else None
    kind, mime = one("warc-type"), one("content-type") or ""
    body = block
    if mime.startswith("application/http"):
        cut = block.find(b"\r\n\r\n")
        body = block[cut + 4 :] if cut >= 0 else b""
    said = _hex(one("warc-payload-digest"))
    own = said if kind == "revisit" else hashlib.sha1(body).hexdigest()
    fields = []
    if mime.startswith("application/warc-fields"):
        for line in body.decode("utf-8", "replace").split("\r\n"):
            name, colon, value = line.partition(":")
            if colon:
                fields.append({"name": name.strip().lower(), "value": value.strip()})
    ok = None if said is None or kind == "revisit" else said == own
    return (file, bare(one("warc-record-id")), kind, one("warc-target-uri"), one("warc-date"), [bare(v) for v in named.get("warc-concurrent-to", [])], bare(one("warc-refers-to")), len(body), own, ok, fields, None, body if payload else None)


def read_records(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row per record of the gzip archives in a folder; payload_digest is that of the content that was read
    (a revisit's that of its header), and digest_ok whether the header agrees. Payloads themselves only where asked for."""
    raw = spark.read.option("lineSep", END + START).option("pathGlobFilter", "*.gz").text(path)
    parts = raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((f, p) for b in batches for f, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        rows, size = [], 0
        schema = pa.schema(_FIELDS)
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for r in _blocks(pairs):
            rows.append(_parse(*r, payload))
            size += 200 + (len(r[2]) if payload else 0)
            if size >= _BATCH:
                yield out(rows)
                rows, size = [], 0
        if rows:
            yield out(rows)

    return parts.mapInArrow(run, _SCHEMA)


def transactions(records: DataFrame) -> DataFrame:
    """(capture_id, capture, request, metadata): a nested row per capture, capture null where no record of it is there.

    records are read twice and more, and should come from a written table. Of several requests of a capture the
    greatest counts; a record beside several captures goes to the least.
    """
    good = records.where("error IS NULL AND record_id IS NOT NULL AND type <> 'warcinfo'")
    is_head = F.col("type").isin(*HEADS)
    links = good.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
    heads, rest = good.where(is_head).select("record_id").distinct(), good.where(~is_head).select("record_id").distinct()
    near = heads.select(F.col("record_id").alias("b"), F.col("record_id").alias("capture_id"))
    both = links.union(links.select("b", "a"))
    placed = None
    while True:  # in most archives one step places all records
        found = both.join(near, "b").groupBy(F.col("a").alias("record_id")).agg(F.min("capture_id").alias("capture_id"))
        step = settle(found.join(rest, "record_id", "left_semi"))
        placed = step if placed is None else placed.unionByName(step)
        rest = settle(rest.join(step, "record_id", "left_anti"))
        if rest.isEmpty() or step.isEmpty():
            break
        near = step.select(F.col("record_id").alias("b"), "capture_id")
    whole = F.struct("record_id", *(c for c in records.columns if c not in ("record_id", "error")))
    pick = lambda cond, name: F.max(F.when(cond, whole)).alias(name)
    keyed = good.join(placed, "record_id", "left").withColumn("capture_id", F.coalesce("capture_id", "record_id"))
    kind = F.col("type")
    notes = F.array_distinct(F.sort_array(F.collect_list(F.when(~is_head & (kind != "request"), whole)))).alias("metadata")
    return keyed.groupBy("capture_id").agg(pick(is_head, "capture"), pick(kind == "request", "request"), notes)


def resolved(captures: DataFrame) -> DataFrame:
    """captures of transactions() with `response`: the record a revisit refers to, null for others and where it is not there.
    Both sides of the join are exchanged by one key, so that a response of many revisits is split."""
    whole = settle(captures)
    found = whole.where("capture.type = 'response'").select(F.col("capture_id").alias("__to"), F.struct("capture", "metadata").alias("response"))
    return whole.withColumn("__from", F.when(F.col("capture.type") == "revisit", F.col("capture.refers_to"))).join(found, F.col("__from") == F.col("__to"), "left").drop("__from", "__to")


def noted(metadata: Column, name: str) -> Column:
    """The first value of a field in metadata records."""
    fields = F.flatten(F.transform(metadata, lambda m: m["fields"]))
    return F.get(F.filter(fields, lambda f: f["name"] == name), F.lit(0))["value"]


def read_back(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of archives that write_archives() has written."""
    records = settle(read_records(spark, path).drop("payload"))
    caps = resolved(transactions(records).where("capture IS NOT NULL"))
    own, to = F.col("capture"), F.col("response")
    return caps.select(
        noted(F.col("metadata"), "page-id").cast(id_type).alias("page_id"),
        F.coalesce(to["capture"]["payload_bytes"], own["payload_bytes"]).alias("payload_bytes"),
        F.coalesce(to["capture"]["payload_digest"], own["payload_digest"]).alias("payload_digest"),
        own["type"].alias("record_type"),
        noted(to["metadata"], "page-id").cast(id_type).alias("refers_to"),
    )
