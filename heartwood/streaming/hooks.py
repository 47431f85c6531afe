"""Deliveries of events with their headers: read as a stream, verified, and taken apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import events as ev

#: A delivery as it was received: headers by name, in any case, and the body as it was signed.
DELIVERY = "headers map<string,string>, body string"
# fixed values: headers, and what stands for those that are missing
TYPE, ID, SIGNATURE, NONE = "x-github-event", "x-github-delivery", "x-hub-signature-256", "unknown"
_BLOCK = 64  # fixed value: bytes of a block of SHA-256


def deliveries(spark: SparkSession, folder: str, stream: bool = True) -> DataFrame:
    """Deliveries of JSON files in a folder, a line each; as a stream, files that come later follow, and its checkpoint holds which were read."""
    return (spark.readStream if stream else spark.read).schema(DELIVERY).json(folder)


def header(headers: Column, name: str) -> Column:
    """A header's value, whatever the case of its name; of several the greatest, null where there is none."""
    own = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.array_max(F.transform(own, lambda e: e["value"]))


def mac(body: Column, secret: str) -> Column:
    """The signature of a body under a secret, as a header holds it (HMAC of RFC 2104 over SHA-256)."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    pad = lambda b: F.unhex(F.lit(bytes(x ^ b for x in key).hex()))
    inner = F.sha2(F.concat(pad(0x36), F.encode(body, "UTF-8")), 256)
    return F.concat(F.lit("sha256="), F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256))


def verified(rows: DataFrame, secret: Column | str) -> DataFrame:
    """Deliveries that are signed with the secret; the others go, and all of them where it is empty or null."""
    key = F.lit(secret) if isinstance(secret, str) else secret
    return rows.where(F.coalesce(ev.signed(F.encode("body", "UTF-8"), header(F.col("headers"), SIGNATURE), key.cast("string")), F.lit(False)))


def parsed(rows: DataFrame) -> DataFrame:
    """(delivery_id, type, installation_id, repo, sender, signature, payload) of deliveries; those whose body is no JSON go."""
    at = lambda path: F.get_json_object("body", path)
    named = lambda n: F.coalesce(header(F.col("headers"), n), F.lit(NONE))
    return rows.where(F.try_parse_json("body").isNotNull()).select(
        named(ID).alias("delivery_id"), named(TYPE).alias("type"), F.expr("try_cast(get_json_object(body, '$.installation.id') AS bigint)").alias("installation_id"),
        at("$.repository.full_name").alias("repo"), at("$.sender.login").alias("sender"), header(F.col("headers"), SIGNATURE).alias("signature"), F.col("body").alias("payload"),
    )


def gated(rows: DataFrame, enabled: Column, branches: tuple[str, ...] = ev.BRANCHES, docs_branch: str = "docs") -> DataFrame:
    """Parsed deliveries with `sha`, `process` and `reason`, as events.gate() has them; enabled may use their columns."""
    at = lambda path: F.get_json_object("payload", path)
    g = ev.gate(F.col("type"), enabled, at("$.ref"), at("$.action"), at("$.pull_request.base.ref"), F.array(*map(F.lit, branches)), F.lit(docs_branch))
    return rows.withColumns({"sha": ev.commit_sha(F.col("type"), F.col("payload")), "__g": g}).select("*", "__g.process", "__g.reason").drop("__g")
