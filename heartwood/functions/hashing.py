"""Content identifiers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(text: Column) -> Column:
    """The identifier that git gives a file of this text: SHA-1 over "blob", the length in bytes, a zero byte and the bytes."""
    head = F.encode(F.concat(F.lit("blob "), F.octet_length(text).cast("string")), "UTF-8")
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), F.encode(text, "UTF-8")))


def fold(node_id: Column, children: Column) -> Column:
    """A folder's hash from its id and its children's "id:hash" strings, whatever their order."""
    return F.sha2(F.concat_ws("\0", node_id, F.array_join(F.array_sort(children), "\0")), 256)


def short_digest(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, 16)


def has_changed(text: Column, stored: Column) -> Column:
    """Whether a text's SHA-256 differs from the stored one; nothing stored counts as a change."""
    return ~F.sha2(text, 256).eqNullSafe(stored)
