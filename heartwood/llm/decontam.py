"""Benchmark decontamination with SimHash fingerprints of item-sized windows.

Texts are words (runs of ASCII letters, digits and non-ASCII characters, A-Z in
lower case) and their five-word shingles, weighted by how often they occur. A
window of an item's number of words gets a fingerprint of 128 bits. Fingerprints
of items are indexed by RADIUS + 1 blocks of bits: two that differ in at most
RADIUS bits agree in one block at least, so the lookup finds all of them. Each
candidate is then verified by exact weighted-shingle similarity (the sum of the
smaller weights over the sum of the larger), THRESHOLD or more.

Windows that hold none of an item's shingles have similarity 0 to it, so only
windows around shared shingles are fingerprinted; nothing is lost by that.

Defined cases: items and texts of under five words have no shingles and never
match; null texts are empty; repeated items each match; repeated rows are
searched each on their own; extra columns pass through; without items nothing
matches. Items are collected in blocks of at most BLOCK_ITEMS, each a pass over
the texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens as tk
from .common import others, raw, steps, strings

BITS, RADIUS, THRESHOLD = 128, 36, 0.8
#: Items that one pass searches for: what a task holds is bounded by this, not by the number of items.
BLOCK_ITEMS = 20_000
_WIDTHS = [BITS // (RADIUS + 1) + (i < BITS % (RADIUS + 1)) for i in range(RADIUS + 1)]
_STARTS = np.cumsum([0, *_WIDTHS[:-1]])
_LOOKUP_BITS = 20


def _signs(h: np.ndarray) -> np.ndarray:
    """The vote of each shingle on each bit, +1 or -1."""
    both = np.stack([h, tk.mix(h + np.uint64(0x632BE59BD9B4E019))], 1)
    bits = np.unpackbits(both.view(np.uint8).reshape(len(h), 16), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprints(h: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Bits of the windows of size shingles that begin at the starts."""
    total = np.zeros((len(h) + 1, BITS), np.int32)
    np.cumsum(_signs(h), axis=0, out=total[1:])
    return total[starts + size] > total[starts]


def _blocks(bits: np.ndarray) -> np.ndarray:
    """The value of each block, by row."""
    return np.stack([bits[:, s : s + w] @ (1 << np.arange(w)) for s, w in zip(_STARTS, _WIDTHS, strict=True)], 1)


class Index:
    """Items by their number of words, with block tables, and by their shingles."""

    def __init__(self, texts: list[str], radius: int = RADIUS, threshold: float = THRESHOLD):
        self.threshold, self.radius = threshold, radius
        data = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in data], dtype=np.int64)])
        w = tk.words(np.frombuffer(b"".join(data), np.uint8), offsets, tk.ALNUM)
        self.weights: dict[int, Counter] = {}
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        keys, owners = [], []
        for i in range(len(texts)):
            h = w.hash[w.first[i] : w.first[i + 1]]
            s, _ = tk.shingles(h, np.zeros(len(h), np.int64))
            if len(s):
                self.weights[i] = Counter(s.tolist())
                by_size.setdefault(len(s), []).append((i, fingerprints(s, np.array([0]), len(s))[0]))
                keys.append(np.unique(s))
                owners.append(np.full(len(keys[-1]), len(s)))
        self.sizes = {}
        for size, items in by_size.items():
            ids, bits = np.array([i for i, _ in items]), np.stack([b for _, b in items])
            tables = []
            for b, width in enumerate(_WIDTHS):
                table = np.zeros((1 << width, len(ids)), bool)
                table[_blocks(bits)[:, b], np.arange(len(ids))] = True
                tables.append(table)
            self.sizes[size] = ids, np.packbits(bits, axis=1).view(np.uint64), tables
        self.keys, self.owners = (np.concatenate(x) if keys else np.zeros(0, d) for x, d in ((keys, np.uint64), (owners, np.int64)))
        order = np.lexsort((self.owners, self.keys))
        self.keys, self.owners = self.keys[order], self.owners[order]
        self.seen = np.zeros(1 << _LOOKUP_BITS, bool)
        self.seen[self.keys >> np.uint64(64 - _LOOKUP_BITS)] = True

    def search(self, buf: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(row, item, similarity, first byte, byte after the last) of the best window of each row and item that match."""
        if not len(self.keys):
            return []
        w = tk.words(buf, offsets, tk.ALNUM)
        s, at = tk.shingles(w.hash, w.doc)
        near = np.flatnonzero(self.seen[s >> np.uint64(64 - _LOOKUP_BITS)])
        lo, hi = np.searchsorted(self.keys, s[near], "left"), np.searchsorted(self.keys, s[near], "right")
        near, lo, hi = near[hi > lo], lo[hi > lo], hi[hi > lo]
        if not len(near):
            return []
        rows = w.doc[at[near]]
        # shingles of one row are neighbours in s; a window is a run of them
        wanted: dict[tuple[int, int], list[int]] = {}
        for p, row, a, b in zip(near.tolist(), rows.tolist(), lo.tolist(), hi.tolist(), strict=True):
            for size in dict.fromkeys(self.owners[a:b].tolist()):
                wanted.setdefault((row, size), []).append(p)
        found = []
        for (row, size), places in wanted.items():
            first, last = np.searchsorted(w.doc[at], [row, row + 1])
            length = min(size, last - first)  # a row shorter than the item is one window
            if length < self.threshold * size - 1e-9:  # its similarity is length / size at most
                continue
            p = np.array(places)
            a, b = np.maximum(p - length + 1, first), np.minimum(p, last - length)
            mark = np.zeros(last - first + 2, np.int32)
            ok = b >= a
            np.add.at(mark, a[ok] - first, 1)
            np.add.at(mark, b[ok] + 1 - first, -1)
            starts = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
            for i, sim, start in self._windows(s[first:last], starts, size, length):
                found.append((row, i, sim, int(w.start[at[first + start]]), int(w.end[at[first + start] + length + tk.SHINGLE - 2])))
        return found

    def _windows(self, s: np.ndarray, starts: np.ndarray, size: int, length: int) -> Iterator[tuple[int, float, int]]:
        if not len(starts):
            return
        ids, prints, tables = self.sizes[size]
        base = starts[0]
        part = s[base : starts[-1] + length]
        bits = fingerprints(part, starts - base, length)
        values = _blocks(bits)
        near = reduce(np.logical_or, (t[values[:, b]] for b, t in enumerate(tables)))
        own = np.packbits(bits, axis=1).view(np.uint64)
        win, item = np.nonzero(near)
        gap = np.bitwise_count(own[win] ^ prints[item]).sum(1)
        ok = gap <= self.radius
        win, item, gap = win[ok], item[ok], gap[ok]
        done = set()
        for k in np.lexsort((win, gap, item)).tolist():  # the closest fingerprint first; ties by place
            i = int(ids[item[k]])
            if i in done:
                continue
            start = int(starts[win[k]])
            sim = similarity(self.weights[i], Counter(s[start : start + length].tolist()))
            if sim >= self.threshold:
                done.add(i)
                yield i, sim, start


def similarity(a: Counter, b: Counter) -> float:
    """The smaller weights' sum over the larger weights' sum."""
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def _item_blocks(items: DataFrame, item_id: str, text: str, block: int) -> Iterator[pa.Table]:
    own = items.select(F.col(item_id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    n = max(1, -(-own.count() // block))
    if n == 1:
        yield own.orderBy("i", "t").toArrow()
        return
    for k in range(2 * n):  # twice as many parts as needed, by hash, so that each stays under the bound
        yield own.where(F.pmod(F.xxhash64("i", "t"), F.lit(2 * n)) == k).orderBy("i", "t").toArrow()


def _found(index: Index, texts: pa.Array) -> list[tuple[int, int, float, int, int]]:
    buf, offsets = raw(texts)
    out = []
    for i, j in steps(offsets):
        base = int(offsets[i])
        part = buf[offsets[i] : offsets[j]]
        for row, item, sim, a, b in index.search(part, offsets[i : j + 1] - offsets[i]):
            out.append((i + row, item, sim, base + a, base + b))
    return out


def find_leaks(docs: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", text: str = "text", keep: list[str] | None = None, block: int = BLOCK_ITEMS) -> DataFrame:
    """A row for each row of docs and item found in it: docs' columns (those in
    keep, by default all but text) and `item_id`, `similarity`, `leak_start` and
    `leak_end` (code points of the closest window). No shuffle."""
    new = ["item_id", "similarity", "leak_start", "leak_end"]
    kept = others(docs.columns if keep is None else keep, new, text)
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("item_id", items.schema[item_id].dataType), T.StructField("similarity", T.DoubleType()), T.StructField("leak_start", T.LongType()), T.StructField("leak_end", T.LongType())])

    def search(part: pa.Table):
        ids, texts = part.column("i").combine_chunks(), part.column("t").to_pylist()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(texts)
            for batch in batches:
                col = strings(batch, len(kept))
                buf, offsets = raw(col)
                hits = _found(index, col)
                rows = pa.array([h[0] for h in hits], pa.int64())
                place = lambda k: pa.array([len(buf[offsets[h[0]] : h[k]].tobytes().decode()) for h in hits], pa.int64())  # noqa: E731,B023
                made = [ids.take(pa.array([h[1] for h in hits], pa.int64())), pa.array([h[2] for h in hits], pa.float64()), place(3), place(4)]
                yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[: len(kept)]), *made], names=[*kept, *new])

        return docs.select(*kept, F.col(text).alias("__text")).mapInArrow(run, schema)

    return reduce(DataFrame.unionAll, (search(p) for p in _item_blocks(items, item_id, item_text, block)))


def decontaminate(docs: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", text: str = "text", block: int = BLOCK_ITEMS) -> DataFrame:
    """docs without the rows in which an item is found. No shuffle."""
    out = docs
    names = docs.columns
    for part in _item_blocks(items, item_id, item_text, block):
        texts = part.column("t").to_pylist()

        def run(batches: Iterator[pa.RecordBatch], texts=texts) -> Iterator[pa.RecordBatch]:
            index = Index(texts)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[h[0] for h in _found(index, strings(batch, names.index(text)))]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
