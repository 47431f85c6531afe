"""Phrase collocations: frequent n-grams of words, with the weakest cut's score.

Words that are frequent in their language get ids; elsewhere pieces break. At
each word the ids of the next few words are one key of fixed width, so that one
sort brings every shorter phrase's occurrences together as a run of prefixes.
Tasks sort keys by 16-bit digits, count runs and cut them at range bounds; each
range is sorted and counted again by one task, which passes on the prefixes that
are frequent, and those at its ends, whose runs may go on in the next range.

Bounds of the ranges come from a sample of texts and concern the balance of
tasks only; counts are over all texts. The dictionary goes to tasks in blocks of
at most BLOCK words, as hashes; with more than one block, texts are first
encoded in a pass for each. Words are told apart by hashes of 64 bits there
(their counts by the words themselves).

Defined cases: a null text is empty; a null language is `und`; texts without
words, and an empty table, give nothing; repeated rows count as often as they
occur; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens as tk
from .common import raw, settle, steps, strings

LONGEST = 5
LEAST, MOST = 100, 2000
#: A cut's score; products have up to 38 digits.
SCORE = "(CAST(f AS DECIMAL(19,0)) * CAST(1000 * total AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"
#: Words of a dictionary block, of which each takes 12 bytes in a task.
BLOCK = 1 << 20
#: Keys that a task sorts at once, and that a range is meant to hold.
RUN, RANGE = 1 << 21, 1 << 20
#: Most ranges and most sampled keys, which bound what goes through the driver.
RANGES, SAMPLE = 1 << 20, 1 << 21
#: Bytes of text of one step.
STEP = 1 << 21

#: Bytes at which pieces end, and bytes of words.
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False


def _salts(langs: pa.Array) -> np.ndarray:
    """A hash for each row's language."""
    coded = langs.dictionary_encode()
    own = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()], np.uint64)
    return own[np.asarray(coded.indices)] if len(own) else np.zeros(len(langs), np.uint64)


class Scan:
    """Words of some rows: `key`, a hash of word and language; `doc`; `piece`, equal for words of one piece."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, salts: np.ndarray):
        w = tk.words(buf, offsets, _WORD)
        self.words, self.doc = w, w.doc
        self.key = tk.mix(w.hash ^ salts[w.doc])
        self.piece = np.cumsum(_BREAK[buf])[w.start] if len(w.start) else w.start


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    buf, offsets = raw(strings(batch, "text"))
    for a, b in steps(offsets, STEP):
        yield buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], a, b


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))


def count_words(texts: DataFrame) -> DataFrame:
    """(lang, word, key, n): words of each language; a row of null word has the language's number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang")
            salts = _salts(langs)
            for buf, offsets, a, b in _steps(batch):
                s = Scan(buf, offsets, salts[a:b])
                if not len(s.key):
                    continue
                key, first, n = np.unique(s.key, return_index=True, return_counts=True)
                start, size = s.words.start[first], s.words.end[first] - s.words.start[first]
                to = np.concatenate([[0], np.cumsum(size)])
                at = np.repeat(start - to[:-1], size) + np.arange(to[-1])
                data = tk.LOWER[buf[at]]
                words = pa.Array.from_buffers(pa.string(), len(key), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(data)])
                own = langs.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([own.take(pa.array(s.doc[first])), words, pa.array(key.view(np.int64)), pa.array(n)], ["lang", "word", "key", "n"])
                total = np.bincount(s.doc, minlength=b - a)
                by = pa.table({"lang": own, "n": total}).group_by("lang").aggregate([("n", "sum")]).combine_chunks()
                none = pa.nulls(len(by), pa.string())
                yield pa.RecordBatch.from_arrays([by["lang"].combine_chunks(), none, pa.nulls(len(by), pa.int64()), by["n_sum"].combine_chunks().cast(pa.int64())], ["lang", "word", "key", "n"])

    rows = texts.mapInArrow(run, "lang string, word string, key bigint, n bigint")
    return rows.groupBy("lang", "word").agg(F.first("key").alias("key"), F.sum("n").alias("n"))


class Block:
    """Ids of a part of the dictionary's words, by sorted hashes."""

    def __init__(self, key: np.ndarray, ids: np.ndarray):
        order = np.argsort(key)
        self.key, self.ids = key[order], ids[order]

    def of(self, key: np.ndarray) -> np.ndarray:
        """Ids of words, 0 for those that are not here."""
        if not len(self.key):
            return np.zeros(len(key), np.int32)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.ids[at], 0).astype(np.int32)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of rows of unsigned 16-bit digits, most significant first: a stable sort by each digit from the last."""
    order = None
    for d in range(keys.shape[1] - 1, -1, -1):
        digit = keys[:, d]
        if len(digit) and digit.min() == digit.max():
            continue
        at = np.argsort(digit if order is None else digit[order], kind="stable")
        order = at if order is None else order[at]
    return np.arange(len(keys)) if order is None else order


def count_runs(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order and how often each occurs, or the sums of n."""
    order = radix_order(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(1)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(keys))) if n is None else np.add.reduceat(n[order], at) if len(at) else n
    return keys[at], count.astype(np.int64)


def _grams(ids: np.ndarray, doc: np.ndarray, piece: np.ndarray, longest: int) -> np.ndarray:
    """Rows of the ids of up to `longest` words from each word that a frequent word follows in its piece; 0 beyond the piece."""
    n = len(ids)
    link = np.zeros(n, bool)
    link[: n - 1] = (ids[:-1] > 0) & (ids[1:] > 0) & (doc[:-1] == doc[1:]) & (piece[:-1] == piece[1:])
    at = np.flatnonzero(link)
    out = np.zeros((len(at), longest), np.int32)
    out[:, 0] = ids[at]
    on = np.ones(len(at), bool)
    for j in range(1, longest):
        on &= link[np.minimum(at + j - 1, n - 1)]
        out[on, j] = ids[at[on] + j]
    return out


def _digits(ids: np.ndarray, wide: bool) -> np.ndarray:
    """Ids as rows of 16-bit digits, two for each id if wide."""
    if not wide:
        return ids.astype(np.uint16)
    return np.ascontiguousarray(ids, ">u4").view(">u2").astype(np.uint16)


def _packed(digits: np.ndarray) -> np.ndarray:
    """Digits as fixed-width binary keys, whose bytes sort as the digits do."""
    return np.ascontiguousarray(digits, ">u2").view(f"S{2 * digits.shape[1]}")[:, 0]


class Phrases:
    """The steps of collocations() over (lang, text) rows."""

    def __init__(self, texts: DataFrame, least: int, longest: int, block: int):
        self.texts, self.least, self.longest, self.most = texts, least, longest, block
        counts = settle(count_words(texts).where((F.col("n") >= least) | F.col("word").isNull()))
        self.totals = counts.where("word IS NULL").select("lang", F.col("n").alias("total"))
        words = counts.where("word IS NOT NULL")
        row = counts.agg(F.count("word").alias("words"), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0)).alias("tokens")).first()
        self.n_words, self.tokens = row["words"], row["tokens"]
        self.blocks = max(1, -(-self.n_words * 17 // (16 * block)))  # their sizes differ by chance, so that a sixteenth is left free
        part = F.pmod(F.col("key"), F.lit(self.blocks))
        rank = F.row_number().over(Window.partitionBy("part").orderBy("key", "lang", "word"))
        # a block's words, bounded in number, meet in one task
        self.words = settle(words.withColumn("part", part).withColumn("rank", rank).withColumn("id", (F.col("part") * F.lit(2 * block) + F.col("rank")).cast("int")).drop("rank"))
        self.wide = self.n_words >= 1 << 16 or self.blocks > 1
        self.width = 4 if self.wide else 2

    def id_key(self, id_: Column) -> Column:
        """The key of a phrase of one word."""
        head = F.unhex(F.lpad(F.hex(id_), 2 * self.width, "0"))
        return F.rpad(head, self.width * self.longest, F.lit(b"\0"))

    def _block(self, part: int):
        rows = self.words.where(F.col("part") == part).select("key", "id").toPandas()
        return self.texts.sparkSession.sparkContext.broadcast(Block(rows["key"].to_numpy(np.int64).view(np.uint64), rows["id"].to_numpy(np.int32)))

    def encoded(self) -> tuple[DataFrame, object]:
        """Texts whose `ids` hold those of all blocks but the last, and the last block."""
        rows = self.texts
        for part in range(self.blocks - 1):
            block, has = self._block(part), "ids" in rows.columns

            def run(batches: Iterator[pa.RecordBatch], block=block, has=has) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    salts, ids = _salts(batch.column("lang")), []
                    for buf, offsets, a, b in _steps(batch):
                        s = Scan(buf, offsets, salts[a:b])
                        own = block.value.of(s.key)
                        if has:
                            own = np.maximum(own, np.frombuffer(b"".join(batch.column("ids").slice(a, b - a).to_pylist()), np.int32))
                        ids += [own[x:y].tobytes() for x, y in zip(s.words.first[:-1], s.words.first[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("text"), pa.array(ids, pa.binary())], ["lang", "text", "ids"])

            rows = settle(rows.mapInArrow(run, "lang string, text string, ids binary"))
        return rows, self._block(self.blocks - 1)

    def counted(self) -> DataFrame:
        """(key, k, f): phrases of two words and more that occur often enough."""
        rows, block = self.encoded()
        longest, wide, least = self.longest, self.wide, self.least
        has = "ids" in rows.columns
        digits = longest * (2 if wide else 1)

        def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            for batch in batches:
                salts = _salts(batch.column("lang"))
                for buf, offsets, a, b in _steps(batch):
                    s = Scan(buf, offsets, salts[a:b])
                    ids = block.value.of(s.key)
                    if has:
                        ids = np.maximum(ids, np.frombuffer(b"".join(batch.column("ids").slice(a, b - a).to_pylist()), np.int32))
                    yield _digits(_grams(ids, s.doc, s.piece, longest), wide)

        n_ranges = min(RANGES, max(64, self.tokens // RANGE))
        want = min(SAMPLE, max(1 << 14, 32 * n_ranges))

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in grams(batches):
                yield pa.RecordBatch.from_arrays([pa.array(_packed(g[::8]).tolist(), pa.binary())], ["key"])

        share = min(1.0, 8.0 * want / max(1, self.tokens))
        drawn = rows.sample(share, seed=1).mapInArrow(some, "key binary").limit(2 * want).toPandas()["key"]
        drawn = np.sort(np.array([bytes(x).ljust(2 * digits, b"\0") for x in drawn], f"S{2 * digits}"))
        bounds = self.texts.sparkSession.sparkContext.broadcast(np.unique(drawn[np.linspace(0, len(drawn) - 1, n_ranges + 1).astype(int)[1:-1]]) if len(drawn) else drawn)

        def dealt(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            cuts = np.concatenate([[0], np.searchsorted(_packed(keys), bounds.value, side="right"), [len(keys)]])
            full = np.flatnonzero(np.diff(cuts))
            data, small = np.ascontiguousarray(keys, ">u2"), n.astype(np.uint32)
            blobs = [data[cuts[p] : cuts[p + 1]].T.tobytes() for p in full]  # digit by digit, whose runs compress
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary()), pa.array([small[cuts[p] : cuts[p + 1]].tobytes() for p in full], pa.binary())], ["part", "keys", "n"])

        def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for g in grams(batches):
                held.append(g)
                size += len(g)
                if size >= RUN:
                    yield dealt(*count_runs(np.concatenate(held)))
                    held, size = [], 0
            if size:
                yield dealt(*count_runs(np.concatenate(held)))

        def merge(table: pa.Table) -> pa.Table:
            blobs = [np.frombuffer(x.as_py(), ">u2").astype(np.uint16).reshape(digits, -1).T for x in table["keys"]]
            keys, n = count_runs(np.concatenate(blobs), np.frombuffer(b"".join(x.as_py() for x in table["n"]), np.uint32).astype(np.int64))
            out, sizes, sums = [], [], []
            new = np.zeros(len(keys), bool)
            new[:1] = True
            per = digits // longest
            for k in range(1, longest + 1):  # a prefix ends where one of its words changes
                for d in range((k - 1) * per, k * per):
                    new[1:] |= keys[1:, d] != keys[:-1, d]
                if k == 1:
                    continue
                at = np.flatnonzero(new)
                f = np.add.reduceat(n, at)
                own = keys[at, (k - 1) * per : k * per].any(1)
                end = np.zeros(len(at), bool)
                end[[0, -1]] = True
                good = own & ((f >= least) | end)
                full = keys[at[good]].copy()
                full[:, k * per :] = 0
                out.append(full)
                sizes.append(np.full(len(full), k, np.int32))
                sums.append(f[good])
            every = np.ascontiguousarray(np.concatenate(out), ">u2")
            data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * digits), len(every), [None, pa.py_buffer(every.tobytes())]).cast(pa.binary())
            return pa.table({"key": data, "k": np.concatenate(sizes), "f": np.concatenate(sums)})

        parts = rows.mapInArrow(sort, "part int, keys binary, n binary")
        runs = parts.groupBy("part").applyInArrow(merge, "key binary, k int, f bigint")
        return runs.groupBy("key").agg(F.first("k").alias("k"), F.sum("f").alias("f")).where(F.col("f") >= least)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, most: int = MOST, longest: int = LONGEST, block: int = BLOCK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `most` phrases of 2 to `longest` words.

    score is floor(1000 a n / (l r)) of the cut where it is lowest, in exact arithmetic; phrases inside
    a longer one of the same count are left out.
    """
    p = Phrases(_texts(docs, text, lang), least, longest, block)
    found, w = settle(p.counted()), p.width
    words = p.words.select(p.id_key(F.col("id")).alias("key"), "lang", "word", "n")
    every = found.select("key", "f").unionByName(words.select("key", F.col("n").alias("f")))
    sub = lambda at, size: F.rpad(F.substring("key", at * w + 1, size * w), w * longest, F.lit(b"\0"))
    k, j = F.col("k"), F.col("j")
    cuts = found.withColumn("j", F.explode(F.sequence(F.lit(1), k - 1))).select("key", "k", "f", "j", sub(F.lit(0), j).alias("left"), sub(j, k - j).alias("right"))
    count = lambda side, name: every.select(F.col("key").alias(side), F.col("f").alias(name))
    both = cuts.join(count("left", "l"), "left").join(count("right", "r"), "right")
    of = words.join(p.totals, "lang").select(F.col("key").alias("first"), "lang", "total")
    both = both.withColumn("first", sub(F.lit(0), F.lit(1))).join(of, "first")
    best = both.groupBy("key").agg(F.min(F.struct(F.expr(SCORE).alias("score"), "j", "l", "r")).alias("m"), *(F.first(c).alias(c) for c in ("k", "f", "lang", "total")))
    # what holds a phrase has a phrase of one word more between, of a count between theirs
    ends = F.explode(F.array(sub(F.lit(0), k - 1), sub(F.lit(1), k - 1))).alias("key")
    longer = found.where("k > 2").select(ends, F.col("f").alias("g")).groupBy("key").agg(F.max("g").alias("g"))
    kept = best.join(longer, "key", "left").where("g IS NULL OR 100 * g < 100 * f").select("key", "k", "lang", F.col("f").alias("a"), "m.l", "m.r", F.col("total").alias("n"), "m.score")
    # tasks keep their own first rows before the shuffle; ties at the end wait for the words
    top = settle(kept.withColumn("near", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("near") <= most).drop("near"))
    one = top.withColumn("i", F.explode(F.sequence(F.lit(0), k - 1))).select(F.col("key").alias("whole"), "i", sub(F.col("i"), F.lit(1)).alias("key"))
    said = one.join(words.select("key", "word"), "key").groupBy(F.col("whole").alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = top.join(said, "key").withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= most)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
