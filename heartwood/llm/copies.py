"""Near-duplicate documents by Order MinHash.

A text's five-word shingles are labelled by their occurrence (the second time a
shingle occurs it is another k-mer). Each of SKETCHES sketches takes the PICKS
k-mers with the least hashes and keeps them in the order of the text, so that
two texts share a sketch with a chance that follows their edit similarity. The
last PLAIN sketches leave later occurrences out, as verification does, so that a
text and one that repeats a line of it many times meet. Texts that share a sketch are a group; pairs from groups are verified by a banded
alignment of their distinct shingles: the longest run of them in the same order
in both, within a band of places, over the shingles of either, THRESHOLD or more.

Equal texts (by a hash of 128 bits of their words) are one node from the start,
so copies cost a row each and no pairs. In a group, every text is paired with the
group's hub, the text that meets most others over all sketches. After links are
joined to components, texts of groups that still hold several components are
paired again (see _cross), in rounds of TRIES: first with the few that share most
sketches, which joins most of them, then with all that are left. No pair is left
out but by a bound: counts of distinct shingles in buckets, of which two texts
can't share more than the lesser count in each. A text has a bucket for every
two to four of its shingles (BUCKETS at least), so that the bound tells as much
of long texts as of short ones. So in the end no two texts of different classes
that share a sketch have a similarity of THRESHOLD or more.

Defined cases: texts of under five words have no shingles and are copies of
equal word sequences only; texts without words, of equal texts only (null is the
empty text); repeated rows are copies; a null id takes part, and a class's id is
the least id that is not null; extra columns are left out of classes() and pass
through keep_one().
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens as tk
from .common import raw, settle, steps, strings
from .components import components

SKETCHES, PLAIN, PICKS, THRESHOLD = 16, 4, 2, 0.8
SMALL, BLOCK, BUCKETS, TRIES = 16, 1024, 256, (6, None)
#: Bytes of buckets in a block of a group, about; and of all in a group whose pairs are made by a join.
BLOCK_BYTES, SMALL_BYTES = 1 << 23, SMALL * 1024
#: Ids that a broadcast of candidates may hold.
BROADCAST_IDS = 250_000
_SEEDS = np.random.default_rng(77).integers(1, 2**63, SKETCHES, dtype=np.uint64)
_ODD = np.random.default_rng(78).integers(1, 2**62, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LAST = np.uint64(2**64 - 1)


def labelled(s: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Shingle hashes with their occurrence in the row mixed in."""
    if not len(s):
        return s
    key = tk.mix(s + doc.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    order = np.argsort(key, kind="stable")
    k = key[order]
    fresh = np.concatenate([[True], k[1:] != k[:-1]])
    if fresh.all():
        return s
    run = np.flatnonzero(fresh)
    nth = np.arange(len(k)) - np.repeat(run, np.diff(np.append(run, len(k))))
    out = s.copy()
    again = nth > 0
    out[order[again]] = tk.mix(s[order[again]] + nth[again].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return out


def text_keys(buf: np.ndarray, offsets: np.ndarray, w: tk.Words | None = None) -> list[bytes]:
    """Of each row, 128 bits of a hash of its words; of its bytes if it has no words."""
    w = w or tk.words(buf, offsets, tk.ALNUM)
    count = np.diff(w.first)
    pos = np.arange(len(w.hash)) - np.repeat(w.first[:-1], count)
    out = np.zeros((len(count), 2), np.uint64)
    for c in range(2):
        term = tk.mix(w.hash * np.uint64(2 * c + 1) + (pos.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407 + 2 * c))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
        out[:, c] = tk.mix(total[w.first[1:]] - total[w.first[:-1]] + count.astype(np.uint64))
    ids = [k.tobytes() for k in out]
    for i in np.flatnonzero(count == 0).tolist():
        ids[i] = hashlib.md5(buf[offsets[i] : offsets[i + 1]].tobytes()).digest()
    return ids


def sketch(buf: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Of each row: its key, its number of shingles, and its sketches (a row of zeros if it has no shingles)."""
    n = len(offsets) - 1
    w = tk.words(buf, offsets, tk.ALNUM)
    ids = text_keys(buf, offsets, w)
    s, at = tk.shingles(w.hash, w.doc)
    doc = w.doc[at]
    lab = labelled(s, doc)
    again = lab != s
    count = np.bincount(doc, minlength=n)
    out = np.zeros((n, SKETCHES), np.uint64)
    full = np.flatnonzero(count)
    if len(full):
        size = count[full]
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        for j in range(SKETCHES):
            h = (lab ^ _SEEDS[j]) * _ODD[j]
            h ^= h >> np.uint64(32)
            if j >= SKETCHES - PLAIN:
                h[again] = _LAST
            picks, places = [], []
            for _ in range(PICKS):
                least = np.minimum.reduceat(h, first)
                here = np.flatnonzero(h == np.repeat(least, size))
                place = here[np.searchsorted(here, first)]
                picks.append(np.where(least == _LAST, np.uint64(0), least))
                places.append(place)
                h[place] = _LAST
            order = np.argsort(np.stack(places), axis=0, kind="stable")
            kept = np.take_along_axis(np.stack(picks), order, axis=0)
            own = np.full(len(full), np.uint64(j + 1))
            for row in kept:
                own = tk.mix(own * np.uint64(0x9E3779B97F4A7C15) + row)
            out[full, j] = own
    return ids, count, out


def buckets(buf: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Of each row, how many of its distinct shingles fall in each of its buckets, 255 at most.

    A row has BUCKETS of them, or the power of two that leaves four shingles at most for each.
    """
    n = len(offsets) - 1
    w = tk.words(buf, offsets, tk.ALNUM)
    s, at = tk.shingles(w.hash, w.doc)
    doc = w.doc[at]
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])])[: len(s)]
    s, doc = s[new], doc[new]
    need = np.maximum(np.bincount(doc, minlength=n) / 4, BUCKETS)
    wide = np.int64(1) << np.ceil(np.log2(need)).astype(np.int64)
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum(wide)])
    spot = first[doc] + (tk.mix(s) & (wide[doc] - 1).astype(np.uint64)).astype(np.int64)
    flat = np.minimum(np.bincount(spot, minlength=first[-1]), 255).astype(np.uint8)
    return [flat[i:j].tobytes() for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def folded(a: np.ndarray, wide: int) -> np.ndarray:
    """Rows of buckets as they are with fewer of them."""
    return a if a.shape[-1] == wide else a.reshape(*a.shape[:-1], -1, wide).sum(axis=-2, dtype=np.uint16)


def may_align(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of buckets leave room for a similarity of THRESHOLD; a full bucket bounds nothing."""
    full = (a.max(axis=-1) == 255) | (b.max(axis=-1) == 255)
    wide = min(a.shape[-1], b.shape[-1])
    a, b = folded(a, wide), folded(b, wide)
    total = a.sum(axis=-1, dtype=np.int64) + b.sum(axis=-1, dtype=np.int64)
    both = np.minimum(a, b).sum(axis=-1, dtype=np.int64)
    return (both >= THRESHOLD / (1 + THRESHOLD) * total - 1e-9) | full


class Bounds:
    """Buckets of many texts, by their number, for bounds of one text against some others."""

    def __init__(self, fp: list[bytes]):
        self.wide = np.array([len(x) for x in fp])
        self.row = np.zeros(len(fp), np.int64)
        self.total, self.full = np.zeros(len(fp), np.int64), np.zeros(len(fp), bool)
        self.rows: dict[int, np.ndarray] = {}
        for wide in np.unique(self.wide).tolist():
            at = np.flatnonzero(self.wide == wide)
            self.rows[wide] = own = np.frombuffer(b"".join(fp[i] for i in at.tolist()), np.uint8).reshape(-1, wide)
            self.row[at] = np.arange(len(at))
            self.total[at], self.full[at] = own.sum(axis=1, dtype=np.int64), own.max(axis=1) == 255

    def fit(self, i: int, at: np.ndarray) -> np.ndarray:
        """Which of the texts `at` may align with text i."""
        if not self.full[i]:  # first by their numbers of shingles, so that few are compared that have other numbers of buckets
            near = np.minimum(self.total[at], self.total[i]) >= THRESHOLD * np.maximum(self.total[at], self.total[i]) - 1e-6
            at = at[near | self.full[at]]
        own = self.rows[int(self.wide[i])][self.row[i]][None]
        out = []
        for wide, rows in self.rows.items():
            mine = at[self.wide[at] == wide]
            if len(mine):
                out.append(mine[may_align(rows[self.row[mine]], own)])
        return np.sort(np.concatenate(out)) if out else at[:0]


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, tid (the text's key), n_shingles, sk (its sketches) and fp (its buckets)."""
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("tid", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("sk", T.ArrayType(T.LongType())), T.StructField("fp", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = strings(batch, 1)
            buf, offsets = raw(col)
            for i, j in steps(offsets):
                part = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                ids, count, sk = sketch(*part)
                fp = pa.array(buckets(*part), pa.binary())
                flat = pa.array(sk.view(np.int64).reshape(-1))
                has = np.where(count > 0, SKETCHES, 0)
                flat = flat.filter(pa.array(np.repeat(count > 0, SKETCHES)))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has)]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(ids, pa.binary()), pa.array(count, pa.int64()), lists, fp], names=schema.names)

    return docs.select(F.col(doc_id), F.col(text).alias("__text")).mapInArrow(run, schema)


def kmers(text: str) -> np.ndarray:
    """A text's distinct shingles, in the order of their first occurrences."""
    data = text.encode()
    w = tk.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), tk.ALNUM)
    s, _ = tk.shingles(w.hash, w.doc)
    return s[np.sort(np.unique(s, return_index=True)[1])]


def aligned(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """The similarity by the banded alignment of two sequences of distinct shingles; 0 if it can't reach the threshold."""
    if not len(a) or not len(b):
        return 0.0
    least = threshold / (1 + threshold) * (len(a) + len(b))
    if min(len(a), len(b)) < least - 1e-9:
        return 0.0
    order = np.argsort(b)
    at = np.searchsorted(b[order], a)
    at[at == len(b)] = 0
    place = order[at]
    hit = b[place] == a
    mine, theirs = np.flatnonzero(hit), place[hit]
    if len(mine) < least - 1e-9:
        return 0.0
    band = max(64, abs(len(a) - len(b)) + max(len(a), len(b)) // 5)
    theirs = theirs[np.abs(theirs - mine) <= band]
    if (np.diff(theirs) > 0).all():
        run = len(theirs)
    else:
        tails: list[int] = []
        for x in theirs.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        run = len(tails)
    sim = run / (len(a) + len(b) - run)
    return sim if sim >= threshold - 1e-12 else 0.0


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of text keys that align, with `similarity`.

    Texts come to pairs by two joins; a hub's pairs are spread over tasks by the join's own
    handling of skew, since the other side holds its text once.
    """
    own = texts.select("tid", "body")
    left = pairs.join(own.select(F.col("tid").alias("a"), F.col("body").alias("ta")), "a")
    full = left.join(own.select(F.col("tid").alias("b"), F.col("body").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[bytes, np.ndarray] = {}
        for batch in batches:
            keep, sims = [], []
            cols = [batch.column(k) for k in range(4)]
            for i in range(batch.num_rows):
                own = []
                for key, body in ((cols[0][i].as_py(), 2), (cols[1][i].as_py(), 3)):
                    if key not in last:
                        if len(last) >= 64:
                            last.pop(next(iter(last)))
                        last[key] = kmers(cols[body][i].as_py())
                    own.append(last[key])
                sim = aligned(*own)
                if sim:
                    keep.append(i)
                    sims.append(sim)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([cols[0].take(at), cols[1].take(at), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])

    return full.mapInArrow(run, "a binary, b binary, similarity double")


def _pairs(df: DataFrame) -> DataFrame:
    return df.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def links(docs: DataFrame, sk: DataFrame, text: str = "text") -> DataFrame:
    """Verified pairs (a, b, similarity) of text keys, for sketches of docs."""
    one = settle(sk.where("n_shingles > 0").groupBy("tid").agg(F.first("sk").alias("sk"), F.first("fp").alias("fp")))
    bands = one.select("tid", F.octet_length("fp").alias("wide"), F.posexplode("sk").alias("j", "key"))
    # groups, masses and hubs are written, so that joins with them can split a large group's rows
    many = settle(bands.groupBy("j", "key").agg(F.count("*").alias("size")).where("size > 1"))
    member = settle(bands.join(many, ["j", "key"]))
    mass = settle(member.groupBy("tid").agg(F.sum("size").alias("mass")))
    hub = settle(member.join(mass, "tid").groupBy("j", "key").agg(F.max(F.struct("mass", "tid")).alias("h")).select("j", "key", F.col("h.tid").alias("hub")))
    first = settle(_pairs(member.join(hub, ["j", "key"]).select(F.col("tid").alias("x"), F.col("hub").alias("y"))))
    texts = settle(_texts(docs, member.select("tid").distinct(), text))
    good = settle(verify(first, texts))
    tried = first
    for most in TRIES:
        more = settle(_pairs(_cross(member, one, components(good), most)).join(tried, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            good, tried = good.unionByName(settle(verify(more, texts))), tried.unionByName(more)
    return good


def _cross(member: DataFrame, one: DataFrame, label: DataFrame, most: int | None) -> DataFrame:
    """Pairs (x, y) of texts that share a group but not a component, and whose buckets may align.

    In groups of over SMALL texts or SMALL_BYTES of buckets, for each text outside
    of the largest component the `most` texts by the number of sketches shared, or
    all; such a group is dealt in pairs of blocks of about BLOCK texts and BLOCK_BYTES,
    so that all of its pairs meet but no task holds them all.
    """
    named = member.join(label.withColumnRenamed("node", "tid"), "tid", "left").withColumn("label", F.coalesce("label", "tid"))
    group = ["j", "key"]
    open_ = settle(named.groupBy(*group).agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("wide").alias("bytes")).where("lo <> hi").select(*group, "bytes"))
    left = settle(named.join(open_, group).join(one, "tid"))
    joined = (F.col("size") <= SMALL) & (F.col("bytes") <= SMALL_BYTES)
    few = left.where(joined).select(*group, "tid", "label", "fp")
    other = few.select(*group, F.col("tid").alias("y"), F.col("label").alias("ly"), F.col("fp").alias("fy"))
    met = few.join(other, group).where((F.col("tid") < F.col("y")) & (F.col("label") != F.col("ly"))).select(F.col("tid").alias("x"), "y", "fp", "fy")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in (2, 3))
            wide = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
            ok = np.zeros(len(a), bool)
            for m, n in np.unique(wide, axis=0).tolist():
                at = np.flatnonzero((wide == (m, n)).all(axis=1))
                x, y = (np.frombuffer(b"".join(c[i] for i in at.tolist()), np.uint8).reshape(len(at), -1) for c in (a, b))
                ok[at] = may_align(x, y)
            ok = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(ok) for k in (0, 1)], names=["x", "y"])

    by_all = met.mapInArrow(bound, "x binary, y binary")
    n = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    dealt = left.where(~joined).withColumn("block", F.pmod(F.xxhash64("tid"), n).cast("int"))
    dealt = dealt.withColumn("to", F.explode(F.sequence(F.lit(0), n - 1)))
    dealt = dealt.select("tid", "label", "sk", "fp", *group, "block", F.least("block", "to").alias("p"), F.greatest("block", "to").alias("q"))

    def best(pdf):
        import pandas as pd

        tid, lab, sk = pdf["tid"].to_numpy(), pd.factorize(pdf["label"])[0], np.stack(pdf["sk"].to_numpy())
        bounds = Bounds(pdf["fp"].tolist())
        block, apart = pdf["block"].to_numpy(), bool(pdf["p"].iloc[0] != pdf["q"].iloc[0])
        inside = lab == np.bincount(lab).argmax()
        own = int(pdf["j"].iloc[0])
        out = []
        for i in np.flatnonzero(~inside):
            # each pair once, in the first group that it shares
            ok = (lab != lab[i]) & (inside | (np.arange(len(lab)) > i))
            if apart:
                ok &= block != block[i]
            at = np.flatnonzero(ok)
            at = bounds.fit(i, at[~(sk[at, :own] == sk[i, :own]).any(axis=1)])
            same = (sk[at] == sk[i]).sum(axis=1)
            if most is not None and len(at) > most:
                at = at[np.argsort(-same, kind="stable")[:most]]
            out.append((np.full(len(at), i), at))
        x, y = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int))
        return pd.DataFrame({"x": tid[x], "y": tid[y]})

    by_best = dealt.groupBy(*group, "p", "q").applyInPandas(best, "x binary, y binary")
    return by_all.unionByName(by_best)


def _texts(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """(tid, body) for the wanted keys: one row of docs for each."""
    n = wanted.count()
    small = F.broadcast(wanted) if n <= BROADCAST_IDS else wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = strings(batch, 0)
            buf, offsets = raw(col)
            for i, j in steps(offsets):
                yield pa.RecordBatch.from_arrays([pa.array(text_keys(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), pa.binary()), col.slice(i, j - i)], names=["tid", "body"])

    return docs.select(F.col(text).alias("body")).mapInArrow(run, "tid binary, body string").join(small, "tid", "left_semi").groupBy("tid").agg(F.first("body").alias("body"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, class_id (the least id of its class) and class_size."""
    sk = settle(sketches(docs, doc_id, text))
    return sk.join(_nodes(docs, sk, text), "tid").select(F.col(doc_id).alias("doc_id"), "class_id", "class_size")


def _nodes(docs: DataFrame, sk: DataFrame, text: str) -> DataFrame:
    """tid, class_id, class_size of every text."""
    per = sk.groupBy("tid").agg(F.min(sk.columns[0]).alias("least"), F.count("*").alias("n"))
    label = components(links(docs, sk, text)).withColumnRenamed("node", "tid")
    named = per.join(label, "tid", "left").withColumn("label", F.coalesce("label", "tid"))
    total = named.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    return settle(named.join(total, "label").select("tid", "class_id", "class_size", "label"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class: that of the least id (nulls last); of rows of equal id, that of the least hash of the text; of equal rows, one."""
    mark = F.struct(F.col(doc_id).isNull().alias("u"), F.col(doc_id).alias("i"), F.xxhash64(text).alias("h"))
    tagged = docs.withColumn("__mark", mark)
    sk = settle(sketches(tagged, "__mark", text))
    chosen = settle(_nodes(docs, sk, text).select(F.col("class_id").alias("__mark")).distinct())
    again = settle(sk.groupBy(F.col("__mark")).count().where("count > 1").select("__mark"))
    within = lambda rows, marks, how: rows.join(F.broadcast(marks) if marks.count() <= BROADCAST_IDS else marks, "__mark", how)
    kept = within(tagged, chosen, "left_semi")
    twice = settle(again.join(chosen, "__mark", "left_semi"))
    if twice.isEmpty():
        return kept.drop("__mark")
    return within(kept, twice, "left_anti").unionByName(within(kept, twice, "left_semi").dropDuplicates(["__mark"])).drop("__mark")
