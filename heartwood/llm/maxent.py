"""Language-model scores by a hashed maximum-entropy model.

Tokens are words (A-Z in lower case) and one end per text, known by 64-bit
hashes. Counts of all training tokens are taken over the whole table. The model
predicts SYMBOLS symbols: the most frequent words, the end, and one symbol for
every other word. A symbol's probability is that of its class (frequency-ranked,
CLASSES of them) times that within its class. Other words stand in a tree of
BRANCH branches a node by bits of their hashes, so deep that its leaves grow in
number with the training vocabulary, LEAF words in each at least; a word's
probability is that of each branch on the way times its smoothed count's share
of its leaf. Classes, symbols and branches are each a softmax over weights of
hashed features: the word before, the two before, and the word before last alone
(a skip). The tree's rows of weights, and the words that contexts tell apart,
grow with the square root of the vocabulary (rows_of).

Training is by rounds. In each, every partition takes mini-batches of its share
of the training texts from the same weights, with adaptive steps; the moves,
weighted by tokens, are summed by block in two levels and averaged. Every
training text is learned from once. The table of frequent words has a fixed size;
the counts of all other words meet the texts by a join.

Defined cases: null and empty texts are an end alone; repeated rows count and
score each; null ids fold as the empty text; extra columns are left out; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens as tk
from .common import fold_of, raw, settle, steps, strings

CLASSES, WITHIN = 32, 32
SYMBOLS = CLASSES * WITHIN
ROWS = 1 << 13
#: Frequent words whose counts every task holds: 16 bytes each.
HEAD = 1 << 18
#: Words beyond this rank, or that of rows_of() if greater, share 64 context buckets.
CONTEXT = 1 << 14
#: The tree of other words: branches of a node, and the least mean number of words of a leaf.
BRANCH, LEAF = 16, 256
ROUNDS, BATCH, RATE = 2, 1 << 12, 0.15
BLOCKS, SPREAD = 64, 64
END, START = np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)
_ROW, _SPREAD = np.uint64(ROWS - 1), np.uint64(0xD6E8FEB86659FD93)
_F = [np.uint64(x) for x in (0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)]


def token_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end included, and the offsets of texts in them."""
    w = tk.words(buf, offsets, tk.SPACED)
    n = len(offsets) - 1
    out = np.empty(len(w.hash) + n, np.uint64)
    first = w.first + np.arange(n + 1)
    out[np.arange(len(w.hash)) + w.doc] = w.hash
    out[first[1:] - 1] = END
    return out, first


class Lookup:
    """Places of hashes in a sorted table, by buckets of their leading bits; -1 where absent."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, min(20, int(len(keys)).bit_length()))
        self.first = np.searchsorted(keys >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        bucket = (h >> np.uint64(64 - self.bits)).astype(np.int32)
        place, stop = self.first[bucket], self.first[bucket + 1]
        out = np.full(len(h), -1, np.int32)
        left = np.flatnonzero(place < stop)
        place, stop, h = place[left], stop[left], h[left]
        while len(left):
            hit = self.keys[place] == h
            out[left[hit]] = place[hit]
            place = place + 1
            go = ~hit & (place < stop)
            left, place, stop, h = left[go], place[go], stop[go], h[go]
        return out


def depth_of(types: int) -> int:
    """Levels of the tree of other words for so many distinct words."""
    depth = 0
    while types >= LEAF * BRANCH ** (depth + 1):
        depth += 1
    return depth


def rows_of(types: int) -> int:
    """Rows of the tree's weights: the least power of two, 4096 or more, that is 8 times the root of the distinct words."""
    return max(1 << 12, 1 << (8 * math.isqrt(types)).bit_length())


class Vocabulary(NamedTuple):
    keys: np.ndarray  # sorted hashes of frequent words
    counts: np.ndarray
    symbol: np.ndarray  # of each, the symbol
    context: np.ndarray  # of each, the hash that stands for it in contexts
    rest: int  # the symbol of all other words
    bias: np.ndarray  # [CLASSES]
    inner: np.ndarray  # [CLASSES, WITHIN]
    total: int  # training tokens
    types: int  # distinct training tokens
    leaves: np.ndarray  # of each leaf, what smoothed counts of its words are divided by
    tree: list[np.ndarray]  # of each level, the logs of shares [prefix, BRANCH]


def vocabulary(keys: np.ndarray, counts: np.ndarray, total: int, types: int, leaf_counts: np.ndarray, leaf_types: np.ndarray) -> Vocabulary:
    """From the most frequent words, by falling counts, and totals over all; tokens and words of each leaf, symbols' own included."""
    own = np.flatnonzero(keys != END)[: SYMBOLS - 2]
    ends = int(counts[keys == END].sum())
    rest = total - int(counts[own].sum()) - ends
    weight = np.concatenate([counts[own], [ends, rest]]).astype(float) + 0.5
    order = np.argsort(-weight, kind="stable")
    symbol_of = np.empty(len(order), np.int32)
    symbol_of[order] = np.arange(len(order))
    share = np.full(SYMBOLS, 1e-9)
    share[: len(order)] = weight[order]
    share = (share / share.sum()).reshape(CLASSES, WITHIN)
    bias = np.log(share.sum(1))
    symbol = np.full(len(keys), symbol_of[-1], np.int32)
    symbol[own] = symbol_of[: len(own)]
    symbol[keys == END] = symbol_of[-2]
    context = np.where(np.arange(len(keys)) < max(CONTEXT, rows_of(types)), keys, keys & np.uint64(63))
    at = np.argsort(keys)
    leaves = leaf_counts + leaf_types + 1.0
    named = np.concatenate([own, np.flatnonzero(keys == END)])
    np.subtract.at(leaves, (keys[named] & np.uint64(len(leaves) - 1)).astype(np.int64), counts[named] + 1.0)
    tree, nodes = [], 1
    while nodes < len(leaves):
        branch = leaves.reshape(-1, nodes * BRANCH).sum(0).reshape(BRANCH, nodes).T
        tree.append(np.log(branch / branch.sum(1, keepdims=True)).astype(np.float32))
        nodes *= BRANCH
    inner = np.log(share / share.sum(1, keepdims=True)).astype(np.float32)
    return Vocabulary(keys[at], counts[at], symbol[at], context[at], int(symbol_of[-1]), bias.astype(np.float32), inner, total, types, leaves, tree)


class Weights(NamedTuple):
    outer: np.ndarray  # [ROWS, CLASSES]
    inner: np.ndarray  # [ROWS, WITHIN]
    tree: np.ndarray  # [rows_of(types), BRANCH]

    @staticmethod
    def zero(types: int) -> Weights:
        return Weights(np.zeros((ROWS, CLASSES), np.float32), np.zeros((ROWS, WITHIN), np.float32), np.zeros((rows_of(types), BRANCH), np.float32))


class Texts(NamedTuple):
    place: np.ndarray  # in the vocabulary's table, -1 for other words
    symbol: np.ndarray
    features: list[np.ndarray]  # three context hashes per token
    leaf: np.ndarray  # in the tree of other words
    hash: np.ndarray
    first: np.ndarray


def contexts(v: Vocabulary, find: Lookup, buf: np.ndarray, offsets: np.ndarray) -> Texts:
    h, first = token_hashes(buf, offsets)
    place = find(h)
    known = place >= 0
    safe = np.maximum(place, 0)
    if not len(v.keys):
        symbol, own = np.full(len(h), v.rest, np.int32), h & np.uint64(63)
    else:
        symbol = np.where(known, v.symbol[safe], v.rest)
        own = np.where(known, v.context[safe], h & np.uint64(63))
    one, two = np.empty_like(own), np.empty_like(own)
    one[1:], one[:1] = own[:-1], START
    one[first[:-1]] = START
    two[1:], two[:1] = one[:-1], START
    two[first[:-1]] = START
    return Texts(place, symbol, [tk.mix(one + _F[0]), tk.mix(one * _F[1] + two), tk.mix(two + _F[2])], (h & np.uint64(len(v.leaves) - 1)).astype(np.int64), h, first)


def _softmax(z: np.ndarray) -> np.ndarray:
    """Of rows of a power of two of logits, in place."""
    peak = z
    while (half := peak.shape[1] // 2):
        peak = np.maximum(peak[:, :half], peak[:, half:])
    z -= peak
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


def forward(w: Weights, v: Vocabulary, features: list[np.ndarray], symbol: np.ndarray) -> tuple:
    """Rows of weights and probabilities of classes and of symbols within the true class."""
    cls = symbol // WITHIN
    rows = [(f & _ROW).astype(np.uint16) for f in features]
    salt = cls.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    inner = [((((f + salt) * _SPREAD) >> np.uint64(40)) & _ROW).astype(np.uint16) for f in features]
    z = np.take(w.outer, rows[0], axis=0)
    z += v.bias
    y = np.take(v.inner, cls, axis=0)
    y += np.take(w.inner, inner[0], axis=0)
    for a, b in zip(rows[1:], inner[1:], strict=True):
        z += np.take(w.outer, a, axis=0)
        y += np.take(w.inner, b, axis=0)
    return rows, inner, _softmax(z), _softmax(y), cls


def descend(w: Weights, v: Vocabulary, features: list[np.ndarray], leaf: np.ndarray) -> tuple:
    """Rows of weights, probabilities of branches, and the branches taken to the leaves, level after level."""
    n, levels, last = len(leaf), len(v.tree), np.uint64(len(w.tree) - 1)
    rows = np.empty((len(features), levels, n), np.uint16 if len(w.tree) <= 1 << 16 else np.uint32)
    z, taken = np.empty((levels, n, BRANCH), np.float32), np.empty((levels, n), np.int64)
    for k, table in enumerate(v.tree):
        prefix = leaf & (BRANCH**k - 1)
        taken[k] = (leaf // BRANCH**k) & (BRANCH - 1)
        salt = (prefix + BRANCH**k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z[k] = np.take(table, prefix, axis=0)
        for i, f in enumerate(features):
            rows[i, k] = (((f + salt) * _SPREAD) >> np.uint64(40)) & last
            z[k] += np.take(w.tree, rows[i, k], axis=0)
    return list(rows.reshape(len(features), -1)), _softmax(z.reshape(-1, BRANCH)), taken.reshape(-1)


def _update(w: np.ndarray, seen: np.ndarray, rows: list[np.ndarray], err: np.ndarray, rate: float) -> None:
    """An adaptive step on the rows that a mini-batch touches, for the sums over its features."""
    every = np.concatenate(rows)
    order = np.argsort(every, kind="stable")
    k = every[order]
    cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    # pairs of numbers are added as one complex number each, which takes half the time
    g = np.add.reduceat(np.take(err, order, axis=0, mode="wrap").view(np.complex64), cut, axis=0).view(np.float32)
    at = k[cut]
    s = np.take(seen, at, axis=0)
    s += g * g
    seen[at] = s
    s += 1
    np.sqrt(s, out=s)
    g *= rate
    g /= s
    w[at] -= g


def learn(w: Weights, v: Vocabulary, batches: Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]], rate: float = RATE) -> tuple[Weights, int]:
    """Weights after mini-batches of (features, symbols, leaves), from w; and the tokens seen."""
    own = Weights(*(a.copy() for a in w))
    seen = Weights(*(np.zeros_like(a) for a in w))
    n = 0
    for features, symbol, leaf in batches:
        for a in range(0, len(symbol), BATCH):
            s, f = symbol[a : a + BATCH], [x[a : a + BATCH] for x in features]
            rows, inner, p, q, cls = forward(own, v, f, s)
            at = np.arange(len(s))
            p[at, cls] -= 1
            q[at, s % WITHIN] -= 1
            _update(own.outer, seen.outer, rows, p, rate)
            _update(own.inner, seen.inner, inner, q, rate)
            n += len(s)
            other = np.flatnonzero(s == v.rest)
            if v.tree and len(other):
                rows, p, taken = descend(own, v, [x[other] for x in f], leaf[a : a + BATCH][other])
                p[np.arange(len(p)), taken] -= 1
                _update(own.tree, seen.tree, rows, p, rate)
    return own, n


def log10_of(w: Weights, v: Vocabulary, features: list[np.ndarray], symbol: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """log10 of each token's symbol under the model; of other words, of the leaf's share of a smoothed count of 1."""
    out = np.empty(len(symbol))
    for a in range(0, len(symbol), BATCH):
        s, f = symbol[a : a + BATCH], [x[a : a + BATCH] for x in features]
        _, _, p, q, cls = forward(w, v, f, s)
        at = np.arange(len(s))
        log = np.log10(p[at, cls].astype(float) + 1e-30) + np.log10(q[at, s % WITHIN].astype(float) + 1e-30)
        other = np.flatnonzero(s == v.rest)
        if len(other):
            to = leaf[a : a + BATCH][other]
            log[other] -= np.log10(v.leaves[to])
            if v.tree:
                _, p, taken = descend(w, v, [x[other] for x in f], to)
                log[other] += np.log10(p[np.arange(len(p)), taken].astype(float) + 1e-30).reshape(len(v.tree), -1).sum(0)
        out[a : a + BATCH] = log
    return out


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, c): the count of every token of docs, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = raw(strings(batch, 0))
            parts = [np.unique(token_hashes(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0], return_counts=True) for i, j in steps(offsets, 8 << 20)]
            for h, c in parts:
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

    return docs.select(F.col(text).alias("__text")).mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def _average(spark, moves: DataFrame, w: Weights) -> Weights:
    """The weights moved by the token-weighted mean of the partitions' moves."""
    moves = moves.withColumn("spread", F.pmod("part", F.lit(SPREAD)))

    def add(key, pdf):
        import pandas as pd

        total = sum(np.frombuffer(b, np.float32) for b in pdf["move"])
        return pd.DataFrame([{"block": int(key[0]), "n": int(pdf["n"].sum()), "move": np.asarray(total, np.float32).tobytes()}])

    out = "block int, n bigint, move binary"
    some = moves.groupBy("block", "spread").applyInPandas(add, out)
    rows = some.groupBy("block").applyInPandas(add, out).collect()  # BLOCKS rows: the size of the weights
    flat = np.concatenate([a.reshape(-1) for a in w])
    size = len(flat) // BLOCKS
    for r in rows:
        flat[r["block"] * size : (r["block"] + 1) * size] += np.frombuffer(r["move"], np.float32) / max(r["n"], 1)
    ends = np.cumsum([a.size for a in w])[:-1]
    return Weights(*(x.reshape(a.shape) for x, a in zip(np.split(flat, ends), w, strict=True)))


def train(docs: DataFrame, v: Vocabulary, text: str = "text", rounds: int = ROUNDS) -> Weights:
    """Weights after one pass over docs in rounds."""
    spark = docs.sparkSession
    w = Weights.zero(v.types)
    for r in range(rounds):
        sent = spark.sparkContext.broadcast((w, v))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            w, v = sent.value
            find = Lookup(v.keys)

            def each() -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
                for batch in batches:
                    buf, offsets = raw(strings(batch, 0))
                    for i, j in steps(offsets):
                        t = contexts(v, find, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                        yield t.features, t.symbol, t.leaf

            own, n = learn(w, v, each())
            if not n:
                return
            flat = np.concatenate([(a - b).reshape(-1) for a, b in zip(own, w, strict=True)]) * np.float32(n)
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(BLOCKS), pa.int32()), pa.array([part] * BLOCKS, pa.int64()), pa.array([n] * BLOCKS, pa.int64()), pa.array([x.tobytes() for x in np.split(flat, BLOCKS)], pa.binary())],
                names=["block", "part", "n", "move"],
            )

        share = docs.where(F.pmod(F.xxhash64(text), F.lit(rounds)) == r) if rounds > 1 else docs
        w = _average(spark, share.select(F.col(text).alias("__text")).mapInArrow(run, "block int, part bigint, n bigint, move binary"), w)
        sent.unpersist()
    return w


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2, head: int = HEAD) -> DataFrame:
    """Counts, model and scores: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score and score, a row for each row of docs."""
    spark = docs.sparkSession
    out_fold = (fold_of(doc_id, folds) == held).alias("held_out")
    training = docs.where(fold_of(doc_id, folds) != held)
    known = settle(counts(training, text))
    total, types = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = known.orderBy(F.desc("c"), "h").limit(head).toArrow()  # head rows of two numbers
    keys = top.column("h").to_numpy().view(np.uint64) if top.num_rows else np.zeros(0, np.uint64)
    size = BRANCH ** depth_of(types)
    leaf_counts, leaf_types = np.zeros(size), np.zeros(size)
    for r in known.groupBy(F.col("h").bitwiseAND(size - 1).alias("leaf")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # a row for LEAF words or more
        leaf_counts[r["leaf"]], leaf_types[r["leaf"]] = r["c"], r["n"]
    v = vocabulary(keys, top.column("c").to_numpy() if top.num_rows else np.zeros(0, np.int64), int(total), int(types), leaf_counts, leaf_types)
    w = train(training, v, text)
    sent = spark.sparkContext.broadcast((w, v))
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("rid", T.LongType())]
        + [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_seen")]
        + [T.StructField(c, T.DoubleType()) for c in ("logs", "rest_logs", "model")]
        + [T.StructField("others", T.ArrayType(T.LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        w, v = sent.value
        find = Lookup(v.keys)
        rid = TaskContext.get().partitionId() << 40
        logs = np.log10(v.counts + 1.0)
        for batch in batches:
            buf, offsets = raw(strings(batch, 2))
            for i, j in steps(offsets):
                t = contexts(v, find, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = j - i
                at = t.first[:-1]
                seen = t.place >= 0
                lg = np.where(seen, logs[np.maximum(t.place, 0)] if len(logs) else 0.0, 0.0)
                rest = t.symbol == v.rest
                other = ~seen
                sums = [np.add.reduceat(x, at) for x in (seen.astype(np.int64), lg, np.where(rest, lg, 0.0), log10_of(w, v, t.features, t.symbol, t.leaf))]
                places = np.concatenate([[0], np.cumsum(np.add.reduceat(other.astype(np.int64), at))])
                lists = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(t.hash[other].view(np.int64)))
                cols = [batch.column(0).slice(i, n), batch.column(1).slice(i, n), pa.array(np.arange(rid, rid + n)), pa.array(np.diff(t.first)), *(pa.array(s) for s in sums), lists]
                rid += n
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    first = settle(docs.select(F.col(doc_id).alias("doc_id"), out_fold, F.col(text).alias("__text")).mapInArrow(run, schema))
    # words beyond the table: their counts join them, and come back summed by row
    far = first.select("rid", F.explode("others").alias("h")).join(known, "h").groupBy("rid").agg(F.count("*").alias("far_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("far_logs"))
    full = first.drop("others").join(far, "rid", "left").na.fill(0, ["far_known"]).na.fill(0.0, ["far_logs"])
    n = F.col("n_tokens")
    return full.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_seen") + F.col("far_known")).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("far_logs") - n * float(np.log10(total + types + 1))).alias("base_score"),
        (F.col("model") + F.col("rest_logs") + F.col("far_logs")).alias("score"),
    )
