"""Quality scores from compressed sizes.

Two zstandard dictionaries are built, from texts labelled good and texts
labelled bad. A text is compressed in blocks under each; the difference of the
two compressed sizes, normalised by the text's length and by their sum, and the
size under the good dictionary by length, go through a logistic calibration
fitted on labelled rows that the dictionaries have not seen, weighted to the
classes' shares among all labels.

Fitting works on a bounded sample of the labelled rows (SAMPLE per class, of at
most SAMPLE_CHARS characters each); scoring takes every byte of every text.

Defined cases: null and empty texts get the score of an empty text (a finite
number from the calibration); null labels are not learned from; a class with no
sample gives the constant score of the classes' smoothed shares; repeated rows
are scored each on its own; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of, others, strings

SAMPLE, SAMPLE_CHARS = 1200, 20_000
DICT_BYTES, BLOCK, LEVEL = 112_640, 512, 3


class Model(NamedTuple):
    good: bytes
    bad: bytes
    weights: np.ndarray  # of the standardised features, the last of the constant
    mean: np.ndarray
    scale: np.ndarray
    prior: float  # the constant score where dictionaries could not be built


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the texts' own bytes where they are too few to train on."""
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(t[:BLOCK] for t in texts)[-DICT_BYTES:].ljust(8, b" ")


def compressor(data: bytes) -> zstandard.ZstdCompressor:
    own = zstandard.ZstdCompressionDict(data)  # trained or raw, by its first bytes
    own.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=own, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


def measure(texts: list[bytes], good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> np.ndarray:
    """A row of features for each text."""
    out = np.empty((len(texts), 3))
    for row, t in zip(out, texts, strict=True):
        a = b = 0
        for i in range(0, len(t) or 1, BLOCK):
            part = t[i : i + BLOCK]
            a += len(good.compress(part))
            b += len(bad.compress(part))
        n = len(t) + 1
        row[:] = (b - a) / n, (b - a) / (a + b), a / n
    return out


def learn(rows: list[tuple[str, int]], shares: tuple[float, float] = (0.5, 0.5)) -> Model:
    """Fit on (text, label) rows: every other row of a class feeds its dictionary, the rest the calibration."""
    sides = [[t.encode() for t, y in rows if y == k] for k in (0, 1)]
    prior = (shares[1] + 0.01) / (sum(shares) + 0.02)
    empty = np.zeros(0)
    if not sides[0] or not sides[1]:
        return Model(b"", b"", empty, empty, empty, prior)
    bad, good = (dictionary(s[::2]) for s in sides)
    held = [s[1::2] or s for s in sides]
    x = measure(held[0] + held[1], compressor(good), compressor(bad))
    y = np.repeat([0.0, 1.0], [len(h) for h in held])
    weight = np.repeat([shares[0] / len(held[0]), shares[1] / len(held[1])], [len(h) for h in held]) * len(y)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(4)
    for _ in range(50):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        ridge = 0.05 * np.array([1, 1, 1, 0])
        slope = z.T @ (weight * (y - p)) - ridge * w
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-6)
        move = np.linalg.solve(curve, slope)
        w += move * min(1, 5 / (np.abs(move).max() + 1e-9))
        if np.abs(move).max() < 1e-8:
            break
    return Model(good, bad, w, mean, scale, prior)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", folds: int = 3, held: int = 1, sample: int = SAMPLE, most_chars: int = SAMPLE_CHARS) -> Model:
    """Learn from labelled rows outside the held-out fold. The sample of each
    class are the ids with the smallest hashes; its rows come to the driver,
    bounded by 2 * sample rows of most_chars characters."""
    known = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).where((fold_of("i", folds) != held) & F.col("y").isin(0, 1) & F.col("i").isNotNull())
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rank = (F.xxhash64("i"), "i")
    picked = known.where("y = 0").orderBy(*rank).limit(sample).unionByName(known.where("y = 1").orderBy(*rank).limit(sample))
    ids = [(r["i"], r["y"]) for r in picked.collect()]
    frame = docs.sparkSession.createDataFrame(ids, picked.schema)
    rows = (
        docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
        .where(F.col("t").isNotNull() & (F.length("t") <= most_chars))
        .join(F.broadcast(frame), "i")  # 2 * sample rows of two numbers
        .orderBy(*rank, "y", F.xxhash64("t"))
        .limit(2 * sample)
        .collect()
    )
    return learn([(r["t"], r["y"]) for r in rows], (counts.get(0, 0), counts.get(1, 0)))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """docs' columns (those in keep, by default all) and the score, 0 to 1. One pass, no shuffle."""
    kept = others(docs.columns if keep is None else keep, [name])
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = (compressor(model.good), compressor(model.bad)) if len(model.weights) else None
        for batch in batches:
            if ready:
                texts = strings(batch, len(kept)).cast(pa.binary())
                x = np.concatenate([measure(texts.slice(i, 512).to_pylist(), *ready) for i in range(0, len(texts), 512)] or [np.zeros((0, 3))])
                z = (x - model.mean) / model.scale @ model.weights[:3] + model.weights[3]
                out = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            else:
                out = np.full(batch.num_rows, model.prior)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(out)], names=[*kept, name])

    return docs.select(*kept, F.col(text).alias("__text")).mapInArrow(run, schema)
