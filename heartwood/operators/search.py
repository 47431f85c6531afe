"""Ranked full-text search."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.state import cut

# The ranking's constants, the weights of its columns and the least weight of a term.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
WEIGHTS = {"name": 10.0, "summary": 5.0, "content": 1.0}
SEPARATORS = "[^a-z0-9]+"


def terms(query: str) -> list[str]:
    """Distinct terms of a query, in order; all must occur."""
    return list(dict.fromkeys(t for t in re.split(SEPARATORS, query.lower()) if t))


def bm25(docs: DataFrame, query: str, key: str = "id", weights: dict[str, float] = WEIGHTS, only: Column | None = None) -> DataFrame:
    """(key, rank) of rows that hold every term, and meet a condition if one is given; a lower rank is better.

    Rows are left out before they are ranked; the corpus figures are those of all rows.

    One pass counts a row's tokens and its terms; corpus figures (rows, rows
    with each term, mean length) are one aggregation of those.
    """
    want = terms(query)
    if not want:
        return docs.select(key, F.lit(0.0).alias("rank")).limit(0)
    tokens = {c: F.array_remove(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), SEPARATORS), "") for c in weights}
    each = docs.select(key, F.coalesce(F.lit(True) if only is None else only, F.lit(False)).alias("__only"), *(t.alias(f"t_{c}") for c, t in tokens.items()))
    length = reduce(lambda a, b: a + b, (F.size(f"t_{c}") for c in weights))
    hits = lambda c, t: F.size(F.filter(F.col(f"t_{c}"), lambda x: x == t))
    freq = [reduce(lambda a, b: a + b, (hits(c, t) * w for c, w in weights.items())).alias(f"f{i}") for i, t in enumerate(want)]
    rows = each.select(key, "__only", length.alias("len"), *freq)
    figures = rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(want))))
    both = rows.where("__only").where(reduce(lambda a, b: a & b, (F.col(f"f{i}") > 0 for i in range(len(want))))).crossJoin(F.broadcast(figures))  # one row
    score = reduce(
        lambda a, b: a + b,
        (F.greatest(F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)), F.lit(LEAST_IDF)) * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + K1 * (1 - B + B * F.col("len") / F.col("mean"))) for i in range(len(want))),
    )
    return both.select(key, (-score).alias("rank"))


#: Rows whose words one vectorised step groups.
STEP_ROWS = 1000


def _held(words: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """(term, key, at) of rows (key, words), each row's words grouped where it is read; with weights, of rows (key, words, ...) with a list of words for each, (term, key, freq)."""
    key = words.schema.fields[0]
    value = T.StructField("at", T.ArrayType(T.IntegerType())) if weights is None else T.StructField("freq", T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, STEP_ROWS):
                batch = whole.slice(i, STEP_ROWS)
                lists = batch.columns[1:]
                sizes = [np.diff(c.offsets.to_numpy()) for c in lists]
                row = np.concatenate([np.repeat(np.arange(batch.num_rows), n) for n in sizes])
                coded = pa.concat_arrays([c.flatten() for c in lists]).dictionary_encode()
                code = coded.indices.to_numpy()
                group = row * max(len(coded.dictionary), 1) + code
                order = np.argsort(group, kind="stable")
                first = np.flatnonzero(np.diff(group[order], prepend=-1))
                if weights is None:
                    at = (np.arange(len(row)) - (np.cumsum(sizes[0]) - sizes[0])[row])[order]
                    each = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(at.astype(np.int32)))
                else:
                    each = pa.array(np.add.reduceat(np.repeat(np.array(weights, float), [n.sum() for n in sizes])[order], first) if len(first) else np.zeros(0))
                one = order[first]
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[one])), batch.column(0).take(pa.array(row[one])), each], names=["term", key.name, value.name])

    return words.mapInArrow(run, T.StructType([T.StructField("term", T.StringType()), key, value]))


def _words(column: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(column), F.lit(""))), SEPARATORS), "")


def _by_term(held: DataFrame, keys: DataFrame, value: Column, key: str) -> DataFrame:
    """A row for each term and key, every file sorted by them: a row's terms stay with the task that read it. Only where several rows have one key are they shuffled, and put together."""
    if not keys.groupBy(key).count().where("count > 1").isEmpty():
        held = held.repartitionByRange("term", key).groupBy("term", key).agg(value)
    return cut(held.sortWithinPartitions("term", key))


def index(docs: DataFrame, key: str = "id", weights: dict[str, float] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """(term, key, freq) and (key, len) of all rows, written once for any number of queries.

    Each file of the first is sorted by term, so that a query reads the pages of its terms.
    """
    each = docs.select(key, *(_words(c).alias(f"t_{c}") for c in weights))
    lengths = cut(each.select(key, reduce(lambda a, b: a + b, (F.size(f"t_{c}") for c in weights)).alias("len")))
    return _by_term(_held(each, list(weights.values())), docs.select(key), F.sum("freq").alias("freq"), key), lengths


def lookup(terms_of: DataFrame, lengths: DataFrame, query: str, key: str = "id") -> DataFrame:
    """bm25() from an index()."""
    want = terms(query)
    hits = terms_of.where(F.col("term").isin(want)) if want else terms_of.limit(0)
    figures = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    held = hits.groupBy("term").agg(F.count("*").alias("nt"))  # a row for each term of the query
    rows = hits.join(F.broadcast(held), "term").join(lengths, key).crossJoin(F.broadcast(figures))  # one row
    idf = F.greatest(F.log((F.col("n") - F.col("nt") + 0.5) / (F.col("nt") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("freq") * (K1 + 1) / (F.col("freq") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return rows.groupBy(key).agg((-F.sum(part)).alias("rank"), F.count("*").alias("__n")).where(F.col("__n") == len(want)).drop("__n")


def page(ranked: DataFrame, key: str = "id", limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of ranked rows with `total` and `has_more`."""
    total = ranked.agg(F.count("*").alias("total"))
    rows = ranked.orderBy("rank", key).offset(offset).limit(limit)
    return rows.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def postings(docs: DataFrame, column: str, key: str = "id") -> DataFrame:
    """(term, key, at): where each term of a column stands, written once in files sorted by term, so that a query reads its terms' pages."""
    held = _held(docs.select(key, _words(column).alias("words")))
    return _by_term(held, docs.select(key), F.sort_array(F.flatten(F.collect_list("at"))).alias("at"), key)


def with_term(index: DataFrame, term: str, key: str = "id") -> DataFrame:
    """(key, at) of rows with a term, whose places are in order; a last `*` makes it a prefix."""
    want = terms(term)
    if len(want) != 1:
        return index.select(key, "at").limit(0)
    if not term.rstrip().endswith("*"):
        return index.where(F.col("term") == want[0]).select(key, "at")
    upto = want[0][:-1] + chr(ord(want[0][-1]) + 1)  # a range of terms, which a scan's statistics can prune
    some = index.where((F.col("term") >= want[0]) & (F.col("term") < upto))
    return some.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("at"))


def _sides(index: DataFrame, text: str, key: str) -> list[DataFrame]:
    want = [t for t in re.split(SEPARATORS, text.lower()) if t]
    last = "*" if text.rstrip().endswith("*") else ""
    return [with_term(index, t + (last if i == len(want) - 1 else ""), key) for i, t in enumerate(want)]


def with_phrase(index: DataFrame, text: str, key: str = "id") -> DataFrame:
    """(key, at) of rows that hold a text's terms next to each other, in order; at is where phrases begin. A text without terms has none."""
    sides = _sides(index, text, key)
    if not sides:
        return index.select(key, "at").limit(0)
    out = sides[0]
    for i, side in enumerate(sides[1:], 1):
        shifted = side.select(key, F.transform("at", lambda x: x - F.lit(i)).alias("next"))  # noqa: B023
        out = out.join(shifted, key).select(key, F.array_intersect("at", "next").alias("at")).where(F.size("at") > 0)
    return out


def with_near(index: DataFrame, text: str, within: int = 10, key: str = "id") -> DataFrame:
    """(key, at) of rows that hold all terms of a text in some order with at most `within` others between first and last.

    at is where such runs begin: some term's place from which each of the others has one no more than within + terms - 1 on.
    """
    sides = _sides(index, text, key)
    if not sides:
        return index.select(key, "at").limit(0)
    out = sides[0].select(key, F.array("at").alias("all"))
    for side in sides[1:]:
        out = out.join(side, key).select(key, F.concat("all", F.array("at")).alias("all"))
    span = within + len(sides) - 1
    near = lambda start: F.forall("all", lambda places: F.exists(places, lambda x: (x >= start) & (x <= start + span)))
    starts = F.filter(F.array_distinct(F.array_sort(F.flatten("all"))), near)
    return out.select(key, starts.alias("at")).where(F.size("at") > 0)


def all_of(*found: DataFrame, key: str = "id") -> DataFrame:
    """Keys in every one of some results."""
    return reduce(lambda a, b: a.join(b.select(key), key, "left_semi"), (f.select(key) for f in found))


def any_of(*found: DataFrame, key: str = "id") -> DataFrame:
    """Keys in one of some results or more."""
    return reduce(lambda a, b: a.union(b), (f.select(key) for f in found)).distinct()


def without(found: DataFrame, other: DataFrame, key: str = "id") -> DataFrame:
    """Keys in one result and not in another."""
    return found.select(key).join(other.select(key), key, "left_anti")


def phrase(text: str, column: str) -> F.Column:
    """Whether a column holds a query's terms next to each other, in order; a last `*` makes the last term a prefix."""
    want = [t for t in re.split(SEPARATORS, text.lower()) if t]
    if not want:
        return F.lit(False)
    end = "" if text.rstrip().endswith("*") else "(?![a-z0-9])"
    return F.lower(F.col(column)).rlike("(?<![a-z0-9])" + SEPARATORS.join(map(re.escape, want)) + end)
