"""Collocations against a plain version."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from heartwood.llm import phrases

DOCS = "doc_id int, text string, lang string"


def plain(rows, least, most=2000, longest=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    good = {(lang, p): c for (lang, p), c in f.items() if len(p) > 1 and c >= least}
    inside = collections.Counter()
    for (lang, p), c in good.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i : i + k]] = max(inside[lang, p[i : i + k]], c)
    out = collections.defaultdict(list)
    for (lang, p), a in good.items():
        cuts = [(1000 * a * n[lang] // (f[lang, p[:j]] * f[lang, p[j:]]), j) for j in range(1, len(p))]
        score, j = min(cuts)
        if inside[lang, p] < a:
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:j]], f[lang, p[j:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, v in out.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:most], 1))


def got(df, **kw):
    return sorted(map(tuple, phrases.collocations(df, **kw).collect()))


@pytest.fixture(scope="module")
def rows():
    """Skewed words, several languages, nulls, repeated rows, breaks, and one long text."""
    rng = random.Random(5)
    words = ["the", "of", "The", "é", "a\x01", "a", "b-c", "x", "|", "zz"] + [f"w{i}" for i in range(40)]

    def text(n):
        return "".join(rng.choice(words[:4] if rng.random() < 0.4 else words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", " ", "\x0b"]) for _ in range(n))

    out = [(i, text(rng.randrange(60)), rng.choice(["en", "en", "en", "EN", None, "", "und"])) for i in range(120)]
    return [*out, *[(7, "of the sea and of the sky " * 3, "fr")] * 9, (1, text(9000), "en"), (2, None, "en"), (3, "", None), (4, " .,\n ", None), (None, "the of " * 40, "de")]


def test_against_plain(spark, rows):
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("key", "rank", "N", "score", "ids")}).repartition(5)
    expect = plain(rows, 8)
    assert len(expect) > 60 and {r[0] for r in expect} == {"en", "EN", "", "und", "fr", "de"}
    assert got(df, least=8) == expect
    assert got(df, least=8, block=16) == expect  # several blocks of the dictionary
    assert got(df, least=8, most=5) == plain(rows, 8, 5)
    assert got(df, least=20, longest=3) == plain(rows, 20, longest=3)


def test_runs_that_ranges_cut(spark, rows, monkeypatch):
    """Small runs of a task and many ranges: prefixes that lie in several ranges are added up."""
    monkeypatch.setattr(phrases, "STEP", 512)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    p = phrases.Phrases(phrases._texts(df, "text", "lang"), 8, 5, 1 << 20)
    whole = sorted(map(tuple, p.counted().collect()))
    monkeypatch.setattr(phrases, "RUN", 100)
    assert sorted(map(tuple, p.counted().collect())) == whole


def test_none(spark):
    assert got(spark.createDataFrame([], DOCS)) == []
    assert got(spark.createDataFrame([(1, None, None), (2, "one two", "en")], DOCS)) == []


def test_radix_order_and_runs():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 3, (500, 4)).astype(np.uint16) * np.uint16(21000)
    order = phrases.radix_order(keys)
    assert [tuple(r) for r in keys[order]] == sorted(tuple(r) for r in keys)
    own, n = phrases.count_runs(keys)
    plain = collections.Counter(map(tuple, keys.tolist()))
    assert {tuple(r): c for r, c in zip(own.tolist(), n.tolist(), strict=True)} == plain
    again, m = phrases.count_runs(np.concatenate([own, own]), np.concatenate([n, n]))
    assert (again == own).all() and (m == 2 * n).all()


def test_exact_beyond_64_bits(spark):
    """Scores of large counts, as the operator computes them."""
    a, n, left, right = 10**13 - 7, 10**14 + 3, 10**13 + 1, 10**13 + 9
    df = spark.createDataFrame([(a, n, left, right)], "f long, total long, l long, r long")
    assert df.select(F.expr(phrases.SCORE)).first()[0] == 1000 * a * n // (left * right)
