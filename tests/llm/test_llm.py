"""The training-text operators against plain versions, and on odd tables."""

import collections
import hashlib
import math
import re
import time
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heartwood.llm import chat, copies, decontam, maxent, passages, pieces, quality, queries, render, rules, secretscan
from heartwood.llm import tokens as tk
from heartwood.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
PROSE = "the quick brown fox jumps over the lazy dog while seven wise men sat by the old river and told long tales of lost ships and of the sea that took them in the year of the great storm before the war came to the town of their fathers and all who lived there had to leave for ever with what they could carry on their backs"
ODD = [
    (1, None, "en", "a"), (2, "", None, None), (3, "  \n\t ", "en", "a"), (4, "one", "en", "a"), (None, PROSE, "en", "a"), (None, None, None, "a"),
    (7, PROSE, "en", "a"), (7, PROSE, "en", "a"), (8, PROSE + " amen", "de", "b"), (9, LONG, "en", "a"), (10, LONG + " end", "en", "a"), (11, "é" * 5000, "fr", "b"), (12, "!!! ### </s> \\ <|end|>", "en", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use."""
    df = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string")
    for c in ("score", "SPANS", "kept", "similarity", "Decoded", "page_text", "n_words", "class_id"):
        df = df.withColumn(c, F.lit(5))
    return df


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def test_scan_of_words():
    texts = ["Ab c", "", "  x\ty ", "é A_b", "z"]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    w = tk.words(np.frombuffer(b"".join(data), np.uint8), offsets, tk.SPACED)
    plain = [[x.lower() if x.isascii() else x for x in WORD.findall(t)] for t in texts]
    assert [w.hash[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:])] == [[tk.word_hash(x) for x in p] for p in plain]
    assert tk.word_hash("Token") == tk.word_hash("tOKEN") != tk.word_hash("tokem")


# --- decontamination


def test_leaks(spark, sf, docs):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]): r for r in queries.op1_decontaminate(spark, sf).collect()}
    expect = {}
    owners = collections.defaultdict(set)
    for d, t in docs.items():
        for s in shingles(t):
            owners[s].add(d)
    for i, t in items.items():
        own = collections.Counter(shingles(t))
        n = sum(own.values())
        for d in {d for s in own for d in owners[s]}:
            s = shingles(docs[d])
            best = max((decontam.similarity(own, collections.Counter(s[k : k + n])) for k in range(max(1, len(s) - n + 1))), default=0)
            if best >= 0.8:
                expect[d, i] = best
    assert set(got) == set(expect)
    for (d, i), r in got.items():
        assert words(docs[d][r["leak_start"] : r["leak_end"]])[:3] == words(items[i])[:3] or r["similarity"] < 1


def test_leaks_by_blocks_and_edits(spark):
    base = PROSE.split()
    edited = " ".join(base[:30] + ["other"] + base[31:])
    df = spark.createDataFrame([(1, "x y " + edited + " z"), (2, "nothing here"), (3, PROSE.upper())], "doc_id int, text string")
    items = spark.createDataFrame([(i, t) for i, t in enumerate([PROSE, None, "two words", "another item of some more words in a row", PROSE])], "item_id int, text string")
    for block in (1, 100):
        got = decontam.find_leaks(df, items, keep=["doc_id"], block=block)
        assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(1, 0), (1, 4), (3, 0), (3, 4)}
        assert [r["doc_id"] for r in decontam.decontaminate(df, items, block=block).collect()] == [2]
    assert decontam.find_leaks(df, items.limit(0)).count() == 0


def test_texts_shorter_than_an_item(spark):
    base = PROSE.split()[:37]
    texts = [" ".join(base[:-2]), " ".join(base[1:-1]), " ".join(base[: len(base) // 2]), " ".join(base[:4])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    items = spark.createDataFrame([(0, " ".join(base))], "item_id int, text string")
    got = {r["doc_id"]: r for r in decontam.find_leaks(df, items, keep=["doc_id"]).collect()}
    assert set(got) == {0, 1}
    assert all(math.isclose(r["similarity"], 31 / 33) and texts[d][r["leak_start"] : r["leak_end"]] == texts[d].rstrip(".") for d, r in got.items())


def test_blocks_find_all_in_the_radius():
    rng = np.random.default_rng(3)
    a = rng.random((50, decontam.BITS)) < 0.5
    b = a.copy()
    for row in b:
        row[rng.choice(decontam.BITS, decontam.RADIUS, replace=False)] ^= True
    assert (decontam._blocks(a) == decontam._blocks(b)).any(1).all()


# --- language model


def test_language_model(spark, sf, docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = {d: [*WORD.findall((t or "").translate(lower)), None] for d, t in docs.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in toks}
    c = collections.Counter(x for d, v in toks.items() if not held[d] for x in v)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in queries.op2_maxent(spark, sf).collect()}
    assert set(got) == set(toks)
    for d, t in toks.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(t), sum(c[x] > 0 for x in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), rel_tol=1e-9)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_words_beyond_the_table(spark, sf):
    """Counts that come by the join equal those that tasks hold."""
    d = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    one, two = ({(r["doc_id"]): (r["n_known"], round(r["base_score"], 6)) for r in maxent.score(d, head=h).collect()} for h in (maxent.HEAD, 300))
    assert one == two


def test_probabilities_sum_to_one():
    """Over all symbols; and, in place of the symbol of other words, over all of the tree's leaves and what is in each."""
    rng = np.random.default_rng(2)
    types = maxent.LEAF * maxent.BRANCH**2
    size = maxent.BRANCH ** maxent.depth_of(types)
    assert size == 256 and maxent.depth_of(types - 1) == 1 and maxent.depth_of(0) == 0
    leaves = rng.integers(900, 9000, size) + np.bincount(np.arange(1, 900) & (size - 1), np.arange(900, 1, -1), size)
    v = maxent.vocabulary(np.arange(1, 900, dtype=np.uint64), np.arange(900, 1, -1), int(leaves.sum()), types, leaves, np.full(size, 256))
    zero = maxent.Weights.zero(types)
    w = maxent.Weights(*(rng.normal(0, 1, a.shape).astype(np.float32) for a in zero))
    every = np.concatenate([np.delete(np.arange(maxent.SYMBOLS, dtype=np.int32), v.rest), np.full(size, v.rest, np.int32)])
    leaf = np.concatenate([np.zeros(maxent.SYMBOLS - 1, np.int64), np.arange(size)])
    features = [np.full(len(every), x, np.uint64) for x in (11, 22, 33)]
    mass = np.where(every == v.rest, v.leaves[leaf], 1.0)
    assert math.isclose((mass * 10 ** maxent.log10_of(w, v, features, every, leaf)).sum(), 1, rel_tol=1e-4)
    plain = 10 ** maxent.log10_of(zero, v, features, every, leaf)[-size:]
    assert np.allclose(plain, plain[0], rtol=1e-4)  # without weights, a word's share of all other words
    assert math.isclose(v.leaves.sum(), leaves.sum() + 256 * size + size - (np.arange(900, 1, -1) + 1).sum())


# --- passages


def test_compact_windows():
    rng = np.random.default_rng(0)
    for trial in range(40):
        n = int(rng.integers(1, 200))
        s = rng.integers(1, 2**63, n, dtype=np.uint64) if trial % 3 else rng.integers(1, 20, n).astype(np.uint64)
        doc = np.sort(rng.integers(0, 4, n))
        least = int(rng.integers(2, 40))
        size = n + 1 + int((doc[1:] != doc[:-1]).sum()) + 1
        v = passages.ranks(s, passages._ODD[0], size)[0].tolist()
        expect = set()
        for c in range(n):
            lo = hi = c
            while lo and doc[lo - 1] == doc[c] and v[lo - 1] >= v[c]:
                lo -= 1
            while hi + 1 < n and doc[hi + 1] == doc[c] and v[hi + 1] >= v[c]:
                hi += 1
            if hi - lo + 1 >= least:  # equal least tokens of one subtree are one node, at the first
                expect.add((lo, v.index(v[c], lo), hi))
        assert set(zip(*(x.tolist() for x in passages.compact_windows(s, doc, passages._ODD[0], least)))) == expect


def test_passages(spark, sf, docs):
    seen = collections.defaultdict(set)
    w = {d: words(t) for d, t in docs.items()}
    for d, x in w.items():
        for i in range(len(x) - 49):
            seen[tuple(x[i : i + 50])].add(d)
    cover = collections.defaultdict(set)
    for d, x in w.items():
        for i in range(len(x) - 49):
            if len(seen[tuple(x[i : i + 50])]) > 1:
                cover[d].update(range(i, i + 50))
    mine = collections.defaultdict(set)
    for r in queries.op3_passages(spark, sf).collect():
        mine[r["doc_id"]].update(range(r["word_start"], r["word_end"]))
    assert not {d for d, c in cover.items() if c - mine[d]}


def test_planted_passages(spark):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    shared, near = text(60), text(80).split()
    changed = near.copy()
    changed[40] = "other"
    rows = [(i, f"{text(40)} {shared} {text(30)}") for i in range(5)] + [(10, f"{text(20)} {' '.join(near)} {text(9)}"), (11, f"{text(70)} {' '.join(changed)}"), (12, text(300)), (13, None), (14, shared), (15, shared)]
    got = passages.find_passages(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    by = {r["doc_id"]: r for r in got}
    assert set(by) == {0, 1, 2, 3, 4, 10, 11, 14, 15}
    assert (by[0]["word_start"], by[0]["word_end"], by[0]["class_id"], by[0]["class_docs"]) == (40, 100, 0, 7)
    assert by[11]["class_id"] == 10 and by[11]["word_end"] == 150


def test_passages_count_rows_once(spark):
    """A text that holds a passage twice counts once, and each of two equal rows counts."""
    said = " ".join(f"v{i}" for i in range(60))
    pad = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    rows = [(1, f"{pad('a', 30)} {said} {pad('b', 30)} {said} {pad('c', 9)}"), (2, f"{pad('d', 20)} {said} {pad('e', 12)}"), (3, f"{pad('f', 20)} {said} {pad('g', 12)}"), (3, f"{pad('f', 20)} {said} {pad('g', 12)}")]
    got = passages.find_passages(spark.createDataFrame(rows, "doc_id int, text string")).where("word_end - word_start <= 70").collect()
    assert got and {(r["class_id"], r["class_docs"]) for r in got if r["doc_id"] in (1, 2)} == {(1, 4)}


def test_passages_beside_a_common_core(spark):
    """Pairs of 60 words whose middle also stands in other texts, which are the representatives of most of its groups."""
    rng = np.random.default_rng(17)
    fresh = lambda n: [f"x{rng.integers(1 << 40)}" for _ in range(n)]
    rows = []
    for p in range(40):
        whole = fresh(60)
        core = whole[7:52]
        for side in range(2):
            rows.append((1000 * p + side, " ".join(fresh(40) + whole + fresh(40))))
        for other in range(20):
            rows.append((1000 * p + 10 + other, " ".join(fresh(40) + core + fresh(40))))
    got = passages.find_passages(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    lost = [p for p in range(40) if not any(r["word_start"] <= 40 and r["word_end"] >= 100 for r in by[1000 * p]) or not any(r["class_id"] == 1000 * p for r in by[1000 * p + 1])]
    assert not lost, lost


def test_passages_of_repeated_lines(spark):
    """Every word of a passage of 50 words that two texts hold is found, also where both repeat its lines elsewhere."""
    rng = np.random.default_rng(23)
    rows = []
    for p in range(12):
        lines = [[f"p{p}l{k}w{j}" for j in range(int(n))] for k, n in enumerate(rng.integers(5, 60, 6))]
        for side in range(2):
            parts = [lines[i] if rng.random() < 0.8 else [f"x{rng.integers(1 << 40)}" for _ in range(9)] for i in rng.integers(0, 6, 25)]
            rows.append((2 * p + side, " ".join(w for x in parts for w in x)))
    held = collections.defaultdict(set)
    w = {d: t.split() for d, t in rows}
    for d, x in w.items():
        for i in range(len(x) - 49):
            held[tuple(x[i : i + 50])].add(d)
    mine = collections.defaultdict(set)
    for r in passages.find_passages(spark.createDataFrame(rows, "doc_id int, text string")).collect():
        mine[r["doc_id"]].update(range(r["word_start"], r["word_end"]))
    lost = {(d, k) for d, x in w.items() for i in range(len(x) - 49) if len(held[tuple(x[i : i + 50])]) > 1 for k in range(i, i + 50) if k not in mine[d]}
    assert not lost, len(lost)


def test_passages_around_a_shingle_from_elsewhere():
    """One match far away does not part a passage; nor do many repeats keep one from being found."""
    s = np.random.default_rng(29).integers(1, 2**62, 400, dtype=np.uint64)
    a, b = s[:60].copy(), np.concatenate([s[:60], s[100:200]])
    a[30] = b[120]
    assert [f[:4] for f in passages.common_passages(passages.Prepared(a), passages.Prepared(b))] == [(0, 60, 0, 60)]
    a, b = np.tile(s[:30], 200), np.tile(s[:30], 150)
    found = passages.common_passages(passages.Prepared(a), passages.Prepared(b))
    assert len(found) < 10 and {k for f in found for k in range(f[0], f[1])} == set(range(len(a))) and {k for f in found for k in range(f[2], f[3])} == set(range(len(b)))


def test_passages_whole_beside_many_repeats():
    """A passage is found whole where over a thousand runs of a line's repeats lie beside it, and in blocks as at once."""
    s = np.random.default_rng(31).integers(1, 2**62, 400, dtype=np.uint64)
    line = np.tile(s[:10], 600)
    a = np.concatenate([line, s[20:70], s[80:85], s[90:102], s[110:160]])
    b = np.concatenate([s[200:260], s[20:70], s[300:305], s[90:102], s[310:360], line])
    found = passages.common_passages(passages.Prepared(a), passages.Prepared(b))
    assert (6000, 6067, 60, 127) in [f[:4] for f in found]
    words = lambda found, k: {w for f in found for w in range(f[k], f[k + 1])}
    blocks = passages.common_passages(passages.Prepared(a), passages.Prepared(b), most=50_000)
    assert (6000, 6067, 60, 127) in [f[:4] for f in blocks]
    assert all(words(found, k) == words(blocks, k) for k in (0, 2))


def test_passages_are_parted_once(monkeypatch):
    """Pairs that all sets of bands hold alike are looked at once; they were parted in each of the three."""
    rng = np.random.default_rng(37)
    s = rng.integers(1, 2**62, 400, dtype=np.uint64)
    a, b = s[:300].copy(), np.concatenate([s[:100], s[300:320], s[100:200], s[320:340], s[200:300]])
    calls = []
    split = passages._split
    monkeypatch.setattr(passages, "_split", lambda px, py, *more: calls.append((px.tobytes(), py.tobytes())) or split(px, py, *more))
    found = passages.common_passages(passages.Prepared(a), passages.Prepared(b))
    assert (0, 100, 0, 100) in [f[:4] for f in found] and {k for f in found for k in range(f[0], f[1])} == set(range(300))
    assert calls and len(calls) == len(set(calls))


def test_overlapping_spans_and_followers():
    """Against plain counts, with spans packed as Spark packs them."""
    rng = np.random.default_rng(41)
    for trial in range(30):
        n = int(rng.integers(1, 60))
        row, k, lo = np.sort(rng.integers(0, 9, n)), rng.integers(0, 6, n), rng.integers(0, 200, n)
        hi = lo + rng.integers(0, 30, n)
        packed = (hi - lo) << 32 | lo << 3 | k
        assert all((x == y).all() for x, y in zip(passages.unpacked(packed), (k, lo, hi), strict=True))
        expect = [r for r in range(9) if any(len({q for o, q, x, y in zip(row, k, lo, hi, strict=True) if o == r and x <= at <= y}) >= 3 for at in range(230))]
        assert passages.overlapping(row, k, lo, hi, 3).tolist() == expect
        s = rng.integers(0, 12, n).astype(np.uint64)
        assert passages.followers(s, row).tolist() == [next((j for j in range(i + 1, n) if s[j] == s[i] and row[j] == row[i]), n) for i in range(n)]


# --- pages


def test_pages_of_many_tags():
    """Time grows with the page's length, in open elements too; the old ways took 27 s and over 45 s for the first two."""
    import time

    for page in ("<div>" * 20_000 + "x", "<a " * 20_000, "<script>" + "</script " * 20_000, "<p>" * 20_000):
        begin = time.perf_counter()
        render.parse(page)
        assert time.perf_counter() - begin < 15
    assert [k if isinstance(k, str) else k.tag for k in render.parse("a<!-- b <p> c").kids] == ["a"]



@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; <b>bold", "plain & bold"),
        ("<title>T</title><p>a<p>b<div>c</div>d", "a\n\nb\n\nc\nd"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>", "- a\n- b\n  3. x\n  4. y"),
        ("<table><tr><th>n<th>size<tr><td>long name<td>1<tr><td>b<td>22</table>", "n          size\nlong name  1\nb          22"),
        ("a<script>var t='</p>';</script><style>p{}</style><!-- no --><span hidden>h</span><i style='display: none'>n</i>b", "ab"),
        ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b></div>", "b"),
        ("<pre>a\n  b</pre>c  d<br>e", "a\n  b\n\nc d\ne"),
        ("<h1>T</h1><blockquote>q</blockquote></nope>x", "T\n\n  q\n\nx"),
        ("<a href=\"x>y\">l</a> <a title='un\">t</a>", "l t"),
    ],
)
def test_render(page, text):
    assert render.render(page or "") == text


def test_tables_of_wide_and_tall_cells():
    """Time and padding follow a table's cells, whatever they span; no text is lost."""
    hostile = "<table><tr>" + "<td rowspan=65534 colspan=1000>x" * 200 + "<tr><td>y" * 200 + "</table>"
    tall = "<table><tr>" + "".join(f"<td rowspan={60_000 - i}>x" for i in range(900)) + "<tr><td>y<td>z" * 20_000 + "</table>"
    many = "<table>" + "<tr>" + "<td>" + "<td>".join(f"cell{i:05}" for i in range(3_000)) + "<tr><td colspan=999>a<td>b" * 2_000 + "</table>"
    for page, found in ((hostile, "x" * 200 + "y" * 200), (tall, "x" * 900 + "yz" * 20_000), (many, "".join(f"cell{i:05}" for i in range(3_000)) + "ab" * 2_000)):
        start = time.perf_counter()
        out = render.render(page)
        assert "".join(out.split()) == found and len(out) < 4 * len(page)
        assert time.perf_counter() - start < 1 + len(page) / 200_000
    assert render.render("<table><tr><td rowspan=3>a<td>b<td rowspan=2>c<tr><td>d<td>e<tr><td colspan=2>f<td>g</table>") == "a  b  c\n   d     e\n   f     g"


def test_render_deep_and_whole(spark, sf):
    assert render.render("<div>" * 5000 + "x" + "<p>y") .split() == ["x", "y"]
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.sub(r"(?s)<(script|style|title)\b.*?</\1>|<!--.*?-->|<head>.*?</head>", " ", r["html"])
        import html

        plain = [w for x in re.split(r"<[^>]*>", body) for w in html.unescape(x).split()]
        assert [w for w in render.render(r["html"]).split() if w != "-"] == [w for w in plain if w != "-"]


# --- quality


def test_quality(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    got = queries.op5_quality(spark, sf.replace("0.001", "0.01")).join(labels, "doc_id").where("held_out").toPandas()
    assert ((got["score"] >= 0) & (got["score"] <= 1)).all()
    assert (got["predicted"] == got["quality"]).mean() > 0.95
    model = quality.fit(docs, labels.where("quality = 1"))
    assert len(model.weights) == 0 and 0.9 < model.prior <= 1


def repeats(w):
    g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = collections.Counter(g)
    return len({k for i, x in enumerate(g) if c[x] > 1 for k in range(i, i + 5)})


def test_rules(spark, sf, docs):
    got = {r["doc_id"]: r for r in queries.op6_outliers(spark, sf).collect()}
    for d, t in docs.items():
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeats(w))
        assert r["base_failed"] == (len(w) < 10 or 100 * repeats(w) > 20 * len(w)) and not (r["base_failed"] and r["kept"])


def test_estimate_resists_outliers(spark):
    rng = np.random.default_rng(1)
    good = rng.normal([1.6, 0.5, 0.4, 0.6], [0.2, 0.3, 0.2, 0.3], (900, 4))
    bad = rng.normal([3, 4, 3, 3], 0.1, (150, 4))
    rows = spark.createDataFrame(pd.DataFrame(np.vstack([good, bad]), columns=rules.NAMES).assign(g="x"))
    mean = rules.estimate(rows).first()["mean"]
    assert np.abs(np.array(mean) - [1.6, 0.5, 0.4, 0.6]).max() < 0.08


# --- chats


def test_chat(spark, sf):
    conv = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        conv[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    said = "</s>[INST] ok [/INST]"
    conv[-1] = [(0, "user", said), (1, "assistant", said)]
    got = {r["conv_id"]: r for r in queries.op7_chat(spark, sf).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == set(conv)
    for c, v in conv.items():
        loss = "".join(t for _, r, t in sorted(v) if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(v), sha("".join(f"{r}\n{t}\n" for _, r, t in sorted(v))), len(loss), sha(loss))


def test_chat_trees(spark):
    rows = [(c, t, r, x) for c, last in ((1, "a"), (2, "b"), (3, "a"), (None, "b")) for t, r, x in ((0, "user", "hi <|end|> \\ <s>"), (1, "assistant", None), (2, "user", last), (2, None, last))]
    packs = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").coalesce(1))
    back = {r["conv_id"]: r for r in chat.read_back(packs).collect()}
    assert set(back) == {1, 2, 3, None} and back[1]["turns_sha256"] == back[3]["turns_sha256"] != back[2]["turns_sha256"]
    for p in packs.collect():
        assert len(p["nodes"]) == len({(n["parent"], p["pack_text"][n["start"] : n["stop"]]) for n in p["nodes"]})  # shared turns once
        for n in p["nodes"]:
            if n["parent"] >= 0:
                up = p["nodes"][n["parent"]]
                assert n["position"] == up["position"] + up["stop"] - up["start"] and n["attends"][:-1] == up["attends"]
    for p in chat.tokenized(packs).collect():
        assert len(p["ids"]) == len(p["position_ids"]) == len(p["loss_mask"])
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], "conv_id bigint, turn int, role string, text string"))).count() == 0
    for s in ("\\", "<s>", "<\\s>", "[[INST]", "<|turn|><|text|>\\\\", "<s<s>"):
        assert chat.unescape(chat.escape(s)) == s and not any(c in chat.escape(s) for c in chat.CONTROL)


# --- pieces


def test_pieces(spark, sf, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.public_model())
    got = {r["doc_id"]: r for r in queries.op8_pieces(spark, sf).collect()}
    for d, t in docs.items():
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())


def test_spans():
    enc = pieces.encoder(pieces.public_model())
    for t in ("", " a  b", "é\n▁x", "日本語 🙂", "a\0b"):
        ids = enc.encode([t])[0]
        start, end = enc.spans(t, ids)
        data = t.encode()
        assert len(ids) == len(start) and b"".join(data[a:b] for a, b in zip(start, end)) == data


def trie(entries):
    """A compiled character map, by the format's own rules, for a test."""
    root: dict = {}
    for key, value in entries:
        node = root
        for b in key:
            node = node.setdefault(b, {})
        node[-1] = value
    units = {0: None}

    def place(node, at):
        base = next(b for b in range(1, 1 << 20) if all((at ^ b ^ max(k, 0)) not in units for k in node) and b < (1 << 21))
        for k in node:
            units[at ^ base ^ max(k, 0)] = None
        old = units[at] or 0
        units[at] = (old & 0xFF) | (base << 10) | ((-1 in node) << 8)
        for k, sub in node.items():
            spot = at ^ base ^ max(k, 0)
            if k == -1:
                units[spot] = sub | (1 << 31)
            else:
                units[spot] = k
                place(sub, spot)

    place(root, 0)
    return np.array([units.get(i, 0xFF) or 0 for i in range(max(units) + 1)], "<u4").tobytes()


def test_character_map():
    strings = b"a\0bc\0 \0"
    blob = trie([(b"A", 0), (b"AB", 2), ("　".encode(), 5)])
    m = pieces.CharMap(len(blob).to_bytes(4, "little") + blob + strings)
    assert m.longest(b"ABx", 0) == (2, b"bc") and m.longest(b"Ax", 0) == (1, b"a") and m.longest(b"x", 0) is None

    class Spec:
        precompiled_charsmap = len(blob).to_bytes(4, "little") + blob + strings
        add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces = True, True, True

    out, source = pieces.Normaliser(Spec)("  AB　 x ".encode())
    assert out.decode() == "▁bc▁x" and source[3] == 2 and source[-2] == 8


# --- near copies


def test_near_copies(spark, sf, docs):
    s = {d: set(shingles(t)) for d, t in docs.items()}
    up = {d: d for d in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if words(docs[a]) == words(docs[b]) or s[a] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]):
                up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["doc_id"]: r["class_id"] for r in queries.op9_near_copies(spark, sf).collect()}
    assert got == {d: find(d) for d in ids}


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(9)
    base = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(200)]
    rows = []
    for i in range(60):
        own = base.copy()
        own[int(rng.integers(0, 200))] = f"x{i}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(200))) for i in range(5)]
    got = {r["doc_id"]: r["class_id"] for r in copies.classes(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert all(got[i] == 0 for i in range(60)) and all(got[100 + i] == 100 + i for i in range(5))


@pytest.mark.parametrize("size", [2, 40])
def test_pairs_with_few_shared_sketches_are_tried(spark, size):
    """Near copies that share one to four of the sketches, in a small group and in one of another size class."""
    rng = np.random.default_rng(23)
    texts = []
    for i in range(1500):
        own = [f"b{rng.integers(1 << 40)}" for _ in range(60)]
        texts.append(" ".join(own))
        own[30] = "x"
        texts.append(" ".join(own))
    data = [x.encode() for x in texts]
    _, _, sk = copies.sketch(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]))
    shared = (sk[::2] == sk[1::2]).sum(axis=1)
    near = [i for i in range(1500) if 1 <= shared[i] <= 4 and copies.aligned(copies.kmers(texts[2 * i]), copies.kmers(texts[2 * i + 1]))][:20]
    assert near
    df = spark.createDataFrame([(2 * i + k, texts[2 * i + k]) for i in near for k in (0, 1)], "doc_id int, text string")
    one = copies.sketches(df).drop("n_shingles")
    ids = {r["doc_id"]: bytes(r["tid"]) for r in one.collect()}
    one = one.drop("doc_id")
    bands = one.select("tid", F.octet_length("fp").alias("wide"), F.posexplode("sk").alias("j", "key"))
    member = bands.join(bands.groupBy("j", "key").count().where("count > 1").drop("count"), ["j", "key"]).withColumn("size", F.lit(size).cast("long"))
    none = spark.createDataFrame([], "node binary, label binary")
    got = {frozenset((bytes(r["x"]), bytes(r["y"]))) for r in copies._cross(member, one, none, copies.TRIES[-1]).collect()}
    assert {frozenset((ids[2 * i], ids[2 * i + 1])) for i in near} <= got


def test_a_line_repeated_many_times(spark):
    line, rest = PROSE[: len(PROSE) // 4], PROSE
    df = spark.createDataFrame([(1, rest), (2, f"{(line + chr(10)) * 200}{rest}"), (3, "nothing like it in any of these words here")], "doc_id int, text string")
    got = {r["doc_id"]: r["class_id"] for r in copies.classes(df).collect()}
    a, b = (copies.kmers(r["text"]) for r in df.where("doc_id < 3").orderBy("doc_id").collect())
    assert copies.aligned(a, b) and got == {1: 1, 2: 1, 3: 3}


def _edited(rng, n_texts, n_words, kept):
    """Texts of which each keeps that share of the words of one, in runs."""
    base = [f"b{i}" for i in range(n_words)]
    out = []
    for k in range(n_texts):
        own = base.copy()
        for at in range(0, n_words, 50):
            if rng.random() > kept:
                own[at : at + 50] = [f"t{k}x{j}" for j in range(len(own[at : at + 50]))]
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("n_words", [1_000, 5_000, 20_000])
def test_bounds_of_long_texts(n_words):
    """Texts that resemble each other are told apart whatever their length, and near copies are not."""
    texts = _edited(np.random.default_rng(5), 24, n_words, 0.77)
    texts += [t.rsplit(" ", n_words // 40)[0] for t in texts[:6]] + [t.rsplit(" ", n_words // 10)[0] for t in texts[6:12]]
    data = [x.encode() for x in texts]
    fp = copies.buckets(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]))
    assert len({len(x) for x in fp}) <= 2 and 4 * max(map(len, fp)) >= n_words - 4
    bounds, own = copies.Bounds(fp), [copies.kmers(t) for t in texts]
    fit = {(i, j) for i in range(len(fp)) for j in bounds.fit(i, np.arange(len(fp))).tolist()}
    near = {(i, j) for i in range(len(fp)) for j in range(len(fp)) if copies.aligned(own[i], own[j])}
    assert len(near) >= len(fp) + 24 and near <= fit and len(fit - near) < 0.02 * len(fp) ** 2


def test_long_texts_that_resemble_each_other(spark):
    """Of a group of long texts few pairs are aligned, and no link is lost."""
    rng = np.random.default_rng(6)
    texts = _edited(rng, 80, 5_000, 0.77)
    texts += [t.rsplit(" ", 300)[0] for t in texts[:10]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    one = copies.sketches(df).drop("n_shingles")
    ids = {bytes(r["tid"]): r["doc_id"] for r in one.collect()}
    member = one.select("tid", F.octet_length("fp").alias("wide"), F.lit(0).alias("j"), F.lit(1).cast("long").alias("key"), F.lit(90).cast("long").alias("size"))
    apart = one.drop("doc_id").withColumn("sk", F.transform("sk", lambda x: F.xxhash64("tid", x)))
    got = {frozenset((ids[bytes(r["x"])], ids[bytes(r["y"])])) for r in copies._cross(member, apart, spark.createDataFrame([], "node binary, label binary"), None).collect()}
    assert {frozenset((i, 80 + i)) for i in range(10)} <= got and len(got) < 0.05 * 90 * 89 / 2
    classes = {r["doc_id"]: r["class_id"] for r in copies.classes(df).collect()}
    assert classes == {i: i if i < 80 else i - 80 for i in range(90)}


def test_order_counts():
    a = copies.kmers(PROSE)
    assert copies.aligned(a, a) == 1.0
    half = len(a) // 2
    assert copies.aligned(a, np.concatenate([a[half:], a[:half]])) == 0.0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (None, 3), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


# --- secrets


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets(spark, sf, docs):
    for r in queries.op10_secrets(spark, sf).collect():
        base = plain_spans(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
    for t in ("é Token : 'abcdefghijklmnop", "APIKEY=short", "toKen=abcdefghijklmnop", "AKIA" + "A" * 14, "deadbeef" * 3, "ſecret = abcdefghijkl"):
        assert secretscan.listed(secretscan.base_spans(t)) == plain_spans(t)


def test_field(docs):
    field = secretscan.train(list(docs.values())[:100])
    rng = np.random.default_rng(5)
    made = secretscan.templates(list(docs.values())[100:], rng, 200)
    found = secretscan.scan(pa.array([t for t, _ in made]), field)
    hits = [any(s.start < g[0][1] and s.end > g[0][0] for s in f) if g else not any(s.kind == 3 for s in f) for (_, g), f in zip(made, found)]
    assert np.mean(hits) > 0.95
    text = 'x token = "abcdefghijklmnopqrst" y'
    assert secretscan.redact(text, secretscan.base_spans(text), "#") == 'x token = "#" y'


def test_what_is_learned_from_is_a_parameter(spark):
    rows = [(i, f"alpha{i} beta gamma password = hunter{i}secret{i}xyz delta epsilon") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    whole, narrow = secretscan.fit(df), secretscan.fit(df, most=1, reach=2, other=1)
    same = secretscan.train([t for _, t in sorted(rows, key=lambda r: r[0])], most=1, reach=2, other=1)
    assert any((whole.weights[k] != narrow.weights[k]).any() for k in whole.weights)
    assert {k: v.shape for k, v in same.weights.items()} == {k: v.shape for k, v in narrow.weights.items()}


def test_rest_of_a_secret_is_added():
    text = 'é password: "abcdef123456$Xy!z" and'
    base = secretscan.base_spans(text)
    starts, ends = secretscan._joined(base)
    at = text.index("abc")
    assert [text[a:b] for a, b in secretscan._uncovered(text, at, text.index('" and'), starts, ends)] == ["$Xy!z"]
    assert [text[a:b] for a, b in secretscan._uncovered(text, 0, len(text), starts, ends)] == ["é ", '$Xy!z" and']
    assert not list(secretscan._uncovered(text, at, ends[0] + 1, starts, ends))
    assert secretscan._joined([secretscan.Span(1, 0, 5, 1), secretscan.Span(2, 2, 9, 2), secretscan.Span(11, 1, 12, 11)]) == ([1, 11], [9, 12])


def test_viterbi_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(1, 40))
        scores = rng.normal(0, 2, (n, 3)).astype(np.float32) + np.float32([4, 0, 0])
        field = secretscan.Field({}, rng.normal(0, 1, (3, 3)).astype(np.float32), rng.normal(0, 1, 3).astype(np.float32))
        best, back = scores[0] + field.start, []
        for row in scores[1:]:
            each = best[:, None] + field.moves
            back.append(each.argmax(0))
            best = each.max(0) + row
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert secretscan.decode(scores, np.array([0, n]), np.zeros(n, int), field).tolist() == path[::-1]


# --- odd tables


def every(spark, df, labels):
    field = secretscan.train(["token = abcdefghijklmnop"])
    items = spark.createDataFrame([(1, PROSE)], "item_id int, text string")
    model = quality.learn([(PROSE * 3, 1), (PROSE, 1), ("### ### | |" * 20, 0), ("!!! A!! B!!" * 9, 0)] * 5)
    return {
        "leaks": decontam.find_leaks(df, items), "clean": decontam.decontaminate(df, items), "lm": maxent.score(df), "passages": passages.find_passages(df), "pages": render.render_pages(df, "text"),
        "quality": quality.score(df, model), "fit": quality.score(df, quality.fit(df, labels)), "rules": rules.judge(df), "pieces": pieces.encode_documents(df), "classes": copies.classes(df),
        "one": copies.keep_one(df), "secrets": secretscan.find_secrets(df, field),
    }


def test_odd(spark, odd):
    labels = spark.createDataFrame([(7, 1, 0), (8, None, 0), (12, 0, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    out = {k: v.collect() for k, v in every(spark, odd, labels).items()}
    for k in ("lm", "pages", "quality", "fit", "rules", "pieces", "classes", "secrets"):
        assert len(out[k]) == len(ODD), k
    assert len(out["leaks"]) == 4 and len(out["clean"]) == len(ODD) - 4
    texts = [(r["doc_id"], r["text"]) for r in out["one"]]
    assert (7, PROSE) in texts and len(texts) == 7 and (1, None) in texts  # PROSE and its near copy; LONG and its own; empty ones
    assert {r["class_id"] for r in out["classes"] if r["doc_id"] in (7, 8)} == {7}
    assert all(r["n_words"] == 0 and r["base_failed"] for r in out["rules"] if r["doc_id"] in (1, 2, 3))
    assert all(0 <= r["score"] <= 1 for r in out["quality"])
    assert {(r["n_tokens"]) for r in out["lm"] if r["doc_id"] in (1, 2, 3)} == {1}


def test_empty(spark, odd):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for k, v in every(spark, odd.limit(0), labels).items():
        assert v.count() == 0, k


def test_pipeline(spark, sf, docs):
    import corpus_pipeline as cp

    kept = spark.read.parquet(f"{sf}/documents.parquet")
    names = kept.columns
    seen = [kept.count()]
    for name, stage in cp.STAGES:
        out = cp.settle(stage(spark, kept, sf))
        if name != "pieces":
            assert out.columns == names
        seen.append(out.count())
        kept = out
    assert seen[0] > seen[1] > seen[2] > seen[3] == seen[4] == seen[5] > 0.5 * seen[0]
    assert {r["doc_id"] for r in cp.run(spark, sf).collect()} == {r["doc_id"] for r in kept.collect()}


def test_pipeline_odd(spark, odd, sf):
    import corpus_pipeline as cp

    for df in (odd, odd.limit(0)):
        for _, stage in cp.STAGES:
            df = cp.settle(stage(spark, df, sf))
        df.collect()
