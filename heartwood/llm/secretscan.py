"""Secret scans: fixed patterns, and a linear-chain conditional random field.

The patterns give the base spans, which always stay. The field tags the tokens
of every text as begin, inside or outside of a secret, from the token's shape,
the words beside it and features of the whole text, and adds what the patterns
miss, the rest of a secret that a pattern cuts short included. It is trained here, by gradient ascent on the exact likelihood, from a
bounded sample of documents labelled by the patterns and from written-out
templates of other secrets and of things that only look like them.

Decoding is Viterbi's algorithm. A token whose outside score leads by more than
any change of transitions could win back is outside on the best path, so the
best path is found run by run between such tokens, exactly.

Defined cases: null and empty texts have no spans and the digest of the empty
list; repeated rows are scanned each on its own; extra columns pass through;
an empty table gives an empty result, with a field trained on the templates.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens as tk
from .common import others, raw, steps, strings

KINDS = ("assign", "access", "hex", "field")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a run of fewer fails; a longer one is taken whole
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    value: int  # where the secret itself starts


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start and then kind; offsets are code points."""
    found: list[Span] = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [Span(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [Span(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [Span(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    found.sort()
    return found


# --- features -------------------------------------------------------------

#: Bytes of a token.
MARKS = tk.ALNUM.copy()
MARKS[[ord(c) for c in "_+/=.-"]] = True
_CLASSES = {
    "digit": range(48, 58), "upper": range(65, 91), "lower": range(97, 123), "mark": [ord(c) for c in "_+/=.-"],
    "far": range(128, 256), "hexa": [*range(48, 58), *range(97, 103)],
}
_TABLES = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}
_KIND = np.select([_TABLES["digit"], _TABLES["upper"], _TABLES["lower"], _TABLES["mark"]], [1, 2, 3, 4], 5).astype(np.uint8)
_KEYS = np.sort(np.array([tk.word_hash(w) for w in "password passwd pwd pass secret token apikey api_key api-key key access_key secret_key access_token auth_token auth bearer authorization credential credentials client_secret private_key".split()], np.uint64))
#: Sizes of the templates of features.
SIZES = {"shape": 4096, "length": 16, "before": 48, "gap": 16, "second": 4, "after": 32, "word_before": 1024, "word_after": 1024, "file": 64}
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
#: What is learned from a sampled text: its first so many secrets with so many tokens on either side, and so many tokens at a random place.
SEEN, REACH, OTHER = 4, 12, 24
#: Words around the templates: so many of so many texts of the sample.
POOL_WORDS, POOL_TEXTS = 60, 200
_BITS = np.array([0, 4, 8, 12, 16, 20, 24, 32, 40, 64], np.int64)


def _sums(table: np.ndarray, buf: np.ndarray, w: tk.Words) -> np.ndarray:
    total = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(table[buf], out=total[1:], dtype=np.int32)
    return total[w.end] - total[w.start]


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[tk.Words, dict[str, np.ndarray]]:
    """The value of every template for every token of every row."""
    w = tk.words(buf, offsets, MARKS)
    n = len(w.hash)
    if not n:
        return w, {k: np.zeros(0, np.int32) for k in SIZES}
    size = w.end - w.start
    count = {k: _sums(t, buf, w) for k, t in _TABLES.items()}
    kinds = _KIND[buf]
    turn = np.zeros(len(buf), bool)
    turn[1:] = kinds[1:] != kinds[:-1]
    turns = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(turn, out=turns[1:], dtype=np.int32)
    turns = np.maximum(turns[w.end] - turns[np.minimum(w.start + 1, len(buf))], 0)
    length = np.searchsorted(_BITS, size, side="right").astype(np.int32)  # 0 to 10
    share = np.select([count["digit"] == 0, count["digit"] * 5 < size, count["digit"] * 2 < size, count["digit"] < size], [0, 1, 2, 3], 4)
    case = (count["upper"] > 0) * 2 + (count["lower"] > 0)
    case = np.where((count["upper"] == 1) & (count["lower"] > 0) & _TABLES["upper"][buf[w.start]], 4, case)
    shape = ((((length * 5 + share) * 5 + case) * 2 + (count["hexa"] == size)) * 2 + (count["mark"] > 0)) * 2 + (count["far"] > 0)
    shape = (shape * 3 + np.select([turns < 2, turns < 6], [0, 1], 2)) % SIZES["shape"]
    same = np.zeros(n, bool)
    same[1:] = w.doc[1:] == w.doc[:-1]
    key = np.isin(w.hash, _KEYS)
    # what stands between a token and the one before: ":" or "=" or a quote, or a space only, or a line's end
    sign = np.isin(buf, [0x3A, 0x3D])
    quote = np.isin(buf, [0x22, 0x27, 0x60])
    total = np.zeros((3, len(buf) + 1), np.int32)
    for row, t in zip(total, (sign, quote, buf == 0x0A), strict=True):
        np.cumsum(t, out=row[1:], dtype=np.int32)
    back = np.where(same, np.concatenate([[0], w.end[:-1]]), offsets[w.doc])
    gap = ((total[0][w.start] > total[0][back]) * 1 + (total[1][w.start] > total[1][back]) * 2 + (total[2][w.start] > total[2][back]) * 4 + (w.start - back <= 1) * 8).astype(np.int32)
    lone = (buf[w.start] == 0x3D) | ((size == 1) & (buf[w.start] == 0x3D))  # "=" is a byte of tokens too
    shift = lambda a, by, fill: np.concatenate([np.full(min(by, n), fill, a.dtype), a[: n - by] if by < n else a[:0]])
    prev_ok, prev2_ok = same, same & shift(same, 1, False)
    key1, lone1 = shift(key, 1, False) & prev_ok, shift(lone, 1, False) & prev_ok
    key2 = shift(key, 2, False) & prev2_ok
    len1 = np.where(prev_ok, np.minimum(shift(length, 1, 0), 5), 6)
    before = (key1 * 1 + (key2 & lone1) * 2 + lone1 * 4) * 6 + np.minimum(len1, 5)
    after_ok = np.concatenate([same[1:], [False]])
    nxt = np.concatenate([length[1:], [0]])
    gap1 = np.concatenate([gap[1:], [0]])
    after = np.where(after_ok, np.minimum(nxt, 10) + 11 * ((gap1 & 2) > 0), 31)
    w1 = np.where(prev_ok, shift(w.hash, 1, np.uint64(0)) % np.uint64(1023), 1023).astype(np.int32)
    w2 = np.where(after_ok, np.concatenate([w.hash[1:], np.zeros(1, np.uint64)]) % np.uint64(1023), 1023).astype(np.int32)
    # the file: how long it is, how much of it are marks of code, how many of its tokens are long with digits
    rows = len(offsets) - 1
    nbytes = np.diff(offsets)
    marks = np.add.reduceat(np.append(sign, False).astype(np.int32), np.minimum(offsets[:-1], len(buf))) * (nbytes > 0)
    odd = np.bincount(w.doc[(size >= 16) & (count["digit"] > 2)], minlength=rows)
    file = np.searchsorted([200, 1000, 5000], nbytes, side="right") * 16 + np.searchsorted([1, 4, 16], marks, side="right") * 4 + np.minimum(odd, 3)
    out = {"shape": shape, "length": length, "before": before, "gap": gap, "second": key2 * 2 + key1, "after": after, "word_before": w1, "word_after": w2, "file": file[w.doc]}
    return w, {k: v.astype(np.int32) for k, v in out.items()}


# --- the field ------------------------------------------------------------


class Field(NamedTuple):
    weights: dict[str, np.ndarray]  # template -> [values, 3]
    moves: np.ndarray  # [3, 3], from and to
    start: np.ndarray

    def scores(self, feats: dict[str, np.ndarray]) -> np.ndarray:
        out = np.zeros((len(feats["shape"]), 3), np.float32)
        for k, v in feats.items():
            out += self.weights[k][v]
        return out


def viterbi(scores: np.ndarray, begin: np.ndarray, size: np.ndarray, moves: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The best tags of many runs of tokens at once, each [begin, begin + size); head and tail, a row per run, are added at its ends."""
    tags = np.zeros(len(scores), np.int8)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    best = scores[begin] + head[order]
    left = len(begin) - np.searchsorted(size[::-1], np.arange(int(size[0]) + 1), side="right")  # runs longer than each step
    back = np.zeros((len(scores), 3), np.int8)
    for t in range(1, int(size[0])):
        k = left[t]
        at = begin[:k] + t
        each = best[:k, :, None] + moves
        which = each.argmax(1)
        back[at] = which
        best[:k] = np.take_along_axis(each, which[:, None], 1)[:, 0] + scores[at]
    tag = (best + tail[order]).argmax(1)
    for t in range(int(size[0]) - 1, -1, -1):
        k = left[t]
        at = begin[:k] + t
        tags[at] = tag[:k]
        tag[:k] = back[at, tag[:k]]
    return tags


def decode(scores: np.ndarray, first: np.ndarray, doc: np.ndarray, field: Field) -> np.ndarray:
    """The best tags of every row's tokens: exact, run by run between tokens that are outside beyond doubt.

    Whatever stands beside a token, putting it outside instead of tag y gains at
    least its lead over y, less the most that the two moves can lose; where that
    is above 0 for every y, the best path has it outside.
    """
    if not len(scores):
        return np.zeros(0, np.int8)
    into = np.vstack([field.moves, field.start])  # what can stand before: a tag, or the row's beginning
    out = np.hstack([field.moves, np.zeros((3, 1), np.float32)])  # what can follow: a tag, or the row's end
    reach = [float((into[:, y] - into[:, OUTSIDE]).max() + (out[y] - out[OUTSIDE]).max()) for y in (BEGIN, INSIDE)]
    doubt = np.flatnonzero((scores[:, BEGIN] + reach[0] >= scores[:, OUTSIDE]) | (scores[:, INSIDE] + reach[1] >= scores[:, OUTSIDE]))
    if not len(doubt):
        return np.zeros(len(scores), np.int8)
    fresh = np.flatnonzero(np.concatenate([[True], (np.diff(doubt) > 1) | (np.diff(doc[doubt]) != 0)]))
    begin, size = doubt[fresh], np.diff(np.append(fresh, len(doubt)))
    d = doc[begin]
    head = np.where((begin == first[d])[:, None], field.start, field.moves[OUTSIDE])
    tail = np.where((begin + size == first[d + 1])[:, None], np.float32(0), field.moves[:, OUTSIDE])
    return viterbi(scores, begin, size, field.moves, head, tail)


def train(texts: list[str], seed: int = 7, rounds: int = 70, rate: float = 0.12, decay: float = 2e-4, most: int = SEEN, reach: int = REACH, other: int = OTHER) -> Field:
    """Fit on texts labelled by the patterns, and on templates.

    Of each text it learns from the tokens within reach of its first `most`
    secrets, and from `other` tokens at a random place.
    """
    rng = np.random.default_rng(seed)
    made = [(t, [(s.value, s.end) for s in base_spans(t)]) for t in texts] + templates(texts, rng)
    seqs, tags = [], []
    for text, gold in made:
        data = text.encode()
        buf, offsets = np.frombuffer(data, np.uint8), np.array([0, len(data)])
        w, f = features(buf, offsets)
        n = len(w.hash)
        if not n:
            continue
        y = np.zeros(n, np.int8)
        for a, b in gold:
            lo, hi = len(text[:a].encode()), len(text[:b].encode())
            hit = np.flatnonzero((w.end > lo) & (w.start < hi))
            if len(hit):
                y[hit], y[hit[0]] = INSIDE, BEGIN
        stacked = np.stack([f[k] for k in SIZES])
        at = np.flatnonzero(y == BEGIN)
        windows = [(max(0, i - reach), min(n, i + reach)) for i in at[:most]] + [(i, min(n, i + other)) for i in rng.integers(0, n, 1)]
        for a, b in windows:
            seqs.append(stacked[:, a:b])
            tags.append(y[a:b])
    weights = {k: np.zeros((v, 3), np.float32) for k, v in SIZES.items()}
    weights["shape"][:, OUTSIDE] = 2.0
    moves, start = np.zeros((3, 3), np.float32), np.zeros(3, np.float32)
    moves[OUTSIDE, INSIDE] = start[INSIDE] = -4.0
    if not seqs:
        return Field(weights, moves, start)
    n, longest = len(seqs), max(x.shape[1] for x in seqs)
    x, y, real = np.zeros((len(SIZES), n, longest), np.int32), np.zeros((n, longest), np.int8), np.zeros((n, longest), bool)
    for i, (s, t) in enumerate(zip(seqs, tags, strict=True)):
        m = s.shape[1]
        x[:, i, :m], y[i, :m], real[i, :m] = s, t, True
    params = [*weights.values(), moves, start]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    gold = np.eye(3, dtype=np.float32)[y] * real[..., None]
    for t in range(1, rounds + 1):
        em = sum(p[x[k]] for k, p in enumerate(params[:-2]))
        node, pair = _marginals(em, real, params[-2], params[-1])
        grads = []
        diff = (gold - node) / n
        for k, p in enumerate(params[:-2]):
            flat = x[k][real]
            grads.append(np.stack([np.bincount(flat, diff[..., c][real], len(p)) for c in range(3)], 1).astype(np.float32))
        both = real[:, 1:]
        seen = np.zeros((3, 3), np.float32)
        np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
        grads += [(seen - pair) / n, diff[:, 0].sum(0)]
        for p, g, a, b in zip(params, grads, first, second, strict=True):
            g = g - decay * p
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-6)
        np.clip(params[-2], -6, 6, out=params[-2])
        np.clip(params[-1], -6, 6, out=params[-1])
    return Field(dict(zip(SIZES, params, strict=False)), params[-2], params[-1])


def _marginals(em: np.ndarray, real: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward passes over padded sequences: tag marginals, and expected moves."""
    n, longest, _ = em.shape
    lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
    ahead = np.zeros_like(em)
    ahead[:, 0] = em[:, 0] + start
    for i in range(1, longest):
        step = lse(ahead[:, i - 1, :, None] + moves, 1) + em[:, i]
        ahead[:, i] = np.where(real[:, i, None], step, ahead[:, i - 1])
    total = lse(ahead[:, -1], 1)
    behind = np.zeros_like(em)
    for i in range(longest - 2, -1, -1):
        step = lse(moves + (em[:, i + 1] + behind[:, i + 1])[:, None, :], 2)
        behind[:, i] = np.where(real[:, i + 1, None], step, 0)
    node = np.exp(ahead + behind - total[:, None, None]) * real[..., None]
    pair = np.zeros((3, 3), np.float32)
    for i in range(1, longest):
        p = np.exp(ahead[:, i - 1, :, None] + moves + (em[:, i] + behind[:, i])[:, None, :] - total[:, None, None])
        pair += (p * real[:, i, None, None]).sum(0)
    return node, pair


def templates(texts: list[str], rng: np.random.Generator, count: int = 700) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts with secrets of other forms, and with harmless look-alikes, amid words of the sample."""
    pool = [w for t in texts[:POOL_TEXTS] for w in t.split()[:POOL_WORDS]] or "the of and to in a is that it for on was as with be by".split()
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    draw = lambda chars, n: "".join(np.array(list(chars))[rng.integers(0, len(chars), n)])
    b64 = lower + upper + digits
    size = lambda a, b: int(rng.integers(a, b))
    secret = [
        lambda: ("Authorization: Bearer ", f"{draw(b64, 20)}.{draw(b64 + '_-', size(30, 60))}.{draw(b64 + '_-', 43)}", ""),
        lambda: ("aws_secret_access_key = ", draw(b64 + "+/", 40), ""),
        lambda: ("", "ghp_" + draw(b64, 36), ""), lambda: ("", "xoxb-" + draw(digits, 12) + "-" + draw(b64, 24), ""),
        lambda: ('client_secret: "', draw(b64, size(24, 48)), '"'), lambda: ("private_key=", draw(b64 + "+/", size(32, 64)), ";"),
        lambda: ("api-key: ", draw(b64, size(20, 40)), ""), lambda: ("auth_token '", draw(lower + digits, size(20, 40)), "'"),
        lambda: ("pwd = '", draw(b64, 6) + "$" + draw(b64, 5) + "!" + draw(b64, 4), "'"), lambda: ("password: ", draw(b64, size(12, 20)), ""),
        lambda: ("key = ", draw(digits + "ABCDEF", size(32, 64)), ""),
    ]
    harmless = [
        lambda: f"+{draw(digits, 2)} ({draw(digits, 3)}) {draw(digits, 3)}-{draw(digits, 4)}", lambda: f"{draw(lower, 6)}.{draw(digits, 2)}@mail.example.com",
        lambda: f"https://{draw(lower, 8)}.example.org/{draw(lower, 5)}/{draw(digits, 4)}?page={draw(digits, 1)}", lambda: f"20{draw(digits, 2)}-0{draw(digits, 1)}-1{draw(digits, 1)}",
        lambda: f"{draw(digits, 3)}.{draw(digits, 2)}.{draw(digits, 1)}.{draw(digits, 3)}", lambda: draw(lower, size(14, 26)), lambda: draw(upper, size(10, 20)),
        lambda: f"v{draw(digits, 1)}.{draw(digits, 2)}.{draw(digits, 1)}", lambda: draw(digits, size(8, 14)), lambda: f"token {draw(lower, 6)}", lambda: f"the secret: {draw(lower, 7)}",
        lambda: f"key = {draw(digits, 3)}", lambda: f"password: {draw(lower, 5)}", lambda: f"{draw(lower, 6)}_{draw(lower, 7)}_{draw(lower, 6)}", lambda: f"{draw(lower, 8)}-{draw(lower, 9)}-{draw(lower, 5)}",
    ]
    out = []
    for i in range(count):
        head, rest = (" ".join(pool[j] for j in rng.integers(0, len(pool), size(4, 10))) for _ in range(2))
        if i % 2:
            out.append((f"{head} {harmless[i // 2 % len(harmless)]()} {rest}", []))
        else:
            lead, value, tail = secret[i // 2 % len(secret)]()
            at = len(head) + 1 + len(lead)
            out.append((f"{head} {lead}{value}{tail} {rest}", [(at, at + len(value))]))
    return out


# --- on tables ------------------------------------------------------------

#: The sample that the field is fitted on: so many documents, of so many characters at most.
SAMPLE, SAMPLE_CHARS = 1000, 20_000


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE, most_chars: int = SAMPLE_CHARS, most: int = SEEN, reach: int = REACH, other: int = OTHER) -> Field:
    """A field trained on the sample of documents with the smallest hashes of their texts.

    The sample's bounds are sample and most_chars; most, reach and other say what train() learns from each text.
    """
    own = docs.select(F.col(text).alias("t")).where(F.col("t").isNotNull() & (F.length("t") <= most_chars))
    # hashes first, so that tasks send numbers to be ranked and the driver gets the sample's texts alone
    hashed = own.withColumn("h", F.xxhash64("t"))
    last = hashed.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return train([], most=most, reach=reach, other=other)
    rows = hashed.where(F.col("h") <= last).groupBy("h").agg(F.first("t").alias("t")).orderBy("h").collect()
    return train([r["t"] for r in rows], most=most, reach=reach, other=other)


def _uncovered(text: str, lo: int, hi: int, starts: list[int], ends: list[int]) -> Iterator[tuple[int, int]]:
    """The parts of text[lo:hi] outside of separate spans in order, where they hold a letter or a digit."""
    k = bisect_right(ends, lo)
    while lo < hi:
        stop = min(hi, starts[k]) if k < len(starts) else hi
        if any(c.isalnum() for c in text[lo:stop]):
            yield lo, stop
        lo, k = (max(stop, ends[k]) if k < len(ends) else hi), k + 1


def _joined(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of what sorted spans cover together."""
    starts, ends = [], []
    for s in spans:
        if ends and s.start <= ends[-1]:
            ends[-1] = max(ends[-1], s.end)
        else:
            starts.append(s.start)
            ends.append(s.end)
    return starts, ends


def scan(texts: pa.Array, field: Field) -> list[list[Span]]:
    """All spans of each text, base ones first in rank; of a field's span, the parts that no base span covers."""
    buf, offsets = raw(texts)
    rows = texts.to_pylist()
    found = [base_spans(t) for t in rows]
    for i, j in steps(offsets):
        part, at = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        w, f = features(part, at)
        tags = decode(field.scores(f), w.first, w.doc, field)
        hits = np.flatnonzero(tags)
        if not len(hits):
            continue
        points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        covered: dict[int, tuple[list[int], list[int]]] = {}
        new = (tags[hits] == BEGIN) | np.concatenate([[True], (np.diff(hits) > 1) | (np.diff(w.doc[hits]) != 0)])
        for run in np.split(hits, np.flatnonzero(new)[1:]):
            d = int(w.doc[run[0]])
            lo, hi = (int(points[x] - points[at[d]]) for x in (w.start[run[0]], w.end[run[-1]]))
            if d not in covered:
                covered[d] = _joined(found[i + d])
            found[i + d] += [Span(a, 3, b, a) for a, b in _uncovered(rows[i + d], lo, hi, *covered[d])]
    for spans in found:
        spans.sort()
    return found


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def redact(text: str, spans: list[Span], mark: str) -> str:
    out, at = [], 0
    for s in sorted(spans, key=lambda s: s.value):
        if s.end > at:
            out += [text[at : max(at, s.value)], mark]
            at = s.end
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, field: Field, text: str = "text", keep: list[str] | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs' columns (those in keep, by default all) with `n_assign`, `n_access`,
    `n_hex`, `n_field`, `base_sha256`, `spans` and `redacted` text, in which each
    secret's own characters are replaced by mark. One pass, no shuffle."""
    new = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "redacted"]
    kept = others(docs.columns if keep is None else keep, new)
    schema = T.StructType([*docs.select(*kept).schema.fields, *(T.StructField(c, T.LongType() if c[:2] == "n_" else T.StringType()) for c in new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = strings(batch, len(kept))
                found = scan(texts, field)
                counts = [pa.array([sum(s.kind == k for s in x) for x in found], pa.int64()) for k in range(4)]
                base = [hashlib.sha256(listed([s for s in x if s.kind < 3]).encode()).hexdigest() for x in found]
                clean = [redact(t, x, mark) if x else t for t, x in zip(texts.to_pylist(), found, strict=True)]
                last = [pa.array(c, pa.string()) for c in (base, [listed(x) for x in found], clean)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *counts, *last], names=[*kept, *new])

    return docs.select(*kept, F.col(text).alias("__text")).mapInArrow(run, schema)
