"""Quality rules: text statistics and robust multivariate outliers.

Only DataFrame functions. Per language and source, a minimum-covariance-
determinant estimate is reached by concentration steps: from a start at medians
and quartiles, each step keeps the share H of rows with the smallest Mahalanobis
distances and takes their mean and covariance. A step is one pass: rows are
aggregated by group and by bin of distance (count, sums and products), and a
cumulative count over a group's bins picks the bins to keep. Groups of few rows
take the estimate of their language, or of all rows.

Defined cases: null text counts as none, and fails the base rules; null
languages and sources are groups of their own; repeated rows each count; extra
columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import others, settle

_GAP = r"[\x20\x09-\x0D]+"
#: Transformed statistics and the least standard deviation that each is given.
FLOORS = {"x_length": 0.12, "x_symbols": 0.35, "x_lines": 0.45, "x_repeats": 0.7}
#: Share of rows that an estimate keeps; rows that a group needs for its own; steps; squared distance beyond which a row goes (chi-square with four degrees of freedom at 1 - 1e-6).
H, LEAST, STEPS, CUT = 0.75, 200, 4, 33.4
_BINS = 16  # to a doubling of the distance


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def repeated_words(words: Column, k: int = 5) -> Column:
    """Words inside windows of k words that the array holds twice or more."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k)))

    def count(h: Column) -> Column:
        by_hash = F.array_sort(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
            at = F.transform(p, lambda v, i: F.when(same(v, F.get(p, i - 1)) | same(v, F.get(p, i + 1)), v["i"]))
            return F.array_sort(F.array_compact(at))

        covered = lambda a: F.aggregate(F.transform(a, lambda v, i: F.least(F.lit(k), F.coalesce(F.get(a, i + 1) - v, F.lit(k)))), F.lit(0).cast("long"), lambda s, v: s + v)
        return let(let(by_hash, places), covered)

    return F.when(n < k, F.lit(0).cast("long")).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(count(h))))


def statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (by default all but text) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    kept = others(docs.columns if keep is None else keep, new, text)
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(body, _GAP), "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda c: c.cast("long")
    wide = docs.select(*kept, body.alias("__body"), words.alias("__words"), lines.alias("__lines"))
    out = wide.select(
        *kept,
        count(F.size("__words")).alias("n_words"),
        count(F.length(F.array_join("__words", ""))).alias("word_chars"),
        count(F.regexp_count("__body", F.lit("[#*$%&|<>]"))).alias("n_symbols"),
        count(F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def vectors(stats: DataFrame) -> DataFrame:
    """The transformed statistics, as columns; null where a text has no words."""
    per = lambda c, by: F.log1p(100 * F.col(c) / F.col(by))
    some = F.col("n_words") > 0
    return stats.select(
        "*",
        F.when(some, F.log(F.col("word_chars") / F.col("n_words"))).alias("x_length"),
        F.when(some, per("n_symbols", "word_chars")).alias("x_symbols"),
        F.when(some, per("n_dup_lines", "n_words")).alias("x_lines"),
        F.when(some, per("n_repeat_words", "n_words")).alias("x_repeats"),
    )


NAMES = list(FLOORS)
_PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]


def _inverse(cov: dict[tuple[int, int], Column]) -> list[Column]:
    """The lower triangle of the inverse of the Cholesky factor of a covariance, row by row.

    A small share of the product of variances is added to the diagonal, so that the factor exists.
    """
    n = len(NAMES)
    low: dict[tuple[int, int], Column] = {}
    for i in range(n):
        for j in range(i + 1):
            s = cov[i, j] - sum((low[i, k] * low[j, k] for k in range(j)), F.lit(0.0))
            low[i, j] = F.sqrt(F.greatest(s, 0.05 * cov[i, i])) if i == j else s / low[j, j]
    inv: dict[tuple[int, int], Column] = {}
    for i in range(n):
        inv[i, i] = 1 / low[i, i]
        for j in range(i):
            inv[i, j] = -sum((low[i, k] * inv[k, j] for k in range(j, i)), F.lit(0.0)) / low[i, i]
    return [inv[p] for p in _PAIRS]


def distance(means: Column, factor: Column) -> Column:
    """Squared Mahalanobis distance of the row's vector."""
    diff = [F.col(x) - means[i] for i, x in enumerate(NAMES)]
    rows = [sum((factor[_PAIRS.index((i, j))] * diff[j] for j in range(i + 1)), F.lit(0.0)) for i in range(len(NAMES))]
    return reduce(lambda a, b: a + b, (r * r for r in rows))


def _factor(sums: DataFrame) -> DataFrame:
    """group, n, mean, factor from a group's count, sums and sums of products."""
    n = F.col("n")
    mean = [F.col("s")[i] / n for i in range(len(NAMES))]
    floor = list(FLOORS.values())
    cov = {(i, j): F.col("p")[k] / n - mean[i] * mean[j] + (floor[i] ** 2 if i == j else 0.0) for k, (i, j) in enumerate(_PAIRS)}
    flat = sums.select("g", "n", *(c.alias(f"c{i}{j}") for (i, j), c in cov.items()), F.array(*mean).alias("mean"))
    return flat.select("g", "n", "mean", F.array(*_inverse({(i, j): F.col(f"c{i}{j}") for i, j in _PAIRS})).alias("factor"))


def estimate(rows: DataFrame, h: float = H, steps: int = STEPS) -> DataFrame:
    """Per group g: n, mean and factor of the estimate; one row per group."""
    # the start: medians, and quartiles for spreads, from counts by bins of a 64th
    long = rows.select("g", F.posexplode(F.array(*(F.col(x) for x in NAMES))).alias("f", "x")).groupBy("g", "f", F.round(F.col("x") * 64).cast("int").alias("b")).agg(F.count("*").alias("c"))
    upto = Window.partitionBy("g", "f").orderBy("b")
    cum = long.withColumn("u", F.sum("c").over(upto)).withColumn("t", F.sum("c").over(Window.partitionBy("g", "f")))
    at = lambda q: F.min(F.when(F.col("u") >= q * F.col("t"), F.col("b") / 64.0))
    start = cum.groupBy("g", "f").agg(at(0.25).alias("lo"), at(0.5).alias("mid"), at(0.75).alias("hi"), F.max("t").alias("n"))
    floor = F.array(*(F.lit(v) for v in FLOORS.values()))
    spread = F.sqrt(F.pow((F.col("hi") - F.col("lo")) / 1.349, 2) + F.pow(F.get(floor, F.col("f")), 2))
    wide = start.groupBy("g").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("f", "mid", spread.alias("sd")))).alias("v"))
    first = [1 / F.col("v")[i]["sd"] if i == j else F.lit(0.0) for i, j in _PAIRS]
    found = settle(wide.select("g", "n", F.col("v")["mid"].alias("mean"), F.array(*first).alias("factor")))
    for _ in range(steps):
        d = rows.join(found.select("g", "mean", "factor"), "g").withColumn("d", distance(F.col("mean"), F.col("factor")))
        bins = d.groupBy("g", F.floor(F.log2(F.col("d") + 1e-9) * _BINS).cast("int").alias("b")).agg(
            F.count("*").alias("c"),
            F.array(*(F.sum(x) for x in NAMES)).alias("s"),
            F.array(*(F.sum(F.col(NAMES[i]) * F.col(NAMES[j])) for i, j in _PAIRS)).alias("p"),
        )
        by = Window.partitionBy("g")
        kept = bins.withColumn("u", F.sum("c").over(by.orderBy("b")) - F.col("c")).withColumn("t", F.sum("c").over(by)).where(F.col("u") < h * F.col("t"))
        sums = kept.groupBy("g").agg(
            F.sum("c").cast("double").alias("n"),
            F.array(*(F.sum(F.col("s")[i]) for i in range(len(NAMES)))).alias("s"),
            F.array(*(F.sum(F.col("p")[k]) for k in range(len(_PAIRS)))).alias("p"),
        )
        found = settle(_factor(sums))
    return found


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None, least: int = LEAST, cut: float = CUT) -> DataFrame:
    """statistics() of docs with `distance` and `kept`.

    Texts are read once: the statistics, a few numbers a row, are written to the
    shared folder, and the steps of the estimates run over them.
    """
    columns = docs.columns if keep is None else keep
    kept = others(columns, ["distance", "kept", *NAMES], text)
    own = docs.select(*kept, F.col(lang).alias("__lang"), F.col(source).alias("__source"), F.col(text).alias("__text"))
    stats = settle(vectors(statistics(own, "__text")))
    fair = stats.where(~F.col("base_failed") & F.col("x_length").isNotNull())
    sizes = settle(fair.groupBy("__lang", "__source").agg(F.count("*").alias("n")))
    level = lambda k, *c: F.concat_ws("\x1f", F.lit(k), *(F.coalesce(F.concat(F.lit("="), x), F.lit("")) for x in c))
    full, part, whole = level("s", F.col("__lang"), F.col("__source")), level("l", F.col("__lang")), level("a")
    group = F.when(F.col("n") >= least, full).when(F.col("m") >= least, part).otherwise(whole)
    # a row counts for its source, its language and the whole; those that some group needs are estimated
    per_lang = sizes.groupBy(F.col("__lang").alias("k0")).agg(F.sum("n").alias("m"))
    groups = settle(sizes.join(per_lang, F.col("__lang").eqNullSafe(F.col("k0"))).select(F.col("__lang").alias("k1"), F.col("__source").alias("k2"), group.alias("g")))
    needed = settle(groups.select("g").distinct())
    tagged = fair.withColumn("g", F.explode(F.array(full, part, whole))).select("g", *NAMES)
    found = estimate(tagged.join(needed, "g", "left_semi"))
    names = groups.join(found, "g").select("k1", "k2", "mean", "factor")
    both = stats.join(settle(names), F.col("__lang").eqNullSafe(F.col("k1")) & F.col("__source").eqNullSafe(F.col("k2")), "left")
    d = both.withColumn("distance", distance(F.col("mean"), F.col("factor")))
    verdict = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True))
    return d.withColumn("kept", verdict).drop("__lang", "__source", "k1", "k2", "mean", "factor", *NAMES)
