"""From raw documents to token ids, in stages that each write their result.

Stages in order: low-quality documents go; one document of each class of near
copies stays; documents that hold benchmark items go; secrets are replaced by a
mark; texts become pieces with their places in the text. All but the last return
the columns of documents. Equal rows are one document from the second stage on;
null and empty texts count as empty texts, of which the second stage keeps one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heartwood.llm import copies, decontam, pieces, quality, secretscan
from heartwood.llm.common import settle, table


def _aside(docs: DataFrame) -> tuple[DataFrame, str, Callable[[DataFrame], DataFrame]]:
    """docs under neutral names, so that no column clashes with an operator's; its text column; and the way back."""
    names = docs.columns
    neutral = [f"c{i}" for i in range(len(names))]
    return docs.toDF(*neutral), f"c{names.index('text')}", lambda df: df.select(*(F.col(c).alias(n) for c, n in zip(neutral, names, strict=True)))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    own, text, back = _aside(docs)
    return back(quality.score(own, model, text=text, name="quality").where("quality >= 0.5"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return copies.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets masked, and n_chars to match; a null text stays null."""
    field = secretscan.fit(docs)
    own, text, back = _aside(docs)
    found = secretscan.find_secrets(own, field, text=text)
    clean = found.withColumn(text, F.when(F.col(text).isNotNull(), F.col("redacted")))
    if "n_chars" in docs.columns:
        n = f"c{docs.columns.index('n_chars')}"
        same = F.col("spans") == ""
        clean = clean.withColumn(n, F.when(same, F.col(n)).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    return back(clean)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, text, _ = _aside(docs)
    names = docs.columns
    kept = [f"c{i}" for i, n in enumerate(names) if n in ("doc_id", "lang", "source")]
    out = pieces.encode_documents(own, text=text, keep=kept)
    n = (F.octet_length("piece_ids") / 4).cast("long").alias("n_tokens")
    return out.select(*(F.col(c).alias(names[int(c[1:])]) for c in kept), n, "piece_ids", "span_starts", "span_ends", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_copies", drop_copies),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("pieces", to_pieces),
]
#: No SQL: the stages learn models. tests/llm holds each operator against plain versions, and run() against the chain of STAGES.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
