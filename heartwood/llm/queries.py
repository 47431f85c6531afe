"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.state import shared_dir
from . import chat, copies, decontam, maxent, panes, passages, phrases, pieces, quality, render, rules, secretscan, warc
from .common import fold_of, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op2_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of documents."""
    return maxent.score(table(spark, sf_dir, "documents"))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that repeat in documents."""
    return passages.find_passages(table(spark, sf_dir, "documents"))


def op4_render_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laid-out text of pages."""
    out = render.render_pages(table(spark, sf_dir, "pages"), keep=["page_id"])
    return out.select("page_id", F.col("page_text").alias("text"), F.length("page_text").cast("long").alias("n_chars"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of documents."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    out = quality.score(docs, model, keep=["doc_id"])
    return out.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the quality rules on documents."""
    out = rules.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as they are read back from packs of prefix trees."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.format_chats(rows.unionByName(extra)), rows.schema["conv_id"].dataType.simpleString())


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of documents' pieces and of their decoding."""
    out = pieces.encode_documents(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select(
        "doc_id",
        (F.octet_length("piece_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("piece_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.sha2(F.concat("span_starts", "span_ends"), 256).alias("spans_sha256"),
    )


def op9_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of each document."""
    return copies.classes(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in documents."""
    docs = table(spark, sf_dir, "documents")
    out = secretscan.find_secrets(docs, secretscan.fit(docs), keep=["doc_id"])
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_field")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of pages, written to archives and read back from them."""
    pages = table(spark, sf_dir, "pages")
    path = f"{shared_dir(spark)}/heartwood-warc-{uuid.uuid4().hex}"
    warc.write_archives(pages, path)
    return warc.read_back(spark, path, pages.schema["page_id"].dataType.simpleString())


_OP11 = """WITH p AS (SELECT page_id, coalesce(html,'') AS h FROM pages), d AS (SELECT page_id, h, strlen(h) AS n, CASE WHEN strlen(h)>=1000 THEN max(page_id) OVER (PARTITION BY h) END AS m FROM p)
SELECT page_id, n AS payload_bytes, sha1(encode(h)) AS payload_digest, CASE WHEN m<>page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN m<>page_id THEN m END AS refers_to FROM d"""

def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of documents, by language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


_OP12 = r"""WITH p AS (SELECT coalesce(lang,'und') AS lang, row_number() OVER () AS d, unnest(regexp_split_to_array(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece,'[\x20\x09]+'), lambda x: x<>'') AS ws FROM p), t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(ws[i:i+k-1],' ') AS phrase FROM w, unnest([1,2,3,4,5]) AS s(k), unnest(range(1,len(ws)-k+2)) AS q(i)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*)>=100), c AS (SELECT *, string_split(phrase,' ') AS ws FROM f WHERE k>1),
s AS (SELECT c.lang, c.k, c.phrase, c.f AS a, l.f AS l, r.f AS r, t.n, j, (1000::HUGEINT*c.f*t.n)//(l.f::HUGEINT*r.f) AS score FROM c JOIN t USING (lang), unnest(range(1,c.k)) AS x(j),
 f l, f r WHERE l.lang=c.lang AND l.phrase=array_to_string(c.ws[1:j],' ') AND r.lang=c.lang AND r.phrase=array_to_string(c.ws[j+1:],' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j)=1),
u AS (SELECT c.lang, array_to_string(c.ws[i:i+m-1],' ') AS phrase, max(c.f) AS g FROM c, unnest(range(2,c.k)) AS x(m), unnest(range(1,c.k-m+2)) AS y(i) GROUP BY ALL),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank FROM b LEFT JOIN u ON u.lang=b.lang AND u.phrase=b.phrase WHERE u.g IS NULL OR 100*u.g<100*a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM z WHERE rank<=2000"""

def op13_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panes of clicks with their revisions, batch by batch."""
    return panes.revisions(table(spark, sf_dir, "clicks")).select("batch", "hour", "click_id", "n_rows", "cents", "record", "kind")


def _crc32(text: str) -> str:
    """CRC-32 of a short ASCII text in SQL: a fold of its bits."""
    step = "CASE WHEN ({0}&1)=1 THEN xor({0}>>1, 3988292384) ELSE {0}>>1 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(generate_series(1, 8*length({text})), lambda i: CASE WHEN i%8=1 THEN ascii({text}[(i-1)//8+1])::BIGINT ELSE 0 END)), lambda c, x: {step.format('xor(c, x)')}), 4294967295)"


_OP13 = f"""WITH c AS (SELECT click_id, min(ts) AS ts, min(arrived_at) AS arrived_at, coalesce(min(kind),'none') AS kind, min(value) AS value FROM clicks WHERE ts IS NOT NULL GROUP BY click_id),
d AS (SELECT *, (epoch_us(arrived_at)//86400000000)::BIGINT AS day FROM c), e AS (SELECT click_id, kind, coalesce(floor(100*value+0.5),0)::BIGINT AS cents, least(11, day%12+greatest(0, {_crc32('(click_id::VARCHAR)')}%30-23))::BIGINT AS batch, epoch_us(ts)-(day-day%12)*86400000000 AS et FROM d),
r AS (SELECT *, floor(et/3600000000.0)::BIGINT AS hour FROM e), b AS (SELECT range AS batch FROM range(12)), w AS (SELECT batch, (SELECT max(et) FROM e WHERE e.batch<b.batch) AS w FROM b),
m AS (SELECT r.*, coalesce(w.w>=(hour+1)*3600000000+259200000000, false) AS late FROM r JOIN w USING (batch)),
p AS (SELECT kind, hour, batch, count(*) AS n, sum(cents)::BIGINT AS c FROM m WHERE NOT late GROUP BY ALL),
t AS (SELECT kind, hour, batch, sum(n) OVER v::BIGINT AS n, sum(c) OVER v::BIGINT AS c, min(batch) OVER (PARTITION BY kind, hour) AS first FROM p WINDOW v AS (PARTITION BY kind, hour ORDER BY batch)),
g AS (SELECT kind, hour, greatest(first, (SELECT min(w.batch) FROM w WHERE w.w>=(hour+1)*3600000000+7200000000)) AS due, (SELECT min(w.batch) FROM w WHERE w.w>=(hour+1)*3600000000+7200000000) IS NULL AS never FROM (SELECT DISTINCT kind, hour, first FROM t)),
o AS (SELECT t.*, g.due, g.never, lag(n) OVER x AS n0, lag(c) OVER x AS c0, lead(t.batch) OVER x AS next FROM t JOIN g USING (kind, hour) WINDOW x AS (PARTITION BY t.kind, t.hour ORDER BY t.batch))
SELECT batch, hour, click_id, 1::BIGINT AS n_rows, cents, 'late' AS record, kind FROM m WHERE late UNION ALL
SELECT CASE WHEN never THEN 11 ELSE due END, hour, -1, n, c, CASE WHEN never THEN 'final' ELSE 'emit' END, kind FROM o WHERE CASE WHEN never THEN next IS NULL ELSE batch<=due AND (next IS NULL OR next>due) END UNION ALL
SELECT batch, hour, -1, n0, c0, 'retract', kind FROM o WHERE NOT never AND batch>due UNION ALL SELECT batch, hour, -1, n, c, 'replace', kind FROM o WHERE NOT never AND batch>due"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontaminate, op2_maxent, op3_passages, op4_render_html, op5_quality, op6_outliers, op7_chat, op8_pieces, op9_near_copies, op10_secrets, op11_warc, op12_phrases, op13_panes)
}
ORACLES: dict[str, str] = {"op11_warc": _OP11, "op12_phrases": _OP12, "op13_panes": _OP13}
