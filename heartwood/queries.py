"""Queries of the engine over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashing, paths, text
from .operators import budget, extract, lookup, refresh, reports, search, tree
from .operators import diff as d
from .plans import jobs
from .plans import plan as p
from .sources import corpus
from .sources.corpus import table
from .sources.files import PIPELINE_BYTES
from .streaming import events as ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _files(name: str, gone: str, edit: str) -> str:
    return f"""{name} AS (SELECT lang AS repo, source||'/b'||CAST(doc_id%10 AS VARCHAR)||'/'||CAST(doc_id AS VARCHAR)||
 CASE doc_id%4 WHEN 0 THEN '.py' WHEN 1 THEN '.v' WHEN 2 THEN '.md' ELSE '.js' END AS path, {edit} AS text FROM documents WHERE {gone})"""


_BLOB = "sha1(encode('blob '||CAST(strlen(text) AS VARCHAR)||chr(0))||encode(text))"
_V0 = "CASE WHEN doc_id%7=0 THEN text||' v0' ELSE text END"
_SPARSE = "source IN ('src1','src3')"
_SNAPS = f"""{_files('fc', 'doc_id%13<>0', 'text')}, {_files('fp', 'doc_id%11<>0', _V0)},
cur AS (SELECT repo, path, {_BLOB} AS sha FROM fc), prev AS (SELECT repo, path, {_BLOB} AS sha FROM fp)"""
_SPARSE_SNAPS = f"""{_files('fc', f'NOT (doc_id%13=0 AND {_SPARSE})', 'text')},
{_files('fp', f'NOT (doc_id%11=0 AND {_SPARSE})', f"CASE WHEN doc_id%7=0 AND {_SPARSE} THEN text||' v0' ELSE text END")},
cur AS (SELECT repo, path, {_BLOB} AS sha FROM fc), prev AS (SELECT repo, path, {_BLOB} AS sha FROM fp)"""
_DIFF = """diff AS (SELECT coalesce(c.repo,q.repo) AS repo, coalesce(c.path,q.path) AS path, c.sha AS current_sha, q.sha AS recorded_sha,
 c.sha IS DISTINCT FROM q.sha AS stale, c.sha IS NULL AS deleted FROM cur c FULL OUTER JOIN prev q ON c.repo=q.repo AND c.path=q.path)"""
_UP = lambda t: f"SELECT repo, '.' AS node_id FROM {t} UNION SELECT repo, split_part(path,'/',1) FROM {t} UNION SELECT repo, split_part(path,'/',1)||'/'||split_part(path,'/',2) FROM {t}"
_PLAN = f"""changed AS (SELECT * FROM diff WHERE stale), up AS ({_UP('changed')}), live AS ({_UP('cur')}),
plan AS (SELECT repo, path AS id, CASE WHEN deleted THEN 'delete' ELSE 'regen' END AS action, 1 AS phase FROM changed
 UNION ALL SELECT u.repo, u.node_id, 'resynth', 2 FROM up u SEMI JOIN live l ON u.repo=l.repo AND u.node_id=l.node_id)"""
_LEVELS = lambda c, n: f"""{n}3 AS (SELECT repo, regexp_replace(path,'/[^/]*$','') AS node_id, path||':'||sha AS part FROM {c}),
{n}2 AS (SELECT repo, node_id, sha256(node_id||chr(0)||array_to_string(list_sort(list(part)),chr(0))) AS h FROM {n}3 GROUP BY repo, node_id),
{n}4 AS (SELECT repo, split_part(node_id,'/',1) AS top, node_id||':'||h AS part FROM {n}2),
{n}1 AS (SELECT repo, top, sha256(top||chr(0)||array_to_string(list_sort(list(part)),chr(0))) AS h FROM {n}4 GROUP BY repo, top),
{n}0 AS (SELECT repo, sha256('.'||chr(0)||array_to_string(list_sort(list(top||':'||h)),chr(0))) AS h FROM {n}1 GROUP BY repo),
{n} AS (SELECT repo, node_id, 1 AS depth, 'folder' AS kind, h AS node_hash FROM {n}2 UNION ALL SELECT repo, top, 0, 'folder', h FROM {n}1 UNION ALL SELECT repo, '.', -1, 'project', h FROM {n}0)"""  # noqa: E731


def _both(spark: SparkSession, sf: str, sparse: bool = False) -> tuple[DataFrame, DataFrame]:
    return corpus.leaves(corpus.current_files(spark, sf, sparse)), corpus.leaves(corpus.previous_files(spark, sf, sparse))


@query(f"WITH {_SNAPS}, {_DIFF}, {_PLAN} SELECT * FROM plan")
def refresh_plan(spark: SparkSession, sf: str) -> DataFrame:
    return p.refresh_plan(*_both(spark, sf))


@query(f"SELECT doc_id, {_BLOB} AS blob_sha FROM documents")
def content_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", hashing.content_id(F.col("text")).alias("blob_sha"))


@query(f"WITH {_SNAPS}, {_DIFF} SELECT * FROM diff")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    return d.snapshot_diff(*_both(spark, sf))


@query(f"WITH {_SNAPS}, {_DIFF} SELECT repo, CASE WHEN deleted THEN 'deleted' WHEN recorded_sha IS NULL THEN 'added' ELSE 'modified' END AS change, count(*) AS n FROM diff WHERE stale GROUP BY ALL")
def change_summary(spark: SparkSession, sf: str) -> DataFrame:
    return d.changes(d.snapshot_diff(*_both(spark, sf))).groupBy("repo", "change").agg(F.count("*").alias("n"))


@query(f"WITH {_SNAPS}, {_LEVELS('cur', 'n')} SELECT * FROM n")
def node_hash(spark: SparkSession, sf: str) -> DataFrame:
    nodes = tree.node_hashes(_both(spark, sf)[0]).where("kind <> 'leaf'")
    return nodes.select("repo", "node_id", F.col("depth").cast("int").alias("depth"), "kind", "node_hash")


@query(f"WITH {_SNAPS}, {_LEVELS('cur', 'n')}, {_LEVELS('prev', 'm')} SELECT n.repo, n.node_id FROM n LEFT JOIN m ON n.repo=m.repo AND n.node_id=m.node_id WHERE n.node_hash IS DISTINCT FROM m.node_hash")
def stale_nodes(spark: SparkSession, sf: str) -> DataFrame:
    cur, prev = _both(spark, sf)
    return tree.stale_nodes(tree.node_hashes(cur), tree.node_hashes(prev))


@query(f"WITH {_SPARSE_SNAPS}, {_LEVELS('cur', 'n')}, {_LEVELS('prev', 'm')} SELECT n.repo, n.node_id FROM n LEFT JOIN m ON n.repo=m.repo AND n.node_id=m.node_id WHERE n.node_hash IS DISTINCT FROM m.node_hash")
def stale_nodes_sparse(spark: SparkSession, sf: str) -> DataFrame:
    cur, prev = _both(spark, sf, True)
    return tree.stale_nodes(tree.node_hashes(cur), tree.node_hashes(prev))


@query(f"WITH {_SNAPS}, {_DIFF}, {_PLAN} SELECT repo, id AS node_id FROM plan WHERE phase=2")
def ancestor_closure(spark: SparkSession, sf: str) -> DataFrame:
    cur, prev = _both(spark, sf)
    return tree.ancestor_closure(d.snapshot_diff(cur, prev).where("stale"), cur)


@query(f"WITH {_SNAPS}, {_DIFF}, {_PLAN} SELECT repo, count(*) FILTER (action='regen') AS stale_leaves, count(*) FILTER (action='resynth') AS stale_nodes, count(*) FILTER (action='delete') AS deleted FROM plan GROUP BY repo")
def plan_summary(spark: SparkSession, sf: str) -> DataFrame:
    return p.summary(p.refresh_plan(*_both(spark, sf)))


@query("SELECT CAST(0 AS BIGINT) AS actions, true AS is_empty")
def plan_is_empty(spark: SparkSession, sf: str) -> DataFrame:
    cur = _both(spark, sf)[0]
    return p.refresh_plan(cur, cur).agg(F.count("*").alias("actions")).withColumn("is_empty", F.col("actions") == 0)


_GEN = "'U['||{t}.path||']'||left({t}.{s},8)"


@query(f"WITH {_SNAPS}, {_DIFF} SELECT repo, path, {_GEN.format(t='diff', s='current_sha')} AS doc, 'regenerated' AS outcome FROM diff WHERE stale AND NOT deleted UNION ALL SELECT repo, path, {_GEN.format(t='diff', s='recorded_sha')}, 'reused' FROM diff WHERE NOT stale")
def leaf_refresh(spark: SparkSession, sf: str) -> DataFrame:
    cur, prev = _both(spark, sf)
    cache = prev.select("repo", "path", F.concat(F.lit("U["), "path", F.lit("]"), F.left("blob_sha", F.lit(8))).alias("doc"))
    make = F.concat(F.lit("U["), F.col("path"), F.lit("]"), F.left(F.col("current_sha"), F.lit(8)))
    return refresh.refresh_leaves(corpus.current_files(spark, sf), d.snapshot_diff(cur, prev), cache, make).drop("error")


def _docs(c: str, n: str, s: str = "sha") -> str:
    leaf = _GEN.format(t=c, s=s)
    return f"""{n}2 AS (SELECT repo, regexp_replace(path,'/[^/]*$','') AS node_id, sha256(string_agg(path||'='||{leaf}, chr(10) ORDER BY path)) AS doc FROM {c} GROUP BY ALL),
{n}1 AS (SELECT repo, split_part(node_id,'/',1) AS node_id, sha256(string_agg(node_id||'='||doc, chr(10) ORDER BY node_id)) AS doc FROM {n}2 GROUP BY repo, split_part(node_id,'/',1)),
{n}0 AS (SELECT repo, '.' AS node_id, sha256(string_agg(node_id||'='||doc, chr(10) ORDER BY node_id)) AS doc FROM {n}1 GROUP BY repo),
{n} AS (SELECT * FROM {n}2 UNION ALL SELECT * FROM {n}1 UNION ALL SELECT * FROM {n}0)"""


@query(f"WITH {_SPARSE_SNAPS}, {_DIFF}, {_PLAN}, {_docs('cur', 'k')} SELECT k.repo, k.node_id, k.doc, CASE WHEN p.id IS NULL THEN 'reused' ELSE 'resynthesized' END AS outcome FROM k LEFT JOIN (SELECT * FROM plan WHERE phase=2) p ON p.repo=k.repo AND p.id=k.node_id")
def ancestor_refresh(spark: SparkSession, sf: str) -> DataFrame:
    cur, prev = _both(spark, sf, True)
    doc = F.concat(F.lit("U["), "path", F.lit("]"), F.left("blob_sha", F.lit(8))).alias("doc")
    made = lambda n, kids: F.sha2(F.array_join(F.transform(kids, lambda k: F.concat(k["id"], F.lit("="), k["doc"])), "\n"), 256)
    none = spark.createDataFrame([], "repo string, node_id string, doc string")
    before = refresh.refresh_nodes(tree.live_nodes(prev), tree.live_nodes(prev), prev.select("repo", "path", doc), none, made)
    stale = tree.ancestor_closure(d.snapshot_diff(cur, prev).where("stale"), cur)
    return refresh.refresh_nodes(tree.live_nodes(cur), stale, cur.select("repo", "path", doc), before.select("repo", "node_id", "doc"), made)


@query(f"""WITH {_SNAPS}, {_DIFF}, {_PLAN}, work AS (SELECT repo, id, phase, row_number() OVER (PARTITION BY repo ORDER BY phase,
 (CASE WHEN phase=2 THEN (CASE WHEN id='.' THEN -1 ELSE length(id)-length(replace(id,'/','')) END) ELSE 0 END) DESC, CASE WHEN phase=1 THEN id END, id DESC) AS ord FROM plan WHERE action<>'delete')
SELECT repo, id, phase, CAST(ord AS INT) AS ord, CAST(7*ord AS BIGINT) AS running, 7*ord<=250 AS admitted FROM work""")
def budget_admit(spark: SparkSession, sf: str) -> DataFrame:
    work = p.in_order(p.refresh_plan(*_both(spark, sf))).withColumn("cents", F.lit(7).cast("long"))
    return budget.admit(work, "cents", 250, ("ord",), ("repo",)).select("repo", "id", "phase", F.col("ord").cast("int").alias("ord"), "running", "admitted")


@query(f"WITH {_SNAPS}, r AS (SELECT repo, path, count(*) OVER (PARTITION BY repo) AS total, row_number() OVER (PARTITION BY repo ORDER BY path) AS n FROM cur) SELECT repo, path, total, CAST(n AS INT) AS n, total>6 AS truncated FROM r WHERE n<=6")
def capped_preview(spark: SparkSession, sf: str) -> DataFrame:
    return budget.capped(_both(spark, sf)[0].select("repo", "path"), "repo", "path", 6)


def _case(t: dict[str, str], col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} IN ({', '.join(repr(e) for e in v.split())}) THEN '{k}'" for k, v in t.items()) + " ELSE 'unknown' END"


_EXT = "CASE doc_id%4 WHEN 0 THEN '.py' WHEN 1 THEN '.v' WHEN 2 THEN '.md' ELSE '.js' END"


@query(f"WITH e AS (SELECT doc_id, {_EXT} AS ext FROM documents) SELECT doc_id, ext, {_case(paths.LANGUAGES, 'ext')} AS language, {_case(paths.FALLBACK, 'ext')} AS fallback, {_case(paths.EXPORT, 'ext')} AS export, CASE ext WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' ELSE ltrim(ext,'.') END AS label, ext<>'.md' AS is_code FROM e")
def language_map(spark: SparkSession, sf: str) -> DataFrame:
    own = corpus.files(spark, sf).withColumn("ext", paths.suffix(F.col("path")))
    e = F.col("ext")
    return own.select("doc_id", "ext", paths.language(e).alias("language"), paths.language(e, paths.FALLBACK).alias("fallback"), paths.language(e, paths.EXPORT).alias("export"), paths.fence_label(e).alias("label"), paths.is_code(F.col("path")).alias("is_code"))


@query(f"WITH e AS (SELECT lang AS repo, {_EXT} AS ext FROM documents) SELECT repo, {_case(paths.LANGUAGES, 'ext')} AS language, count(*) AS n FROM e GROUP BY ALL")
def language_counts(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.files(spark, sf).groupBy("repo", paths.language(paths.suffix(F.col("path"))).alias("language")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, CAST(strlen(text) AS INT) AS n_bytes FROM documents WHERE doc_id%4<>2 AND strlen(text)<{PIPELINE_BYTES} AND NOT regexp_full_match(text, '\\s*')")
def scan_filter(spark: SparkSession, sf: str) -> DataFrame:
    own = corpus.files(spark, sf)
    known = paths.language(paths.suffix(F.col("path")), paths.EXPORT) != "unknown"
    return own.where(known & (F.octet_length("text") < PIPELINE_BYTES) & ~text.is_blank(F.col("text"))).select("doc_id", F.octet_length("text").alias("n_bytes"))


_URL = "'https://example.com/'||source"
_WEB = f"""files AS (SELECT doc_id AS id, lang AS language, '{{"repository_url":"'||{_URL}||'"}}' AS metadata, n_chars AS updated_at FROM documents),
docs AS (SELECT doc_id*10+k AS id, doc_id AS file_id, CASE WHEN toxic=1 THEN 'review' ELSE 'overview' END AS doc_type, doc_id%97 AS generated_at FROM labels, (SELECT unnest([0,1]) AS k) WHERE k=0 OR quality=0)"""


def _web(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Files, and one document of each labelled file, two where its quality is 0."""
    meta = F.concat(F.lit('{"repository_url":"https://example.com/'), "source", F.lit('"}'))
    files = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), meta.alias("metadata"), F.col("n_chars").alias("updated_at"))
    kind = F.when(F.col("toxic") == 1, "review").otherwise("overview")
    two = F.explode(F.when(F.col("quality") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    docs = table(spark, sf, "labels").select("doc_id", kind.alias("doc_type"), two.alias("k")).select((F.col("doc_id") * 10 + F.col("k")).alias("id"), F.col("doc_id").alias("file_id"), "doc_type", (F.col("doc_id") % 97).alias("generated_at"))
    return files, docs


@query(f"WITH {_WEB} SELECT d.id, d.file_id, d.doc_type, f.language, d.generated_at FROM docs d JOIN files f ON d.file_id=f.id WHERE json_extract_string(f.metadata,'$.repository_url')='https://example.com/src3' AND f.language='en' AND d.doc_type='overview'")
def doc_listing(spark: SparkSession, sf: str) -> DataFrame:
    return reports.doc_listing(*_web(spark, sf), url="https://example.com/src3", language="en", doc_type="overview").select("id", "file_id", "doc_type", "language", "generated_at")


_COVER = "json_extract_string(f.metadata,'$.repository_url') AS repo_url, count(*) AS total_files, count(d.id) AS documented_files, max(f.updated_at) AS last_update, round(count(d.id)*100.0/count(*), 6) AS coverage"


@query(f"WITH {_WEB} SELECT {_COVER} FROM files f LEFT JOIN docs d ON f.id=d.file_id GROUP BY 1")
def coverage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return reports.coverage(*_web(spark, sf)).withColumn("coverage", F.round("coverage", 6))


@query(f"WITH {_WEB}, one AS (SELECT file_id, min(id) AS id FROM docs GROUP BY file_id) SELECT {_COVER} FROM files f LEFT JOIN one d ON f.id=d.file_id GROUP BY 1")
def coverage_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return reports.coverage(*_web(spark, sf), distinct=True).withColumn("coverage", F.round("coverage", 6))


@query(f"WITH {_WEB}, c AS (SELECT {_COVER} FROM files f LEFT JOIN docs d ON f.id=d.file_id GROUP BY 1) SELECT count(*) AS total, count(*) FILTER (total_files%2=0) AS active, round(coalesce(avg(coverage),0),1) AS avg_coverage FROM c")
def dashboard_stats(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("total_files") % 2 == 0, "processing").otherwise("completed")
    return reports.dashboard(reports.coverage(*_web(spark, sf)).withColumn("status", status))


def _search_sql(q: tuple[str, ...], pick: str) -> str:
    toks = lambda c: f"list_filter(regexp_split_to_array(lower(coalesce({c},'')), '[^a-z0-9]+'), lambda x: x<>'')"
    freq = ", ".join(f"10.0*len(list_filter(tn, lambda x: x='{t}')) + 5.0*len(list_filter(ts, lambda x: x='{t}')) + 1.0*len(list_filter(tc, lambda x: x='{t}')) AS f{i}" for i, t in enumerate(q))
    idf = " + ".join(f"greatest(ln((n-n{i}+0.5)/(n{i}+0.5)), 1e-6)*f{i}*2.2/(f{i}+1.2*(0.25+0.75*ln_/mean))" for i in range(len(q)))
    return f"""WITH t AS (SELECT doc_id AS id, lang, {toks('source')} AS tn, {toks('left(text,60)')} AS ts, {toks('text')} AS tc FROM documents),
r AS (SELECT id, lang, len(tn)+len(ts)+len(tc) AS ln_, {freq} FROM t), s AS (SELECT count(*) AS n, avg(ln_) AS mean, {', '.join(f'count(*) FILTER (f{i}>0) AS n{i}' for i in range(len(q)))} FROM r),
k AS (SELECT id, lang, -({idf}) AS rank FROM r, s WHERE {' AND '.join(f'f{i}>0' for i in range(len(q)))}) {pick}"""


def _ranked(spark: SparkSession, sf: str, q: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.left("text", F.lit(60)).alias("summary"), F.col("text").alias("content"))
    return search.bm25(docs, q)


@query(_search_sql(("thing",), "SELECT id, round(rank,6) AS rank FROM k"))
def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf, "thing").withColumn("rank", F.round("rank", 6))


@query(_search_sql(("the", "thing"), "SELECT id, round(rank,6) AS rank, (SELECT count(*) FROM k) AS total, (SELECT count(*) FROM k)>15 AS has_more FROM k ORDER BY k.rank, id LIMIT 10 OFFSET 5"))
def bm25_page(spark: SparkSession, sf: str) -> DataFrame:
    return search.page(_ranked(spark, sf, "the thing"), limit=10, offset=5).withColumn("rank", F.round("rank", 6))


@query(_search_sql(("la", "de"), "SELECT id, round(rank,6) AS rank FROM k WHERE lang='es'"))
def filtered_search(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "documents").where("lang = 'es'").select(F.col("doc_id").alias("id"))
    return _ranked(spark, sf, "la de").join(own, "id", "left_semi").withColumn("rank", F.round("rank", 6))


_EV = """e AS (SELECT event_id, ts, CASE event_type WHEN 'click' THEN 'push' WHEN 'view' THEN 'pull_request' ELSE event_type END AS type, 'repo'||CAST(user_id%20 AS VARCHAR) AS repo,
 user_id%20<>7 AS enabled, CASE event_id%4 WHEN 0 THEN 'refs/heads/main' WHEN 1 THEN 'refs/heads/docs' WHEN 2 THEN 'refs/tags/v1' ELSE 'refs/heads/dev' END AS ref,
 CASE event_id%3 WHEN 0 THEN 'opened' WHEN 1 THEN 'synchronize' ELSE 'closed' END AS action, CASE WHEN event_id%5=0 THEN 'dev' ELSE 'main' END AS base, CAST(json_extract(props,'$.k') AS INT) AS k FROM events)"""


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as repository events."""
    i, t = F.col("event_id"), F.col("event_type")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (i % n + 1).cast("int"))
    return table(spark, sf, "events").select(
        "event_id", "ts", F.when(t == "click", "push").when(t == "view", "pull_request").otherwise(t).alias("type"),
        F.concat(F.lit("repo"), (F.col("user_id") % 20).cast("string")).alias("repo"), (F.col("user_id") % 20 != 7).alias("enabled"),
        pick(4, "refs/heads/main", "refs/heads/docs", "refs/tags/v1", "refs/heads/dev").alias("ref"), pick(3, "opened", "synchronize", "closed").alias("action"),
        F.when(i % 5 == 0, "dev").otherwise("main").alias("base"), F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


@query(f"""WITH {_EV}, g AS (SELECT event_id, CASE WHEN type NOT IN ('push','pull_request') THEN 'unsupported' WHEN NOT enabled THEN 'disabled'
 WHEN type='push' AND starts_with(ref,'refs/heads/') AND substr(ref,12) NOT IN ('main','docs') THEN 'branch' WHEN type='push' AND ref='refs/heads/docs' THEN 'docs branch'
 WHEN type='pull_request' AND action NOT IN ('opened','synchronize') THEN 'action' WHEN type='pull_request' AND base NOT IN ('main','docs') THEN 'base' ELSE 'process' END AS reason FROM e)
SELECT event_id, reason='process' AS process, reason FROM g""")
def event_gate(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    g = ev.gate(c("type"), c("enabled"), c("ref"), c("action"), c("base"), F.array(F.lit("main"), F.lit("docs")), F.lit("docs"))
    return _events(spark, sf).select("event_id", g.alias("g")).select("event_id", "g.process", "g.reason")


@query(f"WITH {_EV} SELECT DISTINCT event_id AS delivery_id, unnest(['src/f'||CAST(k%3 AS VARCHAR)||'.py', 'src/f'||CAST(k%5 AS VARCHAR)||'.py', 'new/'||CAST(k AS VARCHAR)||'.v']) AS path FROM e WHERE type='push'")
def event_changed_files(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    load = F.format_string('{"commits":[{"added":["new/%d.v"],"modified":["src/f%d.py"],"removed":["old.py"]},{"modified":["src/f%d.py"]}]}', k, k % 3, k % 5)
    return ev.changed_files(_events(spark, sf).where("type = 'push'").select(F.col("event_id").alias("delivery_id"), load.alias("payload")))


@query(f"WITH {_EV}, r AS (SELECT repo, ts, event_id, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, event_id DESC) AS n FROM e) SELECT repo, ts, event_id FROM r WHERE n=1")
def latest_event_per_repo(spark: SparkSession, sf: str) -> DataFrame:
    return ev.latest_by_repo(_events(spark, sf), value="event_id")


@query("SELECT page_id, CASE WHEN page_id%2=0 THEN 'owner'||CAST(page_id%7 AS VARCHAR)||'-r'||CAST(page_id AS VARCHAR) ELSE left(md5(url),16) END AS slug, page_id%2=0 AND page_id%3=0 AS allowed FROM pages")
def repo_slug(spark: SparkSession, sf: str) -> DataFrame:
    """Plain addresses, addresses of another form, and addresses with more after the name."""
    i = F.col("page_id")
    head = F.when(i % 3 == 1, "git@github.com:owner").otherwise("https://github.com/owner")
    tail = F.when(i % 3 == 0, "").when(i % 3 == 1, ".git").otherwise("/tree/main")
    url = F.when(i % 2 == 0, F.concat(head, (i % 7).cast("string"), F.lit("/r"), i.cast("string"), tail)).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", text.repo_slug(url).alias("slug"), text.repo_url_ok(url).alias("allowed"))



@query("SELECT doc_id, array_to_string(list_filter(['transaction','validation','calculation','workflow'], lambda w: contains(lower(code), w)), ',') AS logic, array_to_string(list_filter(['django'], lambda w: contains(code, 'from django')), ',') AS vendor FROM (SELECT doc_id, text||CASE doc_id%3 WHEN 0 THEN ' Validation of the workflow' WHEN 1 THEN ' from django import x' ELSE '' END AS code FROM documents)")
def pattern_flags(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    code = F.concat("text", F.when(i % 3 == 0, " Validation of the workflow").when(i % 3 == 1, " from django import x").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.logic_flags(code), ",").alias("logic"), F.array_join(text.vendor_flags(code), ",").alias("vendor"))


@query("SELECT conv_id, string_agg('### '||CAST(turn AS VARCHAR)||chr(10)||left(text,1500), chr(10)||chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def prompt_assembly(spark: SparkSession, sf: str) -> DataFrame:
    kid = F.struct(F.col("turn"), F.col("turn").cast("string").alias("id"), F.col("text").alias("doc"))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(kid)).alias("kids")).select("conv_id", refresh.child_listing(F.col("kids")).alias("prompt"))


@query("""WITH l AS (SELECT r.r_name AS a, r.r_name||'/'||n.n_name AS b, r.r_name||'/'||n.n_name||'/c'||CAST(c.c_custkey AS VARCHAR) AS c, r.r_name||'/'||n.n_name||'/c'||CAST(c.c_custkey AS VARCHAR)||'/o'||CAST(o.o_orderkey AS VARCHAR) AS path,
 md5(CAST(o.o_orderkey AS VARCHAR)||o.o_orderstatus) AS sha FROM orders o JOIN customer c ON o.o_custkey=c.c_custkey JOIN nation n ON c.c_nationkey=n.n_nationkey JOIN region r ON n.n_regionkey=r.r_regionkey),
t3 AS (SELECT a, b, c, sha256(c||chr(0)||array_to_string(list_sort(list(path||':'||sha)),chr(0))) AS h FROM l GROUP BY a,b,c),
t2 AS (SELECT a, b, sha256(b||chr(0)||array_to_string(list_sort(list(c||':'||h)),chr(0))) AS h FROM t3 GROUP BY a,b),
t1 AS (SELECT a, sha256(a||chr(0)||array_to_string(list_sort(list(b||':'||h)),chr(0))) AS h FROM t2 GROUP BY a),
t0 AS (SELECT sha256('.'||chr(0)||array_to_string(list_sort(list(a||':'||h)),chr(0))) AS h FROM t1)
SELECT c AS node_id, h AS node_hash FROM t3 UNION ALL SELECT b, h FROM t2 UNION ALL SELECT a, h FROM t1 UNION ALL SELECT '.', h FROM t0""")
def tree_rollup_orders(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n, r = (table(spark, sf, x) for x in ("orders", "customer", "nation", "region"))
    path = F.concat_ws("/", "r_name", "n_name", F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    leaf = rows.select(F.lit("all").alias("repo"), path.alias("path"), F.md5(F.concat(F.col("o_orderkey").cast("string"), "o_orderstatus").cast("binary")).alias("blob_sha"))
    return tree.node_hashes(leaf).where("kind <> 'leaf'").select("node_id", "node_hash")


@query("WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE doc_id%6=0) SELECT source, string_agg('failed '||CAST(doc_id AS VARCHAR), ',' ORDER BY k) AS errors, count(*) AS n_errors FROM r WHERE k<=10 GROUP BY source")
def error_head(spark: SparkSession, sf: str) -> DataFrame:
    error = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("failed "), F.col("doc_id").cast("string")))
    return reports.error_head(table(spark, sf, "documents").select("source", "doc_id", error.alias("error")), "source", "doc_id", "error")


@query("""WITH l AS (SELECT p_partkey AS i FROM part), s AS (SELECT i, i%5 AS k FROM l)
SELECT DISTINCT path, change FROM (SELECT 'f'||CAST(i AS VARCHAR)||'.py' AS path, CASE WHEN k=1 THEN 'deleted' ELSE 'changed' END AS change FROM s WHERE k<>4
 UNION ALL SELECT 'old'||CAST(i AS VARCHAR)||'.py', 'deleted' FROM s WHERE k=4 UNION ALL SELECT 'new'||CAST(i AS VARCHAR)||'.py', 'changed' FROM s WHERE k=4)""")
def name_status_parse(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("A", "D", "M", "T", "R100"))), (i % 5 + 1).cast("int"))
    name = i.cast("string")
    line = F.when(i % 5 == 4, F.concat(kind, F.lit("\told"), name, F.lit(".py\tnew"), name, F.lit(".py"))).otherwise(F.concat(kind, F.lit("\tf"), name, F.lit(".py")))
    return d.name_status(table(spark, sf, "part").select(line.alias("line")))


@query("SELECT l_suppkey AS source, l_partkey AS target, count(*) AS n FROM lineitem GROUP BY ALL")
def dependency_edges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).agg(F.count("*").alias("n"))


@query("SELECT region, round(100*a/t,6) AS pct FROM (SELECT o_orderstatus AS region, sum(CASE WHEN o_totalprice>100000 THEN 1 ELSE 0 END)::DOUBLE AS a, count(*) AS t FROM orders GROUP BY 1)")
def progress(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("region")).agg(F.count_if(F.col("o_totalprice") > 100000).alias("a"), F.count("*").alias("t"))
    return g.select("region", F.round(text.percent(F.col("a"), F.col("t")), 6).alias("pct"))


@query("SELECT event_id, CASE WHEN length(props)>8 THEN left(props,8)||'...' ELSE props END AS clipped, '```json'||chr(10)||props||chr(10)||'```' AS fenced FROM events")
def text_filters(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", text.clip(F.col("props"), 8).alias("clipped"), text.fence(F.col("props"), "json").alias("fenced"))


@query("WITH v AS (SELECT user_id, event_id, ts, value FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM v) SELECT user_id, event_id, value FROM r WHERE n=1")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    from .sources.state import latest

    return latest(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by hour from a stream of the table that ends with what has arrived."""
    import uuid

    from .sources.state import shared_dir

    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")  # a pattern: a file or a folder
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    counts = stream.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
    q = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/counts")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/counts")


def _verilog(spark: SparkSession, sf: str) -> DataFrame:
    """Source text made of part's columns."""
    i, n = F.col("p_partkey"), F.col("p_size")
    code = F.format_string(
        "// part %d, no endmodule here\nmodule m%d #(parameter W = %d) (input wire [W-1:0] a, b, output reg signed [2*W-1:0] y);\n  assign z = a;\n  always @(posedge a) y <= %s;\n  sub%d #(.W(W)) u_%d (a, b);\nendmodule\n",
        i, i, n, F.when(i % 2 == 0, "a * b").otherwise("a + b[2*W-1]"), n, i,
    )
    return corpus.dealt(table(spark, sf, "part").select("p_partkey", "p_size")).select(i.alias("id"), code.alias("code"))


@query("""SELECT p_partkey AS id, 'm'||CAST(p_partkey AS VARCHAR) AS module, 1 AS always_blocks, 1 AS assigns, p_partkey%2=0 AS infers_multiplier,
 'module m'||CAST(p_partkey AS VARCHAR)||' | params: W='||CAST(p_size AS VARCHAR)||' | ports: input [W-1:0] a, input b, output [2*W-1:0] y | instances: u_'||CAST(p_partkey AS VARCHAR)||':sub'||CAST(p_size AS VARCHAR)
 ||' | always=1 | infers_multiplier='||CASE WHEN p_partkey%2=0 THEN 'True' ELSE 'False' END AS summary FROM part""")
def verilog_modules(spark: SparkSession, sf: str) -> DataFrame:
    m = extract.extract_modules(_verilog(spark, sf))
    return m.select("id", "module", "always_blocks", "assigns", "infers_multiplier", extract.summary_line(m).alias("summary"))


@query("""SELECT p_partkey AS id, 'm'||CAST(p_partkey AS VARCHAR) AS module, unnest(['a','b','y']) AS name, unnest(['input','input','output']) AS direction, unnest(['wire','','reg']) AS net_type, unnest([false,false,true]) AS signed, unnest(['[W-1:0]','','[2*W-1:0]']) AS width FROM part""")
def verilog_ports(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract_modules(_verilog(spark, sf)).select("id", "module", F.explode("ports").alias("p")).select("id", "module", "p.*")


@query("""SELECT p_partkey AS id, 'module' AS type, 'm'||CAST(p_partkey AS VARCHAR) AS name, NULL AS direction, NULL AS module, 3 AS n_ports, 1 AS n_parameters, 1 AS n_instances FROM part UNION ALL
SELECT p_partkey, 'port', unnest(['a','b','y']), unnest(['input','input','output']), 'm'||CAST(p_partkey AS VARCHAR), NULL, NULL, NULL FROM part""")
def verilog_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return extract.symbols(extract.extract_modules(_verilog(spark, sf)))


@query("SELECT p_partkey AS id, p_partkey%2=0 AS infers_multiplier, 1 AS always_blocks, 1 AS assigns FROM part")
def verilog_multiplier(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract_modules(_verilog(spark, sf)).select("id", "infers_multiplier", "always_blocks", "assigns")


@query("SELECT o_orderkey, o_orderstatus='O' AND o_orderkey%3=0 AND o_orderkey%5<>0 AS mergeable FROM orders")
def pr_mergeable(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("o_orderkey")
    state, can, merged = F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed"), F.when(i % 3 == 0, True).when(i % 3 == 1, False), F.when(i % 5 == 0, True).when(i % 5 == 1, False)
    return table(spark, sf, "orders").select("o_orderkey", text.mergeable(state, can, merged).alias("mergeable"))


@query("SELECT doc_id, sha256(text) IS DISTINCT FROM CASE doc_id%3 WHEN 0 THEN sha256(text) WHEN 1 THEN sha256(text||'x') END AS changed FROM documents")
def text_changed(spark: SparkSession, sf: str) -> DataFrame:
    i, t = F.col("doc_id"), F.col("text")
    return table(spark, sf, "documents").select("doc_id", hashing.has_changed(t, F.when(i % 3 == 0, F.sha2(t, 256)).when(i % 3 == 1, F.sha2(F.concat(t, F.lit("x")), 256))).alias("changed"))


@query("SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey%2=1 THEN 'host' END, CASE WHEN c_custkey%3=0 THEN 'port' END, CASE WHEN c_custkey%5<>0 THEN 'database' END) AS missing FROM customer")
def form_fields(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("c_custkey")
    body = F.create_map(F.lit("host"), F.when(i % 2 == 0, "h").otherwise(""), F.lit("port"), F.when(i % 3 != 0, "1"), F.when(i % 5 == 0, "database").otherwise("other"), F.lit("d"))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(text.missing_fields(body, ("host", "port", "database")), ",").alias("missing"))


@query("SELECT doc_id, doc_id%4<2 AS refused FROM documents")
def clone_errors(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    error = F.when(i % 4 == 0, F.concat(F.lit("fatal: Authentication failed for "), "source")).when(i % 4 == 1, "ERROR: Repository not found.").when(i % 4 == 2, "timed out")
    return table(spark, sf, "documents").select("doc_id", text.is_refused(error).alias("refused"))


@query(f"WITH {_EV} SELECT event_id, CASE type WHEN 'push' THEN 'a'||CAST(k AS VARCHAR) WHEN 'pull_request' THEN 'h'||CAST(k AS VARCHAR) END AS sha FROM e")
def commit_ids(spark: SparkSession, sf: str) -> DataFrame:
    load = F.format_string('{"after":"a%d","pull_request":{"head":{"sha":"h%d"}}}', F.col("k"), F.col("k"))
    return _events(spark, sf).select("event_id", ev.commit_sha(F.col("type"), load).alias("sha"))


@query(f"WITH {_SNAPS}, {_DIFF} SELECT repo, CASE WHEN stale THEN 'regenerated' ELSE 'reused' END AS outcome, count(*) AS n FROM diff WHERE NOT deleted GROUP BY ALL")
def outcome_totals(spark: SparkSession, sf: str) -> DataFrame:
    return reports.outcome_counts(leaf_refresh(spark, sf))


@query("SELECT o_orderkey, CASE WHEN o_orderkey%3=0 THEN 'new' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey%2=0 OR o_orderkey%3=0")
def upsert_rows(spark: SparkSession, sf: str) -> DataFrame:
    from .sources.state import upsert

    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return upsert(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 3 = 0").withColumn("status", F.lit("new")), ["o_orderkey"])


@query(f"WITH {_SNAPS}, live AS ({_UP('cur')}) SELECT repo, path||'.md' AS target FROM cur UNION ALL SELECT repo, CASE node_id WHEN '.' THEN '__project__.md' ELSE node_id||'/__folder__.md' END FROM live")
def export_paths(spark: SparkSession, sf: str) -> DataFrame:
    cur = _both(spark, sf)[0]
    leaf = cur.select("repo", F.col("path").alias("node_id"), F.lit("leaf").alias("kind"))
    rows = leaf.unionByName(tree.live_nodes(cur).select("repo", "node_id", F.lit("folder").alias("kind")))
    return rows.select("repo", paths.export_path(F.col("node_id"), F.col("kind")).alias("target"))


@query(f"WITH {_SNAPS}, {_DIFF} SELECT 'unknown' AS base, repo, path, sha AS current_sha, NULL AS recorded_sha, true AS stale, false AS deleted FROM cur UNION ALL SELECT 'known', * FROM diff")
def diff_from_base(spark: SparkSession, sf: str) -> DataFrame:
    cur, prev = _both(spark, sf)
    history = spark.createDataFrame([("c1",), ("c2",)], "sha string")
    return d.since(cur, prev, "c9", history).withColumn("base", F.lit("unknown")).unionByName(d.since(cur, prev, "c1", history).withColumn("base", F.lit("known")))


@query(f"WITH {_SNAPS}, {_DIFF} SELECT repo, path FROM diff WHERE deleted UNION SELECT repo, path FROM prev WHERE path LIKE '%.md'")
def deleted_history(spark: SparkSession, sf: str) -> DataFrame:
    cur, prev = _both(spark, sf)
    return d.snapshot_diff(cur, prev).where("deleted").select("repo", "path").union(prev.where(F.endswith("path", F.lit(".md"))).select("repo", "path")).distinct()


@query("SELECT doc_id, CASE doc_id%4 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN NULL ELSE 'verilog' END AS processor, doc_id%5<>0 AND strlen(text)<=600 AS readable, CASE WHEN doc_id%3=0 THEN 'second' ELSE 'first' END AS provider FROM documents")
def processor_lookup(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    lang = F.when(i % 4 == 0, "Python").when(i % 4 == 1, "TypeScript").when(i % 4 == 2, "markdown").otherwise("VERILOG")
    named = F.when(i % 3 == 0, "second").when(i % 3 == 1, "unknown")
    size = F.when(i % 5 != 0, F.octet_length("text"))
    return table(spark, sf, "documents").select("doc_id", lookup.processor(lang).alias("processor"), lookup.readable(size, 600).alias("readable"), lookup.route(named, ("first", "second")).alias("provider"))


@query("SELECT event_id, event_id%12>5 AS fresh, event_id+60*least(event_id%20, 10) AS ends FROM events")
def token_times(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    expires = F.col("ts") + F.make_dt_interval(mins=(i % 12).cast("int"))
    return table(spark, sf, "events").select("event_id", text.fresh(expires, F.col("ts")).alias("fresh"), text.expiry(i, i % 20).alias("ends"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey=3 ORDER BY s_suppkey LIMIT 1")
def status_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.first_match(table(spark, sf, "supplier"), F.col("s_nationkey") == 3, "s_suppkey").select("s_suppkey", "s_name")


@query("SELECT c_custkey, s.s_name FROM customer LEFT JOIN (SELECT s_nationkey, arg_min(s_name, s_suppkey) AS s_name FROM supplier GROUP BY 1) s ON c_nationkey=s_nationkey")
def installation_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("s_nationkey"))
    return lookup.join_first(rows, table(spark, sf, "supplier"), "s_nationkey", "s_suppkey", "s_name").select("c_custkey", "s_name")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_custkey<3)")
def registered_only(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return rows.join(rows.where("c_custkey < 3").select("c_mktsegment"), "c_mktsegment", "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, greatest(0.0::DOUBLE, 100000.0::DOUBLE-CAST(o_totalprice AS DOUBLE)) AS remaining FROM orders")
def budget_remaining(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", budget.remaining(F.col("o_totalprice").cast("double"), 100000.0).alias("remaining"))


@query("""SELECT doc_id, source||'__'||lang AS name, '{"lang":"'||lang||'","n":'||CAST(n_chars AS VARCHAR)||',"source":"'||source||'"}' AS state FROM documents""")
def stored_names(spark: SparkSession, sf: str) -> DataFrame:
    own = F.to_json(F.struct("lang", F.col("n_chars").alias("n"), "source"))
    return table(spark, sf, "documents").select("doc_id", text.safe_name(F.concat_ws("/", "source", "lang")).alias("name"), own.alias("state"))


@query(f"WITH {_SNAPS} SELECT repo, path, CAST(row_number() OVER (PARTITION BY repo ORDER BY split_part(path,'/',1), split_part(path,'/',2), split_part(path,'/',3)) AS INT) AS n FROM cur")
def sorted_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths in the order of their parts, which is not that of the strings."""
    from pyspark.sql import Window

    return _both(spark, sf)[0].select("repo", "path", F.row_number().over(Window.partitionBy("repo").orderBy(F.split("path", "/"))).alias("n"))


@query("""SELECT p_partkey, CASE WHEN p_partkey%2=0 THEN 'Write all documents' ELSE 'Fix Size '||CAST(p_size AS VARCHAR) END AS title, '# '||p_brand||chr(10)||'size '||CAST(p_size AS VARCHAR) AS body FROM part""")
def pr_texts(spark: SparkSession, sf: str) -> DataFrame:
    task = F.when(F.col("p_partkey") % 2 == 0, "all_docs").otherwise(F.concat(F.lit("fix_size_"), F.col("p_size").cast("string")))
    body = text.fill("# {{ brand }}\nsize {{ size }}", {"brand": F.col("p_brand"), "size": F.col("p_size")})
    return table(spark, sf, "part").select("p_partkey", text.task_label(task, {"all_docs": "Write all documents"}).alias("title"), body.alias("body"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])the[^a-z0-9]+thing([^a-z0-9]|$)')")
def phrase_search(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(search.phrase("The thing", "text")).select("doc_id")


@query(_search_sql(("thing",), "SELECT id, round(rank,6) AS rank FROM k ORDER BY k.rank, id LIMIT 50"))
def repo_search(spark: SparkSession, sf: str) -> DataFrame:
    """The first 50 rows of a search."""
    return search.page(_ranked(spark, sf, "thing"), limit=50).select("id", F.round("rank", 6).alias("rank"))


@query(_search_sql(("the", "thing"), "SELECT id, round(rank,6) AS rank FROM k"))
def bm25_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """A search by a written index."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.left("text", F.lit(60)).alias("summary"), F.col("text").alias("content"))
    return search.lookup(*search.index(docs), "the thing").withColumn("rank", F.round("rank", 6))


@query(f"""WITH {_SNAPS}, {_DIFF}, {_PLAN}, work AS (SELECT repo, id, action, phase, row_number() OVER (PARTITION BY repo ORDER BY phase,
 (CASE WHEN phase=2 THEN (CASE WHEN id='.' THEN -1 ELSE length(id)-length(replace(id,'/','')) END) ELSE 0 END) DESC, CASE WHEN phase=1 THEN id END, id DESC) AS ord FROM plan WHERE action<>'delete')
SELECT repo, id, action, phase, CAST(ord AS INT) AS ord, CAST(0.25*ord AS DOUBLE) AS running, 0.25*ord<=9 AS admitted FROM work
UNION ALL SELECT repo, id, action, phase, NULL, NULL, true FROM plan WHERE action='delete'""")
def run_outlook(spark: SparkSession, sf: str) -> DataFrame:
    """What a run would do under a ceiling for each repository."""
    todo = p.refresh_plan(*_both(spark, sf))
    return jobs.planned(todo, 9.0, 0.25, ("repo",)).select("repo", "id", "action", "phase", F.col("ord").cast("int").alias("ord"), "running", "admitted")


@query(f"""WITH {_EV}, g AS (SELECT repo, ts, CASE type WHEN 'push' THEN 'a'||CAST(event_id AS VARCHAR) ELSE 'h'||CAST(event_id AS VARCHAR) END AS sha FROM e WHERE enabled
 AND (type='push' AND (NOT starts_with(ref,'refs/heads/') OR ref='refs/heads/main') OR type='pull_request' AND action IN ('opened','synchronize') AND base='main'))
SELECT repo, max(ts) AS ts, arg_max(sha, (ts, sha)) AS sha FROM g GROUP BY repo""")
def event_work(spark: SparkSession, sf: str) -> DataFrame:
    """The commits that events ask to be documented."""
    i = F.col("event_id")
    head = F.struct(F.struct(F.concat(F.lit("h"), i).alias("sha")).alias("head"), F.struct(F.col("base").alias("ref")).alias("base"))
    load = F.to_json(F.struct(F.concat(F.lit("a"), i).alias("after"), "ref", "action", head.alias("pull_request")))
    return jobs.wanted(_events(spark, sf).withColumn("payload", load), F.array(F.lit("main")), F.lit("docs"))


@query("""SELECT s_suppkey, CASE s_suppkey%3 WHEN 0 THEN 'healthy' WHEN 1 THEN 'unhealthy' ELSE 'disabled' END AS state, CASE WHEN s_suppkey%4=0 OR s_suppkey%5=0 THEN 'Free' ELSE printf('$%.4f/1K tokens', s_suppkey%4*0.25) END AS cost,
 CASE WHEN s_suppkey%2=0 THEN 'Private Repository Access' ELSE 'Processing Error' END AS title FROM supplier""")
def provider_labels(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("s_suppkey")
    error = F.when(i % 2 == 0, "this is a Private repository").when(i % 3 == 0, "timed out")
    return table(spark, sf, "supplier").select(
        "s_suppkey", text.provider_state(i % 3 == 0, i % 3 == 1).alias("state"), text.cost_label(F.when(i % 5 != 0, (i % 4 * 0.25).cast("double"))).alias("cost"), text.error_title(error).alias("title")
    )


@query(f"WITH {_SNAPS} SELECT repo, count(*) FILTER (path LIKE '%.py' OR path LIKE '%.js') AS total_files FROM cur GROUP BY repo")
def fallback_count(spark: SparkSession, sf: str) -> DataFrame:
    """Files of the suffixes that are counted where no analysis is at hand, whatever their size."""
    known = paths.language(paths.suffix(F.col("path")), paths.COUNTED) != "unknown"
    return _both(spark, sf)[0].groupBy("repo").agg(F.count_if(known).alias("total_files"))


@query("""WITH e AS (SELECT 'repo'||CAST(user_id%20 AS VARCHAR) AS repo, ts, event_id, CASE event_type WHEN 'click' THEN 'commit' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' END AS kind, 'a'||CAST(event_id AS VARCHAR) AS sha FROM events),
k AS (SELECT * FROM e WHERE kind IS NOT NULL), r AS (SELECT repo, max(ts) AS rts, arg_max(kind, (ts, kind)) AS result FROM k WHERE kind<>'commit' GROUP BY repo),
c AS (SELECT k.repo, max(k.ts) AS ts, arg_max(sha, (k.ts, sha)) AS sha, count(*) FILTER (rts IS NULL OR k.ts>rts) AS pending FROM k LEFT JOIN r USING (repo) WHERE kind='commit' GROUP BY k.repo),
n AS (SELECT repo, count(*) AS seen FROM k GROUP BY repo)
SELECT n.repo, n.seen, c.sha, coalesce(c.pending,0) AS pending, CASE WHEN c.pending>0 THEN 'pending' ELSE coalesce(r.result,'idle') END AS status FROM n LEFT JOIN c USING (repo) LEFT JOIN r USING (repo)""")
def repository_state(spark: SparkSession, sf: str) -> DataFrame:
    """Each repository's state after a stream of commits and of results of runs."""
    import uuid

    from .sources.state import shared_dir
    from .streaming import repositories

    out = f"{shared_dir(spark)}/repositories-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")  # a pattern: a file or a folder
    t = F.col("event_type")
    kind = F.when(t == "click", "commit").when(t == "purchase", "done").when(t == "error", "failed")
    rows = stream.select(F.concat(F.lit("repo"), (F.col("user_id") % 20).cast("string")).alias("repo"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("sha"))
    repositories.track(rows.where("kind IS NOT NULL"), f"{out}/states", f"{out}/state").awaitTermination()
    return repositories.states(spark, f"{out}/states").select("repo", "seen", "sha", "pending", "status")


@query("""SELECT 1 AS version, o_orderkey, o_orderstatus AS status FROM orders WHERE o_orderkey%2=0 UNION ALL
SELECT 2, o_orderkey, CASE WHEN o_orderkey%6=0 THEN 'new' ELSE o_orderstatus END FROM orders WHERE o_orderkey%10<>0 AND (o_orderkey%2=0 OR o_orderkey%3=0)""")
def stored_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A table at two versions of a store that keeps what changed."""
    import uuid

    from .sources.state import Store, shared_dir

    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    store.commit({"orders": rows.where("o_orderkey % 2 = 0")}, "c1")
    after = rows.where("o_orderkey % 10 <> 0 AND (o_orderkey % 2 = 0 OR o_orderkey % 3 = 0)")
    store.commit({"orders": after.withColumn("status", F.when(F.col("o_orderkey") % 6 == 0, "new").otherwise(F.col("status")))}, "c2")
    at = lambda v: store.read("orders", "o_orderkey bigint, status string", version=v).withColumn("version", F.lit(v))
    return at(1).unionByName(at(2))


def _json(kind: str, h: str, node: str, kids: str = "''") -> str:
    return f"""'{{"children":['||{kids}||'],"kind":"{kind}","node_hash":"'||{h}||'","node_id":"'||{node}||'"}}'"""


_TREE_DOCS = f"""x3 AS (SELECT repo, path, regexp_replace(path,'/[^/]*$','') AS node_id, {_json('leaf', 'sha', 'path')} AS doc FROM cur),
x2 AS (SELECT n2.repo, n2.node_id, split_part(n2.node_id,'/',1) AS top, {_json('folder', 'any_value(n2.h)', 'n2.node_id', "string_agg(x3.doc, ',' ORDER BY x3.path)")} AS doc FROM n2 JOIN x3 ON x3.repo=n2.repo AND x3.node_id=n2.node_id GROUP BY n2.repo, n2.node_id),
x1 AS (SELECT n1.repo, n1.top, {_json('folder', 'any_value(n1.h)', 'n1.top', "string_agg(x2.doc, ',' ORDER BY x2.node_id)")} AS doc FROM n1 JOIN x2 ON x2.repo=n1.repo AND x2.top=n1.top GROUP BY n1.repo, n1.top),
x0 AS (SELECT n0.repo, {_json('project', 'any_value(n0.h)', "'.'", "string_agg(x1.doc, ',' ORDER BY x1.top)")} AS doc FROM n0 JOIN x1 ON x1.repo=n0.repo GROUP BY n0.repo)"""


@query(f"WITH {_SNAPS}, {_LEVELS('cur', 'n')}, {_TREE_DOCS} SELECT repo, doc FROM x0")
def tree_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Each repository's tree as one nested document."""
    return tree.to_documents(tree.node_hashes(_both(spark, sf)[0]))


@query(f"WITH {_SNAPS}, {_LEVELS('cur', 'n')} SELECT repo, node_id, kind, node_hash FROM n UNION ALL SELECT repo, path, 'leaf', sha FROM cur")
def tree_flattened(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of nested trees."""
    return tree.from_documents(tree.to_documents(tree.node_hashes(_both(spark, sf)[0]))).select("repo", "node_id", "kind", "node_hash")


@query(f"WITH {_SNAPS}, {_LEVELS('cur', 'n')}, w AS (SELECT * FROM n UNION ALL SELECT repo, path, 2, 'leaf', sha FROM cur), q AS (SELECT repo, path AS node_id FROM cur WHERE path LIKE '%.py' UNION SELECT repo, split_part(path,'/',1) FROM cur UNION SELECT repo, '.' FROM cur UNION SELECT repo, path||'x' FROM cur) SELECT q.repo, q.node_id, w.kind, w.node_hash FROM q JOIN w ON w.repo=q.repo AND w.node_id=q.node_id")
def tree_find(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes looked up by path in nested trees, some of which are not there."""
    cur = _both(spark, sf)[0]
    pick = lambda c: cur.select("repo", c.alias("node_id"))
    path = F.col("path")
    want = pick(path).where(F.endswith("node_id", F.lit(".py"))).union(pick(F.split(path, "/")[0])).union(pick(F.lit("."))).union(pick(F.concat(path, F.lit("x"))))
    return tree.find(tree.to_documents(tree.node_hashes(cur)), want)


_TOKENS = "t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x<>'') AS ws FROM documents), p AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS at FROM t)"


def _postings(spark: SparkSession, sf: str) -> DataFrame:
    return search.postings(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "text")


@query(f"WITH {_TOKENS} SELECT a.id, a.at-1 AS at FROM p a JOIN p b ON a.id=b.id AND b.at=a.at+1 WHERE a.w='the' AND b.w='thing'")
def phrase_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Places of a phrase, by postings."""
    return search.with_phrase(_postings(spark, sf), "The thing").select("id", F.explode(F.col("at").cast("array<bigint>")).alias("at"))


@query(f"WITH {_TOKENS} SELECT DISTINCT a.id FROM p a JOIN p b ON a.id=b.id AND abs(a.at-b.at)<=4 JOIN p c ON c.id=a.id AND abs(a.at-c.at)<=4 AND abs(b.at-c.at)<=4 WHERE a.w='thing' AND b.w='of' AND c.w='the'")
def near_search(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with three words near one another."""
    return search.with_near(_postings(spark, sf), "thing of the", within=2).select("id")


@query(f"WITH {_TOKENS} SELECT id, count(*) AS n FROM p WHERE starts_with(w,'thi') GROUP BY id")
def prefix_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.with_term(_postings(spark, sf), "thi*").select("id", F.size("at").cast("bigint").alias("n"))


@query(f"WITH {_TOKENS} SELECT id FROM t WHERE (list_contains(ws,'la') AND list_contains(ws,'de') OR contains(' '||array_to_string(ws,' ')||' ', ' of the ')) AND len(list_filter(ws, lambda x: starts_with(x,'que')))=0")
def boolean_search(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with two words or a phrase, and without any word of a prefix."""
    index = _postings(spark, sf)
    some = search.any_of(search.all_of(search.with_term(index, "la"), search.with_term(index, "de")), search.with_phrase(index, "of the"))
    return search.without(some, search.with_term(index, "que*"))


def _history(spark: SparkSession, sf: str) -> DataFrame:
    """A graph of commits made of customers: each has one parent, every fifth another."""
    i = F.col("c_custkey")
    up = F.array_compact(F.array(F.when(i > 1, F.floor(i / 2)), F.when(i % 5 == 0, i - 1)))
    name = lambda c: F.concat(F.lit("k"), c.cast("string"))
    return table(spark, sf, "customer").select(name(i).alias("sha"), F.explode(up).alias("p")).select("sha", name(F.col("p")).alias("parent"))


_GRAPH = "g AS (SELECT 'k'||CAST(c_custkey AS VARCHAR) AS sha, 'k'||CAST(c_custkey//2 AS VARCHAR) AS parent FROM customer WHERE c_custkey>1 UNION ALL SELECT 'k'||CAST(c_custkey AS VARCHAR), 'k'||CAST(c_custkey-1 AS VARCHAR) FROM customer WHERE c_custkey%5=0)"
_REACH = "r AS (SELECT sha AS start, sha, 0 AS d FROM s UNION SELECT r.start, g.parent, r.d+1 FROM r JOIN g ON r.sha=g.sha)"


@query(f"WITH RECURSIVE {_GRAPH}, s AS (SELECT 'k'||CAST(c_custkey AS VARCHAR) AS sha FROM customer WHERE c_custkey%29=0), {_REACH} SELECT start, sha, min(d) AS distance FROM r GROUP BY start, sha")
def commit_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    """What some commits lead to, and over how many steps."""
    from .operators import history

    name = F.concat(F.lit("k"), F.col("c_custkey").cast("string"))
    heads = table(spark, sf, "customer").where("c_custkey % 29 = 0").select(name.alias("start"), name.alias("sha"))
    return history.ancestors(_history(spark, sf), heads)


@query(f"WITH RECURSIVE {_GRAPH}, q AS (SELECT 'k'||CAST(c_custkey AS VARCHAR) AS head, 'k'||CAST(c_custkey//4+c_nationkey%2 AS VARCHAR) AS base FROM customer WHERE c_custkey%7=0), s AS (SELECT DISTINCT head AS sha FROM q), {_REACH} SELECT q.base, q.head, EXISTS (SELECT 1 FROM r WHERE r.start=q.head AND r.sha=q.base) AS known FROM q")
def commit_known(spark: SparkSession, sf: str) -> DataFrame:
    """Whether commits are ancestors of others."""
    from .operators import history

    i, name = F.col("c_custkey"), lambda c: F.concat(F.lit("k"), c.cast("string"))
    pairs = table(spark, sf, "customer").where("c_custkey % 7 = 0").select(name(F.floor(i / 4) + F.col("c_nationkey") % 2).alias("base"), name(i).alias("head"))
    return history.is_ancestor(_history(spark, sf), pairs)


@query(f"""WITH RECURSIVE {_GRAPH}, s AS (SELECT 'k149' AS sha UNION ALL SELECT 'k18'), {_REACH}, n AS (SELECT start, sha, min(d) AS d FROM r GROUP BY start, sha),
own AS (SELECT sha, d FROM n WHERE start='k149' AND sha NOT IN (SELECT sha FROM n WHERE start='k18')), c AS (SELECT 'k'||CAST(c_custkey AS VARCHAR) AS sha, c_custkey AS i, c_nationkey%4 AS f FROM customer),
l AS (SELECT sha, 'f'||CAST(f AS VARCHAR)||'.py' AS path, CASE WHEN i%3=0 THEN 'deleted' ELSE 'changed' END AS change FROM c WHERE i%4<>0 UNION ALL SELECT sha, 'f'||CAST(f AS VARCHAR)||'.py', 'deleted' FROM c WHERE i%4=0 UNION ALL SELECT sha, 'g'||CAST(f AS VARCHAR)||'.py', 'changed' FROM c WHERE i%4=0)
SELECT path, arg_min(change, (d, change)) AS change FROM l JOIN own USING (sha) GROUP BY path""")
def commit_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What the commits between two of them change, from their listings."""
    from .operators import history

    i, f = F.col("c_custkey"), (F.col("c_nationkey") % 4).cast("string")
    file = lambda head: F.concat(F.lit(head), f, F.lit(".py"))
    line = F.when(i % 4 == 0, F.concat_ws("\t", F.lit("R090"), file("f"), file("g"))).when(i % 3 == 0, F.concat_ws("\t", F.lit("D"), file("f"))).otherwise(F.concat_ws("\t", F.lit("M"), file("f")))
    lines = table(spark, sf, "customer").select(F.concat(F.lit("k"), i.cast("string")).alias("sha"), line.alias("line"))
    return history.between(_history(spark, sf), lines, "k18", "k149")


@query(f"""WITH {_SNAPS}, {_DIFF}, a AS (SELECT repo, path, 'U['||path||']'||CAST(length(text) AS VARCHAR) AS doc FROM fp), b AS (SELECT repo, path, 'U['||path||']'||CAST(length(text) AS VARCHAR) AS doc, length(text)%3=0 AS bad FROM fc)
SELECT d.repo, d.path, CASE WHEN d.stale AND NOT b.bad THEN b.doc ELSE a.doc END AS doc FROM diff d JOIN b ON b.repo=d.repo AND b.path=d.path LEFT JOIN a ON a.repo=d.repo AND a.path=d.path WHERE NOT (d.stale AND b.bad AND a.doc IS NULL)""")
def failed_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Documents after a run in which some edits fail: those keep their last good document."""
    import uuid

    from .plans import run as r
    from .sources.state import Store, shared_dir

    def generator(path: str, text: str) -> str:
        if len(text) % 3 == 0:
            raise ValueError("refused")
        return f"U[{path}]{len(text)}"

    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    syn = lambda n, kids: F.sha2(F.array_join(F.transform(kids, lambda k: k["doc"]), "\n"), 256)
    own = lambda df: df.select("repo", "path", "text")
    r.run(store, own(corpus.previous_files(spark, sf)), "c1", F.concat(F.lit("U["), F.col("path"), F.lit("]"), F.length("text").cast("string")), syn)
    r.run(store, own(corpus.current_files(spark, sf)), "c2", generator, syn)
    return store.read("unit_doc", r.DOC)


@query(f"""WITH {_SNAPS}, {_DIFF}, {_PLAN}, work AS (SELECT repo, id, phase, row_number() OVER (PARTITION BY repo ORDER BY phase,
 (CASE WHEN phase=2 THEN (CASE WHEN id='.' THEN -1 ELSE length(id)-length(replace(id,'/','')) END) ELSE 0 END) DESC, CASE WHEN phase=1 THEN id END, id DESC) AS ord FROM plan WHERE action<>'delete'),
k AS (SELECT *, row_number() OVER (ORDER BY phase, repo, ord) AS n FROM work) SELECT repo, id, phase, CAST(ord AS INT) AS ord, 0.25::DOUBLE*n AS running, 0.25*n<=20 AS admitted FROM k""")
def budget_total(spark: SparkSession, sf: str) -> DataFrame:
    """One ceiling over the work of all repositories."""
    work = p.in_order(p.refresh_plan(*_both(spark, sf))).withColumn("cost", F.lit(0.25))
    return budget.admit_all(work, "cost", 20.0, ("phase", "repo", "ord")).select("repo", "id", "phase", F.col("ord").cast("int").alias("ord"), "running", "admitted")


@query(f"WITH {_SNAPS}, {_LEVELS('cur', 'n')} SELECT repo, CASE WHEN repo='en' THEN h ELSE sha256('.') END AS node_hash FROM n0")
def bare_roots(spark: SparkSession, sf: str) -> DataFrame:
    """Roots of repositories, all but one of which have lost their leaves."""
    cur = _both(spark, sf)[0]
    return tree.node_hashes(cur.where("repo = 'en'"), cur.select("repo")).where("node_id = '.'").select("repo", "node_hash")


@query(_search_sql(("la", "de"), "SELECT id, round(rank,6) AS rank FROM k JOIN documents d ON d.doc_id=k.id WHERE d.lang='es' AND d.source IN ('src1','src2','src3','src4','src5') AND d.n_chars<5000"))
def filtered_page(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of three conditions, ranked among themselves by the figures of all."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.left("text", F.lit(60)).alias("summary"), F.col("text").alias("content"), "lang", "n_chars")
    only = (F.col("lang") == "es") & F.col("name").isin("src1", "src2", "src3", "src4", "src5") & (F.col("n_chars") < 5000)
    return search.bm25(docs, "la de", only=only).withColumn("rank", F.round("rank", 6))


@query("SELECT p_partkey AS id, 'm'||CAST(p_partkey AS VARCHAR) AS module, p_partkey%2=0 AS infers_multiplier, 3 AS n_ports FROM part")
def lateral_modules(spark: SparkSession, sf: str) -> DataFrame:
    """Modules of source text, by a table function in SQL."""
    from .operators import processors

    processors.register(spark)
    _verilog(spark, sf).createOrReplaceTempView("heartwood_source")
    return spark.sql("SELECT s.id, m.module, m.infers_multiplier, CAST(size(m.ports) AS INT) AS n_ports FROM heartwood_source s, LATERAL modules(s.code) m")


@query("SELECT p_partkey AS id, 'module' AS type, 'm'||CAST(p_partkey AS VARCHAR) AS name FROM part WHERE p_partkey%3<>1 UNION ALL SELECT p_partkey, 'port', unnest(['a','b','y']) FROM part WHERE p_partkey%3<>1")
def processed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols of files, each by the processor of its language; some languages have none."""
    from .operators import processors

    language = F.when(F.col("id") % 3 == 0, "Verilog").when(F.col("id") % 3 == 1, "markdown").otherwise("VERILOG")
    return processors.processed(_verilog(spark, sf).withColumn("language", language)).select("id", "type", "name")


@query("""SELECT conv_id, '# '||CAST(conv_id AS VARCHAR)||chr(10)||string_agg(CAST(n AS VARCHAR)||'. '||upper(role)||CASE WHEN length(text)>0 THEN ': '||text ELSE ' (empty)' END||chr(10), '' ORDER BY n)||CASE WHEN count(*)>2 THEN 'long' ELSE 'short' END AS page
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id""")
def template_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations by a template with a loop, conditions and a filter."""
    from .functions import templates

    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    page = "# {{ id }}\n{% for t in turns %}{{ loop.index }}. {{ t.role | upper }}{% if t.text %}: {{ t.text }}{% else %} (empty){% endif %}\n{% endfor %}{% if long %}long{% else %}short{% endif %}"
    return turns.select("conv_id", templates.render(page, {"id": F.col("conv_id"), "turns": F.col("turns"), "long": F.size("turns") > 2}).alias("page"))


@query(f"""WITH {_EV}, s AS (SELECT *, user_id FROM e JOIN (SELECT event_id, user_id FROM events) USING (event_id) WHERE event_id%5<3),
g AS (SELECT *, CASE WHEN type NOT IN ('push','pull_request') THEN 'unsupported' WHEN NOT enabled THEN 'disabled'
 WHEN type='push' AND starts_with(ref,'refs/heads/') AND substr(ref,12) NOT IN ('main','docs') THEN 'branch' WHEN type='push' AND ref='refs/heads/docs' THEN 'docs branch'
 WHEN type='pull_request' AND action NOT IN ('opened','synchronize') THEN 'action' WHEN type='pull_request' AND base NOT IN ('main','docs') THEN 'base' ELSE 'process' END AS reason FROM s)
SELECT CASE WHEN event_id%7=0 THEN 'unknown' ELSE 'd'||CAST(event_id AS VARCHAR) END AS delivery_id, coalesce(type,'unknown') AS type, CASE WHEN event_id%4<>0 THEN event_id%9 END AS installation_id, repo, 'u'||CAST(user_id AS VARCHAR) AS sender,
 CASE WHEN type='push' THEN 'c'||CAST(event_id AS VARCHAR) WHEN type='pull_request' THEN 'h'||CAST(event_id AS VARCHAR) END AS sha, reason='process' AS process, reason FROM g""")
def hook_events(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries with headers in any case, some signed wrongly or not at all, from a stream: the signed ones, taken apart and gated."""
    import uuid

    from .sources.state import shared_dir
    from .streaming import hooks

    out, secret = f"{shared_dir(spark)}/hooks-{uuid.uuid4().hex}", "a secret of this query"
    c, i = F.col, F.col("event_id")
    numbered = lambda p: F.concat(F.lit(p), i.cast("string"))
    repo = F.struct(c("repo").alias("full_name"))
    body = F.to_json(F.struct("ref", "action", numbered("c").alias("after"), repo.alias("repository"), F.when(i % 4 != 0, F.struct((i % 9).alias("id"))).alias("installation"), F.struct(F.concat(F.lit("u"), c("user_id").cast("string")).alias("login")).alias("sender"),
                              F.struct(F.struct(c("base").alias("ref")).alias("base"), F.struct(numbered("h").alias("sha")).alias("head")).alias("pull_request")))
    cased = lambda name: F.when(i % 3 == 0, name).when(i % 3 == 1, name.lower()).otherwise(name.upper())
    sent = F.when(i % 5 < 3, hooks.mac(c("body"), secret)).when(i % 5 == 3, hooks.mac(c("body"), "another"))
    given = F.map_filter(F.map_from_arrays(F.array(*map(cased, ("X-GitHub-Event", "X-GitHub-Delivery", "X-Hub-Signature-256"))), F.array("type", F.when(i % 7 != 0, numbered("d")), sent)), lambda k, v: v.isNotNull())
    rows = _events(spark, sf).join(table(spark, sf, "events").select("event_id", "user_id"), "event_id").withColumn("body", body)
    rows.select(given.alias("headers"), "body").write.json(f"{out}/sent")
    events = hooks.gated(hooks.parsed(hooks.verified(hooks.deliveries(spark, f"{out}/sent"), secret)), c("repo") != "repo7", ("main", "docs"))
    events.writeStream.format("parquet").option("path", f"{out}/events").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{out}/events").select("delivery_id", "type", "installation_id", "repo", "sender", "sha", "process", "reason")


@query("""WITH v AS (SELECT 'n'||coalesce(CAST(nation_id AS VARCHAR),'one') AS repo, coalesce(vendor_id,-1) AS i, name FROM vendors), n AS (SELECT repo, 'b'||CAST(i%10 AS VARCHAR) AS b, CAST(i AS VARCHAR) AS i, name FROM v),
d AS (SELECT repo, b||'/v'||i||'.v' AS title, b||'/v'||i||'.v.md' AS f, name AS doc FROM n UNION ALL SELECT repo, b, b||'/__folder__.md', CAST(count(*) AS VARCHAR)||' vendors' FROM n GROUP BY repo, b
 UNION ALL SELECT repo, repo||' — repository overview', '__project__.md', CAST(count(*) AS VARCHAR)||' vendors' FROM n GROUP BY repo),
p AS (SELECT repo||'/'||f AS path, max('# '||title||chr(10)||chr(10)||doc||chr(10)) AS t FROM d WHERE doc IS NOT NULL GROUP BY ALL)
SELECT path, strlen(t) AS length, sha256(t) AS sha FROM p""")
def exported_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of vendors and of their folders, written as files and read back from their folder."""
    import uuid

    from .sources import folders
    from .sources.state import shared_dir

    v = table(spark, sf, "vendors").select(F.concat(F.lit("n"), F.coalesce(F.col("nation_id").cast("string"), F.lit("one"))).alias("repo"), F.coalesce("vendor_id", F.lit(-1)).alias("i"), "name")
    b = F.concat(F.lit("b"), (F.col("i") % 10).cast("string"))
    counted = lambda node: v.groupBy("repo", node.alias("node_id")).agg(F.concat(F.count("*").cast("string"), F.lit(" vendors")).alias("doc")).select("repo", "node_id", F.lit("folder").alias("kind"), "doc")
    leaf = v.select("repo", F.concat(b, F.lit("/v"), F.col("i").cast("string"), F.lit(".v")).alias("node_id"), F.lit("leaf").alias("kind"), F.col("name").alias("doc"))
    target = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    folders.export(folders.pages(leaf.unionByName(counted(b)).unionByName(counted(F.lit(paths.ROOT))), F.col("repo")), target)
    return folders.contents(folders.listing(spark, target), target).select("path", "length", F.sha2("content", 256).alias("sha"))
