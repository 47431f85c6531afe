"""Streaming state, joint runs, tree documents, postings and histories."""

import json
import random

import pytest
from pyspark.sql import functions as F

from heartwood.operators import calls, history, search, tree
from heartwood.plans import jobs, run
from heartwood.sources.state import Store
from heartwood.streaming import repositories

ROWS = "repo string, ts timestamp, kind string, sha string"


def newest(rows):
    """The states, plainly."""
    out = {}
    for repo in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == repo]
        done = max(((r[1], r[2]) for r in own if r[2] != "commit"), default=None)
        commits = {}
        for r in own:
            if r[2] == "commit":
                commits[r[3]] = max(commits.get(r[3], 0), r[1])
        waiting = sum(done is None or t > done[0] for t in commits.values())
        top = max(((t, s) for s, t in commits.items()), default=(None, None))
        out[repo] = (len(own), top[1], "pending" if waiting else done[1] if done else "idle", waiting)
    return out


def feed(spark, folder, rows):
    spark.createDataFrame([(r, s, k, h) for r, s, k, h in rows], "repo string, s long, kind string, sha string").select("repo", F.timestamp_seconds("s").alias("ts"), "kind", "sha").coalesce(1).write.mode("append").parquet(folder)


def states(spark, out):
    return {r["repo"]: (r["seen"], r["sha"], r["status"], r["pending"]) for r in repositories.states(spark, out).collect()}


def test_states_over_restarts(spark, tmp_path):
    """Rows in any order over several starts on one checkpoint end with the states of all rows at once."""
    rng, base = random.Random(4), f"file://{tmp_path}"
    rows = [(f"r{rng.randrange(5)}", rng.randrange(1, 400), rng.choice(["commit", "commit", "done", "failed"]), f"h{rng.randrange(60)}") for _ in range(90)]
    for i in range(3):
        feed(spark, f"{base}/in", rows[i * 30 : i * 30 + 30])
        repositories.track(spark.readStream.schema(ROWS).parquet(f"{base}/in"), f"{base}/out", f"{base}/state").awaitTermination()
        assert states(spark, f"{base}/out") == newest(rows[: i * 30 + 30])


def test_work_without_a_result_stalls(spark, tmp_path):
    base = f"file://{tmp_path}"
    go = lambda: repositories.track(spark.readStream.schema(ROWS).parquet(f"{base}/in"), f"{base}/out", f"{base}/state", patience_ms=60_000).awaitTermination()
    feed(spark, f"{base}/in", [("a", 100, "commit", "a1"), ("b", 100, "commit", "b1"), ("b", 110, "done", "b1"), ("c", 500, "commit", "c1")])
    go()
    feed(spark, f"{base}/in", [("c", 501, "commit", "c2")])
    go()
    got = states(spark, f"{base}/out")
    assert (got["a"][2:], got["b"][2:], got["c"][2:]) == (("stalled", 1), ("done", 0), ("pending", 2))


def test_one_run_for_a_batch(spark, tmp_path):
    """Repositories of a batch are planned and made together; others in the store stay."""
    push = lambda sha: f'{{"ref":"refs/heads/main","after":"{sha}"}}'
    batch = lambda *r: spark.createDataFrame([("push", repo, True, i, push(sha)) for i, (repo, sha) in enumerate(r)], "type string, repo string, enabled boolean, ts long, payload string")
    files = spark.createDataFrame([(r, s, p, f"{s}{p}") for r, s in (("a", "a1"), ("a", "a2"), ("b", "b1"), ("c", "bad")) for p in ("x/1.py", "2.py")], "repo string, sha string, path string, text string")

    def gen(path, text):
        if text.startswith("bad"):
            raise ValueError("refused")
        return f"U{text}"

    base = f"file://{tmp_path}"
    handle = jobs.together(base, lambda todo: files.join(todo.select("repo", "sha"), ["repo", "sha"]).select("repo", "path", "text"), gen, lambda n, kids: f"S{n}{sorted(kids.values())}", native=False)
    handle(batch(("a", "a1"), ("b", "b1")), 0)
    handle(batch(("a", "a2"), ("c", "bad")), 1)
    handle(batch(("a", "a2")), 2)
    handle(batch(("a", "a2")), 2)
    got = {(x["batch"], x["repo"]): (x["sha"], x["status"], x["regenerated"], x["resynthesized"]) for x in spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/status").collect()}
    assert got == {(0, "a"): ("a1", "generated", 2, 2), (0, "b"): ("b1", "generated", 2, 2), (1, "a"): ("a2", "generated", 2, 2), (1, "c"): ("bad", "error", 0, 2), (2, "a"): ("a2", "noop", 0, 0)}
    docs = {(r["repo"], r["path"]): r["doc"] for r in Store(spark, f"{base}/store").read("unit_doc", run.DOC).collect()}
    assert docs == {("a", "x/1.py"): "Ua2x/1.py", ("a", "2.py"): "Ua22.py", ("b", "x/1.py"): "Ub1x/1.py", ("b", "2.py"): "Ub12.py"}


def test_trees_as_documents(spark):
    rng = random.Random(9)
    names = ["a", "é", 'q"t', "b\\c", "z z"]
    paths = {"/".join(rng.choice(names) for _ in range(rng.randrange(0, 4))) + f"/f{i}" for i in range(25)} | {"top", "d/e/f/g/h/deep"}
    leaves = spark.createDataFrame([("r", p.strip("/"), p[-1]) for p in sorted(paths)] + [("s", "only", "1")], "repo string, path string, blob_sha string")
    nodes = tree.node_hashes(leaves)
    docs = tree.to_documents(nodes)
    flat = {(x["repo"], x["node_id"]): (x["parent_id"], x["kind"], x["node_hash"]) for x in nodes.collect()}
    back = {(x["repo"], x["node_id"]): (x["parent_id"], x["kind"], x["node_hash"]) for x in tree.from_documents(docs).collect()}
    assert back == flat
    whole = {x["repo"]: json.loads(x["doc"]) for x in docs.collect()}
    assert list(whole["s"]) == sorted(whole["s"]) and whole["s"]["children"][0]["node_id"] == "only"

    def ordered(n):
        ids = [k["node_id"].encode() for k in n["children"]]
        return ids == sorted(ids) and all(map(ordered, n["children"]))

    assert ordered(whole["r"])
    want = spark.createDataFrame([("r", "d/e/f"), ("r", "d/e/f/g/h/deep"), ("r", "d/e/no"), ("r", "."), ("s", "d"), ("t", ".")], "repo string, node_id string")
    assert {(x["repo"], x["node_id"], x["kind"]) for x in tree.find(docs, want).collect()} == {("r", "d/e/f", "folder"), ("r", "d/e/f/g/h/deep", "leaf"), ("r", ".", "project")}
    assert tree.to_documents(nodes.limit(0)).count() == 0 and tree.from_documents(docs.limit(0)).count() == 0
    assert tree.find(docs, want.limit(0)).count() == 0 and tree.find(docs.limit(0), want).count() == 0


def test_nodes_found_without_a_tree_for_each(spark):
    leaves = spark.range(3000).selectExpr("'r' AS repo", "concat('d', id % 7, '/', id) AS path", "cast(id AS string) AS blob_sha")
    docs = tree.to_documents(tree.node_hashes(leaves))
    size = docs.selectExpr("max(length(doc)) AS n").first()["n"]
    want = leaves.selectExpr("repo", "path AS node_id").union(leaves.selectExpr("repo", "concat(path, 'x')")).union(leaves.selectExpr("repo", "split(path, '/')[0]"))
    written, own = [], tree.cut

    def watched(df):
        out = own(df)
        if "children" in out.columns:
            written.append(out.selectExpr("coalesce(sum(length(array_join(children, ''))), 0) AS n").first()["n"])
        return out

    tree.cut = watched
    try:
        got = tree.find(docs, want)
    finally:
        tree.cut = own
    assert got.count() == 3007 and got.where("kind = 'leaf'").select("node_id").distinct().count() == 3000
    assert len(written) == 4 and sum(written) < 3 * size


def test_postings(spark):
    docs = spark.createDataFrame([(1, "The old man. The sea"), (2, "sea of the old"), (3, None), (4, "the the the"), (5, "old-man! seas")], "id int, text string")
    index = search.postings(docs, "text")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(search.with_phrase(index, "the OLD")) == [1, 2] and ids(search.with_phrase(index, "old man")) == [1, 5]
    assert ids(search.with_phrase(index, "the the")) == [4] and ids(search.with_phrase(index, "the sea*")) == [1]
    assert ids(search.with_phrase(index, "")) == ids(search.with_near(index, " .")) == ids(search.with_term(index, "")) == []
    assert ids(search.with_near(index, "sea old", within=2)) == [1, 2] and ids(search.with_near(index, "sea old", within=1)) == []
    assert ids(search.with_term(index, "sea*")) == [1, 2, 5] and ids(search.with_term(index, "sea")) == [1, 2]
    assert ids(search.without(search.any_of(search.with_term(index, "man"), search.with_term(index, "of")), search.all_of(search.with_term(index, "the"), search.with_term(index, "of")))) == [1, 5]
    assert [r["at"] for r in search.with_phrase(index, "the").orderBy("id").collect()] == [[0, 3], [2], [0, 1, 2]]
    plan = search.with_term(index, "sea")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,sea)" in plan and docs.where(search.phrase("", "text")).count() == 0


def test_histories(spark):
    edges = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("e", "d"), ("x", "y"), ("y", "x"), ("a", None)], "sha string, parent string")
    starts = spark.createDataFrame([("e", "e"), ("x", "x"), ("n", "n")], "start string, sha string")
    got = {(r["start"], r["sha"]): r["distance"] for r in history.ancestors(edges, starts).collect()}
    assert got == {("e", "e"): 0, ("e", "d"): 1, ("e", "b"): 2, ("e", "c"): 2, ("e", "a"): 3, ("x", "x"): 0, ("x", "y"): 1, ("n", "n"): 0}
    pairs = spark.createDataFrame([("a", "e"), ("e", "a"), ("d", "d"), ("y", "x"), (None, "e")], "base string, head string")
    assert {(r["base"], r["head"]): r["known"] for r in history.is_ancestor(edges, pairs).collect()} == {("a", "e"): True, ("e", "a"): False, ("d", "d"): True, ("y", "x"): True, (None, "e"): False}
    lines = spark.createDataFrame([("e", "M\tm"), ("d", "D\tm"), ("d", "R100\told\tnew"), ("b", "A\tn"), ("c", "D\tn"), ("a", "A\tfirst")], "sha string, line string")
    change = lambda base: {(r["path"], r["change"]) for r in history.between(edges, lines, base, "e").collect()}
    assert change("a") == {("m", "changed"), ("old", "deleted"), ("new", "changed"), ("n", "changed")}
    assert change("d") == {("m", "changed")} and change(None) == change("a") | {("first", "changed")}


def test_calls_overlap_keep_order_and_pace(spark, tmp_path):
    """Several calls are under way at once, at no more than the rate; errors are rows; the output is that of calls one by one."""
    import time

    from heartwood.operators.calls import called

    def call(i, folder):
        import os

        start = time.time()
        time.sleep(0.15)
        with open(f"{folder}/{i}-{os.getpid()}-{start}", "w") as f:
            f.write(f"{start} {time.time()}")
        tries = sum(n.startswith(f"{i}-") for n in os.listdir(folder))
        if i % 5 == 1 or (i % 5 == 2 and tries < 2):
            raise ValueError(f"no {i}")
        return "" if i % 5 == 3 else f"d{i}"

    rows = spark.range(10).select(F.col("id").alias("i"), F.lit(str(tmp_path)).alias("f")).coalesce(1)
    got = [(r["i"], r["doc"], r["error"]) for r in called(rows, call, ("i", "f"), ("i",), workers=4, per_second=20, retries=1, backoff=0.01).collect()]
    expect = {0: lambda i: (i, f"d{i}", None), 1: lambda i: (i, None, f"ValueError: no {i}"), 2: lambda i: (i, f"d{i}", None), 3: lambda i: (i, None, "empty answer"), 4: lambda i: (i, f"d{i}", None)}
    assert got == [expect[i % 5](i) for i in range(10)]
    spans = sorted(tuple(map(float, p.read_text().split())) for p in tmp_path.iterdir())
    assert max(sum(a <= s < b for a, b in spans) for s, _ in spans) in (2, 3, 4)
    assert spans[-1][0] - spans[0][0] >= (len(spans) - 1) / 20 - 0.1


def test_templates_of_odd_values(spark):
    from heartwood.functions import templates

    df = spark.createDataFrame([(None, [], 0, [["x"], []]), ('q"', ["b", None], 2, [])], "a string, b array<string>, n int, m array<array<string>>")
    c = {x: F.col(x) for x in df.columns}
    show = lambda t: [r[0] for r in df.select(templates.render(t, c)).collect()]
    assert show("{{ a }}-{{ a | quote }}") == ['-""', 'q"-"q\\""']
    assert show("{% for x in b %}[{{ x }}{{ loop.index }}]{% endfor %}") == ["", "[b1][2]"]
    assert show("{% if n %}{% if a %}1{% endif %}{% else %}0{% endif %}{% if b %}b{% endif %}") == ["0", "1b"]
    assert show("{% for r in m %}<{% for x in r %}{{ x | upper }}{% endfor %}>{% endfor %}") == ["<X><>", ""]
    for bad, error in (("{% if a %}", ValueError), ("{% for x in b %}", ValueError), ("{{ z }}", KeyError), ("{% include x %}", ValueError)):
        with pytest.raises(error):
            templates.render(bad, c)


@pytest.mark.parametrize(("growth", "want"), [(None, [2, 4, 6, 8]), (1.5, [2, 3, 4.5, 6.75])])
def test_back_off_is_linear_or_grows(monkeypatch, growth, want):
    slept, left = [], [None, ValueError("down"), "", TimeoutError(), "up"]

    def call():
        out = left.pop(0)
        if isinstance(out, Exception):
            raise out
        return out

    monkeypatch.setattr(calls.time, "sleep", slept.append)
    assert calls.attempt(call, (), 4, 2, calls.Pace(None), growth) == ("up", None) and slept == want
    assert calls.attempt(lambda: 1 / 0, (), 1, 0, calls.Pace(None), growth) == (None, "ZeroDivisionError: division by zero")
