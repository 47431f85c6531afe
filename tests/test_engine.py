"""Properties of runs, folds, budgets and extraction."""

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heartwood.functions import hashing, paths, text
from heartwood.operators import budget, diff, extract, search, tree
from heartwood.plans import jobs, plan, run
from heartwood.sources import files as sources
from heartwood.sources.state import Store
from heartwood.streaming import events

TREE = {"pkg/core/engine.py": "e", "pkg/core/utils.py": "u", "pkg/api/handler.py": "h", "README.md": "r"}


def frame(spark, tree, repo="r"):
    return spark.createDataFrame([(repo, p, t) for p, t in tree.items()], "repo string, path string, text string")


def folded(leaves):
    """The tree's hashes, plainly."""

    def build(node, items):
        kids = {}
        for path, sha in items.items():
            head, _, rest = path.partition("/")
            kids.setdefault(head, {})[rest] = sha
        parts, out = [], {}
        for name, sub in kids.items():
            cid = name if node == "." else f"{node}/{name}"
            if "" in sub:
                parts.append(f"{cid}:{sub['']}")
            else:
                below = build(cid, sub)
                out |= below
                parts.append(f"{cid}:{below[cid]}")
        h = hashlib.sha256(node.encode())
        for p in sorted(parts):
            h.update(b"\0" + p.encode())
        return out | {node: h.hexdigest()}

    return build(".", leaves)


def test_content_id_is_gits(spark):
    rows = spark.createDataFrame([("",), ("héllo\n",), ("a\0b",)], "t string").select("t", hashing.content_id(F.col("t")).alias("h")).collect()
    for r in rows:
        b = r["t"].encode()
        assert r["h"] == hashlib.sha1(b"blob %d\0" % len(b) + b).hexdigest()


NAME = st.text("abé-.", min_size=1, max_size=3).filter(lambda s: s.strip("."))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.lists(NAME, min_size=1, max_size=4).map("/".join), st.text("0123", min_size=1, max_size=4), min_size=1, max_size=8))
def test_fold(spark, leaves):
    leaves = {p: s for p, s in leaves.items() if not any(q.startswith(p + "/") for q in leaves)}
    rows = spark.createDataFrame([("r", p, s) for p, s in leaves.items()], "repo string, path string, blob_sha string")
    got = {r["node_id"]: r["node_hash"] for r in tree.node_hashes(rows).where("kind <> 'leaf'").collect()}
    assert got == folded(leaves)


def test_deep_tree(spark):
    leaves = {"/".join("abcdefghij"[:9]) + "/x.py": "1", "y": "2"}
    rows = spark.createDataFrame([("r", p, s) for p, s in leaves.items()], "repo string, path string, blob_sha string")
    assert {r["node_id"]: r["node_hash"] for r in tree.node_hashes(rows).where("kind <> 'leaf'").collect()} == folded(leaves)


def test_plan_by_hash_and_by_closure_agree(spark):
    a = sources.snapshot(frame(spark, TREE | {"pkg/new.py": "n"}), F.col("repo"))
    b = sources.snapshot(frame(spark, TREE | {"pkg/api/handler.py": "x", "gone/old.py": "o"}), F.col("repo"))
    one, two = ({(r["id"], r["action"]) for r in plan.refresh_plan(a, b, by_hash=h).collect()} for h in (True, False))
    assert one == two
    assert one == {("pkg/new.py", "regen"), ("pkg/api/handler.py", "regen"), ("gone/old.py", "delete"), (".", "resynth"), ("pkg", "resynth"), ("pkg/api", "resynth")}


def test_runs(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    gen = F.concat(F.lit("U["), "path", F.lit("]"), "text")
    syn = lambda n, kids: F.concat(F.lit("S["), n, F.lit("]"), F.array_join(F.transform(kids, lambda k: F.concat(k["id"], F.lit(":"), k["doc"])), "\n"))
    first = run.run(store, frame(spark, TREE), "c1", gen, syn)
    assert first.calls == 4 + 4 and not first.noop
    before = {r["node_id"]: r["doc"] for r in first.node_docs.collect()}
    edited = TREE | {"pkg/core/engine.py": "E2"}
    second = run.run(store, frame(spark, edited), "c2", gen, syn)
    assert second.calls == 1 + 3
    after = {r["node_id"]: (r["doc"], r["outcome"]) for r in second.node_docs.collect()}
    assert after["pkg/api"] == (before["pkg/api"], "reused") and "E2" in after["."][0]
    third = run.run(store, frame(spark, edited), "c3", gen, syn)
    assert third.noop and third.calls == 0 and store.state()[2] == "c3"
    gone = run.run(store, frame(spark, {}), "c4", gen, syn)
    assert gone.leaf_docs.count() == 0 and gone.node_docs.count() == 0


def test_budget_halts_and_goes_on(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    files = frame(spark, {"src/a.py": "a", "src/util/b.py": "b", "src/util/c.py": "c"})
    gen, syn = (lambda p, t: f"U{p}"), (lambda n, kids: f"S{n}{sorted(kids)}")
    r = run.run(store, files, "c1", gen, syn, ceiling=0.25, price=0.10, native=False)
    assert (r.halted, r.calls, round(r.spent, 2)) == (True, 2, 0.2) and store.state()[2] != "c1"
    r = run.run(store, files, "c1", gen, syn, ceiling=1.0, price=0.10, native=False)
    assert not r.halted and r.calls == 1 + 3 and store.state()[2] == "c1"


@pytest.mark.parametrize(("ceiling", "calls"), [(0.05, 0), (0.35, 3), (0.45, 4)])
def test_budget_loses_no_folder(spark, tmp_path, ceiling, calls):
    """Wherever the ceiling falls, later runs end with the documents of a run without one, and make each once."""
    files = frame(spark, {"src/a.py": "a", "src/util/b.py": "b", "src/util/c.py": "c"})
    gen, syn = (lambda p, t: f"U{p}"), (lambda n, kids: f"S{n}{sorted(kids.items())}")
    whole = run.run(Store(spark, f"file://{tmp_path}/w"), files, "c1", gen, syn, native=False)
    expect = {(r["node_id"], r["doc"]) for r in whole.node_docs.collect()}
    store = Store(spark, f"file://{tmp_path}/s")
    first = run.run(store, files, "c1", gen, syn, ceiling=ceiling, price=0.10, native=False)
    assert (first.halted, first.calls) == (True, calls)
    assert first.node_docs.count() == max(calls - 3, 0)
    second = run.run(store, files, "c1", gen, syn, ceiling=1.0, price=0.10, native=False)
    assert (second.halted, second.calls) == (False, 6 - calls)
    assert {(r["node_id"], r["doc"]) for r in store.read("folder_doc", run.NODE_DOC).collect()} == expect
    assert run.run(store, files, "c2", gen, syn, native=False).noop


def test_a_deleted_folder_under_a_budget(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    gen, syn = (lambda p, t: f"U{p}{t}"), (lambda n, kids: f"S{n}{sorted(kids)}")
    run.run(store, frame(spark, {"a/x.py": "1", "b/y.py": "2"}), "c1", gen, syn, native=False)
    after = frame(spark, {"a/x.py": "3"})
    assert run.run(store, after, "c2", gen, syn, ceiling=0.1, price=0.1, native=False).halted
    run.run(store, after, "c2", gen, syn, native=False)
    assert {r["node_id"]: r["doc"] for r in store.read("folder_doc", run.NODE_DOC).collect()} == {".": "S.['a']", "a": "Sa['a/x.py']"}
    assert [r["path"] for r in store.read("unit_doc", run.DOC).collect()] == ["a/x.py"]


def test_budget_doubles(spark):
    rows = spark.createDataFrame([(1, i, 0.1) for i in range(3)], "phase int, ord int, cost double")
    assert [x["admitted"] for x in budget.admit(rows, "cost", 0.3).orderBy("ord").collect()] == [True, True, False]


def test_failure_stays_stale(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")

    def gen(p, t):
        if "b" in p:
            raise ValueError("no")
        return "ok"

    files = frame(spark, {"a.py": "1", "b.py": "2"})
    run.run(store, files, "c1", gen, lambda n, k: "s", native=False)
    assert {r["id"] for r in run.run(store, files, "c2", gen, lambda n, k: "s", native=False).plan.collect()} == {"b.py", "."}


def test_empty_sha_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path)).commit({}, "")


def test_committed_fallback(spark):
    leaf = lambda rows: spark.createDataFrame(rows, "repo string, path string, blob_sha string")
    out = diff.snapshot_diff(leaf([("r", "a", "1"), ("r", "b", "2")]), leaf([("r", "z", "9")]), leaf([("r", "a", "1")]))
    assert {(r["path"], r["stale"], r["deleted"]) for r in out.collect()} == {("a", False, False), ("b", True, False), ("z", True, True)}


def test_paths(spark):
    rows = spark.createDataFrame([("a/.py",), ("a/x.tar.gz",), ("..b.v",), ("Makefile",), ("x.R",)], "p string")
    got = [r[0] for r in rows.select(paths.suffix(F.col("p"))).collect()]
    assert got == ["", ".gz", ".v", "", ".R"]


def test_modules():
    code = """/* module no (a); endmodule */ module top #(parameter W = 8, D = W*2) (input wire signed [W-1:0] a, b, output reg [2*W-1:0] y); // endmodule
 (* keep *) assign z = a ** 2; always_ff @(posedge clk) y <= x[W*2] + 2*3; sub #(.W(W)) u0 (a); sub u1 (b); endmodule module bare; endmodule"""
    (m,) = extract.modules(code)
    assert [p["name"] for p in m["parameters"]] == ["W", "D"]
    assert [(p["name"], p["direction"], p["signed"], p["width"]) for p in m["ports"]] == [("a", "input", True, "[W-1:0]"), ("b", "input", False, ""), ("y", "output", False, "[2*W-1:0]")]
    assert {i["instance_name"] for i in m["instances"]} >= {"u0", "u1"}
    assert (m["always_blocks"], m["assigns"], m["infers_multiplier"]) == (1, 1, False)
    assert list(extract.modules(None)) == []
    assert list(extract.modules("module a (" + "module b (" * 50_000)) == []  # nothing closes: linear all the same
    assert [(x["module"], x["ports"][0]["name"]) for x in extract.modules("module m #(parameter P=1) (input [1:0] p[3:0]); endmodule module n (output logic signed q); endmodule")] == [("m", "p"), ("n", "q")]
    assert [extract.multiplies(b) for b in ("y = a * b", "y = 2*3", "y = a ** 2", "y = x[a*b]", "(* a * b *)", "y = 2*k")] == [True, False, False, False, False, True]


def test_search_edges(spark):
    docs = spark.createDataFrame([(1, "Alpha beta", None, "x"), (2, None, "beta", "alpha alpha"), (3, "", "", "")], "id int, name string, summary string, content string")
    assert [r["id"] for r in search.bm25(docs, "ALPHA, beta!").orderBy("rank").collect()] == [1, 2]
    assert search.bm25(docs, " ").count() == 0
    assert docs.where(search.phrase("alpha be*", "name")).count() == 1


def test_signature(spark):
    import hmac

    good = "sha256=" + hmac.new(b"k", b"body", "sha256").hexdigest()
    rows = spark.createDataFrame([(b"body", good, "k"), (b"body", good, None), (b"body", "sha256=0", "k"), (b"body", None, "k")], "b binary, s string, k string")
    assert [r[0] for r in rows.select(events.signed("b", "s", "k")).collect()] == [True, False, False, False]


def test_stream_batches(spark, sf, tmp_path):
    src = spark.read.parquet(f"{sf}/events.parquet")
    src.withColumn("delivery_id", F.col("event_id") % 500).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    seen = []
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    events.on_batches(events.once(stream, late="400 days"), lambda df, i: seen.append(df.count()), f"{tmp_path}/cp").awaitTermination()
    assert sum(seen) == 500


def test_scan(spark, tmp_path):
    (tmp_path / "build" / "src" / "node_modules").mkdir(parents=True)
    for n in ("src/a.py", "src/b.md", "src/node_modules/c.py"):
        (tmp_path / "build" / n).write_text("x")
    got = sources.scan(spark, f"file://{tmp_path}/build", (".py",)).collect()
    assert [(r["path"], r["text"]) for r in got] == [("src/a.py", "x")]


def test_templates(spark):
    df = spark.range(1).select(text.fill("name: {{ n }}!", {"n": F.lit("x")}).alias("a"), text.task_label(F.lit("make_it")).alias("b"))
    assert tuple(df.first()) == ("name: x!", "Make It")


def test_outlook(spark, tmp_path):
    store, files = Store(spark, f"file://{tmp_path}/s"), frame(spark, TREE)
    rows = jobs.outlook(store, files, ceiling=0.25, price=0.10).collect()
    assert len(rows) == 4 + 4 and sum(x["admitted"] for x in rows) == 2
    known = sources.snapshot(frame(spark, TREE | {"README.md": "old"}), F.col("repo"))
    assert {x["id"] for x in jobs.outlook(store, files, known).where("phase = 1").collect()} == {"README.md"}
    assert store.state()[0] == 0  # nothing is done
    gen, syn = (lambda p, t: f"U{p}{t}"), (lambda n, kids: f"S{n}{sorted(kids)}")
    run.run(store, files, "c1", gen, syn, native=False)
    assert jobs.outlook(store, files, known).count() == 0  # the store's own record counts


def test_preview(spark, tmp_path):
    gen, syn = (lambda p, t: f"U{p}{t}"), (lambda n, kids: f"S{n}{sorted(kids)}")
    got = jobs.preview(frame(spark, TREE), gen, syn, most=2, native=False)
    assert (got.total, got.capped, got.truncated) == (3, 2, True)
    assert {x["path"] for x in got.result.leaf_docs.collect()} == {"pkg/api/handler.py", "pkg/core/engine.py"}
    with pytest.raises(ValueError):
        jobs.preview(frame(spark, {"README.md": "r"}), gen, syn)


def test_jobs_of_events(spark, tmp_path):
    push = lambda ref, sha: f'{{"ref":"{ref}","after":"{sha}"}}'
    rows = [("push", "o/a", True, 1, push("refs/heads/main", "a1")), ("push", "o/a", True, 2, push("refs/heads/main", "a2")), ("push", "o/a", True, 3, push("refs/heads/dev", "a3")), ("push", "o/b", False, 1, push("refs/heads/main", "b1")), ("push", "o/c", True, 1, push("refs/heads/main", "c1"))]
    batch = spark.createDataFrame(rows, "type string, repo string, enabled boolean, ts long, payload string")
    gen, syn = (lambda p, t: f"U{p}{t}"), (lambda n, kids: f"S{n}{sorted(kids)}")

    def load(repo, sha):
        if repo == "o/c":
            raise OSError("no such repository")
        return frame(spark, TREE, repo)

    base = f"file://{tmp_path}/jobs"
    handle = jobs.handler(base, load, gen, syn, native=False)
    handle(batch, 0)
    handle(batch, 1)
    got = {(x["repo"], x["batch"]): (x["sha"], x["status"], x["regenerated"], x["resynthesized"], x["error"]) for x in spark.read.parquet(f"{base}/status").collect()}
    assert got == {("o/a", 0): ("a2", "generated", 4, 4, None), ("o/a", 1): ("a2", "noop", 0, 0, None), ("o/c", 0): ("c1", "error", 0, 0, "no such repository"), ("o/c", 1): ("c1", "error", 0, 0, "no such repository")}


# --- the store


LEAVES = "repo string, path string, blob_sha string"


def leaves_of(spark, items, repo="r"):
    return spark.createDataFrame([(repo, p, s) for p, s in items.items()], LEAVES)


def written(spark, tmp_path, store, name):
    return spark.read.parquet(f"{store.state()[1]}/{name}").count()


def test_store_writes_what_changed(spark, tmp_path):
    """Rows changed, added and gone; reads at any version equal whole tables; whole tables now and then."""
    store, rng = Store(spark, f"file://{tmp_path}/s"), __import__("random").Random(2)
    items, kept, sizes = {f"p{i}": "0" for i in range(20)}, {}, []
    for version in range(1, 15):
        store.commit({"leaf_sha": leaves_of(spark, items)}, f"c{version}")
        kept[version] = dict(items)
        sizes.append(written(spark, tmp_path, store, "leaf_sha"))
        items[f"p{rng.randrange(20)}"] = str(version)
        if version == 3:
            del items[rng.choice(sorted(items))]
        if version == 6:
            items = {}
    assert sizes[0] == 20 and sizes[1] == 1 and sizes[3] <= 2 and sizes[6] >= 19 and max(sizes[7:]) <= len(kept[14])
    for version, expect in kept.items():
        assert {r["path"]: r["blob_sha"] for r in store.read("leaf_sha", LEAVES, version=version).collect()} == expect
    assert store.state()[0] == 14 and store.state()[2] == "c14"


def test_of_two_commits_one_is_refused(spark, tmp_path):
    from heartwood.sources.state import Conflict

    a, b = (Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    a.commit({"leaf_sha": leaves_of(spark, {"x": "1"})}, "c1")
    b.refresh()
    a.commit({"leaf_sha": leaves_of(spark, {"x": "2"})}, "c2")
    with pytest.raises(Conflict):
        b.commit({"leaf_sha": leaves_of(spark, {"x": "3"})}, "c3")
    assert [r["blob_sha"] for r in b.read("leaf_sha", LEAVES, version=b.refresh()).collect()] == ["2"]
    b.commit({"leaf_sha": leaves_of(spark, {"x": "3"})}, "c3")
    assert Store(spark, f"file://{tmp_path}/s").state()[::2] == (3, "c3")


def test_commit_for_some_repositories(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.commit({"leaf_sha": leaves_of(spark, {"x": "1", "y": "1"}, "a").union(leaves_of(spark, {"x": "1"}, "b"))}, "c1")
    store.commit({"leaf_sha": leaves_of(spark, {"x": "2"}, "a")}, "c2", repos=spark.createDataFrame([("a",)], "repo string"))
    assert {(r["repo"], r["path"], r["blob_sha"]) for r in store.read("leaf_sha", LEAVES).collect()} == {("a", "x", "2"), ("b", "x", "1")}


@pytest.mark.parametrize("ceiling", [None, 5.0])
def test_a_failed_edit_keeps_the_last_good_document(spark, tmp_path, ceiling):
    store = Store(spark, f"file://{tmp_path}/s")

    def gen(p, t):
        if t == "bad":
            raise ValueError("no")
        return f"U{t}"

    syn = lambda n, kids: f"S{n}{sorted(kids.items())}"
    go = lambda tree, sha: run.run(store, frame(spark, tree), sha, gen, syn, native=False, ceiling=ceiling)
    go({"a/x.py": "1", "a/y.py": "2", "b/z.py": "3"}, "c1")
    broken = go({"a/x.py": "bad", "a/y.py": "4", "b/z.py": "3"}, "c2")
    assert broken.failed and store.state()[2] == "c1"
    docs = {r["path"]: r["doc"] for r in store.read("unit_doc", run.DOC).collect()}
    assert docs == {"a/x.py": "U1", "a/y.py": "U4", "b/z.py": "U3"}
    folders = {r["node_id"]: r["doc"] for r in store.read("folder_doc", run.NODE_DOC).collect()}
    assert folders["a"] == "Sa[('a/x.py', 'U1'), ('a/y.py', 'U4')]"
    assert {r["id"] for r in go({"a/x.py": "bad", "a/y.py": "4", "b/z.py": "3"}, "c3").plan.collect()} == {"a/x.py", "a", "."}
    mended = go({"a/x.py": "5", "a/y.py": "4", "b/z.py": "3"}, "c4")
    assert not mended.failed and mended.calls == 3 and store.state()[2] == "c4"
    assert go({"a/x.py": "5", "a/y.py": "4", "b/z.py": "3"}, "c5").noop


def test_trees_without_leaves(spark, tmp_path):
    repos = spark.createDataFrame([("r",), ("s",)], "repo string")
    nodes = {(x["repo"], x["node_id"]): x["node_hash"] for x in tree.node_hashes(leaves_of(spark, {"a": "1"}), repos).collect()}
    assert nodes["s", "."] == hashlib.sha256(b".").hexdigest() and nodes["r", "."] == folded({"a": "1"})["."] and len(nodes) == 3
    store = Store(spark, f"file://{tmp_path}/s")
    assert run.run(store, frame(spark, {}), "c1", F.col("text"), lambda n, k: n).noop and store.state()[::2] == (1, "c1")


def test_one_ceiling_over_many_ranges(spark):
    """Prefix sums of two levels admit what one window does."""
    rows = spark.range(500).select(F.lit(1).alias("phase"), F.lit("r").alias("repo"), ((F.col("id") * 7919) % 500).cast("int").alias("ord"), (F.col("id") % 13 * 0.25).alias("cost"))
    order = ("phase", "repo", "ord")
    pick = lambda df: [(r["ord"], r["running"], r["admitted"]) for r in df.orderBy("ord").collect()]
    for ceiling in (0.0, 100.25, 1e6):
        assert pick(budget.admit_all(rows, "cost", ceiling, order, parts=7)) == pick(budget.admit(rows, "cost", ceiling, order))
    assert budget.admit_all(rows.limit(0), "cost", 1.0, order).count() == 0


@pytest.mark.parametrize("name", ["lateral_modules", "processed_files", "verilog_modules", "verilog_multiplier", "verilog_ports", "verilog_symbols"])
def test_sources_of_one_small_file_are_dealt_to_tasks(spark, sf, name):
    from heartwood.queries import QUERIES

    assert QUERIES[name](spark, sf).select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_indexes_shuffle_terms_only_where_rows_share_a_key(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(search, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    docs = spark.createDataFrame([(1, "a b a", "x"), (1, "B", "a"), (2, None, ""), (3, "c", "b b")], "id int, name string, content string")
    held = {(r["term"], r["id"]): r["at"] for r in search.postings(docs, "name").collect()}
    assert held == {("a", 1): [0, 2], ("b", 1): [0, 1], ("c", 3): [0]}
    terms, lengths = search.index(docs, weights={"name": 10.0, "content": 1.0})
    assert {(r["term"], r["id"]): r["freq"] for r in terms.collect()} == {("a", 1): 21.0, ("b", 1): 20.0, ("x", 1): 1.0, ("c", 3): 10.0, ("b", 3): 2.0}
    assert sorted((r["id"], r["len"]) for r in lengths.collect()) == [(1, 2), (1, 4), (2, 0), (3, 3)]
    assert [p.count("Exchange range") for p in plans] == [1, 0, 1] and not any("Exchange hash" in p for p in plans)
    plans.clear()
    assert search.postings(docs.where("id > 1"), "name").count() == 1 and not any(x in plans[-1] for x in ("Aggregate", "Exchange"))
    assert search.postings(docs.limit(0), "name").count() == 0 and search.index(docs.where("id = 2"), weights={"name": 1.0})[0].count() == 0


def test_frontiers_of_ancestors_are_not_broadcast(spark, monkeypatch):
    from heartwood.operators import history

    plans, own = [], history.cut

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return own(df)

    monkeypatch.setattr(history, "cut", watched)
    edges = spark.createDataFrame([("d", "b"), ("d", "c"), ("c", "a"), ("b", "a")], "sha string, parent string")
    got = history.ancestors(edges, spark.createDataFrame([("d", "d"), ("b", "b")], "start string, sha string"))
    assert {tuple(r) for r in got.collect()} == {("d", "d", 0), ("d", "b", 1), ("d", "c", 1), ("d", "a", 2), ("b", "b", 0), ("b", "a", 1)}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_results_of_calls_are_handed_on_together():
    """A task's results come in a few frames, in the order of the rows, each of them once."""
    from types import SimpleNamespace

    import pandas as pd

    from heartwood.operators import calls

    class Rows:
        schema = {c: SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "string")) for c in ("id", "text")}
        select = lambda self, *names: self
        mapInPandas = lambda self, run, schema: run

    n = 2500
    frame = pd.DataFrame({"id": [str(i) for i in range(n)], "text": ["" if i % 3 == 0 else f"t{i}" for i in range(n)]})
    out = list(calls.called(Rows(), lambda text: text, ("text",), ("id",), workers=3)(iter([frame[:1000], frame[1000:]])))
    assert len(out) == 3
    rows = pd.concat(out).to_numpy().tolist()
    assert rows == [[str(i), None, "empty answer"] if i % 3 == 0 else [str(i), f"t{i}", None] for i in range(n)]
    assert len(list(calls.called(Rows(), lambda text: text * calls.TOGETHER_CHARS, ("text",), ("id",))(iter([frame[1:3]])))) == 2
    assert list(calls.called(Rows(), lambda text: text, ("text",), ("id",))(iter([frame[:0]]))) == []
