"""Folders of files, their documents, and deliveries of events."""

import hashlib
import hmac
import json
import os

import pytest
from pyspark.sql import functions as F

from heartwood.plans import documents
from heartwood.sources import files as sources
from heartwood.sources import folders
from heartwood.streaming import hooks


def put(root, **texts):
    for name, text in texts.items():
        f = root / name.replace("__S__", "/")
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)


def files_under(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f)).read() for d, _, names in os.walk(root) for f in names}


def test_listing_has_hidden_and_empty_files_and_follows_no_links(spark, tmp_path):
    texts = {"a/__init__.py": "", "_b/c.py": "x", ".d/e.py": "yé", "f.py": "z", "node_modules/g.py": "no", "a/build": "a file of an ignored name"}
    put(tmp_path, **texts)
    (tmp_path / "a" / "up").symlink_to(tmp_path)
    got = {r["path"]: (r["length"], r["text"]) for r in sources.scan(spark, f"file://{tmp_path}").collect()}
    assert got == {n: (len(t.encode()), t) for n, t in texts.items() if n.split("/")[0] != "node_modules" and n != "a/build"}
    assert {r["path"] for r in folders.listing(spark, str(tmp_path)).collect()} == set(texts)
    assert [r["path"] for r in sources.scan(spark, str(tmp_path), (".py",), below=2, ordered=True).collect()] == ["_b/c.py", "a/__init__.py", "f.py"]
    (tmp_path / "none").mkdir()
    assert sources.scan(spark, f"{tmp_path}/none").count() == 0


def test_contents_of_large_and_missing_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "STEP", 10)
    put(tmp_path, **{f"f{i}": "x" * i for i in range(30)})
    rows = spark.createDataFrame([(f"f{i}", i) for i in range(31)], "path string, length bigint").coalesce(1)
    got = {r["path"]: r["n"] for r in folders.contents(rows, str(tmp_path)).select("path", F.length("content").alias("n")).collect()}
    assert got == {f"f{i}": i if i < 30 else None for i in range(31)}


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "repo string, node_id string, kind string, doc string")


def test_export_replaces_or_adds(spark, tmp_path):
    out = f"{tmp_path}/docs"
    rows = docs_of(spark, [("o/r", "s/a.py", "leaf", "A"), ("o/r", "s", "folder", "S"), ("o/r", ".", "folder", "P"), ("o/r", "gone.py", "leaf", None), ("o/r", "s/a.py", "leaf", "A")])
    folders.export(folders.pages(rows, "r"), f"file://{out}")
    whole = {"o__r/s/a.py.md": "# s/a.py\n\nA\n", "o__r/s/__folder__.md": "# s\n\nS\n", "o__r/__project__.md": "# r — repository overview\n\nP\n"}
    assert files_under(out) == whole
    folders.export(folders.pages(docs_of(spark, [("o/r", "s/a.py", "leaf", "B")]), "r"), out, replace=False)
    assert files_under(out) == whole | {"o__r/s/a.py.md": "# s/a.py\n\nB\n"}
    folders.export(folders.pages(docs_of(spark, []), "r"), out)
    assert files_under(out) == {} and os.listdir(tmp_path) == ["docs"]


@pytest.mark.parametrize("bad", ["../x.py", "/x.py", "a//x.py"])
def test_a_failed_export_leaves_what_was_there(spark, tmp_path, bad):
    out = f"{tmp_path}/docs"
    folders.export(folders.pages(docs_of(spark, [("r", "a.py", "leaf", "A")]), "r"), out)
    rows = docs_of(spark, [("r", f"b{i}.py", "leaf", "B") for i in range(20)] + [("r", bad, "leaf", "B")])
    with pytest.raises(Exception, match="can't be written"):
        folders.export(folders.pages(rows, "r", by_repo=False), out)
    assert files_under(out) == {"r/a.py.md": "# a.py\n\nA\n"} and os.listdir(tmp_path) == ["docs"]


def test_documents_of_a_folder(spark, tmp_path):
    src, asked = tmp_path / "src", tmp_path / "asked"
    asked.mkdir()
    put(src, **{"rtl/top.v": "module top(input wire a, output b); sub u(a); endmodule", "lib/__init__.py": "", "lib/m.py": "def f(): pass", "lib/notes.txt": "no code"})

    def ask(system, prompt):  # runs in tasks: what it was asked goes to files
        h = hashlib.md5(prompt.encode()).hexdigest()
        (asked / h).write_text(prompt)
        return f"doc {h}"

    run = lambda: documents.document(spark, str(src), f"{tmp_path}/state", f"{tmp_path}/docs", ask, "demo")
    done = run()
    got = files_under(tmp_path / "docs")
    assert set(got) == {"rtl/top.v.md", "lib/__init__.py.md", "lib/m.py.md", "rtl/__folder__.md", "lib/__folder__.md", "__project__.md"} and done.calls == 6
    prompts = files_under(asked).values()
    assert any("top: parameters ()" in p and "input" in p and "u:sub" in p and "```verilog" in p for p in prompts)
    assert sum("### rtl\n" in p and "### lib\n" in p for p in prompts) == 1
    assert got["__project__.md"].startswith("# demo — repository overview\n\ndoc ")
    assert run().noop
    (src / "lib" / "m.py").write_text("def g(): pass")
    (src / "lib" / "__init__.py").unlink()
    assert run().calls == 3  # the file, its folder and the project
    after = files_under(tmp_path / "docs")
    assert after["rtl/top.v.md"] == got["rtl/top.v.md"] and after["lib/m.py.md"] != got["lib/m.py.md"] and "lib/__init__.py.md" not in after


def test_signatures_are_hmacs(spark):
    for key, body in (("k", "{}"), ("", "x"), ("ü" * 50, "é\n"), ("long " * 40, "")):
        want = "sha256=" + hmac.new(key.encode(), body.encode(), hashlib.sha256).hexdigest()
        assert spark.createDataFrame([(body,)], "b string").select(hooks.mac(F.col("b"), key)).first()[0] == want


def test_deliveries_in_batch_and_stream(spark, tmp_path):
    key = "s"
    sign = lambda b, k=key: "sha256=" + hmac.new(k.encode(), b.encode(), hashlib.sha256).hexdigest()
    push = json.dumps({"ref": "refs/heads/main", "after": "c1", "repository": {"full_name": "o/r"}, "installation": {"id": 5}, "sender": {"login": "u"}})
    rows = [
        ({"X-GitHub-Event": "push", "X-GitHub-Delivery": "1", "X-Hub-Signature-256": sign(push)}, push),
        ({"x-github-event": "push", "X-GITHUB-DELIVERY": "2", "x-hub-signature-256": sign(push)}, push),
        ({"X-GitHub-Event": "push", "X-GitHub-Delivery": "3", "X-Hub-Signature-256": sign(push, "other")}, push),
        ({"X-GitHub-Event": "push", "X-GitHub-Delivery": "4"}, push),
        ({"X-Hub-Signature-256": sign("{}")}, "{}"),
        ({"X-GitHub-Delivery": "6", "X-Hub-Signature-256": sign("no json")}, "no json"),
        (None, push),
        ({"X-Hub-Signature-256": sign("")}, None),
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("".join(json.dumps({"headers": h, "body": b}) + "\n" for h, b in rows))
    made = lambda stream: hooks.gated(hooks.parsed(hooks.verified(hooks.deliveries(spark, f"{tmp_path}/in", stream), key)), F.col("repo") != "o/off")
    want = [("1", "push", 5, "o/r", "u", "c1", "process"), ("2", "push", 5, "o/r", "u", "c1", "process"), ("unknown", "unknown", None, None, None, None, "unsupported")]
    cols = ["delivery_id", "type", "installation_id", "repo", "sender", "sha", "reason"]
    assert sorted(map(tuple, made(False).select(*cols).collect())) == want
    assert hooks.verified(hooks.deliveries(spark, f"{tmp_path}/in", False), F.lit(None)).count() == 0

    def streamed():
        q = made(True).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True)
        q.start().awaitTermination()
        return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(*cols).collect()))

    assert streamed() == want
    (tmp_path / "in" / "b.json").write_text(json.dumps({"headers": rows[1][0] | {"X-GITHUB-DELIVERY": "9"}, "body": push}) + "\n")
    assert streamed() == sorted([*want, ("9", *want[0][1:])])  # from the checkpoint: each delivery once
