"""Documents of a folder of code: prompts, a run over what changed, and its export as Markdown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql import SparkSession

from ..functions import paths
from ..operators import extract, tree
from ..operators.refresh import CHILD_CHARS
from ..sources import folders
from ..sources.files import IGNORED, scan, snapshot
from ..sources.state import Store, cut
from . import run as r

#: A call of a model: (system prompt, prompt) to text.
Ask = Callable[[str, str], str]
HARDWARE = tuple(paths.LANGUAGES["verilog"].split())
_LEAF = "You document source code for its maintainers, briefly and exactly."
_FOLDER = "You describe how the parts of a code base fit together."


def fence(path: str) -> str:
    """The label of a code fence for a file."""
    ext = "." + path.rsplit("/", 1)[-1].rsplit(".", 1)[-1]
    return "verilog" if ext in HARDWARE else next((n for n, e in paths.LABELS.items() if e == ext), ext.lstrip("."))


def outline(code: str) -> str:
    """Modules of hardware source, a line each, for a prompt."""
    lines = []
    for m in extract.modules(code):
        params = ", ".join(f"{p['name']}={p['default']}" for p in m["parameters"])
        ports = ", ".join(" ".join(x for x in (p["direction"], p["width"], p["name"]) if x) for p in m["ports"])
        parts = ", ".join(f"{i['instance_name']}:{i['module_type']}" for i in m["instances"])
        lines.append(f"{m['module']}: parameters ({params}), ports ({ports}), parts ({parts}), always blocks {m['always_blocks']}, multiplies {m['infers_multiplier']}")
    return "\n".join(lines)


def leaf_prompt(path: str, code: str) -> str:
    label = fence(path)
    known = f"What it declares:\n{outline(code)}\n\n" if label == "verilog" else ""
    asked = "its parameters and ports as tables, its behaviour" if known else "its functions and classes, how it is used"
    return f"{path}\n\n{known}```{label}\n{code}\n```\n\nWrite Markdown on this file: what it is for, {asked}."


def folder_prompt(node: str, kids: dict[str, str], project: str) -> str:
    what = f"the project {project}" if node == paths.ROOT else f"the folder {node}"
    return f"Write Markdown on {what}: what it holds and how its parts relate.\n\n" + "\n\n".join(f"### {k}\n{(d or '')[:CHILD_CHARS]}" for k, d in sorted(kids.items()))


def callbacks(ask: Ask, project: str) -> tuple[Callable[[str, str], str], Callable[[str, dict[str, str]], str]]:
    """(generator, synthesizer) for run(), both by one call of a model."""
    return (lambda path, code: ask(_LEAF, leaf_prompt(path, code))), (lambda node, kids: ask(_FOLDER, folder_prompt(node, kids, project)))


def document(spark: SparkSession, root: str, base: str, target: str, ask: Ask, project: str, sha: str | None = None, ignore: tuple[str, ...] = IGNORED, **options) -> r.Result:
    """Bring the documents of the code under root up to date, state in base, Markdown under target.

    Only files whose content has changed since the last run, and the folders above them, are asked about.
    sha names the version; without one it is the hash of the tree. options are those of run().
    """
    files = cut(scan(spark, root, paths.CODE, ignore).select(F.lit(project).alias("repo"), "path", "text"))
    if sha is None:
        top = tree.node_hashes(snapshot(files, F.col("repo")), spark.createDataFrame([(project,)], "repo string"))
        sha = top.where(F.col("node_id") == paths.ROOT).first()["node_hash"]
    generator, synthesizer = callbacks(ask, project)
    store = Store(spark, base)
    done = r.run(store, files, sha, generator, synthesizer, native=False, **options)
    if not done.noop:
        folders.export_store(store, target, project, by_repo=False)
    return done
