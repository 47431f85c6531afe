"""Paths, their ancestors and the languages of their suffixes, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT = "."

# Suffixes by language, as the pipeline, the fallback and the export know them.
LANGUAGES = {
    "python": ".py .pyw .pyi",
    "javascript": ".js .mjs .jsx .cjs",
    "typescript": ".ts .tsx",
    "java": ".java",
    "csharp": ".cs",
    "go": ".go",
    "ruby": ".rb .rake .gemspec .ru",
    "rust": ".rs",
    "php": ".php .phtml .php3 .php4 .php5 .phps",
    "cobol": ".cbl .cob .cpy .pco .cobol",
    "fortran": ".f .f77 .f90 .f95 .for .ftn",
    "vb6": ".bas .frm .cls .ctl .pag .dob .vb",
    "powerbuilder": ".pbl .pbt .pbw .srd .sru .srw .pbd",
    "r": ".r .R .Rmd .Rnw .Rscript",
    "verilog": ".v .vh .sv .svh .svi",
}
FALLBACK = {k: v for k, v in LANGUAGES.items() if k != "verilog"} | {"sql": ".sql"}
EXPORT = {"python": ".py", "javascript": ".js", "typescript": ".ts", "java": ".java", "csharp": ".cs", "sql": ".sql", "php": ".php", "ruby": ".rb", "go": ".go", "rust": ".rs", "verilog": ".v .sv .vh .svh"}
#: Suffixes of code that gets documented, and labels for code fences.
CODE = (".v", ".vh", ".sv", ".svh", ".svi", ".py", ".js", ".ts", ".go", ".rs", ".java", ".c", ".cpp", ".h")
# Suffixes of the plain count.
COUNTED = {"counted": ".py .js .ts .java .cs .sql .php .rb .go .rs"}
LABELS = {"python": ".py", "typescript": ".ts", "javascript": ".js"}


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last dot of the base name and what follows; dots that lead a name don't count."""
    return F.regexp_extract(base_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1)


def parent(path: Column) -> Column:
    """The folder that holds a path; of top-level paths the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(ROOT))


def depth(node: Column) -> Column:
    """Separators in a node's id; -1 for the root, so that it comes last bottom-up."""
    return F.when(node.isin("", ROOT), F.lit(-1)).otherwise(F.length(node) - F.length(F.replace(node, F.lit("/"), F.lit(""))))


def ancestors(path: Column) -> Column:
    """All folders above a path, the root first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit(ROOT)).otherwise(F.array_join(F.slice(parts, 1, i), "/")))


def language(ext: Column, table: dict[str, str] = LANGUAGES) -> Column:
    """The language of a suffix, "unknown" where there is none; upper and lower case differ."""
    out = F.lit("unknown")
    for name, exts in table.items():
        out = F.when(ext.isin(*exts.split()), F.lit(name)).otherwise(out)
    return out


def fence_label(ext: Column) -> Column:
    """How a code fence is labelled."""
    known = F.lit(None)
    for name, e in LABELS.items():
        known = F.when(ext == e, F.lit(name)).otherwise(known)
    return F.coalesce(known, F.ltrim(ext, F.lit(".")))


def is_code(path: Column) -> Column:
    return suffix(path).isin(*CODE)


def export_path(node_id: Column, kind: Column) -> Column:
    """Where a document is exported to: beside its file, in its folder, or at the top."""
    return F.when(kind == "leaf", F.concat(node_id, F.lit(".md"))).when(node_id == ROOT, F.lit("__project__.md")).otherwise(F.concat(node_id, F.lit("/__folder__.md")))
