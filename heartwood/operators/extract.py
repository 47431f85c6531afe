"""Structure of hardware source: modules, parameters, ports and instances.

Source is cut into tokens once, brackets are paired in one pass over them, and
modules are read off the tokens, so that the work grows with the length of the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that name no module, port or instance.
KEYWORDS = frozenset({
    "module", "endmodule", "always", "always_ff", "always_comb", "always_latch", "assign", "if", "else", "begin", "end", "case", "casex", "casez", "endcase", "for", "while",
    "initial", "generate", "endgenerate", "wire", "reg", "logic", "localparam", "parameter", "function", "task", "genvar", "integer", "posedge", "negedge",
})
DIRECTIONS, NETS = frozenset({"input", "output", "inout"}), frozenset({"reg", "wire", "logic"})
PROCESSES = frozenset({"always", "always_ff", "always_comb", "always_latch"})
PAIRS = {")": "(", "]": "[", "}": "{"}
_TOKEN = re.compile(r"\w+|\*\*|\S")

SCHEMA = """module string, parameters array<struct<name:string,default:string>>,
 ports array<struct<name:string,direction:string,net_type:string,signed:boolean,width:string>>,
 instances array<struct<module_type:string,instance_name:string>>, always_blocks int, assigns int, infers_multiplier boolean"""


class Token(NamedTuple):
    text: str
    start: int
    end: int

    @property
    def word(self) -> bool:
        return self.text[0] == "_" or self.text[0].isalnum()


def cut_out(text: str, opening: str, closing: str) -> str:
    """text without the spans between two marks; one that is never closed stays."""
    kept, at = [], 0
    while (a := text.find(opening, at)) >= 0 and (b := text.find(closing, a + len(opening))) >= 0:
        kept.append(text[at:a])
        at = b + len(closing)
    return "".join((*kept, text[at:]))


class Source:
    """Tokens of code without comments, and for each opening bracket its partner."""

    def __init__(self, code: str, attributes: bool = True):
        code = "\n".join(line.partition("//")[0] for line in cut_out(code, "/*", "*/").split("\n"))
        self.text = code if attributes else cut_out(code, "(*", "*)")
        self.tokens = [Token(m[0], m.start(), m.end()) for m in _TOKEN.finditer(self.text)]
        self.partner: dict[int, int] = {}
        open_: dict[str, list[int]] = {"(": [], "[": [], "{": []}
        for i, t in enumerate(self.tokens):
            if t.text in open_:
                open_[t.text].append(i)
            elif t.text in PAIRS and open_[PAIRS[t.text]]:
                self.partner[open_[PAIRS[t.text]].pop()] = i

    def is_(self, i: int, text: str) -> bool:
        return i < len(self.tokens) and self.tokens[i].text == text

    def word(self, i: int) -> bool:
        return i < len(self.tokens) and self.tokens[i].word

    def group(self, i: int) -> int | None:
        """The place after a round group that begins at i."""
        return self.partner[i] + 1 if self.is_(i, "(") and i in self.partner else None

    def slice(self, a: int, b: int) -> str:
        """The text of tokens a to b, the last left out."""
        return self.text[self.tokens[a].start : self.tokens[b - 1].end] if a < b else ""

    def parts(self, a: int, b: int, nested: bool) -> Iterator[tuple[int, int]]:
        """Parts between commas; with nested, commas within brackets don't count."""
        start = i = a
        while i < b:
            if self.tokens[i].text == ",":
                yield start, i
                start = i + 1
            i = self.partner[i] + 1 if nested and i in self.partner else i + 1
        if start < b:
            yield start, b


def _parameters(src: Source, a: int, b: int) -> list[dict]:
    out = []
    for lo, hi in src.parts(a, b, nested=False):
        equal = next((i for i in range(lo, hi) if src.is_(i, "=")), lo)
        if equal > lo and equal + 1 < hi and src.word(equal - 1) and src.tokens[equal - 1].text not in KEYWORDS:
            out.append({"name": src.tokens[equal - 1].text, "default": src.slice(equal + 1, hi)})
    return out


def _ports(src: Source, a: int, b: int) -> list[dict]:
    """Ports in order. A bare name takes the direction before it, but no width or sign."""
    out: list[dict] = []
    for lo, hi in src.parts(a, b, nested=True):
        port = {"name": None, "direction": out[-1]["direction"] if out else None, "net_type": "", "signed": False, "width": ""}
        i = next((i for i in range(lo, hi) if src.tokens[i].text in DIRECTIONS), None)
        if i is not None:
            port["direction"] = src.tokens[i].text
            for i in range(i + 1, hi):
                t = src.tokens[i]
                if t.text in NETS and not port["net_type"]:
                    port["net_type"] = t.text
                elif t.text == "signed":
                    port["signed"] = True
                elif t.text == "[" and i in src.partner and not port["width"]:
                    port["width"] = src.slice(i, src.partner[i] + 1)
                elif t.word and (not port["width"] or t.start >= src.tokens[i - 1].end and src.is_(i - 1, "]")):
                    port["name"] = t.text
                    break
        elif port["direction"] and src.word(hi - 1) and src.tokens[hi - 1].text not in KEYWORDS:
            port["name"] = src.tokens[hi - 1].text
        if port["name"]:
            out.append(port)
    return out


def _instances(src: Source, a: int, b: int, own: str) -> list[dict]:
    out, i = [], a
    while i < b:
        after = i + 1
        if src.word(i) and src.is_(after, "#"):
            after = src.group(after + 1) or after
        if src.word(i) and after + 1 < b and src.word(after) and src.is_(after + 1, "("):
            kind, name = src.tokens[i].text, src.tokens[after].text
            if kind not in KEYWORDS and name not in KEYWORDS and kind != own:
                out.append({"module_type": kind, "instance_name": name})
            i = after + 2
        else:
            i += 1
    return out


def multiplies(body: str) -> bool:
    """Whether a product of two operands, not both numbers, stands outside of attributes and square brackets."""
    level, flat = 0, []
    for t in Source(body, attributes=False).tokens:
        if t.text in "[]":
            level = max(level + (1 if t.text == "[" else -1), 0)
        elif not level:
            flat.append(t)
    i = 0
    while i + 2 < len(flat):
        x, op, y = flat[i : i + 3]
        if op.text == "*" and x.word and y.word:
            if not (x.text.isdigit() and y.text.isdigit()):
                return True
            i += 3  # a product's right operand is no other's left one
        else:
            i += 1
    return False


def modules(code: str | None) -> Iterator[dict]:
    """Modules with a list of ports, in order."""
    src = Source(code or "")
    ends = [i for i, t in enumerate(src.tokens) if t.text == "endmodule"]
    i = 0
    while i < len(src.tokens):
        at, i = i, i + 1
        if not src.is_(at, "module") or not src.word(at + 1):
            continue
        given = src.group(at + 3) if src.is_(at + 2, "#") else None
        begin = given or at + 2
        close = src.group(begin)
        k = bisect_left(ends, close) if close else len(ends)
        if close is None or not src.is_(close, ";") or k == len(ends):
            continue
        lo, hi, name = close + 1, ends[k], src.tokens[at + 1].text
        said = [t.text for t in src.tokens[lo:hi]]
        yield {
            "module": name,
            "parameters": _parameters(src, at + 4, given - 1) if given else [],
            "ports": _ports(src, begin + 1, close - 1),
            "instances": _instances(src, lo, hi, name),
            "always_blocks": sum(w in PROCESSES for w in said),
            "assigns": said.count("assign"),
            "infers_multiplier": multiplies(src.slice(lo, hi)),
        }
        i = hi + 1


def extract_modules(sources: DataFrame, key: str = "id", code: str = "code") -> DataFrame:
    """A row for each module of each source."""
    kind = sources.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{key: k, **m} for k, c in zip(pdf[key], pdf[code], strict=True) for m in modules(c)]
            yield pd.DataFrame(rows, columns=[key, "module", "parameters", "ports", "instances", "always_blocks", "assigns", "infers_multiplier"])

    return sources.select(key, code).mapInPandas(run, f"{key} {kind}, {SCHEMA}")


def symbols(found: DataFrame, key: str = "id") -> DataFrame:
    """A row for each module and for each of its ports."""
    none = lambda t: F.lit(None).cast(t)
    counts = ("ports", "parameters", "instances")

    def row(type_, name, direction, module, *n):
        return F.struct(F.lit(type_).alias("type"), name.alias("name"), direction.alias("direction"), module.alias("module"), *(x.alias(f"n_{c}") for c, x in zip(counts, n, strict=True)))

    own = row("module", F.col("module"), none("string"), none("string"), *(F.size(c).cast("int") for c in counts))
    port = F.transform("ports", lambda p: row("port", p["name"], p["direction"], F.col("module"), *(none("int") for _ in counts)))
    return found.select(key, F.explode(F.concat(F.array(own), port)).alias("x")).select(key, "x.*")  # one reading of found, which is parsed as it is read


def summary_line(found: DataFrame) -> F.Column:
    """A module in one line."""
    listed = lambda c, f: F.array_join(F.transform(F.col(c), f), ", ")
    port = lambda p: F.replace(F.concat_ws(" ", p["direction"], p["width"], p["name"]), F.lit("  "), F.lit(" "))
    inst = listed("instances", lambda i: F.concat(i["instance_name"], F.lit(":"), i["module_type"]))
    flag = F.when(F.col("infers_multiplier"), "True").otherwise("False")
    return F.concat(
        F.lit("module "), F.col("module"), F.lit(" | params: "), listed("parameters", lambda p: F.concat(p["name"], F.lit("="), p["default"])), F.lit(" | ports: "), listed("ports", port),
        F.lit(" | instances: "), F.when(inst == "", "none").otherwise(inst), F.lit(" | always="), F.col("always_blocks").cast("string"), F.lit(" | infers_multiplier="), flag,
    )
