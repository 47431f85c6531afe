"""Templates as columns: places, conditions and loops become expressions that Spark evaluates.

`{{ name }}`, `{{ name.field | upper }}`, `{% if name %}..{% else %}..{% endif %}`
and `{% for x in names %}..{% endfor %}`, with `loop.index` inside. A value that
is null is empty; false, 0, "" and empty arrays don't hold.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.DOTALL)
#: Filters by name, of text to text.
FILTERS: dict[str, Callable[[Column], Column]] = {
    "upper": F.upper, "lower": F.lower, "trim": F.trim, "title": F.initcap, "length": lambda c: F.length(c).cast("string"),
    "quote": lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2),
}


def _value(name: str, scope: Mapping[str, Column]) -> Column:
    head, *fields = name.strip().split(".")
    if f"{head}.{'.'.join(fields)}" in scope:
        return scope[f"{head}.{'.'.join(fields)}"]
    if head not in scope:
        raise KeyError(f"the template names {head}, which has no value")
    out = scope[head]
    for f in fields:
        out = out[f]
    return out


def _holds(c: Column) -> Column:
    """Whether a value counts as true, by its text."""
    text = F.to_json(F.struct(c.alias("v")))  # null fields are left out
    return ~text.isin("{}", '{"v":false}', '{"v":""}', '{"v":[]}', '{"v":0}', '{"v":0.0}')


def _body(parts: Iterator[str], scope: Mapping[str, Column], until: tuple[str, ...]) -> tuple[Column, str]:
    """What stands up to one of some tags, and that tag."""
    out: list[Column] = []
    for part in parts:
        if part.startswith("{{"):
            name, *filters = part[2:-2].split("|")
            value = F.coalesce(_value(name, scope).cast("string"), F.lit(""))
            for f in filters:
                value = FILTERS[f.strip()](value)
            out.append(value)
        elif part.startswith("{%"):
            word, *rest = part[2:-2].split()
            if word in until:
                return F.concat(F.lit(""), *out), word
            if word == "if":
                cond = _holds(_value(rest[0], scope))
                yes, end = _body(parts, scope, ("else", "endif"))
                no = _body(parts, scope, ("endif",))[0] if end == "else" else F.lit("")
                out.append(F.when(cond, yes).otherwise(no))
            elif word == "for" and rest[1:2] == ["in"]:
                held = list(_until_endfor(parts))
                over = _value(rest[2], scope)
                each = lambda x, i, held=held, var=rest[0]: _body(iter(held), {**scope, var: x, "loop.index": i + 1}, ())[0]
                out.append(F.coalesce(F.array_join(F.transform(over, lambda x, i: each(x, i)), ""), F.lit("")))  # noqa: PLW0108
            else:
                raise ValueError(f"a template can't hold {part}")
        elif part:
            out.append(F.lit(part))
    if until:
        raise ValueError(f"the template ends before {until[-1]}")
    return F.concat(F.lit(""), *out), ""


def _until_endfor(parts: Iterator[str]) -> Iterator[str]:
    depth = 1
    for part in parts:
        word = part[2:-2].split()[:1] if part.startswith("{%") else []
        depth += (word == ["for"]) - (word == ["endfor"])
        if not depth:
            return
        yield part
    raise ValueError("the template ends before endfor")


def render(template: str, values: Mapping[str, Column]) -> Column:
    """A template filled from columns."""
    return _body(iter(_TAG.split(template)), values, ())[0]
