"""Text assembly and predicates as columns."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that flag patterns, and phrases of refused clones.
LOGIC_WORDS = ("transaction", "validation", "calculation", "workflow")
VENDOR_MARKS = {"spring-boot": "@SpringBootApplication", "django": "from django"}
REFUSALS = ("could not read username", "authentication failed", "repository not found", "permission denied", "fatal: authentication failed")


def clip(text: Column, n: int = 50) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def fence(code: Column, label: Column | str = "text") -> Column:
    return F.concat(F.lit("```"), F.lit(label) if isinstance(label, str) else label, F.lit("\n"), code, F.lit("\n```"))


def logic_flags(code: Column) -> Column:
    low = F.lower(code)
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in LOGIC_WORDS)))


def vendor_flags(code: Column) -> Column:
    return F.array_compact(F.array(*(F.when(F.contains(code, F.lit(m)), F.lit(k)) for k, m in VENDOR_MARKS.items())))


def is_refused(error: Column) -> Column:
    """Whether a clone's error says that the repository is private."""
    low = F.lower(error)
    out = F.lit(False)
    for p in REFUSALS:
        out = out | F.contains(low, F.lit(p))
    return F.coalesce(out, F.lit(False))


def is_blank(text: Column) -> Column:
    return text.rlike(r"(?U)^\s*$")


def _name_chars(part: Column) -> Column:
    """Whether a part of an address is made of letters, digits, underscores, dots and hyphens, of which there is one."""
    return part.rlike(r"(?U)^[\w.-]+$")


def repo_url_ok(url: Column, host: str = "github.com") -> Column:
    """Whether an address is https, the host, an owner and a name, and nothing more than a last slash."""
    parts = F.split(url, "/")
    part = lambda i: F.get(parts, F.lit(i))
    ends = (F.size(parts) == 5) | ((F.size(parts) == 6) & (part(5) == ""))
    return (part(0) == "https:") & (part(1) == "") & (part(2) == host) & ends & F.coalesce(_name_chars(part(3)) & _name_chars(part(4)), F.lit(False))


def repo_slug(url: Column, host: str = "github.com") -> Column:
    """owner-name of a repository's address, of either form and with anything after the name, or a digest of any other address."""
    places = [F.substring_index(url, host + mark, 1) for mark in "/:"]
    head = F.when(F.length(places[0]) <= F.length(places[1]), places[0]).otherwise(places[1])  # what stands before the host
    tail = F.substring(url, F.length(head) + F.lit(len(host) + 2), F.length(url))
    parts = F.split(tail, "/")
    owner, name = F.get(parts, F.lit(0)), F.substring_index(F.get(parts, F.lit(1)), ".git", 1)
    good = (F.length(head) < F.length(url)) & (F.coalesce(owner, F.lit("")) != "") & (F.coalesce(name, F.lit("")) != "")
    return F.when(good, F.concat_ws("-", owner, name)).otherwise(F.substring(F.md5(url.cast("binary")), 1, 16))


def percent(part: Column, whole: Column) -> Column:
    """part in whole as a percentage, 0 where whole isn't positive."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def mergeable(state: Column, can: Column, merged: Column) -> Column:
    return F.coalesce((state == "open") & can.eqNullSafe(F.lit(True)) & ~F.coalesce(merged, F.lit(False)), F.lit(False))


def missing_fields(body: Column, required: tuple[str, ...]) -> Column:
    """Required keys that a map has no value for."""
    return F.array_except(F.array(*map(F.lit, required)), F.map_keys(F.map_filter(body, lambda k, v: v.isNotNull() & (v != ""))))


def task_label(task: Column, known: Mapping[str, str] = {}) -> Column:  # noqa: B006
    """A task's description; of others the words of its name."""
    out = F.initcap(F.replace(task, F.lit("_"), F.lit(" ")))
    for k, v in known.items():
        out = F.when(task == k, F.lit(v)).otherwise(out)
    return out


def fill(template: str, values: Mapping[str, Column]) -> Column:
    """A template with `{{ name }}` places, filled from columns."""
    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    return F.concat(*(F.lit(p) if i % 2 == 0 else F.coalesce(values[p].cast("string"), F.lit("")) for i, p in enumerate(parts)))


def safe_name(repo: Column) -> Column:
    """A repository's name as one part of a path."""
    return F.replace(repo, F.lit("/"), F.lit("__"))


def fresh(expires: Column, now: Column, minutes: int = 5) -> Column:
    """Whether a token still holds for some minutes."""
    return expires > now + F.make_dt_interval(mins=F.lit(minutes))


def expiry(issued: Column, minutes: Column, most: int = 10) -> Column:
    """Epoch second at which a token of so many minutes, most at most, ends."""
    return issued + F.least(minutes, F.lit(most)) * 60


def error_title(error: Column) -> Column:
    return F.when(F.contains(F.lower(error), F.lit("private repository")), "Private Repository Access").otherwise("Processing Error")


def provider_state(healthy: Column, enabled: Column) -> Column:
    """healthy; unhealthy where it is enabled only; else disabled."""
    return F.when(healthy, "healthy").when(enabled, "unhealthy").otherwise("disabled")


def cost_label(cost: Column) -> Column:
    """The price of 1,000 tokens; none or 0 is free."""
    return F.when(F.coalesce(cost, F.lit(0.0)) != 0, F.format_string("$%.4f/1K tokens", cost)).otherwise("Free")
