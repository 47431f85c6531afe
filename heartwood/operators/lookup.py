"""Lookups by name: of rows, of processors, of providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import PROCESSOR_BYTES

# Languages that have a processor of their own, and those that share one.
PROCESSORS = ("python", "javascript", "java", "csharp", "go", "ruby", "rust", "php", "cobol", "fortran", "vb6", "powerbuilder", "r", "verilog")
SHARED = {"typescript": "javascript"}


def processor(language: Column) -> Column:
    """The processor of a language in any case; null where there is none."""
    low = F.lower(language)
    out = F.when(low.isin(*PROCESSORS), low)
    for name, same in SHARED.items():
        out = F.when(low == name, F.lit(same)).otherwise(out)
    return out


def readable(length: Column, most: int = PROCESSOR_BYTES) -> Column:
    """Whether a processor reads a file of so many bytes; a file that is missing has none."""
    return F.coalesce(length <= most, F.lit(False))


def route(named: Column, registered: tuple[str, ...]) -> Column:
    """The provider that is named, if it is registered; the first one otherwise."""
    return F.when(named.isin(*registered), named).otherwise(F.lit(registered[0] if registered else None))


def first_match(rows: DataFrame, condition: Column, *order: str) -> DataFrame:
    """The first row that meets a condition."""
    return rows.where(condition).orderBy(*order).limit(1)


def join_first(rows: DataFrame, dim: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """rows with the value of the first of dim's rows of their key; null where there is none. Dim is aggregated before the join."""
    return rows.join(dim.groupBy(key).agg(F.min_by(value, order).alias(value)), key, "left")
