"""Processors of languages as table functions, for use in SQL with LATERAL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import extract, lookup

#: What a processor gives: a symbol's type and name, and its properties as JSON.
SYMBOL = StructType([StructField(n, StringType()) for n in ("type", "name", "details")])
_MODULE = ("module", "parameters", "ports", "instances", "always_blocks", "assigns", "infers_multiplier")


class Symbols:
    """Symbols of code in a language; none where the language has no processor, and none of null code."""

    @staticmethod
    def analyze(code: AnalyzeArgument, language: AnalyzeArgument) -> AnalyzeResult:
        for arg, name in ((code, "code"), (language, "language")):
            if not isinstance(arg.dataType, StringType):
                raise ValueError(f"{name} has to be a string")
        return AnalyzeResult(SYMBOL)

    def eval(self, code: str | None, language: str | None):
        process = PROCESSORS.get((language or "").lower())
        if process is not None and code is not None:
            yield from process(code)


class Modules:
    """Modules of hardware source, one row each, with the columns of extract_modules()."""

    def eval(self, code: str | None):
        for m in extract.modules(code) if code is not None else ():
            yield tuple(m[n] for n in _MODULE)


def _verilog(code: str):
    import json

    for m in extract.modules(code):
        yield "module", m["module"], json.dumps({"assigns": m["assigns"], "instances": len(m["instances"])})
        for p in m["ports"]:
            yield "port", p["name"], json.dumps({"direction": p["direction"], "module": m["module"]})


#: Processors by language; register() makes others known.
PROCESSORS = {"verilog": _verilog}


def register(spark: SparkSession) -> None:
    """Make the table functions `symbols(code, language)` and `modules(code)` known to a session's SQL."""
    spark.udtf.register("symbols", F.udtf(Symbols))
    spark.udtf.register("modules", F.udtf(Modules, returnType=extract.SCHEMA))


def processed(files: DataFrame, code: str = "code", language: str = "language", key: str = "id") -> DataFrame:
    """(key, type, name, details) of files, each by its language's processor."""
    own = files.select(key, F.col(code).alias("code"), lookup.processor(F.col(language)).alias("language")).where("language IS NOT NULL")
    return own.lateralJoin(F.udtf(Symbols)(F.col("code").outer(), F.col("language").outer())).select(key, "type", "name", "details")
