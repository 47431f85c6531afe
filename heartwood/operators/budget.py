"""Running costs against a ceiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.state import cut

# The ceiling and the price of a call, where none are given.
CEILING, PRICE = 1.00, 0.01


def admit(plan: DataFrame, cost: Column | str, ceiling: float = CEILING, order: tuple = ("phase", "ord"), by: tuple[str, ...] = ()) -> DataFrame:
    """plan with `running` cost in order and `admitted`: whether it stays within the ceiling (reaching it is allowed).

    Once a row is refused, all later ones are. The window is per `by`; without it, all planned
    rows, which are few beside the data, are ordered in one place, as a single ceiling asks for.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    price = F.col(cost) if isinstance(cost, str) else cost
    run = plan.withColumn("running", F.sum(price).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.withColumn("admitted", F.max("running").over(w.rowsBetween(Window.unboundedPreceding, 0)) <= F.lit(ceiling))


def admit_all(plan: DataFrame, cost: str, ceiling: float = CEILING, order: tuple[str, ...] = ("phase", "ord"), parts: int | None = None) -> DataFrame:
    """admit() for one ceiling over any number of rows, by prefix sums of two levels.

    Rows are dealt in order to ranges, written once with their range's number and
    summed within it; the ranges' sums, a row each, give what ran before a range.
    Costs are added as decimals of 12 places, so that sums do not depend on how rows are dealt.
    """
    n = parts or int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    exact = plan.withColumn("__cost", F.coalesce(F.col(cost), F.lit(0)).cast("decimal(26,12)"))
    dealt = cut(exact.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    sums = dealt.groupBy("__part").agg(F.sum("__cost").alias("__sum"))  # a row for each range
    before = sums.select("__part", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.join(F.broadcast(before), "__part").withColumn("__run", F.sum("__cost").over(within) + F.col("__before"))
    # costs are not negative, so that once a row is refused all later ones are
    return run.withColumn("running", F.col("__run").cast("double")).withColumn("admitted", F.col("__run") <= F.lit(ceiling).cast("decimal(26,12)")).drop("__cost", "__part", "__before", "__run")


def spend(admitted: DataFrame) -> DataFrame:
    """(calls, spent) of the admitted rows."""
    return admitted.where("admitted").agg(F.count("*").alias("calls"), F.coalesce(F.max("running"), F.lit(0.0)).alias("spent"))


def remaining(spent: Column, ceiling: Column | float = CEILING) -> Column:
    """What is left of a ceiling, never below 0."""
    return F.greatest(F.lit(0.0), (F.lit(ceiling) if isinstance(ceiling, float) else ceiling) - spent)


def capped(rows: DataFrame, by: str, order: str, cap: int) -> DataFrame:
    """The first rows of each group, with the group's total and whether rows were left out."""
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("n") <= cap)  # each task keeps its own first rows before the shuffle
    total = rows.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("total"))
    return first.join(total, F.col(by).eqNullSafe(F.col("__by"))).select(*rows.columns, "total", "n").withColumn("truncated", F.col("total") > cap)
