"""Running values over long sequences in two levels: within ranges of the order, and over the ranges' totals.

A window over a whole group would sort it in one task. Here a task sees one range of a group, and another one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order column that a range has.
WIDTH = 4096


def _ranged(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("__range", F.floor(F.col(order) / width))


def _with_totals(df: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """Joined by group and range; a null group is a group."""
    t = totals.select(*[F.col(c).alias(f"__{k}") for k, c in enumerate(by)], F.col("__range").alias("__r"), "__carried")
    on = F.col("__range") == F.col("__r")
    for k, c in enumerate(by):
        on &= F.col(c).eqNullSafe(F.col(f"__{k}"))
    return df.join(t, on).drop("__r", *[f"__{k}" for k in range(len(by))])


def _before(by: list[str], *order: str):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def preceding(df: DataFrame, by: list[str], order: str, value: Column, out: str, width: int = WIDTH) -> DataFrame:
    """df with the nearest value that isn't null in a row before; order is a number without ties in its group."""
    r = _ranged(df, order, width).withColumn("__v", value)
    last = r.groupBy(*by, "__range").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(order))).alias("__last"))
    last = last.withColumn("__carried", F.last("__last", True).over(_before(by, "__range")))
    own = F.last("__v", True).over(_before([*by, "__range"], order))
    return _with_totals(r.withColumn(out, own), last, by).withColumn(out, F.coalesce(out, "__carried")).drop("__v", "__range", "__carried")


def sum_before(df: DataFrame, by: list[str], order: str, value: str, out: str, width: int = WIDTH) -> DataFrame:
    """df with the sum of value over the rows before; order is a number without ties in its group."""
    r = _ranged(df, order, width)
    total = r.groupBy(*by, "__range").agg(F.sum(value).alias("__sum"))
    total = total.withColumn("__carried", F.coalesce(F.sum("__sum").over(_before(by, "__range")), F.lit(0)))
    own = F.coalesce(F.sum(value).over(_before([*by, "__range"], order)), F.lit(0))
    return _with_totals(r.withColumn(out, own), total, by).withColumn(out, F.col(out) + F.col("__carried")).drop("__range", "__carried")


def numbered(df: DataFrame, order: list[str], out: str, width: int = WIDTH) -> DataFrame:
    """df with each row's place from 1 in the given order, whose first column is a number."""
    r = _ranged(df, order[0], width)
    count = r.groupBy("__range").agg(F.count("*").alias("__n"))
    count = count.withColumn("__carried", F.coalesce(F.sum("__n").over(_before([], "__range")), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return _with_totals(r.withColumn(out, own), count, []).withColumn(out, F.col(out) + F.col("__carried")).drop("__range", "__carried")
