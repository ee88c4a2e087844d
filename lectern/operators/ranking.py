"""Top-k with defined ties, batch plans and capacity rules."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int | Column) -> DataFrame:
    """The first k rows of each group; add an id to order so that ties are defined. k may differ by row."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def boost(df: DataFrame, by: list[str], score: str, tie: str, strong: int, weak: int, unit: float) -> DataFrame:
    """Adds 2 units to each group's `strong` best finite scores, then 1 to its `weak` best of the raised ones."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), F.col(tie))
    a = df.withColumn("__r", F.row_number().over(w)).withColumn(score, F.when(F.col("__r") <= strong, F.col(score) + 2 * unit).otherwise(F.col(score)))
    return a.withColumn("__r", F.row_number().over(w)).withColumn(score, F.when(F.col("__r") <= weak, F.col(score) + unit).otherwise(F.col(score))).drop("__r")


def keep_best(df: DataFrame, by: list[str], score: str, k: int, tie: str) -> DataFrame:
    """The k best rows of each group, marked with their place by time instead of by score."""
    return top_k(df, by, [F.desc(score), F.col(tie)], k)


def plan_batches(df: DataFrame, by: list[str], length: str, tie: str, most_rows: int, most_total: float) -> DataFrame:
    """Batches of items by ascending length: an item joins while (items + 1) * its length fits most_total and the batch has
    fewer than most_rows; the first one always fits. Gives by, batch, items, longest. A batch's end depends on where it
    began, so it is a fold over a group's items, in the JVM."""
    s = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(length).cast("double").alias("len"), tie))).alias("s"))
    b = "struct<items:int,longest:double>"
    start = F.struct(F.array().cast(f"array<{b}>").alias("done"), F.lit(None).cast(b).alias("open"))

    def step(acc: Column, x: Column) -> Column:
        one = F.struct(F.lit(1).alias("items"), x["len"].alias("longest"))
        fits = acc["open"].isNotNull() & (acc["open"]["items"] < most_rows) & ((acc["open"]["items"] + 1) * x["len"] <= most_total)
        grown = F.struct((acc["open"]["items"] + 1).alias("items"), x["len"].alias("longest"))
        return F.struct(F.when(acc["open"].isNull() | fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"), F.when(fits, grown).otherwise(one).alias("open"))

    out = F.aggregate("s", start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))
    return s.select(*by, F.posexplode(out).alias("batch", "b")).select(*by, F.col("batch").cast("long").alias("batch"), F.col("b.items").cast("long").alias("items"), "b.longest")


def batch_cap(seconds: Column, free: Column, reference: float) -> Column:
    """Largest batch by the longest item, scaled by free memory; 1 where that isn't known."""
    cap = F.when(seconds <= 16, 14).when(seconds <= 24, 10).when(seconds <= 32, 8).otherwise(6)
    return F.when(free.isNull(), 1).otherwise(F.greatest(F.lit(1), F.floor(cap * free / reference))).cast("long")


def capacity(free: Column, safety: float, constant: Column, per_second: Column) -> Column:
    """Seconds that fit: null for a slope that isn't positive, never negative."""
    return F.when(per_second > 0, F.greatest(F.lit(0.0), (free - safety - constant) / per_second))


def continuous_batch(df: DataFrame, by: str, order: str, steps: str, slots: int) -> DataFrame:
    """(by, order, slot, enters, leaves): a batch of so many slots that rows enter in order and leave after their steps; the
    next row enters at the step at which a slot is free, the smallest of them. By groups, each one job's rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        free = [(0, s) for s in range(slots)]
        out = []
        for n in pdf[steps]:
            at, slot = heapq.heappop(free)
            heapq.heappush(free, (at + int(n), slot))
            out.append((slot, at, at + int(n)))
        return pdf[[by, order]].assign(**dict(zip(("slot", "enters", "leaves"), zip(*out, strict=True), strict=True)))

    return df.select(by, order, steps).groupBy(by).applyInPandas(run, f"{by} long, {order} long, slot long, enters long, leaves long")
