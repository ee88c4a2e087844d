"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Seed of the draws and of the shuffle; largest mean for which the distribution is summed term by term. Larger
#: ones are drawn in pieces.
SEED, LARGEST_MEAN = 17, 500.0
#: Rates are broadcast where they are counted to have no more rows than this; beyond it both sides shuffle.
BROADCAST_ROWS = 100_000


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the parts: its first 52 bits."""
    text = F.concat_ws(":", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_inverse(u: Column, mean: Column) -> Column:
    """The smallest k whose distribution function exceeds u. Terms stop where they no longer add to the sum."""
    k_most = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    start = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("total"), F.lit(0).alias("k"))

    def step(s: Column, j: Column) -> Column:
        term = s["term"] * mean / j
        return F.when(u < s["total"], s).otherwise(F.struct(term.alias("term"), (s["total"] + term).alias("total"), j.alias("k")))

    return F.when(mean > 0, F.aggregate(F.sequence(F.lit(1), k_most), start, step, lambda s: s["k"])).otherwise(F.lit(0))


def draws(seed: int, id_col: Column, mean: Column) -> Column:
    """A Poisson number by a hash of seed and id. A mean above LARGEST_MEAN is cut into equal pieces no larger, each
    with its own draw: the sum of Poisson numbers is one of the sum of their means."""
    pieces = F.ceil(mean / LARGEST_MEAN).cast("int")
    us = F.transform(F.sequence(F.lit(1), pieces), lambda i: uniform(F.concat(F.lit(f"{seed}/"), i.cast("string")), id_col))
    many = F.aggregate(us, F.lit(0), lambda n, u: n + poisson_inverse(u, mean / pieces))
    return F.when(mean > LARGEST_MEAN, many).otherwise(poisson_inverse(uniform(F.lit(seed), id_col), mean))


def rates(docs: DataFrame, weights: DataFrame | None = None, size: float | None = None, source_col: str = "source") -> DataFrame:
    """(source, n_docs, rate): the mean number of copies that brings each source to its share of the result.

    weights has (source, weight); weights of one source add up, those that are null, NaN or negative count as 0.
    Sources that aren't named get none, and without weights all sources get the same. size is the number of documents wanted, by default as many as there are. Null is
    a source like any other.
    """
    counts = docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.count("*").alias("n_docs"))
    if weights is None:
        counts = counts.withColumn("weight", F.lit(1.0))
    else:
        weight = F.nanvl(F.col("weight").cast("double"), F.lit(0.0))
        w = weights.groupBy(F.col("source").alias("__source")).agg(F.sum(F.greatest(weight, F.lit(0.0))).alias("weight"))
        counts = counts.join(w, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
        counts = counts.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    whole = counts.agg(F.sum("weight").alias("all_weight"), F.sum("n_docs").cast("double").alias("all_docs"))
    wanted = F.lit(float(size)) if size is not None else F.col("all_docs")
    rate = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * wanted / F.col("n_docs")).otherwise(0.0)
    return counts.join(F.broadcast(whole)).select("source", "n_docs", rate.alias("rate"))


ADDED = ("__copy", "__rate", "__order")


def mix(docs: DataFrame, weights: DataFrame | None = None, size: float | None = None, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with each row as often as a Poisson draw says, in a global random order.

    Adds __copy (from 1), __rate and __order (in [0, 1); partitions follow it and are sorted by it); columns of docs
    with these names are replaced, all others stay as they are. The draw inverts the Poisson distribution of the
    source's rate at a hash of seed and doc_id, so it doesn't depend on partitioning and is the same when a lost
    executor's work is done again. Rows with equal doc_id draw alike and keep their order among themselves only up to
    ties; a null doc_id hashes as the empty string. An empty table gives no rows, and no row is read twice. The draw
    is made before any text moves: rows without copies are never shuffled. __order is spread evenly whatever the
    sources' sizes, so that its ranges need no sample.
    """
    r = settle(rates(docs, weights, size, source_col).select(F.col("source").alias("s"), F.col("rate")))
    if r.count() <= BROADCAST_ROWS:
        r = F.broadcast(r)
    kept = [c for c in docs.columns if c not in ADDED]
    inner = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("of"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    drawn = inner.join(r, F.col("of").eqNullSafe(F.col("s"))).withColumn("n", draws(seed, F.col("id"), F.col("rate"))).where("n > 0")
    copies = drawn.select("id", "rate", "row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    keyed = copies.withColumn("order", uniform(F.lit(seed + 1), F.col("id"), F.col("copy")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionById(parts, F.floor(F.col("order") * parts).cast("int")).sortWithinPartitions("order", "id", "copy")
    return dealt.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("copy").alias("__copy"), F.col("rate").alias("__rate"), F.col("order").alias("__order"))
