"""What the operators share: bounded Arrow batches, checkpoints and connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.scratch import release, shared_dir, store

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "bounded", "components", "forest", "pairs_within", "release", "rename_free", "settle", "shared_dir", "store", "tidy"]

#: Rows and bytes of one Arrow batch handed to Python, so that long texts don't add up.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder: it is computed once and outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def rename_free(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns can't clash with the operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def tidy(run: Callable, *also: Callable[[], None]) -> Callable:
    """run, whose worker hands back its memory at the end of a task: workers live on and serve other stages."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for f in also:
                f()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return tidied


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) for the edges a-b, without loops."""
    if not len(a):
        return a[:0], b[:0]
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        u, v = forest(np.concatenate([u, a]), np.concatenate([v, b]))
    for i in range(0, len(u), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(u[i : i + 50_000]), pa.array(v[i : i + 50_000])], ["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the edges; component is the smallest node reachable.

    Each partition first shrinks its edges to a forest, whose size its nodes bound. Rounds of the
    large-star and small-star steps follow until nothing changes. Minima are pre-aggregated before
    they are shuffled; they are checkpointed before they are joined, so that both sides of that join
    are plain exchanges and adaptive execution can split the rows of a hub. Loops and null ends are
    dropped; no edges give no rows.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = settle(e.mapInArrow(_contract, "u long, v long").distinct())
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = settle(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = settle(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = settle(small.union(low).distinct())


def pairs_within(lengths: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (i, j), i < j, of all pairs inside consecutive runs of the given lengths, in bounded chunks."""
    ends = np.repeat(np.cumsum(lengths), lengths)
    partners = ends - np.arange(len(ends)) - 1
    total = np.cumsum(partners)
    begin = 0
    while begin < len(ends):
        stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most, "right")))
        n = partners[begin:stop]
        i = np.repeat(np.arange(begin, stop), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        if len(i):
            yield i, j
        begin = stop
