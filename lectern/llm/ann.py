"""Approximate nearest neighbours by inner product: a robust-pruned directed graph per shard, searched by beams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, settle

#: Out-neighbours of a node, and up to how many backward edges may bring it before it is pruned again.
DEGREE, SLACK = 32, 64
#: Beam of the searches that propose neighbours, and of queries; nodes a beam expands at once; relaxation of pruning.
BUILD_BEAM, QUERY_BEAM, EXPAND, ALPHA = 64, 160, 4, 1.2
#: Distinct vectors that are worth a shard, and vectors of a shard at most, about, once all tasks have one; queries of a
#: block. Every query visits every shard, so fewer, larger shards cost less, and more of them build side by side.
SHARD_ROWS, MOST_ROWS, BLOCK_QUERIES = 8192, 32_768, 50_000
BATCH, SEED = 256, 23


class Graph:
    """Directed graph over points x; distances are squared Euclidean."""

    def __init__(self, x: np.ndarray, edges: np.ndarray | None = None):
        self.x = np.ascontiguousarray(x, np.float32)
        self.norms = (self.x * self.x).sum(1)
        self.entry = int(((self.x - self.x.mean(0)) ** 2).sum(1).argmin()) if len(x) else 0
        self.edges = edges
        if edges is None:
            self._build()

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam [query, beam] of nearest nodes found, nearest first (-1 where fewer), and their distances less |q|^2."""
        n = len(q)
        ids = np.full((n, beam), -1)
        dist = np.full((n, beam), np.inf, np.float32)
        done = np.ones((n, beam), bool)
        stamp = np.full((n, len(self.x) + 1), -1, np.int32)
        ids[:, 0], dist[:, 0], done[:, 0] = self.entry, self.norms[self.entry] - 2 * (q @ self.x[self.entry]), False
        stamp[:, self.entry] = 0
        wide = EXPAND * self.edges.shape[1]
        columns = np.arange(1, wide + 1, dtype=np.int32)
        while True:
            todo = ~done & (np.cumsum(~done, axis=1) <= EXPAND)
            live = np.flatnonzero(todo.any(1))
            if not len(live):
                return ids, dist
            r, c = np.nonzero(todo)
            done[r, c] = True
            slot = np.cumsum(todo, axis=1)[r, c] - 1
            near = np.full((n, EXPAND, self.edges.shape[1]), -1)
            near[r, slot] = self.edges[ids[r, c]]
            near = near[live].reshape(len(live), wide)
            at = live[:, None]
            fresh = (near >= 0) & (stamp[at, near] < 0)
            stamp[at, np.where(fresh, near, len(self.x))] = columns
            fresh &= stamp[at, near] == columns  # one of equal neighbours stays
            i, j = np.nonzero(fresh)
            to, of = near[i, j], live[i]
            d = np.full(near.shape, np.inf, np.float32)
            d[i, j] = self.norms[to] - 2 * np.einsum("ij,ij->i", self.x[to], q[of])
            all_ids = np.concatenate([ids[live], near], axis=1)
            all_dist = np.concatenate([dist[live], d], axis=1)
            all_done = np.concatenate([done[live], np.zeros(near.shape, bool)], axis=1)
            best = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(all_dist, best, 1), axis=1, kind="stable"), 1)
            dist[live] = np.take_along_axis(all_dist, best, 1)
            ids[live] = np.where(np.isfinite(dist[live]), np.take_along_axis(all_ids, best, 1), -1)
            done[live] = np.take_along_axis(all_done, best, 1) | ~np.isfinite(dist[live])

    def prune(self, of: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Up to DEGREE diverse ones of candidates [node, m] (-1: none) for each node: the nearest stays and drops all
        that are ALPHA times nearer to it than to the node, then the nearest of what is left, and so on."""
        c = np.where(candidates == of[:, None], -1, candidates)
        ordered = np.sort(c, axis=1)
        ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
        safe = np.maximum(ordered, 0)
        y = self.x[safe]
        d = self.norms[of][:, None] + self.norms[safe] - 2 * np.einsum("ijk,ik->ij", y, self.x[of])
        d = np.where(ordered >= 0, np.maximum(d, 0), np.inf)
        order = np.argsort(d, axis=1, kind="stable")[:, :128]
        c, d = np.take_along_axis(ordered, order, 1), np.take_along_axis(d, order, 1)
        y, norms = np.take_along_axis(y, order[:, :, None], 1), self.norms[np.maximum(c, 0)]
        between = np.maximum(norms[:, :, None] + norms[:, None, :] - 2 * (y @ y.transpose(0, 2, 1)), 0)
        alive = np.isfinite(d)
        out = np.full((len(of), SLACK), -1)
        at = np.arange(len(of))
        for k in range(DEGREE):
            some = alive.any(1)
            if not some.any():
                break
            first = alive.argmax(1)
            out[some, k] = c[at, first][some]
            alive &= ALPHA**2 * between[at, first] > d
            alive[at, first] = False
        return out

    def _build(self) -> None:
        n = len(self.x)
        r = np.random.default_rng(SEED)
        self.edges = np.full((n, SLACK), -1)
        if n <= DEGREE + 1:
            for i in range(n):
                self.edges[i, : n - 1] = np.delete(np.arange(n), i)
            return
        start = r.integers(0, n, (n, 8))
        self.edges[:, :8] = np.where(start == np.arange(n)[:, None], (start + 1) % n, start)
        order, begin = r.permutation(n), 0
        while begin < n:
            some = order[begin : begin + min(BATCH, max(16, begin))]
            begin += len(some)
            found, _ = self.search(self.x[some], BUILD_BEAM)
            self.edges[some] = self.prune(some, np.concatenate([found, self.edges[some]], axis=1))
            a, b = np.repeat(some, SLACK), self.edges[some].ravel()
            a, b = a[b >= 0], b[b >= 0]
            by = np.argsort(b, kind="stable")
            a, b = a[by], b[by]
            to, first, size = np.unique(b, return_index=True, return_counts=True)
            extra = np.full((len(to), int(size.max())), -1)
            extra[np.repeat(np.arange(len(to)), size), np.arange(len(b)) - np.repeat(first, size)] = a
            held = (self.edges[to] >= 0).sum(1)
            fits = held + size <= SLACK
            k = np.flatnonzero(fits)
            where = np.repeat(k, size[k])
            nth = np.arange(len(where)) - np.repeat(np.cumsum(size[k]) - size[k], size[k])
            self.edges[to[where], held[where] + nth] = extra[where, nth]
            over = np.flatnonzero(~fits)
            for s in range(0, len(over), BATCH):
                o = over[s : s + BATCH]
                self.edges[to[o]] = self.prune(to[o], np.concatenate([self.edges[to[o]], extra[o]], axis=1))


def _valid(column: str):
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(F.col(column).isNotNull() & finite & F.exists(column, lambda c: c != 0), F.lit(False))


def vectors_of(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows whose vector isn't null, empty or zero and holds only finite numbers."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    return rows.where(_valid("v") & F.col("id").isNotNull())


def build_index(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(shard, node, v, ids, edges): the graphs over all distinct vectors.

    Equal vectors are one node with the k + 1 smallest of their ids: no others can be among k nearest. The
    limit is applied before rows are shuffled, so many copies cost little. Vectors shorter than the longest one are
    left out. Nodes are dealt to shards by a hash; every vector gets a component more, the root of M^2 - |v|^2, so that Euclidean order is that of
    the inner product.
    """
    bounded(vectors.sparkSession)
    rows = vectors_of(vectors, id_col, vector_col).distinct()
    rows = rows.where(F.size("v") == (rows.agg(F.max(F.size("v"))).first()[0] or 0))
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("rn") <= k + 1)
    nodes = settle(ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    n, longest = nodes.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))).first()
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, min(-(-n // shard_rows), tasks), -(-n // max(shard_rows, MOST_ROWS)))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first").reset_index(drop=True)
        x = np.stack(pdf["v"].to_numpy())
        tall = np.sqrt(np.maximum(longest - (x * x).sum(1), 0))
        g = Graph(np.concatenate([x, tall[:, None]], axis=1))
        return pdf.assign(node=np.arange(len(pdf), dtype=np.int32), edges=[e[e >= 0].astype(np.int32) for e in g.edges])[["shard", "node", "v", "ids", "edges"]]

    dealt = nodes.withColumn("first", F.col("ids")[0]).withColumn("shard", F.pmod(F.xxhash64("first"), F.lit(shards)).cast("int"))
    return settle(dealt.groupBy("shard").applyInPandas(build, "shard int, node int, v array<double>, ids array<long>, edges array<int>"))


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = QUERY_BEAM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k best found by inner product in double precision,
    without the query's own id; ties go to the smaller vec_id; fewer where there are fewer. Rows without an id take no
    part, nor do vectors of another length than the longest of the table. No queries or an empty index give no rows.

    Every query visits every shard, in blocks, and brings k answers from each; these are ranked per query.
    Queries whose vector is null, zero or not finite take no part. Rows that repeat an id and vector count once.
    """
    asked = vectors_of(queries, id_col, vector_col).distinct().join(F.broadcast(index.agg(F.max(F.size("v")).alias("n"))), F.size("v") == F.col("n")).drop("n")
    last = index.agg(F.max("shard")).first()[0]
    if last is None:
        return asked.limit(0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last))))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def answer(nodes: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(nodes) and len(q):
            nodes = nodes.sort_values("node")
            x = np.stack(nodes["v"].to_numpy())
            norms = (x * x).sum(1)
            tall = np.sqrt(np.maximum(norms.max() - norms, 0))
            edges = np.full((len(x), SLACK), -1)
            for i, e in enumerate(nodes["edges"]):
                edges[i, : len(e)] = e
            g = Graph(np.concatenate([x, tall[:, None]], axis=1), edges)
            ids = nodes["ids"].to_numpy()
            v = np.stack(q["v"].to_numpy())
            for s in range(0, len(q), BATCH):
                some = v[s : s + BATCH]
                found, _ = g.search(np.concatenate([some, np.zeros((len(some), 1))], axis=1).astype(np.float32), min(max(beam, 2 * k), max(len(x), 2)))
                for own, one, near in zip(q["id"].to_numpy()[s : s + BATCH], some, found, strict=True):
                    near = near[near >= 0]
                    score = np.einsum("ij,j->i", x[near], one)
                    size = np.array([len(ids[i]) for i in near])
                    who = np.concatenate([ids[i] for i in near])
                    score = np.repeat(score, size)[who != own]
                    who = who[who != own]
                    top = np.lexsort((who, -score))[:k]
                    out.append(pd.DataFrame({"query_id": own, "vec_id": who[top], "score": score[top]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    keys = ("shard", "block")
    found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(lambda a, b: answer(a, b), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
