"""Clustering of embeddings within a recording, assignment to centroids, language-model scores."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.vectors import cosine

from . import ranges


#: A cluster of so many items keeps so many of the clusters nearest to it when it searched all.
LARGE, NEIGHBOURS = 32, 1024


class _Clusters:
    """Centres of the clusters that are there, and exact searches for the nearest one. Centres less their mean, in single
    precision, say which few can be the nearest; distances themselves are in double precision from the centres."""

    def __init__(self, x: np.ndarray):
        n, self.dim = x.shape
        self.centre = np.zeros((2 * n - 1, self.dim))
        self.centre[:n] = x
        self.there = np.zeros(2 * n - 1, bool)
        self.there[:n] = True
        good = np.isfinite(x).all(1)
        self.mean = x[good].mean(0) if good.any() else np.zeros(self.dim)
        moved = np.where(good[:, None], x - self.mean, 0)
        norms = (moved * moved).sum(1)
        self.most = norms.max()
        kind = np.float32 if 1e-20 < self.most < 1e30 else np.float64
        self.ids, self.low, self.square = np.arange(n), moved.astype(kind), np.where(good, norms, np.inf).astype(kind)
        self.ids, self.low, self.square = (np.concatenate([v, np.zeros((n // 8 + 64, *v.shape[1:]), v.dtype)]) for v in (self.ids, self.low, self.square))
        self.count, self.gone = n, 0
        self.slack = 4 * (self.dim + 16) * float(np.finfo(kind).eps) * self.most  # twice what a product's roundings can come to

    def add(self, k: int) -> None:
        if self.count == len(self.ids):
            keep = np.flatnonzero(self.there[self.ids])
            keep = keep[self.ids[keep] != k]
            for v in (self.ids, self.low, self.square):
                v[: len(keep)] = v[keep]
            self.count = len(keep)
        at, v = self.count, self.centre[k] - self.mean
        good = np.isfinite(v).all()
        self.ids[at], self.low[at], self.square[at] = k, v if good else 0, v @ v if good else np.inf
        self.there[k] = True
        self.count += 1

    def remove(self, k: int) -> None:
        self.there[k] = False
        self.square[np.searchsorted(self.ids[: self.count], k)] = np.inf

    def exact(self, some: np.ndarray, j: int) -> np.ndarray:
        return ((self.centre[some] - self.centre[j]) ** 2).sum(1)

    def pick(self, some: np.ndarray, j: int) -> tuple[float, int]:
        """The least distance and the smallest cluster that has it; some are in order and not empty."""
        d = self.exact(some, j)
        d[np.isnan(d)] = np.inf
        at = int(d.argmin())
        return float(d[at]), int(some[at])

    def search(self, j: int, keep: bool = False) -> tuple[float, int, tuple | None]:
        """The nearest cluster before j that is there, if any; with keep also what near() takes."""
        p = int(np.searchsorted(self.ids[: self.count], j))
        v = self.centre[j] - self.mean
        if not np.isfinite(v).all():
            before = self.ids[:p][self.there[self.ids[:p]]]
            return (np.inf, int(before[0]), None) if len(before) else (np.inf, -1, None)
        about = self.square[:p] - 2 * (self.low[:p] @ v.astype(self.low.dtype))
        least = about.min() if p else np.inf
        if not np.isfinite(least):  # none but those that aren't finite
            before = self.ids[:p][self.there[self.ids[:p]]]
            return (np.inf, int(before[0]), None) if len(before) else (np.inf, -1, None)
        d, i = self.pick(self.ids[np.flatnonzero(about <= least + 2 * self.slack)], j)
        if not keep or p <= 2 * NEIGHBOURS:
            return d, i, None
        part = np.argpartition(about, NEIGHBOURS)[: NEIGHBOURS + 1]
        part = part[np.argsort(about[part], kind="stable")]
        least = np.sqrt(np.maximum(about[part].astype(float) + float(v @ v) - self.slack, 0))
        return d, i, (self.centre[j].copy(), self.ids[part[:-1]], least, j)

    def near(self, j: int, known: tuple) -> tuple[float, int] | None:
        """The nearest cluster before j from what a search from another centre kept, if that suffices: all others that were
        there then are at least as far from j as they were from that centre, less how far j is from it."""
        centre, some, least, then = known
        later = self.ids[np.searchsorted(self.ids[: self.count], then) : self.count]
        if len(later) > NEIGHBOURS:
            return None
        moved = np.sqrt(((self.centre[j] - centre) ** 2).sum())
        later = later[later < j]
        for many in (64, NEIGHBOURS):
            tried = np.sort(np.concatenate([some[:many], later]))
            tried = tried[self.there[tried]]
            if len(tried):
                d, i = self.pick(tried, j)
                if np.sqrt(d) < (least[min(many, NEIGHBOURS)] - moved) * (1 - 1e-9):
                    return d, i
        return None

    def first(self) -> Iterator[tuple[float, int, int]]:
        """(distance, i, j) of the nearest cluster i before each of the first ones j."""
        n, a = self.count, 1
        left = np.concatenate([-2 * self.low[:n], np.ones((n, 1), self.low.dtype)], axis=1)
        right = np.concatenate([self.low[:n], self.square[:n, None]], axis=1)
        while a < n:
            b = min(n, a + max(1, (1 << 20) // (a + 1)), 2 * a)
            about = left[a:b] @ right[:b].T
            about[:, a:][np.triu_indices(b - a)] = np.inf
            limit = about.min(1) + 2 * self.slack
            row, col = np.divmod(np.flatnonzero(about <= limit[:, None]), b)
            ends = np.searchsorted(row, np.arange(b - a + 1))
            for r in range(b - a):
                j = a + r
                if np.isfinite(limit[r]) and np.isfinite(self.square[j]):
                    d, i = self.pick(col[ends[r] : ends[r + 1]], j)
                else:
                    d, i = np.inf, 0
                yield d, i, j
            a = b


def linkage(x: np.ndarray) -> np.ndarray:
    """Centroid linkage: rows (left, right, distance, size), the pair of nearest centroids each time, the smaller indices
    on ties; clusters are numbered from n on. What isn't finite is at no distance and comes last.

    A cluster knows the nearest of those before it. As long as it is there these only become fewer, so what it knows
    stays a lower bound, and it searches again only where its bound is the least of all. A large cluster moves little in
    a merge and mostly finds its nearest among those near it before. Memory grows with the items, not with their pairs."""
    n = len(x)
    if n < 2:
        return np.empty((0, 4))
    c, size, out = _Clusters(x), np.ones(2 * n - 1, np.int64), []
    queue = list(c.first())
    heapq.heapify(queue)
    around: dict[int, tuple] = {}
    for k in range(n, 2 * n - 1):
        while True:
            d, i, j = heapq.heappop(queue)
            if not c.there[j]:
                continue
            if c.there[i]:
                break
            d, i, known = c.search(j)
            if i >= 0:
                heapq.heappush(queue, (d, i, j))
        size[k] = size[i] + size[j]
        out.append((i, j, float(np.sqrt(d)), int(size[k])))
        c.centre[k] = (c.centre[i] * size[i] + c.centre[j] * size[j]) / size[k]
        c.remove(i)
        c.remove(j)
        c.add(k)
        parts = around.pop(i, None), around.pop(j, None)
        known = parts[0] if size[i] >= size[j] else parts[1]
        found = c.near(k, known) if known else None
        if found is None:
            *found, known = c.search(k, size[k] >= LARGE)
        if known:
            around[k] = known
        if found[1] >= 0:
            heapq.heappush(queue, (*found, k))
    return np.array(out).reshape(-1, 4)


def cut(merges: np.ndarray, n: int, distance: float | None = None, clusters: int | None = None) -> np.ndarray:
    """Labels by first appearance after all merges up to a distance, or after as many as leave so many clusters."""
    parent = list(range(n + len(merges)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    take = merges[: max(0, n - clusters)] if clusters is not None else merges
    for step, (i, j, d, _) in enumerate(take):
        if distance is None or d <= distance:
            parent[root(int(i))] = parent[root(int(j))] = n + step
    first: dict[int, int] = {}
    return np.array([first.setdefault(root(i), len(first)) for i in range(n)], np.int64)


def cluster(df: DataFrame, by: str, item: str, vector: str, distance: float | None = None, clusters: int | None = None) -> DataFrame:
    """(by, item, cluster) by centroid linkage within each recording, whose embeddings are one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item)
        x = np.stack(pdf[vector].to_numpy())
        return pd.DataFrame({by: pdf[by], item: pdf[item], "cluster": cut(linkage(x), len(x), distance, clusters)})

    return df.select(by, item, vector).groupBy(by).applyInPandas(run, f"{by} long, {item} long, cluster long")


def vbx(x: np.ndarray, phi: np.ndarray, start: np.ndarray, fa: float = 0.07, fb: float = 0.8, rounds: int = 20, tolerance: float = 1e-4) -> np.ndarray:
    """Variational refinement of speaker responsibilities [item, speaker] from start, for whitened vectors x with
    between-speaker variances phi: the published update equations of the Bayesian mixture without transitions. Priors
    start even; the bound is compared from the second round on."""
    gamma = start / start.sum(1, keepdims=True)
    pi = np.full(gamma.shape[1], 1 / gamma.shape[1])
    const = -0.5 * ((x * x).sum(1) + x.shape[1] * np.log(2 * np.pi))
    rho, before = x * np.sqrt(phi), -np.inf
    for _ in range(rounds):
        inv = 1 / (1 + fa / fb * gamma.sum(0)[:, None] * phi)
        alpha = fa / fb * inv * (gamma.T @ rho)
        logp = fa * (rho @ alpha.T - 0.5 * ((inv + alpha**2) @ phi) + const[:, None])
        joint = logp + np.log(pi + 1e-8)
        top = joint.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(joint - top).sum(1))
        gamma = np.exp(joint - total[:, None])
        pi = gamma.sum(0) / gamma.sum()
        elbo = total.sum() + fb * 0.5 * (np.log(inv) - inv - alpha**2 + 1).sum()
        if elbo - before < tolerance:
            break
        before = elbo
    return gamma


def refine(df: DataFrame, by: str, item: str, vector: str, label: str, phi: list[float] | None = None, sharp: float = 7.0) -> DataFrame:
    """(by, item, cluster) after vbx from the labels given, softened; clusters that keep items are numbered in the order
    of their labels. phi are the between-speaker variances of the whitened dimensions, all one where not given. A
    recording with one label stays as it is."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item)
        x = np.stack(pdf[vector].to_numpy()).astype(float)
        kinds, at = np.unique(pdf[label], return_inverse=True)
        start = np.exp(sharp * (np.arange(len(kinds)) == at[:, None]))
        best = vbx(x, np.ones(x.shape[1]) if phi is None else np.asarray(phi), start).argmax(1) if len(kinds) > 1 else at
        return pd.DataFrame({by: pdf[by], item: pdf[item], "cluster": np.unique(best, return_inverse=True)[1]})

    return df.select(by, item, vector, label).groupBy(by).applyInPandas(run, f"{by} long, {item} long, cluster long")


def train_subset(df: DataFrame, by: list[str], clean: str, total: str, ratio: float = 0.1) -> DataFrame:
    """The items to cluster first: those with enough clean frames, a share of all of theirs, rounded half to even, and one
    at least. All items of a recording where fewer than two have so many."""
    enough = F.col(clean) >= F.greatest(F.lit(1), F.bround(F.col(total) * F.lit(ratio)).cast("long"))
    count = df.groupBy(*by).agg(F.count_if(enough).alias("__enough"))
    return df.join(count, by).where((F.col("__enough") < 2) | enough).drop("__enough")


def centroids(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(cluster, centroid): means by dimension, pre-aggregated per dimension."""
    e = df.select(cluster, F.posexplode(vector).alias("i", "v")).groupBy(cluster, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return e.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select(cluster, F.transform("c", lambda x: x["m"]).alias("centroid"))


def nearest_centroid(df: DataFrame, cents: DataFrame, vector: str, cluster: str, keep: list[str]) -> DataFrame:
    """(keep, cluster) with the largest cosine, the smaller cluster on ties. Centroids are few and come as one array."""
    all_c = cents.agg(F.array_sort(F.collect_list(F.struct(cluster, "centroid"))).alias("__all"))
    score = F.transform("__all", lambda c: F.struct(F.round(cosine(F.col(vector), c["centroid"]), 12).alias("s"), (-c[cluster]).alias("k")))
    return df.join(F.broadcast(all_c), F.lit(True)).select(*keep, (-F.array_max(score)["k"]).alias(cluster))


def merge_small(df: DataFrame, vector: str, cluster: str, keep: list[str], least: float) -> DataFrame:
    """(keep, cluster): items of clusters below least go to the nearest large one; nothing changes if none is large. least
    is a number, or a fraction below one: that quantile of the clusters' sizes."""
    size = df.groupBy(cluster).agg(F.count("*").alias("__n"))
    if least < 1:  # one row, the size of nothing
        size = size.join(F.broadcast(size.agg(F.expr(f"percentile_disc({least}) WITHIN GROUP (ORDER BY __n)").alias("__least"))))
        least = F.col("__least")
    j = df.join(size, cluster)
    large = j.where(F.col("__n") >= least)
    moved = nearest_centroid(j.where(F.col("__n") < least), centroids(large, cluster, vector), vector, cluster, keep)
    return large.select(*keep, cluster).union(moved.select(*keep, F.coalesce(cluster, F.lit(None).cast("long"))))


def compact(df: DataFrame, by: list[str], cluster: str, order: str, out: str) -> DataFrame:
    """Labels 0, 1, ... by first appearance, in each group or, numbered over ranges of the order, in all."""
    first = df.groupBy(*by, cluster).agg(F.min(order).alias("__first"))
    if by:
        first = first.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy("__first")))
    else:
        first = ranges.numbered(first, ["__first"], out)
    return df.join(first.withColumn(out, (F.col(out) - 1).cast("long")).drop("__first"), [*by, cluster])


def best_unique(score: np.ndarray) -> list[int]:
    """Column of each row, all different, with the largest total; -1 for rows beyond the columns. Rows are few and columns
    may be many: the best choice gives every row one of as many of its best columns as there are rows, so only these
    are tried. The first found wins ties, rows in order, better columns first."""
    rows, cols = score.shape
    choices = [list(np.argsort(-s, kind="stable")[:rows]) + [-1] * (rows > cols) for s in score]
    best, pick = -np.inf, [-1] * rows
    missing = max(0, rows - cols)

    def go(i: int, used: tuple[int, ...], total: float) -> None:
        nonlocal best, pick
        if i == rows:
            if sum(c < 0 for c in used) == missing and total > best + 1e-12:
                best, pick = total, [int(c) for c in used]
            return
        for c in choices[i]:
            if c < 0 or c not in used:
                go(i + 1, (*used, c), total + (score[i, c] if c >= 0 else 0.0))

    go(0, (), 0.0)
    return pick


def assign_unique(df: DataFrame, by: list[str], item: str, scores: str) -> DataFrame:
    """(by, item, cluster): items of a chunk (at most a handful) get different clusters with the largest total score."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item)
        return pdf[[*by, item]].assign(cluster=best_unique(np.stack(pdf[scores].to_numpy())))

    return df.select(*by, item, scores).groupBy(*by).applyInPandas(run, ", ".join(f"{c} long" for c in [*by, item, "cluster"]))


# --- language models --------------------------------------------------------------------------------------------


def _gram(n: int):
    return lambda i: F.array_join(F.slice("w", i, n), " ")


def ngram_counts(df: DataFrame, words: Column, order: int, prune: tuple[int, ...] = (0, 0, 1, 1)) -> DataFrame:
    """(order, gram, n) of the n-grams up to order that occur more often than their order's threshold."""
    w = df.select(words.alias("w"))
    parts = []
    for n in range(1, order + 1):
        at = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>"))
        g = w.select(F.explode(F.transform(at, _gram(n))).alias("gram"))
        parts.append(g.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > prune[n - 1]).select(F.lit(n).cast("long").alias("order"), "gram", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def backoff_scores(queries: DataFrame, lm: DataFrame, unk: float, order: int) -> DataFrame:
    """(id, score) for (id, gram): the longest known suffix of the gram, plus the backoffs of the contexts skipped for it;
    where even the last word is unknown the score is unk alone. lm is (gram, logp, backoff), joined once an order."""
    q = queries.select("id", "gram")
    words = F.split("gram", " ")
    j = q.withColumn("w", words)
    for n in range(1, order + 1):
        suffix = F.when(F.size("w") >= n, F.array_join(F.slice("w", F.size("w") - n + 1, n), " "))
        context = F.when((F.size("w") >= n) & (F.lit(n) > 1), F.array_join(F.slice("w", F.size("w") - n + 1, n - 1), " "))
        j = j.withColumn("__s", suffix).withColumn("__c", context)
        j = j.join(lm.select(F.col("gram").alias("__s"), F.col("logp").alias(f"p{n}")), "__s", "left").join(lm.select(F.col("gram").alias("__c"), F.col("backoff").alias(f"b{n}")), "__c", "left").drop("__s", "__c")
    score = F.lit(unk)
    for n in range(1, order + 1):  # the longest match comes last, so it is asked for first
        skipped = sum([F.coalesce(f"b{m}", F.lit(0.0)) for m in range(n + 1, order + 1)], F.lit(0.0))
        score = F.when(F.col(f"p{n}").isNotNull(), F.col(f"p{n}") + skipped).otherwise(score)
    return j.select("id", score.alias("score"))
