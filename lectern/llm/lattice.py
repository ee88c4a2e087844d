"""Embedding near-duplicates by lattice hashing: E8 cells of random projections, neighbouring cells probed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, components, forest, release, settle, store

#: Cosine from which vectors link.
COSINE = 0.95
#: Cells per unit length, cells of each block that are considered, seed of the projections.
SCALE, NEAR, SEED = 3.0, 4, 11
#: Vectors up to which a form serves: (vectors, tables, 8-dimensional blocks of a key, cells that a vector looks into). Two
#: random vectors share a cell of b blocks with a chance of about 0.017 ** b, so cells stay small as the table grows;
#: tables and probes make up for it. Of pairs at a cosine of 0.95, the least that link, simulation finds all but one in
#: 10,000 with either form.
FORMS = ((4 << 20, 10, 3, 9), (1 << 62, 14, 4, 16))
#: Rows of one cell that one task holds; larger cells are split and every probe visits each part.
CELL_ROWS = 8192
#: Pairs compared at once, and pairs whose earlier meetings are looked up at once.
PAIRS, LOOKED = 1 << 18, 100_000


def nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest point of D8 (integers with even sum) to each row."""
    r = np.rint(x)
    off = x - r
    worst = np.abs(off).argmax(1)
    at = np.arange(len(x))
    odd = r.sum(1).astype(np.int64) & 1 == 1
    r[at[odd], worst[odd]] += np.where(off[at[odd], worst[odd]] >= 0, 1, -1)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 = D8 u (D8 + 1/2) to each row, doubled so that it is integer."""
    a, b = nearest_even(x), nearest_even(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return (2 * np.where(closer[:, None], a, b)).astype(np.int64)


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: where neighbouring cells have their centres."""
    out = []
    for i in range(8):
        for j in range(i):
            for s in (1, -1):
                for t in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = s, t
                    out.append(v)
    out += [np.array([0.5 if b >> k & 1 else -0.5 for k in range(8)]) for b in range(256) if bin(b).count("1") % 2 == 0]
    return np.array(out)


MINIMAL = minimal_vectors()


def _mix(parts: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each row of integers."""
    h = np.full(len(parts), np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & 0xFFFFFFFFFFFFFFFF))
    for k in range(parts.shape[1]):
        h ^= parts[:, k].astype(np.uint64)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
    return h


class Lattice:
    """Tables of random projections for vectors of one dimension."""

    def __init__(self, dim: int, tables: int = FORMS[0][1], blocks: int = FORMS[0][2], probes: int = FORMS[0][3], seed: int = SEED):
        r = np.random.default_rng(seed)
        self.tables, self.blocks, self.probes = tables, blocks, probes
        wide = 8 * blocks
        # orthonormal rows where the dimension allows; a projected block keeps 8 / dim of the squared length
        self.maps = []
        for _ in range(tables):
            m = r.normal(size=(max(dim, wide), wide))
            self.maps.append(np.linalg.qr(m)[0][:dim] * SCALE * np.sqrt(max(dim, wide) / 64))
        self.shifts = r.random((tables, wide))
        self.choices = np.stack(np.meshgrid(*[np.arange(NEAR)] * blocks, indexing="ij"), axis=-1).reshape(-1, blocks)

    def keys(self, unit: np.ndarray, table: int, probing: bool = False) -> np.ndarray:
        """Keys [row, 1 or probes] of a table's cells: the own one first, then combinations of the own and neighbouring cells
        of each block, the nearest first."""
        x = unit @ self.maps[table] + self.shifts[table]
        hashes, costs = [], []
        for b in range(self.blocks):
            part = x[:, 8 * b : 8 * b + 8]
            own = decode(part)
            cells, cost = [own], [np.zeros(len(x))]
            if probing:
                # distance to a neighbouring centre grows as (1 - <offset, v>) for the minimal vectors v, all of one length
                lean = (part - own / 2) @ MINIMAL.T
                best = np.argpartition(-lean, NEAR - 2, axis=1)[:, : NEAR - 1]
                lean = np.take_along_axis(lean, best, 1)
                order = np.argsort(-lean, axis=1, kind="stable")
                best, lean = np.take_along_axis(best, order, 1), np.take_along_axis(lean, order, 1)
                cells += [own + (2 * MINIMAL[best[:, i]]).astype(np.int64) for i in range(NEAR - 1)]
                cost += [np.maximum(1 - lean[:, i], 0) + 1e-9 for i in range(NEAR - 1)]
            hashes.append(np.stack([_mix(c, 100 * table + b) for c in cells], axis=1))
            costs.append(np.stack(cost, axis=1))
        if not probing:
            picked = np.zeros((len(x), 1, self.blocks), np.int64)
        else:
            total = sum(costs[b][:, self.choices[:, b]] for b in range(self.blocks))
            picked = self.choices[np.argsort(total, axis=1, kind="stable")[:, : self.probes]]
        out = np.full(picked.shape[:2], np.uint64(table))
        for b in range(self.blocks):
            out = (out ^ np.take_along_axis(hashes[b], picked[:, :, b], 1)) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(32)
        return out


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows in double precision and which are valid: not null, not zero, of one length, all finite."""
    rows = column.to_pylist() if column.null_count or column.flatten().null_count else None
    if rows is not None:
        dim = max((len(r) for r in rows if r), default=0)
        ok = np.array([bool(r) and len(r) == dim and all(v is not None for v in r) for r in rows], bool)
        x = np.array([r if good else [0.0] * dim for r, good in zip(rows, ok, strict=True)], float).reshape(len(rows), dim)
    else:
        n = column.value_lengths().to_numpy(zero_copy_only=False)
        dim = int(n.max()) if len(n) else 0
        ok = n == dim
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
        x = np.zeros((len(n), dim))
        x[ok] = flat[np.repeat(ok, n)].reshape(-1, dim) if dim else 0
    ok &= np.isfinite(x).all(1)
    x[~ok] = 0
    ok &= (x != 0).any(1)
    return x, ok


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)
    x = x / np.where(top > 0, top, 1)
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n > 0, n, 1)


def _rows(form: tuple[int, int, int]):
    """Per vector and table a row for its own cell (probe false), and one for each cell it looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = None
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                b = whole.slice(k, 1000)
                x, _ = matrix(b.column(1))
                lattice = lattice or Lattice(x.shape[1], *form)
                u = unit(x)
                for t in range(lattice.tables):
                    looked = lattice.keys(u, t, True)
                    n = looked.shape[1]
                    key = np.concatenate([looked[:, 0], looked.ravel()]).view(np.int64)
                    at = pa.array(np.concatenate([np.arange(len(x)), np.repeat(np.arange(len(x)), n)]))
                    probe = np.concatenate([np.zeros(len(x), bool), np.ones(n * len(x), bool)])
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), t, np.int32)), pa.array(probe), b.column(0).take(at)], ["cell", "t", "probe", "id"])

    return run


def _earlier(lattice: Lattice, x: np.ndarray, a: np.ndarray, b: np.ndarray, swapped: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each pair of rows of x (a looks into b's cell in its table) was found before: in an earlier table, or
    in this one the other way round where that way counts first, which is that of the smaller id looking."""
    seen = np.zeros(len(a), bool)
    for t in range(int(table.max()) + 1 if len(table) else 0):
        rows = np.flatnonzero((table >= t) & ~seen)
        if not len(rows):
            continue
        keys = lattice.keys(x, t, True)
        for s in range(0, len(rows), LOOKED):
            r = rows[s : s + LOOKED]
            ka, kb = keys[a[r]], keys[b[r]]
            forth, back = (ka == kb[:, :1]).any(1), (kb == ka[:, :1]).any(1)
            seen[r] |= np.where(table[r] > t, forth | back, swapped[r] & back)
    return seen


def _verify(cosine: float, form: tuple[int, int, int]):
    """Rows sorted by cell and part, own rows before probes: the links first found there, as counts and a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = None
        here = None  # the part of a cell whose own rows are held: (cell, part), ids, sizes, unit vectors
        for b in batches:
            x, _ = matrix(b.column(5))
            u = unit(x)
            lattice = lattice or Lattice(x.shape[1], *form)
            cell, part, t, ids, size = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4, 6))
            probe = b.column(3).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0)) + 1
            left, right, where = [], [], []
            for s, e in zip(np.r_[0, cut], np.r_[cut, len(cell)], strict=True):
                own = slice(s, s + int((~probe[s:e]).sum()))
                if here is None or here[0] != (cell[s], part[s]):
                    here = ((cell[s], part[s]), ids[own], size[own], u[own])
                elif own.stop > s:
                    here = (here[0], *(np.concatenate([h, v[own]]) for h, v in zip(here[1:], (ids, size, u), strict=True)))
                asks = np.arange(own.stop, e)
                step = max(1, PAIRS // max(1, len(here[1])))
                for k in range(0, len(asks), step):
                    some = asks[k : k + step]
                    i, j = np.nonzero(u[some] @ here[3].T >= cosine)
                    keep = ids[some[i]] != here[1][j]
                    if keep.any():
                        i, j = some[i[keep]], j[keep]
                        di, dj = np.unique(i), np.unique(j)
                        left.append((ids[i], size[i], t[i], ids[di], u[di]))
                        right.append((here[1][j], here[2][j], here[1][dj], here[3][dj]))
                    if sum(len(v[0]) for v in left) >= 2 * PAIRS or (left and k + step >= len(asks) and e == len(cell)):
                        yield from _out(lattice, left, right)
                        left, right = [], []
            if left:
                yield from _out(lattice, left, right)

    return run


def _out(lattice: Lattice, left: list, right: list) -> Iterator[pa.RecordBatch]:
    """left: ids, sizes, tables; right: ids, sizes; either with the unit vectors of its distinct ids last."""
    ia, na, t = (np.concatenate([v[k] for v in left]) for k in range(3))
    ib, nb = (np.concatenate([v[k] for v in right]) for k in range(2))
    known, first = np.unique(np.concatenate([v[-2] for v in left + right]), return_index=True)
    x = np.concatenate([v[-1] for v in left + right])[first]
    new = ~_earlier(lattice, x, np.searchsorted(known, ia), np.searchsorted(known, ib), ia > ib, t)
    ids, at = np.unique(np.concatenate([ia[new], ib[new]]), return_inverse=True)
    links = np.bincount(at, weights=np.concatenate([nb[new], na[new]]).astype(float), minlength=len(ids)).astype(np.int64)
    a, b = forest(ia[new], ib[new])
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([ids, a])), pa.array(np.concatenate([links, np.zeros(len(a), np.int64)])), pa.array(np.concatenate([ids, b]))],
        ["id", "links", "to"],
    )


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, form: tuple[int, int, int] | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every vector.

    Equal vectors are one class, whose smallest id stands for it. Every class has a cell of several E8 lattices in each
    table and looks into its own and the nearest neighbouring ones; those it meets there are compared in
    double precision. A pair counts where it is found first, which its two vectors tell, so links are
    counted without listing pairs: a cell gives counts and the edges of a forest. Cells with more than
    CELL_ROWS own rows are dealt out in parts that every probe visits, so none is compared in one task.
    Nothing is capped. form is (tables, blocks, probes), by default that of FORMS for the number of classes.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing: n_links 0,
    component_id their own id. So do those shorter than the longest vector, and rows without an id, whose component is
    null. Rows that repeat a vec_id are vectors of their own with that id, whether equal or not. An empty table gives no rows; other
    columns are ignored.
    """
    bounded(vectors.sparkSession)
    kind = "array<float>" if "float" in vectors.select(F.col(f"`{vector_col}`").alias("v")).dtypes[0][1] else "array<double>"
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast(kind).alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    valid = F.coalesce(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda c: c != 0), F.lit(False))
    longest = rows.where(valid).agg(F.max(F.size("v"))).first()[0] or 0
    valid = valid & (F.coalesce(F.size("v"), F.lit(0)) == longest)
    classes = store(rows.where(valid).groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("size")))
    several = not classes.groupBy("rep").count().where("count > 1").isEmpty()
    classes = classes.withColumn("cls", F.xxhash64("rep", "v") if several else F.col("rep"))
    if form is None:
        n = classes.count()
        form = next(f for most, *f in FORMS if n <= most)
    cells = store(classes.select("cls", "v").mapInArrow(_rows(tuple(form)), "cell long, t int, probe boolean, id long"))
    # cells where a vector may meet another: an own row, and some other vector's row
    met = cells.groupBy("cell").agg(F.count_if(~F.col("probe")).alias("own"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("own > 0 and lo < hi")
    met = store(met.select("cell", F.ceil(F.col("own") / CELL_ROWS).cast("int").alias("parts")))
    light = cells.hint("merge").join(met.hint("merge"), "cell")
    light = light.withColumn("part", F.explode(F.when(F.col("probe"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))))
    light = store(light.select("cell", "part", "t", "probe", "id"))
    release(cells, met)
    full = light.join(classes, light["id"] == classes["cls"]).select("cell", "part", "t", "probe", "id", F.col("v"), "size")
    dealt = full.repartition("cell", "part").sortWithinPartitions("cell", "part", "probe")
    found = settle(dealt.mapInArrow(_verify(cosine, tuple(form)), "id long, links long, to long"))
    release(light)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.where("id <> to"), "id", "to")
    named = classes.join(links, classes["cls"] == links["id"], "left").join(groups, classes["cls"] == groups["node"], "left")
    named = named.select("v", "rep", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component_id"))
    if several:  # classes have numbers of their own: a component's id is the smallest of its vectors'
        named = store(named)
        named = named.join(named.groupBy("component_id").agg(F.min("rep").alias("least")), "component_id").withColumn("component_id", F.col("least"))
    named = store(named.select("v", "n_links", "component_id"))
    good = rows.where(valid).join(named, "v").select("id", "n_links", "component_id")
    bad = rows.where(~valid).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.union(bad).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
