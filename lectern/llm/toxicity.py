"""Toxicity: a convolutional text classifier over hashed word embeddings, with thresholds set by language."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, release, store, tidy

#: Labelled documents of a shard, about, and words after which it is cut in two: a shard is trained on in one go.
SHARD_DOCS, SHARD_WORDS = 4096, 1 << 22
#: A word's embedding is the sum of two rows, picked by two hashes.
BUCKETS, DIM = 1 << 16, 8
WIDTHS, FILTERS = (1, 2, 3), 8
EPOCHS, BATCH, RATE = 5, 64, 0.02
#: The score from which a document counts as toxic; each language's threshold is moved there.
CUT = 0.7
#: Words that tell languages apart, at most, and languages compared at once.
COMMON, LANGUAGES = 2000, 8
#: Changes of weights are summed as whole multiples of this, so that the order of sums is all the same; scores are told
#: apart by this much where thresholds are set.
GRAIN, STEP = 2.0**-24, 2.0**-10
#: The filter of labelled documents has no more bits than two to this.
MOST_BITS = 26


def words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the index of each word of the texts in order, and where each text's words begin.
    Words are runs of letters, marks and digits in lower case."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    split = pc.split_pattern(pc.utf8_trim(pc.replace_substring_regex(low, r"[^\pL\pM\pN]+", " "), " "), " ")
    coded = pc.dictionary_encode(split.flatten())
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    begins = split.offsets.to_numpy()[: len(split) + 1].astype(np.int64)
    return coded.dictionary.to_pylist(), index, begins - begins[0]


def buckets(distinct: list[str]) -> np.ndarray:
    """Two rows [word, 2] of the embedding for each word; no word has row 0, and the empty one has it twice."""
    h = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) | zlib.adler32(w[::-1].encode("utf-8", "surrogatepass"), 7) << 32 for w in distinct), np.uint64, len(distinct))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    two = np.stack([h >> np.uint64(48), (h >> np.uint64(24)) & np.uint64(0xFFFF)], axis=1).astype(np.int64) % (BUCKETS - 1) + 1
    two[np.array([not w for w in distinct], bool)] = 0
    return two


def codes(distinct: list[str]) -> np.ndarray:
    """Both rows of each word as one number. Words that share both are one word to the model, so they are counted as one."""
    two = buckets(distinct).astype(np.uint32)
    return two[:, 0] << np.uint32(16) | two[:, 1]


def _rows(code: np.ndarray) -> np.ndarray:
    return np.stack([code >> 16, code & 0xFFFF], axis=1).astype(np.int64)


class Shard(NamedTuple):
    """Labelled documents: the codes of their words in order, where each document's begin, and what is known of it."""

    number: int
    codes: np.ndarray
    begins: np.ndarray
    toxic: np.ndarray
    langs: list[str | None]

    @property
    def fold(self) -> int:
        return self.number % 2

    def batch(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The arguments of logits() for some documents."""
        take = np.concatenate([self.codes[self.begins[d] : self.begins[d + 1]] for d in some])
        own, local = np.unique(take, return_inverse=True)
        return _rows(own), local, np.concatenate([[0], np.cumsum(self.begins[some + 1] - self.begins[some])])


class Model:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        f = lambda *s, scale: r.normal(0, scale, s).astype(np.float32)
        self.p = {"embed": f(BUCKETS, DIM, scale=0.05), "bias": np.zeros(len(WIDTHS) * FILTERS, np.float32), "out": f(len(WIDTHS) * FILTERS, scale=0.3), "outbias": np.array([-2.0], np.float32)}
        self.p |= {f"w{k}": f(k, DIM, FILTERS, scale=0.3) for k in WIDTHS}
        self.languages: list[str] = []
        self.place, self.profile = np.zeros(BUCKETS, np.int16), np.zeros((1, 0), np.float32)
        self.shift = np.zeros(1, np.float32)

    def features(self, rows: np.ndarray, index: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled filters [text, filter] and the place of each maximum, -1 where a text has no words.
        Filters reach past a text's end over padding, whose embedding is zero."""
        p, n = self.p, len(begins) - 1
        embedded = np.where((rows > 0)[:, :1], p["embed"][rows[:, 0]] + p["embed"][rows[:, 1]], 0)
        ends = np.repeat(begins[1:], np.diff(begins))
        full = np.flatnonzero(np.diff(begins) > 0)
        value, place = np.zeros((n, len(p["bias"])), np.float32), np.full((n, len(p["bias"])), -1)
        if not len(index):
            return value, place
        for a, k in enumerate(WIDTHS):
            s = (embedded @ p[f"w{k}"][0])[index]
            for j in range(1, k):
                part = (embedded @ p[f"w{k}"][j])[index[j:]]
                part[np.arange(j, len(index)) >= ends[:-j]] = 0
                s[:-j] += part
            some = slice(a * FILTERS, (a + 1) * FILTERS)
            top = np.maximum.reduceat(s, begins[:-1][full])
            value[full, some] = top
            if self.fitting:
                for c in range(FILTERS):
                    hit = np.flatnonzero(s[:, c] == np.repeat(top[:, c], np.diff(begins)[full]))
                    of = np.searchsorted(begins, hit, "right") - 1
                    place[of[::-1], a * FILTERS + c] = hit[::-1]
        return value, place

    fitting = False

    def logits(self, rows: np.ndarray, index: np.ndarray, begins: np.ndarray) -> np.ndarray:
        value, _ = self.features(rows, index, begins)
        return np.tanh(value + self.p["bias"]) @ self.p["out"] + self.p["outbias"][0]

    def language(self, rows: np.ndarray, index: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The likeliest language of each text by its common words alone; -1, whose threshold is that of all
        languages, where they favour none."""
        n = len(begins) - 1
        if self.profile.shape[1] < 2:
            return np.zeros(n, int)
        best = np.full(n, -1)
        full = np.flatnonzero(np.diff(begins) > 0)
        top, at = np.zeros(len(full), np.float32), self.place[rows[:, 0]]
        for lo in range(0, self.profile.shape[1] if len(full) else 0, LANGUAGES):
            fit = np.add.reduceat(self.profile[at, lo : lo + LANGUAGES][index], begins[:-1][full])
            some = np.flatnonzero(fit.max(1) > top)
            best[full[some]], top[some] = lo + fit[some].argmax(1), fit[some].max(1)
        return best

    def score(self, texts: pa.Array) -> np.ndarray:
        out = []
        for i in range(0, len(texts), 500):
            distinct, index, begins = words(texts.slice(i, 500))
            rows = buckets(distinct)
            z = self.logits(rows, index, begins) + self.shift[self.language(rows, index, begins)]
            out.append(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30))))
        return np.concatenate(out) if out else np.empty(0)

    def flat(self) -> np.ndarray:
        """All weights as rows of DIM numbers, those of the embedding first."""
        rest = np.concatenate([v.ravel() for k, v in self.p.items() if k != "embed"])
        return np.concatenate([self.p["embed"], np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)])

    def with_flat(self, flat: np.ndarray) -> Model:
        """A model with these weights, to train on."""
        m, at = Model.__new__(Model), 0
        m.p, rest = {"embed": flat[:BUCKETS].astype(np.float32)}, flat[BUCKETS:].astype(np.float32).ravel()
        for k, v in self.p.items():
            if k != "embed":
                m.p[k] = rest[at : at + v.size].reshape(v.shape).copy()
                at += v.size
        m.fitting = True
        return m

    def fit(self, texts: list[str], toxic: np.ndarray, langs: list[str | None]) -> Model:
        """learn() from lists; folds are dealt by place."""
        distinct, index, begins = words(pa.array(texts, pa.large_string()))
        code, shards = codes(distinct)[index] if len(index) else np.empty(0, np.uint32), []
        for fold in (0, 1):
            own = np.arange(fold, len(texts), 2)
            for i in range(0, len(own), SHARD_DOCS):
                some = own[i : i + SHARD_DOCS]
                cut = np.concatenate([[0], np.cumsum(begins[some + 1] - begins[some])])
                shards.append(Shard(i // SHARD_DOCS * 2 + fold, np.concatenate([code[begins[d] : begins[d + 1]] for d in some]), cut, toxic[some], [langs[d] for d in some]))
        return self.learn(Here(shards))

    def learn(self, at: Here | There) -> Model:
        """Word counts, weights and thresholds from all documents of all shards.

        Weights: in each of EPOCHS rounds every shard takes the weights for one pass of Adam over its shuffled batches, and
        a row of weights becomes the mean, by documents, over the shards that changed it. Thresholds: documents are in two
        folds, and two more models, one a fold, are trained alongside; each scores the fold that it wasn't trained on."""
        counts = at.kept(at.sums(_counts, "code long, n0 long, t0 long, n1 long, t1 long, words long", ["code"]))
        total = at.frame(at.where(counts, "code < 0"))
        if not len(total):
            self.p["outbias"][:] = -5
            return self
        n, t = (np.array([total[f"{x}0"][0], total[f"{x}1"][0], total[f"{x}0"][0] + total[f"{x}1"][0]], float) for x in "nt")
        base = np.where(n > 0, t / np.maximum(n, 1), 0.1) + 1e-3
        common = at.frame(at.top(at.where(counts, "code >= 0"), "words", "code", COMMON))["code"].to_numpy(np.int64)
        self._learn_languages(common, at.frame(at.sums(partial(_by_language, common), "lang string, code long, n long", ["lang", "code"])))
        # embeddings start from how much more often a word's documents are toxic; training goes on from there
        start = at.frame(at.maxima(at.where(counts, "code > 0"), partial(_starts, base), "row long, s0 double, s1 double, s2 double", ["row"]))
        at.spent(counts)
        flat = [self.flat() for _ in base]
        for f, own in enumerate(flat):
            own[start["row"], 0] += start[f"s{f}"].to_numpy(np.float32) / 4
            own[0] = 0
        changes = ", ".join(["which int, row int, n long", *[f"d{i} long" for i in range(DIM)]])
        for turn in range(EPOCHS):
            moved = at.frame(at.sums(partial(_pass, self, flat, base, turn), changes, ["which", "row"]))
            which, row = moved["which"].to_numpy(), moved["row"].to_numpy()
            mean = moved[[f"d{i}" for i in range(DIM)]].to_numpy(float) / moved["n"].to_numpy(float)[:, None] * GRAIN
            for f, own in enumerate(flat):
                own[row[which == f]] += mean[which == f].astype(np.float32)
        self.p = self.with_flat(flat[2]).p
        self._set_thresholds(at.frame(at.sums(partial(_scores, self, flat), "own int, lang int, z long, n long, t long", ["own", "lang", "z"])))
        return self

    def _step(self, rows, index, begins, y, weight, m1, m2, step, rate) -> None:
        p = self.p
        value, place = self.features(rows, index, begins)
        hidden = np.tanh(value + p["bias"])
        z = hidden @ p["out"] + p["outbias"][0]
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight).astype(np.float32)
        grad = {"out": hidden.T @ dz, "outbias": np.array([dz.sum()], np.float32)}
        dv = dz[:, None] * p["out"] * (1 - hidden**2)
        grad["bias"] = dv.sum(0)
        touched, changes = [], []
        d, f = np.nonzero(place >= 0)
        for a, k in enumerate(WIDTHS):
            grad[f"w{k}"] = np.zeros_like(p[f"w{k}"])
            for j in range(k):
                use = (f // FILTERS == a) & (place[d, f] + j < begins[d + 1])
                two, c, g = rows[index[place[d, f][use] + j]], f[use] % FILTERS, dv[d[use], f[use]]
                e = np.where((two > 0)[:, :1], p["embed"][two[:, 0]] + p["embed"][two[:, 1]], 0)
                for x in range(FILTERS):
                    grad[f"w{k}"][j][:, x] = (e[c == x] * g[c == x][:, None]).sum(0)
                change = p[f"w{k}"][j].T[c] * g[:, None]
                touched += [two[:, 0], two[:, 1]]
                changes += [change, change]
        at, where = np.unique(np.concatenate(touched), return_inverse=True)
        ge = np.zeros((len(at), DIM), np.float32)
        np.add.at(ge, where, np.concatenate(changes))
        ge[at == 0] = 0

        def adam(name, g, rows_at=slice(None)):
            m1[name][rows_at] = 0.9 * m1[name][rows_at] + 0.1 * g
            m2[name][rows_at] = 0.99 * m2[name][rows_at] + 0.01 * g * g
            p[name][rows_at] -= rate * (m1[name][rows_at] / (1 - 0.9**step)) / (np.sqrt(m2[name][rows_at] / (1 - 0.99**step)) + 1e-6)

        for name, g in grad.items():
            adam(name, g)
        adam("embed", ge, at)

    def _learn_languages(self, common: np.ndarray, counts: pd.DataFrame) -> None:
        self.languages = sorted(counts["lang"][counts["code"] < 0])
        rows, counts = _rows(common), counts[counts["code"] >= 0]
        self.place[rows[:, 0]] = np.arange(1, len(common) + 1)
        self.profile = np.zeros((len(common) + 1, len(self.languages)), np.float32)
        order = np.argsort(common)
        n = np.full((len(common), len(self.languages)), 0.5)
        number = {x: a for a, x in enumerate(self.languages)}
        n[order[np.searchsorted(common, counts["code"].to_numpy(), sorter=order)], [number[x] for x in counts["lang"]]] += counts["n"].to_numpy()
        self.profile[self.place[rows[:, 0]]] = np.log(n / n.sum(0))
        if self.languages:
            self.profile -= self.profile.mean(1, keepdims=True)
        self.place[0], self.profile[0] = 0, 0

    def _set_thresholds(self, scored: pd.DataFrame) -> None:
        """Per language, as told by its common words, the threshold with the best F1 on all documents, each scored by the
        model of the other fold, drawn towards that of all languages where they are few; the logit moves so that it
        falls on CUT."""
        wanted = np.log(CUT / (1 - CUT))

        def best(some: pd.DataFrame) -> float:
            # the model of both folds has seen more and scores higher: not below what tells apart its own documents
            return max(highest(some[some["own"] == k]) for k in (0, 1))

        def highest(some: pd.DataFrame) -> float:
            some = some.groupby("z")[["n", "t"]].sum().sort_index(ascending=False)
            s, n, t = some.index.to_numpy() * STEP, some["n"].to_numpy(float), some["t"].to_numpy(float)
            if t.sum() == 0:
                return (s[0] if len(s) else 0.0) + 2.0
            f1 = 2 * np.cumsum(t) / (np.cumsum(n) + t.sum())
            top = np.flatnonzero(f1 >= f1.max() - 1e-9)
            k = top[len(top) // 2]
            return float((s[k] + s[min(k + 1, len(s) - 1)]) / 2)

        base = best(scored)
        self.shift = np.full(len(self.languages) + 1, wanted - base, np.float32)
        for a in range(len(self.languages)):
            use = scored[scored["lang"] == a]
            n = use["t"][use["own"] == 0].sum()
            self.shift[a] = wanted - (n * best(use) + 10 * base) / (n + 10) if n else wanted - base


# --- what learn() asks of shards: each function turns them into rows whose sums by key are the same however they are dealt


def _counts(shards: Iterable[Shard]) -> Iterator[dict]:
    """Documents and toxic documents of each fold that hold a word, and how often it occurs; -1 stands for all words."""
    for s in shards:
        doc = np.repeat(np.arange(len(s.toxic), dtype=np.int64), np.diff(s.begins))
        pair, times = np.unique(doc << 32 | s.codes, return_counts=True)
        code, at = np.unique(pair & 0xFFFFFFFF, return_inverse=True)
        sums = [np.bincount(at, minlength=len(code)), np.bincount(at, s.toxic[pair >> 32], len(code)), np.bincount(at, times, len(code))]
        n, t, times = (np.append(x, y).astype(np.int64) for x, y in zip(sums, (len(s.toxic), s.toxic.sum(), 0), strict=True))
        none = np.zeros_like(n)
        a, b = ((n, t), (none, none))[:: -1 if s.fold else 1]
        yield {"code": np.append(code, -1), "n0": a[0], "t0": a[1], "n1": b[0], "t1": b[1], "words": times}


def _by_language(common: np.ndarray, shards: Iterable[Shard]) -> Iterator[dict]:
    """How often each common word occurs in each language; -1 stands for the documents."""
    ordered = np.sort(common)
    for s in shards:
        of, names = pd.factorize(np.array(s.langs, object))
        place = np.searchsorted(ordered, s.codes)
        place[place == len(ordered)] = 0
        lang = np.repeat(of, np.diff(s.begins))
        hit = (ordered[place] == s.codes) & (lang >= 0) if len(ordered) else np.zeros(len(place), bool)
        pair, n = np.unique(lang[hit] * len(ordered) + place[hit], return_counts=True)
        docs = np.bincount(of[of >= 0], minlength=len(names))
        yield {"lang": [names[a] for a in pair // max(1, len(ordered))] + list(names), "code": np.append(ordered[pair % max(1, len(ordered))], np.full(len(names), -1)), "n": np.append(n, docs)}


def _starts(base: np.ndarray, counts: Iterable[pd.DataFrame]) -> Iterator[dict]:
    """Where each row of the embedding starts, by the largest lift of its words: in fold 0, in fold 1, in both."""
    for c in counts:
        out = {}
        for f, b in enumerate(base):
            n, t = (sum(c[f"{x}{i}"].to_numpy(float) for i in ((0, 1) if f == 2 else (f,))) for x in "nt")
            out[f"s{f}"] = np.clip(np.log((t + 4 * b) / (n - t + 4 * (1 - b))) - np.log(b / (1 - b)), 0, 4)
        some = np.max(list(out.values()), axis=0) > 0
        for side in _rows(c["code"].to_numpy()).T:
            yield {"row": side[some]} | {k: v[some] for k, v in out.items()}


def _pass(model: Model, flat: list[np.ndarray], base: np.ndarray, turn: int, shards: Iterable[Shard]) -> Iterator[dict]:
    """One pass over each shard, by the model of its fold and that of both: how far rows moved, times documents."""
    moved = np.zeros((3, len(flat[2]), DIM + 1), np.int64)
    for s in shards:
        size, r = len(s.toxic), np.random.default_rng([6, turn, s.number])
        order, both = r.permutation(size), (s.fold, 2)
        own = [model.with_flat(flat[f]) for f in both]
        moments = [[{k: np.zeros_like(v) for k, v in m.p.items()} for _ in range(2)] for m in own]
        weight = [np.where(s.toxic, 0.5 / max(base[f], 0.02), 0.5 / max(1 - base[f], 0.02)) for f in both]
        for i in range(0, size, BATCH):
            some = order[i : i + BATCH]
            batch, rate = s.batch(some), RATE * (1 - 0.9 * (turn + i / size) / EPOCHS)
            for m, w, (m1, m2) in zip(own, weight, moments, strict=True):
                m._step(*batch, s.toxic[some], w[some] / len(some), m1, m2, i // BATCH + 1, rate)
        for f, m in zip(both, own, strict=True):
            far = np.rint((m.flat().astype(float) - flat[f]) / GRAIN).astype(np.int64)
            hit = far.any(1)
            moved[f, hit] += size * np.column_stack([far[hit], np.ones(hit.sum(), np.int64)])
    which, row = np.nonzero(moved[:, :, DIM])
    some = moved[which, row]
    yield {"which": which, "row": row, "n": some[:, DIM]} | {f"d{i}": some[:, i] for i in range(DIM)}


def _scores(model: Model, flat: list[np.ndarray], shards: Iterable[Shard]) -> Iterator[dict]:
    """Documents and toxic ones by language and score, in steps, by the model of the other fold."""
    other = [model.with_flat(flat[1 - f]) for f in (0, 1)]
    for m in other:
        m.fitting = False
    for s in shards:
        for lo in range(0, len(s.toxic), BATCH):
            batch = s.batch(np.arange(lo, min(lo + BATCH, len(s.toxic))))
            for own, m in enumerate((other[s.fold], model)):
                z = np.rint(m.logits(*batch) / STEP).astype(np.int64)
                yield {"own": np.full(len(z), own), "lang": model.language(*batch), "z": z, "n": np.ones(len(z), np.int64), "t": s.toxic[lo : lo + BATCH].astype(np.int64)}


class Here:
    """Shards in memory."""

    def __init__(self, shards: list[Shard]):
        self.shards = shards

    def sums(self, run: Callable, schema: str, by: list[str]) -> pd.DataFrame:
        return self._of(run(self.shards), schema).groupby(by, as_index=False).sum()

    def maxima(self, table: pd.DataFrame, run: Callable, schema: str, by: list[str]) -> pd.DataFrame:
        return self._of(run([table]), schema).groupby(by, as_index=False).max()

    @staticmethod
    def _of(parts: Iterable[dict], schema: str) -> pd.DataFrame:
        return pd.concat([*map(pd.DataFrame, parts)] or [pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])])

    def kept(self, table: pd.DataFrame) -> pd.DataFrame:
        return table

    def spent(self, table: pd.DataFrame) -> None:
        pass

    def frame(self, table: pd.DataFrame) -> pd.DataFrame:
        return table.reset_index(drop=True)

    def where(self, table: pd.DataFrame, condition: str) -> pd.DataFrame:
        return table.query(condition)

    def top(self, table: pd.DataFrame, most: str, least: str, n: int) -> pd.DataFrame:
        return table.sort_values([most, least], ascending=[False, True]).head(n)


class There:
    """Shards as rows of a table, one row each."""

    SCHEMA = "shard long, codes binary, sizes binary, toxic binary, langs array<string>"

    def __init__(self, shards: DataFrame):
        self.shards = shards

    def sums(self, run: Callable, schema: str, by: list[str]) -> DataFrame:
        sent = self.shards.sparkSession.sparkContext.broadcast(run)  # weights and the like, whatever the corpus

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _batches(sent.value(_unpacked(batches)), schema)

        return self._grouped(self.shards.mapInArrow(tidy(each), schema), by, F.sum)

    def maxima(self, table: DataFrame, run: Callable, schema: str, by: list[str]) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _batches(run(b.to_pandas() for b in batches), schema)

        return self._grouped(table.mapInArrow(each, schema), by, F.max)

    @staticmethod
    def _grouped(table: DataFrame, by: list[str], how: Callable) -> DataFrame:
        return table.groupBy(*by).agg(*[how(c).alias(c) for c in table.columns if c not in by])

    def kept(self, table: DataFrame) -> DataFrame:
        return store(table)

    def spent(self, table: DataFrame) -> None:
        release(table)

    def frame(self, table: DataFrame) -> pd.DataFrame:
        return table.toArrow().to_pandas()

    def where(self, table: DataFrame, condition: str) -> DataFrame:
        return table.where(condition)

    def top(self, table: DataFrame, most: str, least: str, n: int) -> DataFrame:
        return table.orderBy(F.desc(most), least).limit(n)


def _batches(parts: Iterable[dict], schema: str) -> Iterator[pa.RecordBatch]:
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    columns = [c.split() for c in schema.split(", ")]
    for part in parts:
        yield pa.RecordBatch.from_arrays([pa.array(part[c], types[t]) for c, t in columns], [c for c, _ in columns])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for b in batches:
        for i in range(b.num_rows):
            number, code, sizes, toxic = (b.column(c)[i] for c in range(4))
            begins = np.concatenate([[0], np.cumsum(np.frombuffer(sizes.as_buffer(), np.int64))])
            yield Shard(number.as_py(), np.frombuffer(code.as_buffer(), np.uint32), begins, np.frombuffer(toxic.as_buffer(), bool), b.column(4)[i].as_py())


def _spots(draws: np.ndarray, bits: int) -> np.ndarray:
    """The two bits [draw, 2] of a Bloom filter of 2 ** bits."""
    return np.stack([draws, draws >> bits], axis=1) & ((1 << bits) - 1)


def _bloom(chosen: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the column draw, eight bits a byte. It keeps most texts without a label from being moved; that it never grows beyond
    2 ** MOST_BITS only lets more of them through, since labels are joined to what it passes."""
    bits = min(MOST_BITS, max(10, (16 * n).bit_length()))
    mask = F.lit((1 << bits) - 1)
    spots = chosen.select(F.explode(F.array(F.col("draw").bitwiseAND(mask), F.shiftright("draw", bits).bitwiseAND(mask))).alias("at"))
    filled = spots.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("set")).toArrow()
    out = np.zeros(1 << max(0, bits - 6), np.int64)
    out[filled["word"].to_numpy()] = filled["set"].to_numpy()
    return out.view(np.uint8)


def _coded(known: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of words in place of the text, the last column, of rows whose draw, the second one, is in the filter."""
    bits = len(known).bit_length() + 2
    for b in batches:
        for i in range(0, b.num_rows, 500):
            part = b.slice(i, 500)
            spots = _spots(part.column(1).to_numpy(), bits)
            part = part.filter(pa.array((known[spots >> 3] >> (spots & 7) & 1).all(1)))
            distinct, index, begins = words(part.column(part.num_columns - 1))
            code = codes(distinct)[index] if len(index) else np.empty(0, np.uint32)
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((begins * 4).astype(np.int32)), pa.py_buffer(code)])
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], packed], [*part.schema.names[:-1], "codes"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of There.SCHEMA from (shard, draw, doc_id, label, lang, codes), ordered by shard and doc_id, where a row with
    label comes before the texts of its doc_id; texts without one are left out."""
    number, held, size, labelled, toxic = None, [], 0, None, None

    def row() -> pa.RecordBatch:
        marks, langs, code = zip(*held, strict=True)
        sizes = np.array([len(c) // 4 for c in code], np.int64)
        values = [[number], [b"".join(code)], [sizes.tobytes()], [np.array(marks, bool).tobytes()], [list(langs)]]
        types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["shard", "codes", "sizes", "toxic", "langs"])

    for b in batches:
        shards, _, ids, labels, langs, code = (b.column(i) for i in range(6))
        for i in range(b.num_rows):
            doc, label = ids[i].as_py(), labels[i].as_py()
            if label is not None:
                labelled, toxic = doc, label
            elif doc == labelled:
                k, c = shards[i].as_py(), code[i].as_py()
                if held and (k != number or size + len(c) > 4 * SHARD_WORDS or len(held) == 2 * SHARD_DOCS):
                    yield row()
                    held, size = [], 0
                number, size = k, size + len(c)
                held.append((toxic, langs[i].as_py(), c))
    if held:
        yield row()


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None) -> Model:
    """A model from all documents joined to (doc_id, toxic). Rows without doc_id, text or toxic are left out; of
    labels that repeat a doc_id the larger counts. The labelled texts are written once, as codes of words in shards
    dealt by a hash of doc_id, and deleted when the model is there. Nothing depends on how Spark deals the rows.
    There are assumed to be no more than some thousand languages."""
    bounded(docs.sparkSession)
    chosen = labels.where("doc_id is not null and toxic is not null")
    if learn_from is not None:
        chosen = chosen.where(learn_from)
    chosen = chosen.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("label"))
    labelled = chosen.count()
    n = 2 * max(1, -(-labelled // (2 * SHARD_DOCS)))
    draw = F.xxhash64(F.lit("toxicity"), "doc_id")
    dealt = lambda df, *more: df.select(F.pmod(draw, F.lit(n)).alias("shard"), draw.alias("draw"), "doc_id", *more)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    marks = dealt(chosen, "label", none("string", "lang"), none("binary", "codes"))
    sent = docs.sparkSession.sparkContext.broadcast(_bloom(marks, labelled))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _coded(sent.value, batches)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    texts = dealt(texts.where("doc_id is not null and text is not null"), none("boolean", "label"), "lang", "text")
    texts = texts.mapInArrow(tidy(coded), "shard long, draw long, doc_id long, label boolean, lang string, codes binary")
    rows = marks.union(texts).repartitionById(n, F.col("shard").cast("int"))
    rows = rows.sortWithinPartitions("shard", "draw", "doc_id", F.desc_nulls_last("label"), "codes", "lang")
    shards = store(rows.mapInArrow(tidy(_packed), There.SCHEMA))
    model = Model().learn(There(shards))
    release(shards)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every whole text; null and empty texts get the score of a text without words.
    Repeated rows come out as often as they came in."""
    sent = bounded(docs.sparkSession).sparkContext.broadcast(model)  # BUCKETS rows, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.score(b.column(1)), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows that score CUT or more; columns as they were."""
    sent = bounded(docs.sparkSession).sparkContext.broadcast(model)

    def score_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(sent.value.score(pa.array(texts, pa.large_string(), from_pandas=True)))

    tidied = tidy(score_all)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidied(batches)

    return docs.where(scored(F.col(f"`{text_col}`")) < CUT)
