"""Vectors, distributions and small array tools as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, empty: float = float("-inf")) -> Column:
    """Cosine; `empty` where either vector is zero."""
    n = dot(a, a) * dot(b, b)
    return F.when(n > 0, dot(a, b) / F.sqrt(n)).otherwise(F.lit(empty))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def l2norm(a: Column) -> Column:
    n = F.sqrt(dot(a, a))
    return F.transform(_doubles(a), lambda x: F.when(n > 0, x / n).otherwise(x))


def affine(v: Column, mean: list[float], rows: list[list[float]]) -> Column:
    """rows times (v - mean)."""
    centred = F.zip_with(_doubles(v), F.array(*map(F.lit, mean)), lambda x, m: x - m)
    return F.array(*[dot(centred, F.array(*map(F.lit, r))) for r in rows])


def _mapped(v: Column, run: Callable[[np.ndarray], np.ndarray]) -> Column:
    """run over the vectors of a batch as rows of a matrix; null where a vector is."""

    @F.pandas_udf("array<double>")
    def apply(column: pd.Series) -> pd.Series:
        there = np.flatnonzero(column.notna().to_numpy())
        made = run(np.stack(column.to_numpy()[there]).astype(float)) if len(there) else []
        out = pd.Series([None] * len(column), dtype=object)
        for k, x in zip(there, made, strict=True):
            out[k] = x
        return out

    return apply(v)


def _fused(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """x times the transpose of rows as SQL sums it: dimension by dimension, each product added before it is rounded."""

    def one(v: list[float], r: list[float]) -> float:
        total = 0.0
        for p, q in zip(v, r, strict=True):
            total = math.fma(p, q, total)
        return total

    r = rows.tolist()
    return np.array([[one(v, k) for k in r] for v in x.tolist()]).reshape(len(x), len(r))


def _lengthened(x: np.ndarray, fused: bool = False) -> np.ndarray:
    """Rows of the length of the root of the dimension."""
    n = np.sqrt(np.array([_fused(v[None], v[None])[0] for v in x]).reshape(len(x), 1) if fused else (x * x).sum(1, keepdims=True))
    return x / np.where(n > 0, n, 1) * np.sqrt(x.shape[1])


def rounded(v: Column, digits: int) -> Column:
    """Halves away from zero of the number times a power of ten, as SQL does, the sign of zero kept; F.round takes the
    halves of the decimal digits and has no such sign."""
    x = v * F.lit(10.0**digits)
    whole = F.floor(F.abs(x)).cast("double")
    up = whole + F.when(F.abs(x) - whole >= 0.5, 1.0).otherwise(0.0)
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), v).otherwise(up * F.when(x.cast("string").startswith("-"), -1.0).otherwise(1.0) / F.lit(10.0**digits))


def whitened(v: Column, mean: list[float], rows: list[list[float]], mean_after: list[float], digits: int | None = None) -> Column:
    """Centred and of the length of the root of the dimension; mapped by rows; then the same again with the second mean.
    With digits, vectors whose numbers are so near to a half of the last digit, or to zero, that the order of sums could
    decide are summed as SQL does, so that rounded() gives its digits."""
    m, r, a = np.array(mean), np.array(rows), np.array(mean_after)

    def run(x: np.ndarray) -> np.ndarray:
        y = _lengthened(_lengthened(x - m) @ r.T - a)
        if digits is not None:
            scaled = np.abs(y) * 10.0**digits
            near = np.flatnonzero(((np.abs(scaled % 1 - 0.5) < 1e-3) | (scaled < 1e-3)).any(1))
            y[near] = _lengthened(_fused(_lengthened(x[near] - m, True), r) - a, True)
        return y

    return _mapped(v, run)


def projected(v: Column, mean: list[float], rows: list[list[float]]) -> Column:
    """rows times (v - mean), as a product of matrices."""
    m, r = np.array(mean), np.array(rows)
    return _mapped(v, lambda x: (x - m) @ r.T)


def log_softmax(x: Column, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    top = F.max(x).over(w)
    return x - top - F.log(F.sum(F.exp(x - top)).over(w))


def softmax(x: Column, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    e = F.exp(x - F.max(x).over(w))
    return e / F.sum(e).over(w)


def mel_slaney(f: Column) -> Column:
    """Linear up to 1 kHz, logarithmic beyond."""
    return F.when(f < 1000, f * 3 / 200).otherwise(F.lit(15.0) + F.log(f / 1000) / (F.log(F.lit(6.4)) / 27))


def mel_slaney_inverse(m: Column) -> Column:
    return F.when(m < 15, m * 200 / 3).otherwise(F.lit(1000.0) * F.exp((m - 15) * (F.log(F.lit(6.4)) / 27)))


def mel_htk(f: Column) -> Column:
    return F.lit(1127.0) * F.log1p(f / 700)


def quality(p: Column, floor: float = 0.25) -> Column:
    """For speakers' probabilities: the log-odds of each, with all speakers' silence, less half the logarithm of two."""
    log = lambda x: F.log(F.greatest(x, F.lit(floor)))
    silent = F.aggregate(p, F.lit(0.0), lambda s, x: s + log(1 - x))
    return F.transform(p, lambda x: log(x) - log(1 - x) + silent - F.log(F.sqrt(F.lit(2.0))))


def confidence_alpha(logprob: Column) -> Column:
    """How strongly a token's background shows that it is unsure."""
    t = F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (logprob + 2) / 2)))
    return (1 - t * t) * 200


def pad_right(a: Column, n: Column, fill: Column) -> Column:
    return F.concat(F.slice(a, 1, n), F.array_repeat(fill, F.greatest(n - F.size(a), F.lit(0))))


def even_timestamps(n: Column, last: int, truncate: bool = False) -> Column:
    """n frames from 0 to last: i * last / (n - 1), rounded half to even; or i * last / n, truncated."""
    at = F.sequence(F.lit(0), n - 1)
    if truncate:
        return F.when(n > 0, F.transform(at, lambda i: (i * last / n).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    spread = F.transform(at, lambda i: F.when(n == 1, 0).otherwise(F.bround(i * F.lit(last) / (n - 1))).cast("long"))
    return F.when(n > 0, spread).otherwise(F.array().cast("array<bigint>"))


def mask_frames(mask_len: Column, frames: Column) -> Column:
    """The mask frame that each of so many feature frames reads."""
    return F.when(frames > 0, F.transform(F.sequence(F.lit(0).cast("long"), frames - 1), lambda i: F.floor(i * mask_len / frames))).otherwise(F.array().cast("array<bigint>"))
