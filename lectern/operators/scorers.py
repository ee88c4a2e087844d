"""The slot for neural models: a scorer is a function from a list of feature arrays to a list of score arrays. No weights are part of the library."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Scorer = Callable[[list[np.ndarray]], list[np.ndarray]]


def in_batches(items: list[np.ndarray], scorer: Scorer, size: int) -> list[np.ndarray]:
    """Scores of all items, so many at a time; where the scorer runs out of memory the same items are tried again in half
    as many, down to one."""
    out, at = [], 0
    while at < len(items):
        try:
            out += scorer(items[at : at + size])
            at += min(size, len(items) - at)
        except MemoryError:
            if size == 1:
                raise
            size = max(1, size // 2)
    return out


def score(df: DataFrame, key: str, features: str, make: Callable[[], Scorer], size: int = 16) -> DataFrame:
    """(key, scores array<double>). make is called once a task, where a session is opened."""

    def run(batches):
        scorer = make()
        for pdf in batches:
            found = in_batches([np.asarray(x, float) for x in pdf[features]], scorer, size)
            yield pd.DataFrame({key: pdf[key], "scores": [np.asarray(f, float) for f in found]})

    return df.select(key, features).mapInPandas(run, f"{key} long, scores array<double>")


def with_context(x: np.ndarray, window: int = 512, context: int = 64) -> np.ndarray:
    """Windows [n, context + window] of a signal, each with the end of the one before; the last is padded with zeros."""
    n = -(-len(x) // window)
    padded = np.pad(x, (context, n * window - len(x)))
    return np.stack([padded[i * window : i * window + window + context] for i in range(n)]) if n else np.empty((0, window + context))


def recurrent(x: np.ndarray, step: Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray]], state: np.ndarray) -> list[float]:
    """Scores of a signal's windows in order, each given the state that the one before left."""
    out = []
    for w in with_context(x):
        p, state = step(w, state)
        out.append(p)
    return out
