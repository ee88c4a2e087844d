"""Decoding of recorded scores, and token arithmetic that needs a loop; each recording or row is by itself."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens one frame may give at most.
MOST_PER_FRAME = 10


#: A model of tokens and durations: frame, tokens so far and its state, to scores of tokens, of durations, and the state
#: that holds if the token counts.
Step = Callable[[int, list[int], object], tuple[np.ndarray, np.ndarray, object]]


def recorded(tokens: np.ndarray, durations: np.ndarray) -> Step:
    """A model whose scores are known for each frame, whatever came before."""
    return lambda t, seq, state: (tokens[t], durations[t], state)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float) - np.max(x)
    return x - np.log(np.exp(x).sum())


def tdt_greedy(step: Step, frames: int, blank: int, state: object = None) -> list[tuple[int, int, int, float]]:
    """(frame, token, duration, log-probability) of the best token of each frame visited, if it isn't blank. The best duration
    says how far to go on; at none the model is asked again at the same frame, after a blank or MOST_PER_FRAME tokens
    at the next one."""
    out, t, here = [], 0, 0
    while t < frames:
        tokens, durations, new = step(t, [k for _, k, _, _ in out], state)
        k, far = int(np.argmax(tokens)), int(np.argmax(durations))
        if k != blank:
            state, here = new, here + 1
            out.append((t, k, far, float(log_softmax(tokens)[k])))
        if far > 0 or k == blank or here == MOST_PER_FRAME:
            t, here = t + max(1, far), 0
    return out


def tdt_beam(step: Step, frames: int, blank: int, beam: int = 4, lm: Callable[[tuple[int, ...], int], float] | None = None, weight: float = 0.0, reward: float = 0.0, state: object = None) -> list[int]:
    """Tokens of the best path: every live path goes on by each of its frame's best tokens and all durations, and the best
    paths live on. Language model and reward count for tokens that aren't blank; no more than MOST_PER_FRAME tokens come
    from a frame, and a blank goes on by a frame at least. Paths with equal tokens aren't merged. The score decides; then,
    so that the result is defined, the path found first."""
    live: list[tuple[float, int, tuple[int, ...], int, object]] = [(0.0, 0, (), 0, state)]
    done: list[tuple[float, int, tuple[int, ...], int, object]] = []
    while live:
        grown = []
        for score, t, seq, here, held in live:
            if t >= frames:
                done.append((score, t, seq, here, held))
                continue
            tokens, durations, new = step(t, list(seq), held)
            lp, ld = log_softmax(tokens), log_softmax(durations)
            for k in np.argsort(-lp, kind="stable")[:beam].tolist():
                extra = reward + weight * lm(seq, k) if lm is not None and k != blank else 0.0
                for far in range(len(ld)):
                    s = score + float(lp[k] + ld[far]) + extra
                    if k == blank:
                        grown.append((s, t + max(1, far), seq, 0, held))
                    elif far or here < MOST_PER_FRAME:
                        grown.append((s, t + far, (*seq, k), 0 if far else here + 1, new))
        grown.sort(key=lambda x: -x[0])
        live = grown[:beam]
    return list(max(done, key=lambda x: x[0])[2]) if done else []


class Backoff:
    """Natural log-probability of a token after others, by an n-gram model {gram: (log10 p, log10 backoff)} of joined ids: the
    longest gram that is known, with the backoffs of longer contexts; an unknown token has unk alone."""

    def __init__(self, grams: dict[str, tuple[float, float]], order: int, unk: float):
        self.grams, self.order, self.unk = grams, order, unk

    def __call__(self, seq: tuple[int, ...], token: int) -> float:
        context, skipped = [str(k) for k in seq[len(seq) - min(len(seq), self.order - 1) :]], 0.0
        for n in range(len(context), -1, -1):
            before = context[len(context) - n :]
            found = self.grams.get(" ".join([*before, str(token)]))
            if found is not None:
                return (found[0] + skipped) * np.log(10)
            skipped += self.grams.get(" ".join(before), (0.0, 0.0))[1] if n else 0.0
        return self.unk * np.log(10)


def decode(df: DataFrame, by: str, order: str, tokens: str, durations: str, blank: int, beam: int | None = None, lm: Backoff | None = None, weight: float = 0.0, reward: float = 0.0) -> DataFrame:
    """(by, text): ids of each recording's tokens, from recorded score arrays."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        step = recorded(np.stack(pdf[tokens].to_numpy()).astype(float), np.stack(pdf[durations].to_numpy()).astype(float))
        ids = [k for _, k, _, _ in tdt_greedy(step, len(pdf), blank)] if beam is None else tdt_beam(step, len(pdf), blank, beam, lm, weight, reward)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "text": [" ".join(map(str, ids))]})

    return df.select(by, order, tokens, durations).groupBy(by).applyInPandas(run, f"{by} long, text string")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def segment_logprobs(said: pd.Series, pieces: pd.Series, logprobs: pd.Series) -> pd.Series:
    """Mean log-probability of the tokens behind each object of a JSON text that the pieces spell out: an object's
    characters are found in the text, and a token counts where it touches them."""
    out = []
    for text, ps, lps in zip(said, pieces, logprobs, strict=True):
        ends = np.cumsum([len(p) for p in ps])
        starts, means, depth, at = ends - [len(p) for p in ps], [], 0, 0
        for i, c in enumerate(text or ""):
            if c == "{":
                depth, at = depth + 1, i if depth == 0 else at
            elif c == "}" and depth:
                depth -= 1
                if depth == 0:
                    try:
                        json.loads(text[at : i + 1])
                    except ValueError:
                        continue
                    touch = (starts <= i) & (ends > at)
                    means.append(float(np.mean(np.asarray(lps)[touch])) if touch.any() else 0.0)
        out.append(means)
    return pd.Series(out)


def progress(actions: Column) -> Column:
    """What a page shows after its actions, an array of (kind, value) in order: the largest percentage since the last
    load, and the segments, each once."""
    start = F.struct(F.lit(0.0).alias("percent"), F.array().cast("array<string>").alias("segments"))

    def step(s: Column, a: Column) -> Column:
        percent = F.when(a["kind"] == "load", 0.0).when(a["kind"] == "percent", F.greatest(s["percent"], a["value"])).otherwise(s["percent"])
        add = (a["kind"] == "segment") & ~F.array_contains(s["segments"], a["value"].cast("string"))
        return F.struct(percent.alias("percent"), F.when(add, F.array_append(s["segments"], a["value"].cast("string"))).otherwise(s["segments"]).alias("segments"))

    return F.aggregate(actions, start, step)
