"""Recognition quality: word and character error rates, longest common subsequences, entity scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.vectors import cosine


def prf(gold: Column, found: Column) -> Column:
    """Precision, recall and F1 of two sets; 1 where both are empty, 0 where one is."""
    g, p, tp = F.size(gold), F.size(found), F.size(F.array_intersect(gold, found))
    both, one = (g == 0) & (p == 0), (g == 0) | (p == 0)
    of = lambda x: F.when(both, 1.0).when(one, 0.0).otherwise(x)
    return F.struct(of(tp / p).alias("prec"), of(tp / g).alias("rec"), of(2 * tp / (p + g)).alias("f1"))


def edits(ref: list, hyp: list) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions of a shortest edit; a row of the table is one numpy step. Among shortest
    edits, ones that substitute come first, then ones that delete."""
    n, m = len(ref), len(hyp)
    number: dict = {}
    r = np.array([number.setdefault(x, len(number)) for x in ref], np.int64)
    h = np.array([number.setdefault(x, len(number)) for x in hyp], np.int64)
    table = np.empty((n + 1, m + 1), np.int32)
    table[0] = np.arange(m + 1)
    along = np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        row = table[i - 1] + 1
        row[1:] = np.minimum(row[1:], table[i - 1][:-1] + (h != r[i - 1]))
        table[i] = np.minimum.accumulate(row - along) + along
    i, j, s, d, ins = n, m, 0, 0, 0
    while i or j:
        if i and j and table[i, j] == table[i - 1, j - 1] + (r[i - 1] != h[j - 1]):
            s += int(r[i - 1] != h[j - 1])
            i, j = i - 1, j - 1
        elif i and table[i, j] == table[i - 1, j] + 1:
            d, i = d + 1, i - 1
        else:
            ins, j = ins + 1, j - 1
    return s, d, ins


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence."""
    row = np.zeros(len(b) + 1, np.int32)
    other = np.array(b, dtype=object)
    for x in a:
        up = row.copy()
        row[1:] = np.maximum.accumulate(np.maximum(up[1:], np.where(other == x, up[:-1] + 1, 0)))
    return int(row[-1])


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("sub", "del", "ins", "n_ref")]))
def word_edits(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Edits between two texts by words; texts are compared as they are, so normalise them first."""
    rows = [(*edits(r := (a or "").split(), (b or "").split()), len(r)) for a, b in zip(ref, hyp, strict=True)]
    return pd.DataFrame(rows, columns=["sub", "del", "ins", "n_ref"])


@F.pandas_udf(T.DoubleType())
def rouge_l(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of words; 1 where both have none, 0 where one has none."""
    out = []
    for a, b in zip(ref, hyp, strict=True):
        x, y = (a or "").split(), (b or "").split()
        both = lcs(x, y) if x and y else 0
        out.append(1.0 if not x and not y else 2 * both / (len(x) + len(y)))
    return pd.Series(out)


def char_error_rate(ref: Column, hyp: Column) -> Column:
    """Character edits by the length of the reference, in the JVM."""
    return F.levenshtein(ref, hyp) / F.greatest(F.length(ref), F.lit(1))


def entity_sets(words: DataFrame, terms: DataFrame, by: list[str], word: str, cls: str, gold: str) -> DataFrame:
    """(by, cls, gold_set, found_set): the terms of each class among the words of the reference (gold) and of the other text."""
    hit = words.join(terms, word)
    of = lambda c: F.array_sort(F.collect_set(F.when(c, F.col(word))))
    return hit.groupBy(*by, cls).agg(of(F.col(gold)).alias("gold_set"), of(~F.col(gold)).alias("found_set"))


def parity(a: Column, b: Column, x: Column, y: Column, apart: float = 1e-3, along: float = 0.9999) -> Column:
    """Whether two scorers agree: scores a and b have the same best entry, their softmax differs by no more than apart
    anywhere, and vectors x and y have a cosine of at least along."""
    e = lambda v: F.transform(v, lambda s: F.exp(s - F.array_max(v)))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, t: s + t)
    ea, eb = e(a), e(b)
    far = F.array_max(F.zip_with(ea, eb, lambda s, t: F.abs(s / total(ea) - t / total(eb))))
    return (F.array_position(a, F.array_max(a)) == F.array_position(b, F.array_max(b))) & (far <= apart) & (cosine(x, y) >= along)
