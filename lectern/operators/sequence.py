"""Operators on ordered frames and segments: state, islands, medians, merges, chunks.

`by` names the columns that part sequences (a recording, a speaker); sequences never meet, so each is one window
partition and none needs the others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frame length in seconds; thresholds, pads and lengths of speech segments (fixed values).
FRAME = 0.08
ONSET, OFFSET, PAD_ONSET, PAD_OFFSET, MIN_ON, MIN_GAP = 0.641, 0.561, 0.229, 0.079, 0.511, 0.296
MEDIAN_WIDTH = 11


def _before(by, order):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def median_truncated(df: DataFrame, by: list[str], order: list[str], score: str, width: int = MEDIAN_WIDTH, out: str = "median") -> DataFrame:
    """Centred median; the frame is cut off at the ends, and an even count gives the mean of the middle two."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(width // 2), width // 2)
    return df.withColumn(out, F.percentile(score, F.lit(0.5)).over(w))


def median_reflected(df: DataFrame, by: list[str], index: str, score: str, width: int = MEDIAN_WIDTH, out: str = "median") -> DataFrame:
    """Centred median over reflected ends: -k reads k, and n - 1 + k reads n - 1 - k, within the sequence. Every frame goes
    to the places that read it, so one shuffle by sequence and place does it."""
    half = width // 2
    n = F.count("*").over(Window.partitionBy(*by))
    i = F.col(index)
    at = F.explode(F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda d: (i + d)))
    places = df.select(*by, i.alias("__at"), n.alias("__n")).withColumn(index, F.col("__at")).withColumn("__read", at)
    r = F.abs(F.col("__read"))
    r = F.when(r > F.col("__n") - 1, 2 * F.col("__n") - 2 - r).otherwise(r)
    places = places.withColumn("__read", F.greatest(F.lit(0), F.least(r, F.col("__n") - 1)))
    values = df.select(*by, i.alias("__read"), F.col(score).alias("__v"))
    med = places.join(values, [*by, "__read"]).groupBy(*by, "__at").agg(F.percentile("__v", F.lit(0.5)).alias(out))
    return df.join(med.withColumnRenamed("__at", index), [*by, index])


def hysteresis(df: DataFrame, by: list[str], order: list[str], score: str, onset: float = ONSET, offset: float = OFFSET, out: str = "active") -> DataFrame:
    """On from a score of onset, off below offset, otherwise as before; off at the start."""
    mark = F.when(F.col(score) >= onset, True).when(F.col(score) < offset, False)
    return df.withColumn(out, F.coalesce(F.last(mark, ignorenulls=True).over(_before(by, order)), F.lit(False)))


def runs(df: DataFrame, by: list[str], index: str, flag: str) -> DataFrame:
    """Maximal runs of equal flags: by, flag, first, last, n."""
    order = Window.partitionBy(*by).orderBy(index)
    changed = F.when(F.col(flag).eqNullSafe(F.lag(flag).over(order)), 0).otherwise(1)
    marked = df.withColumn("__run", F.sum(changed).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "__run").agg(F.first(flag).alias(flag), F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("n")).drop("__run")


def fill_gaps(df: DataFrame, by: list[str], index: str, flag: str, most: int = 2) -> DataFrame:
    """False runs of at most so many frames between true ones become true; leading and trailing ones stay."""
    r = runs(df, by, index, flag)
    w = Window.partitionBy(*by).orderBy("first")
    return r.withColumn(flag, F.when(~F.col(flag) & (F.col("n") <= most) & F.lag("n").over(w).isNotNull() & F.lead("n").over(w).isNotNull(), True).otherwise(F.col(flag)))


def drop_short_runs(r: DataFrame, flag: str, most: int = 2) -> DataFrame:
    """True runs of at most so many frames become false; nothing changes for most <= 1. Run it after fill_gaps and merge_runs."""
    return r.withColumn(flag, F.col(flag) & (F.col("n") > most)) if most > 1 else r


def merge_runs(r: DataFrame, by: list[str], flag: str) -> DataFrame:
    """Neighbouring runs with the same flag become one."""
    w = Window.partitionBy(*by).orderBy("first")
    changed = F.when(F.col(flag).eqNullSafe(F.lag(flag).over(w)), 0).otherwise(1)
    m = r.withColumn("__run", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return m.groupBy(*by, "__run").agg(F.first(flag).alias(flag), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("__run")


def active_segments(r: DataFrame, flag: str, frame: float = FRAME) -> DataFrame:
    """(start, end) in seconds of the true runs."""
    return r.where(flag).withColumn("start", F.col("first") * F.lit(frame)).withColumn("end", (F.col("last") + 1) * F.lit(frame))


def pad(segments: DataFrame, onset: float = PAD_ONSET, offset: float = PAD_OFFSET, least: float = MIN_ON) -> DataFrame:
    """Starts earlier, not before 0, ends later; what is still shorter than least goes."""
    s = segments.withColumn("start", F.greatest(F.col("start") - onset, F.lit(0.0))).withColumn("end", F.col("end") + offset)
    return s.where(F.col("end") - F.col("start") >= least)


def merge_gaps(segments: DataFrame, by: list[str], gap: float = MIN_GAP) -> DataFrame:
    """Chains of segments with less than gap between one's end and the next one's start; the last one's end counts."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    apart = F.when(F.col("start") - F.lag("end").over(w) < gap, 0).otherwise(1)
    m = segments.withColumn("__chain", F.sum(apart).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return m.groupBy(*by, "__chain").agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end"), F.count("*").alias("parts")).drop("__chain")


def merge_neighbours(segments: DataFrame, by: list[str], speaker: str, first: str, last: str, gap: int = 50) -> DataFrame:
    """Of all speakers' segments in order, those that directly follow one of the same speaker no more than gap after its
    chain's latest end join it."""
    w = Window.partitionBy(*by).orderBy(first, last, speaker)
    alone = F.when(F.col(speaker).eqNullSafe(F.lag(speaker).over(w)), 0).otherwise(1)
    m = segments.withColumn("__turn", F.sum(alone).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    t = Window.partitionBy(*by, "__turn").orderBy(first, last)
    latest = F.max(last).over(t.rowsBetween(Window.unboundedPreceding, -1))
    m = m.withColumn("__cut", F.when(F.col(first) - latest <= gap, 0).otherwise(1))
    m = m.withColumn("__chain", F.sum("__cut").over(t.rowsBetween(Window.unboundedPreceding, 0)))
    return m.groupBy(*by, "__turn", speaker, "__chain").agg(F.min(first).alias(first), F.max(last).alias(last), F.count("*").alias("parts")).drop("__turn", "__chain")


def vad_fold(scores: list[float], window: float = 512 / 16000, onset: float = 0.5, offset: float = 0.35, min_silence: float = 0.1, speech_pad: float = 0.03, min_speech: float = 0.25) -> list[tuple[float, float]]:
    """Speech segments of one sequence: a score of onset starts one or cancels its pending end; a score below offset
    makes an end pending, which holds once silence has lasted; scores between do neither. A segment that is still open
    at the end closes there, without the trailing pad."""
    out, start, pending, length = [], None, None, len(scores) * window
    for i, p in enumerate(scores):
        at = i * window
        if p >= onset:
            pending = None
            if start is None:
                start = at
        elif p < offset and start is not None:
            pending = at if pending is None else pending
            if at - pending >= min_silence:
                if pending - start >= min_speech:
                    out.append((max(0.0, start - speech_pad), min(length, pending + speech_pad)))
                start = pending = None
    if start is not None and length - start >= min_speech:
        out.append((max(0.0, start - speech_pad), length))
    return out


def vad_segments(df: DataFrame, by: str, order: str, score: str, **rules: float) -> DataFrame:
    """vad_fold for every recording; the pending end makes it a fold, so a recording is one group."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        spans = vad_fold(pdf.sort_values(order)[score].tolist(), **rules)
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(spans), "n": np.arange(len(spans)), "start": [round(s, 6) for s, _ in spans], "end": [round(e, 6) for _, e in spans]})

    return df.select(by, order, score).groupBy(by).applyInPandas(fold, f"{by} long, n long, start double, end double")


def min_span_groups(segments: DataFrame, by: str, least: float = 5.0) -> DataFrame:
    """Consecutive segments gathered until they span least seconds; a shorter rest joins the group before it, if there is
    one. Gives by, grp, start, end, n. The threshold starts anew with each group, so it is a fold over a recording's
    segments, in the JVM."""
    s = segments.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s"))
    group = "struct<start:double,end:double,n:bigint>"
    start = F.struct(F.array().cast(f"array<{group}>").alias("done"), F.lit(None).cast(group).alias("open"))

    def step(acc: Column, x: Column) -> Column:
        now = F.when(acc["open"].isNull(), F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(1).cast("long").alias("n"))).otherwise(
            F.struct(acc["open"]["start"].alias("start"), F.greatest(acc["open"]["end"], x["end"]).alias("end"), (acc["open"]["n"] + 1).alias("n"))
        )
        full = now["end"] - now["start"] >= least
        return F.struct(F.when(full, F.array_append(acc["done"], now)).otherwise(acc["done"]).alias("done"), F.when(~full, now).alias("open"))

    def finish(acc: Column) -> Column:
        last = F.element_at(acc["done"], -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], acc["open"]["end"]).alias("end"), (last["n"] + acc["open"]["n"]).alias("n"))
        return (
            F.when(acc["open"].isNull(), acc["done"])
            .when(F.size(acc["done"]) == 0, F.array(acc["open"]))
            .otherwise(F.array_append(F.slice(acc["done"], 1, F.size(acc["done"]) - 1), joined))
        )

    return s.select(by, F.posexplode(F.aggregate("s", start, step, finish)).alias("grp", "g")).select(by, F.col("grp").cast("long").alias("grp"), "g.start", "g.end", "g.n")


def ctc_collapse(df: DataFrame, by: list[str], frame: str, token: str, logp: str, blank: int) -> DataFrame:
    """Runs of the best token, blanks dropped: by, token, start, frames, logp (the run's best)."""
    w = Window.partitionBy(*by).orderBy(frame)
    new = F.when(F.col(token) == F.lag(token).over(w), 0).otherwise(1)
    m = df.withColumn("__run", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = m.groupBy(*by, "__run").agg(F.first(token).alias(token), F.min(frame).alias("start"), F.count("*").alias("frames"), F.max(logp).alias("logp"))
    return g.where(F.col(token) != blank).drop("__run")


def sliding_chunks(df: DataFrame, n: str, size: int, stride: int) -> DataFrame:
    """A row for each window [start, start + size) that begins before n; `pad` is what it lacks."""
    s = df.where(F.col(n) > 0).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1, F.lit(stride).cast("long"))))
    return s.withColumn("pad", F.greatest(F.lit(0), F.col("start") + size - F.col(n)))


def fixed_chunks(df: DataFrame, seconds: str, size: float = 30.0) -> DataFrame:
    """Chunks of size seconds one after the other, the last one short."""
    s = df.where(F.col(seconds) > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(seconds) / size) - 1)))
    return s.withColumn("start", F.col("chunk") * F.lit(size)).withColumn("end", F.least((F.col("chunk") + 1) * F.lit(size), F.col(seconds)))


def running_reset_max(df: DataFrame, by: list[str], order: list[str], value: str, reset: Column, out: str) -> DataFrame:
    """Largest value so far, starting anew at every row where reset holds."""
    w = _before(by, order)
    e = df.withColumn("__epoch", F.sum(F.when(reset, 1).otherwise(0)).over(w))
    return e.withColumn(out, F.max(value).over(_before([*by, "__epoch"], order))).drop("__epoch")


def within_budget(df: DataFrame, by: list[str], order: list[str], cost: str, budget: float) -> DataFrame:
    """The leading rows whose costs fit the budget together; the first one always."""
    w = _before(by, order)
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).withColumn("spent", F.sum(cost).over(w)).where((F.col("__n") == 1) | (F.col("spent") <= budget)).drop("__n")


def until_cap(df: DataFrame, by: list[str], order: list[str], count: str, cap: int) -> DataFrame:
    """Rows up to the one that reaches the cap, that one included."""
    before = F.coalesce(F.sum(count).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("before", before).where(F.col("before") < cap)


def first_of_each(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
