"""Joins of intervals and points. Intervals are dealt to time buckets, so that a join on recording and bucket finds
what may overlap; a plain condition on bounds would compare all rows of a recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 10.0


def _bucketed(df: DataFrame, start: str, end: str, width: float) -> DataFrame:
    lo, hi = F.floor(F.col(start) / width), F.floor(F.greatest(F.col(end), F.col(start)) / width)
    return df.withColumn("__bucket", F.explode(F.sequence(lo, hi)))


def max_overlap(a: DataFrame, b: DataFrame, key: str, a_id: str, b_id: str, bucket: float = BUCKET) -> DataFrame:
    """(key, a_id, b_id, overlap): for each interval of a (start, end) the one of b it overlaps most, the smaller b_id on
    ties; only overlaps above 0."""
    x = _bucketed(a.select(key, a_id, "start", "end"), "start", "end", bucket)
    y = _bucketed(b.select(key, F.col(b_id).alias("__b"), F.col("start").alias("__s"), F.col("end").alias("__e")), "__s", "__e", bucket)
    both = x.join(y, [key, "__bucket"]).withColumn("overlap", F.least("end", "__e") - F.greatest("start", "__s")).where("overlap > 0")
    best = both.groupBy(key, a_id).agg(F.max_by(F.struct("__b", "overlap"), F.struct("overlap", -F.col("__b"))).alias("best"))
    return best.select(key, a_id, F.col("best.__b").alias(b_id), "best.overlap")


def nearest_midpoint(a: DataFrame, b: DataFrame, key: str, a_id: str, b_id: str) -> DataFrame:
    """(key, a_id, b_id, distance): the interval of b whose midpoint is nearest, the smaller b_id on ties. Both sides are
    laid on one line per key; the last and the next of b around each of a are the only candidates."""
    mid = (F.col("start") + F.col("end")) / 2
    pb = b.select(key, mid.alias("m"), F.lit(None).cast("long").alias("a"), F.col(b_id).cast("long").alias("b"))
    pb = pb.groupBy(key, "m").agg(F.min("b").alias("b")).select(key, "m", F.lit(None).cast("long").alias("a"), "b")
    line = pb.union(a.select(key, mid.alias("m"), F.col(a_id).cast("long").alias("a"), F.lit(None).cast("long").alias("b")))
    here = F.when(F.col("b").isNotNull(), F.struct("m", "b"))
    w = Window.partitionBy(key).orderBy("m", F.col("b").isNull())
    back = Window.partitionBy(key).orderBy(F.desc("m"), F.col("b").isNull())
    up = Window.unboundedPreceding
    near = line.withColumn("lo", F.last(here, True).over(w.rowsBetween(up, 0))).withColumn("hi", F.last(here, True).over(back.rowsBetween(up, 0))).where("a is not null")
    pick = F.array_min(F.filter(F.transform(F.array("lo", "hi"), lambda s: F.when(s.isNotNull(), F.struct(F.abs(s["m"] - F.col("m")).alias("distance"), s["b"].alias("b")))), lambda s: s.isNotNull()))
    return near.withColumn("best", pick).where("best is not null").select(key, F.col("a").alias(a_id), F.col("best.b").alias(b_id), "best.distance")


def assign_speakers(a: DataFrame, b: DataFrame, key: str, a_id: str, b_id: str) -> DataFrame:
    """The interval of b each interval of a overlaps most, else the nearest by midpoint."""
    over = max_overlap(a, b, key, a_id, b_id)
    rest = nearest_midpoint(a.join(over, [key, a_id], "left_anti"), b, key, a_id, b_id)
    return over.select(key, a_id, b_id, F.lit("overlap").alias("how")).union(rest.select(key, a_id, b_id, F.lit("nearest").alias("how")))


def segment_at(points: DataFrame, segments: DataFrame, key: str, point_id: str, t: str, seg_id: str, bucket: float = BUCKET) -> DataFrame:
    """(key, point_id, seg_id, how): the first segment with start <= t < end; else the next to start after t; else the
    last. The two fallbacks come from one pass over points and starts in order."""
    p = points.select(key, point_id, F.col(t).alias("__t"))
    s = _bucketed(segments.select(key, F.col(seg_id).alias("__seg"), "start", "end"), "start", "end", bucket)
    inside = p.withColumn("__bucket", F.floor(F.col("__t") / bucket)).join(s, [key, "__bucket"]).where("start <= __t and __t < end")
    inside = inside.groupBy(key, point_id).agg(F.min_by("__seg", F.struct("start", "__seg")).alias(seg_id)).withColumn("how", F.lit("inside"))
    rest = p.join(inside, [key, point_id], "left_anti")
    starts = segments.groupBy(key, F.col("start").alias("__t")).agg(F.min(seg_id).alias("__seg"))
    last = segments.groupBy(key).agg(F.max_by(seg_id, F.struct("start", seg_id)).alias("__last"))
    line = starts.select(key, "__t", "__seg", F.lit(None).cast("long").alias(point_id)).union(rest.select(key, "__t", F.lit(None).cast("long"), point_id))
    w = Window.partitionBy(key).orderBy(F.desc("__t"), F.col("__seg").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    later = line.withColumn("__next", F.last("__seg", True).over(w)).where(F.col(point_id).isNotNull())
    out = later.join(last, key, "left").select(key, point_id, F.coalesce("__next", "__last").alias(seg_id), F.when(F.col("__next").isNotNull(), "next").otherwise("last").alias("how"))
    return inside.union(out.where(F.col(seg_id).isNotNull()))


def token_at(t: Column, timestamps: Column, frame: float = 0.08) -> Column:
    """Index of the last token before the first one that begins after t; -1 before the first."""
    later = F.filter(F.transform(timestamps, lambda x, i: F.when(x * F.lit(frame) > t, i)), lambda i: i.isNotNull())
    return F.coalesce(F.array_min(later), F.size(timestamps)) - 1


def preceding(df: DataFrame, by: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """The nearest value that isn't null in a row before."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def decode_tokens(df: DataFrame, key: list[str], tokens: str, vocab: DataFrame, id_col: str = "id", piece: str = "piece") -> DataFrame:
    """(key, text): pieces of the tokens in order; ids without a piece are skipped."""
    t = df.select(*key, F.posexplode(tokens).alias("pos", id_col))
    g = t.join(vocab, id_col).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", piece))).alias("p"))
    return g.select(*key, F.array_join(F.transform("p", lambda x: x[piece]), "").alias("text"))
