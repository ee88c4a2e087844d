"""The transcript store: ordered aggregation of cards, edits as projections and op-logs, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranges

FRAME = 0.08


def aggregate_cards(sources: DataFrame, results: DataFrame) -> DataFrame:
    """Per card: slices [token_start, token_end) of its sources' tokens, timestamps (moved by the offset), logprobs and
    durations in source order; the trimmed texts joined by blanks; the first language. Durations count only where every
    source covers its slice."""
    j = sources.join(results, "result_id")
    n = F.coalesce("token_end", F.size("timestamps")) - F.col("token_start")
    n = F.greatest(n, F.lit(0))
    cut = lambda c: F.slice(c, F.col("token_start") + 1, n)
    one = F.struct(
        "source_order", "result_id", F.coalesce(cut("tokens"), F.array().cast("array<int>")).alias("tokens"), F.transform(cut("timestamps"), lambda x: (x + F.col("ts_frame_offset")).cast("int")).alias("timestamps"), cut("logprobs").alias("logprobs"),
        F.coalesce(cut("durations"), F.array().cast("array<int>")).alias("durations"), (F.col("durations").isNotNull() & (F.size("durations") >= F.col("token_start") + n)).alias("covered"), F.trim("asr_content").alias("text"), "language",
    )
    g = j.groupBy("card_id").agg(F.array_sort(F.collect_list(one)).alias("s"))
    flat = lambda f: F.flatten(F.transform("s", lambda x: x[f]))
    return g.select(
        "card_id", flat("tokens").alias("tokens"), flat("timestamps").alias("timestamps"), flat("logprobs").alias("logprobs"),
        F.when(F.forall("s", lambda x: x["covered"]), flat("durations")).otherwise(F.array().cast("array<int>")).alias("durations"),
        F.array_join(F.filter(F.transform("s", lambda x: x["text"]), lambda t: t != ""), " ").alias("text"),
        F.get(F.filter(F.transform("s", lambda x: x["language"]), lambda v: v.isNotNull()), F.lit(0)).alias("language"),
    )


def fold_log(log: DataFrame, key: str, seq: str, fields: list[str]) -> DataFrame:
    """The last value set for each field of a key; a null in the log sets nothing."""
    return log.groupBy(key).agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(seq))).alias(f) for f in fields])


def migrate_cards(results: DataFrame, cards: DataFrame) -> DataFrame:
    """A card for each result, where there are results and no cards; else the cards as they are. Made once: a second run changes nothing."""
    new = results.select(F.col("result_id").alias("card_id"), "speaker_id", F.col("start_time").alias("play_start"), F.col("end_time").alias("play_end"), F.lit(None).cast("string").alias("content"))
    have = cards.select("card_id", "speaker_id", "play_start", "play_end", "content")
    any_card = have.limit(1).select(F.lit(1).alias("__any"))
    return new.join(any_card, F.lit(True), "left_anti").union(have)


def merge_pair(a: str, b: str) -> list[Column]:
    """Columns of the card that joins struct columns a and b: b's timestamps move by the rounded gap of their starts in frames; text is always written out."""
    x, y = F.col(a), F.col(b)
    move = F.bround((y["play_start"] - x["play_start"]) / F.lit(FRAME)).cast("int")
    return [
        x["card_id"].alias("card_id"), F.least(x["play_start"], y["play_start"]).alias("play_start"), F.greatest(x["play_end"], y["play_end"]).alias("play_end"),
        F.concat(x["tokens"], y["tokens"]).alias("tokens"), F.concat(x["timestamps"], F.transform(y["timestamps"], lambda t: t + move)).alias("timestamps"),
        F.array_join(F.filter(F.array(F.trim(x["text"]), F.trim(y["text"])), lambda t: t != ""), " ").alias("content"),
    ]


def merge_source_ranges(sources: DataFrame, card: str = "card_id") -> DataFrame:
    """Sources of one result in one card become one: the first start, the last end, null standing for open."""
    g = sources.groupBy(card, "result_id").agg(F.min("token_start").alias("token_start"), F.when(F.count_if(F.col("token_end").isNull()) > 0, None).otherwise(F.max("token_end")).alias("token_end"), F.min("source_order").alias("source_order"))
    return g


def split_card(cards: DataFrame, at: Column) -> DataFrame:
    """Two cards for each: tokens before index at, and from it on, whose timestamps begin anew; the time between them is
    that token's, or the middle where there is none."""
    n = F.size("tokens")
    t = F.coalesce(F.get("timestamps", at), F.lit(None).cast("int"))
    mid = F.when(t.isNotNull(), F.col("play_start") + t * F.lit(FRAME)).otherwise((F.col("play_start") + F.col("play_end")) / 2)
    half = lambda part, s, e, lo, k, move: F.struct(F.lit(part).alias("part"), s.alias("play_start"), e.alias("play_end"), F.slice("tokens", lo, k).alias("tokens"), F.transform(F.slice("timestamps", lo, k), lambda x: x - move).alias("timestamps"))
    rest = F.greatest(n - at, F.lit(0))
    both = F.array(half(0, F.col("play_start"), mid, F.lit(1), F.least(at, n), F.lit(0)), half(1, mid, F.col("play_end"), at + 1, rest, F.coalesce(t, F.lit(0))))
    return cards.select("card_id", F.explode(both).alias("h")).select("card_id", "h.*")


def job_state(events: DataFrame, job: str, seq: str, status: str, error: str, seconds: str) -> DataFrame:
    """The last event of each job; error and run time are the last event's own, so one without them clears them."""
    last = events.groupBy(job).agg(F.max_by(F.struct(status, error, seconds), seq).alias("s"))
    return last.select(job, "s.*")


def recover(status: Column) -> Column:
    """What a job is after a restart: one that ran has failed, one that waited is cancelled."""
    return F.when(status == "Running", "Failed").when(status == "Queued", "Cancelled").otherwise(status)


def upsert(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Rows of new replace or join those of old by key."""
    o = old.select(*key, *[F.col(v).alias(f"__o_{v}") for v in values], F.lit(True).alias("__old"))
    n = new.select(*key, *[F.col(v).alias(f"__n_{v}") for v in values], F.lit(True).alias("__new"))
    j = o.join(n, key, "full_outer")
    return j.select(*key, *[F.when(F.col("__new"), F.col(f"__n_{v}")).otherwise(F.col(f"__o_{v}")).alias(v) for v in values])


def route_language(iso: Column, p: Column, supported: Column, least: float = 0.60) -> Column:
    """override where the detection is clear and supported, suggest where clear and not, else keep."""
    return F.when(iso.isNull() | (p < least), "keep").when(supported, "override").otherwise("suggest")


def banner(forced: Column, mismatch: Column, drift: Column) -> Column:
    """One banner at a time: a language the user forced, then a mismatch, then a changed backend."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(forced), "forced").when(yes(mismatch), "mismatch").when(yes(drift), "drift").otherwise("none")


def insert(rows: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows and new ones, which get the ids after the largest, in the given order. Ids come from two levels of counts:
    ranges of the order's first column, then places in a range, so no task sees all new rows."""
    top = rows.agg(F.coalesce(F.max(key), F.lit(0)).alias("__top"))
    return rows.unionByName(ranges.numbered(new, order, "__n").join(F.broadcast(top)).withColumn(key, F.col("__top") + F.col("__n")).drop("__top", "__n"))


def commit(spark: SparkSession, path: str, df: DataFrame) -> None:
    """The next version of a table: written beside the others, and there for readers once its folder has its name."""
    versions = _versions(spark, path)
    n = max(versions, default=-1) + 1
    df.write.parquet(f"{path}/.next-{n}")
    files, at = _files(spark, path)
    if not files.rename(at(f"{path}/.next-{n}"), at(f"{path}/v{n}")):
        raise OSError(f"version {n} of {path} is there already")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table as its last commit left it."""
    return spark.read.parquet(f"{path}/v{max(_versions(spark, path))}")


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, path: str) -> list[int]:
    files, at = _files(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(at(path))] if files.exists(at(path)) else []
    return [int(x[1:]) for x in names if x[:1] == "v" and x[1:].isdigit()]
