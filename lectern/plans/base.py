"""The transcript tables that queries read, made from the driver's tables, in DataFrames and in SQL.

A conversation stands for a recording, a turn for a recognised segment, a user's events for a recording's frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.session import table

from .registry import query


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognition results: one row a segment, never changed by edits."""
    c = table(spark, sf_dir, "conversations")
    w = F.split("text", " ")
    c = c.withColumn("result_id", F.col("conv_id") * 1000 + F.col("turn"))
    return c.select(
        "result_id", F.col("conv_id").alias("audio_id"), "turn",
        F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3).alias("speaker_id"),
        (F.col("turn") * F.lit(5.0) + (F.col("conv_id") % 7) / F.lit(4.0)).alias("start_time"),
        (F.col("turn") * F.lit(5.0) + (F.col("conv_id") % 7) / F.lit(4.0) + F.lit(0.5) + (F.length("text") % 40) / F.lit(10.0)).alias("end_time"),
        F.col("text").alias("asr_content"),
        F.when(F.col("conv_id") % 4 == 0, "en").when(F.col("conv_id") % 4 == 1, "EN").when(F.col("conv_id") % 4 == 2, "fr").alias("language"),
        F.when(F.col("result_id") % 11 != 0, F.transform(w, lambda x: F.length(x))).alias("tokens"),
        F.transform(w, lambda x, i: i * 3).alias("timestamps"),
        F.transform(w, lambda x: -(F.length(x) % 10) / F.lit(10.0)).alias("logprobs"),
        F.when(F.col("result_id") % 6 != 1, F.transform(w, lambda x: F.length(x) % 4 + 1)).alias("durations"),
    )


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES (1, 'Ada user'), (2, 'Ben assistant'), (3, 'Cy system') AS t(speaker_id, name)")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edit overlay: a card for each result, some with text of their own, some verified or suppressed."""
    r = results(spark, sf_dir)
    return r.select(
        F.col("result_id").alias("card_id"), "audio_id", "speaker_id", F.col("start_time").alias("play_start"), F.col("end_time").alias("play_end"),
        F.when(F.col("result_id") % 5 == 0, F.concat(F.lit("edited: "), "asr_content")).alias("content"), (F.col("result_id") % 3 == 0).alias("verified"), (F.col("turn") == 6).alias("suppressed"),
    )


def card_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which slices of which results a card shows; one card in four also shows a part of the next segment."""
    r = results(spark, sf_dir)
    first = r.select(F.col("result_id").alias("card_id"), "result_id", F.lit(0).alias("token_start"), F.lit(None).cast("int").alias("token_end"), F.lit(0).alias("ts_frame_offset"), F.lit(0).alias("source_order"))
    second = r.where("result_id % 4 = 2 and turn > 0").select((F.col("result_id") - 1).alias("card_id"), "result_id", F.lit(1).alias("token_start"), F.lit(3).alias("token_end"), F.lit(10).alias("ts_frame_offset"), F.lit(1).alias("source_order"))
    return first.union(second)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame scores: audio_id, frame from 0, spk, p in [0, 1] rising and falling in triangles with some noise."""
    e = table(spark, sf_dir, "events")
    e = e.withColumn("frame", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long"))
    wave = F.abs((F.col("frame") * 23 + F.col("user_id") * 11) % 200 - 100)
    p = F.least(F.lit(1.0), (wave * 9 + (F.col("event_id") * 7919) % 100) / F.lit(1000.0))
    return e.select(F.col("user_id").alias("audio_id"), "frame", F.col("event_type").alias("spk"), p.alias("p"), "event_id", "ts", "value")


def speaker_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with four speakers' probabilities and an embedding of six dimensions."""
    e = frames(spark, sf_dir).select("audio_id", "frame", "event_id")
    wave = lambda s: F.abs((F.col("frame") * 23 + F.col("audio_id") * 11 + s * 50) % 200 - 100) / F.lit(100.0)
    p = F.array(*[F.when(F.col("event_id") % 7 == 0, 0.02).otherwise(wave(s) * wave(s)) for s in range(4)])
    x = F.array(*[((F.col("event_id") * (k + 3)) % 101) / F.lit(100.0) for k in range(6)])
    return e.select("audio_id", "frame", x.alias("x"), p.alias("p"))


#: The same tables as common table expressions.
PRELUDE = """
results AS (
  SELECT conv_id * 1000 + turn AS result_id, conv_id AS audio_id, turn,
    CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS speaker_id,
    turn * 5.0::DOUBLE + (conv_id % 7) / 4.0::DOUBLE AS start_time,
    turn * 5.0::DOUBLE + (conv_id % 7) / 4.0::DOUBLE + 0.5::DOUBLE + (length(text) % 40) / 10.0::DOUBLE AS end_time,
    text AS asr_content, CASE conv_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'EN' WHEN 2 THEN 'fr' END AS language,
    CASE WHEN (conv_id * 1000 + turn) % 11 <> 0 THEN list_transform(string_split(text, ' '), lambda w: length(w)) END AS tokens,
    list_transform(range(len(string_split(text, ' '))), lambda i: i * 3) AS timestamps,
    list_transform(string_split(text, ' '), lambda w: -(length(w) % 10) / 10.0::DOUBLE) AS logprobs,
    CASE WHEN (conv_id * 1000 + turn) % 6 <> 1 THEN list_transform(string_split(text, ' '), lambda w: length(w) % 4 + 1) END AS durations
  FROM conversations
),
speakers AS (SELECT * FROM (VALUES (1, 'Ada user'), (2, 'Ben assistant'), (3, 'Cy system')) t(speaker_id, name)),
cards AS (
  SELECT result_id AS card_id, audio_id, speaker_id, start_time AS play_start, end_time AS play_end,
    CASE WHEN result_id % 5 = 0 THEN 'edited: ' || asr_content END AS content, result_id % 3 = 0 AS verified, turn = 6 AS suppressed FROM results
),
card_sources AS (
  SELECT result_id AS card_id, result_id, 0 AS token_start, NULL::INT AS token_end, 0 AS ts_frame_offset, 0 AS source_order FROM results
  UNION ALL SELECT result_id - 1, result_id, 1, 3, 10, 1 FROM results WHERE result_id % 4 = 2 AND turn > 0
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events),
frames AS (
  SELECT user_id AS audio_id, frame, event_type AS spk,
    least(1.0::DOUBLE, (abs((frame * 23 + user_id * 11) % 200 - 100) * 9 + (event_id * 7919) % 100) / 1000.0::DOUBLE) AS p, event_id, ts, value
  FROM numbered
)
"""


def on_base(sql: str) -> str:
    """SQL that may name the tables of this module; it may begin with WITH."""
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {PRELUDE}, {sql[15:]}"
    if sql.upper().startswith("WITH "):
        return f"WITH {PRELUDE}, {sql[5:]}"
    return f"WITH {PRELUDE} {sql}"


def base_query(name: str, sql: str | None = None):
    """Register a query whose SQL twin reads the tables of this module."""
    return query(name, on_base(sql) if sql else None)
