"""Queries on sources, sinks, projections, filters and joins of the transcript store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import scratch
from lectern.functions import text, times
from lectern.operators import joins
from lectern.session import table
from lectern.sources import exports, readers

from .base import base_query, card_sources, cards, frames, results, speakers
from .registry import query


# --- sources ----------------------------------------------------------------------------------------------------


@query("src_parquet_text_column", "SELECT text FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return readers.shards(spark, f"{d}/documents.parquet", ["text"], "*.parquet")


@query("src_list_shards", "SELECT doc_id % 4 AS pos, 'train-0000' || (doc_id % 4) || '-of-00003.parquet' AS name, count(*) AS n FROM documents WHERE doc_id % 4 < 3 GROUP BY ALL")
def _(spark, d):
    """Four files, of which three are of the training split; rows of those that the listing names."""
    at = scratch.new_path(spark)
    for k in range(4):
        part = table(spark, d, "documents").where(F.col("doc_id") % 4 == k).select("doc_id")
        name = f"train-0000{k}-of-00003.parquet" if k < 3 else "validation-00000-of-00001.parquet"
        exports.single_file(part, at, name)
    rows = readers.shards(spark, at, ["doc_id", "_metadata.file_name"]).groupBy(F.col("file_name").alias("name")).agg(F.count("*").alias("n"))
    return readers.file_names(spark, at).join(rows, "name").select(F.col("pos").cast("long").alias("pos"), "name", "n")


@query("src_dataset_rows", "SELECT doc_id, lang FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang")


@query("src_text_lines", "SELECT doc_id, line FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> ''")
def _(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", F.trim("line").alias("line")).where("line <> ''")


@base_query("src_segments_json", "SELECT audio_id, turn, start_time AS start_s, end_time AS end_s, CASE WHEN speaker_id <> 3 THEN 'speaker_' || (speaker_id - 1) ELSE 'speaker_0' END AS speaker FROM results")
def _(spark, d):
    r = results(spark, d)
    one = F.struct(F.col("start_time").alias("start"), F.col("end_time").alias("end"), F.when(F.col("speaker_id") != 3, text.speaker_tag(F.col("speaker_id"))).alias("speaker"))
    j = r.select("audio_id", "turn", F.to_json(one).alias("j"))
    s = j.select("audio_id", "turn", F.from_json("j", "start double, end double, speaker string").alias("s"))
    return s.select("audio_id", "turn", F.col("s.start").alias("start_s"), F.col("s.end").alias("end_s"), F.coalesce("s.speaker", F.lit("speaker_0")).alias("speaker"))


@query("src_vocab_txt", "SELECT replace(p_name, '▁', ' ') || ' ' || p_brand AS piece, p_partkey::INT AS id FROM part")
def _(spark, d):
    lines = table(spark, d, "part").select(F.concat_ws(" ", F.replace("p_name", F.lit(" "), F.lit("▁")), "p_brand", F.col("p_partkey").cast("string")).alias("line"))
    return readers.vocabulary(lines)


@query("src_vocab_flat", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, p_name AS piece FROM part")
def _(spark, d):
    one = table(spark, d, "part").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("v"))
    return one.select(F.posexplode("v").alias("id", "x")).select(F.col("id").cast("long").alias("id"), F.col("x.p_name").alias("piece"))


@query("src_lang_spans", "SELECT lang, min(doc_id) AS start, max(doc_id) - min(doc_id) + 1 AS length FROM documents GROUP BY lang")
def _(spark, d):
    g = table(spark, d, "documents").groupBy("lang").agg(F.min("doc_id").alias("start"), (F.max("doc_id") - F.min("doc_id") + 1).alias("length"))
    j = g.select(F.to_json(F.create_map("lang", F.struct("start", "length"))).alias("j"))
    return j.select(F.explode(F.from_json("j", "map<string,struct<start:bigint,length:bigint>>")).alias("lang", "s")).select("lang", "s.start", "s.length")


@query("src_lang_map", "SELECT i AS idx FROM range(0, 107) t(i) WHERE i NOT IN (SELECT n_nationkey FROM nation)")
def _(spark, d):
    have = table(spark, d, "nation").select(F.to_json(F.create_map(F.col("n_nationkey").cast("string"), F.struct(F.col("n_name").alias("name")))).alias("j"))
    have = have.select(F.explode(F.from_json("j", "map<string,struct<name:string>>")).alias("k", "v")).select(F.col("k").cast("long").alias("idx"))
    return spark.range(107).withColumnRenamed("id", "idx").join(have, "idx", "left_anti")


@query("src_manifest", "SELECT lower(url) AS path, md5(html) AS md5 FROM pages")
def _(spark, d):
    j = table(spark, d, "pages").select(F.to_json(F.create_map("url", F.md5(F.col("html").cast("binary")))).alias("j"))
    return j.select(F.explode(F.from_json("j", "map<string,string>")).alias("path", "md5")).select(F.lower("path").alias("path"), "md5")


@query("src_transcript_md", "SELECT item_id, array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '#')), lambda x: trim(x)), ' ') AS text FROM benchmark")
def _(spark, d):
    b = table(spark, d, "benchmark").withColumn("md", F.concat(F.lit("﻿# title\n\n"), "text"))
    return b.select("item_id", readers.markdown_transcript(F.col("md")).alias("text"))


@query("src_gazetteer", "SELECT DISTINCT p_type AS cls, p_name AS term FROM part")
def _(spark, d):
    j = table(spark, d, "part").groupBy("p_type").agg(F.array_sort(F.collect_set("p_name")).alias("t")).select(F.to_json(F.create_map("p_type", "t")).alias("j"))
    return j.select(F.explode(F.from_json("j", "map<string,array<string>>")).alias("cls", "t")).select("cls", F.explode("t").alias("term"))


@query("src_resolve_stream", "SELECT l_orderkey, coalesce(max(CASE WHEN l_linenumber = 3 THEN l_linenumber END), min(l_linenumber))::BIGINT AS stream FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    pick = F.coalesce(F.max(F.when(F.col("l_linenumber") == 3, F.col("l_linenumber"))), F.min("l_linenumber"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(pick.cast("long").alias("stream"))


@query("src_sqlite_results", "SELECT conv_id || '.db' AS path, turn, role, text FROM conversations")
def _(spark, d):
    """A store for each recording, written as a file and opened again."""
    files = exports.sqlite_files(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "results", ["turn", "role", "text"])
    return readers.sqlite_table(files, "results", "turn long, role string, text string")


@query("src_audio_stream_rule", "SELECT page_id, regexp_extract(url, '\\.([a-z0-9]+)$', 1) AS ext, regexp_extract(url, '\\.([a-z0-9]+)$', 1) IN ('mp4','mkv','webm','mov','avi','mp3','m4a','flac','ogg') AS uses_decoder FROM pages")
def _(spark, d):
    ext = F.regexp_extract("url", r"\.([a-z0-9]+)$", 1)
    return table(spark, d, "pages").select("page_id", ext.alias("ext"), ext.isin("mp4", "mkv", "webm", "mov", "avi", "mp3", "m4a", "flac", "ogg").alias("uses_decoder"))


# --- the overlay read and its exports ---------------------------------------------------------------------------


def transcript(spark: SparkSession, d: str) -> DataFrame:
    """Cards that aren't suppressed, with their speaker and what they show: audio_id, id, speaker, start, end, text."""
    c, s, k, r = cards(spark, d), speakers(spark, d), card_sources(spark, d), results(spark, d)
    j = c.where(~F.col("suppressed")).join(F.broadcast(s), "speaker_id").join(k.where("source_order = 0"), "card_id").join(r.select("result_id", "asr_content"), "result_id")
    shown = F.coalesce("content", F.coalesce("asr_content", F.lit("")))
    return j.select("audio_id", F.col("card_id").alias("id"), F.col("name").alias("speaker"), F.col("play_start").alias("start"), F.col("play_end").alias("end"), shown.alias("text"))


SHOWN = """transcript AS (
  SELECT c.audio_id, c.card_id AS id, s.name AS speaker, c.play_start AS st, c.play_end AS en, coalesce(c.content, r.asr_content, '') AS text
  FROM cards c JOIN speakers s USING (speaker_id) JOIN card_sources k ON k.card_id = c.card_id AND k.source_order = 0 JOIN results r ON r.result_id = k.result_id
  WHERE NOT c.suppressed
)"""


def _hms(c: str) -> str:
    rest = f"printf('%05.2f', {c} - floor({c} / 60) * 60)"
    return f"CASE WHEN {c} >= 3600 THEN printf('%d:%02d:', floor({c} / 3600)::BIGINT, floor({c} / 60)::BIGINT % 60) || {rest} ELSE printf('%02d:', floor({c} / 60)::BIGINT % 60) || {rest} END"


def _hhmmss(c: str, wrap: bool = True) -> str:
    h = f"floor({c} / 3600)::BIGINT" + (" % 24" if wrap else "")
    return f"printf('%02d:%02d:%02d', {h}, floor({c} / 60)::BIGINT % 60, floor({c})::BIGINT % 60)"


def _srt(c: str) -> str:
    ms = f"round_even({c} * 1000, 0)::BIGINT"
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


@base_query("export_transcript", f"WITH {SHOWN} SELECT audio_id, id, speaker, {_hms('st')} AS start_text, {_hms('en')} AS end_text, text FROM transcript")
def _(spark, d):
    t = transcript(spark, d)
    return t.select("audio_id", "id", "speaker", times.hms(F.col("start")).alias("start_text"), times.hms(F.col("end")).alias("end_text"), "text").orderBy("audio_id", "start_text", "id")


@base_query("snk_csv", f"WITH {SHOWN}, f AS (SELECT id, speaker, {_hms('st')} AS a, {_hms('en')} AS b, CASE WHEN regexp_matches(text, '[,\"\\n\\r]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END AS t FROM transcript) SELECT id, speaker || ',' || a || ',' || b || ',' || t AS line FROM f")
def _(spark, d):
    t = transcript(spark, d)
    return t.select("id", exports.csv_line(t).alias("line"))


@base_query("snk_json", f"WITH {SHOWN} SELECT id, speaker, {_hms('st')} AS a, {_hms('en')} AS b, text FROM transcript")
def _(spark, d):
    t = transcript(spark, d).select("id", exports.json_record().alias("j"))
    return t.select("id", F.get_json_object("j", "$.speaker").alias("speaker"), F.get_json_object("j", "$.start").alias("a"), F.get_json_object("j", "$.end").alias("b"), F.get_json_object("j", "$.content").alias("text"))


@base_query("snk_json_cli", f"WITH {SHOWN} SELECT id, round_even(st, 3) AS a, round_even(en, 3) AS b, text FROM transcript")
def _(spark, d):
    t = transcript(spark, d).select("id", exports.json_record(False).alias("j"))
    return t.select("id", F.get_json_object("j", "$.start").cast("double").alias("a"), F.get_json_object("j", "$.end").cast("double").alias("b"), F.get_json_object("j", "$.text").alias("text"))


_N = "row_number() OVER (PARTITION BY audio_id ORDER BY st, id)"


@base_query("snk_srt", f"WITH {SHOWN} SELECT id, {_N} || chr(10) || {_srt('st')} || ' --> ' || {_srt('en')} || chr(10) || speaker || ': ' || text || chr(10) AS line FROM transcript")
def _(spark, d):
    return transcript(spark, d).select("id", exports.srt_cue(exports.cue_number("audio_id")).alias("line"))


@base_query("snk_srt_cli", f"WITH {SHOWN} SELECT id, {_N} || chr(10) || {_srt('st')} || ' --> ' || {_srt('en')} || chr(10) || '[' || speaker || '] ' || text || chr(10) AS line FROM transcript")
def _(spark, d):
    return transcript(spark, d).select("id", exports.srt_cue(exports.cue_number("audio_id"), bracket=True, wrap=True).alias("line"))


@base_query("snk_md", f"WITH {SHOWN} SELECT id, '**' || speaker || '** [' || {_hms('st')} || ' - ' || {_hms('en')} || ']' || chr(10) || chr(10) || text || chr(10) AS line FROM transcript")
def _(spark, d):
    return transcript(spark, d).select("id", exports.md_block().alias("line"))


@base_query("snk_md_cli", f"WITH {SHOWN} SELECT id, '## [' || speaker || '] [' || {_hhmmss('st')} || ' - ' || {_hhmmss('en')} || ']' || chr(10) || chr(10) || text || chr(10) AS line FROM transcript")
def _(spark, d):
    return transcript(spark, d).select("id", exports.md_block(False).alias("line"))


@base_query("snk_txt_cli", f"WITH {SHOWN} SELECT id, '[' || speaker || '] ' || {_hhmmss('st')} || ' - ' || {_hhmmss('en')} || chr(10) || text || chr(10) AS line FROM transcript")
def _(spark, d):
    return transcript(spark, d).select("id", exports.txt_block().alias("line"))


@query("snk_autoincrement_path", "WITH t AS (SELECT n_regionkey, n_nationkey - 1 AS n FROM nation) SELECT r.n_regionkey, min(i) AS free FROM (SELECT DISTINCT n_regionkey FROM t) r, range(0, 100) g(i) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.n_regionkey = r.n_regionkey AND t.n = i) GROUP BY r.n_regionkey")
def _(spark, d):
    t = table(spark, d, "nation").select("n_regionkey", (F.col("n_nationkey") - 1).cast("long").alias("i"))
    every = t.select("n_regionkey").distinct().withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long"))))
    return every.join(t, ["n_regionkey", "i"], "left_anti").groupBy("n_regionkey").agg(F.min("i").alias("free"))


@query("snk_corpus", "SELECT line, count(*) AS n FROM (SELECT trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents) WHERE line <> '' GROUP BY line")
def _(spark, d):
    """Written packed, a line a row, and read back."""
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line")).select(F.trim("line").alias("line")).where("line <> ''")
    at = scratch.new_path(spark)
    exports.corpus(lines, at)
    return readers.text_lines(spark, at).groupBy("line").agg(F.count("*").alias("n"))


@query("snk_bench_csv", "SELECT event_type || ',' || count(*) || ',' || printf('%.2f', max(value)) AS line FROM events GROUP BY event_type")
def _(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("m"))
    return g.select(F.concat_ws(",", "event_type", "n", F.format_string("%.2f", "m")).alias("line"))


@query("snk_metadata_kv", "SELECT event_type AS key, arg_max(value, event_id) AS value FROM events WHERE event_id % 10 <> 0 GROUP BY event_type")
def _(spark, d):
    """The last value written for a key; every tenth event deletes nothing and is left out."""
    return table(spark, d, "events").where("event_id % 10 <> 0").groupBy(F.col("event_type").alias("key")).agg(F.max_by("value", "event_id").alias("value"))


@base_query("snk_db_copy", "SELECT card_id, result_id, start_time FROM card_sources JOIN results USING (result_id)")
def _(spark, d):
    """Two tables copied, over a copy that is there, and read from the copy."""
    at = scratch.new_path(spark)
    exports.copy_tables({"results": results(spark, d).limit(0), "card_sources": card_sources(spark, d).limit(0)}, at)
    exports.copy_tables({"results": results(spark, d), "card_sources": card_sources(spark, d)}, at)
    return table(spark, at, "card_sources").join(table(spark, at, "results"), "result_id").select("card_id", "result_id", "start_time")


# --- filters and projections ------------------------------------------------------------------------------------


@base_query("flt_not_suppressed", "SELECT card_id FROM cards WHERE NOT suppressed")
def _(spark, d):
    return cards(spark, d).where(~F.col("suppressed")).select("card_id")


@base_query("flt_unfilled", "SELECT result_id FROM results WHERE tokens IS NULL")
def _(spark, d):
    return results(spark, d).where("tokens is null").select("result_id").orderBy("result_id")


@base_query("flt_unfilled_done", "SELECT audio_id, count(*) > 0 AND count(*) FILTER (WHERE tokens IS NULL) = 0 AS done FROM results GROUP BY audio_id")
def _(spark, d):
    return results(spark, d).groupBy("audio_id").agg(((F.count("*") > 0) & (F.count_if(F.col("tokens").isNull()) == 0)).alias("done"))


@base_query("flt_in_list", "SELECT result_id, audio_id FROM results WHERE result_id IN (1, 1000, 2001, 5002, 999999)")
def _(spark, d):
    return results(spark, d).where(F.col("result_id").isin(1, 1000, 2001, 5002, 999999)).select("result_id", "audio_id")


@query("flt_metadata_get", "SELECT event_type AS key, min_by(value, event_id) AS value FROM events GROUP BY event_type")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("key")).agg(F.min_by("value", "event_id").alias("value"))


@base_query("prj_speaker_tag", "SELECT result_id, 'speaker_' || (speaker_id - 1) AS tag FROM results")
def _(spark, d):
    return results(spark, d).select("result_id", text.speaker_tag(F.col("speaker_id")).alias("tag"))


@base_query("prj_display_content", "SELECT c.card_id, coalesce(c.content, coalesce(r.asr_content, '')) AS shown FROM cards c JOIN results r ON r.result_id = c.card_id")
def _(spark, d):
    return cards(spark, d).join(results(spark, d).select(F.col("result_id").alias("card_id"), "asr_content"), "card_id").select("card_id", F.coalesce("content", "asr_content", F.lit("")).alias("shown"))


@base_query("prj_override_content", "SELECT c.card_id, CASE WHEN replace(coalesce(c.content, r.asr_content), 'edited: T', 'T') <> coalesce(r.asr_content, '') THEN c.content END AS kept FROM cards c JOIN results r ON r.result_id = c.card_id")
def _(spark, d):
    j = cards(spark, d).join(results(spark, d).select(F.col("result_id").alias("card_id"), "asr_content"), "card_id")
    return j.select("card_id", F.when(F.replace(F.coalesce("content", "asr_content"), F.lit("edited: T"), F.lit("T")) != F.coalesce("asr_content", F.lit("")), F.col("content")).alias("kept"))


@base_query("flt_min_duration", "SELECT result_id FROM results WHERE end_time - start_time >= 2.5::DOUBLE")
def _(spark, d):
    return results(spark, d).where(F.col("end_time") - F.col("start_time") >= F.lit(2.5)).select("result_id")


@base_query("flt_midpoint", "SELECT result_id FROM results WHERE (start_time + end_time) / 2 BETWEEN 6::DOUBLE AND 22::DOUBLE")
def _(spark, d):
    return results(spark, d).where(((F.col("start_time") + F.col("end_time")) / 2).between(6.0, 22.0)).select("result_id")


@query("flt_nonblank_text", "SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND length(trim(text)) > 0")
def _(spark, d):
    return table(spark, d, "conversations").where(F.length(F.trim("text")) > 0).select("conv_id", "turn")


@base_query("flt_text_tokens", "SELECT result_id, array_to_string(list_filter(tokens, lambda x: x >= 4), ',') AS tok, round(list_sum(list_transform(list_filter(list_zip(tokens, logprobs), lambda z: z[1] >= 4), lambda z: z[2])), 6) AS lp FROM results WHERE tokens IS NOT NULL AND len(list_filter(tokens, lambda x: x >= 4)) > 0")
def _(spark, d):
    z = F.filter(F.arrays_zip("tokens", "logprobs"), lambda x: (x["tokens"] != 0) & (x["tokens"] >= 4))
    r = results(spark, d).where("tokens is not null").withColumn("z", z).where(F.size("z") > 0)
    total = F.aggregate("z", F.lit(0.0), lambda s, x: s + F.coalesce(x["logprobs"], F.lit(0.0)))
    return r.select("result_id", F.array_join(F.transform("z", lambda x: x["tokens"].cast("string")), ",").alias("tok"), F.round(total, 6).alias("lp"))


@base_query("flt_has_content", "SELECT card_id, content FROM cards WHERE content IS NOT NULL")
def _(spark, d):
    return cards(spark, d).where("content is not null").select("card_id", "content")


@base_query("flt_speech_frames_sil", "SELECT audio_id, frame FROM frames GROUP BY audio_id, frame HAVING sum(p) < 0.2::DOUBLE")
def _(spark, d):
    return frames(spark, d).groupBy("audio_id", "frame").agg(F.sum("p").alias("s")).where(F.col("s") < F.lit(0.2)).select("audio_id", "frame")


@base_query("prj_relative_to_absolute", "SELECT result_id, start_time + 12.5::DOUBLE AS a, end_time + 12.5::DOUBLE AS b FROM results")
def _(spark, d):
    return results(spark, d).select("result_id", (F.col("start_time") + 12.5).alias("a"), (F.col("end_time") + 12.5).alias("b"))


@base_query("prj_slice_bounds", "SELECT result_id, floor(greatest(0, start_time - 0.25::DOUBLE) * 100)::BIGINT AS lo, ceil(least(38::DOUBLE, end_time + 0.25::DOUBLE) * 100)::BIGINT AS hi FROM results")
def _(spark, d):
    return results(spark, d).select("result_id", F.floor(F.greatest(F.lit(0.0), F.col("start_time") - 0.25) * 100).alias("lo"), F.ceil(F.least(F.lit(38.0), F.col("end_time") + 0.25) * 100).alias("hi"))


@base_query("prj_sample_window", "SELECT result_id, a, greatest(b, a) AS b FROM (SELECT result_id, greatest(0, least(trunc(start_time * 16000)::BIGINT, 480000)) AS a, greatest(0, least(trunc(end_time * 16000)::BIGINT, 480000)) AS b FROM results)")
def _(spark, d):
    at = lambda c: F.greatest(F.lit(0), F.least((F.col(c) * 16000).cast("long"), F.lit(480000)))
    return results(spark, d).select("result_id", at("start_time").alias("a"), at("end_time").alias("b")).select("result_id", "a", F.greatest("b", "a").alias("b"))


@base_query("prj_centered_clip", "SELECT result_id, len, CASE WHEN len > 30000 THEN (len - 30000) // 2 ELSE 0 END AS off, least(len, 30000) AS n FROM (SELECT result_id, round_even((end_time - start_time) * 16000, 0)::BIGINT AS len FROM results)")
def _(spark, d):
    n = F.bround((F.col("end_time") - F.col("start_time")) * 16000).cast("long")
    return results(spark, d).select("result_id", n.alias("len")).select("result_id", "len", F.when(F.col("len") > 30000, F.expr("(len - 30000) div 2")).otherwise(F.lit(0)).cast("long").alias("off"), F.least("len", F.lit(30000)).cast("long").alias("n"))


@base_query("prj_token_cap", "SELECT result_id, least(8192, trunc((end_time - start_time) * 40)::BIGINT + 150) AS cap FROM results")
def _(spark, d):
    return results(spark, d).select("result_id", F.least(F.lit(8192), ((F.col("end_time") - F.col("start_time")) * 40).cast("long") + 150).alias("cap"))


@query("prj_status_parse", "SELECT o_orderkey, CASE upper(o_orderstatus) WHEN 'P' THEN 'Pending' WHEN 'F' THEN 'Failed' WHEN 'O' THEN 'Running' END AS status FROM orders")
def _(spark, d):
    full = F.create_map(*[F.lit(x) for x in ("p", "pending", "f", "failed", "o", "running")])
    return table(spark, d, "orders").select("o_orderkey", F.initcap(full[F.lower("o_orderstatus")]).alias("status"))


@query("prj_defaults", "SELECT doc_id, coalesce(nullif(CASE WHEN lang = 'en' THEN '' ELSE lang END, ''), 'auto') AS lang FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.nullif(F.when(F.col("lang") == "en", "").otherwise(F.col("lang")), F.lit("")), F.lit("auto")).alias("lang"))


# --- joins ------------------------------------------------------------------------------------------------------


@base_query("join_inner_view", "SELECT r.result_id, s.name, r.start_time, r.end_time FROM results r JOIN speakers s USING (speaker_id)")
def _(spark, d):
    return results(spark, d).join(F.broadcast(speakers(spark, d)), "speaker_id").select("result_id", "name", "start_time", "end_time")


@base_query("join_cards_4way", "SELECT c.card_id, s.name, k.source_order, r.result_id, c.play_start FROM cards c JOIN speakers s USING (speaker_id) JOIN card_sources k USING (card_id) JOIN results r USING (result_id)")
def _(spark, d):
    j = cards(spark, d).join(F.broadcast(speakers(spark, d)), "speaker_id").join(card_sources(spark, d), "card_id").join(results(spark, d).select("result_id"), "result_id")
    return j.select("card_id", "name", "source_order", "result_id", "play_start").orderBy("play_start", "card_id", "source_order")


@base_query("join_primary_source", f"WITH {SHOWN} SELECT id, speaker, text FROM transcript")
def _(spark, d):
    return transcript(spark, d).select("id", "speaker", "text")


def _diarized(spark, d):
    """A second segmentation of the recordings: shifted and longer segments."""
    r = results(spark, d).where("turn % 2 = 0")
    return r.select("audio_id", F.col("result_id").alias("seg_id"), (F.col("start_time") - 2.0).alias("start"), (F.col("end_time") + 1.5).alias("end"))


def _asr(spark, d):
    return results(spark, d).select("audio_id", "result_id", F.col("start_time").alias("start"), F.col("end_time").alias("end"))


_DIAR = "diar AS (SELECT audio_id, result_id AS seg_id, start_time - 2.0::DOUBLE AS st, end_time + 1.5::DOUBLE AS en FROM results WHERE turn % 2 = 0)"
_OVER = f"{_DIAR}, over AS (SELECT r.audio_id, r.result_id, x.seg_id, least(r.end_time, x.en) - greatest(r.start_time, x.st) AS o FROM results r JOIN diar x ON x.audio_id = r.audio_id AND x.st < r.end_time AND r.start_time < x.en), best AS (SELECT *, row_number() OVER (PARTITION BY audio_id, result_id ORDER BY o DESC, seg_id) AS rn FROM over WHERE o > 0)"


@base_query("join_max_overlap", f"WITH {_OVER} SELECT audio_id, result_id, seg_id, round(o, 6) AS overlap FROM best WHERE rn = 1")
def _(spark, d):
    return joins.max_overlap(_asr(spark, d), _diarized(spark, d), "audio_id", "result_id", "seg_id").withColumn("overlap", F.round("overlap", 6))


@base_query("join_nearest_midpoint", f"WITH {_OVER}, rest AS (SELECT r.* FROM results r WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.result_id = r.result_id)), near AS (SELECT r.audio_id, r.result_id, x.seg_id, abs((r.start_time + r.end_time) / 2 - (x.st + x.en) / 2) AS dist, row_number() OVER (PARTITION BY r.result_id ORDER BY abs((r.start_time + r.end_time) / 2 - (x.st + x.en) / 2), x.seg_id) AS rn FROM rest r JOIN diar x ON x.audio_id = r.audio_id) SELECT audio_id, result_id, seg_id, 'overlap' AS how FROM best WHERE rn = 1 UNION ALL SELECT audio_id, result_id, seg_id, 'nearest' FROM near WHERE rn = 1")
def _(spark, d):
    return joins.assign_speakers(_asr(spark, d), _diarized(spark, d), "audio_id", "result_id", "seg_id")


@base_query("join_point_in_interval", "WITH pts AS (SELECT user_id AS audio_id, event_id, value / 8 AS t FROM events), segs AS (SELECT audio_id, result_id AS seg_id, start_time AS st, end_time AS en FROM results), a AS (SELECT p.audio_id, p.event_id, s.seg_id, CASE WHEN s.st <= p.t AND p.t < s.en THEN 0 WHEN s.st > p.t THEN 1 ELSE 2 END AS k, s.st FROM pts p JOIN segs s USING (audio_id)), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY k, CASE WHEN k = 2 THEN -st ELSE st END, seg_id) AS rn FROM a) SELECT audio_id, event_id, seg_id, ['inside', 'next', 'last'][k + 1] AS how FROM r WHERE rn = 1")
def _(spark, d):
    pts = table(spark, d, "events").select(F.col("user_id").alias("audio_id"), "event_id", (F.col("value") / 8).alias("t"))
    segs = _asr(spark, d).withColumnRenamed("result_id", "seg_id")
    return joins.segment_at(pts, segs, "audio_id", "event_id", "t", "seg_id")


@base_query("join_asof_token", "SELECT result_id, coalesce(list_position(list_transform(timestamps, lambda x: x * 0.08::DOUBLE > 1.7::DOUBLE), true), len(timestamps) + 1)::BIGINT - 2 AS pos FROM results")
def _(spark, d):
    return results(spark, d).select("result_id", joins.token_at(F.lit(1.7), F.col("timestamps")).cast("long").alias("pos"))


@base_query("join_vocab_decode", "WITH t AS (SELECT result_id, unnest(tokens) AS id, generate_subscripts(tokens, 1) AS pos FROM results) SELECT result_id, string_agg(n_name, '' ORDER BY pos) AS text FROM t JOIN nation ON n_nationkey = id GROUP BY result_id")
def _(spark, d):
    vocab = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("piece"))
    return joins.decode_tokens(results(spark, d), ["result_id"], "tokens", F.broadcast(vocab))


@base_query("join_local_global", "SELECT f.audio_id, f.frame, n.n_nationkey AS global_spk FROM frames f JOIN nation n ON n.n_regionkey = f.audio_id % 5 AND n.n_nationkey % 5 = f.frame % 5")
def _(spark, d):
    m = table(spark, d, "nation").select((F.col("n_regionkey")).alias("chunk"), (F.col("n_nationkey") % 5).alias("local"), F.col("n_nationkey").alias("global_spk"))
    f = frames(spark, d).withColumn("chunk", F.col("audio_id") % 5).withColumn("local", F.col("frame") % 5)
    return f.join(F.broadcast(m), ["chunk", "local"]).select("audio_id", "frame", "global_spk")


@query("join_manifest_outdated", "SELECT p.page_id FROM pages p JOIN (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN upper(md5(html)) ELSE md5(url) END AS h FROM pages) m USING (page_id) WHERE lower(m.h) <> lower(md5(p.html))")
def _(spark, d):
    p = table(spark, d, "pages")
    m = p.select("page_id", F.when(F.col("page_id") % 3 == 0, F.upper(F.md5(F.col("html").cast("binary")))).otherwise(F.md5(F.col("url").cast("binary"))).alias("h"))
    return p.select("page_id", F.md5(F.col("html").cast("binary")).alias("have")).join(m, "page_id").where(F.lower("h") != F.lower("have")).select("page_id")


@query("antijoin_missing_files", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("semijoin_present_files", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("antijoin_missing_keys", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti").orderBy("doc_id")


@query("asof_anchor_key", "WITH k AS (SELECT d.source, d.doc_id, l.doc_id AS present FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT doc_id, last_value(present IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM k")
def _(spark, d):
    k = table(spark, d, "documents").select("source", "doc_id").join(table(spark, d, "labels").select("doc_id", F.col("doc_id").alias("present")), "doc_id", "left")
    return joins.preceding(k, ["source"], ["doc_id"], F.col("present"), "anchor").select("doc_id", "anchor")


@base_query("antijoin_orphans", "SELECT result_id FROM results WHERE result_id NOT IN (SELECT result_id FROM card_sources WHERE source_order = 1)")
def _(spark, d):
    return results(spark, d).select("result_id").join(card_sources(spark, d).where("source_order = 1"), "result_id", "left_anti")


@query("join_ref_hyp", "SELECT b.item_id, coalesce(d1.doc_id, d2.doc_id) AS hyp FROM benchmark b LEFT JOIN documents d1 ON d1.doc_id = b.item_id * 10 AND d1.lang = 'en' LEFT JOIN documents d2 ON d2.doc_id = b.item_id WHERE coalesce(d1.doc_id, d2.doc_id) IS NOT NULL")
def _(spark, d):
    b, docs = table(spark, d, "benchmark").select("item_id"), table(spark, d, "documents").select("doc_id", "lang")
    one = docs.where("lang = 'en'").select(F.col("doc_id").alias("a"))
    j = b.join(one, F.col("a") == F.col("item_id") * 10, "left").join(docs.select(F.col("doc_id").alias("b")), F.col("b") == F.col("item_id"), "left")
    return j.select("item_id", F.coalesce("a", "b").alias("hyp")).where("hyp is not null")


@query("join_backend_support", "SELECT d.doc_id, min_by(b.backend, b.rnk) AS best FROM documents d JOIN (VALUES ('alpha', 1, 'de'), ('alpha', 1, 'fr'), ('beta', 2, 'en'), ('beta', 2, 'fr'), ('gamma', 3, 'en'), ('gamma', 3, 'es')) b(backend, rnk, iso) ON b.iso = d.lang GROUP BY d.doc_id")
def _(spark, d):
    dim = spark.sql("SELECT * FROM VALUES ('alpha', 1, 'de'), ('alpha', 1, 'fr'), ('beta', 2, 'en'), ('beta', 2, 'fr'), ('gamma', 3, 'en'), ('gamma', 3, 'es') AS t(backend, rnk, iso)")
    return table(spark, d, "documents").join(F.broadcast(dim), F.col("iso") == F.col("lang")).groupBy("doc_id").agg(F.min_by("backend", "rnk").alias("best"))


@base_query("join_positional_zip", "SELECT c.card_id, s.name FROM cards c JOIN speakers s USING (speaker_id) JOIN results r ON r.result_id = c.card_id")
def _(spark, d):
    return cards(spark, d).join(F.broadcast(speakers(spark, d)), "speaker_id").join(results(spark, d).select(F.col("result_id").alias("card_id")), "card_id").select("card_id", "name")
