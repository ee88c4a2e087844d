"""Queries on scalar functions: texts, times, vectors, JSON."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text, times, vectors
from lectern.session import table
from lectern.sources import exports

from .base import base_query, frames, results, speaker_frames
from .registry import query

_DOC = lambda spark, d: table(spark, d, "documents")
_SQ = "trim(regexp_replace({0}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


@query("sc_gigaspeech_norm", "WITH t AS (SELECT conv_id, turn, list_filter(string_split_regex(trim(replace(replace(text, ',', ' <COMMA>'), '.', ' <PERIOD>')), '\\s+'), lambda w: w <> '') AS w FROM conversations), s AS (SELECT conv_id, turn, regexp_replace(array_to_string(list_transform(w, lambda x: CASE WHEN x = '<COMMA>' THEN ',' WHEN x = '<PERIOD>' THEN '.' WHEN regexp_matches(x, '^<.*>$') THEN '' ELSE ' ' || lower(x) END), ''), '^[,.?!]+', '') AS s FROM t) SELECT conv_id, turn, CASE WHEN length(trim(s)) > 0 THEN upper(substr(trim(s), 1, 1)) || substr(trim(s), 2) END AS line FROM s")
def _(spark, d):
    c = table(spark, d, "conversations").withColumn("t", F.replace(F.replace("text", F.lit(","), F.lit(" <COMMA>")), F.lit("."), F.lit(" <PERIOD>")))
    return c.select("conv_id", "turn", text.tagged_norm(F.col("t")).alias("line"))


@query("sc_peoples_norm", "SELECT doc_id, upper(substr(trim(lower(text)), 1, 1)) || substr(trim(lower(text)), 2) AS line FROM documents")
def _(spark, d):
    return _DOC(spark, d).select("doc_id", text.peoples_norm(text.lowered(F.col("text"))).alias("line"))


@query("sc_sentence_split", f"WITH p AS (SELECT doc_id, {_SQ.format('unnest(string_split_regex(text, chr(10) || chr(92) || chr(115) || chr(42) || chr(10)))')} AS p FROM documents), s AS (SELECT doc_id, unnest(string_split(regexp_replace(p, '([.!?]) ([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS s FROM p) SELECT doc_id, trim(s) AS sentence, count(*) AS n FROM s WHERE length(trim(s)) > 0 GROUP BY ALL")
def _(spark, d):
    s = _DOC(spark, d).select("doc_id", F.explode(text.sentences(F.col("text"))).alias("sentence"))
    return s.groupBy("doc_id", "sentence").agg(F.count("*").alias("n"))


_PHARMA = "list_filter(list_transform(flatten(list_transform(string_split(regexp_replace(regexp_replace(text, '\\n[ \\t\\n\\r\\f]*\\n', chr(1), 'g'), '\\n([A-Z][a-z])', chr(1) || '\\1', 'g'), chr(1)), lambda p: string_split(regexp_replace(trim(regexp_replace(p, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' '), '([.!?]) ([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)))), lambda s: trim(regexp_replace(s, '^[0-9]+(\\.[0-9]+)*[ ]+', ''), ' ')), lambda s: length(s) >= 10)"


@query("sc_sentence_split_pharma", f"SELECT doc_id, generate_subscripts(l, 1)::INT - 1 AS pos, unnest(l) AS sentence FROM (SELECT doc_id, {_PHARMA} AS l FROM documents)")
def _(spark, d):
    return _DOC(spark, d).select("doc_id", F.posexplode(text.sentences_in_lines(F.col("text"))).alias("pos", "sentence"))


@query("sc_clean_ws", f"SELECT doc_id, regexp_replace({_SQ.format('text')}, '^[,;: ]+', '') AS line FROM documents")
def _(spark, d):
    return _DOC(spark, d).select("doc_id", text.clean_ws(F.col("text")).alias("line"))


@query("sc_title_abstract", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN coalesce(lang, '') WHEN doc_id % 4 = 1 THEN source ELSE source || '. ' || lang END AS line FROM documents")
def _(spark, d):
    title = F.when(F.col("doc_id") % 4 != 0, F.col("source")).otherwise("  ")
    content = F.when(F.col("doc_id") % 4 != 1, F.col("lang"))
    return _DOC(spark, d).select("doc_id", text.title_abstract(title, content).alias("line"))


@query("sc_strip_speaker", "WITH l AS (SELECT conv_id, turn, unnest(string_split(replace(CASE WHEN role = 'user' THEN 'Patient: ' ELSE 'DOCTOR:  ' END || text, '\\n', chr(10)), chr(10))) AS x FROM conversations) SELECT conv_id, turn, trim(regexp_replace(x, '^\\s*(DOCTOR|PATIENT):\\s*', '', 'i'), ' ') AS line FROM l WHERE length(trim(regexp_replace(x, '^\\s*(DOCTOR|PATIENT):\\s*', '', 'i'), ' ')) > 0")
def _(spark, d):
    c = table(spark, d, "conversations").withColumn("t", F.concat(F.when(F.col("role") == "user", "Patient: ").otherwise("DOCTOR:  "), "text", F.lit("\\n")))
    return c.select("conv_id", "turn", F.explode(text.turns_without_speakers(F.col("t"))).alias("line"))


@query("sc_template_fill", "SELECT p_partkey, 'take drops daily, ' || p_name AS line FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", text.template(F.concat(F.lit("take {drug} daily, "), "p_name"), {"drug": ["drops"]}, F.col("p_partkey")).alias("line"))


@query("sc_normalize_ref", f"SELECT item_id, {_SQ.format('text')} AS line FROM benchmark")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.normalised_reference(F.concat(F.lit("﻿"), "text")).alias("line"))


STOP = ("the", "of", "and", "to", "a", "in", "is", "that", "for", "it")


@query("sc_content_words", f"SELECT item_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda w: w NOT IN {STOP}), ' ') AS words FROM benchmark")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(text.content_words(F.col("text"), STOP), " ").alias("words"))


@query("sc_metadata_prefix", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN lang = 'en' THEN 'Old English' WHEN lang = 'de' THEN 'German' WHEN lang = 'fr' THEN 'English' ELSE 'Xyzzy' END AS name FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    """Known names, the longest first; a name that isn't known; and texts that say no language."""
    name = F.when(F.col("lang") == "en", "old english").when(F.col("lang") == "de", "German").when(F.col("lang") == "fr", "English").otherwise("Xyzzy")
    said = F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("The ")).otherwise(F.lit(" ")), F.lit("language "), name, F.lit(": "), F.col("text"))
    found = text.language_prefix(said, ["Old", "Old English", "English", "German"])
    return _DOC(spark, d).where("text is not null").select("doc_id", F.initcap(found).alias("name"))


@query("sc_script_fraction", "SELECT doc_id, round(len(regexp_extract_all(text, '[a-zA-Z]')) / length(regexp_replace(text, '[ \\t\\n\\r\\f\\v]', '', 'g'))::DOUBLE, 9) AS latin FROM documents")
def _(spark, d):
    return _DOC(spark, d).select("doc_id", F.round(text.script_fraction(F.col("text"), [(0x41, 0x5A), (0x61, 0x7A)]), 9).alias("latin"))


@query("sc_detok_sp", "SELECT conv_id, turn, trim(text) AS line FROM conversations")
def _(spark, d):
    pieces = F.transform(F.split("text", " "), lambda w: F.concat(F.lit("▁"), w))
    return table(spark, d, "conversations").select("conv_id", "turn", text.detokenised(pieces).alias("line"))


@query("sc_byte_fallback", "SELECT n_nationkey, n_name || 'é' AS line FROM nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", text.from_byte_pieces(F.array(F.concat(F.lit("▁"), "n_name"), F.lit("<0xC3>"), F.lit("<0xA9>"))).alias("line"))


@query("sc_bytelevel_bpe", "SELECT n_nationkey, ' ' || n_name AS line FROM nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", text.from_byte_level(F.concat(F.lit("Ġ"), "n_name")).alias("line"))


@base_query("sc_clip_runs", "SELECT result_id, least(list_sum(tokens), 60)::BIGINT AS total, list_last(list_filter(range(1, len(tokens) + 1), lambda i: coalesce(list_sum(tokens[1:i - 1]), 0) < 60))::BIGINT AS n_runs FROM results WHERE tokens IS NOT NULL AND list_sum(tokens) > 0 AND list_min(tokens) > 0")
def _(spark, d):
    r = results(spark, d).where("tokens is not null and array_min(tokens) > 0").withColumn("c", text.clip_runs(F.col("tokens"), F.lit(60)))
    return r.select("result_id", F.aggregate("c", F.lit(0), lambda a, b: a + b).cast("long").alias("total"), F.size(F.filter("c", lambda x: x > 0)).cast("long").alias("n_runs"))


@query("sc_text_split_ratio", "WITH t AS (SELECT conv_id, turn, text, floor(length(text) * 1 / 3.0::DOUBLE)::INT AS pos FROM conversations), h AS (SELECT *, substr(text, 1, pos) AS head FROM t), c AS (SELECT *, CASE WHEN contains(head, ' ') THEN length(head) - instr(reverse(head), ' ') + 1 ELSE pos END AS cut FROM h) SELECT conv_id, turn, trim(substr(text, 1, cut)) AS head, trim(substr(text, cut + 1)) AS tail FROM c")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.split_by_ratio(F.col("text"), F.lit(1), F.lit(3)).alias("s")).select("conv_id", "turn", "s.head", "s.tail")


@query("sc_iso_normalize", "SELECT doc_id, CASE WHEN lang = 'de' THEN 'he' WHEN lang = 'fr' THEN 'jv' ELSE lang END AS iso FROM documents")
def _(spark, d):
    c = F.when(F.col("lang") == "de", "IW").when(F.col("lang") == "fr", "jw").otherwise(F.upper("lang"))
    return _DOC(spark, d).select("doc_id", text.iso(c).alias("iso"))


@query("sc_csv_escape", "SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[,\"\\n\\r]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END AS field FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", exports.csv_field(F.col("text")).alias("field"))


@query("sc_sha256", "SELECT page_id, substr(sha256(html), 1, 16) || CASE WHEN page_id % 3 > 0 THEN '_s' || (page_id % 3) ELSE '' END AS name FROM pages")
def _(spark, d):
    h = F.substring(F.sha2(F.col("html").cast("binary"), 256), 1, 16)
    return table(spark, d, "pages").select("page_id", F.concat(h, F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("_s"), (F.col("page_id") % 3).cast("string"))).otherwise("")).alias("name"))


@query("sc_md5", "SELECT page_id, md5(html) AS md5 FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(F.col("html").cast("binary")).alias("md5"))


@query("sc_lid_summary", "SELECT p_partkey, CASE WHEN p_size < 25 THEN 'ambiguous: ' || p_name || ' (' || p_size || ' %), other (5 %)' ELSE p_name || ' (' || p_size || ' %)' END AS line FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", text.lid_summary(F.array("p_name", F.lit("other")), F.array(F.col("p_size") / F.lit(100.0), F.lit(0.05)), F.col("p_size") < 25).alias("line"))


@base_query("sc_json_map_tags", "WITH t AS (SELECT result_id, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS pos FROM results) SELECT result_id, arg_max(tok % 2 = 1, pos) FILTER (WHERE tok IN (2, 3)) AS pnc, arg_min(tok, pos) FILTER (WHERE tok > 5) AS lang FROM t GROUP BY result_id")
def _(spark, d):
    """The last flag wins, the first language wins."""
    t = results(spark, d).select("result_id", F.posexplode("tokens").alias("pos", "tok"))
    return t.groupBy("result_id").agg(F.max_by(F.col("tok") % 2 == 1, F.when(F.col("tok").isin(2, 3), F.col("pos"))).alias("pnc"), F.min_by("tok", F.when(F.col("tok") > 5, F.col("pos"))).alias("lang"))


@query("sc_language_match", "SELECT doc_id, lang = CASE doc_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE '??' END AS same FROM documents")
def _(spark, d):
    names = F.create_map(*[F.lit(x) for kv in {"english": "en", "french": "fr", "german": "de", "spanish": "es", "en": "en", "fr": "fr", "de": "de", "es": "es"}.items() for x in kv])
    other = F.when(F.col("doc_id") % 3 == 0, " English").when(F.col("doc_id") % 3 == 1, "French ").otherwise("??")
    a, b = F.lower(F.trim("lang")), F.lower(F.trim(other))
    return _DOC(spark, d).select("doc_id", ((a == b) | F.coalesce(names[a] == names[b], F.lit(False))).alias("same"))


@query("sc_lm_select", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN p_name ELSE CASE WHEN p_partkey % 2 = 0 THEN 'builtin' END END AS path FROM part")
def _(spark, d):
    kind, present = F.col("p_size") % 3, F.col("p_partkey") % 2 == 0
    return table(spark, d, "part").select("p_partkey", F.when(kind == 0, F.lit(None)).when(kind == 1, F.col("p_name")).when(present, "builtin").alias("path"))


# --- times ------------------------------------------------------------------------------------------------------


@query("sc_fmt_hms", "SELECT event_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:', floor(s / 3600)::BIGINT, floor(s / 60)::BIGINT % 60) ELSE printf('%02d:', floor(s / 60)::BIGINT % 60) END || printf('%05.2f', s - floor(s / 60) * 60) AS t FROM (SELECT event_id, value * 37 AS s FROM events)")
def _(spark, d):
    return table(spark, d, "events").select("event_id", times.hms(F.col("value") * 37).alias("t"))


@query("sc_fmt_hhmmss", "SELECT event_id, printf('%02d:%02d:%02d', s // 3600 % 24, s // 60 % 60, s % 60) AS t FROM (SELECT event_id, floor(value * 997)::BIGINT AS s FROM events)")
def _(spark, d):
    return table(spark, d, "events").select("event_id", times.hhmmss(F.col("value") * 997, wrap=True).alias("t"))


@query("sc_fmt_srt", "SELECT event_id, printf('%02d:%02d:%02d,%03d', s // 3600000, s // 60000 % 60, s // 1000 % 60, s % 1000) AS t FROM (SELECT event_id, round_even(value * 997 * 1000, 0)::BIGINT AS s FROM events)")
def _(spark, d):
    return table(spark, d, "events").select("event_id", times.srt(F.col("value") * 997).alias("t"))


@query("sc_fmt_hhmmss_round", "SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS t FROM (SELECT event_id, round_even(floor(value) + 0.5::DOUBLE, 0)::BIGINT AS s FROM events)")
def _(spark, d):
    return table(spark, d, "events").select("event_id", times.hhmmss_rounded(F.floor("value") + F.lit(0.5)).alias("t"))


@query("sc_parse_stamp", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS t FROM events")
def _(spark, d):
    raw = F.when(F.col("event_id") % 5 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy/MM/dd"))
    return table(spark, d, "events").select("event_id", F.date_format(times.stamp(raw), "yyyy-MM-dd HH:mm:ss").alias("t"))


@query("sc_fmt_range", "SELECT event_id, printf('%.3fs - %.3fs', value, value + 1.5::DOUBLE) AS t FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", times.span(F.col("value"), F.col("value") + 1.5).alias("t"))


@query("sc_round_even", "SELECT event_id, round_even(event_id / 2.0::DOUBLE, 0) AS even, round(event_id / 2.0::DOUBLE) AS away FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.bround(F.col("event_id") / F.lit(2.0)).alias("even"), F.round(F.col("event_id") / F.lit(2.0)).alias("away"))


# --- vectors and distributions ----------------------------------------------------------------------------------

_PAIR = "p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _pairs(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")


@query("ma_cosine", f"WITH {_PAIR} SELECT vec_id, round(list_cosine_similarity(x, y), 9) AS cos FROM p")
def _(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(vectors.cosine(F.col("x"), F.col("y")), 9).alias("cos"))


@query("ma_euclidean", f"WITH {_PAIR} SELECT vec_id, round(list_distance(x, y), 9) AS dist FROM p")
def _(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(vectors.euclidean(F.col("x"), F.col("y")), 9).alias("dist"))


@query("ma_l2norm", f"WITH {_PAIR} SELECT vec_id, round(x[3] / sqrt(list_inner_product(x, x)), 9) AS third FROM p")
def _(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(vectors.l2norm(F.col("x"))[2], 9).alias("third"))


_LAB = "l AS (SELECT doc_id, lang, n_chars / 1000.0::DOUBLE AS x FROM documents)"


@query("ma_softmax", f"WITH {_LAB} SELECT doc_id, round(exp(x - max(x) OVER w) / sum(exp(x - m)) OVER w, 12) AS q FROM (SELECT *, max(x) OVER (PARTITION BY lang) AS m FROM l) WINDOW w AS (PARTITION BY lang)")
def _(spark, d):
    x = _DOC(spark, d).select("doc_id", "lang", (F.col("n_chars") / F.lit(1000.0)).alias("x"))
    return x.select("doc_id", F.round(vectors.softmax(F.col("x"), ["lang"]), 12).alias("q"))


@base_query("ma_log_softmax", "WITH m AS (SELECT *, max(p) OVER (PARTITION BY audio_id) AS top FROM frames) SELECT audio_id, frame, round(p - top - ln(sum(exp(p - top)) OVER (PARTITION BY audio_id)), 9) AS q FROM m")
def _(spark, d):
    return frames(spark, d).select("audio_id", "frame", F.round(vectors.log_softmax(F.col("p"), ["audio_id"]), 9).alias("q"))


@base_query("ma_masked_log_softmax", "WITH k AS (SELECT * FROM frames WHERE spk IN ('view', 'click')), m AS (SELECT *, max(p) OVER (PARTITION BY audio_id) AS top FROM k) SELECT audio_id, frame, round(p - top - ln(sum(exp(p - top)) OVER (PARTITION BY audio_id)), 9) AS q FROM m")
def _(spark, d):
    k = frames(spark, d).where(F.col("spk").isin("view", "click"))
    return k.select("audio_id", "frame", F.round(vectors.log_softmax(F.col("p"), ["audio_id"]), 9).alias("q"))


#: Whitening data by rule: means and maps of the two transforms, rows of small fractions.
_MEAN1, _MEAN2 = [((7 * i) % 11 - 5) / 100 for i in range(64)], [((5 * i) % 7 - 3) / 10 for i in range(32)]
_LDA = [[((i * 7 + k * 3) % 13 - 6) / 8 for i in range(64)] for k in range(32)]
_PLDA = [[((i * 5 + k * 11) % 17 - 8) / 8 for i in range(32)] for k in range(32)]
_SQL_LIST = lambda v: "[" + ", ".join(f"{x!r}::DOUBLE" for x in v) + "]"
_SQL_MAP = lambda v, rows: "[" + ", ".join(f"list_dot_product({v}, {_SQL_LIST(r)})" for r in rows) + "]"
_SQL_NORM = lambda v: f"list_transform({v}, lambda z: z / sqrt(list_dot_product({v}, {v})))"
_XVEC = f"""a AS (SELECT vec_id, list_transform(embedding, lambda z, i: z::DOUBLE - ({_SQL_LIST(_MEAN1)})[i]) AS c FROM embeddings), b AS (SELECT vec_id, {_SQL_NORM("c")} AS n FROM a),
m AS (SELECT vec_id, list_transform(n, lambda z: z * sqrt(64::DOUBLE)) AS n FROM b), l AS (SELECT vec_id, {_SQL_MAP("n", _LDA)} AS y FROM m), o AS (SELECT vec_id, list_transform(y, lambda z, i: z - ({_SQL_LIST(_MEAN2)})[i]) AS y FROM l), x AS (SELECT vec_id, list_transform({_SQL_NORM("y")}, lambda z: z * sqrt(32::DOUBLE)) AS y FROM o)"""


def _xvectors(spark, d, digits=None):
    return table(spark, d, "embeddings").select("vec_id", vectors.whitened(F.col("embedding"), _MEAN1, _LDA, _MEAN2, digits).alias("y"))


@query("ma_xvec_tf", f"WITH {_XVEC} SELECT vec_id, list_transform(y, lambda z: round(z, 6)) AS y FROM x")
def _(spark, d):
    return _xvectors(spark, d, 6).select("vec_id", F.transform("y", lambda z: vectors.rounded(z, 6)).alias("y"))


@query("ma_plda_tf", f"WITH {_XVEC}, c AS (SELECT vec_id, list_transform(y, lambda z, i: z - ({_SQL_LIST(_MEAN2)})[i]) AS c FROM x), p AS (SELECT vec_id, {_SQL_MAP('c', _PLDA)} AS y FROM c) SELECT vec_id, list_transform(y, lambda z: round(z, 6)) AS y FROM p")
def _(spark, d):
    return _xvectors(spark, d).select("vec_id", F.transform(vectors.projected(F.col("y"), _MEAN2, _PLDA), lambda z: vectors.rounded(z, 6)).alias("y"))


@query("ma_mel_slaney", "SELECT event_id, round(CASE WHEN f < 1000 THEN f * 3 / 200 ELSE 15 + ln(f / 1000) / (ln(6.4::DOUBLE) / 27) END, 9) AS mel FROM (SELECT event_id, value * 20 AS f FROM events)")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.round(vectors.mel_slaney(F.col("value") * 20), 9).alias("mel"))


@query("ma_mel_htk", "SELECT event_id, round(1127 * ln(1 + value / 700), 9) AS mel FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.round(vectors.mel_htk(F.col("value")), 9).alias("mel"))


@base_query("ma_preemphasis", "SELECT audio_id, frame, round(p - 0.97::DOUBLE * coalesce(lag(p) OVER (PARTITION BY audio_id ORDER BY frame), 0), 12) AS y FROM frames")
def _(spark, d):
    before = F.lag("p").over(Window.partitionBy("audio_id").orderBy("frame"))
    return frames(spark, d).select("audio_id", "frame", F.round(F.col("p") - 0.97 * F.coalesce(before, F.lit(0.0)), 12).alias("y"))


@base_query("ma_downmix", "SELECT audio_id, frame // 2 AS sample, round(avg(p), 12) AS x FROM frames GROUP BY ALL")
def _(spark, d):
    return frames(spark, d).groupBy("audio_id", F.floor(F.col("frame") / 2).alias("sample")).agg(F.round(F.avg("p"), 12).alias("x"))


_CLS = "c AS (SELECT a.r_regionkey AS a, b.r_regionkey AS b FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey), cls AS (SELECT '' AS members, 0 AS n UNION ALL SELECT r_regionkey::VARCHAR, 1 FROM region UNION ALL SELECT a || ',' || b, 2 FROM c)"


def _classes(spark, d):
    """The empty set, single speakers, pairs."""
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("a"))
    two = r.join(r.select(F.col("a").alias("b")), F.col("a") < F.col("b")).select(F.array("a", "b").alias("m"))
    return spark.sql("SELECT cast(array() AS array<int>) AS m").union(r.select(F.array("a"))).union(two)


@query("ma_powerset_combos", f"WITH {_CLS} SELECT row_number() OVER (ORDER BY n, members) - 1 AS cls, members FROM cls")
def _(spark, d):
    c = _classes(spark, d).select(F.size("m").alias("n"), F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("members"))
    return c.select((F.row_number().over(Window.orderBy("n", "members")) - 1).cast("long").alias("cls"), "members")


@base_query("ma_powerset_decode", "WITH s AS (SELECT audio_id, frame, spk, exp(p) AS e, abs(hash_free) AS h FROM (SELECT *, frame % 4 AS hash_free FROM frames)), t AS (SELECT audio_id, frame // 4 AS win, h AS speaker, e FROM s), n AS (SELECT audio_id, win, speaker, sum(e) AS e FROM t GROUP BY ALL) SELECT audio_id, win, speaker, e / sum(e) OVER (PARTITION BY audio_id, win) >= 0.3::DOUBLE AS active FROM n")
def _(spark, d):
    n = frames(spark, d).groupBy("audio_id", F.floor(F.col("frame") / 4).alias("win"), (F.col("frame") % 4).alias("speaker")).agg(F.sum(F.exp("p")).alias("e"))
    return n.select("audio_id", "win", "speaker", (F.col("e") / F.sum("e").over(Window.partitionBy("audio_id", "win")) >= 0.3).alias("active"))


@base_query("ma_quality_score", """WITH w AS (SELECT audio_id, frame, event_id, s, abs((frame * 23 + audio_id * 11 + s * 50) % 200 - 100) / 100.0::DOUBLE AS w FROM frames, range(0, 4) r(s)),
q AS (SELECT audio_id, frame, s, CASE WHEN event_id % 7 = 0 THEN 0.02::DOUBLE ELSE w * w END AS p FROM w),
t AS (SELECT *, sum(ln(greatest(1 - p, 0.25::DOUBLE))) OVER (PARTITION BY audio_id, frame) AS silent FROM q),
u AS (SELECT *, round(ln(greatest(p, 0.25::DOUBLE)) - ln(greatest(1 - p, 0.25::DOUBLE)) + silent - ln(sqrt(2::DOUBLE)), 9) AS score FROM t),
c AS (SELECT *, count(*) FILTER (WHERE score > 0) OVER (PARTITION BY audio_id, s) AS pos FROM u)
SELECT audio_id, frame, s AS spk, CASE WHEN p <= 0.5::DOUBLE OR (score <= 0 AND pos >= 3) THEN NULL ELSE score END AS score FROM c""")
def _(spark, d):
    """How telling every frame is of each of four speakers, given the silence of all of them."""
    q = speaker_frames(spark, d).select("audio_id", "frame", F.posexplode(F.arrays_zip(F.col("p").alias("p"), vectors.quality(F.col("p")).alias("score"))).alias("spk", "x"))
    q = q.select("audio_id", "frame", F.col("spk").cast("long").alias("spk"), F.col("x.p").alias("p"), F.round("x.score", 9).alias("score"))
    pos = F.count(F.when(F.col("score") > 0, 1)).over(Window.partitionBy("audio_id", "spk"))
    masked = (F.col("p") <= 0.5) | ((F.col("score") <= 0) & (F.col("pos") >= 3))
    return q.withColumn("pos", pos).select("audio_id", "frame", "spk", F.when(~masked, F.col("score")).alias("score"))


@base_query("ma_confidence_alpha", "SELECT audio_id, frame, round((1 - t * t) * 200, 6) AS alpha FROM (SELECT audio_id, frame, sqrt(greatest(0, least(1, (2 - 3 * p) / 2))) AS t FROM frames)")
def _(spark, d):
    return frames(spark, d).select("audio_id", "frame", F.round(vectors.confidence_alpha(-3 * F.col("p")), 6).alias("alpha"))


@base_query("ma_pad_list", "SELECT result_id, array_to_string(list_resize(tokens, 12, 0), ',') AS padded FROM results WHERE tokens IS NOT NULL")
def _(spark, d):
    r = results(spark, d).where("tokens is not null")
    return r.select("result_id", F.array_join(F.transform(vectors.pad_right(F.col("tokens"), F.lit(12), F.lit(0)), lambda x: x.cast("string")), ",").alias("padded"))


@base_query("ma_frame_mask_resample", "WITH m AS (SELECT audio_id, count(*) AS n FROM frames GROUP BY audio_id) SELECT m.audio_id, k.i AS feature, f.frame, f.p >= 0.5::DOUBLE AS masked FROM m, LATERAL (SELECT unnest(range(0, 2 * n + 3)) AS i) k JOIN frames f ON f.audio_id = m.audio_id AND f.frame = floor(k.i * m.n / (2 * m.n + 3)::DOUBLE)::BIGINT")
def _(spark, d):
    """Each feature frame reads the mask frame below it; there are a little over twice as many as mask frames."""
    f = frames(spark, d).select("audio_id", "frame", (F.col("p") >= 0.5).alias("masked"))
    n = f.groupBy("audio_id").agg(F.count("*").alias("n")).withColumn("features", 2 * F.col("n") + 3)
    at = n.select("audio_id", F.posexplode(vectors.mask_frames(F.col("n"), F.col("features"))).alias("feature", "frame"))
    return at.join(f, ["audio_id", "frame"]).select("audio_id", F.col("feature").cast("long").alias("feature"), "frame", "masked")


@base_query("ma_synthetic_ts", "SELECT result_id, array_to_string(list_transform(range(len(timestamps)), lambda i: trunc(i * 50 / len(timestamps)::DOUBLE)::BIGINT), ',') AS ts FROM results")
def _(spark, d):
    return results(spark, d).select("result_id", F.array_join(F.transform(vectors.even_timestamps(F.size("timestamps"), 50, True), lambda x: x.cast("string")), ",").alias("ts"))


# --- JSON -------------------------------------------------------------------------------------------------------


@query("js_parse_list", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE (event_id % 10) || ',' || (event_id % 7) END AS items FROM events")
def _(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.lit("[1, 2")).otherwise(F.format_string("[%d, %d]", F.col("event_id") % 10, F.col("event_id") % 7))
    items = F.coalesce(F.from_json(raw, "array<int>"), F.array().cast("array<int>"))
    return table(spark, d, "events").select("event_id", F.array_join(F.transform(items, lambda x: x.cast("string")), ",").alias("items"))


@query("js_extract_array", "SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def _(spark, d):
    said = F.concat(F.lit("Here you go: ["), "props", F.lit("] and so on"))
    return table(spark, d, "events").select("event_id", F.from_json(F.regexp_extract(said, r"(?s)\[.*\]", 0), "array<struct<k:bigint>>")[0]["k"].alias("k"))


@query("js_partial_objects", "SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def _(spark, d):
    said = F.concat(F.lit("["), "props", F.lit(', {"k": 1, "x'))
    found = F.explode(F.regexp_extract_all(said, F.lit(r"\{[^{}]*\}"), F.lit(0)))
    return table(spark, d, "events").select("event_id", found.alias("o")).select("event_id", F.from_json("o", "k bigint")["k"].alias("k"))


@query("js_build_meta", "SELECT event_id, event_type AS kind, value > 10 AS pnc FROM events")
def _(spark, d):
    j = table(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("kind"), (F.col("value") > 10).alias("pnc"))).alias("j"))
    return j.select("event_id", F.get_json_object("j", "$.kind").alias("kind"), F.get_json_object("j", "$.pnc").cast("boolean").alias("pnc"))


@query("js_topk_metadata", "SELECT vec_id, 'c' || label AS iso FROM embeddings")
def _(spark, d):
    one = F.struct(F.concat(F.lit("c"), F.col("label").cast("string")).alias("iso"), F.lit(0.5).alias("p"))
    j = table(spark, d, "embeddings").select("vec_id", F.to_json(F.transform(F.array(one), lambda x: x)).alias("j"))
    return j.select("vec_id", F.get_json_object("j", "$[0].iso").alias("iso"))
