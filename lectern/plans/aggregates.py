"""Queries on aggregation, ranking, batches and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import joins, ranges, ranking, store
from lectern.session import table

from .base import base_query, card_sources, cards, frames, results
from .registry import query

_J = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")

AGG = """s AS (
  SELECT k.card_id, k.source_order, r.language, trim(r.asr_content) AS text, k.token_start AS a, coalesce(k.token_end, len(r.timestamps)) AS b, k.ts_frame_offset AS o,
    r.tokens, r.timestamps, r.durations FROM card_sources k JOIN results r USING (result_id)),
c AS (SELECT card_id, source_order, language, text, coalesce(tokens[a + 1:b], []) AS tok, list_transform(timestamps[a + 1:b], lambda x: x + o) AS ts, coalesce(durations[a + 1:b], []) AS dur, durations IS NOT NULL AND len(durations) >= greatest(a, b) AS covered FROM s),
g AS (SELECT card_id, flatten(list(tok ORDER BY source_order)) AS tok, flatten(list(ts ORDER BY source_order)) AS ts, CASE WHEN bool_and(covered) THEN flatten(list(dur ORDER BY source_order)) ELSE [] END AS dur,
  coalesce(string_agg(text, ' ' ORDER BY source_order) FILTER (WHERE text <> ''), '') AS text, first(language ORDER BY source_order) FILTER (WHERE language IS NOT NULL) AS language FROM c GROUP BY card_id)"""


@base_query("agg_cards_ordered", f"WITH {AGG} SELECT card_id, array_to_string(tok, ',') AS tokens, array_to_string(ts, ',') AS timestamps, array_to_string(dur, ',') AS durations, text, language FROM g")
def _(spark, d):
    g = store.aggregate_cards(card_sources(spark, d), results(spark, d))
    return g.select("card_id", _J("tokens").alias("tokens"), _J("timestamps").alias("timestamps"), _J("durations").alias("durations"), "text", "language")


@base_query("agg_count", "SELECT (SELECT count(*) FROM cards) AS cards, (SELECT count(*) FROM results) AS results")
def _(spark, d):
    return cards(spark, d).agg(F.count("*").alias("cards")).crossJoin(results(spark, d).agg(F.count("*").alias("results")))


@base_query("agg_max_plus_one", "SELECT audio_id, coalesce(max(turn), 0) + 1 AS next FROM results GROUP BY audio_id")
def _(spark, d):
    return results(spark, d).groupBy("audio_id").agg((F.coalesce(F.max("turn"), F.lit(0)) + 1).alias("next"))


@base_query("agg_distinct_count", "SELECT audio_id, count(DISTINCT speaker_id) AS n FROM results GROUP BY audio_id")
def _(spark, d):
    return results(spark, d).groupBy("audio_id").agg(F.count_distinct("speaker_id").alias("n"))


@query("agg_centroid", "WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT label, i::BIGINT AS i, round(avg(v), 9) AS mean FROM e GROUP BY label, i")
def _(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return e.groupBy("label", (F.col("i") + 1).cast("long").alias("i")).agg(F.round(F.avg(F.col("v").cast("double")), 9).alias("mean"))


@base_query("agg_running_mean", "SELECT audio_id, frame, round(avg(p) OVER (PARTITION BY audio_id ORDER BY frame ROWS UNBOUNDED PRECEDING), 9) AS mean FROM frames WHERE p < 0.2::DOUBLE")
def _(spark, d):
    w = Window.partitionBy("audio_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return frames(spark, d).where(F.col("p") < 0.2).select("audio_id", "frame", F.round(F.avg("p").over(w), 9).alias("mean"))


_CH = "ch AS (SELECT audio_id, frame // 4 AS chunk, frame // 2 AS gf, spk, p FROM frames), m AS (SELECT audio_id, chunk, gf, spk, max(p) AS p FROM ch GROUP BY ALL)"


def _chunks(spark, d):
    f = frames(spark, d).select("audio_id", F.floor(F.col("frame") / 4).alias("chunk"), F.floor(F.col("frame") / 2).alias("gf"), "spk", "p")
    return f.groupBy("audio_id", "chunk", "gf", "spk").agg(F.max("p").alias("p"))


@base_query("agg_overlap_add", f"WITH {_CH}, has AS (SELECT DISTINCT audio_id, chunk, spk FROM m), spine AS (SELECT DISTINCT m.audio_id, m.chunk, m.gf, h.spk FROM m JOIN has h USING (audio_id, chunk)) SELECT s.audio_id, s.gf, s.spk, round(sum(coalesce(m.p, 0)) / count(*), 9) AS act FROM spine s LEFT JOIN m USING (audio_id, chunk, gf, spk) GROUP BY s.audio_id, s.gf, s.spk")
def _(spark, d):
    """Mean activation per global frame over the chunks that hold the speaker, silence counting as 0."""
    m = _chunks(spark, d)
    spine = m.select("audio_id", "chunk", "gf").distinct().join(m.select("audio_id", "chunk", "spk").distinct(), ["audio_id", "chunk"])
    j = spine.join(m, ["audio_id", "chunk", "gf", "spk"], "left")
    return j.groupBy("audio_id", "gf", "spk").agg(F.round(F.sum(F.coalesce("p", F.lit(0.0))) / F.count("*"), 9).alias("act"))


@base_query("agg_speaker_count", f"WITH {_CH}, c AS (SELECT audio_id, chunk, gf, count(*) FILTER (WHERE p >= 0.5::DOUBLE) AS n FROM m GROUP BY ALL) SELECT audio_id, gf, least(4, greatest(0, round(avg(n))))::BIGINT AS n FROM c GROUP BY audio_id, gf")
def _(spark, d):
    c = _chunks(spark, d).groupBy("audio_id", "chunk", "gf").agg(F.count_if(F.col("p") >= 0.5).alias("n"))
    return c.groupBy("audio_id", "gf").agg(F.least(F.lit(4), F.greatest(F.lit(0), F.round(F.avg("n")))).cast("long").alias("n"))


@base_query("agg_topn_per_frame", f"WITH {_CH}, r AS (SELECT audio_id, gf, spk, p, row_number() OVER (PARTITION BY audio_id, gf ORDER BY p DESC, spk) AS rn FROM m) SELECT audio_id, gf, spk FROM r WHERE rn <= 1 + audio_id % 2 AND p > 0")
def _(spark, d):
    return ranking.top_k(_chunks(spark, d), ["audio_id", "gf"], [F.desc("p"), F.col("spk")], 1 + F.col("audio_id") % 2).where("p > 0").select("audio_id", "gf", "spk")


@base_query("agg_group_by_language", "SELECT lower(language) AS lang, min(result_id) OVER (PARTITION BY lower(language)) AS first_seen, count(*) OVER (PARTITION BY lower(language)) AS n, result_id FROM results")
def _(spark, d):
    """A row a member, so that no language has to fit into one."""
    r = results(spark, d).select(F.lower("language").alias("lang"), "result_id")
    g = r.groupBy(F.col("lang").alias("l")).agg(F.min("result_id").alias("first_seen"), F.count("*").alias("n"))
    return r.join(g, F.col("lang").eqNullSafe(F.col("l"))).select("lang", "first_seen", "n", "result_id")


@query("agg_prf_micro", "WITH t AS (SELECT lang, len(list_intersect(list_distinct(string_split(text, ' ')), ['the', 'of', 'de', 'und', 'que'])) AS tp, len(list_distinct(string_split(text, ' '))) AS pred FROM documents) SELECT lang, sum(tp)::BIGINT AS tp, round(sum(tp) / greatest(sum(pred), 1)::DOUBLE, 9) AS prec, round(sum(tp) / greatest(count(*) * 5, 1)::DOUBLE, 9) AS rec FROM t GROUP BY lang")
def _(spark, d):
    words = F.array_distinct(F.split("text", " "))
    t = table(spark, d, "documents").select("lang", F.size(F.array_intersect(words, F.array(*map(F.lit, ("the", "of", "de", "und", "que"))))).alias("tp"), F.size(words).alias("pred"))
    return t.groupBy("lang").agg(F.sum("tp").alias("tp"), F.round(F.sum("tp") / F.greatest(F.sum("pred"), F.lit(1)), 9).alias("prec"), F.round(F.sum("tp") / F.greatest(F.count("*") * 5, F.lit(1)), 9).alias("rec"))


@query("agg_latency_pct", "SELECT event_type, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95, round(quantile_cont(value, 0.99), 9) AS p99, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM events GROUP BY event_type")
def _(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return g.select("event_type", *[F.round(F.col("p")[i], 9).alias(n) for i, n in enumerate(("p50", "p95", "p99"))], F.round("m", 6).alias("mean"), F.round("s", 6).alias("sd"))


_LID = "lid AS (SELECT doc_id % 3 AS dur, source AS clip, lang, CASE WHEN doc_id % 7 = 0 THEN 'en' ELSE lang END AS pred, (n_chars % 100) / 100.0::DOUBLE AS p FROM documents)"


def _lid(spark, d):
    return table(spark, d, "documents").select((F.col("doc_id") % 3).alias("dur"), F.col("source").alias("clip"), "lang", F.when(F.col("doc_id") % 7 == 0, "en").otherwise(F.col("lang")).alias("pred"), (F.col("n_chars") % 100 / F.lit(100.0)).alias("p"))


@query("agg_lid_accuracy", f"WITH {_LID}, h AS (SELECT dur, clip, pred, count(*) AS c FROM lid GROUP BY ALL), l AS (SELECT dur, clip, string_agg(pred || ':' || c, ' ' ORDER BY c DESC, pred) AS preds FROM h GROUP BY dur, clip) SELECT dur, clip, count(*) AS n, count(*) FILTER (WHERE lang = pred) AS correct, round(count(*) FILTER (WHERE lang = pred) / count(*)::DOUBLE, 9) AS acc, round(avg(p), 9) AS mean_p, any_value(preds) AS preds FROM lid JOIN l USING (dur, clip) GROUP BY dur, clip")
def _(spark, d):
    lid = _lid(spark, d)
    h = lid.groupBy("dur", "clip", "pred").agg(F.count("*").alias("c"), F.count_if(F.col("lang") == F.col("pred")).alias("ok"), F.sum("p").alias("sp"))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("m"), "pred"))), lambda x: F.concat_ws(":", x["pred"], (-x["m"]).cast("string"))), " ")
    g = h.groupBy("dur", "clip").agg(F.sum("c").alias("n"), F.sum("ok").alias("correct"), F.sum("sp").alias("sp"), top.alias("preds"))
    return g.select("dur", "clip", "n", "correct", F.round(F.col("correct") / F.col("n"), 9).alias("acc"), F.round(F.col("sp") / F.col("n"), 9).alias("mean_p"), "preds")


@query("agg_lid_rollup", f"WITH {_LID}, c AS (SELECT dur, clip, count(*) AS n, count(*) FILTER (WHERE lang = pred) AS ok, avg(p) AS mp FROM lid GROUP BY dur, clip) SELECT dur, sum(n)::BIGINT AS n, sum(ok)::BIGINT AS correct, round(sum(ok) / sum(n)::DOUBLE, 9) AS acc, round(avg(mp), 9) AS mean_p FROM c GROUP BY dur")
def _(spark, d):
    c = _lid(spark, d).groupBy("dur", "clip").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("pred")).alias("ok"), F.avg("p").alias("mp"))
    return c.groupBy("dur").agg(F.sum("n").alias("n"), F.sum("ok").alias("correct"), F.round(F.sum("ok") / F.sum("n"), 9).alias("acc"), F.round(F.avg("mp"), 9).alias("mean_p"))


_SWEEP = "sw AS (SELECT l_linenumber AS dur, l_quantity::BIGINT AS batch, CASE WHEN l_quantity * l_linenumber > 150 THEN 'oom' WHEN l_returnflag = 'R' THEN 'error' ELSE 'ok' END AS status, l_extendedprice AS mem FROM lineitem)"


def _sweep(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_linenumber").alias("dur"), F.col("l_quantity").cast("long").alias("batch"), F.col("l_extendedprice").alias("mem"),
        F.when(F.col("l_quantity") * F.col("l_linenumber") > 150, "oom").when(F.col("l_returnflag") == "R", "error").otherwise("ok").alias("status"),
    )


@query("agg_frontier", f"WITH {_SWEEP}, f AS (SELECT dur, max(batch) FILTER (WHERE status = 'ok') AS max_ok, min(batch) FILTER (WHERE status = 'oom') AS min_oom FROM sw GROUP BY dur) SELECT dur::BIGINT AS dur, max_ok, min_oom, (SELECT min(max_ok * dur) FROM f WHERE min_oom > max_ok)::BIGINT AS conservative FROM f")
def _(spark, d):
    f = _sweep(spark, d).groupBy("dur").agg(F.max(F.when(F.col("status") == "ok", F.col("batch"))).alias("max_ok"), F.min(F.when(F.col("status") == "oom", F.col("batch"))).alias("min_oom"))
    low = f.agg(F.min(F.when(F.col("min_oom") > F.col("max_ok"), F.col("max_ok") * F.col("dur"))).cast("long").alias("conservative"))
    return f.crossJoin(F.broadcast(low)).select(F.col("dur").cast("long").alias("dur"), "max_ok", "min_oom", "conservative")


@query("agg_linear_fit", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem GROUP BY l_returnflag HAVING count(*) >= 4")
def _(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.regr_slope("l_extendedprice", "l_quantity").alias("s"), F.regr_intercept("l_extendedprice", "l_quantity").alias("i"))
    return g.where("n >= 4").select("l_returnflag", F.round("s", 4).alias("slope"), F.round("i", 3).alias("intercept"))


@query("agg_diff_summary", "SELECT a.label, max(abs(a.x - b.x)) AS max_abs, round(avg(abs(a.x - b.x)), 9) AS mean_abs, round(sqrt(avg((a.x - b.x) ** 2)), 9) AS rmse, count(*) AS n FROM (SELECT vec_id, label, embedding[1]::DOUBLE AS x FROM embeddings) a JOIN (SELECT vec_id - 1 AS vec_id, embedding[1]::DOUBLE AS x FROM embeddings) b USING (vec_id) GROUP BY a.label")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id").withColumn("e", F.col("x") - F.col("y"))
    return j.groupBy("label").agg(F.max(F.abs("e")).alias("max_abs"), F.round(F.avg(F.abs("e")), 9).alias("mean_abs"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 9).alias("rmse"), F.count("*").alias("n"))


@base_query("agg_first_exceeding", "SELECT audio_id, min(frame) FILTER (WHERE p > 0.9::DOUBLE) AS first FROM frames GROUP BY audio_id")
def _(spark, d):
    return frames(spark, d).groupBy("audio_id").agg(F.min(F.when(F.col("p") > 0.9, F.col("frame"))).alias("first"))


@query("agg_rtf", "SELECT user_id, round(sum(CASE WHEN event_type IN ('view', 'click') THEN value ELSE 0 END) / 1000 / (count(*) * 30.0::DOUBLE), 12) AS rtf FROM events GROUP BY user_id")
def _(spark, d):
    spent = F.sum(F.when(F.col("event_type").isin("view", "click"), F.col("value")).otherwise(0.0))
    return table(spark, d, "events").groupBy("user_id").agg(F.round(spent / 1000 / (F.count("*") * F.lit(30.0)), 12).alias("rtf"))


@query("agg_phase_breakdown", "WITH g AS (SELECT user_id, event_type, sum(value) AS ms FROM events GROUP BY ALL) SELECT user_id, event_type, round(ms, 6) AS ms, round(CASE WHEN sum(ms) OVER (PARTITION BY user_id) > 0 THEN 100 * ms / sum(ms) OVER (PARTITION BY user_id) ELSE 0 END, 6) AS pct FROM g")
def _(spark, d):
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("ms"))
    total = F.sum("ms").over(Window.partitionBy("user_id"))
    return g.select("user_id", "event_type", F.round("ms", 6).alias("ms"), F.round(F.when(total > 0, 100 * F.col("ms") / total).otherwise(0.0), 6).alias("pct"))


@query("agg_stage_summary", "SELECT event_type, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("agg_step_stats", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS hi FROM events GROUP BY user_id")
def _(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.percentile("value", F.array(F.lit(0.5), F.lit(0.95))).alias("p"), F.max("value").alias("hi"))
    return g.select("user_id", "n", "mean", F.round(F.col("p")[0], 6).alias("median"), F.round(F.col("p")[1], 6).alias("p95"), "hi")


_TR = "tr AS (SELECT event_id, event_type AS op, (props::JSON->>'k')::BIGINT AS k, value FROM events), g AS (SELECT 'op' || (k % 20) AS op, count(*) AS calls, sum(value) AS total FROM tr WHERE k IS NOT NULL GROUP BY 1)"


@query("agg_trace_ops", f"WITH {_TR}, r AS (SELECT *, row_number() OVER (ORDER BY total DESC, op) AS rn, sum(total) OVER () AS whole FROM g) SELECT CASE WHEN rn <= 10 THEN op ELSE 'rest' END AS name, sum(calls)::BIGINT AS calls, round(sum(total), 4) AS total, round(100 * sum(total) / any_value(whole), 6) AS pct FROM r GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("op"), (F.from_json("props", "k bigint")["k"] % 20).cast("string")).alias("op"), "value")
    g = e.where("op is not null").groupBy("op").agg(F.count("*").alias("calls"), F.sum("value").alias("total"))
    r = g.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("total"), "op"))).withColumn("whole", F.sum("total").over(Window.partitionBy(F.lit(0))))  # one row an operator
    return r.groupBy(F.when(F.col("rn") <= 10, F.col("op")).otherwise("rest").alias("name")).agg(F.sum("calls").alias("calls"), F.round(F.sum("total"), 4).alias("total"), F.round(100 * F.sum("total") / F.first("whole"), 6).alias("pct"))


@query("agg_trace_provider", "SELECT coalesce(CASE WHEN event_type <> 'error' THEN event_type END, 'Unknown') AS provider, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def _(spark, d):
    p = F.coalesce(F.when(F.col("event_type") != "error", F.col("event_type")), F.lit("Unknown"))
    return table(spark, d, "events").groupBy(p.alias("provider")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("agg_trace_last_assign", "WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS op FROM events GROUP BY user_id) SELECT user_id, op FROM l WHERE op <> 'view'")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("op")).where("op <> 'view'")


@query("agg_hottest_ops", "SELECT p_type, p_size::BIGINT AS size, round(sum(p_retailprice), 4) AS total, count(*) AS n FROM part WHERE p_retailprice IS NOT NULL GROUP BY ALL ORDER BY total DESC, p_type, size LIMIT 10")
def _(spark, d):
    g = table(spark, d, "part").where("p_retailprice is not null").groupBy("p_type", F.col("p_size").cast("long").alias("size")).agg(F.round(F.sum("p_retailprice"), 4).alias("total"), F.count("*").alias("n"))
    return g.orderBy(F.desc("total"), "p_type", "size").limit(10)


@base_query("agg_benchmark_means", "SELECT audio_id, round(avg(p), 9) AS mean, round(CASE WHEN count(*) > 20 THEN avg(p) / count(*) ELSE 'nan'::DOUBLE END, 9) AS rtf FROM frames WHERE frame >= 3 GROUP BY audio_id")
def _(spark, d):
    g = frames(spark, d).where("frame >= 3").groupBy("audio_id").agg(F.avg("p").alias("m"), F.count("*").alias("n"))
    return g.select("audio_id", F.round("m", 9).alias("mean"), F.round(F.when(F.col("n") > 20, F.col("m") / F.col("n")).otherwise(F.lit(float("nan"))), 9).alias("rtf"))


@query("agg_invert_missing", "WITH k AS (SELECT DISTINCT source FROM documents), l AS (SELECT DISTINCT lang FROM documents), have AS (SELECT DISTINCT source, lang FROM documents WHERE doc_id % 5 = 0) SELECT k.source, count(*) AS n, string_agg(l.lang, ',' ORDER BY l.lang) AS missing FROM k, l WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.source = k.source AND h.lang = l.lang) GROUP BY k.source")
def _(spark, d):
    docs = table(spark, d, "documents").select("source", "lang", "doc_id")
    langs = F.broadcast(docs.agg(F.collect_set("lang").alias("langs")))  # a set of language codes
    every = docs.select("source").distinct().join(langs, F.lit(True)).select("source", F.explode("langs").alias("lang"))
    m = every.join(docs.where("doc_id % 5 = 0"), ["source", "lang"], "left_anti").groupBy("source").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("lang")), ",").alias("missing"))
    return m.orderBy(F.desc("n"), "source")


@query("agg_group_by_anchor", "WITH k AS (SELECT d.source, d.doc_id, d.lang, l.doc_id AS present FROM documents d LEFT JOIN labels l USING (doc_id)), a AS (SELECT *, last_value(present IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM k) SELECT source, anchor, doc_id, lang FROM a WHERE present IS NULL")
def _(spark, d):
    """The keys that are missing, each with the last one before it that is there; a row a key."""
    k = table(spark, d, "documents").select("source", "doc_id", "lang").join(table(spark, d, "labels").select("doc_id", F.col("doc_id").alias("present")), "doc_id", "left")
    return ranges.preceding(k, ["source"], "doc_id", F.col("present"), "anchor").where("present is null").select("source", "anchor", "doc_id", "lang")


@query("agg_cluster_sizes", "SELECT vec_id, count(*) OVER (PARTITION BY label) AS size FROM embeddings")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return e.join(e.groupBy("label").agg(F.count("*").alias("size")), "label").select("vec_id", "size")


@query("agg_word_count", "SELECT source, sum(length(text) - length(replace(text, ' ', '')) + 1)::BIGINT AS words FROM documents GROUP BY source")
def _(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.sum(text.word_count(F.col("text"))).cast("long").alias("words"))


@base_query("agg_coalesce_first", "SELECT audio_id, arg_min(asr_content, turn) FILTER (WHERE tokens IS NOT NULL) AS first_text FROM results GROUP BY audio_id")
def _(spark, d):
    return results(spark, d).groupBy("audio_id").agg(F.min_by("asr_content", F.when(F.col("tokens").isNotNull(), F.col("turn"))).alias("first_text"))


@query("agg_chunk_recombine", "SELECT conv_id, string_agg(trim(text), ' ' ORDER BY turn) FILTER (WHERE trim(text) <> '') AS text FROM conversations GROUP BY conv_id")
def _(spark, d):
    g = table(spark, d, "conversations").where("trim(text) <> ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.trim("text").alias("t")))).alias("s"))
    return g.select("conv_id", F.array_join(F.transform("s", lambda x: x["t"]), " ").alias("text"))


# --- sorts, top-k, batches --------------------------------------------------------------------------------------


@base_query("srt_play_order", "SELECT card_id, source_order, play_start FROM cards JOIN card_sources USING (card_id)")
def _(spark, d):
    return cards(spark, d).join(card_sources(spark, d), "card_id").select("card_id", "source_order", "play_start").orderBy("play_start", "card_id", "source_order")


@query("srt_jobs_desc", "SELECT o_orderkey, o_orderdate::VARCHAR AS created FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def _(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", F.col("o_orderdate").cast("string").alias("created"))


@base_query("srt_results_start", "SELECT result_id, start_time FROM results")
def _(spark, d):
    return results(spark, d).select("result_id", "start_time").orderBy("start_time", "result_id")


_DIM = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS p, generate_subscripts(embedding, 1)::BIGINT AS i FROM embeddings)"


def _dims(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "p"))
    return e.select("vec_id", "label", (F.col("i") + 1).cast("long").alias("i"), F.col("p").cast("double").alias("p"))


@query("topk_lid", f"WITH {_DIM}, s AS (SELECT vec_id, i, exp(p) / sum(exp(p)) OVER (PARTITION BY vec_id) AS q, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS rn FROM e) SELECT vec_id, rn, i, round(q, 9) AS q FROM s WHERE rn <= 5")
def _(spark, d):
    e = _dims(spark, d).withColumn("q", F.exp("p") / F.sum(F.exp("p")).over(Window.partitionBy("vec_id")))
    return ranking.top_k(e, ["vec_id"], [F.desc("p"), F.col("i")], 5).select("vec_id", F.col("rank").alias("rn"), "i", F.round("q", 9).alias("q"))


@query("topk_tokens", f"WITH {_DIM} SELECT vec_id, string_agg(i::VARCHAR, ',' ORDER BY p DESC, i) AS top FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS rn FROM e) WHERE rn <= 4 GROUP BY vec_id")
def _(spark, d):
    z = F.transform("embedding", lambda p, i: F.struct((-p.cast("double")).alias("m"), (i + 1).alias("i")))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(F.slice(F.array_sort(z), 1, 4), lambda x: x["i"].cast("string")), ",").alias("top"))


@base_query("topk_global_cache", "WITH t AS (SELECT audio_id, frame, spk, p FROM frames ORDER BY p DESC, audio_id, frame LIMIT 188) SELECT spk, audio_id, frame, row_number() OVER (ORDER BY spk, audio_id, frame) AS slot FROM t")
def _(spark, d):
    best = frames(spark, d).select("audio_id", "frame", "spk", "p").orderBy(F.desc("p"), "audio_id", "frame").limit(188)
    return best.select("spk", "audio_id", "frame", F.row_number().over(Window.orderBy("spk", "audio_id", "frame")).cast("long").alias("slot"))


@base_query("topk_boost", "WITH a AS (SELECT audio_id, frame, p + CASE WHEN row_number() OVER (PARTITION BY audio_id ORDER BY p DESC, frame) <= 3 THEN 1.0::DOUBLE ELSE 0 END AS p FROM frames) SELECT audio_id, frame, round(p + CASE WHEN row_number() OVER (PARTITION BY audio_id ORDER BY p DESC, frame) <= 6 THEN 0.5::DOUBLE ELSE 0 END, 9) AS score FROM a")
def _(spark, d):
    return ranking.boost(frames(spark, d).select("audio_id", "frame", "p"), ["audio_id"], "p", "frame", 3, 6, 0.5).select("audio_id", "frame", F.round("p", 9).alias("score"))


@base_query("top1_longest", "SELECT audio_id, arg_max(result_id, (end_time - start_time, -turn)) AS longest FROM results GROUP BY audio_id")
def _(spark, d):
    return results(spark, d).groupBy("audio_id").agg(F.max_by("result_id", F.struct(F.col("end_time") - F.col("start_time"), -F.col("turn"))).alias("longest"))


#: A job is a stretch of documents of one source.
_GREEDY = """WITH RECURSIVE s AS (SELECT source, doc_id // 500 AS job, n_chars::DOUBLE AS len, row_number() OVER (PARTITION BY source, doc_id // 500 ORDER BY n_chars, doc_id) AS i FROM documents),
f AS (SELECT source, job, i, len, 0 AS batch, 1 AS items FROM s WHERE i = 1
  UNION ALL SELECT s.source, s.job, s.i, s.len, f.batch + CASE WHEN f.items < {rows} AND (f.items + 1) * s.len <= {total}::DOUBLE THEN 0 ELSE 1 END, CASE WHEN f.items < {rows} AND (f.items + 1) * s.len <= {total}::DOUBLE THEN f.items + 1 ELSE 1 END
  FROM f JOIN s ON s.source IS NOT DISTINCT FROM f.source AND s.job = f.job AND s.i = f.i + 1)
SELECT source, job, batch::BIGINT AS batch, count(*) AS items, max(len) AS longest FROM f GROUP BY source, job, batch"""


def _jobs(spark, d):
    return table(spark, d, "documents").select("source", F.floor(F.col("doc_id") / 500).alias("job"), "n_chars", "doc_id")


@query("bat_plan_cost", _GREEDY.format(rows=8, total=20000))
def _(spark, d):
    return ranking.plan_batches(_jobs(spark, d), ["source", "job"], "n_chars", "doc_id", 8, 20000.0)


@query("bat_frames_cap", _GREEDY.format(rows=32, total=60000))
def _(spark, d):
    return ranking.plan_batches(_jobs(spark, d), ["source", "job"], "n_chars", "doc_id", 32, 60000.0)


@query("bat_qwen_cap", "SELECT event_id, CASE WHEN value > 100 THEN 1 ELSE greatest(1, floor((CASE WHEN value <= 16 THEN 14 WHEN value <= 24 THEN 10 WHEN value <= 32 THEN 8 ELSE 6 END) * (event_id % 24)::DOUBLE / 24.0::DOUBLE)) END::BIGINT AS cap FROM events")
def _(spark, d):
    free = F.when(F.col("value") <= 100, (F.col("event_id") % 24).cast("double"))
    return table(spark, d, "events").select("event_id", ranking.batch_cap(F.col("value"), free, 24.0).alias("cap"))


@query("bat_capacity_est", "SELECT p_partkey, round(CASE WHEN p_size % 5 > 0 THEN greatest(0, (p_retailprice - 950 - p_size) / (p_size % 5)) END, 6) AS seconds FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(ranking.capacity(F.col("p_retailprice"), 950.0, F.col("p_size"), (F.col("p_size") % 5).cast("double")), 6).alias("seconds"))


# --- sets -------------------------------------------------------------------------------------------------------


@query("set_entity_prf", "WITH t AS (SELECT item_id, list_distinct(string_split(text, ' ')) AS g, list_distinct(string_split(substr(text, 20), ' ')) AS p FROM benchmark), n AS (SELECT item_id, len(g) AS g, len(p) AS p, len(list_intersect(g, p)) AS tp FROM t) SELECT item_id, round(tp / p::DOUBLE, 9) AS prec, round(tp / g::DOUBLE, 9) AS rec, round(CASE WHEN tp = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (p + g) END, 9) AS f1 FROM n")
def _(spark, d):
    from lectern.operators.evaluation import prf

    g, p = F.array_distinct(F.split("text", " ")), F.array_distinct(F.split(F.substring("text", 20, 1 << 30), " "))
    b = table(spark, d, "benchmark").select("item_id", prf(g, p).alias("s"))
    return b.select("item_id", *[F.round(f"s.{c}", 9).alias(c) for c in ("prec", "rec", "f1")])


@base_query("set_distinct_sources", "SELECT card_id, count(DISTINCT result_id) AS n FROM card_sources GROUP BY card_id")
def _(spark, d):
    return card_sources(spark, d).groupBy("card_id").agg(F.size(F.array_distinct(F.collect_list("result_id"))).cast("long").alias("n"))


@query("set_union_sources_corpus", "SELECT source, count(*) AS n FROM (SELECT source FROM documents UNION ALL SELECT source FROM documents WHERE lang = 'en' UNION ALL SELECT source FROM documents WHERE lang = 'en') GROUP BY source")
def _(spark, d):
    w = F.when(F.col("lang") == "en", 3).otherwise(1)
    return table(spark, d, "documents").select("source", F.explode(F.sequence(F.lit(1), w)).alias("copy")).groupBy("source").agg(F.count("*").alias("n"))


@query("set_emitted_once", "SELECT DISTINCT user_id, event_type, date_trunc('day', ts)::VARCHAR AS day FROM events")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd HH:mm:ss").alias("day"))
    return e.dropDuplicates(["user_id", "event_type", "day"])
