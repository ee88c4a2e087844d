"""Queries on ordered frames and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import ranges
from lectern.operators import sequence as seq
from lectern.session import table

from .base import base_query, frames, results
from .registry import query

BY, ORDER = ["audio_id"], ["frame"]
_RUN = "row_number() OVER (PARTITION BY audio_id ORDER BY frame)"
#: SQL of the frames' state: the last mark so far.
STATE = "state AS (SELECT audio_id, frame, p, coalesce(last_value(CASE WHEN p >= 0.641::DOUBLE THEN true WHEN p < 0.561::DOUBLE THEN false END IGNORE NULLS) OVER (PARTITION BY audio_id ORDER BY frame ROWS UNBOUNDED PRECEDING), false) AS active FROM frames)"
RUNS = f"{STATE}, r0 AS (SELECT *, frame - row_number() OVER (PARTITION BY audio_id, active ORDER BY frame) AS g FROM state), runs AS (SELECT audio_id, active, min(frame) AS a, max(frame) AS b, count(*) AS n FROM r0 GROUP BY audio_id, active, g)"
SEGS = f"{RUNS}, segs AS (SELECT audio_id, a * 0.08::DOUBLE AS st, (b + 1) * 0.08::DOUBLE AS en FROM runs WHERE active)"
PADS = f"{SEGS}, pads AS (SELECT audio_id, greatest(st - 0.229::DOUBLE, 0) AS st, en + 0.079::DOUBLE AS en FROM segs WHERE en + 0.079::DOUBLE - greatest(st - 0.229::DOUBLE, 0) >= 0.511::DOUBLE)"


def _active(spark, d):
    return seq.hysteresis(frames(spark, d), BY, ORDER, "p")


def _segments(spark, d):
    return seq.active_segments(seq.runs(_active(spark, d), BY, "frame", "active"), "active")


@base_query("win_median_truncate", "SELECT audio_id, frame, round(quantile_cont(p, 0.5) OVER (PARTITION BY audio_id ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 9) AS median FROM frames")
def _(spark, d):
    return seq.median_truncated(frames(spark, d), BY, ORDER, "p").select("audio_id", "frame", F.round("median", 9).alias("median"))


@base_query("win_median_reflect", "WITH n AS (SELECT audio_id, count(*) AS n FROM frames GROUP BY audio_id), x AS (SELECT f.audio_id, f.frame, abs(f.frame + k) AS r, n FROM frames f JOIN n USING (audio_id), range(-5, 6) g(k)), y AS (SELECT audio_id, frame, greatest(0, least(n - 1, CASE WHEN r > n - 1 THEN 2 * n - 2 - r ELSE r END)) AS r FROM x) SELECT y.audio_id, y.frame, round(quantile_cont(f.p, 0.5), 9) AS median FROM y JOIN frames f ON f.audio_id = y.audio_id AND f.frame = y.r GROUP BY y.audio_id, y.frame")
def _(spark, d):
    return seq.median_reflected(frames(spark, d), BY, "frame", "p").select("audio_id", "frame", F.round("median", 9).alias("median"))


@base_query("win_hysteresis", f"WITH {STATE} SELECT audio_id, frame, active FROM state")
def _(spark, d):
    return _active(spark, d).select("audio_id", "frame", "active")


@base_query("win_islands_to_regions", f"WITH {SEGS} SELECT audio_id, round(st, 6) AS s, round(en, 6) AS e FROM segs")
def _(spark, d):
    return _segments(spark, d).select("audio_id", F.round("start", 6).alias("s"), F.round("end", 6).alias("e"))


@base_query("win_pad_and_min_on", f"WITH {PADS} SELECT audio_id, round(st, 6) AS s, round(en, 6) AS e FROM pads")
def _(spark, d):
    return seq.pad(_segments(spark, d)).select("audio_id", F.round("start", 6).alias("s"), F.round("end", 6).alias("e"))


@base_query("win_merge_gap_chain", f"WITH {PADS}, m AS (SELECT *, CASE WHEN st - lag(en) OVER w < 0.296::DOUBLE THEN 0 ELSE 1 END AS cut FROM pads WINDOW w AS (PARTITION BY audio_id ORDER BY st, en)), c AS (SELECT *, sum(cut) OVER (PARTITION BY audio_id ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS chain FROM m) SELECT audio_id, round(min(st), 6) AS s, round(arg_max(en, st), 6) AS e, count(*) AS parts FROM c GROUP BY audio_id, chain")
def _(spark, d):
    return seq.merge_gaps(seq.pad(_segments(spark, d)), BY).select("audio_id", F.round("start", 6).alias("s"), F.round("end", 6).alias("e"), "parts")


@base_query("win_fill_gaps", f"WITH {RUNS}, f AS (SELECT *, lag(n) OVER w AS l, lead(n) OVER w AS r FROM runs WINDOW w AS (PARTITION BY audio_id ORDER BY a)) SELECT audio_id, a, b, active OR (n <= 2 AND l IS NOT NULL AND r IS NOT NULL) AS filled FROM f")
def _(spark, d):
    r = seq.fill_gaps(_active(spark, d), BY, "frame", "active")
    return r.select("audio_id", F.col("first").alias("a"), F.col("last").alias("b"), F.col("active").alias("filled"))


_FILLED = f"{RUNS}, f AS (SELECT *, lag(n) OVER w AS l, lead(n) OVER w AS r FROM runs WINDOW w AS (PARTITION BY audio_id ORDER BY a)), g AS (SELECT audio_id, a, b, n, active OR (n <= 2 AND l IS NOT NULL AND r IS NOT NULL) AS on_ FROM f), h AS (SELECT *, CASE WHEN on_ = lag(on_) OVER (PARTITION BY audio_id ORDER BY a) THEN 0 ELSE 1 END AS c FROM g), i AS (SELECT *, sum(c) OVER (PARTITION BY audio_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS run FROM h), merged AS (SELECT audio_id, on_, min(a) AS a, max(b) AS b, sum(n)::BIGINT AS n FROM i GROUP BY audio_id, on_, run)"


@base_query("win_drop_short_runs", f"WITH {_FILLED} SELECT audio_id, a, b, on_ AND n > 2 AS kept FROM merged")
def _(spark, d):
    r = seq.drop_short_runs(seq.merge_runs(seq.fill_gaps(_active(spark, d), BY, "frame", "active"), BY, "active"), "active")
    return r.select("audio_id", F.col("first").alias("a"), F.col("last").alias("b"), F.col("active").alias("kept"))


@base_query("win_merge_adjacent_speaker", "WITH s AS (SELECT audio_id, speaker_id, round(start_time * 50)::BIGINT AS a, round(end_time * 50)::BIGINT AS b FROM results), t AS (SELECT *, CASE WHEN speaker_id = lag(speaker_id) OVER (PARTITION BY audio_id ORDER BY a, b, speaker_id) THEN 0 ELSE 1 END AS c FROM s), u AS (SELECT *, sum(c) OVER (PARTITION BY audio_id ORDER BY a, b, speaker_id ROWS UNBOUNDED PRECEDING) AS turn FROM t), v AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY audio_id, turn ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 50 THEN 0 ELSE 1 END AS cut FROM u), w AS (SELECT *, sum(cut) OVER (PARTITION BY audio_id, turn ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS chain FROM v) SELECT audio_id, speaker_id, min(a) AS a, max(b) AS b, count(*) AS parts FROM w GROUP BY audio_id, turn, speaker_id, chain")
def _(spark, d):
    s = results(spark, d).select("audio_id", "speaker_id", F.round(F.col("start_time") * 50).cast("long").alias("a"), F.round(F.col("end_time") * 50).cast("long").alias("b"))
    return seq.merge_neighbours(s, BY, "speaker_id", "a", "b")


def _vad_sql(silence: float) -> str:
    """The fold as a recursion from frame to frame: where speech began, where silence after it began, what has ended."""
    return f"""WITH RECURSIVE f AS (SELECT audio_id, frame AS i, p, count(*) OVER (PARTITION BY audio_id) AS n FROM frames),
v(audio_id, i, st, pe, a, b) AS (
  SELECT DISTINCT audio_id, -1::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM f
  UNION ALL SELECT audio_id, i, CASE WHEN p >= 0.5::DOUBLE THEN coalesce(st, x) WHEN done THEN NULL ELSE st END, CASE WHEN p >= 0.5::DOUBLE OR done THEN NULL WHEN off THEN coalesce(pe, x) ELSE pe END,
    CASE WHEN done AND coalesce(pe, x) - st >= 0.25::DOUBLE THEN st END, CASE WHEN done AND coalesce(pe, x) - st >= 0.25::DOUBLE THEN coalesce(pe, x) END
  FROM (SELECT f.audio_id, f.i, f.p, v.st, v.pe, f.i * 0.032::DOUBLE AS x, f.p < 0.35::DOUBLE AND v.st IS NOT NULL AS off, f.p < 0.35::DOUBLE AND v.st IS NOT NULL AND f.i * 0.032::DOUBLE - coalesce(v.pe, f.i * 0.032::DOUBLE) >= {silence!r}::DOUBLE AS done FROM v JOIN f ON f.audio_id = v.audio_id AND f.i = v.i + 1)
),
e AS (SELECT audio_id, max(n) * 0.032::DOUBLE AS len, max(n) - 1 AS last FROM f GROUP BY audio_id),
s AS (SELECT audio_id, greatest(0, a - 0.03::DOUBLE) AS a, least(len, b + 0.03::DOUBLE) AS b FROM v JOIN e USING (audio_id) WHERE a IS NOT NULL
  UNION ALL SELECT audio_id, greatest(0, st - 0.03::DOUBLE), len FROM v JOIN e USING (audio_id) WHERE i = last AND st IS NOT NULL AND len - st >= 0.25::DOUBLE)
SELECT audio_id, row_number() OVER (PARTITION BY audio_id ORDER BY a) - 1 AS n, round(a, 6) AS start, round(b, 6) AS end FROM s"""


@base_query("win_vad_hysteresis", _vad_sql(0.1))
def _(spark, d):
    return seq.vad_segments(frames(spark, d), "audio_id", "frame", "p")


@base_query("win_vad_trailing", _vad_sql(1e9))
def _(spark, d):
    return seq.vad_segments(frames(spark, d), "audio_id", "frame", "p", min_silence=1e9)


@base_query("win_min_span_groups", "WITH RECURSIVE s AS (SELECT audio_id, start_time AS st, end_time AS en, row_number() OVER (PARTITION BY audio_id ORDER BY start_time, end_time) AS i FROM results), f AS (SELECT audio_id, i, st AS a, en AS b, 0 AS grp FROM s WHERE i = 1 UNION ALL SELECT s.audio_id, s.i, CASE WHEN f.b - f.a >= 12::DOUBLE THEN s.st ELSE f.a END, CASE WHEN f.b - f.a >= 12::DOUBLE THEN s.en ELSE greatest(f.b, s.en) END, f.grp + CASE WHEN f.b - f.a >= 12::DOUBLE THEN 1 ELSE 0 END FROM f JOIN s ON s.audio_id = f.audio_id AND s.i = f.i + 1), g AS (SELECT audio_id, grp, arg_max(a, i) AS a, arg_max(b, i) AS b, count(*) AS n FROM f GROUP BY audio_id, grp), k AS (SELECT *, max(grp) OVER (PARTITION BY audio_id) AS last FROM g), m AS (SELECT audio_id, CASE WHEN grp = last AND grp > 0 AND b - a < 12::DOUBLE THEN grp - 1 ELSE grp END AS grp, a, b, n FROM k) SELECT audio_id, grp::BIGINT AS grp, min(a) AS st, max(b) AS en, sum(n)::BIGINT AS n FROM m GROUP BY audio_id, grp")
def _(spark, d):
    s = results(spark, d).select("audio_id", F.col("start_time").alias("start"), F.col("end_time").alias("end"))
    return seq.min_span_groups(s, "audio_id", 12.0).select("audio_id", "grp", F.col("start").alias("st"), F.col("end").alias("en"), "n")


_TOK = "tok AS (SELECT audio_id, frame, ((event_id * 7919) % 100 // 30)::BIGINT AS token, -((event_id % 17) / 16.0::DOUBLE) AS lp FROM frames)"


def _tokens(spark, d):
    return frames(spark, d).select("audio_id", "frame", F.floor((F.col("event_id") * 7919) % 100 / 30).alias("token"), (-(F.col("event_id") % 17) / F.lit(16.0)).alias("lp"))


@base_query("win_ctc_collapse", f"WITH {_TOK}, c AS (SELECT *, CASE WHEN token = lag(token) OVER (PARTITION BY audio_id ORDER BY frame) THEN 0 ELSE 1 END AS c FROM tok), g AS (SELECT *, sum(c) OVER (PARTITION BY audio_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM c) SELECT audio_id, token, min(frame) AS a, count(*) AS n, max(lp) AS logp FROM g WHERE token <> 0 GROUP BY audio_id, run, token")
def _(spark, d):
    return seq.ctc_collapse(_tokens(spark, d), BY, "frame", "token", "lp", 0).select("audio_id", "token", F.col("start").alias("a"), F.col("frames").alias("n"), "logp")


@base_query("de_ctc_greedy", f"WITH {_TOK}, c AS (SELECT *, CASE WHEN token = lag(token) OVER (PARTITION BY audio_id ORDER BY frame) THEN 0 ELSE 1 END AS c FROM tok) SELECT audio_id, string_agg(token::VARCHAR, ' ' ORDER BY frame) AS text FROM c WHERE c = 1 AND token <> 0 GROUP BY audio_id")
def _(spark, d):
    t = seq.ctc_collapse(_tokens(spark, d), BY, "frame", "token", "lp", 0)
    return t.groupBy("audio_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "token"))), lambda x: x["token"].cast("string")), " ").alias("text"))


@query("win_tail_argmax", "SELECT vec_id, list_position(embedding, list_max(embedding))::BIGINT - 1 AS best FROM embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).alias("best"))


_DIM = "e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS p, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"


@query("win_topk_class", f"WITH {_DIM}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS rn FROM e) SELECT vec_id, i::BIGINT AS i, rn FROM r WHERE rn <= 3")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda p, i: F.struct((-p.cast("double")).alias("m"), i.alias("i"))).alias("z"))
    return e.select("vec_id", F.posexplode(F.slice(F.array_sort("z"), 1, 3)).alias("rn", "x")).select("vec_id", F.col("x.i").cast("long").alias("i"), (F.col("rn") + 1).cast("long").alias("rn"))


@base_query("win_row_number_cue", "SELECT result_id, row_number() OVER (PARTITION BY audio_id ORDER BY start_time, result_id) AS cue FROM results")
def _(spark, d):
    from lectern.sources.exports import cue_number

    return results(spark, d).select("result_id", cue_number("audio_id", ("start_time", "result_id")).cast("long").alias("cue"))


@base_query("win_renumber", "SELECT result_id, row_number() OVER (PARTITION BY audio_id ORDER BY end_time, result_id)::DOUBLE AS sort_order FROM results")
def _(spark, d):
    from lectern.sources.exports import cue_number

    return results(spark, d).select("result_id", cue_number("audio_id", ("end_time", "result_id")).cast("double").alias("sort_order"))


@base_query("win_monotonic_progress", "WITH e AS (SELECT *, sum(CASE WHEN spk = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY audio_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS ep FROM frames) SELECT audio_id, frame, max(p) OVER (PARTITION BY audio_id, ep ORDER BY frame ROWS UNBOUNDED PRECEDING) AS progress FROM e")
def _(spark, d):
    return seq.running_reset_max(frames(spark, d), BY, ORDER, "p", F.col("spk") == "signup", "progress").select("audio_id", "frame", "progress")


@base_query("win_nondecreasing_ts", "SELECT result_id, array_to_string(list_transform(range(len(timestamps)), lambda i: CASE WHEN len(timestamps) = 1 THEN 0 ELSE round_even(i * 40 / (len(timestamps) - 1)::DOUBLE, 0)::BIGINT END), ',') AS ts FROM results")
def _(spark, d):
    from lectern.functions.vectors import even_timestamps

    return results(spark, d).select("result_id", F.array_join(F.transform(even_timestamps(F.size("timestamps"), 40), lambda x: x.cast("string")), ",").alias("ts"))


@base_query("win_prefix_sum_budget", "WITH s AS (SELECT audio_id, result_id, sum(end_time - start_time) OVER w AS spent, row_number() OVER w AS n FROM results WINDOW w AS (PARTITION BY audio_id ORDER BY start_time, result_id ROWS UNBOUNDED PRECEDING)) SELECT audio_id, result_id FROM s WHERE n = 1 OR spent <= 8::DOUBLE")
def _(spark, d):
    r = results(spark, d).withColumn("dur", F.col("end_time") - F.col("start_time"))
    return seq.within_budget(r, BY, ["start_time", "result_id"], "dur", 8.0).select("audio_id", "result_id")


@query("win_corpus_word_cap", "WITH w AS (SELECT source, doc_id, length(text) - length(replace(text, ' ', '')) + 1 AS n FROM documents), c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w) SELECT source, doc_id, before::BIGINT AS before FROM c WHERE before < 5000")
def _(spark, d):
    from lectern.functions.text import word_count

    w = table(spark, d, "documents").select("source", "doc_id", word_count(F.col("text")).alias("n"))
    return ranges.sum_before(w, ["source"], "doc_id", "n", "before").where("before < 5000").select("source", "doc_id", F.col("before").cast("long").alias("before"))


@query("win_dedup_first", "SELECT min(conv_id * 1000 + turn) AS first_id, text FROM conversations GROUP BY text")
def _(spark, d):
    c = table(spark, d, "conversations").withColumn("first_id", F.col("conv_id") * 1000 + F.col("turn"))
    return seq.first_of_each(c, ["text"], ["first_id"]).select("first_id", "text")


@query("win_chunk_sliding", "SELECT user_id, s.start AS a, greatest(0, s.start + 16 - n) AS pad FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) u, LATERAL (SELECT unnest(range(0, n, 3)) AS start) s")
def _(spark, d):
    n = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return seq.sliding_chunks(n, "n", 16, 3).select("user_id", F.col("start").alias("a"), F.col("pad").cast("long").alias("pad"))


@query("win_chunk_fixed", "SELECT event_id, chunk, chunk * 30.0::DOUBLE AS a, least((chunk + 1) * 30.0::DOUBLE, value) AS b FROM events, LATERAL (SELECT unnest(range(0, ceil(value / 30)::BIGINT)) AS chunk) c WHERE value > 0")
def _(spark, d):
    return seq.fixed_chunks(table(spark, d, "events"), "value").select("event_id", "chunk", F.col("start").alias("a"), F.col("end").alias("b"))


@query("win_overlap_counts", "SELECT event_id, count(*) FILTER (WHERE value > 5) OVER (PARTITION BY user_id, date_trunc('day', ts)) AS active FROM events")
def _(spark, d):
    from pyspark.sql import Window

    on = F.when(F.col("value") > 5, 1)
    return table(spark, d, "events").select("event_id", F.count(on).over(Window.partitionBy("user_id", F.date_trunc("day", "ts"))).alias("active"))


@query("win_clean_mask_choice", "SELECT user_id, CASE WHEN count(*) FILTER (WHERE value > 10) > 20 THEN 'clean' ELSE 'full' END AS mask FROM events GROUP BY user_id")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.when(F.count_if(F.col("value") > 10) > 20, "clean").otherwise("full").alias("mask"))


@query("win_span_contiguity", "WITH g AS (SELECT l_orderkey % 50 AS k, l_linenumber AS s, count(*) AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT *, lag(s + 1) OVER (PARTITION BY k ORDER BY s) AS want FROM g) SELECT k, count(*) FILTER (WHERE want IS NOT NULL AND want <> s) AS gaps, sum(n)::BIGINT AS total FROM p GROUP BY k")
def _(spark, d):
    from pyspark.sql import Window

    g = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("k"), F.col("l_linenumber").alias("s")).agg(F.count("*").alias("n"))
    want = F.lag(F.col("s") + 1).over(Window.partitionBy("k").orderBy("s"))
    return g.withColumn("want", want).groupBy("k").agg(F.count_if(F.col("want") != F.col("s")).alias("gaps"), F.sum("n").alias("total"))
