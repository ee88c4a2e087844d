"""Queries on clustering, decoding, language models, evaluation, edits of the store, jobs and routing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern import scratch
from lectern.functions import text, vectors
from lectern.operators import clustering, evaluation, store
from lectern.session import table

from .base import base_query, card_sources, cards, frames, results
from .registry import query


def _emb(spark, d):
    return table(spark, d, "embeddings").select((F.col("vec_id") % 25).alias("rec"), "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))


@query("cl_linkage_centroid")
def _(spark, d):
    return clustering.cluster(_emb(spark, d), "rec", "vec_id", "embedding", distance=1.2)


@query("cl_fcluster_threshold")
def _(spark, d):
    return clustering.cluster(_emb(spark, d), "rec", "vec_id", "embedding", distance=0.9)


@query("cl_fcluster_maxclust")
def _(spark, d):
    return clustering.cluster(_emb(spark, d), "rec", "vec_id", "embedding", clusters=4)


@query("cl_vbx")
def _(spark, d):
    """Refinement from the labels, with variances that fall from dimension to dimension."""
    return clustering.refine(_emb(spark, d), "rec", "vec_id", "embedding", "label", [2.0 - i / 64 for i in range(64)])


_CENT = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(v) AS m FROM e GROUP BY label, i), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label), k AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM e GROUP BY vec_id), s AS (SELECT e.vec_id, m.label, round(sum(e.v * m.m) / any_value(k.n) / any_value(n.n), 10) AS cos FROM e JOIN m ON m.i = e.i JOIN n ON n.label = m.label JOIN k ON k.vec_id = e.vec_id GROUP BY e.vec_id, m.label)"


@query("cl_assign_centroid", f"WITH {_CENT} SELECT vec_id, arg_max(label, (cos, -label))::BIGINT AS cluster FROM s GROUP BY vec_id")
def _(spark, d):
    e = _emb(spark, d).withColumnRenamed("label", "cluster")
    return clustering.nearest_centroid(e.drop("cluster"), clustering.centroids(e, "cluster", "embedding"), "embedding", "cluster", ["vec_id"])


@query("cl_merge_small", f"WITH {_CENT}, z AS (SELECT label, count(*) AS c FROM embeddings GROUP BY label), cut AS (SELECT quantile_disc(c, 0.3) AS c FROM z), big AS (SELECT label FROM z, cut WHERE z.c >= cut.c), b AS (SELECT vec_id, arg_max(s.label, (cos, -s.label)) AS best FROM s JOIN big USING (label) GROUP BY vec_id) SELECT x.vec_id, CASE WHEN x.label IN (SELECT label FROM big) THEN x.label ELSE b.best END::BIGINT AS label FROM embeddings x JOIN b USING (vec_id)")
def _(spark, d):
    return clustering.merge_small(_emb(spark, d), "embedding", "label", ["vec_id"], 0.3)


_FRAMES = "f AS (SELECT vec_id, vec_id % 25 AS rec, label, 20 + vec_id % 77 AS frames, (vec_id * 13) % 17 AS clean FROM embeddings)"


@query("cl_train_subset", f"WITH {_FRAMES}, k AS (SELECT *, clean >= greatest(1, round_even(frames * 0.1::DOUBLE, 0)::BIGINT) AS enough FROM f) SELECT vec_id FROM k WHERE enough OR rec IN (SELECT rec FROM k GROUP BY rec HAVING count(*) FILTER (WHERE enough) < 2)")
def _(spark, d):
    """Every embedding stands for a stretch of frames, some of which only one speaker has."""
    f = _emb(spark, d).select("rec", "vec_id", (20 + F.col("vec_id") % 77).alias("frames"), (F.col("vec_id") * 13 % 17).alias("clean"))
    return clustering.train_subset(f, ["rec"], "clean", "frames").select("vec_id")


@query("cl_assign_unique")
def _(spark, d):
    """Chunks of four embeddings of a recording, scored by their cosine with the centroid of every label."""
    e = _emb(spark, d)
    n = F.row_number().over(Window.partitionBy("rec").orderBy("vec_id"))
    one = clustering.centroids(e, "label", "embedding").agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("all"))
    scores = F.transform("all", lambda c: vectors.cosine(F.col("embedding"), c["centroid"]))
    chunks = e.join(F.broadcast(one)).withColumn("chunk", F.floor((n - 1) / 4)).withColumn("scores", scores)
    return clustering.assign_unique(chunks, ["rec", "chunk"], "vec_id", "scores").drop("chunk")


@query("cl_compact_ids", "WITH f AS (SELECT label, min(vec_id) AS first FROM embeddings GROUP BY label), r AS (SELECT label, row_number() OVER (ORDER BY first) - 1 AS cluster FROM f) SELECT vec_id, cluster FROM embeddings JOIN r USING (label)")
def _(spark, d):
    return clustering.compact(_emb(spark, d), [], "label", "vec_id", "cluster").select("vec_id", "cluster")


_GRAMS = "w AS (SELECT string_split(lower(text), ' ') AS w FROM conversations), g AS (SELECT n AS ord, array_to_string(w[i:i + n - 1], ' ') AS gram FROM w, (SELECT unnest([1, 2, 3, 4]) AS n) o, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) p), c AS (SELECT ord, gram, count(*) AS n FROM g GROUP BY ord, gram)"


@query("lm_ngram_counts", f"WITH {_GRAMS} SELECT ord::BIGINT AS ord, gram, n FROM c WHERE n > CASE WHEN ord >= 3 THEN 1 ELSE 0 END")
def _(spark, d):
    return clustering.ngram_counts(table(spark, d, "conversations"), F.split(F.lower("text"), " "), 4).withColumnRenamed("order", "ord")


def _lm(spark, d):
    c = clustering.ngram_counts(table(spark, d, "conversations"), F.split(F.lower("text"), " "), 3, (0, 0, 0))
    return c.where("n > 1").select("gram", (-F.lit(1.0) / F.col("n")).alias("logp"), (-F.lit(0.5) / F.col("n")).alias("backoff"))


def _at_each_word(spark, d):
    """(id, pos, gram): every word of every turn, with as many of the two words before it as there are. Scores depend on
    the gram alone, so they are made once for each different one."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.split(F.lower("text"), " ").alias("w"))
    at = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.array_join(F.slice("w", F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), " "))
    return c.where("w is not null").select("id", F.posexplode(at).alias("pos", "gram"))


_LM = f"""{_GRAMS}, lm AS (SELECT gram, -1.0::DOUBLE / n AS p, -0.5::DOUBLE / n AS b FROM c WHERE ord <= 3 AND n > 1),
t AS (SELECT conv_id * 1000 + turn AS id, string_split(lower(text), ' ') AS w FROM conversations WHERE text IS NOT NULL),
q AS (SELECT id, (i - 1)::INT AS pos, CASE WHEN i > 2 THEN array_to_string(w[i - 2:i], ' ') END AS g3, CASE WHEN i > 1 THEN array_to_string(w[i - 1:i], ' ') END AS g2, w[i] AS g1,
  CASE WHEN i > 2 THEN array_to_string(w[i - 2:i - 1], ' ') END AS h2, CASE WHEN i > 1 THEN w[i - 1] END AS h1 FROM t, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i) o),
j AS (SELECT id, pos, a.p AS p3, b.p AS p2, c1.p AS p1, d.b AS b3, e.b AS b2 FROM q LEFT JOIN lm a ON a.gram = g3 LEFT JOIN lm b ON b.gram = g2 LEFT JOIN lm c1 ON c1.gram = g1 LEFT JOIN lm d ON d.gram = h2 LEFT JOIN lm e ON e.gram = h1)"""
_LM_SCORE = "CASE WHEN p3 IS NOT NULL THEN p3 WHEN p2 IS NOT NULL THEN p2 + coalesce(b3, 0) WHEN p1 IS NOT NULL THEN p1 + coalesce(b2, 0) + coalesce(b3, 0) ELSE -10.0::DOUBLE END"


@query("lm_backoff", f"WITH {_LM} SELECT id, pos, round({_LM_SCORE}, 9) AS score FROM j")
def _(spark, d):
    q = _at_each_word(spark, d)
    scores = clustering.backoff_scores(q.select(F.col("gram").alias("id"), "gram").distinct(), _lm(spark, d), -10.0, 3)
    return q.join(scores.withColumnRenamed("id", "gram"), "gram").select("id", "pos", F.round("score", 9).alias("score"))


@query("lm_lookup", f"WITH {_LM} SELECT id, pos, CASE WHEN p3 IS NOT NULL THEN 3 WHEN p2 IS NOT NULL THEN 2 WHEN p1 IS NOT NULL THEN 1 ELSE 0 END AS matched FROM j")
def _(spark, d):
    lm = _lm(spark, d).select(F.col("gram").alias("suffix"), F.lit(True).alias("hit"))
    q = _at_each_word(spark, d)
    w = F.split("gram", " ")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(w)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(w, F.size(w) - n + 1, n), " ").alias("suffix")))
    e = q.select("gram").distinct().select("gram", F.inline(suffixes))
    matched = e.join(lm, "suffix", "left").groupBy("gram").agg(F.coalesce(F.max(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("matched"))
    return q.join(matched, "gram").select("id", "pos", "matched")


# --- evaluation -------------------------------------------------------------------------------------------------


def _ref_hyp(spark, d):
    """Reference and hypothesis: a benchmark item against itself with words changed, and by mode."""
    b = table(spark, d, "benchmark")
    ref = text.for_scoring(F.col("text"))
    w = F.split(ref, " ")
    hyp = F.array_join(F.filter(F.transform(w, lambda x, i: F.when(i % 7 == 3, "changed").when(i % 11 == 5, None).otherwise(x)), lambda x: x.isNotNull()), " ")
    return b.select("item_id", (F.col("item_id") % 3).alias("mode"), ref.alias("ref"), hyp.alias("hyp"))


@query("ev_wer")
def _(spark, d):
    return _ref_hyp(spark, d).select("item_id", evaluation.word_edits("ref", "hyp").alias("e")).select("item_id", "e.*", ((F.col("e.sub") + F.col("e.del") + F.col("e.ins")) / F.greatest("e.n_ref", F.lit(1))).alias("wer"))


@query("ev_cer", "WITH t AS (SELECT item_id, regexp_replace(trim(regexp_replace(regexp_replace(lower(text), '[^\\pL\\pN_ \\n\\t]', '', 'g'), '\\s+', ' ', 'g')), '[^a-z0-9 ]', '', 'g') AS ref FROM benchmark) SELECT item_id, round(levenshtein(ref, substr(ref, 4)) / greatest(length(ref), 1)::DOUBLE, 9) AS cer FROM t")
def _(spark, d):
    r = _ref_hyp(spark, d).withColumn("ref", F.regexp_replace("ref", "[^a-z0-9 ]", ""))  # DuckDB counts bytes
    return r.select("item_id", F.round(evaluation.char_error_rate(F.col("ref"), F.substring("ref", 4, 1 << 30)), 9).alias("cer"))


@query("ev_cw_wer")
def _(spark, d):
    cw = lambda c: F.array_join(text.content_words(F.col(c), ("the", "of", "and", "to", "a")), " ")
    return _ref_hyp(spark, d).select("item_id", evaluation.word_edits(cw("ref"), cw("hyp")).alias("e")).select("item_id", "e.*")


@query("ev_rouge_l")
def _(spark, d):
    return _ref_hyp(spark, d).select("item_id", F.round(evaluation.rouge_l("ref", "hyp"), 9).alias("rouge_l"))


@query("agg_wer_micro")
def _(spark, d):
    e = _ref_hyp(spark, d).select("mode", evaluation.word_edits("ref", "hyp").alias("e"))
    return e.groupBy("mode").agg((F.sum(F.col("e.sub") + F.col("e.del") + F.col("e.ins")) / F.greatest(F.sum("e.n_ref"), F.lit(1))).alias("wer"))


@query("agg_rouge_macro")
def _(spark, d):
    return _ref_hyp(spark, d).select("mode", evaluation.rouge_l("ref", "hyp").alias("r")).groupBy("mode").agg(F.round(F.avg("r"), 9).alias("rouge_l"))


_HYP = "w AS (SELECT item_id, string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\\pL\\pN_ \\n\\t]', '', 'g'), '\\s+', ' ', 'g')), ' ') AS w FROM benchmark)"


@query("ev_entity_prf", f"WITH {_HYP}, t AS (SELECT DISTINCT x AS t, length(x) % 2 AS cls FROM (SELECT unnest(w) AS x FROM w) WHERE length(x) > 5), e AS (SELECT item_id, w AS r, list_filter(list_transform(w, lambda x, i: CASE WHEN (i - 1) % 7 = 3 THEN 'changed' WHEN (i - 1) % 11 = 5 THEN NULL ELSE x END), lambda x: x IS NOT NULL) AS h FROM w), s AS (SELECT item_id, cls, list_distinct(list_intersect(r, g)) AS gold, list_distinct(list_intersect(h, g)) AS found FROM e, (SELECT cls, list(t) AS g FROM t GROUP BY cls) k), n AS (SELECT item_id, cls, len(gold) AS g, len(found) AS p, len(list_intersect(gold, found)) AS tp FROM s) SELECT item_id, cls, round(CASE WHEN g + p = 0 THEN 1 WHEN g * p = 0 THEN 0 ELSE tp / p::DOUBLE END, 9) AS prec, round(CASE WHEN g + p = 0 THEN 1 WHEN g * p = 0 THEN 0 ELSE tp / g::DOUBLE END, 9) AS rec, round(CASE WHEN g + p = 0 THEN 1 WHEN g * p = 0 THEN 0 ELSE 2 * tp / (p + g)::DOUBLE END, 9) AS f1 FROM n")
def _(spark, d):
    """Entities by gazetteer: long words of two classes stand for its terms. Words meet terms in a join, so the gazetteer
    may be of any size."""
    r = _ref_hyp(spark, d)
    words = lambda c: F.array_distinct(F.split(c, " "))
    each = r.select("item_id", F.lit(True).alias("gold"), F.explode(words("ref")).alias("x")).union(r.select("item_id", F.lit(False), F.explode(words("hyp"))))
    terms = r.select(F.explode(words("ref")).alias("x")).distinct().where("length(x) > 5").withColumn("cls", (F.length("x") % 2).cast("long"))
    sets = evaluation.entity_sets(each, terms, ["item_id"], "x", "cls", "gold")
    score = evaluation.prf("gold_set", "found_set")
    classes = terms.select("cls").distinct()
    all_ = r.select("item_id").join(classes).join(sets, ["item_id", "cls"], "left")
    none = F.array().cast("array<string>")
    s = all_.select("item_id", "cls", F.coalesce("gold_set", none).alias("gold_set"), F.coalesce("found_set", none).alias("found_set")).select("item_id", "cls", score.alias("s"))
    return s.select("item_id", "cls", *[F.round(f"s.{c}", 9).alias(c) for c in ("prec", "rec", "f1")])


_PAIRS = "p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, list_transform(b.embedding::DOUBLE[], lambda v: v * CASE WHEN a.vec_id % 3 = 0 THEN 1.00001::DOUBLE ELSE 1 END) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + CASE WHEN a.vec_id % 2 = 0 THEN 0 ELSE 1 END)"


@query("ev_parity_gate", f"WITH {_PAIRS}, s AS (SELECT vec_id, x, y, list_transform(x, lambda v: exp(v)) AS ex, list_transform(y, lambda v: exp(v)) AS ey FROM p), m AS (SELECT vec_id, list_position(x, list_max(x)) = list_position(y, list_max(y)) AS top, list_max(list_transform(range(1, len(x) + 1), lambda i: abs(ex[i] / list_sum(ex) - ey[i] / list_sum(ey)))) <= 0.001::DOUBLE AS near, list_cosine_similarity(x, y) >= 0.9999::DOUBLE AS along FROM s) SELECT vec_id, top AND near AND along AS same FROM m")
def _(spark, d):
    """Vectors read as scores, against the same ones in other precision or against the next one's."""
    e = _emb(spark, d)
    a = e.withColumn("other", F.col("vec_id") + F.when(F.col("vec_id") % 2 == 0, 0).otherwise(1)).select("vec_id", "other", F.col("embedding").alias("x"))
    b = e.select(F.col("vec_id").alias("other"), F.col("embedding").alias("y0"))
    j = a.join(b, "other").withColumn("y", F.transform("y0", lambda v: v * F.when(F.col("vec_id") % 3 == 0, 1.00001).otherwise(1.0)))
    return j.select("vec_id", evaluation.parity(F.col("x"), F.col("y"), F.col("x"), F.col("y")).alias("same"))


# --- edits of the store -----------------------------------------------------------------------------------------


@base_query("dm_migrate_cards", "SELECT result_id AS card_id, speaker_id, start_time AS play_start FROM results")
def _(spark, d):
    r = results(spark, d)
    none = cards(spark, d).limit(0)
    return store.migrate_cards(r, none).select("card_id", "speaker_id", "play_start")


_LOG = "log AS (SELECT user_id AS card_id, event_id AS seq, CASE WHEN event_type = 'view' THEN value END AS play_start, CASE WHEN event_type = 'click' THEN value END AS play_end, CASE WHEN event_type = 'signup' THEN props END AS content, CASE WHEN event_type = 'error' THEN event_id % 2 = 0 END AS verified FROM events)"


@query("dm_card_ops", f"WITH {_LOG} SELECT card_id, arg_max(play_start, seq) AS play_start, arg_max(play_end, seq) AS play_end, arg_max(content, seq) AS content, arg_max(verified, seq) AS verified FROM log GROUP BY card_id")
def _(spark, d):
    on = lambda kind, v: F.when(F.col("event_type") == kind, v)
    log = table(spark, d, "events").select(
        F.col("user_id").alias("card_id"), F.col("event_id").alias("seq"), on("view", F.col("value")).alias("play_start"), on("click", F.col("value")).alias("play_end"),
        on("signup", F.col("props")).alias("content"), on("error", F.col("event_id") % 2 == 0).alias("verified"),
    )
    return store.fold_log(log, "card_id", "seq", ["play_start", "play_end", "content", "verified"])


@query("dm_update_result", "SELECT user_id AS result_id, arg_max(value, event_id) AS tokens FROM events GROUP BY user_id")
def _(spark, d):
    return store.fold_log(table(spark, d, "events").select(F.col("user_id").alias("result_id"), "event_id", F.col("value").alias("tokens")), "result_id", "event_id", ["tokens"])


@query("dm_insert_result", "WITH n AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS k, (SELECT max(conv_id * 1000 + turn) FROM conversations) AS top FROM conversations WHERE turn = 0) SELECT conv_id * 1000 + turn AS result_id, conv_id FROM conversations UNION ALL SELECT top + k, conv_id FROM n")
def _(spark, d):
    """Every first turn is recognised once more: new results get the ids after the largest one."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("result_id"), "conv_id", "turn")
    return store.insert(c.drop("turn"), c.where("turn = 0").drop("turn"), "result_id", ["conv_id"])


@base_query("dm_update_lid", "SELECT result_id, coalesce(CASE WHEN result_id % 5 = 0 THEN 'de' END, lower(language)) AS lid FROM results")
def _(spark, d):
    r = results(spark, d)
    new = r.where("result_id % 5 = 0").select("result_id", F.lit("de").alias("lid"))
    return store.upsert(r.select("result_id", F.lower("language").alias("lid")), new, ["result_id"], ["lid"])


@query("dm_bulk_tx", "SELECT conv_id * 1000 + turn AS result_id, role, CASE WHEN turn = 2 THEN upper(role) ELSE role END AS now FROM conversations WHERE turn <> 1")
def _(spark, d):
    """Edits of many rows as one write: readers see the table before or after it, never a part."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("result_id"), "turn", "role", F.col("role").alias("now"))
    at = scratch.new_path(spark)
    store.commit(spark, at, c)
    before = store.current(spark, at)
    store.commit(spark, at, before.where("turn <> 1").withColumn("now", F.when(F.col("turn") == 2, F.upper("role")).otherwise(F.col("now"))))
    return store.current(spark, at).drop("turn")


@base_query("dm_merge_cards", "WITH x AS (SELECT a.result_id AS card_id, a.start_time AS s, b.end_time AS e, list_concat(a.timestamps, list_transform(b.timestamps, lambda t: t + round_even((b.start_time - a.start_time) / 0.08::DOUBLE, 0)::BIGINT)) AS ts, trim(a.asr_content) || ' ' || trim(b.asr_content) AS content, a.end_time AS ae FROM results a JOIN results b ON b.result_id = a.result_id + 1 AND a.turn % 2 = 0) SELECT card_id, s AS play_start, greatest(ae, e) AS play_end, array_to_string(ts, ',') AS timestamps, content FROM x")
def _(spark, d):
    r = results(spark, d)
    pack = lambda c: F.struct(F.col("result_id").alias("card_id"), F.col("start_time").alias("play_start"), F.col("end_time").alias("play_end"), F.coalesce("tokens", F.array().cast("array<int>")).alias("tokens"), "timestamps", F.col("asr_content").alias("text")).alias(c)
    a = r.where("turn % 2 = 0").select("result_id", pack("a"))
    b = r.select((F.col("result_id") - 1).alias("result_id"), pack("b"))
    m = a.join(b, "result_id").select(*store.merge_pair("a", "b"))
    return m.select("card_id", "play_start", "play_end", F.array_join(F.transform("timestamps", lambda x: x.cast("string")), ",").alias("timestamps"), "content")


@base_query("dm_merge_sources", "SELECT audio_id, result_id, min(token_start)::BIGINT AS a, CASE WHEN count(*) FILTER (WHERE token_end IS NULL) > 0 THEN NULL ELSE max(token_end) END::BIGINT AS b FROM (SELECT card_id // 1000 AS audio_id, * EXCLUDE (card_id) FROM card_sources) GROUP BY audio_id, result_id")
def _(spark, d):
    s = card_sources(spark, d).withColumn("audio_id", F.floor(F.col("card_id") / 1000))
    return store.merge_source_ranges(s, "audio_id").select("audio_id", "result_id", F.col("token_start").cast("long").alias("a"), F.col("token_end").cast("long").alias("b"))


@base_query("dm_split_card", "WITH h AS (SELECT result_id AS card_id, start_time AS s, end_time AS e, timestamps AS ts, CASE WHEN len(timestamps) > 3 THEN start_time + timestamps[4] * 0.08::DOUBLE ELSE (start_time + end_time) / 2 END AS mid FROM results WHERE tokens IS NOT NULL) SELECT card_id, 0 AS part, s AS play_start, mid AS play_end, array_to_string(ts[1:3], ',') AS ts FROM h UNION ALL SELECT card_id, 1, mid, e, array_to_string(list_transform(ts[4:], lambda x: x - coalesce(ts[4], 0)), ',') FROM h")
def _(spark, d):
    c = results(spark, d).where("tokens is not null").select(F.col("result_id").alias("card_id"), F.col("start_time").alias("play_start"), F.col("end_time").alias("play_end"), "tokens", "timestamps")
    return store.split_card(c, F.lit(3)).select("card_id", "part", "play_start", "play_end", F.array_join(F.transform("timestamps", lambda x: x.cast("string")), ",").alias("ts"))


@base_query("dm_adjust_times", "SELECT card_id, CASE WHEN card_id % 3 = 0 AND NOT (play_start - 2 < 0 OR play_end <= play_start - 2) THEN play_start - 2 ELSE play_start END AS play_start FROM cards")
def _(spark, d):
    new = F.when(F.col("card_id") % 3 == 0, F.col("play_start") - 2)
    bad = (new < 0) | (F.col("play_end") <= new)
    return cards(spark, d).select("card_id", F.when(new.isNotNull() & ~bad, new).otherwise(F.col("play_start")).alias("play_start"))


@base_query("dm_redo_asr", "SELECT card_id, CASE WHEN card_id % 10 = 0 THEN card_id + 1000000 ELSE result_id END AS result_id, CASE WHEN card_id % 10 <> 0 THEN content END AS content FROM cards JOIN card_sources USING (card_id) WHERE source_order = 0 OR card_id % 10 <> 0")
def _(spark, d):
    """A new result takes the place of a card's sources, and the override goes."""
    redo = cards(spark, d).where("card_id % 10 = 0").select("card_id", (F.col("card_id") + 1_000_000).alias("result_id"))
    kept = card_sources(spark, d).join(redo, "card_id", "left_anti").select("card_id", "result_id").union(redo)
    return kept.join(cards(spark, d), "card_id").select("card_id", "result_id", F.when(F.col("card_id") % 10 != 0, F.col("content")).alias("content"))


@base_query("dm_speakers", "SELECT card_id, CASE WHEN speaker_id = 3 THEN 1 ELSE speaker_id END AS speaker_id FROM cards")
def _(spark, d):
    moved = spark.sql("SELECT 3 AS old, 1 AS new")
    return cards(spark, d).join(F.broadcast(moved), F.col("speaker_id") == F.col("old"), "left").select("card_id", F.coalesce("new", "speaker_id").alias("speaker_id"))


@query("dm_job_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'queued' ELSE lower(o_orderstatus) END AS status FROM orders UNION ALL SELECT -1, 'queued'")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.lower("o_orderstatus").alias("status"))
    new = o.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit("queued").alias("status")).union(spark.sql("SELECT -1L, 'queued'"))
    return store.upsert(o, new, ["o_orderkey"], ["status"])


@query("dm_job_status", "WITH l AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) SELECT user_id, event_type AS status, CASE WHEN event_type = 'error' THEN value::VARCHAR END AS error, CASE WHEN event_type = 'purchase' THEN value END AS seconds FROM l WHERE rn = 1")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("status"), F.when(F.col("event_type") == "error", F.col("value").cast("string")).alias("error"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("seconds"))
    return store.job_state(e, "user_id", "event_id", "status", "error", "seconds")


@query("dm_job_recover", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Failed' WHEN 'P' THEN 'Cancelled' ELSE 'Complete' END AS status FROM orders")
def _(spark, d):
    s = F.when(F.col("o_orderstatus") == "O", "Running").when(F.col("o_orderstatus") == "P", "Queued").otherwise("Complete")
    return table(spark, d, "orders").select("o_orderkey", store.recover(s).alias("status"))


@query("dm_translation_upsert", "SELECT doc_id, lang, md5(text) AS hash, doc_id % 3 <> 0 AS hit FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("hash"))
    old = docs.select("doc_id", "lang", F.when(F.col("doc_id") % 3 == 0, "stale").otherwise(F.col("hash")).alias("old"))
    j = docs.join(old, ["doc_id", "lang"], "left")
    return j.select("doc_id", "lang", "hash", F.coalesce(F.col("hash") == F.col("old"), F.lit(False)).alias("hit"))


_ROUTE = "CASE WHEN p < 0.6::DOUBLE THEN 'keep' WHEN lang IN ('en', 'fr') THEN 'override' ELSE 'suggest' END"


@query("dm_lid_routing", f"SELECT doc_id, {_ROUTE} AS action FROM (SELECT doc_id, lang, (n_chars % 100) / 100.0::DOUBLE AS p FROM documents)")
def _(spark, d):
    p = F.col("n_chars") % 100 / F.lit(100.0)
    return table(spark, d, "documents").select("doc_id", store.route_language(F.col("lang"), p, F.col("lang").isin("en", "fr")).alias("action"))


@base_query("dm_lid_per_segment", "SELECT result_id, CASE WHEN end_time - start_time < 2 THEN 'en' ELSE lower(language) END AS lang FROM results")
def _(spark, d):
    return results(spark, d).select("result_id", F.when(F.col("end_time") - F.col("start_time") < 2, "en").otherwise(F.lower("language")).alias("lang"))


@query("dm_lid_escalation", "SELECT event_id, CASE WHEN value < 1 THEN NULL WHEN (event_id % 100) / 100.0::DOUBLE < 0.6::DOUBLE AND value >= 60 THEN 'long' ELSE 'short' END AS used FROM events")
def _(spark, d):
    p = F.col("event_id") % 100 / F.lit(100.0)
    return table(spark, d, "events").select("event_id", F.when(F.col("value") >= 1, F.when((p < 0.6) & (F.col("value") >= 60), "long").otherwise("short")).alias("used"))


@query("dm_banner_state", "SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'forced' WHEN bool_or(event_type = 'view') THEN 'mismatch' WHEN bool_or(event_type = 'click') THEN 'drift' ELSE 'none' END AS banner FROM events WHERE value > 50 GROUP BY user_id")
def _(spark, d):
    has = lambda k: F.bool_or(F.col("event_type") == k)
    return table(spark, d, "events").where("value > 50").groupBy("user_id").agg(store.banner(has("error"), has("view"), has("click")).alias("banner"))


@base_query("st_resume", "SELECT result_id FROM results WHERE result_id NOT IN (SELECT result_id FROM results WHERE turn % 3 = 0)")
def _(spark, d):
    r = results(spark, d).select("result_id", "turn")
    return r.join(r.where("turn % 3 = 0"), "result_id", "left_anti").select("result_id")


@base_query("st_fixed_chunk", "SELECT audio_id, frame // 16 AS chunk, count(*) AS n, round(avg(p), 9) AS p FROM frames GROUP BY ALL")
def _(spark, d):
    return frames(spark, d).groupBy("audio_id", F.floor(F.col("frame") / 16).alias("chunk")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 9).alias("p"))


@query("st_sliding_chunk", "WITH w AS (SELECT event_type, value, to_timestamp((floor(epoch(ts) / 1800) - k) * 1800) AS st FROM events, range(0, 2) r(k)) SELECT event_type, strftime(st AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS st, count(*) AS n FROM w GROUP BY ALL")
def _(spark, d):
    w = table(spark, d, "events").groupBy("event_type", F.window("ts", "60 minutes", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return w.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("st"), "n")


@query("st_session_like", "WITH c AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS c FROM events), s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM c) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS st, count(*) AS n FROM s GROUP BY user_id, s")
def _(spark, d):
    w = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("st"), "n")
