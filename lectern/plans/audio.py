"""Queries on signals, decoding and stateful operators; their results are held against plain folds in the tests."""

from __future__ import annotations

import io
import re
import wave
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lectern import scratch
from lectern.functions import audio
from lectern.operators import decoding, kneser_ney, ranking, scorers
from lectern.session import table
from lectern.sources import exports, readers
from lectern.streaming import stateful

from .base import base_query, frames, speaker_frames
from .registry import query


def _signals(spark, d):
    """A recording per user: its values in order, scaled."""
    e = table(spark, d, "events").select(F.col("user_id").alias("audio_id"), F.struct("ts", "event_id", (F.col("value") / F.lit(100.0) - 0.5).alias("x")).alias("s"))
    g = e.groupBy("audio_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return g.select("audio_id", F.transform("s", lambda s: s["x"]).alias("x"))


def _feature(spark, d, fn):
    """Mean and frames of a feature of each recording, its samples held for 40 ticks."""

    def run(batches):
        for pdf in batches:
            out = [fn(np.repeat(np.asarray(x, float), 40)) for x in pdf["x"]]
            yield pd.DataFrame({"audio_id": pdf["audio_id"], "n": [len(o) for o in out], "mean": [round(float(o.mean()), 6) if o.size else 0.0 for o in out]})

    return _signals(spark, d).mapInPandas(run, "audio_id long, n long, mean double")


@query("ma_stft_logmel")
def _(spark, d):
    return _feature(spark, d, audio.log_mel)


@query("ma_logmel_whisper")
def _(spark, d):
    return _feature(spark, d, audio.log_mel_clamped)


@query("ma_fbank_kaldi")
def _(spark, d):
    return _feature(spark, d, audio.filter_bank)


@query("ma_biquad_cleanup")
def _(spark, d):
    return _feature(spark, d, audio.clean_up)


@query("ma_resample_16k")
def _(spark, d):
    return _feature(spark, d, lambda x: audio.resample(x, 22050))


def _scores(spark, d):
    """Recorded scores: an embedding is a frame, whose first 59 values are of tokens and the others of durations 0 to 4."""
    e = table(spark, d, "embeddings")
    return e.select((F.col("vec_id") % 20).alias("audio_id"), F.col("vec_id").alias("frame"), F.slice("embedding", 1, 59).alias("tokens"), F.slice("embedding", 60, 5).alias("durations"))


@query("de_tdt_greedy", """WITH RECURSIVE f AS (SELECT vec_id % 20 AS audio_id, row_number() OVER (PARTITION BY vec_id % 20 ORDER BY vec_id) - 1 AS t, embedding[1:59] AS x, embedding[60:64] AS y FROM embeddings),
b AS (SELECT audio_id, t, list_position(x, list_max(x)) - 1 AS k, list_position(y, list_max(y)) - 1 AS far FROM f),
v AS (SELECT audio_id, t, k, far FROM b WHERE t = 0 UNION ALL SELECT b.audio_id, b.t, b.k, b.far FROM v JOIN b ON b.audio_id = v.audio_id AND b.t = v.t + greatest(1, v.far)),
s AS (SELECT audio_id, t, CASE WHEN k = 0 THEN NULL WHEN far = 0 THEN array_to_string(list_transform(range(10), lambda i: k), ' ') ELSE k::VARCHAR END AS said FROM v)
SELECT audio_id, coalesce(string_agg(said, ' ' ORDER BY t), '') AS text FROM s GROUP BY audio_id""")
def _(spark, d):
    return decoding.decode(_scores(spark, d), "audio_id", "frame", "tokens", "durations", 0)


@query("de_tdt_beam")
def _(spark, d):
    """With a model of what the recordings say by the best token of each frame: its grams number at most the square of the tokens."""
    s = _scores(spark, d)
    best = F.array_position(F.transform("tokens", lambda x: x), F.array_max("tokens")) - 1
    said = s.groupBy("audio_id").agg(F.array_sort(F.collect_list(F.struct("frame", best.alias("k")))).alias("s"))
    words = F.transform("s", lambda x: x["k"].cast("string"))
    lm = kneser_ney.estimate(kneser_ney.gram_counts(said, words, 2), 2, (0, 0))
    grams = {r["gram"]: (r["logp"], r["backoff"]) for r in lm.collect()}
    return decoding.decode(s, "audio_id", "frame", "tokens", "durations", 0, 4, decoding.Backoff(grams, 2, grams["<unk>"][0]), 0.5, 0.2)


@query("js_char_token_map")
def _(spark, d):
    said = F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]"))
    e = table(spark, d, "events").select("event_id", said.alias("said"))
    pieces = F.split("said", "(?<=[:,])")
    lps = F.transform(pieces, lambda p: -F.length(p) / F.lit(10.0))
    return e.select("event_id", F.array_join(F.transform(decoding.segment_logprobs("said", pieces, lps), lambda x: F.round(x, 6).cast("string")), ",").alias("means"))


@base_query("st_progress_reducer", "WITH a AS (SELECT audio_id, frame, spk, p, sum(CASE WHEN spk = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY audio_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS ep FROM frames), l AS (SELECT audio_id, max(ep) AS ep FROM a GROUP BY audio_id) SELECT l.audio_id, coalesce((SELECT max(p) FROM a WHERE a.audio_id = l.audio_id AND a.ep = l.ep AND spk IN ('view', 'click')), 0) AS percent, (SELECT count(DISTINCT p) FROM a WHERE a.audio_id = l.audio_id AND spk = 'error') AS segments FROM l")
def _(spark, d):
    kind = F.when(F.col("spk") == "signup", "load").when(F.col("spk").isin("view", "click"), "percent").when(F.col("spk") == "error", "segment").otherwise("none")
    g = frames(spark, d).groupBy("audio_id").agg(F.array_sort(F.collect_list(F.struct("frame", kind.alias("kind"), F.col("p").alias("value")))).alias("a"))
    s = g.select("audio_id", decoding.progress(F.col("a")).alias("s"))
    return s.select("audio_id", "s.percent", F.size("s.segments").cast("long").alias("segments"))


@query("st_sortformer_cache")
def _(spark, d):
    """The cache of each recording after all its frames have come as a stream, in three micro-batches."""
    f = speaker_frames(spark, d)
    states = stateful.drained(f, lambda s: stateful.stream_cache(s, cache=32, queue=16), "frame", 3, "update")
    last = states.groupBy("audio_id").agg(F.max_by(F.struct("cached", "queued", "silent", "p_sum", "x_sum"), "batch").alias("s"))
    return last.select("audio_id", "s.*")


_STREAMED = "state AS (SELECT audio_id, frame, coalesce(last_value(CASE WHEN p >= 0.641::DOUBLE THEN true WHEN p < 0.561::DOUBLE THEN false END IGNORE NULLS) OVER (PARTITION BY audio_id ORDER BY frame ROWS UNBOUNDED PRECEDING), false) AS active FROM frames), r AS (SELECT *, frame - row_number() OVER (PARTITION BY audio_id, active ORDER BY frame) AS g FROM state), s AS (SELECT audio_id, min(frame) AS a, max(frame) + 1 AS b FROM r WHERE active GROUP BY audio_id, g), n AS (SELECT audio_id, count(*) AS seen FROM frames GROUP BY audio_id)"


@base_query("st_incremental_segments", f"WITH {_STREAMED} SELECT s.audio_id, a, b FROM s JOIN n USING (audio_id) WHERE b <= seen - 5")
def _(spark, d):
    """Segments of a stream in four micro-batches, each emitted once, when later frames can't change it any more."""
    f = frames(spark, d).select("audio_id", "frame", "p")
    out = stateful.drained(f, lambda s: stateful.stream_segments(s, frame=1.0, half=5), "frame", 4)
    return out.select("audio_id", F.col("start").cast("long").alias("a"), F.col("end").cast("long").alias("b"))


def _transcripts(spark, d):
    from .store import transcript

    return exports.office_files(transcript(spark, d), "audio_id")


def _entries(spark, d, column, name, pattern):
    """How often a pattern occurs in a part of each file."""

    def run(batches):
        for pdf in batches:
            found = [zipfile.ZipFile(io.BytesIO(b)).read(name).decode() for b in pdf[column]]
            yield pd.DataFrame({"audio_id": pdf["audio_id"], "n": [len(re.findall(pattern, x)) for x in found]})

    return _transcripts(spark, d).mapInPandas(run, "audio_id long, n long")


@base_query("snk_xlsx", "SELECT audio_id, count(*) + 1 AS n FROM cards WHERE NOT suppressed GROUP BY audio_id")
def _(spark, d):
    return _entries(spark, d, "xlsx", "xl/worksheets/sheet1.xml", "<row>")


@base_query("snk_docx", "SELECT audio_id, 2 * count(*) AS n FROM cards WHERE NOT suppressed GROUP BY audio_id")
def _(spark, d):
    return _entries(spark, d, "docx", "word/document.xml", "<w:p>")


@query("src_arpa_lm", "SELECT 1 AS ord, p_partkey::VARCHAR AS gram, -(p_size / 10.0::DOUBLE) AS logp, -0.5::DOUBLE AS backoff FROM part WHERE p_partkey < 16384 UNION ALL SELECT 0, '', -9.0, 0")
def _(spark, d):
    p = table(spark, d, "part")
    lines = p.select((F.col("p_partkey") + 10).alias("pos"), F.concat_ws("\t", (-(F.col("p_size") / F.lit(10.0))).cast("string"), F.col("p_partkey").cast("string"), F.lit("-0.5")).alias("line"))
    head = spark.createDataFrame([(0, "\\data\\"), (1, "\\1-grams:"), (2, "-9.0\t<unk>"), (3, "-1.0\t<s>\t-0.2")], "pos long, line string")
    e = readers.arpa_entries(head.union(lines))
    return e.select("order", F.array_join(F.transform("gram", lambda x: x.cast("string")), " ").alias("gram"), "logp", "backoff").withColumnRenamed("order", "ord")


@query("bat_oom_halving", "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def _(spark, d):
    """A scorer that takes no more than three items at once, asked with sixteen."""

    def make():
        def scorer(items):
            if len(items) > 3:
                raise MemoryError
            return [np.array([x.sum()]) for x in items]

        return scorer

    return scorers.score(table(spark, d, "embeddings"), "vec_id", "embedding", make).select("vec_id", F.round(F.col("scores")[0], 6).alias("total"))


def energy():
    """A stand-in model whose state is a running mean of the windows' energy."""

    def step(w, state):
        state = 0.9 * state + 0.1 * np.array([np.mean(w * w)])
        return float(state[0]), state

    return step


@base_query("st_vad_recurrent", """WITH RECURSIVE s AS (SELECT audio_id, frame * 40 + k AS j, value / 100.0::DOUBLE - 0.5::DOUBLE AS x FROM frames, range(0, 40) r(k)),
n AS (SELECT audio_id, count(*) // 512 AS windows FROM s GROUP BY audio_id),
m AS MATERIALIZED (SELECT audio_id, win, sum(x * x) / 576 AS m FROM (SELECT audio_id, j // 512 AS win, x FROM s UNION ALL SELECT audio_id, j // 512 + 1, x FROM s WHERE j % 512 >= 448) t JOIN n USING (audio_id) WHERE win < windows GROUP BY audio_id, win),
v(audio_id, win, p) AS (SELECT audio_id, win, 0.1::DOUBLE * m FROM m WHERE win = 0 UNION ALL SELECT m.audio_id, m.win, 0.9::DOUBLE * v.p + 0.1::DOUBLE * m.m FROM v JOIN m ON m.audio_id = v.audio_id AND m.win = v.win + 1)
SELECT audio_id, win AS window, round(p, 7) AS p FROM v""")
def _(spark, d):
    """Scores of a signal that comes as a stream, 40 samples a row, in three micro-batches."""
    x = (F.col("value") / F.lit(100.0)) - 0.5
    f = frames(spark, d).select("audio_id", F.col("frame").alias("pos"), F.array_repeat(x, 40).alias("x"))
    return stateful.drained(f, lambda s: stateful.stream_scores(s, energy, [0.0]), "pos", 3).select("audio_id", "window", F.round("p", 7).alias("p"))


@query("st_continuous_batch", """WITH RECURSIVE c AS (SELECT conv_id, turn, len(string_split(text, ' ')) AS steps, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
v(conv_id, turn, i, slot, enters, leaves, a, b, c) AS (
  SELECT DISTINCT conv_id, NULL::BIGINT, 0::BIGINT, 0, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM c
  UNION ALL SELECT conv_id, turn, i, slot, least(a, b, c), least(a, b, c) + steps, CASE slot WHEN 0 THEN a + steps ELSE a END, CASE slot WHEN 1 THEN b + steps ELSE b END, CASE slot WHEN 2 THEN c + steps ELSE c END
  FROM (SELECT v.conv_id, x.turn, x.i, x.steps, v.a, v.b, v.c, CASE WHEN v.a <= v.b AND v.a <= v.c THEN 0 WHEN v.b <= v.c THEN 1 ELSE 2 END AS slot FROM v JOIN c x ON x.conv_id = v.conv_id AND x.i = v.i + 1)
)
SELECT conv_id, turn, slot::BIGINT AS slot, enters, leaves FROM v WHERE i > 0""")
def _(spark, d):
    """Turns of a recording decoded in a batch of three: a turn takes a step a token, and the next one has its place as soon
    as it ends. Only the schedule; there is no device to run it."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.size(F.split("text", " ")).cast("long").alias("steps"))
    return ranking.continuous_batch(c, "conv_id", "turn", "steps", 3)


def wav_bytes(x: np.ndarray, rate: int, channels: int) -> bytes:
    """A WAV file of 16 bits, the same samples in every channel."""
    f = io.BytesIO()
    with wave.open(f, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.repeat((np.clip(x, -1, 1) * 32767).astype("<i2"), channels).tobytes())
    return f.getvalue()


def _audio_files(spark, d):
    """A file for each signal: mono, stereo at half the rate, or none that is audio."""

    def run(batches):
        for pdf in batches:
            made = [(f"{a}.wav", b"no audio" if a % 3 == 2 else wav_bytes(np.asarray(x, float), 16000 // (1 + a % 3), 1 + int(a % 3))) for a, x in zip(pdf["audio_id"], pdf["x"], strict=True)]
            yield pd.DataFrame(made, columns=["path", "content"])

    return _signals(spark, d).mapInPandas(run, "path string, content binary")


_FILES = "f AS (SELECT user_id AS a, user_id || '.wav' AS path, count(*) AS n FROM events GROUP BY user_id)"


@query("src_audio_file", f"WITH {_FILES} SELECT path, CASE WHEN a % 3 < 2 THEN 16000 // (1 + a % 3) END::INT AS rate, CASE WHEN a % 3 < 2 THEN 1 + a % 3 END::INT AS channels, CASE WHEN a % 3 < 2 THEN n END AS n FROM f")
def _(spark, d):
    """Files written from the signals, then decoded; n counts what was decoded."""
    x = readers.read_stream(_audio_files(spark, d), 0)
    return x.select("path", "rate", "channels", (F.when(F.col("samples").isNotNull(), F.size("samples")) / F.col("channels")).cast("long").alias("n"))


@query("src_audio_stream", f"WITH {_FILES} SELECT path, a % 2 AS stream, CASE WHEN a % 6 IN (0, 4) THEN n END AS n, round(CASE WHEN a % 6 IN (0, 4) THEN (SELECT sum(trunc(least(1, greatest(-1, value / 100.0::DOUBLE - 0.5::DOUBLE)) * 32767)) FROM events WHERE user_id = a) END / 32768, 6) AS total FROM f")
def _(spark, d):
    """The first or the second stream of each file; there is no second one."""
    files = _audio_files(spark, d)
    index = F.substring_index("path", ".", 1).cast("long") % 2
    x = readers.read_stream(files, index.cast("int"))
    total = F.aggregate("samples", F.lit(0.0), lambda s, v: s + v) / F.col("channels")
    return x.select("path", index.alias("stream"), (F.size("samples") / F.col("channels")).cast("long").alias("n"), F.round(total, 6).alias("total"))


@query("src_probe_streams", f"WITH {_FILES} SELECT path, 0 AS stream, 'pcm_16' AS codec, (16000 // (1 + a % 3))::INT AS rate, (1 + a % 3)::INT AS channels, n AS frames FROM f WHERE a % 3 < 2")
def _(spark, d):
    return readers.audio_streams(_audio_files(spark, d))


_KN = """s AS (SELECT list_filter(string_split_regex(lower(text), '[ \t\n\r\f]+'), lambda x: x <> '') AS w FROM conversations WHERE text IS NOT NULL),
p AS (SELECT list_concat(list_concat(['<s>'], w), ['</s>']) AS w FROM s),
g AS (SELECT n AS ord, array_to_string(w[i:i + n - 1], ' ') AS gram FROM p, (SELECT unnest([1, 2, 3, 4]) AS n) o, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) q),
raw AS MATERIALIZED (SELECT ord, gram, count(*) AS n FROM g GROUP BY ord, gram),
adj AS MATERIALIZED (SELECT x.ord, x.gram, x.a, r.n > [0, 0, 1, 1][x.ord] AS kept FROM (SELECT ord, gram, n AS a FROM raw WHERE (ord = 4 OR gram LIKE '<s>%') AND gram <> '<s>'
  UNION ALL SELECT ord - 1, regexp_replace(gram, '^[^ ]+ ', ''), count(*) FROM raw WHERE ord > 1 GROUP BY 1, 2) x JOIN raw r ON r.ord = x.ord AND r.gram = x.gram),
t AS (SELECT ord, count(*) FILTER (WHERE a = 1)::DOUBLE AS t1, count(*) FILTER (WHERE a = 2)::DOUBLE AS t2, count(*) FILTER (WHERE a = 3)::DOUBLE AS t3, count(*) FILTER (WHERE a = 4)::DOUBLE AS t4 FROM adj GROUP BY ord),
y AS (SELECT *, t1 / (t1 + 2 * t2) AS y FROM t),
dd AS (SELECT ord, least(t1, t2, t3, t4) AS least_t, 1 - 2 * y * t2 / t1 AS d1, 2 - 3 * y * t3 / t2 AS d2, 3 - 4 * y * t4 / t3 AS d3 FROM y),
d AS (SELECT ord, CASE WHEN ok THEN d1 ELSE 0.5 END AS d1, CASE WHEN ok THEN d2 ELSE 1.0 END AS d2, CASE WHEN ok THEN d3 ELSE 1.5 END AS d3 FROM (SELECT *, coalesce(least_t > 0 AND least(d1, d2, d3) >= 0 AND d1 <= 1 AND d2 <= 2 AND d3 <= 3, false) AS ok FROM dd)),
k AS MATERIALIZED (SELECT adj.ord, gram, kept, a::DOUBLE AS a, CASE a WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS d, regexp_replace(gram, ' ?[^ ]+$', '') AS head FROM adj JOIN d USING (ord)),
c AS MATERIALIZED (SELECT ord, head, sum(CASE WHEN kept THEN d ELSE a END) / sum(a) AS gamma, sum(a) AS total FROM k GROUP BY ord, head),
z AS (SELECT gamma / (SELECT count(*) + 1 FROM k WHERE ord = 1) AS least FROM c WHERE ord = 1),
u AS MATERIALIZED (SELECT k.ord, gram, regexp_replace(gram, '^[^ ]+ ?', '') AS tail, (a - d) / total AS u, gamma FROM k JOIN c ON c.ord = k.ord AND c.head = k.head WHERE kept),
p1 AS MATERIALIZED (SELECT gram, u + least AS p FROM u, z WHERE ord = 1 UNION ALL SELECT '<unk>', least FROM z),
p2 AS MATERIALIZED (SELECT u.gram, u + gamma * p AS p FROM u JOIN p1 ON p1.gram = tail WHERE ord = 2),
p3 AS MATERIALIZED (SELECT u.gram, u + gamma * p AS p FROM u JOIN p2 ON p2.gram = tail WHERE ord = 3),
p4 AS (SELECT u.gram, u + gamma * p AS p FROM u JOIN p3 ON p3.gram = tail WHERE ord = 4),
l AS (SELECT 1 AS ord, gram, log10(p) AS logp FROM p1 UNION ALL SELECT 1, '<s>', 0 UNION ALL SELECT 2, gram, log10(p) FROM p2 UNION ALL SELECT 3, gram, log10(p) FROM p3 UNION ALL SELECT 4, gram, log10(p) FROM p4)"""


@query("snk_arpa", f"WITH {_KN} SELECT l.ord::BIGINT AS ord, gram, round(logp, 6) AS logp, round(coalesce(log10(c.gamma), 0), 6) AS backoff FROM l LEFT JOIN c ON c.ord = l.ord + 1 AND c.head = l.gram")
def _(spark, d):
    """A model of order 4 estimated, written as an ARPA file and read back."""
    words = F.split(F.lower("text"), "[ \t\n\r\f]+")
    lm = kneser_ney.estimate(kneser_ney.gram_counts(table(spark, d, "conversations"), words, 4), 4, (0, 0, 1, 1))
    at = scratch.new_path(spark)
    exports.arpa(kneser_ney.arpa_lines(lm, 4), at)
    return readers.arpa_words(spark, at).select(F.col("order").cast("long").alias("ord"), "gram", F.round("logp", 6).alias("logp"), F.round("backoff", 6).alias("backoff"))
