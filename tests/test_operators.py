"""Operators on small inputs worked out by hand, and against plain folds."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import audio, text, times
from lectern.operators import clustering, decoding, evaluation, joins, ranges, ranking, sequence, store
from lectern.sources import exports, readers


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# --- sequences --------------------------------------------------------------------------------------------------


def plain_hysteresis(ps, onset=0.641, offset=0.561):
    out, on = [], False
    for p in ps:
        on = True if p >= onset else False if p < offset else on
        out.append(on)
    return out


def test_hysteresis_equals_a_fold(spark):
    r = random.Random(3)
    series = {k: [round(r.random(), 3) for _ in range(r.randint(1, 60))] for k in range(20)}
    df = spark.createDataFrame([(k, i, p) for k, ps in series.items() for i, p in enumerate(ps)], "k long, i long, p double")
    got = sequence.hysteresis(df, ["k"], ["i"], "p")
    for k, ps in series.items():
        assert [x[0] for x in rows(got.where(f"k = {k}").orderBy("i").select("active"))] == plain_hysteresis(ps)


def test_gap_of_exactly_the_limit_stays(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.296, 2.0), (1, 2.2, 3.0)], "k long, start double, end double")
    assert rows(sequence.merge_gaps(df, ["k"]), "start") == [(1, 0.0, 1.0, 1), (1, 1.296, 3.0, 2)]


def test_short_runs_and_gaps(spark):
    flags = [0, 1, 1, 1, 0, 0, 1, 1, 1, 0, 0, 0, 1, 1, 0]
    df = spark.createDataFrame([(1, i, bool(f)) for i, f in enumerate(flags)], "k long, i long, on boolean")
    r = sequence.merge_runs(sequence.fill_gaps(df, ["k"], "i", "on"), ["k"], "on")
    assert rows(r.select("on", "first", "last", "n"), "first") == [(False, 0, 0, 1), (True, 1, 8, 8), (False, 9, 11, 3), (True, 12, 13, 2), (False, 14, 14, 1)]
    assert [x[0] for x in rows(sequence.drop_short_runs(r, "on").orderBy("first").select("on"))] == [False, True, False, False, False]


def test_reflected_median_of_short_streams(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (2, 0, 0.1), (2, 1, 0.9)], "k long, i long, p double")
    got = {(k, i): m for k, i, m in rows(sequence.median_reflected(df, ["k"], "i", "p").select("k", "i", "median"))}
    assert got[1, 0] == 0.5 and set(got) == {(1, 0), (2, 0), (2, 1)}


def test_vad_rules():
    on, off, mid = [0.9], [0.1], [0.4]
    w = 512 / 16000
    assert sequence.vad_fold([]) == []
    assert sequence.vad_fold(on * 10 + off * 10) == [(0.0, pytest.approx(10 * w + 0.03))]
    assert sequence.vad_fold(off * 2 + on * 10) == [(pytest.approx(2 * w - 0.03), 12 * w)]  # open at the end: no pad after
    assert len(sequence.vad_fold(on * 10 + off * 2 + on * 10 + off * 10)) == 1  # the pending end is cancelled
    assert sequence.vad_fold(mid * 30) == [] and sequence.vad_fold(on * 5 + off * 10) == []


def test_min_span_groups(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (1, 2.5, 4.9), (1, 5.0, 5.5), (1, 6.0, 7.0), (2, 0.0, 1.0)], "k long, start double, end double")
    got = rows(sequence.min_span_groups(df, "k", 5.0), "k", "grp")
    assert got == [(1, 0, 0.0, 7.0, 4), (2, 0, 0.0, 1.0, 1)]  # a short rest joins the group before; a lone short group stays


# --- joins ------------------------------------------------------------------------------------------------------


def test_interval_joins_equal_brute_force(spark):
    r = random.Random(5)
    span = lambda: (s := round(r.uniform(0, 60), 2), round(s + r.uniform(0, 15), 2))
    a = [(1, i, *span()) for i in range(40)]
    b = [(1, i, *span()) for i in range(25)]
    A, B = (spark.createDataFrame(x, f"k long, {n} long, start double, end double") for x, n in ((a, "i"), (b, "j")))
    want = {}
    for _, i, s, e in a:
        over = [(min(e, y) - max(s, x), -j) for _, j, x, y in b]
        best = max(over)
        want[i] = (-best[1], "overlap") if best[0] > 0 else (min((abs((s + e) / 2 - (x + y) / 2), j) for _, j, x, y in b)[1], "nearest")
    got = {i: (j, how) for _, i, j, how in rows(joins.assign_speakers(A, B, "k", "i", "j"))}
    assert got == want


def test_overlap_ties_go_to_the_first(spark):
    a = spark.createDataFrame([(1, 0, 0.0, 10.0)], "k long, i long, start double, end double")
    b = spark.createDataFrame([(1, 7, 5.0, 8.0), (1, 3, 1.0, 4.0)], "k long, j long, start double, end double")
    assert rows(joins.max_overlap(a, b, "k", "i", "j")) == [(1, 0, 3, 3.0)]


# --- texts, times, exports --------------------------------------------------------------------------------------


def test_times(spark):
    one = spark.range(1)
    v = one.select(times.hms(F.lit(59.999)), times.hms(F.lit(3723.5)), times.srt(F.lit(90000.0)), times.srt(F.lit(90000.0), True), times.hhmmss(F.lit(86401.9), True), times.hhmmss_rounded(F.lit(2.5))).first()
    assert tuple(v) == ("00:60.00", "1:02:03.50", "25:00:00,000", "01:00:00,000", "00:00:01", "00:00:02")


def test_text_functions(spark):
    df = spark.createDataFrame([("HELLO <COMMA> WORLD <SIL> YES <PERIOD>", "Mr. Smith went. He ran! ok\n\nNew one", "a b  c")], "a string, b string, c string")
    v = df.select(text.tagged_norm(F.col("a")), text.sentences(F.col("b")), text.squash(F.col("c")), text.split_by_ratio(F.lit("one two three"), F.lit(1), F.lit(2))).first()
    assert v[0] == "Hello, world yes."
    assert v[1] == ["Mr.", "Smith went.", "He ran! ok", "New one"]
    assert v[2] == "a b c" and tuple(v[3]) == ("one", "two three")
    empty = spark.createDataFrame([("<SIL>",)], "a string").select(text.tagged_norm(F.col("a"))).first()[0]
    assert empty is None


def test_byte_level_round_trip(spark):
    back = {b: c for c, b in text.byte_characters().items()}
    s = "héllo wörld 日本"
    token = "".join(back[b] for b in s.encode())
    assert spark.createDataFrame([(token,)], "t string").select(text.from_byte_level(F.col("t"))).first()[0] == s


def test_csv_and_free_name(spark):
    df = spark.createDataFrame([('a "b"', ), ("plain",)], "t string")
    assert [x[0] for x in df.select(exports.csv_field(F.col("t"))).collect()] == ['"a ""b"""', "plain"]
    taken = spark.createDataFrame([("out.txt",), ("out_1.txt",), ("out_3.txt",)], "name string")
    assert exports.free_name(taken, "out", "txt") == "out_2.txt" and exports.free_name(taken, "new", "txt") == "new.txt"


def test_readers(spark, tmp_path):
    import gzip
    import wave

    (tmp_path / "s.json").write_text('[{"start": 2.0, "end": 3.0}, {"start": 0.5, "end": 1.0, "speaker": "speaker_1"}]')
    assert rows(readers.segments_json(spark, str(tmp_path / "s.json"))) == [(0.5, 1.0, "speaker_1"), (2.0, 3.0, "speaker_0")]
    arpa = "\\data\\\nngram 1=3\nngram 2=1\n\n\\1-grams:\n-9.0\t<unk>\n-1.5\t5\t-0.25\n-2.0\t99999\n\n\\2-grams:\n-0.5\t5 5\n\n\\end\\\n"
    with gzip.open(tmp_path / "lm.arpa.gz", "wt") as f:
        f.write(arpa)
    got = rows(readers.arpa(spark, str(tmp_path / "lm.arpa.gz")), "order")
    assert got == [(0, [], -9.0, 0.0), (1, [5], -1.5, -0.25), (2, [5, 5], -0.5, 0.0)]
    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(16000)
        f.writeframes(np.array([0, 16384, -32768], "<i2").tobytes())
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    w = {r["path"].rsplit("/", 1)[1]: r for r in readers.wav(spark, str(tmp_path / "*.wav")).collect()}
    assert w["a.wav"]["samples"] == [0.0, 0.5, -1.0] and w["bad.wav"]["rate"] is None


# --- store ------------------------------------------------------------------------------------------------------


def test_a_source_without_durations_empties_them(spark):
    r = spark.createDataFrame([(1, [1, 2, 3], [0, 3, 6], [-0.1, -0.2, -0.3], [1, 1, 1], " one ", None), (2, [4, 5], [0, 3], [-0.4, -0.5], None, "two", "fr")], "result_id int, tokens array<int>, timestamps array<int>, logprobs array<double>, durations array<int>, asr_content string, language string")
    s = spark.createDataFrame([(9, 2, 0, None, 10, 1), (9, 1, 1, 3, 0, 0)], "card_id int, result_id int, token_start int, token_end int, ts_frame_offset int, source_order int")
    c = store.aggregate_cards(s, r).first()
    assert (c.tokens, c.timestamps, c.durations, c.text, c.language) == ([2, 3, 4, 5], [3, 6, 10, 13], [], "one two", "fr")


def test_split_then_merge_keeps_tokens(spark):
    c = spark.createDataFrame([(1, 0.0, 4.0, [5, 6, 7, 8], [0, 10, 20, 30])], "card_id int, play_start double, play_end double, tokens array<int>, timestamps array<int>")
    h = rows(store.split_card(c, F.lit(2)), "part")
    assert h == [(1, 0, 0.0, 1.6, [5, 6], [0, 10]), (1, 1, 1.6, 4.0, [7, 8], [0, 10])]
    pair = store.split_card(c, F.lit(2)).groupBy("card_id").agg(*[F.max(F.when(F.col("part") == p, F.struct("card_id", "play_start", "play_end", "tokens", "timestamps", F.lit("x").alias("text")))).alias(n) for p, n in ((0, "a"), (1, "b"))])
    m = pair.select(*store.merge_pair("a", "b")).first()
    assert (m.tokens, m.timestamps, m.play_end) == ([5, 6, 7, 8], [0, 10, 20, 30], 4.0)


def test_merged_ranges(spark):
    s = spark.createDataFrame([(1, 5, 0, 4, 0), (1, 5, 4, None, 1), (1, 6, 0, 2, 2), (1, 6, 2, 5, 3)], "card_id int, result_id int, token_start int, token_end int, source_order int")
    assert rows(store.merge_source_ranges(s), "result_id") == [(1, 5, 0, None, 0), (1, 6, 0, 5, 2)]


def test_migration_runs_once(spark):
    r = spark.createDataFrame([(1, 1, 0.0, 1.0)], "result_id int, speaker_id int, start_time double, end_time double")
    none = spark.createDataFrame([], "card_id int, speaker_id int, play_start double, play_end double, content string")
    once = store.migrate_cards(r, none)
    assert rows(once) == [(1, 1, 0.0, 1.0, None)] and rows(store.migrate_cards(r.union(r), once)) == rows(once)


# --- ranking, evaluation, clustering ----------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_edits_equal_levenshtein(a, b):
    s, d, i = evaluation.edits(a, b)
    table = [[max(x, y) if not x or not y else 0 for y in range(len(b) + 1)] for x in range(len(a) + 1)]
    for x in range(1, len(a) + 1):
        for y in range(1, len(b) + 1):
            table[x][y] = min(table[x - 1][y] + 1, table[x][y - 1] + 1, table[x - 1][y - 1] + (a[x - 1] != b[y - 1]))
    assert s + d + i == table[-1][-1] and len(a) - d + i == len(b)


def test_prf_of_empty_sets(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b"])], "g array<string>, p array<string>")
    assert [tuple(r[0]) for r in df.select(evaluation.prf(F.col("g"), F.col("p"))).collect()] == [(1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (1.0, 0.5, pytest.approx(2 / 3))]


def test_batches_hold_every_item(spark):
    df = spark.createDataFrame([(1, i, float(i % 9 + 1)) for i in range(40)], "k int, i int, n double")
    got = rows(ranking.plan_batches(df, ["k"], "n", "i", 6, 20.0), "batch")
    assert sum(r[2] for r in got) == 40 and all(r[2] == 1 or (r[2] <= 6 and r[2] * r[3] <= 20) for r in got)


def test_linkage_and_cut():
    x = np.array([[0.0, 0], [0, 1], [10, 0], [10, 1], [50, 50]])
    m = clustering.linkage(x)
    assert clustering.cut(m, 5, distance=2).tolist() == [0, 0, 1, 1, 2] and clustering.cut(m, 5, clusters=2).tolist() == [0, 0, 0, 0, 1]
    assert clustering.linkage(x[:1]).shape == (0, 4)


def test_vbx_keeps_clear_clusters():
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(0, 0.1, (20, 4)) + [3, 0, 0, 0], r.normal(0, 0.1, (20, 4)) - [3, 0, 0, 0]])
    g = clustering.vbx(x, np.ones(4) * 5, np.eye(2)[[0] * 20 + [1] * 20] + 0.1)
    assert (g.argmax(1) == [0] * 20 + [1] * 20).all()


def test_unique_assignment():
    assert clustering.best_unique(np.array([[0.9, 0.8], [0.85, 0.1]])) == [1, 0]
    assert sorted(clustering.best_unique(np.array([[0.9], [0.8]]))) == [-1, 0]


def test_backoff(spark):
    lm = spark.createDataFrame([("c", -1.0, -0.1), ("b", -1.5, -0.2), ("b c", -0.4, -0.3), ("a b", -0.6, -0.7)], "gram string, logp double, backoff double")
    q = spark.createDataFrame([(1, "a b c"), (2, "x b c"), (3, "a b z"), (4, "x y c")], "id int, gram string")
    got = dict(rows(clustering.backoff_scores(q, lm, -9.0, 3)))
    assert got == {1: pytest.approx(-0.4 - 0.7), 2: pytest.approx(-0.4), 3: -9.0, 4: -1.0}


def test_decoders():
    a = np.full((4, 3), -9.0)
    a[[0, 1, 2, 3], [1, 0, 2, 0]] = 0
    d = np.full((4, 3), -9.0)
    d[:, 1] = 0
    step = decoding.recorded(a, d)
    assert [x[:2] for x in decoding.tdt_greedy(step, 4, 0)] == [(0, 1), (2, 2)] and decoding.tdt_beam(step, 4, 0) == [1, 2]


def test_features():
    x = np.sin(np.arange(16000) / 16000 * 2 * np.pi * 440)
    assert audio.log_mel(x).shape == (101, 128) and audio.filter_bank(x).shape[1] == 80 and audio.log_mel_clamped(x).shape == (100, 80)
    hum = np.sin(np.arange(16000) / 16000 * 2 * np.pi * 50)
    assert np.abs(audio.clean_up(hum)[8000:]).max() < 0.1 and np.abs(audio.clean_up(x)[8000:]).max() > 0.8
    assert abs(len(audio.resample(x, 8000)) - 32000) <= 1 and audio.log_mel(x[:0]).shape[1] == 128


#: Ranges of code points of scripts (fixed values) and a line in each.
SCRIPTS = {
    "hi": ([(0x0900, 0x097F)], "नमस्ते दुनिया, यह एक वाक्य है"),
    "bn": ([(0x0980, 0x09FF)], "ওহে বিশ্ব, এটি একটি বাক্য"),
    "ta": ([(0x0B80, 0x0BFF)], "வணக்கம் உலகம் இது ஒரு வாக்கியம்"),
    "te": ([(0x0C00, 0x0C7F)], "హలో ప్రపంచం ఇది ఒక వాక్యం"),
    "ur": ([(0x0600, 0x06FF), (0x0750, 0x077F)], "ہیلو دنیا یہ ایک جملہ ہے"),
}


def test_script_of_a_transcript(spark):
    for lang, (ranges, line) in SCRIPTS.items():
        df = spark.createDataFrame([(line,), ("hello " + "x" * len(line),), ("  \n",)], "text string")
        own, other, none = [r[0] for r in df.select(text.script_fraction(F.col("text"), ranges)).collect()]
        solid = re.sub(r"\s", "", line)
        assert own == pytest.approx(sum(any(a <= ord(c) <= b for a, b in ranges) for c in solid) / len(solid)), lang
        assert own >= 0.7 and other == 0 and none is None and len(solid) >= 3, lang


def test_backoff_of_unknown_words():
    lm = decoding.Backoff({"1": (-1.0, -0.5), "2": (-2.0, -0.25), "1 2": (-0.3, -0.1), "<unk>": (-5.0, 0.0)}, 3, -5.0)
    ten = np.log(10)
    assert lm((), 2) == pytest.approx(-2 * ten) and lm((1,), 2) == pytest.approx(-0.3 * ten)
    assert lm((2,), 1) == pytest.approx((-1 - 0.25) * ten)  # the bigram is missing
    assert lm((1, 2), 1) == pytest.approx((-1 - 0.1 - 0.25) * ten)
    assert lm((1, 2), 9) == pytest.approx(-5 * ten)  # the word too: no backoffs


def test_running_values_over_ranges(spark):
    r = np.random.default_rng(5)
    rows_ = [(s, int(i), None if r.random() < 0.7 else int(i), int(r.integers(0, 9))) for s in ("a", None) for i in r.choice(200, 90, replace=False)]
    df = spark.createDataFrame(rows_, "s string, i long, v long, n long")
    got = {(x["s"], x["i"]): (x["last"], x["sum"]) for x in ranges.sum_before(ranges.preceding(df, ["s"], "i", F.col("v"), "last", 16), ["s"], "i", "n", "sum", 16).collect()}
    for s, i, _, _ in rows_:
        before = sorted((j, v, n) for t, j, v, n in rows_ if t == s and j < i)
        assert got[s, i] == (next((v for _, v, _ in reversed(before) if v is not None), None), sum(n for _, _, n in before))
    places = [x["k"] for x in ranges.numbered(df.where("s = 'a'"), ["i"], "k", 16).orderBy("i").collect()]
    assert places == list(range(1, 91))


def test_streams_of_files(spark):
    import io
    import struct
    import wave

    f = io.BytesIO()
    with wave.open(f, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\x01\x00\xff\xff" * 10)
    flac = b"fLaC" + b"\x00\x00\x00\x22" + b"\x00" * 10 + ((44100 << 44) | (1 << 41) | (15 << 36) | 1234).to_bytes(8, "big") + b"\x00" * 16
    au = b".snd" + struct.pack(">5I", 24, 80, 3, 22050, 2) + b"\x00" * 80
    aiff = b"FORM" + struct.pack(">I", 46) + b"AIFF" + b"COMM" + struct.pack(">IhIhHQ", 18, 1, 99, 16, 0x400E, 0xAC44 << 48)
    assert readers.probe(f.getvalue()) == [(0, "pcm_16", 8000, 2, 10)] and readers.probe(flac) == [(0, "flac_16", 44100, 2, 1234)]
    assert readers.probe(au) == [(0, "au_3", 22050, 2, 20)] and readers.probe(aiff) == [(0, "aiff_16", 44100, 1, 99)]
    assert readers.probe(b"") == readers.probe(b"RIFFxxxxWAVE") == readers.probe(b"OggS") == []
    files = spark.createDataFrame([("a", f.getvalue()), ("b", b"junk"), ("c", None)], "path string, content binary")
    assert [tuple(x) for x in readers.audio_streams(files).collect()] == [("a", 0, "pcm_16", 8000, 2, 10)]
    first, second = (sorted(tuple(x)[:3] for x in readers.read_stream(files, i).collect()) for i in (0, 1))
    assert first == [("a", 8000, 2), ("b", None, None), ("c", None, None)] and second == [(k, None, None) for k in "abc"]


def test_an_arpa_file_is_read_in_blocks(spark, tmp_path):
    lines = ["\\data\\", "ngram 1=500", "ngram 2=500", "", "\\1-grams:", *[f"-1.5\tw{i}\t-0.25\r" for i in range(500)], "", "\\2-grams:", *[f"-0.5\tw{i} w{i}" for i in range(500)], "", "\\end\\", "-9\tout"]
    (tmp_path / "lm").mkdir()
    (tmp_path / "lm" / "part-0.txt").write_bytes("\n".join(lines).encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "1k")
        got = readers.arpa_words(spark, str(tmp_path / "lm"))
        assert got.rdd.getNumPartitions() > 4
        assert sorted(tuple(r) for r in got.collect()) == sorted([(1, f"w{i}", -1.5, -0.25) for i in range(500)] + [(2, f"w{i} w{i}", -0.5, 0.0) for i in range(500)])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
