"""Queries that SQL can't express, over whole tables, against plain Python."""

import itertools
import math
import tracemalloc

import numpy as np
import pytest

from lectern import plans
from lectern.functions import audio
from lectern.operators import clustering, decoding, kneser_ney
from lectern.plans import registry
from lectern.plans.base import frames, speaker_frames
from lectern.streaming import stateful

SF = "/root/testdata/sf0.001"
plans.load()


def run(spark, name):
    return [tuple(r) for r in registry.QUERIES[name](spark, SF).collect()]


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    out = {}
    for r in sorted(rows, key=lambda r: r["vec_id"]):
        out.setdefault(r["vec_id"] % 25, []).append((r["vec_id"], np.array(r["embedding"], float), r["label"]))
    return out


def plain_merges(x):
    """Centroid linkage over lists of members, everything computed anew."""
    live = {i: [i] for i in range(len(x))}
    out, n = [], len(x)
    while len(live) > 1:
        centre = {k: np.mean([x[i] for i in m], axis=0) for k, m in live.items()}
        i, j = min(itertools.combinations(sorted(live), 2), key=lambda p: (round(float(((centre[p[0]] - centre[p[1]]) ** 2).sum()), 9), p))
        out.append((i, j, math.sqrt(((centre[i] - centre[j]) ** 2).sum()), len(live[i]) + len(live[j])))
        live[n] = live.pop(i) + live.pop(j)
        n += 1
    return out


def test_clusters(spark, vectors):
    for name, rule in (("cl_linkage_centroid", {"distance": 1.2}), ("cl_fcluster_threshold", {"distance": 0.9}), ("cl_fcluster_maxclust", {"clusters": 4})):
        want = []
        for rec, items in vectors.items():
            merges = plain_merges([e for _, e, _ in items])
            assert np.allclose(clustering.linkage(np.stack([e for _, e, _ in items])), merges)
            above = {}
            for k, (i, j, d, _) in enumerate(merges):
                if d <= rule["distance"] if "distance" in rule else k < len(items) - rule["clusters"]:
                    above[i] = above[j] = len(items) + k
            tops = []
            for k in range(len(items)):
                while k in above:
                    k = above[k]
                tops.append(k)
            seen = list(dict.fromkeys(tops))
            want += [(rec, v, seen.index(top)) for (v, _, _), top in zip(items, tops)]
        assert sorted(run(spark, name)) == sorted(want), name


def test_refinement(spark, vectors):
    want = []
    phi = [2.0 - i / 64 for i in range(64)]
    for rec, items in vectors.items():
        kinds = sorted({k for _, _, k in items})
        n, s = len(items), len(kinds)
        gamma = [[math.exp(7.0) / (math.exp(7.0) + s - 1) if kinds[j] == k else 1 / (math.exp(7.0) + s - 1) for j in range(s)] for _, _, k in items]
        pi, before = [1 / s] * s, -math.inf
        for it in range(20):
            total = [sum(g[j] for g in gamma) for j in range(s)]
            inv = [[1 / (1 + 0.07 / 0.8 * total[j] * f) for f in phi] for j in range(s)]
            alpha = [[0.07 / 0.8 * inv[j][d] * sum(gamma[i][j] * items[i][1][d] * math.sqrt(phi[d]) for i in range(n)) for d in range(64)] for j in range(s)]
            bound = 0.0
            for i, (_, e, _) in enumerate(items):
                own = -0.5 * (sum(v * v for v in e) + 64 * math.log(2 * math.pi))
                lp = [0.07 * (sum(e[d] * math.sqrt(phi[d]) * alpha[j][d] for d in range(64)) - 0.5 * sum((inv[j][d] + alpha[j][d] ** 2) * phi[d] for d in range(64)) + own) + math.log(pi[j] + 1e-8) for j in range(s)]
                top = max(lp)
                all_ = top + math.log(sum(math.exp(x - top) for x in lp))
                bound += all_
                gamma[i] = [math.exp(x - all_) for x in lp]
            bound += sum(0.8 * 0.5 * (math.log(inv[j][d]) - inv[j][d] - alpha[j][d] ** 2 + 1) for j in range(s) for d in range(64))
            pi = [sum(g[j] for g in gamma) / n for j in range(s)]
            if it and bound - before < 1e-4:
                break
            before = bound
        best = [g.index(max(g)) for g in gamma] if s > 1 else [0] * n
        used = sorted(set(best))
        want += [(rec, v, used.index(b)) for (v, _, _), b in zip(items, best)]
    assert sorted(run(spark, "cl_vbx")) == sorted(want)


def test_chunks_get_the_best_clusters(spark, vectors):
    labels = sorted({k for items in vectors.values() for _, _, k in items})
    every = [x for items in vectors.values() for x in items]
    centre = [np.mean([e for _, e, k in every if k == lab], axis=0) for lab in labels]
    got = {v: (rec, c) for rec, v, c in run(spark, "cl_assign_unique")}
    assert len(got) == len(every)
    for rec, items in vectors.items():
        for k in range(0, len(items), 4):
            chunk = items[k : k + 4]
            cos = [[float(e @ c / np.sqrt((e @ e) * (c @ c))) for c in centre] for _, e, _ in chunk]
            near = sorted(set(itertools.chain(*[np.argsort(s)[::-1][: len(chunk)].tolist() for s in cos])))
            best = max(sum(cos[i][c] for i, c in enumerate(p)) for p in itertools.permutations(near, len(chunk)))
            picked = [got[v] for v, _, _ in chunk]
            assert all(p[0] == rec for p in picked) and len({c for _, c in picked}) == len(chunk)
            assert sum(cos[i][c] for i, (_, c) in enumerate(picked)) == pytest.approx(best)


def plain_edits(a, b):
    """Fewest edits, and of these the most substitutions, by the whole table of (edits, -substitutions, deletions)."""
    table = {(0, 0): (0, 0, 0, 0)}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            ways = []
            if i and j:
                n, s, d, ins = table[i - 1, j - 1]
                ways.append((n + (a[i - 1] != b[j - 1]), s + (a[i - 1] != b[j - 1]), d, ins))
            if i:
                n, s, d, ins = table[i - 1, j]
                ways.append((n + 1, s, d + 1, ins))
            if j:
                n, s, d, ins = table[i, j - 1]
                ways.append((n + 1, s, d, ins + 1))
            if ways:
                table[i, j] = min(ways, key=lambda w: w[0])
    return table[len(a), len(b)]


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row, old = [0], row
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(row[-1], old[j + 1]))
    return row[-1]


def test_error_rates(spark):
    from lectern.plans.models import _ref_hyp

    texts = [tuple(r) for r in _ref_hyp(spark, SF).collect()]
    got = {r["item_id"]: r for r in registry.QUERIES["ev_wer"](spark, SF).collect()}
    micro, macro = {}, {}
    for item, mode, ref, hyp in texts:
        a, b = ref.split(), hyp.split()
        n = plain_edits(a, b)[0]
        r = got[item]
        assert (r["sub"] + r["del"] + r["ins"], r["n_ref"]) == (n, len(a)) and r["sub"] + r["ins"] - r["del"] + len(a) - len(b) == r["sub"], item
        assert r["wer"] == pytest.approx(n / max(1, len(a)))
        micro.setdefault(mode, []).append((n, len(a)))
        f1 = 1.0 if not a and not b else 2 * plain_common(a, b) / (len(a) + len(b))
        macro.setdefault(mode, []).append(f1)
    assert {k: round(v, 9) for k, v in run(spark, "agg_wer_micro")} == {m: round(sum(n for n, _ in x) / max(1, sum(k for _, k in x)), 9) for m, x in micro.items()}
    assert {k: round(v, 6) for k, v in run(spark, "agg_rouge_macro")} == {m: round(sum(x) / len(x), 6) for m, x in macro.items()}
    rouge = dict(run(spark, "ev_rouge_l"))
    stop = {"the", "of", "and", "to", "a"}
    bare = {r["item_id"]: r for r in registry.QUERIES["ev_cw_wer"](spark, SF).collect()}
    import re

    for item, _, ref, hyp in texts:
        a, b = ref.split(), hyp.split()
        assert rouge[item] == pytest.approx(1.0 if not a and not b else 2 * plain_common(a, b) / (len(a) + len(b)), abs=1e-8)
        a, b = ([w for w in re.findall("[a-z']+", x.lower()) if w not in stop] for x in (ref, hyp))
        assert (bare[item]["sub"] + bare[item]["del"] + bare[item]["ins"], bare[item]["n_ref"]) == (plain_edits(a, b)[0], len(a))


def test_objects_get_the_means_of_their_tokens(spark):
    import json
    import re

    props = {r["event_id"]: r["props"] for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id", "props").collect()}
    for event, means in run(spark, "js_char_token_map"):
        said = f"[{props[event]},{props[event]}]"
        pieces = [p for p in re.split("(?<=[:,])", said)]
        where, at = [], 0
        for p in pieces:
            where.append((at, at + len(p), -len(p) / 10))
            at += len(p)
        want, at = [], 0
        decoder = json.JSONDecoder()
        while (at := said.find("{", at)) >= 0:
            _, end = decoder.raw_decode(said, at)
            touched = [v for a, b, v in where if a < end and b > at]
            want.append(sum(touched) / len(touched))
            at = end
        got = [float(x) for x in means.split(",")] if means else []
        assert got == pytest.approx(want, abs=1e-6)


def test_schedule_of_a_batch(spark):
    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], len(r["text"].split(" "))))
    got = {}
    for conv, turn, slot, enters, leaves in run(spark, "st_continuous_batch"):
        got[conv, turn] = (slot, enters, leaves)
    for conv, rows in turns.items():
        ends = [0, 0, 0]
        for turn, steps in sorted(rows):
            slot = min(range(3), key=lambda s: (ends[s], s))
            assert got[conv, turn] == (slot, ends[slot], ends[slot] + steps)
            ends[slot] += steps


def test_streamed_scores(spark):
    values = {}
    for r in frames(spark, SF).collect():
        values.setdefault(r["audio_id"], []).append((r["frame"], r["value"]))
    want = []
    for a, rows in values.items():
        x = [v / 100 - 0.5 for _, v in sorted(rows) for _ in range(40)]
        state = 0.0
        for n in range(len(x) // 512):
            w = ([0.0] * 64 + x)[512 * n : 512 * n + 576]
            state = 0.9 * state + 0.1 * sum(v * v for v in w) / 576
            want.append((a, n, state))
    got = sorted(run(spark, "st_vad_recurrent"))
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in sorted(want)], abs=1e-6)


def plain_cache(rows, size, queue_size):
    kept, queue, n, mean = [], [], 0, np.zeros(6)
    for x, p in rows:
        queue.append((x, p))
        if len(queue) <= queue_size:
            continue
        for a, b in queue:
            if sum(b) < 0.2:
                n += 1
                mean = mean + (a - mean) / n
        kept, queue = kept + queue, []
        if len(kept) > size:
            each = size // 4 - 3
            score = [[round(math.log(max(v, 0.25)) - math.log(max(1 - v, 0.25)) + sum(math.log(max(1 - u, 0.25)) for u in p) - math.log(math.sqrt(2)), 9) for v in p] for _, p in kept]
            many = [sum(s[c] > 0 for s in score) >= int(each * 0.5) for c in range(4)]
            score = [[-math.inf if p[c] <= 0.5 or (s[c] <= 0 and many[c]) else s[c] for c in range(4)] for s, (_, p) in zip(score, kept)]
            for top, factor in ((int(each * 0.75), 2.0), (int(each * 1.5), 1.0)):
                for c in range(4):
                    for t in sorted(range(len(kept)), key=lambda t: (-score[t][c], t))[:top]:
                        score[t][c] = round(score[t][c] - factor * 0.5 * math.log(2), 9)
            flat = [(-score[t][c], t, c) for t in range(len(kept)) for c in range(4)] + [(math.inf, len(kept) + t, c) for t in range(12) for c in range(4)]
            best = sorted((c, t) for _, t, c in sorted(flat)[:size])
            kept = [(kept[t] if t < len(kept) else (mean, np.zeros(4))) for _, t in best]
    return kept, queue, n


def test_streamed_cache(spark):
    rows = {}
    for r in speaker_frames(spark, SF).collect():
        rows.setdefault(r["audio_id"], []).append((r["frame"], np.array(r["x"]), np.array(r["p"])))
    want = [tuple(stateful.summary(a, *plain_cache([(x, p) for _, x, p in sorted(v, key=lambda e: e[0])], 32, 16)).iloc[0]) for a, v in rows.items()]
    got = sorted(run(spark, "st_sortformer_cache"))
    assert len(got) == len(want) and all(g == pytest.approx(tuple(map(float, w))) for g, w in zip(got, sorted(want)))
    assert any(w[1] == 32 for w in want)


def plain_beam(tokens, durations, lm, beam=4, weight=0.5, reward=0.2):
    """Every step grows all live paths, kept as dicts, and sorts them."""
    soft = lambda x: x - np.log(np.exp(x - x.max()).sum()) - x.max()
    live, done = [{"s": 0.0, "t": 0, "seq": (), "here": 0}], []
    while live:
        grown = []
        for h in live:
            if h["t"] >= len(tokens):
                done.append(h)
                continue
            lp, ld = soft(tokens[h["t"]]), soft(durations[h["t"]])
            for k in sorted(range(len(lp)), key=lambda k: (-lp[k], k))[:beam]:
                for far in range(len(ld)):
                    if k == 0:
                        grown.append({"s": h["s"] + lp[k] + ld[far], "t": h["t"] + (far or 1), "seq": h["seq"], "here": 0})
                    elif far > 0 or h["here"] < 10:
                        grown.append({"s": h["s"] + lp[k] + ld[far] + weight * lm(h["seq"], k) + reward, "t": h["t"] + far, "seq": (*h["seq"], k), "here": 0 if far else h["here"] + 1})
        live = sorted(grown, key=lambda h: -h["s"])[:beam]
    return max(done, key=lambda h: h["s"])["seq"]


def test_beams_with_a_language_model(spark):
    rows = {}
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect():
        rows.setdefault(r["vec_id"] % 20, []).append(np.array(r["embedding"], float))
    said = [[str(int(np.argmax(e[:59]))) for e in v] for v in rows.values()]
    df = spark.createDataFrame([(" ".join(s),) for s in said], "said string")
    from pyspark.sql import functions as F

    grams = {r["gram"]: (r["logp"], r["backoff"]) for r in kneser_ney.estimate(kneser_ney.gram_counts(df, F.split("said", " "), 2), 2, (0, 0)).collect()}

    def lm(seq, k):
        if seq and f"{seq[-1]} {k}" in grams:
            return grams[f"{seq[-1]} {k}"][0] * math.log(10)
        if str(k) in grams:
            return (grams[str(k)][0] + (grams.get(str(seq[-1]), (0, 0))[1] if seq else 0)) * math.log(10)
        return grams["<unk>"][0] * math.log(10)

    want = {a: " ".join(map(str, plain_beam([e[:59] for e in v], [e[59:] for e in v], lm))) for a, v in rows.items()}
    assert dict(run(spark, "de_tdt_beam")) == want


def test_model_sums_to_one(spark):
    df = spark.createDataFrame([("a b a c",), ("a b b",), ("c a b a",), ("",), (None,)], "said string")
    from pyspark.sql import functions as F

    lm = {r["gram"]: (10 ** r["logp"], 10 ** r["backoff"]) for r in kneser_ney.estimate(kneser_ney.gram_counts(df, F.split("said", " "), 3), 3, (0, 0, 0)).collect()}
    words = ["a", "b", "c", "</s>", "<unk>"]

    def p(context, w):
        if " ".join([*context, w]) in lm:
            return lm[" ".join([*context, w])][0]
        return lm.get(" ".join(context), (0, 1.0))[1] * p(context[1:], w)

    for context in ([], ["a"], ["a", "b"], ["<s>"], ["<s>", "a"], ["b", "a"]):
        assert sum(p(context, w) for w in words) == pytest.approx(1.0), context


def test_features_of_every_recording(spark):
    signals = {r["audio_id"]: np.repeat(np.array(r["x"], float), 40) for r in plans.audio._signals(spark, SF).collect()}
    for name, fn in (("ma_stft_logmel", audio.log_mel), ("ma_logmel_whisper", audio.log_mel_clamped), ("ma_fbank_kaldi", audio.filter_bank), ("ma_biquad_cleanup", audio.clean_up), ("ma_resample_16k", lambda x: audio.resample(x, 22050))):
        got = {a: (n, m) for a, n, m in run(spark, name)}
        assert set(got) == set(signals)
        for a, x in signals.items():
            want = fn(x)
            assert got[a] == (len(want), pytest.approx(float(want.mean()) if want.size else 0.0, abs=1e-5))


def test_features_by_their_definitions():
    r = np.random.default_rng(4)
    x = r.normal(size=1400)
    # log mel: a discrete Fourier transform by sums
    y = np.append(x[:1], x[1:] - 0.97 * x[:-1])
    y = np.concatenate([np.zeros(256), y, np.zeros(256)])
    hann = [0.5 - 0.5 * math.cos(2 * math.pi * k / 400) for k in range(400)]
    t = 3
    frame = np.zeros(512)
    frame[56:456] = y[160 * t + 56 : 160 * t + 456] * hann
    k = np.arange(512)
    power = np.array([abs((frame * np.exp(-2j * math.pi * b * k / 512)).sum()) ** 2 for b in range(257)])
    assert np.allclose(audio.log_mel(x)[t], np.log(audio.mel_filters(16000, 512, 128) @ power + 2.0**-24))
    # filters: triangles between neighbouring edges, of area one on the Slaney scale
    f = audio.mel_filters(16000, 512, 20)
    assert f.shape == (20, 257) and (f >= 0).all() and all(np.flatnonzero(row)[0] <= row.argmax() <= np.flatnonzero(row)[-1] for row in f if row.any())
    # recursive filter: its response to one tone is that of its transfer function
    b, a = audio.coefficients("notch", 50.0, 16000, 30.0)
    z = np.exp(-2j * math.pi * 50.0 / 16000)
    assert abs((b[0] + b[1] * z + b[2] * z * z) / (1 + a[0] * z + a[1] * z * z)) < 1e-6
    tone = np.sin(2 * math.pi * 300 * np.arange(22050) / 22050)
    again = audio.resample(tone, 22050)
    assert len(again) == 16000 and np.abs(again[200:-200] - np.sin(2 * math.pi * 300 * np.arange(16000) / 16000)[200:-200]).max() < 0.01


def test_greedy_asks_again_at_the_same_frame():
    asked = []

    def step(t, seq, state):
        asked.append(t)
        token = np.array([0.0, 1.0, 0.5]) if t == 0 or len(seq) < 12 else np.array([1.0, 0.0, 0.0])
        return token, np.array([1.0, 0.0]), (state or 0) + 1

    out = decoding.tdt_greedy(step, 3, 0)
    assert [t for t, *_ in out] == [0] * 10 + [1] * 2 and asked == [0] * 10 + [1, 1, 1, 2]
    assert out[0][3] == pytest.approx(1 - math.log(1 + math.e + math.exp(0.5)))


def test_linkage_needs_no_table_of_pairs(monkeypatch):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(3 * k, 1, (20, 6)) for k in range(4)] + [np.repeat(r.integers(0, 3, (5, 6)), 3, axis=0)])
    monkeypatch.setattr(clustering, "LARGE", 2, raising=False)
    monkeypatch.setattr(clustering, "NEIGHBOURS", 8, raising=False)
    assert np.allclose(clustering.linkage(x), plain_merges(list(x)))
    x = r.normal(size=(1500, 16))
    tracemalloc.start()
    assert clustering.linkage(x)[-1, 3] == 1500
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # a double for every two clusters: 72e6
