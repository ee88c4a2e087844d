"""Awkward rows for every operator: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import ann, bpe, langid, mixing, pii, queries, simhash, toxicity, warc

TEXT = "doc_id long, text string"


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_pii_long_repeated_and_overlapping(spark):
    long = "nothing here " * 20_000 + "mail a.b@c.example.org end"
    docs = spark.createDataFrame([(1, long), (1, long), (None, "ip 10.0.0.1"), (2, "+1 4111 1111 1111 1111")], TEXT)
    docs = docs.withColumns({"spans": F.lit("x"), "kind": F.lit(1), "exact": F.lit(True)})
    got = [(r["doc_id"], [tuple(s) for s in r["spans"]]) for r in pii.find_spans(docs).collect()]
    assert got.count((1, [(0, 260_005, 260_022, True)])) == 2 and (None, [(1, 3, 11, True)]) in got
    assert all(not x[3] for x in dict(got)[2])  # the card's pattern takes the 1 too and fails, without another try
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.where("doc_id = 1 and text like '%mail [EMAIL] end'").count() == 2
    assert pii.redact(docs.limit(0)).count() == 0 and pii.find_spans(docs.limit(0)).count() == 0


def test_parts_and_groups_change_nothing(monkeypatch):
    weights = pii.trained()
    line = "call (569) 555-4877 or write bob (at) example (dot) com, no. 12\n"
    texts = [line * 40 + "words without any\n" * 30 + line, "", "x 1 " * 900, line]
    whole = pii.model_spans(weights, texts)
    assert len(whole[0]) >= 80
    monkeypatch.setattr(pii, "TOGETHER", 3)
    assert pii.model_spans(weights, texts) == whole
    monkeypatch.setattr(pii, "PART", 200)
    assert [(at, len(x)) for at, x in pii._parts(texts[0])][:2] == [(0, 4 * len(line)), (4 * len(line), 4 * len(line))]
    inner = [len(s) for s in pii.model_spans(weights, texts)]
    assert abs(inner[0] - len(whole[0])) <= 4 and inner[1:] == [len(s) for s in whole[1:]]


def test_bytes_of_awkward_texts(spark):
    texts = ["", None, "\x00\x7f", "😀" * 3000, "a" * 300_000, "  \n\t ", "<|endoftext|>", "é‍"]
    docs = spark.createDataFrame([*enumerate(texts), (4, texts[4])], TEXT).withColumns({"ids": F.lit("x"), "n_tokens": F.lit("y")})
    got = collected(bpe.round_trip(docs, **queries.vocabulary()))
    assert len(got) == len(texts) + 1
    for doc, n, _, decoded in got:
        raw = (texts[doc] or "").encode()
        assert decoded == hashlib.sha256(raw).hexdigest() and (n == 0) == (not raw)
    assert bpe.round_trip(docs.limit(0), **queries.vocabulary()).count() == 0
    assert bpe.encode(docs.limit(0), **queries.vocabulary()).count() == 0


def test_archives_of_long_pages_and_clashing_columns(spark):
    long = "<p>" + "long page " * 300_000
    rows = [(1, "http://a", long), (2, "http://b", long), (3, "u", ""), (3, "u", ""), (4, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"n": F.lit("n"), "digest": F.lit(1), "d": F.lit(2), "last": F.lit("l"), "path": F.lit("p"), "content": F.lit("c")})
    got = collected(warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"))
    sha = lambda x: hashlib.sha1(x.encode()).hexdigest()
    want = [(1, len(long), sha(long), "revisit", 2, None), (2, len(long), sha(long), "response", None, None), (3, 0, sha(""), "response", None, None), (3, 0, sha(""), "response", None, None), (4, 0, sha(""), "response", None, None)]
    assert got == sorted(want, key=repr)


def test_language_of_awkward_rows(spark):
    train = spark.createDataFrame([(i, ("the cat sat on the mat " if i % 2 else "der hund und die katze ") * 9, "en" if i % 2 else "de") for i in range(20)] + [(None, "no id", "en"), (50, None, "en"), (51, "x", None)], TEXT + ", lang string")
    p = langid.fit(train.withColumns({"draw": F.lit("d"), "size": F.lit("s"), "id": F.lit("i")}))
    docs = spark.createDataFrame([(1, "the mat " * 50_000), (1, "the mat " * 50_000), (2, None), (None, "der hund"), (3, "\x00")], TEXT).withColumns({"lang_pred": F.lit("z"), "score": F.lit("q")})
    assert [r[:2] for r in collected(langid.predict(docs, p))] == [(1, "en"), (1, "en"), (2, "und"), (3, "und"), (None, "de")]
    only_long = spark.createDataFrame([(1, "ein langer text " * 9000, "de"), (2, "a long text of words " * 9000, "en")], TEXT + ", lang string")
    p = langid.fit(only_long)
    assert [r[:2] for r in collected(langid.predict(spark.createDataFrame([(1, "ein text"), (2, "of words")], TEXT), p))] == [(1, "de"), (2, "en")]


def plain_logit(model, text):
    """The network's forward pass, a word and a filter at a time."""
    p = model.p
    distinct, index, _ = toxicity.words(pa.array([text], pa.large_string()))
    rows = toxicity.buckets(distinct)
    x = [p["embed"][a] + p["embed"][b] if a else np.zeros(toxicity.DIM) for a, b in rows[index]]
    pooled = []
    for k in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            pooled.append(max(sum(float(x[i + j] @ p[f"w{k}"][j][:, f]) for j in range(k) if i + j < len(x)) for i in range(len(x))) if len(x) else 0.0)
    return float(np.tanh(np.array(pooled) + p["bias"]) @ p["out"] + p["outbias"][0])


def test_network_equals_a_plain_pass():
    r = np.random.default_rng(3)
    m = toxicity.Model()
    for k in ("embed", "bias", "out"):
        m.p[k] = r.normal(0, 0.5, m.p[k].shape).astype(np.float32)
    m.p["embed"][0] = 0
    texts = ["one", "one two", "a b c d e a b", "Wörter über Wörter, und so weiter!", " ".join(map(str, range(300)))]
    distinct, index, begins = toxicity.words(pa.array(texts, pa.large_string()))
    assert np.allclose(m.logits(toxicity.buckets(distinct), index, begins), [plain_logit(m, t) for t in texts], atol=1e-4)


def test_network_follows_its_gradient():
    """A step of plain descent along what a batch's gradient is, taken from the optimiser's first moments."""
    r = np.random.default_rng(4)
    m = toxicity.Model()
    for k in ("embed", "bias", "out"):
        m.p[k] = r.normal(0, 0.5, m.p[k].shape).astype(np.float32)
    m.p["embed"][0] = 0
    texts = ["one two three four", "five six", "one six seven eight nine"]
    y, weight = np.array([True, False, True]), np.array([0.2, 0.3, 0.5])
    distinct, index, begins = toxicity.words(pa.array(texts, pa.large_string()))
    rows = toxicity.buckets(distinct)

    def loss():
        z = m.logits(rows, index, begins).astype(float)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum())

    m1, m2 = ({k: np.zeros_like(v) for k, v in m.p.items()} for _ in range(2))
    m.fitting = True
    m._step(rows, index, begins, y, weight, m1, m2, 1, 0.0)  # a rate of nothing: only the moments change
    m.fitting = False
    for name, at in (("out", (3,)), ("bias", (5,)), ("outbias", (0,)), ("w1", (0, 2, 3)), ("w2", (1, 4, 1)), ("w3", (2, 0, 6)), ("embed", (int(rows[0, 0]), 2)), ("embed", (int(rows[3, 1]), 5))):
        kept, eps = m.p[name][at], 1e-2
        m.p[name][at] = kept + eps
        up = loss()
        m.p[name][at] = kept - eps
        down = loss()
        m.p[name][at] = kept
        assert m1[name][at] / 0.1 == pytest.approx((up - down) / (2 * eps), abs=3e-3), name


def test_toxicity_of_awkward_rows(spark):
    rows = [(i, ("kind words " if i % 3 else "vile words ") * 5, "en", int(i % 3 == 0)) for i in range(120)]
    df = spark.createDataFrame([*rows, (None, "vile", "en", 1), (200, None, "en", 1), (201, "vile", None, None)], TEXT + ", lang string, toxic int")
    labels = df.select("doc_id", "toxic").union(spark.createDataFrame([(0, 0), (0, None)], "doc_id long, toxic int"))
    m = toxicity.fit(df, labels)
    long = "kind words " * 40_000
    docs = spark.createDataFrame([(1, long), (1, long), (2, long + "vile words"), (None, ""), (3, None)], TEXT).withColumns({"score": F.lit("x"), "toxic": F.lit(9)})
    got = collected(toxicity.score(docs, m))
    assert len(got) == 5 and got[0] == got[1] and all(0 <= s <= 1 for _, s in got)
    assert toxicity.score(docs.limit(0), m).count() == 0 and toxicity.drop_toxic(docs.limit(0), m).count() == 0
    assert toxicity.drop_toxic(docs, m).columns == docs.columns
    assert m.score(pa.array(["vile words vile words", "kind words kind words"])).argmax() == 0


def test_toxicity_learns_from_every_labelled_row(spark):
    """The toxic word is only in documents that come after 5000 others by the hash that deals them."""
    ids = spark.range(5300).orderBy(F.xxhash64(F.lit("toxicity"), "id"), "id").toPandas()["id"].tolist()
    rows = [(i, f"kind word {i % 50} here" + " vermino" * (k >= 5000), "en", int(k >= 5000)) for k, i in enumerate(ids)]
    df = spark.createDataFrame([*rows, (9000, "unlabelled", "xx", None)], TEXT + ", lang string, toxic int")
    models = [toxicity.fit(df.repartition(k), df.select("doc_id", "toxic").repartition(k)) for k in (1, 5)]
    assert models[0].score(pa.array(["kind word 7 here", "kind word vermino here"])).round().tolist() == [0, 1]
    assert models[0].languages == ["en"]
    assert all((a == models[1].p[k]).all() for k, a in models[0].p.items()) and (models[0].shift == models[1].shift).all()


def test_mixing_of_awkward_rows(spark):
    rows = [(None, "a", "s"), (1, "b", None), (1, "b", None), (2, "c", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({k: F.lit(k) for k in ("__copy", "__rate", "__order", "__source", "__n", "rate", "id", "of", "row", "copy", "n", "s", "order")})
    out = mixing.mix(docs, size=400)
    assert set(out.columns) == set(docs.columns)
    got = out.toPandas()
    assert (got["__n"] == "__n").all() and (got["rate"] == "rate").all() and got["__order"].astype(float).is_monotonic_increasing
    n = got[got["doc_id"] == 1].groupby("__copy").size()
    assert (n == 2).all() and len(got) > 200  # rows that repeat draw alike
    weights = spark.createDataFrame([("s", 1.0), ("s", 1.0), (None, float("nan")), ("x", -1.0)], "source string, weight double")
    assert set(mixing.mix(docs, weights, size=50).select("source").distinct().toPandas()["source"]) == {"s"}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_neighbours_without_ids_and_of_other_lengths(spark):
    r = np.random.default_rng(6)
    rows = [(i, r.normal(size=8).tolist()) for i in range(60)] + [(None, r.normal(size=8).tolist()), (90, [1.0, 2.0]), (0, None)]
    df = spark.createDataFrame([*rows, rows[3]], "vec_id long, embedding array<float>").withColumns({"rank": F.lit(1), "score": F.lit("s"), "shard": F.lit("x")})
    got = ann.search(ann.build_index(df, 5), df.where("vec_id % 20 = 0 or vec_id = 90"), 5).toPandas()
    assert set(got["query_id"]) == {0, 20, 40} and not got["vec_id"].isin([90]).any() and got["vec_id"].notna().all()
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows[:60]}
    for q in (0, 20, 40):
        want = sorted(((-(x[q] @ v), i) for i, v in x.items() if i != q))[:5]
        assert got[got["query_id"] == q].sort_values("rank")["vec_id"].tolist() == [i for _, i in want]
    assert ann.search(ann.build_index(df.limit(0), 5), df, 5).count() == 0


def test_fingerprints_of_awkward_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(120_000))
    docs = spark.createDataFrame([(3, long), (2, long), (2, long), (5, None), (4, ""), (None, long), (9, "A b"), (8, "a B")], TEXT).withColumns({"fp": F.lit("x"), "component": F.lit("y"), "node": F.lit(1)})
    got = collected(simhash.simhash_groups(docs))
    assert sorted(((d, c) for d, _, c in got), key=repr) == sorted([(3, 2), (2, 2), (2, 2), (5, 4), (4, 4), (None, 2), (9, 8), (8, 8)], key=repr)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(kept.toPandas()["doc_id"].fillna(-1).astype(int)) == [-1, 2, 4, 8]
    assert simhash.simhash_groups(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0
