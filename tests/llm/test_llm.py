"""The training-data operators against brute force on small tables with awkward rows."""

import base64
import hashlib
import itertools
import math
import re
import struct
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
import zstandard
from pyspark.sql import functions as F

from lectern.llm import ann, bpe, common, induction, langid, lattice, mixing, pii, queries, simhash, suffix, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, spans string"
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu") for b in ("ren", "sol", "vat", "pik") for c in ("a", "o", "us", "en")]


def sentence(r, n):
    return " ".join(r.choice(WORDS, n))


def documents(spark):
    """Copies, near copies, nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""
    r = np.random.default_rng(1)
    base = sentence(r, 300)
    texts = {i: sentence(r, int(r.integers(1, 120))) for i in range(1, 30)}
    texts |= {40: base, 41: base, 42: base.replace(base.split()[150], "changed", 1), 43: None, 44: "", 45: " \n\t ", 46: "héllo wörld 日本 😀 don't", 47: sentence(r, 4000), 48: "a " * 900, 49: base[:900] + " " + sentence(r, 40)}
    rows = [(k, t, "en" if k % 2 else None, "hot" if k % 3 else "cold", None, k, "x") for k, t in texts.items()]
    return spark.createDataFrame([*rows, rows[3], (None, "no id", None, None, None, None, None)], SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- shared parts -----------------------------------------------------------------------------------------------


def plain_components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in parent}


def test_components(spark):
    r = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 200, (150, 2))] + [(300 + i, 301 + i) for i in range(60)] + [(500, 500 + i) for i in range(1, 50)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = plain_components((a, b) for a, b in edges if a != b)
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pairs_within_runs():
    got = [(int(a), int(b)) for i, j in common.pairs_within(np.array([1, 3, 2]), 2) for a, b in zip(i, j)]
    assert got == [(1, 2), (1, 3), (2, 3), (4, 5)]


# --- 1 PII ------------------------------------------------------------------------------------------------------

PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(re.sub("[^0-9]", "", s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


def plain_base(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in enumerate(PATTERNS.values()) for m in re.finditer(p, text) if ok(m.group())]


def test_base_spans_equal_the_patterns():
    r = np.random.default_rng(3)
    parts = ["a@b.co", "x.y@", "@", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111111111111111", "+1 (569) 555-4877", "+", "1", ".", "-", " ", "é", "a", "12.34", "@b", "c.d@e.f.g", "..", "()", "0000", "a@b@c.de", "1.1.1.1.1.1.1.1.1"]
    for _ in range(4000):
        t = "".join(r.choice(parts, int(r.integers(1, 9))))
        assert pii.base_spans(t) == plain_base(t), t
    assert pii.base_spans("a" * 200_000 + "1" * 200_000) == []


def test_tagger_learns_and_keeps_base_spans():
    p = pii.trained()
    x, y = pii.training_windows(300, 99)
    e = pii._emissions(p, x.T.astype(int))[0].transpose(1, 0, 2)
    got = pii.best_tags(p["trans"], e.reshape(-1, pii.TAGS), np.arange(len(x)) * pii.WINDOW, np.full(len(x), pii.WINDOW)).reshape(x.shape)
    assert (got == y)[y > 0].mean() > 0.85 and (got > 0)[y == 0].mean() < 0.03
    text = "write to bob (at) example (dot) com or call (569) 555-4877, ip 10.0.0.1"
    spans = pii.all_spans(p, [text])[0]
    assert (1, text.index("10.0"), len(text), True) in spans
    assert any(k == 3 and not exact and "555-4877" in text[a:b] for k, a, b, exact in spans)
    assert pii.all_spans(p, ["no private words here at all", ""]) == [[], []]


def test_crf_and_viterbi_equal_enumeration():
    r = np.random.default_rng(12)
    p = {"trans": r.normal(size=(pii.TAGS, pii.TAGS))}
    e = r.normal(size=(4, 1, pii.TAGS))
    y = r.integers(0, pii.TAGS, (4, 1))
    paths = np.array(list(itertools.product(range(pii.TAGS), repeat=4)))

    def total(e, trans, paths):
        return sum(e[t, 0, paths[:, t]] for t in range(4)) + sum(trans[paths[:, t], paths[:, t + 1]] for t in range(3))

    def loss(e, trans):
        s = total(e, trans, paths)
        return np.log(np.exp(s - s.max()).sum()) + s.max() - total(e, trans, y.T)[0]

    found, de, dtrans = pii._crf(p, e, y)
    assert found == pytest.approx(loss(e, p["trans"]))
    for at in [(0, 0, 3), (2, 0, 1), (3, 0, int(y[3, 0]))]:
        moved = e.copy()
        moved[at] += 1e-6
        assert (loss(moved, p["trans"]) - loss(e, p["trans"])) / 1e-6 == pytest.approx(de[at], abs=1e-4)
    moved = p["trans"].copy()
    moved[y[0, 0], y[1, 0]] += 1e-6
    assert (loss(e, moved) - loss(e, p["trans"])) / 1e-6 == pytest.approx(dtrans[y[0, 0], y[1, 0]], abs=1e-4)
    ends = total(e, p["trans"], paths) + p["trans"][0, paths[:, 0]] + p["trans"][paths[:, 3], 0]
    two = np.concatenate([e[:, 0], np.zeros((1, pii.TAGS)), e[:2, 0]])  # stretches of four and two, one position outside
    short = np.array(list(itertools.product(range(pii.TAGS), repeat=2)))
    best = p["trans"][0, short[:, 0]] + two[5, short[:, 0]] + p["trans"][short[:, 0], short[:, 1]] + two[6, short[:, 1]] + p["trans"][short[:, 1], 0]
    assert pii.best_tags(p["trans"], two, np.array([5, 0]), np.array([2, 4])).tolist() == [*paths[ends.argmax()], 0, *short[best.argmax()]]


def test_windows_are_reconciled():
    r = np.random.default_rng(13)
    e = r.normal(size=(5, pii.WINDOW, pii.TAGS)).astype(np.float32)
    joined = np.array([False, True, True, False, True])
    got = pii.reconciled(e, joined)
    run = np.cumsum(~joined)
    for z in range(5):
        for c in range(pii.ZONE):
            seen = [(pii.ZONE * (z - k) + pii.MARGIN + c, k) for k in range(5) if run[k] == run[z]]
            seen = [(at, k) for at, k in seen if 0 <= at < pii.WINDOW]
            weight = [min(at + 1, pii.WINDOW - at) for at, _ in seen]
            assert np.allclose(got[z, c], sum(w * e[k, at] for w, (at, k) in zip(weight, seen)) / sum(weight), atol=1e-5)


def test_spellings_in_any_case():
    p = pii.trained()
    for text in ("bob (aT) example (dOt) com", "bob (at) example (dot) com", "BOB [AT] EXAMPLE [DOT] COM"):
        kinds = [k for k, *_ in pii.all_spans(p, ["write to " + text.lower() + " now", "write to " + text + " now"])[1]]
        assert kinds == [0], text


def test_pii_query_equals_the_operator(spark, tmp_path):
    texts = ["", None, "a@b.co 10.0.0.1 and +1 (569) 555-4877, card 4111 1111 1111 1111!", "x" * 70_000 + " me@there.org", "no digits", "é 😀 u@v.io"]
    spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(2, texts[2])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op1_pii(spark, str(tmp_path)).collect()))
    want = []
    for i, x in [*enumerate(texts), (2, texts[2])]:
        base = plain_base(x or "")
        spans = pii.all_spans(pii.trained(), [x or ""])[0]
        assert [s[:3] for s in spans if s[3]] == sorted(base)
        digest = hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(base)).encode()).hexdigest()
        want.append((i, *[sum(k == s[0] for s in base) for k in range(4)], digest, ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b, _ in spans)))
    assert got == sorted(want)


def test_pii_operator(spark):
    docs = documents(spark).withColumn("text", F.when(F.col("doc_id") == 5, "mail a.b@c.example.org, card 4111 1111 1111 1111.").otherwise(F.col("text")))
    got = {r["doc_id"]: r["spans"] for r in pii.find_spans(docs).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in got[5]] == [(0, 5, 22), (2, 29, 48)] and got[43] == [] and got[44] == []
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[5] == "mail [EMAIL], card [CARD]." and clean[43] is None and pii.redact(docs).columns == docs.columns
    assert pii.find_spans(docs.limit(0)).count() == 0


# --- 2 nearest neighbours ---------------------------------------------------------------------------------------


def vectors(spark, n=700, dim=16):
    r = np.random.default_rng(4)
    x = r.normal(size=(n, dim)) * r.uniform(0.5, 2, (n, 1))
    x[50:90] = x[50]
    x[90:130] = x[90] + r.normal(size=(40, dim)) * 0.01
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [(n, None, 0), (n + 1, [0.0] * dim, 0), (n + 2, [float("nan")] * dim, 0), (n + 3, [None] * dim, 0), (n + 4, [float("inf")] * dim, 0)]
    return x, spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, node int")


def test_ann_recall_and_order(spark):
    x, df = vectors(spark)
    got = defaultdict(list)
    for r in ann.search(ann.build_index(df, 20, shard_rows=250), df.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    hits = total = 0
    for q in range(0, len(x), 20):
        score = x @ x[q]
        want = [i for i in np.lexsort((np.arange(len(x)), -score)) if i != q][:20]
        mine = got[q]
        assert [k for *_, k in mine] == list(range(1, 21)) and all(abs(score[i] - s) < 1e-9 for i, s, _ in mine)
        assert [(i) for i, _, _ in mine] == [i for _, i in sorted((-s, i) for i, s, _ in mine)]
        hits += len(set(want) & {i for i, _, _ in mine})
        total += 20
    assert hits / total >= 0.9 and set(got) == set(range(0, len(x), 20))
    few = df.where("vec_id < 3")
    assert ann.search(ann.build_index(few, 20), few, 20).count() == 6
    none = df.where("vec_id < 0")
    assert ann.search(ann.build_index(none, 20), df.where("vec_id = 0"), 20).count() == 0


# --- 3 byte-level BPE -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_tiktoken(reference):
    c = bpe.codec(**queries.vocabulary())
    r = np.random.default_rng(5)
    parts = ["a", "aa", "=", "-", " ", "\n", "é", "ñ", "😀", "0", "the", "'s", "\t", "  ", "ab", "日本", "\x1c", "\x85", " ", "̀", "½", "<|endoftext|>", "\0", "ﬁ", "١", "ǅ"]
    texts = ["".join(r.choice(parts) * int(r.integers(1, 9)) for _ in range(int(r.integers(0, 9)))) for _ in range(6000)]
    texts += [chr(a) + chr(a) + "x " + chr(a) for a in range(1, 0x3000)] + ["ab" * 20000]
    for t, ids in zip(texts, c.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t), repr(t[:50])
        assert c.decode(ids) == t.encode()


def test_offsets_and_split_characters(spark):
    v = queries.vocabulary()
    docs = documents(spark)
    for r in bpe.encode(docs.where("doc_id in (43, 44, 46)"), **v).collect():
        text = {43: "", 44: "", 46: "héllo wörld 日本 😀 don't"}[r["doc_id"]]
        c = bpe.codec(**v)
        raw, at = text.encode(), 0
        for i, s, e in zip(r["ids"], r["starts"], r["ends"], strict=True):
            piece = c.bytes_of[i]
            assert len(text[:s].encode()) <= at and at + len(piece) <= len(text[:e].encode())
            at += len(piece)
        assert at == len(raw)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs, **v), **v).collect()}
    assert back[46] == "héllo wörld 日本 😀 don't" and back[43] == ""
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, **v).collect()}
    assert got[46]["decoded_sha256"] == hashlib.sha256("héllo wörld 日本 😀 don't".encode()).hexdigest() and got[43]["n_tokens"] == 0


# --- 4 SimHash --------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark):
    docs = documents(spark)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(docs).collect()}
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    ids = [k for k in prints if k is not None]
    comp = plain_components([(a, b) for a in ids for b in ids if (prints[a] ^ prints[b]).bit_count() <= 3])
    assert {k: v for k, v in got.items() if k is not None} == {k: (f"{prints[k]:016x}", comp[k]) for k in ids}
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == {k for k in ids if comp[k] == k} | {None} and simhash.keep_one(docs).columns == docs.columns
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("long_run", [2048, 3])
def test_links_at_three_bits(monkeypatch, long_run):
    monkeypatch.setattr(simhash, "LONG_RUN", long_run)
    r = np.random.default_rng(6)
    base = r.integers(0, 1 << 63, 30, dtype=np.int64)
    fps = np.unique(np.concatenate([base] + [base ^ np.bitwise_or.reduce(np.int64(1) << r.integers(0, 63, (k, 30)), axis=0) for k in (1, 2, 3, 3, 4, 5)]))
    ids = np.arange(len(fps))
    batch = next(simhash._variants([pa.RecordBatch.from_arrays([pa.array(ids), pa.array(fps)], ["id", "fp"])]))
    key, fp, at = (c.to_numpy() for c in batch.columns)
    order = np.argsort(key, kind="stable")
    a, b = simhash._run_edges(key[order], fp[order], at[order], 3)
    want = plain_components([(i, j) for i in ids.tolist() for j in ids.tolist() if i < j and int(fps[i] ^ fps[j]).bit_count() <= 3])
    assert plain_components(zip(a.tolist(), b.tolist())) == want


# --- 5 language ID ----------------------------------------------------------------------------------------------


def test_phrases_equal_a_plain_parse():
    texts = {"a": b"the cat sat on the mat the end", "b": b"der hund und die katze der garten"}
    p = langid.Parser(texts)
    r = np.random.default_rng(7)
    docs = ["".join(r.choice(list("the catdrgunkz!É"), int(r.integers(0, 2500)))) for _ in range(30)]
    docs += ["the cat sat on the mat " * 300, "x" * 5000, "e" * 4000 + "the", ""]
    data = [d.encode() for d in docs]
    ends = np.cumsum([len(d) for d in data])
    got = p.phrases(np.frombuffer(b"".join(data), np.uint8), np.r_[0, ends[:-1]], ends)
    for d, counts in zip(data, got, strict=True):
        for k, lang in enumerate(p.languages):
            known, n = bytes(langid.CLASSES[np.frombuffer(texts[lang], np.uint8)]), 0
            part, i = bytes(langid.CLASSES[np.frombuffer(d, np.uint8)]), 0
            while i < len(part):
                j = i + 1
                while j <= len(part) and part[i:j] in known:
                    j += 1
                n, i = n + 1, max(i + 1, j - 1)
            assert counts[k] == n


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_language_id(spark, sf)
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    row = got.join(lang, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert row[0] > 0.97 and 0 <= row[1] and row[2] <= 1
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ..."), (4, "日本語")], "doc_id long, text string")
    p = langid.fit(documents(spark))
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(odd, p).collect()} == {1: "und", 2: "und", 3: "und", 4: "en"}
    assert langid.predict(odd.limit(0), p).count() == 0
    assert langid.predict(odd, langid.fit(documents(spark).limit(0))).where("lang_pred <> 'und'").count() == 0


def test_little_training_text_is_no_loss(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang in ('en', 'es')")
    two = [r["doc_id"] for r in docs.where("lang = 'es' and length(text) between 200 and 600").orderBy("doc_id").limit(2).collect()]
    p = langid.fit(docs.where((F.col("lang") == "en") | F.col("doc_id").isin(two)))
    got = langid.predict(docs, p).join(docs.select("doc_id", "lang"), "doc_id").where(~F.col("doc_id").isin(two))
    right = {r["lang"]: r["right"] for r in got.groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).collect()}
    assert right["es"] > 0.9 and right["en"] > 0.97, right


def test_score_equals_a_plain_parse(spark):
    texts = {"a": b"the cat sat on the mat the end " * 20, "b": b"der hund und die katze der garten"}
    p = langid.Parser(texts)
    said = ["the cat and the hund", "der garten sat " * 200, "", None, "42"]
    docs = spark.createDataFrame([(i, x, "z", 1.0) for i, x in enumerate(said)] + [(0, said[0], None, None)], "doc_id long, text string, lang_pred string, score double")
    bits = np.log2([max(langid.LEAST_BYTES, len(texts[k])) for k in p.languages])
    for r in langid.predict(docs, p).collect():
        x = said[r["doc_id"]]
        if not x or not any(c.isalpha() for c in x):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        d = x.encode()
        cost = p.phrases(np.frombuffer(d, np.uint8), np.array([0]), np.array([len(d)]))[0] * bits
        share = (cost.min() / cost) ** langid.SHARPNESS
        assert r["lang_pred"] == p.languages[int(cost.argmin())] and r["score"] == pytest.approx(share.max() / share.sum())


# --- 6 WARC -----------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    long = "<p>" + "x" * 1200
    rows = [(1, "http://a/é b", long), (2, "http://b", long), (3, None, None), (4, "http://d", "short"), (5, "http://e", "short"), (6, "u", "ü" * 700), (None, "n", long), (7, "z", "y" * 999), (8, "z", "y" * 999)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    back = warc.read_archives(warc.write_archives(warc.with_revisits(pages)))
    assert back.where("problem is not null").count() == 0
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    for k, _, html in rows:
        raw = (html or "").encode()
        assert (got[k]["payload_bytes"], got[k]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items() if r["record_type"] == "revisit"} == {1: ("revisit", 2), None: ("revisit", 2)}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_query_equals_sql(spark):
    import oracle

    sf = "/root/testdata/sf0.001"
    for name in ("op6_warc_zstd", "op7_embedding_near_dedup", "op10_poisson_mix"):
        assert oracle.compare(queries.QUERIES[name](spark, sf), oracle.connect(sf), queries.ORACLES[name]) is None


def test_links_of_embeddings_equal_sql(spark, tmp_path):
    import oracle

    _, df = vectors(spark, 300)
    df.withColumn("embedding", F.col("embedding").cast("array<float>")).write.parquet(f"{tmp_path}/embeddings.parquet")
    name = "op7_embedding_near_dedup"
    assert oracle.compare(queries.QUERIES[name](spark, str(tmp_path)), oracle.connect(str(tmp_path)), queries.ORACLES[name]) is None


def test_rare_sources_equal_sql(spark, tmp_path):
    import oracle

    rows = [(i, "t", None, "rare" if i < 2 else "big", 1) for i in range(4000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    name = "op10_poisson_mix"
    assert oracle.compare(queries.QUERIES[name](spark, str(tmp_path)), oracle.connect(str(tmp_path)), queries.ORACLES[name]) is None


def test_broken_archives(spark):
    good = warc.archive([warc.record(i, "http://x", f"page {i} ".encode() * 200, None) for i in range(60)])
    assert struct.unpack_from("<I", good)[0] == warc.DICTIONARY_FRAME and struct.unpack_from("<I", good, 4)[0] > 0
    packed = zstandard.ZstdCompressor().compress(good[8 : 8 + struct.unpack_from("<I", good, 4)[0]])
    again = struct.pack("<II", warc.DICTIONARY_FRAME, len(packed)) + packed + good[8 + struct.unpack_from("<I", good, 4)[0] :]
    wrong = warc.record(1, "u", b"payload", None)
    files = {"good": good, "compressed dictionary": again, "cut": good[:-5], "length": zstandard.compress(wrong.replace(b"Content-Length: 88", b"Content-Length: 99").replace(b"payload\r\n", b"pay\r\n")), "junk": b"nothing here", "digest": zstandard.compress(wrong.replace(b"payload\r\n", b"pAyload\r\n")), "empty": b"", "none": None}
    df = spark.createDataFrame(list(files.items()), "path string, content binary")
    got = defaultdict(list)
    for r in warc.read_archives(df).collect():
        got[r["archive"]].append(r["problem"])
    assert got["good"] == [None] * 60 == got["compressed dictionary"]
    assert "cut off" in got["cut"][-1] and len(got["cut"]) == 60 and all(got[k][0] for k in ("length", "junk", "digest")) and "empty" not in got


# --- 7 lattice --------------------------------------------------------------------------------------------------


def test_e8_decoding():
    r = np.random.default_rng(8)
    x = r.normal(size=(300, 8)) * 2
    p = lattice.decode(x) / 2
    d = ((x - p) ** 2).sum(1)
    assert (d <= 1 + 1e-9).all() and len(lattice.MINIMAL) == 240
    for v in lattice.MINIMAL:
        assert (((x - p - v) ** 2).sum(1) >= d - 1e-9).all()


@pytest.mark.parametrize("rows", [2048, 7])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(lattice, "CELL_ROWS", rows)
    x, df = vectors(spark)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    comp = plain_components([(int(a), int(b)) for a, b in zip(*np.nonzero(near))])
    got = {r["vec_id"]: r for r in lattice.near_duplicates(df).collect()}
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum() - 1, comp[i], comp[i] == i)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(len(x), len(x) + 5))
    assert lattice.near_duplicates(df.limit(0)).count() == 0
    r = np.random.default_rng(17)
    base = r.normal(size=(6, 16))
    odd = spark.createDataFrame([(None, base[0].tolist(), "x"), (7, base[0].tolist(), "x"), (7, (2 * base[0]).tolist(), "x"), (8, base[0].tolist()[:9], "x"), (9, [], "x"), (10, (base[0] + 0.01).tolist(), "x")], "vec_id long, embedding array<double>, cell string")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in lattice.near_duplicates(odd).collect()), key=str)
    assert got == sorted([(None, 0, None), (7, 2, 7), (7, 2, 7), (8, 0, 8), (9, 0, 9), (10, 2, 7)], key=str)


def test_every_form_finds_the_least_pairs(spark):
    r = np.random.default_rng(18)
    a = r.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = r.normal(size=a.shape)
    z -= (z * a).sum(1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    b = 0.9505 * a + np.sqrt(1 - 0.9505**2) * z
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))], "vec_id long, embedding array<float>")
    for _, *form in lattice.FORMS:
        got = {r["vec_id"]: r["n_links"] for r in lattice.near_duplicates(df, form=tuple(form)).collect()}
        assert sum(got[i] for i in range(400)) >= 398, form


# --- 8 toxicity -------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    r = np.random.default_rng(9)
    bad = ["kretin", "vermino"]
    rows = []
    for i in range(900):
        w = list(r.choice(WORDS, 60))
        if i % 6 == 0:
            w[int(r.integers(60))] = str(r.choice(bad)).upper() + ","
        rows.append((i, " ".join(w), "en" if i % 2 else "xx", int(i % 6 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    m = toxicity.fit(df, df.select("doc_id", "toxic"), F.col("doc_id") < 600)
    s = {r["doc_id"]: r["score"] for r in toxicity.score(df, m).collect()}
    test = [(s[i] >= toxicity.CUT) == bool(t) for i, _, _, t in rows if i >= 600]
    assert np.mean(test) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "!!!")], "doc_id long, text string")
    assert all(0 <= r["score"] < toxicity.CUT for r in toxicity.score(odd, m).collect())
    kept = toxicity.drop_toxic(df.withColumn("score", F.lit("x")), m)
    assert kept.columns == [*df.columns, "score"] and 700 < kept.count() < 800
    none = toxicity.fit(df, df.select("doc_id", "toxic").limit(0))
    assert toxicity.score(df, none).where("score >= 0.7").count() == 0


def test_toxicity_tells_every_language():
    langs = [f"l{i:02}" for i in range(12)]
    texts = [" ".join(f"{lang}w{(d + j) % 20}" for j in range(15)) for d in range(40) for lang in langs]
    m = toxicity.Model().fit(texts, np.arange(len(texts)) % 7 == 0, langs * 40)
    distinct, index, begins = toxicity.words(pa.array([*texts[:12], "nothing known", ""]))
    got = m.language(toxicity.buckets(distinct), index, begins)
    assert m.languages == langs and got.tolist() == [*range(12), -1, -1]
    assert m.shift.shape == (13,)


# --- 9 suffixes -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("most", "room"), [(100, 1 << 20), (4, 200)])
def test_suffix_array(most, room):
    r = np.random.default_rng(10)
    for k in range(150):
        n = int(r.integers(1, 60))
        t = r.integers(1, 2 + k % 4, n).astype(np.uint8)
        t = np.tile(t[: max(1, n // 5)], 6)[:n] if k % 3 == 0 else t
        t = np.r_[t, 255, t[: n // 2], 255].astype(np.uint8) if k % 7 == 0 else t
        order, common_ = suffix.suffix_array(t, most, room)
        x = t.tobytes() + b"\0"
        assert sorted(order.tolist()) == list(range(len(x)))
        suf = [x[i:] for i in order]
        assert [s[:most] for s in suf] == sorted(s[:most] for s in suf)
        for i in range(1, len(suf)):
            n = 0
            while n < min(len(suf[i]), len(suf[i - 1]), most) and suf[i][n] == suf[i - 1][n]:
                n += 1
            assert common_[i] == n


@pytest.mark.parametrize("rows", [1, 7, 4096])
def test_texts_of_names(monkeypatch, rows):
    monkeypatch.setattr(induction, "BLOCK_ROWS", rows)
    r = np.random.default_rng(19)
    for k in range(250):
        t = r.integers(1, 2 + k % 8, int(r.integers(1, 60)))
        t = np.tile(t[: max(1, len(t) // 5)], 6)[: len(t)] if k % 3 == 0 else t
        t = np.r_[t, 0]
        most = (1, 2, 4, 100)[k % 4]
        order, common_ = induction.sorted_names(t, most)
        suf = [tuple(t[i : i + most]) for i in order]
        assert sorted(order.tolist()) == list(range(len(t))) and suf == sorted(suf)
        for i in range(1, len(suf)):
            n = 0
            while n < min(len(suf[i]), len(suf[i - 1])) and suf[i][n] == suf[i - 1][n]:
                n += 1
            assert common_[i] == n


def plain_removal(texts, length=400):
    seen = defaultdict(int)
    for t in texts:
        for k in range(len(t) - length + 1):
            seen[t[k : k + length]] += 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[: len(t)] > 0
        out.append((int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return out


def test_anchors_of_every_string(monkeypatch):
    r = np.random.default_rng(14)
    passage = sentence(r, 120).encode()
    texts = [sentence(r, 50).encode() + passage + sentence(r, 30).encode(), passage[100:], b"", b"x" * 239, b"y" * 700, sentence(r, 400).encode()]
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    for step in (1 << 20, 333):
        monkeypatch.setattr(suffix, "STEP", step)
        at, of = defaultdict(set), defaultdict(list)
        for text, a, region, place, far, near, cores in suffix.anchors(np.frombuffer(b"".join(texts), np.uint8), offsets):
            for t, h, kind, p, f, n, c in zip(text.tolist(), a, region, place.tolist(), far.tolist(), near.tolist(), cores.tolist()):
                of[h, kind].append(texts[t][p - f : p - n + 400])
                for d in range(n, f + 1):
                    at[texts[t][p - d : p - d + 400]].add((int(h), d, c[d // 64]))
                    of[t].append(p - d)
                assert all((c[j] > 0) == (n // 64 <= j <= f // 64) for j in range(6))
        assert all(len(v) == 1 for v in at.values())  # equal strings: one anchor, distance and core
        assert all(sorted(of[t]) == list(range(max(0, len(x) - 399))) for t, x in enumerate(texts))
        assert all(len(set(v)) == 1 for k, v in of.items() if isinstance(k, tuple))


def plain_places(texts):
    """Hashes of places by their definition, from hashes of all grams."""
    out = []
    for t in texts:
        x = np.frombuffer(t, np.uint8)
        h = suffix.gram_hashes(x, 128) if len(x) >= 240 else np.empty(0, np.uint64)
        out.append([int(h[p]) for p in sorted({k + int(np.argmin(h[k : k + 113] >> np.uint64(32))) for k in range(len(x) - 239)})])
    return out


def test_places_of_every_passage(monkeypatch):
    r = np.random.default_rng(16)
    passage = sentence(r, 60).encode()[:240]
    texts = [sentence(r, 300).encode() + passage + sentence(r, 9).encode(), b"", b"z" * 300, sentence(r, 5).encode() + passage, passage, passage[:239]]
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    want = plain_places(texts)
    for step in (1 << 20, 300):
        monkeypatch.setattr(suffix, "STEP", step)
        got = [[] for _ in texts]
        for text, h in suffix.places(np.frombuffer(b"".join(texts), np.uint8), offsets):
            for t, x in zip(text.tolist(), h.tolist()):
                got[t].append(x)
        assert got == want
    assert set(want[4]) <= set(want[0]) and set(want[4]) <= set(want[3]) and want[4] and not want[5]


def test_a_shard_on_disk(monkeypatch):
    r = np.random.default_rng(15)
    passage = sentence(r, 150).encode()
    regions = [(b"".join([sentence(r, 20).encode()[: 10 * i], passage[i : 620 - 7 * i]])) for i in range(12)]
    monkeypatch.setattr(suffix, "STEP", 1000)
    out = []
    for room in (1 << 24, 500):
        shard = suffix.Shard(room)
        shard.add(np.arange(12), np.arange(12), np.zeros(12, int), pa.array(regions, pa.binary()))
        shard.add(np.arange(2), np.arange(2), np.zeros(2, int), pa.array(regions[:2], pa.binary()))  # rows that repeat
        out.append(shard.repeated().to_pylist())
    assert out[0] == out[1]
    gone = [np.zeros(len(x), bool) for x in regions]
    for row in out[0]:
        gone[row["a"]][row["lo"] : row["hi"]] = True
    assert [g.sum() for g in gone] == [w[0] for w in plain_removal(regions)]


@pytest.mark.parametrize("group", [256, 2])
def test_removal_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffix, "SHARD_GROUP", group)
    r = np.random.default_rng(11)
    passage = sentence(r, 90)
    docs = documents(spark)
    more = [(100 + i, sentence(r, int(r.integers(0, 60))) + (" é " if i % 2 else " ") + passage[i : 520 + 3 * i] + sentence(r, int(r.integers(0, 60)))) for i in range(12)]
    docs = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(*m, "en") for m in more], "doc_id long, text string, lang string"))
    listed = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    texts = [t for _, t in listed]
    at = plain_places(texts)
    seen = defaultdict(int)
    for h in itertools.chain(*at):
        seen[h] += 1
    want = sorted(((d, len(t), *w, sum(seen[h] > 1 for h in hs)) for (d, t), w, hs in zip(listed, plain_removal(texts), at)), key=repr)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"]), r["n_shared"]) for r in suffix.remove_repeats(docs).collect()), key=repr)
    assert got == want
    assert suffix.remove_repeats(docs.limit(0)).count() == 0


# --- 10 mixing --------------------------------------------------------------------------------------------------


def test_mixing_to_weights(spark):
    n = 6000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "big").when(F.col("id") % 2 == 0, "mid").otherwise(None).alias("source"), F.lit("t").alias("text"), F.lit(1).alias("rate"))
    w = spark.createDataFrame([("big", 1.0), ("mid", 3.0), (None, 4.0), ("absent", 9.0)], "source string, weight double")
    m = mixing.mix(docs, w)
    got = {r["source"]: r["count"] for r in m.groupBy("source").count().collect()}
    assert all(abs(got[k] / n - v) < 0.04 for k, v in (("big", 1 / 8), ("mid", 3 / 8), (None, 4 / 8)))
    one, two = mixing.mix(docs).select("doc_id", "__copy", "__order"), mixing.mix(docs.repartition(7)).select("doc_id", "__copy", "__order")
    assert rows_of(one) == rows_of(two)
    order = [r["__order"] for r in one.collect()]
    assert order == sorted(order)
    assert mixing.mix(docs.limit(0)).count() == 0
    ks = spark.range(20000).select(mixing.poisson_inverse(mixing.uniform("id"), F.lit(2.5)).alias("k")).agg(F.avg("k"), F.var_pop("k")).first()
    assert abs(ks[0] - 2.5) < 0.05 and abs(ks[1] - 2.5) < 0.12


def plain_draws(doc_id, mean):
    """The draws of one document from hashlib: one up to a mean of 500, else one for each piece of the mean."""
    pieces = math.ceil(mean / 500)
    out = 0
    for i in range(1, pieces + 1):
        u = int(hashlib.md5(f"{mixing.SEED}{f'/{i}' if pieces > 1 else ''}:{doc_id}".encode()).hexdigest()[:13], 16) / (1 << 52)
        k, term = 0, math.exp(-mean / pieces)
        total = term
        while u >= total and k < math.ceil(mean / pieces + 12 * math.sqrt(mean / pieces) + 20):
            k += 1
            term *= mean / pieces / k
            total += term
        out += k
    return out


def test_mixing_rare_sources_to_weights(spark):
    n = 20000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3, "rare").when(F.col("id") < 5, None).when(F.col("id") < 25, "edge").otherwise("big").alias("source"), F.lit("t").alias("text"))
    w = spark.createDataFrame([("rare", 1.0), (None, 1.0), ("edge", 1.0), ("big", 1.0)], "source string, weight double")
    m = mixing.mix(docs, w)
    got = {r["source"]: r["count"] for r in m.groupBy("source").count().collect()}
    assert all(abs(got[k] - n / 4) < 4 * (n / 4) ** 0.5 for k in ("rare", None, "edge", "big"))
    each = {r["doc_id"]: r["count"] for r in m.where("doc_id < 25").groupBy("doc_id").count().collect()}
    assert each == {i: plain_draws(i, n / 4 / (3 if i < 3 else 2 if i < 5 else 20)) for i in range(25)}
    assert m.select("doc_id", "__copy").distinct().count() == m.count()
    ks = spark.range(4000).select(mixing.draws(17, F.col("id"), F.lit(1250.0)).alias("k")).agg(F.avg("k"), F.var_pop("k")).first()
    assert abs(ks[0] - 1250) < 3 and abs(ks[1] - 1250) < 150


# --- the pipeline -----------------------------------------------------------------------------------------------


def test_pipeline_equals_its_parts(spark, reference):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "pii", "mix_sources", "byte_bpe"]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in at.collect()}
        at = common.settle(stage(spark, at, sf))
        after = at.collect()
        assert at.columns == docs.columns
        if name == "toxicity":
            gone = set(before) - {r["doc_id"] for r in after}
            assert all(labels.get(k, 1) for k in gone)
        elif name == "simhash_near_dedup":
            prints = {k: plain_fingerprint(r["text"]) for k, r in before.items()}
            comp = plain_components([(a, b) for a in prints for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3])
            assert {r["doc_id"] for r in after} == {k for k in prints if comp[k] == k}
        elif name == "pii":
            assert {r["doc_id"] for r in after} == set(before) and not any(plain_base(r["text"]) for r in after)
    want = sorted((r["doc_id"], hashlib.sha256(np.array(reference.encode_ordinary(r["text"]), "<u4").tobytes()).hexdigest()) for r in at.collect())
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, sf).collect()) == want


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_take_awkward_rows(spark, tmp_path, empty):
    import corpus_pipeline

    docs = documents(spark).withColumns({"rate": F.lit(1.0), "score": F.lit(2), "__copy": F.lit(3), "n": F.lit("n")})
    docs = docs.limit(0) if empty else docs
    labels = [(i, None, i % 7 == 0) for i in range(30)] + [(3, 1, True), (None, 0, False), (40, 0, None)]
    spark.createDataFrame([(a, b, None if c is None else int(c)) for a, b, c in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ids = {(r["doc_id"], r["text"]) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        assert (not rows) == empty, name
        if name != "byte_bpe":
            assert out.columns == docs.columns, name
            assert name == "pii" or {(r["doc_id"], r["text"]) for r in rows} <= ids, name
        if name in ("pii", "byte_bpe"):
            assert len(rows) == docs.count(), name
        docs = spark.createDataFrame(rows, out.schema)
