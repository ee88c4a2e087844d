"""Queries do their whole job: against plain folds over tables that reach beyond the ranges of the driver's smallest."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import oracle
from lectern import plans
from lectern.functions import vectors
from lectern.plans import registry, scalars

SF = "/root/testdata/sf0.001"
plans.load()


@pytest.fixture
def tables(spark, tmp_path):
    """A function that writes tables as the driver's and gives their folder."""

    def write(**given):
        for name, (rows, schema) in given.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def run(spark, name, d):
    return sorted(tuple(r) for r in registry.QUERIES[name](spark, d).collect())


def test_points_of_every_recording(spark, tables):
    r = random.Random(1)
    turns = [(c, t, "user", "x" * r.randint(1, 90)) for c in (5, 99, 100, 731) for t in range(4)]
    events = [(i, r.choice([5, 99, 100, 731, 8000]), r.randint(0, 1600) / 8) for i in range(200)]
    d = tables(conversations=(turns, "conv_id long, turn long, role string, text string"), events=(events, "event_id long, user_id long, value double"))
    segs = {}
    for c, t, _, text in turns:
        start = t * 5.0 + (c % 7) / 4
        segs.setdefault(c, []).append((start, start + 0.5 + (len(text) % 40) / 10, c * 1000 + t))
    want = []
    for i, c, value in events:
        t = value / 8
        if c in segs:
            inside, later = [s for s in segs[c] if s[0] <= t < s[1]], [s for s in segs[c] if s[0] > t]
            seg, how = (min(inside), "inside") if inside else (min(later), "next") if later else (max(segs[c]), "last")
            want.append((c, i, seg[2], how))
    assert {w[0] for w in want} == {5, 99, 100, 731} and {w[3] for w in want} == {"inside", "next", "last"}
    assert run(spark, "join_point_in_interval", d) == sorted(want)


def plain_lm(texts, order=3):
    """(n, gram) that occur more than once, by tuple of words."""
    n = {}
    for w in texts:
        for k in range(1, order + 1):
            for i in range(len(w) - k + 1):
                n[tuple(w[i : i + k])] = n.get(tuple(w[i : i + k]), 0) + 1
    return {g: c for g, c in n.items() if c > 1}


def plain_score(context, lm):
    """Backing off from the longest match; -10 where even the word is unknown."""
    for at in range(len(context)):
        if context[at:] in lm:
            return round(-1.0 / lm[context[at:]] + sum(-0.5 / lm[context[k:-1]] for k in range(at) if context[k:-1] in lm), 9)
    return -10.0


def test_language_model_scores_every_word(spark, tables):
    r = random.Random(2)
    turns = [(c, t, "user", " ".join(r.choice(["a", "b", "c", "", "D", f"u{r.random()}"]) for _ in range(r.choice([1, 2, 3, 30])))) for c in range(6) for t in range(5)]
    turns += [(6, 0, "user", ""), (6, 1, "user", None), (6, 2, "user", "one"), (6, 3, "user", "A b")]
    d = tables(conversations=(turns, "conv_id long, turn long, role string, text string"))
    words = {c * 1000 + t: text.lower().split(" ") for c, t, _, text in turns if text is not None}
    lm = plain_lm(words.values())
    at = [(i, pos, tuple(w[max(0, pos - 2) : pos + 1])) for i, w in words.items() for pos in range(len(w))]
    scores = run(spark, "lm_backoff", d)
    want = sorted((i, pos, plain_score(g, lm)) for i, pos, g in at)
    assert [x[:2] for x in scores] == [x[:2] for x in want]
    assert [x[2] for x in scores] == pytest.approx([x[2] for x in want], abs=1e-8)
    assert run(spark, "lm_lookup", d) == sorted((i, pos, next((len(g) - k for k in range(len(g)) if g[k:] in lm), 0)) for i, pos, g in at)


def test_every_chunk_is_assigned(spark, tables):
    r = random.Random(3)
    vectors = [(25 * i + rec, [r.gauss(0, 1) for _ in range(8)], i % 6) for rec, n in ((0, 11), (1, 4), (2, 1)) for i in range(n)]
    d = tables(embeddings=(vectors, "vec_id long, embedding array<float>, label int"))
    got = {v: (rec, c) for rec, v, c in run(spark, "cl_assign_unique", d)}
    assert {v: x[0] for v, x in got.items()} == {v: v % 25 for v, _, _ in vectors}
    for rec in range(3):
        of = [v for v, _, _ in vectors if v % 25 == rec]
        for chunk in (of[i : i + 4] for i in range(0, len(of), 4)):
            picked = [got[v][1] for v in chunk]
            assert len(set(picked)) == len(picked) and set(picked) <= set(range(6))


def plain_lines(role, text):
    """Lines of a turn, a name before the first, without names of speakers."""
    t = ("Patient: " if role == "user" else "DOCTOR:  ") + text + "\\n"
    bare = [re.sub(r"^\s*(DOCTOR|PATIENT):\s*", "", x, flags=re.I).strip(" ") for x in t.replace("\\n", "\n").split("\n")]
    return [x for x in bare if x]


def test_every_line_of_a_turn(spark, tables):
    texts = ["one", " two \nDoctor: three\n\n  patient:four\\nfive", "\n", "", "Patients: six\n\nDOCTOR: ", None]
    turns = [(1, i, ("user", "assistant")[i % 2], x) for i, x in enumerate(texts)]
    d = tables(conversations=(turns, "conv_id long, turn long, role string, text string"))
    want = sorted((c, t, x) for c, t, role, text in turns if text is not None for x in plain_lines(role, text))
    assert run(spark, "sc_strip_speaker", d) == want and (1, 1, "three") in want and (1, 1, "five") in want
    of = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert run(spark, "sc_strip_speaker", SF) == sorted((c, t, x) for c, t, role, text in of for x in plain_lines(role, text))


def test_documents_of_every_language(spark, tables):
    texts = [("en", "  one. Two! three? Four \n \nfive"), ("de", "ärger hier. Über dort. über"), ("fr", "élan. Élan"), (None, "x\n\n\ny. Z"), ("es", ""), ("es", None)]
    d = tables(documents=([(i, x, lang) for i, (lang, x) in enumerate(texts)], "doc_id long, text string, lang string"))

    def norm(x):
        return x if x is None else x.lower().strip(" ")[:1].upper() + x.lower().strip(" ")[1:]

    def split(x):
        parts = [re.split(r"(?<=[.!?])\s+(?=[A-Z])", re.sub(r"\s+", " ", p, flags=re.A).strip(" ")) for p in re.split(r"\n\s*\n", x, flags=re.A)]
        return Counter(s.strip(" ") for p in parts for s in p if s.strip(" "))

    assert run(spark, "sc_peoples_norm", d) == [(i, norm(x)) for i, (_, x) in enumerate(texts)]
    want = sorted((i, s, n) for i, (_, x) in enumerate(texts) if x is not None for s, n in split(x).items())
    assert run(spark, "sc_sentence_split", d) == want and {w[0] for w in want} == {0, 1, 2, 3}
    of = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert run(spark, "sc_sentence_split", SF) == sorted((i, s, n) for i, x in of.items() for s, n in split(x).items())
    assert {i for i, _ in run(spark, "sc_peoples_norm", SF)} == set(of)


def test_every_letter_has_the_case_of_sql(spark, tables):
    every = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    newer = [*"\u1c89\u1c8a\ua7cb\ua7cc\ua7cd\ua7da\ua7db\ua7dc", *map(chr, range(0x10D50, 0x10D86))]
    letters = [x for x in every if x.lower() != x or x.upper() != x or x.isspace()] + newer
    texts = [*letters, *[f"a{x}" for x in letters], "ΑΣ ΒΣ", "İzmir", "　 ßheit  ", "", "  ", None]
    d = tables(documents=([(i, x) for i, x in enumerate(texts)], "doc_id long, text string"))
    assert oracle.compare(registry.QUERIES["sc_peoples_norm"](spark, d), oracle.connect(d), registry.ORACLES["sc_peoples_norm"]) is None


def test_whitened_vectors_are_those_of_sql_to_the_bit(spark):
    con = oracle.connect(SF)
    got = {r["vec_id"]: r["y"] for r in scalars._xvectors(spark, SF, 8).collect()}  # near a half of so many digits: some rows
    want = dict(con.execute(f"WITH {scalars._XVEC} SELECT vec_id, y FROM x").fetchall())
    near = [i for i, y in want.items() if any(abs(abs(v) * 1e8 % 1 - 0.5) < 5e-4 for v in y)]
    assert near and all(got[i] == want[i] for i in near) and got.keys() == want.keys()
    x = [-1e-7, -0.0, 0.0, 1e-7, -4.9e-7, 5e-7, -5e-7, 1.0000005, -1.0000015, 2.0000025, 1.4999999999, 5e15, float("nan"), float("inf"), None]
    near = spark.createDataFrame([(v,) for v in x], "x double").select(vectors.rounded(F.col("x"), 6)).collect()
    assert [str(r[0]) for r in near] == [str(con.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0]) for v in x]
