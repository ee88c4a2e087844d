"""Queries over the driver's tables for the operators of this subpackage, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import table

from . import ann, bpe, langid, lattice, mixing, pii, simhash, suffix, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def vocabulary() -> dict[str, str]:
    """Path and pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return {"path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding of every whole text."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), **vocabulary())


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@query
def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as drawn, all sources to the same share, in a global random order."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "text", "lang", "source", "n_chars", F.col("__copy").cast("long").alias("copy"), F.col("__order").alias("shuffle_key"))


ORACLES["op10_poisson_mix"] = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
means AS (SELECT source, (1.0::DOUBLE / (SELECT count(*) FROM counts)) * (SELECT sum(n) FROM counts)::DOUBLE / n AS rate FROM counts),
rates AS (SELECT source, ceil(rate / {mixing.LARGEST_MEAN})::INT AS pieces, CASE WHEN rate > {mixing.LARGEST_MEAN} THEN rate / ceil(rate / {mixing.LARGEST_MEAN}) ELSE rate END AS rate FROM means),
cdf(source, rate, k, term, total) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, term * rate / (k + 1), total + term * rate / (k + 1) FROM cdf
  WHERE k < ceil(rate + 12 * sqrt(rate) + 20)
),
pieces AS (SELECT source, pieces, unnest(range(1, pieces + 1)) AS piece FROM rates),
drawn AS (
  SELECT d.*, ('0x' || substr(md5('{mixing.SEED}' || CASE WHEN p.pieces > 1 THEN '/' || p.piece ELSE '' END || ':' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / {float(1 << 52)!r} AS u
  FROM documents d JOIN pieces p ON d.source IS NOT DISTINCT FROM p.source
),
copies AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, row_number() OVER (PARTITION BY d.doc_id) AS copy
  FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND d.u >= c.total
  WHERE c.k < ceil(c.rate + 12 * sqrt(c.rate) + 20)
)
SELECT doc_id, text, lang, source, n_chars, copy::BIGINT AS copy,
  ('0x' || substr(md5('{mixing.SEED + 1}:' || coalesce(doc_id::VARCHAR, '') || ':' || copy), 1, 13))::BIGINT / {float(1 << 52)!r} AS shuffle_key
FROM copies
"""


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the exact patterns, and all spans."""
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    line = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, pii.KINDS)), s["kind"] + 1), s["start"], s["end"])
    joined = lambda spans: F.array_join(F.transform(spans, line), ",")
    exact = F.filter("spans", lambda s: s["exact"])
    of = lambda k: F.filter("spans", lambda s: s["exact"] & (s["kind"] == k))
    counts = [F.size(of(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(exact).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def remainder(column: str, by: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose crc32 leaves no 2 by 4."""
    docs = table(spark, sf_dir, "documents")
    parser = langid.fit(docs.where(F.coalesce(remainder("doc_id", 4) != 2, F.lit(False))))
    return langid.predict(docs, parser).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    learn_from = remainder("doc_id", 3) != 1
    return toxicity.fit(docs.where(learn_from), labels, learn_from)


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels whose crc32 leaves no 1 by 3."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


@query
def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all embeddings at a cosine of 0.95."""
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs, which SQL can afford on a small table.
ORACLES["op7_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.c),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
g AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, g.component_id, g.component_id = e.vec_id AS kept FROM embeddings e JOIN g USING (vec_id) LEFT JOIN n ON n.a = e.vec_id
"""


@query
def op2_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every embedding whose id is divisible by 20, among all the others."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(ann.build_index(vectors, 20), vectors.where("vec_id % 20 = 0"), 20)


@query
def op6_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("problem")


ORACLES["op6_warc_zstd"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS n, sha1(html) AS digest FROM p),
g AS (SELECT digest, n, max(page_id) AS last FROM d WHERE n >= 1000 GROUP BY digest, n)
SELECT d.page_id, d.n AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN g.last IS NULL OR g.last = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.last <> d.page_id THEN g.last END AS refers_to
FROM d LEFT JOIN g ON d.digest = g.digest AND d.n = g.n
"""


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the bytes that 400-byte strings repeat."""
    cut = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_shared")
