"""A corpus pipeline of five stages, each a function of (spark, docs, sf_dir); part of lectern.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bpe, common, mixing, pii, queries, simhash, toxicity
from lectern.session import table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of this stage's input, doesn't reject. Null and empty texts
    score as a text without words; repeated rows are all kept or all dropped; an empty table stays empty."""
    return toxicity.drop_toxic(docs, queries.toxicity_model(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies; null and empty texts are one group. Of rows
    that repeat a doc_id one stays, rows without doc_id all stay, and an empty table stays empty."""
    return simhash.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with names of kinds in place of personal data; null texts stay null."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as drawn so that every source has the same share, in a global random order. Null is a source;
    rows with equal doc_id draw alike; an empty table stays empty."""
    return mixing.mix(docs).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document and the digests of its ids and of what they decode to; null texts count as empty."""
    return bpe.round_trip(docs, **queries.vocabulary())


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_copies),
    ("pii", without_personal_data),
    ("mix_sources", mixed),
    ("byte_bpe", encoded),
]

#: Three stages are models or fingerprints that SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage returns is written once, read by the next one, and then deleted."""
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.store(docs)
            if written is not None:
                common.release(written)
            written = docs
    return docs
