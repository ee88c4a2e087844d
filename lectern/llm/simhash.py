"""Near-duplicates by SimHash fingerprints and an index of deletion variants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, components, forest, pairs_within, settle, tidy

#: Words of a shingle, seed of its hash, bits that linked fingerprints may differ in.
WORDS, SEED, BITS = 3, 42, 3
#: A fingerprint is cut into two halves of 32 bits. Three differing bits leave one half with at most one.
HALF = 32
#: A run of equal keys above this length is compared by 16-bit pieces instead of whole.
LONG_RUN = 2048


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The signed 64-bit SimHash of a whole text; null and texts without words give 0."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends, at = [], -1
    for t in tokens:
        at += len(t) + 1
        ends.append(at)
    if len(tokens) <= words:
        digests = xxhash.xxh64_digest(line, seed)
    else:
        starts = [0, *[e + 1 for e in ends[:-1]]]
        h = xxhash.xxh64_digest
        digests = b"".join([h(line[i:j], seed) for i, j in zip(starts, ends[words - 1 :], strict=False)])
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(rows), 4096):
        ones += np.unpackbits(rows[i : i + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big", signed=True)


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words, seed) for t in b.column(1)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return run


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per half its value (position 32) and its 32 variants with one bit deleted."""
    for whole in batches:
        for k in range(0, whole.num_rows, 4000):
            b = whole.slice(k, 4000)
            ids, fps = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            keys = []
            for half in (0, 1):
                value = (fps.view(np.uint64) >> np.uint64(HALF * half)) & np.uint64(0xFFFFFFFF)
                keep = np.array([0xFFFFFFFF ^ (1 << p) for p in range(HALF)] + [0xFFFFFFFF], np.uint64)
                mark = (np.arange(HALF + 1, dtype=np.uint64) | np.uint64(half << 6)) << np.uint64(HALF)
                keys.append((value[:, None] & keep) | mark)
            key = np.concatenate(keys, axis=1).view(np.int64)
            n = key.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(fps, n)), pa.array(np.repeat(ids, n))], ["key", "fp", "id"])


def _near(fp: np.ndarray, i: np.ndarray, j: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(fp[i] ^ fp[j]) <= bits


def _run_edges(keys: np.ndarray, fp: np.ndarray, ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among rows sorted by key, as the edges of a forest per chunk of pairs."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    lengths = np.diff(np.append(starts, len(keys)))
    a, b = ids[:0], ids[:0]
    short = np.repeat((lengths > 1) & (lengths <= LONG_RUN), lengths)
    sf, si, sk = fp[short], ids[short], keys[short]
    for i, j in pairs_within(lengths[(lengths > 1) & (lengths <= LONG_RUN)]):
        # where one bit was deleted, halves that are equal meet under position 32 already
        deleted = (sk[i] >> HALF) & 63
        base = np.where((sk[i] >> (HALF + 6)) & 1, HALF, 0)
        apart = ((sf[i] ^ sf[j]).view(np.uint64) >> (base + np.minimum(deleted, HALF - 1)).astype(np.uint64)) & np.uint64(1)
        use = ((deleted == HALF) | (apart == 1)) & _near(sf, i, j, bits)
        a, b = forest(np.concatenate([a, si[i[use]]]), np.concatenate([b, si[j[use]]]))
    for s, n in zip(starts[lengths > LONG_RUN], lengths[lengths > LONG_RUN], strict=True):
        f, d = fp[s : s + n], ids[s : s + n]
        for piece in range(4):  # three differing bits leave one of four pieces equal
            part = (f.view(np.uint64) >> np.uint64(16 * piece)) & np.uint64(0xFFFF)
            order = np.argsort(part, kind="stable")
            cut = np.flatnonzero(np.diff(part[order])) + 1
            for i, j in pairs_within(np.diff(np.concatenate([[0], cut, [n]]))):
                i, j = order[i], order[j]
                use = _near(f, i, j, bits)
                a, b = forest(np.concatenate([a, d[i[use]]]), np.concatenate([b, d[j[use]]]))
    return a, b


def _links(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 3
        out = (held[0], held[0])

        def flush(key, fp, ids):
            return forest(*(np.concatenate(x) for x in zip(out, _run_edges(key, fp, ids, bits), strict=True))) if len(key) else out

        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            if len(held[0]) < 200_000:
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on
            out = flush(*(h[:cut] for h in held))
            held = [h[cut:] for h in held]
        out = flush(*held)
        for k in range(0, len(out[0]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(out[0][k : k + 50_000]), pa.array(out[1][k : k + 50_000])], ["a", "b"])

    return run


def simhash_groups(docs: DataFrame, words: int = WORDS, seed: int = SEED, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Fingerprints are first made distinct, so copies cost one row each. Every distinct one sends its two
    halves, whole and with one bit deleted, to the partition of that key; runs of equal keys are verified
    on all 64 bits. A run emits the edges of a forest instead of its pairs, so a group of m near copies
    makes at most m - 1 rows a key. Nothing is capped: long runs are compared by 16-bit pieces, of which
    one is equal in every pair sought.

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows come out as often as
    they came in. A row without doc_id gets the component of its fingerprint, or null if no row of that
    fingerprint has one. An empty table gives no rows; other columns are ignored.
    """
    if not 0 <= bits <= 3:
        raise ValueError("two halves with one deleted bit find at most three differing bits")
    bounded(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    prints = settle(rows.mapInArrow(tidy(_fingerprints(words, seed)), "doc_id long, fp long"))
    classes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("id")))
    keyed = classes.where("id is not null").select("id", "fp").mapInArrow(_variants, "key long, fp long, id long")
    edges = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_links(bits)), "a long, b long")
    groups = components(edges)
    named = settle(classes.join(groups, classes["id"] == groups["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id")))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **how: int) -> DataFrame:
    """docs without the rows whose group has a smaller doc_id; columns as they were.

    Rows that repeat a doc_id are copies too: of rows with the group's smallest doc_id one stays, the one
    with the smallest hash of all columns. Rows without doc_id stay.
    """
    bounded(docs.sparkSession)
    kept = settle(simhash_groups(docs, **how).where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct())
    named = [F.col(f"`{c}`") for c in docs.columns]
    some = docs.join(kept, docs["doc_id"] == kept["__kept"], "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*named)))
    return some.withColumn("__first", first).where("__first = 1").select(*named).union(docs.where("doc_id is null").select(*named))
