"""Byte-level BPE: encoding by the tokenizers library over Arrow batches, and decoding by the byte table."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, tidy

#: Pieces whose ids a Python worker remembers at most.
REMEMBERED = 100_000


def byte_table() -> dict[int, str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(shown))
    return table


class Codec:
    """A byte-level BPE vocabulary given as ranks (base64 of the token's bytes, then its rank, a line each).

    Each match of the pattern is merged by itself: the merges of the tokenizers library are all splits of
    a token into two tokens, in the order of ranks, so that they join what the ranks join.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(r) for a, r in (line.split() for line in f if line.strip())}
        self.to_char = byte_table()
        shown = {t: "".join(map(self.to_char.__getitem__, t)) for t in ranks}
        merges = [(shown[t[:i]], shown[t[i:]]) for t in sorted(ranks, key=ranks.__getitem__) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.tokenizer = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        from_char = {c: b for b, c in self.to_char.items()}
        self.bytes_of = {r: bytes(map(from_char.__getitem__, s)) for s, r in self.tokenizer.get_vocab().items()}
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        split = [self.pieces(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = list({p for ps in split for p in ps if p not in known})
        for i in range(0, len(new), 10_000):
            some = new[i : i + 10_000]
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[p] = np.array(e.ids, "<u4").tobytes()
        return [b"".join([known[p] for p in ps]) for ps in split]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids; characters that tokens split are whole again once their bytes are joined."""
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def offsets(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last; tokens inside a character share it."""
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        lead = np.concatenate([(raw & 0xC0) != 0x80, [True]]).cumsum() - 1
        ends = np.cumsum([len(self.bytes_of[i]) for i in np.frombuffer(ids, "<u4").tolist()], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        return lead[starts].astype(np.int32), (lead[np.maximum(ends - 1, 0)] + 1).astype(np.int32)


@lru_cache(1)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _texts(batch: pa.RecordBatch, i: int) -> list[str]:
    return [t or "" for t in batch.column(i).to_pylist()]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, starts array<int>, ends array<int>): token ids of the whole text and the
    characters [start, end) each token touches. Null texts count as empty and give empty arrays; rows are
    neither merged nor dropped, and other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            texts = _texts(b, 1)
            ids = c.encode_all(texts)
            spans = [c.offsets(t, i) for t, i in zip(texts, ids, strict=True)]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.frombuffer(i, "<i4") for i in ids], kind), pa.array([s for s, _ in spans], kind), pa.array([e for _, e in spans], kind)], ["doc_id", "ids", "starts", "ends"])

    bounded(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run, codec.cache_clear), "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes, text) of (doc_id, ids). Bytes that are no UTF-8, as where ids were cut inside a
    character, become U+FFFD in text and stay as they are in bytes. Null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            raw = [c.decode(np.array(i or [], "<u4").tobytes()) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())], ["doc_id", "bytes", "text"])

    bounded(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(tidy(run, codec.cache_clear), "doc_id long, bytes binary, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one pass, so that ids of a
    large corpus needn't leave the worker. Rows as for encode."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            ids = c.encode_all(_texts(b, 1))
            sha = lambda x: hashlib.sha256(x).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array([sha(c.decode(i)) for i in ids], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    bounded(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run, codec.cache_clear), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
