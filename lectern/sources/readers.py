"""Readers. Paths may be any that Spark opens."""

from __future__ import annotations

import io
import sqlite3
import struct
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def segments_json(spark: SparkSession, path: str) -> DataFrame:
    """[{start, end, speaker}], speaker_0 where none is given, by start."""
    df = spark.read.schema("start double, end double, speaker string").json(path, multiLine=True)
    return df.withColumn("speaker", F.coalesce("speaker", F.lit("speaker_0"))).orderBy("start", "end")


def shards(spark: SparkSession, path: str, columns: list[str], pattern: str = "train-*.parquet") -> DataFrame:
    """Only the named columns of the Parquet files whose names match."""
    return spark.read.option("pathGlobFilter", pattern).parquet(path).select(*columns)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that aren't blank; .gz is read as it is."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def vocabulary(lines: DataFrame, column: str = "line") -> DataFrame:
    """(piece, id) of `piece id` lines, split at the last blank; the word mark becomes a blank."""
    c = F.col(column)
    return lines.select(F.replace(F.regexp_extract(c, r"^(.*) (\d+)$", 1), F.lit("▁"), F.lit(" ")).alias("piece"), F.regexp_extract(c, r"^(.*) (\d+)$", 2).cast("int").alias("id")).where("id is not null")


def file_names(spark: SparkSession, path: str, pattern: str = "train-*.parquet") -> DataFrame:
    """(pos, name) of the files of a folder whose names match, in order of their names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    return spark.createDataFrame(list(enumerate(sorted(f.getPath().getName() for f in found))), "pos int, name string")


def arpa(spark: SparkSession, path: str) -> DataFrame:
    """(order, gram array<int>, logp, backoff) of an ARPA file, gzip or not. Entries with words that aren't ids below
    2^14 are left out; <unk> comes as an order of 0. Lines keep their order by file position, blocks are read side by side."""
    return arpa_entries(_file_lines(spark, path))


def arpa_words(spark: SparkSession, path: str) -> DataFrame:
    """(order, gram, logp, backoff) of an ARPA file of any words, joined by blanks."""
    return _arpa_rows(_file_lines(spark, path)).select("order", F.array_join("words", " ").alias("gram"), "logp", "backoff")


def _file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line): pos orders the lines of a file by the block they are in and their place there, whatever task reads it."""
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    return spark.read.text(path, lineSep="\n").select(at.alias("pos"), F.regexp_replace("value", r"\r$", "").alias("line"))


def _arpa_rows(lines: DataFrame) -> DataFrame:
    """(order, words, logp, backoff) of (pos, line): a line belongs to the last section begun before it. The sections are
    as few as orders, so they come as ranges of places instead of a window over all lines."""
    mark = F.regexp_extract("line", r"^\\(\d+)-grams:", 1).try_cast("int")
    marks = lines.where(F.col("line").startswith("\\")).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(mark, F.lit(0)).alias("order")))).alias("marks"))
    section = F.transform("marks", lambda m, i: F.struct(m["order"].alias("order"), m["pos"].alias("begin"), F.get("marks", i + 1)["pos"].alias("next")))
    sections = marks.select(F.inline(section)).where("order > 0")
    parts = F.split("line", "\t")
    body = lines.where("line like '%\t%'").join(F.broadcast(sections), (F.col("pos") > F.col("begin")) & (F.col("next").isNull() | (F.col("pos") < F.col("next"))))
    return body.select("order", F.split(F.trim(parts[1]), r"\s+").alias("words"), parts[0].try_cast("double").alias("logp"), F.coalesce(F.get(parts, F.lit(2)).try_cast("double"), F.lit(0.0)).alias("backoff")).where("logp is not null")


def arpa_entries(lines: DataFrame) -> DataFrame:
    """arpa() of (pos, line)."""
    ids = _arpa_rows(lines).withColumn("gram", F.transform("words", lambda x: x.try_cast("int")))
    good = ids.where(F.forall("gram", lambda x: x.isNotNull() & (x >= 0) & (x < 1 << 14)))
    unk = ids.where((F.col("order") == 1) & (F.col("words")[0] == "<unk>")).select(F.lit(0).alias("order"), F.array().cast("array<int>").alias("gram"), "logp", "backoff")
    return good.select("order", "gram", "logp", "backoff").union(unk)


#: Names of sample formats in containers (fixed values).
_WAV_CODECS = {1: "pcm", 3: "float", 6: "alaw", 7: "mulaw"}


def probe(content: bytes) -> list[tuple[int, str, int, int, int]]:
    """(stream, codec, rate, channels, frames) of the audio streams of a file by its headers: WAV, FLAC, AIFF and AU have one;
    what isn't one of these has none."""
    if content[:4] == b"RIFF" and content[8:12] == b"WAVE":
        at, form = 12, None
        while at + 8 <= len(content):
            name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
            if name == b"fmt " and size >= 16:
                form = struct.unpack_from("<HHIIHH", content, at + 8)
            elif name == b"data" and form:
                tag, channels, rate, _, block, bits = form
                return [(0, f"{_WAV_CODECS.get(tag, tag)}_{bits}", rate, channels, min(size, len(content) - at - 8) // max(1, block))]
            at += 8 + size + size % 2
    elif content[:4] == b"fLaC" and len(content) >= 26:
        x = int.from_bytes(content[18:26], "big")
        return [(0, f"flac_{((x >> 36) & 31) + 1}", x >> 44, ((x >> 41) & 7) + 1, x & 0xFFFFFFFFF)]
    elif content[:4] == b".snd" and len(content) >= 24:
        offset, size, kind, rate, channels = struct.unpack_from(">5I", content, 4)
        width = {2: 1, 3: 2, 4: 3, 5: 4, 6: 4}.get(kind, 1)
        return [(0, f"au_{kind}", rate, channels, min(size, len(content) - offset) // max(1, width * channels))]
    elif content[:4] == b"FORM" and content[8:12] in (b"AIFF", b"AIFC") and (at := content.find(b"COMM")) > 0 and len(content) >= at + 26:
        channels, frames, bits, exponent, mantissa = struct.unpack_from(">hIhHQ", content, at + 8)
        return [(0, f"aiff_{bits}", round(mantissa * 2.0 ** (exponent - 16383 - 63)), channels, frames)]
    return []


def audio_streams(files: DataFrame) -> DataFrame:
    """(path, stream, codec, rate, channels, frames), a row for every audio stream of (path, content)."""

    def run(batches):
        for pdf in batches:
            rows = [(p, *s) for p, c in zip(pdf["path"], pdf["content"], strict=True) for s in probe(c or b"")]
            yield pd.DataFrame(rows, columns=["path", "stream", "codec", "rate", "channels", "frames"])

    return files.select("path", "content").mapInPandas(run, "path string, stream int, codec string, rate int, channels int, frames long")


def read_stream(files: DataFrame, index) -> DataFrame:
    """(path, rate, channels, samples array<float>) of one audio stream of each of (path, content); index is a column or a
    number. Nulls where there is no such stream or it isn't PCM WAV."""

    def run(batches):
        for pdf in batches:
            rows = []
            for p, c, i in zip(pdf["path"], pdf["content"], pdf["index"], strict=True):
                found = [s for s in probe(c or b"") if s[0] == i]
                try:
                    rows.append((p, *decode_wav(c)) if found else (p, None, None, None))
                except (wave.Error, EOFError, ValueError):
                    rows.append((p, None, None, None))
            yield pd.DataFrame(rows, columns=["path", "rate", "channels", "samples"]).astype({"rate": "Int32", "channels": "Int32"})

    index = F.lit(index) if isinstance(index, int) else index
    return files.select("path", "content", index.alias("index")).mapInPandas(run, "path string, rate int, channels int, samples array<float>")


def sqlite_table(files: DataFrame, name: str, schema: str) -> DataFrame:
    """(path, columns of schema) of a table of every SQLite file of (path, content); files without it give no rows."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                db = sqlite3.connect(":memory:")
                db.deserialize(c)
                if db.execute("SELECT count(*) FROM sqlite_master WHERE type = 'table' AND name = ?", (name,)).fetchone()[0]:
                    yield pd.read_sql_query(f"SELECT {', '.join(columns)} FROM {name}", db).assign(path=p)[["path", *columns]]
                db.close()

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}")


def decode_wav(content: bytes) -> tuple[int, int, np.ndarray]:
    """Rate, channels and interleaved samples in [-1, 1] of a PCM WAV file."""
    with wave.open(io.BytesIO(content)) as f:
        width, raw = f.getsampwidth(), f.readframes(f.getnframes())
        if width == 1:
            x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
        elif width == 3:
            b = np.frombuffer(raw, np.uint8).reshape(-1, 3)
            x = (np.pad(b, ((0, 0), (1, 0))).view("<i4").ravel() / np.float32(1 << 31)).astype(np.float32)
        else:
            x = (np.frombuffer(raw, f"<i{width}") / np.float32(1 << (8 * width - 1))).astype(np.float32)
        return f.getframerate(), f.getnchannels(), x


def wav(spark: SparkSession, path: str) -> DataFrame:
    """(path, rate, channels, samples array<float>) of PCM WAV files, interleaved, in [-1, 1]; rate is null for what can't be read."""

    def decode(batches):
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows.append((p, *decode_wav(content)))
                except (wave.Error, EOFError, ValueError):
                    rows.append((p, None, None, None))
            yield pd.DataFrame(rows, columns=["path", "rate", "channels", "samples"]).astype({"rate": "Int32", "channels": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, rate int, channels int, samples array<float>")


def markdown_transcript(text):
    """A transcript's words on one line: its byte-order mark, blank lines and headings dropped."""
    lines = F.split(F.regexp_replace(text, "^﻿", ""), r"\r?\n")
    return F.array_join(F.transform(F.filter(lines, lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#")), lambda x: F.trim(x)), " ")
