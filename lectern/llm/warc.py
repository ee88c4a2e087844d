"""WARC archives as Zstandard frames with a dictionary in the leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, settle

#: Magic numbers (fixed values of the format): the frame that holds the dictionary, Zstandard frames, and
#: dictionaries; and the sixteen skippable frames.
DICTIONARY_FRAME, ZSTD_FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
#: Equal payloads from this many bytes on are written once and revisited.
REVISIT_BYTES = 1000
#: Records and bytes after which an archive is closed; bytes of its dictionary and of the records it is trained on.
ARCHIVE_RECORDS, ARCHIVE_BYTES, DICT_BYTES, TRAIN_BYTES = 1000, 8 << 20, 32 << 10, 1 << 20
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload groups are broadcast where they are counted to have no more rows than this.
BROADCAST_ROWS = 100_000
URN = "urn:lectern:page:"
CHUNK = 64 << 10


def record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP head alone."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{URN}{'' if page_id is None else page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if uri is not None:
        fields.append(("WARC-Target-URI", "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in uri)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{URN}{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The records as frames after a dictionary trained on the first of them; few records get none."""
    some, size = [], 0
    for r in records:
        some += [r[i : i + 8192] for i in range(0, min(len(r), TRAIN_BYTES - size), 8192)]
        size += len(r)
        if size >= TRAIN_BYTES:
            break
    trained = None
    if len(some) >= 32:
        try:
            trained = zstandard.train_dictionary(DICT_BYTES, some, k=256, d=8)
        except zstandard.ZstdError:  # too little or too uniform
            trained = None
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True, write_checksum=True)
    raw = b"" if trained is None else trained.as_bytes()
    return struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw + b"".join(packer.compress(r) for r in records)


def _dictionary(view: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of the leading skippable frame, and where the records begin."""
    if len(view) < 8 or struct.unpack_from("<I", view)[0] != DICTIONARY_FRAME:
        return None, 0
    size = struct.unpack_from("<I", view, 4)[0]
    if len(view) < 8 + size:
        raise ValueError("the dictionary frame is cut off")
    raw = bytes(view[8 : 8 + size])
    if len(raw) >= 4 and struct.unpack_from("<I", raw)[0] == ZSTD_FRAME:  # the dictionary itself may be compressed
        raw = zstandard.ZstdDecompressor().decompress(raw)
    if not raw:
        return None, 8
    if struct.unpack_from("<I", raw)[0] != DICTIONARY:
        raise ValueError("the leading frame holds no Zstandard dictionary")
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT), 8 + size


def frames(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of each frame of an archive, one record each."""
    view = memoryview(content)
    trained, at = _dictionary(view)
    opener = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
    while at < len(view):
        if len(view) < at + 4:
            raise ValueError(f"offset {at}: {len(view) - at} bytes are left over")
        magic = struct.unpack_from("<I", view, at)[0]
        if magic in SKIPPABLE:
            if len(view) < at + 8 or len(view) < at + 8 + struct.unpack_from("<I", view, at + 4)[0]:
                raise ValueError(f"offset {at}: a skippable frame is cut off")
            at += 8 + struct.unpack_from("<I", view, at + 4)[0]
            continue
        if magic != ZSTD_FRAME:
            raise ValueError(f"offset {at}: no frame begins here")
        unpack, parts, end = opener.decompressobj(), [], at
        while not unpack.eof:
            if end >= len(view):
                raise ValueError(f"offset {at}: the frame is cut off")
            parts.append(unpack.decompress(view[end : end + CHUNK]))
            end = min(end + CHUNK, len(view))
        end -= len(unpack.unused_data)
        yield at, b"".join(parts)
        at = end


def _fields(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError("a header line has no name")
        out[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def parse(raw: bytes) -> dict:
    """A record's fields, its payload (None for revisits) and the payload's full length. Raises ValueError where
    the version, a mandatory header, a length or a digest doesn't hold."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC version or no end of the headers")
    fields = _fields(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"{name} is missing")
    if not fields["content-length"].isdigit():
        raise ValueError("content-length is no number")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"content-length is {n}, the block has {len(rest) - 4} bytes")
    kind = fields["warc-type"]
    http, split, payload = rest[:n].partition(b"\r\n\r\n")
    if kind in ("response", "revisit"):
        if not split or not http.startswith(b"HTTP/"):
            raise ValueError("the block is no HTTP response")
        length = _fields(http.partition(b"\r\n")[2]).get("content-length", "")
        if not length.isdigit() or (kind == "response" and int(length) != len(payload)):
            raise ValueError("the HTTP length doesn't hold")
        size = int(length)
    else:
        payload, size = rest[:n], n
    digest = fields.get("warc-payload-digest", "")
    found = None
    if digest.lower().startswith("sha1:"):
        coded = digest[5:]
        found = coded.lower() if len(coded) == 40 else base64.b32decode(coded.upper()).hex()
        if kind == "response" and hashlib.sha1(payload).hexdigest() != found:
            raise ValueError("the payload digest doesn't hold")
    if kind == "revisit" and "warc-profile" not in fields:
        raise ValueError("a revisit has no profile")
    return {
        "record_id": fields["warc-record-id"].strip("<>"), "record_type": kind, "uri": fields.get("warc-target-uri"), "date": fields["warc-date"],
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None, "payload_digest": found, "payload_bytes": size, "payload": None if kind == "revisit" else payload,
    }


RECORD = "archive string, offset long, record_id string, record_type string, uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary, problem string"
_ARROW = [("archive", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("problem", pa.string())]


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in _ARROW], [k for k, _ in _ARROW])


def read_archives(files: DataFrame) -> DataFrame:
    """Records of archives given as (path, content), as the binaryFile source gives them.

    A record that doesn't hold comes as a row with its offset and what is wrong in `problem`; where a frame
    is broken, so that the next can't be found, that is the archive's last row. Empty and null contents give
    no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                path, content, rows, size, at = b.column(0)[k].as_py(), b.column(1)[k].as_py() or b"", [], 0, 0
                try:
                    for at, raw in frames(content):
                        try:
                            rows.append({"archive": path, "offset": at} | parse(raw))
                        except (ValueError, TypeError) as e:
                            rows.append({"archive": path, "offset": at, "problem": str(e)[:500]})
                        size += len(raw)
                        if size > ARCHIVE_BYTES:
                            yield _batch(rows)
                            rows, size = [], 0
                except (ValueError, zstandard.ZstdError) as e:
                    rows.append({"archive": path, "offset": at, "problem": str(e)[:500]})
                if rows:
                    yield _batch(rows)

    bounded(files.sparkSession)  # batches are bounded by bytes too, and an archive is never split
    return files.select(F.col("path").cast("string"), "content").mapInArrow(run, RECORD)


def write_archives(pages: DataFrame) -> DataFrame:
    """(path, content): the archives of (page_id, url, html, refers_to), settled in the shared folder.

    Every task packs its rows in order, closing an archive after ARCHIVE_RECORDS records or ARCHIVE_BYTES
    bytes, so that an archive is bounded however large its task is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size, name = 0, ""

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([archive(held)], pa.binary())], ["path", "content"])

        for b in batches:
            for page_id, url, html, refers_to in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                name = name or f"pages-{page_id}-{hashlib.sha1((html or '').encode()).hexdigest()[:12]}.warc.zst"
                held.append(record(page_id, url, (html or "").encode("utf-8"), refers_to))
                size += len(held[-1])
                if len(held) >= ARCHIVE_RECORDS or size >= ARCHIVE_BYTES:
                    yield close()
                    held, size, name = [], 0, ""
        if held:
            yield close()

    bounded(pages.sparkSession)
    return settle(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, content binary"))


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to): of rows with equal payloads of REVISIT_BYTES or more, the largest page_id is
    kept and the others refer to it. Equal means equal SHA-1 and length; null html counts as empty. Rows without
    page_id refer to the largest one of their payload if there is one; rows that repeat it are all kept."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    payload = F.col("html").cast("binary")
    rows = rows.withColumn("n", F.octet_length("html").cast("long")).withColumn("digest", F.when(F.col("n") >= REVISIT_BYTES, F.sha1(payload)))
    groups = rows.where(F.col("n") >= REVISIT_BYTES).groupBy(F.col("digest").alias("d"), F.col("n").alias("m")).agg(F.max("page_id").alias("last"), F.count("*").alias("c"))
    groups = settle(groups.where("c > 1").drop("c"))
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    joined = rows.join(groups, (rows["digest"] == groups["d"]) & (rows["n"] == groups["m"]), "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, problem) of every page, as read back from the archives."""
    back = read_archives(write_archives(with_revisits(pages)))
    number = lambda c: F.regexp_extract(c, r"(-?\d+)$", 1).try_cast("long")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers_to").isNotNull(), number("refers_to")).alias("refers_to"), "problem")
