"""Language ID by cross-parsing entropy: a text is cut into the longest strings that a language's labelled text holds.

Each phrase points to a place of that text, so the language that explains the text with the fewest bits, phrases times
the logarithm of the length of its labelled text, wins: languages with little labelled text are not at a loss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

#: Bytes of labelled text behind all automata together, and behind one at most; documents they are drawn from, a language.
TRAIN_BYTES, LANGUAGE_BYTES, SAMPLE_DOCS = 256 << 10, 32 << 10, 40
#: A phrase costs at least the bits that point into so many bytes: shorter labelled texts know few strings at all.
LEAST_BYTES = 256
#: Texts are parsed in blocks of this many bytes side by side; what a phrase that crosses into a block changes is added.
BLOCK = 1024
#: How sharply the score follows the ratio of phrase counts.
SHARPNESS = 12


def byte_classes() -> np.ndarray:
    """The symbol of each byte: letters without case, any digit, any white space, any other ASCII, every byte above."""
    table = np.zeros(256, np.uint8)
    table[:128] = 1
    table[[9, 10, 11, 12, 13, 32]] = 2
    table[48:58] = 3
    table[65:91] = table[97:123] = np.arange(4, 30)
    table[128:] = np.arange(30, 158)
    return table


CLASSES = byte_classes()


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is its start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        now = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return step


class Parser:
    """Automata of several languages as one table. An entry holds the next state, and whether a phrase begins
    there because the longest match has ended: 2 * (first entry of the next state) + begins."""

    def __init__(self, texts: dict[str, bytes]):
        self.languages = sorted(texts)
        parts = [CLASSES[np.frombuffer(texts[k], np.uint8)] for k in self.languages]
        used = np.unique(np.concatenate([*parts, [0, 1, 2, 3]]))
        narrow = np.zeros(256, np.uint8)  # 0: a symbol no language has
        narrow[used] = np.arange(1, len(used) + 1)
        self.symbols = narrow[CLASSES]
        self.width = len(used) + 1
        tables, self.roots, at = [], [], 0
        for part in parts:
            step = automaton(narrow[part].tolist())
            root = np.full(self.width, 2 * at * self.width + 1, np.int64)
            for c, to in step[0].items():
                root[c] = 2 * (at + to) * self.width + 1
            table = np.tile(root, (len(step), 1))
            for s, go in enumerate(step[1:], 1):
                for c, to in go.items():
                    table[s, c] = 2 * (at + to) * self.width
            tables.append(table)
            self.roots.append(at * self.width)
            at += len(step)
        self.table = np.concatenate(tables).ravel().astype(np.int32) if tables else np.empty(0, np.int32)
        self.bits = np.log2([max(len(p), LEAST_BYTES) for p in parts]) if parts else np.empty(0)

    def phrases(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Phrases [text, language] of the texts data[start:end]: the longest match, then the next one from its end."""
        counts = np.zeros((len(starts), len(self.languages)), np.int64)
        n_blocks = -(-(ends - starts) // BLOCK)
        codes = self.symbols[data]
        for lo, hi in _slices(n_blocks, 4096):
            self._count(codes, starts[lo:hi], ends[lo:hi], n_blocks[lo:hi], counts[lo:hi])
        return counts

    def _count(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, n_blocks: np.ndarray, counts: np.ndarray) -> None:
        text = np.repeat(np.arange(len(starts)), n_blocks)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        begin = starts[text] + nth * BLOCK
        size = np.minimum(begin + BLOCK, ends[text]) - begin
        roots = np.array(self.roots, np.int32)
        entry = np.repeat(roots[:, None], len(begin), axis=1)
        order = np.argsort(-size, kind="stable")
        leave, seen = entry.copy(), np.zeros(entry.shape, np.int32)
        state, b, n = entry.copy(), begin[order], size[order]
        active = len(b) - np.searchsorted(n[::-1], np.arange(1, n[0] + 1), "left") if len(n) else []
        for t, k in enumerate(active):
            v = self.table.take(state[:, :k] + codes[b[:k] + t])
            seen[:, order[:k]] += v & 1
            state[:, :k] = v >> 1
        leave[:, order] = state
        # every block began at a root; where its text goes on from another state both parses run on until they meet
        inner = np.flatnonzero(nth > 0)
        while len(inner):
            true = leave[:, inner - 1]
            which, at = np.nonzero(true != entry[:, inner])
            block = inner[at]
            if not len(block):
                break
            one, two = entry[which, block], true[which, at]
            entry[which, block] = two
            more = np.zeros(len(block), np.int32)
            live = np.arange(len(block))
            for t in range(int(size[block].max())):
                live = live[(one[live] != two[live]) & (size[block[live]] > t)]
                if not len(live):
                    break
                c = codes[begin[block[live]] + t]
                v, w = self.table[one[live] + c], self.table[two[live] + c]
                more[live] += (w & 1) - (v & 1)
                one[live], two[live] = v >> 1, w >> 1
            seen[which, block] += more
            apart = one != two  # they never met: the block is left in another state
            leave[which[apart], block[apart]] = two[apart]
            inner = np.unique(block[apart]) + 1
            inner = inner[(inner < len(nth))]
            inner = inner[nth[inner] > 0]
        np.add.at(counts, text, seen.T)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        letters = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
        _, offsets, raw = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and at[-1] > at[0] else np.empty(0, np.uint8)
        counts = self.phrases(data, at[:-1] - at[0], at[1:] - at[0]) if len(self.languages) else np.zeros((len(texts), 0))
        if not counts.shape[1]:
            return ["und"] * len(texts), np.zeros(len(texts))
        cost = np.maximum(counts, 1) * self.bits
        share = (cost.min(1)[:, None] / cost) ** SHARPNESS
        score = np.where(letters, share.max(1) / share.sum(1), 0.0)
        best = cost.argmin(1)
        return [self.languages[b] if has else "und" for b, has in zip(best, letters, strict=True)], score


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring items whose sizes add up to about most."""
    if len(sizes):
        cut = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
        yield from zip([0, *cut.tolist()], [*cut.tolist(), len(sizes)], strict=True)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Parser:
    """Automata from (doc_id, text, lang); rows without text or lang are left out.

    They are built from a bounded sample of whole documents: of about SAMPLE_DOCS a language, picked by a hash of
    doc_id among those of up to LANGUAGE_BYTES bytes, as many as fit into LANGUAGE_BYTES, and TRAIN_BYTES for all
    languages together. A language all of whose documents are longer gives evenly spaced parts of its shortest one.
    The languages' counts are taken from all rows; there are assumed to be no more than some thousand.
    """
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col(f"`{id_col}`")), F.lit(1 << 30)) / float(1 << 30)
    rows = labelled.select(F.col(f"`{lang_col}`").alias("lang"), draw.alias("draw"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.where("text is not null and lang is not null and lang <> 'und'").withColumn("size", F.octet_length("text"))
    counted = rows.groupBy("lang").agg(F.count_if(F.col("size") <= LANGUAGE_BYTES).alias("n"), F.min(F.struct("size", "draw", "id")).alias("least")).collect()
    if not counted:
        return Parser({})
    each = min(LANGUAGE_BYTES, TRAIN_BYTES // len(counted))
    share = F.create_map(*[F.lit(x) for r in sorted(counted, key=lambda r: r["lang"]) for x in (r["lang"], min(1.0, 2.0 * SAMPLE_DOCS / max(1, r["n"])))])
    picked = rows.where((F.col("size") <= LANGUAGE_BYTES) & (F.col("draw") <= share[F.col("lang")])).select("lang", "draw", "id", "text")
    for r in (r for r in counted if not r["n"]):
        wide, starts = each // 16, [int(k * (r["least"]["size"] // 4 - each // 16) / 15) for k in range(16)]
        parts = F.concat_ws("\n", *[F.substring("text", s + 1, wide) for s in starts])
        this = (F.col("lang") == r["lang"]) & (F.col("size") == r["least"]["size"]) & F.col("draw").eqNullSafe(F.lit(r["least"]["draw"]))
        picked = picked.union(rows.where(this).select("lang", "draw", "id", parts).limit(1))
    texts: dict[str, list[tuple]] = {r["lang"]: [] for r in counted}
    for r in picked.toLocalIterator():
        texts[r["lang"]].append((r["draw"], r["id"] or 0, r["text"].encode("utf-8", "replace")))
    out = {}
    for k, some in texts.items():
        kept, left = [], each
        for _, _, x in sorted(some):
            if len(x) <= left or not kept and x is min((t for _, _, t in some), key=len):
                kept.append(x)
                left -= len(x)
        if not kept and some:
            kept = [min((t for _, _, t in some), key=len)]
        out[k] = b"\n".join(kept)
    return Parser({k: v for k, v in out.items() if v})


def predict(docs: DataFrame, parser: Parser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): for every whole text the language that explains it with the fewest bits, the first by
    name on ties; `und` and 0 where text is null or holds no letter, or no language was learned. score is the
    winner's share of (fewest / bits) to a fixed power: 1 over the number of languages at a tie, near 1 where no
    other comes close. Repeated rows come out as often as they came in, an empty table gives no rows, and columns
    other than id_col and text_col are ignored."""
    spark = bounded(docs.sparkSession)
    sent = spark.sparkContext.broadcast(parser)  # at most about 2 * TRAIN_BYTES states

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for b in batches:
            lang, score = p.predict(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
