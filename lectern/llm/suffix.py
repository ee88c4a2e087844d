"""Repeated passages by suffix sorting: anchors bring equal strings to one shard, induced sorting finds them there.

Every string of LENGTH bytes has an anchor, the leftmost smallest hash of GRAM bytes in it, which depends on the
string alone. So equal strings have equal anchors at the same distance. The starts of the strings of one anchor are
neighbours; the bytes these strings cover are its region. Anchors that occur once need no text, and equal regions are
sorted once. Regions that share an anchor and a core with another one are dealt to shards, each of which is sorted.

Shorter passages are counted, not removed: every SHORT bytes hold a place, the leftmost smallest hash of SHORT_GRAM bytes
in them, so a passage of SHORT bytes that occurs elsewhere has a place that does, and none does by less than SHORT_GRAM.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import induction
from .common import bounded, release, store

LENGTH, GRAM = 400, 64
SHORT, SHORT_GRAM = 240, 128
#: Bytes of a shard, about.
SHARD_BYTES = 3 << 20
#: Regions of one anchor that a shard gets at most. An anchor with more is split by hashes of its strings.
SHARD_GROUP = 4096
#: Neighbouring starts of strings that such an anchor's regions are first compared by together.
BLOCK = 16
#: Bytes that a shard holds in memory of each of its text, queues and results; what is beyond goes to disk.
ROOM = 32 << 20
#: Starts of strings before an anchor are told apart by so many bytes at first: strings of one stride share a core.
STRIDE, CORES = 64, 6
#: Starts looked at together.
STEP = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)


# --- anchors ----------------------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of size bytes (a power of two), by doubling; mixed, so that their order is random."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    power, n = MULTIPLIER, 1
    with np.errstate(over="ignore"):
        while n < size:
            h = h[:-n] * power + h[n:]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            n *= 2
        h ^= h >> np.uint64(31)
    return h


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of width values."""
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = (x ^ y) * MULTIPLIER
    return x ^ (x >> np.uint64(29))


def anchors(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, anchor, region, place, far, near, cores) of the texts data[offsets[k]:offsets[k + 1]], some at a time.

    An anchor is the hash of its GRAM bytes at place. Its strings start far to near bytes before it. A region is a hash
    of all that these strings cover. Strings that start STRIDE * j up to STRIDE * (j + 1) bytes before the anchor share a
    core; cores [anchor, j] are 16 bits of its hash, or 0 where no string starts there.
    """
    for lo in range(0, max(0, len(data) - LENGTH + 1), STEP):
        part = data[lo : lo + STEP + LENGTH - 1]
        if len(part) < LENGTH:
            return
        h = gram_hashes(part, GRAM)
        packed = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        least = (sliding_minimum(packed, LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first_text, last_text = np.searchsorted(offsets, [lo, lo + len(least)], "right") - 1
        ends = offsets[first_text + 1 : last_text + 2] - lo  # of the texts here
        text = np.searchsorted(ends, np.arange(len(least)), "right")
        inside = np.flatnonzero(np.arange(len(least)) + LENGTH <= ends[np.minimum(text, len(ends) - 1)])
        if not len(inside):
            continue
        least, text = least[inside], text[inside]
        begin = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])])
        first, last, at, text = inside[begin], inside[np.r_[begin[1:], len(inside)] - 1], least[begin], text[begin]
        far, near = at - first, at - last
        region = _mixed(far.astype(np.uint64), near.astype(np.uint64) << np.uint64(32))
        for k in range(0, 2 * LENGTH, GRAM):
            use = np.flatnonzero(first + k < last + LENGTH)
            region[use] = _mixed(region[use], h[np.minimum(first[use] + k, last[use] + LENGTH - GRAM)])
        stride = np.arange(CORES)
        there = (stride >= (near // STRIDE)[:, None]) & (stride <= (far // STRIDE)[:, None])
        start = np.where(there, at[:, None] - STRIDE * stride, 0)
        core, size = np.zeros(start.shape, np.uint64), LENGTH - STRIDE + 1
        for d in [*range(0, size - GRAM, GRAM), size - GRAM]:
            core = _mixed(core, h[np.minimum(start + d, len(h) - 1)])
        core = np.where(there, np.maximum((core >> np.uint64(48)).astype(np.int64), 1), 0)
        yield text + first_text, h[at], region, at + lo - offsets[text + first_text], far, near, core


def places(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, hash) of the places of the texts data[offsets[k]:offsets[k + 1]], some at a time; a place that two parts see
    comes once."""
    done = -1
    for lo in range(0, max(0, len(data) - SHORT + 1), STEP):
        h = gram_hashes(data[lo : lo + STEP + SHORT - 1], SHORT_GRAM)
        packed = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        least = (sliding_minimum(packed, SHORT - SHORT_GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        text = np.searchsorted(offsets, lo + np.arange(len(least)), "right") - 1
        inside = lo + np.arange(len(least)) + SHORT <= offsets[np.minimum(text + 1, len(offsets) - 1)]
        at, first = np.unique(least[inside], return_index=True)
        new = at + lo > done
        if new.any():
            yield text[inside][first][new], h[at[new]]
            done = int(at[-1]) + lo


def _utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts without nulls, and where each begins."""
    column = column.cast(pa.large_string())
    _, offsets, raw = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


#: Rows of places have an anchor alone.
RAW = "doc long, mark long, a long, r long, at int, far short, near short, c0 long, c1 long"


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of RAW for every anchor and every place of every text."""
    names = [c.split()[0] for c in RAW.split(", ")]
    for b in batches:
        docs, marks = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for text, a in places(*_utf8(b.column(2))):
            none = [pa.nulls(len(a), t) for t in (pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(docs[text]), pa.array(marks[text]), pa.array(a.view(np.int64)), *none], names)
        for text, a, r, at, far, near, core in anchors(*_utf8(b.column(2))):
            packed = [core[:, j] | core[:, j + 1] << 16 | core[:, j + 2] << 32 for j in (0, 3)]
            cols = [docs[text], marks[text], a.view(np.int64), r.view(np.int64), at.astype(np.int32), far.astype(np.int16), near.astype(np.int16), *packed]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)


# --- induced sorting --------------------------------------------------------------------------------------------


def disk_array(n: int, dtype: type, room: int) -> np.ndarray:
    """Zeros, in a file without a name where they are more than room bytes."""
    size = n * np.dtype(dtype).itemsize
    if size <= room:
        return np.zeros(n, dtype)
    with tempfile.TemporaryFile() as file:
        file.truncate(size)
        return np.memmap(file, dtype, "r+", shape=(n,))


class Queues:
    """One queue for each first byte: suffixes come out in the order they were put, smallest byte first. Whatever is
    put has a byte not before the one being read, so first-in first-out per byte is all the priority there is. Each
    suffix carries its common prefix with the one before it in its queue. Beyond a size, queues continue on disk."""

    def __init__(self, symbols: int = 256, room: int = ROOM):
        self.held: list[list[tuple]] = [[] for _ in range(symbols)]
        self.size, self.room, self.file = 0, room, None

    def put(self, symbol: int, suffix: np.ndarray, common: np.ndarray) -> None:
        if not len(suffix):
            return
        if self.size + suffix.nbytes + common.nbytes > self.room:
            self.file = self.file or tempfile.TemporaryFile()  # has no name, so it goes with the process
            at = self.file.seek(0, 2)
            self.file.write(suffix.tobytes())
            self.file.write(common.tobytes())
            self.held[symbol].append((at, len(suffix), suffix.dtype, common.dtype))
        else:
            self.size += suffix.nbytes + common.nbytes
            self.held[symbol].append((suffix, common))

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All that the queue of a symbol holds now."""
        parts, self.held[symbol] = self.held[symbol], []
        if not parts:
            return None
        out = []
        for part in parts:
            if len(part) == 4:
                at, n, a, b = part
                self.file.seek(at)
                out.append((np.frombuffer(self.file.read(n * a.itemsize), a), np.frombuffer(self.file.read(n * b.itemsize), b)))
            else:
                self.size -= part[0].nbytes + part[1].nbytes
                out.append(part)
        return out[0] if len(out) == 1 else (np.concatenate([s for s, _ in out]), np.concatenate([c for _, c in out]))

    def close(self) -> None:
        if self.file:
            self.file.close()


def range_minima(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(x[lo:hi]) for each pair, hi > lo."""
    out, size, level, k = np.empty(len(lo), x.dtype), hi - lo, x, 0
    longest = int(size.max(initial=0))
    while (1 << k) <= longest:
        use = np.flatnonzero((size >> k) == 1)
        out[use] = np.minimum(level[lo[use]], level[hi[use] - (1 << k)])
        if (2 << k) <= longest:
            level = np.minimum(level[: -(1 << k)], level[1 << k :])
        k += 1
    return out


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, up to most, eight bytes at a time."""
    out, live, k = np.zeros(len(a), np.int64), np.arange(len(a)), 0
    x, y = a.astype(np.int64), b.astype(np.int64)
    step, last = np.arange(8), len(text) - 1
    while len(live) and k < most:
        same = text[np.minimum(x[live, None] + k + step, last)] == text[np.minimum(y[live, None] + k + step, last)]
        n = np.where(same.all(1), 8, same.argmin(1))
        out[live] += n
        live, k = live[n == 8], k + 8
    return np.minimum(np.minimum(out, most), len(text) - np.maximum(x, y)).astype(np.int16)


def suffix_types(text: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; text ends with a byte smaller than all others."""
    n, step = len(text), STEP
    out[-1] = nxt = True
    if n < 2:
        return out
    for lo in range((n - 2) // step * step, -1, -step):
        x, y = text[lo : min(lo + step, n - 1)], text[lo + 1 : min(lo + step, n - 1) + 1]
        differs = np.flatnonzero(x != y)
        at = np.searchsorted(differs, np.arange(len(x)))
        known = np.append(x[differs] < y[differs], nxt)  # equal bytes go by the next ones that differ
        out[lo : lo + len(x)] = known[at]
        nxt = out[lo]
    return out


class _Induction:
    """Sweeps over the buckets of a text: from the suffixes read so far to the ones a byte longer."""

    def __init__(self, text: np.ndarray, small: np.ndarray, most: int, room: int):
        self.text, self.small, self.most, self.room = text, small, most, room
        self.symbols = 256

    def sweep(self, seeds: Queues, left: bool, backwards: bool = False) -> Queues:
        """seeds: per symbol suffixes and common prefixes in this sweep's order, or in the opposite one. Left to right it
        induces the larger-type suffixes, right to left the smaller-type ones, in this sweep's order."""
        queues, out = Queues(self.symbols, self.room), Queues(self.symbols, self.room)
        self.lowest = np.full(self.symbols, self.most, np.int16)  # least common prefix read since the symbol's last put
        self.begun = np.zeros(self.symbols, bool)
        for c in range(self.symbols) if left else range(self.symbols - 1, -1, -1):
            # left to right the induced suffixes of a bucket come before its seeds; right to left it is the same
            self.lowest[:] = 0  # suffixes of different buckets share nothing
            last = None
            while (wave := queues.take(c)) is not None:
                out.put(c, *wave)
                self._read(*wave, left, queues, last is None)
                last = wave[0][-1:]
            if (own := seeds.take(c)) is not None:
                s, k = own
                if backwards:
                    s, k = s[::-1], np.append(k[:1], k[1:][::-1])
                if last is not None:  # the seam between the two kinds
                    k = np.append(common_prefix(self.text, last, s[:1], self.most), k[1:])
                self._read(s, k, left, queues, last is None)
        queues.close()
        seeds.close()
        return out

    def _read(self, suffix: np.ndarray, common: np.ndarray, left: bool, queues: Queues, first: bool) -> None:
        if first:
            common = np.append(np.zeros(1, np.int16), common[1:])
        before = suffix - 1
        use = np.flatnonzero((before >= 0) & (self.small[np.maximum(before, 0)] != left))
        if not len(use):
            np.minimum(self.lowest, common.min(), out=self.lowest)
            return
        target = self.text[before[use]]
        by = np.argsort(target, kind="stable")
        use, target = use[by], target[by]
        head = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
        symbol, ends = target[head], np.append(head[1:], len(use))
        previous = np.append(-1, use[:-1])
        previous[head] = -1
        least = range_minima(common, previous + 1, use + 1)
        least[head] = np.minimum(least[head], self.lowest[symbol])
        share = np.minimum(least + 1, self.most).astype(np.int16)
        share[head[~self.begun[symbol]]] = 0
        moved = before[use]
        for c, h, e in zip(symbol.tolist(), head.tolist(), ends.tolist(), strict=True):
            queues.put(c, moved[h:e], share[h:e])
        np.minimum(self.lowest, common.min(), out=self.lowest)
        last = use[ends - 1]
        rest = np.full(len(last), self.most, np.int16)
        inner = np.flatnonzero(last + 1 < len(common))
        if len(inner):
            rest[inner] = np.minimum.accumulate(common[::-1])[::-1][last[inner] + 1]
        self.lowest[symbol] = rest
        self.begun[symbol] = True


def sorted_suffixes(text: np.ndarray, most: int = LENGTH, room: int = ROOM) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of text in order, by first byte, and each one's common prefix with the one before it, up to most bytes.

    text is bytes without 0 but at its end. Order beyond most bytes isn't kept apart. Leftmost smaller-type suffixes
    are named by the strings between them, and the text of their names is sorted in turn; two sweeps then induce all
    others, and their common prefixes with them. Text, types, queues and results go to disk beyond room bytes each.
    """
    kind = np.int32 if len(text) < 1 << 31 else np.int64
    small = suffix_types(text, disk_array(len(text), bool, room))
    seeds = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(kind)
    sweep, sent = _Induction(text, small, most, room), len(text) - 1
    s, k = _ranked_seeds(text, seeds, most)
    start = Queues(room=room)
    cut = np.searchsorted(text[s], np.arange(257))
    for c, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        start.put(c, s[a:b], k[a:b])
    larger = sweep.sweep(start, True)
    again = Queues(room=room)
    for c in range(256):
        if (held := larger.take(c)) is not None:
            again.put(c, *held)
            larger.put(c, *held)
    # right to left: within a bucket larger ones come after smaller ones, so they seed from the end
    smaller = sweep.sweep(again, False, backwards=True)
    for c in range(256):
        one, two = larger.take(c), smaller.take(c)
        if c == 0:
            one, two = (np.array([sent], kind), np.zeros(1, np.int16)), None
        if two is not None:
            s, k = two[0][::-1], np.append(np.zeros(1, np.int16), two[1][1:][::-1])
            two = s, k if one is None else np.append(common_prefix(text, one[0][-1:], s[:1], most), k[1:])
        if both := [x for x in (one, two) if x is not None]:
            yield np.concatenate([x for x, _ in both]), np.concatenate([x for _, x in both])
    larger.close()
    smaller.close()


def suffix_array(text: np.ndarray, most: int = LENGTH, room: int = ROOM) -> tuple[np.ndarray, np.ndarray]:
    """All of sorted_suffixes at once for bytes without 0; a 0 is added."""
    return tuple(map(np.concatenate, zip(*sorted_suffixes(np.append(text, 0).astype(np.uint8), most, room), strict=True)))


def _ranked_seeds(text: np.ndarray, seeds: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that start at seeds in order, with their common prefixes: the strings between seeds are named, the text of
    their names is sorted by the same induction in turn, and tells how many strings two neighbours share; only the
    first strings that differ are compared by bytes."""
    n = len(seeds)
    if not n:
        return seeds, np.empty(0, np.int16)
    name = _names(text, seeds, np.append(seeds[1:], len(text) - 1))
    if name.max() + 1 < n:
        by, agree = induction.sorted_names(name, most // 2 + 1)  # a string has two bytes that the next one hasn't
    else:
        by, agree = np.argsort(name, kind="stable"), np.zeros(n, np.int64)
    del name
    a, b = by[:-1], by[1:]
    ends = np.append(seeds, len(text) - 1)
    shared = (ends[np.minimum(a + agree[1:], n)] - seeds[a]).astype(np.int64)
    open_ = np.flatnonzero(shared < most)
    x, y = seeds[a][open_], seeds[b][open_]
    shared[open_] += common_prefix(text, x + shared[open_], y + shared[open_], most)
    return seeds[by], np.append(0, np.minimum(shared, most)).astype(np.int16)


def _names(text: np.ndarray, a: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ranks of the strings text[a:end + 1], eight bytes at a time; where one is the start of another the longer one,
    which goes on with smaller bytes, is told apart by what follows."""
    n = len(a)
    name = np.zeros(n, np.int64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    live, k = np.arange(n), 0
    while len(live):
        at = a[live] + k
        word = np.zeros(len(live), np.uint64)
        for j in range(7):  # seven bytes and how many of them belong to the string
            inside = at + j <= ends[live]
            word = (word << np.uint64(8)) | np.where(inside, padded[np.minimum(at + j, len(text))], 255).astype(np.uint64)
        left = np.clip(ends[live] + 1 - at, 0, 8).astype(np.uint64)
        key = (word << np.uint64(8)) | (np.uint64(8) - left)
        order = np.lexsort((key, name[live]))
        changed = np.r_[True, (name[live][order][1:] != name[live][order][:-1]) | (key[order][1:] != key[order][:-1])]
        rank = np.cumsum(changed) - 1
        first = np.flatnonzero(changed)
        # a name becomes the number of strings before its group, so that names of those at rest still compare
        base = name[live][order][first]
        group = np.flatnonzero(np.r_[True, base[1:] != base[:-1]])
        offset = first - np.repeat(first[group], np.diff(np.r_[group, len(first)]))
        name[live[order]] = (base + offset)[rank]
        counts = np.diff(np.r_[first, len(order)])
        more = np.empty(len(live), bool)
        more[order] = counts[rank] > 1
        live = live[more & (ends[live] + 1 - at > 7)]
        k += 7
    return np.unique(name, return_inverse=True)[1]


# --- a shard ----------------------------------------------------------------------------------------------------


class Shard:
    """Regions of a shard as one text, whose strings that occur twice are found by sorting its suffixes."""

    def __init__(self, room: int = ROOM):
        self.room, self.held, self.size, self.file = room, [], 0, tempfile.SpooledTemporaryFile(room)
        self.keys: list[np.ndarray] = []
        self.known: set[tuple[int, int]] = set()

    def add(self, a: np.ndarray, r: np.ndarray, lead: np.ndarray, content: pa.Array) -> None:
        """Regions of the given anchors and hashes; a region that came before, from a row that repeats another, is left out."""
        new = []
        for k, key in enumerate(zip(a.tolist(), r.tolist(), strict=True)):
            if key not in self.known:
                self.known.add(key)
                new.append(k)
        a, r, lead, content = a[new], r[new], lead[new], content.take(pa.array(new, pa.int64()))
        size = np.array([len(c.as_buffer()) for c in content], np.int64)
        self.file.write(b"".join([x for c in content for x in (c.as_buffer(), b"\xff")]))
        self.keys.append(np.stack([a, r, lead, size], axis=1).astype(np.int64))

    def text(self) -> np.ndarray:
        """Bytes moved up by one below 0xFF, which UTF-8 never has and ends each region, so that 0 is free for the end."""
        n = self.file.tell()
        self.file.seek(0)
        out = disk_array(n + 1, np.uint8, self.room)
        for lo in range(0, n, STEP):
            part = np.frombuffer(self.file.read(min(STEP, n - lo)), np.uint8)
            out[lo : lo + len(part)] = part + (part != 0xFF)
        self.file.close()
        return out

    def repeated(self) -> pa.RecordBatch:
        """(a, r, lo, hi): what repeated strings cover, from the anchor's start."""
        a, r, lead, size = np.concatenate(self.keys).T
        text = self.text()
        start = np.cumsum(size + 1) - size - 1
        hit = disk_array(len(text), np.int8, self.room)
        for s, n in zip(start.tolist(), size.tolist(), strict=True):
            hit[s : s + n - LENGTH + 1] = 1  # starts of strings of the region; all are in different places
        for order, common in sorted_suffixes(text, LENGTH, self.room):
            group = np.cumsum(common < LENGTH)
            use = np.flatnonzero(hit[order])
            several = np.bincount(group[use], minlength=1) > 1
            hit[order[use[several[group[use]]]]] = 2
        edges = np.flatnonzero(np.diff(np.append(np.append(0, hit == 2), 0)))
        lo, hi = edges[::2], edges[1::2]
        of = np.searchsorted(start, lo, "right") - 1
        cols = a[of], r[of], (lo - start[of] - lead[of]).astype(np.int32), (hi - 1 + LENGTH - start[of] - lead[of]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "r", "lo", "hi"])


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = Shard()
    for b in batches:
        shard.add(*(b.column(i).to_numpy(zero_copy_only=False) for i in range(3)), b.column(3))
    if shard.keys:
        yield shard.repeated()


# --- the operator -----------------------------------------------------------------------------------------------


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, wanted anchors) to a row of bytes for each region, narrowed to the strides that may repeat."""
    names = ("a", "r", "lead", "many", "content")
    for b in batches:
        rows: dict[str, list] = {k: [] for k in names}
        for text, wanted in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            text = memoryview(text.as_buffer())
            for w in wanted:
                far, near = min(w["far"], STRIDE * (w["most"] + 1) - 1), max(w["near"], STRIDE * w["least"])
                for k, v in zip(names, (w["a"], w["r"], far, w["many"], bytes(text[w["at"] - far : w["at"] - near + LENGTH])), strict=True):
                    rows[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(rows["a"], pa.int64()), pa.array(rows["r"], pa.int64()), pa.array(rows["lead"], pa.int32()), pa.array(rows["many"], pa.bool_()), pa.array(rows["content"], pa.binary())], list(rows))


def _hash(x: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "big", signed=True)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of a region in blocks of BLOCK neighbouring starts: what all strings of a block share, and what they
    cover together, as hashes; near and far are how far before the anchor the block's strings start."""
    for whole in batches:
        for s in range(0, whole.num_rows, 500):
            out: dict[str, list] = {k: [] for k in ("a", "r", "block", "near", "far", "core", "outer")}
            for anchor, kind, lead, content in zip(*(whole.slice(s, 500).column(i).to_pylist() for i in range(4)), strict=True):
                least, most = lead + LENGTH - len(content), lead
                for j in range(least // BLOCK, most // BLOCK + 1):
                    near, far, at = max(least, j * BLOCK), min(most, j * BLOCK + BLOCK - 1), lead - j * BLOCK
                    for k, v in zip(out, (anchor, kind, j, near, far, _hash(content[at : at - BLOCK + 1 + LENGTH]), _hash(content[lead - far : lead - near + LENGTH])), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if k in ("block", "near", "far") else pa.int64()) for k, v in out.items()], list(out))


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of every string of LENGTH bytes that starts near to far before the anchor of a region."""
    for whole in batches:
        for s in range(0, whole.num_rows, 1000):
            a, r, lo, h = [], [], [], []
            for anchor, kind, near, far, lead, content in zip(*(whole.slice(s, 1000).column(i).to_pylist() for i in range(6)), strict=True):
                n = far - near + 1
                a += [anchor] * n
                r += [kind] * n
                lo += range(-far, -near + 1)
                h += [_hash(content[lead - d : lead - d + LENGTH]) for d in range(far, near - 1, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(r, pa.int64()), pa.array(lo, pa.int32()), pa.array(h, pa.int64())], ["a", "r", "lo", "h"])


def _several(df: DataFrame, *key: str) -> DataFrame:
    """The keys that more than one region has; added up per task before they are shuffled."""
    return store(df.groupBy(*key).agg(F.min("r").alias("x"), F.max("r").alias("y")).where("x < y").select(*key, "x"))


def _having(df: DataFrame, keys: DataFrame, *on: str, how: str = "left_semi") -> DataFrame:
    """df joined to keys by sorting both, so that adaptive execution can split the rows of a frequent key."""
    return df.hint("merge").join(keys.hint("merge"), [*on], how)


def _crowded(regions: DataFrame, tasks: int) -> DataFrame:
    """(a, r, lo, hi) for regions of anchors that have too many for one shard, by counting hashes: of blocks of strings
    first, and of single strings only where a block's strings may repeat but not all of them do so together."""
    blocks = regions.select("a", "r", "lead", "content").repartition(tasks, F.xxhash64("r")).mapInArrow(_blocks, "a long, r long, block int, near int, far int, core long, outer long")
    blocks = store(blocks)
    all_of, some_of = ("a", "near", "far", "outer"), ("a", "block", "core")
    whole = _several(blocks, *all_of)
    done = _having(blocks, whole.drop("x"), *all_of).select("a", "r", (-F.col("far")).alias("lo"), (F.lit(LENGTH) - F.col("near")).alias("hi"))
    # one block stands for all that are equal as a whole
    rest = store(_having(blocks, whole, *all_of, how="left").where("x is null or r = x").drop("x"))
    rest = store(_having(rest, _several(rest, *some_of), *some_of).select("a", "r", "near", "far"))
    texts = _having(rest, regions.select("a", "r", "lead", "content"), "a", "r", how="inner").select("a", "r", "near", "far", "lead", "content")
    strings = store(texts.repartition(tasks, F.xxhash64("r", "near")).mapInArrow(_strings, "a long, r long, lo int, h long"))
    again = _having(strings, _several(strings, "a", "lo", "h"), "a", "lo", "h")
    return done.union(again.select("a", "r", "lo", (F.col("lo") + LENGTH).alias("hi")))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc, text, spans as [lo, hi]) to what is left of each text."""
    for b in batches:
        out: list[tuple] = []
        for doc, text, marks, shared in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            text = text.as_buffer().to_pybytes()
            parts, done, spans = [], 0, []
            for lo, hi in sorted((s["lo"], s["hi"]) for s in marks or []):
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi])
            for lo, hi in spans:
                parts.append(text[done:lo])
                done = hi
            left = b"".join([*parts, text[done:]])
            out.append((doc, len(text), len(text) - len(left), spans, left, shared or 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()),
             pa.array([[{"lo": lo, "hi": hi} for lo, hi in o[3]] for o in out], pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))), pa.array([o[4] for o in out], pa.binary()), pa.array([o[5] for o in out], pa.int64())],
            ["doc_id", "n_bytes", "n_removed", "spans", "kept", "n_shared"],
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans array<struct<lo, hi>>, kept binary, n_shared) for every row: the bytes covered by
    a string of LENGTH bytes that also starts elsewhere, in this or another document, what is left without them, and how
    many places of the text occur elsewhere, of which every repeated passage of SHORT bytes has one.

    Anchors of all texts are counted after equal ones are added up per task. Those that occur once are dropped. Equal
    regions are one entry with a count; those of a count above one repeat as a whole. Entries that share a core with
    another one are dealt to shards by anchor and sorted there. An anchor with more than SHARD_GROUP such entries is
    split by hashes of its strings instead, which are counted like words, so that no shard gets them all. Nothing is
    capped. Tables written on the way are deleted once their successors exist, the last ones with the session.

    Null texts count as empty. Rows that repeat a doc_id with another text are documents of their own; rows that
    repeat both are copies of each other. An empty table gives no rows. Other columns are ignored.
    """
    tasks = int(bounded(docs.sparkSession).conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(key.alias("doc"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    both = store(rows.where(F.octet_length("text") >= SHORT).select("doc", "mark", "text").mapInArrow(_raw, RAW))
    raw, place = both.where("r is not null"), both.where("r is null").select("doc", "mark", "a")
    again = store(place.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"))
    again = store(_having(place, again, "a").groupBy("doc", "mark").agg(F.count("*").alias("n")))
    shared = store(raw.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"))
    seen = store(_having(raw, shared, "a"))
    release(both, shared)
    one = F.min(F.struct("doc", "mark", "at", "far", "near", "c0", "c1")).alias("one")
    kinds = store(seen.groupBy("a", "r").agg(F.count("*").alias("n"), one).select("a", "r", "n", "one.*"))
    # strings that repeat share a core: regions none of whose cores another one has are done, others are narrowed
    core = lambda j: F.shiftright(F.col(f"c{j // 3}"), 16 * (j % 3)).bitwiseAND(F.lit(0xFFFF))
    place = F.struct("doc", "mark", "at", "far", "near").alias("place")
    cores = kinds.select("a", "r", place, F.posexplode(F.array(*[core(j) for j in range(CORES)])).alias("j", "core")).where("core <> 0")
    several = _several(cores, "a", "j", "core")
    live = store(_having(cores, several.drop("x"), "a", "j", "core").groupBy("a", "r").agg(F.min("j").alias("least"), F.max("j").alias("most"), F.first("place").alias("place")))
    live_rows = live.count()
    many = store(live.groupBy("a").agg(F.count("*").alias("kinds")).where(F.col("kinds") > SHARD_GROUP).select("a", F.lit(True).alias("many")))
    some = _having(live, many, "a", how="left").withColumn("many", F.coalesce("many", F.lit(False)))
    wanted = store(some.groupBy("place.doc", "place.mark").agg(F.collect_list(F.struct("a", "r", "place.at", "place.far", "place.near", "least", "most", "many")).alias("wanted")))
    texts = rows.join(wanted, ["doc", "mark"])
    regions = store(texts.select(F.col("text").cast("binary").alias("text"), "wanted").mapInArrow(_regions, "a long, r long, lead int, many boolean, content binary"))
    release(several, live, wanted)
    few = regions.where("not many").select("a", "r", "lead", "content")
    shards = max(tasks, 1 + live_rows * (LENGTH + GRAM) // SHARD_BYTES)
    cover = few.repartition(shards, "a").mapInArrow(_sorted, "a long, r long, lo int, hi int")
    cover = cover.union(kinds.where("n > 1").select("a", "r", (-F.col("far")).cast("int").alias("lo"), (F.lit(LENGTH) - F.col("near")).alias("hi")))
    if not many.isEmpty():
        cover = cover.union(_crowded(regions.where("many"), tasks))
    cover = store(cover)
    release(regions, kinds, many)
    span = F.struct((F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi"))
    found = _having(seen.select("doc", "mark", "a", "r", "at"), cover, "a", "r", how="inner").select("doc", "mark", span.alias("span"), F.lit(0).alias("n"))
    found = found.union(again.select("doc", "mark", F.lit(None).cast(found.schema["span"].dataType), "n"))
    marks = store(found.groupBy("doc", "mark").agg(F.collect_set("span").alias("spans"), F.sum("n").alias("n_shared")))
    release(seen, cover, again)
    cut = rows.join(marks, ["doc", "mark"], "left").select("doc", F.col("text").cast("binary").alias("text"), "spans", "n_shared")
    out = cut.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<lo:int,hi:int>>, kept binary, n_shared long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))
