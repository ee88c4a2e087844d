"""Structured Streaming operators: segments, speaker caches and recurrent scores kept as state between micro-batches.

Each recording is a key. Its rows of a micro-batch are put in order before they are read; rows of a later micro-batch come
after them. All operators need the RocksDB state store.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern import scratch

#: Entries of a speaker cache and of the queue before it, silent entries a speaker, speakers; largest sum of
#: probabilities that is silence; least probability in a score (fixed values).
CACHE, QUEUE, SILENT, SPEAKERS, SILENCE, FLOOR = 188, 124, 3, 4, 0.2, 0.25


def _ordered(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    parts = list(rows)
    return (pd.concat(parts) if len(parts) > 1 else parts[0]).sort_values(order, kind="stable")


class Segments(StatefulProcessor):
    """Hysteresis over a recording's frames as they come, in order: emits a segment when it ends. A segment that is open
    stays in the state; a row with a null score flushes it. With half, a segment waits until half a median window
    and half of it again have passed since its end, as later frames may change it before; it is emitted once."""

    def __init__(self, onset: float = 0.641, offset: float = 0.561, frame: float = 0.08, half: int = 0):
        self.onset, self.offset, self.frame, self.half = onset, offset, frame, half

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "start long, last long, seen long")
        self.waiting = handle.getListState("waiting", "start long, stop long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        start, last, seen = self.open.get() if self.open.exists() else (-1, -1, 0)
        ended = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        flushed = False
        for f, p in _ordered(rows, ["frame"])[["frame", "p"]].itertuples(index=False):
            if pd.isna(p) or (start >= 0 and p < self.offset):
                if start >= 0:
                    ended.append((start, last + 1))
                start = -1
            elif start < 0 and p >= self.onset:
                start = int(f)
            flushed |= bool(pd.isna(p))
            last, seen = (last, seen) if pd.isna(p) else (int(f), seen + 1)
        safe = math.inf if flushed or not self.half else seen - self.half
        out = [(key[0], a * self.frame, b * self.frame) for a, b in ended if b <= safe]
        left = [x for x in ended if x[1] > safe]
        self.open.update((start, last, seen))
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["audio_id", "start", "end"])

    def close(self) -> None:
        pass


def quality(p: np.ndarray, least: int) -> np.ndarray:
    """How telling each frame is of each speaker, p [frame, speaker]: log-odds with the other speakers' silence. Minus
    infinity where the speaker is not the likely one, or where the score isn't positive and enough others are."""
    yes, no = np.log(np.maximum(p, FLOOR)), np.log(np.maximum(1 - p, FLOOR))
    s = np.round(yes - no + no.sum(1, keepdims=True) - math.log(math.sqrt(2)), 9)  # so that ties are ties
    many = (s > 0).sum(0) >= least
    return np.where((p <= 0.5) | ((s <= 0) & many), -np.inf, s)


def adjust(s: np.ndarray, each: int, factor: float) -> np.ndarray:
    """The best scores of each speaker, the earlier on ties, moved by a multiple of half the logarithm of two."""
    s = s.copy()
    for c in range(s.shape[1]):
        top = np.argsort(-s[:, c], kind="stable")[:each]
        s[top, c] -= factor * 0.5 * math.log(2.0)
    return np.round(s, 9)


def compress(x: np.ndarray, p: np.ndarray, silence: np.ndarray, size: int = CACHE) -> tuple[np.ndarray, np.ndarray]:
    """A cache of size entries of x [frame, dimension] and p [frame, speaker]: the best scores over all speakers, by speaker,
    then time; a frame may come once for each speaker. Every speaker has SILENT entries of the mean of silence to
    fill up with; ties go to the earlier frame, then the smaller speaker."""
    n, speakers = p.shape
    each = size // speakers - SILENT
    s = adjust(adjust(quality(p, int(each * 0.5)), int(each * 0.75), 2.0), int(each * 1.5), 1.0)
    s = np.concatenate([s, np.full((SILENT * speakers, speakers), -np.inf)])
    best = np.argsort(-s.ravel(), kind="stable")[:size]
    at = best[np.lexsort((best // speakers, best % speakers))] // speakers
    own = at < n
    out, probs = np.repeat(silence[None], size, axis=0), np.zeros((size, speakers))
    out[own], probs[own] = x[at[own]], p[at[own]]
    return out, probs


class SpeakerCache(StatefulProcessor):
    """A queue of the latest frames (embedding x, speakers' probabilities p) and a cache of telling ones. A queue over its
    size goes to the cache whole; its silent frames move the mean of silence; a cache over its size is compressed."""

    def __init__(self, cache: int = CACHE, queue: int = QUEUE):
        self.cache_size, self.queue_size = cache, queue

    def init(self, handle: StatefulProcessorHandle) -> None:
        entry = "x array<double>, p array<double>"
        self.kept, self.queue = handle.getListState("kept", entry), handle.getListState("queue", entry)
        self.silence = handle.getValueState("silence", "n long, mean array<double>")

    def fold(self, frames: list[tuple], kept: list[tuple], queue: list[tuple], silent: int, mean: np.ndarray) -> tuple:
        """The state after more frames."""
        for x, p in frames:
            queue.append((x, p))
            if len(queue) > self.queue_size:
                for a, b in queue:
                    if sum(b) < SILENCE:
                        silent += 1
                        mean = (mean * (silent - 1) + a) / silent
                kept, queue = kept + queue, []
                if len(kept) > self.cache_size:
                    kept = list(zip(*compress(np.stack([a for a, _ in kept]), np.stack([b for _, b in kept]), mean, self.cache_size), strict=True))
        return kept, queue, silent, mean

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = lambda state: [(np.array(x), np.array(p)) for x, p in state.get()] if state.exists() else []
        pdf = _ordered(rows, ["frame"])
        frames = [(np.asarray(x, float), np.asarray(p, float)) for x, p in zip(pdf["x"], pdf["p"], strict=True)]
        silent, mean = self.silence.get() if self.silence.exists() else (0, [0.0] * len(frames[0][0]))
        kept, queue, silent, mean = self.fold(frames, held(self.kept), held(self.queue), silent, np.array(mean))
        for state, entries in ((self.kept, kept), (self.queue, queue)):
            if entries:
                state.put([(x.tolist(), p.tolist()) for x, p in entries])
            else:
                state.clear()
        self.silence.update((silent, mean.tolist()))
        yield summary(key[0], kept, queue, silent)

    def close(self) -> None:
        pass


def summary(key: int, kept: list[tuple], queue: list[tuple], silent: int) -> pd.DataFrame:
    """What a cache holds: sizes, and sums over its entries that their order and choice decide."""
    at = range(1, len(kept) + 1)
    row = (key, len(kept), len(queue), silent, round(sum(k * float(p.sum()) for k, (_, p) in zip(at, kept, strict=True)), 6), round(sum(k * float(x.sum()) for k, (x, _) in zip(at, kept, strict=True)), 6))
    return pd.DataFrame([row], columns=["audio_id", "cached", "queued", "silent", "p_sum", "x_sum"])


class Recurrent(StatefulProcessor):
    """A model's scores of windows of a signal that comes in pieces: the state is what the model left, the last samples of
    the window before, which the next one begins with, and samples that don't fill a window yet."""

    def __init__(self, make: Callable[[], Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray]]], state: list[float], window: int = 512, context: int = 64):
        self.make, self.state0, self.window, self.context = make, state, window, context

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.step = self.make()
        self.kept = handle.getValueState("kept", "n long, state array<double>, before array<double>, left array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        n, state, before, left = self.kept.get() if self.kept.exists() else (0, self.state0, [0.0] * self.context, [])
        state = np.array(state)
        x = np.concatenate([before, left, *[np.asarray(v, float) for v in _ordered(rows, ["pos"])["x"]]])
        out = []
        while len(x) >= self.context + self.window:
            p, state = self.step(x[: self.context + self.window], state)
            out.append((key[0], n, float(p)))
            n, x = n + 1, x[self.window :]
        self.kept.update((n, state.tolist(), x[: self.context].tolist(), x[self.context :].tolist()))
        yield pd.DataFrame(out, columns=["audio_id", "window", "p"])

    def close(self) -> None:
        pass


def stream_segments(frames: DataFrame, **rules: float) -> DataFrame:
    """Segments of a stream of (audio_id, frame, p)."""
    return frames.groupBy("audio_id").transformWithStateInPandas(Segments(**rules), "audio_id long, start double, end double", "append", "none")


def stream_cache(frames: DataFrame, **sizes: int) -> DataFrame:
    """Each recording's cache after each micro-batch of a stream of (audio_id, frame, x, p)."""
    return frames.groupBy("audio_id").transformWithStateInPandas(SpeakerCache(**sizes), "audio_id long, cached long, queued long, silent long, p_sum double, x_sum double", "update", "none")


def stream_scores(pieces: DataFrame, make: Callable, state: list[float]) -> DataFrame:
    """(audio_id, window, p) of a stream of (audio_id, pos, x array<double>)."""
    return pieces.groupBy("audio_id").transformWithStateInPandas(Recurrent(make, state), "audio_id long, window long, p double", "append", "none")


def drained(df: DataFrame, build: Callable[[DataFrame], DataFrame], order: str, parts: int, mode: str = "append") -> DataFrame:
    """All that a stream gives for the rows of df, which come in so many micro-batches by ranges of a number from 0 on; with
    mode update the rows carry the batch they came in as `batch`, so that the last can be told."""
    spark = df.sparkSession
    at, out, state = (scratch.new_path(spark) for _ in range(3))
    top = df.agg(F.max(order)).first()[0] or 0
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1_000_000)

    def write(batch: DataFrame, k: int) -> None:
        batch.withColumn("batch", F.lit(k).cast("long")).write.mode("append").parquet(out)

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(parts):  # a run a part: each goes on from the state that the one before left
            df.where((F.col(order) * parts >= k * (top + 1)) & (F.col(order) * parts < (k + 1) * (top + 1))).write.mode("append").parquet(at)
            q = build(source.parquet(at)).writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
            q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    return spark.read.parquet(out)
