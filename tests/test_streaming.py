"""Streams give what the batch operators give."""

import numpy as np

from lectern.operators import sequence
from lectern.streaming import stateful


def test_streamed_segments_equal_batch(spark, tmp_path):
    data = [(a, i, ((i * 37 + a * 11) % 100) / 100) for a in range(4) for i in range(60)]
    schema = "audio_id long, frame long, p double"
    for k in range(3):  # three micro-batches in order
        part = [x for x in data if 20 * k <= x[1] < 20 * (k + 1)]
        part += [(a, 60, None) for a in range(4)] if k == 2 else []
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    paths = sorted((tmp_path / "in").glob("*/*.parquet"))
    (tmp_path / "flat").mkdir()
    for k, p in enumerate(paths):
        (tmp_path / "flat" / f"{k}.parquet").write_bytes(p.read_bytes())
    import os

    for k in range(3):
        os.utime(tmp_path / "flat" / f"{k}.parquet", (k + 1, k + 1))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "flat"))
    q = stateful.stream_segments(stream).writeStream.format("memory").queryName("segs").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(round(v, 6) for v in r) for r in spark.sql("select audio_id, start, `end` from segs").collect())
    df = spark.createDataFrame(data, schema)
    batch = sequence.active_segments(sequence.runs(sequence.hysteresis(df, ["audio_id"], ["frame"], "p"), ["audio_id"], "frame", "active"), "active")
    assert got == sorted(tuple(round(v, 6) for v in r) for r in batch.select("audio_id", "start", "end").collect())


def test_cache_keeps_telling_frames():
    p = np.array([[0.9, 0.1, 0.1, 0.1]] * 3 + [[0.1, 0.8, 0.1, 0.1]] * 3 + [[0.4] * 4] * 2)
    x = np.arange(8.0)[:, None]
    kept, probs = stateful.compress(x, p, np.array([-1.0]), 16)
    assert kept[:, 0].tolist()[:3] == [0, 1, 2] and (kept == -1).sum() == (probs.sum(1) == 0).sum()
    assert stateful.quality(p, 1)[6:].max() == -np.inf


def test_segments_wait_until_they_are_stable(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, i, 1.0 if i % 10 < 4 else 0.0) for i in range(36)], "audio_id long, frame long, p double")
    out = stateful.drained(df, lambda s: stateful.stream_segments(s, frame=1.0, half=5), "frame", 6)
    got = sorted(tuple(r) for r in out.select("start", "end", "batch").collect())
    assert [g[:2] for g in got] == [(0.0, 4.0), (10.0, 14.0), (20.0, 24.0)] and [g[2] for g in got] == sorted(g[2] for g in got)
    assert out.agg(F.countDistinct("batch")).first()[0] > 1
