"""Tracking as keyed state: any cut of the stream gives the batch's rows."""

import time

import numpy as np
import pytest

from kinetrace.operators import track
from kinetrace.streaming import tracker

HOME = [(i, float(x), float(y)) for i, (x, y) in enumerate([(16, 16), (32, 16), (16, 32), (32, 32)])]
SCHEMA = "video_id string, frame_idx long, height int, width int, channels int, data binary"


def run_stream(spark, folder, params, patience=60.0, wait=None):
    tracker.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    home = spark.createDataFrame(HOME, "point_id long, x0 double, y0 double")
    name = f"tracked{abs(hash(str(folder)))}"
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = tracker.tracked_stream(stream, home, params, patience).writeStream.format("memory").queryName(name).outputMode("append")
    # timers alone make batches as long as a query runs; one that only takes what is there has none of them
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false" if wait is None else "true")
    if wait is None:
        q = out.trigger(availableNow=True).start()
        assert q.awaitTermination(100)
    else:
        q = out.trigger(processingTime="1 second").start()
        end = time.time() + wait
        while time.time() < end and spark.table(name).count() < 40:
            time.sleep(1)
        q.stop()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return sorted(tuple(r) for r in spark.table(name).collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_any_cut_of_the_stream(spark, tmp_path, seed):
    """Frames in any order, in batches of any size; rewinds included."""
    rng = np.random.default_rng(seed)
    made = track.blob_frames(spark, videos=2, n=14).collect()
    params = track.TrackerParams(neighbours=3, threshold=2.5, before=2, after=2, most_rewinds=2)
    home = spark.createDataFrame(HOME, "point_id long, x0 double, y0 double")
    want = sorted(tuple(r) for r in track.track_points(spark.createDataFrame(made, SCHEMA), home, params).collect())
    assert any(r[5] for r in want)
    order = rng.permutation(len(made)) if seed else np.arange(len(made))
    rows = [tuple(made[i]) for i in order] + [("v0", 14, None, None, None, None), ("v1", 14, None, None, None, None)]
    cuts = sorted({0, len(rows), *rng.integers(1, len(rows), 2).tolist()})
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    assert run_stream(spark, tmp_path / "in", params) == want


def test_missing_frames_are_given_up(spark, tmp_path):
    """Without frame 3 and without an end, the timer lets the video go on and come out."""
    made = [r for r in track.blob_frames(spark, videos=1, n=10).collect()]
    params = track.TrackerParams(neighbours=3)
    home = spark.createDataFrame(HOME, "point_id long, x0 double, y0 double")
    some = [tuple(r) for r in made if r.frame_idx != 3]
    renumbered = [(v, i, *rest) for i, (v, _, *rest) in enumerate(some)]
    want = sorted(tuple(r) for r in track.track_points(spark.createDataFrame(renumbered, SCHEMA), home, params).collect())
    want = [(v, some[i][1], *rest) for v, i, *rest in want]
    spark.createDataFrame(some, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run_stream(spark, tmp_path / "in", params, patience=2.0, wait=90)
    assert got == want[: len(got)] and len(got) == len(want)
