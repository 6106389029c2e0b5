"""Videos are tracked side by side, however few bytes their frames have."""

from pyspark.sql import functions as F

from kinetrace.operators import track


def test_small_videos_are_not_merged_into_one_task(spark):
    home = spark.createDataFrame([(0, 16.0, 16.0), (1, 32.0, 16.0)], "point_id long, x0 double, y0 double")
    tracked = track.track_points(track.blob_frames(spark, videos=6, n=2), home, track.TrackerParams(neighbours=2))
    assert tracked.select(F.spark_partition_id().alias("task")).distinct().count() > 1


def test_few_long_videos_do_not_meet(spark):
    """As many videos as partitions, one task for each; a video without a name and short ones go along."""
    home = spark.createDataFrame([(0, 16.0, 16.0), (1, 32.0, 16.0)], "point_id long, x0 double, y0 double")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frames = track.blob_frames(spark, videos=parts, n=2)
    tracked = track.track_points(frames, home, track.TrackerParams(neighbours=2))
    tasks = tracked.select("video_id", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(tasks) == len({r["task"] for r in tasks}) == parts
    more = track.blob_frames(spark, videos=5 * parts, n=2).union(frames.withColumn("video_id", F.lit(None).cast("string")).limit(3))
    got = track.track_points(more, home, track.TrackerParams(neighbours=2)).groupBy("video_id").count().collect()
    assert {r["video_id"]: r["count"] for r in got} == {f"v{i}": 4 for i in range(5 * parts)} | {None: 6}
