"""Domain tables derived from the star-schema tables; every one has the same definition in SQL.

tracks(video_id, point_id, frame_idx, x, y): hourly frames of event values, dense over
video x point x frame; at least the ``N_FRAMES`` of the first month, and from the first to
the last hour that has an event. points(point_id, x0, y0): mean position of each point.
trials(trial_id, first, last): days of 24 frames, both ends included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_POINTS, N_FRAMES, TRIAL = 8, 720, 24
START = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point tracks per hour and event type; the raw sums are shuffled once, the grid is generated."""
    events = table(spark, sf_dir, "events")
    frame = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - START) / 3600).cast("long")
    raw = events.groupBy(F.col("event_type").alias("video_id"), (F.col("user_id") % N_POINTS).cast("int").alias("point_id"), frame.alias("frame_idx")).agg(
        F.round(F.sum("value"), 2).alias("x"), F.count("*").cast("double").alias("y")
    )
    raw = raw.where("frame_idx IS NOT NULL AND video_id IS NOT NULL AND point_id IS NOT NULL")
    span = raw.agg(F.least(F.min("frame_idx"), F.lit(0)).alias("_a"), F.greatest(F.max("frame_idx"), F.lit(N_FRAMES - 1)).alias("_b"))
    grid = (
        raw.select("video_id").distinct().join(span, F.lit(True))
        .withColumn("point_id", F.explode(F.sequence(F.lit(0), F.lit(N_POINTS - 1))))
        .withColumn("frame_idx", F.explode(F.sequence("_a", "_b")))
    )
    return grid.join(raw, ["video_id", "point_id", "frame_idx"], "left").select("video_id", "point_id", "frame_idx", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))


def points(t: DataFrame) -> DataFrame:
    # a little is added before rounding: exact halves are common here, and sums in another order must not move them
    return t.groupBy("point_id").agg(*[F.round(F.avg(c) + 1e-9, 4).alias(f"{c}0") for c in ("x", "y")])


def videos(t: DataFrame, frame_rate: float = 60.0) -> DataFrame:
    """Per-video metadata; a video's frame rate differs by the length of its name so that checks have something to see."""
    return t.groupBy("video_id").agg((F.max("frame_idx") + 1).alias("num_frames")).withColumn("frame_rate", F.lit(frame_rate) + F.length("video_id") % 3)


def trials(spark: SparkSession) -> DataFrame:
    return spark.range(N_FRAMES // TRIAL).select(F.col("id").alias("trial_id"), (F.col("id") * TRIAL).alias("first"), (F.col("id") * TRIAL + TRIAL - 1).alias("last"))


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a row of an image (y, x, value) of 64 columns."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "value")).select("y", F.col("x").cast("long").alias("x"), F.round(F.col("value").cast("double"), 4).alias("value"))


#: The same tables for DuckDB, as the start of a WITH clause.
SQL = f"""
raw AS (
  SELECT event_type AS video_id, CAST(user_id % {N_POINTS} AS INTEGER) AS point_id,
         CAST(floor((epoch(ts) - {START}) / 3600) AS BIGINT) AS frame_idx, round(sum(value), 2) AS x, CAST(count(*) AS DOUBLE) AS y
  FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL),
tracks AS (
  SELECT v.video_id, CAST(p.p AS INTEGER) AS point_id, f.f AS frame_idx, coalesce(raw.x, 0) AS x, coalesce(raw.y, 0) AS y
  FROM (SELECT DISTINCT video_id FROM raw) v CROSS JOIN range({N_POINTS}) p(p)
  CROSS JOIN (SELECT unnest(range(least(min(frame_idx), 0), greatest(max(frame_idx), {N_FRAMES - 1}) + 1)) AS f FROM raw) f
  LEFT JOIN raw ON raw.video_id = v.video_id AND raw.point_id = p.p AND raw.frame_idx = f.f),
points AS (SELECT point_id, round(avg(x) + 1e-9, 4) AS x0, round(avg(y) + 1e-9, 4) AS y0 FROM tracks GROUP BY point_id),
videos AS (SELECT video_id, max(frame_idx) + 1 AS num_frames, CAST(60 + length(video_id) % 3 AS DOUBLE) AS frame_rate FROM tracks GROUP BY video_id),
trials AS (SELECT i AS trial_id, i * {TRIAL} AS first, i * {TRIAL} + {TRIAL - 1} AS last FROM range({N_FRAMES // TRIAL}) r(i)),
image AS (
  SELECT vec_id AS y, CAST(i - 1 AS BIGINT) AS x, round(CAST(embedding[i] AS DOUBLE), 4) AS value
  FROM embeddings, range(1, 65) r(i))"""
