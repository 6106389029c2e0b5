"""The engine's queries over the star-schema tables, each with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinetrace.functions import scalar, trees
from kinetrace.operators import align, cp, points, spectral, tensor, track
from kinetrace.plans import compare
from kinetrace.sources import files, frames, tables
from kinetrace.storage import keep

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BINS, WIDTH, POOL = 6, 31, 20
TAPS = spectral.simple_taps(BINS, WIDTH, 1 / 24, 0.4)
HZ = [round(float(x), 6) for x in spectral.log_spaced(1 / 24, 0.4, BINS)]
KEYS = ["video_id", "axis", "point_id"]


def query(sql: str | None = None, ctes: str = "") -> Callable[[Query], Query]:
    """Register a query; ``sql`` stands after the shared tables and ``ctes``."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"WITH {tables.SQL}{', ' if ctes else ''}{ctes}\n{sql}"
        return f

    return put


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Doubles cut to what summing in any order leaves alone; no negative zeros."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.tracks(spark, sf_dir)


_HEIGHT = "(SELECT max(vec_id) + 1 FROM embeddings)"


def _whole(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """All vectors as an image, and its height."""
    height = tables.table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]
    return tables.image(spark, sf_dir), 0 if height is None else height + 1



# ---- scans ----------------------------------------------------------------


@query("SELECT video_id, point_id, frame_idx, x, y FROM tracks")
def scan_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracks(spark, sf_dir)


@query("SELECT video_id, num_frames, frame_rate FROM videos")
def video_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.videos(_tracks(spark, sf_dir))


@query("SELECT count(*) AS n_videos, CAST(sum(num_frames) AS BIGINT) AS total_frames, median(frame_rate) AS frame_rate, (max(frame_rate) - min(frame_rate)) / avg(frame_rate) > 0.1 AS uneven FROM videos")
def median_frame_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.frame_rate(tables.videos(_tracks(spark, sf_dir)))


@query("SELECT count(*) AS n_videos, CAST(sum(num_frames) AS BIGINT) AS total_frames, CAST(59.5 AS DOUBLE) AS frame_rate, (max(frame_rate) - min(frame_rate)) / avg(frame_rate) > 0.1 AS uneven FROM videos")
def clamped_frame_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.frame_rate(tables.videos(_tracks(spark, sf_dir)), clamp=59.5)


GLOBAL = "joined AS (SELECT video_id, num_frames, CAST(coalesce(sum(num_frames) OVER (ORDER BY video_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_frame FROM videos)"


@query("SELECT * FROM joined", GLOBAL)
def cumulative_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.global_frames(tables.videos(_tracks(spark, sf_dir)))


@query("SELECT * FROM tracks WHERE video_id = 'purchase' AND frame_idx >= 100 AND frame_idx < 200 AND (frame_idx - 100) % 7 = 0")
def frame_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.frame_range(_tracks(spark, sf_dir), "purchase", 100, 200, 7).select("video_id", "point_id", "frame_idx", "x", "y")


@query("SELECT first_frame + frame_idx AS frame, video_id, frame_idx, point_id, x, y FROM tracks JOIN joined USING (video_id) WHERE first_frame + frame_idx >= 700 AND first_frame + frame_idx < 760", GLOBAL)
def continuous_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tracks(spark, sf_dir)
    return points.global_range(t, tables.videos(t), 700, 760)


@query("SELECT video_id, s AS slot, s * 100 AS start_frame, least(s * 100 + 100, num_frames) AS end_frame, first_frame + s * 100 AS start_global FROM joined, range(8) r(s) WHERE s * 100 < num_frames", GLOBAL)
def buffer_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.slots(tables.videos(_tracks(spark, sf_dir)), 100)


@query("SELECT video_id, point_id, frame_idx, (row_number() OVER (ORDER BY video_id, point_id, frame_idx) - 1) // 1000 AS batch_id FROM tracks QUALIFY row_number() OVER (ORDER BY video_id, point_id, frame_idx) <= (SELECT count(*) - count(*) % 1000 FROM tracks)")
def ordered_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tracks(spark, sf_dir).select("video_id", "point_id", "frame_idx")
    return points.batches(t, F.struct("video_id", "point_id", "frame_idx"), 1000, least=1000)


@query("SELECT c_name AS name, row_number() OVER (ORDER BY regexp_replace(c_name, '[0-9]+', '', 'g'), CAST(regexp_extract(c_name, '([0-9]+)', 1) AS BIGINT), c_name) AS place FROM customer")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name in natural order, numbered by ranges: the numbers in names count as numbers."""
    c = tables.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    return points.batches(c, F.struct(*files.natural_key(F.col("name"))), 1).select("name", (F.col("batch_id") + 1).cast("long").alias("place"))


# ---- masks, meshes, violations --------------------------------------------

POLYGONS = [("a", 0, 4.5, 3.5), ("a", 1, 50.5, 8.5), ("a", 2, 40.5, 55.5), ("a", 3, 10.5, 48.5), ("b", 0, 20.5, 1.5), ("b", 1, 62.5, 30.5), ("b", 2, 22.5, 60.5)]
_VERTICES = f"vert AS (SELECT roi_id, ord, x, y * {_HEIGHT} / 64 AS y FROM (VALUES " + ", ".join(f"('{r}', {o}, {x}::DOUBLE, {y}::DOUBLE)" for r, o, x, y in POLYGONS) + ") v(roi_id, ord, x, y))"
MASKS = f"""{_VERTICES},
edge AS (SELECT roi_id, x AS xa, y AS ya, coalesce(lead(x) OVER w, first_value(x) OVER w) AS xb, coalesce(lead(y) OVER w, first_value(y) OVER w) AS yb FROM vert WINDOW w AS (PARTITION BY roi_id ORDER BY ord)),
px AS (SELECT y, x FROM image),
mask AS (SELECT roi_id, px.y, px.x FROM px JOIN edge ON (ya > px.y) <> (yb > px.y) AND px.x < (xb - xa) * (px.y - ya) / (yb - ya) + xa GROUP BY ALL HAVING count(*) % 2 = 1),
both_masks AS (SELECT y, x FROM mask GROUP BY y, x HAVING count(DISTINCT roi_id) = 2)"""


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygons, as high as the image of all vectors, over its pixels."""
    image, height = _whole(spark, sf_dir)
    return points.polygon_mask(image.select("y", "x"), spark.createDataFrame([(r, o, x, y * height / 64) for r, o, x, y in POLYGONS], "roi_id string, ord int, x double, y double"))


@query("SELECT * FROM mask", MASKS)
def polygon_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masks(spark, sf_dir)


@query("SELECT * FROM both_masks", MASKS)
def mask_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.mask_intersection(_masks(spark, sf_dir))


@query("SELECT y, x FROM mask WHERE roi_id = 'a' INTERSECT SELECT y, x FROM mask WHERE roi_id = 'b'", MASKS)
def mask_intersection_by_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _masks(spark, sf_dir)
    return points.mask_intersection_sets([m.where(F.col("roi_id") == r).select("y", "x") for r in "ab"])


@query("SELECT i.y, i.x, round(CASE WHEN m.y IS NULL THEN 0 ELSE value END, 4) + 0.0 AS value FROM image i LEFT JOIN both_masks m ON i.y = m.y AND i.x = m.x", MASKS)
def masked_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points.masked(tables.image(spark, sf_dir), points.mask_intersection(_masks(spark, sf_dir))), "value")


@query(f"SELECT y, x, CASE WHEN y < 3 OR y >= {_HEIGHT} - 2 OR x < 0 OR x >= 64 - 5 OR (abs(y - {_HEIGHT} // 2) < 4 AND abs(x - 32) < 4) THEN 0.0 ELSE value END AS value FROM image")
def border_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    image, height = _whole(spark, sf_dir)
    return points.border_masked(image, height, 64, top=3, bottom=2, left=0, right=5, centre=4)


@query("""SELECT row_number() OVER (ORDER BY x, y) - 1 AS point_id, CAST(x AS DOUBLE) AS x0, CAST(y AS DOUBLE) AS y0
FROM both_masks m WHERE x < (SELECT max(x) FROM both_masks) AND y < (SELECT max(y) FROM both_masks)
AND (x - (SELECT min(x) FROM both_masks)) % 4 = 0 AND (y - (SELECT min(y) FROM both_masks)) % 4 = 0""", MASKS)
def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.grid_points(points.mask_intersection(_masks(spark, sf_dir)), 4.5)


@query("SELECT l_returnflag AS video_id, l_orderkey AS frame_idx, l_suppkey AS y, l_linenumber AS x, CAST(floor(avg(l_quantity)) AS BIGINT) AS value FROM lineitem GROUP BY ALL")
def channel_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tables.table(spark, sf_dir, "lineitem")
    frames = li.select(F.col("l_returnflag").alias("video_id"), F.col("l_orderkey").alias("frame_idx"), F.col("l_suppkey").alias("y"), F.col("l_linenumber").alias("x"), F.col("l_quantity").alias("value"))
    return points.channel_collapse(frames)


@query("SELECT point_id, neighbor_id, rank FROM (SELECT a.i AS point_id, b.i AS neighbor_id, row_number() OVER (PARTITION BY a.i ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.i) AS rank FROM spots a CROSS JOIN spots b) WHERE rank <= 5", "spots AS (SELECT c_custkey AS i, floor(c_acctbal / 50) * 2 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer)")
def nearest_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every customer by balance and nation, many of them at one place."""
    spots = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), (F.floor(F.col("c_acctbal") / 50) * 2).alias("x0"), F.col("c_nationkey").alias("y0"))
    return points.nearest_points(spots, 5)


MESH = """pairs AS (SELECT a.point_id, b.point_id AS neighbor_id, (a.x0 - b.x0) ** 2 + (a.y0 - b.y0) ** 2 AS d FROM points a CROSS JOIN points b),
mesh AS (SELECT point_id, neighbor_id, row_number() OVER (PARTITION BY point_id ORDER BY d, neighbor_id) AS rank FROM pairs QUALIFY rank <= 4),
offs AS (SELECT t.video_id, t.frame_idx, t.point_id, avg(t.x - n.x) AS dx, avg(t.y - n.y) AS dy
  FROM tracks t JOIN mesh m ON t.point_id = m.point_id JOIN tracks n ON n.video_id = t.video_id AND n.frame_idx = t.frame_idx AND n.point_id = m.neighbor_id GROUP BY ALL),
rest AS (SELECT p.point_id, avg(p.x0 - q.x0) AS dx0, avg(p.y0 - q.y0) AS dy0 FROM points p JOIN mesh m ON p.point_id = m.point_id JOIN points q ON q.point_id = m.neighbor_id GROUP BY ALL),
far AS (SELECT video_id, frame_idx, point_id FROM tracks JOIN points USING (point_id) WHERE sqrt((x - x0) ** 2 + (y - y0) ** 2) > 400),
spread AS (SELECT DISTINCT video_id, frame_idx, neighbor_id AS point_id FROM far JOIN mesh USING (point_id) UNION SELECT * FROM far),
dil AS (SELECT DISTINCT video_id, frame_idx + o - 3 AS frame_idx, point_id FROM far, range(8) r(o) WHERE frame_idx + o - 3 BETWEEN 0 AND 719)"""
THRESHOLD = 400.0


def _mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = _tracks(spark, sf_dir)
    p = tables.points(t)
    return t, p, points.mesh(p, 4)


@query("SELECT * FROM mesh", MESH)
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mesh(spark, sf_dir)[2]


@query("SELECT video_id, frame_idx, point_id, round(dx, 4) + 0.0 AS dx, round(dy, 4) + 0.0 AS dy FROM offs", MESH)
def neighbour_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, _, m = _mesh(spark, sf_dir)
    return rounded(points.neighbour_offset(t, m), "dx", "dy")


@query("SELECT video_id, frame_idx, point_id, round(dx - dx0, 3) + 0.0 AS dx, round(dy - dy0, 3) + 0.0 AS dy FROM offs JOIN rest USING (point_id)", MESH)
def mesh_displacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points.mesh_displacement(*_mesh(spark, sf_dir)), "dx", "dy", digits=3)


@query("SELECT * FROM far", MESH)
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, p, _ = _mesh(spark, sf_dir)
    return points.too_far(t, p, THRESHOLD)


@query("SELECT * FROM spread", MESH)
def violations_with_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, p, m = _mesh(spark, sf_dir)
    return points.with_neighbours(points.too_far(t, p, THRESHOLD), m)


@query("SELECT * FROM dil", MESH)
def violations_dilated(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, p, _ = _mesh(spark, sf_dir)
    return points.dilated(points.too_far(t, p, THRESHOLD), 3, 5, tables.N_FRAMES)


@query("SELECT video_id, coalesce(bad, 0) / num_frames AS fraction, coalesce(n, 0) AS n_violations FROM videos LEFT JOIN (SELECT video_id, count(DISTINCT frame_idx) AS bad, count(*) AS n FROM far GROUP BY 1) USING (video_id)", MESH)
def violation_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, p, _ = _mesh(spark, sf_dir)
    return points.violation_fraction(points.too_far(t, p, THRESHOLD), tables.videos(t))


@query("""SELECT video_id, frame_idx, point_id, round(x0 + tx, 2) + 0.0 AS x, round(y0 + ty, 2) + 0.0 AS y FROM (
  SELECT video_id, frame_idx, point_id, sum(CASE WHEN bad THEN 0 ELSE sx END) OVER w AS tx, sum(CASE WHEN bad THEN 0 ELSE sy END) OVER w AS ty FROM (
    SELECT t.*, x - coalesce(lag(x) OVER v, x) AS sx, y - coalesce(lag(y) OVER v, y) AS sy, (t.video_id, t.frame_idx, t.point_id) IN (SELECT (video_id, frame_idx, point_id) FROM dil) AS bad
    FROM tracks t WINDOW v AS (PARTITION BY video_id, point_id ORDER BY frame_idx))
  WINDOW w AS (PARTITION BY video_id, point_id ORDER BY frame_idx)) JOIN points USING (point_id)""", MESH)
def cleaned_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, p, _ = _mesh(spark, sf_dir)
    return rounded(points.cleaned(t, p, points.dilated(points.too_far(t, p, THRESHOLD), 3, 5, tables.N_FRAMES)), "x", "y", digits=2)


@query("SELECT a.video_id, a.point_id, a.frame_idx, round(sum(b.x * 0.95 ** (a.frame_idx - b.frame_idx + 1)) + 1e-7, 3) + 0.0 AS p FROM tracks a JOIN tracks b ON a.video_id = b.video_id AND a.point_id = b.point_id AND b.frame_idx <= a.frame_idx GROUP BY ALL")
def relaxed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaky sums; a little is added before rounding, so that exact halves go the same way on both sides."""
    p = points.relaxed(_tracks(spark, sf_dir), "x", 0.05, ["video_id", "point_id"], "frame_idx")
    return rounded(p.withColumn("p", F.col("p") + 1e-7), "p", digits=3)


# ---- spectral -------------------------------------------------------------

TRACES = "traces AS (SELECT video_id, 0 AS axis, point_id, frame_idx AS t, x - x0 AS d FROM tracks JOIN points USING (point_id) UNION ALL SELECT video_id, 1, point_id, frame_idx, y - y0 FROM tracks JOIN points USING (point_id))"
_TAPS = "taps(f_idx, k, re, im) AS (VALUES " + ", ".join(f"({f}, {k}, {z.real:.6f}::DOUBLE, {z.imag:.6f}::DOUBLE)" for f, row in enumerate(TAPS) for k, z in enumerate(row)) + ")"
SPECTRAL = f"""{TRACES}, {_TAPS},
conv AS (SELECT video_id, axis, point_id, f_idx, t - k AS o, sum(d * re) AS re, -sum(d * im) AS im FROM traces, taps WHERE t - k >= (SELECT min(t) FROM traces) AND t - k <= (SELECT max(t) FROM traces) - {WIDTH - 1} GROUP BY ALL),
spec AS (SELECT video_id, axis, point_id, f_idx, o // {POOL} AS t_ds, avg(sqrt(re * re + im * im)) AS value FROM conv GROUP BY ALL),
m AS (SELECT video_id, t_ds, avg(p) AS m FROM (SELECT video_id, t_ds, axis, point_id, sum(value) AS p FROM spec GROUP BY ALL) GROUP BY ALL),
hz(f_idx, hz) AS (VALUES {", ".join(f"({i}, {h}::DOUBLE)" for i, h in enumerate(HZ))}),
norm AS (SELECT video_id, axis, point_id, f_idx, t_ds, value / (0.95 * m + 0.05) * hz ** 0.5 AS value FROM spec JOIN m USING (video_id, t_ds) JOIN hz USING (f_idx))"""


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tracks(spark, sf_dir)
    return points.displacements(t, tables.points(t))


def _spectrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By blocks of each series; the packed form is checked against the same SQL by :func:`vqt_packed`."""
    return spectral.overlap_saved(_traces(spark, sf_dir), TAPS, POOL, block=256)


def _packed_spectrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.vqt(spectral.packed(_traces(spark, sf_dir)), TAPS, POOL)


@query("SELECT video_id, axis, point_id, t, round(d, 4) + 0.0 AS d FROM traces", TRACES)
def displacement_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_traces(spark, sf_dir), "d")


@query("SELECT video_id, axis, point_id, t // 20 AS t_ds, round(avg(d), 4) + 0.0 AS d FROM traces GROUP BY ALL", TRACES)
def pooled_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectral.pooled(_traces(spark, sf_dir), KEYS, "t", ["d"], POOL), "d")


@query("SELECT video_id, axis, point_id, f_idx, t_ds, round(value, 4) + 0.0 AS value FROM spec", SPECTRAL)
def spectrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_spectrogram(spark, sf_dir), "value")


@query(
    f"""SELECT video_id, axis, point_id, f_idx, s // {POOL} AS t_ds, round(avg(sqrt(re * re + im * im)), 4) + 0.0 AS value FROM (
  SELECT video_id, axis, point_id, f_idx, t - k + {(WIDTH - 1) // 2} AS s, sum(d * re) AS re, -sum(d * im) AS im FROM traces, taps GROUP BY ALL)
WHERE s BETWEEN (SELECT min(t) FROM traces) AND (SELECT max(t) FROM traces) GROUP BY ALL""",
    SPECTRAL,
)
def spectrogram_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An output for every sample, zeros beyond the ends of a series."""
    return rounded(spectral.overlap_saved(_traces(spark, sf_dir), TAPS, POOL, "same", block=256), "value")


@query("SELECT video_id, axis, point_id, f_idx, t_ds, round(value, 4) + 0.0 AS value FROM spec", SPECTRAL)
def vqt_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_packed_spectrogram(spark, sf_dir), "value")


@query(f"SELECT video_id, axis, point_id, f_idx, o // {POOL} AS t_ds, round(avg(re) + 3e-9, 4) + 0.0 AS re, round(avg(im) + 3e-9, 4) + 0.0 AS im FROM conv GROUP BY ALL", SPECTRAL)
def vqt_packed_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean complex values; a little is added before rounding, so that exact halves go the same way on both sides."""
    y = spectral.vqt(spectral.packed(_traces(spark, sf_dir)), TAPS, POOL, as_complex=True)
    return rounded(y.withColumns({c: F.col(c) + 3e-9 for c in ("re", "im")}), "re", "im")


@query("SELECT video_id, axis, point_id, f_idx, t_ds, round(value, 4) + 0.0 AS value FROM spec WHERE point_id = 3 AND axis = 1", SPECTRAL)
def vqt_one_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A demonstration transform: the filter comes first, so one series is convolved."""
    one = _traces(spark, sf_dir).where("point_id = 3 AND axis = 1")
    return rounded(spectral.vqt(spectral.packed(one), TAPS, POOL), "value")


@query("SELECT video_id, t_ds, round(m, 4) + 0.0 AS m FROM m", SPECTRAL)
def spectral_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectral.power(_packed_spectrogram(spark, sf_dir)), "m")


@query("SELECT video_id, axis, point_id, f_idx, t_ds, round(value, 4) + 0.0 AS value FROM norm", SPECTRAL)
def normalised_spectrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectral.normalised(_packed_spectrogram(spark, sf_dir), HZ), "value")


@query(f"SELECT video_id, o // {POOL} AS t_ds, avg(o) + {(WIDTH - 1) / 2} AS sample FROM (SELECT video_id, unnest(range(num_frames - {WIDTH} + 1)) AS o FROM videos) GROUP BY 1, 2")
def spectrogram_time_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The axis of every video, by its own number of frames."""
    return spectral.time_axes(tables.videos(_tracks(spark, sf_dir)), WIDTH, POOL)


@query(f"SELECT video_id, 2.0 * {BINS} * 8 * floor((num_frames - {WIDTH}) / {POOL} + 1) * 4 / 1e9 AS gb FROM videos")
def spectrogram_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.size_estimate(tables.videos(_tracks(spark, sf_dir)), 8, BINS, WIDTH, POOL)


_KERNEL = "kern AS (SELECT y, x, (cos(least(pi(), 2 * pi() * sqrt((y - 2.0) ** 2 + (x - 2.0) ** 2) / 5.0)) + 1) / 2 AS value FROM (SELECT i // 5 AS y, i % 5 AS x FROM range(25) r(i)))"


@query("SELECT video_id, point_id, frame_idx, round((cos(least(pi(), 2 * pi() * sqrt((x - x0) ** 2 + (y - y0) ** 2) / 800.0)) + 1) / 2, 6) + 0.0 AS value FROM tracks JOIN points USING (point_id)")
def cosine_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernel at every tracked point, around its home."""
    t = _tracks(spark, sf_dir)
    far = F.sqrt(F.pow(F.col("x") - F.col("x0"), F.lit(2)) + F.pow(F.col("y") - F.col("y0"), F.lit(2)))
    return rounded(t.join(tables.points(t), "point_id").select("video_id", "point_id", "frame_idx", scalar.raised_cosine(far, 800.0).alias("value")), "value", digits=6)


def _convolved(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    image, height = _whole(spark, sf_dir)
    return rounded(spectral.convolved_2d(image, scalar.cosine_kernel(spark, 5, 5.0, (2.0, 2.0)), height, 64, 5, 5, mode), "value")


@query(f"SELECT i.y + k.y - 2 AS y, i.x + k.x - 2 AS x, round(sum(i.value * k.value), 4) + 0.0 AS value FROM image i, kern k WHERE i.y + k.y - 2 BETWEEN 0 AND {_HEIGHT} - 1 AND i.x + k.x - 2 BETWEEN 0 AND 63 GROUP BY ALL", _KERNEL)
def convolution_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _convolved(spark, sf_dir, "same")


@query("SELECT l_orderkey, l_linenumber, l_quantity, round(exp(-(((l_quantity - 25) / 10) ** 2) / 2) / (sqrt(2 * pi()) * 10), 6) + 0.0 AS density FROM lineitem")
def gaussian_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tables.table(spark, sf_dir, "lineitem")
    return rounded(li.select("l_orderkey", "l_linenumber", "l_quantity", scalar.gaussian(F.col("l_quantity"), 25, 10).alias("density")), "density", digits=6)


@query("SELECT video_id, CAST(i AS INTEGER) AS i, round(frame_rate ** (i / 35.0), 6) + 0.0 AS value FROM videos, range(36) r(i)")
def log_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """36 frequencies of every video, from 1 to its frame rate."""
    v = tables.videos(_tracks(spark, sf_dir))
    return rounded(v.select("video_id", F.posexplode(scalar.log_spaced_between(F.lit(1.0), F.col("frame_rate"), 36)).alias("i", "value")), "value", digits=6)


@query("""SELECT y, x, round(CASE WHEN v < 0.5 THEN 2 * v ELSE 1 - 2 * (v - 0.5) END, 4) + 0.0 AS r, round(CASE WHEN v < 0.5 THEN 0 ELSE 2 * (v - 0.5) END, 4) + 0.0 AS g, round(CASE WHEN v < 0.5 THEN 1 - 2 * v ELSE 0 END, 4) + 0.0 AS b
FROM (SELECT y, x, least(greatest(value, 0), 1) AS v FROM image)""")
def colour_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = tables.image(spark, sf_dir)
    return rounded(image.select("y", "x", *scalar.colour_map(F.col("value"), [(0, 0, 1), (1, 0, 0), (0, 1, 0)])), "r", "g", "b")


_SOBEL = [(-1, 0, 1), (-2, 0, 2), (-1, 0, 1)]


def _sobel(spark: SparkSession, turned: bool) -> DataFrame:
    cells = [(y, x, float(_SOBEL[x][y] if turned else _SOBEL[y][x]) * -1) for y in range(3) for x in range(3)]
    return spark.createDataFrame(cells, "y long, x long, value double")


@query("""SELECT a.y, a.x, round(sum(i.value * (a.i - 1) * CASE a.j WHEN 1 THEN 2 ELSE 1 END), 4) + 0.0 AS gx, round(sum(i.value * (a.j - 1) * CASE a.i WHEN 1 THEN 2 ELSE 1 END), 4) + 0.0 AS gy
FROM (SELECT y, x, i.i, j.j FROM image, range(3) i(i), range(3) j(j)) a JOIN image i ON i.x = a.x + a.i - 1 AND i.y = a.y + a.j - 1 GROUP BY a.y, a.x""")
def sobel_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradients by 3 x 3 kernels; outside of the image stands 0."""
    image, height = _whole(spark, sf_dir)
    gx = spectral.convolved_2d(image, _sobel(spark, False), height, 64, 3, 3).select("y", "x", F.col("value").alias("gx"))
    gy = spectral.convolved_2d(image, _sobel(spark, True), height, 64, 3, 3).select("y", "x", F.col("value").alias("gy"))
    return rounded(gx.join(gy, ["y", "x"]), "gx", "gy")


@query("SELECT i.y + k.y AS y, i.x + k.x AS x, round(sum(i.value * k.value), 4) + 0.0 AS value FROM image i, kern k GROUP BY ALL", _KERNEL)
def convolution_2d_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _convolved(spark, sf_dir, "full")


@query(f"SELECT i.y + k.y - 4 AS y, i.x + k.x - 4 AS x, round(sum(i.value * k.value), 4) + 0.0 AS value FROM image i, kern k WHERE i.y + k.y - 4 BETWEEN 0 AND {_HEIGHT} - 5 AND i.x + k.x - 4 BETWEEN 0 AND 59 GROUP BY ALL", _KERNEL)
def convolution_2d_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _convolved(spark, sf_dir, "valid")


COMPLEX = SPECTRAL + f""", cs AS (SELECT video_id, axis, point_id, f_idx, o // {POOL} AS t_ds, avg(re) AS re, avg(im) AS im FROM conv GROUP BY ALL),
ca AS (SELECT *, sqrt(re * re + im * im) AS a FROM cs),
cm AS (SELECT video_id, t_ds, avg(p) AS m FROM (SELECT video_id, t_ds, axis, point_id, sum(a) AS p FROM ca GROUP BY ALL) GROUP BY ALL)"""


@query("SELECT video_id, axis, point_id, f_idx, t_ds, round(re / (0.95 * m + 0.05) * hz ** 0.5, 4) + 0.0 AS re, round(im / (0.95 * m + 0.05) * hz ** 0.5, 4) + 0.0 AS im FROM ca JOIN cm USING (video_id, t_ds) JOIN hz USING (f_idx)", COMPLEX)
def normalised_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complex spectrograms pooled before the magnitude is taken; the phase is kept."""
    pooled = spectral.overlap_saved(_traces(spark, sf_dir), TAPS, POOL, as_complex=True, block=256)
    return rounded(spectral.normalised_complex(pooled, HZ), "re", "im")


# ---- tensors --------------------------------------------------------------

TENSOR = SPECTRAL + ", ten AS (SELECT video_id AS elem, axis AS xy, point_id AS points, f_idx AS frequency, t_ds AS time, round(value, 4) + 0.0 AS value FROM norm)"


def _tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = rounded(spectral.normalised(_packed_spectrogram(spark, sf_dir), HZ), "value")
    return n.select(F.col("video_id").alias("elem"), F.col("axis").alias("xy"), F.col("point_id").alias("points"), F.col("f_idx").alias("frequency"), F.col("t_ds").alias("time"), "value")


@query('SELECT elem, frequency, time, xy * 8 + points AS "(xy points)", value FROM ten', TENSOR)
def merged_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor.merged_dims(_tensor(spark, sf_dir), "xy", "points", 8)[0]


@query("SELECT video_id AS elem, point_id AS points, 2 * frame_idx + k AS time, CASE k WHEN 0 THEN x ELSE y END AS value FROM tracks, range(2) r(k)")
def interleaved_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor.interleaved(_complex(spark, sf_dir), "time")


def _complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracks(spark, sf_dir).select(F.col("video_id").alias("elem"), F.col("point_id").alias("points"), F.col("frame_idx").alias("time"), F.col("x").alias("re"), F.col("y").alias("im"))


@query("SELECT video_id AS elem, point_id AS points, frame_idx AS time, x AS re, y AS im FROM tracks")
def deinterleaved_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor.deinterleaved(tensor.interleaved(_complex(spark, sf_dir), "time"), "time")


@query("SELECT video_id, point_id, frame_idx, round(sqrt(x * x + y * y), 4) + 0.0 AS magnitude, round(atan2(y, x), 4) + 0.0 AS angle FROM tracks")
def magnitude_and_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_tracks(spark, sf_dir).select("video_id", "point_id", "frame_idx", *scalar.polar(F.col("x"), F.col("y"))), "magnitude", "angle")


@query("SELECT video_id AS elem, point_id AS points, frame_idx - first AS time, x AS value, trial_id FROM tracks JOIN trials ON frame_idx BETWEEN first AND last")
def trial_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _complex(spark, sf_dir).select("elem", "points", "time", F.col("re").alias("value"))
    return tensor.windowed(t, tables.trials(spark), "time")


@query("SELECT '0' AS elem, point_id AS points, frame_idx + first_frame AS time, x AS value FROM tracks JOIN joined USING (video_id)", GLOBAL)
def concatenated_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor.concatenated(_complex(spark, sf_dir).select("elem", "points", "time", F.col("re").alias("value")), "time")


@query("SELECT '0' AS elem, dense_rank() OVER (ORDER BY video_id) - 1 AS trials, point_id AS points, frame_idx AS time, x AS value FROM tracks")
def stacked_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor.stacked(_complex(spark, sf_dir).select("elem", "points", "time", F.col("re").alias("value")))


@query("SELECT 'time_' || video_id AS elem, frame_idx AS idx, point_id AS r, x AS value FROM tracks")
def split_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _complex(spark, sf_dir).select("elem", F.col("points").alias("r"), F.col("time").alias("idx"), F.col("re").alias("value"))
    lengths = t.groupBy("elem").agg((F.max("idx") + 1).alias("n"))
    return tensor.split(tensor.concatenated(t, "idx").select("idx", "r", "value"), lengths)


@query("SELECT elem, xy, points, frequency, time, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 3) + 0.0 AS value FROM ten WINDOW w AS (PARTITION BY elem, frequency)", TENSOR)
def standardised_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tensor.standardised(_tensor(spark, sf_dir), ["frequency"]), "value", digits=3)


@query("SELECT 0 AS k, y, x, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 4) + 0.0 AS value FROM image")
def min_max_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tensor.min_max(tables.image(spark, sf_dir).withColumn("k", F.lit(0)), ["k"]), "value")


RANK = 3
FACTORS = f""", fac AS (SELECT d.mode, i.i AS idx, r.r AS r, ((i.i * 7 + r.r * 3 + d.n) % 11 + 1) / 11.0::DOUBLE AS value
  FROM (VALUES ('xy', 2, 1), ('points', 8, 2), ('frequency', {BINS}, 3), ('time', {(tables.N_FRAMES - WIDTH) // POOL + 1}, 4)) d(mode, len, n), range(100) i(i), range({RANK}) r(r) WHERE i.i < d.len)"""


def fixed_factors(spark: SparkSession) -> dict[str, DataFrame]:
    """Factors by a rule, so that both engines start from the same ones."""
    out = {}
    for mode, length, n in (("xy", 2, 1), ("points", 8, 2), ("frequency", BINS, 3), ("time", (tables.N_FRAMES - WIDTH) // POOL + 1, 4)):
        cells = spark.range(length * RANK).select(F.floor(F.col("id") / RANK).alias("idx"), (F.col("id") % RANK).cast("int").alias("r"))
        out[mode] = cells.select("idx", "r", (((F.col("idx") * 7 + F.col("r") * 3 + n) % 11 + 1) / 11.0).alias("value"))
    return out


DIMS = ["xy", "points", "frequency", "time"]
PENALTIES = {"points": cp.Penalty(simplex=True), "frequency": cp.Penalty(sparsity=0.5), "time": cp.Penalty(smoothness=5.0)}


@query()
def cp_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent non-negative CP of every element, until an element's error changes by less than a thousandth."""
    return cp.CP(RANK, iterations=12, tolerance=1e-3).fit(_tensor(spark, sf_dir), DIMS).factors


@query()
def cp_factors_by_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain alternating least squares of every element."""
    return cp.CP(RANK, non_negative=False, iterations=6).fit(_tensor(spark, sf_dir), DIMS).factors


@query()
def cp_factors_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from 512 drawn fibres for each mode's pass."""
    return cp.CP(RANK, samples=512, iterations=6).fit(_tensor(spark, sf_dir), DIMS).factors


@query(
    """SELECT elem, mode, n AS n_rows, true AS held, true AS objective_never_rises, true AS exact FROM (
  SELECT elem, 'xy' AS mode, count(DISTINCT xy) AS n FROM ten GROUP BY elem UNION ALL SELECT elem, 'points', count(DISTINCT points) FROM ten GROUP BY elem
  UNION ALL SELECT elem, 'frequency', count(DISTINCT frequency) FROM ten GROUP BY elem UNION ALL SELECT elem, 'time', count(DISTINCT time) FROM ten GROUP BY elem)""",
    TENSOR,
)
def cp_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A penalised fit of every element: rows of each mode, if they keep what they are held to, if the objective ever
    rose, and if the error that the passes tell is that of the factors against all cells."""
    cells = _tensor(spark, sf_dir)
    fit = cp.CP(RANK, penalties=PENALTIES, iterations=3).fit(cells, DIMS)
    rows = fit.factors.groupBy("elem", "mode", "idx").agg(F.min("value").alias("least"), F.sum("value").alias("total"))
    held = (F.col("least") >= 0) & ((F.col("mode") != "points") | (F.abs(F.col("total") - 1) < 1e-9))
    told = spark.createDataFrame(fit.history, "sweep int, elem string, objective double, told double")
    before = Window.partitionBy("elem").orderBy("sweep")
    steps = told.withColumn("rise", F.col("objective") - F.lag("objective").over(before)).groupBy("elem").agg((F.max("rise") <= 1e-9).alias("objective_never_rises"), F.max_by("told", "sweep").alias("told"))
    exact = steps.join(cp.residuals(cells, DIMS, fit.factors), "elem").select("elem", "objective_never_rises", (F.abs(F.col("told") - F.col("error")) < 1e-6).alias("exact"))
    return rows.groupBy("elem", "mode").agg(F.count("*").alias("n_rows"), F.bool_and(held).alias("held")).join(exact, "elem")


@query()
def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "embeddings")
    shares = tensor.explained_variance(e, "embedding", 64)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(shares)], "component int, share double")


# ---- events ---------------------------------------------------------------

# ---- images and warps -----------------------------------------------------

WARP = [[0.96, 0.1, 1.5], [-0.08, 1.02, 2.25]]
_W = f"""remap AS (SELECT y, x, {WARP[0][0]} * x + {WARP[0][1]} * y + {WARP[0][2]} AS src_x, {WARP[1][0]} * x + {WARP[1][1]} * y + {WARP[1][2]} AS src_y FROM (SELECT CAST(y AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x FROM image)),
corner AS (SELECT r.*, floor(src_x) + i AS cx, floor(src_y) + j AS cy, (CASE i WHEN 1 THEN src_x - floor(src_x) ELSE 1 - src_x + floor(src_x) END) * (CASE j WHEN 1 THEN src_y - floor(src_y) ELSE 1 - src_y + floor(src_y) END) AS w FROM remap r, range(2) a(i), range(2) b(j))"""


def _remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The warp over every pixel of the image of all vectors."""
    return align.warped(tables.image(spark, sf_dir).select("y", "x"), WARP)


@query("SELECT CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(src_x, 4) + 0.0 AS src_x, round(src_y, 4) + 0.0 AS src_y FROM remap", _W)
def warp_to_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_remap(spark, sf_dir), "src_x", "src_y")


@query("SELECT CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(src_x - x, 4) + 0.0 AS dx, round(src_y - y, 4) + 0.0 AS dy FROM remap", _W)
def remap_to_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(align.remap_to_flow(_remap(spark, sf_dir)), "dx", "dy")


@query("SELECT CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(src_x, 4) + 0.0 AS src_x, round(src_y, 4) + 0.0 AS src_y FROM remap", _W)
def flow_to_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(align.flow_to_remap(align.remap_to_flow(_remap(spark, sf_dir))), "src_x", "src_y")


@query(f"SELECT CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round((src_x / 63 - 0.5) * 2, 4) + 0.0 AS u, round((src_y / ({_HEIGHT} - 1) - 0.5) * 2, 4) + 0.0 AS v FROM remap", _W)
def remap_to_unit_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(align.remap_to_unit(_remap(spark, sf_dir), _whole(spark, sf_dir)[1], 64), "u", "v")


def _shifted(image: DataFrame) -> DataFrame:
    return rounded(image.withColumn("value", F.col("value") + 1e-9), "value")


@query("SELECT CAST(c.y AS BIGINT) AS y, CAST(c.x AS BIGINT) AS x, round(sum(w * coalesce(i.value, 0)) + 1e-9, 4) + 0.0 AS value FROM corner c LEFT JOIN image i ON i.y = cy AND i.x = cx GROUP BY ALL", _W)
def remapped_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bilinear values; a little is added before rounding, so that exact halves go the same way on both sides."""
    return _shifted(align.remapped(tables.image(spark, sf_dir), _remap(spark, sf_dir)))


@query("SELECT CAST(r.y AS BIGINT) AS y, CAST(r.x AS BIGINT) AS x, coalesce(i.value, 0) AS value FROM remap r LEFT JOIN image i ON i.y = round_even(src_y, 0) AND i.x = round_even(src_x, 0)", _W)
def remapped_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.remapped(tables.image(spark, sf_dir), _remap(spark, sf_dir), method="nearest")


@query("""SELECT CAST(c.y AS BIGINT) AS y, CAST(c.x AS BIGINT) AS x, round(sum(w * r.src_x), 4) + 0.0 AS src_x, round(sum(w * r.src_y), 4) + 0.0 AS src_y
FROM corner c LEFT JOIN remap r ON r.y = cy AND r.x = cx WHERE w > 0 GROUP BY c.y, c.x HAVING count(r.src_x) = count(*)""", _W)
def composed_remaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(align.composed_remaps(_remap(spark, sf_dir), _remap(spark, sf_dir)), "src_x", "src_y")


@query("SELECT CAST(round_even(src_y, 0) AS BIGINT) AS y, CAST(round_even(src_x, 0) AS BIGINT) AS x, round(avg(x), 4) + 0.0 AS src_x, round(avg(y), 4) + 0.0 AS src_y FROM remap GROUP BY 1, 2".replace("avg(x)", "avg(remap.x)").replace("avg(y)", "avg(remap.y)"), _W)
def inverted_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(align.inverted_remap(_remap(spark, sf_dir)), "src_x", "src_y")


@query(f"""SELECT point_id, round(least(greatest(sum(w * src_x), 0), 63), 4) + 0.0 AS x, round(least(greatest(sum(w * src_y), 0), {_HEIGHT} - 1), 4) + 0.0 AS y FROM (
  SELECT point_id, floor(px) + i AS cx, floor(py) + j AS cy, (CASE i WHEN 1 THEN px - floor(px) ELSE 1 - px + floor(px) END) * (CASE j WHEN 1 THEN py - floor(py) ELSE 1 - py + floor(py) END) AS w
  FROM (SELECT point_id, least(greatest(x0, 0), 63) AS px, least(greatest(y0, 0), {_HEIGHT} - 1) AS py FROM points), range(2) a(i), range(2) b(j)) JOIN remap r ON r.y = cy AND r.x = cx WHERE w > 0 GROUP BY point_id""", _W)
def remapped_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(align.remapped_points(tables.points(_tracks(spark, sf_dir)), _remap(spark, sf_dir), _whole(spark, sf_dir)[1], 64), "x", "y")


_CELLS = "a AS (SELECT s_suppkey AS id, i // 3 AS i, i % 3 AS j, ((s_suppkey * 5 + i * 7) % 13) / 13.0::DOUBLE AS value FROM supplier, range(9) r(i))"


@query("SELECT p.id, CAST(p.i AS BIGINT) AS i, CAST(q.j AS BIGINT) AS j, round(sum(p.value * q.value), 4) + 0.0 AS value FROM a p JOIN a q ON p.id = q.id AND p.j = q.i GROUP BY ALL", _CELLS)
def composed_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k"))
    a = s.select("id", F.floor(F.col("k") / 3).alias("i"), (F.col("k") % 3).cast("long").alias("j"), (((F.col("id") * 5 + F.col("k") * 7) % 13) / 13.0).alias("value"))
    return rounded(align.composed_tables(a, a), "value")


@query("""WITH m AS (SELECT s_suppkey AS id, 1.0 + (s_suppkey % 7) / 10.0 AS a, (s_suppkey % 5) / 20.0 AS b, s_suppkey % 11 AS c, (s_suppkey % 3) / 20.0 AS d, 1.0 + (s_suppkey % 4) / 10.0 AS e, s_suppkey % 13 AS f FROM supplier)
SELECT id, round(e / (a * e - b * d), 4) + 0.0 AS a, round(-b / (a * e - b * d), 4) + 0.0 AS b, round((b * f - c * e) / (a * e - b * d), 4) + 0.0 AS c,
round(-d / (a * e - b * d), 4) + 0.0 AS d, round(a / (a * e - b * d), 4) + 0.0 AS e, round((c * d - a * f) / (a * e - b * d), 4) + 0.0 AS f FROM m""".replace("WITH m", "SELECT * FROM (WITH m").replace("AS f FROM m", "AS f FROM m)"))
def inverted_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    m = tables.table(spark, sf_dir, "supplier").select(k.alias("id"), (1 + k % 7 / 10).alias("a"), (k % 5 / 20).alias("b"), (k % 11).alias("c"), (k % 3 / 20).alias("d"), (1 + k % 4 / 10).alias("e"), (k % 13).alias("f"))
    return rounded(align.inverted_columns(m), *"abcdef")


@query("""SELECT y, x, round(value, 4) + 0.0 AS value FROM h JOIN (
  SELECT ty, tx, bin, (sum(c) OVER w + spare * (bin + 1)) / n AS value FROM (
    SELECT *, (n - sum(c) OVER (PARTITION BY ty, tx)) / 64 AS spare FROM (SELECT *, least(k, 4.0 * n / 64) AS c FROM (SELECT *, sum(k) OVER (PARTITION BY ty, tx) AS n FROM (SELECT ty, tx, bin, count(*) AS k FROM h GROUP BY ALL))))
  WINDOW w AS (PARTITION BY ty, tx ORDER BY bin)) USING (ty, tx, bin)""", "h AS (SELECT y, x, y // 16 AS ty, x // 16 AS tx, least(floor((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) * 64), 63) AS bin FROM image)")
def equalised_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(align.equalised(tables.image(spark, sf_dir), 16), "value")


@query("""SELECT video_id, frame_idx, round(sqrt(a * a + b * b), 3) + 0.0 AS scale, round(mx - a * mx0 + b * my0, 2) + 0.0 AS dx, round(my - b * mx0 - a * my0, 2) + 0.0 AS dy FROM (
  SELECT video_id, frame_idx, sum((x0 - mx0) * (x - mx) + (y0 - my0) * (y - my)) / sum((x0 - mx0) ** 2 + (y0 - my0) ** 2) AS a, sum((x0 - mx0) * (y - my) - (y0 - my0) * (x - mx)) / sum((x0 - mx0) ** 2 + (y0 - my0) ** 2) AS b, any_value(mx0) AS mx0, any_value(my0) AS my0, any_value(mx) AS mx, any_value(my) AS my
  FROM (SELECT *, avg(x0) OVER w AS mx0, avg(y0) OVER w AS my0, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM tracks JOIN points USING (point_id) WINDOW w AS (PARTITION BY video_id, frame_idx)) GROUP BY ALL)""")
def rigid_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tracks(spark, sf_dir)
    out = align.rigid_motion(t.join(tables.points(t), "point_id"), ["video_id", "frame_idx"]).drop("angle")
    return rounded(rounded(out, "scale", digits=3), "dx", "dy", digits=2)


TRIALS, NEAR = 12, 60.0
_DRAWN = lambda which: "((n * n + n * (trial + 3)) % {3})".replace("n", f"(((point_id + 1) * {{0}} + (trial + 1) * {{1}} + {which + 1} * {{2}}) % {{3}})").format(*align.DRAW)


@query(f"""SELECT video_id, frame_idx, n_inliers, round(sqrt(a * a + b * b), 3) + 0.0 AS scale, round(mx - a * mx0 + b * my0, 2) + 0.0 AS dx, round(my - b * mx0 - a * my0, 2) + 0.0 AS dy FROM (
  SELECT video_id, frame_idx, n_inliers, sum((x0 - mx0) * (x - mx) + (y0 - my0) * (y - my)) / sum((x0 - mx0) ** 2 + (y0 - my0) ** 2) AS a, sum((x0 - mx0) * (y - my) - (y0 - my0) * (x - mx)) / sum((x0 - mx0) ** 2 + (y0 - my0) ** 2) AS b, any_value(mx0) AS mx0, any_value(my0) AS my0, any_value(mx) AS mx, any_value(my) AS my
  FROM (SELECT *, avg(x0) OVER w AS mx0, avg(y0) OVER w AS my0, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM chosen WINDOW w AS (PARTITION BY video_id, frame_idx)) GROUP BY ALL)""",
f"""lots AS (SELECT t.video_id, t.frame_idx, CAST(t.point_id AS BIGINT) AS point_id, x0, y0, x, y, trial FROM tracks t JOIN points USING (point_id), range({TRIALS}) r(trial)),
two AS (SELECT video_id, frame_idx, trial, arg_min(struct_pack(x0 := x0, y0 := y0, x := x, y := y), row({_DRAWN(0)}, point_id)) AS p, arg_min(struct_pack(x0 := x0, y0 := y0, x := x, y := y), row({_DRAWN(1)}, point_id)) AS q FROM lots GROUP BY ALL),
ways AS (SELECT video_id, frame_idx, trial, p, ((q.x0 - p.x0) * (q.x - p.x) + (q.y0 - p.y0) * (q.y - p.y)) / n AS a, ((q.x0 - p.x0) * (q.y - p.y) - (q.y0 - p.y0) * (q.x - p.x)) / n AS b
  FROM (SELECT *, (q.x0 - p.x0) * (q.x0 - p.x0) + (q.y0 - p.y0) * (q.y0 - p.y0) AS n FROM two) WHERE n > 0),
voters AS (SELECT l.* FROM lots l JOIN ways w ON w.video_id = l.video_id AND w.frame_idx = l.frame_idx AND w.trial = l.trial
  WHERE (w.p.x + a * (l.x0 - w.p.x0) - b * (l.y0 - w.p.y0) - l.x) ** 2 + (w.p.y + b * (l.x0 - w.p.x0) + a * (l.y0 - w.p.y0) - l.y) ** 2 <= {NEAR * NEAR}),
chosen AS (SELECT v.*, b.n_inliers FROM voters v JOIN (SELECT video_id, frame_idx, arg_max(trial, row(n, -trial)) AS trial, max(n) AS n_inliers FROM (SELECT video_id, frame_idx, trial, count(*) AS n FROM voters GROUP BY ALL) GROUP BY ALL) b
  ON b.video_id = v.video_id AND b.frame_idx = v.frame_idx AND b.trial = v.trial)""")
def robust_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tracks(spark, sf_dir)
    out = align.robust_motion(t.join(tables.points(t), "point_id"), ["video_id", "frame_idx"], NEAR, TRIALS).drop("angle")
    return rounded(rounded(out, "scale", digits=3), "dx", "dy", digits=2)


FIELD = """vectors AS (SELECT vec_id AS y, CAST(i - 1 AS BIGINT) AS x, CAST(embedding[i] AS DOUBLE) AS v, CAST(embedding[65 - i] AS DOUBLE) AS u FROM embeddings, range(1, 65) r(i)),
field AS (SELECT y, x, x + v * 0.4 / m AS src_x, y + u * 0.4 / m AS src_y FROM vectors, (SELECT max(abs(v)) AS m FROM vectors))"""


def _field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A remap over every vector: each pixel comes from up to 0.4 pixels beside it, as its vector and the reversed one say."""
    e = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.col("embedding").cast("array<double>").alias("e"))
    cells = e.select("y", F.posexplode(F.arrays_zip(F.col("e").alias("v"), F.reverse("e").alias("u"))).alias("x", "c")).select("y", F.col("x").cast("long").alias("x"), "c.v", "c.u")
    most = cells.agg(F.max(F.abs("v")).alias("m"))
    return cells.join(most, F.lit(True)).select("y", "x", (F.col("x") + F.col("v") * 0.4 / F.col("m")).alias("src_x"), (F.col("y") + F.col("u") * 0.4 / F.col("m")).alias("src_y"))


@query("""SELECT y, x, round(sx, 4) + 0.0 AS src_x, round(sy, 4) + 0.0 AS src_y FROM (
  SELECT y, x, cx + pj + u * (qj - pj) + v * (rj - pj) AS sx, cy + pi + u * (qi - pi) + v * (ri - pi) AS sy, row_number() OVER (PARTITION BY y, x ORDER BY cy, cx, h) AS nth FROM (
    SELECT *, ((x - px) * (ry - py) - (rx - px) * (y - py)) / area AS u, ((qx - px) * (y - py) - (x - px) * (qy - py)) / area AS v
    FROM (SELECT *, (qx - px) * (ry - py) - (rx - px) * (qy - py) AS area FROM (SELECT *, unnest(range(CAST(ceil(least(px, qx, rx)) AS BIGINT), CAST(floor(greatest(px, qx, rx)) AS BIGINT) + 1)) AS x FROM (
      SELECT *, unnest(range(CAST(ceil(least(py, qy, ry)) AS BIGINT), CAST(floor(greatest(py, qy, ry)) AS BIGINT) + 1)) AS y FROM halves))) WHERE area <> 0)
  WHERE u >= -1e-9 AND v >= -1e-9 AND u + v <= 1 + 1e-9) WHERE nth = 1""", FIELD + """,
quads AS (SELECT a.y AS cy, a.x AS cx, a.src_x AS x00, a.src_y AS y00, b.src_x AS x01, b.src_y AS y01, c.src_x AS x10, c.src_y AS y10, d.src_x AS x11, d.src_y AS y11
  FROM field a JOIN field b ON b.y = a.y AND b.x = a.x + 1 JOIN field c ON c.y = a.y + 1 AND c.x = a.x JOIN field d ON d.y = a.y + 1 AND d.x = a.x + 1),
halves AS (SELECT cy, cx, 0 AS h, 0 AS pi, 0 AS pj, 0 AS qi, 1 AS qj, 1 AS ri, 0 AS rj, x00 AS px, y00 AS py, x01 AS qx, y01 AS qy, x10 AS rx, y10 AS ry FROM quads
  UNION ALL SELECT cy, cx, 1, 1, 1, 1, 0, 0, 1, x11, y11, x10, y10, x01, y01 FROM quads)""")
def interpolated_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(align.interpolated_inverse(_field(spark, sf_dir)), "src_x", "src_y")


@query("""SELECT y, x, round(sum(w * value), 4) + 0.0 AS value FROM (
  SELECT y, x, bin, floor(fy) + i AS ty, floor(fx) + j AS tx, (CASE i WHEN 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END) * (CASE j WHEN 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END) AS w
  FROM (SELECT y, x, bin, least(greatest((y + 0.5) / 16 - 0.5, 0), (SELECT max(ty) FROM h)) AS fy, least(greatest((x + 0.5) / 16 - 0.5, 0), (SELECT max(tx) FROM h)) AS fx FROM h), range(2) a(i), range(2) b(j)) JOIN lut USING (ty, tx, bin)
WHERE w > 0 GROUP BY y, x""", """vectors AS (SELECT vec_id AS y, CAST(i - 1 AS BIGINT) AS x, round(CAST(embedding[i] AS DOUBLE), 4) AS value FROM embeddings, range(1, 65) r(i)),
h AS (SELECT y, x, y // 16 AS ty, x // 16 AS tx, CAST(least(floor((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) * 64), 63) AS BIGINT) AS bin FROM vectors),
cut AS (SELECT t.ty, t.tx, b.bin, t.n, least(coalesce(k.k, 0), 4.0 * t.n / 64) AS c FROM (SELECT ty, tx, count(*) AS n FROM h GROUP BY ALL) t CROSS JOIN range(64) b(bin) LEFT JOIN (SELECT ty, tx, bin, count(*) AS k FROM h GROUP BY ALL) k ON k.ty = t.ty AND k.tx = t.tx AND k.bin = b.bin),
lut AS (SELECT ty, tx, bin, (sum(c) OVER (PARTITION BY ty, tx ORDER BY bin) + (n - sum(c) OVER (PARTITION BY ty, tx)) / 64 * (bin + 1)) / n AS value FROM cut)""")
def blended_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a row of an image, equalised with tables blended between tiles."""
    return rounded(align.blended(_whole(spark, sf_dir)[0], 16), "value")


# ---- comparison, tracking --------------------------------------------------


@query("SELECT video_id, bool_and(abs(x - y) <= 0.5 + 0.1 * abs(y)) AS same, round(avg(abs(x - y)), 4) + 0.0 AS mean_difference, round(max(abs(x - y)), 4) + 0.0 AS max_difference, count(*) AS n FROM tracks GROUP BY video_id")
def all_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.all_close(_tracks(spark, sf_dir), ["video_id"], "x", "y", atol=0.5, rtol=0.1), "mean_difference", "max_difference")


@query("SELECT coalesce(a.k, b.k) AS key, CASE WHEN a.k IS NULL THEN 'missing left' ELSE 'missing right' END AS problem FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT c_custkey AS k FROM customer) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def key_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).distinct()
    return compare.key_mismatches(a, tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), "key")


@query("SELECT e.event_id, t.fullkey AS path, CAST(t.atom AS VARCHAR) AS value FROM events e, json_tree(e.props) t WHERE t.atom IS NOT NULL")
def property_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf of every event's properties."""
    return trees.leaves(tables.table(spark, sf_dir, "events"), ["event_id"], "props").drop("kind")


@query("""SELECT coalesce(a.event_id, b.event_id) AS event_id, coalesce(a.path, b.path) AS path, a.value AS left, b.value AS right, CASE WHEN a.path IS NULL THEN 'missing left' WHEN b.path IS NULL THEN 'missing right' ELSE 'differs' END AS problem
FROM a FULL JOIN b ON a.event_id = b.event_id AND a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR NOT (abs(CAST(a.value AS DOUBLE) - CAST(b.value AS DOUBLE)) <= 20 + 1e-5 * abs(CAST(b.value AS DOUBLE)))""",
"""a AS (SELECT e.event_id, t.fullkey AS path, t.atom->>'$' AS value FROM events e, json_tree(e.props) t WHERE t.atom IS NOT NULL),
b AS (SELECT e.event_id, t.fullkey AS path, t.atom->>'$' AS value FROM (SELECT event_id, to_json({'k': user_id % 100, 'at': {'kind': event_type, 'days': [day(ts), hour(ts)]}}) AS props FROM events) e, json_tree(e.props) t WHERE t.atom IS NOT NULL)""")
def tree_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's properties beside a nested tree of its own columns, path by path."""
    e = tables.table(spark, sf_dir, "events")
    at = F.struct(F.col("event_type").alias("kind"), F.array(F.dayofmonth("ts"), F.hour("ts")).alias("days"))
    made = e.select("event_id", F.to_json(F.struct((F.col("user_id") % 100).alias("k"), at.alias("at"))).alias("props"))
    return trees.tree_differences(e.select("event_id", "props"), made, ["event_id"], "props", atol=20)





@query()
def kalman_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(track.kalman(_tracks(spark, sf_dir)), "x", "y")


# The axes don't meet, so the filter is a recursion of one position, one velocity and three covariances (a, b, d) for each.
SQL["kalman_tracks"] = f"""WITH RECURSIVE {tables.SQL},
k AS (
  SELECT video_id, point_id, frame_idx, x AS sx, y AS sy, 0::DOUBLE AS vx, 0::DOUBLE AS vy, 0.5::DOUBLE AS a, 0::DOUBLE AS b, 1::DOUBLE AS d FROM tracks WHERE frame_idx = 0
  UNION ALL
  SELECT video_id, point_id, frame_idx, px + g * (x - px), py + g * (y - py), vx + h * (x - px), vy + h * (y - py), (1 - g) * a, (1 - g) * b, d - h * b
  FROM (SELECT *, a / (a + 1) AS g, b / (a + 1) AS h FROM (
    SELECT t.video_id, t.point_id, t.frame_idx, t.x, t.y, k.sx + k.vx AS px, k.sy + k.vy AS py, k.vx, k.vy, k.a + 2 * k.b + k.d + 0.01 AS a, k.b + k.d AS b, k.d + 0.01 AS d
    FROM k JOIN tracks t ON t.video_id = k.video_id AND t.point_id = k.point_id AND t.frame_idx = k.frame_idx + 1) p) q)
SELECT video_id, point_id, frame_idx, round(sx, 4) + 0.0 AS x, round(sy, 4) + 0.0 AS y FROM k"""


#: Vectors in a frame of :func:`frames.scrolled`, and their neighbours in its averages.
ROWS, BLUR = 24, 2


def _scrolls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.scrolled(tables.table(spark, sf_dir, "embeddings"), ROWS, BLUR)


def _pictures(spark: SparkSession, sf_dir: str, group: int | None = None) -> DataFrame:
    """The scrolls' frames as pictures, a byte for each pixel; a session is a label's whole scroll, or ``group`` frames of it. Written once, for queries that read them several times."""
    session = F.col("video_id") if group is None else F.concat_ws("/", "video_id", F.floor(F.col("frame_idx") / group))
    shown = keep(_scrolls(spark, sf_dir), "pictures")
    return shown.select(session.alias("session"), F.col("frame_idx").alias("image_id"), "height", "width", "data")


def _moved(warps: DataFrame) -> DataFrame:
    """Shifts of warps, to the pixel."""
    return warps.select("session", F.col("image_id").alias("frame_idx"), (F.round(F.abs(F.col("warp")[2])) + 0.0).alias("dx"), (F.round(F.abs(F.col("warp")[5])) + 0.0).alias("dy"))


_FRAMES = f"shown AS (SELECT CAST(label AS VARCHAR) AS label, n - 1 AS frame_idx FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n, count(*) OVER (PARTITION BY label) AS size FROM embeddings) WHERE n <= size - {ROWS + 2 * BLUR - 1})"


@query(f"""SELECT CAST(label AS VARCHAR) AS session, n - 1 AS frame_idx, CAST(0 AS DOUBLE) AS dx, CAST(CASE WHEN n > 1 THEN 1 ELSE 0 END AS DOUBLE) AS dy
FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n, count(*) OVER (PARTITION BY label) AS size FROM embeddings) WHERE n <= size - {ROWS + 2 * BLUR - 1}""")
def registered_scrolls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame of every label's scroll registered to the one before: a row farther, to the pixel."""
    return _moved(align.registered_to_previous(_pictures(spark, sf_dir), "translation"))


@query("SELECT label || '/' || frame_idx // 3 AS session, frame_idx, CAST(0 AS DOUBLE) AS dx, CAST(frame_idx % 3 AS DOUBLE) AS dy FROM shown", _FRAMES)
def registered_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame registered to the first of its three."""
    return _moved(align.registered_to_first(_pictures(spark, sf_dir, 3), "translation"))


@query()
def transformed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame resampled onto the first of its three."""
    images = _pictures(spark, sf_dir, 3)
    return align.transformed(images, align.registered_to_first(images, "translation")).select("session", "image_id", F.posexplode("data").alias("pixel", "value"))


@query("SELECT label || '/' || frame_idx // 6 AS session, frame_idx, CAST(0 AS DOUBLE) AS dx, CAST(frame_idx % 6 AS DOUBLE) AS dy FROM shown", _FRAMES)
def chained_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warps to the first of six frames, from warps to the one before."""
    return _moved(align.chained(align.registered_to_previous(_pictures(spark, sf_dir, 6), "translation")))


@query()
def dense_flow_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow from the first of every two frames to the second, at every pixel."""
    return align.flow_fields(_pictures(spark, sf_dir, 2))


@query("SELECT label || '/' || frame_idx // 2 AS session, frame_idx, CAST(0 AS DOUBLE) AS dx, CAST(frame_idx % 2 AS DOUBLE) AS dy FROM shown", _FRAMES)
def flow_of_scrolls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of each frame's flow from the first of its two, to the pixel."""
    median = align.flow_fields(_pictures(spark, sf_dir, 2)).groupBy("session", F.col("image_id").alias("frame_idx")).agg(F.median("dx").alias("dx"), F.median("dy").alias("dy"))
    return median.select("session", "frame_idx", *[(F.round(F.abs(c)) + 0.0).alias(c) for c in ("dx", "dy")])


@query(
    f"SELECT CAST(vec_id AS VARCHAR) AS session, v.image_id, v.y, v.x, round({WARP[0][0]} * src_x + {WARP[0][1]} * src_y + {WARP[0][2]}, 4) + 0.0 AS src_x, round({WARP[1][0]} * src_x + {WARP[1][1]} * src_y + {WARP[1][2]}, 4) + 0.0 AS src_y FROM (SELECT y AS vec_id, 0 AS image_id, * FROM field) v", FIELD
)
def folded_warps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's flow folded with one warp into a remap."""
    flows = align.remap_to_flow(_field(spark, sf_dir)).select(F.col("y").cast("string").alias("session"), F.lit(0).alias("image_id"), "y", "x", "dx", "dy")
    warps = flows.select("session", "image_id").distinct().withColumn("warp", F.array(*[F.lit(float(c)) for r in WARP for c in r]))
    return rounded(align.folded(flows, warps), "src_x", "src_y")


@query()
def nonrigid_scrolls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remaps of every frame to the first of its three: registered, moved, and the rest of the motion by flow, folded into one."""
    images = _pictures(spark, sf_dir, 3)
    warps = keep(align.registered_to_first(images, "translation"), "warps")
    moved = keep(align.transformed(images, warps), "moved")
    return align.folded(align.flow_fields(moved), warps)


@query()
def point_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six points tracked over every label's scroll, held by three neighbours each."""
    home = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate([(12, 8), (24, 8), (36, 8), (12, 16), (24, 16), (36, 16)])], "point_id long, x0 double, y0 double")
    return track.track_points(keep(_scrolls(spark, sf_dir), "scrolls"), home, track.TrackerParams(neighbours=3))


@query()
def tracked_scrolls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four points tracked over every label's scroll; they hold to their places, so rewinds set in as the pictures leave them."""
    home = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate([(16, 12), (24, 12), (40, 12), (48, 12)])], "point_id long, x0 double, y0 double")
    return track.track_points(keep(_scrolls(spark, sf_dir), "scrolls"), home, track.TrackerParams(neighbours=2, threshold=6.0, relaxation=0.05))


BANK = np.round(spectral.make_taps(1.0, 1 / 24, 0.4, BINS, WIDTH, 2, 4)[0], 8)


@query(
    "SELECT video_id, axis, point_id, f_idx, t_ds, round(value, 4) + 0.0 AS value FROM spec",
    SPECTRAL.replace(_TAPS, "taps(f_idx, k, re, im) AS (VALUES " + ", ".join(f"({f}, {k}, {z.real:.8f}::DOUBLE, {z.imag:.8f}::DOUBLE)" for f, row in enumerate(BANK) for k, z in enumerate(row)) + ")"),
)
def vqt_filter_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variable-Q bank itself, over the same traces."""
    return rounded(spectral.vqt(spectral.packed(_traces(spark, sf_dir)), BANK, POOL), "value")




# ---- every video, element and event -------------------------------------------

EACH = f"""{TRACES}, f AS (SELECT video_id, frame_idx AS idx, point_id AS r, x AS value FROM tracks),
axis AS (SELECT o // {POOL} AS t_ds, avg(o) + {(WIDTH - 1) / 2} AS sample FROM range({tables.N_FRAMES - WIDTH + 1}) r(o) GROUP BY 1),
ev AS (SELECT event_id, event_type, (epoch(ts) - {tables.START}) / 3600.0 AS moment FROM events),
bins AS (SELECT event_id, event_type, arg_min(t_ds, row(abs(sample - moment), t_ds)) AS t_ds FROM ev, axis WHERE moment > 100 GROUP BY 1, 2),
g AS (SELECT video_id, idx, r, abs(value) / nullif(stddev_pop(abs(value)) OVER (PARTITION BY video_id, r), 0) AS value FROM f),
around AS (SELECT event_id, event_type, video_id, r, idx - t_ds AS rel, value FROM bins JOIN g ON idx >= t_ds - 4 AND idx < t_ds + 4)"""
VIDEO = ("video_id",)


def _factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracks(spark, sf_dir).select("video_id", F.col("frame_idx").alias("idx"), F.col("point_id").alias("r"), F.col("x").alias("value"))


def _all_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events")
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - tables.START) / 3600.0
    return align.nearest_bins(e.select("event_id", "event_type", at.alias("at")), spectral.time_axis(spark, tables.N_FRAMES, WIDTH, POOL), least=100)


def _all_traces(spark: SparkSession, sf_dir: str, factor: DataFrame | None = None) -> DataFrame:
    factor = align.scaled_factor(_factors(spark, sf_dir), VIDEO) if factor is None else factor
    return align.around_events(factor, _all_bins(spark, sf_dir), 4, 4, VIDEO, ("event_type",))


@query("SELECT video_id, a.r, b.r AS s, round(corr(a.value, b.value) - CASE WHEN a.r = b.r THEN 1 ELSE 0 END, 4) + 0.0 AS corr FROM f a JOIN f b USING (video_id, idx) GROUP BY video_id, a.r, b.r", EACH)
def factor_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tensor.correlations(_factors(spark, sf_dir), VIDEO), "corr")


@query("SELECT video_id, idx AS point, r, round(sqrt(x * x + y * y), 4) + 0.0 AS magnitude, round(atan2(y, x), 4) + 0.0 AS angle FROM (SELECT video_id, idx % 360 AS idx, r, sum(CASE WHEN idx < 360 THEN value ELSE 0 END) AS x, sum(CASE WHEN idx >= 360 THEN value ELSE 0 END) AS y FROM f GROUP BY 1, 2, 3)", EACH)
def polar_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tensor.polar_loadings(_factors(spark, sf_dir), 360, VIDEO), "magnitude", "angle")


@query("SELECT video_id, idx, r, round(value, 4) + 0.0 AS value FROM g", EACH)
def scaled_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(align.scaled_factor(_factors(spark, sf_dir), VIDEO), "value")


@query("SELECT event_id, event_type, t_ds FROM bins", EACH)
def nearest_event_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_bins(spark, sf_dir)


@query("SELECT event_type, video_id, r, rel, round(avg(value), 4) + 0.0 AS mean, round(stddev_pop(value), 4) + 0.0 AS std, count(*) AS n FROM around GROUP BY ALL", EACH)
def peri_event_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages around each event type of each video's factor."""
    return rounded(align.peri_event(_all_traces(spark, sf_dir), ("event_type", "video_id")), "mean", "std")


@query("SELECT event_id, event_type, video_id, r, rel, round(value, 4) + 0.0 AS value FROM around", EACH)
def event_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factors around every event; rounded before they are joined, as a value stands beside many events."""
    return _all_traces(spark, sf_dir, rounded(align.scaled_factor(_factors(spark, sf_dir), VIDEO), "value"))


@query(f"""SELECT p.video_id, p.r AS key, q.x, round(CASE WHEN a.idx IS NULL THEN NULL WHEN b.idx IS NULL THEN a.value ELSE a.value + (b.value - a.value) * (q.x - a.idx * 2.5) / 2.5 END, 4) + 0.0 AS value
FROM (SELECT DISTINCT video_id, r FROM f) p CROSS JOIN (SELECT i AS x FROM range({tables.N_FRAMES * 5 // 2}) t(i)) q
LEFT JOIN f a ON a.video_id = p.video_id AND a.r = p.r AND a.idx = floor(q.x / 2.5) AND q.x <= {tables.N_FRAMES - 1} * 2.5 LEFT JOIN f b ON b.video_id = p.video_id AND b.r = p.r AND b.idx = a.idx + 1""", EACH)
def interpolated_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every video's factor over all frames on the finer grid; outside of its samples there is no value."""
    s = _factors(spark, sf_dir).select(F.struct("video_id", "r").alias("key"), (F.col("idx") * 2.5).alias("x"), "value")
    out = align.interpolated(s, spark.range(tables.N_FRAMES * 5 // 2).select(F.col("id").alias("x")))
    out = out.select(F.col("key.video_id").alias("video_id"), F.col("key.r").alias("key"), "x", F.nanvl("value", F.lit(None).cast("double")).alias("value"))
    return rounded(out, "value")


@query("""SELECT t.elem, t.frequency AS idx, CAST(a.r AS INTEGER) AS r, round(sum(t.value * a.value * b.value * c.value), 2) + 0.0 AS value
FROM ten t JOIN fac a ON a.mode = 'xy' AND a.idx = t.xy JOIN fac b ON b.mode = 'points' AND b.idx = t.points AND b.r = a.r JOIN fac c ON c.mode = 'time' AND c.idx = t.time AND c.r = a.r
GROUP BY ALL""", TENSOR + FACTORS)
def khatri_rao_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tensor.mttkrp(_tensor(spark, sf_dir), fixed_factors(spark), "frequency", ("elem",)), "value", digits=2)


@query("SELECT video_id, a.r, b.r AS s, round(sum(a.value * b.value), 4) + 0.0 AS value FROM f a JOIN f b USING (video_id, idx) GROUP BY video_id, a.r, b.r", EACH)
def factor_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tensor.gram(_factors(spark, sf_dir), VIDEO), "value")


PIXELS = "pix AS (SELECT vec_id AS y, CAST(i - 1 AS BIGINT) AS x, round(CAST(embedding[i] AS DOUBLE), 4) AS value FROM embeddings, range(1, 65) r(i))"


@query("SELECT y, x, CAST(c AS INTEGER) AS channel, value FROM pix, range(3) t(c)", PIXELS)
def grey_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel of every vector in three equal channels."""
    image = _whole(spark, sf_dir)[0]
    return image.select("y", "x", F.posexplode(scalar.grey_to_rgb(F.col("value"))).alias("channel", "value"))


@query(
    "SELECT y, x, round((m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()), 4) + 0.0 AS value FROM (SELECT y, x, 0.7 * value + 0.3 * value * value AS m FROM pix)", PIXELS
)
def augmented_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a row of an image, mixed with its squares and scaled."""
    image = _whole(spark, sf_dir)[0]
    return rounded(align.augmented(image, image.select("y", "x", (F.col("value") * F.col("value")).alias("value")), 0.3), "value")
