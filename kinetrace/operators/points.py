"""Masks, grids, meshes, displacements and violations of tracked points, as relations."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinetrace.storage import keep


def pixels(spark: SparkSession, height: int, width: int) -> DataFrame:
    """Every (y, x) of an image."""
    return spark.range(height * width).select((F.col("id") / width).cast("long").alias("y"), (F.col("id") % width).alias("x"))


def polygon_mask(image_pixels: DataFrame, vertices: DataFrame) -> DataFrame:
    """(roi_id, y, x) of the pixels inside each polygon (roi_id, ord, x, y), by the even-odd rule; edges are few and broadcast by size."""
    order = Window.partitionBy("roi_id").orderBy("ord")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = vertices.select(
        "roi_id", F.col("x").alias("xa"), F.col("y").alias("ya"),
        F.coalesce(F.lead("x").over(order), F.first("x").over(whole)).alias("xb"), F.coalesce(F.lead("y").over(order), F.first("y").over(whole)).alias("yb"),
    )
    crossing = ((F.col("ya") > F.col("y")) != (F.col("yb") > F.col("y"))) & (F.col("x") < (F.col("xb") - F.col("xa")) * (F.col("y") - F.col("ya")) / F.nullif(F.col("yb") - F.col("ya"), F.lit(0.0)) + F.col("xa"))
    return image_pixels.join(edge, crossing).groupBy("roi_id", "y", "x").count().where("count % 2 = 1").select("roi_id", "y", "x")


def mask_intersection(roi_pixels: DataFrame) -> DataFrame:
    """(y, x) inside every ROI: masks are joined by AND."""
    n = roi_pixels.select(F.countDistinct("roi_id").alias("n"))
    return roi_pixels.groupBy("y", "x").agg(F.countDistinct("roi_id").alias("k")).join(n, F.col("k") == F.col("n")).select("y", "x")


def mask_intersection_sets(masks: list[DataFrame]) -> DataFrame:
    """The same by INTERSECT of one relation per mask."""
    return reduce(DataFrame.intersect, masks)


def masked(image: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels outside the mask become 0."""
    inside = mask.select("y", "x", F.lit(1.0).alias("_in"))
    return image.join(inside, ["y", "x"], "left").select("y", "x", (F.col("value") * F.coalesce("_in", F.lit(0.0))).alias("value"))


def border_masked(image: DataFrame, height: int, width: int, top: int = 0, bottom: int = 0, left: int = 0, right: int = 0, centre: int = 0) -> DataFrame:
    """Zeros in the outer rows and columns and in a centre square; a width of 0 masks nothing."""
    y, x = F.col("y"), F.col("x")
    out = (y < top) | (y >= height - bottom) | (x < left) | (x >= width - right)
    if centre:
        out = out | ((F.abs(y - height // 2) < centre) & (F.abs(x - width // 2) < centre))
    return image.select("y", "x", F.when(out, F.lit(0.0)).otherwise(F.col("value")).alias("value"))


def channel_collapse(frames: DataFrame) -> DataFrame:
    """Mean over the channels of a pixel, cut to a whole number: (video_id, frame_idx, y, x, channel, value)."""
    return frames.groupBy("video_id", "frame_idx", "y", "x").agg(F.floor(F.avg("value")).cast("long").alias("value"))


def grid_points(mask: DataFrame, spacing: float) -> DataFrame:
    """Tracking points on a grid inside a mask: x outer, y inner, the upper ends left out; a broken spacing is rounded half to even."""
    step = int(round(spacing))
    box = mask.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).where("x0 < x1 AND y0 < y1")
    xs = box.select(F.explode(F.sequence("x0", F.col("x1") - 1, F.lit(step).cast("long"))).alias("x"), "y0", "y1")
    grid = xs.select("x", F.explode(F.sequence("y0", F.col("y1") - 1, F.lit(step).cast("long"))).alias("y"))
    kept = grid.join(mask.select("x", "y"), ["x", "y"], "left_semi")
    return batches(kept, F.struct("x", "y"), 1).select(F.col("batch_id").alias("point_id"), F.col("x").cast("double").alias("x0"), F.col("y").cast("double").alias("y0"))


def mesh(points: DataFrame, k: int) -> DataFrame:
    """(point_id, neighbor_id, rank): the k nearest points, the point itself among them, ties by id.

    Point sets are bounded by what one image holds; the pairs are those of one such set.
    """
    a, b = points.alias("a"), points.alias("b")
    d = F.pow(F.col("a.x0") - F.col("b.x0"), F.lit(2)) + F.pow(F.col("a.y0") - F.col("b.y0"), F.lit(2))
    near = Window.partitionBy("point_id").orderBy("d", "neighbor_id")
    pairs = a.join(b, F.lit(True)).select(F.col("a.point_id").alias("point_id"), F.col("b.point_id").alias("neighbor_id"), d.alias("d"))
    return pairs.withColumn("rank", F.row_number().over(near).cast("long")).where(F.col("rank") <= k).select("point_id", "neighbor_id", "rank")


def nearest_points(points: DataFrame, k: int, growth: float = 4.0) -> DataFrame:
    """(point_id, neighbor_id, rank) as :func:`mesh` gives it, for point sets of any size: a grid index instead of all pairs.

    Points at one place have the same neighbours, and no more than the ``k`` least ids of a
    place can be anyone's, so a crowd at one place is ``k`` candidates. Each place looks
    through its grid cell and the eight around it; where the k-th candidate is nearer than a
    cell's width, nothing outside can be nearer or tie. The others go on to a grid of wider
    cells, until none is left or the nine cells hold all points. Cells start small (half
    of what holds k points on average), so crowded regions are done before cells grow wide.

    Points without an id or a finite place are left out; sets of fewer than k points give all.
    """
    known = keep(points.select("point_id", F.col("x0").cast("double").alias("x0"), F.col("y0").cast("double").alias("y0")).where("point_id IS NOT NULL AND abs(x0) < double('infinity') AND abs(y0) < double('infinity')"), "points")
    box = known.agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("x0", "y0")]).first()
    here = Window.partitionBy("x0", "y0").orderBy("point_id")
    candidates = keep(known.withColumn("_n", F.row_number().over(here)).where(F.col("_n") <= k).drop("_n"), "candidates")
    pending, found = candidates.select("x0", "y0").distinct(), []
    extent = max(box["max_x0"] - box["min_x0"], box["max_y0"] - box["min_y0"]) if box["n"] else 0.0
    cell = max(extent * (k / max(box["n"], 1)) ** 0.5 / 2, extent * 2**-40) or 1.0
    shift = lambda c, by=0: (F.floor((F.col(c) - F.lit(box[f"min_{c}"] or 0.0)) / cell) + by).alias(f"_{c}")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    while True:
        c = candidates.select(shift("x0"), shift("y0"), F.col("point_id").alias("neighbor_id"), F.col("x0").alias("cx"), F.col("y0").alias("cy"))
        q = pending.select("x0", "y0", F.explode(around).alias("_a")).select("x0", "y0", shift("x0", F.col("_a.i")), shift("y0", F.col("_a.j")))
        d = F.pow(F.col("x0") - F.col("cx"), F.lit(2)) + F.pow(F.col("y0") - F.col("cy"), F.lit(2))
        order = Window.partitionBy("x0", "y0").orderBy("d", "neighbor_id")
        near = q.join(c, ["_x0", "_y0"]).select("x0", "y0", "neighbor_id", d.alias("d")).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
        whole = Window.partitionBy("x0", "y0")
        sure = F.lit(True) if extent < cell else (F.count("*").over(whole) == k) & (F.max("d").over(whole) < cell * cell)
        near = keep(near.withColumn("_sure", sure), "near")
        found.append(near.where("_sure").select("x0", "y0", "neighbor_id", "rank"))
        pending = near.where("NOT _sure").select("x0", "y0").distinct()
        if not pending.head(1):
            break
        cell *= growth
    every = reduce(DataFrame.union, found)
    return known.join(every, ["x0", "y0"]).select("point_id", "neighbor_id", "rank")


def neighbour_offset(tracks: DataFrame, links: DataFrame) -> DataFrame:
    """Mean offset of each point from its neighbours in every frame. One frame's points meet by (video, frame, point), the mesh is broadcast by size."""
    t, m, n = tracks.alias("t"), links.alias("m"), tracks.alias("n")
    own = t.join(m, F.col("t.point_id") == F.col("m.point_id")).select("t.*", "m.neighbor_id").alias("o")
    both = own.join(n, (F.col("o.video_id") == F.col("n.video_id")) & (F.col("o.frame_idx") == F.col("n.frame_idx")) & (F.col("o.neighbor_id") == F.col("n.point_id")))
    return both.groupBy("o.video_id", "o.frame_idx", "o.point_id").agg(F.avg(F.col("o.x") - F.col("n.x")).alias("dx"), F.avg(F.col("o.y") - F.col("n.y")).alias("dy"))


def rest_offset(points: DataFrame, links: DataFrame) -> DataFrame:
    """The same offsets at the home positions."""
    home = points.select(F.lit("home").alias("video_id"), F.lit(0).alias("frame_idx"), "point_id", F.col("x0").alias("x"), F.col("y0").alias("y"))
    return neighbour_offset(home, links).select("point_id", F.col("dx").alias("dx0"), F.col("dy").alias("dy0"))


def mesh_displacement(tracks: DataFrame, points: DataFrame, links: DataFrame) -> DataFrame:
    """How far each point is from where the mesh would have it."""
    return neighbour_offset(tracks, links).join(rest_offset(points, links), "point_id").select(
        "video_id", "frame_idx", "point_id", (F.col("dx") - F.col("dx0")).alias("dx"), (F.col("dy") - F.col("dy0")).alias("dy")
    )


def displacements(tracks: DataFrame, points: DataFrame) -> DataFrame:
    """Traces (video_id, axis, point_id, t, d) from home positions; axis 0 is x."""
    d = tracks.join(points, "point_id")
    return d.select("video_id", "point_id", F.col("frame_idx").alias("t"), F.expr("stack(2, 0, x - x0, 1, y - y0) AS (axis, d)")).select("video_id", "axis", "point_id", "t", "d")


def too_far(tracks: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """(video_id, frame_idx, point_id) of points farther from home than the threshold."""
    d = tracks.join(points, "point_id")
    far = F.sqrt(F.pow(F.col("x") - F.col("x0"), F.lit(2)) + F.pow(F.col("y") - F.col("y0"), F.lit(2))) > threshold
    return d.where(far).select("video_id", "frame_idx", "point_id")


def with_neighbours(violations: DataFrame, links: DataFrame) -> DataFrame:
    """Violations spread to the neighbours of violating points."""
    v = violations.join(links, "point_id").select("video_id", "frame_idx", F.col("neighbor_id").alias("point_id"))
    return v.union(violations.select("video_id", "frame_idx", "point_id")).distinct()


def dilated(violations: DataFrame, before: int, after: int, n_frames: int) -> DataFrame:
    """Frames [i - before, i + after) around every violation i, cut to the video: a few rows each, no window over a video."""
    at = F.explode(F.sequence(F.greatest(F.col("frame_idx") - before, F.lit(0)), F.least(F.col("frame_idx") + after - 1, F.lit(n_frames - 1))))
    return violations.select("video_id", at.alias("frame_idx"), "point_id").distinct()


def violation_fraction(violations: DataFrame, videos: DataFrame) -> DataFrame:
    """Per video the share of frames with any violation, and the number of violations."""
    v = violations.groupBy("video_id").agg(F.countDistinct("frame_idx").alias("bad"), F.count("*").alias("n_violations"))
    return videos.join(v, "video_id", "left").select("video_id", (F.coalesce("bad", F.lit(0)) / F.col("num_frames")).alias("fraction"), F.coalesce("n_violations", F.lit(0)).cast("long").alias("n_violations"))


def cleaned(tracks: DataFrame, points: DataFrame, outliers: DataFrame) -> DataFrame:
    """Frame-to-frame steps with those at outliers set to 0, summed up again from home positions."""
    order = Window.partitionBy("video_id", "point_id").orderBy("frame_idx")
    steps = tracks.select("*", *[(F.col(c) - F.coalesce(F.lag(c).over(order), F.col(c))).alias(f"s{c}") for c in ("x", "y")])
    bad = outliers.select("video_id", "frame_idx", "point_id", F.lit(True).alias("_bad"))
    held = steps.join(bad, ["video_id", "frame_idx", "point_id"], "left")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = lambda c: F.sum(F.when(F.col("_bad"), F.lit(0.0)).otherwise(F.col(c))).over(upto)
    summed = held.select("video_id", "frame_idx", "point_id", total("sx").alias("tx"), total("sy").alias("ty"))
    return summed.join(points, "point_id").select("video_id", "frame_idx", "point_id", (F.col("x0") + F.col("tx")).alias("x"), (F.col("y0") + F.col("ty")).alias("y"))


def relaxed(steps: DataFrame, value: str, rate: float, group: list[str], order: str) -> DataFrame:
    """Leaky integration p_t = (1 - rate) (p_{t-1} + s_t), by segments of a series.

    With a = 1 - rate, a segment by itself is a scaled running sum (its length keeps the
    scale under a million), and what the segments before it add fades by a to the power of
    its length: four of them reach below double precision. Linear in the series.
    """
    a = 1 - rate
    if not 0 < a < 1:
        raise ValueError("the rate must be between 0 and 1")
    length = max(2, int(-6 * math.log(10) / math.log(a)))
    by = [*group, "_g"]
    placed = steps.withColumn("_i", F.row_number().over(Window.partitionBy(*group).orderBy(order)) - 1)
    placed = placed.select(*group, order, F.col(value).alias("_s"), F.floor(F.col("_i") / length).alias("_g"), (F.col("_i") % length).cast("double").alias("_j"))
    fade = F.pow(F.lit(a), F.col("_j") + 1)
    own = placed.withColumn("_own", fade * F.sum(F.col("_s") / F.pow(F.lit(a), F.col("_j"))).over(Window.partitionBy(*by).orderBy("_j")))
    ends = own.groupBy(*by).agg(F.max_by("_own", "_j").alias("_end"))
    before = Window.partitionBy(*group).orderBy("_g")
    carried = sum((F.coalesce(F.lag("_end", k).over(before), F.lit(0.0)) * a ** ((k - 1) * length) for k in range(2, 5)), F.coalesce(F.lag("_end").over(before), F.lit(0.0)))
    return own.join(ends.select(*by, carried.alias("_carried")), by).select(*group, order, (F.col("_own") + fade * F.col("_carried")).alias("p"))


def frame_rate(videos: DataFrame, clamp: float | None = None) -> DataFrame:
    """Total frames, median frame rate (or the clamp), and whether rates differ by over a tenth of their mean."""
    spread = (F.max("frame_rate") - F.min("frame_rate")) / F.avg("frame_rate") > 0.1
    return videos.agg(
        F.count("*").alias("n_videos"), F.sum("num_frames").alias("total_frames"), F.coalesce(F.lit(clamp).cast("double"), F.median("frame_rate")).alias("frame_rate"), spread.alias("uneven")
    )


def global_frames(videos: DataFrame) -> DataFrame:
    """First frame of each video in the joined sequence (videos by id); one row per video."""
    order = Window.orderBy("video_id").rowsBetween(Window.unboundedPreceding, -1)
    return videos.select("video_id", "num_frames", F.coalesce(F.sum("num_frames").over(order), F.lit(0)).cast("long").alias("first_frame"))


def frame_range(tracks: DataFrame, video: str, start: int, stop: int, step: int = 1) -> DataFrame:
    """Rows of one video's frames start, start + step, ... under stop; both filters reach the scan of stored tracks."""
    f = F.col("frame_idx")
    return tracks.where((F.col("video_id") == video) & (f >= start) & (f < stop) & ((f - start) % step == 0))


def global_range(tracks: DataFrame, videos: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows of the joined sequence's frames [start, stop)."""
    at = tracks.join(global_frames(videos), "video_id").withColumn("frame", F.col("first_frame") + F.col("frame_idx"))
    return at.where((F.col("frame") >= start) & (F.col("frame") < stop)).select("frame", "video_id", "frame_idx", "point_id", "x", "y")


def slots(videos: DataFrame, size: int) -> DataFrame:
    """The buffer table: (video_id, slot, start_frame, end_frame, start_global)."""
    v = global_frames(videos).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("num_frames") - 1) / size))))
    start = F.col("slot") * size
    return v.select("video_id", "slot", start.alias("start_frame"), F.least(start + size, F.col("num_frames")).alias("end_frame"), (F.col("first_frame") + start).alias("start_global"))


def batches(df: DataFrame, order: Column, size: int, least: int = 1) -> DataFrame:
    """batch_id of each row in order; a last batch of fewer than ``least`` rows is dropped.

    The order is found by ranges: each range is numbered by itself and shifted by the
    rows before it, so no task sees all rows.
    """
    spark = df.sparkSession
    dealt = keep(df.withColumn("_o", order).repartitionByRange("_o").sortWithinPartitions("_o").withColumn("_m", F.monotonically_increasing_id()), "batches")
    shift = F.shiftright(F.col("_m"), 33)
    sizes = {r["p"]: r["count"] for r in dealt.groupBy(shift.alias("p")).count().collect()}  # a row for each range
    first, total = {}, 0
    for p in sorted(sizes):
        first[p] = total
        total += sizes[p]
    starts = spark.createDataFrame(list(first.items()) or [(0, 0)], "p long, start long")
    at = dealt.join(F.broadcast(starts), shift == F.col("p")).withColumn("_i", F.col("start") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    full = total if total % size >= least or total % size == 0 else total - total % size
    return at.where(F.col("_i") < full).withColumn("batch_id", F.floor(F.col("_i") / size)).drop("_o", "_m", "_i", "p", "start")
