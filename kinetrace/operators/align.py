"""Aligning factors to events, and images and points to each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Ranges of time that samples and events are dealt into.
_RANGES = 4096


def nearest_bins(events: DataFrame, axis: DataFrame, least: float = 800.0) -> DataFrame:
    """(event_id, t_ds), with the events' other columns: for events that are a number above ``least``, the bin whose sample is nearest, the first on ties.

    Time is cut into equal ranges. Samples are ordered within their range, and the ranges'
    ends follow from one bounded table, so every gap between neighbouring samples is known
    without ordering all; it is dealt to the ranges that it touches, where events meet it.
    Work is in proportion to samples and events, in tasks by range.
    """
    others = [c for c in events.columns if c not in ("event_id", "at")]
    e = events.where(~F.isnan("at") & (F.col("at") > least)).select("event_id", *others, F.col("at").alias("x"))
    samples = axis.groupBy(F.col("sample").cast("double").alias("x")).agg(F.min(F.col("t_ds").cast("long")).alias("first"), F.max(F.col("t_ds").cast("long")).alias("last"))
    low, high = samples.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return e.select("event_id", *others, F.lit(None).cast("long").alias("t_ds"))
    step = (high - low) / _RANGES or 1.0
    at = lambda x: F.greatest(F.lit(0), F.least(F.lit(_RANGES - 1), F.floor((x - low) / step))).cast("int")
    dealt = samples.withColumn("range", at(F.col("x")))
    heads = dealt.groupBy("range").agg(F.min(F.struct("x", "first")).alias("head"))  # a row for each range
    behind = heads.select("range", F.lead("head").over(Window.orderBy("range")).alias("behind"))
    inner = dealt.withColumn("next", F.lead(F.struct("x", "first")).over(Window.partitionBy("range").orderBy("x")))
    known = inner.join(behind, "range").select("x", "last", F.coalesce("next", "behind").alias("hi"))
    gaps = known.select(F.struct("x", "last").alias("lo"), "hi").union(samples.where(F.col("x") == low).select(F.lit(None).cast("struct<x: double, last: bigint>"), F.struct("x", "first")))
    ends = F.coalesce(at(F.col("lo.x")), F.lit(0)), F.coalesce(at(F.col("hi.x")), F.lit(_RANGES - 1))
    touched = gaps.select("lo", "hi", F.explode(F.sequence(*ends)).alias("range"))
    inside = (F.col("lo").isNull() | (F.col("x") >= F.col("lo.x"))) & (F.col("hi").isNull() | (F.col("x") < F.col("hi.x")))
    near = F.when(F.col("hi").isNull() | (F.col("x") - F.col("lo.x") <= F.col("hi.x") - F.col("x")), F.col("lo.last")).otherwise(F.col("hi.first"))
    return e.withColumn("range", at(F.col("x"))).join(touched, "range").where(inside).select("event_id", *others, near.alias("t_ds"))


def around_events(factor: DataFrame, bins: DataFrame, before: int, after: int, by: tuple[str, ...] = (), events: tuple[str, ...] = ()) -> DataFrame:
    """(event_id, r, rel, value), with the keys ``by`` of the factor and ``events`` of the bins: the factor (idx, r, value) at [t - before, t + after) around each event's bin.

    What stands around a bin is put together once for each bin; events only join it.
    """
    mids = bins.select(F.col("t_ds").alias("mid")).distinct()
    at = mids.select("mid", F.explode(F.sequence(F.col("mid") - before, F.col("mid") + after - 1)).alias("idx"))
    around = at.join(factor, "idx").select("mid", *by, "r", (F.col("idx") - F.col("mid")).alias("rel"), "value")
    return bins.select("event_id", *events, F.col("t_ds").alias("mid")).join(around, "mid").select("event_id", *events, *by, "r", "rel", "value")


def scaled_factor(factor: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Absolute values over each component's population deviation; each ``by`` for itself."""
    s = factor.groupBy(*by, "r").agg(F.stddev_pop(F.abs("value")).alias("s"))
    return factor.join(s, [*by, "r"]).select(*by, "idx", "r", (F.abs("value") / F.nullif("s", F.lit(0.0))).alias("value"))


def peri_event(traces: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean and population deviation over events at each relative index; each ``by`` for itself."""
    return traces.groupBy(*by, "r", "rel").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("n"))


def interpolated(samples: DataFrame, grid: DataFrame) -> DataFrame:
    """Linear interpolation of (key, x, value) at the grid's whole x; NaN outside of the samples.

    Each pair of neighbouring samples gives the grid positions between them.
    """
    order = Window.partitionBy("key").orderBy("x")
    pair = samples.select("key", "x", "value", F.lead("x").over(order).alias("x2"), F.lead("value").over(order).alias("v2"))
    last = F.col("x2").isNull()
    end = F.when(last, F.floor("x")).otherwise(F.ceil("x2") - 1)
    between = pair.where(F.ceil("x") <= end).select("*", F.explode(F.sequence(F.ceil("x"), end)).alias("g"))
    w = (F.col("g") - F.col("x")) / (F.col("x2") - F.col("x"))
    value = F.when(last, F.col("value")).otherwise(F.col("value") + (F.col("v2") - F.col("value")) * w)
    wanted = samples.select("key").distinct().join(grid.select(F.col("x").alias("g")), F.lit(True))
    return wanted.join(between.select("key", "g", value.alias("value")), ["key", "g"], "left").select("key", F.col("g").alias("x"), F.coalesce("value", F.lit(float("nan"))).alias("value"))


# images and warps: an image is (y, x, value), a remap (y, x, src_x, src_y)


def warp_remap(spark: SparkSession, m: list[list[float]], height: int, width: int) -> DataFrame:
    """Where each pixel comes from under an affine (2 x 3) or projective (3 x 3) matrix."""
    return warped(spark.range(height * width).select(F.floor(F.col("id") / width).alias("y"), (F.col("id") % width).alias("x")), m)


def warped(pixels: DataFrame, m: list[list[float]]) -> DataFrame:
    """The same for the pixels (y, x) of an image."""
    row = lambda r: r[0] * F.col("x") + r[1] * F.col("y") + r[2]
    z = row(m[2]) if len(m) == 3 else F.lit(1.0)
    return pixels.select("y", "x", (row(m[0]) / z).alias("src_x"), (row(m[1]) / z).alias("src_y"))


def inverted(m: list[list[float]]) -> list[list[float]]:
    """The inverse of a warp matrix, of the same shape."""
    full = np.vstack([m, [0, 0, 1]]) if len(m) == 2 else np.array(m, float)
    return np.linalg.inv(full)[: len(m)].tolist()


def inverted_columns(table: DataFrame) -> DataFrame:
    """Closed-form inverses of a table of affine matrices (id, a, b, c, d, e, f)."""
    a, b, c, d, e, f = (F.col(x) for x in "abcdef")
    det = a * e - b * d
    return table.select("id", (e / det).alias("a"), (-b / det).alias("b"), ((b * f - c * e) / det).alias("c"), (-d / det).alias("d"), (a / det).alias("e"), ((c * d - a * f) / det).alias("f"))


def composed(ab: list[list[float]], bc: list[list[float]]) -> list[list[float]]:
    """The matrix that first does ``bc``; affine if both are."""
    full = [np.vstack([m, [0, 0, 1]]) if len(m) == 2 else np.array(m, float) for m in (ab, bc)]
    out = full[0] @ full[1]
    return out[:2].tolist() if np.allclose(out[2], [0, 0, 1]) else out.tolist()


def composed_tables(ab: DataFrame, bc: DataFrame) -> DataFrame:
    """Products of matrices given as cells (id, i, j, value), by id."""
    a, b = ab.alias("a"), bc.alias("b")
    pairs = a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.j") == F.col("b.i")))
    return pairs.groupBy(F.col("a.id").alias("id"), F.col("a.i").alias("i"), F.col("b.j").alias("j")).agg(F.sum(F.col("a.value") * F.col("b.value")).alias("value"))


def flow_to_remap(flow: DataFrame) -> DataFrame:
    """(y, x, dx, dy) to (y, x, src_x, src_y)."""
    return flow.select("y", "x", (F.col("dx") + F.col("x")).alias("src_x"), (F.col("dy") + F.col("y")).alias("src_y"))


def remap_to_flow(remap: DataFrame) -> DataFrame:
    return remap.select("y", "x", (F.col("src_x") - F.col("x")).alias("dx"), (F.col("src_y") - F.col("y")).alias("dy"))


def remap_to_unit(remap: DataFrame, height: int, width: int) -> DataFrame:
    """Sources in -1..1 of the image's extent."""
    return remap.select("y", "x", ((F.col("src_x") / (width - 1) - 0.5) * 2).alias("u"), ((F.col("src_y") / (height - 1) - 0.5) * 2).alias("v"))


def _corners(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """Each row once for each of the four pixels around (x, y), with its weight."""
    fx, fy = x - F.floor(x), y - F.floor(y)
    corner = lambda i, j: F.struct((F.floor(y) + j).alias("cy"), (F.floor(x) + i).alias("cx"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w"))
    return df.select("*", F.explode(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)])).alias("_c"))


#: Pixels on each side that a method reads.
_REACH = {"linear": 1, "cubic": 2, "lanczos": 4}
#: The cubic kernel's free parameter, as image libraries have it.
_CUBIC = -0.75


def _kernel(d: Column, method: str) -> Column:
    """The weight of cubic or lanczos at a distance."""
    d = F.abs(d)
    if method == "cubic":
        far = _CUBIC * (d * d * d - 5 * d * d + 8 * d - 4)
        return F.when(d <= 1, (_CUBIC + 2) * d * d * d - (_CUBIC + 3) * d * d + 1).when(d < 2, far).otherwise(0.0)
    sinc = lambda x: F.sin(np.pi * x) / (np.pi * x)
    return F.when(d < 1e-9, 1.0).when(d < 4, sinc(d) * sinc(d / 4)).otherwise(0.0)


def _bordered(at: Column, n: int | None, border: str) -> Column:
    """The pixel that stands for ``at`` on an axis of ``n`` pixels."""
    if border == "constant":
        return at
    if border == "replicate":
        return F.least(F.greatest(at, F.lit(0)), F.lit(n - 1))
    if border == "wrap":
        return F.pmod(at, F.lit(n))
    if border == "reflect":
        m = F.pmod(at, F.lit(2 * n))
        return F.when(m < n, m).otherwise(2 * n - 1 - m)
    raise ValueError("border is constant, replicate, reflect or wrap")


def remapped(image: DataFrame, remap: DataFrame, fill: float = 0.0, method: str = "linear", border: str = "constant", shape: tuple[int, int] | None = None) -> DataFrame:
    """The image sampled at each pixel's source: nearest, linear, cubic or lanczos (eight pixels wide).

    Outside there is ``fill``, or with another border the pixels of an image of ``shape``
    (height, width): the last one again, mirrored with it, or from the other end.
    """
    height, width = shape or (None, None)
    if border != "constant" and shape is None:
        raise ValueError("this border needs the image's shape")
    i = image.select(F.col("y").alias("iy"), F.col("x").alias("ix"), F.col("value").alias("iv"))
    if method == "nearest":
        cy, cx = _bordered(F.bround("src_y").cast("long"), height, border), _bordered(F.bround("src_x").cast("long"), width, border)
        r = remap.select("y", "x", cy.alias("cy"), cx.alias("cx"))
        return r.join(i, (F.col("cy") == F.col("iy")) & (F.col("cx") == F.col("ix")), "left").select("y", "x", F.coalesce("iv", F.lit(fill)).alias("value"))
    if method not in _REACH:
        raise ValueError("method is nearest, linear, cubic or lanczos")
    reach = range(1 - _REACH[method], _REACH[method] + 1)

    def axis(source: str, n: int | None) -> Column:
        at = F.floor(source)
        part = F.col(source) - at
        weights = [1 - part, part] if method == "linear" else [_kernel(part - k, method) for k in reach]
        if method == "lanczos":
            total = sum(weights, F.lit(0.0))
            weights = [w / total for w in weights]
        return F.array(*[F.struct(_bordered(at + k, n, border).alias("at"), w.alias("w")) for k, w in zip(reach, weights, strict=True)])

    rows = remap.select("y", "x", axis("src_x", width).alias("_h"), F.explode(axis("src_y", height)).alias("_v")).select("y", "x", "_v", F.explode("_h").alias("_h"))
    hit = rows.join(i, (F.col("_v.at") == F.col("iy")) & (F.col("_h.at") == F.col("ix")), "left")
    return hit.groupBy("y", "x").agg(F.sum(F.col("_v.w") * F.col("_h.w") * F.coalesce("iv", F.lit(fill))).alias("value"))


def composed_remaps(ab: DataFrame, bc: DataFrame) -> DataFrame:
    """The remap that first applies ``bc``: ``ab`` sampled at bc's sources; pixels from outside are left out."""
    a = ab.select(F.col("y").alias("ay"), F.col("x").alias("ax"), F.col("src_x").alias("sx"), F.col("src_y").alias("sy"))
    c = _corners(bc.select("y", "x", F.col("src_x").alias("bx"), F.col("src_y").alias("by")), F.col("bx"), F.col("by")).where("_c.w > 0")
    hit = c.join(a, (F.col("_c.cy") == F.col("ay")) & (F.col("_c.cx") == F.col("ax")), "left")
    sums = hit.groupBy("y", "x").agg(F.sum(F.col("_c.w") * F.col("sx")).alias("src_x"), F.sum(F.col("_c.w") * F.col("sy")).alias("src_y"), F.count("sx").alias("n"), F.count("*").alias("all"))
    return sums.where("n = all").select("y", "x", "src_x", "src_y")


def remapped_points(points: DataFrame, remap: DataFrame, height: int, width: int) -> DataFrame:
    """Points moved by a remap, read bilinearly at each point and cut to the image."""
    r = remap.select(F.col("y").alias("ry"), F.col("x").alias("rx"), "src_x", "src_y")
    inside = points.select("point_id", F.least(F.greatest("x0", F.lit(0.0)), F.lit(width - 1.0)).alias("px"), F.least(F.greatest("y0", F.lit(0.0)), F.lit(height - 1.0)).alias("py"))
    c = _corners(inside, F.col("px"), F.col("py")).where("_c.w > 0")
    hit = c.join(r, (F.col("_c.cy") == F.col("ry")) & (F.col("_c.cx") == F.col("rx")))
    at = hit.groupBy("point_id").agg(F.sum(F.col("_c.w") * F.col("src_x")).alias("x"), F.sum(F.col("_c.w") * F.col("src_y")).alias("y"))
    return at.select("point_id", F.least(F.greatest("x", F.lit(0.0)), F.lit(width - 1.0)).alias("x"), F.least(F.greatest("y", F.lit(0.0)), F.lit(height - 1.0)).alias("y"))


def inverted_remap(remap: DataFrame) -> DataFrame:
    """For each pixel the mean place of the pixels that came from it (a gather by rounding; holes stay out)."""
    at = remap.groupBy(F.bround("src_y").cast("long").alias("y2"), F.bround("src_x").cast("long").alias("x2")).agg(F.avg("x").alias("src_x"), F.avg("y").alias("src_y"))
    return at.select(F.col("y2").alias("y"), F.col("x2").alias("x"), "src_x", "src_y")


def interpolated_inverse(remap: DataFrame) -> DataFrame:
    """The inverse of a remap (y, x, src_y, src_x) at every pixel inside what it covers, without holes.

    Four neighbouring pixels are two triangles in the source, which are filled with the
    pixels in them: each gets its place by barycentric weights. Cells that lack a pixel
    are left out, a pixel in several triangles (on an edge, or in a fold) takes the first
    by the cell's row, column and half. A triangle without area has no pixels.
    """
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    part = remap.select("y", "x", "src_y", "src_x", F.explode(corners).alias("_c"))
    at = part.select((F.col("y") - F.col("_c.i")).alias("cy"), (F.col("x") - F.col("_c.j")).alias("cx"), F.col("_c.i").alias("i"), F.col("_c.j").alias("j"), "src_y", "src_x")
    one = lambda i, j, c: F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col(c))).alias(f"{c[-1]}{i}{j}")
    cells = at.groupBy("cy", "cx").agg(*[one(i, j, c) for i in (0, 1) for j in (0, 1) for c in ("src_y", "src_x")], F.count("*").alias("n")).where("n = 4")
    corner = lambda i, j: F.struct(F.lit(float(i)).alias("i"), F.lit(float(j)).alias("j"), F.col(f"y{i}{j}").alias("y"), F.col(f"x{i}{j}").alias("x"))
    half = lambda h, *at: F.struct(F.lit(h).alias("h"), *[corner(*ij).alias(n) for n, ij in zip("pqr", at, strict=True)])
    halves = cells.select("cy", "cx", F.explode(F.array(half(0, (0, 0), (0, 1), (1, 0)), half(1, (1, 1), (1, 0), (0, 1)))).alias("t"))
    ends = lambda c, f: f(*[F.col(f"t.{n}.{c}") for n in "pqr"])
    span = lambda c: F.sequence(F.ceil(ends(c, F.least)), F.floor(ends(c, F.greatest)))
    wide = F.ceil(ends("y", F.least)) <= F.floor(ends("y", F.greatest))
    high = F.ceil(ends("x", F.least)) <= F.floor(ends("x", F.greatest))
    filled = halves.where(wide & high).select("cy", "cx", "t", F.explode(span("y")).alias("y")).select("cy", "cx", "t", "y", F.explode(span("x")).alias("x"))
    d = lambda a, b, c: F.col(f"t.{a}.{c}") - F.col(f"t.{b}.{c}")
    area = d("q", "p", "x") * d("r", "p", "y") - d("r", "p", "x") * d("q", "p", "y")
    px, py = F.col("x") - F.col("t.p.x"), F.col("y") - F.col("t.p.y")
    weighed = filled.withColumn("_area", area).where("_area <> 0").select("*", ((px * d("r", "p", "y") - d("r", "p", "x") * py) / F.col("_area")).alias("u"), ((d("q", "p", "x") * py - px * d("q", "p", "y")) / F.col("_area")).alias("v"))
    inside = weighed.where("u >= -1e-9 AND v >= -1e-9 AND u + v <= 1 + 1e-9")
    place = lambda c, k: F.col(c) + F.col(f"t.p.{k}") + F.col("u") * d("q", "p", k) + F.col("v") * d("r", "p", k)
    first = F.min(F.struct("cy", "cx", F.col("t.h").alias("h"), place("cx", "j").alias("sx"), place("cy", "i").alias("sy"))).alias("m")
    return inside.groupBy("y", "x").agg(first).select("y", "x", F.col("m.sx").alias("src_x"), F.col("m.sy").alias("src_y"))


def blended(image: DataFrame, tile: int, bins: int = 64, clip: float = 4.0, scale: float = 1.0) -> DataFrame:
    """Histogram equalisation whose tables change smoothly: a pixel's value is blended from the tables of its four nearest tiles.

    Tables are those of :func:`equalised`, for all bins; weights go by the distance to the tiles'
    centres, and beyond the outer centres the nearest tiles count alone.
    """
    at = _binned(image, tile, bins)
    counts = at.groupBy("ty", "tx", "bin").count()
    tiles = at.groupBy("ty", "tx").agg(F.count("*").alias("n"))
    every = tiles.select("ty", "tx", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    table = _tables(every.join(counts, ["ty", "tx", "bin"], "left").select("ty", "tx", "bin", "n", F.coalesce("count", F.lit(0)).alias("count")), bins, clip, scale)
    last = tiles.agg(F.max("ty").alias("_ly"), F.max("tx").alias("_lx"))
    place = lambda c, n: F.least(F.greatest((F.col(c) + 0.5) / tile - 0.5, F.lit(0.0)), F.col(n).cast("double"))
    placed = at.join(last, F.lit(True)).select("y", "x", "bin", place("y", "_ly").alias("fy"), place("x", "_lx").alias("fx"))
    four = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    part = lambda c, k: F.when(F.col(f"_c.{k}") == 1, F.col(c) - F.floor(c)).otherwise(1 - F.col(c) + F.floor(c))
    near = placed.withColumn("_c", F.explode(four)).select("y", "x", "bin", (F.floor("fy") + F.col("_c.i")).alias("ty"), (F.floor("fx") + F.col("_c.j")).alias("tx"), (part("fy", "i") * part("fx", "j")).alias("w"))
    return near.where("w > 0").join(table, ["ty", "tx", "bin"]).groupBy("y", "x").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def _binned(image: DataFrame, tile: int, bins: int) -> DataFrame:
    """(y, x, ty, tx, bin): each pixel's tile and its level among ``bins``."""
    span = image.agg(F.min("value").alias("a"), F.max("value").alias("b"))
    level = F.least(F.floor((F.col("value") - F.col("a")) / F.nullif(F.col("b") - F.col("a"), F.lit(0.0)) * bins), F.lit(bins - 1))
    return image.join(span, F.lit(True)).select("y", "x", F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx"), F.coalesce(level, F.lit(0)).alias("bin"))


def _tables(counts: DataFrame, bins: int, clip: float, scale: float) -> DataFrame:
    """(ty, tx, bin, value) from (ty, tx, bin, n, count): the running share of clipped counts."""
    whole = Window.partitionBy("ty", "tx")
    cut = counts.withColumn("c", F.least(F.col("count").cast("double"), clip * F.col("n") / bins))
    even = cut.withColumn("spare", (F.col("n") - F.sum("c").over(whole)) / bins)
    share = (F.sum("c").over(whole.orderBy("bin")) + F.col("spare") * (F.col("bin") + 1)) / F.col("n")
    return even.select("ty", "tx", "bin", (share * scale).alias("value"))


def equalised(image: DataFrame, tile: int, bins: int = 64, clip: float = 4.0, scale: float = 1.0) -> DataFrame:
    """Histogram equalisation in tiles: counts over ``clip`` times the mean are cut and spread evenly."""
    at = _binned(image, tile, bins)
    counts = at.groupBy("ty", "tx", "bin").count()
    known = counts.withColumn("n", F.sum("count").over(Window.partitionBy("ty", "tx")))
    return at.join(_tables(known, bins, clip, scale), ["ty", "tx", "bin"]).select("y", "x", "value")


def rigid_motion(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares rotation, scale and shift of points (x0, y0) to (x, y) per key, from sums alone."""
    mean = pairs.groupBy(*keys).agg(*[F.avg(c).alias(f"m{c}") for c in ("x0", "y0", "x", "y")])
    d = pairs.join(mean, keys)
    u, v, p, q = (F.col(c) - F.col(f"m{c}") for c in ("x0", "y0", "x", "y"))
    s = d.groupBy(*keys, "mx0", "my0", "mx", "my").agg(F.sum(u * p + v * q).alias("s"), F.sum(u * q - v * p).alias("c"), F.sum(u * u + v * v).alias("n"))
    a, b = F.col("s") / F.nullif("n", F.lit(0.0)), F.col("c") / F.nullif("n", F.lit(0.0))
    return s.select(*keys, F.hypot(a, b).alias("scale"), F.atan2(b, a).alias("angle"), (F.col("mx") - a * F.col("mx0") + b * F.col("my0")).alias("dx"), (F.col("my") - b * F.col("mx0") - a * F.col("my0")).alias("dy"))


#: Multipliers and modulus of the seeded draws, which any engine can repeat.
DRAW = (7919, 104729, 15485863, 1000003)


def drawn(trial: Column, point: Column, which: int, seed: int) -> Column:
    """A number that orders the points of a trial at random; ``which`` of its two draws."""
    a, b, c, m = DRAW
    x = ((point + 1) * a + (trial + 1) * b + (which + 1) * c + seed) % m
    return (x * x + x * (trial + 3)) % m


def robust_motion(pairs: DataFrame, keys: list[str], tolerance: float, trials: int = 16, seed: int = 0) -> DataFrame:
    """Rotation, scale and shift of points (point_id, x0, y0) to (x, y) per key, without those that move otherwise (RANSAC).

    Each trial draws two points (the least of two seeded orders), which fix a motion; the
    points that it takes to within ``tolerance`` of where they are vote for it. The trial with
    most votes, the first of them, is refitted to its voters by least squares. Two equal
    draws, or two points at one place, are no trial; a key without a trial has no row.
    """
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trials - 1).cast("long"))).alias("trial")
    known = pairs.select(*keys, F.col("point_id").cast("long").alias("point_id"), "x0", "y0", "x", "y").dropna()
    pick = lambda which: F.min(F.struct(drawn(F.col("trial"), F.col("point_id"), which, seed).alias("r"), "point_id", "x0", "y0", "x", "y")).alias(f"p{which}")
    two = known.select("*", numbers).groupBy(*keys, "trial").agg(pick(0), pick(1))
    u, v = (F.col(f"p1.{c}0") - F.col(f"p0.{c}0") for c in ("x", "y"))
    p, q = (F.col(f"p1.{c}") - F.col(f"p0.{c}") for c in ("x", "y"))
    n = u * u + v * v
    motion = two.where(n > 0).select(*keys, "trial", ((u * p + v * q) / n).alias("a"), ((u * q - v * p) / n).alias("b"), F.col("p0.x0").alias("ox"), F.col("p0.y0").alias("oy"), F.col("p0.x").alias("tx"), F.col("p0.y").alias("ty"))
    moved = known.join(motion, keys)
    dx, dy = F.col("x0") - F.col("ox"), F.col("y0") - F.col("oy")
    ex, ey = F.col("tx") + F.col("a") * dx - F.col("b") * dy - F.col("x"), F.col("ty") + F.col("b") * dx + F.col("a") * dy - F.col("y")
    voters = moved.where(ex * ex + ey * ey <= tolerance * tolerance)
    best = voters.groupBy(*keys, "trial").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max(F.struct("n", (-F.col("trial")).alias("t"))).alias("m"))
    chosen = voters.join(best.select(*keys, (-F.col("m.t")).alias("trial"), F.col("m.n").alias("n_inliers")), [*keys, "trial"])
    fitted = rigid_motion(chosen.select(*keys, "n_inliers", "x0", "y0", "x", "y"), [*keys, "n_inliers"])
    return fitted


# registration: one image per row, numpy inside


def blurred(a: np.ndarray, size: int) -> np.ndarray:
    """Gaussian blur; an even size becomes the next odd one."""
    size = size + 1 - size % 2
    if size <= 1:
        return a
    k = np.exp(-0.5 * ((np.arange(size) - size // 2) / max(size / 6, 0.3)) ** 2)
    k /= k.sum()
    pad = size // 2
    for axis in (0, 1):
        wide = np.pad(a, [(pad, pad) if i == axis else (0, 0) for i in (0, 1)], mode="edge")
        a = np.tensordot(np.lib.stride_tricks.sliding_window_view(wide, size, axis=axis), k, axes=([-1], [0]))
    return a


def framed(a: np.ndarray, fill: float = 0.0) -> np.ndarray:
    """An array with a border of ``fill``, on which every sample outside falls."""
    wide = np.full((a.shape[0] + 2, a.shape[1] + 2), fill, float)
    wide[1:-1, 1:-1] = a
    return wide


def _sides(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """[2, ...]: both neighbours of each place on an axis of ``n`` in a framed array, and their weights."""
    low = np.floor(x)
    at = low.astype(int) + np.array([1, 2]).reshape(2, *[1] * x.ndim)
    weights = np.empty(at.shape)
    np.add(1 - x, low, out=weights[0])
    np.subtract(x, low, out=weights[1])
    return np.minimum(np.maximum(at, 0), n + 1), weights


def sampled_framed(arrays: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Bilinear samples of framed arrays of one shape at the same places, which are found once for all; x and y of as many axes broadcast."""
    h, w = arrays[0].shape
    (cx, wx), (cy, wy) = _sides(x, w - 2), _sides(y, h - 2)
    at, wx, wy = (cy * w)[None] + cx[:, None], wx[:, None], wy[None]
    out = []
    for a in arrays:
        part = a.ravel().take(at)
        part *= wx
        part *= wy
        out.append(part[0, 0] + part[0, 1] + part[1, 0] + part[1, 1])
    return out


def sampled_together(arrays: list[np.ndarray], x: np.ndarray, y: np.ndarray, fill: float = 0.0) -> list[np.ndarray]:
    """Bilinear samples of arrays of one shape at the same places."""
    if x.ndim != y.ndim:
        x, y = np.broadcast_arrays(x, y)
    return sampled_framed([framed(a, fill) for a in arrays], x, y)


def sampled(a: np.ndarray, x: np.ndarray, y: np.ndarray, fill: float = 0.0) -> np.ndarray:
    """Bilinear samples of an array."""
    return sampled_together([a], x, y, fill)[0]


#: Free parameters of each kind of motion, as derivatives of (x, y) for every pixel.
MOTIONS = ("translation", "euclidean", "affine", "homography")


def enhanced_correlation(template: np.ndarray, image: np.ndarray, motion: str = "affine", blur: int = 5, iterations: int = 100, tolerance: float = 1e-6) -> np.ndarray:
    """The warp (2 x 3, or 3 x 3) from template to image coordinates with the greatest correlation (forward additive ECC)."""
    if motion not in MOTIONS:
        raise ValueError(f"motion is one of {MOTIONS}")
    t, im = blurred(template.astype(float), blur), blurred(image.astype(float), blur)
    gy, gx = np.gradient(im)
    y, x = np.mgrid[: t.shape[0], : t.shape[1]].astype(float)
    m = np.eye(3)
    last = -2.0
    for _ in range(iterations):
        d = m[2, 0] * x + m[2, 1] * y + m[2, 2]
        u, v = (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / d, (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / d
        inside = (u >= 0) & (u <= im.shape[1] - 1) & (v >= 0) & (v <= im.shape[0] - 1)
        if inside.sum() < 16:
            break
        w, a, b = (q[inside] for q in sampled_together([im, gx, gy], u, v))
        xi, yi, di, ui, vi = x[inside], y[inside], d[inside], u[inside], v[inside]
        if motion == "translation":
            jac = np.stack([a, b])
        elif motion == "euclidean":
            jac = np.stack([a * (-m[1, 0] * xi - m[0, 0] * yi) + b * (m[0, 0] * xi - m[1, 0] * yi), a, b])
        elif motion == "affine":
            jac = np.stack([a * xi, a * yi, a, b * xi, b * yi, b])
        else:
            e = -(ui * a + vi * b)
            jac = np.stack([a * xi, a * yi, a, b * xi, b * yi, b, e * xi, e * yi]) / di
        w = w - w.mean()
        r = t[inside] - t[inside].mean()
        rho = float(r @ w / (np.linalg.norm(r) * np.linalg.norm(w) + 1e-12))
        h = jac @ jac.T + 1e-9 * np.eye(len(jac))
        pw, pr = jac @ w, jac @ r
        hw = np.linalg.solve(h, pw)
        under = r @ w - pr @ hw
        lam = (w @ w - pw @ hw) / under if under > 0 else np.sqrt(max((w @ w - pw @ hw) / max(r @ r - pr @ np.linalg.solve(h, pr), 1e-12), 0))
        step = np.linalg.solve(h, jac @ (lam * r - w))
        if motion == "translation":
            m[0, 2] += step[0]
            m[1, 2] += step[1]
        elif motion == "euclidean":
            angle = np.arctan2(m[1, 0], m[0, 0]) + step[0]
            m[:2, :2] = [[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]]
            m[:2, 2] += step[1:]
        elif motion == "affine":
            m[:2] += step.reshape(2, 3)
        else:
            m[0] += step[:3]
            m[1] += step[3:6]
            m[2, :2] += step[6:]
        if abs(rho - last) < tolerance:
            break
        last = rho
    return m if motion == "homography" else m[:2]


def safe_registration(template: np.ndarray, image: np.ndarray, motion: str, blur: int, tries: int = 10) -> np.ndarray:
    """Registration with growing blur while it fails; the identity if it never succeeds."""
    for i in range(tries):
        try:
            m = enhanced_correlation(template, image, motion, blur + 4 * i)
            if np.isfinite(m).all():
                return m
        except np.linalg.LinAlgError:
            continue
    return np.eye(3)[: 3 if motion == "homography" else 2]


def dense_flow(template: np.ndarray, image: np.ndarray, blur: int = 9, window: int = 9, rounds: int = 20) -> np.ndarray:
    """Dense Lucas-Kanade flow [2, H, W] from template to image coordinates, smoothed after every round."""
    t, im = blurred(template.astype(float), blur), blurred(image.astype(float), blur)
    y, x = np.mgrid[: t.shape[0], : t.shape[1]].astype(float)
    u, v = np.zeros_like(t), np.zeros_like(t)
    for _ in range(rounds):
        w = sampled(im, np.clip(x + u, 0, t.shape[1] - 1), np.clip(y + v, 0, t.shape[0] - 1))
        gy, gx = np.gradient(w)
        e = t - w
        xx, xy, yy, xe, ye = (blurred(q, window) for q in (gx * gx, gx * gy, gy * gy, gx * e, gy * e))
        det = xx * yy - xy * xy + 1e-3 * (xx + yy + 1e-6) ** 2 + 1e-9
        u, v = blurred(u + np.clip((yy * xe - xy * ye) / det, -1, 1), window), blurred(v + np.clip((xx * ye - xy * xe) / det, -1, 1), window)
    return np.stack([u, v])


def polynomials(a: np.ndarray, radius: int, sigma: float) -> np.ndarray:
    """[5, H, W]: for the neighbourhood of each pixel the coefficients of x, y, x^2, y^2 and xy of the quadratic that fits it best.

    Neighbours weigh by a Gaussian; the six moments are separable sums, and one 6 x 6 matrix
    turns them into coefficients at every pixel.
    """
    at = np.arange(-radius, radius + 1)
    g = np.exp(-(at**2) / (2 * sigma**2))
    g /= g.sum()
    padded = np.pad(a, radius, mode="edge")
    view = np.lib.stride_tricks.sliding_window_view
    down = [view(padded, 2 * radius + 1, 0) @ (g * at**k) for k in range(3)]
    moment = lambda i, j: view(down[j], 2 * radius + 1, 1) @ (g * at**i)
    powers = [(0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1)]
    sums = [float((g * at**k).sum()) for k in range(5)]
    gram = np.array([[sums[i + p] * sums[j + q] for p, q in powers] for i, j in powers])
    return np.tensordot(np.linalg.inv(gram), np.stack([moment(i, j) for i, j in powers]), 1)[1:]


def polynomial_flow(template: np.ndarray, image: np.ndarray, radius: int = 3, sigma: float = 1.2, window: int = 15, levels: int = 3, rounds: int = 4) -> np.ndarray:
    """Dense flow [2, H, W] from template to image coordinates by polynomial expansion, from coarse levels to fine.

    With neighbourhoods as quadratics x'Ax + b'x, a shift by d changes b by -2Ad. Each round
    expands the image as the flow so far moves it (so that turned neighbourhoods turn back),
    and solves for the d that is left by least squares over a window, in which pixels near
    the border, whose neighbourhoods are made up, weigh little.
    """
    stack = [(template.astype(float), image.astype(float))]
    while len(stack) < levels and min(stack[-1][0].shape) >= 4 * (radius + window):
        stack.append(tuple(blurred(a, 5)[::2, ::2] for a in stack[-1]))
    flow = np.zeros((2, *stack[-1][0].shape))
    for t, im in reversed(stack):
        h, w = t.shape
        y, x = np.mgrid[:h, :w].astype(float)
        if flow.shape[1:] != t.shape:
            flow = 2 * np.stack([sampled(f, np.minimum(x / 2, f.shape[1] - 1), np.minimum(y / 2, f.shape[0] - 1)) for f in flow])
        first = polynomials(t, radius, sigma)
        edge = np.minimum(np.minimum(x, w - 1 - x), np.minimum(y, h - 1 - y))
        sure = np.minimum((edge + 1) / (radius + 1), 1) ** 2
        for _ in range(rounds):
            u, v = flow
            sx, sy = x + u, y + v
            inside = (sx >= 0) & (sx <= w - 1) & (sy >= 0) & (sy <= h - 1)
            there = polynomials(sampled(im, np.clip(sx, 0, w - 1), np.clip(sy, 0, h - 1)), radius, sigma)
            axx, ayy, axy = ((first[k] + there[k]) / 2 for k in (2, 3, 4))
            axy = axy / 2
            bx = (first[0] - there[0]) / 2 + axx * u + axy * v
            by = (first[1] - there[1]) / 2 + axy * u + ayy * v
            weight = sure * np.where(inside, 1.0, 1e-3)
            gxx, gxy, gyy, hx, hy = (
                blurred(weight * q, window)
                for q in (axx * axx + axy * axy, axy * (axx + ayy), axy * axy + ayy * ayy, axx * bx + axy * by, axy * bx + ayy * by)
            )
            held = 1e-6 * (gxx + gyy) + 1e-12
            gxx, gyy = gxx + held, gyy + held
            hx, hy = hx + held * blurred(u, window), hy + held * blurred(v, window)
            det = gxx * gyy - gxy * gxy
            flow = np.stack([(gyy * hx - gxy * hy) / det, (gxx * hy - gxy * hx) / det])
    return flow


#: Pictures that a task turns into output at a time.
_SLICE = 64


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
    """The columns of at most ``_SLICE`` rows at a time; Spark's batches go by rows, which pictures make large."""
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            part = batch.slice(at, _SLICE)
            yield dict(zip(part.schema.names, part.columns, strict=True))


def _picture(data: pa.Scalar, height: pa.Scalar, width: pa.Scalar) -> np.ndarray:
    """A cell of numbers, or of a byte for each pixel, as doubles [H, W]."""
    flat = np.frombuffer(data.as_buffer(), np.uint8) if isinstance(data, (pa.BinaryScalar, pa.LargeBinaryScalar)) else data.values.to_numpy(zero_copy_only=False)
    return flat.astype(float).reshape(height.as_py(), width.as_py())


def _lists(rows: list[np.ndarray]) -> pa.Array:
    """Arrays as the cells of a list column, without a Python number for each value."""
    flat = [np.ravel(r) for r in rows]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, flat)]), pa.int32()), pa.array(np.concatenate(flat), pa.float64()))


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to all shuffle partitions by keys: numpy's time goes by rows, and Spark merges partitions by their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def registered(images: DataFrame, template: np.ndarray, motion: str = "affine", blur: int = 5) -> DataFrame:
    """(image_id, warp): every image (image_id, height, width, data) against one template, in parallel.

    Here and below ``data`` is array<double>, or binary with a byte for each pixel.
    """
    shared = images.sparkSession.sparkContext.broadcast(np.asarray(template, float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _slices(batches):
            warps = [safe_registration(shared.value, _picture(d, h, w), motion, blur) for h, w, d in zip(p["height"], p["width"], p["data"], strict=True)]
            yield pa.RecordBatch.from_arrays([p["image_id"], _lists(warps)], ["image_id", "warp"])

    return images.select(F.col("image_id").cast("long").alias("image_id"), "height", "width", "data").mapInArrow(run, "image_id long, warp array<double>")


def registered_to_previous(images: DataFrame, motion: str = "affine", blur: int = 5) -> DataFrame:
    """(session, image_id, warp): every image of a session against the one before, in parallel; the first has the identity."""
    order = Window.partitionBy("session").orderBy("image_id")
    return _registered_pairs(images.select("session", "image_id", "height", "width", "data", F.lag("data").over(order).alias("before")), motion, blur)


def _with_first(images: DataFrame) -> DataFrame:
    """Every image with the first of its session as ``before``; null beside the first itself. A hot session is left to skew-splitting joins."""
    first = images.groupBy("session").agg(F.min("image_id").alias("_first"), F.min_by("data", "image_id").alias("_data"))
    before = F.when(F.col("image_id") != F.col("_first"), F.col("_data")).alias("before")
    return images.join(first, "session").select("session", "image_id", "height", "width", "data", before)


def registered_to_first(images: DataFrame, motion: str = "affine", blur: int = 5) -> DataFrame:
    """(session, image_id, warp): every image of a session against its first, in parallel; the first has the identity."""
    return _registered_pairs(_with_first(images), motion, blur)


def _registered_pairs(pairs: DataFrame, motion: str, blur: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _slices(batches):
            warps = []
            for h, w, d, before in zip(p["height"], p["width"], p["data"], p["before"], strict=True):
                first = np.eye(3)[: 3 if motion == "homography" else 2]
                warps.append(safe_registration(_picture(before, h, w), _picture(d, h, w), motion, blur) if before.is_valid else first)
            yield pa.RecordBatch.from_arrays([p["session"], p["image_id"], _lists(warps)], ["session", "image_id", "warp"])

    typed = pairs.select("session", F.col("image_id").cast("long").alias("image_id"), "height", "width", "data", "before")
    return _spread(typed, "session", "image_id").mapInArrow(run, "session string, image_id long, warp array<double>")


def chained(warps: DataFrame) -> DataFrame:
    """(image_id, warp): warps to the previous image made into warps to the first, an ordered product over a session's images."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("image_id")
        total, out = [[1.0, 0, 0], [0, 1.0, 0]], []
        for w in p["warp"]:
            total = composed(np.reshape(w, (-1, 3)).tolist(), total)
            out.append(np.ravel(total).tolist())
        return pd.DataFrame({"session": p["session"], "image_id": p["image_id"], "warp": out})

    return warps.groupBy("session").applyInPandas(run, "session string, image_id long, warp array<double>")


def transformed(images: DataFrame, warps: DataFrame) -> DataFrame:
    """Images resampled through their warps; what comes from outside takes the image's mean. Images with a session keep it."""
    keys = ["session", "image_id"] if "session" in images.columns else ["image_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _slices(batches):
            out = []
            for h, w, d, m in zip(p["height"], p["width"], p["data"], p["warp"], strict=True):
                a, m = _picture(d, h, w), np.reshape(m.as_py(), (-1, 3))
                y, x = np.mgrid[: a.shape[0], : a.shape[1]].astype(float)
                z = m[2, 0] * x + m[2, 1] * y + m[2, 2] if len(m) == 3 else 1.0
                out.append(sampled(a, (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / z, (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / z, float(a.mean())))
            yield pa.RecordBatch.from_arrays([*[p[k] for k in keys], p["height"], p["width"], _lists(out)], [*keys, "height", "width", "data"])

    schema = ("session string, " if len(keys) == 2 else "") + "image_id long, height int, width int, data array<double>"
    typed = images.join(warps, keys).select(*keys[:-1], F.col("image_id").cast("long").alias("image_id"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), "data", "warp")
    return _spread(typed, *keys).mapInArrow(run, schema)


def flow_fields(images: DataFrame, method: str = "polynomial", **settings: float) -> DataFrame:
    """(session, image_id, y, x, dx, dy): dense flow from a session's first image to every other, in parallel; a row for each pixel.

    ``polynomial`` or ``lucas_kanade``, with that function's settings. A first image has no flow: zeros.
    """
    flow = {"polynomial": polynomial_flow, "lucas_kanade": dense_flow}[method]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _slices(batches):
            for s, i, h, w, d, before in zip(p["session"], p["image_id"], p["height"], p["width"], p["data"], p["before"], strict=True):
                shape = (h.as_py(), w.as_py())
                u, v = flow(_picture(before, h, w), _picture(d, h, w), **settings) if before.is_valid else np.zeros((2, *shape))
                y, x = np.mgrid[: shape[0], : shape[1]]
                keys = [pa.repeat(k, u.size) for k in (s, i)]
                yield pa.RecordBatch.from_arrays([*keys, *[pa.array(np.ravel(c)) for c in (y, x, u, v)]], ["session", "image_id", "y", "x", "dx", "dy"])

    typed = _with_first(images).withColumn("image_id", F.col("image_id").cast("long"))
    return _spread(typed, "session", "image_id").mapInArrow(run, "session string, image_id long, y long, x long, dx double, dy double")


def folded(flows: DataFrame, warps: DataFrame) -> DataFrame:
    """(session, image_id, y, x, src_x, src_y): flows of images that had been moved by their warps, and the warps, as one remap.

    The moved image at x is the image at W x, and the flow leads from x to x + f(x) in the
    moved image; so the whole way from x leads to W (x + f(x)). Warps are affine or
    projective; an image without a warp has no remap.
    """
    at = flows.join(warps.select("session", "image_id", "warp"), ["session", "image_id"])
    x, y, m = F.col("x") + F.col("dx"), F.col("y") + F.col("dy"), F.col("warp")
    row = lambda i: m[i] * x + m[i + 1] * y + m[i + 2]
    z = F.when(F.size("warp") == 9, F.get(m, F.lit(6)) * x + F.get(m, F.lit(7)) * y + F.get(m, F.lit(8))).otherwise(1.0)
    return at.select("session", "image_id", "y", "x", (row(0) / z).alias("src_x"), (row(3) / z).alias("src_y"))


def augmented(image: DataFrame, other: DataFrame, weight: float) -> DataFrame:
    """An image mixed with a version of itself (edges, blur, equalisation), scaled to 0..1 before registration."""
    both = image.join(other.select("y", "x", F.col("value").alias("other")), ["y", "x"])
    mixed = both.select("y", "x", ((1 - weight) * F.col("value") + weight * F.col("other")).alias("value"))
    low, high = mixed.agg(F.min("value"), F.max("value")).first()
    return mixed.select("y", "x", ((F.col("value") - F.lit(low)) / F.nullif(F.lit(high) - F.lit(low), F.lit(0.0))).alias("value"))
