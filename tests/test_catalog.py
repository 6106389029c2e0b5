"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from kinetrace.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    return round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in names] for r in df.collect()), key=str)
    rel = con.sql(catalog.SQL[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    want = sorted(([plain(r[i]) for i in at] for r in rel.fetchall()), key=str)
    assert len(got) == len(want)
    assert got == want


def blobs(dx, dy, size=48):
    """Two blobs, moved."""
    import numpy as np

    y, x = np.mgrid[:size, :size]
    return np.exp(-((x - 20 - dx) ** 2 + (y - 24 - dy) ** 2) / 60) + 0.7 * np.exp(-((x - 32 - dx) ** 2 + (y - 14 - dy) ** 2) / 30)


def shots(spark):
    """Four pictures of two blobs, each a little farther from the first."""
    return spark.createDataFrame([("s", i, 48, 48, blobs(i * 0.7, -i * 0.4).ravel().tolist()) for i in range(4)], "session string, image_id long, height int, width int, data array<double>")


def test_point_tracking_follows_blobs(spark):
    import numpy as np

    from kinetrace.operators import track

    home = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate([(16, 16), (32, 16), (16, 32), (32, 32)])], "point_id long, x0 double, y0 double")
    rows = track.track_points(track.blob_frames(spark), home, track.TrackerParams(neighbours=3)).toPandas()
    assert len(rows) == 2 * 12 * 4
    moved = rows[(rows.video_id == "v0") & (rows.point_id == 0)].sort_values("frame_idx")
    want = 16 + 3 * np.sin(2 * np.pi * np.arange(12) / 12)
    assert np.abs(moved.x.to_numpy() - want).max() < 0.8


def test_registration_finds_the_shift(spark):
    from kinetrace.operators import align

    for r in [*align.registered(shots(spark), blobs(0, 0), "affine").collect(), *align.registered_to_first(shots(spark), "affine").collect()]:
        assert abs(r["warp"][2] - 0.7 * r["image_id"]) < 0.2
        assert abs(r["warp"][5] + 0.4 * r["image_id"]) < 0.2


def test_chained_warps_equal_direct_ones(spark):
    from kinetrace.operators import align

    direct = {r["image_id"]: r["warp"] for r in align.registered(shots(spark), blobs(0, 0), "affine").collect()}
    rows = align.chained(align.registered_to_previous(shots(spark), "euclidean")).collect()
    assert len(rows) == len(direct) == 4
    for r in rows:
        assert abs(r["warp"][2] - 0.7 * r["image_id"]) < 0.2 and abs(r["warp"][5] + 0.4 * r["image_id"]) < 0.2
        assert abs(r["warp"][2] - direct[r["image_id"]][2]) < 0.2 and abs(r["warp"][5] - direct[r["image_id"]][5]) < 0.2


def test_relaxed_over_many_segments(spark):
    from kinetrace.operators import points

    rows = [("a", i, float((i * 7919) % 13 - 6)) for i in range(3000)] + [("b", 0, 2.0)]
    for rate in (0.05, 0.3, 0.9, 0.9999):
        got = {(r["k"], r["i"]): r["p"] for r in points.relaxed(spark.createDataFrame(rows, "k string, i long, v double"), "v", rate, ["k"], "i").collect()}
        p = 0.0
        for k, i, v in rows:
            p = (1 - rate) * ((0.0 if i == 0 else p) + v)
            assert abs(got[k, i] - p) < 1e-9


def test_nearest_bins_on_an_irregular_axis(spark):
    import random

    from kinetrace.operators import align

    random.seed(3)
    samples = sorted({round(random.expovariate(1 / 50) ** 2, 2) for _ in range(300)})
    axis = spark.createDataFrame([(float(x), i) for i, x in enumerate(samples)], "sample double, t_ds long")
    at = [(i, random.choice([random.uniform(-50, samples[-1] + 500), random.choice(samples), samples[3] / 2 + samples[4] / 2])) for i in range(1500)] + [(9999, float("nan")), (9998, None)]
    got = {r["event_id"]: r["t_ds"] for r in align.nearest_bins(spark.createDataFrame(at, "event_id long, at double"), axis, least=-10).collect()}
    want = {i: min(range(len(samples)), key=lambda k: (abs(samples[k] - x), k)) for i, x in at if x is not None and x > -10}
    assert got == want


def test_principal_components(spark, con):
    import numpy as np

    x = np.stack([r[0] for r in con.sql("SELECT embedding FROM embeddings").fetchall()]).astype(float)
    w = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    got = catalog.principal_components(spark, SF).toPandas()
    assert np.allclose(np.sort(got.iloc[:, -1])[::-1], np.round(w / w.sum(), 4)[: len(got)], atol=1e-4)


def test_transformed_images_lie_on_the_first(spark):
    """Resampled through their warps, the pictures differ from the first by little of what they differed before."""
    import numpy as np

    from kinetrace.operators import align

    first = blobs(0, 0)
    rows = align.transformed(shots(spark), align.registered_to_first(shots(spark), "translation")).collect()
    before = {r["image_id"]: np.abs(np.reshape(r["data"], (48, 48)) - first)[6:-6, 6:-6].mean() for r in shots(spark).collect()}
    assert len(rows) == len(before)
    for r in rows:
        assert np.abs(np.reshape(r["data"], (48, 48)) - first)[6:-6, 6:-6].mean() <= 0.15 * before[r["image_id"]] + 1e-6


def textured(x, y):
    import numpy as np

    return 100 + 30 * np.sin(x / 3.1 + 0.4 * np.cos(y / 5)) * np.cos(y / 3.7) + 20 * np.sin(x / 7.3 + y / 4.9)


@pytest.mark.parametrize("dx,dy,turn", [(0.0, 0.0, 0.0), (1.3, -0.6, 0.0), (-3.4, 2.7, 0.0), (0.5, 0.0, 0.03), (0.0, 0.0, -0.05)])
def test_polynomial_flow_finds_shifts_and_rotations(dx, dy, turn):
    """Within a tenth of a pixel, away from the border, of the true way of nearly every pixel; a little more for a turn of 3 degrees."""
    import numpy as np

    from kinetrace.operators import align

    y, x = np.mgrid[:72, :80].astype(float)
    c, s, mx, my = np.cos(turn), np.sin(turn), 39.5, 35.5
    # the template at p is the picture at R p + d
    to_x, to_y = mx + c * (x - mx) - s * (y - my) + dx, my + s * (x - mx) + c * (y - my) + dy
    u, v = align.polynomial_flow(textured(to_x, to_y), textured(x, y))
    off = np.hypot(u - (to_x - x), v - (to_y - y))[10:-10, 10:-10]
    assert off.mean() < 0.05 and np.quantile(off, 0.99) < (0.1 if abs(turn) < 0.05 else 0.12)


def test_flow_of_flat_and_tiny_pictures():
    import numpy as np

    from kinetrace.operators import align

    assert np.abs(align.polynomial_flow(np.full((20, 30), 7.0), np.full((20, 30), 7.0))).max() < 1e-6
    assert align.polynomial_flow(np.ones((1, 1)), np.ones((1, 1))).shape == (2, 1, 1)


def test_folded_remap_is_the_whole_way(spark):
    """A warp, then a flow of what it leaves: the image read through the folded remap is the template."""
    import numpy as np

    from kinetrace.operators import align

    y, x = np.mgrid[:64, :64].astype(float)
    bend = 0.8 * np.sin(y / 9)
    template, image = textured(x + 2.0 + bend, y - 1.0), textured(x, y)
    images = spark.createDataFrame([("s", 0, 64, 64, template.ravel().tolist()), ("s", 1, 64, 64, image.ravel().tolist())], "session string, image_id long, height int, width int, data array<double>")
    warps = spark.createDataFrame([("s", 0, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]), ("s", 1, [1.0, 0.0, 2.0, 0.0, 1.0, -1.0])], "session string, image_id long, warp array<double>")
    remap = align.folded(align.flow_fields(align.transformed(images, warps)), warps).where("image_id = 1").orderBy("y", "x").toPandas()
    off = np.hypot(remap.src_x.to_numpy().reshape(64, 64) - (x + 2 + bend), remap.src_y.to_numpy().reshape(64, 64) - (y - 1))[8:-8, 8:-8]
    assert off.mean() < 0.1
    nine = spark.createDataFrame([("s", 0, [2.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 2.0]), ("s", 1, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.01, 0.0, 1.0])], "session string, image_id long, warp array<double>")
    flat = spark.createDataFrame([("s", i, 2, 3, 0.5, 0.0) for i in (0, 1, 2)], "session string, image_id long, y long, x long, dx double, dy double")
    got = {r["image_id"]: (r["src_x"], r["src_y"]) for r in align.folded(flat, nine).collect()}
    assert got == {0: (3.5, 2.0), 1: pytest.approx((3.5 / 1.035, 2 / 1.035))}


@pytest.mark.parametrize("border", ["constant", "replicate", "reflect", "wrap"])
def test_remaps_against_loops(spark, border):
    import math

    import numpy as np

    from kinetrace.operators import align

    rng = np.random.default_rng(4)
    image, h, w = rng.random((6, 7)), 6, 7
    sources = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-9, 15, 40), rng.uniform(-9, 14, 40), strict=True))] + [(40, 3.0, 2.0), (41, 0.5, 5.0)]

    def pixel(y, x):
        if border == "constant":
            return image[y, x] if 0 <= y < h and 0 <= x < w else 0.25
        if border == "replicate":
            return image[min(max(y, 0), h - 1), min(max(x, 0), w - 1)]
        if border == "wrap":
            return image[y % h, x % w]
        fold = lambda i, n: i % (2 * n) if i % (2 * n) < n else 2 * n - 1 - i % (2 * n)
        return image[fold(y, h), fold(x, w)]

    def weight(d, method):
        d = abs(d)
        if method == "linear":
            return max(0.0, 1 - d)
        if method == "cubic":
            return 1.25 * d**3 - 2.25 * d**2 + 1 if d <= 1 else -0.75 * (d**3 - 5 * d**2 + 8 * d - 4) if d < 2 else 0.0
        return 1.0 if d < 1e-9 else np.sinc(d) * np.sinc(d / 4) if d < 4 else 0.0

    pixels = spark.createDataFrame([(y, x, float(image[y, x])) for y in range(h) for x in range(w)], "y long, x long, value double")
    remap = spark.createDataFrame([(0, i, x, y) for i, x, y in sources], "y long, x long, src_x double, src_y double")
    for method, reach in (("nearest", 0), ("linear", 1), ("cubic", 2), ("lanczos", 4)):
        got = {r["x"]: r["value"] for r in align.remapped(pixels, remap, 0.25, method, border, (h, w)).collect()}
        for i, x, y in sources:
            if method == "nearest":
                want = pixel(round(y), round(x))
            else:
                xs, ys = ([(k, weight(c - k, method)) for k in range(math.floor(c) + 1 - reach, math.floor(c) + reach + 1)] for c in (x, y))
                want = sum(wx * wy * pixel(ky, kx) for kx, wx in xs for ky, wy in ys) / sum(a for _, a in xs) / sum(a for _, a in ys)
            assert abs(got[i] - want) < 1e-9, (method, i)


def test_natural_key_takes_every_number(spark):
    import re

    from kinetrace.sources import files

    names = ["a10b2", "a10b10", "a2b30", "a2b4", "b1", "10", "9x", "9x08", "9x8", "a", "", "a010b1", "x" + "9" * 60, "x" + "1" * 61]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r["n"] for r in df.orderBy(*files.natural_key(df["n"])).collect()]
    turns = lambda n: [int(p) if i % 2 else p for i, p in enumerate(re.split("([0-9]+)", n)) if p or i == 0]
    assert got == sorted(names, key=lambda n: (turns(n), n))


def test_taps():
    import numpy as np

    from kinetrace.operators import spectral

    taps, hz = spectral.make_taps(100, 2, 40, 5, 101, 3, 6)
    assert np.allclose(np.abs(taps).sum(axis=1), 1)
    with pytest.raises(ValueError):
        spectral.make_taps(100, 2, 40, 5, 100, 3, 6)
    # a sinusoid peaks in its own bin, a constant gives nearly nothing at high frequencies
    t = np.arange(2000) / 100
    y = spectral.spectrum(np.sin(2 * np.pi * hz[3] * t), taps, 20)
    assert y.mean(axis=1).argmax() == 3
    assert spectral.spectrum(np.ones(2000), taps, 20)[4].max() < 1e-2
    assert spectral.spectrum(np.ones(101), taps, 20).shape == (5, 1)
    assert spectral.spectrum(np.ones(100), taps, 20).shape == (5, 0)


def test_natural_order_of_every_customer(spark):
    rows = catalog.QUERIES["natural_order"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(r["place"] for r in rows) == list(range(1, 1501))


def test_images_of_every_vector(spark, con):
    n = con.sql("SELECT count(*) FROM embeddings").fetchall()[0][0]
    assert n > 64
    for name in ("masked_image", "border_mask", "convolution_2d", "sobel_gradients", "colour_mapped", "remapped_image", "remapped_nearest", "equalised_image", "min_max_image"):
        assert catalog.QUERIES[name](spark, SF).count() == 64 * n


def test_every_element_and_video(spark):
    for name, key in (("cp_factors", "elem"), ("khatri_rao_product", "elem"), ("factor_correlations", "video_id"), ("nearest_event_bins", "event_type")):
        assert {r[0] for r in catalog.QUERIES[name](spark, SF).select(key).distinct().collect()} == {"click", "error", "purchase", "signup", "view"}


def test_entry_and_queries(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
