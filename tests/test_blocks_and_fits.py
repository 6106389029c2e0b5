"""Overlap-save, robust motion, inverses by triangles, blended tiles and frame ranges, each against plain code."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.operators import align, spectral
from kinetrace.sources import tables


@pytest.mark.parametrize(("padding", "block", "as_complex"), [("valid", 8, False), ("valid", 64, True), ("same", 8, True), ("same", 4096, False)])
def test_overlap_save_is_the_direct_sum(spark, padding, block, as_complex):
    rng = np.random.default_rng(block)
    taps = spectral.simple_taps(3, 9, 0.05, 0.4)
    series = {n: rng.normal(size=n) for n in (1, 8, 9, 10, 57, 200)}
    rows = [("v", 0, n, t, float(d)) for n, x in series.items() for t, d in enumerate(x)]
    traces = spark.createDataFrame(rows, "video_id string, axis int, point_id int, t long, d double").repartition(3)
    got = {(r.point_id, r.f_idx, r.t_ds): complex(r.re, r.im) if as_complex else r.value for r in spectral.overlap_saved(traces, taps, 4, padding, as_complex, block).collect()}
    want = {}
    for n, x in series.items():
        y = spectral.spectrum(x, taps, 4, padding, as_complex)
        want |= {(n, f, t): y[f, t] for f in range(y.shape[0]) for t in range(y.shape[1])}
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    assert spectral.overlap_saved(traces.limit(0), taps, 4, padding).collect() == []


def test_robust_motion_leaves_outliers_out(spark):
    """30 % of the points move at random; the motion of the others is found, with the number of its voters."""
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for key in range(12):
        n, angle, scale, shift = 30, rng.uniform(-1, 1), rng.uniform(0.7, 1.4), rng.normal(size=2) * 20
        p = rng.uniform(0, 100, (n, 2))
        a, b = scale * np.cos(angle), scale * np.sin(angle)
        q = p @ np.array([[a, b], [-b, a]]) + shift + rng.normal(size=(n, 2)) * 0.01
        q[:9] += rng.uniform(20, 80, (9, 2)) * rng.choice([-1, 1], (9, 2))
        rows += [(key, i, *map(float, (*p[i], *q[i]))) for i in range(n)]
        want[key] = (scale, angle, *shift)
    rows += [(50, 0, 1.0, 1.0, 2.0, 2.0), (51, 0, 1.0, 1.0, 2.0, 2.0), (51, 1, 1.0, 1.0, 2.0, 2.0), (52, 0, None, 1.0, 2.0, 2.0)]  # no trial
    df = spark.createDataFrame(rows, "k long, point_id long, x0 double, y0 double, x double, y double")
    got = {r["k"]: r for r in align.robust_motion(df, ["k"], 0.5, 24).collect()}
    assert set(got) == set(want)
    for key, (scale, angle, dx, dy) in want.items():
        r = got[key]
        assert r["n_inliers"] == 21
        assert abs(r["scale"] - scale) < 1e-3 and abs(r["angle"] - angle) < 1e-3 and abs(r["dx"] - dx) < 0.1 and abs(r["dy"] - dy) < 0.1


def test_inverse_by_triangles_has_no_holes_and_goes_back(spark):
    h, w = 24, 30
    y, x = np.mgrid[:h, :w].astype(float)
    sx, sy = 1.3 * x + 2 + np.sin(y / 4), 1.2 * y - 1 + 0.8 * np.cos(x / 5)  # stretched: rounding would leave holes
    rows = [(int(a), int(b), float(sy[a, b]), float(sx[a, b])) for a in range(h) for b in range(w)]
    remap = spark.createDataFrame(rows, "y long, x long, src_y double, src_x double")
    inverse = {(r.y, r.x): (r.src_y, r.src_x) for r in align.interpolated_inverse(remap).collect()}
    for (py, px), (ry, rx) in inverse.items():  # the remap read at what the inverse says is the pixel
        assert abs(align.sampled(sx, np.array([[rx]]), np.array([[ry]]))[0, 0] - px) < 0.1
        assert abs(align.sampled(sy, np.array([[rx]]), np.array([[ry]]))[0, 0] - py) < 0.1
    whole = [(py, px) for py in range(int(np.ceil(sy[0].max())), int(sy[-1].min()) + 1) for px in range(int(np.ceil(sx[:, 0].max())), int(sx[:, -1].min()) + 1)]
    assert len(whole) > 700 and set(whole) <= set(inverse)
    assert len(inverse) > 1.3 * 1.2 * (h - 1) * (w - 1) * 0.9
    again = align.interpolated_inverse(spark.createDataFrame([(a, b, *v) for (a, b), v in inverse.items()], "y long, x long, src_y double, src_x double")).collect()
    assert len(again) > (h - 4) * (w - 4)
    assert all(abs(r.src_x - sx[r.y, r.x]) < 0.15 and abs(r.src_y - sy[r.y, r.x]) < 0.15 for r in again)
    broken = remap.where("NOT (y = 5 AND x = 5)")  # cells without a corner are left out
    assert align.interpolated_inverse(broken).count() < len(inverse)


def test_blended_tiles_against_loops(spark):
    rng = np.random.default_rng(1)
    image = np.cumsum(rng.random((20, 28)), axis=1)
    df = spark.createDataFrame([(a, b, float(image[a, b])) for a in range(20) for b in range(28)], "y long, x long, value double")
    got = {(r.y, r.x): r.value for r in align.blended(df, 8, 16, 2.0).collect()}
    level = np.minimum(np.floor((image - image.min()) / (image.max() - image.min()) * 16), 15).astype(int)
    luts = {}
    for ty in range(3):
        for tx in range(4):
            k = np.bincount(level[ty * 8 : ty * 8 + 8, tx * 8 : tx * 8 + 8].ravel(), minlength=16)
            c = np.minimum(k, 2.0 * k.sum() / 16)
            luts[ty, tx] = (np.cumsum(c) + (k.sum() - c.sum()) / 16 * np.arange(1, 17)) / k.sum()
    for a in range(20):
        for b in range(28):
            fy, fx = min(max((a + 0.5) / 8 - 0.5, 0), 2), min(max((b + 0.5) / 8 - 0.5, 0), 3)
            want = 0.0
            for i in (0, 1):
                for j in (0, 1):
                    wy, wx = abs(1 - i - fy % 1), abs(1 - j - fx % 1)
                    if wy * wx > 0:
                        want += wy * wx * luts[int(fy) + i, int(fx) + j][level[a, b]]
            assert abs(got[a, b] - want) < 1e-9
    flat = np.repeat(np.arange(40)[None, :], 40, axis=0)  # a ramp, the same in every row
    ramp = {(r.y, r.x): r.value for r in align.blended(spark.createDataFrame([(a, b, float(flat[a, b])) for a in range(40) for b in range(40)], "y long, x long, value double"), 8, 40).collect()}
    tiles = {(r.y, r.x): r.value for r in align.equalised(spark.createDataFrame([(a, b, float(flat[a, b])) for a in range(40) for b in range(40)], "y long, x long, value double"), 8, 40).collect()}
    step = lambda v: max(abs(v[0, b + 1] - v[0, b]) for b in range(39))
    assert step(ramp) < step(tiles) / 2


def test_tracks_reach_to_the_last_event(spark, tmp_path):
    events = spark.sql("SELECT 1L AS event_id, 9L AS user_id, 'a' AS event_type, 2.5D AS value, timestamp_ntz'2025-02-03 04:30:00' AS ts UNION ALL SELECT 2L, 3L, 'a', 1.5D, timestamp_ntz'2023-12-31 23:10:00' UNION ALL SELECT 3L, 3L, NULL, 1.5D, timestamp_ntz'2024-01-01 00:10:00'")
    events.write.parquet(str(tmp_path / "events.parquet"))
    t = tables.tracks(spark, str(tmp_path))
    assert t.where("x <> 0").select("video_id", "point_id", "frame_idx", "x").orderBy("frame_idx").collect() == [("a", 3, -1, 1.5), ("a", 1, 399 * 24 + 4, 2.5)]
    assert t.count() == 8 * (399 * 24 + 4 + 2) and t.agg(F.sum("y")).first()[0] == 2
