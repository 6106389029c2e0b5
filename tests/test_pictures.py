"""Pictures of a byte for each pixel: slices of bounded size, spread over tasks, with the results of arrays of doubles."""

import numpy as np
import pyarrow as pa
import pytest

from kinetrace.operators import align
from kinetrace.plans import catalog
from kinetrace.sources import frames

SF = "/root/testdata/sf0.001"


def scenes(spark):
    y, x = np.mgrid[:32, :40]
    shown = [np.clip(200 * np.exp(-((x - 16 - i) ** 2 + (y - 14) ** 2) / 60) + 90 * np.exp(-((x - 27 - i) ** 2 + (y - 20) ** 2) / 30), 0, 255).astype(np.uint8) for i in range(4)]
    schema = "session string, image_id long, height int, width int, data "
    as_bytes = spark.createDataFrame([("s", i, 32, 40, bytearray(a.tobytes())) for i, a in enumerate(shown)], schema + "binary")
    as_doubles = spark.createDataFrame([("s", i, 32, 40, a.astype(float).ravel().tolist()) for i, a in enumerate(shown)], schema + "array<double>")
    return as_bytes, as_doubles


@pytest.mark.parametrize("of", [align.registered_to_previous, align.registered_to_first])
def test_bytes_register_as_doubles(spark, of):
    got, want = (sorted(map(tuple, of(images, "translation").collect())) for images in scenes(spark))
    assert len(got) == 4 and got == want


def test_bytes_flow_as_doubles(spark):
    got, want = (sorted(map(tuple, align.flow_fields(images).collect())) for images in scenes(spark))
    assert len(got) == 4 * 32 * 40 and got == want


def test_bytes_are_resampled_as_doubles(spark):
    as_bytes, as_doubles = scenes(spark)
    warps = align.registered_to_first(as_doubles, "translation")
    got, want = (sorted(map(tuple, align.transformed(images, warps).collect())) for images in (as_bytes, as_doubles))
    assert len(got) == 4 and got == want


def test_pictures_are_bytes_in_small_slices(spark):
    assert dict(catalog._pictures(spark, SF).dtypes)["data"] == "binary"
    batch = pa.RecordBatch.from_pydict({"image_id": list(range(1000))})
    parts = [p["image_id"] for p in align._slices(iter([batch]))]
    assert max(map(len, parts)) <= 64 and [x for p in parts for x in p.to_pylist()] == list(range(1000))


def test_scrolls_go_on_over_blocks(spark):
    rng = np.random.default_rng(5)
    v = rng.random((200, 8))
    df = spark.createDataFrame([(i * 3, 1, r.tolist()) for i, r in enumerate(v)], "vec_id long, label int, embedding array<double>")
    got = {r["frame_idx"]: bytes(r["data"]) for r in frames.scrolled(df, 6).collect()}
    assert sorted(got) == list(range(200 - 9))
    low, scale = v.min(), 255 / (v.max() - v.min())
    for i in (0, 63, 64, 65, 127, 128, 190):
        a = np.lib.stride_tricks.sliding_window_view(np.pad((v[i : i + 10] - low) * scale, ((0, 0), (2, 2)), mode="edge"), (5, 5)).mean((2, 3))
        assert got[i] == np.clip((a - 127.5) * 2.5 + 127.5, 0, 255).astype(np.uint8).tobytes()


def test_samples_outside_are_the_fill():
    a = np.arange(12.0).reshape(3, 4)
    x, y = np.array([-5.0, -0.5, 3.5, 9.0, 1.5]), np.array([1.0, 0.0, 2.0, 1.0, 0.5])
    assert align.sampled(a, x, y, 100.0).tolist() == [100.0, 50.0, 55.5, 100.0, 3.5]
    assert np.array_equal(align.sampled_together([a, 2 * a], x[:, None], y)[1], 2 * align.sampled(a, *np.broadcast_arrays(x[:, None], y)))
