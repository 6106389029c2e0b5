"""The frame source against the files' bytes, and tracking over it."""

import numpy as np
import pytest

from kinetrace.operators import track
from kinetrace.sources import frames


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Videos of every kind: a PGM file of 7 images, a folder of PPM files, raw files."""
    base = tmp_path_factory.mktemp("frames")
    rng = np.random.default_rng(0)
    known = {}
    a = rng.integers(0, 256, (7, 5, 6, 1), np.uint8)
    (base / "one.pgm").write_bytes(b"".join(b"P5\n# made\n6 5\n255\n" + x.tobytes() for x in a))
    known["one"] = a
    b = rng.integers(0, 256, (12, 4, 3, 3), np.uint8)
    (base / "many").mkdir()
    for i, x in enumerate(b[:10]):
        (base / "many" / f"shot{i}.ppm").write_bytes(b"P6 3 4 255\n" + x.tobytes())
    (base / "many" / "shot10.ppm").write_bytes(b"".join(b"P6 3 4 255\n" + x.tobytes() for x in b[10:]))
    (base / "many" / "notes.txt").write_text("no frames")
    known["many"] = b
    c = rng.integers(0, 256, (3, 2, 8, 1), np.uint8)
    (base / "cam_2x8.raw").write_bytes(c.tobytes())
    known["cam_2x8"] = c
    (base / "nothing.pgm").write_bytes(b"")
    return str(base), known


def arrays(df):
    return {(r.video_id, r.frame_idx): np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels) for r in df.collect()}


@pytest.mark.parametrize("n", [1, 4, 256])
def test_every_frame(spark, folder, n):
    path, known = folder
    got = arrays(frames.read_frames(spark, path, frames=n))
    assert set(got) == {(v, i) for v, a in known.items() for i in range(len(a))}
    assert all((got[v, i] == x).all() for v, a in known.items() for i, x in enumerate(a))


def test_filters_choose_what_is_read(spark, folder):
    path, known = folder
    reader = frames.FrameReader({"path": path, "frames": "2"})
    left = list(reader.pushFilters([frames.EqualTo(("video_id",), "many"), frames.GreaterThan(("frame_idx",), 3), frames.LessThanOrEqual(("frame_idx",), 10), frames.EqualTo(("height",), 4)]))
    assert [f.attribute for f in left] == [("height",)]
    ranges = reader.partitions()
    assert {(r.video_id, r.shift + i) for r in ranges for i in range(r.first, r.stop)} == {("many", i) for i in range(4, 11)}
    df = frames.read_frames(spark, path, frames=3)
    assert set(arrays(df.where("video_id = 'many' AND frame_idx >= 9"))) == {("many", i) for i in (9, 10, 11)}
    assert set(arrays(df.where("frame_idx IN (0, 5) AND video_id <> 'many'"))) == {("one", 0), ("one", 5), ("cam_2x8", 0)}
    assert df.where("video_id = 'one' AND frame_idx >= 6").rdd.getNumPartitions() == 1


def test_broken_files(spark, tmp_path):
    (tmp_path / "cut.pgm").write_bytes(b"P5 2 2 255\n123")
    with pytest.raises(Exception, match="bytes after 0 frames"):
        frames.read_frames(spark, str(tmp_path)).collect()
    (tmp_path / "cut.pgm").unlink()
    assert frames.read_frames(spark, str(tmp_path)).collect() == []
    (tmp_path / "x.raw").write_bytes(b"12345678")
    assert len(arrays(frames.read_frames(spark, str(tmp_path), height=2, width=2))) == 2


def test_written_frames_are_read_again(spark, tmp_path):
    made = track.blob_frames(spark)
    assert sum(r["n"] for r in frames.write_frames(made, str(tmp_path / "v")).collect()) == made.count()
    got, want = arrays(frames.read_frames(spark, str(tmp_path / "v"))), arrays(made)
    assert set(got) == set(want) and all((got[k] == want[k]).all() for k in want)
    home = spark.createDataFrame([(0, 16.0, 16.0), (1, 32.0, 32.0)], "point_id long, x0 double, y0 double")
    p = track.TrackerParams(neighbours=2)
    rows = lambda df: sorted(tuple(r) for r in track.track_points(df, home, p).collect())
    assert rows(frames.read_frames(spark, str(tmp_path / "v"), frames=5)) == rows(made)


def test_scrolled_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 32))
    df = spark.createDataFrame([(i, "a", row.tolist()) for i, row in enumerate(x)] + [(100, "b", x[0].tolist()), (101, None, None)], "vec_id long, label string, embedding array<double>")
    got = arrays(frames.scrolled(df, 20))
    assert set(got) == {("a", i) for i in range(40 - 20 - 4 + 1)}
    assert all((got["a", i][1:] == got["a", i + 1][:-1]).all() for i in range(16))
