import pytest

from kinetrace.functions import params
from kinetrace.operators import track
from kinetrace.plans import project
from kinetrace.sources import files
from kinetrace.streaming import windows


def test_params():
    p = params.resolved({"factors": {"rank": 3}})
    assert p["factors"]["rank"] == 3 and p["factors"]["iterations"] == 200 and p["spectra"]["bins"] == 36
    with pytest.raises(KeyError):
        params.resolved({"factors": {"rang": 3}})
    assert params.flattened({"a": {"b": 1}, "c": 2}) == {("a", "b"): 1, ("c",): 2}
    assert params.find_keys({"a": {"bc": 1}}, "^b") == [(("a", "bc"), 1)]
    assert params.updated({"a": {"b": 1}}, ["a", "b"], 2) == {"a": {"b": 2}}
    with pytest.raises(KeyError):
        params.updated({"a": {}}, ["a", "b"], 2)
    assert params.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert list(params.batches(range(5), size=2, least=2)) == [[0, 1], [2, 3]]
    assert len(list(params.batches(range(10), count=3))) == 3


def test_repeated_items():
    three, endless = params.Repeated({"a": 1}, 3), params.Repeated("x")
    assert list(three) == [{"a": 1}] * 3 and three[-1] is three[0] and len(three) == 3
    with pytest.raises(IndexError):
        three[3]
    assert [job + p for job, p in zip(["a", "b"], endless, strict=False)] == ["ax", "bx"] and endless[10**9] == "x"
    with pytest.raises(TypeError):
        len(endless)


def test_files(spark, tmp_path):
    for n in ("v10.txt", "v9.txt", "sub/v2.txt"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text(n)
    found = [r["name"] for r in files.find_paths(spark, str(tmp_path), r"\.txt$").collect()]
    assert found == ["v9.txt", "v10.txt", "v2.txt"]
    assert [r["name"] for r in files.find_paths(spark, str(tmp_path), depth=0).collect()] == ["v9.txt", "v10.txt"]
    m = files.manifest(spark, str(tmp_path)).collect()
    assert {r["path"] for r in m} == {"v10.txt", "v9.txt", "sub/v2.txt"}
    before = spark.createDataFrame(m)
    (tmp_path / "v9.txt").write_text("other")
    assert [tuple(r) for r in files.compare_manifests(before, files.manifest(spark, str(tmp_path))).collect()] == [("v9.txt", "different")]
    files.write_yaml({"a": [1]}, str(tmp_path / "x/y.yaml"))
    assert files.read_yaml(str(tmp_path / "x/y.yaml")) == {"a": [1]}
    with pytest.raises(FileExistsError):
        files.write_json({}, str(tmp_path / "x/y.yaml"), overwrite=False)


def test_pipeline(spark, tmp_path):
    p = project.Project(str(tmp_path / "p"))
    home = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate([(16, 16), (32, 16), (16, 32), (32, 32)])], "point_id long, x0 double, y0 double")
    given = {"tracker": {"neighbours": 3}, "spectra": {"taps": 5, "pool": 2, "bins": 3}, "factors": {"rank": 2, "iterations": 2}}
    out = project.run(spark, track.blob_frames(spark), home, given, p)
    assert set(out) == {"tracks", "spectrogram", "factors"}
    assert out["spectrogram"].count() == 2 * 2 * 4 * 3 * 4
    assert p.tree() == {"factors": ["factors"], "spectra": ["raw", "spectrogram"], "tracker": ["points", "tracks"]}
    assert p.config()["factors"]["rank"] == 2 and "violation_fraction" in p.run_info()["tracker"]
    with pytest.raises(KeyError):
        p.save_config("factors", {}, overwrite=False)


def test_pipeline_from_polygons_and_video_rates(spark, tmp_path):
    """Points are a grid inside the polygons; the spectra follow the videos' frame rate."""
    polygons = spark.createDataFrame([("a", i, float(x), float(y)) for i, (x, y) in enumerate([(10, 10), (40, 10), (40, 40), (10, 40)])], "roi_id string, ord int, x double, y double")
    videos = spark.createDataFrame([("v0", 12, 90.0), ("v1", 12, 90.0)], "video_id string, num_frames long, frame_rate double")
    given = {"steps": ["track", "spectra"], "points": {"spacing": 14}, "tracker": {"neighbours": 2, "most_rewinds": 2}, "spectra": {"taps": 5, "pool": 2, "bins": 3}}
    p = project.Project(str(tmp_path / "p"))
    out = project.run(spark, track.blob_frames(spark), None, given, p, videos, polygons)
    n = p.load(spark, "tracker", "points").count()
    assert n in (4, 9) and out["tracks"].count() == 2 * 12 * n
    from kinetrace.operators import spectral

    taps, _ = spectral.make_taps(90.0, 1.0, 60.0, 3, 5, 4.0, 10.0)
    raw = p.load(spark, "tracker", "tracks").where("video_id = 'v0' AND point_id = 0").toPandas().sort_values("frame_idx")
    start = p.load(spark, "tracker", "points").where("point_id = 0").first()
    got = p.load(spark, "spectra", "raw").where("video_id = 'v0' AND point_id = 0 AND axis = 0").toPandas().sort_values(["f_idx", "t_ds"])
    assert abs(got.value.to_numpy().reshape(3, -1) - spectral.spectrum(raw.x.to_numpy() - start.x0, taps, 2)).max() < 1e-6


def test_cleanup(spark):
    import os

    from kinetrace import storage

    path = storage.new_path(spark, "kept")
    spark.range(3).write.parquet(path)
    assert os.path.exists(path.removeprefix("file://"))
    assert storage.cleanup(spark) >= 1
    assert not os.path.exists(path.removeprefix("file://")) and storage.cleanup(spark) == 0


def test_streams(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", "a", 1, float(m)) for m in range(0, 40, 5)]
    spark.createDataFrame(rows, "ts string, video_id string, point_id int, value double").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "video_id", "point_id", "value", "CAST(value AS LONG) AS frame_idx", "value AS step").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def result(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    pooled = result(windows.pooled_stream(stream(), "10 minutes"), "pooled", "complete")
    assert sorted((r["n"], r["value"]) for r in pooled) == [(2, 2.5), (2, 12.5), (2, 22.5), (2, 32.5)]
    assert [r["n"] for r in result(windows.sessions(stream(), "6 minutes"), "bursts", "complete")] == [8]
    relaxed = sorted((r["frame_idx"], r["p"]) for r in result(windows.relaxed_stream(stream(), 0.5), "relaxed", "append"))
    p, want = 0.0, []
    for m in range(0, 40, 5):
        p = (p + m) * 0.5
        want.append((m, p))
    assert relaxed == want
