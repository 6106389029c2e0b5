"""Video frames as a Spark data source, read straight from frame files.

``spark.dataSource.register(Frames)``, then ``spark.read.format("frames").load(folder)``
gives frames(video_id, frame_idx, height, width, channels, data). A video is

* a ``.pgm`` or ``.ppm`` file (binary, 8 bits) of any number of images after each other,
* a folder of such files, one image or more in each, in natural order of their names, or
* a ``.raw`` file of frames of options ``height``, ``width``, ``channels`` (1), or with them
  in its name, as in ``cam1_480x640x3.raw``.

The driver lists files and reads one header of each; a partition is ``frames`` (option,
256) consecutive frames of a video, which a task reads by their offsets, one frame at a
time. All images of a file must have one header; another is an error when it is read.

Filters on video_id (=, in) and frame_idx (=, in, <, <=, >, >=) choose files and frames
before any is read; that needs ``spark.sql.python.filterPushdown.enabled``, which
``read_frames`` sets. Folders can be in any store that Arrow's file systems reach.

Defined cases: an empty folder has no frames, as has an empty file. A frame cut short
is an error. Names without digits sort before those with.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "video_id string, frame_idx long, height int, width int, channels int, data binary"
_HEADER = re.compile(rb"P([56])\s(?:\s*#[^\n]*\n)*\s*(\d+)\s(?:\s*#[^\n]*\n)*\s*(\d+)\s(?:\s*#[^\n]*\n)*\s*(\d+)\s")
_SHAPE = re.compile(r"_(\d+)x(\d+)(?:x(\d+))?$")
#: Bytes in which a header must end.
_LONGEST_HEADER = 4096
#: Frames of a scroll that one group makes.
_BLOCK = 64


@dataclass(frozen=True)
class FrameFile:
    """A file of equal frames: where each begins and how it looks."""

    path: str
    header: bytes
    height: int
    width: int
    channels: int
    n: int

    @property
    def size(self) -> int:
        return self.height * self.width * self.channels

    @property
    def step(self) -> int:
        return len(self.header) + self.size


@dataclass
class FrameRange(InputPartition):
    """Frames ``first`` to ``stop`` of a file, the first of which is frame ``shift`` of its video."""

    video_id: str
    file: FrameFile
    first: int
    stop: int
    shift: int

    def __post_init__(self) -> None:
        super().__init__(None)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def natural(name: str) -> list[tuple[int, int, str]]:
    return [(1, int(x), "") if x.isdigit() else (0, 0, x) for x in re.split(r"(\d+)", name) if x]


def header_of(start: bytes, path: str) -> tuple[bytes, int, int, int]:
    """(header, height, width, channels) of a PGM or PPM image."""
    found = _HEADER.match(start)
    if not found or int(found[4]) > 255:
        raise ValueError(f"{path}: no binary PGM or PPM of 8 bits")
    return found[0], int(found[3]), int(found[2]), 1 if found[1] == b"5" else 3


def described(fs: pafs.FileSystem, info: pafs.FileInfo, shape: tuple[int, int, int] | None) -> FrameFile | None:
    """What a file holds; None for other files and empty ones."""
    name, _, suffix = info.base_name.rpartition(".")
    if not info.size or suffix not in ("pgm", "ppm", "raw"):
        return None
    if suffix == "raw":
        in_name = _SHAPE.search(name)
        shape = shape or (tuple(int(x or 1) for x in in_name.groups()) if in_name else None)
        if shape is None:
            raise ValueError(f"{info.path}: the frames' height and width are not known")
        header, (h, w, c) = b"", shape
    else:
        with fs.open_input_file(info.path) as f:
            header, h, w, c = header_of(f.read(_LONGEST_HEADER), info.path)
    n, rest = divmod(info.size, len(header) + h * w * c)
    if rest:
        raise ValueError(f"{info.path}: {rest} bytes after {n} frames of {h} x {w} x {c}")
    return FrameFile(info.path, header, h, w, c, n)


class FrameReader(DataSourceReader):
    """Plans ranges of frames on the driver and reads them in tasks."""

    def __init__(self, options: dict) -> None:
        self.folder, self.most = options["path"], int(options.get("frames", 256))
        self.shape = (int(options["height"]), int(options["width"]), int(options.get("channels", 1))) if "height" in options else None
        self.videos: set[str] | None = None
        self.low, self.high, self.only = 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if column == "video_id" and values is not None:
                self.videos = values if self.videos is None else self.videos & values
            elif column == "frame_idx" and values is not None:
                self.only = values if self.only is None else self.only & values
            elif column == "frame_idx" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif column == "frame_idx" and isinstance(f, (LessThan, LessThanOrEqual)):
                stop = f.value + isinstance(f, LessThanOrEqual)
                self.high = stop if self.high is None else min(self.high, stop)
            else:
                yield f

    def partitions(self) -> list[FrameRange]:
        fs, base = opened(self.folder)
        found = fs.get_file_info(pafs.FileSelector(base, recursive=True))
        videos: dict[str, list[FrameFile]] = {}
        base = base.rstrip("/")
        for info in sorted((x for x in found if x.is_file), key=lambda x: natural(x.path)):
            inside = info.path[len(base) + 1 :]
            video = inside.split("/")[0] if "/" in inside else info.base_name.rpartition(".")[0]
            if self.videos is None or video in self.videos:
                file = described(fs, info, self.shape)
                if file is not None:
                    videos.setdefault(video, []).append(file)
        out = []
        for video, files in videos.items():
            shift = 0
            for file in files:
                if (file.height, file.width, file.channels) != (files[0].height, files[0].width, files[0].channels):
                    raise ValueError(f"{file.path}: frames of one video must have one shape")
                first, stop = max(self.low - shift, 0), file.n if self.high is None else min(self.high - shift, file.n)
                for at in range(first, stop, self.most):
                    end = min(at + self.most, stop)
                    if self.only is None or any(shift + at <= x < shift + end for x in self.only):
                        out.append(FrameRange(video, file, at, end, shift))
                shift += file.n
        return out

    def read(self, partition: FrameRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where no partition was planned
            return
        file = partition.file
        fs, _ = opened(self.folder)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        with fs.open_input_file(file.path) as f:
            for i in range(partition.first, partition.stop):
                if self.only is not None and partition.shift + i not in self.only:
                    continue
                block = f.read_at(file.step, i * file.step)
                if len(block) != file.step or not block.startswith(file.header):
                    raise ValueError(f"{file.path}: frame {i} is cut short or has another header")
                row = ([partition.video_id], [partition.shift + i], [file.height], [file.width], [file.channels], [block[len(file.header) :]])
                types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names)


class Frames(DataSource):
    """``spark.read.format("frames").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        if "path" not in self.options:
            raise ValueError("the folder of the frames is not given")
        return FrameReader(dict(self.options))


def read_frames(spark: SparkSession, folder: str, **options: str | int) -> DataFrame:
    """frames(video_id, frame_idx, height, width, channels, data) of a folder."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Frames)
    reader = spark.read.format("frames")
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(folder)


def write_frames(frames: DataFrame, folder: str) -> DataFrame:
    """Write each video as ``folder``/<video_id>/<n>.pgm or .ppm, a file for 256 frames of a video; (path, n) of the files."""
    slot = F.floor(F.col("frame_idx") / 256)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        fs, base = opened(folder)
        table = table.sort_by("frame_idx")
        video, number = key[0].as_py(), key[1].as_py()
        path = f"{base}/{video}/{number}.{'pgm' if table.column('channels')[0].as_py() == 1 else 'ppm'}"
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path, compression=None) as out:
            for h, w, c, data in zip(*(table.column(x) for x in ("height", "width", "channels", "data")), strict=True):
                out.write(b"P%d\n%d %d\n255\n" % (5 if c.as_py() == 1 else 6, w.as_py(), h.as_py()) + data.as_py())
        return pa.table({"path": [path], "n": [len(table)]})

    return frames.groupBy("video_id", slot.alias("slot")).applyInArrow(run, "path string, n long")


def scrolled(vectors: DataFrame, rows: int, blur: int = 2) -> DataFrame:
    """Frames from vectors (vec_id, label, embedding): a label is a video whose picture, its vectors one below the other, scrolls by a row each frame.

    Frame i shows vectors i to i + ``rows`` of its label in order of vec_id, each value
    averaged with ``blur`` neighbours on every side and scaled to 0..255. So everything in a
    frame is one pixel farther up than in the frame before. Frames are made in blocks of a
    label's vectors, each a group of bounded size with the vectors that its last frames show.
    """
    import numpy as np
    from pyspark.sql.window import Window

    known = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").select(F.col("label").cast("string").alias("video_id"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    ends = known.select(F.array_min("v").alias("a"), F.array_max("v").alias("b")).agg(F.min("a"), F.max("b")).first()
    low, scale = float(ends[0] or 0.0), 255.0 / max(float((ends[1] or 0.0) - (ends[0] or 0.0)), 1e-12)
    span, width = rows + 2 * blur, 2 * blur + 1
    numbered = known.withColumn("n", F.row_number().over(Window.partitionBy("video_id").orderBy("vec_id")) - 1)
    touched = F.sequence(F.greatest(F.floor((F.col("n") - (span - 1)) / _BLOCK), F.lit(0)), F.floor(F.col("n") / _BLOCK))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        first, vectors = (table.column("n")[0].as_py(), np.array(table.column("v").to_pylist(), float))
        shown = []
        for at in range(min(_BLOCK, len(vectors) - span + 1)):
            a = np.pad((vectors[at : at + span] - low) * scale, ((0, 0), (blur, blur)), mode="edge")
            a = np.lib.stride_tricks.sliding_window_view(a, (width, width)).mean((2, 3))
            shown.append(np.clip((a - 127.5) * width / 2 + 127.5, 0, 255).astype(np.uint8))
        n = len(shown)
        sides = [[a.shape[k] for a in shown] for k in (0, 1)]
        columns = ([table.column("video_id")[0].as_py()] * n, range(first, first + n), *sides, [1] * n, [a.tobytes() for a in shown])
        types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.table([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["video_id", "frame_idx", "height", "width", "channels", "data"])

    blocks = numbered.select("video_id", "n", "v", F.explode(touched).alias("block"))
    return blocks.groupBy("video_id", "block").applyInArrow(run, SCHEMA)
