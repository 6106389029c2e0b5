"""Point tracking by optical flow with a mesh, and simple per-series filters.

Tracking is a recursion over a video's frames, with rewinds, so a video stays in one
task. Its frames pass through in order, an Arrow batch at a time; only the frames that
a rewind can reach stay in memory, however long the video is.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.operators.align import framed, sampled_framed, sampled_together


@dataclass(frozen=True)
class TrackerParams:
    """What a tracker may be told; names follow the behaviour, all have defaults."""

    window: int = 9
    levels: int = 3
    iterations: int = 12
    neighbours: int = 8
    rigidity: float = 0.02
    relaxation: float = 0.002
    threshold: float = 25.0
    before: int = 3
    after: int = 3
    #: Rewinds to one frame before its violations are let stand.
    most_rewinds: int = 3


def _half(a: np.ndarray) -> np.ndarray:
    h, w = a.shape[0] // 2 * 2, a.shape[1] // 2 * 2
    a = a[:h, :w]
    return (a[::2, ::2] + a[1::2, ::2] + a[::2, 1::2] + a[1::2, 1::2]) / 4


def pyramid(a: np.ndarray, levels: int) -> list[np.ndarray]:
    out = [a.astype(float)]
    for _ in range(levels - 1):
        if min(out[-1].shape) < 16:
            break
        out.append(_half(out[-1]))
    return out


def lucas_kanade(previous: np.ndarray, current: np.ndarray, points: np.ndarray, window: int = 9, levels: int = 3, iterations: int = 12) -> np.ndarray:
    """New positions of points (n, 2) as (x, y): iterative Lucas-Kanade from the coarsest level down."""
    a, b = pyramid(previous, levels), pyramid(current, levels)
    side = np.arange(-(window // 2), window // 2 + 1, dtype=float)
    shift = np.zeros_like(points, dtype=float)
    for level in range(len(a) - 1, -1, -1):
        p = points / 2**level
        x, y = p[:, 0, None, None] + side, p[:, 1, None, None] + side[:, None]
        gy, gx = np.gradient(a[level])
        ix, iy, it = sampled_together([gx, gy, a[level]], x, y)
        xx, xy, yy = (ix * ix).sum((1, 2)), (ix * iy).sum((1, 2)), (iy * iy).sum((1, 2))
        det = xx * yy - xy * xy
        ok = det > 1e-6 * np.maximum(xx + yy, 1e-9) ** 2
        divisor, still, target = np.where(ok, det, 1), ~ok, framed(b[level])
        for _ in range(iterations):
            e = it - sampled_framed([target], x + shift[:, 0, None, None], y + shift[:, 1, None, None])[0]
            ex, ey = (e * ix).sum((1, 2)), (e * iy).sum((1, 2))
            step = np.empty_like(shift)
            step[:, 0], step[:, 1] = (yy * ex - xy * ey) / divisor, (xx * ey - xy * ex) / divisor
            step[still] = 0
            shift = shift + step
            if np.abs(step).max(initial=0) < 0.01:
                break
        if level:
            shift *= 2
    return points + shift


def nearest(points: np.ndarray, k: int) -> np.ndarray:
    """The k nearest points of each, itself among them, ties by index."""
    d = ((points[:, None, :] - points[None, :, :]) ** 2).sum(-1)
    return np.argsort(d, axis=1, kind="stable")[:, : min(k, len(points))]


class Tracker:
    """The tracking recursion of one video."""

    def __init__(self, home: np.ndarray, params: TrackerParams, mask: np.ndarray | None = None) -> None:
        self.home, self.p, self.mask = home.astype(float), params, mask
        self.near = nearest(self.home, params.neighbours)
        self.rest = (self.home[:, None, :] - self.home[self.near]).mean(1)

    def image(self, frame: np.ndarray) -> np.ndarray:
        """Mean over channels, cut to whole numbers, times the mask."""
        grey = np.trunc(frame.mean(axis=-1)) if frame.ndim == 3 else frame.astype(float)
        return grey if self.mask is None else grey * self.mask

    def step(self, previous: np.ndarray, current: np.ndarray, at: np.ndarray, frozen: np.ndarray) -> np.ndarray:
        new = lucas_kanade(previous, current, at, self.p.window, self.p.levels, self.p.iterations)
        new[frozen] = at[frozen]
        new = new - self.p.rigidity * ((new[:, None, :] - new[self.near]).mean(1) - self.rest)
        return new - self.p.relaxation * (new - self.home)

    def stream(self, frames: Iterable[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(frame, positions [P, 2], violations [P]) in order, each once no rewind can reach it any more."""
        going = Recursion(self)
        for frame in frames:
            yield from going.push(frame)
        yield from going.rest()

    def run(self, frames: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Positions [T, P, 2] and violations [T, P] of all frames."""
        rows = list(self.stream(frames))
        return np.array([r[1] for r in rows]).reshape(len(rows), len(self.home), 2), np.array([r[2] for r in rows], bool).reshape(len(rows), len(self.home))


class Recursion:
    """A video's tracking so far: takes frames one by one, and can be taken apart and put together between two of them.

    Only the last ``reach`` frames are held: a rewind goes back no farther than that
    from the newest frame, and at most ``most_rewinds`` times from one frame.
    """

    def __init__(self, tracker: Tracker) -> None:
        self.tracker, self.p = tracker, tracker.p
        self.reach = self.p.before * (self.p.most_rewinds + 1) + 1
        self.images: dict[int, np.ndarray] = {}
        self.tracks: dict[int, np.ndarray] = {}
        self.bad: dict[int, np.ndarray] = {}
        self.rewinds: dict[int, int] = {}
        self.none = np.zeros(len(tracker.home), bool)
        self.at, self.frozen = tracker.home.copy(), self.none
        self.i, self.newest, self.first = 0, -1, 0

    def push(self, frame: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Take the next frame; yields what no rewind can reach any more."""
        self.newest += 1
        self.images[self.newest] = self.tracker.image(frame)
        while self.first < self.newest - self.reach:
            k = self.first
            yield k, self.tracks.pop(k), self.bad.pop(k, self.none)
            self.images.pop(k - 1, None)
            self.rewinds.pop(k, None)
            self.first += 1
        while self.i <= self.newest:
            self._step()

    def _step(self) -> None:
        i, p = self.i, self.p
        self.at = self.tracker.step(self.images[max(i - 1, 0)], self.images[i], self.at, self.frozen)
        self.tracks[i] = self.at
        far = np.linalg.norm(self.at - self.tracker.home, axis=1) > p.threshold
        if far.any():
            hit = far.copy()
            hit[np.unique(self.tracker.near[far])] = True
            for k in range(max(i - p.before, self.first), i + p.after):
                self.bad[k] = self.bad.get(k, self.none) | hit
            if self.rewinds.get(i, 0) < p.most_rewinds:
                self.rewinds[i] = self.rewinds.get(i, 0) + 1
                self.i = max(i - p.before, self.first)
                self.at, self.frozen = self.tracks[self.i].copy(), self.bad.get(self.i, self.none)
                return
        self.frozen = self.bad.get(i, self.none)
        self.i += 1

    def rest(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for k in range(self.first, self.newest + 1):
            yield k, self.tracks[k], self.bad.get(k, self.none)


def track_points(frames: DataFrame, points: DataFrame, params: TrackerParams | None = None, contiguous: bool = False) -> DataFrame:
    """(video_id, frame_idx, point_id, x, y, violation): each video by itself, or all as one sequence.

    ``frames``: (video_id, frame_idx, height, width, channels, data). A video's frames
    come to one task in order and pass through; points are one image's, collected and
    sent along.
    """
    params = params or TrackerParams()
    rows = points.orderBy("point_id").select("point_id", "x0", "y0").collect()
    ids, home = [r[0] for r in rows], np.array([r[1:] for r in rows], float).reshape(len(rows), 2)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for p in parts for r in p.itertuples(index=False))
        for _, video in groupby(rows, key=lambda r: None if contiguous else r.video_id):
            names: deque[tuple[str, int]] = deque()

            def images(video=video, names=names) -> Iterator[np.ndarray]:
                for r in video:
                    names.append((r.video_id, r.frame_idx))
                    yield np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)

            settled = Tracker(home, params).stream(images())
            while block := list(islice(settled, _BLOCK)):  # a table for every frame costs time
                of = [names.popleft() for _ in block]
                xy, bad = np.concatenate([r[1] for r in block]), np.concatenate([r[2] for r in block])
                video_id, frame = (np.repeat(np.array(c, object), len(ids)) for c in zip(*of, strict=True))
                yield pd.DataFrame({"video_id": video_id, "frame_idx": frame.astype(int), "point_id": ids * len(block), "x": xy[:, 0], "y": xy[:, 1], "violation": bad})

    dealt = frames.repartition(1) if contiguous else _dealt(frames)
    ordered = dealt.sortWithinPartitions("video_id", "frame_idx")
    return ordered.mapInPandas(run, "video_id string, frame_idx long, point_id long, x double, y double, violation boolean")


#: Frames whose positions a task gives out together.
_BLOCK = 256
#: Videos for each partition that are dealt by their length; all others go by hash.
_LARGEST = 4


def _dealt(frames: DataFrame) -> DataFrame:
    """Frames by video over all shuffle partitions; the longest videos go one to a partition, there and back again.

    Time goes by a task's frames, and few videos dealt by hash often meet. Partitions are
    numbered, since Spark would merge them for their few bytes. Frames are read twice.
    """
    spark = frames.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    longest = frames.where("video_id IS NOT NULL").groupBy("video_id").count().orderBy(F.desc("count"), "video_id").limit(_LARGEST * parts).collect()
    turn = [*range(parts), *reversed(range(parts))]
    slots = spark.createDataFrame([(r["video_id"], turn[i % len(turn)]) for i, r in enumerate(longest)], "video_id string, _slot int")
    by_hash = F.pmod(F.hash("video_id"), F.lit(parts))
    numbered = frames.join(F.broadcast(slots), "video_id", "left").withColumn("_slot", F.coalesce("_slot", by_hash))
    return numbered.repartitionById(parts, F.col("_slot")).drop("_slot")


def blob_frames(spark: SparkSession, videos: int = 2, n: int = 12, size: int = 48) -> DataFrame:
    """Synthetic frames: Gaussian blobs that circle with a known motion."""

    def run(parts):
        for p in parts:
            out = []
            for v, i in zip(p["video"], p["frame_idx"], strict=True):
                y, x = np.mgrid[:size, :size]
                a = np.zeros((size, size))
                for cx, cy in ((16, 16), (32, 16), (16, 32), (32, 32)):
                    mx, my = cx + 3 * np.sin(2 * np.pi * i / n + v) - 3 * np.sin(v), cy + 3 * np.cos(2 * np.pi * i / n + v) - 3 * np.cos(v)
                    a += 200 * np.exp(-((x - mx) ** 2 + (y - my) ** 2) / 18)
                out.append(np.repeat(np.clip(a, 0, 255).astype(np.uint8)[:, :, None], 3, axis=2).tobytes())
            yield pd.DataFrame({"video_id": [f"v{v}" for v in p["video"]], "frame_idx": p["frame_idx"], "height": size, "width": size, "channels": 3, "data": out})

    ids = spark.range(videos * n).select(F.floor(F.col("id") / n).alias("video"), (F.col("id") % n).alias("frame_idx"))
    return ids.mapInPandas(run, "video_id string, frame_idx long, height int, width int, channels int, data binary")


def kalman(tracks: DataFrame, q: float = 1e-2, r: float = 1.0) -> DataFrame:
    """Constant-velocity Kalman filter of every point's (x, y): correct, then predict."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("frame_idx")
        f, h = np.eye(4), np.eye(2, 4)
        f[0, 2] = f[1, 3] = 1
        z = p[["x", "y"]].to_numpy()
        s, c = np.array([*z[0], 0, 0]), np.eye(4)
        out = []
        for m in z:
            g = c @ h.T @ np.linalg.inv(h @ c @ h.T + r * np.eye(2))
            s, c = s + g @ (m - h @ s), (np.eye(4) - g @ h) @ c
            out.append(s[:2].copy())
            s, c = f @ s, f @ c @ f.T + q * np.eye(4)
        out = np.array(out)
        return pd.DataFrame({"video_id": p["video_id"], "point_id": p["point_id"], "frame_idx": p["frame_idx"], "x": out[:, 0], "y": out[:, 1]})

    return tracks.groupBy("video_id", "point_id").applyInPandas(run, "video_id string, point_id int, frame_idx long, x double, y double")
