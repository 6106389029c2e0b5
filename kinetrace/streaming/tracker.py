"""Point tracking over a stream of frames, as keyed state.

A video is a key. Its state is the tracker's recursion between two frames: a list of
the frames that a rewind can still reach (pictures, positions, violations, rewinds), a
list of frames that came before their turn, and where the recursion stands. Rewinds
happen inside the state, so a frame's row is emitted once no rewind can reach it, and
the rows are those of ``track.track_points`` however the stream is cut into batches.

Frames may come in any order. One that is missing holds its video up for ``patience``
seconds of processing time, after which the next one that has come takes its place (the
video goes on without it; numbers of frames stay their own). A frame that comes after it
was given up or a second time is left out. A row without data (null) ends its video: it
bears the number of frames; what is left is emitted and the state cleared. A video that
is silent for ``patience`` seconds is ended likewise, so its last rows come out.

Needs the RocksDB state store (``use_rocksdb``). Points are one image's and travel with
the processor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import ListState, StatefulProcessor, StatefulProcessorHandle

from kinetrace.operators.track import Recursion, Tracker, TrackerParams

_OUT = "video_id string, frame_idx long, point_id long, x double, y double, violation boolean"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _put(state: ListState, rows: list[tuple]) -> None:
    if rows:
        state.put(rows)
    else:
        state.clear()


class TrackProcessor(StatefulProcessor):
    """The recursion of each video between batches."""

    def __init__(self, ids: list[int], home: np.ndarray, params: TrackerParams, patience: float) -> None:
        self.ids, self.home, self.params, self.patience = ids, home, params, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", "k long, height int, width int, image binary, xy binary, bad binary, rewinds int")
        self.early = handle.getListState("early", "frame_idx long, height int, width int, channels int, data binary")
        self.names = handle.getListState("names", "k long, frame_idx long")
        self.stand = handle.getValueState("stand", "i long, newest long, first long, expected long, last long, at binary, frozen binary")
        self.tracker = Tracker(self.home, self.params)

    # ---- state ----------------------------------------------------------

    def _load(self) -> tuple[Recursion, dict[int, int], int, int | None]:
        going, names = Recursion(self.tracker), {}
        if not self.stand.exists():
            return going, names, 0, None
        going.i, going.newest, going.first, expected, last, at, frozen = self.stand.get()
        going.at, going.frozen = np.frombuffer(at).reshape(-1, 2).copy(), np.frombuffer(frozen, bool)
        for k, h, w, image, xy, bad, rewinds in self.ring.get():
            if image is not None:
                going.images[k] = np.frombuffer(image).reshape(h, w)
            if xy is not None:
                going.tracks[k] = np.frombuffer(xy).reshape(-1, 2).copy()
            if bad is not None:
                going.bad[k] = np.frombuffer(bad, bool)
            if rewinds:
                going.rewinds[k] = rewinds
        names = dict(self.names.get())
        return going, names, expected, last

    def _save(self, going: Recursion, names: dict[int, int], expected: int, last: int | None) -> None:
        keys = sorted({*going.images, *going.tracks, *going.bad, *going.rewinds})
        rows = []
        for k in keys:
            image, xy, bad = going.images.get(k), going.tracks.get(k), going.bad.get(k)
            shape = image.shape if image is not None else (0, 0)
            rows.append((k, *shape, *(None if x is None else x.tobytes() for x in (image, xy, bad)), going.rewinds.get(k, 0)))
        _put(self.ring, rows)
        _put(self.names, sorted(names.items()))
        self.stand.update((going.i, going.newest, going.first, expected, last, going.at.tobytes(), going.frozen.tobytes()))

    # ---- batches --------------------------------------------------------

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting = {f: (h, w, c, d) for f, h, w, c, d in self.early.get()} if self.early.exists() else {}
        going, names, expected, last = self._load()
        for part in rows:
            for f, h, w, c, d in part[["frame_idx", "height", "width", "channels", "data"]].itertuples(index=False):
                if d is None or d is pd.NA or (isinstance(d, float) and d != d):
                    last = int(f)
                elif f >= expected:
                    waiting.setdefault(int(f), (int(h), int(w), int(c), bytes(d)))
        yield from self._advance(key, timerValues, waiting, going, names, expected, last, skip=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.stand.exists():
            return
        waiting = {f: (h, w, c, d) for f, h, w, c, d in self.early.get()} if self.early.exists() else {}
        going, names, expected, last = self._load()
        if not waiting and last is None:
            last = expected  # silent for too long
        yield from self._advance(key, timerValues, waiting, going, names, expected, last, skip=True)

    def _advance(self, key, timers, waiting: dict, going: Recursion, names: dict[int, int], expected: int, last: int | None, skip: bool) -> Iterator[pd.DataFrame]:
        done = []
        while waiting and (expected in waiting or skip):
            expected = min(waiting)
            h, w, c, data = waiting.pop(expected)
            names[going.newest + 1] = expected
            done += going.push(np.frombuffer(data, np.uint8).reshape(h, w, c))
            expected += 1
            skip = skip and last is not None  # after its end a video waits for nothing
        over = last is not None and not waiting and expected >= last
        if over:
            done += going.rest()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if over:
            self.ring.clear()
            self.early.clear()
            self.names.clear()
            self.stand.clear()
        else:
            _put(self.early, [(f, *x) for f, x in sorted(waiting.items())])
            self._save(going, {k: v for k, v in names.items() if k >= going.first}, expected, last)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + int(self.patience * 1000))
        for k, xy, bad in done:
            yield pd.DataFrame({"video_id": key[0], "frame_idx": names[k], "point_id": self.ids, "x": xy[:, 0], "y": xy[:, 1], "violation": bad})

    def close(self) -> None:
        pass


def tracked_stream(frames: DataFrame, points: DataFrame, params: TrackerParams | None = None, patience: float = 60.0) -> DataFrame:
    """(video_id, frame_idx, point_id, x, y, violation) of a stream of frames, as they are settled."""
    rows = points.orderBy("point_id").select("point_id", "x0", "y0").collect()  # one image's points
    ids, home = [r[0] for r in rows], np.array([r[1:] for r in rows], float).reshape(len(rows), 2)
    processor = TrackProcessor(ids, home, params or TrackerParams(), patience)
    return frames.groupBy("video_id").transformWithStateInPandas(processor, _OUT, "Append", "ProcessingTime")
