"""Tracks as streams: pooled windows with late data, and the leaky integrator as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def pooled_stream(events: DataFrame, window: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Mean and count per video, point and window of (ts, video_id, point_id, value); data later than ``late`` is left out."""
    at = F.window("ts", window, slide) if slide else F.window("ts", window)
    pooled = events.withWatermark("ts", late).groupBy(at.alias("w"), "video_id", "point_id").agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    return pooled.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "video_id", "point_id", "value", "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Bursts of a point's events with no pause over ``gap``."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "video_id", "point_id").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "video_id", "point_id", "n", "value")


def relaxed_stream(steps: DataFrame, rate: float) -> DataFrame:
    """p = (1 - rate) (p + step) per point of (video_id, point_id, frame_idx, step), in order of frames within each batch."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(parts)).sort_values("frame_idx")
        out = []
        for s in rows["step"]:
            p = (p + s) * (1 - rate)
            out.append(p)
        state.update((p,))
        yield pd.DataFrame({"video_id": key[0], "point_id": key[1], "frame_idx": rows["frame_idx"].to_numpy(), "p": out})

    return steps.groupBy("video_id", "point_id").applyInPandasWithState(
        fold, "video_id string, point_id int, frame_idx long, p double", "p double", "append", GroupStateTimeout.NoTimeout
    )
