"""Variable-Q spectrograms: taps, convolution, pooling and normalisation.

The same transform has two forms. The relational one joins a series with its taps and
sums; an engine without arrays can check it. The packed one has a series per row and
convolves whole blocks of output in numpy, inside an Arrow function; both give the
same numbers. Taps are small and go along with the plan or the function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def log_spaced(low: float, high: float, n: int) -> np.ndarray:
    return low * (high / low) ** (np.arange(n) / max(n - 1, 1))


def analytic(taps: np.ndarray) -> np.ndarray:
    """The analytic signal along the last axis: negative frequencies removed, positive ones doubled."""
    n = taps.shape[-1]
    keep = np.zeros(n)
    keep[0] = 1
    keep[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        keep[n // 2] = 1
    return np.fft.ifft(np.fft.fft(taps) * keep)


def make_taps(
    fs: float, f_low: float, f_high: float, bins: int, width: int, q_low: float, q_high: float, side: str = "center", taper: bool = True, centred: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Complex taps [bins, width] with unit sums of absolute values, and their frequencies.

    Each bin is a cosine under a Gaussian whose width falls with frequency; ``width`` is
    odd. By default the Gaussian's centre is one sample after the cosine's, as known
    recordings have it; ``centred`` puts both in the middle. One-sided windows keep the
    left or right half, with the centre sample halved if ``taper``.
    """
    if width % 2 == 0:
        raise ValueError("the number of taps must be odd")
    hz = log_spaced(f_low, f_high, bins)
    sigma = log_spaced(q_low, q_high, bins) * (fs / hz) / 4
    place = np.arange(width) - (width - 1) // 2 - (0 if centred else 1)
    bell = np.exp(-((place[None, :] / sigma[:, None]) ** 2) / 2) / (np.sqrt(2 * np.pi) * sigma[:, None])
    half = width // 2
    if side == "left":
        bell[:, half + 1 :] = 0
    elif side == "right":
        bell[:, :half] = 0
    elif side != "center":
        raise ValueError("side is center, left or right")
    if side != "center" and taper:
        bell[:, half] *= 0.5
    wave = np.cos(np.linspace(-np.pi, np.pi, width)[None, :] * (hz * width / fs)[:, None])
    h = analytic(bell * wave)
    return h / np.abs(h).sum(axis=1, keepdims=True), hz


def simple_taps(bins: int, width: int, f_low: float, f_high: float) -> np.ndarray:
    """Real and imaginary parts of plain Gabor taps, rounded so that any engine has the same."""
    k = np.arange(width) - (width - 1) / 2
    hz = log_spaced(f_low, f_high, bins)
    bell = np.exp(-((k / (width / 6)) ** 2) / 2)
    taps = bell[None, :] * np.exp(-2j * np.pi * hz[:, None] * k[None, :])
    return np.round(taps / np.abs(taps).sum(axis=1, keepdims=True), 6)


def taps_table(spark: SparkSession, taps: np.ndarray) -> DataFrame:
    """taps(f_idx, k, re, im)."""
    rows = [(f, k, float(z.real), float(z.imag)) for f, row in enumerate(taps) for k, z in enumerate(row)]
    return spark.createDataFrame(rows, "f_idx int, k int, re double, im double")


def convolved(traces: DataFrame, taps: DataFrame, width: int, n: int) -> DataFrame:
    """Cross-correlation with the real part and minus the imaginary part, full overlaps only: y[o] = sum x[o + k] (re - i im)."""
    keys = ["video_id", "axis", "point_id"]
    spread = traces.join(F.broadcast(taps), F.lit(True)).withColumn("o", F.col("t") - F.col("k")).where((F.col("o") >= 0) & (F.col("o") <= n - width))
    return spread.groupBy(*keys, "f_idx", "o").agg(F.sum(F.col("d") * F.col("re")).alias("re"), (-F.sum(F.col("d") * F.col("im"))).alias("im"))


def pooled(df: DataFrame, keys: list[str], time: str, values: list[str], by: int) -> DataFrame:
    """Means over blocks of ``by`` samples; the last block has what there is."""
    return df.groupBy(*keys, F.floor(F.col(time) / by).alias("t_ds")).agg(*[F.avg(v).alias(v) for v in values])


def power(spectrogram: DataFrame, exponent: float = 1.0) -> DataFrame:
    """Per video and time the sum over frequencies, averaged over channels."""
    channel = spectrogram.groupBy("video_id", "t_ds", "axis", "point_id").agg(F.sum(F.pow("value", F.lit(exponent))).alias("p"))
    return channel.groupBy("video_id", "t_ds").agg(F.avg("p").alias("m"))


def normalised(spectrogram: DataFrame, hz: list[float], alpha: float = 0.95, exponent: float = 1.0, gamma: float = 0.5) -> DataFrame:
    """s^p / (alpha m(t) + 1 - alpha) * f^gamma; m is taken before the frequency correction."""
    m = power(spectrogram, exponent)
    scale = F.get(F.array(*[F.lit(float(x) ** gamma) for x in hz]), F.col("f_idx"))
    out = F.pow("value", F.lit(exponent)) / (alpha * F.col("m") + (1 - alpha)) * scale
    return spectrogram.join(m, ["video_id", "t_ds"]).select("video_id", "axis", "point_id", "f_idx", "t_ds", out.alias("value"))


def normalised_complex(spectrogram: DataFrame, hz: list[float], alpha: float = 0.95, exponent: float = 1.0, gamma: float = 0.5) -> DataFrame:
    """The same for (re, im), which keep their phase."""
    size = F.hypot("re", "im")
    flat = normalised(spectrogram.select("video_id", "axis", "point_id", "f_idx", "t_ds", size.alias("value")), hz, alpha, exponent, gamma)
    both = spectrogram.join(flat, ["video_id", "axis", "point_id", "f_idx", "t_ds"])
    part = lambda c: F.when(size > 0, F.col(c) / size * F.col("value")).otherwise(0.0)
    return both.select("video_id", "axis", "point_id", "f_idx", "t_ds", part("re").alias("re"), part("im").alias("im"))


def packed(traces: DataFrame) -> DataFrame:
    """channels(video_id, axis, point_id, series): one row a series, in order of time."""
    rows = traces.groupBy("video_id", "axis", "point_id").agg(F.array_sort(F.collect_list(F.struct("t", "d"))).alias("s"))
    return rows.select("video_id", "axis", "point_id", F.transform("s", lambda x: x["d"]).alias("series"))


def spectrum(series: np.ndarray, taps: np.ndarray, by: int, padding: str = "valid", as_complex: bool = False, block: int = 1 << 16) -> np.ndarray:
    """[bins, time] of one series; output is made ``block`` samples at a time, so memory stays bounded."""
    bins, width = taps.shape
    if padding == "same":
        series = np.pad(series, ((width - 1) // 2, width // 2))
    n = len(series) - width + 1
    if n <= 0:
        return np.zeros((bins, 0), complex if as_complex else float)
    out = []
    block = max(by, block // by * by)
    for at in range(0, n, block):
        windows = np.lib.stride_tricks.sliding_window_view(series[at : at + block + width - 1], width)
        y = np.conj(taps) @ windows.T
        y = y if as_complex else np.abs(y)
        ends = np.arange(0, y.shape[1], by)
        out.append(np.add.reduceat(y, ends, axis=1) / np.diff(np.append(ends, y.shape[1])))
    return np.concatenate(out, axis=1)


def vqt(channels: DataFrame, taps: np.ndarray, by: int, padding: str = "valid", as_complex: bool = False) -> DataFrame:
    """spectrogram(video_id, axis, point_id, f_idx, t_ds, value) from packed channels; complex ones have (re, im) for the value."""
    shared = channels.sparkSession.sparkContext.broadcast(taps)
    values = ["re", "im"] if as_complex else ["value"]
    names = ["video_id", "axis", "point_id", "f_idx", "t_ds", *values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                y = spectrum(np.asarray(batch.column(3)[i].values, float), shared.value, by, padding, as_complex)
                f, t = np.indices(y.shape)
                head = [pa.array([batch.column(c)[i].as_py()] * y.size, batch.schema.types[c]) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*head, pa.array(f.ravel().astype(np.int32)), pa.array(t.ravel().astype(np.int64)), *[pa.array(v.ravel()) for v in ((y.real, y.imag) if as_complex else (y,))]], names)

    return channels.mapInArrow(run, f"video_id string, axis int, point_id int, f_idx int, t_ds long, {', '.join(f'{v} double' for v in values)}")


def overlap_saved(traces: DataFrame, taps: np.ndarray, by: int, padding: str = "valid", as_complex: bool = False, block: int = 4096) -> DataFrame:
    """The same spectrogram from traces (video_id, axis, point_id, t, d), by overlap-save: no series is one row.

    A row is a block of about ``block`` output samples (whole pools) with the samples that its
    outputs overlap; one FFT of it serves all bins. ``valid``: outputs with full overlaps,
    at the time of their first sample; ``same``: an output for every sample, at its own time,
    zeros beyond the ends. Samples of one moment add up, null ones and missing moments are
    zeros (missing ones have no ``same`` output).
    """
    if padding not in ("valid", "same"):
        raise ValueError("padding is valid or same")
    width, keys = taps.shape[1], ["video_id", "axis", "point_id"]
    left = (width - 1) // 2 if padding == "same" else 0
    right, size = width - 1 - left, by * -(-block // by)
    n = 1 << (size + width - 2).bit_length()
    shared = traces.sparkSession.sparkContext.broadcast(np.conj(np.fft.fft(taps, n)))
    reached = F.sequence(F.floor((F.col("t") - right) / size), F.floor((F.col("t") + left) / size))
    spread = traces.select(*keys, F.col("t").cast("long").alias("t"), "d").select(*keys, "t", "d", F.explode(reached).alias("block"))
    blocks = spread.groupBy(*keys, "block").agg(F.collect_list(F.struct("t", F.coalesce("d", F.lit(0.0)).alias("d"))).alias("s")).select(*keys, "block", "s.t", "s.d")
    values = ["re", "im"] if as_complex else ["value"]
    names = [*keys, "f_idx", "t_ds", *values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                first = batch.column(3)[i].as_py() * size - left
                t = np.asarray(batch.column(4)[i].values) - first
                x = np.bincount(t, weights=np.asarray(batch.column(5)[i].values, float), minlength=size + width - 1)
                y = np.fft.ifft(np.fft.fft(x, n) * shared.value)[:, :size]
                own = np.zeros(size, bool)
                if padding == "same":
                    own[t[(t >= left) & (t < left + size)] - left] = True
                else:
                    own[max(int(t.min()), 0) : max(int(t.max()) - width + 2, 0)] = True
                counts = np.add.reduceat(own, np.arange(0, size, by)).astype(int)
                pools = np.flatnonzero(counts)
                if not len(pools):
                    continue
                y = np.where(own, y if as_complex else np.abs(y), 0)
                pooled = np.add.reduceat(y, np.arange(0, size, by), axis=1)[:, pools] / counts[pools]
                f, at = np.indices(pooled.shape)
                head = [pa.array([batch.column(c)[i].as_py()] * pooled.size, batch.schema.types[c]) for c in range(3)]
                t_ds = pools[at.ravel()] + batch.column(3)[i].as_py() * (size // by)
                yield pa.RecordBatch.from_arrays([*head, pa.array(f.ravel().astype(np.int32)), pa.array(t_ds.astype(np.int64)), *[pa.array(v.ravel()) for v in ((pooled.real, pooled.imag) if as_complex else (pooled,))]], names)

    kinds = dict(traces.dtypes)
    return blocks.mapInArrow(run, f"{', '.join(f'{k} {kinds[k]}' for k in keys)}, f_idx int, t_ds long, {', '.join(f'{v} double' for v in values)}")


def time_axis(spark: SparkSession, n: int, width: int, by: int) -> DataFrame:
    """(t_ds, sample): the mean centre of the samples in each block, full overlaps only."""
    o = spark.range(n - width + 1).select(F.col("id").alias("o"))
    return o.groupBy(F.floor(F.col("o") / by).alias("t_ds")).agg((F.avg("o") + (width - 1) / 2).alias("sample"))


def time_axes(videos: DataFrame, width: int, by: int) -> DataFrame:
    """(video_id, t_ds, sample): the same axis for every video, from its own number of frames; none where a video is shorter than the taps."""
    last = (F.col("num_frames") - width).cast("long")
    bins = videos.where(last >= 0).select("video_id", last.alias("_l"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / by))).alias("t_ds"))
    return bins.select("video_id", "t_ds", ((F.col("t_ds") * by + F.least(F.col("t_ds") * by + by - 1, F.col("_l"))) / 2 + (width - 1) / 2).alias("sample"))


def size_estimate(videos: DataFrame, points: int, bins: int, width: int, by: int, itemsize: int = 4) -> DataFrame:
    """Gigabytes of each video's spectrogram."""
    frames: Column = F.floor((F.col("num_frames") - width) / by + 1)
    return videos.select("video_id", (2 * bins * points * frames * itemsize / 1e9).alias("gb"))


def convolved_2d(image: DataFrame, kernel: DataFrame, height: int, width: int, k_height: int, k_width: int, mode: str = "same") -> DataFrame:
    """Two-dimensional convolution as a join with the kernel's taps: full, same or valid."""
    k = kernel.select(F.col("y").alias("ky"), F.col("x").alias("kx"), F.col("value").alias("kv"))
    out = image.join(F.broadcast(k), F.lit(True)).groupBy((F.col("y") + F.col("ky")).alias("y"), (F.col("x") + F.col("kx")).alias("x")).agg(F.sum(F.col("value") * F.col("kv")).alias("value"))
    if mode == "full":
        return out
    if mode == "same":
        top, left, bottom, right = (k_height - 1) // 2, (k_width - 1) // 2, height, width
    elif mode == "valid":
        top, left, bottom, right = k_height - 1, k_width - 1, height - k_height + 1, width - k_width + 1
    else:
        raise ValueError("mode is full, same or valid")
    inside = (F.col("y") >= top) & (F.col("y") < top + bottom) & (F.col("x") >= left) & (F.col("x") < left + right)
    return out.where(inside).select((F.col("y") - top).alias("y"), (F.col("x") - left).alias("x"), "value")
