"""Frames, spectra and log-mel features of sampled signals.

Samples come as rows ``(signal_id, sample_ix, sample)`` with ``sample_ix``
counting from 0. A signal is cut into blocks of whole hops; a block also gets the
few samples its last frame reaches into, so a long signal spreads over tasks and
only those samples are sent twice. Frames are made inside a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import audio
from leafmill.functions.audio import FFT, HOP, LOG_FLOOR, MELS, SAMPLE_RATE, WINDOW, mel_filterbank

BLOCK_SAMPLES = 65_536


def signal_lengths(samples: DataFrame) -> DataFrame:
    """Samples, seconds and rejection of each signal (too long or too short)."""
    sizes = samples.groupBy("signal_id").agg(F.count(F.lit(1)).alias("samples"))
    return with_reject_reason(sizes, WINDOW)


def with_reject_reason(
    sizes: DataFrame, window: int, rate: int = SAMPLE_RATE, limit: float = audio.MAX_SECONDS
) -> DataFrame:
    seconds = audio.duration_seconds(F.col("samples"), rate)
    reason = F.when(F.col("samples") < window, "too short").when(seconds > limit, "too long")
    return sizes.withColumns({"seconds": seconds, "reject_reason": reason})


def frame_starts(sizes: DataFrame, window: int = WINDOW, hop: int = HOP) -> DataFrame:
    """Frames of each signal with its first sample; signals below a window have none."""
    count = F.floor((F.col("samples") - window) / hop) + 1
    usable = sizes.filter(F.col("samples") >= window)
    return usable.select(
        "signal_id", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("frame")
    ).withColumn("start", F.col("frame") * hop)


def _blocks(samples: DataFrame, window: int, hop: int, block: int) -> DataFrame:
    """Sorted samples per (signal, block), each block with the reach of its last frame."""
    size = max(block // hop, 1) * hop
    home = F.floor(F.col("sample_ix") / size)
    # Sample s lies in the reach of earlier block b while s < (b + 1) * size - hop + window.
    back = -(-(window - hop) // size) if window > hop else 0
    homes = F.filter(
        F.sequence(F.greatest(home - back, F.lit(0)), home),
        lambda b: F.col("sample_ix") < (b + 1) * size - hop + window,
    )
    placed = samples.withColumn("block", F.explode(homes))
    rows = F.sort_array(F.collect_list(F.struct("sample_ix", F.col("sample").cast("double").alias("v"))))
    return placed.groupBy("signal_id", "block").agg(rows.alias("_s")).select(
        "signal_id", "block", F.lit(size).alias("size"), F.col("_s.v").alias("samples")
    )


def _frames(values: np.ndarray, size: int, window: int, hop: int) -> np.ndarray:
    """Windowed frames that start inside a block, one per row."""
    if len(values) < window:
        return np.empty((0, window))
    frames = np.lib.stride_tricks.sliding_window_view(values, window)[::hop][: size // hop]
    weights = 0.5 * (1.0 - np.cos(2.0 * np.pi * np.arange(window) / window))
    return frames * weights


def _per_frame(
    samples: DataFrame, window: int, hop: int, block: int, work: Callable[[np.ndarray], np.ndarray]
) -> DataFrame:
    """``(signal_id, frame, values)`` with ``work`` applied to a block's frames."""
    blocks = _blocks(samples, window, hop, block)
    id_type = samples.schema["signal_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                frames = _frames(np.asarray(row.samples), row.size, window, hop)
                if len(frames):
                    first = row.block * (row.size // hop)
                    yield pd.DataFrame(
                        {
                            "signal_id": row.signal_id,
                            "frame": first + np.arange(len(frames)),
                            "values": list(work(frames)),
                        }
                    )

    return blocks.mapInPandas(run, f"signal_id {id_type}, frame long, values array<double>")


def _magnitudes(n_fft: int) -> Callable[[np.ndarray], np.ndarray]:
    def work(frames: np.ndarray) -> np.ndarray:
        points = max(n_fft, frames.shape[1])
        return np.abs(np.fft.rfft(frames, n=points))[:, : n_fft // 2 + 1]

    return work


def spectrum(
    samples: DataFrame, window: int = WINDOW, hop: int = HOP, n_fft: int = FFT,
    block: int = BLOCK_SAMPLES,
) -> DataFrame:
    """Magnitudes ``(signal_id, frame, bin, magnitude)``, bins 0 to half the FFT size."""
    frames = _per_frame(samples, window, hop, block, _magnitudes(n_fft))
    return frames.select("signal_id", "frame", F.posexplode("values").alias("bin", "magnitude"))


def log_mel(
    samples: DataFrame,
    rate: int = SAMPLE_RATE,
    window: int = WINDOW,
    hop: int = HOP,
    n_mels: int = MELS,
    n_fft: int = FFT,
    block: int = BLOCK_SAMPLES,
) -> DataFrame:
    """Log-mel features ``(signal_id, frame, mel, value)``.

    The filterbank goes to the tasks as a matrix; its size is fixed by the
    parameters.
    """
    bank = np.zeros((n_fft // 2 + 1, n_mels))
    for row in mel_filterbank(samples.sparkSession, rate, n_fft, n_mels).collect():
        bank[row["bin"], row["mel"]] = row["weight"]
    magnitudes = _magnitudes(n_fft)

    def work(frames: np.ndarray) -> np.ndarray:
        return np.log(magnitudes(frames) ** 2 @ bank + LOG_FLOOR)

    frames = _per_frame(samples, window, hop, block, work)
    return frames.select("signal_id", "frame", F.posexplode("values").alias("mel", "value"))


def normalised(features: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Adds ``normalised``: zero mean and unit deviation within ``keys``.

    The statistics are one aggregate row per key, joined back, so a speaker with
    most of the frames is never gathered. A key without spread gives 0.
    """
    stats = features.groupBy(*keys).agg(
        F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std")
    )
    spread = (F.col(value) - F.col("_mean")) / F.col("_std")
    return (
        features.join(stats, keys)
        .withColumn("normalised", F.when(F.col("_std") > 0, spread).otherwise(F.lit(0.0)))
        .drop("_mean", "_std")
    )


def min_max_table(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``scaled``: value moved to [0, 1] within ``keys``; as is if all are equal."""
    edges = df.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    moved = (F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low"))
    return (
        df.join(edges, keys)
        .withColumn("scaled", F.when(F.col("_high") == F.col("_low"), F.col(value)).otherwise(moved))
        .drop("_low", "_high")
    )
