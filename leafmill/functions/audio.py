"""Mel scale, analysis window and filterbank values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the default feature extractor.
SAMPLE_RATE = 16_000
WINDOW = 400
HOP = 160
MELS = 80
FFT = 400
LOG_FLOOR = 1e-10
MAX_SECONDS = 30


def hz_to_mel(hz: Column) -> Column:
    return F.lit(2595.0) * F.log10(F.lit(1.0) + hz / F.lit(700.0))


def mel_to_hz(mel: Column) -> Column:
    return F.lit(700.0) * (F.pow(F.lit(10.0), mel / F.lit(2595.0)) - F.lit(1.0))


def hann(n: Column, size: int) -> Column:
    """Weight of sample ``n`` of a periodic Hann window."""
    return F.lit(0.5) * (F.lit(1.0) - F.cos(F.lit(2.0) * F.pi() * n / F.lit(float(size))))


def log_power(power: Column) -> Column:
    return F.log(power + F.lit(LOG_FLOOR))


def duration_seconds(samples: Column, rate: int = SAMPLE_RATE) -> Column:
    return samples / F.lit(float(rate))


def mel_filterbank(spark: SparkSession, rate: int, n_fft: int, n_mels: int) -> DataFrame:
    """Non-zero weights ``(bin, mel, weight)`` of the triangular filters.

    Edges are evenly spaced in mels and rounded to bins. Its size depends only
    on the parameters: at most two weights per bin.
    """
    half = n_fft // 2
    nyquist = rate / 2.0
    top = hz_to_mel(F.lit(nyquist))

    def edge(i: Column) -> Column:
        hz = mel_to_hz(top * i / F.lit(float(n_mels + 1)))
        return F.round(hz / F.lit(nyquist) * F.lit(half)).cast("int")

    mels = spark.range(n_mels).select(
        F.col("id").cast("int").alias("mel"),
        edge(F.col("id")).alias("start"),
        edge(F.col("id") + 1).alias("center"),
        edge(F.col("id") + 2).alias("end"),
    )
    bins = mels.filter("end > start").withColumn("bin", F.explode(F.sequence("start", F.expr("end - 1"))))
    rising = (F.col("bin") - F.col("start")) / (F.col("center") - F.col("start") + F.lit(1e-10))
    falling = (F.col("end") - F.col("bin")) / (F.col("end") - F.col("center") + F.lit(1e-10))
    on_rise = F.col("bin") < F.col("center")
    inside = F.when(on_rise, F.col("bin") < half).otherwise(F.col("bin") < half + 1)
    weighted = bins.filter(inside).withColumn("weight", F.when(on_rise, rising).otherwise(falling))
    return weighted.filter("weight > 0").select("bin", "mel", "weight")
