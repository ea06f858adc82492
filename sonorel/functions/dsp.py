"""Frequency scales, windows, filterbanks and logarithms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_BREAK_HZ, _BREAK_MEL, _STEP = 1000.0, 15.0, math.log(6.4) / 27.0  # the Slaney scale: linear below 1 kHz
_HZ_PER_MEL = 200.0 / 3.0


def hz_to_mel_slaney(hz: Column) -> Column:
    return F.when(hz >= _BREAK_HZ, _BREAK_MEL + F.log(hz / _BREAK_HZ) / _STEP).otherwise(hz / _HZ_PER_MEL)


def mel_to_hz_slaney(mel: Column) -> Column:
    return F.when(mel >= _BREAK_MEL, _BREAK_HZ * F.exp(_STEP * (mel - _BREAK_MEL))).otherwise(mel * _HZ_PER_MEL)


def hz_to_mel_htk(hz: Column) -> Column:
    return 2595.0 * F.log10(1.0 + hz / 700.0)


def mel_to_hz_htk(mel: Column) -> Column:
    return 700.0 * (F.pow(F.lit(10.0), mel / 2595.0) - 1.0)


def hann(n: Column, length: int) -> Column:
    """The periodic Hann window at whole ``n``."""
    return 0.5 - 0.5 * F.cos(n * (2.0 * math.pi / length))


def floored_log10(x: Column, floor: float = 1e-10) -> Column:
    return F.log10(F.greatest(x, F.lit(floor)))


def clamped_ln(x: Column, low: float = 1e-9, high: float = 1e9) -> Column:
    return F.log(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def filterbank(spark: SparkSession, sample_rate: int, n_fft: int, n_mels: int, scale: str = "slaney", f_min: float = 0.0, f_max: float | None = None) -> DataFrame:
    """Triangular filters as ``(bin, k, w)``, non-zero weights only; area-normalised on the Slaney scale.

    A generated table of n_mels times n_fft / 2 + 1 rows at most.
    """
    to_mel, to_hz = (hz_to_mel_slaney, mel_to_hz_slaney) if scale == "slaney" else (hz_to_mel_htk, mel_to_hz_htk)
    top = sample_rate / 2 if f_max is None else f_max
    edges = spark.range(n_mels + 2).select(
        F.col("id").alias("p"),
        to_hz(to_mel(F.lit(float(f_min))) + (to_mel(F.lit(float(top))) - to_mel(F.lit(float(f_min)))) * F.col("id") / (n_mels + 1)).alias("hz"),
    )
    lo, mid, hi = (edges.select((F.col("p") - d).alias("bin"), F.col("hz").alias(name)) for d, name in ((0, "lo"), (1, "mid"), (2, "hi")))
    bins = lo.join(mid, "bin").join(hi, "bin").where(f"bin between 0 and {n_mels - 1}")
    k = F.explode(F.sequence(F.lit(0), F.lit(n_fft // 2))).alias("k")
    hz = F.col("k") * (sample_rate / n_fft)
    w = F.greatest(F.lit(0.0), F.least((hz - F.col("lo")) / (F.col("mid") - F.col("lo")), (F.col("hi") - hz) / (F.col("hi") - F.col("mid"))))
    if scale == "slaney":
        w = w * 2.0 / (F.col("hi") - F.col("lo"))
    out = bins.select(F.col("bin").cast("int").alias("bin"), "lo", "mid", "hi", k).select("bin", F.col("k").cast("int").alias("k"), w.alias("w"))
    return out.where("w > 0")
