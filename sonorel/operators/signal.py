"""Samples to spectra: channels, resampling, framing, power spectra, log-mel and its normalisations.

Long relations ``samples(stream, i, x)``, ``spectrum(stream, frame, k, power)`` and
``mel(stream, frame, bin, v)``; real transform sizes run as numpy FFTs in Arrow batches of
(stream, samples) rows, small ones as a join with a generated table, so SQL can check them.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sonorel.functions import dsp


def channel(samples: Column, channels: Column | int, index: int) -> Column:
    """One channel of an interleaved array; an error where there is no such channel."""
    channels = F.lit(channels) if isinstance(channels, int) else channels
    one = F.filter(samples, lambda x, i: i % channels == index)
    return F.when(channels > index, one).otherwise(F.raise_error(F.lit("channel index out of range")))


def downmix(samples: DataFrame, channels: int) -> DataFrame:
    """``samples(stream, i, x)`` interleaved to the mean over channels of each frame."""
    return samples.groupBy("stream", F.floor(F.col("i") / channels).cast("long").alias("i")).agg(F.avg("x").alias("x"))


def mix(left: Column, right: Column) -> Column:
    """Half the sum of two arrays, as long as the shorter."""
    n = F.least(F.size(left), F.size(right))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1), n), lambda a, b: 0.5 * (a + b))


def pcm16(x: Column) -> Column:
    """Clamped to [-1, 1], times 32767, cut off towards zero."""
    return (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 32767).cast("smallint")


def pre_emphasis(samples: DataFrame, alpha: float = 0.97) -> DataFrame:
    before = F.lag("x").over(Window.partitionBy("stream").orderBy("i"))
    return samples.withColumn("x", F.coalesce(F.col("x") - alpha * before, F.col("x")))


def pad_or_trim(samples: Column, length: int = 480000) -> Column:
    return F.slice(F.concat(samples, F.array_repeat(F.lit(0.0).cast("float"), length)), 1, length)


def frames(samples: DataFrame, n_fft: int, hop: int, padding: str = "reflect", win: int | None = None) -> DataFrame:
    """``samples(stream, i, x)`` to ``(stream, frame, j, x)``, x before windowing.

    ``reflect``: centred, n / hop + 1 frames, reflected once beyond an end, else 0. ``none``:
    whole windows only. ``zero``: win / 2 zeros on both sides, whole windows only.
    """
    win = win or n_fft
    n = samples.groupBy("stream").agg((F.max("i") + 1).alias("n"))
    if padding == "reflect":
        count, shift = F.floor(F.col("n") / hop) + 1, n_fft // 2
    elif padding == "zero":
        count, shift = F.floor((F.col("n") + win - n_fft) / hop) + 1, win // 2
    else:
        count, shift = F.floor((F.col("n") - n_fft) / hop) + 1, 0
    grid = n.withColumn("count", count.cast("long")).where("count > 0")
    grid = grid.select("stream", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("frame"))
    grid = grid.select("stream", "n", "frame", F.explode(F.sequence(F.lit(0), F.lit(n_fft - 1))).alias("j"))
    at = F.col("frame") * hop + F.col("j") - shift
    if padding == "reflect":
        at = F.when(at < 0, -at).when(at >= F.col("n"), 2 * F.col("n") - at - 2).otherwise(at)
    grid = grid.select("stream", "frame", "j", at.alias("i"))
    return grid.join(samples.select("stream", "i", "x"), ["stream", "i"], "left").select("stream", "frame", "j", F.coalesce("x", F.lit(0.0)).alias("x"))


def power_by_join(framed: DataFrame, n_fft: int, win: int | None = None) -> DataFrame:
    """|DFT|^2 of windowed frames, bins 0 to n_fft / 2, as sums over a join with all bins; for small n_fft."""
    win = win or n_fft
    windowed = framed.where(F.col("j") < win).withColumn("x", F.col("x") * dsp.hann(F.col("j"), win))
    bins = windowed.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_fft // 2))))
    angle = 2.0 * math.pi / n_fft * (F.col("k") * F.col("j") % n_fft)
    sums = bins.groupBy("stream", "frame", "k").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(F.col("x") * F.sin(angle)).alias("im"))
    return sums.select("stream", "frame", "k", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def apply_filterbank(spectrum: DataFrame, bank: DataFrame) -> DataFrame:
    """Power spectrum times filters: a join on the frequency bin and a sum. The bank is a generated table of fixed size."""
    return spectrum.join(F.broadcast(bank), "k").groupBy("stream", "frame", "bin").agg(F.sum(F.col("power") * F.col("w")).alias("v"))


def normalize_whisper(mel: DataFrame) -> DataFrame:
    """log10 with a floor, last frame off, at most 8 below the stream's maximum, then (x + 4) / 4."""
    logs = mel.withColumn("v", dsp.floored_log10(F.col("v")))
    per = Window.partitionBy("stream")
    cut = logs.withColumn("last", F.max("frame").over(per)).where(F.col("frame") < F.col("last"))
    top = F.max("v").over(per)
    return cut.select("stream", "frame", "bin", ((F.greatest(F.col("v"), top - 8.0) + 4.0) / 4.0).alias("v"))


def normalize_utterance(mel: DataFrame) -> DataFrame:
    per = Window.partitionBy("stream")
    return mel.withColumn("v", (F.col("v") - F.avg("v").over(per)) / F.greatest(F.stddev_pop("v").over(per), F.lit(1e-10)))


def normalize_features(mel: DataFrame) -> DataFrame:
    per = Window.partitionBy("stream", "bin")
    return mel.withColumn("v", (F.col("v") - F.avg("v").over(per)) / F.greatest(F.stddev_pop("v").over(per), F.lit(1e-5)))


# --- real transform sizes, in Arrow batches ---------------------------------------------------


def _hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def _slaney(hz):
    hz = np.asarray(hz, float)
    return np.where(hz >= 1000, 15 + np.log(np.maximum(hz, 1e-9) / 1000) / (math.log(6.4) / 27), hz * 3 / 200)


def _unslaney(m):
    m = np.asarray(m, float)
    return np.where(m >= 15, 1000 * np.exp(math.log(6.4) / 27 * (m - 15)), m * 200 / 3)


@functools.cache
def filter_matrix(sample_rate: int, n_fft: int, n_mels: int, scale: str = "slaney", f_max: float | None = None) -> np.ndarray:
    """Triangular filters as (n_mels, n_fft / 2 + 1)."""
    to, back = (_slaney, _unslaney) if scale == "slaney" else (lambda f: 2595 * np.log10(1 + np.asarray(f, float) / 700), lambda m: 700 * (10 ** (np.asarray(m, float) / 2595) - 1))
    edges = back(np.linspace(to(0.0), to(f_max or sample_rate / 2), n_mels + 2))
    hz = np.arange(n_fft // 2 + 1) * sample_rate / n_fft
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    w = np.maximum(0, np.minimum((hz - lo) / (mid - lo), (hi - hz) / (hi - mid)))
    return w * (2 / (hi - lo)) if scale == "slaney" else w


@functools.cache
def _steps() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the window W and its part V from each place on: |W|^2, Re(W conj V) and |V|^2 by frequency.

    A frame of the value a and from a place on a + d has the spectrum aW + dV.
    """
    w = _hann(400)
    whole, part = np.fft.rfft(w), np.fft.rfft(w * (np.arange(400) >= np.arange(400)[:, None]), axis=1)
    return np.abs(whole) ** 2, (whole * part.conj()).real, np.abs(part) ** 2


@functools.cache
def _mel_steps() -> tuple[np.ndarray, ...]:
    return tuple(t @ filter_matrix(16000, 400, 128).T for t in _steps())


def _whisper(x: np.ndarray, bank: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows of the whisper front end and each frame's row; frames within one stretch of equal samples share a row.

    Frames of one or two values need no transform of their own.
    """
    n_fft, hop = 400, 160
    frames = np.arange(len(x) // hop)
    at = np.concatenate([np.arange(-n_fft // 2, 0), len(x) + np.arange(n_fft // 2)])
    at = np.where(at < 0, -at, at)
    at = np.where(at >= len(x), 2 * len(x) - at - 2, at)
    ok = (at >= 0) & (at < len(x))
    ends = np.where(ok, x[np.where(ok, at, 0)], 0) if len(x) else np.zeros(n_fft)
    padded = np.concatenate([ends[: n_fft // 2], x, ends[n_fft // 2 :]])
    edges = np.flatnonzero(padded[1:] != padded[:-1]) + 1
    first, last = (np.searchsorted(edges, frames * hop + d, "right") for d in (0, n_fft - 1))
    _, chosen, row = np.unique(np.where(first == last, -1 - first, frames), return_index=True, return_inverse=True)
    filters = filter_matrix(16000, n_fft, 128) if bank is None else bank
    mel = np.empty((len(chosen), len(filters)))
    plain = (last - first)[chosen] <= 1
    if plain.any():
        begin, edge = chosen[plain] * hop, np.append(edges, 0)[first[chosen[plain]]]
        a, b = (padded[begin + d].astype(np.float64)[:, None] for d in (0, n_fft - 1))
        place = np.clip(edge - begin, 0, n_fft - 1)  # of no account where a = b
        whole, cross, part = _mel_steps() if bank is None else _steps()
        power = a * a * whole + 2 * a * (b - a) * cross[place] + (b - a) ** 2 * part[place]
        mel[plain] = power if bank is None else power @ filters.T
    if not plain.all():
        spectrum = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(padded, n_fft)[chosen[~plain] * hop] * _hann(n_fft), axis=1)
        mel[~plain] = (spectrum.real**2 + spectrum.imag**2) @ filters.T
    v = np.log10(np.maximum(mel, 1e-10))
    return (np.maximum(v, v.max() - 8) + 4) / 4 if v.size else v, row


def whisper_rows(samples: np.ndarray, bank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``log_mel`` without repeats, and how many frames each stands for."""
    v, row = _whisper(np.asarray(samples), bank)
    return v, np.bincount(row, minlength=len(v)).astype(np.float64)


def log_mel(samples: np.ndarray, kind: str = "whisper", bank: np.ndarray | None = None) -> np.ndarray:
    """(frames, bins) of one recording, by the front end of one model family: whisper, gigaam or parakeet."""
    x = np.asarray(samples, np.float64)
    if kind == "whisper":
        v, row = _whisper(x, bank)
        return v[row]
    if kind == "gigaam":
        n_fft, hop = 320, 160
        if len(x) < n_fft:
            return np.zeros((0, 64))
        f = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
        power = np.abs(np.fft.rfft(f * _hann(n_fft), axis=1)) ** 2
        return np.log(np.clip(power @ (filter_matrix(16000, n_fft, 64, "htk") if bank is None else bank).T, 1e-9, 1e9))
    if kind == "parakeet":
        n_fft, hop, win = 512, 160, 400
        x = np.append(x[:1], x[1:] - 0.97 * x[:-1])
        x = np.concatenate([np.zeros(win // 2), x, np.zeros(win // 2)])
        if len(x) < n_fft:
            return np.zeros((0, 128))
        f = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop].copy()
        f[:, :win] *= _hann(win)
        f[:, win:] = 0
        v = np.log(np.maximum(np.abs(np.fft.rfft(f, axis=1)) ** 2 @ (filter_matrix(16000, n_fft, 128) if bank is None else bank).T, 2.0**-24))
        return (v - v.mean(axis=0)) / np.maximum(v.std(axis=0), 1e-5)
    raise ValueError(f"no front end {kind}")


def mel_frames(recordings: DataFrame, kind: str = "whisper") -> DataFrame:
    """``recordings(path, samples)`` to ``(path, frame, mel)``, a recording at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, samples in zip(pdf["path"], pdf["samples"]):
                v = log_mel(np.asarray(samples, np.float64), kind).astype(np.float32)
                yield pd.DataFrame({"path": [path] * len(v), "frame": np.arange(len(v), dtype=np.int32), "mel": list(v)})

    return recordings.select("path", "samples").mapInPandas(run, "path string, frame int, mel array<float>")


def resample(x: np.ndarray, source: int, target: int, chunk: int = 1024) -> np.ndarray:
    """By zeroing or cutting the spectrum of overlapping blocks; equal rates change nothing.

    A substitute of our own for an external resampler: lengths are proportional, values close
    for band-limited signals, not bit-equal.
    """
    x = np.asarray(x, np.float64)
    if source == target or not len(x):
        return x
    g = math.gcd(source, target)
    up, down = target // g, source // g
    size = max(chunk, 2 * down) // down * down
    step, out_len = size, size * up // down
    padded = np.concatenate([np.zeros(size // down * down // 2 // down * down), x, np.zeros(3 * size)])
    lead = size // down * down // 2 // down * down
    out = np.zeros(math.ceil((len(x) + 4 * size) * up / down))
    window = _hann(2 * size)
    for s in range(-size, len(x) + size, step):
        a = s + lead
        block = padded[max(a, 0) : a + 2 * size]
        if a < 0:
            block = np.concatenate([np.zeros(-a), block])
        block = np.pad(block, (0, max(0, 2 * size - len(block))))
        y = np.fft.irfft(_fit(np.fft.rfft(block * window), out_len), 2 * out_len) * (up / down)
        o = s * up // down
        b, c = max(o, 0), min(o + 2 * out_len, len(out))
        if c > b:
            out[b:c] += y[b - o : c - o]
    return out[: math.ceil(len(x) * up / down)]


def _fit(spectrum: np.ndarray, half: int) -> np.ndarray:
    want = half + 1
    return spectrum[:want] if len(spectrum) >= want else np.pad(spectrum, (0, want - len(spectrum)))


def resampled(recordings: DataFrame, target: int = 16000) -> DataFrame:
    """``recordings(path, sample_rate, samples)`` of one channel each, at the target rate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(samples=[resample(np.asarray(s, np.float64), int(r), target).astype(np.float32) for s, r in zip(pdf["samples"], pdf["sample_rate"])], sample_rate=np.int32(target))

    return recordings.select("path", "sample_rate", "samples").mapInPandas(run, "path string, sample_rate int, samples array<float>")


def hann_table(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("n"), dsp.hann(F.col("id"), n).alias("w"))
