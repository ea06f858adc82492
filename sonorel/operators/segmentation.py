"""Voice-activity segmentation: frames, hysteresis, padding, merging, splitting, chunking.

Every step is partitioned by stream; places are sample or frame numbers, intervals half-open.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class VadConfig:
    """Milliseconds; ``max_segment_ms`` 0 never splits."""

    sample_rate: int = 16000
    mode: int = 2
    frame_ms: int = 30
    min_speech_ms: int = 300
    min_silence_ms: int = 200
    pad_ms: int = 150
    max_segment_ms: int = 30000

    def __post_init__(self):
        if self.frame_ms not in (10, 20, 30):
            raise ValueError("frame_ms must be 10, 20 or 30")
        if self.mode not in range(4):
            raise ValueError("mode must be 0 to 3")

    @property
    def frame_len(self) -> int:
        return self.sample_rate * self.frame_ms // 1000

    def frames(self, ms: int, least: int = 1) -> int:
        return max(least, -(-ms // self.frame_ms))


def energy_detector(x: Column, mode: int = 2) -> Column:
    """A stand-in detector: root mean square of a frame's samples above a level that rises with ``mode``."""
    power = F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")) / F.size(x)
    return F.sqrt(power) > (0.005, 0.01, 0.02, 0.04)[mode]


#: A frame of equal samples has the level of one of them, so that one will do; detectors without this mark get whole frames.
energy_detector.steady = True


def fixed_frames(samples: DataFrame, frame_len: int) -> DataFrame:
    """``samples(stream, i, x)`` to whole frames ``(stream, f, n, mean_square)``; a part frame at the end goes."""
    f = F.floor(F.col("i") / frame_len).cast("long").alias("f")
    framed = samples.groupBy("stream", f).agg(F.count("*").alias("n"), F.avg(F.col("x") * F.col("x")).alias("mean_square"))
    return framed.where(F.col("n") == frame_len)


def hysteresis(frames: DataFrame, min_speech: int, min_silence: int) -> DataFrame:
    """``frames(stream, f, voice)`` to ``(stream, start, end, total)`` in frames; with a column ``n``, a row stands for n equal frames from f on.

    Runs of equal frames that are long enough are events; of neighbouring events of one kind the
    first counts; a speech event lasts to the next event, or to the stream's end.
    """
    n = F.col("n") if "n" in frames.columns else F.lit(1)
    by_stream, in_kind = (Window.partitionBy(*keys).orderBy("f").rowsBetween(Window.unboundedPreceding, 0) for keys in (["stream"], ["stream", "voice"]))
    runs = frames.select("stream", "f", "voice", n.alias("n"), (F.sum(n).over(by_stream) - F.sum(n).over(in_kind)).alias("island"), F.sum(n).over(Window.partitionBy("stream")).alias("total"))
    events = runs.groupBy("stream", "voice", "island").agg(F.min("f").alias("start"), F.sum("n").alias("n"), F.first("total").alias("total"))
    events = events.where((F.col("voice") & (F.col("n") >= min_speech)) | (~F.col("voice") & (F.col("n") >= min_silence)))
    order = Window.partitionBy("stream").orderBy("start")
    turns = events.withColumn("before", F.lag("voice").over(order)).where(F.col("before").isNull() | (F.col("before") != F.col("voice")))
    turns = turns.withColumn("end", F.coalesce(F.lead("start").over(order), F.col("total")))
    return turns.where("voice").select("stream", F.col("start").cast("long"), F.col("end").cast("long"), F.col("total").cast("long"))


def pad(segments: DataFrame, frames: int) -> DataFrame:
    """Longer on both sides, clipped to [0, total]; empty ones go."""
    out = segments.withColumn("start", F.greatest(F.col("start") - frames, F.lit(0))).withColumn("end", F.least(F.col("end") + frames, F.col("total")))
    return out.where("end > start")


def merge_intervals(segments: DataFrame, *keys: str) -> DataFrame:
    """Overlapping and touching intervals of each key become one."""
    keys = keys or ("stream",)
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    islands = segments.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def split_long(segments: DataFrame, longest: int) -> DataFrame:
    """Contiguous pieces of at most ``longest``; the last may be short; 0 leaves all whole."""
    if not longest:
        return segments
    pieces = F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(longest).cast("long")))
    out = segments.where("end > start").withColumn("piece", pieces)
    return out.withColumn("start", F.col("piece")).withColumn("end", F.least(F.col("piece") + longest, F.col("end"))).drop("piece")


def vad_segments(frames: DataFrame, config: VadConfig) -> DataFrame:
    """``frames(stream, f, voice)``, or with ``n``, to segments ``(stream, start, end)`` in samples."""
    speech = hysteresis(frames, config.frames(config.min_speech_ms), config.frames(config.min_silence_ms))
    merged = merge_intervals(pad(speech, config.frames(config.pad_ms, 0)))
    scaled = merged.select("stream", (F.col("start") * config.frame_len).alias("start"), (F.col("end") * config.frame_len).alias("end"))
    return split_long(scaled, config.sample_rate * config.max_segment_ms // 1000)


def fixed_chunks(lengths: DataFrame, size: int) -> DataFrame:
    """``lengths(stream, n)`` to ``(stream, chunk, start, end)``: back-to-back chunks, the last may be short."""
    out = lengths.where("n > 0").select("stream", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1, F.lit(size).cast("long"))).alias("start"))
    return out.select("stream", F.floor(F.col("start") / size).cast("long").alias("chunk"), "start", F.least(F.col("start") + size, F.col("n").cast("long")).alias("end"))


def valid_segments(segments: DataFrame, total: str = "n", order: tuple[str, ...] = ("start", "channel")) -> DataFrame:
    """Numbered from 1 per stream, then clipped to the stream; empty ones go, leaving gaps in the numbers."""
    numbered = segments.withColumn("idx", F.row_number().over(Window.partitionBy("stream").orderBy(*order)))
    clipped = numbered.withColumn("start", F.least("start", total)).withColumn("end", F.least("end", total))
    return clipped.where("end > start")
