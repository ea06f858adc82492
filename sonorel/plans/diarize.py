"""Whole runs: transcribe, diarize, inventory and quantisation planning."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sonorel.operators import clustering, segmentation, signal, transcript
from sonorel.plans.models import Model, ToneModel, transcribe_segments
from sonorel.sources.binary import QUANTIZERS, array_of, read_wav, write_gguf
from sonorel.sources.inventory import quantizable

RATE = transcript.TARGET_RATE


@dataclass
class DiarizeOptions:
    speaker_mode: str = "auto"
    num_speakers: int = 2
    speakers: list[str] = field(default_factory=list)
    channel_names: list[str] = field(default_factory=lambda: ["left", "right"])
    right_num_speakers: int | None = None
    right_speakers: list[str] = field(default_factory=list)
    language: str | None = None
    overrides: list[str] = field(default_factory=list)
    vad: segmentation.VadConfig = field(default_factory=segmentation.VadConfig)
    max_tokens: int | None = None
    #: Filters of the model's own front end, for the mean embeddings of clustering; generated ones where none.
    bank: np.ndarray | None = None

    def __post_init__(self):
        if self.speaker_mode not in ("auto", "channel", "cluster"):
            raise ValueError("speaker_mode must be auto, channel or cluster")
        if self.num_speakers < 1:
            raise ValueError("num_speakers must be at least 1")

    def parsed_overrides(self) -> list[tuple[int, str, str]]:
        out = []
        for i, item in enumerate(self.overrides):
            speaker, _, lang = item.partition("=")
            if not speaker.strip() or not lang.strip():
                raise ValueError(f"{item!r} is not SPEAKER=LANG")
            out.append((i, speaker.strip(), lang.strip()))
        return out


def speaker_mode(asked: str, channels: int) -> str:
    """auto: by channel for two channels, by clustering for one."""
    return ("channel" if channels == 2 else "cluster") if asked == "auto" else asked


def tracks(recordings: DataFrame, mode: str, block: int = 1) -> DataFrame:
    """``recordings(path, sample_rate, channels, samples)`` to ``(path, channel, samples, hold)`` at 16 kHz.

    Channel mode: a track per channel; cluster mode: one track, two channels mixed. Where recordings have a column
    ``hold``, each of their samples lasts that long. It stays so at 16 kHz, if whole blocks of ``block`` samples
    fit into a hold; else the samples are written out and ``hold`` is 1.
    """
    with_hold = recordings if "hold" in recordings.columns else recordings.withColumn("hold", F.lit(1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, rate, channels, samples, hold in zip(pdf["path"], pdf["sample_rate"], pdf["channels"], pdf["samples"], pdf["hold"]):
                if channels not in (1, 2):
                    raise ValueError(f"{path}: {channels} channels")
                parts = [np.asarray(samples, np.float64)[c::channels] for c in range(channels)]
                if rate != RATE or hold % block:
                    parts, hold = [signal.resample(np.repeat(p, hold), rate, RATE) for p in parts], 1
                if speaker_mode(mode, channels) == "cluster":
                    n = min(map(len, parts))
                    parts = [sum(p[:n] for p in parts) / len(parts)]
                rows += [(path, c, p.astype(np.float32), int(channels), int(hold)) for c, p in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["path", "channel", "samples", "channels", "hold"])

    return with_hold.mapInPandas(run, "path string, channel int, samples array<float>, channels int, hold int")


def detect(track: DataFrame, config: segmentation.VadConfig, detector=segmentation.energy_detector) -> DataFrame:
    """``(path, channel, start, end)`` of speech in tracks; frames are cut inside one row, not by exploding samples.

    A sample held for several frames is detected once for all of them; a hold other than 1 is a multiple of the frame.
    """
    n = config.frame_len
    cut = f"transform(sequence(0, cast(size(samples) / {n} as int) - 1), f -> struct(cast(f as long) as f, 1L as n, slice(samples, f * {n} + 1, {n}) as x))"
    whole = f"transform(samples, (x, i) -> struct(cast(i as long) * (hold div {n}) as f, hold div {n} as n, array(x) as x))"
    frames = track.where(F.size("samples").cast("long") * F.col("hold") >= n).select(F.struct("path", "channel").alias("stream"), "hold", F.explode(F.expr(f"if(hold = 1, {cut}, {whole})")).alias("frame"))
    x = F.col("frame.x")
    if not getattr(detector, "steady", False):
        x = F.when(F.col("hold") == 1, x).otherwise(F.array_repeat(x[0], n))
    voiced = frames.select("stream", "frame.f", "frame.n", detector(x, config.mode).alias("voice"))
    found = segmentation.vad_segments(voiced, config)
    return found.select("stream.path", "stream.channel", "start", "end")


def _cluster(segments: DataFrame, track: DataFrame, k: int, bank: np.ndarray | None = None) -> DataFrame:
    """Adds ``speaker_id`` per recording; one group holds one recording's segments of one track."""
    sliced = transcript.segment_samples(segments, track, "path", "channel")

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            e = [clustering.segment_embedding(transcript.held(s, hold, a, b), 0, b - a, bank) for s, hold, a, b in zip(pdf["samples"], pdf["hold"], pdf["start"], pdf["end"])]
            yield pdf[["path", "seg_id", "start"]].assign(embedding=e)

    rows = sliced.select("path", "seg_id", "start", "end", "samples", "hold").mapInPandas(embed, "path string, seg_id long, start long, embedding array<double>")
    ids = clustering.cluster_segments(rows.withColumnRenamed("path", "stream"), k).withColumnRenamed("stream", "path")
    return segments.join(ids, ["path", "seg_id"])


def diarize(recordings: DataFrame, options: DiarizeOptions | None = None, factory: Callable[[], Model] = ToneModel) -> DataFrame:
    """Transcript rows ``path, idx, speaker, start_s, end_s, language, text, stop_reason`` of all recordings."""
    o = options or DiarizeOptions()
    spark = recordings.sparkSession
    track = tracks(recordings, o.speaker_mode, o.vad.frame_len).select("path", "channel", "samples", "hold")
    track = track.repartition("path", "channel").hint("merge")  # one exchange for all uses; never broadcast: its size is underestimated
    found = detect(track, o.vad)
    order = Window.partitionBy("path").orderBy("start", "channel", "end")
    modes = recordings.select("path", F.when(F.lit(o.speaker_mode) == "auto", F.when(F.col("channels") == 2, "channel").otherwise("cluster")).otherwise(F.lit(o.speaker_mode)).alias("mode"))
    found = found.withColumn("seg_id", F.row_number().over(order).cast("long")).join(modes, "path")
    names = F.array(*map(F.lit, o.channel_names))
    by_channel = found.where("mode = 'channel'").withColumn("speaker", F.coalesce(F.try_element_at(names, F.col("channel") + 1), F.concat(F.lit("ch"), F.col("channel").cast("string"))))
    mono = found.where("mode = 'cluster'")
    speakers = F.array(*map(F.lit, o.speakers)).cast("array<string>")
    clustered = _cluster(mono, track, o.num_speakers, o.bank).withColumn("speaker", transcript.speaker_label(F.col("speaker_id"), speakers)).drop("speaker_id")
    if (o.right_num_speakers or 0) >= 2:
        right_name = o.channel_names[1] if len(o.channel_names) > 1 else "ch1"
        right = by_channel.where("channel = 1").withColumn("n", F.count("*").over(Window.partitionBy("path")))
        enough = right.where("n >= 2").drop("n", "speaker")
        right_track = track.where("channel = 1")
        fine = _cluster(enough, right_track, o.right_num_speakers, o.bank).withColumn("speaker", transcript.speaker_label(F.col("speaker_id"), F.array(*map(F.lit, o.right_speakers)).cast("array<string>"), right_name)).drop("speaker_id")
        by_channel = by_channel.where("channel <> 1").unionByName(right.where("n < 2").drop("n")).unionByName(fine)
    labelled = by_channel.unionByName(clustered)
    overrides = spark.createDataFrame(o.parsed_overrides(), "ordinal int, speaker string, lang string")
    spoken = transcript.resolve_language(labelled, overrides, o.language)
    sliced = transcript.segment_samples(spoken, track, "path", "channel")
    done = transcribe_segments(sliced, factory, max_tokens=o.max_tokens, budget="segment")
    return done.select("path", F.col("seg_id").cast("int").alias("idx"), "speaker", (F.col("start") / RATE).alias("start_s"), (F.col("end") / RATE).alias("end_s"), "language", "text", "stop_reason")


def diarize_files(spark: SparkSession, path: str, options: DiarizeOptions | None = None, factory: Callable[[], Model] = ToneModel) -> DataFrame:
    return diarize(read_wav(spark, path), options, factory)


def transcribe(recordings: DataFrame, factory: Callable[[], Model] = ToneModel, chunk_seconds: int = 30, language: str | None = None, max_tokens: int | None = None) -> DataFrame:
    """``path, text, audio_duration_secs, inference_time_secs, rtf`` by back-to-back chunks, skipping empty texts."""
    track = tracks(recordings, "cluster")
    size = chunk_seconds * RATE
    lengths = track.select(F.col("path").alias("stream"), (F.size("samples").cast("long") * F.col("hold")).alias("n"))
    chunks = segmentation.fixed_chunks(lengths, size).select(F.col("stream").alias("path"), "chunk", "start", "end", F.lit(language).cast("string").alias("lang"))
    done = transcribe_segments(transcript.segment_samples(chunks, track), factory, max_tokens=max_tokens, budget="file")
    text = transcript.joined_chunks(done.select("path", "chunk", "text"))
    total = lengths.select(F.col("stream").alias("path"), (F.col("n") / RATE).alias("audio_duration_secs")).join(done.groupBy("path").agg(F.sum("seconds").alias("inference_time_secs")), "path", "left")
    rtf = F.when(F.col("audio_duration_secs") > 0, F.col("inference_time_secs") / F.col("audio_duration_secs")).otherwise(0.0)
    return total.join(text, "path", "left").select("path", F.coalesce("text", F.lit("")).alias("text"), "audio_duration_secs", F.coalesce("inference_time_secs", F.lit(0.0)).alias("inference_time_secs"), F.coalesce(rtf, F.lit(0.0)).alias("rtf"))


def right_channel_status(found: DataFrame, options: DiarizeOptions) -> DataFrame:
    """``(path, right_channel_clustering)`` of ``found(path, channels, channel)``, one row per segment: what became of the request; null if there was none."""
    k = options.right_num_speakers
    per = found.groupBy("path").agg(F.max("channels").alias("channels"), F.count(F.when(F.col("channel") == 1, 1)).alias("n"))
    if k is None:
        return per.select("path", F.lit(None).cast("string").alias("right_channel_clustering"))
    base = options.channel_names[1] if len(options.channel_names) > 1 else "ch1"
    applies = (F.lit(k) >= 2) & (F.col("channels") == 2) & F.lit(options.speaker_mode != "cluster")
    enabled = F.format_string(f"enabled (k=%d, base={base}, names={'provided' if options.right_speakers else '-'})", F.least(F.lit(k).cast("long"), F.col("n")))
    text = F.when(~applies, "requested but not applicable (need stereo + speaker-mode=channel)").when(F.col("n") >= 2, enabled).otherwise(F.format_string(f"requested (k={k}) but skipped (segments=%d)", F.col("n")))
    return per.select("path", text.alias("right_channel_clustering"))


def default_out_dir(prefix: str, now: float | None = None) -> str:
    """``prefix`` and the second of the epoch."""
    return f"{prefix}-{int(time.time() if now is None else now)}"


def write_text(results: DataFrame, out: str) -> None:
    """``results(path, text)`` as a text file per recording."""
    results.select("path", "text").write.mode("overwrite").partitionBy("path").text(out)


def write_outputs(result: DataFrame, out: str, settings: dict[str, object] | None = None) -> None:
    """Segments as JSON lines, and per recording the combined text, a text per speaker under its file's name, and the report.

    The models run once: the result is written first and everything else is made from it.
    """
    result.write.mode("overwrite").json(f"{out}/segments")
    rows = result.sparkSession.read.schema(result.schema).json(f"{out}/segments")
    write_text(transcript.combined_text(rows, "path"), f"{out}/combined")
    transcript.per_speaker_text(rows, "path").select("path", "file", F.rtrim("text", F.lit("\n")).alias("text")).write.mode("overwrite").partitionBy("path", "file").text(f"{out}/speakers")
    write_text(transcript.reports(rows, settings or {}), f"{out}/reports")


def quantize_tensors(tensors: DataFrame, scope: str, kind: str = "Q8_0", embeddings: bool = False) -> DataFrame:
    """``tensors(name, rank, dtype, shape, raw)`` below a name prefix to ``(name, type, shape, raw)``, a tensor at a time.

    Blocks where the plan says so and rows fill them, half precision elsewhere.
    """
    block = F.element_at("shape", -1) % 32 == 0
    planned = tensors.where(F.col("name").startswith(scope)).withColumn("blocks", quantizable(F.col("name"), F.col("rank"), embeddings) & F.coalesce(block, F.lit(False)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, dtype, shape, raw, blocks in zip(pdf["name"], pdf["dtype"], pdf["shape"], pdf["raw"], pdf["blocks"]):
                x = array_of(raw, dtype)
                out.append((name, kind if blocks else "F16", shape, QUANTIZERS[kind](x) if blocks else x.astype("<f2").tobytes()))
            yield pd.DataFrame(out, columns=["name", "type", "shape", "raw"])

    return planned.select("name", "dtype", "shape", "raw", "blocks").mapInPandas(run, "name string, type string, shape array<long>, raw binary")


def quantize(contents: list[bytes], scope: str, embeddings: bool = False, kind: str = "Q8_0", spark: SparkSession | None = None) -> bytes:
    """A GGUF file of the tensors of some safetensors files; the file is put together where it is written."""
    from sonorel.sources.inventory import safetensors_header

    spark = spark or SparkSession.getActiveSession()
    rows = [(n, len(shape), dtype, shape, bytearray(c[a:b])) for c in contents for n, dtype, shape, a, b in safetensors_header(c) if n.startswith(scope)]
    if not rows:
        return write_gguf([], {"general.architecture": "speech"})
    table = spark.createDataFrame(rows, "name string, rank int, dtype string, shape array<long>, raw binary").repartition(len(rows))
    done = {r.name: (r.name, r.type, tuple(r.shape), bytes(r.raw)) for r in quantize_tensors(table, scope, kind, embeddings).collect()}
    return write_gguf([done[name] for name, *_ in rows], {"general.architecture": "speech"})
