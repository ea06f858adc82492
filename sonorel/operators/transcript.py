"""Labels, languages and assembly: from timed segments and texts to transcripts and reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from sonorel.functions.text import escape_cell, format_timestamp, sanitize_filename

TARGET_RATE = 16000


def resolve_language(segments: DataFrame, overrides: DataFrame, default: str | None = None) -> DataFrame:
    """Adds ``lang``: that of the speaker, else of the name before its first hyphen, else the default.

    ``overrides(ordinal, speaker, lang)``; of repeated speakers the last counts.
    """
    last = overrides.groupBy("speaker").agg(F.max_by("lang", "ordinal").alias("lang"))
    exact = last.select(F.col("speaker"), F.col("lang").alias("_exact"))
    base = last.select(F.col("speaker").alias("_base"), F.col("lang").alias("_of_base"))
    named = segments.withColumn("_base", F.when(F.instr("speaker", "-") > 0, F.substring_index("speaker", "-", 1)))
    joined = named.join(exact, "speaker", "left").join(base, "_base", "left")
    return joined.withColumn("lang", F.coalesce("_exact", "_of_base", F.lit(default).cast("string"))).drop("_base", "_exact", "_of_base")


def speaker_label(cluster: Column, names: Column, prefix: str | None = None) -> Column:
    """The supplied name at the cluster's place, else ``spk`` and its number; after a channel's name if given."""
    label = F.coalesce(F.try_element_at(names, (cluster + 1).cast("int")), F.concat(F.lit("spk"), cluster.cast("string")))
    return label if prefix is None else F.concat(F.lit(prefix + "-"), label)


def speaker_names(text: Column) -> Column:
    """A comma-separated list, trimmed, empty entries out."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def segment_samples(segments: DataFrame, recordings: DataFrame, *keys: str) -> DataFrame:
    """``segments(path, start, end, ...)`` with the slice of ``recordings(path, samples)``: one join on the recording.

    ``keys`` in place of the recording's path join on more. With a column ``hold`` each sample lasts that long; the slice has all samples that the segment touches, and ``held`` cuts it.
    """
    keys = keys or ("path",)
    kept = [c for c in ("samples", "hold") if c in recordings.columns]
    joined = segments.join(recordings.select(*keys, *kept), list(keys))
    hold = F.col("hold") if "hold" in kept else F.lit(1)
    first, last = F.floor(F.col("start") / hold), F.floor((F.col("end") - 1) / hold)
    return joined.withColumn("samples", F.slice("samples", (first + 1).cast("int"), (last - first + 1).cast("int")))


def held(samples: np.ndarray, hold: int, start: int, end: int) -> np.ndarray:
    """A segment's samples at full length, from a slice of ``segment_samples``."""
    return np.repeat(samples, hold)[start % hold :][: end - start]


def line_of(start_s: Column, end_s: Column, speaker: Column, text: Column) -> Column:
    return F.concat(F.lit("["), format_timestamp(start_s), F.lit(" - "), format_timestamp(end_s), F.lit("] "), speaker, F.lit(": "), text)


def combined_text(transcript: DataFrame, *keys: str) -> DataFrame:
    """All lines in order of idx, between line ends, none after the last."""
    line = F.struct("idx", line_of(F.col("start_s"), F.col("end_s"), F.col("speaker"), F.col("text")).alias("line"))
    rows = transcript.groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return rows.select(*keys, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


def per_speaker_text(transcript: DataFrame, *keys: str) -> DataFrame:
    """Each speaker's texts in order, a line end after each, and the file name the speaker gets."""
    rows = transcript.groupBy(*keys, "speaker").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("texts"))
    body = F.concat(F.array_join(F.transform("texts", lambda x: x["text"]), "\n"), F.lit("\n"))
    return rows.select(*keys, "speaker", F.concat(sanitize_filename(F.col("speaker")), F.lit(".txt")).alias("file"), body.alias("text"))


def joined_chunks(chunks: DataFrame, keep_empty: bool = False) -> DataFrame:
    """``chunks(path, chunk, text)`` joined by spaces in order; empty ones are skipped unless asked for."""
    used = chunks if keep_empty else chunks.where("text <> ''")
    rows = used.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("c"))
    return rows.select("path", F.array_join(F.transform("c", lambda x: x["text"]), " ").alias("text"))


def report_rows(transcript: DataFrame) -> Column:
    """A table row of the report; bars in language and text are escaped, the speaker stands as it is."""
    cells = [F.col("idx").cast("string"), format_timestamp(F.col("start_s")), format_timestamp(F.col("end_s")), F.col("speaker"), escape_cell(F.col("language")), F.col("stop_reason"), escape_cell(F.col("text"))]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


#: The head of the report's table.
_TABLE = ["| # | Start | End | Speaker | Lang | Stop | Text |", "|---:|---|---|---|---|---|---|"]


def reports(transcript: DataFrame, settings: dict[str, object], key: str = "path") -> DataFrame:
    """``(path, text)``: the Markdown report of each recording, made where its rows are."""
    row = F.struct("idx", report_rows(transcript).alias("row"), line_of(F.col("start_s"), F.col("end_s"), F.col("speaker"), F.col("text")).alias("line"))
    per = transcript.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("r"))
    head = ["# Diarized transcript", "", *(f"- {k}: {v}" for k, v in settings.items())]
    parts = [
        *map(F.lit, head), F.concat(F.lit("- Segments: "), F.size("r").cast("string")), *map(F.lit, ["", "## Segments", "", *_TABLE]),
        F.array_join(F.transform("r", lambda x: x["row"]), "\n"), *map(F.lit, ["", "## Combined", "", "```text"]), F.array_join(F.transform("r", lambda x: x["line"]), "\n"), F.lit("```"), F.lit(""),
    ]
    return per.select(key, F.array_join(F.array(*parts), "\n").alias("text"))


def report(transcript: DataFrame, settings: dict[str, object]) -> str:
    """The Markdown report of one recording; its rows come to the driver, as its file is written there."""
    rows = transcript.orderBy("idx").select(report_rows(transcript).alias("row"), line_of(F.col("start_s"), F.col("end_s"), F.col("speaker"), F.col("text")).alias("line")).collect()
    head = ["# Diarized transcript", "", *(f"- {k}: {v}" for k, v in settings.items()), f"- Segments: {len(rows)}", "", "## Segments", ""]
    table = [*_TABLE, *(r.row for r in rows)]
    return "\n".join([*head, *table, "", "## Combined", "", "```text", *(r.line for r in rows), "```", ""])
