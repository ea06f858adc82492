"""Scalar text rules of transcript assembly, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Model ids, what they are shown as, and the spellings accepted for them.
MODELS = {
    "whisper": ("Whisper Large v3 Turbo", ["whisper", "whisper-large-v3-turbo", "whisper-large"]),
    "gigaam": ("GigaAM v3 E2E CTC", ["gigaam", "gigaam-ctc", "gigaam-v3"]),
    "parakeet": ("Parakeet TDT v3", ["parakeet", "parakeet-tdt", "parakeet-v3"]),
    "qwen3-asr": ("Qwen3-ASR-0.6B", ["qwen3-asr", "qwen3", "qwen"]),
}
#: Parameters by number of encoder layers; 32 layers depend on the decoder.
LAYER_PARAMETERS = {4: 39_000_000, 6: 74_000_000, 12: 244_000_000, 24: 769_000_000}
#: Fixed values: (tokens a second, overhead, least, most, rounding up) of the three budgets.
BUDGETS = {"file": (16.0, 64, 256, 4096, True), "segment": (16.0, 32, 64, 2048, True), "adapter": (25.0, 0, 64, 4096, False)}


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def format_timestamp(seconds: Column) -> Column:
    """``HH:MM:SS.mmm`` of seconds; negative counts as zero, hours are unbounded."""
    ms = F.greatest(F.round(seconds * 1000), F.lit(0)).cast("long")
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, ms % 1000)


def sanitize_filename(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(name, "[^A-Za-z0-9_.-]", "_"), F.lit("")), F.lit("speaker"))


def normalize_language(name: Column) -> Column:
    """Trimmed, first character upper, all others lower."""
    t = F.trim(name)
    return F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, F.lit(2), F.length(t))))


def parse_output(raw: Column, forced: Column | None = None) -> Column:
    """Struct (language, text) of a model's raw output with an optional ``<asr_text>`` tag.

    A forced language is trimmed and kept as it is, and the whole text with it.
    """
    t = F.trim(F.coalesce(raw, F.lit("")), F.lit(" \t\n\r\f\x0b"))
    tag = F.instr(t, "<asr_text>")
    meta = F.when(tag > 0, F.substring(t, F.lit(1), tag - 1))
    body = F.trim(F.substring(t, tag + len("<asr_text>"), F.length(t)), F.lit(" \t\n\r\f\x0b"))
    lines = F.filter(F.transform(F.split(meta, "\r?\n"), lambda x: F.trim(x, F.lit(" \t\n\r\f\x0b"))), lambda x: _lower_ascii(x).startswith("language ") & (F.length(F.trim(F.substring(x, F.lit(10), F.length(x)))) > 0))
    named = F.try_element_at(lines, F.lit(1))
    language = F.when(F.contains(_lower_ascii(meta), F.lit("language none")), F.lit("")).otherwise(F.coalesce(normalize_language(F.substring(named, F.lit(10), F.length(named))), F.lit("")))
    detected = F.when(tag > 0, F.struct(language.alias("language"), body.alias("text"))).otherwise(F.struct(F.lit("").alias("language"), t.alias("text")))
    empty = F.struct(F.lit("").alias("language"), F.lit("").alias("text"))
    out = F.when(t == "", empty)
    if forced is not None:
        out = out.when(forced.isNotNull(), F.struct(F.trim(forced).alias("language"), t.alias("text")))
    return out.otherwise(detected)


def split_override(item: Column) -> Column:
    """Struct (speaker, lang) of ``SPEAKER=LANG``; null where the form is wrong."""
    parts = F.split(item, "=", 2)
    a, b = F.trim(parts[0]), F.trim(F.try_element_at(parts, F.lit(2)))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.struct(a.alias("speaker"), b.alias("lang")))


def escape_cell(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def join_pieces(pieces: Column, both_ends: bool) -> Column:
    """Sentence pieces to text: the word mark becomes a space; spaces go at the front, or at both ends."""
    joined = F.replace(F.array_join(pieces, ""), F.lit("▁"), F.lit(" "))
    return F.trim(joined) if both_ends else F.ltrim(joined)


def model_of(name: Column) -> Column:
    """The model id that a loosely spelt name stands for; null if none."""
    low, out = F.lower(name), None
    for model, (_, spellings) in MODELS.items():
        out = F.when(low.isin(spellings), model) if out is None else out.when(low.isin(spellings), model)
    return out


def display_name(model: Column) -> Column:
    out = None
    for key, (shown, _) in MODELS.items():
        out = F.when(model == key, shown) if out is None else out.when(model == key, shown)
    return out


def mebibytes(size: Column) -> Column:
    """Whole bytes in MiB with one decimal; ties go to the even digit, as in C, and null stays null.

    Java's own format rounds ties up and decimals instead of the number, so whole tenths are counted here.
    """
    least = F.abs(size.cast("double"))
    whole = F.floor(least / F.lit(1048576.0)).cast("long")
    rest = (least - whole * F.lit(1048576.0)).cast("long") * 10  # both exact: 2**20 is a power of two
    tenths, over = F.floor(rest / 1048576).cast("long"), rest % 1048576
    up = F.when((over > 524288) | ((over == 524288) & (tenths % 2 == 1)), 1).otherwise(0)
    total = whole * 10 + tenths + up
    sign = F.when(size < 0, "-").otherwise("")
    return F.concat(sign, F.floor(total / 10).cast("string"), F.lit("."), (total % 10).cast("string"), F.lit(" MiB"))


def quantization_of(file: Column) -> Column:
    """The block format that a weight file's name tells; the eight-bit one where it tells none."""
    return F.when(file.rlike("q4|Q4"), "GGUF Q4_0").when(file.rlike("q6k|Q6K|q6_k"), "GGUF Q6_K").otherwise("GGUF Q8_0")


def layer_parameters(encoder_layers: Column, decoder_layers: Column) -> Column:
    out = F.when((encoder_layers == 32) & (decoder_layers <= 4), F.lit(809_000_000)).when(encoder_layers == 32, F.lit(1_550_000_000))
    for layers, n in LAYER_PARAMETERS.items():
        out = out.when(encoder_layers == layers, F.lit(n))
    return out.otherwise(F.lit(0)).cast("long")


def named_parameters(model_name: Column) -> Column:
    return F.when(model_name.rlike("1\\.7[bB]"), F.lit(1_700_000_000)).otherwise(F.lit(600_000_000)).cast("long")


def token_budget(seconds: Column, kind: str) -> Column:
    rate, overhead, least, most, up = BUDGETS[kind]
    n = (F.ceil(seconds * rate) if up else F.floor(seconds * rate)).cast("long") + overhead
    return F.greatest(F.lit(least), F.least(F.lit(most), n)).cast("long")


def round_up_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0)).otherwise(F.floor((a + b - 1) / b)).cast("long")


def real_time_factor(took: Column, duration: Column) -> Column:
    return F.when(duration > 0, took / duration).otherwise(F.lit(0.0))


def output_token_rate(downsample: Column) -> Column:
    return F.lit(100.0) / downsample


def halved_twice(length: Column) -> Column:
    """Frames after two stride-2 convolutions, each rounding up."""
    return F.ceil(F.ceil(length / 2) / 2).cast("long")


def uncentred_frames(samples: Column, window: int, hop: int) -> Column:
    return F.when(samples < window, F.lit(0)).otherwise(F.floor((samples - window) / hop) + 1).cast("long")
