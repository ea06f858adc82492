"""The registered queries of the speech-data operators, with an independent SQL text for each.

The tables hold no audio, so streams are users' events in time order, transcripts are
conversations, embeddings are the vectors, and model folders are literal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sonorel.functions import dsp, text as tx, vector as vec
from sonorel.operators import clustering as cl, decoding as de, segmentation as sg, signal as si, transcript as tr
from sonorel.sources import inventory as inv

VAD = sg.VadConfig(sample_rate=100, frame_ms=30, min_speech_ms=60, min_silence_ms=60, pad_ms=30, max_segment_ms=240)
_queries: dict = {}
_sql: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def add(f):
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return add


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# --- stand-in relations -------------------------------------------------------------------------


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """``(stream, i, x)``: users' values in time order, scaled to [-1, 1]."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    return e.select(F.col("user_id").alias("stream"), (F.row_number().over(order) - 1).cast("long").alias("i"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value") / 500)).alias("x"))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return samples(spark, sf).select("stream", F.col("i").alias("f"), (F.col("x") > 0.07).alias("voice"))


def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    c = _table(spark, sf, "conversations")
    start = F.col("turn") * 7.25 + F.col("conv_id") * 0.001
    return c.select(
        F.col("conv_id").alias("path"), (F.col("turn") + 1).cast("int").alias("idx"), F.concat("role", F.when(F.col("turn") % 3 == 1, "-a").otherwise("")).alias("speaker"),
        start.alias("start_s"), (start + 6.5).alias("end_s"), F.when(F.col("turn") % 2 == 0, "en|us").otherwise("").alias("language"), F.col("text"), F.lit("eos").alias("stop_reason"),
    )


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, ids)``: characters of each text, a small alphabet with many repeats."""
    d = _table(spark, sf, "documents").select("doc_id", F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.ascii(F.lower(c)) % 29).alias("ids"))
    return d


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """``(seq, t, class, score)``: ten vectors make a sequence, their components are classes."""
    e = _table(spark, sf, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 10).cast("long").alias("seq"), (F.col("vec_id") % 10).cast("int").alias("t"), F.posexplode("embedding").alias("class", "score"))


_SAMPLES = "s AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, greatest(-1.0, least(1.0, value / 500)) AS x FROM events)"
_TRANSCRIPT = """t AS (SELECT conv_id AS path, CAST(turn + 1 AS INTEGER) AS idx, role || CASE WHEN turn % 3 = 1 THEN '-a' ELSE '' END AS speaker,
    CAST(turn AS DOUBLE) * 7.25 + CAST(conv_id AS DOUBLE) * 0.001 AS start_s, CAST(turn AS DOUBLE) * 7.25 + CAST(conv_id AS DOUBLE) * 0.001 + 6.5 AS end_s,
    CASE WHEN turn % 2 = 0 THEN 'en|us' ELSE '' END AS language, text, 'eos' AS stop_reason FROM conversations)"""


def _stamp(ms: str) -> str:
    return f"lpad(CAST({ms} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ms} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ms} // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0')"


def _ms(x: str) -> str:
    return f"CAST(greatest(round(({x}) * 1000), 0) AS BIGINT)"


# --- scalars ------------------------------------------------------------------------------------


@_register("f1_format_ts", f"SELECT event_id, {_stamp(_ms('value - 5'))} AS stamp FROM events")
def f1(spark, sf):
    return _table(spark, sf, "events").select("event_id", tx.format_timestamp(F.col("value") - 5).alias("stamp"))


@_register("f2_sanitize", """SELECT doc_id, CASE WHEN text = '' THEN 'speaker' ELSE array_to_string(list_transform(string_split(text, ''),
    lambda c: CASE WHEN (c >= 'a' AND c <= 'z') OR (c >= 'A' AND c <= 'Z') OR (c >= '0' AND c <= '9') OR c IN ('_', '-', '.') THEN c ELSE '_' END), '') END AS name FROM documents""")
def f2(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", tx.sanitize_filename(F.col("text")).alias("name"))


@_register("f3_lang_norm", "SELECT conv_id, turn, upper(substr(r, 1, 1)) || lower(substr(r, 2)) AS lang FROM (SELECT conv_id, turn, trim('  ' || upper(role) || ' ' || role || ' ') AS r FROM conversations)")
def f3(spark, sf):
    c = _table(spark, sf, "conversations")
    return c.select("conv_id", "turn", tx.normalize_language(F.concat(F.lit("  "), F.upper("role"), F.lit(" "), "role", F.lit(" "))).alias("lang"))


@_register("f4_parse_output", """SELECT doc_id, CASE WHEN k = 0 THEN upper(substr(source, 1, 1)) || lower(substr(source, 2)) ELSE '' END AS language, trim(replace(body, chr(10), ' ')) AS text
    FROM (SELECT doc_id, doc_id % 4 AS k, source, regexp_replace(text, '\\s+', ' ', 'g') AS body FROM documents)""")
def f4(spark, sf):
    d = _table(spark, sf, "documents").withColumn("body", F.regexp_replace("text", r"\s+", " "))
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("\n noise\nLANGUAGE "), F.upper("source"), F.lit("<asr_text> "), "body")).when(k == 1, F.concat(F.lit("language None<asr_text>"), "body")).when(k == 2, F.concat(F.lit("no tag<asr_text>"), "body")).otherwise(F.concat(F.lit("  "), "body"))
    return d.select("doc_id", tx.parse_output(raw).alias("p")).select("doc_id", "p.language", "p.text")


@_register("f5_overrides", """SELECT speaker, arg_max(lang, ordinal) AS lang FROM (VALUES (0, 'user', 'en'), (1, 'system', 'de'), (2, 'user', 'fr=x')) v(ordinal, speaker, lang) GROUP BY speaker""")
def f5(spark, sf):
    items = spark.createDataFrame([(0, " user =en"), (1, "system= de "), (2, "user=fr=x"), (3, "=no"), (4, "none")], "ordinal int, item string")
    parsed = items.select("ordinal", tx.split_override(F.col("item")).alias("p")).where("p is not null").select("ordinal", "p.speaker", "p.lang")
    return parsed.groupBy("speaker").agg(F.max_by("lang", "ordinal").alias("lang"))


@_register("f7_sentencepiece", """SELECT conv_id, turn, ltrim(replace(p, '▁', ' '), ' ') AS front, trim(replace(p, '▁', ' '), ' ') AS both_ends
    FROM (SELECT conv_id, turn, '▁' || replace(text, ' ', '▁') || '▁' AS p FROM conversations)""")
def f7(spark, sf):
    pieces = F.split(F.concat(F.lit("▁"), F.replace(F.col("text"), F.lit(" "), F.lit("▁")), F.lit("▁")), "(?=▁)")
    return _table(spark, sf, "conversations").select("conv_id", "turn", tx.join_pieces(pieces, False).alias("front"), tx.join_pieces(pieces, True).alias("both_ends"))


_SPELLINGS = ["Whisper", "GIGAAM-ctc", "parakeet-v3", "qwen", "Whisper-Large", "none"]


@_register("f9_models", """SELECT doc_id, m AS model, CASE m WHEN 'whisper' THEN 'Whisper Large v3 Turbo' WHEN 'gigaam' THEN 'GigaAM v3 E2E CTC' WHEN 'parakeet' THEN 'Parakeet TDT v3' WHEN 'qwen3-asr' THEN 'Qwen3-ASR-0.6B' END AS shown
    FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'whisper' WHEN 1 THEN 'gigaam' WHEN 2 THEN 'parakeet' WHEN 3 THEN 'qwen3-asr' WHEN 4 THEN 'whisper' END AS m FROM documents)""")
def f9(spark, sf):
    name = F.element_at(F.array(*map(F.lit, _SPELLINGS)), (F.col("doc_id") % 6 + 1).cast("int"))
    m = tx.model_of(name)
    return _table(spark, sf, "documents").select("doc_id", m.alias("model"), tx.display_name(m).alias("shown"))


@_register("f11_mebibytes", "SELECT doc_id, printf('%.1f MiB', n_chars * 1000 / 1048576.0::DOUBLE) AS shown FROM documents")
def f11(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", tx.mebibytes(F.col("n_chars") * 1000).alias("shown"))


@_register("f12_quantization", "SELECT * FROM (VALUES ('model-q4_0.gguf', 'GGUF Q4_0'), ('model-q6k.gguf', 'GGUF Q6_K'), ('model-Q8_0.gguf', 'GGUF Q8_0'), ('model.gguf', 'GGUF Q8_0')) v(file, quantization)")
def f12(spark, sf):
    files = spark.createDataFrame([("model-q4_0.gguf",), ("model-q6k.gguf",), ("model-Q8_0.gguf",), ("model.gguf",)], "file string")
    return files.select("file", tx.quantization_of(F.col("file")).alias("quantization"))


@_register("f13_parameters", """SELECT n_regionkey * 8 AS encoder_layers, n_nationkey AS decoder_layers, CAST(CASE WHEN n_regionkey = 4 AND n_nationkey <= 4 THEN 809000000 WHEN n_regionkey = 4 THEN 1550000000 WHEN n_regionkey = 3 THEN 769000000 ELSE 0 END AS BIGINT) AS parameters FROM nation""")
def f13(spark, sf):
    n = _table(spark, sf, "nation").select((F.col("n_regionkey") * 8).alias("encoder_layers"), F.col("n_nationkey").alias("decoder_layers"))
    return n.withColumn("parameters", tx.layer_parameters(F.col("encoder_layers"), F.col("decoder_layers")))


@_register("f14_token_budget", """SELECT event_id, CAST(greatest(256, least(4096, ceil(value * 16) + 64)) AS BIGINT) AS file_budget, CAST(greatest(64, least(2048, ceil(value * 16) + 32)) AS BIGINT) AS segment_budget,
    CAST(greatest(64, least(4096, floor(value * 25))) AS BIGINT) AS adapter_budget FROM events""")
def f14(spark, sf):
    return _table(spark, sf, "events").select("event_id", *(tx.token_budget(F.col("value"), k).alias(f"{k}_budget") for k in tx.BUDGETS))


@_register("f15_round_up_div", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE (event_id + event_id % 5 - 1) // (event_id % 5) END AS parts FROM events")
def f15(spark, sf):
    return _table(spark, sf, "events").select("event_id", tx.round_up_div(F.col("event_id"), F.col("event_id") % 5).alias("parts"))


@_register("f16_mel_scales", """SELECT event_id, round(CASE WHEN hz >= 1000 THEN 15 + ln(hz / 1000) * 27 / ln(6.4) ELSE 3 * hz / 200 END, 6) AS slaney, round(2595 * log10(1 + hz / 700), 6) AS htk, round(hz, 3) AS back_slaney, round(hz, 3) AS back_htk
    FROM (SELECT event_id, value * 16 AS hz FROM events)""")
def f16(spark, sf):
    hz = F.col("value") * 16
    return _table(spark, sf, "events").select("event_id", F.round(dsp.hz_to_mel_slaney(hz), 6).alias("slaney"), F.round(dsp.hz_to_mel_htk(hz), 6).alias("htk"), F.round(dsp.mel_to_hz_slaney(dsp.hz_to_mel_slaney(hz)), 3).alias("back_slaney"), F.round(dsp.mel_to_hz_htk(dsp.hz_to_mel_htk(hz)), 3).alias("back_htk"))


@_register("f18_hann", "SELECT n, round(power(sin(pi() * n / 400), 2), 9) AS w FROM range(400) r(n)")
def f18(spark, sf):
    return si.hann_table(spark, 400).select("n", F.round("w", 9).alias("w"))


@_register("f19_logs", """SELECT event_id, round(log10(CASE WHEN p > 1e-10 THEN p ELSE 1e-10 END), 6) AS log_floor, round(ln(CASE WHEN p < 1e-9 THEN 1e-9 WHEN p > 1e9 THEN 1e9 ELSE p END), 6) AS ln_clamped
    FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.0::DOUBLE ELSE power(10.0, value / 10 - 14) END AS p FROM events)""")
def f19(spark, sf):
    p = F.when(F.col("event_id") % 3 == 0, F.lit(0.0)).otherwise(F.pow(F.lit(10.0), F.col("value") / 10 - 14))
    return _table(spark, sf, "events").select("event_id", F.round(dsp.floored_log10(p), 6).alias("log_floor"), F.round(dsp.clamped_ln(p), 6).alias("ln_clamped"))


@_register("f20_l2norm", """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-6), 6) AS total,
    round(embedding[1]::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-6), 6) AS head FROM embeddings""")
def f20(spark, sf):
    e = _table(spark, sf, "embeddings").select("vec_id", vec.l2_normalize(F.col("embedding")).alias("e"))
    return e.select("vec_id", F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.col("e")[0], 6).alias("head"))


@_register("f21_softmax", """SELECT vec_id, round(exp(embedding[1]::DOUBLE) / s, 6) AS p0, round(embedding[2]::DOUBLE - ln(s), 6) AS logp1
    FROM (SELECT vec_id, embedding, list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE))) AS s FROM embeddings)""")
def f21(spark, sf):
    e = _table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return e.select("vec_id", F.round(vec.softmax(F.col("e"))[0], 6).alias("p0"), F.round(vec.log_softmax(F.col("e"))[1], 6).alias("logp1"))


@_register("f22_activations", """SELECT event_id, round(1 / (1 + exp(-x)), 9) AS sigmoid, round(CASE WHEN x > 0 THEN x ELSE 0 END, 9) AS relu, round(x / (1 + exp(-x)), 9) AS silu FROM (SELECT event_id, value / 100 - 1 AS x FROM events)""")
def f22(spark, sf):
    x = F.col("value") / 100 - 1
    return _table(spark, sf, "events").select("event_id", F.round(vec.sigmoid(x), 9).alias("sigmoid"), F.round(vec.relu(x), 9).alias("relu"), F.round(vec.silu(x), 9).alias("silu"))


@_register("f26_lengths", "SELECT event_id, CAST((event_id + 3) // 4 AS BIGINT) AS after_two, CASE WHEN event_id < 320 THEN 0 ELSE (event_id - 320) // 160 + 1 END AS frames FROM events")
def f26(spark, sf):
    return _table(spark, sf, "events").select("event_id", tx.halved_twice(F.col("event_id")).alias("after_two"), tx.uncentred_frames(F.col("event_id"), 320, 160).alias("frames"))


@_register("a13_rtf", "SELECT event_id, CASE WHEN value > 50 THEN event_id / (value - 50) ELSE 0.0::DOUBLE END AS rtf FROM events")
def a13(spark, sf):
    return _table(spark, sf, "events").select("event_id", tx.real_time_factor(F.col("event_id"), F.col("value") - 50).alias("rtf"))


# --- lookups ------------------------------------------------------------------------------------

# a piece for each of the 64 components but one, every third of which begins a word
_VOCAB = [(i, ("▁" if i % 3 == 1 else "") + chr(97 + i % 26) + "aeiou"[i // 26]) for i in range(64) if i != 6]
_VALUES = ", ".join(f"({i}, '{p}')" for i, p in _VOCAB)


@_register("j1_detok", f"""WITH best AS (SELECT vec_id // 10 AS seq, vec_id % 10 AS t, list_position(embedding, list_max(embedding)) - 1 AS tok FROM embeddings),
    v(id, piece) AS (VALUES {_VALUES})
    SELECT seq, ltrim(replace(string_agg(piece, '' ORDER BY t), '▁', ' '), ' ') AS text FROM best JOIN v ON v.id = best.tok GROUP BY seq""")
def j1(spark, sf):
    vocab = spark.createDataFrame(_VOCAB, "id int, piece string")
    return de.pieces_to_text(de.lookup_pieces(de.best_class(scores(spark, sf)), vocab))


@_register("j2_lang_override", f"""WITH {_TRANSCRIPT}, o(speaker, lang) AS (VALUES ('user-a', 'xx'), ('system', 'de'), ('assistant', 'en'))
    SELECT path, idx, speaker, coalesce((SELECT lang FROM o WHERE o.speaker = t.speaker), CASE WHEN contains(speaker, '-') THEN (SELECT lang FROM o WHERE o.speaker = split_part(t.speaker, '-', 1)) END, 'auto') AS lang FROM t""")
def j2(spark, sf):
    o = spark.createDataFrame([(0, "user-a", "yy"), (1, "system", "de"), (2, "assistant", "en"), (3, "user-a", "xx")], "ordinal int, speaker string, lang string")
    return tr.resolve_language(transcripts(spark, sf), o, "auto").select("path", "idx", "speaker", "lang")


@_register("j3_speaker_label", "SELECT vec_id, CASE label WHEN 0 THEN 'Ann' WHEN 1 THEN 'Bo' ELSE 'spk' || label END AS speaker, 'system-' || CASE label WHEN 0 THEN 'Ann' WHEN 1 THEN 'Bo' ELSE 'spk' || label END AS right_speaker FROM embeddings")
def j3(spark, sf):
    names = tr.speaker_names(F.lit(" Ann, ,Bo ,"))
    return _table(spark, sf, "embeddings").select("vec_id", tr.speaker_label(F.col("label"), names).alias("speaker"), tr.speaker_label(F.col("label"), names, "system").alias("right_speaker"))


@_register("j6_segment_slice", f"""WITH {_SAMPLES} SELECT stream, i // 10 AS chunk, count(*) AS n, round(sum(x), 6) AS total FROM s GROUP BY stream, i // 10""")
def j6(spark, sf):
    s = samples(spark, sf)
    rec = s.groupBy(F.col("stream").alias("path")).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p")).select("path", F.transform("p", lambda p: p["x"]).alias("samples"))
    chunks = sg.fixed_chunks(s.groupBy("stream").agg(F.count("*").alias("n")), 10).withColumnRenamed("stream", "path")
    got = tr.segment_samples(chunks, rec)
    return got.select(F.col("path").alias("stream"), "chunk", F.size("samples").cast("long").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


# --- assembly -----------------------------------------------------------------------------------

_LINE = f"'[' || {_stamp(_ms('start_s'))} || ' - ' || {_stamp(_ms('end_s'))} || '] ' || speaker || ': ' || text"


@_register("a10_combined", f"WITH {_TRANSCRIPT} SELECT path, string_agg({_LINE}, chr(10) ORDER BY idx) AS text FROM t GROUP BY path")
def a10(spark, sf):
    return tr.combined_text(transcripts(spark, sf), "path")


@_register("a10_per_speaker", f"WITH {_TRANSCRIPT} SELECT path, speaker, speaker || '.txt' AS file, string_agg(text || chr(10), '' ORDER BY idx) AS text FROM t GROUP BY path, speaker")
def a10b(spark, sf):
    return tr.per_speaker_text(transcripts(spark, sf), "path")


@_register("a10_chunk_texts", "SELECT conv_id AS path, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations WHERE turn % 3 <> 1 AND text <> '' GROUP BY conv_id")
def a10c(spark, sf):
    c = _table(spark, sf, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("chunk"), F.when(F.col("turn") % 3 == 1, "").otherwise(F.col("text")).alias("text"))
    return tr.joined_chunks(c)


@_register("f6_report_rows", f"WITH {_TRANSCRIPT} SELECT path, '| ' || idx || ' | ' || {_stamp(_ms('start_s'))} || ' | ' || {_stamp(_ms('end_s'))} || ' | ' || speaker || ' | ' || replace(language, '|', '\\|') || ' | ' || stop_reason || ' | ' || replace(text, '|', '\\|') || ' |' AS line FROM t")
def f6(spark, sf):
    t = transcripts(spark, sf)
    return t.select("path", tr.report_rows(t).alias("line"))


# --- segmentation -------------------------------------------------------------------------------

_HYST = """runs AS (SELECT stream, voice, grp, min(f) AS a, count(*) AS n FROM (SELECT *, sum(chg) OVER (PARTITION BY stream ORDER BY f) AS grp FROM (SELECT *, CASE WHEN voice IS DISTINCT FROM lag(voice) OVER (PARTITION BY stream ORDER BY f) THEN 1 ELSE 0 END AS chg FROM f)) GROUP BY stream, voice, grp),
    ev AS (SELECT * FROM runs WHERE n >= 2),
    opens AS (SELECT e.stream, e.a FROM ev e WHERE e.voice AND coalesce((SELECT arg_max(p.voice, p.a) FROM ev p WHERE p.stream = e.stream AND p.a < e.a), false) = false),
    seg AS (SELECT o.stream, o.a, coalesce((SELECT min(q.a) FROM ev q WHERE q.stream = o.stream AND q.a > o.a AND NOT q.voice), tot.n) AS b, tot.n AS total FROM opens o JOIN (SELECT stream, count(*) AS n FROM f GROUP BY stream) tot USING (stream))"""
_FRAMES = f"{_SAMPLES}, f AS (SELECT stream, i AS f, x > 0.07 AS voice FROM s)"


@_register("w1_frames", f"WITH {_SAMPLES} SELECT stream, i // 8 AS f, 8::BIGINT AS n, round(sum(x * x) / 8, 6) AS mean_square FROM s GROUP BY stream, i // 8 HAVING count(*) = 8")
def w1(spark, sf):
    return sg.fixed_frames(samples(spark, sf), 8).withColumn("mean_square", F.round("mean_square", 6))


@_register("w6_hysteresis", f"WITH {_FRAMES}, {_HYST} SELECT stream, a AS start, b AS \"end\", total FROM seg")
def w6(spark, sf):
    return sg.hysteresis(frames(spark, sf), 2, 2)


_PADDED = "pd AS (SELECT stream, greatest(a - 1, 0) AS a, least(b + 1, total) AS b FROM seg)"
_MERGED = """mg AS (SELECT p.stream, p.a, (SELECT min(q.b) FROM pd q WHERE q.stream = p.stream AND q.b >= p.b AND NOT EXISTS (SELECT 1 FROM pd r WHERE r.stream = q.stream AND r.a <= q.b AND r.b > q.b)) AS b
    FROM pd p WHERE NOT EXISTS (SELECT 1 FROM pd r WHERE r.stream = p.stream AND r.a < p.a AND r.b >= p.a))"""


@_register("w7_merge", f"WITH {_FRAMES}, {_HYST}, {_PADDED}, {_MERGED} SELECT stream, a AS start, b AS \"end\" FROM mg")
def w7(spark, sf):
    return sg.merge_intervals(sg.pad(sg.hysteresis(frames(spark, sf), 2, 2), 1))


@_register("w12_split", f"WITH {_FRAMES}, {_HYST} SELECT stream, a + 5 * k AS start, least(a + 5 * k + 5, b) AS \"end\", total FROM seg, range(1000) r(k) WHERE a + 5 * k < b")
def w12(spark, sf):
    return sg.split_long(sg.hysteresis(frames(spark, sf), 2, 2), 5)


_G1 = f"WITH {_FRAMES}, {_HYST}, {_PADDED}, {_MERGED}, v AS (SELECT stream, a * 3 + 24 * k AS start, least(a * 3 + 24 * k + 24, b * 3) AS stop FROM mg, range(1000) r(k) WHERE a * 3 + 24 * k < b * 3)"


@_register("g1_vad", f"{_G1} SELECT stream, start, stop AS \"end\" FROM v")
def g1(spark, sf):
    return sg.vad_segments(frames(spark, sf), VAD)


@_register("vad_lines", f"{_G1} SELECT stream, idx, '[' || {_stamp('start * 10')} || ' - ' || {_stamp('stop * 10')} || '] spk0: ' || (stop - start) AS line FROM (SELECT *, CAST(row_number() OVER (PARTITION BY stream ORDER BY start) AS INTEGER) AS idx FROM v)")
def flagship(spark, sf):
    found = sg.vad_segments(frames(spark, sf), VAD).withColumn("idx", F.row_number().over(Window.partitionBy("stream").orderBy("start")))
    line = tr.line_of(F.col("start") / VAD.sample_rate, F.col("end") / VAD.sample_rate, F.lit("spk0"), (F.col("end") - F.col("start")).cast("string"))
    return found.select("stream", "idx", line.alias("line"))


@_register("w10_chunks", f"WITH {_SAMPLES}, n AS (SELECT stream, count(*) AS n FROM s GROUP BY stream) SELECT stream, k AS chunk, k * 30 AS start, least(k * 30 + 30, n) AS \"end\" FROM n, range(100000) r(k) WHERE k * 30 < n")
def w10(spark, sf):
    return sg.fixed_chunks(samples(spark, sf).groupBy("stream").agg(F.count("*").alias("n")), 30)


@_register("p5_valid_segments", f"WITH {_TRANSCRIPT} SELECT path AS stream, idx, least(idx * 4, 20) AS start, least(idx * 4 + 3, 20) AS \"end\" FROM t WHERE least(idx * 4 + 3, 20) > least(idx * 4, 20)")
def p5(spark, sf):
    t = transcripts(spark, sf).select(F.col("path").alias("stream"), (F.col("idx") * 4).alias("start"), (F.col("idx") * 4 + 3).alias("end"), F.lit(20).alias("n"))
    return sg.valid_segments(t, order=("start",)).select("stream", "idx", "start", "end")


# --- clustering ---------------------------------------------------------------------------------


@_register("a1_mean_embedding", """WITH d AS (SELECT label, k, avg(embedding[k]::DOUBLE) AS v FROM embeddings, range(1, 65) r(k) GROUP BY label, k)
    SELECT label, round(sum(v) / greatest(sqrt(sum(v * v)), 1e-6), 6) AS total FROM d GROUP BY label""")
def a1(spark, sf):
    mel = _table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("bin", "x")).select("label", "bin", F.col("x").cast("double").alias("v"))
    e = cl.mean_embedding(mel, "label")
    return e.select("label", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def _kmeans_sql(k: int = 3, rounds: int = 6) -> str:
    """Farthest-point start and unrolled rounds, per group of 25 vectors, as one SQL text."""
    ctes = ["""p AS (SELECT vec_id // 25 AS g, vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS e FROM embeddings)""",
            "c0 AS (SELECT g, 0 AS c, arg_min(e, vec_id) AS e FROM p GROUP BY g)"]
    for i in range(1, k):
        ctes.append(f"""d{i} AS (SELECT p.g, p.vec_id, any_value(p.e) AS e, max(list_dot_product(p.e, c.e)) AS s FROM p JOIN c{i - 1} c ON c.g = p.g GROUP BY p.g, p.vec_id)""")
        ctes.append(f"""c{i} AS (SELECT * FROM c{i - 1} UNION ALL SELECT g, {i} AS c, e FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s, vec_id) AS r FROM d{i}) WHERE r = 1)""")
    last = f"c{k - 1}"
    for r in range(rounds):
        ctes.append(f"""a{r} AS (SELECT g, vec_id, e, c FROM (SELECT p.g, p.vec_id, p.e, c.c, row_number() OVER (PARTITION BY p.vec_id ORDER BY list_dot_product(p.e, c.e) DESC, c.c) AS r FROM p JOIN {last} c ON c.g = p.g) WHERE r = 1)""")
        ctes.append(f"""m{r} AS (SELECT g, c, k, avg(e[k]) AS v FROM a{r}, range(1, 65) r(k) GROUP BY g, c, k)""")
        ctes.append(f"""n{r} AS (SELECT g, c, list_transform(list(v ORDER BY k), lambda x: x / sqrt(list_sum(list_transform(list(v ORDER BY k), lambda y: y * y)))) AS e FROM m{r} GROUP BY g, c)""")
        last = f"n{r}"
    return f"""WITH {', '.join(ctes)}, f AS (SELECT g, c, min(vec_id) AS first FROM a{rounds - 1} GROUP BY g, c), o AS (SELECT g, c, row_number() OVER (PARTITION BY g ORDER BY first, c) - 1 AS n FROM f)
    SELECT a.g AS stream, a.vec_id AS seg_id, CAST(o.n AS INTEGER) AS speaker_id FROM a{rounds - 1} a JOIN o ON o.g = a.g AND o.c = a.c"""


@_register("g3_kmeans", _kmeans_sql(rounds=25))
def g3(spark, sf):
    e = _table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 25).cast("long").alias("stream"), F.col("vec_id").alias("seg_id"), F.col("vec_id").alias("start"), "embedding")
    return cl.cluster_segments(e, 3)


@_register("j8_nearest_centroid", """WITH c AS (SELECT vec_id AS cluster, embedding AS e FROM embeddings WHERE vec_id < 4)
    SELECT vec_id AS id, arg_max(cluster, struct_pack(d := d, c := -cluster)) AS cluster FROM (SELECT v.vec_id, c.cluster, list_sum(list_transform(range(1, 65), lambda k: v.embedding[k]::DOUBLE * c.e[k]::DOUBLE)) AS d FROM embeddings v, c) GROUP BY vec_id""")
def j8(spark, sf):
    e = _table(spark, sf, "embeddings")
    points = e.select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("dim", "x")).select("id", "dim", F.col("x").cast("double").alias("v"))
    centroids = points.where("id < 4").withColumnRenamed("id", "cluster")
    return cl.assign_nearest(points, centroids)


@_register("w13_relabel", "SELECT g AS stream, label AS cluster, CAST(row_number() OVER (PARTITION BY g ORDER BY first, label) - 1 AS INTEGER) AS speaker_id FROM (SELECT vec_id // 50 AS g, label, min(vec_id) AS first FROM embeddings GROUP BY ALL)")
def w13(spark, sf):
    return cl.rank_by_first_start(_table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 50).cast("long").alias("stream"), F.col("label").alias("cluster"), F.col("vec_id").alias("start")))


# --- decoding -----------------------------------------------------------------------------------

_BEST = "best AS (SELECT vec_id // 10 AS seq, CAST(vec_id % 10 AS INTEGER) AS t, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS tok FROM embeddings)"


@_register("a15_argmax", f"WITH {_BEST} SELECT * FROM best")
def a15(spark, sf):
    return de.best_class(scores(spark, sf))


@_register("w8_collapse", f"WITH {_BEST} SELECT b.* FROM best b LEFT JOIN best p ON p.seq = b.seq AND p.t = b.t - 1 WHERE b.tok <> 7 AND (p.tok IS NULL OR p.tok <> b.tok)")
def w8(spark, sf):
    return de.collapse(de.best_class(scores(spark, sf)), 7)


@_register("o1_ctc", f"""WITH {_BEST}, v(id, piece) AS (VALUES {_VALUES}), k AS (SELECT b.* FROM best b LEFT JOIN best p ON p.seq = b.seq AND p.t = b.t - 1 WHERE b.tok <> 0 AND (p.tok IS NULL OR p.tok <> b.tok))
    SELECT seq, ltrim(replace(string_agg(piece, '' ORDER BY t), '▁', ' '), ' ') AS text FROM k JOIN v ON v.id = k.tok GROUP BY seq""")
def o1(spark, sf):
    return de.ctc_greedy(scores(spark, sf), spark.createDataFrame(_VOCAB, "id int, piece string"), 0)


@_register("p11_eos_cut", "SELECT vec_id, list_filter(CASE WHEN list_position(x, 5) > 0 THEN x[1:list_position(x, 5) - 1] ELSE x END, lambda y: y <> 2) AS kept FROM (SELECT vec_id, list_transform(range(0, vec_id % 9), lambda i: CAST((vec_id * 7 + i * i) % 11 AS INTEGER)) AS x FROM embeddings)")
def p11(spark, sf):
    n = (F.col("vec_id") % 9).cast("int")
    x = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: ((F.col("vec_id") * 7 + i * i) % 11).cast("int"))).otherwise(F.array().cast("array<int>"))
    return _table(spark, sf, "embeddings").select("vec_id", de.without_special(de.cut_at_eos(x, (5,)), F.array(F.lit(2))).alias("kept"))


@_register("p12_suppress", "SELECT vec_id // 10 AS seq, CAST(vec_id % 10 AS INTEGER) AS t, CAST(list_position(embedding[3:], list_max(embedding[3:])) + 1 AS INTEGER) AS tok FROM embeddings")
def p12(spark, sf):
    return de.best_class(de.suppressed(scores(spark, sf), spark.createDataFrame([(0,), (1,)], "class int")))


_IDS = "x AS (SELECT doc_id, list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: CAST(unicode(lower(c)) % 29 AS INTEGER)) AS ids FROM documents)"


@_register("a8_bigram_ratio", f"WITH {_IDS} SELECT doc_id, round(1 / greatest(0.01, len(list_distinct(list_transform(range(1, len(ids)), lambda i: ids[i] * 1000 + ids[i + 1])))::DOUBLE / (len(ids) - 1)), 6) AS ratio FROM x WHERE len(ids) > 1")
def a8(spark, sf):
    return tokens(spark, sf).where(F.size("ids") > 1).select("doc_id", F.round(de.bigram_compression(F.col("ids")), 6).alias("ratio"))


@_register("o8_repetition", f"""WITH {_IDS} SELECT doc_id, CASE WHEN len(ids) < 128 THEN false ELSE len(list_distinct(ids[len(ids) - 95 : len(ids)])) <= 6
    OR len(list_filter(range(1, 17), lambda p: ids[len(ids) - 6 * p + 1 : len(ids) - p] = ids[len(ids) - 5 * p + 1 : len(ids)])) > 0 END AS loops FROM x""")
def o8(spark, sf):
    return tokens(spark, sf).select("doc_id", de.repetition_loop(F.col("ids")).alias("loops"))


@_register("o4_fallback", """WITH a AS (SELECT vec_id // 6 AS seq, (vec_id % 6) * 0.2::DOUBLE AS temperature, 1 + abs(embedding[1])::DOUBLE * 10 AS compression_ratio, embedding[2]::DOUBLE * 10 AS avg_logprob FROM embeddings)
    SELECT seq, round(coalesce(min(temperature) FILTER (WHERE compression_ratio < 2.4 AND avg_logprob > -1), max(temperature)), 3) AS temperature, bool_or(compression_ratio < 2.4 AND avg_logprob > -1) AS accepted FROM a GROUP BY seq""")
def o4(spark, sf):
    e = _table(spark, sf, "embeddings")
    a = e.select(F.floor(F.col("vec_id") / 6).cast("long").alias("seq"), ((F.col("vec_id") % 6) * 0.2).alias("temperature"), (1 + F.abs(F.col("embedding")[0].cast("double")) * 10).alias("compression_ratio"), (F.col("embedding")[1].cast("double") * 10).alias("avg_logprob"))
    return de.first_accepted(a).select("seq", F.round("temperature", 3).alias("temperature"), "accepted")


@_register("a9_mean_logprob", "SELECT label, round(sum(ln(abs(embedding[1]::DOUBLE) + 0.01)) / greatest(1, count(*) - 1), 6) AS avg_logprob FROM embeddings GROUP BY label")
def a9(spark, sf):
    e = _table(spark, sf, "embeddings").groupBy("label").agg(F.sum(F.log(F.abs(F.col("embedding")[0].cast("double")) + 0.01)).alias("s"), F.count("*").alias("n"))
    return e.select("label", F.round(de.mean_log_probability(F.col("s"), F.col("n") - 1), 6).alias("avg_logprob"))


@_register("o2_tdt", """WITH RECURSIVE st AS (SELECT vec_id // 20 AS seq, CAST(vec_id % 20 AS INTEGER) AS t, list_position(embedding[:-5], list_max(embedding[:-5])) - 1 AS tok, list_position(embedding[-4:], list_max(embedding[-4:])) - 1 AS d FROM embeddings),
    walk(seq, t, emitted, n) AS (SELECT DISTINCT seq, 0, 0, 0 FROM st UNION ALL
        SELECT w.seq, CASE WHEN s.tok = 5 THEN w.t + greatest(s.d, 1) WHEN w.emitted + 1 >= 10 AND w.emitted > 0 THEN w.t + s.d + 1 ELSE w.t + s.d END,
            CASE WHEN s.tok = 5 OR s.d > 0 OR w.emitted + 1 >= 10 THEN 0 ELSE w.emitted + 1 END, w.n + CASE WHEN s.tok = 5 THEN 0 ELSE 1 END
        FROM walk w JOIN st s ON s.seq = w.seq AND s.t = w.t)
    SELECT seq, CAST(pos AS INTEGER) AS pos, CAST(tok AS INTEGER) AS tok FROM (SELECT w.seq, w.n AS pos, s.tok FROM walk w JOIN st s ON s.seq = w.seq AND s.t = w.t WHERE s.tok <> 5)""")
def o2(spark, sf):
    e = _table(spark, sf, "embeddings")
    s = e.select(F.floor(F.col("vec_id") / 20).cast("long").alias("seq"), (F.col("vec_id") % 20).cast("int").alias("t"), F.expr("slice(embedding, 1, size(embedding) - 4)").alias("tokens"), F.slice("embedding", -4, 4).alias("lengths"))
    return de.tdt_decode(s, 5, [0, 1, 2, 3])


# --- signal -------------------------------------------------------------------------------------


def _rows(spark, sf):
    s = samples(spark, sf)
    return s.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p")).select("stream", F.transform("p", lambda p: p["x"]).alias("a"))


@_register("p1_channel", f"WITH {_SAMPLES} SELECT stream, count(*) AS n, round(sum(x), 6) AS total FROM s WHERE i % 2 = 1 GROUP BY stream")
def p1(spark, sf):
    a = _rows(spark, sf).where(F.size("a") > 1).select("stream", si.channel(F.col("a"), 2, 1).alias("a"))
    return a.select("stream", F.size("a").cast("long").alias("n"), F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@_register("p2_mono", f"WITH {_SAMPLES} SELECT stream, i // 2 AS i, round(avg(x), 9) AS x FROM s GROUP BY stream, i // 2")
def p2(spark, sf):
    return si.downmix(samples(spark, sf), 2).withColumn("x", F.round("x", 9))


@_register("p3_mix", f"WITH {_SAMPLES} SELECT a.stream, count(*) AS n, round(sum(0.5 * (a.x + b.x)), 6) AS total FROM s a JOIN s b ON a.stream = b.stream AND b.i = a.i + 1 WHERE a.i % 2 = 0 GROUP BY a.stream")
def p3(spark, sf):
    a = _rows(spark, sf).where(F.size("a") > 1).select("stream", si.mix(si.channel(F.col("a"), 2, 0), si.channel(F.col("a"), 2, 1)).alias("m"))
    return a.select("stream", F.size("m").cast("long").alias("n"), F.round(F.aggregate("m", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@_register("p4_pcm16", "SELECT event_id, CAST(trunc(greatest(-1.0, least(1.0, value / 200 - 0.5)) * 32767) AS SMALLINT) AS pcm FROM events")
def p4(spark, sf):
    return _table(spark, sf, "events").select("event_id", si.pcm16(F.col("value") / 200 - 0.5).alias("pcm"))


@_register("w5_preemph", f"WITH {_SAMPLES} SELECT a.stream, a.i, round(a.x - coalesce(0.97 * b.x, 0), 9) AS x FROM s a LEFT JOIN s b ON b.stream = a.stream AND b.i = a.i - 1")
def w5(spark, sf):
    return si.pre_emphasis(samples(spark, sf)).withColumn("x", F.round("x", 9))


@_register("x9_pad_or_trim", f"WITH {_SAMPLES} SELECT stream, 50::BIGINT AS n, round(sum(CASE WHEN i < 50 THEN x ELSE 0 END), 6) AS total FROM s GROUP BY stream")
def x9(spark, sf):
    a = _rows(spark, sf).select("stream", si.pad_or_trim(F.col("a"), 50).alias("a"))
    return a.select("stream", F.size("a").cast("long").alias("n"), F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


_REFLECT = f"""{_SAMPLES}, n AS (SELECT stream, count(*) AS n FROM s GROUP BY stream), g AS (SELECT stream, n, fr AS frame, j, fr * 8 + j - 16 AS q FROM (SELECT stream, n, unnest(range(0, n // 8 + 1)) AS fr FROM n), range(32) u(j)),
    fx AS (SELECT g.stream, g.frame, CAST(g.j AS INTEGER) AS j, coalesce(s.x, 0) AS x FROM g LEFT JOIN s ON s.stream = g.stream AND s.i = CASE WHEN q < 0 THEN -q WHEN q >= n THEN 2 * n - q - 2 ELSE q END)"""


@_register("w2_reflect_frames", f"WITH {_REFLECT} SELECT * FROM fx")
def w2(spark, sf):
    return si.frames(samples(spark, sf), 32, 8)


@_register("w3_plain_frames", f"WITH {_SAMPLES}, n AS (SELECT stream, count(*) AS n FROM s GROUP BY stream) SELECT g.stream, g.fr AS frame, CAST(g.j AS INTEGER) AS j, s.x FROM (SELECT stream, fr, j FROM (SELECT stream, unnest(range(0, (n - 32) // 8 + 1)) AS fr FROM n WHERE n >= 32), range(32) u(j)) g JOIN s ON s.stream = g.stream AND s.i = g.fr * 8 + g.j")
def w3(spark, sf):
    return si.frames(samples(spark, sf), 32, 8, "none")


@_register("w4_zero_frames", f"WITH {_SAMPLES}, n AS (SELECT stream, count(*) AS n FROM s GROUP BY stream) SELECT g.stream, g.fr AS frame, CAST(g.j AS INTEGER) AS j, coalesce(s.x, 0) AS x FROM (SELECT stream, fr, j FROM (SELECT stream, unnest(range(0, (n - 8) // 8 + 1)) AS fr FROM n WHERE n >= 8), range(32) u(j)) g LEFT JOIN s ON s.stream = g.stream AND s.i = g.fr * 8 + g.j - 12")
def w4(spark, sf):
    return si.frames(samples(spark, sf), 32, 8, "zero", 24)


_POWER = f"""{_REFLECT}, pw AS (SELECT stream, frame, CAST(k AS INTEGER) AS k, power(sum(x * h * cos(2 * pi() * k * j / 32)), 2) + power(sum(x * h * sin(2 * pi() * k * j / 32)), 2) AS power
    FROM (SELECT *, power(sin(pi() * j / 32), 2) AS h FROM fx), range(17) r(k) GROUP BY stream, frame, k)"""


@_register("x5_power", f"WITH {_POWER} SELECT stream, frame, k, round(power, 6) AS power FROM pw")
def x5(spark, sf):
    return si.power_by_join(si.frames(samples(spark, sf), 32, 8), 32).withColumn("power", F.round("power", 6))


def _bank_sql(scale: str, mels: int, n_fft: int, rate: int) -> str:
    if scale == "slaney":
        top = f"(15 + ln({rate / 2} / 1000) * 27 / ln(6.4))"
        hz = f"CASE WHEN {top} * p / {mels + 1} >= 15 THEN 1000 * exp(({top} * p / {mels + 1} - 15) * ln(6.4) / 27) ELSE {top} * p / {mels + 1} * 200 / 3 END"
    else:
        top = f"(2595 * log10(1 + {rate / 2} / 700))"
        hz = f"700 * (power(10, {top} * p / {mels + 1} / 2595) - 1)"
    area = " * 2 / (c.hz - a.hz)" if scale == "slaney" else ""
    return f"""e AS (SELECT p, {hz} AS hz FROM range({mels + 2}) r(p)),
    bank AS (SELECT * FROM (SELECT CAST(a.p AS INTEGER) AS bin, CAST(k AS INTEGER) AS k, greatest(0, least((k * {rate / n_fft} - a.hz) / (b.hz - a.hz), (c.hz - k * {rate / n_fft}) / (c.hz - b.hz))){area} AS w
        FROM e a JOIN e b ON b.p = a.p + 1 JOIN e c ON c.p = a.p + 2, range({n_fft // 2 + 1}) r(k)) WHERE w > 0)"""


@_register("x6_slaney", f"WITH {_bank_sql('slaney', 20, 256, 16000)} SELECT bin, k, round(w, 9) AS w FROM bank")
def x6(spark, sf):
    return dsp.filterbank(spark, 16000, 256, 20).withColumn("w", F.round("w", 9))


@_register("x7_htk", f"WITH {_bank_sql('htk', 20, 256, 16000)} SELECT bin, k, round(w, 9) AS w FROM bank")
def x7(spark, sf):
    return dsp.filterbank(spark, 16000, 256, 20, "htk").withColumn("w", F.round("w", 9))


_MEL = f"{_POWER}, {_bank_sql('htk', 4, 32, 16000)}, mel AS (SELECT stream, frame, bin, sum(power * w) AS v FROM pw JOIN bank ON bank.k = pw.k GROUP BY stream, frame, bin)"


def _mel(spark, sf):
    return si.apply_filterbank(si.power_by_join(si.frames(samples(spark, sf), 32, 8), 32), dsp.filterbank(spark, 16000, 32, 4, "htk"))


@_register("j7_melapply", f"WITH {_MEL} SELECT stream, frame, bin, round(v, 6) AS v FROM mel")
def j7(spark, sf):
    return _mel(spark, sf).withColumn("v", F.round("v", 6))


@_register("x8_lognorm", f"WITH {_MEL}, l AS (SELECT *, log10(greatest(v, 1e-10)) AS lg FROM mel), l2 AS (SELECT * FROM l WHERE frame < (SELECT max(frame) FROM l m WHERE m.stream = l.stream)) SELECT a.stream, a.frame, a.bin, round((greatest(a.lg, b.top - 8) + 4) / 4, 6) AS v FROM l2 a JOIN (SELECT stream, max(lg) AS top FROM l2 GROUP BY stream) b ON a.stream = b.stream")
def x8(spark, sf):
    return si.normalize_whisper(_mel(spark, sf)).withColumn("v", F.round("v", 6))


@_register("a5_utterance", f"WITH {_MEL} SELECT a.stream, a.frame, a.bin, round((a.v - b.m) / greatest(b.s, 1e-10), 6) AS v FROM mel a JOIN (SELECT stream, avg(v) AS m, stddev_pop(v) AS s FROM mel GROUP BY stream) b USING (stream)")
def a5(spark, sf):
    return si.normalize_utterance(_mel(spark, sf)).withColumn("v", F.round("v", 6))


@_register("a6_perfeature", f"WITH {_MEL} SELECT a.stream, a.frame, a.bin, round((a.v - b.m) / greatest(b.s, 1e-5), 6) AS v FROM mel a JOIN (SELECT stream, bin, avg(v) AS m, stddev_pop(v) AS s FROM mel GROUP BY stream, bin) b USING (stream, bin)")
def a6(spark, sf):
    return si.normalize_features(_mel(spark, sf)).withColumn("v", F.round("v", 6))


# --- inventory ----------------------------------------------------------------------------------

_FILES = [
    ("a", "config.json", 10), ("a", "vocab.json", 20), ("a", "merges.txt", 30), ("a", "model.safetensors", 4000), ("a", "model-q4_0.gguf", 700), ("a", "model-q8_0.gguf", 900),
    ("b", "config.json", 11), ("b", "model-00001-of-00002.safetensors", 5000), ("b", "model-00002-of-00002.safetensors", 6000), ("b", "model.gguf", 800),
    ("c", "mel_filters.bin", 12), ("c", "model-00001-of-00002.safetensors", 70), ("d", "model-00002-of-00002.safetensors", 8), ("d", "model-00001-of-00002.safetensors", 9), ("e", "notes.txt", 1),
]
_INDEX = [("b", '{"weight_map": {"x": "model-00002-of-00002.safetensors", "y": "model-00001-of-00002.safetensors", "z": "model-00001-of-00002.safetensors"}}'), ("c", '{"weight_map": {"x": "model-00001-of-00002.safetensors", "y": "model-00002-of-00002.safetensors"}}')]
_TENSORS = [("thinker.embed_tokens.weight", 2, 400), ("thinker.layers.0.q.weight", 2, 100), ("thinker.layers.0.norm.weight", 1, 8), ("thinker.layers.0.q.bias", 1, 4), ("audio.conv.weight", 4, 50), ("thinker.lm.input_layernorm.weight", 2, 9)]
_FILE_VALUES = ", ".join(f"('{d}', '{n}', {s})" for d, n, s in _FILES)


def _files(spark):
    return spark.createDataFrame(_FILES, "dir string, name string, size long")


@_register("s3_shards", "SELECT * FROM (VALUES ('a', ['model.safetensors'], NULL), ('b', ['model-00001-of-00002.safetensors', 'model-00002-of-00002.safetensors'], NULL), ('c', NULL, 'missing shard model-00002-of-00002.safetensors'), ('d', ['model-00001-of-00002.safetensors', 'model-00002-of-00002.safetensors'], NULL), ('e', NULL, 'no safetensors')) v(dir, weights, error)")
def s3(spark, sf):
    return inv.resolve_weights(_files(spark), spark.createDataFrame(_INDEX, "dir string, json string"))


@_register("s5_prefer_gguf", f"WITH f(dir, name, size) AS (VALUES {_FILE_VALUES}), r(name, rank) AS (VALUES ('model-q8_0.gguf', 1), ('model-q6k.gguf', 2), ('model-q6_k.gguf', 3), ('model-q4_0.gguf', 4), ('model.gguf', 5)) SELECT dir, arg_min(name, rank) AS preferred_gguf FROM f JOIN r USING (name) GROUP BY dir")
def s5(spark, sf):
    return inv.preferred_gguf(_files(spark))


@_register("s15_gguf_files", f"WITH f(dir, name, size) AS (VALUES {_FILE_VALUES}) SELECT dir, list(name ORDER BY name) AS gguf_files FROM f WHERE name LIKE '%.gguf' GROUP BY dir")
def s15(spark, sf):
    return inv.gguf_files(_files(spark))


@_register("p8_quant_pred", "SELECT name, CAST(\"rank\" AS INTEGER) AS \"rank\", CAST(bytes AS BIGINT) AS bytes, \"rank\" = 2 AND suffix(name, '.weight') AND NOT contains(name, 'norm') AND NOT contains(name, 'embed_tokens.weight') AS quantize FROM (VALUES " + ", ".join(map(str, _TENSORS)) + ") v(name, \"rank\", bytes) WHERE starts_with(name, 'thinker.')")
def p8(spark, sf):
    return inv.quantize_plan(spark.createDataFrame(_TENSORS, "name string, rank int, bytes long"), "thinker.")


@_register("a11_sizes", "SELECT split_part(name, '.', 1) AS scope, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM (VALUES " + ", ".join(map(str, _TENSORS)) + ") v(name, \"rank\", bytes) GROUP BY ALL")
def a11(spark, sf):
    return inv.weight_summary(spark.createDataFrame(_TENSORS, "name string, rank int, bytes long"))


@_register("m4_inventory", "SELECT * FROM (VALUES ('a', 'model-q8_0.gguf', 4000::BIGINT, true, true), ('b', 'model.gguf', 11000, false, true), ('c', NULL, NULL, false, false), ('d', NULL, 17, false, true), ('e', NULL, NULL, false, false)) v(dir, preferred_gguf, weights_bytes, ready_transcribe, ready_quantize)")
def m4(spark, sf):
    return inv.inspect(_files(spark), spark.createDataFrame(_INDEX, "dir string, json string")).select("dir", "preferred_gguf", "weights_bytes", "ready_transcribe", "ready_quantize")


@_register("s9_vocab", "SELECT * FROM (VALUES (3, 'a', 'token_to_id'), (4, 'b', 'token_to_id'), (7, 'x', 'id_to_piece'), (2, 'p', 'piece_to_record')) v(id, piece, shape)")
def s9(spark, sf):
    texts = {"token_to_id": '{"a": 3, "b": 4}', "id_to_piece": '{"7": "x", "seven": "y"}', "piece_to_record": '{"p": {"id": 2, "score": -1.5}}'}
    parts = [inv.vocabulary(spark.createDataFrame([(t,)], "json string"), k).withColumn("shape", F.lit(k)) for k, t in texts.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_register("s7_config", "SELECT * FROM (VALUES ('896', '18')) v(d_model, layers)")
def s7(spark, sf):
    c = spark.createDataFrame([('{"audio": {"d_model": 896}}',)], "json string")
    return c.select(inv.config_value(F.col("json"), "$.audio.d_model", 1024).alias("d_model"), inv.config_value(F.col("json"), "$.audio.layers", 18).alias("layers"))


# --- composite ----------------------------------------------------------------------------------


@_register("f8_bytebpe")
def f8(spark, sf):
    """Whole texts as byte-level pieces and back; equals the trimmed text."""
    d = _table(spark, sf, "documents")
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in own)}
    table = F.create_map(*[F.lit(v) for b in range(256) for v in (f"{b:02X}", names[b])])
    pairs = F.filter(F.split(F.hex(F.col("text").cast("binary")), "(?<=\\G..)"), lambda h: h != "")
    return de.byte_level_decode(d.select(F.col("doc_id").alias("seq"), F.transform(pairs, lambda h: F.element_at(table, h)).alias("pieces")))


@_register("g11_diarize_stub")
def g11(spark, sf):
    """Streams as recordings, each value held for 4,800 samples, clustered into two speakers and transcribed by the stand-in model."""
    from sonorel.plans.diarize import DiarizeOptions, diarize

    rec = _rows(spark, sf).repartition(64, "stream").select(F.col("stream").cast("string").alias("path"), F.lit(16000).alias("sample_rate"), F.lit(1).alias("channels"), F.transform("a", lambda x: x.cast("float")).alias("samples"), F.lit(4800).alias("hold"))
    return diarize(rec, DiarizeOptions(overrides=["spk1=de"], language="en"))
