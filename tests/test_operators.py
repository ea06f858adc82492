"""Operators against plain versions and hand-made cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonorel.functions import text as tx
from sonorel.operators import clustering as cl, decoding as de, neural as nn, segmentation as sg, signal as si, transcript as tr
from sonorel.plans import diarize as dz, models
from sonorel.sources import binary, inventory


def loop_segments(voice, min_speech, min_silence):
    """The scan, frame by frame."""
    out, opened, kind, begun, n = [], None, None, 0, 0
    for f, v in enumerate(voice):
        if v == kind:
            n += 1
        else:
            kind, begun, n = v, f, 1
        if v and n >= min_speech and opened is None:
            opened = begun
        if not v and n >= min_silence and opened is not None:
            out.append((opened, begun))
            opened = None
    if opened is not None:
        out.append((opened, len(voice)))
    return out


def test_hysteresis_pad_merge_split(spark):
    rng = random.Random(4)
    cases = {0: [True] * 12, 1: [False] * 12, 2: [True] * 3, 3: [True] * 2 + [False] * 2 + [True] * 3}
    cases |= {k: [rng.random() < 0.55 for _ in range(rng.randint(1, 60))] for k in range(4, 120)}
    rows = [(s, f, v) for s, vs in cases.items() for f, v in enumerate(vs)]
    frames = spark.createDataFrame(rows, "stream long, f long, voice boolean")
    got = {(r.stream, r.start, r.end) for r in sg.hysteresis(frames, 3, 2).collect()}
    assert got == {(s, a, b) for s, vs in cases.items() for a, b in loop_segments(vs, 3, 2)}
    want = set()
    for s, vs in cases.items():
        merged = []
        for a, b in loop_segments(vs, 3, 2):
            a, b = max(0, a - 1), min(len(vs), b + 1)
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in merged:
            want |= {(s, p, min(p + 5, b)) for p in range(a, b, 5)}
    final = sg.split_long(sg.merge_intervals(sg.pad(sg.hysteresis(frames, 3, 2), 1)), 5)
    assert {(r.stream, r.start, r.end) for r in final.collect()} == want


def test_vad_config_is_checked():
    with pytest.raises(ValueError):
        sg.VadConfig(frame_ms=25)
    with pytest.raises(ValueError):
        sg.VadConfig(mode=4)
    assert sg.VadConfig().frame_len == 480


def test_streaming_hysteresis_state_machine(spark, tmp_path):
    from sonorel.streaming import stream_hysteresis

    voice = [False, True, True, True, False, False, True, True, True, True, False, False, False]
    spark.createDataFrame([(1, f, v) for f, v in enumerate(voice)], "stream long, f long, voice boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    frames = spark.readStream.schema("stream long, f long, voice boolean").parquet(str(tmp_path / "in"))
    q = stream_hysteresis(frames, 3, 2).writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.start, r.end) for r in spark.table("closed").collect()} == {(1, 4), (6, 10)}


def test_two_blobs():
    x = np.array([[1, 0], [0.9, 0.1], [0.95, 0.05], [0, 1], [0.1, 0.9], [0.05, 0.95]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert cl.cosine_kmeans(x, 2).tolist() == [0, 0, 0, 1, 1, 1]
    assert cl.cosine_kmeans(x, 1).tolist() == [0] * 6
    assert cl.cosine_kmeans(x[:1], 3).tolist() == [0]
    assert cl.relabel(np.array([2, 2, 0]), np.array([5, 6, 1])).tolist() == [1, 1, 0]
    with pytest.raises(ValueError):
        cl.cosine_kmeans(x, 0)


def test_tdt_quirks():
    dur = [0, 1, 2, 3]

    def run(script, length):
        calls = iter(script)
        return de.tdt_greedy(lambda t, s: (np.eye(6)[(c := next(calls))[0]], np.eye(4)[c[1]]), length, 5, dur)

    assert run([(1, 1), (5, 0), (2, 3)], 3) == [1, 2]
    seen = []

    def steps(t, s):
        seen.append(t)
        return (np.eye(6)[1], np.eye(4)[2 if len(seen) == 10 else 0]) if len(seen) <= 10 else (np.eye(6)[5], np.eye(4)[1])

    assert de.tdt_greedy(steps, 4, 5, dur) == [1] * 10
    assert seen[10:] == [3]  # the tenth token's duration of two, and one more


def test_fallback_and_generation():
    made = iter([de.Decoded([1], -2.0, 1.0, 0.0), de.Decoded([2], -0.5, 3.0, 0.2), de.Decoded([3], -0.5, 1.0, 0.4)])
    assert de.decode_with_fallback(lambda t: next(made)).tokens == [3]
    assert de.decode_with_fallback(lambda t: de.Decoded([], -9, 1, t)).temperature == 1.0
    got = de.decode_segment(lambda ids: np.array([0.0, 5.0, 1.0]) if len(ids) < 3 else np.array([9.0, 0, 0]), [1], 0, 10)
    assert got.tokens == [1, 1] and got.avg_logprob < 0
    again = [de.decode_segment(lambda ids: np.zeros(4), [1], 0, 10, 0.7, seed=42).tokens for _ in range(2)]
    assert again[0] == again[1]
    assert de.generate(lambda ids: np.eye(200)[1], 400)[1] == "repetition"
    assert de.generate(lambda ids: np.eye(200)[len(ids) % 97], 50) == (list(range(50)), "max_tokens")
    assert de.generate(lambda ids: np.eye(8)[7 if ids else 1], 50, (7,)) == ([1], "eos")
    assert de.prompt(1, None, 2, 3) == [1, 2, 3]


def test_repetition_thresholds(spark):
    cases = {"short": [1] * 127, "few": [1] * 128, "six": [i % 6 for i in range(128)], "period16": [*range(100, 200), *[i % 16 for i in range(96)]], "period17": [*range(100, 200), *[i % 17 for i in range(102)]], "free": list(range(300))}
    df = spark.createDataFrame(list(cases.items()), "k string, ids array<int>")
    got = {r.k: r.v for r in df.select("k", de.repetition_loop(F.col("ids")).alias("v")).collect()}
    assert got == {k: de.loops(v) for k, v in cases.items()}
    assert got == {"short": False, "few": True, "six": True, "period16": True, "period17": False, "free": False}


def test_output_parser(spark):
    cases = [("", None), ("  hi ", None), ("language Russian<asr_text> a", None), ("x\n\n LANGUAGE new GUINEA\nlanguage b<asr_text>t", None), ("language None<asr_text>", None), ("a<asr_text>b<asr_text>c", None), ("language en<asr_text>x", " DE ")]
    df = spark.createDataFrame(cases, "raw string, forced string").select(tx.parse_output(F.col("raw"), F.col("forced")).alias("p"))
    assert [tuple(r.p) for r in df.collect()] == [("", ""), ("", "hi"), ("Russian", "a"), ("New guinea", "t"), ("", ""), ("", "b<asr_text>c"), ("DE", "language en<asr_text>x")]


def test_names_and_stamps(spark):
    df = spark.createDataFrame([("Ünï x", 0.0), ("", -1.0), ("a.b-c_1", 360000.5)], "n string, s double")
    rows = df.select(tx.sanitize_filename(F.col("n")).alias("f"), tx.format_timestamp(F.col("s")).alias("t")).collect()
    assert [tuple(r) for r in rows] == [("_n__x", "00:00:00.000"), ("speaker", "00:00:00.000"), ("a.b-c_1", "100:00:00.500")]


def test_language_override_order(spark):
    seg = spark.createDataFrame([("a",), ("a-1",), ("b-x-y",), ("c",)], "speaker string")
    o = spark.createDataFrame([(0, "a", "en"), (1, "a-1", "de"), (2, "b", "fr"), (3, "a", "es")], "ordinal int, speaker string, lang string")
    got = {r.speaker: r.lang for r in tr.resolve_language(seg, o, None).collect()}
    assert got == {"a": "es", "a-1": "de", "b-x-y": "fr", "c": None}


def test_wav_round_trip_and_formats(spark, tmp_path):
    import struct

    x = (0.5 * np.sin(np.arange(1600) / 7)).astype(np.float32)
    raw = binary.encode_wav(np.column_stack([x, -x]).ravel(), 16000, 2)
    rate, channels, got = binary.decode_wav(raw)
    assert (rate, channels) == (16000, 2) and np.abs(got[0::2] - x).max() < 1e-4
    body = x.astype("<f4").tobytes()
    f32 = b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3, 1, 8000, 32000, 4, 32) + b"data" + struct.pack("<I", len(body)) + body
    assert np.array_equal(binary.decode_wav(f32)[2], x)
    with pytest.raises(ValueError):
        binary.decode_wav(b"nothing")
    (tmp_path / "a.wav").write_bytes(raw)
    row = binary.read_wav(spark, str(tmp_path)).first()
    assert row.channels == 2 and len(row.samples) == 3200


def test_mel_shapes_and_scales():
    assert si.log_mel(np.zeros(16000), "gigaam").shape == (99, 64)
    assert si.log_mel(np.zeros(100), "gigaam").shape == (0, 64)
    assert si.log_mel(np.random.default_rng(0).normal(size=16000), "whisper").shape == (100, 128)
    v = si.log_mel(np.random.default_rng(0).normal(size=16000), "parakeet")
    assert v.shape[1] == 128 and np.abs(v.mean(axis=0)).max() < 1e-9
    assert si.filter_matrix(16000, 400, 128).shape == (128, 201) and (si.filter_matrix(16000, 400, 128).sum(axis=1) > 0).all()
    assert abs(si._unslaney(si._slaney(4000.0)) - 4000) < 1e-6
    assert np.allclose(si._hann(400)[[0, 200]], [0, 1])


def test_filterbank_table_equals_matrix(spark):
    from sonorel.functions.dsp import filterbank

    for scale in ("slaney", "htk"):
        m = np.zeros((20, 129))
        for r in filterbank(spark, 16000, 256, 20, scale).collect():
            m[r.bin, r.k] = r.w
        assert np.allclose(m, si.filter_matrix(16000, 256, 20, scale))


def test_resample_keeps_a_tone():
    t = np.arange(48000) / 48000
    y = si.resample(np.sin(2 * np.pi * 440 * t), 48000, 16000)
    assert len(y) == 16000
    want = np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    assert np.abs(y - want)[1000:-1000].max() < 0.02
    x = np.arange(10.0)
    assert si.resample(x, 16000, 16000) is x


def test_layers_by_hand():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6, 8))
    assert np.allclose(nn.layer_norm(x).mean(axis=1), 0) and np.allclose(nn.layer_norm(x).std(axis=1), 1, atol=1e-4)
    assert np.allclose(nn.rms_norm(np.full((1, 4), 2.0), np.ones(4)), 1)
    cos, sin = nn.rotary(6, 8)
    q, k = nn.rotate(x, cos, sin), nn.rotate(x, cos, sin)
    assert np.allclose(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)) and np.allclose((q * k).sum(1), (x * x).sum(1))
    pe = nn.sinusoidal(5, 8)
    assert pe.shape == (5, 8) and np.allclose(pe[0], [0] * 4 + [1] * 4)
    k1 = rng.normal(size=(3, 8, 3))
    assert np.allclose(nn.conv1d(x, k1, padding=1)[2], np.einsum("wc,ocw->o", x[1:4], k1))
    h, c = nn.lstm_step(np.zeros(2), np.zeros(3), np.zeros(3), {"ih": np.zeros((12, 2)), "hh": np.zeros((12, 3))})
    assert np.allclose(h, 0) and np.allclose(c, 0)
    assert np.allclose(np.exp(nn.ctc_head(x, rng.normal(size=(5, 8)), np.zeros(5))).sum(axis=1), 1)
    assert np.allclose(nn.gelu(np.array([0.0, 10.0])), [0, 10])
    s = nn.relative_shift(np.arange(10.0).reshape(1, 2, 5)[:, :, :3])
    assert s.shape == (1, 2, 2) and s[0, 0, 0] == 1 and s[0, 1, 1] == 6


def test_cached_decoding_equals_whole():
    rng = np.random.default_rng(2)
    d = 8
    attn = {"q": rng.normal(size=(8, d)), "k": rng.normal(size=(4, d)), "v": rng.normal(size=(4, d)), "out": rng.normal(size=(d, 8)), "q_norm": np.ones(4), "k_norm": np.ones(4)}
    layer = {"n1": np.ones(d), "n2": np.ones(d), "attn": attn, "mlp": {"gate": rng.normal(size=(12, d)), "up": rng.normal(size=(12, d)), "down": rng.normal(size=(d, 12))}}
    m = nn.Decoder(rng.normal(size=(20, d)), [layer, layer], np.ones(d), 2, 1)
    ids = [3, 1, 4, 1, 5]
    caches = m.caches()
    parts = np.concatenate([m.forward(ids[:2], caches), *(m.forward(ids[i : i + 1], caches, i) for i in range(2, 5))])
    assert np.allclose(parts, m.forward(ids))
    audio = rng.normal(size=(2, d))
    assert m.forward_with_audio([0, 19, 19, 2], audio, 19).shape == (4, 20)


def test_encoders_compose():
    rng = np.random.default_rng(3)
    mel = rng.normal(size=(16, 8))
    conv = [{"kernel": rng.normal(size=(4, 1, 3, 3))}, {"kernel": rng.normal(size=(4, 4, 3, 3))}, {"kernel": rng.normal(size=(4, 4, 3, 3))}]
    assert nn.downsample_conv2d(mel, conv, {"w": rng.normal(size=(6, 4))}).shape == (2, 6)
    assert nn.subsample_conv1d(mel, [{"kernel": rng.normal(size=(6, 8, 5))}, {"kernel": rng.normal(size=(6, 6, 5))}]).shape == (4, 6)
    pairs = [({"kernel": rng.normal(size=(4, 1, 3, 3))}, {"kernel": rng.normal(size=(4, 4, 1, 1))})] * 2
    assert nn.subsample_depthwise(mel, {"kernel": rng.normal(size=(4, 1, 3, 3))}, pairs, {"w": rng.normal(size=(6, 4))}).shape == (2, 6)
    norms = {f"n{i}": (np.ones(8), np.zeros(8)) for i in range(1, 6)}
    ff = {"up": rng.normal(size=(16, 8)), "down": rng.normal(size=(8, 16))}
    square = {n: rng.normal(size=(8, 8)) for n in ("q", "k", "v", "out", "pos")} | {"bias_u": rng.normal(size=(2, 4)), "bias_v": rng.normal(size=(2, 4))}
    w = norms | {"ff1": ff, "ff2": ff, "conv": {"in": rng.normal(size=(16, 8)), "depth": rng.normal(size=(8, 1, 5)), "out": rng.normal(size=(8, 8))}}
    for attention in (lambda x: nn.relative_attention(x, square, 2), lambda x: nn.rotary_first_attention(x, square, 2), lambda x: nn.self_attention(x, square, 2)):
        assert nn.encode(mel, lambda x: x, [lambda x: nn.conformer_layer(x, w, attention, nn.layer_norm)]).shape == (16, 8)
    assert nn.projector(mel, {"w": rng.normal(size=(6, 8))}, {"w": rng.normal(size=(5, 6))}).shape == (16, 5)
    tok, dur = nn.joint(np.ones(8), np.ones(8), {"enc": square["q"], "pred": square["k"], "out": rng.normal(size=(9, 8))}, 5)
    assert tok.shape == (5,) and dur.shape == (4,)
    p = nn.Prediction(rng.normal(size=(5, 3)), [{"ih": rng.normal(size=(12, 3)), "hh": rng.normal(size=(12, 3))}], 4)
    assert p.step(4, p.start())[0].shape == (3,)


def test_safetensors_gguf_and_quantization(spark, tmp_path):
    import json

    x = np.random.default_rng(0).normal(size=(4, 32)).astype("<f4")
    b = np.ones(3, "<f4")
    head = json.dumps({"m.q.weight": {"dtype": "F32", "shape": [4, 32], "data_offsets": [0, 512]}, "m.norm.weight": {"dtype": "F32", "shape": [3], "data_offsets": [512, 524]}}).encode()
    raw = len(head).to_bytes(8, "little") + head + x.tobytes() + b.tobytes()
    assert np.array_equal(binary.tensor(raw, "m.q.weight"), x)
    (tmp_path / "m.safetensors").write_bytes(raw)
    rows = {r.name: (r.rank, r.bytes) for r in binary.read_safetensors(spark, str(tmp_path)).collect()}
    assert rows == {"m.q.weight": (2, 512), "m.norm.weight": (1, 12)}
    packed = dz.quantize([raw], "m.")
    _, tensors = binary.gguf_header(packed)
    assert {(n, t) for n, _, t, _ in tensors} == {("m.q.weight", 8), ("m.norm.weight", 1)}
    back = binary.dequantize_q8_0(binary.quantize_q8_0(x), x.size).reshape(x.shape)
    assert np.abs(back - x).max() < np.abs(x).max() / 100
    y = np.ones((2, 32))
    assert np.allclose(nn.quantized_linear(y, binary.quantize_q8_0(x), (4, 32)), y @ back.T, atol=1e-4)
    with pytest.raises(ValueError):
        models.load("gigaam", quantized=True)
    assert "tone" in models.available_models()


def test_listing_never_reads_contents(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "config.json").write_text("{}")
    files = inventory.list_files(spark, str(tmp_path))
    assert [(r.name, r.size) for r in files.collect()] == [("config.json", 2)]


def test_equal_samples_share_a_row():
    rng = np.random.default_rng(0)
    steps, noise = np.repeat(rng.normal(size=12), 4800)[960:-480], rng.normal(size=4000)
    for x in (steps, noise, np.full(700, 0.1), np.repeat(noise[:9], 70), np.zeros(0)):
        at = np.pad(x, 200, mode="reflect") if len(x) else np.zeros(400)
        frames = np.array([at[i * 160 : i * 160 + 400] for i in range(len(x) // 160)]).reshape(-1, 400)
        power = np.abs(np.fft.rfft(frames * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(400) / 400)), axis=1)) ** 2
        v = np.log10(np.maximum(power @ si.filter_matrix(16000, 400, 128).T, 1e-10))
        want = (np.maximum(v, v.max() - 8) + 4) / 4 if v.size else v
        assert np.allclose(si.log_mel(x, "whisper"), want, atol=1e-9)
        rows, counts = si.whisper_rows(x)
        assert counts.sum() == len(want) and np.allclose(counts @ rows, want.sum(axis=0), atol=1e-6)
    assert len(si.whisper_rows(steps)[0]) < 60 < 340 < len(si.log_mel(steps, "whisper"))


def test_held_samples_equal_samples_written_out(spark):
    rng = np.random.default_rng(3)
    values = [float(v) for v in np.float32(rng.exponential(0.1, 120) * (rng.random(120) < 0.6))]
    rows = [("a", 16000, 1, values, 4800), ("b", 16000, 1, values, 2500), ("c", 16000, 2, values, 4800), ("d", 8000, 1, values, 1200), ("e", 16000, 1, values[:1], 480), ("f", 16000, 1, [], 480)]
    out = [(p, r, c, [float(v) for v in np.repeat(np.reshape(x, (-1, c)), h, axis=0).ravel()]) for p, r, c, x, h in rows]
    held = spark.createDataFrame(rows, "path string, sample_rate int, channels int, samples array<float>, hold int")
    written = spark.createDataFrame(out, "path string, sample_rate int, channels int, samples array<float>")
    for detector in (sg.energy_detector, lambda x, mode: F.exists(x, lambda v: v > 0.1) & (F.size(x) == 480)):
        a, b = (sorted(map(tuple, dz.detect(dz.tracks(d, "auto", 480), sg.VadConfig(), detector).collect())) for d in (held, written))
        assert a and a == b
    for mode in ("auto", "cluster"):
        a, b = (sorted(map(tuple, dz.diarize(d, dz.DiarizeOptions(speaker_mode=mode)).collect())) for d in (held, written))
        assert {r[0] for r in a} >= {"a", "b", "c", "d"} and a == b
    a, b = (sorted(map(tuple, dz.transcribe(d, chunk_seconds=1).select("path", "text", "audio_duration_secs").collect())) for d in (held, written))
    assert len(a) == 6 and a == b


def test_diarize_stereo_and_mono(spark, tmp_path):
    rng = np.random.default_rng(5)
    t = np.arange(16000) / 16000
    loud, quiet = 0.6 * np.sin(2 * np.pi * 300 * t), 0.001 * rng.normal(size=16000)
    left, right = np.concatenate([loud, quiet, quiet, quiet]), np.concatenate([quiet, quiet, loud, quiet])
    (tmp_path / "two.wav").write_bytes(binary.encode_wav(np.column_stack([left, right]).ravel(), 16000, 2))
    o = dz.DiarizeOptions(channel_names=["mic", "system"], overrides=["system=de"], language="en", right_num_speakers=2)
    rows = dz.diarize_files(spark, str(tmp_path), o).orderBy("idx").collect()
    assert [(r.speaker, r.language, r.stop_reason) for r in rows] == [("mic", "en", "eos"), ("system", "de", "eos")]
    assert rows[0].start_s == 0 and abs(rows[0].end_s - 1.15) < 0.1
    high = 0.6 * np.sin(2 * np.pi * 3000 * t)
    mono = spark.createDataFrame([("m", 16000, 1, [float(v) for v in np.concatenate([loud, quiet, high, quiet, loud, quiet])])], "path string, sample_rate int, channels int, samples array<float>")
    rows = dz.diarize(mono, dz.DiarizeOptions(speakers=["Ann"])).orderBy("idx").collect()
    assert [r.speaker for r in rows] == ["Ann", "spk1", "Ann"]
    done = dz.transcribe(mono, chunk_seconds=2).collect()[0]
    assert done.audio_duration_secs == 6 and done.text.count(" ") == 5
    report = tr.report(dz.diarize(mono).drop("path"), {"Model": "tone"})
    assert "| 1 | 00:00:00.000 |" in report and "- Segments: 3" in report
    dz.write_outputs(dz.diarize(mono), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "segments")).count() == 3
    with pytest.raises(ValueError):
        dz.DiarizeOptions(overrides=["x"]).parsed_overrides()
