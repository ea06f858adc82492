"""Models with weights, whole runs, sinks and the command line."""

import io
import json

import numpy as np
import pytest

from sonorel import __main__ as cli
from sonorel.operators import decoding as de, neural as nn
from sonorel.plans import diarize as dz, models, transcribers as ts
from sonorel.plans.models import TranscribeOptions
from sonorel.sources import binary

RNG = np.random.default_rng(8)
SOUND = 0.5 * np.sin(2 * np.pi * 300 * np.arange(16000) / 16000)


def w(*shape):
    return RNG.normal(size=shape) / np.sqrt(shape[-1])


def attention(d, *names):
    return {n: w(d, d) for n in ("q", "k", "v", "out", *names)}


def norm(d):
    return np.ones(d), np.zeros(d)


def test_ctc_equals_collapse(spark):
    m = ts.CtcTranscriber("c", "ctc", ts.Pieces({i: f"▁{i}" for i in range(1, 6)}), head=(w(6, 64), np.zeros(6)), seconds=0.5)
    got = m.transcribe(SOUND, TranscribeOptions())
    texts = []
    for chunk in (SOUND[:8000], SOUND[8000:]):
        best = nn.ctc_head(ts.log_mel(chunk, "gigaam"), *m.head).argmax(axis=1)
        rows = [(0, t, int(k)) for t, k in enumerate(best)]
        kept = de.collapse(spark.createDataFrame(rows, "seq int, t int, tok int"), 0).orderBy("t").collect()
        texts.append(" ".join(str(r.tok) for r in kept))
    assert got.text == " ".join(x for x in texts if x) and m.transcribe(np.zeros(0), TranscribeOptions()).text == ""


def test_tdt_runs_to_the_end():
    d = 8
    p = nn.Prediction(w(5, d), [{"ih": w(4 * d, d), "hh": w(4 * d, d)}], 4)
    m = ts.TdtTranscriber("t", "tdt", ts.Pieces({i: f"{i}" for i in range(4)}), encoder=lambda mel: mel[:, :d], prediction=p, joint={"enc": w(d, d), "pred": w(d, d), "out": w(10, d)}, n_tokens=5, blank=4)
    got = m.transcribe(SOUND, TranscribeOptions())
    assert got.text == "".join(map(str, got.tokens)) and len(got.tokens) <= 10 * 101


def test_tdt_rule_of_ten():
    always = lambda token, length: de.tdt_greedy(lambda t, _: (np.eye(3)[token], np.eye(3)[length]), 4, 2, [0, 1, 2])
    assert always(0, 0) == [0] * 40 and always(0, 1) == [0] * 4 and always(0, 2) == [0] * 2 and always(2, 0) == []
    calls = iter([0] * 9 + [1] + [2] * 9)
    assert de.tdt_greedy(lambda t, _: (np.eye(3)[0], np.eye(3)[next(calls)]), 3, 2, [0, 1, 2]) == [0] * 11  # the tenth moves by its length and one more


def network(d=8, vocab=12):
    layer = lambda *more: {f"n{i}": norm(d) for i in (1, 2, 3)} | {"attn": attention(d), "ff": {"up": w(16, d), "down": w(d, 16)}} | {k: attention(d) for k in more}
    stem = [{"kernel": w(d, 128, 3)}, {"kernel": w(d, d, 3)}]
    return nn.EncoderDecoder(stem, [layer()], norm(d), w(vocab, d), w(64, d), [layer("cross"), layer("cross")], norm(d), 2)


def test_cached_decoding_equals_a_fresh_pass():
    net = network()
    audio = net.encoder_forward(RNG.normal(size=(20, 128)))
    assert audio.shape == (10, 8)
    whole = net.decoder_final_linear(net.decoder_forward([1, 2, 3, 4], audio, True))
    net.reset()
    steps = [net.decoder_final_linear(net.decoder_forward([k], audio))[0] for k in (1, 2, 3, 4)]
    assert np.allclose(whole, steps)


def test_sequence_model_chunks_and_falls_back():
    m = ts.SequenceTranscriber("s", "seq", ts.Pieces({i: f"▁{i}" for i in range(6)}), network=network(), special={"start": 6, "end": 7, "transcribe": 8, "no_timestamps": 9}, language_ids={"en": 10}, limit=12, seconds=0.5)
    got = m.transcribe(SOUND[:12000], TranscribeOptions("en", 5))
    assert len(got.segments) == 2 and got.segments[1][:2] == (0.5, 0.75) and len(got.tokens) <= 10 and got.language == "en"


def test_language_model_reads_audio(spark):
    d = 8
    layer = {"n1": np.ones(d), "n2": np.ones(d), "attn": {"q": w(d, d), "k": w(4, d), "v": w(4, d), "out": w(d, d), "q_norm": np.ones(4), "k_norm": np.ones(4)}, "mlp": {"gate": w(12, d), "up": w(12, d), "down": w(d, 12)}}
    net = nn.Decoder(w(20, d), [layer], np.ones(d), 2, 1)
    m = ts.LanguageModelTranscriber("l", "llm", ts.Pieces({i: chr(97 + i) for i in range(20)}, "byte"), encoder=lambda mel: mel[:4, :d], decoder=net, before=[1, 2], after=[3], audio_id=19, eos=(18,))
    got = m.transcribe(SOUND, TranscribeOptions(max_tokens=6))
    ids = [1, 2, 19, 19, 19, 19, 3]
    want, audio = [], ts.log_mel(SOUND, "whisper")[:4, :d]
    for _ in range(6):
        token = int(net.forward_with_audio(ids + want, audio, 19)[-1].argmax())
        if token == 18:
            break
        want.append(token)
    assert got.tokens == want and got.stop_reason in ("eos", "max_tokens")


def test_raw_output_is_parsed_and_budgets_reach_the_model(spark):
    class Echo(models.ToneModel):
        raw = True

        def transcribe(self, samples, options):
            return models.Transcription(f" language german<asr_text> {options.max_tokens} ")

    segs = spark.createDataFrame([(1, [0.0] * 160000, None), (2, [0.0] * 16, "en")], "id int, samples array<float>, lang string")
    rows = {r.id: (r.text, r.language) for r in models.transcribe_segments(segs, Echo, budget="segment").collect()}
    assert rows == {1: ("192", "German"), 2: ("language german<asr_text> 64", "")}
    assert models.transcribe_segments(segs, Echo, max_tokens=7, budget="segment").where("id = 1").collect()[0].text == "7"
    assert models.transcribe_segments(segs.limit(0), Echo).count() == 0


def test_chunks_of_the_mel_start_anew():
    conv = [{"kernel": w(4, c, 3, 3)} for c in (1, 4, 4)]
    mel = RNG.normal(size=(130, 8))
    out = nn.downsample_in_chunks(mel, conv, {"w": w(6, 4)})
    assert out.shape == (13 + 4, 6)
    project = {"w": w(6, 4)}
    first, second = nn.downsample_conv2d(mel[:100], conv, project), nn.downsample_conv2d(mel[100:], conv, project)
    whole = nn.downsample_in_chunks(mel, conv, project)
    assert np.allclose(whole[:13], first + nn.sinusoidal(13, 6)) and np.allclose(whole[13:], second + nn.sinusoidal(4, 6))


def test_missing_tokens_are_errors(spark):
    vocab = spark.createDataFrame([(1, "a")], "id int, piece string")
    with pytest.raises(Exception, match="no token for"):
        de.special_tokens(vocab).collect()


def test_written_files(spark, tmp_path):
    rows = [("x/1", 1, "Ann", 0.0, 1.0, "en|x", "one\ntwo", "eos"), ("x/1", 2, "b?", 1.0, 2.0, "", "three", "eos"), ("y", 1, "Ann", 0.0, 1.0, "", "", "eos")]
    t = spark.createDataFrame(rows, "path string, idx int, speaker string, start_s double, end_s double, language string, text string, stop_reason string")
    dz.write_outputs(t, str(tmp_path), {"Model": "tone"})
    got = {(r.path, r.file): r.value for r in spark.read.text(str(tmp_path / "speakers"), wholetext=True).collect()}
    assert got == {("x/1", "Ann.txt"): "one\ntwo\n", ("x/1", "b_.txt"): "three\n", ("y", "Ann.txt"): "\n"}
    report = {r.path: r.value for r in spark.read.text(str(tmp_path / "reports"), wholetext=True).collect()}
    assert "- Model: tone\n- Segments: 2\n" in report["x/1"] and "| 2 | 00:00:01.000 | 00:00:02.000 | b? |  | eos | three |" in report["x/1"]
    combined = {r.path: r.value for r in spark.read.text(str(tmp_path / "combined"), wholetext=True).collect()}
    assert combined["x/1"].endswith("[00:00:01.000 - 00:00:02.000] b?: three\n")
    assert dz.default_out_dir("d", 12.9) == "d-12"


def test_right_channel_status(spark):
    found = spark.createDataFrame([("a", 2, 1), ("a", 2, 1), ("b", 2, 0), ("b", 2, 1), ("c", 1, 0)], "path string, channels int, channel int")
    status = lambda **k: {r.path: r.right_channel_clustering for r in dz.right_channel_status(found, dz.DiarizeOptions(channel_names=["mic", "sys"], **k)).collect()}
    assert status() == {"a": None, "b": None, "c": None}
    assert status(right_num_speakers=3, right_speakers=["Z"]) == {"a": "enabled (k=2, base=sys, names=provided)", "b": "requested (k=3) but skipped (segments=1)", "c": "requested but not applicable (need stereo + speaker-mode=channel)"}


def test_four_bit_blocks_and_weights_as_filters():
    x = RNG.normal(size=(4, 64)).astype(np.float32)
    back = binary.dequantize_q4_0(binary.quantize_q4_0(x), x.size).reshape(x.shape)
    assert np.abs(back - x).max() <= np.abs(x).max() / 8 + 1e-3
    bank, window = RNG.random((1, 4, 9)).astype("<f4"), RNG.random(16).astype("<f4")
    head = json.dumps({"p.fb": {"dtype": "F32", "shape": [1, 4, 9], "data_offsets": [0, 144]}, "p.window": {"dtype": "F32", "shape": [16], "data_offsets": [144, 208]}}).encode()
    raw = len(head).to_bytes(8, "little") + head + bank.tobytes() + window.tobytes()
    fb, win = binary.bank_from_weights(raw, "p.")
    assert fb.shape == (4, 9) and np.allclose(win, window) and dz.clustering.segment_embedding(SOUND, 0, 16000, np.ones((5, 201))).shape == (5,)


def test_npy_and_command_line(spark, tmp_path, capsys):
    out = io.BytesIO()
    np.save(out, np.arange(6, dtype=np.float32).reshape(2, 3))
    (tmp_path / "x.npy").write_bytes(out.getvalue())
    r = binary.read_npy(spark, str(tmp_path / "x.npy")).collect()[0]
    assert (r.shape, r.data) == ([2, 3], [0, 1, 2, 3, 4, 5])
    assert cli.main(["models"]) == 0 and "tone" in capsys.readouterr().out
    assert cli.main(["test"], spark) == 0 and "loud 1.00" in capsys.readouterr().out
    (tmp_path / "a.wav").write_bytes(binary.encode_wav(SOUND, 16000))
    assert cli.main(["transcribe", str(tmp_path / "a.wav")], spark) == 0 and "loud 1.00" in capsys.readouterr().out
    assert cli.main(["diarize", str(tmp_path / "a.wav"), "--out", str(tmp_path / "o"), "--max-tokens", "9"], spark) == 0
    assert (tmp_path / "o" / "reports").is_dir() and cli.device("unknown") == "cpu"
