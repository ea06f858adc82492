"""Models with weights: front end, encoder, decoder and pieces tied together, one class per family.

Weights are plain arrays; a factory that closes over them (or loads them from files) is what
``transcribe_segments`` makes once per task. Texts of an utterance longer than ``seconds`` are
made by the chunk and joined by spaces.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from sonorel.operators import decoding, neural
from sonorel.operators.signal import log_mel
from sonorel.plans.models import Transcription, TranscribeOptions


@dataclass
class Pieces:
    """Pieces by id, and how they become text: ``word`` pieces with a mark for spaces, or ``byte`` pieces."""

    piece: dict[int, str]
    kind: str = "word"
    special: frozenset[int] = frozenset()

    def text(self, ids: list[int]) -> str:
        found = [self.piece[i] for i in ids if i in self.piece and i not in self.special]
        if self.kind == "byte":
            return decoding.byte_text(found)
        return "".join(found).replace("▁", " ").strip(" ")


@dataclass
class Chunked:
    """What the families share: chunks of ``seconds``, texts joined by spaces, empty ones left out unless ``keep_empty``."""

    name: str
    model_type: str
    pieces: Pieces
    sample_rate: int = 16000
    seconds: float = 30.0
    languages: list[str] = field(default_factory=lambda: ["en"])
    keep_empty = False

    def supported_languages(self) -> list[str]:
        return self.languages

    def model_info(self) -> dict:
        return {"model_type": self.model_type, "display_name": self.name, "languages": self.languages, "backend": "numpy"}

    def transcribe_chunk(self, samples: np.ndarray, options: TranscribeOptions, number: int) -> Transcription:
        raise NotImplementedError

    def transcribe(self, samples: np.ndarray, options: TranscribeOptions) -> Transcription:
        size = int(self.seconds * self.sample_rate)
        parts, segments = [], []
        for number, start in enumerate(range(0, max(len(samples), 1), size)):
            chunk = samples[start : start + size]
            got = self.transcribe_chunk(chunk, options, number)
            if got.text or self.keep_empty:
                parts.append(got)
                segments.append((start / self.sample_rate, (start + len(chunk)) / self.sample_rate, got.text, got.confidence))
        stops = {p.stop_reason for p in parts}
        stop = next((s for s in ("repetition", "max_tokens") if s in stops), "eos")
        out = Transcription(" ".join(p.text for p in parts), next((p.language for p in parts if p.language), options.language or ""), stop, parts[0].confidence if len(parts) == 1 else None, [t for p in parts for t in p.tokens])
        out.segments = segments
        return out


@dataclass
class CtcTranscriber(Chunked):
    """Frame-wise classes with a blank: the largest of each frame, repeats and blanks out."""

    front: str = "gigaam"
    bank: np.ndarray | None = None
    encoder: Callable[[np.ndarray], np.ndarray] = lambda mel: mel
    head: tuple[np.ndarray, np.ndarray] = ()
    blank: int = 0

    def transcribe_chunk(self, samples, options, number=0):
        mel = log_mel(samples, self.front, self.bank)
        if not len(mel):
            return Transcription("")
        best = neural.ctc_head(self.encoder(mel), *self.head).argmax(axis=1)
        fresh = np.append(True, best[1:] != best[:-1]) & (best != self.blank)
        ids = best[fresh].tolist()
        return Transcription(self.pieces.text(ids), tokens=ids)


@dataclass
class TdtTranscriber(Chunked):
    """Token-and-duration transducer over a prediction network and a joint."""

    front: str = "parakeet"
    bank: np.ndarray | None = None
    encoder: Callable[[np.ndarray], np.ndarray] = lambda mel: mel
    prediction: neural.Prediction | None = None
    joint: dict = field(default_factory=dict)
    n_tokens: int = 1
    blank: int = 0
    durations: list[int] = field(default_factory=lambda: [0, 1, 2, 3, 4])

    def transcribe_chunk(self, samples, options, number=0):
        mel = log_mel(samples, self.front, self.bank)
        if not len(mel):
            return Transcription("")
        enc = self.encoder(mel)
        first = self.prediction.step(self.blank, self.prediction.start())
        ids = decoding.tdt_greedy(lambda t, state: neural.joint(enc[t], state[0], self.joint, self.n_tokens), len(enc), self.blank, self.durations, lambda token, state: self.prediction.step(token, state[1]), first)
        return Transcription(self.pieces.text(ids), tokens=ids)


@dataclass
class SequenceTranscriber(Chunked):
    """Encoder and decoder over padded chunks, with the temperature fallback; ``special`` has ids by use."""

    network: neural.EncoderDecoder | None = None
    special: dict[str, int] = field(default_factory=dict)
    language_ids: dict[str, int] = field(default_factory=dict)
    suppress: tuple[int, ...] = ()
    limit: int = 224
    bank: np.ndarray | None = None
    keep_empty = True

    def transcribe_chunk(self, samples, options, number=0):
        size = int(self.seconds * self.sample_rate)
        padded = np.pad(np.asarray(samples, np.float64)[:size], (0, max(0, size - len(samples))))
        audio = self.network.encoder_forward(log_mel(padded, "whisper", self.bank), True)
        start = decoding.prompt(self.special["start"], self.language_ids.get(options.language or ""), self.special["transcribe"], None if options.timestamps else self.special["no_timestamps"])

        def forward(tokens: list[int]) -> np.ndarray:
            fresh = len(tokens) == len(start)
            hidden = self.network.decoder_forward(tokens if fresh else tokens[-1:], audio, fresh)
            return self.network.decoder_final_linear(hidden)[-1]

        def attempt(temperature: float) -> decoding.Decoded:
            return decoding.decode_segment(forward, start, self.special["end"], min(options.max_tokens or self.limit, self.limit), temperature, self.suppress, 42 + number)

        got = decoding.decode_with_fallback(attempt) if options.temperature == 0 else attempt(options.temperature)
        return Transcription(self.pieces.text(got.tokens), options.language or "", confidence=float(np.exp(got.avg_logprob)), tokens=got.tokens)


@dataclass
class LanguageModelTranscriber(Chunked):
    """A language model that reads audio embeddings inside a prompt; its output names the language (``raw``)."""

    encoder: Callable[[np.ndarray], np.ndarray] = lambda mel: mel
    decoder: neural.Decoder | None = None
    before: list[int] = field(default_factory=list)
    after: list[int] = field(default_factory=list)
    audio_id: int = 0
    eos: tuple[int, ...] = decoding.EOS_IDS
    bank: np.ndarray | None = None
    seconds: float = float(1 << 20)  # never cut
    raw = True

    def transcribe_chunk(self, samples, options, number=0):
        audio = self.encoder(log_mel(samples, "whisper", self.bank))
        ids = [*self.before, *[self.audio_id] * len(audio), *self.after]
        caches = self.decoder.caches()
        last = self.decoder.forward_with_audio(ids, audio, self.audio_id, caches)[-1]

        def forward(tokens: list[int]) -> np.ndarray:
            return self.decoder.forward(tokens[-1:], caches, len(ids) + len(tokens) - 1)[-1] if tokens else last

        got, why = decoding.generate(forward, options.max_tokens or 256, self.eos)
        return Transcription(self.pieces.text(got), options.language or "", why, tokens=got)
