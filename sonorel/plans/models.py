"""Models as plug-ins: a small protocol, a registry of factories, and their use on segments."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sonorel.functions.text import parse_output, token_budget
from sonorel.operators.transcript import held

RATE = 16000

#: Languages of the multilingual adapter.
LANGUAGES = "en ru zh de fr es it ja ko pt nl pl ar hi th vi tr id ms sv".split()


@dataclass(frozen=True)
class TranscribeOptions:
    language: str | None = None
    max_tokens: int | None = None
    timestamps: bool = False
    temperature: float = 0.0


@dataclass
class Transcription:
    text: str
    language: str = ""
    stop_reason: str = "eos"
    confidence: float | None = None
    tokens: list[int] = field(default_factory=list)


class Model(Protocol):
    name: str
    model_type: str
    sample_rate: int

    def supported_languages(self) -> list[str]: ...

    def model_info(self) -> dict: ...

    def transcribe(self, samples: np.ndarray, options: TranscribeOptions) -> Transcription: ...


class ToneModel:
    """A model without weights for tests and demonstrations: it names the level and length of what it hears."""

    name, model_type, sample_rate = "tone", "stub", 16000

    def supported_languages(self) -> list[str]:
        return list(LANGUAGES)

    def model_info(self) -> dict:
        return {"model_type": self.model_type, "display_name": "Tone", "parameters": 0, "weights_size_bytes": 0, "quantization": "none", "languages": self.supported_languages(), "backend": "numpy"}

    def transcribe(self, samples: np.ndarray, options: TranscribeOptions) -> Transcription:
        if not len(samples):
            return Transcription("")
        level = float(np.sqrt(np.mean(np.square(samples, dtype=np.float64))))
        return Transcription(f"{'loud' if level > 0.1 else 'soft'} {len(samples) / self.sample_rate:.2f}", options.language or "")


_factories: dict[str, Callable[[], Model]] = {"tone": ToneModel}
FULL_PRECISION_ONLY = {"gigaam", "parakeet"}


def register_model(name: str, factory: Callable[[], Model]) -> None:
    _factories[name] = factory


def available_models() -> list[str]:
    return sorted(_factories)


def load(name: str, quantized: bool = False) -> Model:
    if quantized and name in FULL_PRECISION_ONLY:
        raise ValueError(f"{name} has no quantized weights")
    if name not in _factories:
        raise KeyError(f"no model {name}; there are {', '.join(available_models())}")
    return _factories[name]()


def transcribe_segments(segments: DataFrame, factory: Callable[[], Model], temperature: float = 0.0, max_tokens: int | None = None, budget: str | None = None, parts: int | None = None) -> DataFrame:
    """``segments(..., start, end, samples, lang)``, or with ``hold``, with ``text, language, stop_reason, seconds``; the model is made once per task.

    Segments are dealt out evenly first, so that one long recording keeps all executors busy.
    ``budget`` names the rule by which a segment's length bounds its tokens; ``max_tokens`` overrides it.
    Texts are trimmed; what a model marked ``raw`` says is parsed into language and text.
    """
    spark = segments.sparkSession
    keep = [c for c in segments.columns if c not in ("samples", "lang", "hold")]
    schema = ", ".join(f"`{c}` {t}" for c, t in segments.dtypes if c in keep) + ", lang string, text string, language string, stop_reason string, seconds double, raw boolean"
    limit = F.lit(max_tokens).cast("long") if max_tokens or not budget else token_budget((F.col("end") - F.col("start") if "hold" in segments.columns else F.size("samples")) / RATE, budget)
    dealt = segments.withColumn("_limit", limit).repartition(parts or int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in batches:
            rows = []
            heard = (held(*x) for x in zip(pdf["samples"], pdf["hold"], pdf["start"], pdf["end"])) if "hold" in pdf else pdf["samples"]
            for samples, lang, most in zip(heard, pdf["lang"], pdf["_limit"]):
                began = time.perf_counter()
                got = model.transcribe(np.asarray(samples, np.float32), TranscribeOptions(language=lang or None, max_tokens=None if pd.isna(most) else int(most), temperature=temperature))
                rows.append((lang, got.text.strip(), got.language or "", got.stop_reason, time.perf_counter() - began, getattr(model, "raw", False)))
            names = ("lang", "text", "language", "stop_reason", "seconds", "raw")
            yield pdf[keep].assign(**dict(zip(names, map(list, zip(*rows)) if rows else [[] for _ in names])))

    done = dealt.mapInPandas(run, schema)
    parsed = parse_output(F.col("text"))
    unforced = F.col("raw") & F.coalesce(F.col("lang") == "", F.lit(True))
    return done.withColumns({"text": F.when(unforced, parsed["text"]).otherwise(F.col("text")), "language": F.when(unforced, parsed["language"]).otherwise(F.col("language"))}).drop("raw", "lang")
