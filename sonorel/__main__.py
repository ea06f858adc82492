"""Command line: transcribe, diarize, quantize, models, test."""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import SparkSession


def device(name: str) -> str:
    """Where layers run. They are numpy code, so every name, known or not, means the CPU."""
    return "cpu"


def debugging() -> bool:
    """On where SONOREL_DEBUG is set, to anything."""
    return "SONOREL_DEBUG" in os.environ


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sonorel")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("transcribe", "diarize"):
        q = sub.add_parser(name)
        q.add_argument("audio")
        q.add_argument("--model", default="tone")
        q.add_argument("--device", default="cpu")
        q.add_argument("--language")
        q.add_argument("--max-tokens", type=int)
        q.add_argument("--out")
        if name == "diarize":
            q.add_argument("--speaker-mode", default="auto", choices=["auto", "channel", "cluster"])
            q.add_argument("--num-speakers", type=int, default=2)
            q.add_argument("--speakers", default="")
            q.add_argument("--channel-names", default="left,right")
            q.add_argument("--right-num-speakers", type=int)
            q.add_argument("--right-speakers", default="")
            q.add_argument("--speaker-language", action="append", default=[])
    q = sub.add_parser("quantize")
    q.add_argument("weights", nargs="+")
    q.add_argument("--scope", default="")
    q.add_argument("--format", default="Q8_0", choices=["Q8_0", "Q4_0"])
    q.add_argument("--embeddings", action="store_true")
    q.add_argument("--out", required=True)
    q = sub.add_parser("models")
    q.add_argument("folder", nargs="?")
    sub.add_parser("test")
    return p


def _names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from sonorel.plans import diarize as runs, models
    from sonorel.sources.binary import read_wav
    from sonorel.sources.inventory import list_files, inspect

    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if debugging() else logging.INFO)
    if a.command == "models" and not a.folder:
        print("\n".join(models.available_models()))
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command == "models":
        index = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.safetensors.index.json").load(a.folder)
        indexes = index.selectExpr("regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir", "decode(content, 'utf-8') AS json")
        inspect(list_files(spark, a.folder), indexes).show(truncate=False)
    elif a.command == "test":
        tone = spark.range(1).selectExpr("'tone' AS path", "16000 AS sample_rate", "1 AS channels", "transform(sequence(0, 15999), i -> cast(sin(i * 0.17) / 2 AS float)) AS samples")
        print(f"{device('cpu')}: {runs.transcribe(tone).collect()[0].text}")
    elif a.command == "quantize":
        files = spark.read.format("binaryFile").load(a.weights).orderBy("path").collect()  # a model's weights: written to one file here
        with open(a.out, "wb") as f:
            f.write(runs.quantize([bytes(r.content) for r in files], a.scope, a.embeddings, a.format, spark))
    elif a.command == "transcribe":
        done = runs.transcribe(read_wav(spark, a.audio), lambda: models.load(a.model), language=a.language, max_tokens=a.max_tokens)
        if a.out:
            runs.write_text(done, a.out)
        else:
            for r in done.orderBy("path").toLocalIterator():
                print(json.dumps(r.asDict(), ensure_ascii=False))
    else:
        o = runs.DiarizeOptions(a.speaker_mode, a.num_speakers, _names(a.speakers), _names(a.channel_names), a.right_num_speakers, _names(a.right_speakers), a.language, a.speaker_language, max_tokens=a.max_tokens)
        settings = {"Audio": a.audio, "Model": a.model, "Device": device(a.device), "Speaker mode": a.speaker_mode, "Language": a.language or "auto"}
        runs.write_outputs(runs.diarize_files(spark, a.audio, o, lambda: models.load(a.model)), a.out or runs.default_out_dir("diarize"), settings)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
