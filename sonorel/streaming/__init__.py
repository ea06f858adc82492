"""Segmentation of unbounded frame streams: an extension, not a batch operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def stream_hysteresis(frames: DataFrame, min_speech: int, min_silence: int) -> DataFrame:
    """``frames(stream, f, voice)``, in order per stream, to closed segments ``(stream, start, end)`` as they end.

    State per stream is five numbers: the current run and the open segment.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kind, begun, length, opened, seen = state.get if state.exists else (-1, 0, 0, -1, 0)
        out = []
        for pdf in batches:
            for f, voice in zip(*(pdf.sort_values("f")[c] for c in ("f", "voice"))):
                if int(voice) == kind:
                    length += 1
                else:
                    kind, begun, length = int(voice), int(f), 1
                if kind == 1 and length == min_speech and opened < 0:
                    opened = begun
                if kind == 0 and length == min_silence and opened >= 0:
                    out.append((key[0], opened, begun))
                    opened = -1
                seen = int(f)
        state.update((kind, begun, length, opened, seen))
        yield pd.DataFrame(out, columns=["stream", "start", "end"])

    t = dict(frames.dtypes)["stream"]
    return frames.groupBy("stream").applyInPandasWithState(run, f"stream {t}, start long, end long", "kind int, begun long, length long, opened long, seen long", "append", "NoTimeout")
