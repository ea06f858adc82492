"""Speaker clustering: mean embeddings, deterministic cosine k-means, labels by first appearance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from sonorel.functions.vector import l2_normalize
from sonorel.operators.signal import whisper_rows


def mean_embedding(mel: DataFrame, *keys: str) -> DataFrame:
    """``mel(keys, bin, v)`` over frames to one normalised array per key."""
    means = mel.groupBy(*keys, "bin").agg(F.avg("v").alias("v"))
    rows = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "v"))).alias("pairs"))
    return rows.select(*keys, l2_normalize(F.transform("pairs", lambda p: p["v"])).alias("embedding"))


def assign_nearest(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """``points(id, dim, v)`` to the centroid ``(cluster, dim, v)`` of largest inner product, the first of equals.

    An equi-join on the dimension; centroids are k rows per dimension.
    """
    dots = points.withColumnRenamed("v", "x").join(F.broadcast(centroids), "dim").groupBy("id", "cluster").agg(F.sum(F.col("x") * F.col("v")).alias("dot"))
    return dots.groupBy("id").agg(F.max_by("cluster", F.struct(F.col("dot"), -F.col("cluster"))).alias("cluster"))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return x / np.where(np.isfinite(norm), np.maximum(norm, 1e-6), 1e-6)


def cosine_kmeans(points: np.ndarray, k: int, rounds: int = 25) -> np.ndarray:
    """Cluster of each row. Centres start at the first point, then at the point farthest from all centres."""
    x = np.asarray(points, np.float64)
    n = len(x)
    if k < 1:
        raise ValueError("k must be at least 1")
    if n == 0 or k == 1 or n == 1:
        return np.zeros(n, np.int64)
    k = min(k, n)

    def farthest(centres: np.ndarray) -> int:
        return int((1 - np.maximum(-1.0, (x @ centres.T).max(axis=1))).argmax())

    centres = x[:1].copy()
    while len(centres) < k:
        centres = np.vstack([centres, x[farthest(centres)]])
    assigned = np.full(n, -1)
    for _ in range(rounds):
        new = (x @ centres.T).argmax(axis=1)
        if (new == assigned).all():
            break
        assigned = new
        for c in range(k):
            mine = x[assigned == c]
            centres[c] = _unit(mine.mean(axis=0)) if len(mine) else x[farthest(centres)]
    return assigned


def relabel(assigned: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Clusters renumbered by their earliest start, ties by old number."""
    first: dict[int, int] = {}
    for c, s in zip(assigned, starts):
        first[int(c)] = min(first.get(int(c), s), s)
    rank = {c: i for i, c in enumerate(sorted(first, key=lambda c: (first[c], c)))}
    return np.array([rank[int(c)] for c in assigned], np.int64)


def cluster_segments(segments: DataFrame, k: int, rounds: int = 25) -> DataFrame:
    """``segments(stream, seg_id, start, embedding)`` to ``(stream, seg_id, speaker_id)``; one group per recording."""
    if k < 1:
        raise ValueError("k must be at least 1")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for starts, embeddings in zip(pdf["starts"], pdf["embeddings"]):
                x = _unit(np.stack([np.asarray(e, np.float64) for e in embeddings]))
                out.append(relabel(cosine_kmeans(x, k, rounds), np.asarray(starts)).astype(np.int32))
            yield pdf[["stream", "seg_ids"]].assign(speaker_ids=out)

    kind = dict(segments.dtypes)
    groups = segments.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("seg_id", "start", "embedding"))).alias("g"))
    groups = groups.select("stream", F.col("g.seg_id").alias("seg_ids"), F.col("g.start").alias("starts"), F.col("g.embedding").alias("embeddings"))
    done = groups.mapInPandas(run, f"stream {kind['stream']}, seg_ids array<{kind['seg_id']}>, speaker_ids array<int>")
    return done.select("stream", F.explode(F.arrays_zip("seg_ids", "speaker_ids")).alias("s")).select("stream", F.col("s.seg_ids").alias("seg_id"), F.col("s.speaker_ids").alias("speaker_id"))


def rank_by_first_start(assignments: DataFrame) -> DataFrame:
    """``assignments(stream, cluster, start)`` to ``(stream, cluster, speaker_id)`` by first appearance."""
    firsts = assignments.groupBy("stream", "cluster").agg(F.min("start").alias("first"))
    rank = F.row_number().over(Window.partitionBy("stream").orderBy("first", "cluster")) - 1
    return firsts.select("stream", "cluster", rank.cast("int").alias("speaker_id"))


def segment_embedding(samples: np.ndarray, start: int, end: int, bank: np.ndarray | None = None) -> np.ndarray:
    """Mean log-mel of a segment alone, normalised; zeros for an empty segment. ``bank`` are the model's own filters, if it has any."""
    bins = 128 if bank is None else len(bank)
    v, counts = whisper_rows(samples[start:end], bank) if end > start else (np.zeros((0, bins)), np.zeros(0))
    return _unit(counts @ v / counts.sum()) if len(v) else np.zeros(bins)
