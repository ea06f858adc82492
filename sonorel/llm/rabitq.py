"""Approximate nearest neighbours by randomly rotated one-bit codes.

A unit vector is rotated by a fixed random orthogonal matrix and kept as the signs of its
coordinates, packed to bits, with one correction scalar: its inner product with its own code.
The inner product with a query is estimated from the code, divided by that scalar, with an
error bound that shrinks with the root of the dimension (Gao and Long 2024). A candidate whose
upper bound reaches the k-th best lower bound seen is reranked on the original vectors in
double precision.

All rows are coded, in blocks of 1024, and so are the queries, in blocks of 512. Codes are dealt
into lanes and queries into lanes, every pair of lanes is a task's work, and their numbers follow
from the amount of work and the cluster, so that what travels is least. A task keeps the k best
exact scores of each query while blocks pass by, so that bounds get sharper as it goes, and returns
k rows a query. No candidate is capped: equal vectors within a block share one code, and of their
ids the k + 1 smallest can ever rank.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components,
and rows with a null vec_id, are neither queries nor candidates; with fewer than k candidates all are
returned; ties go to the smaller vec_id; vectors of another length than the query's are no
candidates; a repeated row counts once per repetition of its id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sonorel.llm.vectors import dots, norms, read_vectors, scaled, unit, width_of
from sonorel.llm.work import discard, stored

BLOCK, QUERY_BLOCK, TASK = 1024, 512, 1 << 23
EPSILON = 4.0  # standard errors of the estimate that the bounds allow


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = 9) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, rotate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of rotated unit rows, and each row's inner product with its own code."""
    y = x @ rotate
    signs = y >= 0
    own = np.abs(y).sum(axis=1) / np.sqrt(x.shape[1])
    return np.packbits(signs, axis=1), own


def estimates(codes: np.ndarray, own: np.ndarray, q: np.ndarray, rotate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of query rows with coded rows, and the error bound of each coded row."""
    dim = q.shape[1]
    y = (q @ rotate).astype(np.float32)
    bits = np.unpackbits(codes, axis=1, count=dim).astype(np.float32)
    raw = (2 * (y @ bits.T) - y.sum(axis=1, keepdims=True)) / np.sqrt(dim)
    error = np.sqrt(np.maximum(0, 1 - own**2)) / own * EPSILON / np.sqrt(max(dim - 1, 1))
    return raw / own, error


def block_rows(vectors: DataFrame, width: str, size: int, coded: bool) -> DataFrame:
    """Rows of ``size`` vectors of one length: ``block, dim, ids, vecs, codes, own``."""
    item = np.dtype(width).itemsize

    def run(batches):
        held: dict[int, list] = {}

        def give(length: int):
            rows = held.pop(length)
            raw = b"".join(v for _, v in rows)
            codes = own = b""
            if coded:
                x = unit(np.frombuffer(raw, width).reshape(len(rows), -1))
                c, o = encode(x, rotation(x.shape[1]))
                codes, own = c.tobytes(), o.tobytes()
            ids = np.array([i for i, _ in rows], "<i8")
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((length // item, pa.int32()), (ids.tobytes(), pa.binary()), (raw, pa.binary()), (codes, pa.binary()), (own, pa.binary()))], names=["dim", "ids", "vecs", "codes", "own"])

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("vec").to_pylist()):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) >= size:
                    yield give(len(v))
        for length in list(held):
            yield give(length)

    return vectors.select("vec_id", "vec").mapInArrow(run, "dim int, ids binary, vecs binary, codes binary, own binary")


class Best:
    """The nearest found so far of the queries of one block: exact scores, and ids, of ``k`` each."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.k, self.unit = ids, k, unit(q)
        self.q, self.norm = scaled(q), norms(scaled(q))
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def see(self, ids: np.ndarray, x: np.ndarray, norm: np.ndarray, codes: np.ndarray, own: np.ndarray, begin: np.ndarray, by_kind: np.ndarray) -> None:
        """Rerank what of a code block the bounds do not rule out.

        ``x`` (scaled), ``norm``, ``codes`` and ``own`` have a row for each kind of equal vectors; ``by_kind`` lists the rows of kinds by id.
        """
        k = self.k
        est, err = estimates(codes, own, self.unit, rotation(x.shape[1]))
        take = min(k + 1, len(x))  # one more: the query itself may be among them
        low = np.partition(est - err, len(x) - take, axis=1)[:, len(x) - take] if take == k + 1 else np.full(len(est), -np.inf)
        rows, cols = np.nonzero(est + err >= np.maximum(low, self.scores[:, -1] - 1e-9)[:, None])
        if not len(rows):
            return
        scores = np.empty(len(rows))
        for s in range(0, len(rows), 8192):  # as ``cosines``, with each row scaled and measured once
            i, j = rows[s : s + 8192], cols[s : s + 8192]
            scores[s : s + 8192] = dots(self.q[i], x[j]) / (self.norm[i] * norm[j])
        good = scores >= self.scores[rows, -1]
        rows, cols, scores = rows[good], cols[good], scores[good]
        copies = np.minimum(begin[cols + 1] - begin[cols], k + 1)  # of equal vectors no more can rank
        place = np.arange(int(copies.sum())) - np.repeat(np.cumsum(copies) - copies, copies)
        rows, scores, found = np.repeat(rows, copies), np.repeat(scores, copies), ids[by_kind[np.repeat(begin[cols], copies) + place]]
        other = found != self.ids[rows]
        rows, scores, found = rows[other], scores[other], found[other]
        touched = np.unique(rows)
        rows = np.concatenate([rows, np.repeat(touched, k)])
        scores, found = np.concatenate([scores, self.scores[touched].ravel()]), np.concatenate([found, self.found[touched].ravel()])
        order = np.lexsort((found, -scores, rows))
        rows, scores, found = rows[order], scores[order], found[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        best = rank < k
        self.scores[rows[best], rank[best]], self.found[rows[best], rank[best]] = scores[best], found[best]

    def rows(self) -> pa.RecordBatch:
        there = np.isfinite(self.scores)
        query = np.repeat(self.ids, self.k).reshape(self.scores.shape)
        return pa.RecordBatch.from_arrays([pa.array(query[there]), pa.array(self.scores[there]), pa.array(self.found[there])], names=["query_id", "score", "vec_id"])


def _kinds(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row of each kind of equal vectors; where each kind's rows begin in the list of rows by kind and id; that list."""
    order = np.argsort(ids, kind="stable")
    view = np.ascontiguousarray(x[order]).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, first, inverse = np.unique(view, return_index=True, return_inverse=True)
    by_kind = np.argsort(inverse, kind="stable")
    begin = np.append(np.searchsorted(inverse[by_kind], np.arange(len(first))), len(ids))
    return order[first], begin, order[by_kind]


def lanes(vectors: int, queries: int, partitions: int) -> tuple[int, int]:
    """Into how many lanes codes and queries are dealt: a task for every ``TASK`` comparisons, at most 16 per partition, of least travel."""
    tasks = min(max(1, math.ceil(vectors * queries / TASK)), 16 * partitions)
    of_codes = min(tasks, max(1, round(math.sqrt(tasks * vectors / max(queries, 1)))))
    return of_codes, math.ceil(tasks / of_codes)


def nearest(df: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The ``k`` nearest other rows of every row of ``df(vec_id, embedding)`` whose vec_id is divisible by ``every``."""
    spark = df.sparkSession
    width = width_of(df)
    vectors = stored(read_vectors(df, width).where("vec is not null and vec_id is not null").select("vec_id", "vec"), "vectors")
    n, q = vectors.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    a, b = lanes(n, q, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def dealt(rows: DataFrame, own: str, number: int, other: str, others: int) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long")))
        return rows.withColumn(own, F.pmod(F.xxhash64(F.col(rows.columns[1])), F.lit(number))).withColumn(other, each)

    codes = dealt(block_rows(vectors, width, BLOCK, True), "a", a, "b", b)
    queries = block_rows(vectors.where(f"vec_id % {every} = 0"), width, QUERY_BLOCK, False)
    queries = dealt(queries.select(F.col("dim"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q")), "b", b, "a", a)
    met = codes.join(queries, ["dim", "a", "b"])

    def run(batches):
        best: dict[tuple, Best] = {}  # k rows a query of this task
        last: tuple = (None,)
        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                if last[0] != (dim, r["ids"]):
                    ids, x = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["vecs"], width).reshape(-1, dim)
                    kinds, begin, by_kind = _kinds(ids, x)
                    x = scaled(x[kinds])
                    last = (dim, r["ids"]), (ids, x, norms(x), np.frombuffer(r["codes"], np.uint8).reshape(len(ids), -1)[kinds], np.frombuffer(r["own"], np.float64)[kinds], begin, by_kind)
                if (dim, r["q_ids"]) not in best:
                    best[dim, r["q_ids"]] = Best(np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["q"], width).reshape(-1, dim), k)
                best[dim, r["q_ids"]].see(*last[1])
        for some in best.values():
            yield some.rows()

    best = stored(met.mapInArrow(run, "query_id long, score double, vec_id long"), "best", rows=16)
    discard(vectors)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
