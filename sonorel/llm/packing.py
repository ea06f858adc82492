"""Packing along a space-filling curve.

A document's token ids are counted into 256 signed hash buckets, the damped and normalised
vector is projected to four dimensions, squashed to 8 bits each, and turned into a position on
the four-dimensional Hilbert curve (Skilling 2004). Documents are range-sorted by that position,
and each sort partition lays its documents end to end and cuts the line every ``size`` tokens,
so neighbours on the curve share sequences and nothing is padded. The end of a partition's line,
less than a sequence, is cut into powers of two: at most ten short sequences a partition.

Ids are encoded once and move once, as 16-bit numbers where the vocabulary allows. A task holds
the pieces of one open sequence; sequences are numbered within their partition, and the driver
adds up one number per sort partition.

Defined results: null and empty texts are their end token alone; rows are packed one by one,
so repeated rows and null doc_ids each get their own pieces; ties on the curve go by row
number; a long text takes as many sequences as it needs; an empty table gives no pieces. Extra
columns are not carried.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sonorel.llm.byte_bpe import default_path, encoder, vocabulary_size
from sonorel.llm.work import discard, stored

HASHED, DIMS, BITS = 256, 4, 8
_rng = np.random.Generator(np.random.PCG64(7))
_project = _rng.standard_normal((HASHED, DIMS))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of rows of whole-number coordinates, by Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(flip, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(bags: np.ndarray) -> np.ndarray:
    """Curve positions of rows of signed bucket counts."""
    v = np.sign(bags) * np.sqrt(np.abs(bags))
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    p = (v / np.where(norm > 0, norm, 1)) @ _project
    return hilbert(np.minimum((np.tanh(p) + 1) * (1 << (BITS - 1)), (1 << BITS) - 1))


def remainder_sizes(rest: int) -> list[int]:
    """Powers of two, largest first, that add up to ``rest``."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class Packer:
    """Lays rows of ids end to end and gives the pieces of each sequence of ``size`` as it fills."""

    def __init__(self, size: int):
        self.size, self.at, self.sequence = size, 0, 0
        self.open: list[tuple] = []
        self.out: list[tuple] = []

    def add(self, doc: int | None, key: int, ids: np.ndarray) -> None:
        done = 0
        while done < len(ids):
            take = min(self.size - self.at, len(ids) - done)
            self.open.append((doc, key, len(ids), done, ids[done : done + take]))
            self.at += take
            done += take
            if self.at == self.size:
                self._close(self.size)

    def _close(self, length: int) -> None:
        """The first ``length`` open tokens become a sequence."""
        offset, rest = 0, []
        for doc, key, total, start, ids in self.open:
            mine = ids[: length - offset]
            if len(mine):
                self.out.append((doc, start, len(mine), zlib.crc32(mine.astype("<u4").tobytes()), total, self.sequence, offset, key))
                offset += len(mine)
            if len(mine) < len(ids):
                rest.append((doc, key, total, start + len(mine), ids[len(mine) :]))
        self.open, self.at, self.sequence = rest, self.at - length, self.sequence + 1

    def end(self) -> None:
        for length in remainder_sizes(self.at):
            self._close(length)

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def encoded(docs: DataFrame, path: str, end_id: int, wide: str) -> DataFrame:
    """``(row, doc_id, key, ids)``: a number per row, curve position and packed ids."""

    def run(batches):
        enc = encoder(path)
        rng = np.random.Generator(np.random.PCG64(8))
        bucket = rng.integers(0, HASHED, max(enc.n_ids, end_id + 1))
        sign = rng.choice([-1.0, 1.0], len(bucket))
        for batch in batches:
            ids, bags = [], np.zeros((batch.num_rows, HASHED))
            for i, x in enumerate(enc.encode(batch.column("text"))):
                bags[i] = np.bincount(bucket[x], sign[x], HASHED)
                ids.append(np.append(x, end_id).astype(wide).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(curve_keys(bags)), pa.array(ids, pa.binary())], names=["row", "doc_id", "key", "ids"])

    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "row long, doc_id long, key long, ids binary")


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence long, offset long, curve long"


def pack(docs: DataFrame, size: int = 1024, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve``."""
    spark = docs.sparkSession
    path = path or default_path()
    wide = "<u2" if max(vocabulary_size(path), end_id + 1) <= 1 << 16 else "<u4"
    rows = stored(encoded(docs, path, end_id, wide), "ids")

    def pieces(batches):
        packer, part = Packer(size), 0

        def table(found):
            columns = list(zip(*found)) or [()] * 8
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([part] * len(found), pa.int32())], names=[*(x.split()[0] for x in PIECE.split(", ")), "part"])

        for batch in batches:
            for doc, key, raw, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "ids", "part"))):
                packer.add(doc, key, np.frombuffer(raw, wide))
            yield table(packer.taken())
        packer.end()
        yield table(packer.taken())

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    line = rows.repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row").withColumn("part", F.spark_partition_id())
    found = stored(line.select("doc_id", "key", "ids", "part").mapInArrow(pieces, f"{PIECE}, part int"), "pieces")
    discard(rows)
    used = {r.part: r.n for r in found.groupBy("part").agg((F.max("sequence") + 1).alias("n")).collect()}  # a number per sort partition
    base, total = [], 0
    for part in sorted(used):
        base.append((part, total))
        total += used[part]
    bases = F.broadcast(spark.createDataFrame(base, "part int, base long"))  # as many rows as sort partitions
    return found.join(bases, "part").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("sequence")).alias("sequence_id"), "offset", "curve")
