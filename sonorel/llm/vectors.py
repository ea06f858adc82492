"""Reading vector tables: valid rows as raw little-endian bytes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def valid_rows(column: pa.Array, double: bool) -> list[bytes | None]:
    """Each vector's bytes; None if it is null, empty or zero, or holds a null or non-finite component."""
    out: list[bytes | None] = []
    for v in column.to_pylist():
        if not v or None in v:
            out.append(None)
            continue
        x = np.asarray(v, "<f8")
        ok = np.isfinite(x).all() and x.any()
        out.append(x.astype("<f8" if double else "<f4").tobytes() if ok else None)
    return out


def is_double(df: DataFrame) -> bool:
    return "double" in df.schema["embedding"].dataType.simpleString() or "float" not in df.schema["embedding"].dataType.simpleString()


def read_vectors(df: DataFrame, width: str) -> DataFrame:
    """``(vec_id, vec, digest)`` of every row of ``df(vec_id, embedding)``; vec is null for vectors that take no part.

    ``width`` is '<f4' for float and '<f8' for double components, so bytes are exact.
    """
    double = width == "<f8"

    def run(batches):
        for batch in batches:
            vec = valid_rows(batch.column("embedding"), double)
            digest = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in vec]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(vec, pa.binary()), pa.array(digest, pa.binary())], names=["vec_id", "vec", "digest"])

    return df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, vec binary, digest binary")


def width_of(df: DataFrame) -> str:
    return "<f8" if is_double(df) else "<f4"


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows in double precision times a power of two each, so that no square overflows or vanishes; no digit changes."""
    x = np.ascontiguousarray(x, np.float64)
    _, exponent = np.frexp(np.abs(x).max(axis=-1, keepdims=True, initial=0))
    return np.ldexp(x, -exponent)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of ``a`` with rows of ``b``, summed from the first component to the last."""
    out = np.zeros(len(a))
    for s in range(0, len(a), 4096):
        parts = np.ascontiguousarray((a[s : s + 4096] * b[s : s + 4096]).T)
        total = out[s : s + 4096]
        for part in parts:
            total += part
    return out


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(dots(x, x))


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of ``a`` with rows of ``b`` in double precision, each alike whatever its neighbours are."""
    a, b = scaled(a), scaled(b)
    return dots(a, b) / (norms(a) * norms(b))
