"""Binary sources and sinks: WAV, filter files, safetensors and GGUF."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from sonorel.sources.inventory import safetensors_header


def decode_wav(content: bytes) -> tuple[int, int, np.ndarray]:
    """Rate, channels and interleaved samples: whole numbers over 2**(bits - 1), floats as they are."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, fmt, data = 12, None, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if kind == 0xFFFE:
                kind = struct.unpack("<H", body[24:26])[0]
            fmt = kind, channels, rate, bits
        elif name == b"data":
            data = body
        at += 8 + size + (size & 1)
    if fmt is None or data is None:
        raise ValueError("no format or data chunk")
    kind, channels, rate, bits = fmt
    if kind == 3:
        x = np.frombuffer(data[: len(data) // (bits // 8) * (bits // 8)], "<f4" if bits == 32 else "<f8").astype(np.float32)
    elif bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    elif bits == 24:
        b = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        x = np.where(v >= 1 << 23, v - (1 << 24), v).astype(np.float32) / (1 << 23)
    elif bits in (16, 32):
        x = np.frombuffer(data[: len(data) // (bits // 8) * (bits // 8)], f"<i{bits // 8}").astype(np.float64) / 2.0 ** (bits - 1)
    else:
        raise ValueError(f"{bits} bits a sample")
    return rate, channels, x.astype(np.float32)


def encode_wav(samples: np.ndarray, rate: int, channels: int = 1) -> bytes:
    """A 16-bit WAV file."""
    data = (np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes()
    out = io.BytesIO()
    out.write(b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16))
    out.write(b"data" + struct.pack("<I", len(data)) + data)
    return out.getvalue()


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sample_rate, channels, samples)`` of WAV files, one row each."""
    return decoded(spark.read.format("binaryFile").load(path))


def decoded(files: DataFrame) -> DataFrame:
    """``files(path, content)`` of WAV bytes to ``(path, sample_rate, channels, samples)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *decode_wav(c)) for p, c in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "channels", "samples"])

    return files.select("path", "content").mapInPandas(run, "path string, sample_rate int, channels int, samples array<float>")


def read_filters(spark: SparkSession, path: str, n_mels: int, n_fft: int) -> DataFrame:
    """``(bin, k, w)`` of a raw little-endian float file of n_mels rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c in pdf["content"]:
                w = np.frombuffer(c, "<f4")
                if len(w) != n_mels * (n_fft // 2 + 1):
                    raise ValueError("the filter file has another size")
                b, k = np.divmod(np.arange(len(w)), n_fft // 2 + 1)
                yield pd.DataFrame({"bin": b.astype(np.int32), "k": k.astype(np.int32), "w": w.astype(np.float64)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "bin int, k int, w double")


def read_safetensors(spark: SparkSession, path: str) -> DataFrame:
    """``(path, name, dtype, shape, rank, bytes)`` of all tensors: only the header of each file is read, whatever its size."""
    rows = []
    for p, head in _heads(spark, path):
        rows += [(p, n, d, s, len(s), e - b) for n, d, s, b, e in safetensors_header(head)]
    return spark.createDataFrame(rows, "path string, name string, dtype string, shape array<long>, rank int, bytes long")


def _heads(spark: SparkSession, path: str) -> list[tuple[str, bytes]]:
    """Name and header bytes of the safetensors files that a path or pattern names; a model has a few, of some KB each."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    out = []
    for status in fs.globStatus(p) or []:
        files = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        for f in files:
            if f.isFile() and (not status.isDirectory() or f.getPath().getName().endswith(".safetensors")):
                stream = fs.open(f.getPath())
                try:
                    size = bytes(stream.readNBytes(8))
                    out.append((f.getPath().toString(), size + bytes(stream.readNBytes(int.from_bytes(size, "little")))))
                finally:
                    stream.close()
    return sorted(out)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """``(path, shape, data)`` of ``.npy`` files of floats."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            arrays = [np.load(io.BytesIO(c), allow_pickle=False) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "shape": [list(a.shape) for a in arrays], "data": [a.astype(np.float32).ravel() for a in arrays]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, shape array<long>, data array<float>")


_DTYPES = {"F32": "<f4", "F64": "<f8", "F16": "<f2", "I32": "<i4", "I64": "<i8", "U8": "u1"}


def tensor(content: bytes, name: str) -> np.ndarray:
    """One tensor of a safetensors file; bfloat16 is widened to float."""
    for n, dtype, shape, begin, end in safetensors_header(content):
        if n == name:
            return array_of(content[begin:end], dtype).reshape(shape)
    raise KeyError(name)


def array_of(raw: bytes, dtype: str) -> np.ndarray:
    if dtype == "BF16":
        return (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32)
    return np.frombuffer(raw, _DTYPES[dtype])


def bank_from_weights(content: bytes, prefix: str = "preprocessor.featurizer.") -> tuple[np.ndarray, np.ndarray | None]:
    """Filters (bins, n_fft / 2 + 1) and, if it is there, the window, from a model's own weights."""
    bank = np.asarray(tensor(content, prefix + "fb"), np.float64)
    try:
        window = np.asarray(tensor(content, prefix + "window"), np.float64).ravel()
    except KeyError:
        window = None
    return bank.reshape(bank.shape[-2:]), window


def quantize_q8_0(x: np.ndarray) -> bytes:
    """Blocks of 32: a half-precision scale and 32 signed bytes (the public Q8_0 layout)."""
    b = np.asarray(x, np.float32).reshape(-1, 32)
    d = np.abs(b).max(axis=1) / 127
    q = np.where(d[:, None] > 0, b / np.where(d > 0, d, 1)[:, None], 0)
    return b"".join(s.tobytes() + r.tobytes() for s, r in zip(d.astype("<f2"), np.rint(q).astype(np.int8)))


def dequantize_q8_0(raw: bytes, n: int) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).reshape(-1, 34)[: -(-n // 32)]
    return (np.ascontiguousarray(b[:, :2]).view("<f2").astype(np.float32) * np.ascontiguousarray(b[:, 2:]).view(np.int8)).ravel()[:n]


def quantize_q4_0(x: np.ndarray) -> bytes:
    """Blocks of 32: a half-precision scale and 16 bytes of two four-bit numbers (the public Q4_0 layout)."""
    b = np.asarray(x, np.float32).reshape(-1, 32)
    top = b[np.arange(len(b)), np.abs(b).argmax(axis=1)]
    d = top / -8
    q = np.clip(np.floor(np.where(d[:, None] != 0, b / np.where(d != 0, d, 1)[:, None], 0) + 8.5), 0, 15).astype(np.uint8)
    packed = q[:, :16] | q[:, 16:] << 4
    return b"".join(s.tobytes() + r.tobytes() for s, r in zip(d.astype("<f2"), packed))


def dequantize_q4_0(raw: bytes, n: int) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).reshape(-1, 18)[: -(-n // 32)]
    q = np.concatenate([b[:, 2:] & 15, b[:, 2:] >> 4], axis=1).astype(np.float32) - 8
    return (np.ascontiguousarray(b[:, :2]).view("<f2").astype(np.float32) * q).ravel()[:n]


QUANTIZERS = {"Q8_0": quantize_q8_0, "Q4_0": quantize_q4_0}
_GGML = {"F32": 0, "F16": 1, "Q4_0": 2, "Q8_0": 8}


def write_gguf(tensors: list[tuple[str, str, tuple[int, ...], bytes]], metadata: dict[str, str] | None = None, align: int = 32) -> bytes:
    """A GGUF version 3 file of (name, type, shape, raw) with string metadata."""
    string = lambda s: struct.pack("<Q", len(s.encode())) + s.encode()
    meta = metadata or {}
    head = b"GGUF" + struct.pack("<IQQ", 3, len(tensors), len(meta)) + b"".join(string(k) + struct.pack("<I", 8) + string(v) for k, v in meta.items())
    at, body = 0, b""
    for name, kind, shape, raw in tensors:
        head += string(name) + struct.pack("<I", len(shape)) + b"".join(struct.pack("<Q", n) for n in reversed(shape)) + struct.pack("<IQ", _GGML[kind], at)
        body += raw + b"\0" * (-len(raw) % align)
        at = len(body)
    return head + b"\0" * (-len(head) % align) + body


def gguf_header(content: bytes) -> tuple[dict[str, object], list[tuple[str, tuple[int, ...], int, int]]]:
    """String and scalar metadata, and (name, shape, type, offset) of each tensor."""
    if content[:4] != b"GGUF":
        raise ValueError("not a GGUF file")
    _, n_tensors, n_meta = struct.unpack("<IQQ", content[4:24])
    at = 24
    formats = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<?", 10: "<Q", 11: "<q", 12: "<d"}

    def value(kind: int):
        nonlocal at
        if kind == 8:
            n = struct.unpack_from("<Q", content, at)[0]
            at += 8 + n
            return content[at - n : at].decode("utf-8", "replace")
        if kind == 9:
            inner, n = struct.unpack_from("<IQ", content, at)
            at += 12
            return [value(inner) for _ in range(n)]
        out = struct.unpack_from(formats[kind], content, at)[0]
        at += struct.calcsize(formats[kind])
        return out

    meta = {}
    for _ in range(n_meta):
        key = value(8)
        meta[key] = value(value(4))
    tensors = []
    for _ in range(n_tensors):
        name, dims = value(8), value(4)
        shape = tuple(reversed([value(10) for _ in range(dims)]))
        tensors.append((name, shape, value(4), value(10)))
    return meta, tensors


def read_gguf(spark: SparkSession, path: str) -> DataFrame:
    """``(path, name, shape, type)`` of all tensors of GGUF files, from headers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, n, list(s), t) for p, c in zip(pdf["path"], pdf["content"]) for n, s, t, _ in gguf_header(c)[1]]
            yield pd.DataFrame(rows, columns=["path", "name", "shape", "type"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, name string, shape array<long>, type int")
