"""Byte-level BPE over whole texts, by distinct space-led chunk.

A text is cut before every space whose left or right neighbour is not white space. No
pre-token crosses such a place, so the chunks' ids joined are the text's ids. The chunks of a
batch are found and hashed by numpy; only the distinct ones are looked up or encoded, and the
rest is a gather. A chunk is known by two 64-bit hashes under keys that each process draws for
itself; where the first agrees and the second does not, the chunks count as different.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken

SLICE_BYTES = 2 << 20
LONG_CHUNK = 4096
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
_K, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_KEY, _KEY2 = np.frombuffer(os.urandom(16), np.uint64)
_MASK = np.array([*((1 << 8 * i) - 1 for i in range(8)), (1 << 64) - 1], np.uint64)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def vocabulary_size(path: str) -> int:
    """One more than the largest id of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return max(*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])) + 1


def byte_of() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, other bytes for U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def white(buf: np.ndarray) -> np.ndarray:
    """Which bytes belong to white-space characters, those of two and three bytes included."""
    out = _ASCII_SPACE[buf]
    at = np.flatnonzero((buf[:-1] == 0xC2) & ((buf[1:] == 0x85) | (buf[1:] == 0xA0)))
    for i in (at, at + 1):
        out[i] = True
    lead = np.flatnonzero((buf[:-2] >= 0xE1) & (buf[:-2] <= 0xE3))
    if lead.size:
        a, b, c = buf[lead], buf[lead + 1], buf[lead + 2]
        hit = (a == 0xE1) & (b == 0x9A) & (c == 0x80)
        hit |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        hit |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
        hit |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
        for i in range(3):
            out[lead[hit] + i] = True
    return out


class Chunks:
    """The chunks of some texts: ``starts`` and ``ends`` in ``buf``, ``first`` chunk of each text,
    ``inverse`` to the distinct chunks, and ``sample``, one chunk of each kind."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets = buf, offsets
        n = len(buf)
        self.white = white(buf)
        edge = np.zeros(n + 1, bool)
        if n:
            solid = np.ones(n + 2, bool)  # beyond a text's ends counts as white
            solid[1:-1] = ~self.white
            solid[0] = solid[-1] = False
            before, after = solid[:-2].copy(), solid[2:].copy()
            inner = offsets[(offsets > 0) & (offsets < n)]
            before[inner], after[inner - 1] = False, False
            edge[:-1] = (buf == 32) & (before | after)
        edge[offsets[:-1][np.diff(offsets) > 0]] = True
        self.starts = np.flatnonzero(edge[:n])
        self.ends = np.append(self.starts[1:], n) if len(self.starts) else self.starts
        self.first = np.searchsorted(self.starts, offsets)
        h, check = self._hashes()
        while True:
            self.hashes, self.sample, self.inverse = np.unique(h, return_index=True, return_inverse=True)
            self.checks = check[self.sample]
            clash = self.checks[self.inverse] != check
            if not clash.any():
                break
            h[clash] = (h[clash] + _K) ^ check[clash]  # another place for those that are not the sample

    def _hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two mixed hashes of each chunk, eight bytes at a step."""
        if not len(self.starts):
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        words = np.ndarray((len(self.buf) + 1,), "<u8", np.concatenate([self.buf, np.zeros(8, np.uint8)]), strides=(1,))
        lengths = self.ends - self.starts
        h = lengths.astype(np.uint64) * _K ^ _KEY
        g = lengths.astype(np.uint64) ^ _KEY2
        left, at, which = lengths, self.starts, slice(None)
        for _ in range(LONG_CHUNK // 8):
            step = words[at] & _MASK[np.minimum(left, 8)]
            x = (h[which] ^ step) * _K
            h[which] = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (g[which] ^ step) * _K2
            g[which] = x ^ (x >> np.uint64(32))
            more = left > 8
            if not more.any():
                break
            left, at = left[more] - 8, at[more] + 8
            which = np.flatnonzero(more) if isinstance(which, slice) else which[more]
        h ^= h >> np.uint64(32)
        for i in np.flatnonzero(lengths > LONG_CHUNK):
            h[i], g[i] = np.frombuffer(hashlib.blake2b(self.bytes_of(i), digest_size=16).digest(), "<u8")
        return h, g

    def bytes_of(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()

    def distinct(self) -> list[bytes]:
        raw = self.buf.tobytes()
        return [raw[a:b] for a, b in zip(self.starts[self.sample].tolist(), self.ends[self.sample].tolist())]

    def rows_with(self, strings: Iterable[str]) -> set[int]:
        """Texts that hold one of some strings."""
        raw, rows = self.buf.tobytes(), set()
        for s in strings:
            needle, at = s.encode(), -1
            while (at := raw.find(needle, at + 1)) >= 0:
                rows.add(int(np.searchsorted(self.offsets, at, "right")) - 1)
        return rows


def chunked(column: pa.Array) -> Iterator[tuple[int, int, Chunks]]:
    """``(from row, to row, chunks)`` for slices of a string column of a few MB each; null counts as empty."""
    n = len(column)
    if not n:
        return
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, "<i8")[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        j = min(j, n)
        yield i, j, Chunks(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def spread(sizes: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Indices that gather ragged values, stored one after another with these sizes, in the order of ``inverse``."""
    begin = np.cumsum(sizes, dtype=np.int64) - sizes
    each = sizes[inverse]
    return np.repeat(begin[inverse] - (np.cumsum(each, dtype=np.int64) - each), each) + np.arange(int(each.sum()))


def gathered(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text: more repeats within each."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.column(column).nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held and (rest := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield rest[0]


class ChunkIds:
    """Ids of the distinct chunks of a batch; a subclass makes those not seen before (``_new``).

    Chunks of earlier batches are found by hash in a sorted cache of at most ``entries``; one that
    meets another's first hash takes its place.
    """

    entries = 500_000

    def __init__(self):
        self.cache = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, "<u4")

    def kinds(self, c: Chunks) -> tuple[np.ndarray, np.ndarray]:
        """For the distinct chunks of ``c``: how many ids each has, and all their ids, one after another."""
        known, checks, sizes, flat = self.cache
        at = np.minimum(np.searchsorted(known, c.hashes), max(len(known) - 1, 0))
        met = known[at] == c.hashes if len(known) else np.zeros(len(c.hashes), bool)
        hit = met.copy()
        hit[met] = checks[at[met]] == c.checks[met]
        new_sizes, new_flat = self._new(c, np.flatnonzero(~hit))
        full = len(known) + len(new_sizes) > self.entries
        if full or (met & ~hit).any():
            used = np.unique(at[hit]) if full else np.delete(np.arange(len(known)), at[met & ~hit])
            known, checks, flat, sizes = known[used], checks[used], flat[spread(sizes, used)], sizes[used]
        hashes = np.concatenate([known, c.hashes[~hit]])
        order = np.argsort(hashes, kind="stable")  # two sorted runs
        all_checks = np.concatenate([checks, c.checks[~hit]])
        all_sizes, all_flat = np.concatenate([sizes, new_sizes.astype(np.int32)]), np.concatenate([flat, new_flat])
        self.cache = known, _, sizes, flat = hashes[order], all_checks[order], all_sizes[order], all_flat[spread(all_sizes, order)]
        mine = np.searchsorted(known, c.hashes)
        return sizes[mine], flat[spread(sizes, mine)]

    def texts(self, column: pa.Array, special: Iterable[str]) -> Iterator[np.ndarray | None]:
        """The ids of each text; None for those that hold a special string."""
        for i, j, c in chunked(column):
            kinds, flat = self.kinds(c)
            flat = flat[spread(kinds, c.inverse)]
            ends = np.concatenate([[0], np.cumsum(kinds[c.inverse], dtype=np.int64)])[c.first]
            odd = c.rows_with(special)
            for row in range(j - i):
                yield None if row in odd else flat[ends[row] : ends[row + 1]]


class Encoder(ChunkIds):
    """Ids of the distinct chunks of a batch, in one call for all chunks that begin with a space and a letter or sign."""

    def __init__(self, path: str):
        super().__init__()
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_of()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.encoding = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.n_ids = max(*spec["model"]["vocab"].values(), *self.special.values()) + 1
        self.width = np.zeros(self.n_ids, np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)

    def raw(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode_ordinary(text), "<u4")

    def _new(self, c: Chunks, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = c.starts[c.sample[which]], c.ends[c.sample[which]]
        regular = (ends - starts > 1) & (c.buf[starts] == 32)
        regular[regular] &= ~c.white[starts[regular] + 1]
        sizes = np.zeros(len(starts), np.int64)
        lengths = (ends - starts)[regular]
        at = np.repeat(starts[regular] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        joined = self.raw(c.buf[at].tobytes().decode("utf-8"))
        edges = np.searchsorted(np.cumsum(self.width[joined]), np.cumsum(lengths), "right")
        sizes[regular] = np.diff(edges, prepend=0)
        others = [self.raw(c.buf[a:b].tobytes().decode("utf-8")) for a, b in zip(starts[~regular], ends[~regular])]
        sizes[~regular] = [len(x) for x in others]
        flat = np.empty(int(sizes.sum()), "<u4")
        flat[np.repeat(regular, sizes)] = joined
        flat[np.repeat(~regular, sizes)] = np.concatenate([*others, np.empty(0, "<u4")])
        return sizes, flat

    def counts(self, c: Chunks) -> np.ndarray:
        """Tokens of each chunk."""
        return self.kinds(c)[0][c.inverse]

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, as the tokenizers library gives them: special strings in a text become their ids."""
        for row, ids in enumerate(self.texts(column, self.special)):
            yield self.with_special(column[row].as_py()) if ids is None else ids

    def with_special(self, text: str) -> np.ndarray:
        parts = self.split_special.split(text)
        return np.concatenate([np.asarray([self.special[p]], "<u4") if i % 2 else self.raw(p) for i, p in enumerate(parts)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
