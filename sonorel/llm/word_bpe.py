"""BPE encoding and decoding of whole texts with a word-end vocabulary.

Merging a word: its symbols form a doubly linked list, all neighbouring pairs that have a merge
rank go to a priority queue ordered by (rank, place); the best is taken, skipped if it is stale
(a side was merged meanwhile), else merged and its two new neighbours queued. Decoding
concatenates vocabulary strings, with a space between tokens, as the library does for a
vocabulary without decoder.

Words never cross white space, so each distinct space-led chunk of a batch is encoded once;
bounded caches keep chunks and words.

Defined results: null and empty texts have no tokens (digests of the empty string); special
strings in a text become their ids, matched before normalisation; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from sonorel.llm.byte_bpe import ChunkIds, Chunks, byte_of, gathered
from sonorel.shipping import ship

CACHE_ENTRIES = 300_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def merge_word(symbols: list[int], ranks: dict[int, int]) -> list[int]:
    """Merge symbol ids by rank; ``ranks`` maps left << 17 | right to rank << 17 | merged id.

    A queue entry is one number: rank, place and merged id from the top bits down.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    rank_of = ranks.get
    queue = []
    left = symbols[0]
    for i in range(1, n):
        right = symbols[i]
        hit = rank_of(left << 17 | right)
        if hit is not None:
            queue.append((hit >> 17) << 57 | (i - 1) << 17 | hit & 0x1FFFF)
        left = right
    if not queue:
        return symbols
    heapify(queue)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while queue:
        top = heappop(queue)
        i = top >> 17 & 0xFFFFFFFFFF
        j = after[i]
        left = symbols[i]
        if left < 0 or j >= n or rank_of(left << 17 | symbols[j]) != (top >> 57) << 17 | top & 0x1FFFF:
            continue  # stale: one side was merged meanwhile
        merged = top & 0x1FFFF
        symbols[i], symbols[j] = merged, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            hit = rank_of(merged << 17 | symbols[k])
            if hit is not None:
                heappush(queue, (hit >> 17) << 57 | i << 17 | hit & 0x1FFFF)
        h = before[i]
        if h >= 0:
            hit = rank_of(symbols[h] << 17 | merged)
            if hit is not None:
                heappush(queue, (hit >> 17) << 57 | h << 17 | hit & 0x1FFFF)
    return [s for s in symbols if s >= 0]


class WordBPE(ChunkIds):
    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.token = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        pairs = (m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"])
        self.ranks = {vocab[a] << 17 | vocab[b]: r << 17 | vocab[a + b] for r, (a, b) in enumerate(pairs)}
        alphabet = {b: c for c, b in byte_of().items()}
        self.inner = [vocab.get(alphabet[b]) for b in range(256)]
        self.last = [vocab.get(alphabet[b] + end) for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.spaces = regex.compile(r"[^\S\x1c-\x1f]+")
        self.of_word: dict[str, tuple[int, ...]] = {}
        top = max(self.token) + 1
        self.decimal = [b"%d " % i for i in range(top)]
        self.string = [(self.token.get(i, "") + " ").encode() for i in range(top)]

    def word(self, w: str) -> tuple[int, ...]:
        ids = self.of_word.get(w)
        if ids is None:
            raw = w.encode("utf-8", "surrogatepass")
            symbols = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
            ids = tuple(merge_word([s for s in symbols if s is not None], self.ranks))
            if len(self.of_word) >= CACHE_ENTRIES:
                self.of_word.clear()
            self.of_word[w] = ids
        return ids

    def ids_of(self, text: str) -> list[int]:
        """Ids of a text without special strings."""
        low = unicodedata.normalize("NFC", text)
        low = "".join(c.lower() for c in low) if "Σ" in low else low.lower()
        if low.isalpha():  # the common case needs no pattern
            return list(self.word(low))
        return [i for w in self.words.findall(self.spaces.sub(" ", low)) for i in self.word(w)]

    def _new(self, c: Chunks, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes, flat = [], []
        raw = c.buf.tobytes()
        for a, b in zip(c.starts[c.sample[which]].tolist(), c.ends[c.sample[which]].tolist()):
            if raw[a] == 32:
                a += 1
            ids = self.ids_of(raw[a:b].decode("utf-8"))
            sizes.append(len(ids))
            flat += ids
        return np.asarray(sizes, np.int64), np.asarray(flat, "<u4")

    def encode(self, text: str | None) -> list[int]:
        text = text or ""
        if self.split_special and any(s in text for s in self.special):
            return [i for k, part in enumerate(self.split_special.split(text)) for i in ([self.special[part]] if k % 2 else self.ids_of(part))]
        return self.ids_of(text)

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.token[i] for i in ids])

    def round_trips(self, column: pa.Array) -> Iterator[tuple[int, bytes, bytes]]:
        """Number of tokens, decimal ids and decoded text of each text."""
        decimal, string = self.decimal.__getitem__, self.string.__getitem__
        for row, found in enumerate(self.texts(column, self.special)):
            ids = self.encode(column[row].as_py()) if found is None else found.tolist()
            yield len(ids), b"".join(map(decimal, ids))[:-1], b"".join(map(string, ids))[:-1]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBPE:
    return WordBPE(path)


def round_trips(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row."""
    path = path or default_path()
    ship(docs.sparkSession)

    def run(batches):
        bpe = tokenizer(path)
        for batch in gathered(batches):
            n, ids_sha, decoded_sha = [], [], []
            for count, ids, text in bpe.round_trips(batch.column("text")):
                n.append(count)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded_sha.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
