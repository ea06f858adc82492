"""Token counts that follow edits.

A document is kept as a segment tree over its pre-token groups: its leaves are runs of a few
dozen space-led chunks (no pre-token crosses a chunk's edge), each node holds the characters and
tokens below it. An edit walks down to the chunks it touches, takes one more on either side as
context, encodes only that region anew and puts the sums right on the way up.

Trees are kept as a table (``trees``), one row a document; ``apply_edits`` takes that table and
edits, encodes nothing but the touched regions, and gives the table anew.

The count is that of the byte-level vocabulary; strings of special tokens count as ordinary
text. Only ``trees`` encodes whole texts.

Defined results: a null text is empty; a null edit list is empty, a null edit is none, and null
places and lengths are 0, null insertions empty; edits apply in order to the
text as it then stands; places and lengths are clipped to it; repeated rows and null doc_ids
each get their own row; extra columns are not carried.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sonorel.llm.byte_bpe import Encoder, chunked, default_path, encoder
from sonorel.llm.work import stored
from sonorel.shipping import ship

LEAF = 64
CUT = re.compile(r"(?<=\S)(?= )|(?= \S)")


def split(text: str) -> list[str]:
    return [c for c in CUT.split(text) if c]


class TokenTree:
    """Chunks with their token counts in leaves; sums of characters and tokens in a complete binary tree."""

    def __init__(self, chunks: list[str], counts: list[int], encode: Encoder):
        self.encode = encode
        self.reencoded = 0
        self.leaves = [(chunks[i : i + LEAF], list(counts[i : i + LEAF])) for i in range(0, len(chunks), LEAF)] or [([], [])]
        self._build()

    def _build(self) -> None:
        self.width = 1
        while self.width < len(self.leaves):
            self.width *= 2
        self.chars = [0] * (2 * self.width)
        self.tokens = [0] * (2 * self.width)
        for i, (chunks, counts) in enumerate(self.leaves):
            self.chars[self.width + i] = sum(map(len, chunks))
            self.tokens[self.width + i] = sum(counts)
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _update(self, leaf: int) -> None:
        chunks, counts = self.leaves[leaf]
        i = self.width + leaf
        self.chars[i], self.tokens[i] = sum(map(len, chunks)), sum(counts)
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(c for chunks, _ in self.leaves for c in chunks)

    def _find(self, place: int) -> tuple[int, int, int]:
        """Leaf and chunk that hold the character at ``place`` (the last ones at the end), and where in the chunk."""
        i = 1
        while i < self.width:
            i *= 2
            if place >= self.chars[i] and self.chars[i + 1]:
                place -= self.chars[i]
                i += 1
        leaf = min(i - self.width, len(self.leaves) - 1)
        chunks = self.leaves[leaf][0]
        for k, c in enumerate(chunks):
            if place < len(c) or k == len(chunks) - 1:
                return leaf, k, place
            place -= len(c)
        return leaf, 0, place

    def _step(self, leaf: int, k: int, by: int) -> tuple[int, int]:
        """The neighbouring chunk before (-1) or after (1), or the same at an end."""
        a, b = leaf, k + by
        while not 0 <= b < len(self.leaves[a][0]):
            a += by
            if not 0 <= a < len(self.leaves):
                return leaf, k
            b = len(self.leaves[a][0]) - 1 if by < 0 else 0
        return a, b

    def edit(self, start: int, deleted: int, inserted: str) -> None:
        start = min(max(start, 0), self.chars[1])
        deleted = min(max(deleted, 0), self.chars[1] - start)
        la, ka, within = self._find(start)
        lb, kb, _ = self._find(max(start + deleted, 0))
        (fa, ia), (fb, ib) = self._step(la, ka, -1), self._step(lb, kb, 1)
        region = [c for leaf in range(fa, fb + 1) for k, c in enumerate(self.leaves[leaf][0]) if (leaf, k) >= (fa, ia) and (leaf, k) <= (fb, ib)]
        lead = within + (len(self.leaves[fa][0][ia]) if (fa, ia) != (la, ka) else 0)
        old = "".join(region)
        new = old[:lead] + inserted + old[lead + deleted :]
        self.reencoded += len(new)
        chunks = split(new)
        counts = [len(self.encode.raw(c)) for c in chunks]
        head, tail = self.leaves[fa], self.leaves[fb]
        merged = (head[0][:ia] + chunks + tail[0][ib + 1 :], head[1][:ia] + counts + tail[1][ib + 1 :])
        self.leaves[fa] = merged
        for leaf in range(fa + 1, fb + 1):
            self.leaves[leaf] = ([], [])
            self._update(leaf)
        self._update(fa)
        if len(merged[0]) > 8 * LEAF:  # a large insertion: deal the leaves anew
            flat = [(c, n) for chunks, counts in self.leaves for c, n in zip(chunks, counts)]
            self.leaves = [([c for c, _ in flat[i : i + LEAF]], [n for _, n in flat[i : i + LEAF]]) for i in range(0, len(flat), LEAF)]
            self._build()


TREE = "doc_id long, text string, lengths binary, counts binary, n_tokens long"
EDITS = "array<struct<start:int,deleted:int,inserted:string>>"


def trees(docs: DataFrame, path: str | None = None, edits: Column | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: its text, the characters and tokens of each of its chunks, and their total.

    This is what a tree is kept as (write it where it shall last): inner sums are made from the leaves in one pass.
    ``edits``, a column on ``docs``, is carried along.
    """
    path = path or default_path()
    ship(docs.sparkSession)
    carried = edits is not None

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            texts = batch.column("text").fill_null("")
            lengths, numbers, totals = [], [], []
            for i, j, c in chunked(texts):
                counts = enc.counts(c)
                chars = np.concatenate([[0], np.cumsum((c.buf & 0xC0) != 0x80)])
                sizes = (chars[c.ends] - chars[c.starts]).astype("<u4")
                for a, b in zip(c.first[:-1].tolist(), c.first[1:].tolist()):
                    lengths.append(sizes[a:b].tobytes())
                    numbers.append(counts[a:b].astype("<u4").tobytes())
                    totals.append(int(counts[a:b].sum()))
            names = ["doc_id", "text", "lengths", "counts", "n_tokens"]
            columns = [batch.column("doc_id"), texts, pa.array(lengths, pa.binary()), pa.array(numbers, pa.binary()), pa.array(totals, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("edits")] if carried else columns, names=[*names, "edits"] if carried else names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([edits.cast(EDITS).alias("edits")] if carried else []))
    return rows.mapInArrow(run, f"{TREE}, edits {EDITS}" if carried else TREE)


def apply_edits(kept: DataFrame, edits: Column, path: str | None = None, keep: bool = True) -> DataFrame:
    """The trees of ``kept`` after an array of (start int, deleted int, inserted string) each: only touched regions are encoded.

    Rows of ``trees`` with ``n_tokens_before, n_edits, n_chars, n_chars_reencoded`` added, to be kept in turn; without ``keep``
    the numbers alone.
    """
    path = path or default_path()
    ship(kept.sparkSession)
    numbers = ["n_tokens", "n_tokens_before", "n_edits", "n_chars", "n_chars_reencoded"]

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            out, whole = {k: [] for k in numbers}, {k: [] for k in ("text", "lengths", "counts")}
            for text, lengths, counts, before, some in zip(*(batch.column(c).to_pylist() for c in ("text", "lengths", "counts", "n_tokens", "edits"))):
                ends = np.cumsum(np.frombuffer(lengths, "<u4")).tolist()
                tree = TokenTree([text[a:b] for a, b in zip([0, *ends], ends)], np.frombuffer(counts, "<u4").tolist(), enc)
                some = [e for e in some or [] if e]
                for e in some:
                    tree.edit(e["start"] or 0, e["deleted"] or 0, e["inserted"] or "")
                for k, v in zip(numbers, (tree.total, before, len(some), tree.chars[1], tree.reencoded)):
                    out[k].append(v)
                if keep:
                    flat = [(c, n) for chunks, own in tree.leaves for c, n in zip(chunks, own)]
                    whole["text"].append("".join(c for c, _ in flat))
                    whole["lengths"].append(np.array([len(c) for c, _ in flat], "<u4").tobytes())
                    whole["counts"].append(np.array([n for _, n in flat], "<u4").tobytes())
            more = [pa.array(whole["text"], pa.string()), pa.array(whole["lengths"], pa.binary()), pa.array(whole["counts"], pa.binary())] if keep else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *more, *(pa.array(v, pa.int64()) for v in out.values())], names=["doc_id", *(whole if keep else ()), *out])

    rows = kept.select("doc_id", "text", "lengths", "counts", "n_tokens", edits.cast(EDITS).alias("edits"))
    tree = "text string, lengths binary, counts binary, " if keep else ""
    return rows.mapInArrow(run, f"doc_id long, {tree}" + ", ".join(f"{k} long" for k in numbers))


def edited_counts(docs: DataFrame, edits: Column, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, n_tokens_edited, n_edits, n_chars_edited, n_chars_reencoded`` of every row: trees are kept, then edited.

    ``edits`` is an array of (start int, deleted int, inserted string) on ``docs``.
    """
    kept = stored(trees(docs, path, edits), "trees")
    done = apply_edits(kept, F.col("edits"), path, keep=False)
    return done.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_edits", F.col("n_chars").alias("n_chars_edited"), "n_chars_reencoded")


def standard_edits(text: Column) -> Column:
    """Four edits of a text: a word put in at the middle, a dozen characters cut at a quarter, the first two replaced, a line added."""
    n = F.length(F.coalesce(text, F.lit("")))
    edit = lambda start, deleted, inserted: F.struct(start.cast("int").alias("start"), F.lit(deleted).alias("deleted"), F.lit(inserted).alias("inserted"))
    return F.array(edit(F.floor(n / 2), 0, " inserted words"), edit(F.floor(n / 4), 12, ""), edit(F.lit(0), 2, "  It's"), edit(n + 20, 0, "\nThe end. "))


def count_edits(docs: DataFrame) -> DataFrame:
    return edited_counts(docs, standard_edits(F.col("text")))
