"""MinHash near-dedup with HyperMinHash registers.

Each shingle hash falls into one of 128 buckets; a bucket keeps the smallest of its values as
six bits of leading-zero count and ten mantissa bits. Empty buckets borrow from others
(densification) for banding only: 25 bands of 5 registers. Candidate pairs are those that share
a band; the collision-corrected estimate of the Jaccard index, five standard errors wide,
drops the hopeless ones, and full sets confirm the rest.

No group is ever expanded into its pairs:

1. rows with equal sets become one class (its smallest doc_id stands for it);
2. each class is compared with the smallest class of each of its band buckets (a star);
3. in buckets of three and more whose members still lie in different components, the pairs
   between different components are compared too, block against block, until they are joined.

Step 3 makes the components those of all candidate links: a pair is skipped only if both ends
are already connected.

Defined results: a null doc_id takes no part in linking (component_id null, kept true); a null,
empty or blank text has n_shingles 0 and its own component; rows repeated as a whole have the same result;
when one doc_id stands on rows with different texts, each row follows its own text, and
classes whose smallest id is the same count as one. An empty table gives no rows. Extra columns
pass through ``deduplicated`` untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sonorel.llm.components import components
from sonorel.llm.shingles import fingerprint, linked, mix, shingle_set, truly_linked
from sonorel.llm.work import discard, stored

BUCKETS, MANTISSA, BANDS, ROWS_PER_BAND = 128, 10, 25, 5
EMPTY = 0xFFFF
_probe = np.random.Generator(np.random.PCG64(11)).integers(0, BUCKETS, (256, BUCKETS))
_band_seed = np.random.Generator(np.random.PCG64(12)).integers(1, 2**63, (BANDS, ROWS_PER_BAND), dtype=np.uint64) | np.uint64(1)


def registers(s: np.ndarray) -> np.ndarray:
    """128 registers of a set of hashes: leading zeros << 10 | mantissa, EMPTY where no hash fell."""
    low = np.full(BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    bucket = (s & np.uint64(BUCKETS - 1)).astype(np.int64)
    np.minimum.at(low, bucket, mix(s) >> np.uint64(7))
    filled = np.zeros(BUCKETS, bool)
    filled[bucket] = True
    # 57-bit values: position of the leading one, then the ten bits after it
    top = np.frexp(np.maximum(low, np.uint64(1)).astype(np.float64))[1].astype(np.int64)
    top = np.minimum(top, 57)
    zeros = 57 - top
    shift = np.maximum(top - 1 - MANTISSA, 0).astype(np.uint64)
    mantissa = (low >> shift) & np.uint64((1 << MANTISSA) - 1)
    return np.where(filled, (zeros.astype(np.uint64) << np.uint64(MANTISSA)) | mantissa, EMPTY).astype("<u2")


def densify(reg: np.ndarray) -> np.ndarray:
    """Empty registers take the value of a filled one, found by the same random probes in every set."""
    out, filled = reg.copy(), reg != EMPTY
    if not filled.any():
        return out
    empty = np.flatnonzero(~filled)
    for probe in _probe:
        if not empty.size:
            return out
        at = probe[empty]
        hit = filled[at]
        out[empty[hit]] = reg[at[hit]]
        empty = empty[~hit]
    out[empty] = reg[filled].min()
    return out


def band_keys(reg: np.ndarray) -> np.ndarray:
    parts = densify(reg)[: BANDS * ROWS_PER_BAND].astype(np.uint64).reshape(BANDS, ROWS_PER_BAND)
    h = (mix(parts + _band_seed) * _band_seed).sum(axis=1, dtype=np.uint64)
    return mix(h + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers of disjoint sets of these sizes that agree by chance (Yu and Weber 2017, for r = 10)."""
    ratio = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    phi = 4 * ratio / (1 + ratio) ** 2
    return 0.169919487159739093975315012348630288992889 * BUCKETS / 2.0**MANTISSA * phi


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of rows of registers, and the buckets they rest on."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=-1)
    same = ((a == b) & (a != EMPTY)).sum(axis=-1)
    return np.clip((same - collisions(n, m)) / np.maximum(used - collisions(n, m), 1e-9), 0, 1), used


def hopeful(a, b, n, m, percent: int) -> np.ndarray:
    """Pairs whose sizes allow the threshold and whose estimate lies within five standard errors of it."""
    t = percent / 100
    est, used = estimate(a, b, n, m)
    near = est >= t - 5 * np.sqrt(t * (1 - t) / np.maximum(used, 1)) - 1e-9
    return near & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def signatures(docs: DataFrame, k: int = 5) -> DataFrame:
    """``(doc_id, digest, n, fp, regs, bands)`` of every row; fp, regs and bands are null for empty sets, digest is the text's."""

    def run(batches):
        for batch in batches:
            n, fp, regs, bands = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, k)
                n.append(len(s))
                fp.append(fingerprint(s))
                reg = registers(s) if len(s) else None
                regs.append(None if reg is None else reg.tobytes())
                bands.append(None if reg is None else band_keys(reg))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "digest", "n", "fp", "regs", "bands"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, digest binary, n long, fp binary, regs binary, bands array<long>")


def text_digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def _matrix(column) -> np.ndarray:
    raw = b"".join(column)
    return np.frombuffer(raw, "<u2").reshape(-1, BUCKETS)


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The hopeful ones of ``pairs(a, b)``, with the fingerprints of both."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
            ok = hopeful(*(_matrix(batch.column(c).to_pylist()) for c in ("regs_a", "regs_b")), n, m, percent)
            yield batch.select(["a", "b", "fp_a", "fp_b"]).filter(pa.array(ok))

    def side(x):
        return classes.select(F.col("rep").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "fp", "regs")))

    sized = pairs.join(side("a"), "a").join(side("b"), "b")
    sized = sized.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return sized.mapInArrow(run, "a long, b long, fp_a binary, fp_b binary")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id", "left_semi")


def _confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b, fp_a, fp_b)`` whose full sets pass. Texts travel only for documents that stand in a pair."""

    def run(batches):
        last: dict[str, tuple] = {}
        for batch in batches:
            u, v = [], []
            for a, b, fp_a, fp_b, text_a, text_b in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "fp_a", "fp_b", "text_a", "text_b"))):
                sets = []
                for doc, text, fp in ((a, text_a, fp_a), (b, text_b, fp_b)):
                    if (doc, fp) not in last:
                        if len(last) > 64:
                            last.clear()
                        s = shingle_set(text, k)
                        if fingerprint(s) != fp:  # another row of the same id
                            break
                        last[doc, fp] = s
                    sets.append(last[doc, fp])
                if len(sets) == 2 and linked(*sets, percent) and truly_linked(text_a, text_b, k, percent):
                    u.append(a)
                    v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    texts = stored(_texts(docs, ids), "texts")
    with_a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    links = stored(with_b.mapInArrow(run, "u long, v long"), "links")
    discard(ids, texts)
    return links


def _open_links(members: DataFrame, k: int, percent: int, block: int = 1024) -> DataFrame:
    """Confirmed links between different components within buckets that are still open.

    ``members(band, size, rep, label, n, fp, regs, bands, text)``. A bucket is dealt into blocks
    of about ``block`` members; each pair of blocks is a group of its own, which keeps its own
    union of components: once two members hang together, no pair between their components is
    looked at again. A pair that meets in several buckets is looked at in the first. What comes
    out is at most one link per union.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        band, i, j = key
        pdf = pdf.sort_values(["part", "rep"], kind="stable").reset_index(drop=True)
        if i == j:
            lefts = rights = np.arange(len(pdf))
        else:
            lefts, rights = np.flatnonzero(pdf["part"] == i), np.flatnonzero(pdf["part"] == j)
        regs = _matrix(pdf["regs"])
        bands = np.stack([np.asarray(b, np.int64) for b in pdf["bands"]])
        here = int(np.flatnonzero(bands[0] == band)[0])
        n, reps, texts, fps = pdf["n"].to_numpy(), pdf["rep"].to_numpy(), pdf["text"], pdf["fp"]
        _, root = np.unique(pdf["label"].to_numpy(), return_inverse=True)
        sets: dict[int, np.ndarray] = {}

        def full(x: int) -> np.ndarray:
            if x not in sets:
                s = shingle_set(texts[x], k)
                sets[x] = s if fingerprint(s) == fps[x] else np.empty(0, np.uint64)  # another row of the same id
            return sets[x]

        out = []
        for x in lefts:
            ys = rights[(rights > x) & (root[rights] != root[x])] if i == j else rights[root[rights] != root[x]]
            if not ys.size:
                continue
            ys = ys[(bands[ys] == bands[x]).argmax(axis=1) == here]
            ys = ys[hopeful(regs[x][None, :], regs[ys], np.full(ys.size, n[x]), n[ys], percent)]
            est, _ = estimate(regs[x][None, :], regs[ys], np.full(ys.size, n[x]), n[ys])
            for y in ys[np.argsort(-est, kind="stable")]:
                if root[y] != root[x] and full(x).size and full(y).size and linked(full(x), full(y), percent) and truly_linked(texts[x], texts[y], k, percent):
                    out.append((reps[x], reps[y]))
                    root[root == root[y]] = root[x]
        return pd.DataFrame(out, columns=["u", "v"])

    parts = F.ceil(F.col("size") / block).cast("int")
    dealt = members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("i"), F.greatest(o, F.col("part")).alias("j")))
    dealt = dealt.withColumn("cell", F.explode(cells)).select("band", "cell.i", "cell.j", "part", "rep", "label", "n", "fp", "regs", "bands", "text")
    return dealt.groupBy("band", "i", "j").applyInPandas(run, "u long, v long").distinct()


def labelled(docs: DataFrame, k: int = 5, percent: int = 85) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id, digest, n, component``; component is null for rows that take no part."""
    sig = stored(signatures(docs, k), "signatures")
    known = sig.where("fp is not null and doc_id is not null")
    classes = stored(known.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.first("bands").alias("bands")), "classes")

    banded = classes.select("rep", F.explode("bands").alias("band"))
    sizes = stored(banded.groupBy("band").agg(F.min("rep").alias("lead"), F.count("*").alias("size")).where("size > 1"), "buckets")
    stars = banded.join(sizes, "band").where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct()
    candidates = stored(_estimated(stars, classes, percent), "stars", rows=4096)
    links = _confirmed(candidates, docs, k, percent)
    label = components(links)
    discard(candidates, links)

    in_large = banded.join(sizes.where("size > 2").select("band", "size"), "band")
    named = stored(in_large.join(label.select(F.col("node").alias("rep"), F.col("component")), "rep", "left").select("band", "size", "rep", F.coalesce("component", "rep").alias("label")), "named")
    open_bands = named.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band")
    members = stored(named.join(open_bands, "band"), "members")
    if members.limit(1).count():
        ids = stored(members.select(F.col("rep").alias("doc_id")).distinct(), "ids")  # as a table its size is known: the texts need not move to meet a small one
        texts = stored(_texts(docs, ids), "texts")
        about = stored(classes.join(ids.withColumnRenamed("doc_id", "rep"), "rep", "left_semi").join(texts.withColumnRenamed("doc_id", "rep"), "rep").select("rep", "n", "fp", "regs", "bands", "text"), "about")
        more = stored(_open_links(members.join(about, "rep"), k, percent), "links")
        discard(ids, texts, about)
        if more.limit(1).count():
            label = components(label.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
        discard(more)
    discard(members, named, sizes)

    by_fp = classes.select("fp", F.col("rep")).join(label.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    rows = sig.select("doc_id", "digest", "n", "fp")  # empty sets have no key: they must not meet in one task
    out = rows.where("fp is not null").join(by_fp, "fp", "left").drop("fp")
    return out.unionByName(rows.where("fp is null").select("doc_id", "digest", "n", F.lit(None).cast("long").alias("component")))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 85) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id, n_shingles, component_id, kept``."""
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return labelled(docs, k, percent).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 85) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest doc_id. All columns stay.

    Each row follows its own text. Of rows that repeat a doc_id and its text one stays; rows that
    share the smallest doc_id but not the text all stay, as do rows without a doc_id.
    """
    found = labelled(docs.select("doc_id", "text"), k, percent).where("doc_id is not null")
    gone = found.where("component <> doc_id").select("doc_id", "digest").distinct()
    twice = stored(found.where("component is null or component = doc_id").groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "digest"), "twice")
    # the row travels as one struct, so that no column of it can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"))
    left = rows.join(gone, ["doc_id", "digest"], "left_anti")
    if twice.limit(1).count():
        marked = left.join(twice.withColumn("twice", F.lit(True)), ["doc_id", "digest"], "left")
        left = marked.where("twice is null").select("row").unionByName(marked.where("twice").dropDuplicates(["doc_id", "digest"]).select("row"))
    return left.select("row.*")
