"""Embedding near-dedup by dual traversal of cover trees: all pairs at a cosine threshold, exactly.

Equal vectors become one class first. Classes are dealt into cells by their nearest pivot
(pivots are a far-apart net of a bounded sample) and cells into blocks of about ``block``
classes by hash, every class into one block. Each block gets a cover tree: nested nets whose
radii halve from level to level, every point below the nearest point of the net above, with
measured covering radii. A pair of cells, then of blocks, then of nodes, is dropped when its
centres lie farther apart than both radii and the threshold allow; what is left at the bottom is
confirmed in double precision.

A task holds two blocks, whatever the size of the table, and reports, per class, how many vectors
it links to and the smallest class it hangs together with, never the pairs. Only cells, at most
``max_cells`` for each vector length, are paired on the driver; blocks, their pairs, classes and
links stay on the executors.

High-dimensional data without clusters lets no bound prune above the lowest levels: then each
pair of blocks costs one matrix product.

Defined results: a vector that is null, empty or zero, or holds a null or non-finite component
has n_links 0 and its own component; a null vec_id takes no part (n_links 0, component_id
null, kept true); vectors of another length than the most usual of their block link only among
their like; rows repeated as a whole count as vectors of their own, with their shared id.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sonorel.llm.components import components
from sonorel.llm.vectors import cosines, read_vectors, unit, width_of
from sonorel.llm.work import stored

CHUNK = 512  # classes per row while blocks travel


def net(points: np.ndarray, radius: float, chosen: list[int]) -> tuple[list[int], np.ndarray]:
    """Extend the net ``chosen`` until every point is within ``radius`` of it; also each point's nearest net point."""
    best = np.full(len(points), -2.0)
    owner = np.zeros(len(points), np.int64)
    out = list(chosen)
    limit = 1 - radius * radius / 2
    for start in range(0, len(out), 256):
        part = out[start : start + 256]
        sims = points @ points[part].T
        at = sims.argmax(axis=1)
        top = sims[np.arange(len(points)), at]
        better = top > best
        best[better], owner[better] = top[better], np.asarray(part)[at[better]]
    while True:
        open_ = np.flatnonzero(best < limit)
        if not open_.size:
            return out, owner
        # take a handful of open points that are pairwise apart, in order
        take: list[int] = []
        head = open_[:256]
        sims = points[head] @ points[head].T
        blocked = np.zeros(len(head), bool)
        for k in range(len(head)):
            if not blocked[k]:
                take.append(int(head[k]))
                blocked |= sims[k] >= limit
        out += take
        sims = points @ points[take].T
        at = sims.argmax(axis=1)
        top = sims[np.arange(len(points)), at]
        better = top > best
        best[better], owner[better] = top[better], np.asarray(take)[at[better]]
        best[take], owner[take] = 1.0, take


class CoverTree:
    """Levels of nested nets over unit vectors; ``levels[l]`` is (centres, covering radius, parent's index)."""

    def __init__(self, points: np.ndarray, lowest: float = 0.25):
        self.points = points
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.member = np.zeros(len(points), np.int64)
        chosen, radius = [0], 2.0
        owners = []
        nets = [[0]]
        owners.append(np.zeros(len(points), np.int64))
        while radius > lowest and len(nets[-1]) < len(points):
            radius /= 2
            chosen, owner = net(points, radius, nets[-1])
            nets.append(chosen)
            owners.append(owner)
        # a point's chain upward: its centre on a level is the parent of its centre on the level below
        up = [None] * len(nets)
        up[-1] = owners[-1]
        for level in range(len(nets) - 2, -1, -1):
            up[level] = owners[level][up[level + 1]]
        place_above = None
        for level, centres in enumerate(nets):
            centres = np.asarray(centres)
            place = np.full(len(points), -1, np.int64)
            place[centres] = np.arange(len(centres))
            node = place[up[level]]
            d = np.sqrt(np.maximum(0, 2 - 2 * (points * points[up[level]]).sum(axis=1)))
            radius_ = np.zeros(len(centres))
            np.maximum.at(radius_, node, d)
            parent = np.zeros(len(centres), np.int64) if level == 0 else place_above[up[level - 1][centres]]
            self.levels.append((centres, radius_, parent))
            place_above = place
            self.member = node

    def to_bytes(self) -> bytes:
        """The tree without its points."""
        return pickle.dumps(([(c.astype(np.int32), r, p.astype(np.int32)) for c, r, p in self.levels], self.member.astype(np.int32)), protocol=5)

    @classmethod
    def over(cls, points: np.ndarray, raw: bytes) -> CoverTree:
        """A tree that was built before over the same points."""
        tree = cls.__new__(cls)
        tree.points = points
        tree.levels, tree.member = pickle.loads(raw)
        return tree

    def leaves(self) -> list[np.ndarray]:
        """The points below each node of the lowest level."""
        order = np.argsort(self.member, kind="stable")
        return np.split(order, np.cumsum(np.bincount(self.member, minlength=len(self.levels[-1][0])))[:-1])


def _below(parent: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Children grouped by parent: their order, where each parent's begin, how many there are."""
    count = np.bincount(parent, minlength=n)
    return np.argsort(parent, kind="stable"), np.cumsum(count) - count, count


def dual_traversal(a: CoverTree, b: CoverTree, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of lowest-level nodes of both trees that no bound rules out for points within ``reach``."""
    i = j = np.zeros(1, np.int64)
    for step in range(max(len(a.levels), len(b.levels))):
        na, nb = min(step, len(a.levels) - 1), min(step, len(b.levels) - 1)
        (ca, ra, up_a), (cb, rb, up_b) = a.levels[na], b.levels[nb]
        if not step or na < step:
            up_a = np.arange(len(ca))
        if not step or nb < step:
            up_b = np.arange(len(cb))
        above = (int(up_a.max()) + 1, int(up_b.max()) + 1) if step else (1, 1)
        order_a, first_a, count_a = _below(up_a, above[0])
        order_b, first_b, count_b = _below(up_b, above[1])
        ways = count_a[i] * count_b[j]
        if ways.sum() * 16 > len(ca) * len(cb):
            # most pairs are alive: one product of all centres, then only those near enough
            sims = a.points[ca].astype(np.float32) @ b.points[cb].astype(np.float32).T
            least = 1 - (ra + (rb.max() + reach + 2e-3)) ** 2 / 2  # beyond any rounding of single precision
            x, y = np.nonzero(sims >= least.astype(np.float32)[:, None])
            near = np.sqrt(np.maximum(0, 2 - 2 * sims[x, y])) <= ra[x] + rb[y] + reach + 2e-3
            x, y = x[near], y[near]
            if ways.sum() < len(ca) * len(cb):
                alive = np.zeros(above, bool)
                alive[i, j] = True
                keep = alive[up_a[x], up_b[y]]
                x, y = x[keep], y[keep]
        else:
            place = np.arange(int(ways.sum())) - np.repeat(np.cumsum(ways) - ways, ways)
            wide = np.repeat(count_b[j], ways)
            x = order_a[np.repeat(first_a[i], ways) + place // np.maximum(wide, 1)]
            y = order_b[np.repeat(first_b[j], ways) + place % np.maximum(wide, 1)]
            near = np.zeros(len(x), bool)
            for s in range(0, len(x), 1 << 16):
                p, q = x[s : s + (1 << 16)], y[s : s + (1 << 16)]
                d = np.sqrt(np.maximum(0, 2 - 2 * (a.points[ca[p]] * b.points[cb[q]]).sum(axis=1)))
                near[s : s + (1 << 16)] = d <= ra[p] + rb[q] + reach + 1e-6
            x, y = x[near], y[near]
        i, j = x, y
    return i, j


def links_between(xa: np.ndarray, xb: np.ndarray | None, threshold: float, a: CoverTree | None = None, b: CoverTree | None = None):
    """Yield (i, j) index arrays of pairs with cosine >= threshold between rows of ``xa`` and ``xb``, or within ``xa``."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    a = a or CoverTree(unit(xa))
    b = a if xb is None else b or CoverTree(unit(xb))
    below_a, below_b = a.leaves(), (a if xb is None else b).leaves()
    other = xa if xb is None else xb
    ii, jj, held = [], [], 0
    nodes_a, nodes_b = dual_traversal(a, b, reach)

    def confirm():
        i, j = np.concatenate(ii), np.concatenate(jj)
        if xb is None:
            keep = i < j
            i, j = i[keep], j[keep]
        near = np.fromiter((), bool) if not len(i) else cosines(xa[i], other[j]) >= threshold
        return i[near.astype(bool)], j[near.astype(bool)]

    for p, q in zip(nodes_a, nodes_b):
        left, right = below_a[p], below_b[q]
        for s in range(0, len(left), max(1, (1 << 17) // max(len(right), 1))):
            part = left[s : s + max(1, (1 << 17) // max(len(right), 1))]
            ii.append(np.repeat(part, len(right)))
            jj.append(np.tile(right, len(part)))
            held += len(part) * len(right)
            if held >= 1 << 17:
                yield confirm()
                ii, jj, held = [], [], 0
    if held:
        yield confirm()


class Forest:
    """Union-find over numbers, by smallest label, for links that come in arrays."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def linked_vectors(df: DataFrame, threshold: float = 0.95, block: int = 4096, max_cells: int = 256, sample: int = 4096) -> DataFrame:
    """One row per row of ``df(vec_id, embedding)``: ``vec_id, n_links, component_id, kept``."""
    spark = df.sparkSession
    width = width_of(df)
    rows = stored(read_vectors(df, width), "vectors")
    known = rows.where("vec is not null and vec_id is not null")
    classes = known.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    classes = stored(classes, "classes")
    n_blocks = max(1, math.ceil(classes.count() / block))
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))

    picks = classes.select("digest", "vec").orderBy("digest").limit(min(sample, 64 * n_blocks)).collect()  # bounded by ``sample``
    lengths = Counter(len(r.vec) for r in picks)
    usual = max(lengths, key=lambda n: (lengths[n], n), default=0)  # vectors of other lengths have one cell each length
    pivots = _pivots([np.frombuffer(r.vec, width) for r in picks if len(r.vec) == usual], max(1, min(max_cells, n_blocks // 4)))

    def deal(batches):
        for batch in batches:
            vec = batch.column("vec").to_pylist()
            cell = np.zeros(len(vec), np.int64)
            if pivots is not None:
                same = [i for i, v in enumerate(vec) if len(v) == pivots.shape[1] * np.dtype(width).itemsize]
                if same:
                    x = unit(np.frombuffer(b"".join(vec[i] for i in same), width).reshape(len(same), -1))
                    cell[same] = (x @ pivots.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"), batch.column("vec"), pa.array(cell)], names=["rep", "copies", "vec", "cell"])

    dealt = stored(classes.select("rep", "copies", "vec").mapInArrow(deal, "rep long, copies long, vec binary, cell long"), "dealt")
    per_cell = {(r.cell, r.width): r.n for r in dealt.groupBy("cell", F.length("vec").alias("width")).agg(F.count("*").alias("n")).collect()}  # cells times vector lengths
    number, first = 0, []
    for (cell, w), n in sorted(per_cell.items()):
        parts = math.ceil(n / block)
        first.append((cell, w, number, parts))
        number += parts
    if not first:
        first = [(0, 0, 0, 1)]
    places = F.broadcast(spark.createDataFrame(first, "cell long, width int, base long, parts long"))
    dealt = dealt.withColumn("width", F.length("vec")).join(places, ["cell", "width"])
    dealt = dealt.select((F.col("base") + F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("block"), "cell", "rep", "copies", "vec", "width")

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable")
        x = unit(np.frombuffer(b"".join(pdf["vec"]), width).reshape(len(pdf), -1))
        centre = x.mean(axis=0)
        centre = centre / max(float(np.linalg.norm(centre)), 1e-12) if np.linalg.norm(centre) > 1e-9 else x[0]
        radius = float(np.sqrt(np.maximum(0, 2 - 2 * (x @ centre))).max())
        cell, w = int(pdf["cell"].iloc[0]), int(pdf["width"].iloc[0])
        around = float(np.sqrt(np.maximum(0, 2 - 2 * (x @ pivots[cell]))).max()) if w == usual else 2.0
        tree = CoverTree(x).to_bytes()  # built once, used in every pair of blocks
        out = []
        for s in range(0, len(pdf), CHUNK):
            part = pdf.iloc[s : s + CHUNK]
            out.append((int(key[0]), s // CHUNK, cell, w, part["rep"].to_numpy("<i8").tobytes(), part["copies"].to_numpy("<i8").tobytes(), b"".join(part["vec"]), b"" if s else centre.tobytes(), radius, around, b"" if s else tree))
        return pd.DataFrame(out, columns=["block", "chunk", "cell", "width", "reps", "copies", "vecs", "centre", "radius", "around", "tree"])

    blocks = stored(dealt.groupBy("block").applyInPandas(pack, "block long, chunk int, cell long, width int, reps binary, copies binary, vecs binary, centre binary, radius double, around double, tree binary"), "blocks")
    pairs = stored(_block_pairs(blocks.where("chunk = 0"), pivots, usual, reach), "pairs", rows=4096)
    pair_rows = pairs.select(F.explode(F.array_distinct(F.array("i", "j"))).alias("block"), "i", "j")
    travelling = pair_rows.join(blocks.select("block", "chunk", "reps", "copies", "vecs", "width", "tree"), "block")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(key[0]), int(key[1])
        sides = []
        for b in dict.fromkeys((i, j)):
            part = pdf[pdf["block"] == b].sort_values("chunk")
            w = int(part["width"].iloc[0])
            x = np.frombuffer(b"".join(part["vecs"]), width).reshape(-1, w // np.dtype(width).itemsize)
            sides.append((np.frombuffer(b"".join(part["reps"]), "<i8"), np.frombuffer(b"".join(part["copies"]), "<i8"), x, CoverTree.over(unit(x), part["tree"].iloc[0])))
        reps = np.concatenate([s[0] for s in sides])
        copies = np.concatenate([s[1] for s in sides])
        order = np.argsort(reps, kind="stable")
        rank = np.empty(len(reps), np.int64)
        rank[order] = np.arange(len(reps))
        shift = len(sides[0][0]) if i != j else 0
        degree, forest = np.zeros(len(reps), np.int64), Forest(len(reps))
        for a, b in links_between(sides[0][2], sides[-1][2] if i != j else None, threshold, sides[0][3], sides[-1][3]):
            b = b + shift
            np.add.at(degree, a, copies[b])
            np.add.at(degree, b, copies[a])
            forest.join(rank[a], rank[b])
        hit = np.flatnonzero(degree)
        return pd.DataFrame({"rep": reps[hit], "links": degree[hit], "low": reps[order][forest.label[rank[hit]]]})

    found = stored(travelling.groupBy("i", "j").applyInPandas(compare, "rep long, links long, low long"), "links")
    label = components(found.select(F.col("rep").alias("u"), F.col("low").alias("v"))).withColumnRenamed("node", "rep")
    degree = found.groupBy("rep").agg(F.sum("links").alias("links"))
    summary = classes.select("digest", "rep", "copies").join(degree, "rep", "left").join(label, "rep", "left")
    summary = stored(summary.select("digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")), "summary")
    part = rows.where("vec is not null and vec_id is not null").select("vec_id", "digest").join(summary, "digest").select("vec_id", "n_links", F.col("component").alias("component_id"))
    rest = rows.where("vec is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return part.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _pivots(vectors: list[np.ndarray], most: int) -> np.ndarray | None:
    """At most ``most`` points of a far-apart net over a sample."""
    if not vectors:
        return None
    x = unit(np.stack(vectors))
    chosen, best = [0], x @ x[0]
    while len(chosen) < min(most, len(x)):
        k = int(best.argmin())
        if best[k] > 0.999:
            break
        chosen.append(k)
        best = np.maximum(best, x @ x[k])
    return x[chosen]


def _block_pairs(heads: DataFrame, pivots: np.ndarray | None, usual: int, reach: float) -> DataFrame:
    """``(i, j)`` with i <= j: the pairs of blocks that no bound rules out.

    ``heads(block, cell, width, centre, radius, around)``, ``around`` being the radius of a block
    about its cell's pivot. Cells are paired first, here; their blocks meet by the pair of cells.
    """
    cells = heads.groupBy("cell", "width").agg(F.max("around").alias("around")).collect()  # at most ``max_cells`` a vector length
    near = [(c.cell, c.cell, c.width) for c in cells]
    same = sorted((c for c in cells if c.width == usual), key=lambda c: c.cell)
    if len(same) > 1:
        p, r = pivots[[c.cell for c in same]], np.array([c.around for c in same])
        d = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)))
        a, b = np.nonzero(np.triu(d <= r[:, None] + r[None, :] + reach + 1e-6, 1))
        near += [(same[x].cell, same[y].cell, usual) for x, y in zip(a, b)]

    def bounded(batches):
        for batch in batches:
            w = batch.column("width").to_numpy()
            ok = np.zeros(batch.num_rows, bool)
            for one in np.unique(w):  # centres of one length at a time
                at = np.flatnonzero(w == one)
                a, b = (np.frombuffer(b"".join(batch.column(c).take(pa.array(at)).to_pylist()), np.float64).reshape(len(at), -1) for c in ("centre_i", "centre_j"))
                far = batch.column("radius_i").to_numpy()[at] + batch.column("radius_j").to_numpy()[at] + reach + 1e-6
                ok[at] = np.sqrt(np.maximum(0, 2 - 2 * (a * b).sum(axis=1))) <= far
            yield batch.select(["i", "j"]).filter(pa.array(ok))

    def side(x):
        return heads.select(F.col("block").alias(x), F.col("cell").alias(f"cell_{x}"), "width", F.col("centre").alias(f"centre_{x}"), F.col("radius").alias(f"radius_{x}"))

    met = heads.sparkSession.createDataFrame(near, "cell_i long, cell_j long, width int")
    both = side("i").join(met, ["cell_i", "width"]).join(side("j"), ["cell_j", "width"]).where("i <= j")
    return both.select("i", "j", "width", "centre_i", "centre_j", "radius_i", "radius_j").mapInArrow(bounded, "i long, j long")
