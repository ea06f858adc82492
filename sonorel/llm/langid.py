"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 4-grams of the lower-cased whole text are hashed to 2**15 features with damped
counts; document frequencies come from every row that may be learned from. The classifier is
fitted by FTRL-proximal with L1 and L2 penalties on a sample of at most about ``sample_rows``
rows (drawn by hash, evenly over languages; the bound is a parameter because the fit runs on
the driver), and its scores are calibrated by a temperature fitted on a held-back fifth of that
sample. All languages are learned: beyond ``max_languages`` they are cut into groups of at most
that many, one model tells the groups and one per group its languages, and a language's
probability is the product. Then each language gives ``LEAST_ROWS`` rows or all it has, about,
and never none, even if the sample grows beyond ``sample_rows``.

Rows whose crc32(doc_id as text) mod 3 is 1 are held out. A prediction uses the text alone.

Defined results: a null text or one without a letter is ``und`` with score 0; a null doc_id
counts as empty text in the remainder; rows without lang are only predicted; with nothing to
learn from, everything is ``und`` with score 0; repeated rows get the same result each; extra columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from sonorel.llm.work import discard, held
from sonorel.shipping import ship

FEATURES = 1 << 15
ORDERS = 4
LEAST_ROWS = 8
_LETTER = regex.compile(r"\p{L}")
_MULTIPLY = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a text and their damped counts."""
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    counts = np.zeros(FEATURES, np.int64)
    h = np.zeros(len(c), np.uint32)
    for n in range(ORDERS):
        if len(c) <= n:
            break
        h = (h[: len(c) - n] ^ c[n:]) * np.uint32(_MULTIPLY[n])
        h ^= h >> np.uint32(15)
        counts += np.bincount(h & np.uint32(FEATURES - 1), minlength=FEATURES)
    idx = np.flatnonzero(counts)
    return idx, (1 + np.log(counts[idx])).astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0
    #: Of more than one group: the first language of each and the end, the groups' weights, and a temperature for each group.
    bounds: list[int] | None = None
    coarse: np.ndarray | None = None
    fine: list[float] | None = None

    def vector(self, idx: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x = tf * self.idf[idx]
        return x / max(float(np.linalg.norm(x)), 1e-12)

    def shares(self, idx: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The probability of each language."""
        logits = x @ self.weights[idx]
        if self.bounds is None:
            return softmax(logits / self.temperature)
        groups = softmax((x @ self.coarse[idx]) / self.temperature)
        return np.concatenate([p * softmax(logits[a:b] / t) for p, a, b, t in zip(groups, self.bounds, self.bounds[1:], self.fine)])

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not _LETTER.search(text):
            return "und", 0.0
        idx, tf = features(text)
        p = self.shares(idx, self.vector(idx, tf))
        best = int(p.argmax())
        return self.languages[best], float(p[best])


class FTRL:
    """Follow the regularised leader, proximal form, with elastic-net penalties; a row at a time."""

    def __init__(self, n_features: int, n_classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((n_features, n_classes))
        self.n = np.zeros((n_features, n_classes))

    def weights(self, idx=slice(None)) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def step(self, idx: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(idx)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p[None, :]
        n = self.n[idx]
        self.z[idx] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[idx] = n + g * g


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden section over its logarithm.

    Targets are smoothed by 1 / (rows + 2), so that separable rows do not drive it to zero.
    """
    soft = np.full(logits.shape, 1 / (len(y) + 2) / max(logits.shape[1] - 1, 1))
    soft[np.arange(len(y)), y] = 1 - 1 / (len(y) + 2)

    def loss(t: float) -> float:
        return -float((soft * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-12))).sum(axis=1).mean())

    lo, hi, g = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def fitted(rows: list[tuple], classes: int, epochs: int) -> tuple[np.ndarray, float]:
    """Weights and temperature of one model from rows ``(class, held back, idx, x)``."""
    fit = [r for r in rows if not r[1]]
    ftrl = FTRL(FEATURES, classes)
    order = np.random.Generator(np.random.PCG64(5))
    for _ in range(epochs):
        for k in order.permutation(len(fit)):
            y, _, i, x = fit[k]
            ftrl.step(i, x, y)
    weights = ftrl.weights()
    held = [r for r in rows if r[1]]
    if not held or classes < 2:
        return weights, 1.0
    return weights, best_temperature(np.stack([x @ weights[i] for _, _, i, x in held]), np.array([y for y, *_ in held]))


def train(docs: DataFrame, sample_rows: int = 4000, max_languages: int = 64, epochs: int = 3) -> Model:
    """Learn from the rows of ``docs(doc_id, text, lang)`` that are not held out and have a text and a lang."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id")) != 1))
    learn = learn.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("draw"))
    per_lang = {r.lang: (r.n, r.first) for r in learn.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("first")).collect()}
    if not per_lang:
        return Model([], np.ones(FEATURES), np.zeros((FEATURES, 0)))
    many = len(per_lang) > max_languages
    rate = {lang: max(sample_rows / len(per_lang), LEAST_ROWS if many else 0) / n for lang, (n, _) in per_lang.items()}
    rates = F.create_map(*[F.lit(v) for pair in rate.items() for v in pair])
    drawn = F.pmod("draw", F.lit(1 << 20)) < F.coalesce(F.try_element_at(rates, F.col("lang")), F.lit(0.0)) * (1 << 20)
    if many:  # a few rows by chance may be none
        firsts = F.create_map(*[F.lit(v) for lang, (_, first) in per_lang.items() for v in (lang, first)])
        drawn = drawn | F.coalesce(F.col("draw") == F.try_element_at(firsts, F.col("lang")), F.lit(False))

    def run(batches):
        df, rows = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            lang, draw, idx, tf = [], [], [], []
            for text, name, d, take in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "draw", "drawn"))):
                i, x = features(text)
                df[i] += 1
                rows += 1
                if take:
                    lang.append(name)
                    draw.append(d)
                    idx.append(i.astype("<u2").tobytes())
                    tf.append(x.tobytes())
            none = pa.nulls(len(lang), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(lang, pa.string()), pa.array(draw, pa.int64()), pa.array(idx, pa.binary()), pa.array(tf, pa.binary())], names=["feature", "df", "lang", "draw", "idx", "tf"])
        seen = np.append(np.flatnonzero(df), FEATURES)  # the last stands for the number of rows
        n = len(seen)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(np.append(df[seen[:-1]], rows)), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=["feature", "df", "lang", "draw", "idx", "tf"])

    ship(docs.sparkSession)
    found = held(learn.withColumn("drawn", drawn).mapInArrow(run, "feature long, df long, lang string, draw long, idx binary, tf binary"))
    counts = found.where("feature is not null").groupBy("feature").agg(F.sum("df").alias("df")).toPandas()  # at most 2**15 + 1 rows
    df = np.zeros(FEATURES + 1)
    df[counts["feature"].to_numpy()] = counts["df"].to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    sample = found.where("lang is not null").select("lang", "draw", "idx", "tf").toPandas()  # about sample_rows rows
    discard(found)
    sample = sample.sort_values(["draw", "lang"], kind="stable")
    languages = sorted(per_lang)
    number = {lang: i for i, lang in enumerate(languages)}
    model = Model(languages, idf, np.zeros((FEATURES, len(languages))))
    # two long arrays for all rows, which go back to the system when the fit is done
    ends = np.cumsum(sample["idx"].map(len).to_numpy(np.int64) // 2) if len(sample) else np.zeros(0, np.int64)
    all_idx, all_x = np.frombuffer(b"".join(sample["idx"]), "<u2"), np.frombuffer(b"".join(sample["tf"]), "<f4").copy()
    sample = sample[["lang", "draw"]]
    rows = []
    for (lang, draw), b, a in zip(sample.itertuples(index=False), ends, [0, *ends[:-1]]):
        i, x = all_idx[a:b], all_x[a:b]
        x[:] = model.vector(i, x)
        rows.append((number[lang], (draw >> 20) % 5 == 0, i, x))
    learned = {y for y, held, *_ in rows if not held}
    rows = [(y, held and y in learned, i, x) for y, held, i, x in rows]  # no language is only held back
    if not many:
        model.weights, model.temperature = fitted(rows, len(languages), epochs)
        return model
    size = -(-len(languages) // -(-len(languages) // max_languages))
    model.bounds = [*range(0, len(languages), size), len(languages)]
    model.coarse, model.temperature = fitted([(y // size, *r) for y, *r in rows], len(model.bounds) - 1, epochs)
    model.weights, model.fine = np.zeros((FEATURES, len(languages)), np.float32), []
    for a, b in zip(model.bounds, model.bounds[1:]):
        model.weights[:, a:b], t = fitted([(y - a, *r) for y, *r in rows if a <= y < b], b - a, epochs)
        model.fine.append(t)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**15 features times as many numbers as languages

    def run(batches):
        m = shared.value
        for batch in batches:
            out = [m.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (remainder(F.col("doc_id")) == 1).alias("held_out"))
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Train on the rows that may be learned from and predict all rows."""
    return predict(docs, train(docs))


def recognised(docs: DataFrame, margin: float = 1.2) -> DataFrame:
    """The rows of ``docs`` whose text has a letter and a language likelier than a guess; all columns stay.

    A guess among k learned languages scores 1 / k; the best language must have ``margin`` times
    that. With fewer than two learned languages only texts without a letter go.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    where = docs.columns.index("text")

    def run(batches):
        m = shared.value
        bar = margin / len(m.languages) if len(m.languages) > 1 else 0.0
        for batch in batches:
            texts = batch.column(where).to_pylist()
            yield batch.filter(pa.array([bool(t and _LETTER.search(t)) and m.predict(t)[1] >= bar for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
