"""Personal data by weak supervision, with DataFrame functions only.

Candidates are the base patterns' matches and weaker look-alikes. Four labelers vote on each
(1 yes, -1 no, 0 abstains): the strict pattern with its checksum or range, a gazetteer (top
level domains, card issuers, reserved networks, calling codes), the words before it, and its
shape. Expectation-maximisation over the counts of vote patterns estimates how reliable each
labeler is for each kind; its posteriors train a logistic span classifier over votes and span
features. A candidate is a span if it is a base match or the classifier says so.

Both fits see every document through one table of counts per (kind, votes, features), whose
size does not depend on the corpus. Patterns are possessive and anchored at the start of a run,
so no text makes them quadratic.

Defined results: a null text is empty; empty and null texts have no spans; repeated rows and
null doc_ids each get their own row; a corpus without candidates keeps the base rules; extra columns are not carried.
Spans of one kind do not overlap; spans of different kinds may.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from sonorel.llm.work import stored

KINDS = ("email", "ip", "card", "phone")
VOTES = ("regex", "gazetteer", "context", "shape")
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: Fixed patterns, leftmost and non-overlapping. \G: a match may also begin where the last one ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WEAK = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]{2,63}+(?:\.|\x20?(?:\[dot\]|\(dot\))\x20?)[A-Za-z]{2,10}",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
}
#: What a text must contain for a pattern to be tried at all.
NEEDS = {"email": "@", "phone": "+"}
CONTEXT = {
    "email": "mail|contact|write|reach|address",
    "ip": r"\bip\b|host|server|addr|client|login|connect",
    "card": "card|visa|master|amex|credit|debit|account|pay",
    "phone": r"phone|call|\btel|mobile|cell|fax|contact|whatsapp|dial",
}
AGAINST = r"version|isbn|build|release|chapter|section|figure|serial|order no|example:"


@dataclass
class SpanModel:
    """Log-odds of the final classifier, by kind; weights follow VOTES then FEATURES."""

    prior: dict[str, float] = field(default_factory=dict)
    reliability: dict[str, list[float]] = field(default_factory=dict)
    bias: dict[str, float] = field(default_factory=dict)
    weights: dict[str, list[float]] = field(default_factory=dict)


FEATURES = ("long", "separated", "led", "followed")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _strict(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.call_function("luhn_check", _digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def _gazetteer(kind: str, x: Column) -> Column:
    if kind == "email":
        return F.when(F.lower(x).rlike(r"[.\]) ](com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ca|it|nl|ch|at)$"), 1).otherwise(0)
    if kind == "ip":
        return F.when(x.rlike(r"^(0|127|22[4-9]|2[3-5][0-9])\."), -1).otherwise(1)
    if kind == "card":
        return F.when(x.rlike("^(4|5[1-5]|2[2-7]|3[47]|3[068]|6)"), 1).otherwise(-1)
    return F.when(x.rlike(r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), 1).otherwise(0)


def _shape(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    if kind == "email":
        return F.when(F.length(x) <= 64, 1).otherwise(-1)
    if kind == "ip":
        return F.when(x.rlike(r"(^|\.)0[0-9]"), -1).otherwise(1)
    if kind == "card":
        return F.when(n.between(13, 16), 1).otherwise(0)
    return F.when(n.between(10, 13), 1).otherwise(F.when(n < 9, -1).otherwise(0))


def _candidate(kind: str, weak: bool, start: Column, x: Column, before: Column, after: Column) -> Column:
    near = F.lower(F.substring(before, -40, 40))
    strict = F.lit(False) if weak else _strict(kind, x)
    context = F.when(near.rlike(AGAINST), -1).when(near.rlike(CONTEXT[kind]), 1).otherwise(0)
    return F.struct(
        start.alias("start"),
        F.lit(KINDS.index(kind)).alias("kind"),
        (start + F.length(x)).alias("end"),
        strict.alias("base"),
        F.array(*(v.cast("int") for v in (F.lit(0) if weak else F.when(strict, 1).otherwise(-1), _gazetteer(kind, x), context, _shape(kind, x)))).alias("votes"),
        F.array(
            (F.length(x) > 18).cast("int"),
            x.rlike("[0-9][ ().-]+[0-9]").cast("int"),
            before.rlike(r"[\p{L}0-9]$").cast("int"),
            after.rlike(r"^[\p{L}0-9]").cast("int"),
        ).alias("features"),
    )


BLOCK = 256
_TYPE = "array<struct<start:int,kind:int,end:int,base:boolean,votes:array<int>,features:array<int>>>"


def _located(text: Column, kind: str, weak: bool) -> Column:
    """All candidates of one pattern: matches give the strings, the pieces between them the places."""
    pattern = (WEAK if weak else BASE)[kind]
    bound = F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("s")))

    def fold(z: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            x, before, after = F.element_at(z["m"], i), F.element_at(z["s"], i), F.element_at(z["s"], i + 1)
            start = acc["at"] + F.length(before)
            return F.struct((start + F.length(x)).alias("at"), F.concat(acc["out"], F.array(_candidate(kind, weak, start, x, before, after))).cast(_TYPE).alias("out"))

        def block(acc: Column, first: Column) -> Column:  # by the block, so that lists stay short while they grow
            some = F.aggregate(F.sequence(first, F.least(first + BLOCK - 1, F.size(z["m"]))), F.struct(acc["at"].alias("at"), F.array().cast(_TYPE).alias("out")), step)
            return F.struct(some["at"].alias("at"), F.concat(acc["out"], F.array(some["out"])).cast(f"array<{_TYPE}>").alias("out"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_TYPE}>").alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.size(z["m"]), F.lit(BLOCK)), zero, block, lambda acc: F.flatten(acc["out"]))

    found = F.element_at(F.transform(bound, fold), 1)
    return F.when(text.rlike(pattern) & F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS and not weak else text.rlike(pattern), found).otherwise(F.array().cast(_TYPE))


def candidates(text: Column) -> Column:
    """Base and weak candidates of a text, by start then kind; a weak one that meets a base match is left out."""
    base = F.concat(*(_located(text, k, False) for k in KINDS))
    weak = F.concat(*(_located(text, k, True) for k in WEAK))
    both = F.array(F.struct(base.alias("b"), weak.alias("w")))

    def clear(z: Column) -> Column:
        apart = F.filter(z["w"], lambda w: ~F.exists(z["b"], lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
        return F.array_sort(F.concat(z["b"], apart))

    return F.element_at(F.transform(both, clear), 1)


def expectation_maximisation(counts: dict[tuple[int, ...], float], rounds: int = 50) -> tuple[float, list[float], dict[tuple[int, ...], float]]:
    """Prior, labelers' accuracies and posteriors from counts of vote patterns (conditionally independent labelers)."""
    m = len(next(iter(counts)))
    prior, acc = 0.7, [0.8] * m
    post: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for v in counts:
            odds = math.log(prior / (1 - prior)) + sum(x * math.log(a / (1 - a)) for x, a in zip(v, acc))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        total = sum(counts.values())
        prior = min(0.99, max(0.01, (1 + sum(c * post[v] for v, c in counts.items())) / (total + 2)))
        for j in range(m):
            right = 4 + sum(c * (post[v] if v[j] > 0 else 1 - post[v]) for v, c in counts.items() if v[j])
            cast = 5 + sum(c for v, c in counts.items() if v[j])
            acc[j] = min(0.99, max(0.51, right / cast))  # a labeler is taken to be better than chance
    return prior, acc, post


def logistic(rows: list[tuple[list[float], float, float]], rounds: int = 300, rate: float = 0.5, l2: float = 0.01) -> tuple[float, list[float]]:
    """Bias and weights from (features, target in [0, 1], weight) by full gradient steps."""
    width = len(rows[0][0])
    bias, w = 0.0, [0.0] * width
    total = sum(n for _, _, n in rows)
    for _ in range(rounds):
        gb, g = 0.0, [0.0] * width
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + sum(a * b for a, b in zip(w, x))))))
            d = (p - y) * n / total
            gb += d
            for j, a in enumerate(x):
                g[j] += d * a
        bias -= rate * gb
        w = [a - rate * (b + l2 * a) for a, b in zip(w, g)]
    return bias, w


def fit(found: DataFrame) -> SpanModel:
    """Fit labelers and classifier on ``found(candidates)``; the counts have at most 4 * 3**4 * 2**4 rows."""
    c = found.select(F.explode("candidates").alias("c"))
    counted = c.groupBy("c.kind", "c.votes", "c.features").agg(F.count("*").alias("n")).collect()
    model = SpanModel()
    for number, kind in enumerate(KINDS):
        rows = sorted((tuple(r.votes), tuple(r.features), r.n) for r in counted if r.kind == number)
        if not rows:
            continue
        counts: dict[tuple[int, ...], float] = {}
        for v, _, n in rows:
            counts[v] = counts.get(v, 0) + n
        model.prior[kind], model.reliability[kind], post = expectation_maximisation(counts)
        model.bias[kind], model.weights[kind] = logistic([([*map(float, v), *map(float, f)], post[v], n) for v, f, n in rows])
    return model


def probability(model: SpanModel, c: Column) -> Column:
    """The classifier's probability of a candidate; without a model for its kind, whether it is a base match."""
    out = None
    for number, kind in enumerate(KINDS):
        if kind not in model.bias:
            continue
        w = model.weights[kind]
        z = F.lit(model.bias[kind])
        for name, at, size in (("votes", 0, len(VOTES)), ("features", len(VOTES), len(FEATURES))):
            for j in range(size):
                z = z + c[name][j] * F.lit(w[at + j])
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        out = F.when(c["kind"] == number, p) if out is None else out.when(c["kind"] == number, p)
    sure = c["base"].cast("double")
    return sure if out is None else F.coalesce(out, sure)


def accepted(model: SpanModel, found: Column) -> Column:
    return F.filter(found, lambda c: c["base"] | ((c["votes"][0] == 0) & (probability(model, c) >= 0.5)))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.element_at(names, c["kind"] + 1), c["start"].cast("string"), c["end"].cast("string"))), ",")


def _number(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda c: c["kind"] == kind))


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, score`` of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), candidates(text).alias("candidates")), "candidates")
    model = fit(found)
    base = F.filter("candidates", lambda c: c["base"])
    spans = accepted(model, F.col("candidates"))
    rows = found.select("doc_id", base.alias("b"), spans.alias("s"))
    counts = [_number(F.col("b"), k).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    surest = F.aggregate("s", F.lit(0.0), lambda a, c: F.greatest(a, probability(model, c)))
    return rows.select("doc_id", *counts, F.sha2(_joined(F.col("b")), 256).alias("base_sha256"), _joined(F.col("s")).alias("spans"), (F.size("s") - F.size("b")).cast("long").alias("n_added"), surest.alias("score"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first names the place."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, c: Column) -> Column:
        fresh = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, c["start"] - acc["at"]), F.element_at(names, c["kind"] + 1)))
        return F.struct(F.greatest(acc["at"], c["end"]).alias("at"), F.when(c["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(spans, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of ``text`` masked and ``n_chars``, if there, recounted; other columns stay, null texts too."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the row travels as one struct, so that no column of it can clash; the patterns run once
    found = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), candidates(text).alias("candidates")), "candidates")
    model = fit(found)
    own = F.col("row.text").cast("string")
    spans = F.array(F.struct(accepted(model, F.col("candidates")).alias("s")))
    masks = F.when(own.isNotNull(), F.element_at(F.transform(spans, lambda z: masked(own, z["s"])), 1))
    out = found.select("row", masks.alias("masked"))
    new = {"text": F.col("masked").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("masked").isNotNull(), F.length("masked")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
