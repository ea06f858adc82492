"""From scores to tokens to text: CTC, transducer, sampling with fallback, repetition, detokenizing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sonorel.functions.text import join_pieces

EOS_IDS = (151645, 151643)  # fixed values: end-of-sequence ids of the LLM decoder
NO_SPEECH_FALLBACK = 50362  # fixed value: used where the vocabulary has no such token
#: Special tokens by use, each with the names to try in order.
SPECIAL_TOKENS = {
    "start": ["<|startoftranscript|>"], "end": ["<|endoftext|>"], "transcribe": ["<|transcribe|>"], "translate": ["<|translate|>"],
    "no_speech": ["<|nospeech|>", "<|nocaptions|>"], "no_timestamps": ["<|notimestamps|>"],
}


def best_class(scores: DataFrame) -> DataFrame:
    """``scores(seq, t, class, score)`` to ``(seq, t, tok)``: the largest score, the first of equals."""
    return scores.groupBy("seq", "t").agg(F.max_by("class", F.struct(F.col("score"), -F.col("class"))).alias("tok"))


def collapse(tokens: DataFrame, blank: int | Column) -> DataFrame:
    """``tokens(seq, t, tok)``: repeats go, then blanks; a blank between equal tokens lets both stand."""
    before = F.lag("tok").over(Window.partitionBy("seq").orderBy("t"))
    return tokens.withColumn("_before", before).where((F.col("tok") != blank) & (F.col("_before").isNull() | (F.col("_before") != F.col("tok")))).drop("_before")


def lookup_pieces(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """``tokens(seq, t, tok)`` with ``vocab(id, piece)``; unknown ids go. The vocabulary is a dimension table."""
    return tokens.join(vocab.select(F.col("id").alias("tok"), "piece"), "tok")


def pieces_to_text(pieces: DataFrame, both_ends: bool = False) -> DataFrame:
    ordered = pieces.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("t", "piece"))).alias("p"))
    return ordered.select("seq", join_pieces(F.transform("p", lambda x: x["piece"]), both_ends).alias("text"))


def ctc_greedy(scores: DataFrame, vocab: DataFrame, blank: int) -> DataFrame:
    return pieces_to_text(lookup_pieces(collapse(best_class(scores), blank), vocab))


def cut_at_eos(tokens: Column, eos: tuple[int, ...] = EOS_IDS) -> Column:
    """Tokens before the first end token."""
    ends = F.array_min(F.filter(F.array(*(F.nullif(F.array_position(tokens, F.lit(e)), F.lit(0)) for e in eos)), lambda x: x.isNotNull()))
    return F.when(ends.isNotNull(), F.slice(tokens, F.lit(1), (ends - 1).cast("int"))).otherwise(tokens)


def token_ids(wanted: DataFrame, vocab: DataFrame, defaults: dict[str, int] | None = None) -> DataFrame:
    """``wanted(use, names)`` to ``(use, id)``: the id of the first of the names that ``vocab(id, piece)`` has.

    A use without any gets its default; without a default its id is null, which ``required`` makes an error.
    """
    tried = wanted.select("use", F.posexplode("names").alias("rank", "piece")).join(vocab.select("id", "piece"), "piece")
    found = tried.groupBy("use").agg(F.min_by("id", "rank").alias("id"))
    fallback = F.lit(None).cast("int")
    for use, number in (defaults or {}).items():
        fallback = F.when(F.col("use") == use, F.lit(number)).otherwise(fallback)
    return wanted.select("use").join(found, "use", "left").select("use", F.coalesce("id", fallback).cast("int").alias("id"))


def required(ids: DataFrame) -> DataFrame:
    """``(use, id)`` in which every id must be known."""
    return ids.withColumn("id", F.when(F.col("id").isNull(), F.raise_error(F.concat(F.lit("no token for "), F.col("use"))).cast("int")).otherwise(F.col("id")))


def special_tokens(vocab: DataFrame) -> DataFrame:
    """Ids of the special tokens by use; no-speech has two names and a default, the others are required."""
    wanted = vocab.sparkSession.createDataFrame(list(SPECIAL_TOKENS.items()), "use string, names array<string>")
    return required(token_ids(wanted, vocab, {"no_speech": NO_SPEECH_FALLBACK}))


def largest(scores: DataFrame, n: int = 5) -> DataFrame:
    """``scores(seq, t, class, score)`` to the ``n`` largest of each step, ``(seq, t, rank, class, score)``; of equals the first class."""
    rank = F.row_number().over(Window.partitionBy("seq", "t").orderBy(F.desc("score"), "class"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= n).select("seq", "t", "rank", "class", "score")


def detokenize(tokens: DataFrame, vocab: DataFrame, special: tuple[int, ...] = (), eos: tuple[int, ...] = EOS_IDS) -> DataFrame:
    """``tokens(seq, ids)`` to ``(seq, text)``: cut at the end token, special and unknown ids out, byte-level pieces to trimmed text."""
    kept = cut_at_eos(F.col("ids"), eos)
    if special:
        kept = without_special(kept, F.array(*map(F.lit, special)))
    rows = tokens.select("seq", F.posexplode_outer(kept).alias("t", "tok")).join(vocab.select(F.col("id").alias("tok"), "piece"), "tok", "left")
    pieces = rows.groupBy("seq").agg(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("t", "piece")))).alias("p"))
    return byte_level_decode(pieces.select("seq", F.transform("p", lambda x: x["piece"]).alias("pieces")))


def without_special(tokens: Column, special: Column) -> Column:
    return F.filter(tokens, lambda t: ~F.array_contains(special, t))


def suppressed(scores: DataFrame, suppressed_ids: DataFrame) -> DataFrame:
    """``scores`` without the classes of ``suppressed_ids(class)``: they can never be the largest."""
    return scores.join(suppressed_ids, "class", "left_anti")


def bigram_compression(tokens: Column) -> Column:
    """1 / max(0.01, distinct neighbour pairs per pair); 1 for a single token, 0 for none."""
    n = F.size(tokens)
    pairs = F.zip_with(F.slice(tokens, F.lit(1), n - 1), F.slice(tokens, F.lit(2), n - 1), lambda a, b: F.call_function("shiftleft", a.cast("long"), F.lit(32)).bitwiseOR(b.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))
    return F.when(n == 0, 0.0).when(n == 1, 1.0).otherwise(1.0 / F.greatest(F.lit(0.01), F.size(F.array_distinct(pairs)) / (n - 1)))


def mean_log_probability(sum_with_end: Column, generated: Column) -> Column:
    """The end token's share is in the sum, not in the divisor, which is 1 at least."""
    return sum_with_end / F.greatest(F.lit(1), generated)


def repetition_loop(tokens: Column, least: int = 128, tail: int = 96, few: int = 6, longest: int = 16, blocks: int = 6) -> Column:
    """Whether the end of a token array runs in a loop: few distinct tokens, or six equal blocks of up to 16."""
    n = F.size(tokens)
    low = F.size(F.array_distinct(F.slice(tokens, F.greatest(n - tail + 1, F.lit(1)), tail))) <= few

    def periodic(p: Column) -> Column:
        end = F.slice(tokens, F.greatest(n - p * blocks + 1, F.lit(1)), p * blocks)
        head = F.slice(end, F.lit(1), p * (blocks - 1))
        return F.when(n >= p * blocks, head == F.slice(end, p + 1, p * (blocks - 1))).otherwise(F.lit(False))

    return F.when(n < least, F.lit(False)).otherwise(low | F.exists(F.sequence(F.lit(1), F.lit(longest)), periodic))


def first_accepted(attempts: DataFrame, max_compression: float = 2.4, min_logprob: float = -1.0) -> DataFrame:
    """Of each sequence's ``attempts(seq, temperature, compression_ratio, avg_logprob, ...)`` the first acceptable by temperature, else the last."""
    ok = (F.col("compression_ratio") < max_compression) & (F.col("avg_logprob") > min_logprob)
    order = Window.partitionBy("seq").orderBy(F.when(ok, 0).otherwise(1), F.when(ok, F.col("temperature")).otherwise(-F.col("temperature")))
    return attempts.withColumn("accepted", ok).withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


# --- sequential decoders ----------------------------------------------------------------------


def tdt_greedy(steps: Callable[[int, object], tuple[np.ndarray, np.ndarray]], length: int, blank: int, durations: list[int], advance: Callable[[int, object], object] = lambda token, state: state, state: object = None, max_symbols: int = 10) -> list[int]:
    """Token-and-duration greedy search.

    ``steps(t, state)`` gives token and duration scores; ``advance(token, state)`` the state
    after an emission. At most ``max_symbols`` tokens per frame; reaching that moves on by one
    frame in addition to the last token's duration.
    """
    out: list[int] = []
    t = emitted = 0  # emitted: on this frame
    while t < length:
        scores, lengths = steps(t, state)
        token, best = int(np.argmax(scores)), int(np.argmax(lengths))
        skip = durations[best] if best < len(durations) else 1
        if token == blank:
            t, emitted = t + max(skip, 1), 0
            continue
        out.append(token)
        state = advance(token, state)
        emitted += 1
        full = emitted == max_symbols and (emitted > 1 or not skip)
        t += skip + full
        if skip or full:
            emitted = 0
    return out


def tdt_decode(scores: DataFrame, blank: int, durations: list[int]) -> DataFrame:
    """``scores(seq, t, tokens, lengths)``, arrays that do not depend on what was emitted, to ``(seq, pos, tok)``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        tok, dur = list(pdf["tokens"]), list(pdf["lengths"])
        got = tdt_greedy(lambda t, _: (tok[t], dur[t]), len(tok), blank, durations)
        return pd.DataFrame({"seq": [pdf["seq"].iloc[0]] * len(got), "pos": np.arange(len(got), dtype=np.int32), "tok": np.asarray(got, np.int32)})

    kind = dict(scores.dtypes)["seq"]
    return scores.groupBy("seq").applyInPandas(run, f"seq {kind}, pos int, tok int")


@dataclass
class Decoded:
    tokens: list[int]
    avg_logprob: float
    compression_ratio: float
    temperature: float


def prompt(start: int, language: int | None, task: int, no_timestamps: int | None) -> list[int]:
    return [x for x in (start, language, task, no_timestamps) if x is not None]


def _compression(tokens: list[int]) -> float:
    if len(tokens) < 2:
        return float(len(tokens))
    return 1 / max(0.01, len(set(zip(tokens, tokens[1:]))) / (len(tokens) - 1))


def decode_segment(forward: Callable[[list[int]], np.ndarray], start: list[int], end: int, limit: int, temperature: float = 0.0, suppress: tuple[int, ...] = (), seed: int = 42) -> Decoded:
    """Autoregressive decoding: greedy at temperature 0, else seeded sampling; log-probabilities at temperature 1."""
    rng = np.random.default_rng(seed)
    tokens: list[int] = []
    total = 0.0
    for _ in range(limit):
        logits = np.array(forward(start + tokens), np.float64)
        logits[list(suppress)] = -np.inf
        logp = logits - logits.max()
        logp -= np.log(np.exp(logp).sum())
        if temperature > 0:
            p = np.exp((logits - logits.max()) / temperature)
            token = int(rng.choice(len(p), p=p / p.sum()))
        else:
            token = int(logits.argmax())
        total += logp[token]
        if token == end:
            break
        tokens.append(token)
    return Decoded(tokens, total / max(1, len(tokens)), _compression(tokens), temperature)


def decode_with_fallback(attempt: Callable[[float], Decoded], max_compression: float = 2.4, min_logprob: float = -1.0) -> Decoded:
    """Temperatures 0.0 to 1.0 by 0.2; the first acceptable result, else the last."""
    for step in range(6):
        got = attempt(round(0.2 * step, 1))
        if got.compression_ratio < max_compression and got.avg_logprob > min_logprob:
            return got
    return got


def loops(tokens: list[int], least: int = 128, tail: int = 96, few: int = 6, longest: int = 16, blocks: int = 6) -> bool:
    if len(tokens) < least:
        return False
    if len(set(tokens[-tail:])) <= few:
        return True
    return any(len(tokens) >= p * blocks and tokens[-p * blocks : -p] == tokens[-p * (blocks - 1) :] for p in range(1, longest + 1))


def generate(forward: Callable[[list[int]], np.ndarray], limit: int, eos: tuple[int, ...] = EOS_IDS) -> tuple[list[int], str]:
    """Greedy LLM generation: tokens and why it stopped; the token that shows a loop stays."""
    tokens: list[int] = []
    for _ in range(limit):
        token = int(np.argmax(forward(tokens)))
        if token in eos:
            return tokens, "eos"
        tokens.append(token)
        if loops(tokens):
            return tokens, "repetition"
    return tokens, "max_tokens"


_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The byte that each character of a byte-level piece stands for.
BYTES = {chr(b): b for b in _OWN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _OWN)}


def byte_text(pieces: list[str]) -> str:
    return bytes(BYTES[c] for p in pieces for c in p if c in BYTES).decode("utf-8", "replace").strip()


def byte_level_decode(tokens: DataFrame) -> DataFrame:
    """``tokens(seq, pieces)`` of byte-level pieces to ``(seq, text)``: bytes to text with replacement, trimmed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"seq": pdf["seq"], "text": [byte_text(pieces) for pieces in pdf["pieces"]]})

    return tokens.select("seq", "pieces").mapInPandas(run, f"seq {dict(tokens.dtypes)['seq']}, text string")
