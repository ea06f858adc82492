"""Queries of the network layers, tokens and binary sources, each with an independent SQL text.

Vectors of ``embeddings`` stand for hidden states; ten of them make a sequence. Weights are made
by a rule that both sides know: ``weight(i, j) = sin(7 i + 3 j) / 8``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sonorel.operators import decoding as de, neural as nn, transcript as tr
from sonorel.plans.catalogue import _SAMPLES, _register, _rows, _table, scores, transcripts
from sonorel.sources import binary, inventory as inv


def weight(rows: int, cols: int, shift: int = 0) -> np.ndarray:
    return np.sin(7 * (np.arange(rows)[:, None] + shift) + 3 * np.arange(cols)[None, :]) / 8


def _by_vector(spark, sf, layer):
    """``(vec_id, i, v)``: ``layer`` over the rows of a matrix of vectors."""

    def run(batches):
        for pdf in batches:
            y = layer(np.stack([np.asarray(e, np.float64) for e in pdf["embedding"]]))
            yield pd.DataFrame({"vec_id": np.repeat(pdf["vec_id"].to_numpy(), y.shape[1]), "i": np.tile(np.arange(y.shape[1], dtype=np.int32), len(y)), "v": np.round(y.ravel(), 6)})

    return _table(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, i int, v double")


def _by_sequence(spark, sf, layer, width=8):
    """``(seq, t, i, v)``: ``layer`` over a sequence of up to ten vectors, their first ``width`` components."""

    def run(pdf):
        pdf = pdf.sort_values("vec_id", kind="stable")
        y = layer(np.stack([np.asarray(e, np.float64)[:width] for e in pdf["embedding"]]))
        n, k = y.shape
        return pd.DataFrame({"seq": [int(pdf["vec_id"].iloc[0]) // 10] * (n * k), "t": np.repeat(np.arange(n, dtype=np.int32), k), "i": np.tile(np.arange(k, dtype=np.int32), n), "v": np.round(y.ravel(), 6)})

    e = _table(spark, sf, "embeddings").select("vec_id", "embedding").withColumn("seq", F.floor(F.col("vec_id") / 10))
    return e.groupBy("seq").applyInPandas(run, "seq long, t int, i int, v double")


_V = "v AS (SELECT vec_id, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"
_S = "s AS (SELECT vec_id // 10 AS seq, CAST(row_number() OVER (PARTITION BY vec_id // 10, i ORDER BY vec_id) - 1 AS INTEGER) AS t, i, x FROM v WHERE i < 8)"


def _w(row: str, col: str, shift: int = 0) -> str:
    return f"sin(7 * ({row} + {shift}) + 3 * {col}) / 8"


def _lin(name: str, source: str, key: str, rows: int, shift: int = 0) -> str:
    """``name(key, i, x)``: a linear map of ``source(key, i, x)``."""
    return f"{name} AS (SELECT {key}, CAST(o AS INTEGER) AS i, sum(x * {_w('o', 'i', shift)}) AS x FROM {source}, range({rows}) r(o) GROUP BY {key}, o)"


@_register("n1_layernorm", f"WITH {_V} SELECT vec_id, i, round((x - m) / sqrt(p + 1e-5), 6) AS v FROM v JOIN (SELECT vec_id, avg(x) AS m, var_pop(x) AS p FROM v GROUP BY vec_id) USING (vec_id)")
def n1(spark, sf):
    return _by_vector(spark, sf, nn.layer_norm)


@_register("n2_rmsnorm", f"WITH {_V} SELECT vec_id, i, round(x / sqrt(m + 1e-6) * (1 + i / 64.0::DOUBLE), 6) AS v FROM v JOIN (SELECT vec_id, avg(x * x) AS m FROM v GROUP BY vec_id) USING (vec_id)")
def n2(spark, sf):
    return _by_vector(spark, sf, lambda x: nn.rms_norm(x, 1 + np.arange(x.shape[1]) / 64))


@_register("n3_batchnorm", f"WITH {_V} SELECT vec_id, i, round((x - i / 100.0::DOUBLE) / sqrt(1 + i / 50.0::DOUBLE + 1e-5) * (1 + i / 64.0::DOUBLE) + i / 10.0::DOUBLE, 6) AS v FROM v")
def n3(spark, sf):
    return _by_vector(spark, sf, lambda x: nn.batch_norm(x, *(f(np.arange(x.shape[1])) for f in (lambda i: i / 100, lambda i: 1 + i / 50, lambda i: 1 + i / 64, lambda i: i / 10))))


@_register("n10_swiglu", f"WITH {_V}, {_lin('g', 'v', 'vec_id', 8)}, {_lin('u', 'v', 'vec_id', 8, 8)}, h AS (SELECT vec_id, i, g.x / (1 + exp(-g.x)) * u.x AS x FROM g JOIN u USING (vec_id, i)), {_lin('d', 'h', 'vec_id', 4, 16)} SELECT vec_id, i, round(x, 6) AS v FROM d")
def n10(spark, sf):
    return _by_vector(spark, sf, lambda x: nn.swiglu(x, {"gate": weight(8, x.shape[1]), "up": weight(8, x.shape[1], 8), "down": weight(4, 8, 16)}))


@_register("n17_linear", f"WITH {_V}, {_lin('h', 'v', 'vec_id', 6)}, a AS (SELECT vec_id, i, x AS x0 FROM h) SELECT vec_id, i, round(x0, 6) AS v FROM a")
def n17(spark, sf):
    return _by_vector(spark, sf, lambda x: nn.linear(x, weight(6, x.shape[1])))


@_register("n20_ctc_head", f"WITH {_V}, {_lin('h', 'v', 'vec_id', 8)}, b AS (SELECT vec_id, i, x + i / 10.0::DOUBLE AS x FROM h), l AS (SELECT vec_id, max(x) AS top FROM b GROUP BY vec_id), z AS (SELECT vec_id, top + ln(sum(exp(x - top))) AS z FROM b JOIN l USING (vec_id) GROUP BY vec_id, top) SELECT vec_id, i, round(x - z, 6) AS v FROM b JOIN z USING (vec_id)")
def n20(spark, sf):
    return _by_vector(spark, sf, lambda x: nn.ctc_head(x, weight(8, x.shape[1]), np.arange(8) / 10))


@_register("n21_lstm", f"WITH {_V}, {_lin('a', 'v', 'vec_id', 16)}, g AS (SELECT vec_id, i, x + (SELECT sum((k / 4.0::DOUBLE) * {_w('a.i', 'k', 16)}) FROM range(4) r(k)) AS x FROM a),\n    p AS (SELECT a.vec_id, CAST(a.i AS INTEGER) AS i, 1 / (1 + exp(-a.x)) AS gi, 1 / (1 + exp(-b.x)) AS gf, tanh(c.x) AS gg, 1 / (1 + exp(-d.x)) AS go FROM g a JOIN g b ON b.vec_id = a.vec_id AND b.i = a.i + 4 JOIN g c ON c.vec_id = a.vec_id AND c.i = a.i + 8 JOIN g d ON d.vec_id = a.vec_id AND d.i = a.i + 12 WHERE a.i < 4)\n    SELECT vec_id, i, round(go * tanh(gf * (i / 8.0::DOUBLE) + gi * gg), 6) AS v FROM p")
def n21(spark, sf):
    def step(x):
        w = {"ih": weight(16, x.shape[1]), "hh": weight(16, 4, 16)}
        return np.stack([nn.lstm_step(r, np.arange(4) / 4, np.arange(4) / 8, w)[0] for r in x])

    return _by_vector(spark, sf, step)


@_register("n22_joint", f"WITH {_V}, {_lin('e', 'v', 'vec_id', 8)}, {_lin('p', 'v', 'vec_id', 8, 8)}, h AS (SELECT vec_id, i, greatest(e.x + p.x, 0) AS x FROM e JOIN p USING (vec_id, i)), {_lin('o', 'h', 'vec_id', 6, 16)} SELECT vec_id, i, round(x, 6) AS v FROM o")
def n22(spark, sf):
    return _by_vector(spark, sf, lambda x: np.concatenate(nn.joint(x, x, {"enc": weight(8, x.shape[1]), "pred": weight(8, x.shape[1], 8), "out": weight(6, 8, 16)}, 4), axis=1))


_ATTEND = f"""{_V}, {_S}, {_lin('q', 's', 'seq, t', 8)}, {_lin('k', 's', 'seq, t', 8, 8)}, {_lin('w', 's', 'seq, t', 8, 16)},
    sc AS (SELECT q.seq, q.t, k.t AS u, q.i // 4 AS h, sum(q.x * k.x) / 2 AS x FROM q JOIN k ON k.seq = q.seq AND k.i = q.i GROUP BY q.seq, q.t, k.t, q.i // 4),
    pr AS (SELECT seq, t, u, h, exp(x - max(x) OVER (PARTITION BY seq, t, h)) AS e FROM sc), pn AS (SELECT seq, t, u, h, e / sum(e) OVER (PARTITION BY seq, t, h) AS p FROM pr),
    mx AS (SELECT pn.seq, pn.t, w.i, sum(p * w.x) AS x FROM pn JOIN w ON w.seq = pn.seq AND w.t = pn.u AND w.i // 4 = pn.h GROUP BY pn.seq, pn.t, w.i)"""


@_register("n4_attention", f"WITH {_ATTEND}, {_lin('o', 'mx', 'seq, t', 8, 24)} SELECT seq, t, i, round(x, 6) AS v FROM o")
def n4(spark, sf):
    return _by_sequence(spark, sf, lambda x: nn.self_attention(x, {"q": weight(8, 8), "k": weight(8, 8, 8), "v": weight(8, 8, 16), "out": weight(8, 8, 24)}, 2))


@_register("n6_rope", f"WITH {_V}, {_S} SELECT a.seq, a.t, a.i, round(a.x * cos(a.t * power(10000.0::DOUBLE, -(a.i % 4) / 4.0::DOUBLE)) + CASE WHEN a.i < 4 THEN -1 ELSE 1 END * b.x * sin(a.t * power(10000.0::DOUBLE, -(a.i % 4) / 4.0::DOUBLE)), 6) AS v FROM s a JOIN s b ON a.seq = b.seq AND a.t = b.t AND b.i = (a.i + 4) % 8")
def n6(spark, sf):
    return _by_sequence(spark, sf, lambda x: nn.rotate(x, *nn.rotary(len(x), 8, 10000.0)))


@_register("n9_sinusoidal", f"WITH {_V}, {_S} SELECT seq, t, i, round(x + CASE WHEN i < 4 THEN sin(t * exp(-ln(10000.0::DOUBLE) / 3 * i)) ELSE cos(t * exp(-ln(10000.0::DOUBLE) / 3 * (i - 4))) END, 6) AS v FROM s")
def n9(spark, sf):
    return _by_sequence(spark, sf, lambda x: x + nn.sinusoidal(len(x), 8))


_CONV = f"""n AS (SELECT seq, max(t) + 1 AS n FROM s GROUP BY seq), g AS (SELECT seq, unnest(range(0, (n + 1) // 2)) AS t FROM n),
    c AS (SELECT g.seq, CAST(g.t AS INTEGER) AS t, CAST(o AS INTEGER) AS i, sum(s.x * sin(7 * o + 3 * s.i + (s.t - 2 * g.t + 1)) / 8) AS x FROM g JOIN s ON s.seq = g.seq AND s.t BETWEEN 2 * g.t - 1 AND 2 * g.t + 1, range(4) r(o) GROUP BY g.seq, g.t, o)"""


@_register("n12_conv1d", f"WITH {_V}, {_S}, {_CONV} SELECT seq, t, i, round(greatest(x, 0), 6) AS v FROM c")
def n12(spark, sf):
    kernel = np.sin(7 * np.arange(4)[:, None, None] + 3 * np.arange(8)[None, :, None] + np.arange(3)[None, None, :]) / 8
    return _by_sequence(spark, sf, lambda x: nn.subsample_conv1d(x, [{"kernel": kernel}]))


@_register("n18_cross_attention", f"""WITH {_V}, {_S}, {_lin('q', 's', 'seq, t', 4)}, {_lin('k', 's', 'seq, t', 4, 4)}, {_lin('w', 's', 'seq, t', 4, 8)},
    sc AS (SELECT q.seq, q.t, k.t AS u, sum(q.x * k.x) / 2 AS x FROM q JOIN k ON k.seq = q.seq AND k.i = q.i WHERE q.t < 2 GROUP BY q.seq, q.t, k.t),
    pn AS (SELECT seq, t, u, exp(x) / sum(exp(x)) OVER (PARTITION BY seq, t) AS p FROM sc),
    mx AS (SELECT pn.seq, pn.t, w.i, sum(p * w.x) AS x FROM pn JOIN w ON w.seq = pn.seq AND w.t = pn.u GROUP BY pn.seq, pn.t, w.i), {_lin('o', 'mx', 'seq, t', 8, 12)} SELECT seq, t, i, round(x, 6) AS v FROM o""")
def n18(spark, sf):
    return _by_sequence(spark, sf, lambda x: nn.cross_attention(x[:2], x, {"q": weight(4, 8), "k": weight(4, 8, 4), "v": weight(4, 8, 8), "out": weight(8, 4, 12)}, 1))


# --- tokens ---------------------------------------------------------------------------------------

_WORDS = "w AS (SELECT item_id AS id, string_split(text, ' ')[1] AS piece FROM benchmark)"


def _vocab(spark, sf):
    return _table(spark, sf, "benchmark").select(F.col("item_id").cast("int").alias("id"), F.element_at(F.split("text", " "), 1).alias("piece"))


@_register("j10_token_ids", f"WITH {_WORDS}, u AS (SELECT id, [piece || '?', piece, 'zz'] AS names FROM w), f AS (SELECT piece, min(id) AS id FROM w GROUP BY piece) SELECT CAST(u.id AS VARCHAR) AS use, CAST(f.id AS INTEGER) AS id FROM u JOIN f ON f.piece = u.names[2] UNION ALL SELECT 'none', 7")
def j10(spark, sf):
    v = _vocab(spark, sf)
    vocab = v.groupBy("piece").agg(F.min("id").alias("id"))
    wanted = v.select(F.col("id").cast("string").alias("use"), F.array(F.concat("piece", F.lit("?")), F.col("piece"), F.lit("zz")).alias("names"))
    return de.required(de.token_ids(wanted.unionByName(spark.createDataFrame([("none", ["?"])], "use string, names array<string>")), vocab, {"none": 7}))


@_register("j11_special_tokens", f"SELECT * FROM (VALUES ('start', 1::INTEGER), ('end', 2), ('transcribe', 3), ('translate', 4), ('no_speech', {de.NO_SPEECH_FALLBACK}), ('no_timestamps', 6)) v(use, id)")
def j11(spark, sf):
    names = [x for use, x in de.SPECIAL_TOKENS.items() if use != "no_speech"]
    ids = [1, 2, 3, 4, 6]
    return de.special_tokens(spark.createDataFrame([(i, x[0]) for i, x in zip(ids, names)], "id int, piece string"))


@_register("t4_largest", "SELECT seq, t, CAST(rk AS INTEGER) AS \"rank\", class, round(score, 6) AS score FROM (SELECT vec_id // 10 AS seq, CAST(vec_id % 10 AS INTEGER) AS t, i AS class, x AS score, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS rk FROM (SELECT vec_id, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)) WHERE rk <= 5")
def t4(spark, sf):
    return de.largest(scores(spark, sf).withColumn("score", F.col("score").cast("double"))).withColumn("score", F.round("score", 6))


@_register("o9_detokenize", "SELECT doc_id AS seq, trim(regexp_replace(CASE WHEN contains(text, 'e') THEN split_part(text, 'e', 1) ELSE text END, '[^ -df-~]|~', '', 'g')) AS text FROM documents")
def o9(spark, sf):
    """Characters as tokens: ids are ASCII codes, 'e' ends a text, '~' is special, other characters are unknown."""
    d = _table(spark, sf, "documents")
    ids = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.ascii(c))
    names = {v: k for k, v in de.BYTES.items()}
    vocab = spark.createDataFrame([(b, names[b]) for b in range(32, 127)], "id int, piece string")
    return de.detokenize(d.select(F.col("doc_id").alias("seq"), ids.alias("ids")), vocab, (126,), (101,))


@_register("o6_prompt", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN [1, 5, 3, 6] ELSE [1, 3] END AS ids FROM conversations")
def o6(spark, sf):
    c = _table(spark, sf, "conversations")
    lists = {who: F.array(*map(F.lit, de.prompt(1, 5 if who else None, 3, 6 if who else None))) for who in (True, False)}
    return c.select("conv_id", "turn", F.when(F.col("role") == "user", lists[True]).otherwise(lists[False]).alias("ids"))


@_register("a14_errors", "WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS a, unnest(list_concat(embedding[2:], embedding[1:1]))::DOUBLE AS b FROM embeddings) SELECT label, round(avg((a - b) * (a - b)), 6) AS mse, round(max(abs(a - b)), 6) AS max_abs, round(min(a), 6) AS low, round(max(a), 6) AS high, round(avg(a), 6) AS mean FROM e GROUP BY label")
def a14(spark, sf):
    e = _table(spark, sf, "embeddings").select("label", F.explode(F.arrays_zip(F.col("embedding").alias("a"), F.concat(F.expr("slice(embedding, 2, size(embedding) - 1)"), F.slice("embedding", 1, 1)).alias("b"))).alias("p"))
    e = e.select("label", F.col("p.a").cast("double").alias("a"), F.col("p.b").cast("double").alias("b"))
    d = F.col("a") - F.col("b")
    return e.groupBy("label").agg(F.round(F.avg(d * d), 6).alias("mse"), F.round(F.max(F.abs(d)), 6).alias("max_abs"), F.round(F.min("a"), 6).alias("low"), F.round(F.max("a"), 6).alias("high"), F.round(F.avg("a"), 6).alias("mean"))


# --- sources and sinks ----------------------------------------------------------------------------


@_register("s1_wav", f"WITH {_SAMPLES} SELECT CAST(stream AS VARCHAR) AS path, 100 AS sample_rate, 1 AS channels, count(*) AS n, round(sum(trunc(CAST(x AS FLOAT)::DOUBLE * 32767) / 32768), 4) AS total FROM s GROUP BY stream")
def s1(spark, sf):
    def encode(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "content": [binary.encode_wav(np.asarray(a, np.float32).astype(np.float64), 100) for a in pdf["a"]]})

    files = _rows(spark, sf).select(F.col("stream").cast("string").alias("path"), "a").mapInPandas(encode, "path string, content binary")
    read = binary.decoded(files)
    total = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return read.select("path", "sample_rate", "channels", F.size("samples").cast("long").alias("n"), F.round(total, 4).alias("total"))


@_register("s10_tokenizer", "SELECT CAST(item_id AS INTEGER) AS id, 'p' || CAST(item_id AS VARCHAR) AS piece, item_id % 7 = 0 AS special FROM benchmark")
def s10(spark, sf):
    b = _table(spark, sf, "benchmark").select(F.col("item_id").cast("int").alias("id"), F.concat(F.lit("p"), F.col("item_id").cast("string")).alias("piece"))
    parts = b.groupBy().agg(F.map_from_entries(F.collect_list(F.when(F.col("id") % 7 != 0, F.struct("piece", "id")))).alias("vocab"), F.collect_list(F.when(F.col("id") % 7 == 0, F.struct("id", F.col("piece").alias("content"), F.lit(True).alias("special")))).alias("added_tokens"))
    return inv.tokenizer_vocabulary(parts.select(F.to_json(F.struct(F.struct("vocab").alias("model"), "added_tokens")).alias("json")))


@_register("s20_reports", "SELECT conv_id AS path, count(*) AS segments FROM conversations GROUP BY conv_id")
def s20(spark, sf):
    r = tr.reports(transcripts(spark, sf), {"Model": "tone"})
    return r.select("path", F.regexp_extract("text", "- Segments: ([0-9]+)", 1).cast("long").alias("segments"))
