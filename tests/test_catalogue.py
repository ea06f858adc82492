"""Each registered query of the speech operators against its SQL text on the smallest tables."""

import math
import os
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sonorel.plans import catalogue, layers  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def shown(v):
    if isinstance(v, list):
        return "[" + ",".join(map(shown, v)) + "]"
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(name, spark, duck):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    theirs = sorted(tuple(shown(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert ours == theirs
    assert ours


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def same(ours, theirs, cols):
    """Equal as sets of rows, floats up to the last rounded digit."""
    key = lambda row: tuple(repr(v) for v in row if not isinstance(v, float))
    ours, theirs = (sorted((tuple(v + 0.0 if isinstance(v, float) else float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in rows), key=key) for rows in (ours, theirs))
    assert len(ours) == len(theirs) and [key(r) for r in ours] == [key(r) for r in theirs]
    for a, b in zip(ours, theirs):
        assert all(x == y or isinstance(x, float) and abs(x - y) <= 2e-6 * max(1, abs(y)) for x, y in zip(a, b)), (cols, a, b)


def against_whole(name, spark, duck):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    ours = [tuple(r[c] for c in cols) for r in df.collect()]
    same(ours, [tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()], cols)
    return ours, cols


@pytest.mark.parametrize("name", ["w2_reflect_frames", "w3_plain_frames", "w4_zero_frames", "x5_power", "j7_melapply", "x8_lognorm", "a5_utterance", "a6_perfeature"])
def test_every_stream_is_framed(name, spark, duck):
    ours, cols = against_whole(name, spark, duck)
    least = 32 if name == "w3_plain_frames" else 1
    users = {r[0] for r in duck.execute(f"select user_id from events group by user_id having count(*) >= {least}").fetchall()}
    assert max(users) >= 12 and {r[cols.index("stream")] for r in ours} == users


@pytest.mark.parametrize("name, column", [("f2_sanitize", "name"), ("f4_parse_output", "text")])
def test_texts_are_read_to_their_end(name, column, spark, duck):
    ours, cols = against_whole(name, spark, duck)
    assert max(len(r[cols.index(column)]) for r in ours) > 1000


def test_repetition_is_of_each_text(spark, duck, tmp_path):
    against_whole("o8_repetition", spark, duck)
    free = "".join(chr(97 + (i * i + i // 7) % 23) for i in range(300))
    texts = ["a" * 127, "a" * 128, free + "a" * 96, free + "abcdefghijklmnop" * 6, free, free[:40] + "abcde" * 40]
    rows = [(4 * i + k, t) for i, t in enumerate(texts) for k in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.loops for r in catalogue.queries()["o8_repetition"](spark, str(tmp_path)).collect()}
    assert got == {i: (False, True, True, True, False, True)[i // 4] for i, _ in rows}


def test_every_stream_is_diarized(spark, tmp_path):
    rows = [(u * 1000 + i, u, i, 400.0 if i % 20 < 10 else 0.0) for u in (3, 40, 977) for i in range(40)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = catalogue.queries()["g11_diarize_stub"](spark, str(tmp_path)).collect()
    texts = {p: sorted((r.idx, r.start_s, r.end_s, r.text) for r in got if r.path == p) for p in ("3", "40", "977")}
    assert {r.path for r in got} == set(texts) and texts["3"] and texts["3"] == texts["40"] == texts["977"]


def test_groups_settle_beyond_six_rounds(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(10000, 64)) * np.where(np.arange(64) < 4, 1.0, 0.01))[:2500]
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got, six, all_rounds = ({tuple(r) for r in rows} for rows in (catalogue.queries()["g3_kmeans"](spark, str(tmp_path)).collect(), con.execute(catalogue._kmeans_sql()).fetchall(), con.execute(catalogue._kmeans_sql(rounds=25)).fetchall()))
    assert got == all_rounds and got != six


def test_long_streams_are_diarized(spark, tmp_path):
    """Two streams of 20,000 values, 96 million samples each."""
    rows = spark.range(40000).selectExpr("id as event_id", "id % 2 as user_id", "id as ts", "case when id div 2 % 20 < 10 then 400.0d else 0.0d end as value")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    began = time.perf_counter()
    got = catalogue.queries()["g11_diarize_stub"](spark, str(tmp_path)).groupBy("path").agg(F.count("*").alias("n"), F.min("start_s").alias("first"), F.max("end_s").alias("last")).collect()
    assert {r.path: (r.n, r.first) for r in got} == {p: (1000, 0.0) for p in ("0", "1")}
    assert all(5997 <= r.last <= 5998 for r in got) and time.perf_counter() - began < 60


def test_mebibytes_round_as_sql(spark, tmp_path):
    rng = np.random.default_rng(5)
    sizes = [None, 0, 1, -1, -40, 52, 53, 32768, -32768, 98304, 163840, 229376, 2**63 // 1000, -(2**63) // 1000 + 1, *range(1047, 1060), *(32768 * k for k in range(1, 200)), *(int(v) for v in rng.integers(0, 2**24, 2000)), *(int(v) for v in rng.integers(2**40, 2**53, 500))]
    spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got, want = ({r[0]: r[1] for r in rows} for rows in (catalogue.queries()["f11_mebibytes"](spark, str(tmp_path)).collect(), con.execute(catalogue.oracle_sql()["f11_mebibytes"]).fetchall()))
    assert got == want and len(got) == len(sizes)
    assert [got[sizes.index(n)] for n in (32768, 98304, None)] == ["31.2 MiB", "93.8 MiB", None]
