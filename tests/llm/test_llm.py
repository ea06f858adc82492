"""The training-data operators against brute force, the libraries themselves, and odd inputs."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sonorel.llm import byte_bpe, components, cover_tree, edit_counts, hyperminhash as hm, langid, license_scan, packing, pii, rabitq, warc, word_bpe

DOC = "doc_id long, text string, lang string, source string, n_chars long, row string, key int"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix potions under bright silver moons near old stone bridges".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


def corpus():
    """Nulls, empties, blanks, repeats, near copies, special strings, odd white space, a long text."""
    rng = random.Random(1)
    base = [prose(rng, 60) for _ in range(6)]
    near = [b.replace(" ", "  ", 1) + " tail" for b in base[:3]]
    odd = [None, "", " ", "\n\n", "word", "a b c d", "x <|endoftext|> y", "É ñ 日本 Σσς", "12 34", base[0], base[0], prose(rng, 4000), "    a  b \x1c c", "mail a@b.co call +1 (988) 555-2485 now", "card 4041 8949 7460 8795, 4111111111111111 ip 10.0.0.256 1.2.3.4.5", "Licensed under the Apache License, Version 2.0."]
    texts = base + near + odd
    rows = [(i, t, "en" if i % 2 else None, "s", None if t is None else len(t), "clash", i) for i, t in enumerate(texts)]
    return [*rows, (None, "no id here at all, six words", "en", None, None, None, None), rows[4], rows[0]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# --- tokenizers ---------------------------------------------------------------------------------


def odd_texts():
    rng = random.Random(2)
    made = ["".join(rng.choice(" \n\tab'1.éÉΣİ<　 \x1c\x85") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    return [t or "" for _, t, *_ in corpus()] + made + ["a" * 3000, "It's WE'RE", " ".join(["ab"] * 50)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path(name))
    texts = odd_texts()
    if name.startswith("byte"):
        for t, ids in zip(texts, byte_bpe.Encoder(public_tokenizers.path(name)).encode(pa.array(texts))):
            assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)
        return
    for t, (n, ids, out) in zip(texts, word_bpe.WordBPE(public_tokenizers.path(name)).round_trips(pa.array(texts))):
        want = lib.encode(t, add_special_tokens=False).ids
        assert (n, ids.decode(), out.decode()) == (len(want), " ".join(map(str, want)), lib.decode(want, skip_special_tokens=False)), repr(t)


@pytest.mark.parametrize("entries", [500_000, 3])
def test_chunks_that_share_a_hash_stay_apart(monkeypatch, entries):
    from tokenizers import Tokenizer

    whole = byte_bpe.Chunks._hashes
    monkeypatch.setattr(byte_bpe.Chunks, "_hashes", lambda c: (whole(c)[0] & np.uint64(3), whole(c)[1]))
    enc = byte_bpe.Encoder(byte_bpe.default_path())
    enc.entries = entries
    lib = Tokenizer.from_file(byte_bpe.default_path())
    rng = np.random.default_rng(3)
    words = ["one", "two", "Three", "fünf", "6", "sieben", "x" * 5000, "y" * 5000, ".", "ab"]
    for _ in range(8):  # batches that meet the chunks of earlier ones in another order
        texts = [" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(rng.integers(1, 6))]
        assert [x.tolist() for x in enc.encode(pa.array(texts))] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_merging_skips_stale_entries():
    ranks = {(1 << 17 | 2): (0 << 17 | 5), (2 << 17 | 1): (1 << 17 | 6), (5 << 17 | 5): (2 << 17 | 7)}
    assert word_bpe.merge_word([1, 2, 1, 2], ranks) == [7]
    assert word_bpe.merge_word([2, 1, 2], ranks) == [2, 5]
    assert word_bpe.merge_word([3], ranks) == [3] and word_bpe.merge_word([], ranks) == []


def test_word_round_trips(docs, empty):
    rows = word_bpe.round_trips(docs).collect()
    assert len(rows) == docs.count() and word_bpe.round_trips(empty).count() == 0
    none = next(r for r in rows if r.doc_id == 9)
    assert none.n_tokens == 0 and none.ids_sha256 == hashlib.sha256(b"").hexdigest() == none.decoded_sha256


# --- packing ------------------------------------------------------------------------------------


def test_hilbert_visits_every_cell_in_steps_of_one():
    for dims, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = packing.hilbert(cells, bits)
        assert sorted(key) == list(range(side**dims))
        walk = cells[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_pieces_cover_everything_once(docs, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(byte_bpe.default_path())
    rows = packing.pack(docs, 64).collect()
    line, at = {}, {}
    want = sorted((-1 if i is None else i, len(lib.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, *_ in corpus())
    for r in rows:
        assert 0 < r.length <= 64 and r.offset not in at.setdefault(r.sequence_id, {})
        at[r.sequence_id][r.offset] = r.length
        line.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens, r.ids_crc32))
    for places in at.values():
        end = 0
        for offset in sorted(places):
            assert offset == end
            end += places[offset]
        assert end == 64 or end & (end - 1) == 0
    assert sum(r.length for r in rows) == sum(n for _, n in want)
    for i, t, *_ in corpus():
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        for start, length, total, crc in line[i]:
            if total * 4 == len(ids):
                assert zlib.crc32(ids[4 * start : 4 * (start + length)]) == crc
    assert packing.pack(empty).count() == 0
    assert packing.remainder_sizes(11) == [8, 2, 1]


# --- language ID --------------------------------------------------------------------------------


def test_language_id_learns_and_holds_out(spark, empty):
    rng = random.Random(3)
    vocab = {"aa": "bal dor kin".split(), "bb": "muz fex qui".split(), "cc": "тын сор вел".split()}
    rows = [(i, " ".join(rng.choice(vocab[lang]) + rng.choice(["", "s", "t"]) for _ in range(rng.randint(3, 30))), lang) for i, lang in enumerate(rng.choices(list(vocab), k=500))]
    rows += [(900, None, "aa"), (901, "123 !?", "aa"), (902, "", None), (None, "muz fex", None), (903, "muz " * 50000, None)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert held and sum(r.lang_pred == dict((i, lang) for i, _, lang in rows)[r.doc_id] for r in held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert [by[i].lang_pred for i in (900, 901, 902, None, 903)] == ["und", "und", "und", "bb", "bb"]
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()} == {"und"}


def test_languages_beyond_one_group_are_learned(spark):
    rng = random.Random(19)
    vocab = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(6)] for k in range(90)}
    text = lambda lang: " ".join(rng.choice(vocab[lang]) for _ in range(25))
    names = [lang for k, lang in enumerate(vocab) for _ in range(20 if k < 64 else 7)]
    rows = [(i, text(lang), lang) for i, lang in enumerate(names)]
    once = next(i for i in range(len(rows), len(rows) + 20) if zlib.crc32(str(i).encode()) % 3 != 1)
    vocab["once"] = ["qwrtz", "xxyyq", "zzkkj"]
    rows.append((once, text("once"), "once"))
    fresh = {5000 + k: lang for k, lang in enumerate(vocab)}
    rows += [(i, text(lang), None) for i, lang in fresh.items()]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    rare = {i: lang for i, lang in fresh.items() if lang == "once" or lang >= "l64"}
    assert sum(got[i].lang_pred == lang for i, lang in fresh.items()) / len(fresh) > 0.95
    assert sum(got[i].lang_pred == lang for i, lang in rare.items()) / len(rare) > 0.95 and got[once].lang_pred == "once"
    model = langid.Model(["a", "b", "c"], np.ones(langid.FEATURES), np.eye(langid.FEATURES, 3), 1.0, [0, 2, 3], np.eye(langid.FEATURES, 2), [1.0, 2.0])
    assert abs(model.shares(np.array([0, 5]), np.array([0.6, 0.8])).sum() - 1) < 1e-12


def test_predictions_by_plain_counting(spark):
    rng = random.Random(12)
    words = {"aa": "ono moko tulu raba".split(), "bb": "esti fern whig stad".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(20)), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    df = spark.createDataFrame(rows + [(200, "", "aa"), (201, "123", None), (None, "ono ono", None)], "doc_id long, text string, lang string")
    model = langid.train(df)
    for r in langid.predict(df, model).collect():
        text = {i: t for i, t, _ in rows}.get(r.doc_id, {201: "123", None: "ono ono"}.get(r.doc_id, ""))
        if not re.search("[a-z]", text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        counts = {}
        padded = f" {text.lower()} "
        for at in range(len(padded)):
            h = 0
            for n in range(min(langid.ORDERS, len(padded) - at)):
                h = ((h ^ ord(padded[at + n])) * langid._MULTIPLY[n]) % (1 << 32)
                h ^= h >> 15
                f = h % langid.FEATURES
                counts[f] = counts.get(f, 0) + 1
        x = {f: (1 + math.log(c)) * model.idf[f] for f, c in counts.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        logits = [sum(v / norm * model.weights[f, k] for f, v in x.items()) / model.temperature for k in range(2)]
        p = [math.exp(z - max(logits)) for z in logits]
        best = p.index(max(p))
        assert r.lang_pred == model.languages[best] and abs(r.score - max(p) / sum(p)) < 1e-4
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 3 == 1)


def test_ftrl_is_sparse_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    ftrl = langid.FTRL(50, 2, l1=0.5)
    for _ in range(400):
        y = int(rng.integers(2))
        ftrl.step(np.array([y, 2 + int(rng.integers(48))]), np.array([1.0, 0.3]), y)
    w = ftrl.weights()
    assert w[0, 0] > 0 > w[0, 1] and (w[2:] == 0).mean() > 0.5
    y = (rng.random(4000) < 0.8).astype(int)
    assert abs(langid.best_temperature(np.tile([0.0, 3 * np.log(4)], (4000, 1)), y) - 3) < 0.4


# --- PII ----------------------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def ok(kind, x):
        d = re.sub("[^0-9]", "", x)
        if kind == "ip":
            return all(int(p) <= 255 for p in x.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    found = [(m.start(), k, m.end(), kind) for k, kind in enumerate(PLAIN) for m in re.finditer(PLAIN[kind], text or "") if ok(kind, m.group())]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_pii_base_spans(spark, docs, empty):
    rng = random.Random(5)
    parts = ["a@b.co", ".d@e.f", "x@y", "@", "1.2.3.4", "300.1.1.1", "001.002.003.004", ".5", "4111111111111111", "4111 1111-1111 1111", "+1 (988) 555-2485", "+12", "+", " ", "-", "7", "12", "ü", "😀", "_", "\n", "4" * 25]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(1200)]
    # long runs, on which plain backtracking would be quadratic: the answers are known
    long = {"9" * 200000: "", "a" * 200000: "", "1 " * 50000: "", "+1" + " " * 50000: "", "a@" * 20000: "", "1.2." * 4000: ",".join(f"ip:{a}:{a + 7}" for a in range(0, 16000, 8))}
    texts += list(long)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(docs.select((F.col("doc_id") + 100000).alias("doc_id"), "text"))
    want = dict(enumerate(texts)) | {None if i is None else i + 100000: t for i, t, *_ in corpus()}
    rows = pii.find(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        text = want[r.doc_id]
        base = long[text] if text in long else plain_spans(text)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), text[:200]
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
        assert r.n_email == base.count("email") and r.n_phone == base.count("phone") and 0 <= r.score <= 1
    assert pii.find(empty).count() == 0


def test_pii_adds_and_masks(spark):
    text = "contact me: bob.smith [at] mail.com or call (212) 555-7890, a@b.co 4111111111111111."
    many = [(i, f"call +1 (988) 555-{2000 + i} or mail u{i}@x.com") for i in range(30)]
    df = spark.createDataFrame([*many, (99, text), (100, None)], "doc_id long, text string").withColumn("n_chars", F.length("text"))
    row = next(r for r in pii.find(df).collect() if r.doc_id == 99)
    assert row.n_email == 1 and row.n_added >= 1 and "phone:" in row.spans
    masked = {r.doc_id: r for r in pii.redacted(df).collect()}
    assert "555-7890" not in masked[99].text and "[CARD]" in masked[99].text and masked[99].n_chars == len(masked[99].text)
    assert masked[0].text == "call [PHONE] or mail [EMAIL]" and masked[100].text is None


def test_expectation_maximisation_finds_the_bad_labeler():
    rng = random.Random(6)
    counts = {}
    for _ in range(4000):
        y = 1 if rng.random() < 0.6 else -1
        v = (y if rng.random() < 0.95 else -y, y if rng.random() < 0.9 else -y, y if rng.random() < 0.55 else -y)
        counts[v] = counts.get(v, 0) + 1
    prior, acc, post = pii.expectation_maximisation(counts)
    assert abs(prior - 0.6) < 0.05 and acc[0] > 0.9 > 0.7 > acc[2] and post[1, 1, -1] > 0.9


# --- licences -----------------------------------------------------------------------------------


def plain_scan(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    at, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        hit = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += hit
        labels |= {label} if hit else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licence_scan(spark, docs, empty):
    rng = random.Random(7)
    parts = "GNU General public license apache Apache-License cc BY by mit MIT. x É".split()
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this nice software and associated documentation files"
    texts += [grant, "mit license " * 20000, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    want = dict(enumerate(texts)) | {None if i is None else i + 1000: t for i, t, *_ in corpus()}
    rows = license_scan.scan(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_scan(want[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert next(r for r in rows if r.doc_id == 300).labels == "mit-text"
    assert license_scan.scan(empty).count() == 0


def plain_cover(words, template):
    """The largest share of a template's word pairs that a text holds in order, with at most one shift of up to two words."""
    t = template.split()
    m, best = len(t) - 1, 0
    pair = {i: (words[i], words[i + 1]) for i in range(len(words) - 1)}
    here = sorted({i - j for i, p in pair.items() for j in range(m) if p == (t[j], t[j + 1])})
    for at in here:
        for shift in (-2, -1, 0, 1, 2):
            for split in range(m + 1):
                skip = max(0, -shift)
                got = sum(pair.get(at + j) == (t[j], t[j + 1]) for j in range(split))
                got += sum(pair.get(at + shift + j) == (t[j], t[j + 1]) for j in range(split + skip, m))
                best = max(best, got)
    return best / m


def test_licence_spans_are_verified(spark):
    rng = random.Random(71)
    notices = list(license_scan.NOTICES)
    texts = ["this source this source this source this source code form is subject to the terms of"]
    for _ in range(150):
        words = rng.choice(notices).split()
        for _ in range(rng.randint(0, 4)):
            at, how = rng.randrange(len(words)), rng.randint(0, 3)
            words[at : at + 1] = [[], ["new", words[at]], ["other"], words[max(0, at - 3) : at + 1]][how]
        texts.append(" ".join([rng.choice(WORDS) for _ in range(rng.randint(0, 4))] + words + [rng.choice(WORDS)]))
    texts += [notices[7] + " " + notices[8], "GNU GENERAL PUBLIC LICENSE \u212a", "l\u0130cense apache license"]
    rows = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        cover = {t: plain_cover(words, t) for t in notices}
        phrases = {x for p, x in license_scan.PHRASES.items() if f" {p} " in f" {' '.join(words)} "}
        assert set(filter(None, rows[i].labels.split(","))) == phrases | {license_scan.NOTICES[t] for t, c in cover.items() if c >= license_scan.COVERED}
        assert abs(rows[i].score - max([*cover.values(), float(bool(phrases))])) < 1e-12
    assert rows[0].labels == "" and sum(bool(r.labels) for r in rows.values()) > 40


# --- components and pairs -----------------------------------------------------------------------


def smallest_reachable(nodes, edges):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(low[a], low[b])
            changed |= (low[a], low[b]) != (m, m)
            low[a] = low[b] = m
    return low


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)] + [(i, i + 1) for i in range(200, 230)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(edges, "u long, v long")
    real = [(a, b) for a, b in edges if a is not None and a != b]
    got = {r.node: r.component for r in components.components(df).collect()}
    assert got == smallest_reachable({n for e in real for n in e}, real)
    assert components.components(df.where("false")).count() == 0


def test_near_duplicates(spark, docs, empty):
    rng = random.Random(9)
    base = [prose(rng, rng.choice([3, 8, 60, 200])) for _ in range(40)]
    texts = []
    for b in base:
        w = b.split()
        texts.append(b)
        for _ in range(rng.randint(0, 5)):
            v = list(w)
            for _ in range(max(1, len(w) // rng.choice([20, 40, 80]))):
                v[rng.randrange(len(v))] = "new" + str(rng.randint(0, 9))
            texts.append(" ".join(v).upper() if rng.random() < 0.2 else " ".join(v))
    rows = list(enumerate(texts)) + [(5000 + k, t) for k, (_, t, *_) in enumerate(corpus())] + [(None, texts[0]), (3, texts[3])]
    sets = {}
    for i, t in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)})
        w = [x for x in re.split("[\x20\x09-\x0d]+", w) if x]
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    ids = [i for i, s in sets.items() if s and i is not None]
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    low = smallest_reachable([i for i in sets if i is not None], edges)
    got = hm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == (None if r.doc_id is None else low[r.doc_id]), r
        assert r.kept == (r.doc_id == r.component_id)
    assert hm.near_duplicates(empty).count() == 0


def test_deduplicated_follows_texts(spark, empty):
    rng = random.Random(33)
    a, b, c = (prose(rng, 50) for _ in range(3))
    rows = [(1, a), (1, b), (2, c), (3, a), (4, b + " x"), (2, c), (5, None), (5, ""), (None, a), (6, "two words"), (7, "two words")]
    df = spark.createDataFrame([(i, t, i, "r", b"d") for i, t in rows], "doc_id long, text string, _gone long, row string, digest binary")
    got = hm.deduplicated(df)
    assert got.columns == df.columns
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "") for r in got.collect()) == sorted([(1, a), (1, b), (2, c), (5, ""), (-1, a), (6, "two words")])
    assert hm.deduplicated(empty).count() == 0 and hm.deduplicated(empty).columns == empty.columns


def test_links_hold_for_the_shingles_themselves():
    from sonorel.llm.shingles import linked, shingle_set, truly_linked

    rng = random.Random(34)
    for _ in range(200):
        x = prose(rng, rng.randint(0, 30)).split()
        y = [w if rng.random() < 0.97 else "z" for w in x]
        s, t = " ".join(x), " ".join(y)
        assert truly_linked(s, t) == bool(len(shingle_set(s)) and len(shingle_set(t)) and linked(shingle_set(s), shingle_set(t)))


def test_session_settings_stay(spark, docs):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    hm.near_duplicates(docs).count()
    packing.pack(docs).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_open_buckets_are_finished(spark):
    """A chain in which the smallest document links to few: stars alone would leave it in pieces."""
    rng = random.Random(10)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for k in range(14):
        texts.append(" ".join(words))
        for _ in range(3):
            words[rng.randrange(400)] = f"z{k}{rng.randint(0, 99)}"
    rows = list(enumerate(texts))
    sets = [{tuple(t.split()[j : j + 5]) for j in range(396)} for t in texts]
    edges = [(a, b) for a in range(14) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    low = smallest_reachable(range(14), edges)
    got = {r.doc_id: r.component_id for r in hm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == low


def test_register_estimates():
    rng = np.random.default_rng(11)
    for j in (0.5, 0.85, 0.95):
        est = []
        for _ in range(20):
            both = rng.integers(0, 2**63, int(2000 * j), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, int(1000 * (1 - j)), dtype=np.uint64)])) for _ in range(2))
            est.append(hm.estimate(hm.registers(a)[None], hm.registers(b)[None], np.array([len(a)]), np.array([len(b)]))[0][0])
        assert abs(np.mean(est) - j) < 0.03
    assert (hm.densify(hm.registers(np.array([7], np.uint64))) != hm.EMPTY).all()


# --- vectors ------------------------------------------------------------------------------------


def vectors(rng, n=260, dim=16):
    x = rng.normal(size=(n, dim)).astype(np.float32)
    for i in range(0, 120, 3):
        x[i + 1] = x[i] if i % 2 else x[i] + 0.12 * rng.normal(size=dim)
    x[200:240] = x[199] + 0.08 * rng.normal(size=(40, dim))
    x[250:] = x[249]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(300, None, 1), (350, [0.0] * dim, 1), (400, [float("nan")] * dim, 1), (450, [], 1), (500, [None] + [1.0] * (dim - 1), 1), (None, x[0].tolist(), 1), (600, [1.0, 2.0], 1), (650, [1.0, 2.0], 1)]
    return rows


def plain_cosine(a, b):
    a, b = np.asarray(a, np.float32).astype(float), np.asarray(b, np.float32).astype(float)
    return (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))


def usable(rows):
    return {i: v for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}


def test_cover_tree_pairs(spark):
    rows = vectors(np.random.default_rng(12))
    ok = usable(rows)
    ids = list(ok)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if len(ok[a]) == len(ok[b]) and plain_cosine(ok[a], ok[b]) >= 0.95]
    low, degree = smallest_reachable([i for i, *_ in rows if i is not None], edges), {}
    for a, b in edges:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for block in (4096, 40):
        got = cover_tree.linked_vectors(df, block=block).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_links, r.component_id) == (degree.get(r.vec_id, 0), low.get(r.vec_id)), r
            assert r.kept == (r.vec_id == r.component_id)
    assert cover_tree.linked_vectors(df.where("false")).count() == 0


def test_cells_and_blocks_lose_no_link(spark, monkeypatch):
    """Blocks of eight classes, cells that bounds rule out, and two vector lengths, against brute force."""
    rng = np.random.default_rng(21)
    middles = rng.normal(size=(10, 12))
    made = [m + rng.normal(size=12) * rng.choice([0.05, 0.3]) for m in middles for _ in range(30)] + [rng.normal(size=5) for _ in range(40)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(made)]
    rows += [(1000 + i, rows[7 * i][1]) for i in range(20)]
    ok = {i: np.asarray(v) / np.linalg.norm(v) for i, v in rows}
    edges = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.95]
    low, degree = smallest_reachable(ok, edges), Counter(x for e in edges for x in e)
    seen = []
    plain = cover_tree._block_pairs
    monkeypatch.setattr(cover_tree, "_block_pairs", lambda heads, *rest: seen.append((heads.count(), plain(heads, *rest).count())) or plain(heads, *rest))
    got = cover_tree.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=8).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (degree[i], low[i]) for i in ok}
    (blocks, pairs), = seen
    assert blocks >= 40 and pairs < blocks * (blocks + 1) / 4


def test_huge_and_tiny_vectors_take_part(spark):
    rows = [(0, [1e200, 1e200]), (50, [1e-200, 1e-200]), (2, [1.0, 1.0]), (3, [5e-324, 0.0]), (4, [1.0, -1.0]), (5, [0.0, 0.0]), (6, [1e308, 1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in cover_tree.linked_vectors(df).collect()}
    assert got == {0: (3, 0), 50: (3, 0), 2: (3, 0), 6: (3, 0), 3: (0, 3), 4: (0, 4), 5: (0, 5)}
    near = {(r.query_id, r.rank): r.vec_id for r in rabitq.nearest(df).collect()}
    assert [near[50, k] for k in (1, 2, 3)] == [0, 2, 6] and near[0, 1] in (2, 6, 50)


def test_cover_tree_is_one():
    x = np.random.default_rng(13).normal(size=(300, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = cover_tree.CoverTree(x, lowest=0.1)
    for level, (centres, radius, parent) in enumerate(tree.levels):
        if level:
            assert set(tree.levels[level - 1][0]) <= set(centres)
            above = tree.levels[level - 1][0][parent]
            assert (np.linalg.norm(x[centres] - x[above], axis=1) <= tree.levels[level - 1][1][parent] + 1e-9).all()
    found = np.zeros((300, 300), bool)
    for i, j in cover_tree.links_between(x, None, 0.9):
        found[i, j] = True
    want = np.triu(x @ x.T >= 0.9, 1)
    assert (found | found.T == (want | want.T)).all()


def test_one_bit_codes(spark):
    rows = vectors(np.random.default_rng(14))
    ok = usable(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in rabitq.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    queries = [i for i in ok if i % 50 == 0]
    assert set(got) == set(queries)
    hits = total = 0
    for q in queries:
        want = sorted(((-plain_cosine(ok[q], ok[i]), i) for i in ok if i != q and len(ok[i]) == len(ok[q])))[:5]
        mine = sorted(got.get(q, []))
        assert [r for r, *_ in mine] == list(range(1, len(want) + 1))
        assert all(abs(s - plain_cosine(ok[q], ok[i])) < 1e-12 for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & {i for _, i in want})
        total += len(want)
    assert hits / total >= 0.9
    assert rabitq.nearest(df.where("false")).count() == 0


def test_nearest_equal_their_sql(spark, tmp_path):
    import duckdb

    from sonorel.llm import queries

    rows = vectors(np.random.default_rng(15))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(f"select query_id, rank, vec_id, score from ({queries.OP9_SQL})").fetchall()
    got = queries.queries()["op9_one_bit_codes"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and want


def test_error_bounds_hold():
    rng = np.random.default_rng(15)
    x, q = (rng.normal(size=(n, 64)) for n in (2000, 50))
    x, q = x / np.linalg.norm(x, axis=1, keepdims=True), q / np.linalg.norm(q, axis=1, keepdims=True)
    rotate = rabitq.rotation(64)
    est, err = rabitq.estimates(*rabitq.encode(x, rotate), q, rotate)
    assert (np.abs(est - q @ x.T) <= err).mean() > 0.999


# --- WARC ---------------------------------------------------------------------------------------


def one(i, body, extra=b""):
    digest = base64.b32encode(hashlib.sha1(body).digest())
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Payload-Digest: sha1:%s\r\n%sContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, digest, extra, len(body), body)


def test_salvage_finds_what_is_left():
    parts = [one(i, b"body %d WARC/1.1\r\n" % i * 3) for i in range(6)]
    whole, gaps = warc.salvage(b"".join(parts))
    assert len(whole) == 6 and not gaps
    bad = bytearray(b"".join(parts))
    bad[len(parts[0]) + len(parts[1]) - 10] ^= 1
    found, gaps = warc.salvage(bytes(bad))
    assert [r.headers["warc-record-id"] for r in found] == [f"<urn:page:{i}>" for i in (0, 2, 3, 4, 5)]
    assert gaps == [(len(parts[0]), len(parts[0]) + len(parts[1]), "digest")]
    members = [gzip.compress(p, mtime=0) for p in parts]
    torn = members[0] + members[1][:-9] + b"junk" + members[2] + parts[3] + members[4][:20]
    found, gaps = warc.salvage(torn)
    assert [r.headers["warc-record-id"] for r in found] == [f"<urn:page:{i}>" for i in (0, 2, 3)]
    assert [g[:2] for g in gaps] == [(len(members[0]), len(members[0]) + len(members[1]) - 5), (len(torn) - 20, len(torn))]
    assert warc.salvage(b"") == ([], []) and warc.salvage(b"nothing")[1] == [(0, 7, "no version line")]


def test_salvage_inside_gzip_members():
    ids = lambda found: [int(r.headers["warc-record-id"][10:-1]) for r in found]
    rng = random.Random(18)
    parts = [one(i, rng.randbytes(3000)) for i in range(60)]
    pack = lambda ps, level=9: gzip.compress(b"".join(ps), level, mtime=0)
    hollow = gzip.compress(b"", mtime=0)
    members = [pack([p]) for p in parts[:3]]
    found, gaps = warc.salvage(hollow + members[0] + hollow + hollow + members[1] + members[2] + hollow)
    assert ids(found) == [0, 1, 2] and not gaps
    wrong = bytearray(b"".join(parts))
    wrong[sum(map(len, parts[:7])) - 10] ^= 1
    both = gzip.compress(bytes(wrong), mtime=0) + members[1]
    found, gaps = warc.salvage(both)
    assert ids(found) == [*range(6), *range(7, 60), 1] and gaps == [(0, len(both) - len(members[1]), "digest")]
    for level in (0, 9):
        whole = pack(parts, level)
        found, gaps = warc.salvage(whole[: len(whole) // 2])
        assert ids(found) == list(range(len(found))) and len(found) in (28, 29, 30) and gaps == [(0, len(whole) // 2, "the member is cut short")]
        hurt = bytearray(whole)
        hurt[len(whole) // 2] ^= 0x55
        found, gaps = warc.salvage(bytes(hurt) + members[2])
        assert ids(found)[:28] == list(range(28)) and ids(found)[-1] == 2 and gaps[0][0] == 0
        assert len(found) > 55 if level == 0 else len(found) in (29, 30, 31) and gaps[0][1] == len(whole)
        assert all(r.block == parts[i].split(b"\r\n\r\n", 1)[1][:-4] for i, r in zip(ids(found), found)) and len(set(ids(found[:-1]))) == len(found) - 1
        found, gaps = warc.salvage(whole[: len(whole) // 2] + parts[59] + members[0])
        assert ids(found)[:28] == list(range(28)) and ids(found)[-2:] == [59, 0] and len(gaps) == 1
    found, gaps = warc.salvage(pack(parts[:2])[:-4])
    assert ids(found) == [0, 1] and gaps[0][2] == "the member is cut short"


def test_warc_round_trip(spark):
    rows = [(5, "u5", "<p>é same</p>"), (2, "u2", "<p>é same</p>"), (3, None, None), (4, "u\n4", ""), (9, "u9", "x\r\n\r\nWARC/1.1\r\ny"), (None, "u", "alone"), (7, "u7", "z" * 100000), (8, "u8", "z" * 100000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("clash"))
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    got = warc.round_trip(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, _, h in rows:
        raw = (h or "").encode()
        want = None if i is None or first[h or ""] == i else first[h or ""]
        assert (by[i].payload_bytes, by[i].payload_digest, by[i].record_type, by[i].refers_to) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if want is not None else "response", want)
    assert warc.round_trip(df.where("false")).count() == 0


# --- edits --------------------------------------------------------------------------------------


def test_edits_equal_a_full_count(docs, empty):
    enc = byte_bpe.encoder(byte_bpe.default_path())
    rng = random.Random(16)
    for _ in range(300):
        t = "".join(rng.choice(" \n ab'1.é") for _ in range(rng.randint(0, 500)))
        chunks = edit_counts.split(t)
        tree = edit_counts.TokenTree(chunks, [len(enc.raw(c)) for c in chunks], enc)
        for _ in range(6):
            s, d, ins = rng.randint(0, len(t)), rng.randint(0, 40), "".join(rng.choice(" \n ab'1.") for _ in range(rng.choice([0, 3, 12, 900])))
            tree.edit(s, d, ins)
            t = t[:s] + ins + t[s + d :]
            assert tree.total == len(enc.raw(t)) and tree.text() == t
    rows = edit_counts.count_edits(docs).collect()
    assert len(rows) == docs.count() and edit_counts.count_edits(empty).count() == 0
    long = next(r for r in rows if r.n_tokens > 5000)
    assert long.n_chars_reencoded < long.n_chars_edited / 50


def test_kept_trees_take_edits_in_turn(spark, docs, empty):
    enc = byte_bpe.encoder(byte_bpe.default_path())
    rows = [(1, "one two three", [(4, 4, "2 "), None, (None, None, "zero ")]), (2, None, [(0, 5, "new")]), (3, "text", None), (4, "", [(-3, 99, None)])]
    df = spark.createDataFrame(rows, "doc_id int, text string, e array<struct<start:int,deleted:int,inserted:string>>")
    kept = edit_counts.trees(df, edits=F.col("e"))
    once = edit_counts.apply_edits(kept, F.col("edits"))
    assert {r.doc_id: r.text for r in once.collect()} == {1: "zero one 2 three", 2: "new", 3: "text", 4: ""}
    twice = edit_counts.apply_edits(once, edit_counts.standard_edits(F.col("text"))).collect()
    for r in [*once.collect(), *twice]:
        assert r.n_tokens == len(enc.raw(r.text)) and sum(np.frombuffer(r.counts, "<u4")) == r.n_tokens and sum(np.frombuffer(r.lengths, "<u4")) == len(r.text) == r.n_chars
    for r in edit_counts.apply_edits(edit_counts.trees(docs), edit_counts.standard_edits(F.col("text"))).collect():
        assert r.n_tokens == len(enc.raw(r.text))
    assert edit_counts.trees(empty).count() == 0


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    rng = random.Random(17)
    kept = [(1000 + i, prose(rng, 40), "en", "s", 0, None, None) for i in range(20)]
    table = docs.unionByName(spark.createDataFrame(kept, DOC))
    first = corpus_pipeline.keep_recognised(spark, table, "")
    assert first.columns == table.columns and first.where("text is null or text = ''").count() == 0 and first.where("doc_id >= 1000").count() == 20
    second = corpus_pipeline.keep_one_of_each(spark, first, "")
    assert second.columns == table.columns and second.where("doc_id = 0").count() == 1 and second.where("doc_id in (18, 19)").count() == 0
    third = corpus_pipeline.mask_personal_data(spark, second, "")
    assert third.columns == table.columns and third.count() == second.count() and third.where("text like '%555-2485%'").count() == 0
    assert corpus_pipeline.pack_sequences(spark, third, "").select("doc_id").distinct().count() == third.select("doc_id").distinct().count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "pii", "packing"]
