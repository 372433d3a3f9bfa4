"""License scans, sharding, top-k and quality: edge rows and brute force."""

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketry.llm import licenses, quality, sharding, topk

from .conftest import rows_of


# ---- license scans

def test_license_texts_in_other_dress(spark):
    mit = next(t for i, t in licenses.KNOWN if i == "MIT")
    dressed = ("Copyright (c) 2024 Somebody\n\n" + mit.upper().replace("SUBLICENSE", "sub-license").replace(" ", "   ")
               .replace(",", " ,") + "\n© 2023 Someone Else. All rights reserved.")
    docs = spark.createDataFrame([(1, dressed), (2, mit + " more"), (3, "x\nReleased under the MIT Licence!\ny")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(docs, licenses.known_licenses(spark)).collect()}
    assert got[1].license == "MIT"
    assert got[2].license is None and got[2].n_notices == 0
    assert got[3].license is None and got[3].notices == "MIT" and got[3].n_notices == 1


def test_whole_texts_of_long_licenses(spark):
    texts = {p.stem: p.read_text("utf-8") for p in licenses.TEXTS.glob("*.txt")}
    assert {"Apache-2.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "CC0-1.0"} == set(texts)
    dress = lambda t: "Copyright 2024 Somebody\n\n" + t.upper().replace("\n", "\r\n ")
    rows = [(i, t) for i, t in texts.items()] + [(i, dress(t)) for i, t in texts.items()]
    rows += [(i, t.split(licenses.TERMS_END)[0] + licenses.TERMS_END) for i, t in texts.items() if licenses.TERMS_END in t]
    assert len(rows) == 26
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = licenses.license_scan(docs, licenses.known_licenses(spark)).collect()
    assert len(got) == 26 and all(r.license == r.doc_id for r in got)


def test_long_licenses_are_in_the_sql_too(spark):
    import duckdb
    rows = list(enumerate(p.read_text("utf-8") for p in sorted(licenses.TEXTS.glob("*.txt")))) + [(99, "Licensed under CC BY 4.0.\nx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    got = licenses.license_scan(docs, licenses.known_licenses(spark))
    cols = got.columns
    assert rows_of(got) == sorted(con.execute(f"select {', '.join(cols)} from ({licenses.oracle_sql()})").fetchall(), key=repr)


def test_license_edges(spark, edges, nothing):
    known = licenses.known_licenses(spark)
    got = licenses.license_scan(edges, known)
    assert got.count() == edges.count()
    assert all(r.license is None for r in got.collect())
    assert licenses.license_scan(nothing, known).count() == 0
    assert {r.license for r in licenses.license_scan(edges, known.where("false")).collect()} == {None}


def test_license_repeated_spellings_share_no_blank(spark):
    docs = spark.createDataFrame([(1, "licence licence licence")], "doc_id long, text string")
    known = spark.createDataFrame([("L", "license license license"), ("M", "license license license"), (None, "x"), ("E", "")], "license_id string, text string")
    assert licenses.license_scan(docs, known).first().license == "L"


def test_license_shuffle_joins_give_the_same(spark, documents, edges, monkeypatch):
    known = licenses.known_licenses(spark)
    small = [rows_of(licenses.license_scan(d, known)) for d in (documents, edges)]
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 0)
    assert [rows_of(licenses.license_scan(d, known)) for d in (documents, edges)] == small


# ---- sharding

@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 25, 97, 1000, 4097])
def test_feistel_is_a_permutation(n):
    assert sorted(sharding.position(i, n, 42) for i in range(n)) == list(range(n))


def test_feistel_columns_match_plain_numbers(spark):
    n = 1000
    got = spark.range(n).select("id", sharding.walked(F.col("id"), n, 7).alias("p")).collect()
    assert all(r.p == sharding.position(r.id, n, 7) for r in got)


def test_sharding_law(documents):
    got = sharding.feistel_shards(documents).collect()
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 24
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    again = sharding.feistel_shards(documents.repartition(7))
    assert rows_of(again) == sorted(map(tuple, got), key=repr)  # does not depend on how the input is stored


def test_sharding_edges(edges, nothing):
    got = sharding.feistel_shards(edges, 5).collect()
    assert len(got) == edges.count()
    assert sorted((r.shard, r.slot) for r in got) == sorted({(r.shard, r.slot) for r in got})
    assert sharding.feistel_shards(nothing).count() == 0


# ---- exact top-k

def brute_topk(vectors, k):
    ints = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in vectors]
    out = []
    for a, (qi, qv) in enumerate(ints):
        if qi is None or qi % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(qv, cv)), ci is None, ci) for b, (ci, cv) in enumerate(ints) if b != a)[:k]
        out += [(qi, r + 1, c[2], -c[0]) for r, c in enumerate(scored)]
    return sorted(out, key=repr)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 1, 2, 50, 51, 100]), st.lists(st.floats(-4, 4, width=32), min_size=5, max_size=5)), min_size=1, max_size=14))
def test_topk_against_brute_force(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = rows_of(topk.exact_topk(df, "vec_id % 50 = 0", k=3, dim_block=2, query_block=2))
    assert got == brute_topk(vectors, 3)


def test_topk_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (1, None, 1), (2, [nan, 1.0], 1), (3, [inf, 1.0], 1), (4, [None, 1.0], 1), (5, [], 1),
            (6, [0.5], 1), (None, [2.0, 2.0], 1), (7, [2.0, 2.0], 1), (8, [2.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, row int")
    got = topk.exact_topk(df, "vec_id % 50 = 0", k=3).collect()
    assert len(got) == 6 and {r.query_id for r in got} == {0}
    assert sorted((r["rank"], r.vec_id) for r in got) == [(1, 7), (1, 7), (2, 8), (2, 8), (3, None), (3, None)]
    assert topk.exact_topk(df.where("false"), "vec_id % 50 = 0").count() == 0
    assert topk.exact_topk(df.where("vec_id > 5"), "vec_id % 50 = 0").count() == 0


def test_topk_large_components_stay_exact(spark):
    big = 2.0 ** 22
    df = spark.createDataFrame([(0, [big, 1.0]), (1, [big, 1.0]), (2, [big, 0.99609375]), (3, [big, -1.0])], "vec_id long, embedding array<float>")
    got = sorted((r["rank"], r.vec_id, r.score) for r in topk.exact_topk(df, "vec_id % 50 = 0", k=2).collect())
    assert got == [(1, 1, 2 ** 60 + 65536), (2, 2, 2 ** 60 + 256 * 255)]


# ---- quality rules

def brute_stats(text):
    words = "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in text).split(" ")
    words = [w for w in words if w]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    marked = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if any(c not in " \t\n\x0b\x0c\r" for c in line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é#|\n\t\x0b\x85  ", max_size=60))
def test_quality_stats_against_brute_force(text):
    assert quality.text_stats(text)[0] == brute_stats(text)


def test_quality_over_labels(spark, documents):
    got = {r.doc_id: r for r in quality.quality(documents).collect()}
    for r in documents.collect():
        g = got[r.doc_id]
        assert [g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words] == brute_stats(r.text)
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words)
        assert not (g.base_failed and g.kept)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    pairs = [(r.quality, got[r.doc_id].kept) for r in labels if not got[r.doc_id].base_failed]
    assert np.mean([bool(a) == b for a, b in pairs]) > 0.95


def test_quality_estimate_finds_rule_accuracy():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.6])
    correct = rng.random((20_000, 4)) < right
    votes = np.where(correct == good[:, None], quality.GOOD, quality.BAD)
    patterns, inverse, counts = np.unique((votes * 3 ** np.arange(4)).sum(1), return_inverse=True, return_counts=True)
    fit = quality.estimate(quality.votes_of(patterns, 4), counts)
    assert abs(fit["prior"] - 0.8) < 0.02
    assert np.abs(fit["table"][:, 1, quality.GOOD] - right).max() < 0.03
    assert np.mean((fit["posterior"][inverse] >= 0.5) == good) > 0.93


def test_quality_edges(edges, nothing):
    got = quality.quality(edges).collect()
    assert len(got) == edges.count()
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in got if r.doc_id in (2, 3, 4))
    assert quality.quality(nothing).count() == 0
