"""Rolled files, rows alike in id and text, encrypted keys, numbers in small groups, few long texts."""

import base64
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import mixing, pii, secrets, sharding, topk, toxicity
from basketry.llm.common import whole_files

from .conftest import SF01, rows_of
from .test_text_scans import der, integer


@pytest.fixture(params=[4, 100])
def rolled(spark, request):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", request.param)
    yield
    spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_shards_are_a_permutation_when_files_roll(spark, rolled, documents):
    got = sharding.feistel_shards(documents).collect()
    assert len({(r.shard, r.slot) for r in got}) == len(got) == documents.count()
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all({r.slot for r in got if r.shard == s} == set(range(n)) for s, n in sizes.items())


def test_top_k_when_files_roll(spark, rolled):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 5))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    v = np.floor(256 * x).astype(int)
    want = []
    for q in range(0, 120, 6):
        scores = v @ v[q]
        best = sorted((i for i in range(120) if i != q), key=lambda i: (-scores[i], i))[:5]
        want += [(q, k + 1, i, int(scores[i])) for k, i in enumerate(best)]
    assert rows_of(topk.exact_topk(docs, "vec_id % 6 = 0", query_block=3)) == sorted(want, key=repr)


def test_whole_files_number_rows_once(spark, rolled):
    got = whole_files(spark.range(1000).repartition(3), "t").select("_file", "_row").collect()
    assert len(set(got)) == 1000


def test_rows_that_differ_beside_id_and_text_are_all_mixed(spark):
    docs = spark.createDataFrame([(1, "a b c d", "s", "en"), (1, "a b c d", "s", "de"), (2, "x y", "t", None), (2, "x y", "t", None)],
                                 "doc_id long, text string, source string, lang string")
    goals = {r.doc_id: r for r in mixing.mix(docs).collect()}
    got = Counter(tuple(r) for r in mixing.mixed_documents(docs).collect())
    assert set(got) == {tuple(r) for r in docs.collect()} or goals[1].target < 8
    total = Counter()
    for r in mixing.mix(docs).collect():
        total[r.doc_id] += r.copies
    assert {i: sum(n for k, n in got.items() if k[0] == i) for i in (1, 2)} == total
    en, de = got[(1, "a b c d", "s", "en")], got[(1, "a b c d", "s", "de")]
    assert abs(en - de) <= 1 and got[(2, "x y", "t", None)] == total[2]


def test_colliding_keys_lose_no_document(spark):
    docs = spark.createDataFrame([(i, f"w{i} a b", "s") for i in range(50)] + [(7, "w7 a b", "s")] * 3, "doc_id long, text string, source string")
    wide = docs.select(F.struct("doc_id", "text", "source").alias("row"), F.lit(5).cast("long").alias("_key"), F.col("source").alias("_source"), F.lit(3).cast("long").alias("_size"))
    got = Counter(r.doc_id for r in mixing._copied(wide, mixing.WEIGHTS, mixing.SHARE, mixing.MOST, 42).collect())
    assert set(got) == set(range(50)) and sum(got.values()) in (79, 80) and all(1 <= n <= 2 for i, n in got.items() if i != 7) and 4 <= got[7] <= 8


# ---- encrypted keys

def pem(kind, body, headers=""):
    text = base64.b64encode(body).decode()
    lines = "\n".join(text[i:i + 64] for i in range(0, len(text), 64))
    return f"-----BEGIN {kind}-----\n{headers}{lines}\n-----END {kind}-----"


OID = bytes.fromhex("06092a864886f70d01050d")


def test_encrypted_keys_are_parsed():
    good = pem("ENCRYPTED PRIVATE KEY", der(0x30, der(0x30, OID + der(0x30, b"")) + der(0x04, bytes(range(64)))))
    assert [k for _, _, k in secrets.added_spans(good)] == [secrets.KINDS.index("key")]
    for bad in (der(0x30, der(0x30, OID) + der(0x04, b"x" * 64)) + b"tail", der(0x30, der(0x30, integer(5)) + der(0x04, b"x" * 64)),
                der(0x30, der(0x30, OID) + der(0x04, b"x" * 64) + integer(1)), b"only prose " * 9):
        assert secrets.added_spans(pem("ENCRYPTED PRIVATE KEY", bad)) == []
    prose = "-----BEGIN ENCRYPTED PRIVATE KEY-----\n" + "this is plain english prose, not a key at all " * 3 + "\n-----END ENCRYPTED PRIVATE KEY-----"
    assert secrets.added_spans(prose) == []


@pytest.mark.parametrize("start, size, holds", [("00112233445566778899AABBCCDDEEFF", 64, True), ("0011223344556677", 24, True),
                                                ("00112233445566778899AABBCCDDEEFF", 63, False), ("xyz", 64, False)])
def test_legacy_encrypted_keys_need_a_start_value_and_whole_blocks(start, size, holds):
    head = f"Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{start}\n\n"
    text = pem("RSA PRIVATE KEY", bytes((i * 37 + 11) % 256 for i in range(size)), head)
    assert bool(secrets.added_spans(text)) is holds


def test_letters_in_a_quad_are_no_address_of_a_machine(spark):
    model = pii.trained(spark.createDataFrame([(1, "a 10.20.30.40 b 1a.2.3.4@x now")], "doc_id long, text string"))
    assert pii.scan_text("mail 1a.2.3.4@x.yz now", model)[1] == 0


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_numbers_are_found_in_groups_of_any_width(spark, width):
    model = pii.trained(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    cards = [" ".join(c[i:i + width] for i in range(0, 16, width)) for c in ("4929348385146306", "4845168114407329")]
    text = f"pay {cards[0]} {cards[1]} now, call +49 (0) 30 12 34 56 78 +49 (0) 30 12 34 56 79"
    base, added = pii.all_spans(text, model)
    assert [text[a:b] for a, b, _ in sorted(base + added)] == [*cards, "+49 (0) 30 12 34 56 78", "+49 (0) 30 12 34 56 79"]


def test_running_check_sums_are_luhn():
    rng = np.random.default_rng(2)
    for _ in range(200):
        text = "".join(rng.choice(list("0123456789 "), 30)).strip()
        bounds = pii.units_of(text, 0, len(text))
        for i, j, names, kinds in pii.candidates(text, bounds):
            digits = text[bounds[i]:bounds[j]].replace(" ", "")
            assert kinds[2] == (12 <= len(digits) <= 19 and pii.luhn(digits)) and ("check-digit" in names) == kinds[2]


def test_few_long_texts_recur_as_many_short_ones():
    rng = np.random.default_rng(3)
    for _ in range(40):
        lengths = rng.integers(0, rng.integers(1, 40), rng.integers(0, 30))
        emission, trans = rng.normal(size=lengths.sum()) * 3, np.exp(rng.normal(size=(2, 2)))
        got = toxicity.forward_backward(emission, lengths, trans)
        ends = np.cumsum(lengths)
        for a, b in zip(ends - lengths, ends, strict=True):
            e, ahead, after = np.exp(emission[a:b]), np.empty(b - a), np.ones(b - a)
            for t in range(b - a):
                r = ahead[t - 1]
                ahead[t] = e[t] * (trans[0, 1] + r * trans[1, 1]) / (trans[0, 0] + r * trans[1, 0]) if t else e[0]
            for t in range(b - a - 2, -1, -1):
                x = e[t + 1] * after[t + 1]
                after[t] = (trans[1, 0] + trans[1, 1] * x) / (trans[0, 0] + trans[0, 1] * x)
            assert np.allclose(got[0][a:b], ahead) and np.allclose(got[1][a:b], after)
