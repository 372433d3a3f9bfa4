"""The pipeline: stages on their own, edge rows, and the whole run against brute force."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from basketry.llm import mixing, pii, simhash, toxicity
from basketry.llm.common import staged

from .conftest import SF01, rows_of
from .test_corpus_ops import brute_components, brute_fingerprint, check_packing, water


@pytest.fixture(scope="module")
def kept(spark):
    """Each stage's output, in order."""
    docs, out = spark.read.parquet(f"{SF01}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF01), f"test-{name}")
        out.append(docs)
    return out


def test_stages_are_the_five():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]


def test_each_stage_against_brute_force(spark, documents, kept):
    first, second, third, fourth, last = (d.collect() for d in kept)
    assert all(d.columns == documents.columns for d in kept[:-1])
    model = toxicity.trained(documents, spark.read.parquet(f"{SF01}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    rows = documents.collect()
    score = {r.doc_id: s for r, s in zip(rows, scorer.score([r.text for r in rows])[0])}
    assert sorted(r.doc_id for r in first) == sorted(i for i, s in score.items() if s < 0.5)
    prints = [(r.doc_id, brute_fingerprint(r.text)) for r in first]
    component = brute_components(prints)
    assert sorted(r.doc_id for r in second) == sorted(set(component.values()))
    field = pii.trained(kept[1])
    texts = {r.doc_id: r.text for r in second}
    assert {r.doc_id: r.text for r in third} == {i: pii.redact(t, field) for i, t in texts.items()}
    assert all(r.n_chars == len(r.text) for r in third)
    words, source = {r.doc_id: len(r.text.encode().split()) for r in third}, {r.doc_id: r.source for r in third}
    copies = Counter(r.doc_id for r in fourth)
    assert max(copies.values()) <= 2 and {tuple(r) for r in fourth} <= {tuple(r) for r in third}
    sizes, taken = Counter(), Counter()
    for i, n in words.items():
        sizes[source[i]] += n
        taken[source[i]] += n * copies[i]
    goal = water(dict(sizes))
    assert all(abs(taken[s] - goal[s]) <= max(3, 0.005 * goal[s]) for s in sizes)
    padding, tokens = check_packing(fourth, last)
    assert padding <= 1024 * kept[3].rdd.getNumPartitions()


def test_run_is_the_stages_in_turn(spark, kept):
    got = corpus_pipeline.run(spark, SF01)
    drop = ["sequence_id", "offset", "start", "length", "ids_crc32"]
    assert Counter(rows_of(got.drop(*drop))).keys() == Counter(rows_of(kept[-1].drop(*drop))).keys()


def test_edges_of_the_stages(spark, edges, nothing):
    labels = spark.createDataFrame([(6, 1), (5, 0)], "doc_id long, toxic int")
    model = toxicity.trained(edges, labels)
    assert rows_of(toxicity.without_toxic(edges, model)) == rows_of(edges)
    one = simhash.one_of_each(edges)
    assert one.columns == edges.columns
    ids = Counter(r.doc_id for r in one.collect())
    assert ids == {1: 1, 2: 1, None: 1, 5: 1, 6: 1, 7: 1, 8: 1}  # 3 and 4 have no words either, like 2
    field = pii.trained(edges)
    assert rows_of(pii.redacted(edges, field).select("doc_id")) == rows_of(edges.select("doc_id"))
    mixed = mixing.mixed_documents(edges)
    assert mixed.columns == edges.columns
    originals, copies = Counter(map(repr, edges.collect())), Counter(map(repr, mixed.collect()))
    assert all(copies[r] <= 2 * originals[r] for r in copies) and set(copies) <= set(originals)
    for empty in (toxicity.without_toxic(nothing, model), simhash.one_of_each(nothing), pii.redacted(nothing, field), mixing.mixed_documents(nothing)):
        assert empty.count() == 0 and empty.columns == edges.columns


def test_one_of_each_keeps_the_smallest_id_of_any_text(spark):
    rows = [(5, "a b c d e f g"), (5, "x y z q r s t u"), (3, "a b c d e f g"), (9, "x y z q r s t u"), (None, "only null id"), (None, "only null id"), (7, "only null id")]
    got = rows_of(simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == rows_of(spark.createDataFrame([(3, "a b c d e f g"), (5, "x y z q r s t u"), (7, "only null id")], "doc_id long, text string"))
