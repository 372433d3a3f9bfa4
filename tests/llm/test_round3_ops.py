"""Divergence audit, fill-in-middle and substring dedup: edges and brute force (the SQL of each is held in test_queries)."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from basketry.llm import divergence, fim, substrings

from .conftest import rows_of

SPACE = r"\x20\x09-\x0D"


# ------------------------------------------------------------ fill-in-middle

def fim_brute(doc_id, text):
    text = text or ""
    tokens = re.findall(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+", text)
    n = len(tokens)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    one, two = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    p, m, s = "".join(tokens[:one]), "".join(tokens[one:two]), "".join(tokens[two:])
    spm = h[3] % 100 < 80
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def odd_texts(spark):
    rng = random.Random(3)
    parts = ["a", "bc", " ", "\n", "\t ", "é", "😀x", "<P", "<S", ">", "<M>", "<", "P>", "\x0b", "\x85", " ", "ſ"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 30)))) for i in range(600)]
    rows += [(i, "".join(rng.choice([p for p in parts if p != "<M>"]) for _ in range(rng.randrange(0, 12)))) for i in range(600, 1200)]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


@pytest.mark.parametrize("most", [1, 100, 4_000_000])
def test_fim_equals_brute_force_and_comes_back(odd_texts, most):
    docs, rows = odd_texts
    out = fim.fill_in_middle(docs, most=most)
    got = fim.restored(out, most=most)
    assert rows_of(out) == sorted((fim_brute(*r) for r in rows), key=repr)
    assert {r.form for r in out.collect()} == set(fim.FORMS)
    assert sorted((r.doc_id, r.restored) for r in got.collect()) == sorted(rows)


def test_fim_edges(edges, nothing):
    assert rows_of(fim.fill_in_middle(edges)) == sorted((fim_brute(r.doc_id, r.text) for r in edges.collect()), key=repr)
    back = fim.restored(fim.fill_in_middle(edges))
    assert sorted(r.restored for r in back.collect()) == sorted(r.text or "" for r in edges.collect())
    assert fim.fim_digests(nothing).collect() == []


def test_fim_restores_text_ids_and_keeps_other_columns(spark):
    docs = spark.createDataFrame([("x1", "one two three"), ("x2", ""), (None, " a ")], "name string, body string")
    out = fim.fill_in_middle(docs, id_col="name", text_col="body").withColumnRenamed("output", "made")
    got = fim.restored(out, "made", name="text")
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "made", "text"]
    assert sorted((r.doc_id or "", r.text) for r in got.collect()) == [("", " a "), ("x1", "one two three"), ("x2", "")]


def test_fim_refuses_an_output_without_marks(spark):
    bad = spark.createDataFrame([("<P>a<S>b", "psm")], "output string, form string")
    with pytest.raises(Exception, match="three marks"):
        fim.restored(bad).collect()


# ------------------------------------------------------------ divergence

def divergence_brute(rows, min_docs, top):
    often, held, groups = defaultdict(Counter), Counter(), set()
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        found = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups.add((lang, source))
        often[lang, source].update(found)
        held.update((lang, t) for t in set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), d in held.items() if x == lang and d >= min_docs)
        v, own = len(kept), sorted(g for g in groups if g[0] == lang)
        whole = Counter()
        for g in own:
            whole.update({t: often[g][t] for t in kept})

        def p(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10 ** 9 * (counts[t] + 5) // (total + 5 * v) for t in kept}
        ps, q = {g: p(often[g]) for g in own}, p(whole)
        for g in own:
            pairs = [(sum(abs(ps[g][t] - ps[o][t]) for t in kept), o[1]) for o in own if o != g]
            speaking = [(ps[g][t] - q[t], t) for t in kept if often[g][t] and ps[g][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", speaking, top)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((*g, part, item, value, rank))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def groups(spark):
    rng = random.Random(5)
    words = ["The", "the", "CAT", "über", "ÜBER", "naïve", "a", "x1y", "don't", "東京", "é", "zz", "rare"]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "s4", "s5", None, "é"]),
             " ".join(rng.choices(words, weights=[9, 9, 5, 4, 3, 3, 3, 2, 2, 2, 1, 1, 0.2], k=rng.randrange(0, 40)))) for _ in range(400)]
    rows += [("fr", "s1", "solo mot"), ("it", "s1", None), ("it", "s2", ""), ("it", "s3", "ciao"), ("en", "empty", None)]
    return spark.createDataFrame(rows, "lang string, source string, text string"), rows


@pytest.mark.parametrize("block, tile, memory", [(1024, 32, 300_000), (3, 2, 20)])
def test_divergence_equals_brute_force(groups, monkeypatch, block, tile, memory):
    docs, rows = groups
    monkeypatch.setattr(divergence, "COLUMNS", 7 if block == 3 else 2048)
    got = divergence.divergence(docs, min_docs=5, top=4, block_terms=block, tile_groups=tile)
    assert rows_of(got) == divergence_brute(rows, 5, 4)


def test_divergence_joint_tables_are_the_products_of_the_level_columns():
    """One block of two groups, priced by hand out of its joint table."""
    import pyarrow as pa
    block = pa.table({"idx": [0, 0, 1, 1, 1], "term": ["a", "b", "a", "b", "c"], "n": [2, 2, 1, 3, 3], "p": [50, 50, 10, 70, 70]})
    sides = pa.table({"lang": ["x", "x"], "left": [0, 0], "right": [0, 0], "idx": [0, 1], "tile": [0, 0], "zero": [5, 4], "n_terms": [5, 5]})
    # tables: (2, 1): a, (2, 3): b, (0, 3): c, (0, 0): two terms that neither holds
    want = abs(50 - 10) + abs(50 - 70) + abs(5 - 70) + 2 * abs(5 - 4)
    got = divergence.priced_tables(block, sides).to_pylist()
    assert got == [{"lang": "x", "a": 0, "b": 1, "f": want}, {"lang": "x", "a": 1, "b": 0, "f": want}]


def test_divergence_edges(edges, nothing):
    rows = [(r.lang, r.source, r.text) for r in edges.collect()]
    assert rows_of(divergence.divergence(edges, min_docs=2)) == divergence_brute(rows, 2, 50)
    assert rows_of(divergence.divergence(edges)) == divergence_brute(rows, 30, 50)
    assert divergence.divergence(nothing).collect() == []


# ------------------------------------------------------------ substring dedup

def dedup_brute(rows, length=13):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - length + 1):
            key = tuple(w[p:p + length])
            if i is not None and (first.get(key) is None or i < first[key]):
                first[key] = i
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - length + 1):
            f = first.get(tuple(w[p:p + length]))
            if i is not None and f is not None and f < i:
                gone.update(range(p, p + length))
        out.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def shared_passages(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    bank = [[rng.choice(words) for _ in range(rng.choice([12, 13, 14, 30, 80]))] for _ in range(12)]
    rows = []
    for i in range(250):
        text = []
        for _ in range(rng.randrange(1, 6)):
            if rng.random() < 0.5:
                piece = list(rng.choice(bank))
                if rng.random() < 0.4:
                    piece[rng.randrange(len(piece))] = rng.choice(words)
                text += piece[rng.randrange(0, 5):]
            text += [rng.choice(words) for _ in range(rng.randrange(0, 25))]
        rows.append((rng.randrange(200), rng.choice([" ", "\n", " \t"]).join(text)))
    rows += rows[:20] + [(500 + i, "same words over and over " * 30) for i in range(5)] + [(None, rows[0][1]), (900, None), (901, "")]
    rows += [(1000 + i, " ".join(rng.choices(words, k=20) + bank[3][:13] + rng.choices(words, k=20))) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


@pytest.mark.parametrize("bounds", [{}, {"shard_words": 200}, {"shard_words": 12}, {"gram": 1}, {"gram": 13}])
def test_dedup_equals_brute_force(shared_passages, bounds):
    docs, rows = shared_passages
    got = substrings.without_repeats(docs, **bounds).drop("removed")
    assert rows_of(got) == dedup_brute(rows)


def test_dedup_with_many_hot_references(shared_passages, monkeypatch):
    docs, rows = shared_passages
    monkeypatch.setattr(substrings, "BROADCAST_ROWS", 1)
    assert rows_of(substrings.without_repeats(docs, shard_words=12).drop("removed")) == dedup_brute(rows)


def test_dedup_removed_runs_agree_with_what_is_kept(shared_passages):
    docs, rows = shared_passages
    for r in substrings.without_repeats(docs).where("n_removed > 0").collect():
        runs = [tuple(map(int, x.split(":"))) for x in r.removed.split(",")]
        assert sum(b - a for a, b in runs) == r.n_removed and all(b - a >= 13 for a, b in runs)


def test_dedup_edges(edges, nothing, spark):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    assert rows_of(substrings.without_repeats(edges).drop("removed")) == dedup_brute(rows)
    assert substrings.dedup_digests(nothing).collect() == []
    long = [(1, "a b c d e f g h i j k l m"), (2, ("z " * 100_000) + "a b c d e f g h i j k l m"), (3, "z " * 13)]
    assert rows_of(substrings.without_repeats(spark.createDataFrame(long, "doc_id long, text string")).drop("removed")) == dedup_brute(long)
    named = spark.createDataFrame([("b", "x " * 15), ("a", "x " * 14), ("c", "y")], "doc_id string, text string")
    assert rows_of(substrings.without_repeats(named).select("doc_id", "n_removed")) == [("a", 0), ("b", 15), ("c", 0)]


def test_automaton_statistics_equal_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        texts = [(d, [rng.randrange(3) for _ in range(rng.randrange(1, 25))]) for d in rng.sample(range(99), 4)]
        a = substrings.SuffixAutomaton()
        for d, t in texts:
            a.add(t, d)
        a.close()
        query = [rng.randrange(4) for _ in range(30)]

        def holds(x):
            return [d for d, t in texts if any(t[i:i + len(x)] == x for i in range(len(t) - len(x) + 1))]
        want = [max(k for k in range(i + 2) if k == 0 or holds(query[i + 1 - k:i + 1])) for i in range(30)]
        assert [n for n, _ in a.statistics(query)] == want
        assert a.first_documents(query, 3) == [min(holds(query[i:i + 3]), default=None) for i in range(28)]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    words = [b"w%d" % i for i in rng.integers(0, 40, 300)]

    def at(rows):
        data = np.frombuffer(b"".join(rows), np.uint8)
        return substrings.anchors(data, np.cumsum([0, *map(len, rows)]))
    whole = at([b"", b" ".join(words), b"glued " * 3])
    assert len(whole[0]) == 288 and set(whole[1].tolist()) == {1}
    for s in range(0, 288, 7):
        alone = at([b"x y ", b"\t " + b"\n ".join(words[s:s + 13])])
        assert len(alone[0]) == 1 and alone[2][0] == whole[2][s] and alone[3][0] - 2 + s == whole[3][s]


def test_words_of_rows_equal_split():
    rng = random.Random(4)
    rows = [bytes(rng.choice(b"ab \t\n\xc3\xa9") for _ in range(rng.randrange(0, 9))) for _ in range(300)]
    starts, ends, row = substrings.words_of(np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)]))
    joined = b"".join(rows)
    got = [[] for _ in rows]
    for a, b, r in zip(starts, ends, row, strict=True):
        got[r].append(joined[a:b])
    assert got == [r.split() for r in rows]
