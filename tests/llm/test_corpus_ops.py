"""Packing, mixing and SimHash components: brute force, invariants and edge rows."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketry.llm import mixing, packing, simhash

from .conftest import rows_of


# ---- packing

def tokenizer():
    import public_tokenizers as public
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def check_packing(docs, rows, window=1024):
    """Every id in exactly one piece with its checksum; offsets gapless; returns (padding, tokens)."""
    t = tokenizer()
    ids = [(r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in docs]
    pieces = defaultdict(list)
    for r in rows:
        pieces[(r.doc_id, r.doc_tokens)].append((r.start, r.length, r.ids_crc32))
    expected = Counter((i, len(x)) for i, x in ids)
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    for i, x in ids:
        got = sorted(pieces[(i, len(x))])
        copies = expected[(i, len(x))]
        if copies == 1:
            at = 0
            for start, length, c in got:
                assert start == at and c == crc(x[start:start + length])
                at += length
            assert at == len(x)
        else:
            assert sum(p[1] for p in got) == copies * len(x)
            assert all(c in {crc(y[s:s + n]) for j, y in ids if j == i} for s, n, c in got)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, sum(len(x) for _, x in ids)


def test_packing_documents(documents):
    rows = packing.packed(documents).collect()
    padding, tokens = check_packing(documents.collect(), rows)
    assert padding <= 1024 and padding < 0.01 * tokens
    docs = [r for r in rows if r.doc_tokens <= 1024]
    assert len(docs) < 1.3 * len({r.doc_id for r in docs})  # most short documents stay in one piece


def test_packing_edges(edges, nothing):
    rows = packing.packed(edges, window=64).collect()
    sequences = defaultdict(int)
    for r in rows:
        sequences[r.sequence_id] += r.length
    assert max(sequences.values()) <= 64
    total = {r.doc_id: r.doc_tokens for r in rows}
    assert total[2] == total[3] == 1 and total[8] == len(tokenizer().encode("<|endoftext|> special <|endoftext|>", add_special_tokens=False).ids) + 1
    assert sum(r.length for r in rows) == sum(len(tokenizer().encode(r.text or "", add_special_tokens=False).ids) + 1 for r in edges.collect())
    assert packing.packed(nothing).count() == 0


def test_packing_buffers_are_whole(documents):
    rows = packing.packed(documents.repartition(3), buffer_tokens=5_000).collect()
    check_packing(documents.collect(), rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=30), st.integers(0, 40))
def test_best_fill_against_brute_force(items, room):
    counts = Counter(items)
    chosen = packing.best_fill(sorted(counts, reverse=True), dict(counts), room)
    assert all(0 < k <= counts[n] for n, k in chosen.items())
    reach = {0}
    for x in items:
        reach |= {x + y for y in reach if x + y <= room}
    assert sum(n * k for n, k in chosen.items()) == max(reach)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 31), max_size=60))
def test_pack_is_whole_and_tight(items):
    stock = defaultdict(list)
    for i, n in enumerate(items):
        stock[n].append(((i, n), 0))
    windows = list(packing.pack(dict(stock), 32))
    parts = defaultdict(list)
    for w in windows:
        assert sum(p[0] for p in w) <= 32
        for length, item, start in w:
            parts[item].append((start, length))
    assert all(sum(p[0] for p in w) == 32 for w in windows[:-1])
    for (i, n), got in parts.items():
        at = 0
        for start, length in sorted(got):
            assert start == at
            at += length
        assert at == n
    assert len(parts) == len(items)


def test_pack_hot_length_in_few_steps():
    stock = {600: [(i, 0) for i in range(5000)], 424: [(i, 0) for i in range(5000, 10_000)]}
    assert len(list(packing.pack(stock, 1024))) == 5000


def test_ranks_give_the_ids_of_the_tokenizer():
    t, path = tokenizer(), packing.default_ranks()
    rng = random.Random(1)
    samples = ["a" + chr(c) + "1 " + chr(c) + chr(c) + "b  " + chr(c) + "\n" for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    samples += ["a" + chr(c) + "1 " + chr(c) for c in range(0x3100, 0x110000, 37) if not 0xD800 <= c < 0xE000]
    samples += ["".join(rng.choice("ab Z09'.,\n\t  é😀<|endoftext|>st") for _ in range(60)) for _ in range(500)]
    bad = [s for s in samples if packing.token_ids(s, path).tolist() != t.encode(s, add_special_tokens=False).ids + [0]]
    assert not bad, (len(bad), [hex(ord(s[1])) for s in bad[:20] if len(s) > 1])


def test_long_runs_of_white_space_are_packed_whole(spark):
    n = 2_000_000
    texts = [" " * n, "\n" * n, "a" + " " * n + "b", "a\n" + " \t\r" * 400_000 + "\n<|endoftext|>" + "\u3000" * 150_000 + "é" + "\n" * n + "x  y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_packing(docs.collect(), packing.packed(docs).collect())


# ---- mixing

def water(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: most * sizes[s] for s in full}
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 10}, {"a": 8, "b": 20}, {"a": 0, "b": 5, None: 7}, {"x": 100, "y": 1, "z": 1, None: 50},
    {"s1": 5, "s2": 900, "s3": 3, "s4": 77, "s5": 0, "s6": 1000, "S": 4}])
def test_targets_against_reshare_loop(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(water(sizes))


def test_mix_documents(documents):
    rows = mixing.mix(documents).collect()
    source = {r.doc_id: r.source for r in documents.collect()}
    words = {r.doc_id: len((r.text or "").encode().split()) for r in documents.collect()}
    assert all(r.size == words[r.doc_id] for r in rows) and len(rows) == documents.count()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
    goal = water(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(goal[source[r.doc_id]])
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= max(2, 0.002 * goal[s])
    assert rows_of(mixing.mix(documents.repartition(5))) == sorted(map(tuple, rows), key=repr)


def dense_balance(words, goals, slack, most=2):
    """Rates {(source, class): rate} of the same problem: all duals at once, dense Hessian, backtracking."""
    cells, free = sorted(words, key=repr), [s for s in goals if 0 < goals[s] < most * sum(w for (t, _), w in words.items() if t == s)]
    of_source = {s: sum(w for (t, _), w in words.items() if t == s) for s in goals}
    names = sorted({c for _, c in words})
    of_class = {c: sum(w for (_, d), w in words.items() if d == c) for c in names}
    share = sum(goals.values()) / sum(words.values())
    w = np.array([words[k] for k in cells])
    a = np.zeros((len(cells), len(free) + len(names)))
    fixed = np.full(len(cells), np.nan)
    for i, (s, c) in enumerate(cells):
        if s in free:
            a[i, free.index(s)] = a[i, len(free) + names.index(c)] = 1
        else:
            fixed[i] = goals[s] / of_source[s]
    given = {c: sum(w[i] * fixed[i] for i, k in enumerate(cells) if k[1] == c and k[0] not in free) for c in names}
    goal = np.array([goals[s] for s in free] + [share * of_class[c] - given[c] for c in names])
    ridge = np.array([0.0] * len(free) + [slack * of_class[c] for c in names])
    open_ = np.isnan(fixed)

    def value(x):
        z = a[open_] @ x
        return goal @ x - ridge @ (x * x) / 2 - w[open_] @ (most * np.logaddexp(z, np.log(most - 1)))

    x = np.zeros(len(goal))
    for _ in range(500):
        rate = most / (1 + (most - 1) * np.exp(-(a @ x)))
        grad = goal - ridge * x - a[open_].T @ (w * rate)[open_]
        h = (a[open_].T * (w * rate * (1 - rate / most))[open_]) @ a[open_] + np.diag(ridge)
        step, t = np.linalg.solve(h, grad), 1.0
        while value(x + t * step) < value(x) - 1e-9 and t > 1e-9:
            t /= 2
        x = x + t * step
    rate = np.where(open_, most / (1 + (most - 1) * np.exp(-(a @ x))), fixed)
    return dict(zip(cells, rate))


@pytest.mark.parametrize("slack", [0.1, 0.01])
def test_balanced_rates_against_a_dense_solver(spark, slack):
    rng = np.random.default_rng(5)
    rows = [(s, c, int(4 ** c + rng.integers(0, 3 * 4 ** c)), int(rng.integers(1, 90))) for s in ("a", "b", "c", None, "full", "none") for c in range(1, 6) for _ in range(3)
            if rng.random() < 0.7]
    classes = spark.createDataFrame(rows, "source string, class int, size long, n long")
    sizes, words = Counter(), Counter()
    for s, c, size, n in rows:
        sizes[s] += size * n
        words[s, c] += float(size * n)
    goals = {s: sizes[s] * k for s, k in (("a", 1.7), ("b", 0.4), ("c", 1.95), (None, 1.1), ("full", 2.0), ("none", 0.0))}
    table = spark.createDataFrame([(s, sizes[s], g) for s, g in goals.items()], "source string, source_size long, target double")
    got = mixing.balanced_rates(classes, table, slack=slack).collect()
    want = dense_balance(words, goals, slack)
    assert len(got) == len(rows) and all(r.rate == pytest.approx(want[r.source, r["class"]], abs=1e-6) for r in got)
    taken = Counter()
    for r in got:
        taken[r.source] += r.rate * r.size * r.n
    assert all(taken[s] == pytest.approx(goals[s], rel=1e-6, abs=1e-6) for s in goals)
    assert len({round(r.rate, 3) for r in got if r.source == "b"}) > 1  # rates differ inside a source


def test_classes_keep_their_share_better_than_flat_rates(spark):
    # short documents in one source, long ones in the other, and both in a third: flat rates follow the sources
    rows = [("s", 0, 10, 900), ("s", 1, 100, 10), ("l", 0, 10, 100), ("l", 1, 100, 90), ("m", 0, 10, 500), ("m", 1, 100, 50)]
    goals = {"s": 17000.0, "l": 3000.0, "m": 10000.0}
    classes = spark.createDataFrame(rows, "source string, class int, size long, n long")
    table = spark.createDataFrame([("s", 10000, 17000.0), ("l", 10000, 3000.0), ("m", 10000, 10000.0)], "source string, source_size long, target double")
    got = mixing.balanced_rates(classes, table, slack=0.001).collect()
    flat = sum(goals[s] / 10000 * size * n for s, c, size, n in rows if c == 0) / 30000
    kept = sum(r.rate * r.size * r.n for r in got if r["class"] == 0) / 30000
    corpus = sum(size * n for _, c, size, n in rows if c == 0) / 30000
    assert flat - corpus > 0.1 and abs(kept - corpus) < 0.01


def test_balance_of_one_source_and_of_nothing_is_flat(spark):
    classes = spark.createDataFrame([("a", 0, 1, 10), ("a", 3, 70, 4)], "source string, class int, size long, n long")
    goals = spark.createDataFrame([("a", 290, 435.0)], "source string, source_size long, target double")
    assert [r.rate for r in mixing.balanced_rates(classes, goals).collect()] == pytest.approx([1.5, 1.5])
    assert mixing.balanced_rates(classes.where("false"), goals).count() == 0
    with pytest.raises(RuntimeError):
        two = classes.union(classes.withColumn("source", F.lit("b")).withColumn("n", F.col("class") + 1))
        mixing.balanced_rates(two, goals.union(spark.createDataFrame([("b", 281, 20.0)], goals.schema)), steps=1)


def test_mix_edges(edges, nothing):
    rows = mixing.mix(edges).collect()
    assert len(rows) == edges.count()
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert {r.size for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert mixing.mix(nothing).count() == 0


def test_mix_large_class_of_equal_rows(spark):
    same = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("a").alias("source"))
    other = spark.range(3000).select("id", F.lit("one two three").alias("text"), F.lit("b").alias("source"))
    rows = mixing.mixed(mixing.sized(same.union(other)), class_rows=100).groupBy("source").agg(
        F.sum("repeats").alias("n"), F.sum(F.col("copies") * F.col("repeats") * F.col("size")).alias("taken"), F.first("target").alias("t")).collect()
    assert all(r.n == 3000 and abs(r.taken - r.t) <= 3 for r in rows) and len(rows) == 2


# ---- SimHash components

def brute_fingerprint(text, k=3):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB é\n\t\x0b\x85 İ", max_size=50))
def test_fingerprint_against_brute_force(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def brute_components(rows, bits=3):
    """rows: (doc_id, fp); the smallest id reachable, by fingerprint."""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= bits:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for d, f in rows:
        r = find(f)
        least[r] = d if least.get(r) is None else min(x for x in (d, least[r]) if x is not None) if d is not None or least[r] is not None else None
    return {f: least[find(f)] for f in fps}


def test_components_of_documents(documents):
    rows = simhash.simhash_components(documents).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    prints = {d: brute_fingerprint(t) for d, t in texts.items()}
    component = brute_components(list(prints.items()))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{p:016x}", component[p]) for d, p in prints.items()}
    assert any(r.component_id != r.doc_id for r in rows)


@pytest.mark.parametrize("split,blocks", [(20_000, 1 << 26), (5, 1 << 26), (20_000, 0), (3, 0)])
def test_links_of_planted_balls(spark, monkeypatch, split, blocks):
    """Dense balls, chains of 3-bit steps and lone fingerprints, with split cells and with either block scheme."""
    monkeypatch.setattr(simhash, "FOUR_BLOCKS", blocks)
    rng = random.Random(split + blocks)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for base in fps[:3]:
        fps += [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(40)]
    x = fps[10]
    for _ in range(12):
        x ^= sum(1 << b for b in rng.sample(range(64), 3))
        fps.append(x)
    rows = list(enumerate(sorted(set(fps), key=lambda f: rng.random())))
    signed = [(f - (1 << 64) if f >> 63 else f,) for _, f in rows]
    df = spark.createDataFrame(signed, "fp long").repartition(4)
    roots = {r.a % (1 << 64): r.root % (1 << 64) for r in simhash.components(simhash._links(df, 3, len(rows), split, simhash.pivots())).collect()}
    groups, expected = defaultdict(set), defaultdict(set)
    component = brute_components(rows)
    for d, f in rows:
        groups[roots.get(f, f)].add(d)
        expected[component[f]].add(d)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_edges(edges, nothing):
    rows = simhash.simhash_components(edges).collect()
    assert len(rows) == edges.count()
    zero = [r for r in rows if r.doc_id in (2, 3, 4)]
    assert {(r.fingerprint, r.component_id) for r in zero} == {("0" * 16, 2)}
    assert {r.component_id for r in rows if r.doc_id is None} == {None}
    assert simhash.simhash_components(nothing).count() == 0
