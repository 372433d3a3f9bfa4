"""Toxicity, secrets and personal data: brute force, planted cases and edge rows."""

import base64
import hashlib
import json
import random
import re
import zlib
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basketry.llm import pii, secrets, toxicity

from .conftest import SF01, rows_of

# ---- toxicity


def brute_marginals(emission, trans):
    n = len(emission)
    total, marked = 0.0, np.zeros(n)
    for tags in product((0, 1), repeat=n):
        w = np.exp(sum(e for e, t in zip(emission, tags) if t))
        for a, b in zip(tags, tags[1:]):
            w *= trans[a, b]
        total += w
        marked += w * np.array(tags)
    return marked / total


def test_marginals_against_enumeration():
    rng = np.random.default_rng(3)
    lengths = np.array([4, 0, 1, 7, 2, 0])
    emission, trans = rng.normal(size=lengths.sum()), np.exp(rng.normal(size=(2, 2)))
    got = toxicity.marginals(emission, lengths, trans)
    want, at = [], 0
    for n in lengths:
        want.append(brute_marginals(emission[at:at + n], trans))
        at += n
    assert np.allclose(got, np.concatenate(want))


def test_pair_expectations_sum_to_marginals():
    rng = np.random.default_rng(4)
    lengths = np.array([5, 3])
    emission, trans = rng.normal(size=8), np.exp(rng.normal(size=(2, 2)))
    ahead, after = toxicity.forward_backward(emission, lengths, trans)
    right = np.array([1, 2, 3, 4, 6, 7])
    pairs = toxicity._pairs(emission, ahead, after, right, trans)
    p = ahead * after / (1 + ahead * after)
    assert np.allclose(pairs[:, 1].sum(), p[right].sum()) and np.allclose(pairs[1].sum(), p[right - 1].sum())


def test_scorer_skips_only_what_it_may():
    model = {"weights": {"vile": 6.0, "vil-": 2.0, "-ile": 1.0}, "bias": -4.0, "trans": np.array([[2.0, 0.4], [0.5, 1.5]]), "doc": np.array([2.0, 3.0, -4.0])}
    scorer = toxicity.Scorer(model)
    docs = ["a b c", "such a vile thing", "", "plain " * 30, "Vile! vilest smile"]
    words, lengths = toxicity._tokens(docs)
    emission = np.array([model["bias"] + sum(model["weights"].get(f, 0) for f in toxicity.features(w)) for d in words for w in d])
    assert np.allclose(scorer.emissions([w for d in words for w in d]), emission)
    assert np.allclose(scorer.marginals(emission, lengths), toxicity.marginals(emission, lengths, model["trans"]))
    score, spans, n = scorer.score([*docs, None])
    assert spans[1] == "7:11" and n[1] == 1 and score[1] > score[0] and score[2] == score[5]


def test_toxicity_spans_are_offsets_of_the_text():
    model = {"weights": {"vile": 12.0}, "bias": -4.0, "trans": np.ones((2, 2)), "doc": np.array([2.0, 3.0, -4.0])}
    text = "İİ ß VILE###vile x"
    spans = toxicity.Scorer(model).score([text])[1][0]
    assert [text[int(a):int(b)] for a, b in (s.split(":") for s in spans.split(","))] == ["VILE###vile"]


def synthetic(n, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    texts, y = [], []
    for _ in range(n):
        words, toxic = rng.choices(plain, k=rng.randint(5, 60)), rng.random() < 0.15
        if toxic:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["zorgle", "kwaxi", "blip" + rng.choice(plain)]))
        texts.append(" ".join(words))
        y.append(int(toxic))
    return texts, y


def test_toxicity_learns_markers_and_prefixes():
    model = toxicity.fit(*synthetic(1500, 1))
    texts, y = synthetic(800, 2)
    scorer = toxicity.Scorer(model)
    assert np.mean((np.array(scorer.score(texts)[0]) >= 0.5) == np.array(y, bool)) > 0.98
    assert scorer.score(["abc blipzzz def blipqq gah"])[1] == ["4:11,16:22"]  # forms that were never seen


@pytest.mark.parametrize("texts,y", [([], []), (["a b"], [1]), (["a b"], [0]), (["", ""], [0, 1])])
def test_toxicity_fit_without_evidence(texts, y):
    score = toxicity.Scorer(toxicity.fit(texts, y)).score(["x y", "", None])[0]
    assert all(0 <= s <= 1 for s in score)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.trained(docs, labels, max_docs=1500)
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(r.toxic, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([y == g.predicted for y, g in held]) > 0.96
    assert all(g.predicted == (g.score >= 0.5) for _, g in held)
    assert np.mean([g.predicted for y, g in held if not y]) < 0.02


def test_toxicity_never_reads_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    flipped = labels.withColumn("toxic", __import__("pyspark.sql.functions", fromlist=["x"]).expr(
        "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end").cast("int"))
    assert toxicity.training_sample(docs, labels) == toxicity.training_sample(docs, flipped)


def test_toxicity_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None), (6, 0), (99, 1)], "doc_id long, toxic int")
    model = toxicity.trained(edges, labels)
    got = toxicity.toxicity_scores(edges, model).collect()
    assert len(got) == edges.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    assert toxicity.toxicity_scores(nothing, toxicity.trained(nothing, labels.where("false"))).count() == 0


def test_scores_keep_the_class_shares_of_the_labels(spark):
    rng = random.Random(3)
    plain = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = []
    for i in range(6000):  # one in ten is toxic, half of these without any sign of it
        words = rng.choices(plain, k=12)
        if i % 10 == 0 and i % 20:
            words.insert(rng.randrange(12), "vilescum")
        rows.append((i, " ".join(words), int(i % 10 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scores = [toxicity.Scorer(toxicity.trained(docs, docs, max_docs=n)).score(["wab wac wad", "wab vilescum wad"])[0] for n in (6000, 1500, 300)]
    for plain_text, marked in scores:
        assert abs(plain_text - 0.053) < 0.03 and marked > 0.5, scores


# ---- secrets


def der(tag, content):
    n = len(content)
    size = bytes([n]) if n < 128 else bytes([0x80 | len(x := n.to_bytes((n.bit_length() + 7) // 8))]) + x
    return bytes([tag]) + size + content


def integer(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1))


RNG = random.Random(5)
PKCS1 = der(0x30, integer(0) + b"".join(integer(RNG.getrandbits(512)) for _ in range(8)))
PKCS8 = der(0x30, integer(0) + der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(4, PKCS1))
SEC1 = der(0x30, integer(1) + der(4, RNG.randbytes(32)))


def string(b):
    return len(b).to_bytes(4) + b


SSH = b"openssh-key-v1\x00" + string(b"none") + string(b"none") + string(b"") + (1).to_bytes(4) + string(b"pub" * 9) + string(b"priv" * 30)


def b64(b, url=False):
    return (base64.urlsafe_b64encode if url else base64.b64encode)(b).decode()


def jwt(head, body=None):
    part = lambda x: b64(json.dumps(x).encode(), True).rstrip("=")
    return f"{part(head)}.{part(body or {'sub': 'me'})}.{b64(bytes(range(20)), True).rstrip('=')}"


def kinds(text):
    found = secrets.scan_text(text)[4]
    return [x.split(":")[0] for x in found.split(",")] if found else []


@pytest.mark.parametrize("key", [PKCS1, PKCS8, SEC1, SSH])
def test_keys_are_confirmed_by_their_lengths(key):
    assert "key" in kinds(f"x {b64(key)} y")
    assert "key" in kinds(f"x {key.hex()} y")
    assert "key" not in kinds(f"x {b64(key[:-3])} y")  # lengths don't add up
    assert "key" not in kinds(f"x {b64(RNG.randbytes(len(key)))} y")
    lines = "\n".join(re.findall(".{1,64}", b64(key)))
    text = f"a\n-----BEGIN PRIVATE KEY-----\n{lines}\n-----END PRIVATE KEY-----\nb"
    assert secrets.added_spans(text) == [(2, len(text) - 2, 4)]
    assert secrets.added_spans(text.replace(lines, "no key here")) == []


DSA = der(0x30, integer(0) + b"".join(integer(RNG.getrandbits(n)) for n in (1024, 160, 1024, 1024, 160)))


def test_dsa_keys():
    test_keys_are_confirmed_by_their_lengths(DSA)
    assert not secrets.is_der_key(der(0x30, integer(1) + b"".join(integer(9 ** 40) for _ in range(5))))
    assert not secrets.is_der_key(der(0x30, integer(0) + b"".join(integer(9 ** 40) for _ in range(4))))


@pytest.mark.parametrize("width", [48, 64, 76])
@pytest.mark.parametrize("key", [PKCS1, PKCS8, DSA, SSH, b"x" * 45 + b"\npassword = hunter2hunter2" + b"y" * 60])
def test_runs_wrapped_over_lines(key, width):
    kind = 5 if key[:1] == b"x" else 4
    for run in (b64(key), key.hex()):
        for indent, end in (("", "\n"), ("    ", "\n"), ("\t", " \r\n")):
            lines = (end + indent).join(re.findall(f".{{1,{width}}}", run))
            for before, after in (("data:\n", "\nend. of it"), ("words\n", "\nend\n"), ("", "")):
                text = before + indent + lines + after
                start = len(before + indent)
                got = secrets.added_spans(text)
                assert (start, start + len(lines), kind) in got or kind == 5 and got, (run, text)
    assert secrets.added_spans("\n".join(re.findall(f".{{1,{width}}}", b64(RNG.randbytes(300))))) == []


def test_lines_with_secrets_of_their_own_stay_apart():
    one, two = (b64(b"user: x%d, password = hunter2hunter2" % i).rstrip("=") for i in (11, 22))
    assert secrets.added_spans(f"{one}\n{two}") == [(0, len(one), 5), (len(one) + 1, len(one) + 1 + len(two), 5)]


def test_tokens_and_wrapped_secrets():
    token = jwt({"alg": "HS256", "typ": "JWT"})
    assert secrets.added_spans(f"t={token};") == [(2, 2 + len(token), 3)]
    assert kinds(jwt({"typ": "JWT"})) == [] and kinds("eyes.are.open") == []
    inner = b64(b"user: x\npassword = hunter2hunter2")
    assert "wrapped" in kinds(f"data {inner}")
    assert "wrapped" in kinds("data " + b64(inner.encode()))
    assert kinds("data " + b64(b"just some harmless text, nothing to see")) == []
    assert kinds("Donaudampfschifffahrtsgesellschaftskapitaen antidisestablishmentarianism") == []


def brute_secret_base(text):
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    out = [(m.start(), m.end(), 0) for m in assign.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return out + [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]


TRICKY = st.lists(st.sampled_from(["token", "toKen", "api_key", "passwd", "Secret", "Key", "=", ":", " ", "'", '"', "0123456789ab", "deadbeefcafe", "AKIA",
                                   "ABCDEF0123456789", "+/", "é", "\n", "ey", ".", "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----", "QUJD" * 6]), max_size=14)


@settings(max_examples=300, deadline=None)
@given(TRICKY)
def test_secret_base_against_plain_patterns(parts):
    text = "".join(parts)
    assert sorted(secrets.base_spans(text)) == sorted(brute_secret_base(text))
    row = secrets.scan_text(text)
    base = sorted(brute_secret_base(text), key=lambda s: (s[0], s[2]))
    assert row[3] == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
    assert set(secrets.spans_text(base).split(",")) <= set(row[4].split(","))


@pytest.mark.parametrize("text", ["a" * 2_000_000, "ey" * 500_000, "-----BEGIN PRIVATE KEY-----" * 20_000, "token" + " " * 1_000_000, "AKIA" * 200_000, "QUJD" * 200_000, "ey.." * 200_000])
def test_long_texts_stay_linear(text):
    secrets.scan_text(text)


def test_secret_edges(edges, nothing):
    got = secrets.secret_scan(edges).collect()
    assert len(got) == edges.count()
    assert {r.base_sha256 for r in got if r.doc_id in (2, 3)} == {hashlib.sha256(b"").hexdigest()}
    assert secrets.secret_scan(nothing).count() == 0


def test_secrets_of_documents(documents):
    got = {r.doc_id: r for r in secrets.secret_scan(documents).collect()}
    for r in documents.collect():
        base = brute_secret_base(r.text)
        assert (got[r.doc_id].n_assign, got[r.doc_id].n_access, got[r.doc_id].n_hex) == tuple(sum(s[2] == k for s in base) for k in range(3))


# ---- personal data


def brute_pii_base(text):
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), m.end(), 2))
    return out + [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


PII = st.lists(st.sampled_from(["4929348385146306", "1", "23", "255", "256", "+1", "+49 30", " ", ".", "-", "(", ")", "@", "a", "b.c", "x_y%", "é", "\n", "٣", "555-5069", "0", "++"]), max_size=16)


@settings(max_examples=500, deadline=None)
@given(PII)
def test_pii_base_against_plain_patterns(parts):
    text = "".join(parts)
    assert sorted(pii.base_spans(text)) == sorted(brute_pii_base(text))


@pytest.fixture(scope="module")
def model(spark):
    return pii.trained(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_field_finds_base_spans_and_what_they_overran(model, documents):
    spans = [(r.text, s) for r in documents.collect() for s in pii.base_spans(r.text)]
    found = [s in pii.field_spans(t, model) for t, s in spans]
    assert len(found) > 20 and np.mean(found) > 0.97
    text = "pay 4929348385146306 4845168114407329 or call +1 (017) 555-7713 97.51.17.173"
    got = pii.all_spans(text, model)
    assert [text[a:b] for a, b, _ in sorted(got[0] + got[1])] == ["4929348385146306", "4845168114407329", "+1 (017) 555-7713", "97.51.17.173"]
    assert pii.redact(text, model) == "pay [CARD] [CARD] or call [PHONE] [IP]"
    assert pii.field_spans("order 12 34 56 78 90 and 2024-01-01 10:00:00, total 1 1 1 1 1 1 1 1", model) == []


def test_segmentation_against_enumeration():
    rng = np.random.default_rng(1)
    n = 6
    segments = [(i, j, (), ()) for i in range(n) for j in range(i + 1, min(n, i + 3) + 1) if rng.random() < 0.7]
    scores = rng.normal(size=(len(segments), 4))

    def all_ways(at):
        if at == n:
            yield []
            return
        for rest in all_ways(at + 1):
            yield rest
        for r, s in enumerate(segments):
            if s[0] == at:
                for rest in all_ways(s[1]):
                    for k in range(4):
                        yield [(r, k), *rest]
    total, share, best = 0.0, np.zeros_like(scores), (-1, None)
    for way in all_ways(0):
        value = sum(scores[r, k] for r, k in way)
        total += np.exp(value)
        for r, k in way:
            share[r, k] += np.exp(value)
        best = max(best, (value, [(*segments[r][:2], k) for r, k in way]), key=lambda b: b[0])
    log_sum, p = pii.expected(n, segments, scores)
    assert np.allclose(log_sum, np.log(total)) and np.allclose(p, share / total)
    assert pii.best_segments(n, segments, scores) == best[1]


@pytest.mark.parametrize("text", ["1" * 1_000_000, "a" * 1_000_000, "1 " * 100_000, "1.2.3.4." * 20_000, "@" * 200_000, "a@b." * 50_000, "+1" * 200_000, "+(" * 200_000])
def test_pii_long_texts_stay_linear(model, text):
    pii.scan_text(text, model)


def test_pii_edges(edges, nothing, model):
    got = pii.pii_scan(edges, model).collect()
    assert len(got) == edges.count()
    assert {r.base_sha256 for r in got if r.doc_id in (2, 3)} == {hashlib.sha256(b"").hexdigest()}
    assert pii.pii_scan(nothing, pii.trained(nothing)).count() == 0
    assert pii.redact(None, model) is None and pii.redact("", model) == ""
    assert rows_of(pii.pii_scan(edges, pii.trained(nothing)).select("n_card")) == rows_of(pii.pii_scan(edges, model).select("n_card"))
