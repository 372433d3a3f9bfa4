"""Toxic spans by a linear-chain conditional random field over words.

Labels are there for documents; token labels are derived from them.  A word
form, prefix or suffix is a marker if toxic documents hold it so much more
often than the share of toxic documents explains (log-likelihood gain above
the cost of picking it from all forms), counted over distinct surroundings so
that copies of one passage count once.  Words with a marker in a toxic
document are the tokens labelled toxic.

The field has two tags, the sum of the word's feature weights as emission and
a 2 x 2 transition table; it is fitted by gradient steps on its log-likelihood,
the expectations coming from forward-backward.  The marginal of the toxic tag
gives spans (runs of words at 0.5 or more) and, through a logistic on the
number of toxic words and the largest marginal, the score of a document.

The model is fitted on the driver from at most ``MAX_DOCS`` labelled documents
of at most ``MAX_CHARS`` characters; every text is scored whole.  A class that is
sampled weighs as much as all its labels, so the share of toxic documents that
markers, field and score are fitted to doesn't depend on the bound.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import hashed_sample, map_rows, rewrite_rows

#: Bounds of the training sample: labelled documents of each class, and the length above which one isn't used.
MAX_DOCS = 1_500
MAX_CHARS = 10_000
#: Lengths of prefixes and suffixes that are features.
AFFIXES = (3, 4, 5, 6)
ROUNDS = 60
#: Words whose emission a worker remembers.
MEMORY = 150_000
#: Texts whose recursions run side by side, and how many of them are so few that each goes on alone.
ROWS = 512
FEW = 8
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The word itself and its proper prefixes and suffixes."""
    n = len(word)
    return [word, *[f"{word[:k]}-" for k in AFFIXES if k < n], *[f"-{word[-k:]}" for k in AFFIXES if k < n]]


class Packed:
    """Sequences laid out position by position, longest first, for recursions over all of them at once."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        ordered = lengths[self.order]
        self.longest = int(ordered[0]) if len(ordered) else 0
        # number of sequences that reach each position
        self.active = np.searchsorted(-ordered, -np.arange(self.longest), side="left")
        self.offset = np.concatenate(([0], np.cumsum(self.active)))
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1][self.order]
        self.source = np.empty(int(self.offset[-1]), np.int64)
        for t in range(self.longest):
            self.source[self.offset[t]:self.offset[t + 1]] = starts[:self.active[t]] + t

    def put(self, flat: np.ndarray) -> np.ndarray:
        return flat[self.source]

    def back(self, packed: np.ndarray) -> np.ndarray:
        out = np.empty_like(packed)
        out[self.source] = packed
        return out


def forward_backward(emission: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odds of the toxic tag given the words up to each position, and given the words after it.

    ``emission`` are log-odds of the words, one sequence after the other;
    ``trans[a, b]`` the potential of tag b after tag a.  Their product is the
    marginal odds.
    """
    lay = Packed(lengths)
    e = np.exp(np.clip(lay.put(emission), -40, 40))
    ahead, after = np.empty_like(e), np.ones_like(e)
    (t00, t01), (t10, t11) = trans.tolist()
    # a numpy call a position pays while several sequences reach it; the few longest go on word by word
    wide = int(np.searchsorted(-lay.active, -FEW, side="left"))
    for t in range(wide):
        now = slice(lay.offset[t], lay.offset[t + 1])
        if t == 0:
            ahead[now] = e[now]
            continue
        r = ahead[lay.offset[t - 1]:lay.offset[t - 1] + lay.active[t]]
        ahead[now] = e[now] * (t01 + r * t11) / (t00 + r * t10)
    for i in range(int(lay.active[wide]) if wide < lay.longest else 0):
        at = lay.offset[wide:-1][:np.count_nonzero(lay.active[wide:] > i)] + i
        words = e[at].tolist()
        r, out = float(ahead[lay.offset[wide - 1] + i]) if wide else None, []
        for x in words:
            r = x if r is None else x * (t01 + r * t11) / (t00 + r * t10)
            out.append(r)
        ahead[at] = out
        x, out = 1.0, [1.0]
        for following in reversed(words):
            x = following * x
            x = (t10 + t11 * x) / (t00 + t01 * x)
            out.append(x)
        after[at] = out[-2::-1]
        if wide:
            after[lay.offset[wide - 1] + i] = out[-1]
    for t in range(min(wide, lay.longest) - 2, -1, -1):
        n = lay.active[t + 1]
        following = slice(lay.offset[t + 1], lay.offset[t + 1] + n)
        x = e[following] * after[following]
        after[lay.offset[t]:lay.offset[t] + n] = (t10 + t11 * x) / (t00 + t01 * x)
    return lay.back(ahead), lay.back(after)


def marginals(emission: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Probability of the toxic tag of every word."""
    ahead, after = forward_backward(emission, lengths, trans)
    odds = ahead * after
    return odds / (1 + odds)


def _pairs(emission: np.ndarray, ahead: np.ndarray, after: np.ndarray, right: np.ndarray, trans: np.ndarray,
           weight: np.ndarray | float = 1.0) -> np.ndarray:
    """Expected (weighted) number of each tag pair (of a word and the one before it) at the words ``right``."""
    r, x = ahead[right - 1], np.exp(np.clip(emission[right], -40, 40)) * after[right]
    w = np.stack((np.full(len(r), trans[0, 0]), trans[0, 1] * x, r * trans[1, 0], r * trans[1, 1] * x))
    return (w / w.sum(0) * weight).sum(1).reshape(2, 2)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights (last: bias) of a ridge logistic regression by Newton steps; each row counts ``weight`` times."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    pull = np.diag([ridge] * (len(w) - 1) + [1e-6]) * max(1, weight.sum())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + pull / 10, x.T @ (weight * (y - p)) - pull @ w / 10)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _tokens(texts: list[str]) -> tuple[list[list[str]], np.ndarray]:
    docs = [WORD.findall(t.lower()) for t in texts]
    return docs, np.array([len(d) for d in docs], np.int64)


def _markers(docs: list[list[str]], toxic: np.ndarray, weight: tuple[float, float]) -> set[str]:
    """Features that speak for toxic documents; see the module's text. Documents of a class count ``weight`` times."""
    inside = Counter(f for d, y in zip(docs, toxic, strict=True) if y for f in {f for w in set(d) for f in features(w)})
    share, cost = np.average(toxic, weights=np.where(toxic, weight[1], weight[0])), np.log(len(inside) + 2) + 2
    inside = {f: a for f, a in inside.items() if a * weight[1] * -np.log(share) >= cost}  # the others can't gain enough
    outside = Counter(f for d, y in zip(docs, toxic, strict=True) if not y for f in {f for w in set(d) for f in features(w) if f in inside})

    def gain(a, b):
        a, b = a * weight[1], b * weight[0]
        p = a / (a + b)
        return a * np.log(p / share) + (b * np.log((1 - p) / (1 - share)) if b else 0) if p > share else 0.0

    likely = {f for f, a in inside.items() if a * weight[1] / (a * weight[1] + outside[f] * weight[0]) >= max(0.8, share) and gain(a, outside[f]) >= cost}
    around: dict[str, set] = {f: set() for f in likely}
    for d, y in zip(docs, toxic, strict=True):
        if y:
            for i, w in enumerate(d):
                for f in likely.intersection(features(w)):
                    around[f].add((d[i - 1] if i else "", w, d[i + 1] if i + 1 < len(d) else ""))
    return {f for f in likely if gain(min(inside[f], len(around[f])), outside[f]) >= cost}


def fit(texts: list[str], toxic: list[int], weight: tuple[float, float] = (1.0, 1.0), rounds: int = ROUNDS) -> dict:
    """The model: {weights: feature -> weight, bias, trans, doc}. No toxic or no clean document: a constant score.

    ``weight``: how often a clean and a toxic document count.
    """
    y = np.array(toxic, bool)
    times = np.where(y, weight[1], weight[0])
    share = min((times[y].sum() + 1) / (times.sum() + 2), 0.49)  # without evidence no text is rejected
    empty = {"weights": {}, "bias": -20.0, "trans": np.ones((2, 2)), "doc": np.array([0.0, 0.0, np.log(share / (1 - share))])}
    if not y.any() or y.all():
        return empty
    docs, lengths = _tokens(texts)
    markers = _markers(docs, y, weight)
    if not markers:
        return empty
    number: dict[str, int] = {}
    words = np.array([number.setdefault(w, len(number)) for d in docs for w in d], np.int64)
    vocabulary = list(number)
    marked = np.array([not markers.isdisjoint(features(w)) for w in vocabulary])
    tag, often = marked[words] & np.repeat(y, lengths), np.repeat(times, lengths)
    # features: the markers of words that were labelled toxic at least once
    known = {f: i for i, f in enumerate(sorted({f for w in np.unique(words[tag]) for f in features(vocabulary[w]) if f in markers}))}
    row, col = zip(*[(w, known[f]) for w, word in enumerate(vocabulary) for f in features(word) if f in known], strict=True)
    row, col = np.array(row), np.array(col)
    weights, bias, logs = np.zeros(len(known)), np.log((often[tag].sum() + 1) / (often.sum() + 1)), np.zeros((2, 2))
    observed = np.zeros((2, 2))
    start = np.zeros(len(words), bool)
    start[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    at = np.flatnonzero(~start)
    np.add.at(observed, (tag[at - 1].astype(int), tag[at].astype(int)), often[at])
    # diagonal scaling: the squared gradient so far
    scale = [np.full_like(weights, 1e-8), 1e-8, np.full((2, 2), 1e-8)]
    for _ in range(rounds):
        emission = (bias + np.bincount(row, weights[col], len(vocabulary)))[words]
        ahead, after = forward_backward(emission, lengths, np.exp(logs))
        p = ahead * after / (1 + ahead * after)
        error = np.bincount(words, often * (tag - p), len(vocabulary))
        grads = [np.bincount(col, error[row], len(known)) - weights, error.sum(),
                 observed - _pairs(emission, ahead, after, at, np.exp(logs), often[at]) - 0.5 * logs]
        scale = [s + g * g for s, g in zip(scale, grads, strict=True)]
        weights, bias, logs = (v + 0.7 * g / np.sqrt(s) for v, g, s in zip((weights, bias, logs), grads, scale, strict=True))
    model = {"weights": {f: float(weights[i]) for f, i in known.items()}, "bias": float(bias), "trans": np.exp(logs), "doc": None}
    emission = bias + np.bincount(row, weights[col], len(vocabulary))
    model["doc"] = _logistic(_summary(marginals(emission[words], lengths, model["trans"]), lengths), y.astype(float), times)
    return model


def _summary(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document: log of the toxic words' number (sum of squared marginals, which long clean texts don't raise), and the largest marginal."""
    out = np.zeros((len(lengths), 2))
    some = lengths > 0
    starts = (np.cumsum(lengths) - lengths)[some]
    if len(starts):
        out[some, 0] = np.log1p(np.minimum(np.add.reduceat(p * p, starts), 20.0))
        out[some, 1] = np.maximum.reduceat(p, starts)
    return out


class Scorer:
    """The model with what a worker keeps: emissions of seen words, and the recursions of texts without any feature."""

    def __init__(self, model: dict):
        self.bias, self.trans, self.doc, self.weights = model["bias"], model["trans"], model["doc"], model["weights"]
        self.seen: dict[str, float] = {}
        # a word has a feature only if it is one or shares three letters at an end with one
        self.whole = {f for f in self.weights if "-" not in f}
        self.heads = {f[:3] for f in self.weights if f.endswith("-")}
        self.tails = {f[-3:] for f in self.weights if f.startswith("-")}
        self.ahead, self.after = np.empty(0), np.empty(0)

    def emission(self, word: str) -> float:
        if word in self.whole or word[:3] in self.heads or word[-3:] in self.tails:
            return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))
        return self.bias

    def emissions(self, words: list[str]) -> np.ndarray:
        seen, emission, out = self.seen, self.emission, []
        if len(seen) > MEMORY:
            seen.clear()
        for w in words:
            value = seen.get(w)
            if value is None:
                value = seen[w] = emission(w)
            out.append(value)
        return np.array(out, float)

    def plain(self, n: int) -> np.ndarray:
        """Marginals of n words without features: the recursions of one long text serve all lengths."""
        if len(self.ahead) < n:
            flat = np.full(2 * n, self.bias)
            self.ahead, after = forward_backward(flat, np.array([2 * n]), self.trans)
            self.after = after[::-1]
        odds = self.ahead[:n] * self.after[:n][::-1]
        return odds / (1 + odds)

    def marginals(self, emission: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """As the function ``marginals``; texts without a feature skip the recursion."""
        out, starts = np.empty(len(emission)), np.cumsum(lengths) - lengths
        special = np.zeros(len(lengths), bool)
        some = lengths > 0
        if some.any():
            special[some] = np.logical_or.reduceat(emission != self.bias, starts[some])
        for i in np.flatnonzero(some & ~special):
            out[starts[i]:starts[i] + lengths[i]] = self.plain(int(lengths[i]))
        rest = np.repeat(special, lengths)
        out[rest] = marginals(emission[rest], lengths[special], self.trans)
        return out

    def score(self, texts: list[str | None]) -> tuple[list[float], list[str], list[int]]:
        """Score, toxic spans (start:end in code points, comma-joined) and number of toxic words of each text."""
        texts = [t or "" for t in texts]
        docs, lengths = _tokens(texts)
        p = self.marginals(self.emissions([w for d in docs for w in d]), lengths)
        summary = _summary(p, lengths)
        score = 1 / (1 + np.exp(-np.clip(summary @ self.doc[:2] + self.doc[2], -30, 30)))
        spans, counts, starts = [], [], np.cumsum(lengths) - lengths
        for text, start, n, top in zip(texts, starts, lengths, summary[:, 1], strict=True):
            if top < 0.5:
                spans.append("")
                counts.append(0)
                continue
            hits = p[start:start + n] >= 0.5
            found, last = [], None
            for m, hit in zip(_words(text), hits, strict=True):
                if hit and last is not None:
                    found[-1][1] = m[1]
                elif hit:
                    found.append([*m])
                last = m if hit else None
            spans.append(",".join(f"{a}:{b}" for a, b in found))
            counts.append(int(hits.sum()))
        return score.tolist(), spans, counts


def _words(text: str) -> list[tuple[int, int]]:
    """Spans in ``text`` of the words of its lower-cased form."""
    low = text.lower()
    if len(low) == len(text):
        return [m.span() for m in WORD.finditer(low)]
    place = [i for i, c in enumerate(text) for _ in c.lower()]
    place += [len(text)] * (len(low) + 1 - len(place))
    return [(place[m.start()], place[m.end() - 1] + 1) for m in WORD.finditer(low)]


def held_out(doc_id: Column) -> Column:
    """True for ids that no label is learned from: crc32 of the id as text, modulo 5, is 0; null ids are not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> tuple[list[str], list[int], tuple[float, float]]:
    """At most ``max_docs`` labelled, not held-out texts of each class, by a hash of the id; equal texts once.

    Beside texts and labels, how many labels one of the sample stands for in
    the clean and the toxic class, the smaller as 1.
    """
    known = labels.select(labels["doc_id"], labels["toxic"].cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    lot, some = F.xxhash64(F.lit(11), "doc_id"), []
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    for c in (1, 0):
        of_class = hashed_sample(known.where(F.col("toxic") == c), F.col("doc_id"), counts.get(c, 0), max_docs + max_docs // 4)
        some.append(of_class.sort(lot, "doc_id").limit(max_docs))
    # at most 2 * max_docs rows: small by construction
    picked = F.broadcast(some[0].unionByName(some[1]).select(F.col("doc_id").alias("_id"), "toxic"))
    texts = docs.select(docs["doc_id"].alias("_doc"), docs["text"].alias("_text")).join(picked, F.col("_doc") == F.col("_id"))
    texts = texts.where(F.length("_text") <= max_chars).groupBy("_text").agg(F.max("toxic").alias("toxic"), F.min("_doc").alias("_doc"))
    rows = texts.sort("_doc").limit(2 * max_docs).collect()
    stands_for = [max(1.0, counts.get(c, 0) / max_docs) for c in (0, 1)]
    return [r["_text"] for r in rows], [r["toxic"] for r in rows], (stands_for[0] / min(stands_for), stands_for[1] / min(stands_for))


def toxicity_scores(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of every text under the model.

    Returns doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5),
    toxic_spans, n_toxic_words.

    Null and empty texts get the score of a text without toxic words; repeated
    rows stay; null ids are not held out; an empty table gives an empty
    result; other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    kind = docs.schema[id_col].dataType
    sent = docs.sparkSession.sparkContext.broadcast(model)
    scorer: list[Scorer] = []

    def run(columns):
        ids, texts = columns
        if not scorer:
            scorer.append(Scorer(sent.value))
        return [ids, *scorer[0].score(texts)]

    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    out = map_rows(slim, ["doc_id", "text"], run, f"doc_id {kind.simpleString()}, score double, toxic_spans string, n_toxic_words long",
                   [to_arrow_type(kind), pa.float64(), pa.string(), pa.int64()], ["doc_id", "score", "toxic_spans", "n_toxic_words"], ROWS)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                      "toxic_spans", "n_toxic_words")


def trained(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> dict:
    return fit(*training_sample(docs, labels, max_docs, max_chars))


def without_toxic(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below 0.5, all columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    scorer: list[Scorer] = []

    def judged(texts):
        if not scorer:
            scorer.append(Scorer(sent.value))
        return None, [s < 0.5 for s in scorer[0].score(texts)[0]]

    return rewrite_rows(docs, text_col, judged, ROWS)
