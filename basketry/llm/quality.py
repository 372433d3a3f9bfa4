"""Quality rules as weak supervision.

Each rule looks at a whole text and votes good, bad or abstains.  How often a
rule is right is not known beforehand: expectation-maximisation (Dawid-Skene,
one confusion row a class and rule) estimates it from how the rules agree over
all documents, and the posterior probability of "good" replaces an all-must-
pass filter.  Documents enter the estimate through counts of their vote
patterns, of which there are at most 3 ** rules, so it covers every document
and its cost on the driver does not grow with them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import map_rows, staged

SYMBOLS = "#*$%&|<>"
BAD, ABSTAIN, GOOD = 0, 1, 2
ROUNDS = 200
_LETTERS = re.compile(r"[^\W\d_]+")
#: Words of letters with at most one mark at the end.
_PLAIN = re.compile(r"(?<![^\x20\x09-\x0D])[^\W\d_]+[^\w\x20\x09-\x0D]?(?![^\x20\x09-\x0D])")
_WHITE = re.compile(r"[\x20\x09-\x0D]+")

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RULES = ["length", "repetition", "symbols", "lines", "word_length", "capitals", "marks", "plain_words", "variety", "numbers"]


def repeat_words(words: list) -> int:
    """Words in 3-word windows that are found twice or more, the first find included."""
    if len(words) < 4:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) < 1 << 21:  # three numbers fit 63 bits
        n = len(number)
        window = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    else:
        rows = np.stack((ids[:-2], ids[1:-1], ids[2:]), 1)
        window = np.unique(rows, axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(window, kind="stable")
    ranked = window[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(len(window), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift:len(window) + shift] |= again
    return int(covered.sum())


def text_stats(text: str) -> tuple[list[int], list[int]]:
    """The five base counts and the votes of the rules."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    word_chars = sum(len(x) for x in _WHITE.split(text))
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    seen, n_lines, dup = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.strip():
            n_lines += 1
            dup += line in seen
            seen.add(line)
    repeated = repeat_words(words)
    stats = [n, word_chars, n_symbols, dup, repeated]
    if not n:
        return stats, [BAD] + [ABSTAIN] * (len(RULES) - 1)
    letters = sum(map(len, _LETTERS.findall(text)))
    capitals = sum(map(str.isupper, text)) if not text.isascii() else len(raw) - len(raw.translate(None, _CAPITALS))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    marks = word_chars - letters - digits
    plain = len(_PLAIN.findall(text))
    mean, kinds = word_chars / n, len(set(words))
    vote = lambda bad, good=False: BAD if bad else GOOD if good else ABSTAIN
    return stats, [
        vote(n < 50, n >= 100),
        vote(5 * repeated > n, n >= 50 and 50 * repeated < n),
        vote(10 * n_symbols > n),
        vote(4 * dup > n_lines),
        vote(mean < 2.5 or mean > 15),
        vote(4 * capitals > letters),
        vote(5 * marks > word_chars, 10 * marks < word_chars),
        vote(10 * plain < 8 * n, 10 * plain >= 9 * n),
        vote(n >= 50 and 3 * kinds < n and n < 2000 or 20 * kinds < n),
        vote(5 * digits > word_chars),
    ]


_CAPITALS = bytes(range(65, 91))


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts and the vote pattern (base 3, first rule lowest) of every row; null texts are empty."""
    from pyspark.sql.pandas.types import to_arrow_type
    kind = docs.schema[id_col].dataType

    def run(columns):
        ids, texts = columns
        out = [[] for _ in STATS]
        patterns = []
        for text in texts:
            stats, votes = text_stats(text or "")
            for column, value in zip(out, stats, strict=True):
                column.append(value)
            patterns.append(sum(v * 3 ** i for i, v in enumerate(votes)))
        return [ids, *out, patterns]

    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    names = ["doc_id", *STATS, "pattern"]
    schema = f"doc_id {kind.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:])
    return map_rows(slim, ["doc_id", "text"], run, schema, [to_arrow_type(kind), *[pa.int64()] * 6], names)


def votes_of(patterns: np.ndarray, rules: int) -> np.ndarray:
    return (patterns[:, None] // 3 ** np.arange(rules)) % 3


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS, start: float = 0.8) -> dict:
    """Expectation-maximisation over vote patterns and their counts.

    Starts from rules that are right with probability ``start`` when they
    vote, and keeps each rule on its side: it votes bad at least as often on
    bad documents as on good ones.  Returns prior (of good), table[rule, class, vote] and posterior (of
    good, a pattern).  Adds one imagined document a cell, so no vote has
    probability zero.
    """
    rules = votes.shape[1] if votes.ndim == 2 else 0
    score = ((votes == GOOD).sum(1) - (votes == BAD).sum(1)) * np.log(start / (1 - start))
    good = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
    prior, table = 0.5, np.full((rules, 2, 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack((counts * (1 - good), counts * good))
        prior = (weight[1].sum() + 1) / (weight.sum() + 2)
        for r in range(rules):
            for v in range(3):
                table[r, :, v] = weight[:, votes[:, r] == v].sum(1) + 1
        table /= table.sum(2, keepdims=True)
        for v, side in ((BAD, 1), (GOOD, 0)):  # a vote that speaks for the other class counts as saying nothing
            wrong = table[:, side, v] > table[:, 1 - side, v]
            pooled = (weight.sum(1) + 1) / (weight.sum() + 2)
            table[wrong, :, v] = (table[wrong, :, v] @ pooled)[:, None]
        logs = np.log(np.array([1 - prior, prior]))[:, None] + sum(np.log(table[r][:, votes[:, r]]) for r in range(rules))
        before, good = good, 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(before - good).max(initial=0) < 1e-9:
            break
    return {"prior": prior, "table": table, "posterior": good}


def quality(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, posterior quality and verdict of every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, quality (posterior probability of
    good).  kept is false if base_failed, else quality >= threshold.

    Null and empty texts have zero counts and fail; repeated rows stay; an
    empty table gives an empty result; other columns are ignored.
    """
    rows = staged(text_features(docs, id_col, text_col), "quality-features")
    # at most 3 ** len(RULES) rows
    counted = rows.groupBy("pattern").count().sort("pattern").collect()
    patterns, counts = (np.array([r[c] for r in counted], np.int64) for c in ("pattern", "count"))
    good = estimate(votes_of(patterns, len(RULES)), counts)["posterior"]
    table = docs.sparkSession.createDataFrame([(int(p), float(g)) for p, g in zip(patterns, good, strict=True)], "pattern long, quality double")
    out = rows.join(F.broadcast(table), "pattern")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", *STATS, failed.alias("base_failed"), (~failed & (F.col("quality") >= threshold)).alias("kept"), "quality")
