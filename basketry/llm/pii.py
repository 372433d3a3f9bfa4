"""Personal data by a semi-Markov conditional random field.

Base patterns find e-mail addresses, IP addresses, cards and phone numbers;
they read greedily and drop what they overran ("two cards in a row").  The
field looks at the regions where digits or an at sign stand: a segment is a
run of at most ``MAX_DIGITS`` digits in units (digit groups, letter runs, single marks),
its score the weighted sum of features of the whole span (digits, grouping,
check digit, part values, neighbours).  Dynamic programming over segments and
their types chooses boundaries and types of a region together; everything
outside segments scores 0.  Segments are bounded by digits (19, which a card
may have), however they are grouped.  Address regions are those of the base
pattern: an address has no other form, there the field only weighs it against
numbers that touch it.

Weights maximise the likelihood of the base spans on a bounded sample of
regions, expectations by the forward-backward recursion over segments.  Base
spans always stay; the field adds segments that overlap none of them.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import hashed_sample, map_rows, rewrite_rows

KINDS = ("email", "ip", "card", "phone")
#: Longest segment, in digits and in units (a digit and three marks each): entities are bounded, so the recursion is linear in the text.
MAX_DIGITS = 19
MAX_UNITS = 4 * MAX_DIGITS
#: Segments that are scored together.
BATCH = 8_192
#: Bounds of the training sample: texts with candidates, texts they are looked for in, characters of one, regions of a label.
MAX_DOCS = 2_000
SAMPLE_TEXTS = 40_000
MAX_CHARS = 20_000
MAX_REGIONS = 200
ROUNDS = 60
UNSEEN = -2.0

#: The base patterns. A match can only start where a digit run starts, which the look-behind says in constant time.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DIGIT = re.compile(r"[0-9]")

#: Regions: digits with at most three marks between groups, or what surrounds an at sign.
_NUMBERS = re.compile(r"[+(]{0,2}[0-9](?:[\x20().:/+-]{0,3}[0-9])+")
_UNIT = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _ip_parts_hold(text: str) -> bool:
    return all(p.isdigit() and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, each at sign looked at once."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns that hold."""
    found = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found += [(*m.span(), 1) for m in IP.finditer(text) if _ip_parts_hold(m[0])]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), 2))
    if "+" in text:
        found += [(*m.span(), 3) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15]
    return found


def regions(text: str) -> list[tuple[int, int]]:
    """Spans that may hold personal data: numbers of seven digits or more and surroundings of at signs; merged where they touch."""
    found = []
    if _DIGIT.search(text):
        found += [m.span() for m in _NUMBERS.finditer(text) if sum(map(str.isdigit, m[0])) >= 7]
    found += [(a, b) for a, b in emails(text)] if "@" in text else []
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: Every digit as 0: features ask where digits stand, but for check digits and address parts.
_SHAPE = str.maketrans("123456789", "0" * 9)


@lru_cache(maxsize=100_000)
def segment_features(before: str, span: str, after: str, check: bool, parts: bool) -> tuple[str, ...]:
    """Features of a span, digits written as 0, between the character before and the two after it.

    ``check``: its digits end in a check digit; ``parts``: it is four numbers
    of at most 255.
    """
    groups = re.findall(r"[0-9]+", span)
    n = sum(map(len, groups))
    marks = "".join(sorted({c for c in span if not c.isalnum()}))
    out = [f"marks={marks}", f"digits={n if n < 20 else '20+'}", f"groups={min(len(groups), 6)}",
           f"first={'d' if span[0].isdigit() else 'a' if span[0].isalpha() else span[0]}",
           f"last={'d' if span[-1].isdigit() else 'a' if span[-1].isalpha() else 'm'}"]
    if any(c.isalpha() for c in span):
        out.append("letters")
    # what each kind must be, told either way
    out.append("no-address" if "@" not in span else "address" if emails(span) == [(0, len(span))] else "broken-address")
    out.append(f"ats={min(span.count('@'), 2)}")
    quad = marks == "." and span.count(".") == 3 and len(groups) == 4
    out.append("no-quad" if not quad else "quad" if parts else "bad-quad")
    if 12 <= n <= 19 and not set(marks) - set(" -"):
        out.append("check-digit" if check else "no-check-digit")
        out.append("even-groups" if len({len(g) for g in groups}) == 1 else "uneven-groups")
    else:
        out.append("no-card-digits")
    out.append("no-plus" if not span.startswith("+") else "plus-9-15" if 9 <= n <= 15 else "plus-other")
    if span.startswith("+"):
        out.append(f"country={min(len(groups[0]), 4) if groups else 0}")
    if n and not span.startswith("+") and 7 <= n <= 15:
        out.append(f"grouping={'-'.join(str(len(g)) for g in groups) if len(groups) < 6 else 'many'}")
    following = after[:1]
    if before.isalnum() or before in ("@", "_"):
        out.append("glued-before")
    if following.isalnum() or following in ("@", "_"):
        out.append("glued-after")
    if following in (".", "-") and after[1:].isdigit() or before in (".", "-", "+") and span[0].isdigit():
        out.append("cut-number")
    if "@" in span and following and following in ".-" and after[1:].isalnum():
        out.append("cut-address-after")
    if "@" in span and before and before in "._%+-":
        out.append("cut-address-before")
    return tuple(out)


def units_of(text: str, start: int, end: int) -> list[int]:
    """Bounds of the units of a region: digit groups, letter runs, single marks."""
    return [start, *[m.end() for m in _UNIT.finditer(text, start, end)]]


def candidates(text: str, bounds: list[int]) -> Iterator[tuple[int, int, tuple[str, ...], tuple[bool, ...]]]:
    """Segments of a region by their first unit: (first unit, unit after the last, features, admissible kinds).

    Segments start at a digit group, a letter run, ``+`` or a bracket, end at
    one of these but ``+``, and can be of some kind: an address, four parts up
    to 255, 12 to 19 digits with a check digit, or 7 to 15 digits without
    letters, open brackets and double blanks.  Running counts over the units
    tell most of that before any feature is made.
    """
    n = len(bounds) - 1
    units = [text[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    lead, top = max(bounds[0] - 1, 0), bounds[-1] + 2
    shape = text[lead:top].translate(_SHAPE)

    def so_far(flags: Iterable) -> list[int]:
        return [0, *accumulate(flags)]
    number = ["0" <= u[0] <= "9" for u in units]
    digits = so_far(len(u) if is_number else 0 for u, is_number in zip(units, number, strict=True))
    groups, letters, ats = so_far(number), so_far(u[0].isalpha() for u in units), so_far(u == "@" for u in units)
    brackets, dots = so_far((u == "(") - (u == ")") for u in units), so_far(u == "." for u in units)
    blanks = so_far(u == " " and t > 0 and units[t - 1] == " " for t, u in enumerate(units))
    no_card = so_far(not u[0].isalnum() and u not in " -" for u in units)
    no_quad = so_far(u[0] != "." and not is_number for u, is_number in zip(units, number, strict=True))
    ends = [u[0].isalnum() or u == ")" for u in units]
    # check sums of all digits so far, those at even and those at odd places doubled
    twice = [[], []]
    for place, c in enumerate("".join(u for u, is_number in zip(units, number, strict=True) if is_number)):
        d = ord(c) - 48
        twice[place % 2].append(2 * d - 9 * (d > 4))
        twice[1 - place % 2].append(d)
    twice = [so_far(t) for t in twice]
    for i, first in enumerate(units):
        if not (first[0].isalnum() or first in "+("):
            continue
        last, d_i, a = min(n, i + MAX_UNITS), digits[i], bounds[i]
        address = ats[last] > ats[i]
        before = shape[a - lead - 1:a - lead] if a > lead else ""
        for j in range(i + 1, last + 1):
            d_j = digits[j]
            n_digits = d_j - d_i
            if n_digits > MAX_DIGITS and not address:
                break
            if not ends[j - 1]:
                continue
            check = parts = False
            if address and ats[j] > ats[i]:
                if ats[j] - ats[i] > 1 or emails(text[a:bounds[j]]) != [(0, bounds[j] - a)]:
                    continue
                kinds = (True, False, False, False)
            elif 4 <= n_digits <= MAX_DIGITS:
                # the last digit counts once, the one before it twice
                check = n_digits >= 12 and (twice[d_j % 2][d_j] - twice[d_j % 2][d_i]) % 10 == 0
                parts = (groups[j] - groups[i] == 4 and dots[j] - dots[i] == 3 and no_quad[j] == no_quad[i]
                         and _ip_parts_hold(text[a:bounds[j]]))
                card = check and no_card[j] == no_card[i]
                phone = 7 <= n_digits <= 15 and letters[j] == letters[i] and brackets[j] == brackets[i] and blanks[j] == blanks[i]
                if not (parts or card or phone):
                    continue
                kinds = (False, parts, card, phone)
            else:
                continue
            b = bounds[j] - lead
            yield i, j, segment_features(before, shape[a - lead:b], shape[b:b + 2], check, parts), kinds


def _scores(segments: list, number: dict[str, int], weights: np.ndarray, seen: dict | None = None) -> np.ndarray:
    """Segments x kinds: bias plus weights; a feature that was never seen counts UNSEEN, what can't be scores minus infinity.

    ``seen`` keeps the sums of sets of features.
    """
    seen, out = {} if seen is None else seen, []
    for _, _, names, _ in segments:
        row = seen.get(names)
        if row is None:
            rows = [0, *[number[f] for f in names if f in number]]
            row = seen[names] = weights[rows].sum(0) + UNSEEN * (len(names) + 1 - len(rows))
        out.append(row)
    return np.where(np.array([s[3] for s in segments], bool).reshape(-1, len(KINDS)), np.array(out).reshape(-1, len(KINDS)), -np.inf)


def _best_of(n: int, scored: Iterable[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """(first unit, unit after the last, kind) of the best segmentation, given (first, after, kind, score) by first unit.

    Ties go to fewer segments.  Only a few values a unit are kept, so a region
    of any length passes segment by segment.
    """
    best, back, offer, done = [0.0] * (n + 1), [None] * (n + 1), [(0.0, None)] * (n + 1), 0

    def settle(after: int, upto: int) -> int:
        for j in range(after + 1, upto + 1):
            value, way = offer[j]
            best[j], back[j] = (value, way) if way and value > best[j - 1] + 1e-12 else (best[j - 1], None)
        return upto
    for i, j, kind, score in scored:
        if i > done:
            done = settle(done, i)
        value = best[i] + score
        if score > 0 and value > offer[j][0] + 1e-12:
            offer[j] = value, (i, kind)
    settle(done, n)
    out, j = [], n
    while j > 0:
        if back[j]:
            i, kind = back[j]
            out.append((i, j, kind))
            j = i
        else:
            j -= 1
    return out[::-1]


def best_segments(n: int, segments: list, scores: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation of n units out of ``segments`` (by first unit) with ``scores`` of each kind."""
    return _best_of(n, ((s[0], s[1], int(k), float(v)) for s, k, v in zip(segments, scores.argmax(1), scores.max(1), strict=True)))


def expected(n: int, segments: list, scores: np.ndarray) -> tuple[float, np.ndarray]:
    """Log of the partition sum over all segmentations, and the probability of each segment and kind."""
    ahead, after = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = after[n] = 0.0
    whole = np.logaddexp.reduce(scores, axis=1) if len(segments) else np.zeros(0)
    ending, starting = {}, {}
    for r, (i, j, *_) in enumerate(segments):
        ending.setdefault(j, []).append(r)
        starting.setdefault(i, []).append(r)
    first = np.array([s[0] for s in segments], int)
    last = np.array([s[1] for s in segments], int)
    for j in range(1, n + 1):
        rows = ending.get(j, [])
        ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[first[rows]] + whole[rows])])
    for i in range(n - 1, -1, -1):
        rows = starting.get(i, [])
        after[i] = np.logaddexp.reduce([after[i + 1], *(after[last[rows]] + whole[rows])])
    if not len(segments):
        return 0.0, np.zeros((0, len(KINDS)))
    return float(ahead[n]), np.exp(scores + (ahead[first] + after[last] - ahead[n])[:, None])


def fit(texts: list[str], rounds: int = ROUNDS, max_regions: int = MAX_REGIONS) -> dict:
    """Weights by maximum likelihood of the base spans: {features: name -> row, weights: row x kind, row 0 the bias}.

    Regions that the base patterns overran (more digits than any kind has, and no
    base span) say nothing about labels and are left out.
    """
    examples, per_label = [], {}
    for text in texts:
        base = base_spans(text)
        for a, b in regions(text):
            inside = [s for s in base if s[0] < b and a < s[1]]
            n_digits = sum(map(str.isdigit, text[a:b]))
            if len({(x, y) for x, y, _ in inside}) > 1 or not inside and n_digits > 19 or any(x < a or y > b for x, y, _ in inside):
                continue
            label = inside[0][2] if inside else -1
            if per_label.get(label, 0) >= max_regions:
                continue
            bounds = units_of(text, a, b)
            segments = list(candidates(text, bounds))
            gold = [r for r, (i, j, *_) in enumerate(segments) if inside and (bounds[i], bounds[j]) == inside[0][:2]]
            if inside and not gold or not segments:
                continue
            per_label[label] = per_label.get(label, 0) + 1
            examples.append((len(bounds) - 1, segments, gold[0] if gold else None, label))
    names = sorted({f for _, segments, _, _ in examples for _, _, fs, _ in segments for f in fs})
    number = {f: i + 1 for i, f in enumerate(names)}
    weights = np.zeros((len(names) + 1, len(KINDS)))
    weights[0] = -1.0
    rows = [[np.array([0, *[number[f] for f in fs]]) for _, _, fs, _ in segments] for _, segments, _, _ in examples]
    flat = [(np.concatenate(r), np.repeat(np.arange(len(r)), [len(x) for x in r])) for r in rows]
    scale = np.full_like(weights, 1e-6)
    for _ in range(rounds):
        grad = -0.02 * weights
        for (n, segments, gold, kind), (cols, owner) in zip(examples, flat, strict=True):
            scores = np.zeros((len(segments), len(KINDS)))
            np.add.at(scores, owner, weights[cols])
            scores[~np.array([s[3] for s in segments])] = -np.inf
            p = -expected(n, segments, scores)[1]
            if gold is not None:
                p[gold, kind] += 1
            np.add.at(grad, cols, p[owner])
        scale += grad * grad
        weights += 0.5 * grad / np.sqrt(scale)
    return {"features": number, "weights": weights}


def field_spans(text: str, model: dict) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the segments that the field chooses."""
    out, seen = [], model.setdefault("seen", {})
    if len(seen) > 100_000:
        seen.clear()

    def scored(bounds):
        for some in batched(candidates(text, bounds), BATCH):
            scores = _scores(some, model["features"], model["weights"], seen)
            kinds, values = scores.argmax(1).tolist(), scores.max(1).tolist()
            yield from ((s[0], s[1], k, v) for s, k, v in zip(some, kinds, values, strict=True) if v > 0)
    for a, b in regions(text):
        bounds = units_of(text, a, b)
        out += [(bounds[i], bounds[j], k) for i, j, k in _best_of(len(bounds) - 1, scored(bounds))]
    return out


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end by start, then kind, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def all_spans(text: str, model: dict) -> tuple[list, list]:
    """Base spans, and those that the field adds beside them."""
    base = base_spans(text)
    if "@" not in text and not _DIGIT.search(text):
        return base, []
    merged = sorted((a, b) for a, b, _ in base)
    ends, top = [], 0
    for _, b in merged:
        top = max(top, b)
        ends.append(top)
    starts = [a for a, _ in merged]

    def free(a, b):
        i = bisect.bisect_left(starts, b)
        return i == 0 or ends[i - 1] <= a
    return base, [s for s in field_spans(text, model) if free(s[0], s[1])]


def scan_text(text: str | None, model: dict) -> tuple:
    base, added = all_spans(text or "", model)
    counts = [sum(s[2] == k for s in base) for k in range(len(KINDS))]
    return (*counts, hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(base + added), len(added))


def redact(text: str | None, model: dict) -> str | None:
    """The text with each span replaced by its kind in square brackets; overlapping spans become one, named by the first."""
    if text is None:
        return None
    base, added = all_spans(text, model)
    out, at = [], 0
    for a, b, k in sorted(base + added, key=lambda s: (s[0], -s[1], s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def training_sample(docs: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS, texts: int = SAMPLE_TEXTS, text_col: str = "text") -> list[str]:
    """At most ``max_docs`` distinct texts with a long number or an at sign, out of a hash sample of about ``texts`` texts."""
    t = docs.select(docs[text_col].cast("string").alias("t"))
    t = hashed_sample(t, F.col("t"), docs.count(), texts).where((F.length("t") <= max_chars) & F.col("t").rlike("[0-9][0-9 ().-]{5,}[0-9]|@"))
    picked = t.select("t", F.xxhash64("t").alias("h")).distinct().sort("h", "t").limit(max_docs)
    return [r["t"] for r in picked.collect()]


def trained(docs: DataFrame, text_col: str = "text", **bounds) -> dict:
    return fit(training_sample(docs, text_col=text_col, **bounds))


def pii_scan(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every whole text.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base
    spans), spans (all spans), n_added.

    Null and empty texts have no spans (base_sha256 is that of the empty
    string); repeated rows stay; null ids stay null; an empty table gives an
    empty result; other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    kind = docs.schema[id_col].dataType
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(columns):
        ids, texts = columns
        return [ids, *([list(c) for c in zip(*(scan_text(t, sent.value) for t in texts), strict=True)] if texts else [[]] * 7)]

    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]
    schema = f"doc_id {kind.simpleString()}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return map_rows(slim, ["doc_id", "text"], run, schema, [to_arrow_type(kind), *[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()], names)


def redacted(docs: DataFrame, model: dict, text_col: str = "text", lengths: str | None = "n_chars") -> DataFrame:
    """All rows and columns, each span of the text replaced by its kind; a column of text lengths follows. Null texts stay null."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return rewrite_rows(docs, text_col, lambda texts: ([redact(t, sent.value) for t in texts], None), lengths=lengths)
