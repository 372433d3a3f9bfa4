"""Packing into fixed windows by minimum bin slack.

Each task tokenizes its rows, lays whole windows of long documents out at once
and keeps the remainders (lengths 1 to window - 1) as a histogram.  A window
takes the longest remainder left and the multiset of others that fills it
best: a subset-sum dynamic program over bitsets, one bitset a length, from
which the count of each length is read backwards.  A multiset is used as often
as the histogram allows, so a hot length costs no more than a rare one.  If no
multiset fills a window, the front of the next longest remainder is cut off to
fit; only the last window of a buffer is padded.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from basketry.llm.common import ship_package, sliced

WINDOW = 1024
END_ID = 0
#: Tokens of remainders that a task holds before it packs them: the bound of its memory. A buffer ends with one padded window.
BUFFER_TOKENS = 16_000_000
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50_256

#: Runs of white space from this length on are encoded as pieces of their own: the pattern's look-ahead keeps one state
#: a character of a run, and tiktoken panics at 1,000,000 of them.
LONG_RUN = 100_000
#: Two or more characters of the pattern's ``\\s`` (Python's own also has U+001C to U+001F).
_RUNS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{2,}")

_encoders: dict[tuple[str, bool], object] = {}


def default_ranks() -> str:
    """The rank file of the byte-level BPE vocabulary ``byte_bpe_50k``."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str, one_piece: bool = False):
    """The vocabulary as merge ranks, loaded once a worker; the same ids as the JSON form, several times faster.

    With ``one_piece`` texts are not split before the merges, so no look-ahead is needed.
    """
    if (path, one_piece) not in _encoders:
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = r"(?s:.+)" if one_piece else public_tokenizers.PATTERN
        _encoders[path, one_piece] = tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
    return _encoders[path, one_piece]


def _ids_around_runs(text: str, path: str) -> list[int]:
    """Ids of a text without special tokens, its long runs of white space taken out of the pattern's way.

    As the pattern does, a run is one piece up to its last character, which goes
    with what follows; at the text's end the whole run is the piece.
    """
    ids, at = [], 0
    for run in _RUNS.finditer(text):
        if run.end() - run.start() >= LONG_RUN:
            end = run.end() - (run.end() < len(text))
            ids += encoder(path).encode_ordinary(text[at:run.start()])
            ids += encoder(path, True).encode_ordinary(text[run.start():end])
            at = end
    return ids + encoder(path).encode_ordinary(text[at:])


def token_ids(text: str | None, path: str) -> np.ndarray:
    """Ids of the text and the end id, as little-endian 32-bit numbers. The special token's string is that token."""
    text = text or ""
    e = encoder(path)
    if len(text) >= LONG_RUN:
        ids = []
        for i, part in enumerate(text.split(SPECIAL)):
            ids += [SPECIAL_ID] * (i > 0)
            ids += _ids_around_runs(part, path)
    else:
        ids = e.encode(text, allowed_special="all") if SPECIAL in text else e.encode_ordinary(text)
    ids.append(END_ID)
    return np.array(ids, "<u4")


def best_fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of ``lengths`` (falling, each at most its count) whose sum comes closest to ``room`` from below.

    reach[i] has bit s if the first i lengths give the sum s.  Stops as soon as
    ``room`` itself is reached.
    """
    mask = (1 << (room + 1)) - 1
    reach, used = [1], []
    for length in lengths:
        if length > room:
            continue
        now, left, step = reach[-1], min(counts[length], room // length), 1
        while left:  # copies in powers of two: every count up to the limit
            take = min(step, left)
            now |= (now << (take * length)) & mask
            left -= take
            step *= 2
        if now != reach[-1]:
            reach.append(now)
            used.append(length)
        if now >> room & 1:
            break
    total, chosen = reach[-1].bit_length() - 1, {}
    for i in range(len(used) - 1, -1, -1):
        k = 0
        while not reach[i] >> total & 1:
            total -= used[i]
            k += 1
        if k:
            chosen[used[i]] = k
    return chosen


def pack(stock: dict[int, list], window: int) -> Iterator[list[tuple[int, object, int, int]]]:
    """Windows of (length, item, start, item's rest length) from the stock: length -> list of (item, start).

    Every item of the stock appears whole or cut into consecutive parts, each
    exactly once.  All windows but the last are full.
    """
    while stock:
        lengths = sorted(stock, reverse=True)
        largest = lengths[0]
        counts = {n: len(v) for n, v in stock.items()}
        counts[largest] -= 1
        chosen = best_fill([n for n in lengths if counts[n]], counts, window - largest)
        chosen[largest] = chosen.get(largest, 0) + 1
        slack = window - sum(n * k for n, k in chosen.items())
        times = 1 if slack else min(len(stock[n]) // k for n, k in chosen.items())
        for _ in range(times):
            row = [(n, *stock[n].pop()) for n, k in chosen.items() for _ in range(k)]
            for n in chosen:
                if not stock.get(n, True):
                    del stock[n]
            if slack and stock:
                n = max(stock)  # longer than the slack, or it would have filled it better
                item, start = stock[n].pop()
                if not stock[n]:
                    del stock[n]
                row.append((slack, item, start))
                stock.setdefault(n - slack, []).append((item, start + slack))
            yield row


def pack_rows(ids: list, texts: list, path: str, window: int, state: dict) -> Iterator[tuple]:
    """Pieces (doc, start, length, crc, doc tokens, sequence, offset) that are ready; remainders stay in ``state``."""
    for doc, text in zip(ids, texts, strict=True):
        tokens = token_ids(text, path)
        total = len(tokens)
        whole = total - total % window
        for start in range(0, whole, window):
            yield doc, start, window, zlib.crc32(tokens[start:start + window].tobytes()), total, state["sequence"], 0
            state["sequence"] += 1
        if whole < total:
            state["stock"].setdefault(total - whole, []).append(((doc, whole, total, tokens[whole:].astype("<u2" if tokens.max() < 65536 else "<u4")), 0))
            state["held"] += total - whole


def pack_stock(window: int, state: dict) -> Iterator[tuple]:
    for row in pack(state["stock"], window):
        at = 0
        for length, (doc, base, total, tokens), start in row:
            yield doc, base + start, length, zlib.crc32(tokens[start:start + length].astype("<u4").tobytes()), total, state["sequence"], at
            at += length
        state["sequence"] += 1
    state["stock"], state["held"] = {}, 0


def packed(docs: DataFrame, window: int = WINDOW, ranks: str | None = None, buffer_tokens: int = BUFFER_TOKENS,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens.

    Returns doc_id, start (tokens of the document before the piece), length,
    ids_crc32 (of the ids as little-endian 32-bit numbers), doc_tokens (with
    the end id), sequence_id, offset (in the sequence, gapless from 0).  A
    sequence id holds the number of the partition, so tasks need not agree on
    anything and a task that runs again on its partition gives the same rows.

    Null and empty texts are the end id alone; repeated rows are packed each;
    null ids stay null; an empty table gives an empty result; other columns
    are ignored.  Texts are packed whole, whatever their length.
    """
    path = ranks or default_ranks()
    kind = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    types = [to_arrow_type(kind), *[pa.int64()] * 6]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        state = {"stock": {}, "held": 0, "sequence": TaskContext.get().partitionId() << 36}

        def table(rows):
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], names=names)

        for part in sliced(batches):
            ids, texts = (c.to_pylist() for c in part.columns)
            rows = list(pack_rows(ids, texts, path, window, state))
            if state["held"] > buffer_tokens:
                rows += pack_stock(window, state)
            if rows:
                yield table(rows)
        yield table(list(pack_stock(window, state)))

    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(n, T.LongType()) for n in names[1:]]])
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    ship_package(docs.sparkSession)
    return slim.mapInArrow(run, schema)
