"""Substring dedup by suffix automata of reference shards.

A window is ``length`` consecutive words.  A word goes if a window over it
also starts in a document with a smaller id.

Streaming every document through an automaton of every reference shard would
take the corpus squared, so documents are routed to the shards that concern
them.  Each window names an anchor: its smallest hash of ``GRAM`` consecutive words.
Equal windows have equal anchors, and neighbouring windows mostly share one.
One grouped count finds the anchors of more than one document and the first
document of each, its reference.  A maximal run of windows whose anchors have one
reference is a passage; equal passages are counted once with their smallest
document.

Passages are dealt into shards by their reference document; those of a
reference with more different words than a shard holds are dealt window by
window instead, so no shard grows with a popular document.  A shard's passages
are the reference text of one suffix automaton, whose states carry the smallest
document that they occur in.  Streaming the passages through it gives the
matching statistics: at each word the longest match, and the state of its last
``length`` words says who has the window first.  Hashes only route; which windows
are equal is decided by their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.columns import let
from basketry.llm.common import by_bytes, filled, ship_package, sliced, staged, text_bytes

LENGTH = 13
#: Words of an anchor: a window has LENGTH - GRAM + 1 of them to choose from.
GRAM = 5
#: About so many words of reference text go into one automaton: the bound of a task's memory, not of what is found.
SHARD_WORDS = 50_000
#: Rows (of two numbers) up to which the table of such references is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Bytes of text whose words are hashed at a time; eight-byte numbers make it some fifty times as much.
SLICE_BYTES = 1_000_000
#: Odd multipliers of the hashes.
_BYTE, _WORD, _MIX = (np.uint64(v) for v in (0x100000001B3, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BYTE to the powers 0 to n, and their inverses modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) <= n:
        inverse = np.uint64(pow(int(_BYTE), -1, 1 << 64))
        _POWERS[:] = [np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, b, np.uint64)))) for b in (_BYTE, inverse)]
    return _POWERS[0][:n + 1], _POWERS[1][:n + 1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word in rows of bytes."""
    if not len(data):
        return (np.empty(0, np.int64),) * 3
    word = ~((data == 0x20) | (data >= 0x09) & (data <= 0x0D))
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    stop = word.copy()
    stop[:-1] &= ~word[1:]
    edge = bounds[:-1][bounds[:-1] < bounds[1:]]
    begin[edge] = word[edge]
    stop[edge[1:] - 1] = word[edge[1:] - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(bounds, starts, side="right") - 1


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """First word, row, anchor hash and anchor place of every window of the rows, and their words.

    The anchor is the smallest hash of ``gram`` words in the window, the first of equal ones.
    """
    starts, ends, row = words = words_of(data, bounds)
    n = len(starts) - length + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 4 + (words,)
    up, down = _powers(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])))
    h = _mixed((sums[ends] - sums[starts]) * down[starts])
    grams = np.zeros(len(h) - gram + 1, np.uint64)
    for j in range(gram):
        grams = grams * _WORD + h[j:j + len(grams)]
    grams = _mixed(grams)
    least, at = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, length - gram + 1):
        less = grams[j:j + n] < least
        np.copyto(least, grams[j:j + n], where=less)
        at[less] = j
    window = np.flatnonzero(row[:n] == row[length - 1:])
    return window, row[window], least[window].view(np.int64), window + at[window], words


def passages(data: np.ndarray, bounds: np.ndarray, shared: list[tuple[np.ndarray, np.ndarray]], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int, bytes]]:
    """(row, first word of the row, route, words) of the runs of windows whose anchors have one route.

    ``shared``: for each row its anchors of more than one document, rising, and their
    routes.  Words of the rows are parted by one space.
    """
    window, row, value, _, (starts, ends, word_row) = anchors(data, bounds, length, gram)
    edges = np.searchsorted(row, np.arange(len(bounds)))
    first_word = np.searchsorted(word_row, np.arange(len(bounds)))
    for r, (known, routes) in enumerate(shared):
        a, b = edges[r], edges[r + 1]
        if a == b or not len(known):
            continue
        place = np.minimum(np.searchsorted(known, value[a:b]), len(known) - 1)
        hit, route = known[place] == value[a:b], routes[place]
        change = np.flatnonzero(np.concatenate(([True], (hit[1:] != hit[:-1]) | (route[1:] != route[:-1]) & hit[1:])))
        for i, j in zip(change.tolist(), [*change[1:].tolist(), b - a], strict=True):
            if hit[i]:
                w = int(window[a + i])
                yield r, w - int(first_word[r]), int(route[i]), data[starts[w]:ends[w + j - i + length - 2]].tobytes()


class SuffixAutomaton:
    """Of several word sequences; each state knows the smallest document that its words occur in."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def _state(self, length: int, link: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.first.append(None)
        return len(self.link) - 1

    def _split(self, p: int, word, q: int) -> int:
        """A copy of state ``q`` for the words that reach it from ``p`` and up."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, word) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        state, p = self._state(self.length[last] + 1, 0, {}), last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p != -1:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return state

    def add(self, words: list, document) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)
            if self.first[last] is None or document < self.first[last]:
                self.first[last] = document

    def close(self) -> None:
        """Hand each state's document up its suffix links, longest states first."""
        first, link = self.first, self.link
        for s in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            up = link[s]
            if up > 0 and (first[up] is None or first[s] < first[up]):
                first[up] = first[s]

    def statistics(self, words: list) -> Iterator[tuple[int, int]]:
        """At each word the length of the longest match that ends there, and its state."""
        state, length = 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield length, state

    def first_documents(self, words: list, length: int = LENGTH) -> list:
        """For each window of ``words`` the smallest document that holds it, None if none does.

        The matching statistics up to ``length`` words: a longer match goes on
        from the state of its last ``length`` words, so each word costs a bounded
        climb, also in texts of one word over and over.
        """
        out, state, matched, link, lengths = [], 0, 0, self.link, self.length
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = link[state]
                matched = lengths[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            while state and lengths[link[state]] >= length:
                state = link[state]
            matched = min(matched, length)
            if i >= length - 1:
                out.append(self.first[state] if matched == length else None)
        return out


def shard_matches(rows: list[tuple], length: int = LENGTH) -> list[list]:
    """For each (document, words) of a shard the first documents of its windows."""
    number: dict[str, int] = {}
    automaton, texts = SuffixAutomaton(), []
    for document, text in rows:
        words = [number.setdefault(w, len(number)) for w in text.split(" ")]
        automaton.add(words, document)
        texts.append(words)
    automaton.close()
    return [automaton.first_documents(words, length) for words in texts]


def covered(n: int, starts: list[int], length: int = LENGTH) -> np.ndarray:
    """Which of ``n`` words a window from one of ``starts`` covers."""
    steps = np.zeros(n + 1, np.int64)
    starts = np.unique(np.array(starts, np.int64))
    steps[starts] += 1
    np.add.at(steps, starts + length, -1)
    return np.cumsum(steps[:n]) > 0


def _anchor_rows(slim: DataFrame, kind, length: int, gram: int) -> DataFrame:
    """(h, doc): the different anchors of each document."""
    def run(batches):
        for part in by_bytes(batches, 1, SLICE_BYTES):
            data, bounds = text_bytes(part.column(1))
            _, row, value, _, _ = anchors(data, bounds, length, gram)
            order = np.lexsort((value, row))
            row, value = row[order], value[order]
            new = np.ones(len(row), bool)
            new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(value[new]), part.column(0).take(pa.array(row[new]))], names=["h", "doc"])

    return slim.select("doc", "text").mapInArrow(run, f"h long, doc {kind.simpleString()}")


def _compressed(slim: DataFrame, kind) -> DataFrame:
    """(doc, copy, z): words parted by one space, compressed for the shuffle; ``copy`` is a hash that tells texts of one id apart."""
    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for part in sliced(batches):
            z = [press.compress(b" ".join(t.split())) for t in part.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(z, pa.binary())], names=["doc", "copy", "z"])

    return slim.select("doc", F.xxhash64("text").alias("copy"), "text").mapInArrow(run, f"doc {kind.simpleString()}, copy long, z binary")


def _passage_rows(texts: DataFrame, kind, length: int, gram: int) -> DataFrame:
    """(doc, copy, at, route, words) of rows (doc, copy, z, shared)."""
    names, types = ["at", "route", "words"], [pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        open_ = zstandard.ZstdDecompressor()
        for part in sliced(batches, 64):
            texts = [open_.decompress(z) for z in part.column(2).to_pylist()]
            data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
            flat, ends = part.column(3).flatten(), np.cumsum([0, *part.column(3).value_lengths().to_pylist()])
            h, route = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            shared = [(h[a:b], route[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            rows = list(passages(data, bounds, shared, length, gram))
            of = pa.array([r[0] for r in rows], pa.int64())
            found = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True))[1:] if rows else [()] * 3, types, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), *found], names=["doc", "copy", *names])

    return texts.select("doc", "copy", "z", "shared").mapInArrow(run, f"doc {kind.simpleString()}, copy long, at long, route long, words string")


def _first_rows(passage: DataFrame, kind, length: int) -> DataFrame:
    """(route, id, firsts) of rows (shard, route, id, doc, words) that stand together by shard: one automaton a shard."""
    from pyspark.sql.pandas.types import to_arrow_type
    types = [pa.int64(), pa.binary(), pa.list_(to_arrow_type(kind))]

    def matched(ids, rows):
        columns = [*zip(*ids, strict=True), shard_matches(rows, length)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["route", "id", "firsts"])

    def run(batches):
        now, ids, rows = None, [], []
        for batch in batches:
            for shard, route, id_, doc, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now and rows:
                    yield matched(ids, rows)
                    ids, rows = [], []
                now = shard
                ids.append((route, id_))
                rows.append((doc, words))
        if rows:
            yield matched(ids, rows)

    return passage.select("shard", "route", "id", "doc", "words").mapInArrow(run, f"route long, id binary, firsts array<{kind.simpleString()}>")


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc, copy, starts): first words of the windows that also start in a smaller document, of rows (doc, text)."""
    kind = docs.schema["doc"].dataType
    known = docs.where(F.col("doc").isNotNull())
    each = _anchor_rows(known, kind, length, gram)
    several = each.groupBy("h").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    several = several.select("h", F.xxhash64("least").alias("route"))
    shared = each.join(several, "h").groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("h", "route"))).alias("shared"))
    found = _passage_rows(_compressed(known, kind).join(shared, "doc"), kind, length, gram)
    found = staged(found.withColumn("id", F.unhex(F.md5("words"))), "passages")
    # references with more different words than a shard holds: their passages are dealt window by window
    word = F.split("words", " ")
    hot = found.select("route", "id", F.size(word).alias("n")).distinct().groupBy("route").agg(F.sum("n").alias("different")).where(F.col("different") > shard_words)
    hot = staged(hot, "hot-references")
    few = hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = found.join(F.broadcast(hot) if few else hot, "route", "left")
    # split once a passage, not once a window
    window = let(word, lambda ws: F.transform(F.sequence(F.lit(0), F.size(ws) - length), lambda i: F.struct(
        (F.col("at") + i).alias("at"), F.array_join(F.slice(ws, i + 1, length), " ").alias("words"))))
    pieces = found.where("different is not null").select("doc", "copy", F.explode(window).alias("w"))
    pieces = pieces.select("doc", "copy", "w.at", F.xxhash64("w.words").alias("route"), "w.words", F.unhex(F.md5("w.words")).alias("id"))
    pieces = staged(pieces, "hot-windows")
    found = found.where("different is null").select("doc", "copy", "at", "route", "words", "id").unionByName(pieces)
    different = staged(found.groupBy("route", "id", "words").agg(F.min("doc").alias("doc")), "different-passages")
    total = different.agg(F.sum(F.size(word))).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    dealt = different.withColumn("shard", F.pmod("route", F.lit(shards))).repartition("shard").sortWithinPartitions("shard")
    firsts = _first_rows(dealt, kind, length)
    here = F.filter(F.transform("firsts", lambda f, i: F.when(f < F.col("doc"), F.col("at") + i)), lambda s: s.isNotNull())
    hits = found.select("doc", "copy", "at", "id", "route").join(firsts, ["route", "id"]).select("doc", "copy", here.alias("s")).where(F.size("s") > 0)
    return hits.groupBy("doc", "copy").agg(F.flatten(F.collect_list("s")).alias("starts"))


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """Every document without the words that a window shared with a smaller document covers.

    Returns doc_id, n_words, n_removed, kept (words that stay, joined by one
    space), removed (start:end of the removed runs of words, comma-joined).
    Windows are judged on the input.

    Null texts have no words; null ids are neither smaller nor larger than any
    other, so nothing goes from them or because of them; repeated rows and
    other texts of one id are judged alike and not against each other, so
    there are no ties; texts shorter than a window stay whole; very long texts are read
    whole, by the task that holds them; an empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    slim = docs.select(docs[id_col].alias("doc"), filled(docs, text_col).cast("string").alias("text"))
    starts = repeated_windows(slim, length, **bounds)
    types = [to_arrow_type(kind), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["doc_id", "n_words", "n_removed", "kept", "removed"]

    def run(batches):
        open_ = zstandard.ZstdDecompressor()
        for part in sliced(batches, 64):
            rows = []
            for doc, z, starts in zip(*(c.to_pylist() for c in part.columns), strict=True):
                text = open_.decompress(z)
                if not starts:
                    rows.append((doc, text.count(b" ") + bool(text), 0, text, ""))
                    continue
                words = text.split(b" ")
                gone = covered(len(words), starts, length)
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                rows.append((doc, len(words), int(gone.sum()), kept, ",".join(f"{a}:{b}" for a, b in edge.reshape(-1, 2))))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    whole = _compressed(slim, kind).join(starts, ["doc", "copy"], "left").select("doc", "z", "starts")
    return whole.mapInArrow(run, f"doc_id {kind.simpleString()}, n_words long, n_removed long, kept string, removed string")


def dedup_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words of every document."""
    out = without_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def oracle_sql(length: int = LENGTH) -> str:
    """DuckDB SQL for ``dedup_digests(documents)``."""
    return f"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select r, doc_id, w, unnest(range(1, len(w) - {length - 2})) as i from d),
windows as (select r, doc_id, i, array_to_string(w[i:i + {length - 1}], ' ') as x from s),
firsts as (select x, min(doc_id) as first_id from windows group by x),
gone as (select distinct r, unnest(range(i, i + {length})) as p from windows join firsts using (x) where first_id < doc_id),
words as (select r, unnest(w) as v, unnest(range(1, len(w) + 1)) as p from d),
kept as (select r, string_agg(v, ' ' order by p) as t, count(*) as n from words anti join gone using (r, p) group by r)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (r)"""
