"""Shards by a Feistel permutation of global row numbers.

Row numbers follow a total order of the rows, so they do not depend on how the
input is stored.  A number n < N = |rows| is split into a digit pair of the
grid a x b >= N, goes through Feistel rounds with modular addition, and walks
the cycle until it is below N again: a permutation of 0..N-1 that anyone can
compute from (n, N, seed).  shard = position mod shards, slot = position div
shards: counts are at most one apart (law ``rows``) and slots have no gaps.
DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import filled, staged, whole_files

#: Fixed values of the round function: a Lehmer-style step modulo a 31-bit prime.
PRIME = 2147483647
ROUND_KEYS = [1103515245, 742938285, 1664525013, 950706376, 1226874159, 630360016]
#: Steps of the cycle walk that one expression holds. The grid has fewer than sqrt(N) + 1 numbers beyond N, so a
#: step leaves 0..N-1 with probability about 1/sqrt(N); rows that would need more steps raise an error.
WALK = 64


def grid(n: int) -> tuple[int, int]:
    """Sides a, b of the smallest near-square grid with a * b >= n."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def round_value(key: int, digit: int, seed: int) -> int:
    """The round function on plain numbers; ``_round`` is the same as an expression."""
    t = (digit * key + seed + key) % PRIME
    return (t * t + digit + seed) % PRIME


def permute(x: int, n: int, seed: int) -> int:
    """One pass through the network, for tests and for computing a position without Spark."""
    a, b = grid(n)
    left, right = x % a, x // a
    for i, key in enumerate(ROUND_KEYS):
        if i % 2:
            right = (right + round_value(key, left, seed)) % b
        else:
            left = (left + round_value(key, right, seed)) % a
    return left + a * right


def position(x: int, n: int, seed: int) -> int:
    y = permute(x, n, seed)
    while y >= n:
        y = permute(y, n, seed)
    return y


def _round(key: Column, digit: Column, seed: int) -> Column:
    t = (digit * key + F.lit(seed) + key) % F.lit(PRIME)
    return (t * t + digit + F.lit(seed)) % F.lit(PRIME)


def _permuted(x: Column, n: int, seed: int) -> Column:
    """The network as one fold over its round keys, the state being the two digits; every other key is negative."""
    a, b = (F.lit(v).cast("long") for v in grid(n))
    keys = F.array(*[F.lit(-k if i % 2 else k).cast("long") for i, k in enumerate(ROUND_KEYS)])
    start = F.struct((x % a).alias("l"), ((x - x % a) / a).cast("long").alias("r"))

    def mixed(s: Column, k: Column) -> Column:
        return F.struct(F.when(k > 0, (s["l"] + _round(k, s["r"], seed)) % a).otherwise(s["l"]).alias("l"),
                        F.when(k > 0, s["r"]).otherwise((s["r"] + _round(-k, s["l"], seed)) % b).alias("r"))

    return F.aggregate(keys, start, mixed, lambda s: s["l"] + a * s["r"])


def walked(x: Column, n: int, seed: int) -> Column:
    """Position of row number ``x`` among ``n`` rows."""
    y = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), _permuted(x, n, seed),
                    lambda acc, _: F.when(acc < n, acc).otherwise(_permuted(acc, n, seed)))
    return F.when(y < n, y).otherwise(F.raise_error(F.lit("cycle walk is longer than WALK")).cast("long"))


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with a gapless global ``row_number`` from 0 in the given order (nulls first), and their number.

    A range exchange sorts the rows over all tasks; a random last key splits
    runs of equal rows, which are interchangeable.  The sorted rows are
    written, so each has a fixed place; file offsets come from one small
    count, and no task ever numbers more than its own range.
    """
    table = whole_files(rows.repartitionByRange(*order, F.rand(7)).sortWithinPartitions(*order), "numbered")
    # one row a file: at most the number of shuffle partitions
    counts = sorted((r["_file"], r["count"]) for r in table.groupBy("_file").count().collect())
    offsets, total = [], 0
    for file, count in counts:
        offsets.append((file, total))
        total += count
    offsets = rows.sparkSession.createDataFrame(offsets, "_file long, _offset long")
    out = table.join(F.broadcast(offsets), "_file").withColumn("row_number", F.col("_offset") + F.col("_row"))
    return out.drop("_file", "_row", "_offset"), total


def feistel_shards(docs: DataFrame, shards: int = 24, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every document, by the law ``rows``.

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law,
    shard, slot, grown_shard (null under this law).  The total order is
    (doc_id nulls first, text_crc32, size).

    Null texts count as empty (size 8, crc 0); repeated rows are rows of
    their own and take neighbouring numbers; an empty table gives an empty
    result; other columns are ignored.
    """
    text = filled(docs, text_col)
    slim = docs.select(docs[id_col].alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows, total = numbered(staged(slim, "shard-sizes"), ["doc_id", "text_crc32", "size"])
    at = rows.withColumn("at", walked(F.col("row_number"), max(1, total), seed))
    return at.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("at") % shards).cast("int").alias("shard"),
                     F.expr(f"at div {int(shards)}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def oracle_sql(shards: int = 24, seed: int = 42) -> str:
    """DuckDB SQL for ``feistel_shards(documents)``; CRC-32 is folded over the bytes of each text."""
    def network(x: str) -> str:
        steps = [f"{x} % a as l0, {x} // a as r0"]
        for i, k in enumerate(ROUND_KEYS):
            d = "l" if i % 2 else "r"
            t = f"(({d}{i} * {k} + {seed + k}) % {PRIME})"
            f = f"(({t} * {t} + {d}{i} + {seed}) % {PRIME})"
            steps.append(f"l{i} as l{i + 1}, (r{i} + {f}) % b as r{i + 1}" if i % 2 else f"(l{i} + {f}) % a as l{i + 1}, r{i} as r{i + 1}")
        sql = "__FROM__"
        for s in steps:
            sql = f"(select *, {s} from {sql})"
        return f"select k, a, b, n, step + 1 as step, l{len(ROUND_KEYS)} + a * r{len(ROUND_KEYS)} as v from {sql}"
    return f"""
with recursive crc_table as (
  select list(v order by i) as t from (
    select i, list_reduce([i::bigint, 1, 2, 3, 4, 5, 6, 7, 8],
      lambda c, _: case when c % 2 = 1 then xor(c // 2, 3988292384::bigint) else c // 2 end) as v from range(256) g(i))),
sized as (
  select doc_id, coalesce(octet_length(encode(text)), 0) + 8 as size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint) as bytes
  from documents),
summed as (
  select doc_id, size, xor(list_reduce(list_prepend(4294967295::bigint, bytes),
      lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295::bigint) as text_crc32
  from sized, crc_table),
numbered as (
  select *, row_number() over (order by doc_id nulls first, text_crc32, size) - 1 as k, count(*) over () as n from summed),
sides as (
  select k, n, greatest(1, case when n <= 1 then 1 else floor(sqrt(n - 1))::bigint + 1 end) as a from numbered),
start as (select k, a, greatest(1, (n + a - 1) // a) as b, n, 0 as step, k as v from sides),
walk as (
  select * from start
  union all {network('v').replace('__FROM__', '(select * from walk where step = 0 or v >= n)')}),
place as (select k, v as pos from walk where step > 0 and v < n)
select doc_id, size, text_crc32, 'rows' as law, cast(pos % {shards} as integer) as shard, pos // {shards} as slot,
  cast(null as integer) as grown_shard
from numbered join place using (k)"""
