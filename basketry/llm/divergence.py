"""Source divergence audit by one-hot level products.

How often a term occurs in a group (lang, source) is its level there.  One
column for each (group, level) says which terms stand at it: a 0/1 matrix over
the kept terms of a language, level zero included.  The product of its
transpose with itself holds, for every two groups, the joint table "terms at
level a here and level b there"; pricing the table with the two groups' smoothed
probabilities of the levels gives their distance.

The matrix is multiplied in blocks: terms are dealt into blocks, groups into
tiles, and a task multiplies one block of two tiles.  Products of a block count
to its terms at most, so they are exact; prices and sums are integers.  Prices
are linear in the tables, so a block's tables are priced where they arise and
only one sum a block and pair is shuffled.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import filled, ship_package, sliced, staged

MIN_DOCS = 30
TOP_TERMS = 50
#: Fixed values of the smoothed probability 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)).
SCALE, PRIOR = 1_000_000_000, 5
#: Terms of a block and groups of a tile: the bound of what one task multiplies.
BLOCK_TERMS = 1_024
TILE_GROUPS = 32
#: Columns of one product inside a task.
COLUMNS = 2_048
#: Entries that a task counts before it passes them on.
MEMORY = 300_000

#: Bytes of terms: letters, lower-cased, and everything beyond ASCII; the others part terms.
_TERM_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text as UTF-8."""
    return text.encode().translate(_TERM_BYTES).split()


def term_counts(docs: DataFrame, memory: int = MEMORY) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents of each term of a group, counted in each task before they meet."""
    schema = "lang string, source string, term string, n long, d long"

    def flushed(tally):
        rows = [(*group, term.decode(), n, held[term]) for group, (often, held) in tally.items() for term, n in often.items()]
        columns = zip(*rows, strict=True) if rows else [()] * 5
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["lang", "source", "term", "n", "d"])

    def run(batches):
        tally, size = {}, 0
        for part in sliced(batches):
            for lang, source, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                found = terms(text)
                if not found:
                    continue
                often, held = tally.setdefault((lang, source), (Counter(), Counter()))
                size -= len(often)
                often.update(found)
                held.update(set(found))
                size += len(often)
                if size > memory:
                    yield flushed(tally)
                    tally, size = {}, 0
        yield flushed(tally)

    ship_package(docs.sparkSession)
    return docs.select("lang", "source", "text").mapInArrow(run, schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def probability(count: Column, total: Column, kept: Column) -> Column:
    """The smoothed probability in units of 1 / SCALE; null without kept terms."""
    up = F.lit(SCALE).cast("decimal(20,0)") * (count + PRIOR)
    down = F.nullif(total + F.lit(PRIOR) * kept, F.lit(0)).cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("floor", F.try_divide(up - up % down, down)).cast("long")).cast("long")


def priced_tables(block: pa.Table, groups: pa.Table) -> pa.Table:
    """(lang, a, b, f): the joint tables of every two groups of a block's tiles, priced.

    ``block``: idx, term, n, p of the groups of both tiles; ``groups``: idx,
    tile, zero (price of level zero), n_terms of the block, and the tiles left
    and right.
    """
    first = groups.slice(0, 1).to_pylist()[0]
    idx, tile = groups["idx"].to_numpy(), groups["tile"].to_numpy()
    order = np.argsort(idx)
    idx, tile, zero = idx[order], tile[order], groups["zero"].fill_null(0).to_numpy()[order]
    place = np.searchsorted(idx, block["idx"].to_numpy())
    term = block["term"].combine_chunks().dictionary_encode()
    term, n_seen = term.indices.to_numpy(zero_copy_only=False), len(term.dictionary)
    count, price = block["n"].to_numpy(), block["p"].to_numpy()
    # levels of each group, level zero first; a column for each
    pairs = np.concatenate((np.stack((np.arange(len(idx)), np.zeros(len(idx), np.int64)), 1), np.stack((place, count), 1)))
    levels, where, column = np.unique(pairs, axis=0, return_index=True, return_inverse=True)
    column, owner = column.ravel()[len(idx):], levels[:, 0]
    worth = np.concatenate((zero, price))[where]
    x = np.zeros((n_seen, len(levels)), np.float32)
    at_zero = np.ones((n_seen, len(idx)), bool)
    at_zero[term, place] = False
    x[:, np.flatnonzero(levels[:, 1] == 0)] = at_zero
    x[term, column] = 1
    unseen = int(first["n_terms"]) - n_seen  # terms of the block that none of these groups holds
    f = np.zeros((len(idx), len(idx)), np.int64)
    rows, cols = (np.flatnonzero(tile[owner] == first[side]) for side in ("left", "right"))
    for r in range(0, len(rows), COLUMNS):
        these = rows[r:r + COLUMNS]
        for c in range(0, len(cols), COLUMNS):
            those = cols[c:c + COLUMNS]
            joint = (x[:, these].T @ x[:, those]).astype(np.int64)  # counts up to BLOCK_TERMS, exact in single precision
            joint[np.ix_(levels[these, 1] == 0, levels[those, 1] == 0)] += unseen
            joint *= np.abs(worth[these][:, None] - worth[those][None, :])
            own, other = owner[these], owner[those]
            a, b = (np.flatnonzero(np.diff(v, prepend=-1)) for v in (own, other))
            f[np.ix_(own[a], other[b])] += np.add.reduceat(np.add.reduceat(joint, a, 0), b, 1)
    a, b = np.nonzero((tile == first["left"])[:, None] & (tile == first["right"])[None, :] & ~np.eye(len(idx), dtype=bool))
    return pa.table({"lang": pa.array([first["lang"]] * len(a), pa.string()), "a": pa.array(idx[a], pa.int64()), "b": pa.array(idx[b], pa.int64()),
                     "f": pa.array(f[a, b], pa.int64())})


def _tiles(df: DataFrame) -> DataFrame:
    """Each row once for every pair of tiles that its own tile is one of."""
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    df = df.withColumn("_o", other)
    return df.withColumn("left", F.least("tile", "_o")).withColumn("right", F.greatest("tile", "_o")).drop("_o")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, block_terms: int = BLOCK_TERMS, tile_groups: int = TILE_GROUPS,
               lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """How far the sources of a language lie apart, and which terms speak for each.

    Returns lang, source, part, item, value, rank.  Part ``pair``: item is
    another source of the language, value the sum of |p - q| over the kept
    terms; part ``term``: item is a term of the source with p above the
    language's q, value p - q, the first ``top``.  Rank by falling value, ties
    by item in UTF-8 order.

    Null texts, langs and sources count as empty strings; texts of any length are counted
    whole; repeated rows are documents of their own; a group without terms,
    or of a language without kept terms, has its pairs (there with value 0)
    and no terms; an empty table gives an empty result; other columns are ignored,
    whatever their names.
    """
    docs = docs.select(filled(docs, lang_col).cast("string").alias("lang"), filled(docs, source_col).cast("string").alias("source"),
                       filled(docs, text_col).cast("string").alias("text"))
    counts = staged(term_counts(docs), "audit-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("lang_n")).where(F.col("d") >= min_docs).drop("d")
    entries = staged(counts.drop("d").join(kept, ["lang", "term"]), "audit-entries")
    kept = entries.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    numbered = Window.partitionBy("lang").orderBy("source")
    zero = F.lit(0).cast("long")
    groups = docs.select("lang", "source").distinct().join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.select("lang", "source", F.coalesce("v", zero).alias("v"), F.coalesce("total", zero).alias("total"), F.coalesce("lang_total", zero).alias("lang_total"),
                           (F.row_number().over(numbered) - 1).cast("long").alias("idx"), F.count("*").over(Window.partitionBy("lang")).alias("size"))
    groups = groups.select("*", F.expr(f"idx div {tile_groups}").alias("tile"), F.expr(f"(size + {tile_groups - 1}) div {tile_groups}").alias("tiles"),
                           F.greatest(F.lit(1).cast("long"), F.expr(f"(v + {block_terms - 1}) div {block_terms}")).alias("blocks"),
                           probability(zero, F.col("total"), F.col("v")).alias("zero"))
    groups = staged(groups, "audit-groups")
    block = F.pmod(F.xxhash64("term"), F.col("blocks"))
    rated = entries.join(groups, ["lang", "source"]).withColumn("p", probability(F.col("n"), F.col("total"), F.col("v")))
    # the terms that speak for a group; the limit keeps top rows a group in each task before the exchange
    above = rated.select("lang", "source", F.col("term").alias("item"), (F.col("p") - probability(F.col("lang_n"), F.col("lang_total"), F.col("v"))).alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    speaking = above.where("value > 0").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    # blocks of the level matrix, and the groups that each pair of tiles multiplies in them
    key = ["lang", "block", "left", "right"]
    in_block = kept.join(groups.select("lang", "blocks").distinct(), "lang").groupBy("lang", block.alias("block")).agg(F.count("*").alias("n_terms"))
    level_rows = _tiles(rated.withColumn("block", block)).select(*key, "idx", "term", "n", "p")
    group_rows = groups.withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1))).join(in_block, ["lang", "block"], "left")
    group_rows = _tiles(group_rows).withColumn("n_terms", F.coalesce("n_terms", zero))
    group_rows = group_rows.select(*[F.col(c).alias(c) for c in (*key, "idx", "tile", "zero", "n_terms")])  # columns of their own for the cogroup
    ship_package(docs.sparkSession)
    sums = level_rows.groupBy(*key).cogroup(group_rows.groupBy(*key)).applyInArrow(priced_tables, "lang string, a long, b long, f long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("f").alias("f"))
    # tiles on either side of the diagonal were multiplied once
    sides = F.when(F.expr(f"a div {tile_groups} = b div {tile_groups}"), F.array(F.struct("a", "b"))).otherwise(
        F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    sums = sums.select("lang", "f", F.explode(sides).alias("s")).select("lang", "s.a", "s.b", "f")
    name = groups.select("lang", "idx", "source")
    pairs = sums.join(name.withColumnRenamed("idx", "a"), ["lang", "a"]).join(
        name.select("lang", F.col("idx").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.col("f").alias("value"), F.row_number().over(
        Window.partitionBy("lang", "source").orderBy(F.desc("f"), "item")).alias("rank"))
    return pairs.unionByName(speaking.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def oracle_sql(min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> str:
    """DuckDB SQL for ``divergence(documents)``."""
    def p(count, total):
        return f"(1 + ({SCALE}::hugeint * ({count} + {PRIOR})) // ({total} + {PRIOR} * v))::bigint"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as x from documents),
w as (
  select r, lang, source, unnest(regexp_extract_all(translate(x, '{upper}', '{upper.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
kept as (select lang, term, count(*) as lang_n from w group by all having count(distinct r) >= {min_docs}),
langs as (select lang, count(*) as v, sum(lang_n)::bigint as lang_total from kept group by all),
groups as (select distinct lang, source from d),
cells as (
  select g.lang, g.source, k.term, k.lang_n, count(w.term) as n
  from groups g join kept k using (lang) left join w on w.lang = g.lang and w.source = g.source and w.term = k.term group by all),
rated as (
  select c.*, {p('n', 'total')} as p, {p('lang_n', 'lang_total')} as q
  from (select *, (sum(n) over (partition by lang, source))::bigint as total from cells) c join langs using (lang)),
pair as (
  select a.lang, a.source, b.source as item, coalesce(f, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source as s1, y.source as s2, sum(abs(x.p - y.p)) as f from rated x join rated y on x.lang = y.lang and x.term = y.term group by all) t
    on t.lang = a.lang and s1 = a.source and s2 = b.source),
parts as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pair
  union all
  select * from (
    select lang, source, 'term', term, p - q as value, row_number() over (partition by lang, source order by p - q desc, term) as rank
    from rated where n > 0 and p > q) t where rank <= {top})
select lang, source, part, item, value, rank::integer as rank from parts"""
