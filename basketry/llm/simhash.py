"""SimHash near-duplicates with pivot distance tables.

Every fingerprint gets a row of Hamming distances to fixed reference
fingerprints (pivots).  By the triangle inequality two fingerprints within k
bits differ by at most k in every coordinate of the table, so a pair whose
largest coordinate difference is above k is discarded unseen; survivors are
verified bit by bit.  Distances of random fingerprints to one pivot lie close
together, so a table alone names no place to look: pairs are looked for inside
cells that share 64-bit blocks.  Of b blocks, two fingerprints within k bits
share at least b - k, hence a cell for each choice of b - k blocks loses no link.

Copies share a fingerprint and are folded before anything is compared.  A cell
gives a forest of its links, not its pairs; cells above ``split`` members are
dealt out as pairs of parts.  Components of the forest come from large-star and
small-star rounds.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.llm.common import map_rows, ship_package, staged

SEED = 42
PIVOTS = 24
#: Members of a cell that one task compares; larger cells are dealt out in parts.
SPLIT = 20_000
#: Distinct fingerprints up to which four blocks keep cells small; beyond, six blocks and cells of three of them.
FOUR_BLOCKS = 1 << 26


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: hashes of their numbers."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(n)], np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles, repeats included; a bit is 1 if set in over half of the hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        n = len(words) - shingle + 1
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1:].tolist(), strict=True)]
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        part = np.array(hashes[i:i + 8192], "<u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed 64-bit number."""
    kind = docs.schema[id_col].dataType

    def run(columns):
        ids, texts = columns
        fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
        return [ids, fps]

    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    arrow = T.StructType([T.StructField("doc_id", kind)])
    from pyspark.sql.pandas.types import to_arrow_schema
    types = [to_arrow_schema(arrow).field(0).type, pa.int64()]
    return map_rows(slim, ["doc_id", "text"], run, f"doc_id {kind.simpleString()}, fp long", types, ["doc_id", "fp"])


class Forest:
    """Union of rows; the root of a set is its first row."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, rows: np.ndarray) -> np.ndarray:
        roots = self.parent[rows]
        while True:
            above = self.parent[roots]
            if (above == roots).all():
                return roots
            roots = above

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        while left.size:
            a, b = self.find(left), self.find(right)
            open_ = a != b
            left, right, a, b = left[open_], right[open_], a[open_], b[open_]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def link_forest(group: np.ndarray, fps: np.ndarray, bits: int, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, root) of rows that are connected by pairs of one group within ``bits`` bits.

    The table is sorted by (group, first coordinate); rows are compared with
    their first, second, ... follower as long as some follower is within
    ``bits`` in the first coordinate.  The other coordinates discard pairs one
    after the other, survivors are verified.
    """
    table = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], group))
    group, table, fp = group[order], np.ascontiguousarray(table[order].T), fps[order]
    forest = Forest(len(fp))
    left, step = np.arange(len(fp) - 1), 1
    while left.size:
        left = left[left + step < len(fp)]
        right = left + step
        near = (group[left] == group[right]) & (table[0][right] - table[0][left] <= bits)
        left = left[near]
        a, b = left, left + step
        for coordinate in table[1:]:
            keep = np.abs(coordinate[a] - coordinate[b]) <= bits
            a, b = a[keep], b[keep]
        close = np.bitwise_count(fp[a] ^ fp[b]) <= bits
        forest.join(a[close], b[close])
        step += 1
    roots = forest.find(np.arange(len(fp)))
    member = np.flatnonzero(roots != np.arange(len(fp)))
    return order[member], order[roots[member]]


def _cells(fps: DataFrame, bits: int, n: int) -> DataFrame:
    """(cell, value, fp): a row for each choice of blocks that two near fingerprints must share."""
    blocks = bits + 1 if n <= FOUR_BLOCKS else bits + 3
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
             for chosen in combinations(range(blocks), blocks - bits)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    cells = F.array(*[F.struct(F.lit(i).alias("cell"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("value")) for i, m in enumerate(masks)])
    return fps.select("fp", F.explode(cells).alias("c")).select("c.cell", "c.value", "fp")


def _links(fps: DataFrame, bits: int, n: int, split: int, refs: np.ndarray) -> DataFrame:
    """(a, b): links a > b that connect the same fingerprints as all pairs within ``bits`` bits."""
    cells = _cells(fps, bits, n)
    sizes = cells.groupBy("cell", "value").count()
    hot = sizes.where(F.col("count") > split).withColumn("parts", F.ceil(F.col("count") / split).cast("int"))
    # part p of a hot cell meets every part q: the cell becomes tasks (p, q), p <= q
    spread = cells.join(hot.drop("count"), ["cell", "value"], "left")
    part = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
    spread = spread.select("cell", "value", "fp", part.alias("part"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("other"))
    spread = spread.select("cell", "value", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "fp")
    keys = ["cell", "value", "p", "q"]

    def run(batches):
        held: list[list[np.ndarray]] = []

        def forest(rows):
            cols = [np.concatenate(x) for x in zip(*rows, strict=True)]
            change = np.zeros(len(cols[4]), bool)
            for c in cols[:4]:
                change[1:] |= c[1:] != c[:-1]
            a, b = link_forest(np.cumsum(change), cols[4].view(np.uint64), bits, refs)
            a, b = cols[4][a], cols[4][b]
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[4]):
                continue
            held.append(cols)
            # the last group may go on in the next batch
            same = np.ones(len(cols[4]), bool)
            for c in cols[:4]:
                same &= c == c[-1]
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                held[-1] = [c[:cut] for c in cols]
                yield forest(held)
                held = [[c[cut:] for c in cols]]
        if held:
            yield forest(held)

    ship_package(fps.sparkSession)
    return spread.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "fp").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, root): every linked node but the roots, with the smallest node of its component.

    Large-star and small-star rounds; each stages its links, of which there
    are never more than at the start, until they stay the same.
    """
    links, seen = staged(links, "links"), None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        links = staged(small.distinct(), "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return links.select("a", F.col("b").alias("root"))
        seen = state


def simhash_components(docs: DataFrame, shingle: int = 3, bits: int = 3, split: int = SPLIT,
                       id_col: str = "doc_id", text_col: str = "text", n_pivots: int = PIVOTS) -> DataFrame:
    """Fingerprint and near-duplicate component of every document.

    Returns doc_id, fingerprint (16 hex digits), component_id: the smallest
    doc_id that links of at most ``bits`` differing bits reach, itself included.

    Null and empty texts have fingerprint zero and are linked like others;
    repeated rows stay and share a component; null ids never name a component
    unless all its ids are null; an empty table gives an empty result; other
    columns are ignored.
    """
    prints = staged(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    n = distinct.count()
    roots = components(_links(distinct.select("fp"), bits, n, split, pivots(n_pivots)))
    # the smallest id of each component, then by fingerprint
    rooted = distinct.join(roots.withColumnRenamed("a", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(smallest, "root").select("fp", "component_id")
    out = prints.join(by_fp, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, bits: int = 3, split: int = SPLIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of every component, all columns as they are: that of the smallest id (nulls last), then text hash.

    Components are found on (id, text hash, fingerprint); the documents are
    read once more and lose the others by an anti join on id and hash.  Of
    equal rows one stays.
    """
    mark = F.xxhash64(docs[text_col])
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    prints = staged(fingerprints(rows.select(F.struct("doc_id", F.xxhash64("text").alias("mark")).alias("doc_id"), "text"), shingle), "fingerprints")
    prints = prints.select("doc_id.doc_id", "doc_id.mark", "fp")
    order = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("mark").alias("m"))
    distinct = staged(prints.groupBy("fp").agg(F.min(order).alias("least")), "distinct-fingerprints")
    roots = components(_links(distinct.select("fp"), bits, distinct.count(), split, pivots()))
    rooted = distinct.join(roots.withColumnRenamed("a", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    keeper = rooted.groupBy("root").agg(F.min("least").alias("keeper"))
    by_fp = rooted.join(keeper, "root").select("fp", "keeper")
    seen = prints.join(by_fp, "fp").groupBy("doc_id", "mark").agg(F.first("keeper").alias("keeper"), F.count("*").alias("n"))
    is_keeper = F.col("doc_id").eqNullSafe(F.col("keeper.d")) & (F.col("mark") == F.col("keeper.m"))
    seen = staged(seen.select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), "n", is_keeper.alias("keep")), "kept-or-not")
    wide = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("_id"), mark.alias("_mark"))
    on = F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_mark") == F.col("_m"))
    out = wide.join(seen.where("not keep"), on, "left_anti")
    several = seen.where("keep and n > 1")
    if not several.isEmpty():
        once = out.join(several, on, "left_semi").dropDuplicates(["_id", "_mark"])
        out = out.join(several, on, "left_anti").unionByName(once)
    return out.select("row.*")
