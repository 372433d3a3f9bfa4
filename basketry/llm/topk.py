"""Exact top-k inner products by columnar branch-and-bound.

Candidates are read in vertical layout: one array per block of dimensions,
blocks in falling order of their mass.  Scores of a query against a batch are
accumulated block by block; after each block a candidate is dropped if its
partial score plus the largest product its remaining mass allows
(Cauchy-Schwarz) is below the query's k-th best score so far, and the arrays
are compacted to the survivors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import ship_package, whole_files
from basketry.session import scratch_path

#: Queries that are sent to all tasks at a time: the bound of what is broadcast, QUERY_BLOCK * dimensions * 8 bytes.
QUERY_BLOCK = 2_048
#: Candidates that are scored at a time.
ROWS = 4_096
DIM_BLOCK = 16


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): components floor(scale * x); vectors that are null or hold null or non-finite components go."""
    x = df.select(df[id_col].alias("vec_id"), df[vec_col].cast("array<double>").alias("x")).where("x is not null")
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return x.where(~bad).select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def dimension_order(vectors: DataFrame) -> list[int]:
    """Dimensions by falling mass over all rows: one aggregate row a dimension."""
    mass = vectors.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.sum(F.col("x").cast("double") ** 2).alias("m"))
    return [r["d"] for r in sorted(mass.collect(), key=lambda r: (-r["m"], r["d"]))]


class Best:
    """The k best (score, vec_id, row) of each query so far, smaller ids first among equal scores."""

    def __init__(self, n: int, k: int):
        self.k, self.kept = k, [None] * n
        self.least = np.full(n, -np.inf)

    def add(self, q: int, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        if self.kept[q] is not None:
            score, ids, null = (np.concatenate((a, b)) for a, b in zip(self.kept[q], (score, ids, null), strict=True))
        if len(score) > 4 * self.k:  # only ties with the k-th best matter
            cut = np.partition(score, len(score) - self.k)[len(score) - self.k]
            keep = score >= cut
            score, ids, null = score[keep], ids[keep], null[keep]
        order = np.lexsort((ids, null, -score))[:self.k]
        self.kept[q] = (score[order], ids[order], null[order])
        if len(order) == self.k:
            self.least[q] = self.kept[q][0][-1]


def _dense(column: pa.Array, order: list[int]) -> np.ndarray:
    """Rows x dimensions in the given order; missing dimensions are 0."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py():column.offsets[-1].as_py()]
    out = np.zeros((len(lengths), len(order)), np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    row = np.repeat(np.arange(len(lengths)), lengths)
    col = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place[col]] = values
    return out


def _remaining(x: np.ndarray, starts: list[int]) -> np.ndarray:
    """Length of each row's part from each block on, rounded up."""
    squares = x.astype(np.float64) ** 2
    return np.stack([np.sqrt(squares[:, s:].sum(1)) for s in starts], 1) * (1 + 1e-9)


def score_batch(best: Best, queries: np.ndarray, query_rows: np.ndarray, mass: np.ndarray, x: np.ndarray,
                ids: np.ndarray, null: np.ndarray, rows: np.ndarray, starts: list[int]) -> None:
    """Add the candidates ``x`` to the best of every query; ``rows`` tells a query from its own row."""
    width = x.shape[1]
    largest = np.abs(x).max(initial=0) * float(np.abs(queries).max(initial=0)) * max(1, width)
    exact = np.float64 if largest < 2 ** 53 else np.int64  # doubles are exact below 2^53
    blocks = [np.ascontiguousarray(x[:, s:e].astype(exact)) for s, e in zip(starts, [*starts[1:], width], strict=True)]
    asked = [queries[:, s:e].astype(exact) for s, e in zip(starts, [*starts[1:], width], strict=True)]
    rest = _remaining(x, starts)
    first = blocks[0] @ asked[0].T if blocks else np.zeros((len(x), len(queries)), exact)
    for q in range(len(queries)):
        alive = np.flatnonzero(rows != query_rows[q])
        partial = first[alive, q]
        for b in range(1, len(blocks)):
            if best.least[q] > -np.inf:
                keep = partial + rest[alive, b] * mass[q, b] >= best.least[q]
                alive, partial = alive[keep], partial[keep]
            if not alive.size:
                break
            partial = partial + blocks[b][alive] @ asked[b][q]
        keep = partial >= best.least[q]
        if keep.any():
            best.add(q, partial[keep].astype(np.int64), ids[alive[keep]], null[alive[keep]])


def exact_topk(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
               query_block: int = QUERY_BLOCK, dim_block: int = DIM_BLOCK) -> DataFrame:
    """The k largest integer inner products of each query row with every row but itself.

    ``is_query`` is a condition on ``vec_id``.  Returns query_id, rank (from
    1), vec_id, score; ties go to the smaller vec_id, null ids last.  Queries go
    in blocks of ``query_block`` against all rows, one job a block, whose rows
    are appended to one table; each task keeps k rows a query.

    Vectors that are null or hold null or non-finite components take no part;
    shorter vectors count as padded with zeros, empty ones score 0; repeated
    rows are rows of their own; an empty table or no query gives an empty
    result; other columns are ignored.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    ints = integer_vectors(vectors, id_col, vec_col).withColumn("vec_id", F.col("vec_id").cast("long"))
    table = whole_files(ints, "vectors").select("vec_id", "v", (F.shiftleft("_file", 40) + F.col("_row")).alias("row"))
    order = dimension_order(table)
    starts = list(range(0, len(order), dim_block))
    # the query set, numbered without a window: pages of a sorted table
    asked = whole_files(table.where(is_query).sort("vec_id", "row"), "queries").withColumnsRenamed({"_file": "f", "_row": "i"})
    path, after = None, F.lit(True)
    while page := asked.where(after).sort("f", "i").limit(query_block).collect():
        f, i = page[-1]["f"], page[-1]["i"]
        after = (F.col("f") > f) | ((F.col("f") == f) & (F.col("i") > i))
        path = path or scratch_path(spark, "top-k")
        _block(table, page, order, starts, k).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path) if path else spark.createDataFrame([], schema)


def _block(table: DataFrame, page: list, order: list[int], starts: list[int], k: int) -> DataFrame:
    place = {d: i for i, d in enumerate(order)}
    queries = np.zeros((len(page), len(order)), np.int64)
    for r, row in enumerate(page):
        for d, value in enumerate(row["v"]):
            queries[r, place[d]] = value
    query_ids, query_rows = [r["vec_id"] for r in page], np.array([r["row"] for r in page], np.int64)
    sent = table.sparkSession.sparkContext.broadcast((queries, query_rows, _remaining(queries, starts)))

    def run(batches):
        queries, query_rows, mass = sent.value
        best = Best(len(queries), k)
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                ids, vectors, rows = batch.slice(s, ROWS).columns
                null = ids.is_null().to_numpy(zero_copy_only=False)
                score_batch(best, queries, query_rows, mass, _dense(vectors, order), ids.fill_null(0).to_numpy(zero_copy_only=False), null,
                            rows.to_numpy(zero_copy_only=False), starts)
        out = [(q, int(i) if not z else None, int(v)) for q, kept in enumerate(best.kept) if kept for v, i, z in zip(*kept, strict=True)]
        q, i, v = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(v, pa.int64())], names=["query", "vec_id", "score"])

    ship_package(table.sparkSession)
    local = table.select("vec_id", "v", "row").mapInArrow(run, "query long, vec_id long, score long")
    # k rows a query and task meet; the rank limit keeps k of them in each task before the exchange
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    top = local.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    names = table.sparkSession.createDataFrame(list(enumerate(query_ids)), "query long, query_id long")
    return top.join(F.broadcast(names), "query").select("query_id", "rank", "vec_id", "score")


def oracle_sql(k: int = 5) -> str:
    return f"""
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.r, q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.r <> c.r where q.vec_id % 50 = 0),
ranked as (
  select *, row_number() over (partition by r order by score desc, vec_id nulls last) as rank from scored)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= {k}"""
