"""Helpers shared by the operators: table reads, staged tables, word splitting."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import basketry
from basketry.session import scratch_path

#: White space of the word rule ``[^\x20\x09-\x0D]+``; also what ``bytes.split()`` splits at.
SPACE = "\\x20\\x09-\\x0D"

#: Rows of one Arrow batch that are turned into Python objects at a time.
SLICE = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared checkpoint folder and read it back.

    Cuts the lineage: later steps read files that every executor sees, and
    a lost executor costs a re-read, not a recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_files(df: DataFrame, name: str) -> DataFrame:
    """As ``staged``, with one file a task whatever ``maxRecordsPerFile`` says, and the columns ``_file`` and ``_row``.

    They are the task's number and the row's place in it, so together they tell
    rows apart and follow the order that the tasks wrote them in.  More files
    than task numbers would make them ambiguous and are an error.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", 0).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    numbers = [int(re.search(r"part-(\d+)", f)[1]) for f in table.inputFiles()]
    if len(set(numbers)) != len(numbers):
        raise RuntimeError(f"{path}: a task wrote more than one file")
    file = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    return table.select("*", file.alias("_file"), F.col("_metadata.row_index").alias("_row"))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once an application: they need not have it installed."""
    sc, root = spark.sparkContext, Path(basketry.__file__).parent
    if sc.applicationId in _SHIPPED or not root.is_dir():
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    path = scratch_path(spark, "package") + "/basketry.zip"
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def filled(df: DataFrame, column: str) -> Column:
    """The text column, null as empty."""
    return F.coalesce(df[column], F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words ``[^\x20\x09-\x0D]+`` in a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def hashed_sample(rows: DataFrame, key: Column, total: int, wanted: int, seed: int = 11) -> DataFrame:
    """About ``wanted`` of ``total`` rows: those whose key hashes below a threshold.

    Each task keeps its share, so what reaches a sort or the driver afterwards
    does not grow with the number of tasks.  Rows with equal keys stay together.
    """
    if total <= wanted:
        return rows
    span = 1 << 32
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(span)) < F.lit(wanted * span // total))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches cut into short slices, so that few texts are Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the bounds of its rows in them."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[bounds[0]:bounds[-1]], bounds - bounds[0]


def by_bytes(batches: Iterator[pa.RecordBatch], text: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``most`` bytes of their column ``text``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        bounds = text_bytes(batch.column(text))[1]
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + most, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def map_rows(df: DataFrame, columns: list[str], func: Callable[[list[list]], list[list]], schema: str,
             types: list[pa.DataType], names: list[str], rows: int = SLICE) -> DataFrame:
    """``func`` gets lists of column values of a slice and returns lists of output columns, same rows."""

    def run(batches):
        for part in sliced(batches, rows):
            out = func([c.to_pylist() for c in part.columns])
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=names)

    ship_package(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)


def rewrite_rows(df: DataFrame, text_col: str, func: Callable[[list], tuple[list | None, list | None]], rows: int = SLICE,
                 lengths: str | None = None) -> DataFrame:
    """All columns of ``df`` with texts replaced or rows dropped.

    ``func`` gets the texts of a slice and returns (new texts or None, keep
    flags or None).  ``lengths`` names a column that holds the text's length
    in characters and follows a replaced text.
    """
    at = df.columns.index(text_col)

    def run(batches):
        for part in sliced(batches, rows):
            texts, keep = func(part.column(at).to_pylist())
            if texts is not None:
                columns = list(part.columns)
                columns[at] = pa.array(texts, part.schema.field(at).type)
                if lengths in part.schema.names:
                    i = part.schema.get_field_index(lengths)
                    columns[i] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(part.schema.field(i).type)
                part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
            yield part if keep is None else part.filter(pa.array(keep, pa.bool_()))

    ship_package(df.sparkSession)
    return df.mapInArrow(run, df.schema)
