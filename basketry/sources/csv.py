"""CSV price and FX files: declared schema, ';' separator, header, yyyy-MM-dd.

Rows that do not fit the schema are kept apart (PERMISSIVE mode with a
corrupt-record column) instead of being dropped silently, and
:func:`rejected_rows` reports them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.sources.schemas import ASSET_CSV, CORRUPT, DOWNLOADER_CSV, FX_CSV

# columnPruning: the CSV parser skips columns a query does not read, so a
# malformed value in a pruned column would go unnoticed and the kept rows would
# depend on the projection; every column is parsed.
CSV_OPTIONS = {"sep": ";", "header": "true", "dateFormat": "yyyy-MM-dd", "mode": "PERMISSIVE",
               "columnNameOfCorruptRecord": CORRUPT, "columnPruning": "false"}


def _read(spark: SparkSession, paths, schema: T.StructType) -> DataFrame:
    full = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(full).options(**CSV_OPTIONS).csv(paths)


# A row is good when it parses and has a date, a price and a key.
_REQUIRED = {"asset": ("dt", "adj_close", "symbol"), "fx": ("dt", "adj_close", "from_ccy", "to_ccy")}


def _good(schema: T.StructType):
    req = _REQUIRED["fx" if "from_ccy" in schema.fieldNames() else "asset"]
    cond = F.col(CORRUPT).isNull()
    for c in req:
        cond = cond & F.col(c).isNotNull()
    return cond


def read_asset_csv(spark: SparkSession, paths) -> DataFrame:
    """Good asset rows: dt, open, high, low, close, adj_close, volume, symbol, index_name, currency."""
    return _read(spark, paths, ASSET_CSV).filter(_good(ASSET_CSV)).drop(CORRUPT)


def read_fx_csv(spark: SparkSession, paths) -> DataFrame:
    """Good FX rows: dt, open, high, low, close, adj_close, volume, from_ccy, to_ccy."""
    return _read(spark, paths, FX_CSV).filter(_good(FX_CSV)).drop(CORRUPT)


def rejected_rows(spark: SparkSession, paths, schema: T.StructType = ASSET_CSV) -> DataFrame:
    """file, line of every row that does not parse under ``schema`` or lacks a
    required value (a short row parses with NULLs in PERMISSIVE mode)."""
    return _read(spark, paths, schema).filter(~_good(schema)).select(F.input_file_name().alias("file"), line_text(schema))


def line_text(schema: T.StructType):
    """``line``: the rejected text, or the parsed values where the row parsed but lacks one."""
    cols = [F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in schema.fields]
    return F.coalesce(F.col(CORRUPT), F.concat_ws(";", *cols)).alias("line")


def read_downloader_csv(spark: SparkSession, paths, listing: DataFrame) -> DataFrame:
    """Asset rows from the price downloader's files: 8 columns, no index and no
    currency.  Both come from ``listing`` (symbol, index_name, currency; one row
    a symbol); rows without a match are left to :func:`downloader_rejects`."""
    rows = _read(spark, paths, DOWNLOADER_CSV).filter(_good(DOWNLOADER_CSV)).drop(CORRUPT)
    return rows.join(listing, "symbol").select(*[f.name for f in ASSET_CSV.fields])


def downloader_rejects(spark: SparkSession, paths, listing: DataFrame) -> DataFrame:
    """file, line of downloader rows that don't parse, lack a value or whose symbol isn't listed."""
    raw = _read(spark, paths, DOWNLOADER_CSV).withColumn("file", F.input_file_name())
    known = listing.select("symbol", F.lit(True).alias("_listed"))
    return raw.join(known, "symbol", "left").filter(~_good(DOWNLOADER_CSV) | F.col("_listed").isNull()).select("file", line_text(DOWNLOADER_CSV))


def write_downloader_csv(df: DataFrame, path: str) -> None:
    """Write asset rows in the downloader's 8-column layout (used to stage test inputs)."""
    df.select(*[f.name for f in DOWNLOADER_CSV.fields]).write.mode("errorifexists").options(
        sep=";", header="true", dateFormat="yyyy-MM-dd").csv(path)


def write_asset_csv(df: DataFrame, path: str) -> None:
    """Write asset rows in the CSV layout (used to stage test inputs)."""
    cols = [f.name for f in ASSET_CSV.fields]
    df.select(*cols).write.mode("errorifexists").options(sep=";", header="true", dateFormat="yyyy-MM-dd").csv(path)


def write_fx_csv(df: DataFrame, path: str) -> None:
    cols = [f.name for f in FX_CSV.fields]
    df.select(*cols).write.mode("errorifexists").options(sep=";", header="true", dateFormat="yyyy-MM-dd").csv(path)
