"""Feature panel storage: Parquet partitioned by year, its long form by window and year (scan pruning by date and window)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.features import asset_features, features_long
from basketry.session import path_exists
from basketry.sources.csv import read_asset_csv


def write_panel_parquet(df: DataFrame, path: str) -> None:
    """Write partitioned by year; fails if the path exists (the reference's default mode).

    Rebalanced by year: the exchange's partitions are merged or split at run
    time to the advisory size, so a year gets as many files as its data needs,
    not one a task.  Rows of a file are ordered by symbol and date (tight
    min/max statistics)."""
    out = df if "year" in df.columns else df.withColumn("year", F.year("dt").cast("int"))
    (out.hint("rebalance", "year").sortWithinPartitions("year", "symbol", "dt")
        .write.mode("errorifexists").partitionBy("year").parquet(path))


def read_panel_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def panel_or_build(spark: SparkSession, path: str, csv_paths) -> DataFrame:
    """The stored feature panel at ``path``; built from the CSV files and stored
    first when absent.  A folder that a broken-off write left (no ``_SUCCESS``)
    is an error, not a panel: the caller decides what becomes of it."""
    if not path_exists(spark, path):
        write_panel_parquet(asset_features(read_asset_csv(spark, csv_paths)), path)
    elif not path_exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        raise RuntimeError(f"{path} holds an incomplete panel (no _SUCCESS): remove it and build again")
    return read_panel_parquet(spark, path)


def write_long_panel(features: DataFrame, path: str) -> None:
    """The long form (a row per symbol, date and window) partitioned by window and year.

    A scenario asks for one window and a few years: the slices read those
    folders alone (``slicing.asked_folders``).  Rows of a file are ordered
    by date and symbol."""
    out = features_long(features).withColumn("year", F.year("dt").cast("int"))
    (out.hint("rebalance", "win", "year").sortWithinPartitions("win", "year", "dt", "symbol")
        .write.mode("errorifexists").partitionBy("win", "year").parquet(path))


def read_long_panel(spark: SparkSession, path: str) -> DataFrame:
    """symbol, dt, win, ror, std, mean, adj_close, currency, year."""
    schema = "symbol string, dt date, ror double, std double, mean double, adj_close double, currency string, win int, year int"
    return spark.read.schema(schema).parquet(path).select("symbol", "dt", "win", "ror", "std", "mean", "adj_close", "currency", "year")
