"""Per-symbol window features: rate of return, rolling sample stddev and mean.

All frames are ROWS frames over one symbol ordered by date.  Every window
expression shares one partitioning (symbol) and one order (dt), so the plan
has a single exchange and a single sort for the 18 feature columns.

Skew: a symbol's window partition holds one row per (symbol, date) after the
duplicate collapse below, so its size is bounded by the calendar (at most
366 rows a year), not by the data volume.  The collapse is a group-by with
map-side combine, so even a symbol that holds a third of all raw rows
(duplicated feeds) is reduced before its rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.columns import clean_symbol, date_parts
from basketry.sources.schemas import WINDOWS

BASE_COLS = ["symbol", "dt", "adj_close", "volume", "index_name", "currency"]


def _by_symbol():
    return Window.partitionBy("symbol").orderBy("dt")


def collapse_duplicates(prices: DataFrame) -> DataFrame:
    """One row per (symbol, dt): the row with the highest volume, then price."""
    best = F.max(F.struct("volume", "adj_close", "index_name", "currency")).alias("b")
    return (prices.groupBy("symbol", "dt").agg(best)
            .select("symbol", "dt", "b.adj_close", "b.volume", "b.index_name", "b.currency"))


def duplicate_rows(raw: DataFrame) -> DataFrame:
    """symbol, dt, n_removed: what :func:`collapse_duplicates` takes out of raw rows
    (the counterpart of ``rejected_rows`` for rows that parse but repeat)."""
    p = raw.select(clean_symbol("symbol").alias("symbol"), "dt").groupBy("symbol", "dt").agg(F.count(F.lit(1)).alias("n"))
    return p.filter("n > 1").select("symbol", "dt", (F.col("n") - 1).alias("n_removed"))


def rate_of_return(k: int, price: str = "adj_close") -> Column:
    """(p - lag(p, k)) / lag(p, k) * 100; NULL where the lag is missing or 0."""
    lagged = F.lag(price, k).over(_by_symbol())
    return (F.try_divide(F.col(price) - lagged, lagged) * F.lit(100.0)).alias(f"ror_{k}")


def rolling_stddev(k: int) -> Column:
    """Sample stddev of ror_k over rows -k..0 (k+1 rows, NULLs skipped)."""
    return F.stddev_samp(f"ror_{k}").over(_by_symbol().rowsBetween(-k, 0)).alias(f"std_{k}")


def rolling_mean(k: int) -> Column:
    """Mean of ror_k over rows -k..0 (k+1 rows, NULLs skipped)."""
    return F.avg(f"ror_{k}").over(_by_symbol().rowsBetween(-k, 0)).alias(f"mean_{k}")


def prepare_prices(raw: DataFrame, dedupe: bool = True) -> DataFrame:
    """clean_symbol + prune the OHLC columns (+ optional duplicate collapse, which
    :func:`duplicate_rows` reports)."""
    p = raw.select(clean_symbol("symbol").alias("symbol"), "dt", "adj_close",
                   F.col("volume").cast("bigint").alias("volume"), "index_name", "currency")
    return collapse_duplicates(p) if dedupe else p


def asset_features(prices: DataFrame, windows=WINDOWS, dedupe: bool = True) -> DataFrame:
    """The feature panel: base columns, year/month/day, then ror_k, std_k, mean_k per window."""
    p = prepare_prices(prices, dedupe)
    lvl1 = p.select(*BASE_COLS, *date_parts("dt"), *[rate_of_return(k) for k in windows])
    keep = BASE_COLS + ["year", "month", "day"] + [f"ror_{k}" for k in windows]
    return lvl1.select(*keep, *[rolling_stddev(k) for k in windows], *[rolling_mean(k) for k in windows])


def features_long(features: DataFrame, windows=WINDOWS) -> DataFrame:
    """(symbol, dt, window, ror, std, mean, adj_close, currency): one row per window.

    Lets scenarios with different windows join the panel on (dt, window) in one job.
    The unpivot is narrow (no exchange); it runs after the window exchange.
    """
    rows = F.array(*[F.struct(F.lit(k).alias("win"), F.col(f"ror_{k}").alias("ror"),
                              F.col(f"std_{k}").alias("std"), F.col(f"mean_{k}").alias("mean"))
                     for k in windows])
    return features.select("symbol", "dt", "adj_close", "currency", F.inline(rows)) \
                   .select("symbol", "dt", "win", "ror", "std", "mean", "adj_close", "currency")


def fx_panel(fx_rows: DataFrame) -> DataFrame:
    """FX: prune price columns and volume, add date parts. No global sort."""
    return fx_rows.select("dt", "adj_close", "from_ccy", "to_ccy", *date_parts("dt"))
