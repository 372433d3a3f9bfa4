"""Price and FX tables derived from the driver's TPC-H-style tables.

``panel``: one asset per supplier nation, one bar per week.  ``fx``: EUR per
USD per week.  ``daily``: one asset per supplier, one bar per ship day (many
symbols, sparse dates).  Prices are built from integer cents and divided
late, so Spark and DuckDB produce equal doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _cents(c: str):
    """Hundredths, rounded half up as ``round`` does, which takes a decimal object a row: ``rint`` differs at ties alone."""
    v = F.col(c).cast("double") * 100
    r = F.rint(v)
    return F.when(F.abs(v - r) == 0.5, v + F.signum(v) * 0.5).otherwise(r).cast("bigint")


def panel_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, dt, open, high, low, close, adj_close, volume, index_name, currency."""
    li = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    sup = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = _t(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    reg = _t(spark, sf_dir, "region").select("r_regionkey", "r_name")
    unit_price = F.col("l_extendedprice") / F.col("l_quantity")
    # aggregated by the supplier's nation key first: each line item meets one join, and names join a few rows a week
    n = (li.join(sup.filter(F.col("s_nationkey").isNotNull()), li.l_suppkey == sup.s_suppkey)
           .groupBy("s_nationkey", F.trunc(F.col("l_shipdate").cast("date"), "week").alias("wk"))
           .agg(F.sum(_cents("l_extendedprice")).alias("cents"),
                F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
                F.max(unit_price).alias("high"),
                F.min(unit_price).alias("low")))
    g = (n.join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
          .join(reg, F.col("n_regionkey") == F.col("r_regionkey"))
          .groupBy("n_nationkey", "wk", "r_name")
          .agg(F.sum("cents").alias("cents"), F.sum("qty").alias("qty"), F.max("high").alias("high"), F.min("low").alias("low")))
    adj = g.cents.cast("double") / g.qty.cast("double") / F.lit(100.0)
    return g.select(
        F.concat(F.lit("N."), F.col("n_nationkey").cast("string")).alias("symbol"),
        F.col("wk").cast("date").alias("dt"),
        adj.alias("open"), F.col("high"), F.col("low"), adj.alias("close"),
        adj.alias("adj_close"),
        F.col("qty").cast("bigint").alias("volume"),
        F.col("r_name").alias("index_name"),
        F.when(F.col("r_name") == "EUROPE", "EUR").otherwise("USD").alias("currency"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, dt, adj_close, volume, index_name, currency."""
    return panel_raw(spark, sf_dir).select("symbol", "dt", "adj_close", "volume", "index_name", "currency")


def fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dt, from_ccy, to_ccy, adj_close: base (EUR) units per one USD."""
    o = _t(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice")
    g = (o.groupBy(F.date_trunc("week", "o_orderdate").alias("wk"))
          .agg(F.sum(_cents("o_totalprice")).alias("cents"), F.count(F.lit(1)).alias("n")))
    return g.select(
        F.col("wk").cast("date").alias("dt"), F.lit("USD").alias("from_ccy"), F.lit("EUR").alias("to_ccy"),
        (g.cents.cast("double") / g.n.cast("double") / F.lit(25000000.0)).alias("adj_close"))


def fx_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX rows with the CSV layout (price columns repeated, volume = order count)."""
    o = _t(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice")
    g = (o.groupBy(F.date_trunc("week", "o_orderdate").alias("wk"))
          .agg(F.sum(_cents("o_totalprice")).alias("cents"), F.count(F.lit(1)).alias("n")))
    rate = g.cents.cast("double") / g.n.cast("double") / F.lit(25000000.0)
    return g.select(F.col("wk").cast("date").alias("dt"), rate.alias("open"), rate.alias("high"),
                    rate.alias("low"), rate.alias("close"), rate.alias("adj_close"),
                    F.col("n").cast("bigint").alias("volume"),
                    F.lit("USD").alias("from_ccy"), F.lit("EUR").alias("to_ccy"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, dt, adj_close, volume, index_name, currency: one asset per supplier."""
    li = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    g = (li.groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("dt"))
           .agg(F.sum(_cents("l_extendedprice")).alias("cents"),
                F.sum(F.col("l_quantity").cast("bigint")).alias("qty")))
    return g.select(
        F.concat(F.lit("S."), F.col("l_suppkey").cast("string")).alias("symbol"), "dt",
        (g.cents.cast("double") / g.qty.cast("double") / F.lit(100.0)).alias("adj_close"),
        F.col("qty").cast("bigint").alias("volume"),
        F.lit("SUPPLIERS").alias("index_name"), F.lit("USD").alias("currency"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw price rows with repeats: every lineitem is a tick of its supplier on the ship day."""
    li = _t(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("S."), F.col("l_suppkey").cast("string")).alias("symbol"), F.col("l_shipdate").cast("date").alias("dt"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("adj_close"), F.col("l_quantity").cast("bigint").alias("volume"),
        F.lit("SUPPLIERS").alias("index_name"), F.lit("USD").alias("currency"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars, one asset per part: a wide universe (thousands of symbols)."""
    li = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    g = (li.groupBy("l_partkey", F.date_trunc("month", "l_shipdate").cast("date").alias("dt"))
           .agg(F.sum(_cents("l_extendedprice")).alias("cents"),
                F.sum(F.col("l_quantity").cast("bigint")).alias("qty")))
    return g.select(
        F.concat(F.lit("P."), F.col("l_partkey").cast("string")).alias("symbol"), "dt",
        (g.cents.cast("double") / g.qty.cast("double") / F.lit(100.0)).alias("adj_close"),
        F.col("qty").cast("bigint").alias("volume"),
        F.lit("PARTS").alias("index_name"), F.lit("USD").alias("currency"))


# ---------------------------------------------------------------- oracle text
# The same tables as DuckDB SQL over the pre-registered views.

SQL_PANEL_RAW = """
select concat('N.', n_nationkey) as symbol,
       cast(date_trunc('week', l_shipdate) as date) as dt,
       cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double)
         / cast(sum(cast(l_quantity as bigint)) as double) / cast(100 as double) as adj_close,
       max(l_extendedprice / l_quantity) as high,
       min(l_extendedprice / l_quantity) as low,
       cast(sum(cast(l_quantity as bigint)) as bigint) as volume,
       r_name as index_name,
       case when r_name = 'EUROPE' then 'EUR' else 'USD' end as currency
from lineitem
join supplier on l_suppkey = s_suppkey
join nation on s_nationkey = n_nationkey
join region on n_regionkey = r_regionkey
group by n_nationkey, date_trunc('week', l_shipdate), r_name
"""

SQL_PANEL = """
select symbol, dt, adj_close, volume, index_name, currency from panel_raw
"""

SQL_FX = """
select cast(date_trunc('week', o_orderdate) as date) as dt,
       'USD' as from_ccy, 'EUR' as to_ccy,
       cast(sum(cast(round(o_totalprice * 100) as bigint)) as double)
         / cast(count(*) as double) / cast(25000000 as double) as adj_close
from orders
group by date_trunc('week', o_orderdate)
"""

SQL_DAILY = """
select concat('S.', l_suppkey) as symbol, cast(l_shipdate as date) as dt,
       cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double)
         / cast(sum(cast(l_quantity as bigint)) as double) / cast(100 as double) as adj_close,
       cast(sum(cast(l_quantity as bigint)) as bigint) as volume,
       'SUPPLIERS' as index_name, 'USD' as currency
from lineitem group by l_suppkey, cast(l_shipdate as date)
"""

SQL_PARTS = """
select concat('P.', l_partkey) as symbol, cast(date_trunc('month', l_shipdate) as date) as dt,
       cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double)
         / cast(sum(cast(l_quantity as bigint)) as double) / cast(100 as double) as adj_close,
       cast(sum(cast(l_quantity as bigint)) as bigint) as volume,
       'PARTS' as index_name, 'USD' as currency
from lineitem group by l_partkey, cast(date_trunc('month', l_shipdate) as date)
"""
