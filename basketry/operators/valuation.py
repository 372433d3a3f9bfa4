"""Shares, as-of prices, FX conversion, value and ROI for many portfolios at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.session import stage_scratch
from basketry.sources.schemas import BASE_CURRENCY, HORIZONS

PKEYS = ["scenario_id", "portfolio_id"]


def allocate_shares(portfolios: DataFrame, scenarios: DataFrame) -> DataFrame:
    """shares = trunc(weight * budget / price) with the formation price in local
    currency; NULL (not an error) for a zero price."""
    b = scenarios.select("scenario_id", "budget", "fee", "n_assets", "formation_date")
    p = portfolios.join(b, "scenario_id")
    raw = F.try_divide(F.col("weight") * F.col("budget").cast("double"), F.col("price"))
    return p.withColumn("shares", raw.try_cast("bigint"))


def asof(values: DataFrame, requests: DataFrame, key: str, value: str,
         req_dt: str = "req_dt", max_staleness_days: int | None = None) -> DataFrame:
    """Latest ``value`` at or before each request date, per ``key``.

    ``values``: key, dt, value.  ``requests``: key, req_dt, ... (any columns).
    Adds ``<value>_dt`` and ``value``.  Distinct (key, req_dt) pairs are
    resolved first, so a key requested by many portfolios is resolved once:
    per key the window holds at most one row per calendar day of prices and
    of requests.  The resolved pairs join back on (key, req_dt)."""
    hit_dt = f"{value}_dt"
    v = values.filter(F.col(value).isNotNull()).select(
        key, "dt", F.struct(F.col("dt").alias(hit_dt), F.col(value).alias(value)).alias("_hit"),
        F.lit(0).alias("_side"))
    r = requests.select(key, F.col(req_dt).alias("dt")).distinct().select(
        key, "dt", F.lit(None).cast(v.schema["_hit"].dataType).alias("_hit"), F.lit(1).alias("_side"))
    w = Window.partitionBy(key).orderBy("dt", "_side").rowsBetween(Window.unboundedPreceding, 0)
    res = (v.unionByName(r).select(key, "dt", "_side", F.last("_hit", ignorenulls=True).over(w).alias("_hit"))
            .filter(F.col("_side") == 1)
            .select(key, F.col("dt").alias(req_dt), F.col(f"_hit.{hit_dt}").alias(hit_dt), F.col(f"_hit.{value}").alias(value)))
    if max_staleness_days is not None:
        stale = F.datediff(F.col(req_dt), F.col(hit_dt)) > max_staleness_days
        res = res.select(key, req_dt, F.when(stale, None).otherwise(F.col(hit_dt)).alias(hit_dt),
                         F.when(stale, None).otherwise(F.col(value)).alias(value))
    return requests.join(res, [key, req_dt], "left")


def asof_price(prices: DataFrame, requests: DataFrame, max_staleness_days: int | None = None) -> DataFrame:
    """requests (symbol, req_dt, ...) + price_dt, price from prices (symbol, dt, adj_close)."""
    p = prices.select("symbol", "dt", F.col("adj_close").alias("price"))
    return asof(p, requests, "symbol", "price", "req_dt", max_staleness_days)


def fx_rate(fx: DataFrame, requests: DataFrame, base: str = BASE_CURRENCY) -> DataFrame:
    """requests (currency, rate_req_dt, ...) + rate: base units per one unit of currency,
    as of the request date; 1.0 for the base currency; NULL when no rate exists.

    Rates are reduced to one a (currency, day) first (the highest, so duplicates
    give the same answer in any order): a currency's window then holds calendar
    days, not rows of the feed."""
    f = (fx.filter((F.col("to_ccy") == base) & F.col("adj_close").isNotNull())
           .groupBy(F.col("from_ccy").alias("currency"), "dt").agg(F.max("adj_close").alias("rate")))
    need = requests.filter(F.col("currency") != base)
    got = asof(f, need.select("currency", "rate_req_dt").distinct(), "currency", "rate", "rate_req_dt")
    out = requests.join(got, ["currency", "rate_req_dt"], "left")
    return out.withColumn("rate", F.when(F.col("currency") == base, F.lit(1.0)).otherwise(F.col("rate")))


def convert_currency(price, rate, currency, base: str = BASE_CURRENCY):
    """Local price to the base currency (price * rate unless already in base)."""
    return F.when(currency == base, price).otherwise(price * rate)


def shares_value(holdings: DataFrame, prices: DataFrame, fx: DataFrame, keys=PKEYS,
                 max_staleness_days: int | None = None, base: str = BASE_CURRENCY) -> DataFrame:
    """keys, val_dt, value, n_held, n_priced.

    ``holdings``: keys, symbol, shares, currency, val_dt (one row per holding and
    valuation date).  value = sum(shares * price * rate) in the base currency,
    with price as of val_dt and the rate as of the price's own date; NULL when
    any holding has no price or rate.  Requests and priced requests are written
    once: an as-of lookup reads them twice (distinct keys, then the join back),
    and neither reading repeats how they came about."""
    req = stage_scratch(holdings.withColumnRenamed("val_dt", "req_dt"), "value-requests")
    priced = stage_scratch(asof_price(prices, req, max_staleness_days).withColumn("rate_req_dt", F.col("price_dt")), "priced")
    rated = fx_rate(fx, priced, base)
    comp = convert_currency(F.col("price"), F.col("rate"), F.col("currency"), base) * F.col("shares")
    g = rated.groupBy(*keys, F.col("req_dt").alias("val_dt")).agg(
        F.sum(comp).alias("_v"), F.count(F.lit(1)).alias("n_held"), F.count(comp).alias("n_priced"))
    return g.select(*keys, "val_dt", F.when(F.col("n_priced") == F.col("n_held"), F.col("_v")).alias("value"),
                    "n_held", "n_priced")


def _fee() -> Column:
    return (F.col("fee") * F.col("n_assets")).cast("double")


def portfolio_value(portfolios: DataFrame, scenarios: DataFrame, prices: DataFrame, fx: DataFrame,
                    val_dates: DataFrame | None = None, base: str = BASE_CURRENCY) -> DataFrame:
    """scenario_id, portfolio_id, val_dt, value: shares value minus fee * n_assets.
    ``val_dates`` (scenario_id, val_dt) defaults to the formation date."""
    sh = allocate_shares(portfolios, scenarios).withColumn("_fee", _fee())
    dated = sh.withColumn("val_dt", F.col("formation_date")) if val_dates is None else sh.join(val_dates, "scenario_id")
    v = shares_value(dated.select(*PKEYS, "_fee", "symbol", "shares", "currency", "val_dt"), prices, fx, [*PKEYS, "_fee"], base=base)
    return v.select(*PKEYS, "val_dt", (F.col("value") - F.col("_fee")).alias("value"))


def _roi(dated: DataFrame, prices: DataFrame, fx: DataFrame, base: str) -> DataFrame:
    """PKEYS, label, end_date, start_value, end_value, roi.

    ``dated``: shares rows with ``at``: struct(label, dt), label NULL for the
    formation date.  Start and ends are valued in one grouped pass; the start
    value reaches the ends through a window over the portfolio's few rows."""
    h = dated.select(*PKEYS, "_fee", "symbol", "shares", "currency", F.col("at.label").alias("label"), F.col("at.dt").alias("val_dt"))
    v = shares_value(h, prices, fx, [*PKEYS, "_fee", "label"], base=base)
    start = F.max(F.when(F.col("label").isNull(), F.col("value") - F.col("_fee"))).over(Window.partitionBy(*PKEYS))
    r = v.withColumn("start_value", start).filter(F.col("label").isNotNull())
    roi = F.try_divide(F.col("value") - F.col("start_value"), F.col("start_value"))
    return r.select(*PKEYS, "label", F.col("val_dt").alias("end_date"), "start_value", F.col("value").alias("end_value"), roi.alias("roi"))


def _point(label, dt) -> Column:
    return F.struct(label.cast("string").alias("label"), dt.alias("dt"))


def roi_horizons(portfolios: DataFrame, scenarios: DataFrame, prices: DataFrame, fx: DataFrame,
                 horizons=HORIZONS, base: str = BASE_CURRENCY) -> DataFrame:
    """scenario_id, portfolio_id, horizon, end_date, start_value, end_value, roi.

    ROI = (end - start) / start with start = value at formation - fee * n_assets
    and end = value at formation + days (no fee).  All horizons of all
    portfolios are valued in one pass: holdings x {start, ends} -> as-of
    price -> FX -> grouped sums.  ``horizons`` is a short constant list of
    (label, days), expanded inside each holding row."""
    f = F.col("formation_date")
    points = F.array(_point(F.lit(None), f), *[_point(F.lit(a), F.date_add(f, int(d))) for a, d in horizons])
    sh = allocate_shares(portfolios, scenarios).withColumn("_fee", _fee())
    return _roi(sh.withColumn("at", F.explode(points)), prices, fx, base).withColumnRenamed("label", "horizon")


def portfolio_roi(portfolios: DataFrame, scenarios: DataFrame, prices: DataFrame, fx: DataFrame,
                  end_dates: DataFrame, base: str = BASE_CURRENCY) -> DataFrame:
    """ROI between each scenario's formation date and its end dates
    (``end_dates``: scenario_id, end_date; the dates of one scenario form one short list)."""
    ends = end_dates.select("scenario_id", "end_date").distinct().groupBy("scenario_id").agg(
        F.collect_list(_point(F.col("end_date"), F.col("end_date"))).alias("ends"))
    sh = allocate_shares(portfolios, scenarios).withColumn("_fee", _fee()).join(ends, "scenario_id")
    points = F.concat(F.array(_point(F.lit(None), F.col("formation_date"))), F.col("ends"))
    return _roi(sh.withColumn("at", F.explode(points)), prices, fx, base).drop("label")
