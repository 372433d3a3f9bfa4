"""Portfolio return, variance and the covariance forms, for many portfolios at once.

Variance uses the identity w'Σw = var_samp over complete dates of
Σ_i w_i r_i(t): join holdings to their lookback returns, one grouped sum per
(portfolio, date), one var_samp per portfolio.  No pivot, no matrix, no
driver round trip, and the number of portfolios is unbounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.operators.slicing import lookback_slice
from basketry.operators.valuation import portfolio_value
from basketry.session import stage_scratch
from basketry.sources.schemas import BASE_CURRENCY

#: Holdings of one block of a matrix: a pair of blocks is at most 64 vectors of a lookback.
GRAM_BLOCK = 32


def portfolio_return(portfolios: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ret = Σ weight * mean (percent)."""
    return portfolios.groupBy(*keys).agg(F.sum(F.col("mean") * F.col("weight")).alias("ret"))


def _held_returns(portfolios: DataFrame, scenarios: DataFrame, flong: DataFrame, keys: list[str], store: bool = True) -> DataFrame:
    """keys, symbol, weight, n_held, dt, ror: every holding with its lookback
    returns; a holding without any keeps one row with dt NULL.  The holdings are
    read twice, so they are written once first (``store``: not if they are a
    stored table already)."""
    if store:
        portfolios = stage_scratch(portfolios.select(*keys, "symbol", "weight"), "holdings")
    rets = lookback_slice(scenarios, flong, portfolios)
    h = portfolios.select(*keys, "symbol", "weight", F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("n_held"))
    return h.join(rets, ["scenario_id", "symbol"], "left")


def holding_returns(portfolios: DataFrame, scenarios: DataFrame, flong: DataFrame, keys: list[str]) -> DataFrame:
    """keys, symbol, weight, dt, ror over each scenario's lookback, complete dates only.

    A date is complete for a portfolio when every holding has a return on it."""
    x = _held_returns(portfolios, scenarios, flong, keys)
    n_ok = F.count("ror").over(Window.partitionBy(*keys, "dt"))
    return x.withColumn("n_ok", n_ok).filter("dt is not null and n_ok = n_held").drop("n_ok", "n_held")


def _per_date(portfolios: DataFrame, scenarios: DataFrame, flong: DataFrame, keys: list[str], store: bool = True) -> DataFrame:
    """keys, dt, pr (portfolio return of a complete date, else NULL); dt NULL for a portfolio without returns."""
    x = _held_returns(portfolios, scenarios, flong, keys, store).groupBy(*keys, "dt").agg(
        F.sum(F.col("weight") * F.col("ror")).alias("pr"), F.count("ror").alias("n_ok"), F.max("n_held").alias("n_held"))
    return x.select(*keys, "dt", F.when(F.col("dt").isNotNull() & (F.col("n_ok") == F.col("n_held")), F.col("pr")).alias("pr"))


def portfolio_variance(portfolios: DataFrame, scenarios: DataFrame, flong: DataFrame, keys: list[str], store: bool = True) -> DataFrame:
    """keys, variance (percent², NULL with fewer than two complete dates), n_dates; one row for every portfolio."""
    d = _per_date(portfolios, scenarios, flong, keys, store)
    return d.groupBy(*keys).agg(F.var_samp("pr").alias("variance"), F.count("pr").alias("n_dates"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def return_blocks(returns: DataFrame, keys: list[str], block: int = GRAM_BLOCK) -> DataFrame:
    """keys, block, n_dates, vectors: holdings in blocks of ``block`` by symbol, each with its centred return vector.

    ``returns`` as ``holding_returns`` gives them: all holdings of a portfolio
    have the same dates, so vectors in the order of dates are aligned.  They are
    shifted by their first value before they are centred, so a constant series
    has deviations of exactly 0.  A vector spans a lookback (at most 366 days)."""
    v = returns.groupBy(*keys, "symbol").agg(F.transform(F.sort_array(F.collect_list(F.struct("dt", "ror"))), lambda x: x["ror"]).alias("v"))
    v = v.withColumn("d", F.transform("v", lambda x: x - F.col("v")[0])).withColumn("n_dates", F.size("v"))
    v = v.withColumn("center", F.aggregate("d", F.lit(0.0), lambda total, x: total + x) / F.col("n_dates"))
    v = v.withColumn("c", F.transform("d", lambda x: x - F.col("center")))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("symbol")) - 1
    v = v.select(*keys, "n_dates", F.floor(number / block).cast("int").alias("block"), "symbol", "c", _dot(F.col("c"), F.col("c")).alias("ss"))
    return v.groupBy(*keys, "block").agg(F.first("n_dates").alias("n_dates"), F.sort_array(F.collect_list(F.struct("symbol", "c", "ss"))).alias("vectors"))


def _pair_measures(portfolios: DataFrame, scenarios: DataFrame, flong: DataFrame, keys: list[str]) -> DataFrame:
    """keys, symbol_i, symbol_j, cov, corr over complete dates, both halves of the matrix.

    Blocked Gram product: a portfolio's vectors lie in blocks, every pair of its
    blocks is one row whose products are taken vector by vector, and the other
    half is the mirror image.  There is no row per pair and date, and a
    portfolio of any number of holdings is spread over its pairs of blocks."""
    blocks = stage_scratch(return_blocks(holding_returns(portfolios, scenarios, flong, keys), keys), "return-blocks")
    left = blocks.select(*keys, F.col("block").alias("bi"), "n_dates", F.col("vectors").alias("vi"))
    right = blocks.select(*keys, F.col("block").alias("bj"), F.col("vectors").alias("vj"))
    both = left.join(right, keys).filter("bi <= bj")

    def measures(i, j):
        return F.struct(i["symbol"].alias("symbol_i"), j["symbol"].alias("symbol_j"), _dot(i["c"], j["c"]).alias("cc"), (i["ss"] * j["ss"]).alias("ss"))

    products = F.flatten(F.transform("vi", lambda i: F.transform(F.filter("vj", lambda j: j["symbol"] >= i["symbol"]), lambda j: measures(i, j))))
    half = both.select(*keys, "n_dates", F.explode(products).alias("m"))
    several = F.col("n_dates") > 1
    half = half.select(*keys, "m.symbol_i", "m.symbol_j", F.when(several, F.col("m.cc") / (F.col("n_dates") - 1)).alias("cov"),
                       F.when(several, F.try_divide(F.col("m.cc"), F.sqrt("m.ss"))).alias("corr"))
    sides = F.when(F.col("symbol_i") == F.col("symbol_j"), F.array(F.struct("symbol_i", "symbol_j"))).otherwise(
        F.array(F.struct("symbol_i", "symbol_j"), F.struct(F.col("symbol_j").alias("symbol_i"), F.col("symbol_i").alias("symbol_j"))))
    return half.select(*keys, "cov", "corr", F.explode(sides).alias("s")).select(*keys, "s.symbol_i", "s.symbol_j", "cov", "corr")


def covariance_matrix(portfolios: DataFrame, scenarios: DataFrame, flong: DataFrame, keys: list[str]) -> DataFrame:
    """keys, symbol_i, symbol_j, cov: sample covariance of the holdings' returns
    over complete dates (NULL with fewer than two dates)."""
    return _pair_measures(portfolios, scenarios, flong, keys).drop("corr")


def correlation_matrix(portfolios: DataFrame, scenarios: DataFrame, flong: DataFrame, keys: list[str]) -> DataFrame:
    """keys, symbol_i, symbol_j, corr (Pearson), from the same aggregate as the covariance."""
    return _pair_measures(portfolios, scenarios, flong, keys).drop("cov")


def quadratic_form(portfolios: DataFrame, cov: DataFrame, keys: list[str]) -> DataFrame:
    """keys, variance = Σ_i Σ_j w_i w_j cov_ij (cross-check of portfolio_variance)."""
    wi = portfolios.select(*keys, F.col("symbol").alias("symbol_i"), F.col("weight").alias("wi"))
    wj = portfolios.select(*keys, F.col("symbol").alias("symbol_j"), F.col("weight").alias("wj"))
    j = cov.join(wi, keys + ["symbol_i"]).join(wj, keys + ["symbol_j"])
    return j.groupBy(*keys).agg(F.sum(F.col("wi") * F.col("wj") * F.col("cov")).alias("variance"))


def complete_dates(portfolios: DataFrame, scenarios: DataFrame, flong: DataFrame, keys: list[str]) -> DataFrame:
    """keys, dt: dates on which every holding has a return."""
    return _per_date(portfolios, scenarios, flong, keys).filter("pr is not null").select(*keys, "dt")


def portfolio_summary(portfolios: DataFrame, scenarios: DataFrame, flong: DataFrame, prices: DataFrame, fx: DataFrame,
                      base: str = BASE_CURRENCY) -> DataFrame:
    """scenario_id, portfolio_id, ret, variance, value at formation: one row per portfolio."""
    keys = ["scenario_id", "portfolio_id"]
    portfolios = stage_scratch(portfolios, "summary-holdings")
    r = portfolio_return(portfolios, keys)
    v = portfolio_variance(portfolios, scenarios, flong, keys, store=False).select(*keys, "variance")
    w = portfolio_value(portfolios, scenarios, prices, fx, base=base).select(*keys, "value")
    return r.join(v, keys, "left").join(w, keys, "left")
