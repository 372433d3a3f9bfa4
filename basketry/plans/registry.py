"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their oracle SQL.

Each query reads the driver's tables (through the fixtures) and runs over
all of them; the oracle SQL computes the same rows in DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.columns import clean_symbol, date_parts, rescale_range
from basketry.operators import backtest
from basketry.operators import features as feat
from basketry.operators import formation as form
from basketry.operators import risk, slicing, valuation
from basketry.plans import oracle as O
from basketry.plans import oracle_search as OS
from basketry.operators import search
from basketry.plans.context import Ctx, rounded, sql_rounded
from basketry.plans.scenarios import DEFAULTS
from basketry.session import StoredTables, scratch_path, stage, stage_scratch
from basketry.sources import csv as csvsrc
from basketry.sources import fixtures as fx_mod
from basketry.sources import parquet as pq
from basketry.sources import sinks
from basketry.sources.fixtures import SQL_FX, SQL_PANEL_RAW
from basketry.sources.schemas import ASSET_CSV, ROULETTE_NEW, ROULETTE_OLD, WINDOWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

R6, MONEY, VAR = 6, 2, 4
PK = ["scenario_id", "portfolio_id"]
PK_SQL = "scenario_id, portfolio_id"


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


FEATURE_COLS = (["symbol", "dt", "adj_close", "volume", "index_name", "currency", "year", "month", "day"]
                + [f"ror_{k}" for k in WINDOWS] + [f"std_{k}" for k in WINDOWS] + [f"mean_{k}" for k in WINDOWS])
# Prices are bit-identical inputs in both engines and stay unrounded.
FEATURE_ROUND = {c: R6 for c in FEATURE_COLS if c.startswith(("ror_", "std_", "mean_"))}
PORT_COLS = ["scenario_id", "portfolio_id", "symbol", "weight", "price", "currency", "mean"]
# Weights come out of short decimals: six digits would often be halfway.
PORT_ROUND = {"weight": 9, "mean": R6}

BASE = O.base_ctes()


# ------------------------------------------------------- projections, cleaning

@query("clean_symbol", O.with_ctes([("panel_raw", SQL_PANEL_RAW)],
                                    "select distinct symbol as raw_symbol, translate(symbol, '.', '_') as symbol from panel_raw"))
def q_clean_symbol(spark, sf_dir):
    p = Ctx(spark, sf_dir).panel
    return p.select(F.col("symbol").alias("raw_symbol"), clean_symbol("symbol").alias("symbol")).distinct()


@query("date_parts", O.with_ctes(BASE[:2],
                                  "select distinct dt, cast(year(dt) as integer) as year, cast(month(dt) as integer) as month, "
                                  "cast(day(dt) as integer) as day from panel"))
def q_date_parts(spark, sf_dir):
    return Ctx(spark, sf_dir).panel.select("dt", *date_parts("dt")).distinct()


@query("fx_panel", O.with_ctes([("fx", SQL_FX)],
                                "select dt, round(adj_close, 9) as adj_close, from_ccy, to_ccy, cast(year(dt) as integer) as year, "
                                "cast(month(dt) as integer) as month, cast(day(dt) as integer) as day from fx"))
def q_fx_panel(spark, sf_dir):
    return rounded(feat.fx_panel(Ctx(spark, sf_dir).fx), {"adj_close": 9})


_RS = f"""((mean_252 - ({ROULETTE_OLD[0]})) * ({ROULETTE_NEW[1]} - {ROULETTE_NEW[0]})) / ({ROULETTE_OLD[1]} - ({ROULETTE_OLD[0]})) + {ROULETTE_NEW[0]}"""


@query("rescale_range", O.with_ctes(BASE, f"select symbol, dt, round({_RS}, 6) as scaled from features where mean_252 is not null"))
def q_rescale_range(spark, sf_dir):
    """The roulette map of the reference: [-10000, 10000] -> [1, 10000], applied to mean_252."""
    f = Ctx(spark, sf_dir).features.filter(F.col("mean_252").isNotNull())
    s = rescale_range(F.col("mean_252"), ROULETTE_OLD[0], ROULETTE_OLD[1], ROULETTE_NEW[0], ROULETTE_NEW[1])
    return f.select("symbol", "dt", F.round(s, 6).alias("scaled"))


# ----------------------------------------------------------- window features

@query("asset_features", O.with_ctes(BASE, sql_rounded(FEATURE_COLS, FEATURE_ROUND, "features")))
def q_asset_features(spark, sf_dir):
    return rounded(feat.asset_features(Ctx(spark, sf_dir).panel).select(*FEATURE_COLS), FEATURE_ROUND)


@query("duplicate_rows", """
select symbol, dt, n_rows - 1 as n_removed from (
  select concat('S_', l_suppkey) as symbol, cast(l_shipdate as date) as dt, count(*) as n_rows
  from lineitem group by l_suppkey, cast(l_shipdate as date)) t where n_rows > 1""")
def q_duplicate_rows(spark, sf_dir):
    """Rows that the duplicate collapse takes out of a feed with several ticks a day (each lineitem one tick)."""
    return feat.duplicate_rows(fx_mod.ticks(spark, sf_dir))


def _single_window_sql(col: str) -> str:
    return O.with_ctes(BASE, f"select symbol, dt, {', '.join(f'round({col}_{k}, 6) as {col}_{k}' for k in WINDOWS)} from features")


@query("rate_of_return", _single_window_sql("ror"))
def q_rate_of_return(spark, sf_dir):
    f = Ctx(spark, sf_dir).features
    return f.select("symbol", "dt", *[F.round(f"ror_{k}", 6).alias(f"ror_{k}") for k in WINDOWS])


@query("rolling_stddev", _single_window_sql("std"))
def q_rolling_stddev(spark, sf_dir):
    f = Ctx(spark, sf_dir).features
    return f.select("symbol", "dt", *[F.round(f"std_{k}", 6).alias(f"std_{k}") for k in WINDOWS])


@query("rolling_mean", _single_window_sql("mean"))
def q_rolling_mean(spark, sf_dir):
    f = Ctx(spark, sf_dir).features
    return f.select("symbol", "dt", *[F.round(f"mean_{k}", 6).alias(f"mean_{k}") for k in WINDOWS])


FLONG_COLS = ["symbol", "dt", "win", "ror", "std", "mean", "adj_close", "currency"]
FLONG_ROUND = {"ror": R6, "std": R6, "mean": R6}


@query("features_long", O.with_ctes(BASE, sql_rounded(FLONG_COLS, FLONG_ROUND, "flong")))
def q_features_long(spark, sf_dir):
    return rounded(Ctx(spark, sf_dir).flong.select(*FLONG_COLS), FLONG_ROUND)


# ------------------------------------------------------ distinct, rank, slices

@query("distinct_symbols", O.with_ctes(BASE, "select distinct symbol from features"))
def q_distinct_symbols(spark, sf_dir):
    return slicing.distinct_symbols(Ctx(spark, sf_dir).features)


@query("distinct_dates", O.with_ctes(BASE, "select distinct dt from features"))
def q_distinct_dates(spark, sf_dir):
    return slicing.distinct_dates(Ctx(spark, sf_dir).features)


# Each scenario of the grid as it is, and broken in every way a rule knows.
VARIANTS = [("win", "win", "7"), ("n_assets", "n_assets", "3"), ("n_assets", "n_assets", "120"), ("pop_size", "pop_size", "2"),
            ("fitness_type", "fitness_type", "'sharpe'")]
_VARIANT_SQL = " union all ".join(
    ["select scenario_id * 10 as scenario_id, win, n_assets, pop_size, fitness_type from scenarios"]
    + ["select scenario_id * 10 + {} as scenario_id, {} from scenarios".format(
        i + 1, ", ".join(f"{v} as {c}" if c == col else c for c in ("win", "n_assets", "pop_size", "fitness_type")))
       for i, (_, col, v) in enumerate(VARIANTS)])


def _variants(scenarios):
    out = scenarios.withColumn("scenario_id", F.col("scenario_id") * 10)
    for i, (_, col, v) in enumerate(VARIANTS):
        broken = scenarios.withColumn("scenario_id", F.col("scenario_id") * 10 + (i + 1))
        out = out.unionByName(broken.withColumn(col, F.expr(v).cast(scenarios.schema[col].dataType)))
    return out


@query("validate_scenarios", O.with_ctes(BASE + [("v", _VARIANT_SQL)], f"""
select scenario_id,
       win in ({', '.join(str(k) for k in WINDOWS)}) and n_assets between 4 and 100 and pop_size >= 4
         and fitness_type in ('return', 'linear') as valid,
       concat_ws(';', case when win not in ({', '.join(str(k) for k in WINDOWS)}) then 'win' end,
                      case when n_assets not between 4 and 100 then 'n_assets' end,
                      case when pop_size < 4 then 'pop_size' end,
                      case when fitness_type not in ('return', 'linear') then 'fitness_type' end) as reason
from v"""))
def q_validate_scenarios(spark, sf_dir):
    """Valid scenarios and five broken variants of each, with the reasons."""
    return slicing.validate_scenarios(_variants(Ctx(spark, sf_dir).scenarios))


@query("lookback_bounds", O.with_ctes(BASE + O.lookback_ctes("bh")[:1],
                                       "select scenario_id, win, formation_date, left_date, right_date from bh_bounds"))
def q_lookback_bounds(spark, sf_dir):
    return slicing.lookback_bounds(Ctx(spark, sf_dir).scenarios)


@query("formation_slice", O.with_ctes(BASE, """
select s.scenario_id, u.symbol, round(u.mean, 6) as mean, u.adj_close, u.currency
from scenarios s join universe u on u.dt = s.formation_date and u.win = s.win"""))
def q_formation_slice(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return rounded(slicing.formation_slice(ctx.scenarios, ctx.flong), {"mean": R6})


@query("top_k", O.with_ctes(BASE, """
select dt, win, symbol, rank from (
  select dt, win, symbol, row_number() over (partition by dt, win order by mean desc, symbol) as rank from universe) t
where rank <= 10"""))
def q_top_k(spark, sf_dir):
    """The ten highest-mean symbols per formation key (a top-k report)."""
    ctx = Ctx(spark, sf_dir)
    u = slicing.universe(ctx.scenarios, ctx.flong)
    return slicing.top_k(u, ["dt", "win"], [F.col("mean").desc(), F.col("symbol")], 10) \
                  .select("dt", "win", "symbol", F.col("rank").cast("int").alias("rank"))


# ----------------------------------------------------------------- formation

@query("buy_and_hold", O.with_ctes(BASE + O.bh_ctes(), sql_rounded(PORT_COLS, PORT_ROUND, "bh")))
def q_buy_and_hold(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return rounded(form.buy_and_hold(ctx.scenarios, ctx.flong), PORT_ROUND)


WIDE = dict(windows=(5,), n_assets=150)
WIDE_BASE = [("panel", fx_mod.SQL_PARTS)] + O.features_sql("panel") + [
    ("scenarios", O.sql_scenario_grid("panel", **WIDE)),
    ("universe", "select f.dt, f.win, f.symbol, f.mean, f.adj_close, f.currency from flong f where f.mean is not null and f.win = 5")]


@query("buy_and_hold_wide", O.with_ctes(WIDE_BASE + O.bh_ctes(), sql_rounded(PORT_COLS, PORT_ROUND, "bh")))
def q_buy_and_hold_wide(spark, sf_dir):
    """150 holdings out of the monthly bars of all parts: more than the bounded draws may hold."""
    ctx = Ctx(spark, sf_dir, features=feat.asset_features(fx_mod.parts(spark, sf_dir)), **WIDE)
    return rounded(form.buy_and_hold(ctx.scenarios, ctx.flong), PORT_ROUND)


@query("normalize_weights", O.with_ctes(BASE + O.bh_ctes(), """
select scenario_id, symbol, round(mean / cast(sum(cast(mean as decimal(38,18))) over (partition by scenario_id) as double), 6) as weight
from bh"""))
def q_normalize_weights(spark, sf_dir):
    """Buy-and-hold holdings re-weighted in proportion to their mean return."""
    ctx = Ctx(spark, sf_dir)
    b = form.buy_and_hold(ctx.scenarios, ctx.flong).select("scenario_id", "symbol", F.col("mean").alias("weight"))
    return form.normalize_weights(b, ["scenario_id"]).select("scenario_id", "symbol", F.round("weight", 6).alias("weight"))


@query("weights_valid", O.with_ctes(BASE + O.bh_ctes(), """
select scenario_id, bool_and(w between 0.01 and 0.25) as valid
from (select scenario_id, mean / cast(sum(cast(mean as decimal(38,18))) over (partition by scenario_id) as double) as w from bh) t
group by scenario_id"""))
def q_weights_valid(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    b = form.buy_and_hold(ctx.scenarios, ctx.flong).select("scenario_id", "symbol", F.col("mean").alias("weight"))
    return form.weights_valid(form.normalize_weights(b, ["scenario_id"]), ["scenario_id"])


# ------------------------------------------------------------ risk measures

@query("portfolio_return", O.with_ctes(BASE + O.bh_ctes(),
                                        f"select {PK_SQL}, round(sum(mean * weight), 6) as ret from bh group by {PK_SQL}"))
def q_portfolio_return(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    r = risk.portfolio_return(form.buy_and_hold(ctx.scenarios, ctx.flong), PK)
    return rounded(r, {"ret": R6})


@query("portfolio_variance", O.with_ctes(BASE + O.bh_ctes() + O.lookback_ctes("bh") + O.variance_pairwise_ctes("bh"), f"""
select p.scenario_id, p.portfolio_id, round(v.variance, 4) as variance, coalesce(n.n_dates, 0) as n_dates
from (select distinct {PK_SQL} from bh) p left join bh_var v using ({PK_SQL})
left join (select {PK_SQL}, count(distinct dt) as n_dates from bh_complete group by {PK_SQL}) n using ({PK_SQL})"""))
def q_portfolio_variance(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    v = risk.portfolio_variance(form.buy_and_hold(ctx.scenarios, ctx.flong), ctx.scenarios, ctx.flong, PK)
    return rounded(v, {"variance": VAR})


@query("covariance_matrix", O.with_ctes(BASE + O.bh_ctes() + O.lookback_ctes("bh") + O.variance_pairwise_ctes("bh"),
                                         f"select {PK_SQL}, symbol_i, symbol_j, round(cov, 4) as cov from bh_cov"))
def q_covariance_matrix(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    c = risk.covariance_matrix(form.buy_and_hold(ctx.scenarios, ctx.flong), ctx.scenarios, ctx.flong, PK)
    return rounded(c, {"cov": VAR})


@query("correlation_matrix", O.with_ctes(BASE + O.bh_ctes() + O.lookback_ctes("bh") + O.variance_pairwise_ctes("bh"),
                                          f"select {PK_SQL}, symbol_i, symbol_j, round(case when isnan(corr) then null else corr end, 6) as corr from bh_cov"))
def q_correlation_matrix(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    c = risk.correlation_matrix(form.buy_and_hold(ctx.scenarios, ctx.flong), ctx.scenarios, ctx.flong, PK)
    return rounded(c, {"corr": R6})


@query("quadratic_form", O.with_ctes(BASE + O.bh_ctes() + O.lookback_ctes("bh") + O.variance_pairwise_ctes("bh"),
                                      f"select {PK_SQL}, round(variance, 4) as variance from bh_var"))
def q_quadratic_form(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    p = form.buy_and_hold(ctx.scenarios, ctx.flong)
    cov = risk.covariance_matrix(p, ctx.scenarios, ctx.flong, PK)
    return rounded(risk.quadratic_form(p, cov, PK), {"variance": VAR})


@query("complete_dates", O.with_ctes(BASE + O.bh_ctes() + O.lookback_ctes("bh"),
                                      f"select distinct {PK_SQL}, dt from bh_complete"))
def q_complete_dates(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return risk.complete_dates(form.buy_and_hold(ctx.scenarios, ctx.flong), ctx.scenarios, ctx.flong, PK)


@query("lookback_slice", O.with_ctes(BASE + O.bh_ctes() + O.lookback_ctes("bh"),
                                      "select scenario_id, symbol, dt, round(ror, 6) as ror from bh_rets"))
def q_lookback_slice(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    s = slicing.lookback_slice(ctx.scenarios, ctx.flong, form.buy_and_hold(ctx.scenarios, ctx.flong))
    return rounded(s, {"ror": R6})


@query("union_distinct", O.with_ctes(BASE + O.bh_ctes() + O.lookback_ctes("bh"), """
select distinct scenario_id, symbol, dt, round(ror, 6) as ror from (
  select scenario_id, symbol, dt, ror from bh_rets
  union all
  select b.scenario_id, b.symbol, s.formation_date as dt, f.ror
  from bh b join scenarios s using (scenario_id)
  join flong f on f.symbol = b.symbol and f.dt = s.formation_date and f.win = s.win) t"""))
def q_union_distinct(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    p = form.buy_and_hold(ctx.scenarios, ctx.flong)
    sl = slicing.lookback_slice(ctx.scenarios, ctx.flong, p)
    s = ctx.scenarios.select("scenario_id", F.col("formation_date").alias("dt"), "win")
    own = p.select("scenario_id", "symbol").join(s, "scenario_id").join(
        ctx.flong.select("symbol", "dt", "win", "ror"), ["symbol", "dt", "win"])
    return rounded(slicing.union_distinct(sl, own), {"ror": R6})


# ---------------------------------------------------------------- valuation

SHARES_COLS = PORT_COLS + ["shares"]


@query("allocate_shares", O.with_ctes(BASE + O.bh_ctes() + O.shares_ctes("bh"), sql_rounded(SHARES_COLS, PORT_ROUND, "bh_shares")))
def q_allocate_shares(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    sh = valuation.allocate_shares(form.buy_and_hold(ctx.scenarios, ctx.flong), ctx.scenarios)
    return rounded(sh.select(*SHARES_COLS), PORT_ROUND)


ASOF_SQL = O.with_ctes(BASE + [("req", """
select distinct symbol, end_date as req_dt from (
  select b.symbol, s.formation_date + cast(h.days as integer) as end_date
  from (select distinct scenario_id, symbol from (select s.scenario_id, r.symbol from scenarios s
        join universe r on r.dt = s.formation_date and r.win = s.win) x) b
  join scenarios s using (scenario_id), (values (7), (31), (365)) h(days)) t""")], """
select q.symbol, q.req_dt, p.dt as price_dt, p.adj_close as price
from req q asof left join prices p on q.symbol = p.symbol and q.req_dt >= p.dt""")


@query("asof_price", ASOF_SQL)
def q_asof_price(spark, sf_dir):
    """Prices of every eligible symbol 7, 31 and 365 days after each formation date."""
    ctx = Ctx(spark, sf_dir)
    sl = slicing.formation_slice(ctx.scenarios, ctx.flong).select("scenario_id", "symbol").distinct()
    s = ctx.scenarios.select("scenario_id", "formation_date")
    req = sl.join(s, "scenario_id").select(
        "symbol", F.explode(F.array(*[F.date_add("formation_date", d) for d in (7, 31, 365)])).alias("req_dt")).distinct()
    out = valuation.asof_price(ctx.prices, req)
    return out.select("symbol", "req_dt", "price_dt", "price")


@query("fx_rate", O.with_ctes(BASE + [("req", """
select distinct currency, dt + cast(d.days as integer) as rate_req_dt
from prices, (values (0), (3)) d(days)""")], """
select q.currency, q.rate_req_dt, round(case when q.currency = 'EUR' then 1.0 else f.adj_close end, 9) as rate
from req q asof left join (select * from fx where to_ccy = 'EUR') f on q.currency = f.from_ccy and q.rate_req_dt >= f.dt"""))
def q_fx_rate(spark, sf_dir):
    """Rate of each price row's currency on its date and three days later."""
    ctx = Ctx(spark, sf_dir)
    req = ctx.prices.select("currency", F.explode(F.array("dt", F.date_add("dt", 3))).alias("rate_req_dt")).distinct()
    out = valuation.fx_rate(ctx.fx, req)
    return rounded(out.select("currency", "rate_req_dt", "rate"), {"rate": 9})


@query("convert_currency", O.with_ctes(BASE + O.bh_ctes(), """
select b.scenario_id, b.symbol,
       case when b.currency = 'EUR' then b.price else b.price * f.adj_close end as price_eur
from bh b join scenarios s using (scenario_id)
asof left join (select * from fx where to_ccy = 'EUR') f on b.currency = f.from_ccy and s.formation_date >= f.dt"""))
def q_convert_currency(spark, sf_dir):
    """Formation prices of the buy-and-hold holdings in EUR."""
    ctx = Ctx(spark, sf_dir)
    b = form.buy_and_hold(ctx.scenarios, ctx.flong).join(
        ctx.scenarios.select("scenario_id", F.col("formation_date").alias("rate_req_dt")), "scenario_id")
    r = valuation.fx_rate(ctx.fx, b)
    return r.select("scenario_id", "symbol", valuation.convert_currency(
        F.col("price"), F.col("rate"), F.col("currency")).alias("price_eur"))


VALUE_ROUND = {"value": MONEY}


@query("shares_value", O.with_ctes(
    BASE + O.bh_ctes() + O.shares_ctes("bh")
    + [("vd", "select scenario_id, formation_date + 31 as val_dt from scenarios")] + O.value_ctes("bh", "vd"),
    "select scenario_id, portfolio_id, val_dt, round(value, 2) as value, n_held, n_priced from bh_value"))
def q_shares_value(spark, sf_dir):
    """Value in EUR of each buy-and-hold portfolio 31 days after formation."""
    ctx = Ctx(spark, sf_dir)
    sh = valuation.allocate_shares(form.buy_and_hold(ctx.scenarios, ctx.flong), ctx.scenarios)
    vd = ctx.scenarios.select("scenario_id", F.date_add("formation_date", 31).alias("val_dt"))
    h = sh.select(*PK, "symbol", "shares", "currency").join(vd, "scenario_id")
    return rounded(valuation.shares_value(h, ctx.prices, ctx.fx), VALUE_ROUND)


@query("portfolio_value", O.with_ctes(
    BASE + O.bh_ctes() + O.shares_ctes("bh")
    + [("vd", "select scenario_id, formation_date as val_dt from scenarios")] + O.value_ctes("bh", "vd"),
    """select v.scenario_id, v.portfolio_id, v.val_dt, round(v.value - cast(s.fee * s.n_assets as double), 2) as value
       from bh_value v join scenarios s using (scenario_id)"""))
def q_portfolio_value(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    v = valuation.portfolio_value(form.buy_and_hold(ctx.scenarios, ctx.flong), ctx.scenarios, ctx.prices, ctx.fx)
    return rounded(v, VALUE_ROUND)


ROI_COLS = ["scenario_id", "portfolio_id", "horizon", "end_date", "start_value", "end_value", "roi"]
ROI_ROUND = {"start_value": MONEY, "end_value": MONEY, "roi": R6}


@query("roi_horizons", O.with_ctes(BASE + O.bh_ctes() + O.roi_ctes("bh"), sql_rounded(ROI_COLS, ROI_ROUND, "bh_roi")))
def q_roi_horizons(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    r = valuation.roi_horizons(form.buy_and_hold(ctx.scenarios, ctx.flong), ctx.scenarios, ctx.prices, ctx.fx)
    return rounded(r, ROI_ROUND)


@query("portfolio_roi", O.with_ctes(BASE + O.bh_ctes() + O.roi_ctes("bh"),
                                     "select scenario_id, portfolio_id, end_date, round(start_value, 2) as start_value, "
                                     "round(end_value, 2) as end_value, round(roi, 6) as roi from bh_roi where horizon = '12m'"))
def q_portfolio_roi(spark, sf_dir):
    """ROI from formation to one year later."""
    ctx = Ctx(spark, sf_dir)
    ends = ctx.scenarios.select("scenario_id", F.date_add("formation_date", 365).alias("end_date"))
    r = valuation.portfolio_roi(form.buy_and_hold(ctx.scenarios, ctx.flong), ctx.scenarios, ctx.prices, ctx.fx, ends)
    return rounded(r, ROI_ROUND)


@query("portfolio_summary", O.with_ctes(
    BASE + O.bh_ctes() + O.lookback_ctes("bh") + O.variance_pairwise_ctes("bh") + O.shares_ctes("bh")
    + [("vd", "select scenario_id, formation_date as val_dt from scenarios")] + O.value_ctes("bh", "vd"), f"""
select r.scenario_id, r.portfolio_id, round(r.ret, 6) as ret, round(v.variance, 4) as variance,
       round(w.value - cast(s.fee * s.n_assets as double), 2) as value
from (select {PK_SQL}, sum(mean * weight) as ret from bh group by {PK_SQL}) r
join scenarios s using (scenario_id)
left join bh_var v using ({PK_SQL})
left join bh_value w using ({PK_SQL})"""))
def q_portfolio_summary(spark, sf_dir):
    """Return, variance and value at formation, one row per portfolio."""
    ctx = Ctx(spark, sf_dir)
    out = risk.portfolio_summary(form.buy_and_hold(ctx.scenarios, ctx.flong), ctx.scenarios, ctx.flong, ctx.prices, ctx.fx)
    return rounded(out.select(*PK, "ret", "variance", "value"), {"ret": R6, "variance": VAR, "value": MONEY})


@query("value_in_usd", O.with_ctes(
    BASE + O.bh_ctes() + O.shares_ctes("bh") + [("priced", """
select h.scenario_id, h.portfolio_id, h.formation_date, h.shares, h.currency, p.dt as price_dt, p.adj_close as price
from bh_shares h asof left join prices p on h.symbol = p.symbol and h.formation_date >= p.dt"""), ("rated", """
select q.*, case when q.currency = 'USD' then price else price * f.rate end as base_price
from priced q asof left join (select dt, 1 / adj_close as rate from fx where to_ccy = 'EUR') f on q.price_dt >= f.dt""")], """
select scenario_id, portfolio_id, formation_date as val_dt,
       round(case when count(base_price * shares) = count(*) then sum(base_price * shares) end, 2) as value
from rated group by scenario_id, portfolio_id, formation_date"""))
def q_value_in_usd(spark, sf_dir):
    """Buy-and-hold portfolios at formation in US dollars: another base currency, rates given the other way round."""
    ctx = Ctx(spark, sf_dir)
    sh = valuation.allocate_shares(form.buy_and_hold(ctx.scenarios, ctx.flong), ctx.scenarios)
    h = sh.select(*PK, "symbol", "shares", "currency", F.col("formation_date").alias("val_dt"))
    usd = ctx.fx.select("dt", F.col("to_ccy").alias("from_ccy"), F.col("from_ccy").alias("to_ccy"), (F.lit(1.0) / F.col("adj_close")).alias("adj_close"))
    return rounded(valuation.shares_value(h, ctx.prices, usd, base="USD").select(*PK, "val_dt", "value"), VALUE_ROUND)


# ------------------------------------------------------- seeded random formation

POP_COLS = ["scenario_id", "generation", "indiv_id", "symbol", "weight", "price", "currency", "mean"]
POP_ROUND = PORT_ROUND
# Bounded draws are the same operations in both engines, bit for bit; they stay unrounded, as their short decimals tie.
DRAW_ROUND = {"mean": R6}
IK_SQL = "scenario_id, indiv_id"


def _rec(ctes, final):
    return O.with_ctes(ctes, final, recursive=True)


@query("random_unconstrained", _rec(BASE + OS.unconstrained_ctes(), sql_rounded(PORT_COLS, PORT_ROUND, "unc")))
def q_random_unconstrained(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return rounded(form.random_unconstrained(ctx.scenarios, ctx.flong), PORT_ROUND)


RC_COLS = ["scenario_id", "generation", "indiv_id", "slot", "symbol", "weight", "price", "currency", "mean"]


@query("random_constrained", _rec(BASE + OS.init_ctes(), sql_rounded(RC_COLS, DRAW_ROUND, "ini_rc")))
def q_random_constrained(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    iu = slicing.indexed_universe(ctx.scenarios, ctx.flong)
    return rounded(form.random_constrained(form.individuals_of(ctx.scenarios, 0), iu, "init"), DRAW_ROUND)


def _wide_draw(n):
    base = O.base_ctes(n_assets=n)

    @query(f"random_constrained_{n}", _rec(base + OS.init_ctes(), sql_rounded(RC_COLS, DRAW_ROUND, "ini_rc")))
    def q(spark, sf_dir):
        ctx = Ctx(spark, sf_dir, n_assets=n)
        iu = slicing.indexed_universe(ctx.scenarios, ctx.flong)
        return rounded(form.random_constrained(form.individuals_of(ctx.scenarios, 0), iu, "init"), DRAW_ROUND)
    q.__doc__ = f"The bounded draw at n = {n}: the same rule as at n = 10."


for _n in (30, 50):
    _wide_draw(_n)


GBASE = O.base_ctes()


@query("init_population", _rec(GBASE + OS.init_ctes(), sql_rounded(POP_COLS, DRAW_ROUND, "pop0")))
def q_init_population(spark, sf_dir):
    ctx = _search_ctx(spark, sf_dir)
    return rounded(search.init_population(ctx.scenarios, ctx.flong), DRAW_ROUND)


# ----------------------------------------------------------- search steps

def _search_ctx(spark, sf_dir):
    return Ctx(spark, sf_dir)


GA_BASE = (GBASE + OS.init_ctes() + O.lookback_ctes("pop0", IK_SQL) + OS.variance_identity_ctes("pop0", IK_SQL) + OS.eval_ctes("pop0"))
FIT_ROUND = {"ret": R6, "variance": VAR, "fitness": VAR}


class _Gen0:
    """Generation 0 of the search over the scenario grid, shared by the step queries."""

    def __init__(self, spark, sf_dir):
        self.ctx = _search_ctx(spark, sf_dir)
        self.scen = self.ctx.scenarios
        self.iu = search._cut(slicing.indexed_universe(self.scen, self.ctx.flong))
        self.rets = search._cut(search.lookback_returns(self.scen, self.ctx.flong))
        self.pop = search._cut(search.init_population(self.scen, self.ctx.flong, self.iu))
        self._fit = None

    def fit(self):
        if self._fit is None:
            self._fit = search._cut(search.evaluate_population(self.pop, self.scen, self.rets))
        return self._fit

    def ranked(self):
        return search.rank_population(self.fit())

    def parents(self):
        return search.select_parents(self.ranked(), self.scen)

    def pairs(self):
        return search.roulette_pairs(self.parents(), self.scen, 0)

    def cuts(self):
        return search.crossover_cuts(self.pairs(), self.pop, self.scen, 0)

    def kids(self):
        return search._cut(search.crossover(self.cuts(), self.pop, self.scen, 0))


@query("fitness_return", _rec(GA_BASE, f"select {IK_SQL}, round(ret, 6) as ret from pop0_ret"))
def q_fitness_return(spark, sf_dir):
    return rounded(search.fitness_return(_Gen0(spark, sf_dir).pop), {"ret": R6})


@query("fitness_linear", _rec(GA_BASE, sql_rounded(["scenario_id", "indiv_id", "ret", "variance", "fitness"], FIT_ROUND, "pop0_fit")))
def q_fitness_linear(spark, sf_dir):
    g = _Gen0(spark, sf_dir)
    f = search.fitness_linear(g.pop, g.scen, g.ctx.flong)
    return rounded(f.select("scenario_id", "indiv_id", "ret", "variance", "fitness"), FIT_ROUND)


@query("evaluate_population", _rec(GA_BASE, sql_rounded(["scenario_id", "indiv_id", "ret", "variance", "fitness"], FIT_ROUND, "pop0_eval")))
def q_evaluate_population(spark, sf_dir):
    return rounded(_Gen0(spark, sf_dir).fit(), FIT_ROUND)


STEPS = GA_BASE + OS.step_ctes(0)


@query("rank_population", _rec(STEPS, f"select {IK_SQL}, cast(rank as integer) as rank from ranked"))
def q_rank_population(spark, sf_dir):
    return _Gen0(spark, sf_dir).ranked().select("scenario_id", "indiv_id", F.col("rank").cast("int").alias("rank"))


@query("select_parents", _rec(STEPS, f"select {IK_SQL}, cast(rank as integer) as rank from parents"))
def q_select_parents(spark, sf_dir):
    return _Gen0(spark, sf_dir).parents().select("scenario_id", "indiv_id", F.col("rank").cast("int").alias("rank"))


@query("elite", _rec(STEPS, f"select {IK_SQL}, round(fitness, 4) as fitness from ranked where rank = 1"))
def q_elite(spark, sf_dir):
    e = search.elite(_Gen0(spark, sf_dir).ranked())
    return e.select("scenario_id", "indiv_id", F.round("fitness", 4).alias("fitness"))


@query("roulette_pairs", _rec(STEPS, "select scenario_id, pair, indiv_a, indiv_b from pairs"))
def q_roulette_pairs(spark, sf_dir):
    return _Gen0(spark, sf_dir).pairs()


@query("crossover_cuts", _rec(STEPS, "select scenario_id, pair, indiv_a, indiv_b, cut from cuts"))
def q_crossover_cuts(spark, sf_dir):
    return _Gen0(spark, sf_dir).cuts()


@query("crossover", _rec(STEPS, sql_rounded(POP_COLS, POP_ROUND, "kids")))
def q_crossover(spark, sf_dir):
    return rounded(_Gen0(spark, sf_dir).kids(), POP_ROUND)


@query("mutate", _rec(STEPS, sql_rounded(POP_COLS, POP_ROUND, "mutated")))
def q_mutate(spark, sf_dir):
    g = _Gen0(spark, sf_dir)
    return rounded(search.mutate(g.kids(), g.scen, g.iu, 0), POP_ROUND)


@query("immigrants", _rec(STEPS, sql_rounded(POP_COLS, DRAW_ROUND, "imm_rc")))
def q_immigrants(spark, sf_dir):
    g = _Gen0(spark, sf_dir)
    return rounded(search.immigrants(g.scen, g.iu, 0), DRAW_ROUND)


@query("next_generation", _rec(STEPS, sql_rounded(POP_COLS, POP_ROUND, "nextgen")))
def q_next_generation(spark, sf_dir):
    g = _Gen0(spark, sf_dir)
    return rounded(search.generation_step(g.pop, g.fit(), g.scen, g.iu, 0), POP_ROUND)


# ---------------------------------------------------------- sources and sinks

RAW_SQL = ("select dt, adj_close as open, high, low, adj_close as close, adj_close, volume, symbol, index_name, currency "
           "from panel_raw")


@query("read_asset_csv", O.with_ctes([("panel_raw", SQL_PANEL_RAW)], RAW_SQL))
def q_read_asset_csv(spark, sf_dir):
    """Asset rows written as ';' CSV and read back with the declared schema."""
    path = scratch_path(spark, "assets-csv")
    csvsrc.write_asset_csv(fx_mod.panel_raw(spark, sf_dir), path)
    return csvsrc.read_asset_csv(spark, path)


@query("read_fx_csv", """
select cast(date_trunc('week', o_orderdate) as date) as dt,
       cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / cast(count(*) as double) / cast(25000000 as double) as open,
       cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / cast(count(*) as double) / cast(25000000 as double) as high,
       cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / cast(count(*) as double) / cast(25000000 as double) as low,
       cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / cast(count(*) as double) / cast(25000000 as double) as close,
       cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / cast(count(*) as double) / cast(25000000 as double) as adj_close,
       cast(count(*) as bigint) as volume, 'USD' as from_ccy, 'EUR' as to_ccy
from orders group by date_trunc('week', o_orderdate)""")
def q_read_fx_csv(spark, sf_dir):
    path = scratch_path(spark, "fx-csv")
    csvsrc.write_fx_csv(fx_mod.fx_raw(spark, sf_dir), path)
    return csvsrc.read_fx_csv(spark, path)


@query("rejected_rows", O.with_ctes([("panel_raw", SQL_PANEL_RAW)],
                                     "select symbol, count(*) as n_rejected from panel_raw where index_name <> 'EUROPE' group by symbol"))
def q_rejected_rows(spark, sf_dir):
    """Vendor files that write volume as a decimal ("1234.0") fail the 64-bit
    volume column: here every non-European row.  Rejects counted per symbol."""
    raw = fx_mod.panel_raw(spark, sf_dir)
    path = scratch_path(spark, "mixed-csv")
    vendor = raw.withColumn("volume", F.when(F.col("index_name") == "EUROPE", F.col("volume").cast("string"))
                            .otherwise(F.format_string("%d.0", F.col("volume"))))
    csvsrc.write_asset_csv(vendor, path)
    rej = csvsrc.rejected_rows(spark, path, ASSET_CSV)
    return rej.groupBy(F.split("line", ";").getItem(7).alias("symbol")).agg(F.count(F.lit(1)).alias("n_rejected"))


LISTED = "index_name <> 'AFRICA'"


def _downloaded(spark, sf_dir):
    """Downloader files (8 columns) of every symbol, and a listing that lacks the African ones."""
    raw = fx_mod.panel_raw(spark, sf_dir)
    path = scratch_path(spark, "downloader-csv")
    csvsrc.write_downloader_csv(raw, path)
    return path, raw.filter(LISTED).select("symbol", "index_name", "currency").distinct()


@query("read_downloader_csv", O.with_ctes([("panel_raw", SQL_PANEL_RAW)], RAW_SQL + f" where {LISTED}"))
def q_read_downloader_csv(spark, sf_dir):
    """The 8-column layout, index and currency joined from the listing."""
    path, listing = _downloaded(spark, sf_dir)
    return csvsrc.read_downloader_csv(spark, path, listing)


@query("unlisted_rows", O.with_ctes([("panel_raw", SQL_PANEL_RAW)],
                                     f"select symbol, count(*) as n_rejected from panel_raw where not {LISTED} group by symbol"))
def q_unlisted_rows(spark, sf_dir):
    """Downloader rows whose symbol the listing lacks, counted per symbol."""
    path, listing = _downloaded(spark, sf_dir)
    rej = csvsrc.downloader_rejects(spark, path, listing)
    return rej.groupBy(F.split("line", ";").getItem(7).alias("symbol")).agg(F.count(F.lit(1)).alias("n_rejected"))


@query("read_panel_parquet", O.with_ctes([("panel_raw", SQL_PANEL_RAW)],
                                          "select symbol, dt, adj_close, volume, index_name, currency from panel_raw"))
def q_read_panel_parquet(spark, sf_dir):
    path = scratch_path(spark, "panel")
    pq.write_panel_parquet(fx_mod.panel(spark, sf_dir), path)
    return pq.read_panel_parquet(spark, path).select("symbol", "dt", "adj_close", "volume", "index_name", "currency")


@query("write_panel_parquet", O.with_ctes(BASE, "select year, count(*) as n_rows from features group by year"))
def q_write_panel_parquet(spark, sf_dir):
    """Feature panel written partitioned by year; rows per year partition read back."""
    path = scratch_path(spark, "features")
    pq.write_panel_parquet(Ctx(spark, sf_dir).features, path)
    return pq.read_panel_parquet(spark, path).groupBy("year").agg(F.count(F.lit(1)).alias("n_rows"))


@query("panel_or_build", O.with_ctes(BASE, sql_rounded(FEATURE_COLS, FEATURE_ROUND, "features")))
def q_panel_or_build(spark, sf_dir):
    """First call builds the panel from CSV and stores it; the second reads it."""
    csv_path = scratch_path(spark, "assets-csv")
    csvsrc.write_asset_csv(fx_mod.panel_raw(spark, sf_dir), csv_path)
    store = scratch_path(spark, "panel-store")
    pq.panel_or_build(spark, store, csv_path)
    again = pq.panel_or_build(spark, store, csv_path)
    return rounded(again.select(*FEATURE_COLS), FEATURE_ROUND)


@query("write_portfolios", O.with_ctes(BASE + O.bh_ctes(), "select scenario_id, count(*) as n_rows from bh group by scenario_id"))
def q_write_portfolios(spark, sf_dir):
    """Buy-and-hold portfolios of all scenarios written in one CSV write, read back."""
    ctx = Ctx(spark, sf_dir)
    path = scratch_path(spark, "portfolios")
    sinks.write_portfolios(form.buy_and_hold(ctx.scenarios, ctx.flong), path, "bh")
    back = sinks.read_run(spark, path, "bh",
                          "scenario_id bigint, portfolio_id bigint, symbol string, weight double, price double, currency string, mean double")
    return back.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n_rows"))


# ------------------------------------------------------------ ranking, sampling

@query("sample_rows", O.with_ctes(BASE, f"""
select dt, win, symbol, rk from (
  select dt, win, symbol, row_number() over (partition by dt, win order by {O.sql_draw('42', 'sample:order', 'dt', 'win', 'symbol')}, symbol) as rk
  from universe where cast({O.sql_draw('42', 'sample:keep', 'dt', 'win', 'symbol')} as double) / {float(16 ** 15)!r} < 0.25) t
where rk <= 10"""))
def q_sample_rows(spark, sf_dir):
    """A seeded 25 % Bernoulli sample of each formation universe, first ten in seeded order."""
    from basketry.functions.rng import draw, unit
    ctx = Ctx(spark, sf_dir)
    u = slicing.universe(ctx.scenarios, ctx.flong)
    keys = (F.col("dt"), F.col("win"), F.col("symbol"))
    kept = u.filter(unit(F.lit(42), "sample:keep", *keys) < 0.25)
    ranked = slicing.top_k(kept, ["dt", "win"], [draw(F.lit(42), "sample:order", *keys), F.col("symbol")], 10, "rk")
    return ranked.select("dt", "win", "symbol", F.col("rk").cast("bigint").alias("rk"))


_PIVOT_SQL = O.with_ctes(BASE, "select dt, " + ", ".join(
    f"round(max(case when symbol = 'N_{k}' then ror_60 end), 6) as N_{k}" for k in range(25)) + " from features group by dt")


@query("pivot_returns", _PIVOT_SQL)
def q_pivot_returns(spark, sf_dir):
    """dt x symbol matrix of ror_60: a column for every row of nation, which names the symbols."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").distinct().sort("n_nationkey")
    symbols = [f"N_{r[0]}" for r in nations.collect()]
    f = Ctx(spark, sf_dir).features.select("symbol", "dt", F.col("ror_60").alias("ror"))
    p = slicing.pivot_returns(f, symbols)
    return p.select("dt", *[F.round(c, 6).alias(c) for c in symbols])


@query("sorted_panel", O.with_ctes(BASE, "select symbol, dt, adj_close from prices"))
def q_sorted_panel(spark, sf_dir):
    """Prices clustered by symbol and sorted by date within partitions (no global sort)."""
    return Ctx(spark, sf_dir).prices.repartition("symbol").sortWithinPartitions("symbol", "dt").select("symbol", "dt", "adj_close")


# ----------------------------------------------------------- backtests, search loop

GENERATIONS = DEFAULTS["generations"]
# Named market regimes, as the reference's live run has three of them: a report table.
REGIMES = [("early", "1996-01-02", "1996-12-31"), ("middle", "1998-01-02", "1998-06-30"), ("late", "2000-01-02", "2000-12-31")]


def _scenarios_as(base, name, sql):
    """``base`` with its scenario grid renamed and ``scenarios`` defined from it."""
    out = []
    for n, q in base:
        out += [(name, q), ("scenarios", sql)] if n == "scenarios" else [(n, q)]
    return out


_REGIME_BASE = _scenarios_as(GBASE, "grid", f"""
select g.*, r.regime, r.end_date
from grid g, (values {', '.join(f"('{n}', date '{a}', date '{b}')" for n, a, b in REGIMES)}) r(regime, start_date, end_date)
where g.formation_date = (select min(x.formation_date) from grid x where x.formation_date between r.start_date and r.end_date)""")


@query("regime_backtest", O.with_ctes(
    _REGIME_BASE + O.bh_ctes() + OS.evolve_ctes(GENERATIONS) + OS.unconstrained_ctes()[2:] + [
        ("allp", "select * from bh union all select * from unc union all select * from best"),
        ("ends", f"""
select distinct scenario_id, formation_date + cast(d.days as integer) as end_date
from scenarios s, (values {', '.join(f'({d})' for d in backtest.REGIME_STEPS)}) d(days) where formation_date + cast(d.days as integer) <= s.end_date
union select scenario_id, end_date from scenarios""")] + O.shares_ctes("allp") + [("vdates", """
select scenario_id, end_date as val_dt from ends union select scenario_id, formation_date from scenarios""")] + O.value_ctes("allp", "vdates"), """
select s.regime, st.portfolio_id, s.scenario_id, e.end_date, round(st.value - cast(s.fee * s.n_assets as double), 2) as start_value,
       round(en.value, 2) as end_value,
       round((en.value - (st.value - cast(s.fee * s.n_assets as double))) / nullif(st.value - cast(s.fee * s.n_assets as double), 0), 6) as roi
from ends e join scenarios s using (scenario_id)
join allp_value st on st.scenario_id = e.scenario_id and st.val_dt = s.formation_date
join allp_value en on en.scenario_id = e.scenario_id and en.portfolio_id = st.portfolio_id and en.val_dt = e.end_date""",
    recursive=True, materialized=True))
def q_regime_backtest(spark, sf_dir):
    """Buy-and-hold, random and optimised portfolios formed at the start of each regime, valued at fixed dates within it."""
    ctx = _search_ctx(spark, sf_dir)
    regimes = spark.createDataFrame(REGIMES, "regime string, start_date string, end_date string").select(
        "regime", F.to_date("start_date").alias("start_date"), F.to_date("end_date").alias("end_date"))
    s = stage_scratch(backtest.regime_scenarios(ctx.scenarios, regimes), "regime-scenarios")
    r = backtest.regime_backtest(backtest.strategies(s, ctx.flong), s, ctx.prices, ctx.fx)
    return rounded(r, ROI_ROUND)


_RUNS = StoredTables()


def _evolved(spark, sf_dir):
    """One search over the grid a session and state of the data folder; its three results are different queries."""
    def build(path):
        ctx = _search_ctx(spark, sf_dir)
        best, pop, hist = search.evolve(ctx.scenarios, ctx.flong)
        return stage(best, f"{path}/best"), stage(pop, f"{path}/population"), stage(hist, f"{path}/history")
    return _RUNS.get(spark, sf_dir, "evolved", build)


def _evolve_sql(final, base=None):
    return O.with_ctes((base or GBASE) + OS.evolve_ctes(GENERATIONS), final, recursive=True, materialized=True)


@query("evolve", _evolve_sql(sql_rounded(POP_COLS, POP_ROUND, f"pop_g{GENERATIONS}")))
def q_evolve(spark, sf_dir):
    """The last generation of the search for every scenario."""
    return rounded(_evolved(spark, sf_dir)[1].select(*POP_COLS), POP_ROUND)


@query("optimized", _evolve_sql(sql_rounded(PORT_COLS, PORT_ROUND, "best")))
def q_optimized(spark, sf_dir):
    """The optimised portfolio of every scenario (portfolio_id 2)."""
    return rounded(_evolved(spark, sf_dir)[0], PORT_ROUND)


HISTORY_SQL = "select scenario_id, generation, round(best_fitness, 4) as best_fitness from history"


@query("fitness_history", _evolve_sql(HISTORY_SQL))
def q_fitness_history(spark, sf_dir):
    """Best fitness per generation for every scenario (the seconds beside it differ from run to run)."""
    return rounded(_evolved(spark, sf_dir)[2].drop("runtime_s"), {"best_fitness": VAR})


@query("write_run_stats", _evolve_sql("select *, true as timed from (" + HISTORY_SQL + ") t"))
def q_write_run_stats(spark, sf_dir):
    """The search statistics written in one CSV write and read back; of the clock columns, whether they are there."""
    import time as _t
    t0 = _t.perf_counter()
    ctx = _search_ctx(spark, sf_dir)
    _, _, hist = search.evolve(ctx.scenarios, ctx.flong)
    path = scratch_path(spark, "stats")
    sinks.write_run_stats(hist, path, "r0", _t.perf_counter() - t0)
    back = sinks.read_run(spark, path, "r0", "scenario_id bigint, generation int, best_fitness double, runtime_s double, total_s double")
    back = back.withColumn("timed", (F.col("runtime_s") > 0) & (F.col("total_s") > 0)).drop("runtime_s", "total_s")
    return rounded(back, {"best_fitness": VAR})


RUNS = 2
_RUN_COLS = "formation_date, win, n_assets, fitness_type, generations, pop_size, mutation_rate, budget, fee"


@query("repeat_runs", _evolve_sql("""
select s.base_id, count(*) as runs, round(avg(r.ret), 6) as avg_ret, round(min(r.ret), 6) as min_ret, round(max(r.ret), 6) as max_ret,
       round(stddev_samp(r.ret), 6) as std_ret
from (select scenario_id, sum(mean * weight) as ret from best group by scenario_id) r join scenarios s using (scenario_id) group by s.base_id""",
    _scenarios_as(GBASE, "grid", f"select scenario_id * {RUNS} + run as scenario_id, {_RUN_COLS}, seed * {RUNS} + run as seed, scenario_id as base_id "
                                 f"from grid, (select range as run from range({RUNS})) r")))
def q_repeat_runs(spark, sf_dir):
    """The search repeated per scenario (own ids and seeds), summarised per scenario."""
    ctx = _search_ctx(spark, sf_dir)
    rep = stage_scratch(backtest.repeat_scenarios(ctx.scenarios, RUNS), "repeats")
    best, _, _ = search.evolve(rep, ctx.flong)
    out = backtest.repeat_summary(best, rep)
    return rounded(out, {c: R6 for c in ("avg_ret", "min_ret", "max_ret", "std_ret")})
