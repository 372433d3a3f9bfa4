"""Scenario tables derived from the data: every formation date of the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Defaults of the reference's live run, except those FIXTURES.md sets for tests
# (budget 10,000,000 so that prices up to 100,000 still buy shares;
# generations 3, pop_size 8).
DEFAULTS = dict(n_assets=10, fitness_type=None, generations=3, pop_size=8,
                mutation_rate=0.03, budget=10_000_000, fee=8, seed=42)
GRID_WINDOWS = (5, 10, 20, 60, 120, 252)
# Short windows use "return" fitness (their lookback holds too few bars for a variance).
RETURN_WINDOWS = (5, 10, 20)


def scenario_grid(prices: DataFrame, windows=GRID_WINDOWS, **overrides) -> DataFrame:
    """One scenario per (distinct price date, window); scenario_id = yyyymmdd * 1000 + window."""
    p = dict(DEFAULTS, **overrides)
    d = prices.select(F.col("dt").alias("formation_date")).distinct()
    s = d.select("formation_date", F.explode(F.array(*[F.lit(int(w)) for w in windows])).alias("win"))
    sid = F.date_format("formation_date", "yyyyMMdd").cast("bigint") * 1000 + F.col("win")
    return s.select(
        sid.alias("scenario_id"), "formation_date", F.col("win").cast("int").alias("win"),
        F.lit(int(p["n_assets"])).alias("n_assets"), (F.lit(p["fitness_type"]) if p["fitness_type"] else F.when(F.col("win").isin(*RETURN_WINDOWS), "return")
                                                .otherwise("linear")).alias("fitness_type"),
        F.lit(int(p["generations"])).alias("generations"), F.lit(int(p["pop_size"])).alias("pop_size"),
        F.lit(float(p["mutation_rate"])).alias("mutation_rate"), F.lit(int(p["budget"])).cast("bigint").alias("budget"),
        F.lit(int(p["fee"])).cast("bigint").alias("fee"), F.lit(int(p["seed"])).cast("bigint").alias("seed"))


def sql_scenario_grid(prices_view: str = "panel", windows=GRID_WINDOWS, **overrides) -> str:
    p = dict(DEFAULTS, **overrides)
    vals = ", ".join(f"({int(w)})" for w in windows)
    short = ", ".join(map(str, RETURN_WINDOWS))
    fit = f"'{p['fitness_type']}'" if p["fitness_type"] else f"case when w.win in ({short}) then 'return' else 'linear' end"
    return f"""
select cast(strftime(d.formation_date, '%Y%m%d') as bigint) * 1000 + w.win as scenario_id,
       d.formation_date, cast(w.win as integer) as win,
       cast({int(p['n_assets'])} as integer) as n_assets, {fit} as fitness_type,
       cast({int(p['generations'])} as integer) as generations, cast({int(p['pop_size'])} as integer) as pop_size,
       cast({float(p['mutation_rate'])} as double) as mutation_rate, cast({int(p['budget'])} as bigint) as budget,
       cast({int(p['fee'])} as bigint) as fee, cast({int(p['seed'])} as bigint) as seed
from (select distinct dt as formation_date from {prices_view}) d, (values {vals}) w(win)
"""
