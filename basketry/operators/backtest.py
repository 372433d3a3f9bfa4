"""Strategy comparison over market regimes and repeated searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators import formation, search
from basketry.operators.valuation import portfolio_roi
from basketry.session import stage_scratch
from basketry.sources.schemas import BASE_CURRENCY

# Days after formation at which a regime's portfolios are valued, beside its end.
REGIME_STEPS = (7, 14, 31, 92, 183, 274)


def regime_scenarios(scenarios: DataFrame, regimes: DataFrame) -> DataFrame:
    """The scenarios formed on a regime's first trading day: its first formation
    date on or after ``start`` (``regimes``: regime, start_date, end_date; a small report table).
    Adds regime and its end_date.  One row a regime and scenario: a scenario
    that opens several regimes stands there once for each."""
    s = scenarios.join(F.broadcast(regimes), F.col("formation_date").between(F.col("start_date"), F.col("end_date")))
    first = s.groupBy("regime").agg(F.min("formation_date").alias("formation_date"))
    return s.join(first, ["regime", "formation_date"]).drop("start_date")


def _once(scenarios: DataFrame) -> DataFrame:
    """The scenarios without their regimes, each once."""
    return scenarios.drop("regime", "end_date").dropDuplicates(["scenario_id"])


def regime_dates(scenarios: DataFrame, steps=REGIME_STEPS) -> DataFrame:
    """scenario_id, regime, end_date: fixed days after formation that lie within the regime, and its end."""
    days = F.array(*[F.date_add("formation_date", int(d)) for d in steps], F.col("end_date"))
    return (scenarios.select("scenario_id", "regime", F.col("end_date").alias("_last"), F.explode(days).alias("end_date"))
            .filter(F.col("end_date") <= F.col("_last")).drop("_last").distinct())


def strategies(scenarios: DataFrame, flong: DataFrame) -> DataFrame:
    """Buy-and-hold (0), unconstrained random (1) and optimised (2) portfolios of the same scenarios, staged once.
    A scenario that opens several regimes is formed once."""
    scenarios = stage_scratch(_once(scenarios), "strategy-scenarios")
    fixed = formation.buy_and_hold(scenarios, flong).unionByName(formation.random_unconstrained(scenarios, flong))
    best, _, _ = search.evolve(scenarios, flong)
    return stage_scratch(fixed.unionByName(best), "strategies")


def regime_backtest(portfolios: DataFrame, scenarios: DataFrame, prices: DataFrame, fx: DataFrame,
                    base: str = BASE_CURRENCY) -> DataFrame:
    """regime, portfolio_id (strategy), scenario_id, end_date, start_value, end_value, roi.

    ``scenarios`` as :func:`regime_scenarios` gives them; every strategy's
    portfolio is valued at every end date of its regimes in one job."""
    dates = regime_dates(scenarios)
    r = portfolio_roi(portfolios, _once(scenarios), prices, fx, dates.select("scenario_id", "end_date").distinct(), base)
    return r.join(dates, ["scenario_id", "end_date"]).select(
        "regime", "portfolio_id", "scenario_id", "end_date", "start_value", "end_value", "roi")


def repeat_scenarios(scenarios: DataFrame, runs: int) -> DataFrame:
    """Each scenario repeated ``runs`` times with its own id and seed; base_id keeps the origin."""
    r = scenarios.select("*", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    return (r.withColumn("base_id", F.col("scenario_id"))
             .withColumn("scenario_id", F.col("scenario_id") * runs + F.col("run"))
             .withColumn("seed", F.col("seed") * runs + F.col("run")))


def repeat_summary(best: DataFrame, rep_scenarios: DataFrame) -> DataFrame:
    """base_id: runs, avg/min/max/stddev of the final portfolios' return."""
    ret = best.groupBy("scenario_id").agg(F.sum(F.col("mean") * F.col("weight")).alias("ret"))
    j = ret.join(rep_scenarios.select("scenario_id", "base_id"), "scenario_id")
    return j.groupBy("base_id").agg(F.count(F.lit(1)).alias("runs"), F.avg("ret").alias("avg_ret"),
                                    F.min("ret").alias("min_ret"), F.max("ret").alias("max_ret"),
                                    F.stddev_samp("ret").alias("std_ret"))
