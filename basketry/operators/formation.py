"""Portfolio formation for many scenarios at once.

Output rows follow the ``portfolios`` contract:
(scenario_id, portfolio_id, symbol, weight, price, currency, mean).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.columns import exact_sum, let, ratio
from basketry.functions.rng import draw_mod, unit
from basketry.operators.slicing import accepted, indexed_universe, ranked_universe
from basketry.session import stage_scratch
from basketry.sources.schemas import WEIGHT_CEILING, WEIGHT_FLOOR

BUY_AND_HOLD, RANDOM_UNCONSTRAINED, OPTIMIZED = 0, 1, 2
PORTFOLIO_COLS = ["scenario_id", "portfolio_id", "symbol", "weight", "price", "currency", "mean"]

def normalize_weights(df: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """weight / sum(weight) within each portfolio (no driver round trip); NULL where the sum is 0."""
    total = exact_sum(weight).over(Window.partitionBy(*keys)).cast("double")
    return df.withColumn(weight, ratio(F.col(weight), total))


def weights_valid(df: DataFrame, keys: list[str], lo: float = WEIGHT_FLOOR, hi: float = WEIGHT_CEILING) -> DataFrame:
    """keys, valid: every weight within [lo, hi] (inclusive)."""
    return df.groupBy(*keys).agg(F.bool_and(F.col("weight").between(lo, hi)).alias("valid"))


def buy_and_hold(scenarios: DataFrame, flong: DataFrame) -> DataFrame:
    """The n_assets symbols with the highest mean at the formation date, weight 1/n.

    Any n_assets >= 1; scenarios with an unknown window or no assets are left
    out (``validate_scenarios(..., bounded=False, search=False)`` names them).
    Ranks once per (date, window), not once per scenario; scenarios pick
    their first n_assets ranks by an equi-join."""
    scenarios = accepted(scenarios, bounded=False, search=False)
    ru = ranked_universe(scenarios, flong)
    s = scenarios.select("scenario_id", F.col("formation_date").alias("dt"), "win", "n_assets")
    j = s.join(ru, ["dt", "win"]).filter(F.col("rank") <= F.col("n_assets"))
    return j.select("scenario_id", F.lit(BUY_AND_HOLD).cast("bigint").alias("portfolio_id"), "symbol",
                    (F.lit(1.0) / F.col("n_assets").cast("double")).alias("weight"),
                    F.col("adj_close").alias("price"), "currency", "mean")


# ------------------------------------------------------------ seeded sampling

def floyd_positions(n: Column, m: Column, seed: Column, purpose: str, *keys: Column) -> Column:
    """min(n, m) distinct positions in [0, m), uniformly at random (Floyd's method).

    Runs inside the row: n steps of an array fold, no rows per universe member."""
    k = F.least(n, m).cast("bigint")
    m = m.cast("bigint")
    steps = F.when(k > 0, F.sequence(m - k, m - 1)).otherwise(F.array().cast("array<bigint>"))

    def step(acc, j):
        t = draw_mod(seed, purpose, j + 1, *keys, j)
        return F.when(F.array_contains(acc, t), F.concat(acc, F.array(j))).otherwise(F.concat(acc, F.array(t)))

    return F.aggregate(steps, F.array().cast("array<bigint>"), step)


def _bounded_weights(g: Column, n: Column, lo: float, hi: float) -> Column:
    """Weights in [lo, hi] that sum to 1, from integer genes: lo plus a share of
    the rest by (g + 1), capped at hi, the excess spread over the others in
    proportion to their headroom.  One pass suffices whenever n*lo <= 1 <= n*hi."""
    nd = n.cast("double")

    def added(xs, term):
        return F.aggregate(xs, F.lit(0.0), lambda a, x: a + term(x))

    def shared(genes):
        total = F.aggregate(genes, F.lit(0).cast("bigint"), lambda a, x: a + x + 1).cast("double")
        return let(total, lambda t: F.transform(genes, lambda x: F.lit(lo) + (F.lit(1.0) - nd * lo) * (x + 1).cast("double") / t))

    def spread(w0):
        parts = F.struct(added(w0, lambda x: F.greatest(x - hi, F.lit(0.0))).alias("excess"),
                         added(w0, lambda x: F.lit(hi) - F.least(x, F.lit(hi))).alias("room"))
        return let(parts, lambda p: F.transform(w0, lambda x: F.least(x, F.lit(hi)) + F.when(
            p["room"] > 0, p["excess"] * (F.lit(hi) - F.least(x, F.lit(hi))) / p["room"]).otherwise(0.0)))

    return let(g, lambda genes: let(shared(genes), spread))


def random_constrained(individuals: DataFrame, iu: DataFrame, purpose: str = "init",
                       lo: float = WEIGHT_FLOOR, hi: float = WEIGHT_CEILING) -> DataFrame:
    """Random portfolios under weight bounds, one per individual.

    ``individuals``: scenario_id, generation, indiv_id, dt, win, n_assets, seed.
    ``iu``: :func:`indexed_universe`.  Returns scenario_id, generation, indiv_id,
    slot, symbol, weight, price, currency, mean.  One rule for every row and
    every n with n*lo <= 1 <= n*hi: n integer genes 0..999, mapped into the
    bounds in closed form (no attempts, so the distribution does not change
    with n).  Individuals outside that range are left out.
    Symbols: min(n, M) distinct positions of the universe by Floyd's method.
    With fewer than n_assets eligible symbols only the first M weights are used
    (they then sum below 1), as in the reference."""
    sizes = iu.select("dt", "win", "m").distinct()
    feasible = F.col("n_assets").between(round(1 / hi), round(1 / lo))
    ind = individuals.filter(feasible).join(sizes, ["dt", "win"])
    keys = (F.col("scenario_id"), F.col("generation"), F.col("indiv_id"))
    n, seed = F.col("n_assets"), F.col("seed")
    genes = F.transform(F.sequence(F.lit(0), n - 1), lambda k: draw_mod(seed, purpose + ":gene", 1000, *keys, k))
    # Each stage reads the previous stage's columns more than once, so the
    # optimizer keeps them computed once instead of inlining the draws.
    s1 = ind.select("scenario_id", "generation", "indiv_id", "dt", "win", "n_assets", genes.alias("g"),
                    floyd_positions(n, F.col("m"), seed, purpose + ":pos", *keys).alias("positions"))
    s2 = s1.select("scenario_id", "generation", "indiv_id", "dt", "win", "positions",
                   _bounded_weights(F.col("g"), n, lo, hi).alias("weights"))
    ex = s2.select("scenario_id", "generation", "indiv_id", "dt", "win", "weights", F.posexplode("positions").alias("slot", "pos"))
    ex = ex.withColumn("weight", F.element_at("weights", F.col("slot") + 1)).drop("weights")
    j = ex.join(iu.select("dt", "win", "pos", "symbol", "mean", "adj_close", "currency"), ["dt", "win", "pos"])
    return j.select("scenario_id", "generation", "indiv_id", F.col("slot").cast("int").alias("slot"),
                    "symbol", "weight", F.col("adj_close").alias("price"), "currency", "mean")


def individuals_of(scenarios: DataFrame, generation: int = 0) -> DataFrame:
    """One row per (valid scenario, indiv_id in 0..pop_size-1)."""
    return accepted(scenarios).select(
        "scenario_id", F.lit(generation).alias("generation"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("pop_size") - 1).cast("bigint"))).alias("indiv_id"),
        F.col("formation_date").alias("dt"), "win", "n_assets", "seed")


def random_unconstrained(scenarios: DataFrame, flong: DataFrame) -> DataFrame:
    """Random order of the eligible universe, 25 % Bernoulli thinning, first n
    rows, uniform random weights, normalised.

    The kept set is a uniform random subset of size min(n, K) with
    K ~ Binomial(M, 1/4); K is drawn by the inverse CDF (only its part
    below n matters), the subset by Floyd's method, so no scenario is
    paired with the whole universe.  Any n_assets >= 1."""
    scenarios = accepted(scenarios, bounded=False, search=False)
    iu = stage_scratch(indexed_universe(scenarios, flong), "universe")  # read twice: sizes and symbols
    sizes = iu.select("dt", "win", "m").distinct()
    s = scenarios.select("scenario_id", F.col("formation_date").alias("dt"), "win", "n_assets", "seed") \
                 .join(sizes, ["dt", "win"])
    key = F.col("scenario_id")
    p = 0.25
    m = F.col("m").cast("double")
    u = unit(F.col("seed"), "unc:thin", key)
    # pmf(0) = (1-p)^M, pmf(k+1) = pmf(k) * (M-k)/(k+1) * p/(1-p); K = first k with cdf(k) > u, capped at n.
    acc0 = F.struct(F.pow(F.lit(1 - p), m).alias("pmf"), F.pow(F.lit(1 - p), m).alias("cdf"),
                    F.lit(None).cast("int").alias("k"))

    def step(acc, k):
        hit = F.when(acc["k"].isNull() & (acc["cdf"] > u), k).otherwise(acc["k"])
        pmf = acc["pmf"] * (m - k) / (k + 1) * F.lit(p / (1 - p))
        return F.struct(pmf.alias("pmf"), (acc["cdf"] + pmf).alias("cdf"), hit.alias("k"))

    kept = F.aggregate(F.sequence(F.lit(0), F.col("n_assets") - 1), acc0, step)
    size = F.least(F.coalesce(kept["k"], F.col("n_assets")), F.col("m"))
    drawn = s.select("scenario_id", "dt", "win", "seed",
                     F.posexplode(floyd_positions(size, F.col("m"), F.col("seed"), "unc:pos", key)).alias("slot", "pos"))
    drawn = drawn.withColumn("raw_w", unit(F.col("seed"), "unc:weight", key, F.col("slot")))
    j = drawn.join(iu.select("dt", "win", "pos", "symbol", "mean", "adj_close", "currency"), ["dt", "win", "pos"])
    j = normalize_weights(j, ["scenario_id"], "raw_w")
    return j.select("scenario_id", F.lit(RANDOM_UNCONSTRAINED).cast("bigint").alias("portfolio_id"), "symbol",
                    F.col("raw_w").alias("weight"), F.col("adj_close").alias("price"), "currency", "mean")
