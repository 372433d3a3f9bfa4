"""Scenario-driven slices of the feature panel, ranking and set operators.

Scenario tables are small relative to the panel, but their size is not
assumed: joins against them are plain equi-joins that AQE turns into
broadcast joins only after measuring the scenario side at run time.  The
constant lookup tables built here (windows, horizons) have a fixed row
count and are broadcast outright.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.functions.rng import draw_mod
from basketry.sources.schemas import LOOKBACK_DAYS, RIGHT_PAD_DAYS, WINDOWS

# Random draws under weight bounds need n·floor <= 1 <= n·ceiling, i.e. 4 <= n <= 100.
BOUNDED_ASSETS = (4, 100)
MIN_POPULATION = 4
FITNESS_TYPES = ("return", "linear")
# A universe is numbered in this many parts per formation key.
UNIVERSE_BUCKETS = 64


def windows_table(spark: SparkSession) -> DataFrame:
    """(window, lookback_days): six rows, broadcast by construction."""
    rows = ", ".join(f"({int(k)}, {int(LOOKBACK_DAYS[k])})" for k in WINDOWS)
    return F.broadcast(spark.sql(f"select * from values {rows} as t(win, lookback_days)"))  # rows of the plan itself, no job


def scenario_rules(bounded: bool = True, search: bool = True) -> dict[str, Column]:
    """reason -> condition that a valid scenario meets.  ``bounded``: weights are
    drawn under bounds; ``search``: the scenario runs the evolutionary search."""
    rules = {"win": F.col("win").isin(*WINDOWS)}
    rules["n_assets"] = F.col("n_assets").between(*BOUNDED_ASSETS) if bounded else F.col("n_assets") >= 1
    if search:
        rules["pop_size"] = F.col("pop_size") >= MIN_POPULATION
        rules["fitness_type"] = F.col("fitness_type").isin(*FITNESS_TYPES)
    return rules


def accepted(scenarios: DataFrame, bounded: bool = True, search: bool = True) -> DataFrame:
    """The scenarios that meet the rules; formation and search run on these alone."""
    ok = F.lit(True)
    for cond in scenario_rules(bounded, search).values():
        ok = ok & F.coalesce(cond, F.lit(False))
    return scenarios.filter(ok)


def validate_scenarios(scenarios: DataFrame, strict: bool = False, bounded: bool = True, search: bool = True) -> DataFrame:
    """scenario_id, valid, reason: the rules each scenario breaks, ``;``-joined.
    What formation and search leave out is what this returns with valid = false."""
    reasons = F.concat_ws(";", *[F.when(~F.coalesce(cond, F.lit(False)), F.lit(name))
                                 for name, cond in scenario_rules(bounded, search).items()])
    out = scenarios.select("scenario_id", (reasons == "").alias("valid"), reasons.alias("reason"))
    if strict:
        out = out.withColumn("valid", F.when(F.col("valid"), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("invalid scenario "), F.col("scenario_id").cast("string"),
                                   F.lit(": "), F.col("reason")))))
    return out


def lookback_bounds(scenarios: DataFrame) -> DataFrame:
    """scenario_id, window, formation_date, left_date, right_date (true calendar days)."""
    w = windows_table(scenarios.sparkSession)
    s = scenarios.select("scenario_id", "win", "formation_date").join(w, "win")
    return s.select("scenario_id", "win", "formation_date",
                    F.date_sub("formation_date", F.col("lookback_days")).alias("left_date"),
                    F.date_add("formation_date", F.lit(RIGHT_PAD_DAYS)).alias("right_date"))


def _month(c) -> Column:
    """Months since year 0: the bucket of the lookback join."""
    c = F.col(c) if isinstance(c, str) else c
    return F.year(c) * 12 + F.month(c)


def _clustered(flong: DataFrame) -> list[str]:
    """The join columns that the stored long panel is partitioned by beside win; an unstored one has none."""
    return [c for c in ("year",) if c in flong.columns]


def asked_folders(flong: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of the stored long panel in the (win, year) folders that ``asked`` names; an unstored panel stays whole.

    The folders are read first and become a partition filter of the plan, which
    holds whatever join follows and whatever statistics there are (run-time
    pruning needs a selective filter on the scenarios and a broadcast).  They are
    six windows times the years of the calendar at most."""
    if not _clustered(flong):
        return flong
    years: dict[int, list[int]] = {}
    for r in asked.filter(F.col("win").isin(*WINDOWS) & F.col("year").isNotNull()).select("win", "year").distinct().collect():
        years.setdefault(r["win"], []).append(r["year"])
    folders = F.lit(False)
    for win, in_years in sorted(years.items()):
        folders = folders | ((F.col("win") == win) & F.col("year").isin(*sorted(in_years)))
    return flong.filter(folders)


def lookback_months(scenarios: DataFrame) -> DataFrame:
    """scenario_id, win, left_date, right_date, month: a row per calendar month
    that the lookback touches (at most 14)."""
    b = lookback_bounds(scenarios)
    return b.select("scenario_id", "win", "left_date", "right_date",
                    F.explode(F.sequence(_month("left_date"), _month("right_date"))).alias("month"))


def lookback_slice(scenarios: DataFrame, flong: DataFrame, holdings: DataFrame) -> DataFrame:
    """scenario_id, symbol, dt, ror: lookback returns of the held symbols only.

    An equi-join on (symbol, window, month) with the date bounds as residual:
    at most 14 request rows per (scenario, held symbol).  A symbol held by many
    scenarios makes hot join keys, which AQE's skew join splits."""
    held = holdings.select("scenario_id", "symbol").distinct()
    parts = _clustered(flong)
    months = lookback_months(scenarios).withColumn("year", F.floor((F.col("month") - 1) / 12).cast("int"))
    panel = asked_folders(flong, months).select("symbol", "dt", "win", "ror", _month("dt").alias("month"), *parts)
    req = held.join(months, "scenario_id")
    hit = req.join(panel, ["symbol", "win", "month", *parts]).filter(F.col("dt").between(F.col("left_date"), F.col("right_date")))
    return hit.select("scenario_id", "symbol", "dt", "ror")


def scenario_keys(scenarios: DataFrame) -> DataFrame:
    """Distinct (dt, window) formation keys with the largest n_assets asked for."""
    return (scenarios.groupBy(F.col("formation_date").alias("dt"), "win")
                     .agg(F.max("n_assets").alias("max_n")))


def universe(scenarios: DataFrame, flong: DataFrame) -> DataFrame:
    """Eligible symbols per formation key (dt, window): mean not null.

    From the stored long panel only the (window, year) folders of the keys are read.  One row per (key, symbol), shared by all scenarios with that key."""
    parts = _clustered(flong)
    keys = scenario_keys(scenarios).select("dt", "win", F.year("dt").cast("int").alias("year"))
    u = asked_folders(flong, keys).filter(F.col("mean").isNotNull()).join(keys, ["dt", "win", *parts], "left_semi")
    return u.select("dt", "win", "symbol", "mean", "adj_close", "currency")


def formation_slice(scenarios: DataFrame, flong: DataFrame) -> DataFrame:
    """scenario_id, symbol, mean, adj_close, currency: each scenario's eligible universe."""
    u = universe(scenarios, flong)
    s = scenarios.select("scenario_id", F.col("formation_date").alias("dt"), "win")
    return s.join(u, ["dt", "win"]).select("scenario_id", "symbol", "mean", "adj_close", "currency")


def top_k(df: DataFrame, part: list[str], order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k within ``part`` by ``order`` (include a complete tie-break).

    A literal k lets Spark plan a partial WindowGroupLimit before the shuffle."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def ranked_universe(scenarios: DataFrame, flong: DataFrame) -> DataFrame:
    """Symbols by falling mean per formation key, with their rank, as far as some scenario asks.

    The largest n_assets is read first: as a literal it lets each task keep
    that many rows a key before the exchange."""
    most = scenarios.agg(F.max("n_assets")).first()[0] or 0
    u = universe(scenarios, flong)
    return top_k(u, ["dt", "win"], [F.col("mean").desc(), F.col("symbol")], int(most))


def indexed_universe(scenarios: DataFrame, flong: DataFrame) -> DataFrame:
    """Eligible symbols numbered 0..m-1 per formation key, and m.

    Numbered inside hash buckets of the symbol; a bucket's offset is the number
    of symbols in the buckets before it, from one small count.  So no task
    sorts a whole universe, also when all scenarios share one formation key.
    Random formation draws positions in [0, m) and equi-joins on them."""
    u = universe(scenarios, flong)
    u = u.withColumn("bucket", draw_mod(F.lit(0), "universe", UNIVERSE_BUCKETS, F.col("symbol")).cast("int"))
    key = ["dt", "win"]
    before = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sizes = u.groupBy(*key, "bucket").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select(*key, "bucket", (F.sum("n").over(before) - F.col("n")).alias("offset"),
                         F.sum("n").over(Window.partitionBy(*key)).alias("m"))
    inside = Window.partitionBy(*key, "bucket").orderBy("symbol")
    numbered = u.withColumn("_i", F.row_number().over(inside) - 1)
    return numbered.join(sizes, [*key, "bucket"]).select(
        *key, "symbol", "mean", "adj_close", "currency", (F.col("offset") + F.col("_i")).alias("pos"), "m")


def distinct_symbols(features: DataFrame) -> DataFrame:
    return features.select("symbol").distinct()


def distinct_dates(features: DataFrame) -> DataFrame:
    return features.select("dt").distinct()


def union_distinct(slice_rows: DataFrame, portfolio_rows: DataFrame) -> DataFrame:
    """Lookback rows and portfolio rows, one row per (scenario, symbol, dt)."""
    cols = ["scenario_id", "symbol", "dt", "ror"]
    return slice_rows.select(*cols).unionByName(portfolio_rows.select(*cols)) \
                     .dropDuplicates(["scenario_id", "symbol", "dt"])


def pivot_returns(long_returns: DataFrame, symbols: list[str]) -> DataFrame:
    """dt x symbol matrix of ror for a bounded, explicit symbol list (a report)."""
    return (long_returns.filter(F.col("symbol").isin(*symbols))
            .groupBy("dt").pivot("symbol", symbols).agg(F.first("ror")))
