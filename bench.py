"""Headline timings.  Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs to completion through the no-op sink (full execution, no
collect to the driver); times are wall seconds.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from basketry.operators import features as feat  # noqa: E402
from basketry.operators import formation as form  # noqa: E402
from basketry.operators import risk, search, valuation  # noqa: E402
from basketry.plans.context import Ctx  # noqa: E402
from basketry.session import build_session, scratch_path  # noqa: E402
from basketry.sources.parquet import read_panel_parquet, write_panel_parquet  # noqa: E402
from basketry.sources import fixtures  # noqa: E402


def run(df):
    df.write.format("noop").mode("overwrite").save()


class Clock:
    """Seconds and number of Spark jobs of each step."""

    def __init__(self, spark):
        self.sc, self.seconds, self.jobs = spark.sparkContext, {}, {}

    def time(self, name, fn):
        self.sc.setJobGroup(name, name)
        t0 = time.perf_counter()
        out = fn()
        self.seconds[name] = round(time.perf_counter() - t0, 3)
        self.jobs[name] = len(self.sc.statusTracker().getJobIdsForGroup(name))
        return out


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus)
    clock = Clock(spark)
    # warm-up: JVM start and first planning, not timed
    run(fixtures.fx(spark, sf_dir))

    # build the feature panel from the raw tables and store it (as panel_or_build does)
    store = scratch_path(spark, "bench-features")
    clock.time("panel_build", lambda: run(fixtures.panel(spark, sf_dir)))
    clock.time("asset_features", lambda: write_panel_parquet(feat.asset_features(fixtures.panel(spark, sf_dir)), store))
    grid = (60, 120, 252)
    ctx = Ctx(spark, sf_dir, features=read_panel_parquet(spark, store), windows=grid)
    daily = fixtures.daily(spark, sf_dir)
    dstore = scratch_path(spark, "bench-daily")
    clock.time("asset_features_daily", lambda: write_panel_parquet(feat.asset_features(daily), dstore))
    dfeatures = read_panel_parquet(spark, dstore)
    # scenarios and FX are stored once a session; what that takes is a step of its own
    scen, fx = clock.time("stored_inputs", lambda: (ctx.scenarios, ctx.fx))
    flong = ctx.flong
    bh = form.buy_and_hold(scen, flong)
    clock.time("buy_and_hold", lambda: run(form.buy_and_hold(scen, flong)))
    clock.time("portfolio_variance", lambda: run(risk.portfolio_variance(bh, scen, flong, ["scenario_id", "portfolio_id"])))
    clock.time("correlation_matrix", lambda: run(risk.correlation_matrix(bh, scen, flong, ["scenario_id", "portfolio_id"])))
    clock.time("roi_horizons", lambda: run(valuation.roi_horizons(bh, scen, ctx.prices, fx)))
    clock.time("portfolio_summary", lambda: run(risk.portfolio_summary(bh, scen, flong, ctx.prices, fx)))
    clock.time("random_unconstrained", lambda: run(form.random_unconstrained(scen, flong)))

    # daily supplier panel: many symbols, one scenario per ship date
    dctx = Ctx(spark, sf_dir, features=dfeatures, windows=(60,), n_assets=10)
    dscen = clock.time("stored_inputs_daily", lambda: dctx.scenarios)
    clock.time("roi_horizons_daily", lambda: run(valuation.roi_horizons(form.buy_and_hold(dscen, dctx.flong), dscen, dctx.prices, fx)))

    # one generation of the search over the whole scenario grid, and over 1, 10 and 100 of its scenarios
    def evolve(s, generations=1):
        return lambda: run(search.evolve(s.withColumn("generations", F.lit(generations)), flong)[0])

    clock.time("evolve_1gen", evolve(scen))
    late = scen.filter("win = 120").orderBy(F.desc("formation_date"))
    for n in (1, 10, 100):
        clock.time(f"evolve_1gen_{n}_scenarios", evolve(late.limit(n)))
    # the reference's live setting (20 assets, 32 individuals, window 120), ten of its hundred generations
    live = Ctx(spark, sf_dir, features=ctx.features, windows=(120,), n_assets=20, pop_size=32, fitness_type="linear").scenarios
    clock.time("evolve_live_10gen", evolve(live.orderBy(F.desc("formation_date")).limit(1), 10))

    total = round(sum(clock.seconds.values()), 3)
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": clock.seconds, "jobs": clock.jobs,
                      "sf": os.path.basename(sf_dir).replace("sf", ""), "cpus": cpus}))


if __name__ == "__main__":
    main()
