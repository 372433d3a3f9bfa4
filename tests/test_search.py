"""Invariants of the search."""
import pytest
from pyspark.sql import functions as F

from basketry.operators import formation as form
from basketry.operators import search
from basketry.operators.slicing import indexed_universe
from basketry.plans.context import Ctx
from conftest import SF001


@pytest.fixture(scope="module")
def run(spark):
    ctx = Ctx(spark, "/root/testdata/sf0.01", windows=(20, 120), n_assets=10, generations=2, pop_size=8)
    scen = ctx.scenarios.filter(F.col("formation_date") >= "2000-01-01")  # dates with full history
    best, pop, hist = search.evolve(scen, ctx.flong)
    return ctx, scen, best, pop, hist


def test_population_size_constant(run):
    _, scen, _, pop, _ = run
    sizes = pop.groupBy("scenario_id").agg(F.countDistinct("indiv_id").alias("k")).select("k").distinct().collect()
    assert [r.k for r in sizes] == [8]


def test_individuals_hold_distinct_symbols_and_unit_weight(run):
    _, _, _, pop, _ = run
    g = pop.groupBy("scenario_id", "indiv_id").agg(
        F.count("*").alias("n"), F.countDistinct("symbol").alias("nd"), F.sum("weight").alias("s"))
    assert g.filter(F.col("n") != F.col("nd")).count() == 0
    assert g.filter(F.abs(F.col("s") - 1.0) > 1e-9).count() == 0


def test_elitism_best_fitness_never_falls(run):
    _, _, _, _, hist = run
    rows = hist.orderBy("scenario_id", "generation").collect()
    by = {}
    for r in rows:
        by.setdefault(r.scenario_id, []).append(r.best_fitness)
    for seq in by.values():
        vals = [v for v in seq if v is not None]
        assert all(b >= a - 1e-9 for a, b in zip(vals, vals[1:]))


def test_one_best_portfolio_per_scenario(run):
    _, scen, best, _, _ = run
    assert best.select("scenario_id").distinct().count() == scen.count()


def test_fresh_portfolios_within_bounds(spark):
    ctx = Ctx(spark, "/root/testdata/sf0.01", n_assets=10)
    iu = indexed_universe(ctx.scenarios, ctx.flong)
    r = form.random_constrained(form.individuals_of(ctx.scenarios, 0), iu, "t")
    full = r.groupBy("scenario_id", "indiv_id").agg(F.count("*").alias("n"), F.min("weight").alias("mn"),
                                                   F.max("weight").alias("mx"), F.sum("weight").alias("s"))
    full = full.filter(F.col("n") == 10)
    assert full.count() > 0
    assert full.filter((F.col("mn") < 0.01 - 1e-12) | (F.col("mx") > 0.25 + 1e-12)).count() == 0
    assert full.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_same_seed_same_rows_under_other_partitioning(spark):
    ctx = Ctx(spark, SF001, n_assets=5)
    iu = indexed_universe(ctx.scenarios, ctx.flong)
    a = form.random_constrained(form.individuals_of(ctx.scenarios, 0), iu, "p")
    rows_a = sorted(map(tuple, a.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = form.random_constrained(form.individuals_of(ctx.scenarios.repartition(5), 0), iu, "p")
        rows_b = sorted(map(tuple, b.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert rows_a == rows_b


def test_every_scenario_gets_all_pairs_with_distinct_parents(spark):
    ctx = Ctx(spark, SF001, n_assets=5, pop_size=12)
    iu = indexed_universe(ctx.scenarios, ctx.flong)
    pop = search.init_population(ctx.scenarios, ctx.flong, iu)
    fit = search.evaluate_population(pop, ctx.scenarios, ctx.flong)
    parents = search.select_parents(search.rank_population(fit), ctx.scenarios)
    pairs = search.roulette_pairs(parents, ctx.scenarios, 0)
    # pop 12: selection 6, z = 2, three pairs per scenario with parents
    counts = pairs.groupBy("scenario_id").count().select("count").distinct().collect()
    assert [r["count"] for r in counts] == [3]
    assert pairs.filter(F.col("indiv_a") == F.col("indiv_b")).count() == 0
    n_with_parents = parents.select("scenario_id").distinct().count()
    assert pairs.select("scenario_id").distinct().count() == n_with_parents


def test_no_attempts_at_any_n(spark):
    """One rule from 4 to 100 holdings: bounds hold, weights sum to 1, nothing is left out."""
    rows = [(n, 0, i, "2020-01-01", 60, n, 7) for n in (4, 5, 10, 30, 50, 99, 100) for i in range(20)]
    ind = spark.createDataFrame(rows, "scenario_id long, generation int, indiv_id long, dt string, win int, n_assets int, seed long")
    iu = spark.range(120).select(F.lit("2020-01-01").alias("dt"), F.lit(60).alias("win"), F.concat(F.lit("S"), "id").alias("symbol"),
                                 F.lit(0.1).alias("mean"), F.lit(1.0).alias("adj_close"), F.lit("EUR").alias("currency"),
                                 F.col("id").alias("pos"), F.lit(120).alias("m"))
    g = form.random_constrained(ind, iu, "t").groupBy("scenario_id", "indiv_id").agg(
        F.count("*").alias("n"), F.countDistinct("symbol").alias("d"), F.sum("weight").alias("s"), F.min("weight").alias("mn"), F.max("weight").alias("mx"))
    got = g.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n == r.d == r.scenario_id and abs(r.s - 1) < 1e-9 and r.mn >= 0.01 - 1e-12 and r.mx <= 0.25 + 1e-12


def test_mutation_has_the_distribution_of_the_retry_loop(spark):
    """Gene and weight of many mutations of one child against a simulated retry loop."""
    import random
    from collections import Counter
    weights = [0.24, 0.20, 0.18, 0.15, 0.13, 0.10]
    n = 4000
    kids = spark.range(n).select(F.lit(1).cast("long").alias("scenario_id"), F.lit(1).alias("generation"), F.col("id").alias("indiv_id"),
                                 F.explode(F.array(*[F.struct(F.lit(f"S{i}").alias("symbol"), F.lit(w).alias("weight")) for i, w in enumerate(weights)])).alias("x"))
    kids = kids.select("scenario_id", "generation", "indiv_id", "x.symbol", "x.weight", F.lit(1.0).alias("price"), F.lit("EUR").alias("currency"), F.lit(0.1).alias("mean"))
    scen = spark.createDataFrame([(1, 42, 1.0, 6, "2020-01-01", 60)], "scenario_id long, seed long, mutation_rate double, n_assets int, formation_date string, win int")
    iu = spark.createDataFrame([("2020-01-01", 60, f"T{p}", 0.1, 1.0, "EUR", p, 9) for p in range(9)],
                               "dt string, win int, symbol string, mean double, adj_close double, currency string, pos long, m long")
    out = search.mutate(kids, scen, iu, 0).groupBy("indiv_id").agg(F.sort_array(F.collect_list(F.struct("symbol", "weight"))).alias("h")).collect()
    assert len(out) == n

    def changed(h):
        w = [x.weight for x in h]
        assert all(0.01 - 1e-12 <= x <= 0.25 + 1e-12 for x in w) and abs(sum(w) - 1) < 1e-9
        # the unchanged weights keep their ratios
        for g in range(6):
            rest = [w[i] / weights[i] for i in range(6) if i != g]
            if max(rest) - min(rest) < 1e-9:
                return g
    got = Counter(changed(r.h) for r in out)
    rng, want = random.Random(1), Counter()
    for _ in range(n):
        while True:
            g, hit = rng.randrange(6), False
            for _ in range(20):
                w = list(weights)
                w[g] = max(rng.randrange(250), 1) / 1000
                s = sum(w)
                if all(0.01 <= x / s <= 0.25 for x in w):
                    hit = True
                    break
            if hit:
                break
        want[g] += 1
    assert None not in got
    assert all(abs(got[g] - want[g]) < 5 * (want[g] + 30) ** 0.5 for g in range(6)), (got, want)


def test_invalid_scenarios_stay_out_with_their_reason(spark):
    from basketry.operators.slicing import validate_scenarios
    ctx = Ctx(spark, SF001, windows=(20,), n_assets=5, generations=1)
    one = ctx.scenarios.orderBy(F.desc("formation_date")).limit(1)
    bad = [("n_assets", 3), ("n_assets", 120), ("pop_size", 2), ("fitness_type", "sharpe"), ("win", 7)]
    rows = one
    for i, (c, v) in enumerate(bad):
        rows = rows.unionByName(one.withColumn("scenario_id", F.lit(i).cast("long")).withColumn(c, F.lit(v).cast(one.schema[c].dataType)))
    best, pop, hist = search.evolve(rows, ctx.flong)
    valid = one.first().scenario_id
    assert {r.scenario_id for r in pop.select("scenario_id").distinct().collect()} == {valid}
    assert {r.scenario_id: r.reason for r in validate_scenarios(rows).collect() if not r.valid} == {i: c for i, (c, _) in enumerate(bad)}
    iu = indexed_universe(rows, ctx.flong)
    assert {r.scenario_id for r in form.random_constrained(form.individuals_of(rows), iu).collect()} == {valid}
    # buy-and-hold knows no bounds on n, only windows that exist
    held = {r.scenario_id for r in form.buy_and_hold(rows, ctx.flong).collect()}
    assert held == {valid, 0, 1, 2, 3}


def test_evolve_keeps_two_generations_on_disk(spark, monkeypatch):
    import os
    import tempfile
    root = tempfile.mkdtemp(prefix="basketry-evolve-")
    monkeypatch.setattr(search, "scratch_path", lambda s, n: f"{root}/run")
    ctx = Ctx(spark, SF001, windows=(20,), n_assets=5, generations=4)
    search.evolve(ctx.scenarios.orderBy(F.desc("formation_date")).limit(3), ctx.flong)
    assert sorted(d for d in os.listdir(f"{root}/run") if d[0] == "g" and d[1].isdigit()) == ["g3", "g4"]


@pytest.mark.parametrize("name", ["init_population", "fitness_linear", "fitness_history", "optimized"])
def test_registered_searches_run_on_every_window(spark, name):
    import __spark_entry__ as E
    windows = lambda q: {r[0] for r in E.queries()[q](spark, SF001).select(F.col("scenario_id") % 1000).distinct().collect()}
    assert windows(name) == windows("buy_and_hold") == {5, 10, 20, 60, 120, 252}
