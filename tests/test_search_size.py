"""The search step and its panel: each part of the plan once, draws computed once a child, rows as before."""
import random
import re

import pytest
from pyspark.sql import functions as F

from basketry.operators import search
from basketry.operators.slicing import windows_table
from basketry.sources import fixtures
from basketry.sources.schemas import LOOKBACK_DAYS, WINDOWS

SCEN = "scenario_id long, seed long, mutation_rate double, n_assets int, formation_date string, win int, pop_size int, fitness_type string"
POP = "scenario_id long, generation int, indiv_id long, symbol string, weight double, price double, currency string, mean double"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _population(n_scen=3, n_indiv=6, n=5, universe=9):
    rng, rows = random.Random(3), []
    for s in range(n_scen):
        for i in range(n_indiv):
            for symbol in rng.sample(range(universe), n):
                rows.append((s, 0, i, f"S{symbol}", 1.0 / n, 1.0, "EUR", rng.random()))
    return rows


@pytest.fixture(scope="module")
def step(spark):
    rows = _population()
    pop = spark.createDataFrame(rows, POP)
    scen = spark.createDataFrame([(s, 7, 1.0, 5, "2020-01-01", 60, 6, "return") for s in range(3)], SCEN)
    pairs = spark.createDataFrame([(s, p, 2 * p, 2 * p + 1) for s in range(3) for p in range(3)], "scenario_id long, pair int, indiv_a long, indiv_b long")
    return rows, pop, scen, pairs


def test_children_take_each_parent_from_one_join(spark, step):
    rows, pop, scen, pairs = step
    cuts = search.crossover_cuts(pairs, pop, scen, 0)
    held = {}
    for s, _, i, symbol, *_ in rows:
        held.setdefault((s, i), []).append(symbol)
    want = set()
    for r in cuts.collect():
        a, b = sorted(held[r.scenario_id, r.indiv_a]), sorted(held[r.scenario_id, r.indiv_b])
        kids = (a[5 - r.cut:] + b[:5 - r.cut], b[5 - r.cut:] + a[:5 - r.cut])
        assert all(len(set(k)) == 5 for k in kids)      # a valid cut: no symbol twice
        want |= {(r.scenario_id, 2 * r.pair + 1 + j, symbol) for j, k in enumerate(kids) for symbol in k}
    kids = search.crossover(cuts, pop, scen, 0)
    got = [(r.scenario_id, r.indiv_id, r.symbol) for r in kids.collect()]
    assert len(got) == len(set(got)) == 90 and set(got) == want
    # the cuts are planned once, not once per part of a child
    plan = _optimized(kids)
    assert len(re.findall(r"Window \[", plan)) <= 3 and len(re.findall(r"Join \w+", plan)) <= 5, plan


def test_a_child_is_drawn_once_for_its_rows_and_once_for_the_lost(spark, step):
    _, pop, scen, _ = step
    iu = spark.createDataFrame([("2020-01-01", 60, f"T{p}", 0.1, 1.0, "EUR", p, 9) for p in range(9)],
                               "dt string, win int, symbol string, mean double, adj_close double, currency string, pos long, m long")
    out = search.mutate(pop, scen, iu, 0)
    assert _optimized(out).count("filter(") <= 2      # the trial of all 250 draws of a gene: the child's rows, the lost ones
    assert len(out.select("scenario_id", "indiv_id").distinct().collect()) == 18


def test_children_without_a_valid_draw_are_replaced(spark):
    """Two weights cannot both be at most 0.25: every mutated child is lost; the replacement has four or more."""
    scen = spark.createDataFrame([(1, 7, 1.0, 4, "2020-01-01", 60, 6, "return")], SCEN)
    kids = spark.createDataFrame([(1, 1, i, f"S{k}", 0.5, 1.0, "EUR", 0.1) for i in range(5) for k in range(2)], POP)
    iu = spark.createDataFrame([("2020-01-01", 60, f"T{p}", 0.1, 1.0, "EUR", p, 9) for p in range(9)],
                               "dt string, win int, symbol string, mean double, adj_close double, currency string, pos long, m long")
    rows = search.mutate(kids, scen, iu, 0).collect()
    assert len(rows) == 20 and {r.symbol[0] for r in rows} == {"T"} and {r.indiv_id for r in rows} == set(range(5))


def test_windows_are_rows_of_the_plan(spark):
    assert "LocalTableScan" in _plan(windows_table(spark))
    assert {r.win: r.lookback_days for r in windows_table(spark).collect()} == {k: LOOKBACK_DAYS[k] for k in WINDOWS}


def test_line_items_meet_one_join_before_they_are_summed(spark, tmp_path):
    import datetime as dt
    sup = [(1, 10), (2, 10), (3, 11), (4, None), (2, 10)]                       # a supplier that comes twice
    nat, reg = [(10, 0), (11, 1), (11, 1), (12, 0)], [(0, "EUROPE"), (1, "ASIA")]
    days = [dt.datetime(2020, 1, 5, 23, 59), dt.datetime(2020, 1, 6), dt.datetime(2020, 1, 12), None]
    li = [(k % 5 + 1, day, price, 3.0) for k, price in enumerate((1.005, 10.125, 7.0, None, 2.675, 1e6 + 0.125, 0.285)) for day in days]
    for name, rows, schema in (("supplier", sup, "s_suppkey long, s_nationkey long"), ("nation", nat, "n_nationkey long, n_regionkey long"),
                               ("region", reg, "r_regionkey long, r_name string"),
                               ("lineitem", li, "l_suppkey long, l_shipdate timestamp_ntz, l_extendedprice double, l_quantity double")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        spark.read.parquet(f"{tmp_path}/{name}.parquet").createOrReplaceTempView(f"size_{name}")
    want = spark.sql("""select concat('N.', n_nationkey) symbol, cast(date_trunc('week', l_shipdate) as date) dt, sum(cast(round(l_extendedprice * 100) as bigint)) cents,
        max(l_extendedprice / l_quantity) high, min(l_extendedprice / l_quantity) low, sum(cast(l_quantity as bigint)) volume, r_name index_name
        from size_lineitem join size_supplier on l_suppkey = s_suppkey join size_nation on s_nationkey = n_nationkey join size_region on n_regionkey = r_regionkey
        group by n_nationkey, date_trunc('week', l_shipdate), r_name""").selectExpr(
        "symbol", "dt", "cast(cents as double) / cast(volume as double) / 100d as adj_close", "high", "low", "volume", "index_name").collect()
    out = fixtures.panel_raw(spark, str(tmp_path))
    got = out.select("symbol", "dt", "adj_close", "high", "low", "volume", "index_name").collect()
    assert len(got) > 4 and sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))
    lines = _optimized(out).splitlines()
    depth = lambda line: re.search(r"\w", line).start()
    at = next(k for k, line in enumerate(lines) if "Relation" in line and "l_extendedprice" in line)
    above, d = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < d:
            above, d = [*above, line[depth(line):]], depth(line)
    first = next(k for k, line in enumerate(above) if line.startswith("Aggregate"))
    assert sum(line.startswith("Join") for line in above[:first]) == 1, above


def test_cents_round_half_up(spark):
    rng = random.Random(5)
    xs = [rng.uniform(-1, 1) * 10 ** rng.randint(-4, 11) for _ in range(3000)] + [k / 8 for k in range(-400, 400)] + [0.0049999999999999994, -0.0, 4e13, None]
    df = spark.createDataFrame([(x,) for x in xs], "p double").select(fixtures._cents("p").alias("a"), F.round(F.col("p") * 100).cast("bigint").alias("b"))
    assert df.filter("not (a <=> b)").count() == 0
    assert "round(" not in _plan(spark.createDataFrame([(1.0,)], "p double").select(fixtures._cents("p")))
