"""Edge rows as small inline tables."""
import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from basketry.functions.columns import rescale_range
from basketry.operators import features as feat
from basketry.operators import formation as form
from basketry.operators import slicing, valuation
from basketry.sources import csv as csvsrc

D = dt.date
PRICE_SCHEMA = "symbol string, dt date, adj_close double, volume bigint, index_name string, currency string"


def _prices(spark, rows):
    return spark.createDataFrame(rows, PRICE_SCHEMA)


def test_one_row_symbol_and_duplicates(spark):
    rows = [("A.X", D(2020, 1, 1), 10.0, 5, "I", "EUR"),
            ("B", D(2020, 1, 1), 1.0, 5, "I", "USD"), ("B", D(2020, 1, 1), 2.0, 9, "I", "USD"),
            ("B", D(2020, 1, 2), 4.0, 1, "I", "USD")]
    f = feat.asset_features(_prices(spark, rows)).orderBy("symbol", "dt").collect()
    assert [r.symbol for r in f] == ["A_X", "B", "B"]           # dot cleaned, duplicate collapsed
    assert f[1].adj_close == 2.0                                 # highest volume wins
    assert f[0].ror_5 is None and f[0].std_5 is None
    assert f[2].ror_5 is None                                    # lag 5 missing


def test_zero_price_gives_null_return_and_null_shares(spark):
    rows = [("Z", D(2020, 1, d), 0.0 if d == 1 else 1.0, 1, "I", "EUR") for d in range(1, 8)]
    f = feat.asset_features(_prices(spark, rows)).orderBy("dt").collect()
    assert f[5].ror_5 is None                                    # divides by the zero price
    p = spark.createDataFrame([(1, 0, "Z", 1.0, 0.0, "EUR", 0.0)],
                              "scenario_id long, portfolio_id long, symbol string, weight double, price double, currency string, mean double")
    s = spark.createDataFrame([(1, D(2020, 1, 1), 1000, 0, 5)], "scenario_id long, formation_date date, budget long, fee long, n_assets int")
    assert valuation.allocate_shares(p, s).first().shares is None


def test_asof_price_walks_back_and_unknown_symbol_is_null(spark):
    prices = _prices(spark, [("A", D(2020, 1, 1), 1.0, 1, "I", "EUR"), ("A", D(2020, 1, 5), 2.0, 1, "I", "EUR")])
    req = spark.createDataFrame([("A", D(2020, 1, 4)), ("A", D(2020, 1, 5)), ("A", D(2019, 12, 31)), ("Q", D(2020, 1, 5))],
                                "symbol string, req_dt date")
    got = {(r.symbol, r.req_dt): (r.price_dt, r.price) for r in valuation.asof_price(prices, req).collect()}
    assert got[("A", D(2020, 1, 4))] == (D(2020, 1, 1), 1.0)
    assert got[("A", D(2020, 1, 5))] == (D(2020, 1, 5), 2.0)
    assert got[("A", D(2019, 12, 31))] == (None, None)
    assert got[("Q", D(2020, 1, 5))] == (None, None)
    stale = valuation.asof_price(prices, req, max_staleness_days=2).filter("req_dt = date'2020-01-04'").first()
    assert stale.price is None


def test_fx_gap_and_unknown_currency(spark):
    fx = spark.createDataFrame([(D(2020, 1, 1), "USD", "EUR", 0.9), (D(2020, 1, 10), "USD", "EUR", 0.8)],
                               "dt date, from_ccy string, to_ccy string, adj_close double")
    req = spark.createDataFrame([("USD", D(2020, 1, 7)), ("EUR", D(2020, 1, 7)), ("JPY", D(2020, 1, 7))],
                                "currency string, rate_req_dt date")
    got = {r.currency: r.rate for r in valuation.fx_rate(fx, req).collect()}
    assert got == {"USD": 0.9, "EUR": 1.0, "JPY": None}


def test_tie_in_mean_broken_by_symbol(spark):
    rows = [(s, D(2020, 1, 1), 60, 0.5, 1.0, "EUR") for s in ["C", "A", "B"]]
    flong = spark.createDataFrame(rows, "symbol string, dt date, win int, mean double, adj_close double, currency string") \
                 .withColumn("ror", F.lit(None).cast("double")).withColumn("std", F.lit(None).cast("double"))
    scen = spark.createDataFrame([(1, D(2020, 1, 1), 60, 2)], "scenario_id long, formation_date date, win int, n_assets int")
    got = sorted(r.symbol for r in form.buy_and_hold(scen, flong).collect())
    assert got == ["A", "B"]


def test_validate_scenarios(spark):
    rows = [(1, 7, 10, 8, "linear"), (2, 60, 3, 8, "linear"), (3, 60, 4, 8, "linear"), (4, 60, 100, 8, "return"),
            (5, 60, 101, 8, "linear"), (6, 252, 10, 2, "linear"), (7, 120, 10, 8, "sharpe")]
    s = spark.createDataFrame(rows, "scenario_id long, win int, n_assets int, pop_size int, fitness_type string")
    got = {r.scenario_id: r.reason for r in slicing.validate_scenarios(s).collect()}
    assert got == {1: "win", 2: "n_assets", 3: "", 4: "", 5: "n_assets", 6: "pop_size", 7: "fitness_type"}


def test_rescale_range(spark):
    df = spark.createDataFrame([(-10000.0,), (10000.0,), (0.0,)], "x double")
    got = [r.y for r in df.select(rescale_range(F.col("x"), -10000, 10000, 1, 10000).alias("y")).collect()]
    assert got == [1.0, 10000.0, 5000.5]
    same = df.select(rescale_range(F.col("x"), 5, 5, 1, 10000).alias("y")).collect()
    assert {r.y for r in same} == {1.0}


def test_csv_rejects(spark):
    d = tempfile.mkdtemp(prefix="basketry-csv-")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("dt;open;high;low;close;adj_close;volume;symbol;index_name;currency\n")
        f.write("2020-01-02;1;1;1;1;1.5;10;GOOD;IDX;EUR\n")
        f.write("2020-01-03;1;1;1;1;1.5;3000000000;BIG;IDX;EUR\n")          # volume over 2^31: kept
        f.write("2020-01-04;1;1;1;1;1.5;10;SHORT\n")                       # downloader layout: 8 tokens
        f.write("2020-01-05;1;1;1;1;abc;10;BADPRICE;IDX;EUR\n")
        f.write("2020-01-06;1;1;1;1;;10;EMPTY;IDX;EUR\n")
        f.write("2020-01-07;1;1;1;1;1.5;100.0;FLOATVOL;IDX;EUR\n")
    good = {r.symbol: r for r in csvsrc.read_asset_csv(spark, d).collect()}
    assert set(good) == {"GOOD", "BIG"}
    assert good["BIG"].volume == 3000000000
    rej = csvsrc.rejected_rows(spark, d).collect()
    assert sorted(r.line.split(";")[7] for r in rej) == ["BADPRICE", "EMPTY", "FLOATVOL", "SHORT"]


def test_floyd_positions_distinct_and_in_range(spark):
    rows = [(i, n, m) for i, (n, m) in enumerate([(5, 5), (5, 3), (10, 1000), (0, 4), (100, 100), (4, 7)])]
    df = spark.createDataFrame(rows, "k long, n int, m int")
    out = df.select("k", "n", "m", form.floyd_positions(F.col("n"), F.col("m"), F.lit(7), "t", F.col("k")).alias("p")).collect()
    for r in out:
        assert len(r.p) == min(r.n, r.m)
        assert len(set(r.p)) == len(r.p)
        assert all(0 <= x < r.m for x in r.p)


def test_four_assets_only_equal_weights(spark):
    """n = 4 admits only 1/4 each."""
    iu = spark.createDataFrame([(D(2020, 1, 1), 60, f"S{p}", 0.1, 1.0, "EUR", p, 6) for p in range(6)],
                               "dt date, win int, symbol string, mean double, adj_close double, currency string, pos long, m long")
    ind = spark.createDataFrame([(1, 0, i, D(2020, 1, 1), 60, 4, 42) for i in range(20)],
                                "scenario_id long, generation int, indiv_id long, dt date, win int, n_assets int, seed long")
    r = form.random_constrained(ind, iu, "four").collect()
    assert len(r) == 80
    assert all(abs(x.weight - 0.25) < 1e-12 for x in r)
    assert len({(x.indiv_id, x.symbol) for x in r}) == 80


def test_buy_and_hold_beyond_a_hundred(spark):
    rows = [(f"S{i:03d}", D(2020, 1, 1), 60, float(i), 1.0, "EUR", None, None) for i in range(150)]
    flong = spark.createDataFrame(rows, "symbol string, dt date, win int, mean double, adj_close double, currency string, ror double, std double")
    scen = spark.createDataFrame([(1, D(2020, 1, 1), 60, 150), (2, D(2020, 1, 1), 60, 3)], "scenario_id long, formation_date date, win int, n_assets int")
    got = form.buy_and_hold(scen, flong).groupBy("scenario_id").agg(F.count("*").alias("n"), F.sum("weight").alias("s")).collect()
    assert {r.scenario_id: (r.n, round(r.s, 9)) for r in got} == {1: (150, 1.0), 2: (3, 1.0)}


def test_duplicate_fx_rows_in_either_order(spark):
    schema = "dt date, from_ccy string, to_ccy string, adj_close double"
    rows = [(D(2020, 1, 1), "USD", "EUR", 0.9), (D(2020, 1, 1), "USD", "EUR", 0.8), (D(2020, 1, 1), "USD", "EUR", None)]
    req = spark.createDataFrame([("USD", D(2020, 1, 7))], "currency string, rate_req_dt date")
    got = {valuation.fx_rate(spark.createDataFrame(r, schema).coalesce(1), req).first().rate for r in (rows, rows[::-1])}
    assert got == {0.9}


def test_zero_weight_sum_gives_null(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 0.0), (2, 1.0)], "scenario_id long, weight double")
    got = sorted((r.scenario_id, r.weight) for r in form.normalize_weights(df, ["scenario_id"]).collect() if r.weight is not None)
    assert got == [(2, 1.0)]


def test_portfolio_without_a_complete_date_has_a_row(spark):
    from basketry.operators import risk
    d = [D(2020, 1, k) for k in range(1, 6)]
    flong = spark.createDataFrame([("A", d[0], 5, 1.0), ("A", d[1], 5, 2.0), ("B", d[2], 5, 1.0), ("C", d[0], 5, 1.0), ("C", d[1], 5, 3.0)],
                                  "symbol string, dt date, win int, ror double")
    scen = spark.createDataFrame([(1, d[4], 5)], "scenario_id long, formation_date date, win int")
    ports = spark.createDataFrame([(1, 0, "A", 0.5), (1, 0, "B", 0.5), (1, 1, "A", 0.5), (1, 1, "C", 0.5), (1, 2, "Z", 1.0)],
                                  "scenario_id long, portfolio_id long, symbol string, weight double")
    got = {r.portfolio_id: (r.variance, r.n_dates) for r in risk.portfolio_variance(ports, scen, flong, ["scenario_id", "portfolio_id"]).collect()}
    assert got == {0: (None, 0), 1: (1.125, 2), 2: (None, 0)}
    cov = risk.covariance_matrix(ports, scen, flong, ["scenario_id", "portfolio_id"]).collect()
    assert {(r.portfolio_id, r.symbol_i, r.symbol_j): r["cov"] for r in cov} == {
        (1, "A", "A"): 0.5, (1, "A", "C"): 1.0, (1, "C", "A"): 1.0, (1, "C", "C"): 2.0}


def test_repeats_have_ids_of_their_own(spark):
    from basketry.operators.backtest import repeat_scenarios
    s = spark.createDataFrame([(1, 42), (2, 42)], "scenario_id long, seed long")
    r = repeat_scenarios(s, 150)
    assert r.select("scenario_id").distinct().count() == 300


def test_regimes_start_on_their_first_formation_date(spark):
    from basketry.operators.backtest import regime_dates, regime_scenarios
    days = [D(2020, 1, 1), D(2020, 1, 8), D(2020, 6, 1), D(2021, 3, 1)]
    s = spark.createDataFrame([(i, x) for i, x in enumerate(days)], "scenario_id long, formation_date date")
    g = spark.createDataFrame([("a", D(2020, 1, 2), D(2020, 2, 15)), ("b", D(2020, 5, 1), D(2020, 6, 30)), ("none", D(2019, 1, 1), D(2019, 2, 1))],
                              "regime string, start_date date, end_date date")
    r = regime_scenarios(s, g)
    assert sorted((x.regime, x.scenario_id) for x in r.collect()) == [("a", 1), ("b", 2)]
    assert sorted(x.end_date for x in regime_dates(r).filter("scenario_id = 1").collect()) == [D(2020, 1, 15), D(2020, 1, 22), D(2020, 2, 8), D(2020, 2, 15)]


def test_overlapping_regimes_keep_all_their_rows(spark):
    from basketry.operators import backtest, formation
    from basketry.plans.context import Ctx
    from conftest import SF001
    ctx = Ctx(spark, SF001, windows=(20, 60))
    year, half = ("a year", D(1998, 1, 2), D(1998, 12, 31)), ("half", D(1998, 1, 2), D(1998, 6, 30))

    def run(*regimes):
        s = backtest.regime_scenarios(ctx.scenarios, spark.createDataFrame(regimes, "regime string, start_date date, end_date date"))
        return sorted(map(tuple, backtest.regime_backtest(formation.buy_and_hold(ctx.scenarios, ctx.flong), s, ctx.prices, ctx.fx).collect()))

    both = run(year, half)
    assert {r[0] for r in both} == {"a year", "half"}
    assert both == sorted(run(year) + run(half))


def test_downloader_files(spark):
    d = tempfile.mkdtemp(prefix="basketry-dl-")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("Date;Open;High;Low;Close;Adj Close;Volume;Symbol\n")
        f.write("2020-01-02;1;1;1;1;1.5;10;EDP.LS\n2020-01-02;1;1;1;1;1.5;10;XXX.LS\n2020-01-03;1;1;1;1;bad;10;EDP.LS\n2020-01-04;1;1\n")
    listing = spark.createDataFrame([("EDP.LS", "PSI20", "EUR")], "symbol string, index_name string, currency string")
    good = csvsrc.read_downloader_csv(spark, d, listing).collect()
    assert [(r.symbol, r.index_name, r.currency, r.adj_close) for r in good] == [("EDP.LS", "PSI20", "EUR", 1.5)]
    bad = sorted(r.line for r in csvsrc.downloader_rejects(spark, d, listing).collect())
    assert len(bad) == 3 and bad[0].startswith("2020-01-02") and "XXX.LS" in bad[0]


def test_writes_are_whole_and_never_doubled(spark):
    import pytest
    from basketry.sources import parquet as pq
    from basketry.sources import sinks
    base = tempfile.mkdtemp(prefix="basketry-w-")
    rows = _prices(spark, [("A", D(2020, 1, 1), 1.0, 1, "I", "EUR"), ("A", D(2021, 1, 1), 2.0, 1, "I", "EUR")])
    pq.write_panel_parquet(rows, f"{base}/panel")
    assert pq.panel_or_build(spark, f"{base}/panel", None).count() == 2
    os.rename(f"{base}/panel/_SUCCESS", f"{base}/panel/_LATER")
    with pytest.raises(RuntimeError, match="incomplete"):
        pq.panel_or_build(spark, f"{base}/panel", None)
    sinks.write_portfolios(rows, f"{base}/out", "r1")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        sinks.write_portfolios(rows, f"{base}/out", "r1")
    sinks.write_portfolios(rows, f"{base}/out", "r2")


def test_duplicate_rows_are_counted(spark):
    rows = _prices(spark, [("A.X", D(2020, 1, 1), 1.0, 1, "I", "EUR")] * 3 + [("B", D(2020, 1, 1), 1.0, 1, "I", "EUR")])
    assert [(r.symbol, r.n_removed) for r in feat.duplicate_rows(rows).collect()] == [("A_X", 2)]


def test_universe_numbers_are_gapless(spark):
    ctx = __import__("basketry.plans.context", fromlist=["Ctx"]).Ctx(spark, "/root/testdata/sf0.001", windows=(60,))
    got = slicing.indexed_universe(ctx.scenarios, ctx.flong).groupBy("dt", "win").agg(
        F.min("pos").alias("a"), F.max("pos").alias("b"), F.countDistinct("pos").alias("n"), F.max("m").alias("m")).collect()
    assert got and all(r.a == 0 and r.b == r.n - 1 and r.n == r.m for r in got)
