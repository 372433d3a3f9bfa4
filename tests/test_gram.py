"""Blocked Gram products against numpy, with portfolios of one block, of several and with gaps."""
import datetime

import numpy as np
import pytest

from basketry.operators import risk

KEYS = ["scenario_id", "portfolio_id"]
START = datetime.date(2020, 1, 1)


def _panel(spark, holdings, dates, gaps=()):
    rng = np.random.default_rng(3)
    values = {(s, d): float(rng.normal()) + 1e6 * (s == "S001") for s in holdings for d in range(dates)}
    values |= {("S002", d): 0.1 for d in range(dates)}  # a constant series
    rows = [(s, START + datetime.timedelta(days=d), 252, None if (s, d) in gaps else x) for (s, d), x in values.items()]
    flong = spark.createDataFrame(rows, "symbol string, dt date, win int, ror double")
    scen = spark.createDataFrame([(1, START + datetime.timedelta(days=dates), 252)], "scenario_id long, formation_date date, win int")
    ports = spark.createDataFrame([(1, 0, s, 1 / len(holdings)) for s in holdings], "scenario_id long, portfolio_id long, symbol string, weight double")
    return values, flong, scen, ports


@pytest.mark.parametrize("n, dates", [(3, 12), (32, 9), (70, 40)])
def test_matrices_of_one_and_of_several_blocks(spark, n, dates):
    names = [f"S{i:03d}" for i in range(n)]
    gaps = {("S000", 3), ("S001", 5)}
    values, flong, scen, ports = _panel(spark, names, dates, gaps)
    whole = [d for d in range(dates) if not any((s, d) in gaps for s in names)]
    r = np.array([[values[s, d] for d in whole] for s in names])
    cov, at = np.cov(r), {s: i for i, s in enumerate(names)}
    got = risk.covariance_matrix(ports, scen, flong, KEYS).collect()
    assert len(got) == n * n and len({(x.symbol_i, x.symbol_j) for x in got}) == n * n
    assert all(x["cov"] == pytest.approx(cov[at[x.symbol_i], at[x.symbol_j]], abs=1e-6) for x in got)
    for x in risk.correlation_matrix(ports, scen, flong, KEYS).collect():
        if "S002" in (x.symbol_i, x.symbol_j):
            assert x["corr"] is None
        else:
            i, j = at[x.symbol_i], at[x.symbol_j]
            assert x["corr"] == pytest.approx(cov[i, j] / np.sqrt(cov[i, i] * cov[j, j]), abs=1e-6)


def test_one_complete_date_has_no_covariance(spark):
    _, flong, scen, ports = _panel(spark, ["S000", "S003"], 1)
    got = risk.covariance_matrix(ports, scen, flong, KEYS).collect()
    assert len(got) == 4 and all(x["cov"] is None for x in got)


def test_pairs_and_dates_do_not_meet_in_rows(spark):
    _, flong, scen, ports = _panel(spark, [f"S{i:03d}" for i in range(40)], 6)
    blocks = risk.return_blocks(risk.holding_returns(ports, scen, flong, KEYS), KEYS).collect()
    assert sorted((b.block, len(b.vectors)) for b in blocks) == [(0, 32), (1, 8)]
    plan = risk.covariance_matrix(ports, scen, flong, KEYS)._jdf.queryExecution().optimizedPlan().toString()
    assert "covar_samp" not in plan and "dt#" not in plan
