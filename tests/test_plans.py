"""Physical plan shapes that matter at scale."""
import re

import pytest

import __spark_entry__ as E
from basketry.operators import features as feat
from basketry.operators import formation as form
from basketry.plans.context import Ctx
from basketry.sources import fixtures
from conftest import SF001

# Queries whose construction has no side effect (no writes, no lineage cuts).
PURE = ["asset_features", "features_long", "formation_slice", "top_k", "buy_and_hold", "normalize_weights",
        "portfolio_variance", "covariance_matrix", "quadratic_form", "lookback_slice", "allocate_shares",
        "asof_price", "fx_rate", "shares_value", "roi_horizons", "portfolio_summary", "random_unconstrained",
        "random_constrained", "init_population", "sample_rows", "value_in_usd"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PURE)
def test_no_cartesian_or_nested_loop_join(spark, name):
    p = _plan(E.queries()[name](spark, SF001))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_feature_windows_share_one_exchange(spark):
    """18 window columns: one exchange on symbol (plus the duplicate collapse on (symbol, dt))."""
    p = _plan(feat.asset_features(fixtures.panel(spark, SF001)))
    assert len(re.findall(r"Exchange hashpartitioning\(symbol#\d+, \d+\)", p)) == 1, p
    assert len(re.findall(r"Exchange hashpartitioning\(symbol#\d+, dt#\d+, \d+\)", p)) == 1, p


def test_top_k_limits_before_the_shuffle(spark):
    """The group limit runs in each task below the exchange, and again above it."""
    ctx = Ctx(spark, SF001, windows=(60,), n_assets=5)
    u = ctx.flong.repartition(4).filter("mean is not null")
    top = _plan(u.transform(lambda d: __import__("basketry.operators.slicing", fromlist=["top_k"]).top_k(d, ["dt", "win"], [d["mean"].desc(), d["symbol"]], 5)))
    final, partial = top.index("WindowGroupLimit"), top.rindex("WindowGroupLimit")
    assert final < top.index("Exchange hashpartitioning(dt") < partial


def test_no_task_numbers_a_whole_universe(spark):
    ctx = Ctx(spark, SF001, windows=(60,), n_assets=5)
    from basketry.operators.slicing import indexed_universe
    windows = re.findall(r"Window \[(.*?)\], \[(.*?)\]", _plan(indexed_universe(ctx.scenarios, ctx.flong)))
    numbering = [part for what, part in windows if "row_number" in what]
    assert numbering and all("bucket" in part for part in numbering)


# Most scans of stored tables and most exchanges that each plan may have (before run-time reuse of equal stages).
BOUNDS = {"roi_horizons": (6, 12), "portfolio_summary": (12, 24), "correlation_matrix": (6, 12), "portfolio_variance": (6, 12)}


@pytest.mark.parametrize("name", BOUNDS)
def test_plans_scan_stored_tables_and_stay_small(spark, name):
    p = _plan(E.queries()[name](spark, SF001))
    scans, exchanges = len(re.findall(r"FileScan parquet", p)), len(re.findall(r"Exchange ", p))
    assert "lineitem" not in p and "orders" not in p      # the panel is read, not rebuilt
    assert scans <= BOUNDS[name][0] and exchanges <= BOUNDS[name][1], (scans, exchanges)
