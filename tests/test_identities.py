"""Identities between operators."""
from pyspark.sql import functions as F

from basketry.operators import formation as form
from basketry.operators import risk, valuation
from basketry.plans.context import Ctx
from conftest import SF001

PK = ["scenario_id", "portfolio_id"]


def test_variance_equals_quadratic_form(spark):
    ctx = Ctx(spark, SF001, n_assets=5)
    p = form.buy_and_hold(ctx.scenarios, ctx.flong)
    v = risk.portfolio_variance(p, ctx.scenarios, ctx.flong, PK).select(*PK, F.col("variance").alias("v1"))
    q = risk.quadratic_form(p, risk.covariance_matrix(p, ctx.scenarios, ctx.flong, PK), PK).select(*PK, F.col("variance").alias("v2"))
    rows = v.join(q, PK).filter(F.col("v1").isNotNull()).collect()
    assert rows
    for r in rows:
        assert abs(r.v1 - r.v2) <= 1e-9 * max(1.0, abs(r.v1))


def test_roi_at_start_without_fee_is_zero(spark):
    ctx = Ctx(spark, SF001, n_assets=5, fee=0)
    p = form.buy_and_hold(ctx.scenarios, ctx.flong)
    ends = ctx.scenarios.select("scenario_id", F.col("formation_date").alias("end_date"))
    r = valuation.portfolio_roi(p, ctx.scenarios, ctx.prices, ctx.fx, ends).filter(F.col("roi").isNotNull())
    assert r.count() > 0
    assert r.filter(F.abs("roi") > 1e-12).count() == 0


def test_equal_weight_return_is_mean_of_means(spark):
    ctx = Ctx(spark, SF001, n_assets=5)
    p = form.buy_and_hold(ctx.scenarios, ctx.flong)
    r = risk.portfolio_return(p, PK)
    m = p.groupBy(*PK).agg((F.sum("mean") / 5.0).alias("m"))
    for row in r.join(m, PK).collect():
        assert abs(row.ret - row.m) < 1e-9


def test_buy_and_hold_whole_universe_is_universe_mean(spark):
    ctx = Ctx(spark, SF001, n_assets=100)
    p = form.buy_and_hold(ctx.scenarios, ctx.flong)
    got = p.groupBy("scenario_id").agg(F.count("*").alias("k"), F.sum(F.col("weight") * F.col("mean")).alias("ret"))
    from basketry.operators.slicing import formation_slice
    uni = formation_slice(ctx.scenarios, ctx.flong).groupBy("scenario_id").agg(
        F.count("*").alias("k"), (F.sum("mean") / 100.0).alias("ret"))
    a = sorted((r.scenario_id, r.k, round(r.ret, 9)) for r in got.collect())
    b = sorted((r.scenario_id, r.k, round(r.ret, 9)) for r in uni.collect())
    assert a == b
