"""Runs that are broken off: writes that were never committed, searches that go on."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from basketry.operators import search
from basketry.plans.context import Ctx
from basketry.sources import sinks
from conftest import SF001

SCHEMA = "scenario_id bigint, symbol string, weight double"


def _rows(spark):
    return spark.createDataFrame([(1, "A", 0.5), (1, "B", 0.5), (2, "A", 1.0)], SCHEMA)


def test_a_broken_write_is_invisible_and_its_run_id_free(spark):
    path = tempfile.mkdtemp(prefix="basketry-runs-") + "/out"
    broken = _rows(spark).withColumn("weight", F.when(F.col("scenario_id") == 2, F.raise_error(F.lit("killed"))).otherwise(F.col("weight")))
    with pytest.raises(Exception, match="killed"):
        sinks.write_portfolios(broken, path, "r1")
    # one that wrote all its rows, but no manifest
    _rows(spark).write.partitionBy("scenario_id").csv(f"{path}/attempts/{0:020d}-left")
    assert sinks.committed_runs(spark, path).count() == 0
    with pytest.raises(FileNotFoundError):
        sinks.read_run(spark, path, "r1", SCHEMA)
    sinks.write_portfolios(_rows(spark), path, "r1")
    got = sinks.read_run(spark, path, "r1", SCHEMA)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, _rows(spark).collect()))
    assert f"{0:020d}-left" in sinks.remove_unfinished(spark, path, older_than_s=0)
    assert sinks.read_run(spark, path, "r1", SCHEMA).count() == 3


def test_runs_lie_in_a_folder_a_scenario(spark):
    path = tempfile.mkdtemp(prefix="basketry-runs-") + "/out"
    sinks.write_portfolios(_rows(spark), path, "r1")
    sinks.write_portfolios(_rows(spark).limit(0), path, "empty")
    assert sinks.read_run(spark, path, "empty", SCHEMA).count() == 0
    one = sinks.read_run(spark, path, "r1", SCHEMA).filter("scenario_id = 2")
    assert "PartitionFilters: [isnotnull(scenario_id" in one._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert {os.path.basename(os.path.dirname(f)) for f in one.inputFiles()} >= {"scenario_id=2"} and one.count() == 1


def test_the_writer_that_began_first_holds_the_run(spark):
    path = tempfile.mkdtemp(prefix="basketry-runs-") + "/out"
    sinks.write_portfolios(_rows(spark), path, "r1")
    held = sinks.committed_runs(spark, path).first()["attempt"]
    spark.range(1).select(F.lit("r1").alias("run_id"), F.lit("9" * 20 + "-late").alias("attempt")).write.mode("append").parquet(f"{path}/manifest")
    assert [tuple(r) for r in sinks.committed_runs(spark, path).collect()] == [("r1", held)]


def test_a_search_goes_on_from_its_last_whole_generation(spark, monkeypatch):
    ctx = Ctx(spark, SF001, windows=(60,), n_assets=5, generations=3, pop_size=6)
    some = ctx.scenarios.filter(F.col("formation_date") >= "1998-01-01")
    best, pop, hist = search.evolve(some, ctx.flong)
    run_dir = tempfile.mkdtemp(prefix="basketry-search-") + "/run"
    whole, step = [], search.generation_step

    def broken(pop, fit, scenarios, iu, generation, cut):
        if generation == 2 and not whole:
            whole.append(generation)
            raise RuntimeError("killed")
        return step(pop, fit, scenarios, iu, generation, cut)
    monkeypatch.setattr(search, "generation_step", broken)
    with pytest.raises(RuntimeError, match="killed"):
        search.evolve(some, ctx.flong, run_dir=run_dir)
    again = []
    monkeypatch.setattr(search, "generation_step", lambda *a, **k: (again.append(a[4]), step(*a, **k))[1])
    best2, pop2, hist2 = search.evolve(some, ctx.flong, run_dir=run_dir)
    assert again == [2]

    def rows(df):
        return sorted(map(repr, df.drop("runtime_s").collect()))
    assert rows(best) and rows(best) == rows(best2) and rows(pop) == rows(pop2) and rows(hist) == rows(hist2)
    with pytest.raises(ValueError, match="other scenarios"):
        search.evolve(some.withColumn("seed", F.col("seed") + 1), ctx.flong, run_dir=run_dir)
