"""Stored inputs follow their tables; the long panel is read by window and year."""
import os
import shutil

from pyspark.sql import functions as F

from basketry.operators import formation as form
from basketry.operators import slicing
from basketry.plans.context import Ctx
from basketry.session import StoredTables, fingerprint, scratch_path, stage
from basketry.sources.parquet import read_long_panel, write_long_panel
from conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_replaced_table_is_read_anew(spark, tmp_path):
    src = str(tmp_path / "data")
    os.makedirs(src)
    for t in ("lineitem", "supplier", "nation", "region", "orders"):
        shutil.copy(f"{SF001}/{t}.parquet", src)
    before = Ctx(spark, src).features
    n = before.count()
    assert Ctx(spark, src).features.inputFiles() == before.inputFiles()
    some = spark.read.parquet(f"{SF001}/lineitem.parquet").where("l_suppkey <= 3").toPandas()
    some.to_parquet(f"{src}/lineitem.parquet", coerce_timestamps="us")
    after = Ctx(spark, src)
    assert 0 < after.features.count() < n and after.features.inputFiles() != before.inputFiles()
    assert after.flong.count() == 6 * after.features.count()
    assert not os.path.exists(before.inputFiles()[0].removeprefix("file://"))     # the outdated copy is gone


def test_a_result_whose_folder_is_gone_is_built_again(spark, tmp_path):
    (tmp_path / "t").write_text("x")
    kept, built = StoredTables(), []

    def build(path):
        built.append(path)
        return stage(spark.range(3), path)
    for _ in range(2):
        assert kept.get(spark, str(tmp_path), "n", build).count() == 3
    assert len(built) == 1
    shutil.rmtree(built[0].removeprefix("file:"))
    assert kept.get(spark, str(tmp_path), "n", build).count() == 3 and len(built) == 2
    was = fingerprint(spark, str(tmp_path))
    (tmp_path / "t").write_text("xy")
    assert fingerprint(spark, str(tmp_path)) != was
    kept.get(spark, str(tmp_path), "n", build)
    assert len(built) == 3 and not os.path.exists(built[1].removeprefix("file:"))


def _one(ctx):
    return ctx.scenarios.filter("win = 60 and formation_date = date'2000-06-05'")


def test_slices_filter_folders_before_anything_else(spark):
    ctx = Ctx(spark, SF001, n_assets=5)
    one = _one(ctx)
    held = form.buy_and_hold(one, ctx.flong)
    for df in (slicing.formation_slice(one, ctx.flong), held, slicing.lookback_slice(one, ctx.flong, held)):
        scans = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line and "year#" in line]
        assert scans and all("win#" in line and "60" in line and "2000" in line for line in scans)
        assert "inline" not in _plan(df)


def test_one_scenario_reads_the_files_of_its_window_and_years_alone(spark):
    """The files of all other folders are spoilt; the slices must not notice."""
    ctx = Ctx(spark, SF001, n_assets=5)
    path = scratch_path(spark, "long")
    write_long_panel(ctx.features, path)
    one = stage(_one(ctx), scratch_path(spark, "one"))
    want = [sorted(map(tuple, f(read_long_panel(spark, path)).collect())) for f in (
        lambda p: slicing.formation_slice(one, p), lambda p: form.buy_and_hold(one, p),
        lambda p: slicing.lookback_slice(one, p, form.buy_and_hold(one, p)))]
    assert all(want)
    spoilt = 0
    for folder, _, files in os.walk(path.removeprefix("file:")):
        keep = folder.endswith(("win=60/year=2000", "win=60/year=1999"))
        for f in files:
            if "win=" in folder and not keep:
                os.truncate(os.path.join(folder, f), 8)
                spoilt += 1
    assert spoilt > 20
    panel = read_long_panel(spark, path)
    got = [sorted(map(tuple, df.collect())) for df in (
        slicing.formation_slice(one, panel), form.buy_and_hold(one, panel), slicing.lookback_slice(one, panel, form.buy_and_hold(one, panel)))]
    assert got == want


def test_slices_agree_with_the_unstored_panel(spark):
    from basketry.operators.features import features_long
    ctx = Ctx(spark, SF001, n_assets=5)
    plain = features_long(ctx.features)
    a, b = (slicing.lookback_slice(ctx.scenarios, p, form.buy_and_hold(ctx.scenarios, p)).orderBy("scenario_id", "symbol", "dt").select(
        F.sum(F.xxhash64("scenario_id", "symbol", "dt", "ror").cast("decimal(38,0)")), F.count("*")).first() for p in (plain, ctx.flong))
    assert a == b
