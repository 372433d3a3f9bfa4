"""Per-run inputs of the registered queries: fixture tables, features, scenarios."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.features import asset_features
from basketry.plans.scenarios import GRID_WINDOWS, scenario_grid
from basketry.session import StoredTables, scratch_path, stage, stage_scratch
from basketry.sources import fixtures
from basketry.sources.parquet import read_long_panel, write_long_panel


# Feature panel, its long form and FX of each (application, data folder), built once and read by every query of the
# session as long as the tables of the folder stay as they are.
_STORED = StoredTables()


class Ctx:
    """Inputs of one (session, data folder): raw tables as plans, and the feature
    panel, FX and scenarios as stored Parquet tables, so that a query that uses
    them in several places scans files and never rebuilds the panel."""

    def __init__(self, spark: SparkSession, sf_dir: str, features: DataFrame | None = None, windows=GRID_WINDOWS, **scenario_overrides):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.windows = windows
        self.scenario_overrides = scenario_overrides
        self._own_features = features is not None
        if features is not None:
            self.__dict__["features"] = features

    def _stored(self, name: str, build) -> DataFrame:
        return _STORED.get(self.spark, self.sf_dir, name, lambda path: stage(build(), path))

    @cached_property
    def panel_raw(self) -> DataFrame:
        return fixtures.panel_raw(self.spark, self.sf_dir)

    @cached_property
    def panel(self) -> DataFrame:
        return fixtures.panel(self.spark, self.sf_dir)

    @cached_property
    def fx(self) -> DataFrame:
        return self._stored("fx", lambda: fixtures.fx(self.spark, self.sf_dir))

    @cached_property
    def prices(self) -> DataFrame:
        """Cleaned, de-duplicated prices (symbol, dt, adj_close, volume, index_name, currency):
        the base columns of the feature panel."""
        return self.features.select("symbol", "dt", "adj_close", "volume", "index_name", "currency")

    @cached_property
    def features(self) -> DataFrame:
        return self._stored("features", lambda: asset_features(self.panel))

    @cached_property
    def flong(self) -> DataFrame:
        """The long panel, stored by (win, year)."""
        def build(path):
            write_long_panel(self.features, path)
            return read_long_panel(self.spark, path)
        if self._own_features:
            return build(scratch_path(self.spark, "flong"))
        return _STORED.get(self.spark, self.sf_dir, "flong", build)

    @cached_property
    def scenarios(self) -> DataFrame:
        return stage_scratch(scenario_grid(self.features, self.windows, **self.scenario_overrides), "scenarios")


def rounded(df: DataFrame, spec: dict[str, int]) -> DataFrame:
    """Round the named double columns (final outputs only)."""
    return df.select(*[F.round(F.col(c), spec[c]).alias(c) if c in spec else F.col(c) for c in df.columns])


def sql_rounded(cols: list[str], spec: dict[str, int], src: str) -> str:
    sel = ", ".join(f"round({c}, {spec[c]}) as {c}" if c in spec else c for c in cols)
    return f"select {sel} from {src}"
