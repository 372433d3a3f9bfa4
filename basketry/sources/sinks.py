"""Result sinks: portfolios and search statistics, one committed write per run.

Layout below the sink's folder: ``attempts/<attempt>/scenario_id=<id>/*.csv``,
one attempt a write, and ``manifest/``, a table of (run_id, attempt) with one
row a run.  The manifest's row is written last and readers go by the manifest,
so a write that is broken off is never read and its run id stays free.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basketry.session import list_names, path_exists, remove_path

MANIFEST = "run_id string, attempt string"


def committed_runs(spark: SparkSession, path: str) -> DataFrame:
    """run_id, attempt of the whole runs of a sink.  Of two writers that raced for one id, the one that began first holds it."""
    path = path.rstrip("/")
    if not path_exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").groupBy("run_id").agg(F.min("attempt").alias("attempt"))


def _attempt(spark: SparkSession, path: str, run_id: str) -> str | None:
    row = committed_runs(spark, path).filter(F.col("run_id") == F.lit(run_id)).first()
    return row["attempt"] if row else None


def _write_run(rows: DataFrame, path: str, run_id: str) -> None:
    """CSV with header, a folder a scenario; a run id that is there already is an error, as rows would double.

    Rebalanced by scenario at run time: a scenario gets as many files as its
    rows need, not one a task."""
    spark, path = rows.sparkSession, path.rstrip("/")
    if _attempt(spark, path, run_id) is not None:
        raise FileExistsError(f"run {run_id} already exists in {path}")
    attempt = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    by = [c for c in ("scenario_id",) if c in rows.columns]
    out = rows.hint("rebalance", *by) if by else rows
    out.write.mode("errorifexists").partitionBy(*by).option("header", "true").csv(f"{path}/attempts/{attempt}")
    done = spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(attempt).alias("attempt"))
    done.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    if _attempt(spark, path, run_id) != attempt:
        raise FileExistsError(f"run {run_id} already exists in {path}: another writer began it first")


def read_run(spark: SparkSession, path: str, run_id: str, schema: str) -> DataFrame:
    """The rows of one committed run; a filter on scenario_id reads that scenario's folder alone."""
    attempt = _attempt(spark, path, run_id)
    if attempt is None:
        raise FileNotFoundError(f"no committed run {run_id} in {path}")
    rows = spark.read.option("header", "true").schema(schema).csv(f"{path.rstrip('/')}/attempts/{attempt}")
    return rows.select(*StructType.fromDDL(schema).fieldNames())


def remove_unfinished(spark: SparkSession, path: str, older_than_s: float = 7 * 86_400) -> list[str]:
    """Remove the attempts that began so long ago and that no manifest row names; returns them.

    The age keeps writes that are still under way."""
    path = path.rstrip("/")
    kept = {r["attempt"] for r in committed_runs(spark, path).collect()}
    latest = f"{max(0, time.time_ns() - int(older_than_s * 1e9)):020d}"
    old = [a for a in list_names(spark, f"{path}/attempts") if a not in kept and a < latest]
    for a in old:
        remove_path(spark, f"{path}/attempts/{a}")
    return old


def write_portfolios(portfolios: DataFrame, path: str, run_id: str) -> None:
    """All scenarios' portfolios of one run.  A run id replaces the reference's
    probe-for-a-free-file-name loop; like there, a used name is never written to."""
    _write_run(portfolios, path, run_id)


def write_run_stats(history: DataFrame, path: str, run_id: str, total_s: float) -> None:
    """(scenario_id, generation, best_fitness, runtime_s, total_s) of one run."""
    _write_run(history.withColumn("total_s", F.lit(float(total_s))), path, run_id)
