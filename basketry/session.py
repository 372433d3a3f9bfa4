"""Session helpers: local test session, the shared checkpoint folder, scratch paths."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every run wants; cluster-size settings (executor memory, shuffle
# partitions at scale) belong to the deployment, AQE re-plans at run time.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "basketry", extra: dict | None = None) -> SparkSession:
    """A session for tests and the bench.  On a cluster, use the cluster's session."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("BASKETRY_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must name a shared, reliable folder (HDFS, S3,
    ...).  Only a local-mode session without the setting gets a fresh
    folder of its own, as in tests.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder for lineage cuts")
        d = tempfile.mkdtemp(prefix="basketry-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for written intermediate tables, under the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/basketry-scratch/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, path: str) -> DataFrame:
    """``df`` written once as Parquet at ``path`` and read back: a lineage cut
    with column pruning and statistics, on files that every executor sees."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_scratch(df: DataFrame, name: str) -> DataFrame:
    return stage(df, scratch_path(df.sparkSession, name))


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through its Hadoop file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """(name, modification time, bytes, files) of what lies in a folder: changes when a table in it is replaced or grows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for status in fs.listStatus(p):
        held = fs.getContentSummary(status.getPath())
        out.append((status.getPath().getName(), status.getModificationTime(), held.getLength(), held.getFileCount()))
    return tuple(sorted(out))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through the Hadoop file system of the path (HDFS, S3, local)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, through its Hadoop file system; none if there is no such folder."""
    if not path_exists(spark, path):
        return []
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(s.getPath().getName() for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p))


class StoredTables:
    """Results kept for a session, each valid as long as the inputs that it was made of stay as they are.

    A result is a folder of Parquet tables and what is read from it.  It is
    rebuilt when the fingerprint of the input folder has changed or its own folder
    is gone; the folder of the outdated one is removed.
    """

    def __init__(self):
        self._kept: dict[tuple, tuple] = {}

    def get(self, spark: SparkSession, inputs: str, name: str, build):
        """``build(path)`` writes below ``path`` and returns the result."""
        key = (spark.sparkContext.applicationId, inputs.rstrip("/"), name)
        now = fingerprint(spark, inputs)
        if key in self._kept:
            made_of, path, result = self._kept[key]
            if made_of == now and path_exists(spark, path):
                return result
            remove_path(spark, path)
        path = scratch_path(spark, name)
        result = build(path)
        self._kept[key] = (now, path, result)
        return result
