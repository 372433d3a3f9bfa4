"""Price files arriving in a folder, appended to the stored price table.

The same load as :func:`basketry.sources.csv.read_asset_csv` (declared
schema, rejects kept apart) as a Structured Streaming file source: each
micro-batch writes good rows (partitioned by batch and year) and the rejected
lines (a side table) under its batch id.  The query checkpoint lives under the shared checkpoint folder,
so a restarted driver resumes where it stopped and files are not loaded twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.session import checkpoint_dir
from basketry.sources.csv import CSV_OPTIONS, _good, line_text
from basketry.sources.schemas import ASSET_CSV, CORRUPT


def price_stream(spark: SparkSession, src_dir: str) -> DataFrame:
    full = T.StructType(ASSET_CSV.fields + [T.StructField(CORRUPT, T.StringType())])
    return spark.readStream.schema(full).options(**CSV_OPTIONS).csv(src_dir)


def ingest_prices(spark: SparkSession, src_dir: str, table_dir: str, rejects_dir: str,
                  query_name: str = "price_ingest", available_now: bool = True):
    """Start the ingest; returns the StreamingQuery (availableNow: process what is there, then stop)."""
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/streams/{query_name}"

    def batch(df: DataFrame, batch_id: int) -> None:
        # a batch that is replayed after a failure overwrites its own folders, so nothing is there twice
        good = df.filter(_good(ASSET_CSV)).drop(CORRUPT).withColumn("year", F.year("dt").cast("int"))
        good.write.mode("overwrite").partitionBy("year").parquet(f"{table_dir.rstrip('/')}/batch_id={batch_id}")
        bad = df.filter(~_good(ASSET_CSV)).select(line_text(ASSET_CSV))
        bad.write.mode("overwrite").parquet(f"{rejects_dir.rstrip('/')}/batch_id={batch_id}")

    w = price_stream(spark, src_dir).writeStream.foreachBatch(batch).option("checkpointLocation", ckpt).queryName(query_name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
