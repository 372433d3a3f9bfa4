"""Declared schemas; nothing is inferred."""

from pyspark.sql import types as T

# Raw price rows as the CSV files hold them (volume is 64-bit: a 32-bit
# volume silently drops liquid rows).
ASSET_CSV = T.StructType([
    T.StructField("dt", T.DateType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("adj_close", T.DoubleType()),
    T.StructField("volume", T.LongType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("index_name", T.StringType()),
    T.StructField("currency", T.StringType()),
])

FX_CSV = T.StructType([
    T.StructField("dt", T.DateType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("adj_close", T.DoubleType()),
    T.StructField("volume", T.LongType()),
    T.StructField("from_ccy", T.StringType()),
    T.StructField("to_ccy", T.StringType()),
])

# The price downloader writes the price columns and the symbol only.
DOWNLOADER_CSV = T.StructType(ASSET_CSV.fields[:8])

CORRUPT = "_corrupt_record"

# Fixed values of the reference: the rolling windows (in rows) and the
# calendar days looked back for each window.
WINDOWS = [5, 10, 20, 60, 120, 252]
LOOKBACK_DAYS = {5: 8, 10: 16, 20: 31, 60: 93, 120: 183, 252: 366}
RIGHT_PAD_DAYS = 1

# Weight bounds, selection threshold, fitness mix, roulette rescale.
WEIGHT_FLOOR = 0.01
WEIGHT_CEILING = 0.25
SELECTION_THRESHOLD = 0.5
RETURN_WEIGHT = 0.75
RISK_WEIGHT = 0.25
ROULETTE_OLD = (-10000.0, 10000.0)
ROULETTE_NEW = (1.0, 10000.0)

# ROI horizons (label, calendar days after formation).
HORIZONS = [("1w", 7), ("2w", 14), ("1m", 31), ("3m", 92), ("6m", 183), ("9m", 274), ("12m", 365)]

BASE_CURRENCY = "EUR"
