"""Schemas of the input tables and checks on them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Raw detections as text: everything is cast later, bad values become null.
DETECTION_COLUMNS = (
    "latitude", "longitude", "bright_ti4", "bright_ti5", "scan", "track", "acq_date", "acq_time", "satellite",
    "instrument", "version", "confidence", "frp", "daynight", "type", "product", "source_id",
)
RAW_TEXT = T.StructType([T.StructField(c, T.StringType()) for c in DETECTION_COLUMNS])

#: Target names of the raw columns.
RENAMED = {
    "bright_ti4": "brightness", "bright_ti5": "bright_t31", "acq_date": "date", "acq_time": "time", "type": "firms_type",
}

STANDARD = T.StructType([
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
    T.StructField("brightness", T.DoubleType()), T.StructField("bright_t31", T.DoubleType()),
    T.StructField("date", T.DateType()), T.StructField("time", T.StringType()),
    T.StructField("satellite", T.StringType()), T.StructField("confidence", T.StringType()),
    T.StructField("frp", T.DoubleType()), T.StructField("daynight", T.StringType()),
    T.StructField("firms_type", T.IntegerType()), T.StructField("product", T.StringType()),
    T.StructField("source_id", T.LongType()),
])

#: Model inputs in their order.
FEATURES = (
    "brightness", "bright_t31", "frp", "confidence_score", "log_frp", "thermal_excess", "hour", "month", "day_of_year",
    "is_night", "hotspot_count_7d", "active_days_7d", "hotspot_count_30d", "active_days_30d", "persistence_ratio_7d",
    "persistence_ratio_30d", "persistent_source_flag", "high_persistence_flag", "daily_total_frp", "daily_max_brightness",
    "daily_mean_confidence", "frp_per_detection_30d", "persistence_score", "night_fire_flag", "persistent_activity",
    "high_frp_flag", "low_persistence_flag",
)


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The same table, or a ValueError that lists the columns it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_contract(df: DataFrame, features: Iterable[str] = FEATURES) -> DataFrame:
    """All model inputs are there and numeric."""
    require_columns(df, features)
    kinds = dict(df.dtypes)
    text = [f for f in features if not isinstance(df.schema[f].dataType, T.NumericType)]
    if text:
        raise ValueError("not numeric: " + ", ".join(f"{f} ({kinds[f]})" for f in text))
    return df


def standardize_columns(df: DataFrame, mapping: dict[str, str] = RENAMED) -> DataFrame:
    """Names trimmed, in lower case, with underscores; then renamed."""
    df = df.toDF(*(c.strip().lower().replace(" ", "_") for c in df.columns))
    return df.withColumnsRenamed(mapping)


def align_schema(df: DataFrame, schema: T.StructType = STANDARD) -> DataFrame:
    """Missing columns become null, others are cast; what can't be cast becomes null, NaN too."""
    out = []
    for f in schema:
        if f.name not in df.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = F.col(f.name).try_cast(f.dataType)
        if isinstance(f.dataType, T.IntegralType) and isinstance(df.schema[f.name].dataType, T.StringType):
            c = F.col(f.name).try_cast("double").try_cast(f.dataType)
        if isinstance(f.dataType, T.DoubleType):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)
