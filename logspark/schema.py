"""Fixed schemas (no inference anywhere)."""

from __future__ import annotations

from pyspark.sql import types as T

HEADER = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("color", T.StringType()),
    T.StructField("description", T.StringType()),
])

# Nested ingest record {header: {...}, body: {...}}.  ``body`` is declared a
# STRING so the JSON reader keeps the raw object text for later parsing.
RAW_NESTED = T.StructType([
    T.StructField("header", HEADER),
    T.StructField("body", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

# Flat ingest record (title + flags + body JSON text).
RAW_FLAT = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("color", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

# Stored, enriched logs.  created_at is a wall-clock UTC TIMESTAMP_NTZ so no
# result depends on the session time zone; log_date is the partition key.
LOGS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("title", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("source", T.StringType()),
    T.StructField("color", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("derived_severity", T.StringType()),
    T.StructField("derived_source", T.StringType()),
    T.StructField("derived_category", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("log_date", T.DateType()),
])

LOG_COLUMNS = [f.name for f in LOGS.fields]
