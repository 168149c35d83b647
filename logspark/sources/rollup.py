"""Counts by hour, severity and source, kept beside the stored log table.

The rollup is a side table (``sources.side``): it follows batch and stream
writers, deletes and retention alike.  ``rolled`` puts it in the place of the
logs: one row for each hour, severity and source with its number of logs, and
the logs themselves only for the hours that a point in time cuts in two.  The
statistics of ``operators.stats`` take such rows as they take logs (F1-F10).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions import normalize as N
from logspark.functions.formatting import month_ago_value, parse_as_of, trunc_ntz
from logspark.operators.stats import WEIGHT
from logspark.sources.side import Side, read
from logspark.sources.store import read_logs


def _hour_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("log_date", "batch", trunc_ntz("created_at", "hour").alias("created_at"),
                        N.effective_severity().alias("severity"), "source").agg(F.count(F.lit(1)).alias(WEIGHT))


ROLLUP = Side("hours", f"created_at timestamp_ntz, severity string, source string, {WEIGHT} bigint", _hour_counts)


def day_ago(as_of) -> list[_dt.datetime]:
    """The point that F2 and F5 count from."""
    return [parse_as_of(as_of) - _dt.timedelta(hours=24)]


def bucket_bounds(as_of) -> list[_dt.datetime]:
    """The points between the age buckets (F9), and the one of F2."""
    now = parse_as_of(as_of)
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    return [now, midnight, midnight - _dt.timedelta(days=1), now - _dt.timedelta(days=7), month_ago_value(now), *day_ago(as_of)]


def rolled(spark: SparkSession, path: str, points: list[_dt.datetime] | tuple = ()) -> DataFrame:
    """Rows that count like the logs of a store in any statistic over created_at,
    severity and source that tells times apart only at ``points``."""
    cols = ("created_at", "severity", F.lit(None).cast("string").alias("derived_severity"), "source", "log_date")
    hours = read(spark, path, ROLLUP).select(*cols, WEIGHT)
    cut = sorted({p.replace(minute=0, second=0, microsecond=0) for p in points if (p.minute, p.second, p.microsecond) != (0, 0, 0)})
    if not cut:
        return hours
    logs = read_logs(spark, path)
    inside = None
    for h in cut:   # at most one hour a point: its day is read, of it the row groups of the hour
        own = (F.col("log_date") == F.lit(h.date())) & (F.col("created_at") >= F.lit(str(h)).cast("timestamp_ntz")) \
            & (F.col("created_at") < F.lit(str(h + _dt.timedelta(hours=1))).cast("timestamp_ntz"))
        inside = own if inside is None else inside | own
    rows = logs.filter(inside).select("created_at", N.effective_severity().alias("severity"), *cols[2:], F.lit(1).cast("bigint").alias(WEIGHT))
    whole = ~F.coalesce(F.col("created_at").isin(*[F.lit(str(h)).cast("timestamp_ntz") for h in cut]), F.lit(False))
    return hours.filter(whole).unionByName(rows)
