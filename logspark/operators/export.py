"""Exports (I1-I4): JSON lines of record views, CSV files.

Writers are distributed (one file per task).  An export holds every matching
row; a limit is only applied when the request names one, as a top-k.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.functions import normalize as N
from logspark.operators.query import LogFilter, newest_first, page, record_json, search

FORMATS = ("csv", "json")


class ExportRequest(NamedTuple):
    format: str
    limit: int | None
    filters: LogFilter


def export_request(fmt: str, limit: int | None = None, filters: LogFilter = LogFilter()) -> ExportRequest:
    """Format must be csv or json; ``limit`` (newest rows first) is optional
    and has no upper bound."""
    if fmt not in FORMATS:
        raise ValueError(f"invalid export format: {fmt} (must be csv or json)")
    return ExportRequest(fmt, limit if limit and limit > 0 else None, filters)


def export_rows(logs: DataFrame, req: ExportRequest) -> DataFrame:
    """All matching rows, or the newest ``req.limit`` of them."""
    rows = search(logs, req.filters)
    return rows if req.limit is None else page(rows, req.limit, 0)


def csv_rows(logs: DataFrame) -> DataFrame:
    """I2 columns: id, severity (effective), source, title, description, created_at."""
    return logs.select("id", N.effective_severity().alias("severity"), F.coalesce("source", F.lit("")).alias("source"),
                       "title", F.coalesce("description", F.lit("")).alias("description"),
                       N.rfc3339("created_at").alias("created_at"))


def dashboard_csv_rows(logs: DataFrame) -> DataFrame:
    """I4 columns: ID, Timestamp, Severity, Title, Source, Description."""
    return logs.select(
        F.col("id").alias("ID"), N.rfc3339("created_at").alias("Timestamp"),
        N.effective_severity().alias("Severity"), F.col("title").alias("Title"),
        F.coalesce("source", F.lit("")).alias("Source"), F.coalesce("description", F.lit("")).alias("Description"))


def export_json(logs: DataFrame, path: str, req: ExportRequest | None = None) -> None:
    """JSON lines of record views, newest first."""
    req = req or export_request("json")
    rows = newest_first(record_json(export_rows(logs, req)))
    rows.select("json").write.mode("overwrite").text(path)


def export_csv(logs: DataFrame, path: str, req: ExportRequest | None = None) -> None:
    """CSV with header, RFC 4180 quoting."""
    req = req or export_request("csv")
    (csv_rows(export_rows(logs, req)).write.mode("overwrite")
     .option("header", True).option("escape", '"').option("emptyValue", "").csv(path))


def export_dashboard_csv(logs: DataFrame, path: str) -> None:
    """I4: every cell quoted."""
    (dashboard_csv_rows(logs).write.mode("overwrite")
     .option("header", True).option("quoteAll", True).option("escape", '"').csv(path))
