"""Filtered search, ordering, paging and record views.

Filters are plain ``Column`` predicates so Catalyst pushes equality / range
tests into the Parquet scan; date bounds also add the implied ``log_date``
bound so partition pruning applies (the optimizer cannot infer it from
``created_at``).  Pages are top-k (TakeOrderedAndProject): each task keeps
offset + limit rows, nothing is fully sorted.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions import normalize as N
from logspark.functions.analyze import escaped_json
from logspark.functions.formatting import as_timestamp


def newest_first_order() -> tuple[Column, Column]:
    """created_at descending, id descending (the id tie-break is ours)."""
    return F.col("created_at").desc(), F.col("id").desc()


@dataclass(frozen=True)
class LogFilter:
    """E1-E6; empty string or None means 'no filter' for every field."""

    search: str | None = None
    severity: str | None = None
    source: str | None = None
    color: str | None = None
    from_: object | None = None
    to: object | None = None
    effective: bool = False   # severity on the effective instead of the header value


def like_contains(q: str) -> str:
    """'%q%' for (I)LIKE with the backslash escaped: it is Spark's default
    escape character, while % and _ keep acting as wildcards."""
    return "%" + q.replace("\\", "\\\\") + "%"


def search_predicate(q: str) -> Column:
    """Case-insensitive substring (with wildcards) over title,
    description or body; NULL fields never match."""
    pat = like_contains(q)
    return reduce(lambda a, b: a | b,
                  [F.coalesce(F.col(c).ilike(pat), F.lit(False)) for c in ("title", "description", "body")])


def _day(v) -> Column:
    return F.to_date(as_timestamp(v))


def predicate(f: LogFilter, has_log_date: bool = True) -> Column:
    """Conjunction of the filters that are set."""
    preds: list[Column] = []
    if f.search:
        preds.append(search_predicate(f.search))
    if f.severity:
        sev = N.effective_severity("derived_severity", "severity") if f.effective else F.col("severity")
        preds.append(sev == f.severity)
    if f.source:
        preds.append(F.col("source") == f.source)
    if f.color:
        preds.append(F.col("color") == f.color)
    if f.from_ not in (None, ""):
        preds.append(F.col("created_at") >= as_timestamp(f.from_))
        if has_log_date:
            preds.append(F.col("log_date") >= _day(f.from_))
    if f.to not in (None, ""):
        preds.append(F.col("created_at") <= as_timestamp(f.to))
        if has_log_date:
            preds.append(F.col("log_date") <= _day(f.to))
    return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)


def search(logs: DataFrame, f: LogFilter = LogFilter()) -> DataFrame:
    """Filtered logs (unordered)."""
    return logs.filter(predicate(f, "log_date" in logs.columns))


def day_filter(day) -> LogFilter:
    """One calendar day, from midnight to next midnight inclusive."""
    d = day if isinstance(day, _dt.date) else _dt.date.fromisoformat(str(day))
    start = _dt.datetime(d.year, d.month, d.day)
    return LogFilter(from_=start, to=start + _dt.timedelta(days=1))


def newest_first(df: DataFrame) -> DataFrame:
    """E9 (id tie-break is ours)."""
    return df.orderBy(*newest_first_order())


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Newest-first rows offset .. offset+limit (a top-k)."""
    ordered = newest_first(df)
    if offset > 0:
        ordered = ordered.offset(offset)
    return ordered.limit(limit)


def clamp_api(page_no: int | None, limit: int | None) -> tuple[int, int]:
    """Limit default 20, cap 100; page >= 1 -> (limit, offset)."""
    lim = limit if limit and limit > 0 else 20
    lim = min(lim, 100)
    p = page_no if page_no and page_no > 0 else 1
    return lim, (p - 1) * lim


def clamp_listing(limit: int | None, offset: int | None) -> tuple[int, int]:
    """Limit default 100, cap 1000; offset >= 0."""
    lim = limit if limit and limit > 0 else 100
    return min(lim, 1000), max(offset or 0, 0)


def page_number(df: DataFrame, page_no: int | None = 1, limit: int | None = None) -> DataFrame:
    lim, off = clamp_api(page_no, limit)
    return page(df, lim, off)


def total(df: DataFrame) -> DataFrame:
    """Matching row count (a separate aggregate; partial counts per task)."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def page_info(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """E14 + E15: one row with total, pages, shown range and the summary line."""
    t = total(df)
    shown = F.greatest(F.least(F.col("total") - F.lit(offset), F.lit(limit)), F.lit(0))
    return t.select(
        "total",
        F.lit(limit).alias("limit"),
        F.lit(offset).alias("offset"),
        (F.lit(offset // limit + 1) if limit else F.lit(1)).alias("page"),
        F.ceil(F.col("total") / F.lit(limit)).cast("bigint").alias("total_pages"),
        shown.cast("bigint").alias("shown"),
    ).withColumn(
        "summary",
        F.when((F.lit(offset) > 0) | (F.col("total") > F.col("shown")),
               F.format_string("Showing %d-%d of %d logs", F.lit(offset + 1), F.lit(offset) + F.col("shown"),
                               F.col("total"))),
    )


def lookup(logs: DataFrame, log_id: int) -> DataFrame:
    """The record with this id; an empty frame means not found."""
    return logs.filter(F.col("id") == F.lit(log_id))


def flat_view(logs: DataFrame) -> DataFrame:
    """B9 in flat form: effective severity and colour, RFC 3339 time."""
    return logs.select(
        "id", "title",
        N.effective_severity().alias("severity"),
        "source",
        N.effective_color().alias("color"),
        "description", "body",
        "derived_severity", "derived_source", "derived_category",
        N.rfc3339("created_at").alias("created_at"),
    )


def record_view(logs: DataFrame) -> DataFrame:
    """Nested record (id, header, body, metadata, created_at); NULL
    optional fields are omitted by ``to_json``."""
    return logs.select(
        "id",
        F.struct("title", N.effective_severity().alias("severity"), "source",
                 N.effective_color().alias("color"), "description").alias("header"),
        F.coalesce(F.try_parse_json("body"), F.parse_json(F.lit("{}"))).alias("body"),
        F.struct("derived_severity", "derived_source", "derived_category").alias("metadata"),
        N.rfc3339("created_at").alias("created_at"),
    )


def record_json(logs: DataFrame) -> DataFrame:
    """B9 as JSON text per record."""
    return record_view(logs).select("id", escaped_json(F.to_json(F.struct("*"))).alias("json"))


def event_columns() -> list[Column]:
    """B10 columns: the record view with empty optional fields kept as ''."""
    def e(c):
        return F.coalesce(F.col(c), F.lit(""))

    return [
        F.col("id"),
        F.struct(e("title").alias("title"), N.effective_severity().alias("severity"), e("source").alias("source"),
                 N.effective_color().alias("color"), e("description").alias("description")).alias("header"),
        F.coalesce(F.try_parse_json("body"), F.parse_json(F.lit("{}"))).alias("body"),
        F.struct(e("derived_severity").alias("derived_severity"), e("derived_source").alias("derived_source"),
                 e("derived_category").alias("derived_category")).alias("metadata"),
        N.rfc3339("created_at").alias("created_at"),
    ]


def event_view(logs: DataFrame) -> DataFrame:
    """Like the record view, but empty optional fields kept as ''."""
    return logs.select(*event_columns())


def receipt(logs: DataFrame) -> DataFrame:
    """Id, title, effective severity, created_at text."""
    return logs.select("id", "title", N.effective_severity().alias("severity"), N.rfc3339("created_at").alias("created_at"))


def list_view(logs: DataFrame) -> DataFrame:
    """Id, effective severity, source or '-', cut title, list time."""
    return logs.select(
        "id", N.effective_severity().alias("severity"),
        F.coalesce("source", F.lit("-")).alias("source"),
        N.short_title("title").alias("title"),
        N.list_time("created_at").alias("created"),
    )
