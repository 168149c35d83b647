"""Text search and deep pages on the stored log table.

A side table (``sources.side``) lists, for every file of the store, the
trigrams that the lower-cased title, description or body of its rows hold.  A
search cuts its text at the wildcards ``%`` and ``_``; a file that lacks a
trigram of what is between them holds no match and is not read.  The search
itself then runs as on any logs, so the rows are the same.  Only trigrams of
ASCII characters are used: their lower case is the same everywhere.

A page deep in the listing is found by the counts of the rollup: whole days
newer than the page are skipped, and only the days that the page touches are
read and sorted.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.operators import query as Q
from logspark.operators.stats import WEIGHT
from logspark.schema import LOG_COLUMNS, LOGS
from logspark.sources import side
from logspark.sources.rollup import ROLLUP
from logspark.sources.store import read_logs

#: All runs of three code points, one from each place.
TRIGRAM = r"(?s)(?=(...))"


def _trigrams(logs: DataFrame) -> DataFrame:
    texts = [F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TRIGRAM), 1) for c in ("title", "description", "body")]
    found = logs.select("log_date", "batch", "file", F.explode(F.array_distinct(F.flatten(F.array(*texts)))).alias("trigram"))
    return found.groupBy("log_date", "batch", "file", "trigram").agg(F.count(F.lit(1)).alias("rows"))


TRIGRAMS = side.Side("trigrams", "file string, trigram string, rows bigint", _trigrams, ("trigram",))


def trigrams_of(q: str) -> set[str]:
    """Trigrams that a text matching the search must hold."""
    pieces = re.split("[%_]", q.lower())
    return {t for p in pieces for t in (p[i:i + 3] for i in range(len(p) - 2)) if t.isascii()}


def files_with(spark: SparkSession, path: str, f: Q.LogFilter) -> list[str] | None:
    """Files of the store that may hold a match; None: any may.  A name a file
    comes to the driver, as for any scan."""
    wanted = trigrams_of(f.search or "")
    if not wanted:
        return None
    found = Q.search(side.read(spark, path, TRIGRAMS).withColumn("created_at", F.col("log_date").cast("timestamp_ntz")),
                     _days_of(f)).filter(F.col("trigram").isin(sorted(wanted)))
    have = found.groupBy("log_date", "batch", "file").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted))
    day = F.coalesce(F.col("log_date").cast("string"), F.lit(side.NO_DAY))
    at = have.select(F.concat(F.lit(f"{path}/log_date="), day, F.lit("/batch="), F.col("batch"), F.lit("/"), F.col("file")).alias("at"))
    return sorted(r.at for r in at.collect())


def _days_of(f: Q.LogFilter) -> Q.LogFilter:
    """The filter's bounds, widened to whole days."""
    def day(v, more):
        return None if v in (None, "") else _dt.datetime.combine(_as_date(v) + _dt.timedelta(days=more), _dt.time())

    return Q.LogFilter(from_=day(f.from_, 0), to=day(f.to, 1))


def _as_date(v) -> _dt.date:
    return v.date() if isinstance(v, _dt.datetime) else _dt.datetime.fromisoformat(str(v)).date()


def search_table(spark: SparkSession, path: str, f: Q.LogFilter) -> DataFrame:
    """``Q.search`` on a stored table, reading only files that may hold a match."""
    files = files_with(spark, path, f)
    if files is None:
        return Q.search(read_logs(spark, path), f)
    if not files:
        return spark.createDataFrame([], LOGS)
    return Q.search(spark.read.schema(LOGS).option("basePath", path).parquet(*files).select(*LOG_COLUMNS), f)


def deep_page(spark: SparkSession, path: str, limit: int, offset: int = 0, from_=None, to=None) -> DataFrame:
    """E10 on a stored table, without a filter or with whole days ``from_`` to
    ``to`` (dates, both included): the newest-first rows offset .. offset + limit."""
    def bounded(rows: DataFrame) -> DataFrame:
        rows = rows if from_ is None else rows.filter(F.col("log_date") >= F.lit(_as_date(from_)))
        return rows if to is None else rows.filter(F.col("log_date") <= F.lit(_as_date(to)))

    days = bounded(side.read(spark, path, ROLLUP)).groupBy("log_date").agg(F.sum(WEIGHT).alias("n")) \
        .orderBy(F.col("log_date").desc_nulls_last()).collect()     # one row a day
    before, held, touched = 0, 0, []
    for log_date, n in days:
        if not touched and before + n <= offset:        # newer than the page, as a whole
            before += n
            continue
        touched.append(log_date)
        held += n
        if before + held >= offset + limit:
            break
    if not touched:
        return spark.createDataFrame([], LOGS)
    own = F.col("log_date").isin([d for d in touched if d is not None])
    rows = bounded(read_logs(spark, path)).filter(own | F.col("log_date").isNull() if None in touched else own)
    return Q.page(rows, limit, offset - before)
