"""Deletes and retention (H1-H4).

On a frame every operation returns ``(kept, report)``: the rows that remain
and a one-row report.  On a stored table retention drops whole ``log_date``
partitions and rewrites the cutoff day alone; deletes rewrite the days that
hold a listed id (``sources.store.replace_days``).
"""

from __future__ import annotations

import datetime as _dt
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.functions.formatting import as_timestamp, parse_as_of
from logspark.session import staged

class Outcome(NamedTuple):
    kept: DataFrame
    report: DataFrame


def delete_id(logs: DataFrame, log_id: int) -> Outcome:
    """H1: drop one id; the report says whether it existed."""
    kept = logs.filter(F.col("id") != F.lit(log_id))
    report = logs.agg(F.count_if(F.col("id") == F.lit(log_id)).alias("deleted")) \
        .select(F.lit(log_id).cast("bigint").alias("id"), "deleted", (F.col("deleted") > 0).alias("found"))
    return Outcome(kept, report)


def _wanted(ids: DataFrame, id_col: str) -> DataFrame:
    wanted = ids.select(F.col(id_col).cast("bigint").alias("id")).filter(F.col("id").isNotNull()).distinct()
    if wanted.isEmpty():
        raise ValueError("at least one id is required")
    return wanted


def delete_ids(logs: DataFrame, ids: DataFrame, id_col: str = "id") -> Outcome:
    """H2: drop every listed id (missing ids ignored, repeats count once).
    Adaptive execution picks the join from the sizes it meets."""
    wanted = _wanted(ids, id_col)
    kept = logs.join(wanted, "id", "left_anti")
    deleted = logs.join(wanted, "id", "left_semi").agg(F.count(F.lit(1)).alias("deleted"))  # one row each
    report = wanted.agg(F.count(F.lit(1)).alias("requested")).join(F.broadcast(deleted)) \
        .select("requested", "deleted", (F.col("requested") - F.col("deleted")).alias("missing"))
    return Outcome(kept, report)


def cutoff_for(days: int, as_of) -> _dt.datetime:
    """as_of - days; ``as_of`` is required (no wall clock), days >= 1
    (the configured default is 90)."""
    if days is None or days < 1:
        raise ValueError("days must be at least 1")
    if as_of is None:
        raise ValueError("as_of is required")
    return parse_as_of(as_of) - _dt.timedelta(days=days)


def apply_retention(logs: DataFrame, days: int = 90, as_of=None) -> Outcome:
    """H3 + H4: drop rows created before as_of - days; report count, cutoff
    and message."""
    cutoff = cutoff_for(days, as_of)
    c = as_timestamp(cutoff)
    old = F.col("created_at") < c
    if "log_date" in logs.columns:
        # whole partitions before the cutoff day are pruned, not scanned
        kept = logs.filter((F.col("log_date") >= F.lit(cutoff.date())) & (F.col("created_at") >= c))
    else:
        kept = logs.filter(F.col("created_at") >= c)
    candidates = logs.filter(F.col("log_date") <= F.lit(cutoff.date())) if "log_date" in logs.columns else logs
    n = candidates.agg(F.count_if(old).alias("deleted"))
    msg = F.when(F.col("deleted") > 0,
                 F.format_string(f"Cleaned up %d logs older than {days} days", F.col("deleted"))) \
        .otherwise(F.lit(f"No logs older than {days} days to clean up"))
    report = n.select("deleted", c.alias("cutoff"), F.lit(days).alias("days"), msg.alias("message"))
    return Outcome(kept, report)


# ------------------------------------------------------ table maintenance
def _fs(spark, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def partition_days(spark, path: str) -> dict:
    """``log_date`` partition directories of a table: {date: path}."""
    import datetime as dt

    fs, root = _fs(spark, path)
    out = {}
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("log_date="):
            try:
                out[dt.date.fromisoformat(name.split("=", 1)[1])] = st.getPath().toString()
            except ValueError:
                continue
    return out


def publish_deletes(gone: DataFrame, feed: str) -> None:
    """Append the ``log_deleted`` events of ``gone`` to the folder ``feed``.
    They are written before the rows go: after a failure in between they may
    come twice, and readers count an id once."""
    from logspark.streaming.stream import change_feed

    change_feed(gone.limit(0), gone).write.mode("append").parquet(feed)


def cleanup_table(spark, path: str, days: int = 90, as_of=None, feed: str | None = None) -> dict:
    """H3 on a stored table: drop every ``log_date`` partition before the
    cutoff day (a directory delete, no data read) and rewrite only the
    cutoff day itself.  Returns the H4 report as a dict.  With ``feed`` the
    rows that go are read once and announced there."""
    from logspark.sources.store import finish_swaps, read_logs, replace_days

    finish_swaps(spark, path)
    cutoff = cutoff_for(days, as_of)
    c = as_timestamp(cutoff)
    logs = read_logs(spark, path)
    old = logs.filter((F.col("log_date") <= F.lit(cutoff.date())) & (F.col("created_at") < c))
    deleted = old.count()
    if feed and deleted:
        publish_deletes(old, feed)
    parts = partition_days(spark, path)
    fs, _ = _fs(spark, path)
    for d, p in parts.items():
        if d < cutoff.date():
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(p), True)
    if cutoff.date() in parts:
        boundary = logs.filter((F.col("log_date") == F.lit(cutoff.date())) & (F.col("created_at") >= c))
        replace_days(spark, path, boundary, [cutoff.date()])
    message = (f"Cleaned up {deleted} logs older than {days} days" if deleted > 0
               else f"No logs older than {days} days to clean up")
    return {"deleted": deleted, "cutoff": cutoff, "days": days, "message": message}


def delete_from_table(spark, path: str, ids: DataFrame, id_col: str = "id", feed: str | None = None) -> dict:
    """H2 on a stored table: rewrite only the days that hold a listed id; with
    ``feed`` the deleted rows are announced there."""
    from logspark.sources.store import finish_swaps, read_logs, replace_days

    finish_swaps(spark, path)
    logs = read_logs(spark, path)
    wanted = staged(_wanted(ids, id_col), "wanted")     # the list may come from this very table
    gone = logs.join(wanted, "id", "left_semi")
    per_day = {r.log_date: r.n for r in gone.groupBy("log_date").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row an affected day
    if per_day:
        if feed:
            publish_deletes(_of_days(gone, per_day), feed)
        kept = _of_days(logs, per_day).join(wanted, "id", "left_anti")
        replace_days(spark, path, kept, list(per_day))
    deleted, requested = sum(per_day.values()), wanted.count()
    return {"requested": requested, "deleted": deleted, "missing": requested - deleted}


def _of_days(logs: DataFrame, days) -> DataFrame:
    own = F.col("log_date").isin([d for d in days if d is not None])
    return logs.filter(own | F.col("log_date").isNull() if None in days else own)


def delete_one_from_table(spark, path: str, log_id: int, feed: str | None = None) -> dict:
    """H1 on a stored table: the id is looked up in the files (sorted, with
    bloom filters), and the day that holds it is rewritten."""
    from logspark.sources.store import finish_swaps, read_logs, replace_days

    finish_swaps(spark, path)
    logs = read_logs(spark, path)
    gone = logs.filter(F.col("id") == F.lit(log_id))
    days = [r.log_date for r in gone.select("log_date").collect()]      # the rows of one id
    if days:
        if feed:
            publish_deletes(_of_days(gone, days), feed)
        replace_days(spark, path, _of_days(logs, days).filter(~F.col("id").eqNullSafe(F.lit(log_id))), list(set(days)))
    return {"id": log_id, "deleted": len(days), "found": bool(days)}


def compact_table(spark, path: str, batches: int = 8) -> list:
    """Rewrite the days whose rows lie in more than ``batches`` folders as
    one batch each; returns these days.  The rows stay as they are."""
    from logspark.sources.store import finish_swaps, folders, read_logs, replace_days

    finish_swaps(spark, path)
    days = sorted(d for d, at in partition_days(spark, path).items() if len(folders(spark, at, "batch=")) > batches)
    if days:
        replace_days(spark, path, _of_days(read_logs(spark, path), days), days)
    return days
