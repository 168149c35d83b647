"""Top sources as heavy hitters (F15), from counts kept beside the log table.

A side table (``sources.side``) holds for every folder of the store a
frequent-items state of its sources (a built-in aggregate, ``TRACKED`` items at
most, however many sources there are).  States merge, so the candidates of the
whole table come without its rows.  With N logs, a merged state errs by at most
``error_bound(N)`` for each source it returns, and a source that it does not
return has at most twice that many logs.  ``top_sources`` therefore counts the
candidates exactly and is done when the k-th has more than any other source
can have, or when the candidates are all there is; otherwise - a table whose
sources are nearly all alike - it counts every source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions import normalize as N
from logspark.operators import stats as S
from logspark.sources.side import Side, read
from logspark.sources.store import read_logs

#: Sources that a state tracks; 3/4 of a power of two, the size of its table.
TRACKED = 3072
STATE = "struct<sketch: binary, maxItemsTracked: int, itemDataType: string, itemDataTypeDDL: string>"


def _source():
    return F.coalesce(N.effective_source("derived_source", "source"), F.lit("unknown"))


def _states(logs: DataFrame) -> DataFrame:
    return logs.groupBy("log_date", "batch").agg(
        F.count(F.lit(1)).alias("n"), F.call_function("approx_top_k_accumulate", _source(), F.lit(TRACKED)).alias("state"))


HEAVY = Side("heavy_sources", f"n bigint, state {STATE}", _states)


def error_bound(logs: int) -> int:
    """How far an estimate may lie above the count, of so many logs."""
    return int(3.5 * logs / (TRACKED * 4 // 3))


def candidates(spark: SparkSession, path: str) -> tuple[list[tuple[str, int]], int]:
    """([(source, estimate)], logs): the sources that the merged states return
    (``TRACKED`` at most) and the number of logs they stand for; only states
    are read."""
    days = read(spark, path, HEAVY)
    n = days.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not n:
        return [], 0
    state = days.agg(F.call_function("approx_top_k_combine", "state", F.lit(TRACKED)).alias("s"))
    found = state.select(F.call_function("approx_top_k_estimate", "s", F.lit(TRACKED)).alias("f")).first().f
    return [(r["item"], r["count"]) for r in found], n


def heavy_sources(spark: SparkSession, path: str) -> DataFrame:
    """(source, at_least, at_most) of every candidate, from states alone."""
    found, n = candidates(spark, path)
    err = error_bound(n)
    return spark.createDataFrame([(s, max(0, c - err), c) for s, c in found], "source string, at_least long, at_most long")


def top_sources(spark: SparkSession, path: str, k: int = 10) -> DataFrame:
    """F15 of a stored table: the k sources with the most logs, counted
    exactly, by count desc and name asc.  The count reads the two source
    columns and groups no more than ``TRACKED`` of them."""
    found, n = candidates(spark, path)
    logs = read_logs(spark, path)
    names = [s for s, _ in found]
    counted = logs.filter(_source().isin(names)).groupBy(_source().alias("source")).agg(F.count(F.lit(1)).alias("n")) \
        .collect() if names else []     # TRACKED rows at most
    best = sorted(counted, key=lambda r: (-r.n, r.source))[:k]
    whole = sum(r.n for r in counted) == n
    if not whole and (len(best) < k or best[-1].n <= 2 * error_bound(n)):
        return S.top_sources(logs, k)
    return spark.createDataFrame([(r.source, r.n) for r in best], "source string, n long")
