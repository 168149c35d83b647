"""Latency percentiles from mergeable sketches, kept by path and hour.

A KLL sketch (a built-in aggregate) holds a few thousand durations, however
many it has seen, and sketches merge: those of one hour answer for any span of
hours and any set of paths without the records.  Beside it lie the exact
counts, the greatest duration and the first and last time, which merge as they
are.  A batch or micro-batch writes its sketches into a folder of its own; a
replay writes that folder again.

``RANK_ERROR`` is the share of ranks by which a percentile of a (merged) sketch
may miss, with a probability of 99 %; the error does not grow with merging.
Records without a duration are not counted, as in ``operators.metrics``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions.formatting import epoch_micros, parse_as_of, trunc_ntz
from logspark.operators.metrics import DEFAULT_PERCENTILES
from logspark.sources.store import exists

#: Accuracy parameter of the sketches, and the rank error that follows from it.
SKETCH_K = 1600
RANK_ERROR = 2.296 / SKETCH_K ** 0.9723

SKETCHES = ("path string, hour timestamp_ntz, sent long, failed long, slowest int, "
            "first_ts timestamp_ntz, last_ts timestamp_ntz, sketch binary")


def latency_sketches(access: DataFrame) -> DataFrame:
    """One row for each path and hour.  Tasks sketch before the shuffle, so a
    hot path sends one sketch per task and hour."""
    return access.filter(F.col("duration_ms").isNotNull()).groupBy("path", trunc_ntz("ts", "hour").alias("hour")).agg(
        F.count(F.lit(1)).alias("sent"), F.count_if(F.col("status") >= 400).alias("failed"),
        F.max("duration_ms").cast("int").alias("slowest"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.call_function("kll_sketch_agg_bigint", F.col("duration_ms").cast("bigint"), F.lit(SKETCH_K)).alias("sketch"))


def keep_sketches(access: DataFrame, path: str, batch: str) -> None:
    """Sketches of one batch of records, in folders of (batch, day)."""
    latency_sketches(access).withColumn("day", F.to_date("hour")).hint("rebalance", "day") \
        .write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={batch}")


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    """All kept sketches with ``day`` and ``batch``; a path and hour has a row
    for each batch that held records of it."""
    schema = f"{SKETCHES}, batch string, day date"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def merged(sketches: DataFrame, by: tuple[str, ...] = (), pcts=DEFAULT_PERCENTILES) -> DataFrame:
    """One row for each group of ``by`` (path, hour, day; one row without):
    counts, rate per second (0 when no time elapsed), p<k> and the maximum."""
    one = sketches.groupBy(*by).agg(
        F.coalesce(F.sum("sent"), F.lit(0)).alias("sent"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"),
        F.max("slowest").alias("max"), F.min("first_ts").alias("_first"), F.max("last_ts").alias("_last"),
        F.call_function("kll_merge_agg_bigint", "sketch").alias("_sketch"))
    ranks = F.array(*[F.lit(p / 100.0) for p in pcts])
    got = F.when(F.col("sent") > 0, F.call_function("kll_sketch_get_quantile_bigint", F.col("_sketch"), ranks))
    elapsed = (epoch_micros(F.col("_last")) - epoch_micros(F.col("_first"))) / 1e6
    return one.withColumn("_at", got).select(
        *by, "sent", "failed", *[F.col("_at")[i].alias(f"p{p}") for i, p in enumerate(pcts)], "max",
        F.when(elapsed > 0, F.col("sent") / elapsed).otherwise(0.0).alias("rate_per_sec"))


def spanning(sketches: DataFrame, access: DataFrame, since, until) -> DataFrame:
    """Sketch rows of the records with since <= ts < until: the kept ones of
    the hours that lie inside, and fresh ones of the records of the (at most
    two) hours that the span cuts.  Days and times bound what is read."""
    lo, hi = parse_as_of(since), parse_as_of(until)
    hour = _dt.timedelta(hours=1)
    first = lo.replace(minute=0, second=0, microsecond=0)
    first = first if first == lo else first + hour
    last = max(first, hi.replace(minute=0, second=0, microsecond=0))

    def t(v):
        return F.lit(str(v)).cast("timestamp_ntz")

    inside = sketches.filter((F.col("day") >= F.lit(first.date())) & (F.col("day") <= F.lit(last.date()))
                             & (F.col("hour") >= t(first)) & (F.col("hour") < t(last)))
    ts = F.col("ts")
    cut = access.filter((ts >= t(lo)) & (ts < t(hi)) & ((ts < t(first)) | (ts >= t(last))))
    names = [f.split()[0] for f in SKETCHES.split(", ")]
    return inside.select(*names).unionByName(latency_sketches(cut).select(*names))
