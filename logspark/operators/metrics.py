"""Request metrics over access records.

Input: access records ``(id, path, status, duration_ms, ts)``.

Exact rank percentiles are computed from a per-(group, value) histogram:
partial aggregation collapses rows to distinct values before the shuffle,
and the running count that locates rank k runs over the histogram, split into
value-range buckets (see ``_percentile_rows``) - so a path holding a third
of all requests is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logspark.functions.formatting import epoch_micros, rate_percent_text, trunc_ntz
from logspark.session import staged

DEFAULT_PERCENTILES = (50, 95, 99)


def request_metrics(access: DataFrame, by_path: bool = False) -> DataFrame:
    """total requests, errors (status >= 400), error rate text."""
    aggs = [F.count(F.lit(1)).alias("total_requests"),
            F.count_if(F.col("status") >= 400).alias("total_errors")]
    g = access.groupBy("path").agg(*aggs) if by_path else access.agg(*aggs)
    return g.withColumn("error_rate", rate_percent_text(F.col("total_errors"), F.col("total_requests")))


def last_n_per_key(df: DataFrame, key: str = "path", n: int = 100, order: tuple | None = None) -> DataFrame:
    """G1: the newest n rows per key (older ones dropped first).

    ``row_number() <= n`` is planned with a WindowGroupLimit before the
    shuffle, so each map task forwards at most n rows per key.
    """
    order = order or (F.col("ts").desc(), F.col("id").desc())
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= n)


PERCENTILE_BUCKETS = 64


def _percentile_rows(hist: DataFrame, by: list[str], pcts, extra: dict | None = None,
                     buckets: int = PERCENTILE_BUCKETS) -> DataFrame:
    """From a histogram (by..., v, c, ...) return (by..., p, value, n, max,
    extra...) with value = sorted[min(floor(N * p / 100), N - 1)] (0-based).

    The histogram is written once.  Approximate quantiles of all distinct
    values give one list of at most ``buckets - 1`` bounds for every group,
    collected to the driver (64 numbers, whatever the data) and applied as a
    literal: no join, so no key can gather rows.  Per (group, bucket) totals
    are prefix-summed per group - at most ``buckets`` rows each - and only the
    buckets that hold a wanted rank are looked into, by a running count
    inside (group, bucket).  ``extra`` maps output names to ``(function,
    column)`` with function one of sum / min / max over the whole group.
    """
    extra = extra or {}
    keys = list(by) if by else ["_g"]
    h = staged(hist if by else hist.withColumn("_g", F.lit(0)), "histogram")
    fractions = [i / buckets for i in range(1, buckets)]
    found = h.agg(F.percentile_approx("v", F.array(*[F.lit(f) for f in fractions]), 1000)).first()[0]
    bounds = sorted(set(found or []))
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("v"))) if bounds else F.lit(0)
    tagged = h.withColumn("_bucket", bucket)
    per_bucket = tagged.groupBy(*keys, "_bucket").agg(
        F.sum("c").alias("_bc"), F.max("v").alias("_bmax"),
        *[getattr(F, fn)(col).alias(name) for name, (fn, col) in extra.items()])
    w_before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    w_group = Window.partitionBy(*keys)
    offsets = per_bucket.select(
        *keys, "_bucket", "_bc",
        F.coalesce(F.sum("_bc").over(w_before), F.lit(0)).alias("_before"),
        F.sum("_bc").over(w_group).alias("n"),
        F.max("_bmax").over(w_group).alias("max"),
        *[getattr(F, fn)(name).over(w_group).alias(name) for name, (fn, _) in extra.items()])
    ranks = F.array(*[F.struct(F.lit(int(p)).alias("p"), F.least(F.floor(F.col("n") * int(p) / 100), F.col("n") - 1).alias("k"))
                      for p in pcts])
    # the bucket in which rank k lies: one row per group and percentile
    wanted = offsets.select("*", F.inline(ranks)) \
        .filter((F.col("k") >= F.col("_before")) & (F.col("k") < F.col("_before") + F.col("_bc")))
    w_run = Window.partitionBy(*keys, "_bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = tagged.select(*keys, "_bucket", "v", "c", F.sum("c").over(w_run).alias("_local"))
    upto = F.col("_before") + F.col("_local")
    hit = run.join(wanted, keys + ["_bucket"]).filter((upto > F.col("k")) & (upto - F.col("c") <= F.col("k")))
    return hit.select(*by, "p", F.col("v").alias("value"), "n", "max", *extra.keys())


def _pivot(rows: DataFrame, by: list[str], pcts, keep: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"p{p}") for p in pcts],
        *[F.max(c).alias(c) for c in keep],
    )


def rank_percentiles(df: DataFrame, value: str, pcts=DEFAULT_PERCENTILES, by: tuple = ()) -> DataFrame:
    """F24 + F25 + G2 exact: one row per group with p<k> columns, the count
    and the maximum.  NULL values are ignored."""
    by = list(by)
    hist = df.filter(F.col(value).isNotNull()) \
        .groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    return _pivot(_percentile_rows(hist, by, pcts), by, pcts, ["n", "max"])


def approx_percentiles(df: DataFrame, value: str, pcts=DEFAULT_PERCENTILES, by: tuple = (),
                       accuracy: int = 10000) -> DataFrame:
    """F24 approximate: ``percentile_approx`` (mergeable sketch, fixed memory per group)."""
    fr = F.array(*[F.lit(p / 100.0) for p in pcts])
    agg = F.percentile_approx(F.col(value), fr, accuracy).alias("ps")
    g = df.groupBy(*by).agg(agg, F.count(F.lit(1)).alias("n")) if by else df.agg(agg, F.count(F.lit(1)).alias("n"))
    return g.select(*by, *[F.col("ps")[i].alias(f"p{p}") for i, p in enumerate(pcts)], "n")


def latency_report(access: DataFrame) -> DataFrame:
    """F24 + F25 per path: exact p50/p95/p99, max and count."""
    return rank_percentiles(access, "duration_ms", DEFAULT_PERCENTILES, ("path",))


def delivery_report(access: DataFrame) -> DataFrame:
    """F25-F27 over records with a duration: sent / success / failed counts
    and %, exact percentiles, max latency and throughput (count / elapsed
    seconds between first and last request; 0 when none elapsed), one row."""
    hist = access.filter(F.col("duration_ms").isNotNull()).groupBy(F.col("duration_ms").alias("v")).agg(
        F.count(F.lit(1)).alias("c"),
        F.count_if(F.col("status") >= 400).alias("f"),
        F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    extra = {"failed": ("sum", "f"), "first_ts": ("min", "lo"), "last_ts": ("max", "hi")}
    one = _pivot(_percentile_rows(hist, [], DEFAULT_PERCENTILES, extra), [], DEFAULT_PERCENTILES,
                 ["n", "max", "failed", "first_ts", "last_ts"])
    elapsed = (epoch_micros(F.col("last_ts")) - epoch_micros(F.col("first_ts"))) / 1e6
    return one.select(
        F.col("n").alias("sent"),
        (F.col("n") - F.col("failed")).alias("success"),
        "failed",
        (F.col("n") - F.col("failed")) / F.col("n") * 100.0,
        F.col("failed") / F.col("n") * 100.0,
        "p50", "p95", "p99", "max",
        F.when(elapsed > 0, F.col("n") / elapsed).otherwise(0.0).alias("rate_per_sec"),
    ).toDF("sent", "success", "failed", "success_pct", "failed_pct", "p50", "p95", "p99", "max", "rate_per_sec")


def exposition(access: DataFrame, prefix: str = "logspark") -> DataFrame:
    """Request counters as exposition rows (name, type, help, value, line)."""
    m = request_metrics(access)
    rows = F.array(
        F.struct(F.lit(f"{prefix}_http_requests_total").alias("name"), F.lit("counter").alias("type"),
                 F.lit("Total number of HTTP requests").alias("help"), F.col("total_requests").alias("value")),
        F.struct(F.lit(f"{prefix}_http_errors_total").alias("name"), F.lit("counter").alias("type"),
                 F.lit("Total number of HTTP errors (4xx and 5xx)").alias("help"), F.col("total_errors").alias("value")),
    )
    return m.select(F.inline(rows)).withColumn(
        "line", F.concat(F.col("name"), F.lit(" "), F.col("value").cast("string")))


def progress(access: DataFrame) -> DataFrame:
    """J9 (batch form): per second of ts - sent, errors and approximate p95."""
    sec = trunc_ntz(F.col("ts"), "second")
    return access.groupBy(sec.alias("second")).agg(
        F.count(F.lit(1)).alias("sent"),
        F.count_if(F.col("status") >= 400).alias("errors"),
        F.percentile_approx("duration_ms", 0.95, 1000).alias("p95"),
    )

