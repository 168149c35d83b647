"""Aggregate statistics over stored logs.

Every bundle is one aggregation over one scan: partial aggregation runs
map-side, so only one row per group and task crosses the shuffle no matter
how skewed a severity or source is.  Zero-filling joins only ever join
aggregated frames of a fixed, tiny size (5 buckets, 24 hours, 25 slots).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions import analyze as A
from logspark.functions import normalize as N
from logspark.functions.formatting import as_timestamp, epoch_micros, month_ago, parse_as_of, percent_text, trunc_ntz
from logspark.functions.rules import AGE_BUCKETS, DEFAULT_RULES, Rules

ERROR_SEVERITIES = ("error", "critical")
#: Column of rows that stand for several logs (see ``sources.rollup``).
WEIGHT = "_logs"


def _count(rows: DataFrame, cond: Column | None = None) -> Column:
    """Number of logs (for which ``cond`` holds): rows, or the sum of their weights."""
    if WEIGHT not in rows.columns:
        return F.count(F.lit(1)) if cond is None else F.count_if(cond)
    n = F.col(WEIGHT) if cond is None else F.when(cond, F.col(WEIGHT))
    return F.coalesce(F.sum(n), F.lit(0))


def _eff_sev() -> Column:
    return N.effective_severity("derived_severity", "severity")


def _recent(as_of, hours: int = 24) -> Column:
    return F.col("created_at") >= as_timestamp(as_of) - F.expr(f"INTERVAL {hours} HOURS")


def since(logs: DataFrame, as_of, hours: int) -> DataFrame:
    """Rows of the last ``hours`` before as_of and later; on a stored table the
    implied ``log_date`` bound prunes the partitions before."""
    out = logs.filter(_recent(as_of, hours))
    if "log_date" in logs.columns:
        first = parse_as_of(as_of) - _dt.timedelta(hours=hours)
        out = out.filter(F.col("log_date") >= F.lit(first.date()))
    return out


def total(logs: DataFrame) -> DataFrame:
    """F1."""
    return logs.agg(_count(logs).alias("total"))


def last_24_hours(logs: DataFrame, as_of) -> DataFrame:
    """rows created at or after as_of - 24h (no upper bound)."""
    return logs.agg(_count(logs, _recent(as_of)).alias("last_24_hours"))


def severity_counts(logs: DataFrame) -> DataFrame:
    """count by effective severity."""
    return logs.groupBy(_eff_sev().alias("severity")).agg(_count(logs).alias("n"))


def by_type(logs: DataFrame) -> DataFrame:
    """(severity, n) ordered by display rank then name."""
    return severity_counts(logs).orderBy(N.severity_rank("severity"), "severity")


def source_counts(logs: DataFrame) -> DataFrame:
    """count by header source; NULL counted as 'unknown' (merged with a
    literal 'unknown')."""
    return logs.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(_count(logs).alias("n"))


def stats_long(logs: DataFrame, as_of) -> DataFrame:
    """F5 in long form (kind, key, n) from ONE aggregation with grouping sets
    ((severity), (source), ())."""
    base = logs.select(
        _eff_sev().alias("sev"),
        F.coalesce("source", F.lit("unknown")).alias("src"),
        _recent(as_of).alias("recent"), *([WEIGHT] if WEIGHT in logs.columns else []),
    )
    agg = base.groupingSets([["sev"], ["src"], []], "sev", "src").agg(
        _count(base).alias("n"),
        _count(base, F.col("recent")).alias("n_recent"),
        F.grouping_id().alias("gid"),
    )
    rows = F.when(F.col("gid") == 1, F.array(F.struct(F.lit("by_severity").alias("kind"), F.col("sev").alias("key"), F.col("n").alias("n")))) \
        .when(F.col("gid") == 2, F.array(F.struct(F.lit("by_source").alias("kind"), F.col("src").alias("key"), F.col("n").alias("n")))) \
        .otherwise(F.array(
            F.struct(F.lit("total").alias("kind"), F.lit(None).cast("string").alias("key"), F.col("n").alias("n")),
            F.struct(F.lit("last_24_hours").alias("kind"), F.lit(None).cast("string").alias("key"),
                     F.coalesce(F.col("n_recent"), F.lit(0)).cast("bigint").alias("n")),
        ))
    return agg.select(F.inline(rows))


def stats(logs: DataFrame, as_of) -> DataFrame:
    """F5 as served: one row (total, last_24_hours, by_severity map, by_source
    map).  The maps hold one entry per name; for groupings too large for one
    record use ``stats_long``."""
    def group(kind: str) -> Column:
        entries = F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "n")))
        return F.map_from_entries(F.sort_array(entries)).alias(kind)

    return stats_long(logs, as_of).agg(
        F.max(F.when(F.col("kind") == "total", F.col("n"))).alias("total"),
        F.max(F.when(F.col("kind") == "last_24_hours", F.col("n"))).alias("last_24_hours"),
        group("by_severity"), group("by_source"))


def stats_printout(logs: DataFrame, as_of) -> DataFrame:
    """the two groupings sorted by name (kind, key, n)."""
    return stats_long(logs, as_of).filter(F.col("key").isNotNull()).orderBy("kind", "key")


def error_rate(logs: DataFrame) -> DataFrame:
    """(error + critical) / total * 100 on the effective severity; 0 if empty."""
    agg = logs.agg(_count(logs).alias("total"), _count(logs, _eff_sev().isin(*ERROR_SEVERITIES)).alias("errors"))
    return agg.select("total", "errors",
                      F.when(F.col("total") > 0, F.col("errors").cast("double") / F.col("total").cast("double") * 100.0)
                      .otherwise(F.lit(0.0)).alias("error_rate"))


def severity_breakdown(logs: DataFrame) -> DataFrame:
    """F8 + G3: count, share rounded half up, display rank and label."""
    counts = severity_counts(logs)
    whole = counts.agg(F.sum("n").alias("_all"))  # one row
    share = F.col("n").cast("double") / F.col("_all").cast("double") * 100.0
    return counts.join(F.broadcast(whole)).select(
        "severity", N.capitalized("severity").alias("label"), N.severity_rank("severity").alias("rank"), "n",
        F.floor(share + 0.5).cast("bigint").alias("percentage"),
    )


def _bucket(as_of) -> Column:
    """Age bucket of a row relative to as_of (NULL for rows at or after as_of)."""
    now = as_timestamp(as_of)
    d0 = trunc_ntz(now, "day")
    c = F.col("created_at")
    return (
        F.when(c >= now, F.lit(None).cast("string"))
        .when(c >= d0, F.lit("today"))
        .when(c >= d0 - F.expr("INTERVAL 1 DAY"), F.lit("yesterday"))
        .when(c >= now - F.expr("INTERVAL 7 DAYS"), F.lit("last_week"))
        .when(c >= month_ago(now), F.lit("last_month"))
        .otherwise(F.lit("older"))
    )


def _bucket_counts(rows: DataFrame, as_of) -> list[Column]:
    b = _bucket(as_of)
    return [_count(rows, b == name).alias(name) for name in AGE_BUCKETS]


def age_buckets(logs: DataFrame, as_of) -> DataFrame:
    """(bucket, n) for all five buckets, zero-filled, in display order."""
    one = logs.agg(*_bucket_counts(logs, as_of))
    stack = ", ".join(f"{i}, '{b}', `{b}`" for i, b in enumerate(AGE_BUCKETS))
    return one.selectExpr(f"stack({len(AGE_BUCKETS)}, {stack}) AS (position, bucket, n)")


def retention_info(logs: DataFrame, as_of) -> DataFrame:
    """total, last_24_hours and the five buckets in one aggregation."""
    return logs.agg(_count(logs).alias("total"), _count(logs, _recent(as_of)).alias("last_24_hours"),
                    *_bucket_counts(logs, as_of))


def by_color(logs: DataFrame) -> DataFrame:
    """count by effective colour."""
    return logs.groupBy(N.effective_color("color", "derived_severity", "severity").alias("color")) \
        .agg(F.count(F.lit(1)).alias("n"))


def error_rate_24h(logs: DataFrame, as_of) -> DataFrame:
    """error share of the last 24 hours as percent text."""
    agg = since(logs, as_of, 24).agg(_count(logs).alias("total"), _count(logs, _eff_sev().isin(*ERROR_SEVERITIES)).alias("errors"))
    rate = F.col("errors").cast("double") / F.col("total").cast("double") * 100.0
    return agg.select("total", "errors", F.when(F.col("total") > 0, percent_text(rate))
                      .otherwise(F.lit("0.00%")).alias("error_rate_24h"))


def top_sources(logs: DataFrame, k: int = 10) -> DataFrame:
    """effective sources by count desc, name asc, first k (a top-k report)."""
    counts = logs.groupBy(F.coalesce(N.effective_source("derived_source", "source"), F.lit("unknown")).alias("source")) \
        .agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("source")).limit(k)


def hourly_distribution(logs: DataFrame) -> DataFrame:
    """F16: rows per hour of day 0-23, zero-filled."""
    spark = logs.sparkSession
    counts = logs.groupBy(F.hour("created_at").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    # both sides are bounded by 24 rows
    return hours.join(F.broadcast(counts), "hour", "left") \
        .select("hour", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def pattern_stats(logs: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """logs with an HTTP status code, a stack trace, a security issue and
    a performance issue (text pattern or positive body duration)."""
    text = A.searchable_text("title", "description", "body")
    staged = logs.select(text.alias("text"), "body", F.try_parse_json("body").alias("body_v"))
    found = A.Found()
    code, stack, security, slow = (A.http_status_code("text", found), A.stack_trace(found, rules), A.security_issue(found, rules),
                                   A.contains_any(found, [p for p, _ in rules.performance]))
    staged = staged.select("text", F.lower("text").alias("text_lower"),
                           A.body_duration_ms("body_v", rules, body_text="body").alias("duration_ms")) \
        .select("text", "duration_ms", found.captured("text_lower").alias("captured")) \
        .select("text", "duration_ms", found.bits("captured").alias(found.name))
    return staged.agg(
        F.count_if(code.isNotNull()).alias("http_codes"),
        F.count_if(stack).alias("stack_traces"),
        F.count_if(security).alias("security_issues"),
        F.count_if(slow | F.col("duration_ms").isNotNull()).alias("performance_issues"),
    )


def detection_accuracy(logs: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """among logs whose stored header severity is explicit and not info,
    the share whose ungated inferred severity agrees with it."""
    from logspark.operators.enrich import analysis

    stored = logs.select("id", "created_at", "title", "severity", "source", "color", "description", "body",
                         F.try_parse_json("body").alias("body_v"))
    explicit = stored.filter(F.col("severity") != "info")
    a = analysis(explicit, rules)
    agg = a.agg(F.count(F.lit(1)).alias("explicit"),
                F.count_if(F.col("verdict.severity") == F.col("severity")).alias("agreeing"))
    acc = F.col("agreeing").cast("double") / F.col("explicit").cast("double") * 100.0
    return agg.select("explicit", "agreeing",
                      F.when(F.col("explicit") > 0, percent_text(acc)).otherwise(F.lit("0.00%")).alias("accuracy"))


def _hour_slots(logs: DataFrame, as_of, slots: int) -> DataFrame:
    """Row and error counts per hour slot before as_of: slot 0 = [as_of-1h,
    as_of), slot k = [as_of-(k+1)h, as_of-k h); zero-filled for 0..slots-1."""
    now = as_timestamp(as_of)
    age = epoch_micros(now) - epoch_micros(F.col("created_at"))
    slot = F.floor(age / F.lit(3_600_000_000)).cast("int")
    recent = since(logs, as_of, slots).filter(F.col("created_at") < now)
    if "log_date" in logs.columns:
        recent = recent.filter(F.col("log_date") <= F.lit(parse_as_of(as_of).date()))
    counts = recent.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("total"),
                                          F.count_if(_eff_sev().isin(*ERROR_SEVERITIES)).alias("errors"))
    grid = logs.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    # both sides are bounded by ``slots`` rows
    return grid.join(F.broadcast(counts), "slot", "left").select(
        "slot", F.coalesce("total", F.lit(0)).cast("bigint").alias("total"),
        F.coalesce("errors", F.lit(0)).cast("bigint").alias("errors"))


def trends(logs: DataFrame, as_of) -> DataFrame:
    """errors in the last 24 h vs the 24 h before, percent change, and a
    spike flag (last-hour errors > mean + 3 sigma of the 24 hours before)."""
    s = _hour_slots(logs, as_of, 48)
    cur = F.sum(F.when(F.col("slot") < 24, F.col("errors")))
    prev = F.sum(F.when(F.col("slot") >= 24, F.col("errors")))
    window = F.col("slot").between(1, 24)
    agg = s.agg(
        cur.cast("bigint").alias("errors_24h"),
        prev.cast("bigint").alias("errors_prev_24h"),
        F.sum(F.when(F.col("slot") < 24, F.col("total"))).cast("bigint").alias("total_24h"),
        F.max(F.when(F.col("slot") == 0, F.col("errors"))).alias("last_hour"),
        F.avg(F.when(window, F.col("errors").cast("double"))).alias("hourly_mean"),
        F.stddev_pop(F.when(window, F.col("errors").cast("double"))).alias("hourly_stddev"),
    )
    change = (F.col("errors_24h") - F.col("errors_prev_24h")).cast("double") / F.col("errors_prev_24h").cast("double") * 100.0
    return agg.select(
        "total_24h", "errors_24h", "errors_prev_24h",
        (F.col("errors_24h") > F.col("errors_prev_24h")).alias("increasing"),
        F.when(F.col("errors_prev_24h") > 0, change).alias("change_pct"),
        "last_hour", "hourly_mean", "hourly_stddev",
        (F.col("last_hour").cast("double") > F.col("hourly_mean") + 3.0 * F.col("hourly_stddev")).alias("spike"),
    )


def hourly_error_series(logs: DataFrame) -> DataFrame:
    """Per clock hour, the error count and the mean and standard deviation
    of the 24 hours before it (those since the first hour, empty ones as 0).

    Every hour with rows adds its count to the 24 hours after it, so the
    trailing sums are one grouping by hour: no window over all hours, and no
    grid from the first to the last one.  Hours that have neither rows nor
    rows in the day before them are left out (all their values are 0), so a
    stray timestamp far off adds 25 rows, not the years in between.
    """
    hour = trunc_ntz(F.col("created_at"), "hour")
    counts = logs.filter(F.col("created_at").isNotNull()).groupBy(hour.alias("hour")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_eff_sev().isin(*ERROR_SEVERITIES)).alias("errors"))
    span = counts.agg(F.min("hour").alias("_first"), F.max("hour").alias("_last"))  # one row
    after = F.col("hour") + F.col("k") * F.expr("INTERVAL 1 HOUR")
    own = F.col("k") == 0
    sums = counts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(24)))).groupBy(after.alias("hour")).agg(
        F.sum(F.when(own, F.col("total")).otherwise(0)).alias("total"),
        F.sum(F.when(own, F.col("errors")).otherwise(0)).alias("errors"),
        F.sum(F.when(~own, F.col("errors")).otherwise(0)).alias("s1"),
        F.sum(F.when(~own, F.col("errors") * F.col("errors")).otherwise(0)).alias("s2"))
    age = (epoch_micros(F.col("hour")) - epoch_micros(F.col("_first"))) / 3_600_000_000
    n = F.least(F.lit(24.0), age)
    mean = F.when(n > 0, F.col("s1") / n)
    spread = F.when(n > 0, F.sqrt(F.greatest(F.lit(0.0), n * F.col("s2") - F.col("s1") * F.col("s1"))) / n)
    return sums.join(F.broadcast(span)).filter(F.col("hour") <= F.col("_last")).select(
        "hour", "total", "errors", mean.alias("trailing_mean"), spread.alias("trailing_stddev"),
    ).withColumn("spike", F.col("errors").cast("double") > F.col("trailing_mean") + 3.0 * F.col("trailing_stddev"))


def alerts(logs: DataFrame, as_of, error_rate_threshold: float = 10.0) -> DataFrame:
    """alert lines from thresholds on the last-24h error rate and the
    F19 trend (zero or more rows)."""
    t = trends(logs, as_of)
    rate = F.col("errors_24h").cast("double") / F.col("total_24h").cast("double") * 100.0
    lines = F.array(
        F.when((F.col("total_24h") > 0) & (rate > error_rate_threshold),
               F.concat(F.lit("High error rate: "), percent_text(rate), F.lit(" in the last 24 hours"))),
        F.when(F.col("spike"), F.concat(F.lit("Error spike: "), F.col("last_hour").cast("string"),
                                        F.lit(" errors in the last hour"))),
        F.when(F.col("increasing") & F.col("change_pct").isNotNull(),
               F.concat(F.lit("Errors increasing: +"), percent_text(F.col("change_pct")), F.lit(" vs the previous 24 hours"))),
    )
    return t.select(F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("alert"))


def category_counts(logs: DataFrame) -> DataFrame:
    """count by derived category."""
    return logs.groupBy(F.col("derived_category").alias("category")).agg(F.count(F.lit(1)).alias("n"))


def filter_options(logs: DataFrame) -> DataFrame:
    """Distinct effective severities and header sources seen (kind, value)."""
    return stats_long(logs, _dt.datetime(1970, 1, 1)).filter(F.col("kind").isin("by_severity", "by_source")) \
        .select(F.when(F.col("kind") == "by_severity", F.lit("severity")).otherwise(F.lit("source")).alias("kind"),
                F.col("key").alias("value"))
