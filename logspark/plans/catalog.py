"""Registered queries: each is a Spark builder ``(spark, sf_dir) -> DataFrame``
next to its DuckDB oracle SQL (``None`` = rows-only check).

Every query reads whole driver tables (``events``, ``documents``) through
the adapters and runs over all of their rows; limits appear only where a
page or a top-k report is the feature.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions import normalize as N
from logspark.functions.analyze import parsed_body, whole_body
from logspark.functions.formatting import trunc_ntz
from logspark.functions.rules import AGE_BUCKETS, AUTO_COLORS, COLORS, SEVERITY_RANK
from logspark.operators import export as X
from logspark.operators import metrics as M
from logspark.operators import query as Q
from logspark.operators import retention as H
from logspark.operators import sketches as K
from logspark.operators import stats as S
from logspark.operators.enrich import enrich, ingest
from logspark.plans import oracle as O
from logspark.sources import adapters as AD
from logspark.session import checkpoint_dir
from logspark.sources import heavy as HV
from logspark.sources import rollup as RU
from logspark.sources import search as TS
from logspark.sources.store import append, assign_ids, inputs_of, read_logs, spread, stored_logs

AS_OF = "2024-01-29 12:00:00"
AS_OF_LATER = "2024-02-10 12:00:00"
AS_OF_MONTH_END = "2024-03-31 10:20:30"


@dataclass(frozen=True)
class Registered:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: str


def events(spark: SparkSession, sf: str) -> DataFrame:
    return AD.read_table(spark, sf, "events")


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Enrichment computed in the query's own lineage."""
    return enrich(AD.raw_logs(events(spark, sf)))


def logs(spark: SparkSession, sf: str) -> DataFrame:
    """The stored log table: events enriched once per session, then scanned."""
    return stored_logs(spark, events(spark, sf), AD.raw_logs)


def access(spark: SparkSession, sf: str) -> DataFrame:
    return AD.access_logs(events(spark, sf))


def doc_logs(spark: SparkSession, sf: str) -> DataFrame:
    return stored_logs(spark, AD.read_table(spark, sf, "documents"), AD.document_logs)


def conversation_logs(spark: SparkSession, sf: str) -> DataFrame:
    return stored_logs(spark, AD.read_table(spark, sf, "conversations"), AD.conversation_logs)


# ---------------------------------------------------------------- SQL helpers
EFF = "coalesce(derived_severity, severity, 'info')"


def ts(v: str) -> str:
    return f"TIMESTAMP '{v}'"


def fixed3_sql(x: str) -> str:
    whole = f"CAST(trunc({x}) AS BIGINT)"
    frac = f"abs(CAST(trunc(({x} - CAST({whole} AS DOUBLE)) * 1000.0) AS BIGINT))"
    return f"(CAST({whole} AS VARCHAR) || '.' || lpad(CAST({frac} AS VARCHAR), 3, '0'))"


def pct_sql(part: str, whole: str) -> str:
    rate = f"(CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100.0)"
    return f"CASE WHEN {whole} > 0 THEN {fixed3_sql(rate)} || '%' ELSE '0.00%' END"


def month_ago_sql(v: str) -> str:
    t = ts(v)
    day0 = f"(CAST(date_trunc('month', {t}) - INTERVAL 1 MONTH AS DATE) + CAST(day({t}) - 1 AS INTEGER))"
    return f"(CAST({day0} AS TIMESTAMP) + ({t} - date_trunc('day', {t})))"


def bucket_sql(v: str) -> str:
    t = ts(v)
    d0 = f"date_trunc('day', {t})"
    return (f"CASE WHEN created_at >= {t} THEN NULL WHEN created_at >= {d0} THEN 'today' "
            f"WHEN created_at >= {d0} - INTERVAL 1 DAY THEN 'yesterday' "
            f"WHEN created_at >= {t} - INTERVAL 7 DAY THEN 'last_week' "
            f"WHEN created_at >= {month_ago_sql(v)} THEN 'last_month' ELSE 'older' END")


def search_sql(q: str) -> str:
    pat = O.lit("%" + q + "%")
    return f"(coalesce(title ILIKE {pat}, false) OR coalesce(description ILIKE {pat}, false) OR coalesce(body ILIKE {pat}, false))"


def eff_color_sql() -> str:
    colors = ", ".join(f"'{c}'" for c in COLORS)
    auto = "CASE " + " ".join(f"WHEN {EFF} = '{s}' THEN '{c}'" for s, c in AUTO_COLORS) + " ELSE 'slate' END"
    return f"coalesce(CASE WHEN lower(color) IN ({colors}) THEN lower(color) END, {auto})"


def rank_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = '{s}' THEN {r}" for s, r in SEVERITY_RANK) + " ELSE 10 END"


RFC3339 = "strftime(created_at, '%Y-%m-%dT%H:%M:%SZ')"
NEWEST = "ORDER BY created_at DESC, id DESC"


# ------------------------------------------------------------ spark builders
def _age_buckets(as_of):
    return lambda s, sf: S.age_buckets(logs(s, sf), as_of)


def _age_buckets_sql(as_of: str) -> str:
    values = ", ".join(f"({i}, '{b}')" for i, b in enumerate(AGE_BUCKETS))
    return O.with_logs(f""", b AS (SELECT {bucket_sql(as_of)} AS bucket FROM logs)
SELECT CAST(p.position AS INTEGER) AS position, p.bucket, CAST(count(b.bucket) AS BIGINT) AS n
FROM (VALUES {values}) p(position, bucket) LEFT JOIN b ON b.bucket = p.bucket
GROUP BY p.position, p.bucket""")


def _filtered():
    return Q.LogFilter(severity="error", source="api", from_="2024-01-05 00:00:00", to="2024-01-20 00:00:00")


def _delete_list(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of logs whose event is an error event, plus a missing id (-1) and
    one id repeated - all derived from the events table."""
    err = events(spark, sf).filter(F.col("event_type") == "error").select(F.col("event_id").alias("id"))
    extra = err.agg(F.min("id").alias("id")).unionByName(spark.range(-1, 0).select("id"))
    return err.unionByName(extra)


DELETE_LIST_SQL = "(SELECT event_id AS id FROM events WHERE event_type = 'error' UNION ALL SELECT min(event_id) FROM events WHERE event_type = 'error' UNION ALL SELECT -1)"


def _trends_sql(as_of: str, slots: int = 48) -> str:
    t = ts(as_of)
    return f""", sl AS (
  SELECT CAST(floor((epoch_us({t}) - epoch_us(created_at)) / 3600000000.0) AS INTEGER) AS slot,
         {EFF} IN ('error', 'critical') AS is_err
  FROM logs WHERE created_at < {t} AND created_at >= {t} - INTERVAL {slots} HOUR),
grid AS (SELECT CAST(s AS INTEGER) AS slot FROM generate_series(0, {slots - 1}) g(s)),
cnt AS (SELECT grid.slot, count(sl.slot) AS total, count(sl.slot) FILTER (WHERE sl.is_err) AS errors
        FROM grid LEFT JOIN sl ON sl.slot = grid.slot GROUP BY grid.slot),
tr AS (
  SELECT CAST(sum(total) FILTER (WHERE slot < 24) AS BIGINT) AS total_24h,
         CAST(sum(errors) FILTER (WHERE slot < 24) AS BIGINT) AS errors_24h,
         CAST(sum(errors) FILTER (WHERE slot >= 24) AS BIGINT) AS errors_prev_24h,
         max(errors) FILTER (WHERE slot = 0) AS last_hour,
         avg(CAST(errors AS DOUBLE)) FILTER (WHERE slot BETWEEN 1 AND 24) AS hourly_mean,
         stddev_pop(CAST(errors AS DOUBLE)) FILTER (WHERE slot BETWEEN 1 AND 24) AS hourly_stddev
  FROM cnt)"""


def _trends(spark, sf):
    t = S.trends(logs(spark, sf), AS_OF)
    return t.withColumn("hourly_mean", F.round("hourly_mean", 9)).withColumn("hourly_stddev", F.round("hourly_stddev", 9))


def _hourly_series(spark, sf):
    t = S.hourly_error_series(logs(spark, sf))
    return t.withColumn("trailing_mean", F.round("trailing_mean", 9)).withColumn("trailing_stddev", F.round("trailing_stddev", 9))


def _header_values(spark, sf):
    lg = logs(spark, sf)
    eff = N.effective_severity()
    return lg.select(
        "id", eff.alias("effective_severity"), N.effective_color().alias("effective_color"),
        N.effective_source().alias("effective_source"), N.category_normalized("derived_category").alias("category"),
        N.is_standard_severity("severity").alias("is_standard"), N.is_valid_severity("severity").alias("is_valid"),
        N.severity_rank(eff).alias("rank"), N.capitalized(eff).alias("label"),
        N.auto_color(eff).alias("auto_color"), N.rfc3339("created_at").alias("created_text"),
    )


def _doc_search(spark, sf):
    return Q.total(Q.search(doc_logs(spark, sf), Q.LogFilter(search="the")))


def _text_counts(d):
    return d.groupBy(N.effective_severity().alias("severity"), F.col("derived_category").alias("category"),
                     F.col("derived_source").alias("source")).agg(F.count(F.lit(1)).alias("n"))


def _approx(spark, sf):
    return M.approx_percentiles(access(spark, sf), "duration_ms", M.DEFAULT_PERCENTILES, ("path",))


def _approx_bounds(spark, sf):
    """Per path and percentile: whether the approximate value lies within one
    hundredth of the ranks around the exact one."""
    acc = access(spark, sf).filter(F.col("duration_ms").isNotNull())
    approx = _approx(spark, sf)
    ranked = acc.join(approx, "path")
    out = ranked.groupBy("path").agg(
        F.max("n").alias("n"),
        *[F.count_if(F.col("duration_ms") < F.col(f"p{p}")).alias(f"below{p}") for p in M.DEFAULT_PERCENTILES],
        *[F.count_if(F.col("duration_ms") <= F.col(f"p{p}")).alias(f"upto{p}") for p in M.DEFAULT_PERCENTILES])
    ok = [((F.col(f"below{p}") <= F.col("n") * (p / 100 + 0.01)) & (F.col(f"upto{p}") >= F.col("n") * (p / 100 - 0.01)))
          .alias(f"p{p}_within") for p in M.DEFAULT_PERCENTILES]
    return out.select("path", "n", *ok)


def _fresh(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run of a streaming query."""
    return f"{checkpoint_dir(spark)}/logspark-{name}-{uuid.uuid4().hex}"


#: The events arrive in three parts, cut at these times.
CUTS = ("2024-01-11 00:00:00", "2024-01-21 00:00:00")


def _part(frame: DataFrame, i: int) -> DataFrame:
    lo, hi = (None, *CUTS)[i], (*CUTS, None)[i]
    t = F.col("ts")
    if lo:
        frame = frame.filter(t >= F.lit(lo).cast("timestamp_ntz"))
    return frame.filter(t < F.lit(hi).cast("timestamp_ntz")) if hi else frame


def _arriving(spark: SparkSession, sf: str, base: str, i: int, kind: str = "events") -> None:
    """Part ``i`` of the events (or of the error events) arrives as files."""
    part = _part(events(spark, sf), i)
    if kind == "deletes":
        part = part.filter(F.col("event_type") == "error")
    part.write.mode("append").parquet(f"{base}/{kind}")


def _arrived(spark: SparkSession, base: str, kind: str = "events") -> DataFrame:
    from logspark.streaming import stream as ST

    return ST.events_stream(spark, f"{base}/{kind}", glob="*.parquet")


def _stream_logs(spark, sf):
    from logspark.streaming import stream as ST

    return enrich(AD.raw_logs(ST.events_stream(spark, sf)))


def _stream_deleted(spark, sf):
    """The logs of error events, as a stream of deleted records."""
    from logspark.streaming import stream as ST

    return enrich(AD.raw_logs(ST.events_stream(spark, sf).filter(F.col("event_type") == "error")))


def _stream_enriched(spark, sf):
    from logspark.streaming import stream as ST

    return ST.run_available(_stream_logs(spark, sf), _fresh(spark, "enrich")).result


def _stream_running(spark, sf):
    from logspark.streaming import stream as ST

    feed = ST.change_feed(_stream_logs(spark, sf), _stream_deleted(spark, sf))
    return ST.run_available(ST.running_stats(feed), _fresh(spark, "running"), "update", ("kind", "key")).result


def _windowed(order, watermark, sliding=False):
    """A windowed count over the three parts, each its own micro-batch, with
    the number of rows that came too late in a column of its own."""
    def build(spark, sf):
        from logspark.streaming import stream as ST

        base, entered, result = _fresh(spark, "windows"), 0, None
        for i in order:
            _arriving(spark, sf, base, i)
            result, more = ST.run_available(ST.hourly_counts(enrich(AD.raw_logs(_arrived(spark, base))), watermark),
                                            f"{base}/run", "update", ("hour",))
            entered += more
        dropped = F.lit(ST.not_counted(result, "total", entered)).cast("bigint")
        return (ST.sliding_day_counts(result) if sliding else result).withColumn("dropped", dropped)
    return build


def _stream_ring(spark, sf):
    from logspark.streaming import stream as ST

    acc = AD.access_logs(ST.events_stream(spark, sf))
    return ST.run_available(ST.last_durations(acc, 100), _fresh(spark, "ring"), "update", ("path",)).result


def _stream_progress(spark, sf):
    """Per second, the parts in order of time (a second never spans two)."""
    from logspark.streaming import stream as ST

    base, result = _fresh(spark, "progress"), None
    for i in range(3):
        _arriving(spark, sf, base, i)
        result = ST.run_available(ST.progress(AD.access_logs(_arrived(spark, base)), "10 seconds"),
                                  f"{base}/run", "update", ("second",)).result
    return result


def _stream_tail(spark, sf):
    """Logs arrive in order of time, the deletes of error events the other way
    round: those of the last part before their logs, those of the first after."""
    from logspark.streaming import stream as ST

    base, tail = _fresh(spark, "tail"), None
    for i in range(3):
        _arriving(spark, sf, base, i)
        _arriving(spark, sf, base, 2 - i, "deletes")
        gone = enrich(AD.raw_logs(_arrived(spark, base, "deletes"))).select("id")
        tail = ST.live_tail(enrich(AD.raw_logs(_arrived(spark, base))), gone, f"{base}/run", 100)
    return tail


def _stream_snapshots(spark, sf):
    """The snapshot after each of the three parts."""
    from logspark.streaming import stream as ST

    base, out = _fresh(spark, "snapshots"), None
    for i in range(3):
        _arriving(spark, sf, base, i)
        out = ST.stats_snapshots(enrich(AD.raw_logs(_arrived(spark, base))), f"{base}/run")
    return out


_INGESTED: dict[tuple, str] = {}


def _ingested(spark, sf):
    """The three parts, streamed into a store; once per application and input."""
    from logspark.streaming import stream as ST

    key = (spark.sparkContext.applicationId, *inputs_of(events(spark, sf)))
    if key in _INGESTED:
        return _INGESTED[key]
    base = _fresh(spark, "ingest")
    for i in range(3):
        _arriving(spark, sf, base, i)
        ST.ingest_stream(AD.raw_logs(_arrived(spark, base)), f"{base}/run", f"{base}/store")
    _INGESTED[key] = base
    return base


def _stream_ingest(spark, sf):
    return read_logs(spark, f"{_ingested(spark, sf)}/store")


def _stream_rejected(spark, sf):
    return spark.read.parquet(f"{_ingested(spark, sf)}/run/rejected").select("id", "created_at", "title", "reason")


def _stream_feed(spark, sf):
    return spark.read.parquet(f"{_ingested(spark, sf)}/run/feed").select("type", "id", "severity", "source", "created_at", "title", "data")


def _stream_numbered(spark, sf):
    """The three parts without ids; each micro-batch numbers its own."""
    from logspark.streaming import stream as ST

    base = _fresh(spark, "numbered")
    for i in range(3):
        _arriving(spark, sf, base, i)
        ST.ingest_stream(AD.raw_logs(_arrived(spark, base)).drop("id"), f"{base}/run", f"{base}/store", number=True)
    return read_logs(spark, f"{base}/store").select("id", "created_at", "title")


_SKETCHED: dict[tuple, str] = {}


def _sketches(spark, sf):
    """Latency sketches kept while the three parts arrive; once per application and input."""
    from logspark.streaming import stream as ST

    key = (spark.sparkContext.applicationId, *inputs_of(events(spark, sf)))
    if key not in _SKETCHED:
        base = _fresh(spark, "sketches")
        for i in range(3):
            _arriving(spark, sf, base, i)
            ST.keep_latency(AD.access_logs(_arrived(spark, base)), f"{base}/run")
        _SKETCHED[key] = base
    return K.read_sketches(spark, f"{_SKETCHED[key]}/run/sketches")


def _ranked_within(records, got, by):
    """``got`` with, for each percentile, whether it lies within four times the
    stated rank error of the ranks of ``records`` around it."""
    ranked = records.filter(F.col("duration_ms").isNotNull()).join(got, by)  # got: a row for each group
    err = 4 * K.RANK_ERROR
    pcts = [p for p in M.DEFAULT_PERCENTILES if f"p{p}" in got.columns]
    counts = [F.count_if(c).alias(f"{name}{p}") for p in pcts for name, c in (
        ("below", F.col("duration_ms") < F.col(f"p{p}")), ("upto", F.col("duration_ms") <= F.col(f"p{p}")))]
    facts = [c for c in ("sent", "failed", "max", "rate_per_sec") if c in got.columns]
    out = ranked.groupBy(by).agg(*[F.max(c).alias(c) for c in facts], *counts)
    ok = [((F.col(f"below{p}") <= F.col("sent") * (p / 100 + err)) & (F.col(f"upto{p}") >= F.col("sent") * (p / 100 - err)))
          .alias(f"p{p}_within") for p in pcts]
    return out.select(by, *facts, *ok)


def _sketch_report(spark, sf):
    return _ranked_within(access(spark, sf), K.merged(_sketches(spark, sf), ("path",)).drop("rate_per_sec"), "path")


def _sketch_hours(spark, sf):
    records = access(spark, sf).withColumn("hour", trunc_ntz("ts", "hour"))
    return _ranked_within(records, K.merged(_sketches(spark, sf), ("hour",), (95,)).drop("rate_per_sec"), "hour")


SPAN = ("2024-01-09 12:20:30", "2024-01-28 17:23:45.678901")


def _sketch_span(spark, sf):
    """F27 for a span that cuts hours in two."""
    acc = access(spark, sf)
    got = K.merged(K.spanning(_sketches(spark, sf), acc, *SPAN)).withColumn("span", F.lit("all"))
    lo, hi = (F.lit(v).cast("timestamp_ntz") for v in SPAN)
    records = acc.filter((F.col("ts") >= lo) & (F.col("ts") < hi)).withColumn("span", F.lit("all"))
    return _ranked_within(records, got, "span").drop("span")


def _heavy_bounds(spark, sf):
    """The candidates' bounds next to the exact counts."""
    path = _table(spark, sf)
    exact = S.top_sources(read_logs(spark, path), HV.TRACKED)
    return exact.join(HV.heavy_sources(spark, path), "source").select(
        "source", ((F.col("at_least") <= F.col("n")) & (F.col("n") <= F.col("at_most"))).alias("within"))


_MAINTAINED: dict[tuple, str] = {}


def _maintained(spark, sf):
    """One table: streamed into, appended to, deleted from, streamed into again,
    expired, and a last run of the stream that finds nothing new.  Deletes and
    retention announce what they remove in ``deletes``.  Once per application
    and input."""
    from logspark.streaming import stream as ST

    key = (spark.sparkContext.applicationId, *inputs_of(events(spark, sf)))
    if key in _MAINTAINED:
        return _MAINTAINED[key]
    base = _fresh(spark, "maintained")
    store, feed = f"{base}/store", f"{base}/deletes"
    for i in range(3):
        _arriving(spark, sf, base, i)
        ST.ingest_stream(AD.raw_logs(_arrived(spark, base)), f"{base}/run", store)
        if i == 0:
            extra = enrich(AD.raw_logs(spread(events(spark, sf).filter(F.col("event_type") == "view"))))
            append(extra.withColumn("id", -F.col("id") - 1), store)
        if i == 1:
            H.delete_from_table(spark, store, events(spark, sf).filter(F.col("event_type") == "error")
                                .select(F.col("event_id").alias("id")), feed=feed)
    H.cleanup_table(spark, store, 20, AS_OF, feed=feed)
    ST.ingest_stream(AD.raw_logs(_arrived(spark, base)), f"{base}/run", store)
    _MAINTAINED[key] = base
    return base


def _table(spark, sf):
    return f"{_maintained(spark, sf)}/store"


def _store_maintained(spark, sf):
    return read_logs(spark, _table(spark, sf)).select("id", "title", "created_at", "log_date")


def _deletes_published(spark, sf):
    return spark.read.parquet(f"{_maintained(spark, sf)}/deletes").select("type", "id", "severity", "source", "created_at", "data")


GONE_ID = 500


def _delete_one_stored(spark, sf):
    """The report of one delete on a table of its own, next to what is left and
    what was announced."""
    base = _fresh(spark, "delete-one")
    append(logs(spark, sf), f"{base}/store")
    report = H.delete_one_from_table(spark, f"{base}/store", GONE_ID, feed=f"{base}/feed")
    left = read_logs(spark, f"{base}/store").agg(F.count(F.lit(1)).alias("left"), F.count_if(F.col("id") == GONE_ID).alias("left_of_id"))
    said = spark.read.schema("id long, severity string").parquet(f"{base}/feed").agg(
        F.count(F.lit(1)).alias("announced"), F.max("severity").alias("severity"))
    return left.join(F.broadcast(said)).select(F.lit(report["id"]).cast("bigint").alias("id"), F.lit(report["deleted"]).cast("bigint").alias("deleted"),
                                               F.lit(report["found"]).alias("found"), "left", "left_of_id", "announced", "severity")


def _live(order):
    """Running statistics over the three parts; the deletes of error events
    hold an id and a time alone and arrive in the opposite order."""
    def build(spark, sf):
        from logspark.streaming import stream as ST

        base, out = _fresh(spark, "live"), None
        for i in order:
            _arriving(spark, sf, base, i)
            _arriving(spark, sf, base, 2 - i, "deletes")
            gone = _arrived(spark, base, "deletes").select(
                F.col("event_id").alias("id"), (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.floor("value").cast("int"))).alias("deleted_at"))
            out = ST.live_stats(enrich(AD.raw_logs(_arrived(spark, base))), gone, f"{base}/run", "40 days", "90 days")
        return out
    return build


def _nested_ingest(spark, sf):
    """A1: every event as a nested JSON line {"header": {...}, "body": ...},
    decoded with the fixed nested schema, lifted to flat form and enriched.
    A body that is not JSON travels as a JSON string (and is rejected)."""
    from logspark.operators.enrich import from_nested
    from logspark.schema import RAW_NESTED

    raw = AD.raw_logs(events(spark, sf))
    as_json_string = F.regexp_extract(F.to_json(F.array("body")), r"^\[(.*)\]$", 1)
    body_part = (F.when(F.col("body").isNull(), F.lit(""))
                 .when(whole_body(parsed_body("body")).isNotNull(), F.concat(F.lit(',"body":'), F.col("body")))
                 .otherwise(F.concat(F.lit(',"body":'), as_json_string)))
    header = F.to_json(F.struct("title", "severity", "source", "color", "description"))
    line = F.concat(F.lit('{"header":'), header, body_part, F.lit("}"))
    decoded = raw.select("id", "created_at", F.from_json(line, RAW_NESTED).alias("r"))
    return enrich(from_nested(decoded.select("id", "created_at", "r.header", "r.body")))


def _tolerant(spark, sf):
    from logspark.sources.store import tolerant

    return tolerant(logs(spark, sf))


def _request_span(spark, sf):
    from logspark.functions.formatting import duration_text, epoch_micros

    a = access(spark, sf)
    span = a.groupBy("path").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    secs = ((epoch_micros(F.col("last_ts")) - epoch_micros(F.col("first_ts"))) / 1_000_000).cast("bigint")
    return span.select("path", "first_ts", "last_ts", secs.alias("elapsed_s"), duration_text(secs).alias("elapsed"))


def _record_json(spark, sf):
    return Q.record_json(logs(spark, sf))


def _event_feed(spark, sf):
    from logspark.streaming import stream as ST

    lg = logs(spark, sf)
    gone = lg.join(_delete_list(spark, sf).distinct(), "id", "left_semi")
    return ST.change_feed(lg, gone)


def _json(x: str) -> str:
    """JSON string of a text, with the escapes of the stored form."""
    out = f"CAST(to_json({x}) AS VARCHAR)"
    for ch, text in (("'<'", "u003c"), ("'>'", "u003e"), ("'&'", "u0026"), ("chr(8232)", "u2028"), ("chr(8233)", "u2029")):
        out = f"replace({out}, {ch}, '\\{text}')"
    return out


def _field(name: str, value: str) -> str:
    return f"""'"{name}":' || {_json(value)}"""


def record_sql(empty: bool) -> str:
    """JSON of the record view; ``empty``: of the event view, which keeps empty
    optional fields."""
    opt = (lambda c: f"coalesce({c}, '')") if empty else (lambda c: c)
    header = ", ".join([_field("title", "title"), _field("severity", EFF), _field("source", opt("source")),
                        _field("color", eff_color_sql()), _field("description", opt("description"))])
    meta = ", ".join(_field(c, opt(c)) for c in ("derived_severity", "derived_source", "derived_category"))
    return (f"""'{{"id":' || id || ',"header":{{' || concat_ws(',', {header}) || '}},"body":' || body || ',"metadata":{{' """
            f"""|| concat_ws(',', {meta}) || '}},' || {_field("created_at", RFC3339)} || '}}'""")


CREATED_SQL = f"SELECT 'log_created' AS type, id, {EFF} AS severity, source, created_at, title, {record_sql(True)} AS data FROM logs"


def build_registry() -> list[Registered]:
    R: list[Registered] = []

    def reg(name, build, sql, covers):
        R.append(Registered(name, build, sql, covers))

    # --- ingest and enrichment
    reg("enriched_logs", enriched, O.with_logs("SELECT * FROM logs"), "A2-A5 B1 B2 C1-C17 D1-D7")
    reg("stored_logs", logs, O.with_logs("SELECT * FROM logs"), "A6 A9")
    reg("rejected_logs", lambda s, sf: ingest(AD.raw_logs(events(s, sf))).rejected,
        O.with_logs("SELECT * FROM rejected"), "A3")
    reg("header_values", _header_values, O.with_logs(f"""SELECT id, {EFF} AS effective_severity,
  {eff_color_sql()} AS effective_color, coalesce(derived_source, source) AS effective_source,
  CASE WHEN derived_category IN ('http','database','security','performance','business','system','general')
       THEN derived_category ELSE 'general' END AS category,
  severity IN ('debug','info','success','warning','error','critical') AS is_standard,
  coalesce(severity <> '', false) AS is_valid,
  {rank_sql(EFF)} AS rank, upper(substr({EFF}, 1, 1)) || substr({EFF}, 2) AS label,
  CASE {EFF} {' '.join(f"WHEN '{s}' THEN '{c}'" for s, c in AUTO_COLORS)} ELSE 'slate' END AS auto_color,
  {RFC3339} AS created_text FROM logs"""), "B3-B8 B12 B14")
    reg("assigned_ids", lambda s, sf: assign_ids(AD.raw_logs(events(s, sf)).drop("id"), 0, ("created_at",))
        .select("id", "created_at", "title"),
        f"WITH raw AS ({O.raw_logs_sql()}) SELECT row_number() OVER (ORDER BY created_at) AS id, created_at, title FROM raw",
        "A8")
    reg("nested_json_ingest", _nested_ingest, O.with_logs("SELECT * FROM logs"), "A1")
    reg("tolerant_scan", _tolerant, O.with_logs("SELECT * FROM logs"), "A7")
    reg("record_json", _record_json, O.with_logs(f"SELECT id, {record_sql(False)} AS json FROM logs"), "B9 (JSON text)")
    reg("change_feed_batch", _event_feed, O.with_logs(CREATED_SQL + f"""
UNION ALL SELECT 'log_deleted', id, {EFF}, source, created_at, NULL, '{{"id":' || id || '}}' FROM logs
WHERE id IN (SELECT id FROM {DELETE_LIST_SQL} d)"""), "B10 J2 (batch form)")
    reg("lookup_one", lambda s, sf: Q.lookup(logs(s, sf), 4242), O.with_logs("SELECT * FROM logs WHERE id = 4242"), "A11")

    # --- statistics
    reg("severity_counts", lambda s, sf: S.severity_counts(logs(s, sf)),
        O.with_logs(f"SELECT {EFF} AS severity, count(*) AS n FROM logs GROUP BY 1"), "F3 F12")
    reg("source_counts", lambda s, sf: S.source_counts(logs(s, sf)),
        O.with_logs("SELECT coalesce(source, 'unknown') AS source, count(*) AS n FROM logs GROUP BY 1"), "F4")
    reg("stats_bundle", lambda s, sf: S.stats_long(logs(s, sf), AS_OF), O.with_logs(f"""SELECT 'total' AS kind, CAST(NULL AS VARCHAR) AS key, count(*) AS n FROM logs
UNION ALL SELECT 'last_24_hours', NULL, count(*) FILTER (WHERE created_at >= {ts(AS_OF)} - INTERVAL 24 HOUR) FROM logs
UNION ALL SELECT 'by_severity', {EFF}, count(*) FROM logs GROUP BY 2
UNION ALL SELECT 'by_source', coalesce(source, 'unknown'), count(*) FROM logs GROUP BY 2"""), "F1 F2 F5")
    reg("stats_served", lambda s, sf: S.stats(logs(s, sf), AS_OF).withColumns(
        {c: F.to_json(c) for c in ("by_severity", "by_source")}), O.with_logs(f""", sev AS (
  SELECT {EFF} AS k, count(*) AS n FROM logs GROUP BY 1), src AS (SELECT coalesce(source, 'unknown') AS k, count(*) AS n FROM logs GROUP BY 1)
SELECT (SELECT count(*) FROM logs) AS total,
  (SELECT count(*) FROM logs WHERE created_at >= {ts(AS_OF)} - INTERVAL 24 HOUR) AS last_24_hours,
  (SELECT '{{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}}' FROM sev) AS by_severity,
  (SELECT '{{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}}' FROM src) AS by_source"""), "F5 (served form)")
    reg("stats_printout", lambda s, sf: S.stats_printout(logs(s, sf), AS_OF), O.with_logs(f"""SELECT * FROM (
SELECT 'by_severity' AS kind, {EFF} AS key, count(*) AS n FROM logs GROUP BY 2
UNION ALL SELECT 'by_source', coalesce(source, 'unknown'), count(*) FROM logs GROUP BY 2) ORDER BY kind, key"""), "F6")
    reg("category_counts", lambda s, sf: S.category_counts(logs(s, sf)),
        O.with_logs("SELECT derived_category AS category, count(*) AS n FROM logs GROUP BY 1"), "F28")
    reg("error_rate", lambda s, sf: S.error_rate(logs(s, sf)), O.with_logs(f""", c AS (
  SELECT count(*) AS total, count(*) FILTER (WHERE {EFF} IN ('error', 'critical')) AS errors FROM logs)
SELECT total, errors, CASE WHEN total > 0 THEN CAST(errors AS DOUBLE) / CAST(total AS DOUBLE) * 100.0 ELSE 0.0 END AS error_rate FROM c"""), "F7")
    reg("severity_breakdown", lambda s, sf: S.severity_breakdown(logs(s, sf)), O.with_logs(f""", c AS (
  SELECT {EFF} AS severity, count(*) AS n FROM logs GROUP BY 1)
SELECT severity, upper(substr(severity, 1, 1)) || substr(severity, 2) AS label, {rank_sql('severity')} AS rank, n,
  CAST(floor(CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) * 100.0 + 0.5) AS BIGINT) AS percentage FROM c"""), "F8 G3 B14")
    reg("age_buckets", _age_buckets(AS_OF), _age_buckets_sql(AS_OF), "F9")
    reg("age_buckets_later", _age_buckets(AS_OF_LATER), _age_buckets_sql(AS_OF_LATER), "F9")
    reg("age_buckets_month_end", _age_buckets(AS_OF_MONTH_END), _age_buckets_sql(AS_OF_MONTH_END), "F9 F11")
    reg("retention_info", lambda s, sf: S.retention_info(logs(s, sf), AS_OF_LATER), O.with_logs(f""", b AS (SELECT created_at, {bucket_sql(AS_OF_LATER)} AS bucket FROM logs)
SELECT count(*) AS total, count(*) FILTER (WHERE created_at >= {ts(AS_OF_LATER)} - INTERVAL 24 HOUR) AS last_24_hours,
  {', '.join(f"count(*) FILTER (WHERE bucket = '{x}') AS {x}" for x in AGE_BUCKETS)} FROM b"""), "F10")
    reg("by_color", lambda s, sf: S.by_color(logs(s, sf)),
        O.with_logs(f"SELECT {eff_color_sql()} AS color, count(*) AS n FROM logs GROUP BY 1"), "F13 B6")
    reg("error_rate_24h", lambda s, sf: S.error_rate_24h(logs(s, sf), AS_OF), O.with_logs(f""", c AS (
  SELECT count(*) FILTER (WHERE created_at >= {ts(AS_OF)} - INTERVAL 24 HOUR) AS total,
         count(*) FILTER (WHERE created_at >= {ts(AS_OF)} - INTERVAL 24 HOUR AND {EFF} IN ('error', 'critical')) AS errors FROM logs)
SELECT total, errors, {pct_sql('errors', 'total')} AS error_rate_24h FROM c"""), "F14 F22")
    reg("top_sources", lambda s, sf: S.top_sources(logs(s, sf)), O.with_logs(
        "SELECT coalesce(derived_source, source, 'unknown') AS source, count(*) AS n FROM logs GROUP BY 1 ORDER BY n DESC, source ASC LIMIT 10"),
        "F15")
    reg("hourly_distribution", lambda s, sf: S.hourly_distribution(logs(s, sf)), O.with_logs(
        """SELECT CAST(h.hour AS INTEGER) AS hour, CAST(count(l.created_at) AS BIGINT) AS n
FROM generate_series(0, 23) h(hour) LEFT JOIN logs l ON hour(l.created_at) = h.hour GROUP BY h.hour"""), "F16")
    reg("pattern_stats", lambda s, sf: S.pattern_stats(logs(s, sf)), O.with_logs(
        """SELECT count(*) FILTER (WHERE code IS NOT NULL) AS http_codes, count(*) FILTER (WHERE s_stack) AS stack_traces,
  count(*) FILTER (WHERE s_security) AS security_issues,
  count(*) FILTER (WHERE s_perf IS NOT NULL OR duration_ms IS NOT NULL) AS performance_issues FROM steps"""), "F17")
    reg("detection_accuracy", lambda s, sf: S.detection_accuracy(logs(s, sf)), O.with_logs(f""", c AS (
  SELECT count(*) AS explicit, count(*) FILTER (WHERE v_severity = severity) AS agreeing FROM verdicts WHERE severity <> 'info')
SELECT explicit, agreeing, {pct_sql('agreeing', 'explicit')} AS accuracy FROM c"""), "F18")
    reg("trends", _trends, O.with_logs(_trends_sql(AS_OF) + """
SELECT total_24h, errors_24h, errors_prev_24h, errors_24h > errors_prev_24h AS increasing,
  CASE WHEN errors_prev_24h > 0 THEN CAST(errors_24h - errors_prev_24h AS DOUBLE) / CAST(errors_prev_24h AS DOUBLE) * 100.0 END AS change_pct,
  last_hour, round(hourly_mean, 9) AS hourly_mean, round(hourly_stddev, 9) AS hourly_stddev,
  CAST(last_hour AS DOUBLE) > hourly_mean + 3.0 * hourly_stddev AS spike FROM tr"""), "F19")
    alert_sql = O.with_logs(_trends_sql(AS_OF) + f""",
tr2 AS (SELECT *, errors_24h > errors_prev_24h AS increasing,
  CASE WHEN errors_prev_24h > 0 THEN CAST(errors_24h - errors_prev_24h AS DOUBLE) / CAST(errors_prev_24h AS DOUBLE) * 100.0 END AS change_pct,
  CAST(last_hour AS DOUBLE) > hourly_mean + 3.0 * hourly_stddev AS spike,
  CAST(errors_24h AS DOUBLE) / CAST(total_24h AS DOUBLE) * 100.0 AS rate FROM tr)
SELECT 'High error rate: ' || {fixed3_sql('rate')} || '% in the last 24 hours' AS alert FROM tr2 WHERE total_24h > 0 AND rate > 10.0
UNION ALL SELECT 'Error spike: ' || last_hour || ' errors in the last hour' FROM tr2 WHERE spike
UNION ALL SELECT 'Errors increasing: +' || {fixed3_sql('change_pct')} || '% vs the previous 24 hours' FROM tr2 WHERE increasing AND change_pct IS NOT NULL""")
    reg("alerts", lambda s, sf: S.alerts(logs(s, sf), AS_OF), alert_sql, "F20")
    reg("hourly_error_series", _hourly_series, O.with_logs(f""", c AS (
  SELECT date_trunc('hour', created_at) AS hour, count(*) AS total,
         count(*) FILTER (WHERE {EFF} IN ('error', 'critical')) AS errors FROM logs GROUP BY 1),
g AS (SELECT unnest(generate_series((SELECT min(hour) FROM c), (SELECT max(hour) FROM c), INTERVAL 1 HOUR)) AS hour),
s AS (SELECT g.hour, CAST(coalesce(c.total, 0) AS BIGINT) AS total, CAST(coalesce(c.errors, 0) AS BIGINT) AS errors
      FROM g LEFT JOIN c ON c.hour = g.hour),
w AS (SELECT hour, total, errors,
        avg(CAST(errors AS DOUBLE)) OVER win AS m, stddev_pop(CAST(errors AS DOUBLE)) OVER win AS sd
      FROM s WINDOW win AS (ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT hour, total, errors, round(m, 9) AS trailing_mean, round(sd, 9) AS trailing_stddev,
  CAST(errors AS DOUBLE) > m + 3.0 * sd AS spike FROM w
WHERE EXISTS (SELECT 1 FROM c WHERE c.hour <= w.hour AND c.hour >= w.hour - INTERVAL 24 HOUR)"""), "G4")
    reg("filter_options", lambda s, sf: S.filter_options(logs(s, sf)), O.with_logs(f"""SELECT DISTINCT 'severity' AS kind, {EFF} AS value FROM logs
UNION ALL SELECT DISTINCT 'source', coalesce(source, 'unknown') FROM logs"""), "E16")

    # --- search, paging, views
    cols = "id, title, severity, source, color, description, body, derived_severity, derived_source, derived_category, created_at, log_date"
    reg("search_page", lambda s, sf: Q.page(Q.search(logs(s, sf), Q.LogFilter(search="request")), 20, 20),
        O.with_logs(f"SELECT {cols} FROM logs WHERE {search_sql('request')} {NEWEST} LIMIT 20 OFFSET 20"), "E1 E9 E10")
    reg("search_wildcard_total", lambda s, sf: Q.total(Q.search(logs(s, sf), Q.LogFilter(search="re_uest"))),
        O.with_logs(f"SELECT count(*) AS total FROM logs WHERE {search_sql('re_uest')}"), "E1 E13")
    reg("filtered_page", lambda s, sf: Q.page_number(Q.search(logs(s, sf), _filtered()), 2, 50),
        O.with_logs(f"""SELECT {cols} FROM logs WHERE severity = 'error' AND source = 'api'
  AND created_at >= {ts('2024-01-05 00:00:00')} AND created_at <= {ts('2024-01-20 00:00:00')} {NEWEST} LIMIT 50 OFFSET 50"""),
        "E2 E3 E5 E6 E7 E11")
    reg("color_effective_filter", lambda s, sf: Q.total(Q.search(logs(s, sf), Q.LogFilter(color="red", severity="critical", effective=True))),
        O.with_logs(f"SELECT count(*) AS total FROM logs WHERE color = 'red' AND {EFF} = 'critical'"), "E2 E4")
    reg("day_page", lambda s, sf: Q.page(Q.search(logs(s, sf), Q.day_filter("2024-01-10")), 100, 0),
        O.with_logs(f"""SELECT {cols} FROM logs WHERE created_at >= {ts('2024-01-10 00:00:00')}
  AND created_at <= {ts('2024-01-11 00:00:00')} {NEWEST} LIMIT 100"""), "E8 E12")
    reg("page_info", lambda s, sf: Q.page_info(Q.search(logs(s, sf), Q.LogFilter(search="error")), 25, 50),
        O.with_logs(f""", t AS (SELECT count(*) AS total FROM logs WHERE {search_sql('error')}),
v AS (SELECT total, 25 AS "limit", 50 AS "offset", 3 AS page, CAST(ceil(total / 25) AS BIGINT) AS total_pages,
  CAST(greatest(least(total - 50, 25), 0) AS BIGINT) AS shown FROM t)
SELECT *, CASE WHEN 50 > 0 OR total > shown THEN 'Showing ' || 51 || '-' || (50 + shown) || ' of ' || total || ' logs' END AS summary FROM v"""),
        "E13 E14 E15")
    reg("list_view", lambda s, sf: Q.list_view(logs(s, sf)), O.with_logs(f"""SELECT id, {EFF} AS severity, coalesce(source, '-') AS source,
  CASE WHEN strlen(title) > 50 THEN substr(title, 1, 47) || '...' ELSE title END AS title,
  strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created FROM logs"""), "B13")
    reg("flat_view", lambda s, sf: Q.flat_view(logs(s, sf)), O.with_logs(f"""SELECT id, title, {EFF} AS severity, source, {eff_color_sql()} AS color,
  description, body, derived_severity, derived_source, derived_category, {RFC3339} AS created_at FROM logs"""), "B9 B12")
    reg("receipts", lambda s, sf: Q.receipt(logs(s, sf)),
        O.with_logs(f"SELECT id, title, {EFF} AS severity, {RFC3339} AS created_at FROM logs"), "B11")
    reg("export_csv_rows", lambda s, sf: X.csv_rows(X.export_rows(logs(s, sf), X.export_request("csv"))),
        O.with_logs(f"""SELECT id, {EFF} AS severity, coalesce(source, '') AS source, title, coalesce(description, '') AS description,
  {RFC3339} AS created_at FROM logs"""), "I2 I3")
    reg("export_csv_newest", lambda s, sf: X.csv_rows(X.export_rows(logs(s, sf), X.export_request("csv", 500))),
        O.with_logs(f"""SELECT id, {EFF} AS severity, coalesce(source, '') AS source, title, coalesce(description, '') AS description,
  {RFC3339} AS created_at FROM logs {NEWEST} LIMIT 500"""), "I3 (a named limit)")
    reg("export_json_rows", lambda s, sf: Q.record_json(X.export_rows(logs(s, sf), X.export_request("json"))),
        O.with_logs(f"SELECT id, {record_sql(False)} AS json FROM logs"), "I1")
    reg("export_dashboard_rows", lambda s, sf: X.dashboard_csv_rows(logs(s, sf)),
        O.with_logs(f"""SELECT id AS "ID", {RFC3339} AS "Timestamp", {EFF} AS "Severity", title AS "Title",
  coalesce(source, '') AS "Source", coalesce(description, '') AS "Description" FROM logs"""), "I4")

    # --- deletes and retention
    reg("delete_one", lambda s, sf: H.delete_id(logs(s, sf), 1234).report,
        O.with_logs("SELECT CAST(1234 AS BIGINT) AS id, count(*) FILTER (WHERE id = 1234) AS deleted, count(*) FILTER (WHERE id = 1234) > 0 AS found FROM logs"),
        "H1")
    reg("delete_one_kept", lambda s, sf: H.delete_id(logs(s, sf), 1234).kept.select("id", "title", "created_at"),
        O.with_logs("SELECT id, title, created_at FROM logs WHERE id <> 1234"), "H1 (kept rows)")
    reg("delete_list_report", lambda s, sf: H.delete_ids(logs(s, sf), _delete_list(s, sf)).report,
        O.with_logs(f""", w AS (SELECT DISTINCT id FROM {DELETE_LIST_SQL} d),
r AS (SELECT (SELECT count(*) FROM w) AS requested, (SELECT count(*) FROM logs WHERE id IN (SELECT id FROM w)) AS deleted)
SELECT requested, deleted, requested - deleted AS missing FROM r"""), "H2")
    reg("delete_list_kept", lambda s, sf: H.delete_ids(logs(s, sf), _delete_list(s, sf)).kept.select("id", "title", "created_at"),
        O.with_logs(f"SELECT id, title, created_at FROM logs WHERE id NOT IN (SELECT id FROM {DELETE_LIST_SQL} d)"), "H2")
    reg("retention_report", lambda s, sf: H.apply_retention(logs(s, sf), 20, AS_OF).report,
        O.with_logs(f""", c AS (SELECT count(*) FILTER (WHERE created_at < {ts('2024-01-09 12:00:00')}) AS deleted FROM logs)
SELECT deleted, {ts('2024-01-09 12:00:00')} AS cutoff, 20 AS days,
  CASE WHEN deleted > 0 THEN 'Cleaned up ' || deleted || ' logs older than 20 days' ELSE 'No logs older than 20 days to clean up' END AS message FROM c"""),
        "H3 H4")
    reg("retention_kept", lambda s, sf: H.apply_retention(logs(s, sf), 20, AS_OF).kept.select("id", "created_at", "log_date"),
        O.with_logs(f"SELECT id, created_at, log_date FROM logs WHERE created_at >= {ts('2024-01-09 12:00:00')}"), "H3")

    # --- request metrics
    acc = O.access_logs_sql()
    reg("request_metrics", lambda s, sf: M.request_metrics(access(s, sf)), f"""WITH a AS ({acc}),
c AS (SELECT count(*) AS total_requests, count(*) FILTER (WHERE status >= 400) AS total_errors FROM a)
SELECT total_requests, total_errors, {pct_sql('total_errors', 'total_requests')} AS error_rate FROM c""", "F21 F22")
    reg("request_metrics_by_path", lambda s, sf: M.request_metrics(access(s, sf), by_path=True), f"""WITH a AS ({acc}),
c AS (SELECT path, count(*) AS total_requests, count(*) FILTER (WHERE status >= 400) AS total_errors FROM a GROUP BY path)
SELECT path, total_requests, total_errors, {pct_sql('total_errors', 'total_requests')} AS error_rate FROM c""", "F21")
    reg("latency_report", lambda s, sf: M.latency_report(access(s, sf)), f"""WITH a AS ({acc}),
r AS (SELECT path, duration_ms AS v, row_number() OVER (PARTITION BY path ORDER BY duration_ms) - 1 AS rn,
        count(*) OVER (PARTITION BY path) AS n FROM a WHERE duration_ms IS NOT NULL)
SELECT path, {', '.join(f'max(CASE WHEN rn = least(n * {p} // 100, n - 1) THEN v END) AS p{p}' for p in M.DEFAULT_PERCENTILES)},
  max(n) AS n, max(v) AS max FROM r GROUP BY path""", "F24 F25 G2")
    reg("latency_report_approx", _approx, None, "F24 approximate")
    reg("latency_approx_bounds", _approx_bounds, f"""WITH a AS ({acc})
SELECT path, count(*) AS n, true AS p50_within, true AS p95_within, true AS p99_within FROM a
WHERE duration_ms IS NOT NULL GROUP BY path""", "F24 approximate, within its bounds")
    timed = f"WITH a AS ({acc}), r AS (SELECT *, date_trunc('hour', ts) AS hour FROM a WHERE duration_ms IS NOT NULL)\n"
    facts = "count(*) AS sent, count(*) FILTER (WHERE status >= 400) AS failed, max(duration_ms) AS max"
    flags = ", ".join(f"true AS p{p}_within" for p in M.DEFAULT_PERCENTILES)
    reg("sketch_latency_report", _sketch_report, f"{timed}SELECT path, {facts}, {flags} FROM r GROUP BY path",
        "F24 F25 (merged sketches, within their rank error)")
    reg("sketch_hourly_p95", _sketch_hours, f"{timed}SELECT hour, {facts}, true AS p95_within FROM r GROUP BY hour",
        "J9 (merged sketches by hour, within their rank error)")
    reg("sketch_span_report", _sketch_span, f"""{timed}SELECT {facts}, {flags},
  CASE WHEN max(ts) > min(ts) THEN count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) ELSE 0.0 END AS rate_per_sec
FROM r WHERE ts >= {ts(SPAN[0])} AND ts < {ts(SPAN[1])}""", "F27 (span of merged sketches)")
    reg("delivery_report", lambda s, sf: M.delivery_report(access(s, sf)), f"""WITH a AS ({acc}),
r AS (SELECT duration_ms AS v, status, ts, row_number() OVER (ORDER BY duration_ms) - 1 AS rn, count(*) OVER () AS n
      FROM a WHERE duration_ms IS NOT NULL),
g AS (SELECT max(n) AS n, count(*) FILTER (WHERE status >= 400) AS failed,
        {', '.join(f'max(CASE WHEN rn = least(n * {p} // 100, n - 1) THEN v END) AS p{p}' for p in M.DEFAULT_PERCENTILES)},
        max(v) AS mx, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS elapsed FROM r)
SELECT n AS sent, n - failed AS success, failed, (n - failed) / n * 100.0 AS success_pct, failed / n * 100.0 AS failed_pct,
  p50, p95, p99, mx AS max, CASE WHEN elapsed > 0 THEN n / elapsed ELSE 0.0 END AS rate_per_sec FROM g""", "F25 F26 F27")
    reg("last_100_per_path", lambda s, sf: M.last_n_per_key(access(s, sf), "path", 100).select("path", "id", "duration_ms", "ts", "recency"),
        f"""WITH a AS ({acc}),
r AS (SELECT path, id, duration_ms, ts, CAST(row_number() OVER (PARTITION BY path ORDER BY ts DESC, id DESC) AS INTEGER) AS recency FROM a)
SELECT * FROM r WHERE recency <= 100""", "G1")
    reg("metrics_exposition", lambda s, sf: M.exposition(access(s, sf)), f"""WITH a AS ({acc}),
c AS (SELECT count(*) AS total_requests, count(*) FILTER (WHERE status >= 400) AS total_errors FROM a)
SELECT 'logspark_http_requests_total' AS name, 'counter' AS type, 'Total number of HTTP requests' AS help, total_requests AS value,
  'logspark_http_requests_total ' || total_requests AS line FROM c
UNION ALL SELECT 'logspark_http_errors_total', 'counter', 'Total number of HTTP errors (4xx and 5xx)', total_errors,
  'logspark_http_errors_total ' || total_errors FROM c""", "I6")
    reg("request_span", _request_span, f"""WITH a AS ({acc}),
s AS (SELECT path, min(ts) AS first_ts, max(ts) AS last_ts,
        CAST(trunc((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000) AS BIGINT) AS elapsed_s FROM a GROUP BY path)
SELECT *, CASE WHEN elapsed_s // 3600 > 0 THEN (elapsed_s // 3600) || 'h ' || (elapsed_s // 60 % 60) || 'm ' || (elapsed_s % 60) || 's'
               WHEN elapsed_s // 60 % 60 > 0 THEN (elapsed_s // 60 % 60) || 'm ' || (elapsed_s % 60) || 's'
               ELSE (elapsed_s % 60) || 's' END AS elapsed FROM s""", "F23")
    progress_sql = f"""WITH a AS ({acc}),
r AS (SELECT date_trunc('second', ts) AS second, status, duration_ms,
        row_number() OVER (PARTITION BY date_trunc('second', ts) ORDER BY duration_ms) AS rn,
        count(*) OVER (PARTITION BY date_trunc('second', ts)) AS n FROM a)
SELECT second, count(*) AS sent, count(*) FILTER (WHERE status >= 400) AS errors,
  max(duration_ms) FILTER (WHERE rn = ceil(n * 0.95)) AS p95 FROM r GROUP BY second"""
    reg("progress_per_second", lambda s, sf: M.progress(access(s, sf)), progress_sql, "J9 (batch)")

    # --- documents as logs: whole texts through search and enrichment
    reg("document_search_total", _doc_search,
        O.with_logs(f"SELECT count(*) AS total FROM logs WHERE {search_sql('the')}", O.document_logs_sql()), "E1 on long texts")
    reg("conversation_enrich_counts", lambda s, sf: _text_counts(conversation_logs(s, sf)), O.with_logs(
        f"SELECT {EFF} AS severity, derived_category AS category, derived_source AS source, count(*) AS n FROM logs GROUP BY 1, 2, 3",
        O.conversation_logs_sql()), "C D on whole turns")
    reg("document_enrich_counts", lambda s, sf: _text_counts(doc_logs(s, sf)), O.with_logs(
        f"SELECT {EFF} AS severity, derived_category AS category, derived_source AS source, count(*) AS n FROM logs GROUP BY 1, 2, 3",
        O.document_logs_sql()), "C D on long texts")

    # --- streaming (availableNow over the events table, read back as batch)
    deleted_ids = "(SELECT event_id FROM events WHERE event_type = 'error')"
    reg("stream_enriched_logs", _stream_enriched, O.with_logs("SELECT * FROM logs"), "J1 A10")
    reg("stream_ingest_store", _stream_ingest, O.with_logs("SELECT * FROM logs"), "A10 A9")
    reg("stream_ingest_rejected", _stream_rejected, O.with_logs("SELECT * FROM rejected"), "A10 A3")
    reg("stream_numbered_store", _stream_numbered, O.with_logs(
        "SELECT row_number() OVER (ORDER BY created_at) AS id, created_at, title FROM logs"), "A8 A10 (ids by micro-batch)")
    reg("stream_ingest_feed", _stream_feed, O.with_logs(CREATED_SQL), "I5 J2 B10")
    reg("stream_store_maintained", _store_maintained, O.with_logs(f""", t AS (
  SELECT id, title, created_at, log_date FROM logs WHERE NOT (id IN {deleted_ids} AND created_at < {ts(CUTS[1])})
  UNION ALL SELECT -id - 1, title, created_at, log_date FROM logs WHERE id IN (SELECT event_id FROM events WHERE event_type = 'view'))
SELECT * FROM t WHERE created_at >= {ts('2024-01-09 12:00:00')}"""), "A9 A10 H2 H3 (one table)")
    table_sql = f""", t AS (
  SELECT * FROM logs WHERE NOT (id IN {deleted_ids} AND created_at < {ts(CUTS[1])})
  UNION ALL SELECT * REPLACE (-id - 1 AS id) FROM logs WHERE id IN (SELECT event_id FROM events WHERE event_type = 'view')),
m AS (SELECT * FROM t WHERE created_at >= {ts('2024-01-09 12:00:00')})"""
    odd = "2024-01-28 17:23:45.678901"      # cuts hours in two
    reg("store_deletes_feed", _deletes_published, O.with_logs(table_sql + f"""
SELECT 'log_deleted' AS type, id, {EFF} AS severity, source, created_at, '{{"id":' || id || '}}' AS data FROM (
  SELECT * FROM t WHERE created_at < {ts('2024-01-09 12:00:00')}
  UNION ALL SELECT * FROM logs WHERE id IN {deleted_ids} AND created_at < {ts(CUTS[1])})"""), "J2 H2 H3 (announced deletes)")
    reg("store_delete_one", _delete_one_stored, O.with_logs(f"""SELECT CAST({GONE_ID} AS BIGINT) AS id, count(*) FILTER (WHERE id = {GONE_ID}) AS deleted,
  count(*) FILTER (WHERE id = {GONE_ID}) > 0 AS found, count(*) FILTER (WHERE id <> {GONE_ID}) AS "left", CAST(0 AS BIGINT) AS left_of_id,
  count(*) FILTER (WHERE id = {GONE_ID}) AS announced, max({EFF}) FILTER (WHERE id = {GONE_ID}) AS severity FROM logs"""), "H1 A11 J2 (stored table)")
    reg("rollup_severity_counts", lambda s, sf: S.severity_counts(RU.rolled(s, _table(s, sf))),
        O.with_logs(table_sql + f"SELECT {EFF} AS severity, count(*) AS n FROM m GROUP BY 1"), "F3 F12 (rollup)")
    reg("rollup_stats_bundle", lambda s, sf: S.stats_long(RU.rolled(s, _table(s, sf), RU.day_ago(odd)), odd),
        O.with_logs(table_sql + f"""SELECT 'total' AS kind, CAST(NULL AS VARCHAR) AS key, count(*) AS n FROM m
UNION ALL SELECT 'last_24_hours', NULL, count(*) FILTER (WHERE created_at >= {ts(odd)} - INTERVAL 24 HOUR) FROM m
UNION ALL SELECT 'by_severity', {EFF}, count(*) FROM m GROUP BY 2
UNION ALL SELECT 'by_source', coalesce(source, 'unknown'), count(*) FROM m GROUP BY 2"""), "F1 F2 F4 F5 (rollup)")
    reg("rollup_retention_info", lambda s, sf: S.retention_info(RU.rolled(s, _table(s, sf), RU.bucket_bounds(odd)), odd),
        O.with_logs(table_sql + f""", b AS (SELECT created_at, {bucket_sql(odd)} AS bucket FROM m)
SELECT count(*) AS total, count(*) FILTER (WHERE created_at >= {ts(odd)} - INTERVAL 24 HOUR) AS last_24_hours,
  {', '.join(f"count(*) FILTER (WHERE bucket = '{x}') AS {x}" for x in AGE_BUCKETS)} FROM b"""), "F9 F10 (rollup)")
    heavy_sql = O.with_logs(table_sql + "SELECT coalesce(derived_source, source, 'unknown') AS source, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, source LIMIT 10")
    reg("heavy_top_sources", lambda s, sf: HV.top_sources(s, _table(s, sf)), heavy_sql, "F15 (frequent-items states)")
    reg("heavy_source_bounds", _heavy_bounds, O.with_logs(table_sql + "SELECT DISTINCT coalesce(derived_source, source, 'unknown') AS source, true AS within FROM m"),
        "F15 (bounds from states alone)")
    reg("indexed_search_page", lambda s, sf: Q.page(TS.search_table(s, _table(s, sf), Q.LogFilter(search="Failed")), 50),
        O.with_logs(table_sql + f"SELECT {cols} FROM m WHERE {search_sql('Failed')} {NEWEST} LIMIT 50"), "E1 E9 (trigram index)")
    reg("indexed_search_total", lambda s, sf: Q.total(TS.search_table(s, _table(s, sf), Q.LogFilter(search="de_dlock%", from_="2024-01-12 06:30:00"))),
        O.with_logs(table_sql + f"SELECT count(*) AS total FROM m WHERE {search_sql('de_dlock%')} AND created_at >= {ts('2024-01-12 06:30:00')}"),
        "E1 E5 E13 (trigram index)")
    reg("deep_page", lambda s, sf: TS.deep_page(s, _table(s, sf), 40, 400),
        O.with_logs(table_sql + f"SELECT {cols} FROM m {NEWEST} LIMIT 40 OFFSET 400"), "E9 E10 E12 E14 (by days)")
    live_sql = O.with_logs(f""", k AS (SELECT * FROM logs WHERE id NOT IN {deleted_ids}), c AS (
  SELECT 'total' AS kind, CAST(NULL AS VARCHAR) AS key, count(*) AS n FROM k
  UNION ALL SELECT 'by_severity', sev, count(k.id) FROM (SELECT DISTINCT {EFF} AS sev FROM logs) s LEFT JOIN k ON {EFF} = sev GROUP BY sev
  UNION ALL SELECT 'by_source', src, count(k.id) FROM (SELECT DISTINCT coalesce(source, 'unknown') AS src FROM logs) s
    LEFT JOIN k ON coalesce(source, 'unknown') = src GROUP BY src
  UNION ALL SELECT 'recent', NULL, count(*) FROM k WHERE created_at >= (SELECT max(created_at) FROM logs) - INTERVAL 24 HOUR)
SELECT kind, key, n, CAST(NULL AS DOUBLE) AS rate FROM c
UNION ALL SELECT 'error_rate', NULL, NULL, CAST(count(*) FILTER (WHERE {EFF} IN ('error', 'critical')) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 FROM k""")
    reg("stream_live_stats", _live((0, 1, 2)), live_sql, "J2 J3 (deletes by id)")
    reg("stream_live_stats_newest_first", _live((2, 0, 1)), live_sql, "J2 J3 (out of order)")
    reg("stream_running_stats", _stream_running, O.with_logs(f"""SELECT 'total' AS kind, CAST(NULL AS VARCHAR) AS key, count(*) AS n
  FROM logs WHERE id NOT IN {deleted_ids}
UNION ALL SELECT 'by_severity', {EFF}, count(*) FROM logs WHERE id NOT IN {deleted_ids} GROUP BY 2
UNION ALL SELECT 'by_source', coalesce(source, 'unknown'), count(*) FROM logs WHERE id NOT IN {deleted_ids} GROUP BY 2
UNION ALL SELECT DISTINCT 'by_severity', {EFF}, 0 FROM logs WHERE id IN {deleted_ids}
  AND {EFF} NOT IN (SELECT {EFF} FROM logs WHERE id NOT IN {deleted_ids})
UNION ALL SELECT DISTINCT 'by_source', coalesce(source, 'unknown'), 0 FROM logs WHERE id IN {deleted_ids}
  AND coalesce(source, 'unknown') NOT IN (SELECT coalesce(source, 'unknown') FROM logs WHERE id NOT IN {deleted_ids})"""),
        "J2 J3")
    hourly_sql = O.with_logs(f"""SELECT date_trunc('hour', created_at) AS hour, count(*) AS total,
  count(*) FILTER (WHERE {EFF} IN ('error', 'critical')) AS errors, CAST(0 AS BIGINT) AS dropped FROM logs GROUP BY 1""")
    sliding_sql = O.with_logs("""SELECT date_trunc('hour', created_at) - to_hours(k) AS window_start,
  date_trunc('hour', created_at) - to_hours(k) + INTERVAL 24 HOUR AS window_end, count(*) AS n, CAST(0 AS BIGINT) AS dropped
FROM logs, range(24) r(k) GROUP BY 1, 2""")
    late = "40 days"  # longer than the events are apart
    reg("stream_hourly_counts", _windowed((0, 1, 2), "2 hours"), hourly_sql, "J7")
    reg("stream_hourly_counts_newest_first", _windowed((2, 1, 0), late), hourly_sql, "J7 (out of order)")
    reg("stream_sliding_day_counts", _windowed((0, 1, 2), "2 hours", sliding=True), sliding_sql, "J8")
    reg("stream_sliding_newest_first", _windowed((2, 0, 1), late, sliding=True), sliding_sql,
        "J8 (out of order)")
    reg("stream_ring_buffer", _stream_ring, f"""WITH a AS ({O.access_logs_sql()}),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, id DESC) AS rn FROM a)
SELECT path, count(*) AS buffered, sum(CAST(duration_ms AS DOUBLE)) / count(*) AS avg_ms, max(duration_ms) AS max_ms,
  max(ts) AS newest_ts FROM r WHERE rn <= 100 GROUP BY path""", "J6 G1")
    reg("stream_progress", _stream_progress, progress_sql, "J9")
    reg("stream_live_tail", _stream_tail, O.with_logs(f"""SELECT id, title, {EFF} AS severity, source, created_at FROM logs
WHERE id NOT IN {deleted_ids} {NEWEST} LIMIT 100"""), "J5")
    cuts = [ts(CUTS[0]), ts(CUTS[1]), "TIMESTAMP '9999-01-01 00:00:00'"]
    parts = "\nUNION ALL ".join(f"""SELECT kind, key, n, CAST({i} AS BIGINT) AS batch, 'stats_updated' AS type FROM (
  SELECT 'total' AS kind, CAST(NULL AS VARCHAR) AS key, count(*) AS n FROM logs WHERE created_at < {c}
  UNION ALL SELECT 'last_24_hours', NULL, count(*) FROM logs WHERE created_at < {c}
    AND created_at >= (SELECT max(created_at) FROM logs WHERE created_at < {c}) - INTERVAL 24 HOUR
  UNION ALL SELECT 'by_severity', {EFF}, count(*) FROM logs WHERE created_at < {c} GROUP BY 2
  UNION ALL SELECT 'by_source', coalesce(source, 'unknown'), count(*) FROM logs WHERE created_at < {c} GROUP BY 2) x{i}"""
                             for i, c in enumerate(cuts))
    reg("stream_stats_snapshots", _stream_snapshots, O.with_logs(parts), "J4")
    return R


REGISTRY = build_registry()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {r.name: r.build for r in REGISTRY}


def oracle_sql() -> dict[str, str]:
    return {r.name: r.sql for r in REGISTRY if r.sql is not None}
