"""Adapters from the driver's tables to log-shaped records.

``raw_logs`` turns every ``events`` row into one flat ingest record.  Its text
is built from the row itself (type, ids, value, props); every second row also
carries one pattern of the rule tables, in table order, so that each rule
meets data, and one row in eight carries one of a few body shapes at the edge
of what the validator accepts.  ``access_logs`` turns every ``events`` row into
one request record.  ``document_logs`` and ``conversation_logs`` turn whole
texts into records (long-text load for enrichment).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions.rules import DEFAULT_RULES as R

#: Every pattern of the rule tables, in table order.
RULE_WORDS = tuple(dict.fromkeys([
    *R.security, *(w for _, words in R.category_words for w in words), *(p for p, _ in R.business),
    *(p for p, _ in R.performance), *R.stack_markers, *(p for p, _ in R.database), *(p for p, _ in R.system_codes),
    *(w for _, words in R.keyword_groups for w in words), *(w for _, anys, alls, _ in R.source_rules for w in (*anys, *alls)),
    *(w for w, _ in R.database_source_refinement)]))

SEVERITY_CYCLE = ("error", "critical", "audit", "info", None, None, None)   # by g % 7
COLOR_CYCLE = ("RED", "nope", None, None, None)                           # by g % 5
ACCESS_STATUS_CYCLE = (200, 200, 201, 301, 400, 401, 404, 500, 503)       # by event_id % 9
#: Bodies of the rows with event_id % 8 = 7, by g % 16 (None: see ``raw_logs``).
BODY_CYCLE = (
    None, "not json", None, '{"a":1} trailing', '{"a":1}{"b":2}', None, None, None, '{"service":123}', None,
    "null", '{"text":"line\u2028and\u2029end <b>&"}', '{"n":1e3}', "[1,2]", "", '{"a":1,"a":{"c":[true,null]}}',
)


def _pick(values, index: Column) -> Column:
    """values[index] for a small literal list (NULL entries allowed)."""
    out = None
    for i, v in enumerate(values):
        lit = F.lit(v).cast("string") if v is None else F.lit(v)
        out = F.when(index == i, lit) if out is None else out.when(index == i, lit)
    return out


def duration_of(value: Column) -> Column:
    """A duration in ms derived from the event value: floor(value * 20)."""
    return F.floor(value * 20).cast("bigint")


def raw_logs(events: DataFrame) -> DataFrame:
    """Flat ingest records (id, created_at, title, severity, source, color,
    description, body) from the ``events`` table; g = event_id div 8."""
    m, g = F.col("event_id") % 8, F.expr("event_id div 8")
    d = duration_of(F.col("value")).cast("string")
    user, k = F.col("user_id").cast("string"), F.get_json_object("props", "$.k")
    what, eid = F.col("event_type"), F.col("event_id").cast("string")
    word = F.element_at(F.array(*[F.lit(w) for w in RULE_WORDS]), (g % len(RULE_WORDS) + 1).cast("int"))
    title = (
        F.when(m % 2 == 0, F.concat(what, F.lit(" "), eid, F.lit(": "), word))
        .when(m == 1, F.concat(what, F.lit(" returned "), (g % 500 + 100).cast("string")))
        .when(m == 3, F.concat(F.lit("["), what, F.lit("] user "), user))
        .when(m == 5, F.concat(what, F.lit(": step "), k, F.lit(" of user "), user))
        .when(g % 16 == 0, F.lit(""))
        .otherwise(F.concat(what, F.lit(" "), eid))
    )
    edge = g % 16
    body = (
        F.when((m == 3) | (m == 5), F.col("props"))
        .when(m == 7, F.when(edge == 2, F.concat(F.lit('{"k":0,"k":'), k, F.lit("}")))
              .when(edge == 5, F.concat(F.lit('{"duration_ms":'), d, F.lit(',"user_id":'), user, F.lit("}")))
              .when(edge == 6, F.concat(F.lit('{"elapsed_ms":"'), d, F.lit('"}')))
              .when(edge == 7, F.concat(F.lit('{"service":"'), what, F.lit('-desk"}')))
              .when(edge == 9, F.concat(F.lit('{"bytes":'), d, F.lit(',"status":'), (F.col("user_id") % 600).cast("string"), F.lit("}")))
              .otherwise(_pick(BODY_CYCLE, edge)))
    )
    source = F.when(g % 3 == 0, F.lit("api")).when((g % 3 == 1) & (g % 2 == 0), F.lit("unknown"))
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        title.alias("title"),
        _pick(SEVERITY_CYCLE, g % 7).alias("severity"),
        source.alias("source"),
        _pick(COLOR_CYCLE, g % 5).alias("color"),
        F.when(g % 4 == 0, F.concat(F.lit("props "), F.col("props"))).when(g % 4 == 1, F.lit("")).alias("description"),
        body.alias("body"),
    )


def access_logs(events: DataFrame) -> DataFrame:
    """Request records (id, path, status, duration_ms, ts) from ``events``."""
    status = F.element_at(F.array(*[F.lit(s) for s in ACCESS_STATUS_CYCLE]),
                          ((F.col("event_id") % 9) + 1).cast("int"))
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("/api/"), F.col("event_type")).alias("path"),
        status.cast("int").alias("status"),
        duration_of(F.col("value")).alias("duration_ms"),
        F.col("ts").alias("ts"),
    )


def document_logs(documents: DataFrame, created_at: str = "2024-01-15 00:00:00") -> DataFrame:
    """Every document as one log record: title = source, description = the
    whole text, no body."""
    return documents.select(
        F.col("doc_id").alias("id"),
        F.lit(created_at).cast("timestamp_ntz").alias("created_at"),
        F.concat(F.lit("document from "), F.coalesce(F.col("source"), F.lit("unknown"))).alias("title"),
        F.lit(None).cast("string").alias("severity"),
        F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("string").alias("color"),
        F.col("text").alias("description"),
        F.lit(None).cast("string").alias("body"),
    )


def conversation_logs(conversations: DataFrame, created_at: str = "2024-01-15 00:00:00") -> DataFrame:
    """Every turn as one log record: title = role and turn, description = the
    whole text, no body."""
    return conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.lit(created_at).cast("timestamp_ntz").alias("created_at"),
        F.concat(F.col("role"), F.lit(" turn "), F.col("turn").cast("string")).alias("title"),
        F.lit(None).cast("string").alias("severity"),
        F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("string").alias("color"),
        F.col("text").alias("description"),
        F.lit(None).cast("string").alias("body"),
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
