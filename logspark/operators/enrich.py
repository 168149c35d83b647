"""Ingest normalisation, validation and enrichment (A3-A5, C, D, C17).

``enrich`` is a pure projection (no shuffle, no Python), usable on batch and
streaming DataFrames alike.  It is written as three stacked projections so
the body JSON is parsed once and the searchable text is built once; the
optimizer keeps them apart because the shared columns are not cheap.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions import analyze as A
from logspark.functions import normalize as N
from logspark.functions import source as S
from logspark.functions.rules import DEFAULT_RULES, Rules
from logspark.schema import LOG_COLUMNS

TITLE_REQUIRED = "title is required"
BODY_NOT_OBJECT = "body must be a JSON object"


def _opt(df: DataFrame, name: str, dtype: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype).alias(name)


def normalized(raw: DataFrame) -> DataFrame:
    """A4 + A5: normalised header, canonical body text, parsed body and the
    reason a record is rejected (NULL when it is accepted)."""
    raw.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # the last of equal keys wins
    parsed = raw.select(
        _opt(raw, "id", "bigint").alias("id"),
        _opt(raw, "created_at", "timestamp_ntz").alias("created_at"),
        F.col("title"),
        N.severity_normalized("severity").alias("severity"),
        N.blank_to_null("source").alias("source"),
        N.color_normalized("color").alias("color"),
        N.blank_to_null("description").alias("description"),
        F.col("body").alias("body_raw"),
        A.parsed_body("body").alias("_parsed"),
    )
    parsed = parsed.select("*", A.whole_body("_parsed").alias("body_v")).drop("_parsed")
    kind = F.schema_of_variant("body_v")
    is_object = kind.startswith("OBJECT")
    reason = (
        F.when(F.col("title").isNull() | (F.col("title") == ""), F.lit(TITLE_REQUIRED))
        .when(F.col("body_raw").isNotNull() & ~F.coalesce(is_object | (kind == "VOID"), F.lit(False)),
              F.lit(BODY_NOT_OBJECT))
    )
    body = F.when(is_object, A.escaped_json(F.to_json("body_v"))).otherwise(F.lit("{}"))
    return parsed.select(
        "id", "created_at", "title", "severity", "source", "color", "description",
        body.alias("body"),
        F.when(is_object, F.col("body_v")).alias("body_v"),
        reason.alias("reject_reason"),
    )


class Ingested(NamedTuple):
    logs: DataFrame
    rejected: DataFrame


def _keep_where(df: DataFrame, cond: Column, cols: list) -> DataFrame:
    """Rows of ``df`` where ``cond`` holds, projected to ``cols``.

    Written as ``inline`` of a zero- or one-element array rather than a
    Filter: a Filter would be pushed below the projection that parses the
    body (down to the scan) and parse it a second time there; this keeps
    one parse per row, in the same task as the rest of the work.
    """
    one = F.array(F.struct(*cols))
    return df.select(F.inline(F.slice(one, 1, F.when(cond, F.lit(1)).otherwise(F.lit(0)))))


def validate(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A3: split into (accepted normalised records, rejected records with reason)."""
    n = normalized(raw)
    ok = F.col("reject_reason").isNull()
    good = _keep_where(n, ok, [c for c in n.columns if c != "reject_reason"])
    bad = _keep_where(n, ~ok, ["id", "created_at", "title", F.col("reject_reason").alias("reason")])
    return good, bad


class _Columns(NamedTuple):
    text: Column
    captured: Column
    found: Column
    duration: Column
    category: Column
    verdict: Column
    source: Column


@lru_cache(maxsize=16)
def _columns(application: str, rules: Rules, for_gate: bool) -> _Columns:
    """The rule columns, built once per application and rules: they name their
    inputs, so one tree serves every frame, and building it takes seconds."""
    needed = (F.col("severity") == "info") if for_gate else None
    found = A.Found()
    category = A.base_category(found, rules, include_security=False)
    verdict = A.decide("text", found, "duration_ms", "base_category", rules, severity_needed=needed)
    source = S.derive_source("source", "body_v", "title", "text_lower", rules, body_text="body", found=found)
    return _Columns(A.searchable_text("title", "description", "body"), found.captured("text_lower"), found.bits("captured"),
                    A.body_duration_ms("body_v", rules, body_text="body"), category, verdict, source)


def analysis(n: DataFrame, rules: Rules = DEFAULT_RULES, for_gate: bool = False) -> DataFrame:
    """Analysis of normalised records: adds ``verdict`` = struct(severity,
    category, rule) and ``inferred_source``; the text, its lower case, the body
    duration and the base category (without its security arm, see ``decide``)
    are materialised once per row.  With ``for_gate`` the keyword severity is
    only computed where the gate keeps it (header severity info)."""
    c = _columns(n.sparkSession.sparkContext.applicationId, rules, for_gate)
    t = n.select(*n.columns, c.text.alias("text")) \
        .select("*", F.lower("text").alias("text_lower"), c.duration.alias("duration_ms")) \
        .select("*", c.captured.alias("captured")) \
        .select("*", c.found.alias(A.Found().name)) \
        .select("*", c.category.alias("base_category"))
    return t.select(*n.columns, c.verdict.alias("verdict"), c.source.alias("inferred_source"))


def gate(analysed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """C17: keep an inferred severity only when the header says info and the
    inference is not info; an inferred source only when the header has none."""
    v = F.col("verdict")
    return analysed.select(
        "id", "title", "severity", "source", "color", "description", "body",
        F.when((F.col("severity") == "info") & (v.severity != "info"), v.severity).alias("derived_severity"),
        F.when(F.col("source").isNull(), F.col("inferred_source")).alias("derived_source"),
        v.category.alias("derived_category"),
        "created_at",
        F.to_date("created_at").alias("log_date"),
        *keep,
    )


def ingest(raw: DataFrame, rules: Rules = DEFAULT_RULES) -> Ingested:
    """Validate, normalise, enrich and gate raw flat records."""
    good, bad = validate(raw)
    return Ingested(gate(analysis(good, rules, for_gate=True)).select(*LOG_COLUMNS), bad)


def ingest_marked(raw: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """All records in one pass: the stored columns and ``reason``, which is
    NULL for accepted records (the other columns only count for those)."""
    n = normalized(raw)
    analysed = analysis(n, rules, for_gate=True)
    stored = gate(analysed, keep=("reject_reason",))
    return stored.select(*LOG_COLUMNS, F.col("reject_reason").alias("reason"))


def enrich(raw: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Accepted records, enriched to the stored ``LOGS`` shape."""
    return ingest(raw, rules).logs


def from_nested(nested: DataFrame) -> DataFrame:
    """A1 -> flat form: header fields lifted to columns."""
    cols = [F.col(f"header.{c}").alias(c) for c in ("title", "severity", "source", "color", "description")]
    extra = [c for c in ("id", "created_at") if c in nested.columns]
    return nested.select(*extra, *cols, F.col("body"))
