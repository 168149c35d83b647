"""Golden rows for severity / category / source inference (C, D, C17)."""

import json

from pyspark.sql import functions as F

from logspark.operators.enrich import analysis, enrich, ingest, validate


def analyse_titles(spark, raw_frame, rows):
    raw = raw_frame(rows)
    good, _ = validate(raw)
    out = analysis(good).select("title", "body", F.col("verdict.severity").alias("sev"),
                                F.col("verdict.category").alias("cat"), "inferred_source")
    return out.collect()


SEVERITY_GOLDEN = [
    # security
    ("SQL injection attempt detected", "critical"),
    ("Unauthorized access to /admin", "critical"),
    ("XSS attack blocked", "critical"),
    ("Authentication failed for user", "critical"),
    ("Token expired", "critical"),
    # http status
    ("Request returned status 200", "success"),
    ("HTTP 201 Created", "success"),
    ("API returned 404 not found", "warning"),
    ("Server error: status 500", "error"),
    ("Gateway timeout: HTTP 504", "critical"),
    # stack traces
    ("Error at line 42", "error"),
    ("Traceback (most recent call last)", "error"),
    ("panic: runtime error", "error"),
    ("goroutine 1 [running]:", "error"),
    # database
    ("Deadlock detected in transaction", "critical"),
    ("Connection pool exhausted", "critical"),
    ("Duplicate key error on insert", "warning"),
    ("Foreign key violation", "error"),
    # keywords
    ("Connection failed", "error"),
    ("Request timeout", "error"),
    ("Deprecated API called", "warning"),
    ("Slow query detected", "warning"),
    ("Payment processed successfully", "success"),
    ("User created", "success"),
    ("Debug mode enabled", "debug"),
    ("Entering function", "debug"),
    ("Processing request", "info"),
    # system codes
    ("Error ECONNREFUSED on connect", "error"),
    ("Signal SIGKILL received", "error"),
    ("ENOMEM: cannot allocate", "critical"),
    # performance text
    ("Slow query took 5 seconds", "warning"),
    ("Memory leak detected in worker", "error"),
]


def test_severity_golden(spark, raw_frame):
    got = {r.title: r.sev for r in analyse_titles(spark, raw_frame, [(t, "info") for t, _ in SEVERITY_GOLDEN])}
    assert got == dict(SEVERITY_GOLDEN)


def test_business_golden(spark, raw_frame):
    rows = [("Payment failed for order 123", "error", "business"),
            ("Subscription canceled", "warning", "business"),
            ("Refund processed successfully", "info", "business")]
    got = {r.title: (r.sev, r.cat) for r in analyse_titles(spark, raw_frame, [(t,) for t, _, _ in rows])}
    assert got == {t: (s, c) for t, s, c in rows}


def test_duration_golden(spark, raw_frame):
    rows = [
        ({"duration_ms": 2500.0}, "warning"),
        ({"latency": 500}, "info"),
        ({"elapsed_ms": "1200"}, "warning"),
        ({"duration": 0, "time_ms": 50}, "success"),       # first positive value wins
        ({"duration": 0.5, "latency_ms": 3000}, "error"),  # 0.5 truncates to 0 -> skipped
        ({"duration": "12ms"}, "info"),                      # strict integer parse fails -> no duration
        ({"duration": -100}, "info"),
        ({"duration_ms": 99}, "success"),
        ({"duration_ms": 100}, "info"),
        ({"duration_ms": 999}, "info"),
        ({"duration_ms": 1000}, "warning"),
        ({"duration_ms": 2999}, "warning"),
        ({"duration_ms": 3000}, "error"),
        ({"duration_ms": 5000}, "error"),
    ]
    raw = [(f"Request handled #{i}", None, None, None, None, json.dumps(b)) for i, (b, _) in enumerate(rows)]
    got = {r.title: r.sev for r in analyse_titles(spark, raw_frame, raw)}
    assert got == {f"Request handled #{i}": s for i, (_, s) in enumerate(rows)}


def test_category_golden(spark, raw_frame):
    rows = [("HTTP request failed", "http"), ("SQL query executed", "database"),
            ("Latency spike detected", "performance"), ("User logged in", "business"),
            ("Process started", "system"), ("Random log message", "general")]
    got = {r.title: r.cat for r in analyse_titles(spark, raw_frame, [(t,) for t, _ in rows])}
    assert got == dict(rows)


SOURCE_GOLDEN = [
    ("PostgreSQL query failed", "postgresql-db"),
    ("MySQL connection error", "mysql-db"),
    ("Mongo database connection error", "mongodb"),
    ("Redis query timeout", "redis-cache"),
    ("SQLite database locked", "sqlite-db"),
    ("Database query timeout", "database-service"),
    ("Login attempt blocked", "auth-service"),
    ("Stripe payment processed", "payment-service"),
    ("Email sent via SendGrid", "email-service"),
    ("API gateway /api/users request", "api-gateway"),
    ("User profile updated", "user-service"),
    ("Order placed in cart", "order-service"),
    ("File upload to S3 completed", "file-service"),
    ("Search index updated in Algolia", "search-service"),
    ("Health check passed", "monitoring-service"),
    ("Nginx upstream error", "load-balancer"),
    ("Cache invalidation", "cache-service"),
    ("RabbitMQ message published", "queue-service"),
    ("Config setting updated", "config-service"),
    ("Backup completed successfully", "backup-service"),
    ("Report generated for analytics", "reporting-service"),
    ("Docker container deployed", "deployment-service"),
    ("CDN Cloudflare edge node", "cdn-service"),
    ("Cron job executed", "scheduler-service"),
    ("Webhook callback received", "webhook-service"),
    ("my-service: request handled", "my-service"),
    ("Error from payment-service", "payment-service"),
    ("[api] Request failed", "api"),
    ("[AUTH] Login attempt", "auth"),
    ("database: Connection error", "database"),
    ("api-gateway: Request timeout", "api-gateway"),
    ("Regular title without prefix", None),
    ("Title with spaces: should not match", None),
    # rows we add
    ("[]x: y", "[]x"),
    ("handled by tax-service, all fine", "tax-service"),
    ("0123456789012345678: late colon", "0123456789012345678"),
    ("01234567890123456789: too late", None),
    ("12:30 started", "12"),
]


def test_source_golden(spark, raw_frame):
    got = {r.title: r.inferred_source for r in analyse_titles(spark, raw_frame, [(t,) for t, _ in SOURCE_GOLDEN])}
    assert got == dict(SOURCE_GOLDEN)


def test_source_body_fields(spark, raw_frame):
    rows = [({"service": "my-service"}, "my-service"), ({"source": "my-source"}, "my-source"),
            ({"app": "my-app"}, "my-app"), ({"application": "my-application"}, "my-application"),
            ({"component": "my-component"}, "my-component"), ({"module": "my-module"}, "my-module"),
            ({"service": ""}, None), ({"service": 123}, None), ({"service": 123, "app": "x"}, "x")]
    raw = [(f"Generic message {i}", None, None, None, None, json.dumps(b)) for i, (b, _) in enumerate(rows)]
    got = {r.title: r.inferred_source for r in analyse_titles(spark, raw_frame, raw)}
    assert got == {f"Generic message {i}": s for i, (_, s) in enumerate(rows)}


def test_header_source_wins(spark, raw_frame):
    r = analyse_titles(spark, raw_frame, [("[api] x", None, "explicit-source")])[0]
    assert r.inferred_source == "explicit-source"


def test_rule_ties_follow_declaration_order(spark, raw_frame):
    got = {r.title: r.sev for r in analyse_titles(spark, raw_frame, [
        ("Order failed, payment pending",), ("table locked after deadlock on duplicate key",)])}
    assert got == {"Order failed, payment pending": "info",   # 'payment pending' precedes 'order failed'
                   "table locked after deadlock on duplicate key": "critical"}


def test_status_traps(spark, raw_frame):
    got = {r.title: r.sev for r in analyse_titles(spark, raw_frame, [
        ("status 2000 reached",), ("status 299 returned by peer",), ("got 401 error",),
        ("HTTP 403 forbidden",), ("code=503",)])}
    assert got["status 2000 reached"] == "success"
    assert got["status 299 returned by peer"] == "info"
    assert got["got 401 error"] == "error"
    assert got["HTTP 403 forbidden"] == "critical"     # security wins before http
    assert got["code=503"] == "critical"


def test_gating(spark, raw_frame):
    raw = raw_frame([
        ("Database connection failed",),                       # defaulted info -> derived applies
        ("Database connection failed", "warning"),            # explicit -> no derived severity
        ("Processing request", "info"),                       # derived info -> not stored
        ("Error from payment-service", None, "billing"),      # header source -> no derived source
    ])
    rows = {(r.title, r.severity): r for r in enrich(raw).collect()}
    r = rows[("Database connection failed", "info")]
    assert (r.derived_severity, r.derived_source, r.derived_category) == ("error", "database-service", "database")
    r = rows[("Database connection failed", "warning")]
    assert r.derived_severity is None
    assert rows[("Processing request", "info")].derived_severity is None
    r = rows[("Error from payment-service", "info")]
    assert r.derived_source is None and r.source == "billing"


def test_validation_and_canonical_body(spark, raw_frame):
    raw = raw_frame([
        ("ok", None, None, None, None, '{"b":1,"a":"<x>&"}'),
        ("", None, None, None, None, None),
        ("arr", None, None, None, None, "[1]"),
        ("bad", None, None, None, None, "not json"),
        ("jnull", None, None, None, None, "null"),
        ("   ", "", "", "RED", ""),
    ])
    good, bad = validate(raw)
    g = {r.title: r for r in good.collect()}
    assert set(g) == {"ok", "jnull", "   "}
    assert g["ok"].body == '{"a":"\\u003cx\\u003e\\u0026","b":1}'
    assert g["jnull"].body == "{}"
    assert (g["   "].severity, g["   "].source, g["   "].color, g["   "].description) == ("info", None, "red", None)
    reasons = {r.title: r.reason for r in bad.collect()}
    assert reasons == {"": "title is required", "arr": "body must be a JSON object",
                       "bad": "body must be a JSON object"}


def test_enrich_is_one_stage_without_python(spark):
    from logspark.sources.adapters import raw_logs, read_table
    from tests.conftest import SF_SMALL

    plan = enrich(raw_logs(read_table(spark, SF_SMALL, "events")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_rule_tables_are_pinned():
    """The oracle reads the same tables; a change to them must be meant."""
    import hashlib
    import json

    from logspark.functions import rules as R

    names = sorted(n for n in vars(R) if n.isupper() and n != "DEFAULT_RULES")
    text = json.dumps({n: getattr(R, n) for n in names}, default=str, sort_keys=True)
    assert hashlib.sha256(text.encode()).hexdigest() == "2e8f4e6e2fdad6ade0ef193b09fa24791d85e4c8f6133a075ca1cff682b48e66"


def test_body_shapes(spark, raw_frame):
    """One whole JSON object, the last of equal keys, the stored escapes."""
    bodies = {
        '{"a":1,"a":2}': '{"a":2}', '{"a":1} trailing': None, '{"a":1}{"b":2}': None, '{"a":1},{"b":2}': None,
        '{"a":1}] x': None, "null": "{}", "[1]": None, "": None, ' {"b" : 1e3, "a":"5.0,"} ': '{"a":"5.0,","b":1000}',
        '{"x":"\u2028\u2029<&>"}': '{"x":"\\u2028\\u2029\\u003c\\u0026\\u003e"}',
    }
    res = ingest(raw_frame([(f"t{i}", None, None, None, None, b) for i, b in enumerate(bodies)]))
    got = {r.title: r.body for r in res.logs.collect()}
    assert got == {f"t{i}": want for i, want in enumerate(bodies.values()) if want is not None}
    assert res.rejected.count() == sum(want is None for want in bodies.values())


def test_words_found_in_one_pass(spark):
    """Every group of words against plain substring tests, on texts made of
    pieces of the words: beginnings, overlaps, words inside words."""
    import random

    from logspark.functions import analyze as A
    from logspark.functions.rules import DEFAULT_RULES

    rng = random.Random(5)
    found = A.Found()
    A.decide("text", found, "d", "c")
    groups = [*found.groups, ("ab", "abc", "bcd"), ("bc",), (".*",), ("a\nb", "\\"), ("x",), ("abcde",)]
    columns = [found.any(g) for g in groups]
    words = sorted({w for g in groups for w in g})
    texts = ["", "abcd", "xabcbcd", "a\nb", "\\.*", "😀abc😀bcdé"] + [
        "".join(rng.choice(words)[:rng.randrange(1, 12)] + rng.choice(["", "", " ", "x"]) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select("text", found.captured("text").alias("captured")) \
        .select("text", found.bits("captured").alias("found")).select("text", *(c.alias(f"g{i}") for i, c in enumerate(columns)))
    for r in frame.collect():
        assert list(r)[1:] == [any(w in r.text for w in g) for g in groups], r.text
    assert A.keyword_severity(A.Found(), DEFAULT_RULES) is not None
