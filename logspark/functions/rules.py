"""Rule tables for log enrichment.

The tables are plain data: an ordered tuple of patterns, or of
``(pattern, severity)`` pairs.  Order is significant everywhere: the first
pattern (in the order written here) that matches decides.  Users extend the
rules by passing their own ``Rules`` to ``enrich``; no UDF is involved.

All matches are plain substring tests (``contains``), not word matches, so
``ok`` hits ``token`` and ``lag`` hits ``flag``.  That is intended.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES - these must equal the behaviour being reproduced; they are
# written out in their natural (declaration) order and must not be reordered.
# ---------------------------------------------------------------------------

STANDARD_SEVERITIES = ("debug", "info", "success", "warning", "error", "critical")

COLORS = (
    "slate", "gray", "zinc", "neutral", "stone", "red", "orange", "amber",
    "yellow", "lime", "green", "emerald", "teal", "cyan", "sky", "blue",
    "indigo", "violet", "purple", "fuchsia", "pink", "rose",
)

CATEGORIES = ("http", "database", "security", "performance", "business", "system", "general")

# severity -> automatic colour; anything else -> slate
AUTO_COLORS = (
    ("critical", "red"),
    ("error", "red"),
    ("warning", "yellow"),
    ("success", "green"),
    ("info", "blue"),
    ("debug", "gray"),
)
DEFAULT_AUTO_COLOR = "slate"

# UI rank of a severity (custom severities rank 10)
SEVERITY_RANK = (
    ("debug", 0),
    ("info", 1),
    ("success", 2),
    ("warning", 3),
    ("error", 4),
    ("critical", 5),
)
CUSTOM_SEVERITY_RANK = 10

SECURITY_PATTERNS = (
    "unauthorized", "forbidden", "auth failed", "authentication failed",
    "permission denied", "access denied", "invalid token", "token expired",
    "session expired", "breach", "leaked", "exposed", "vulnerability",
    "injection", "xss", "csrf", "compromised", "malicious", "exploit",
    "brute force", "ddos", "flooding", "suspicious", "intrusion",
    "sql injection", "code injection", "command injection",
)

# base category word groups, tested in this order after security
CATEGORY_WORDS = (
    ("http", ("http", "request", "response", "status", "endpoint", "api", "rest", "graphql")),
    ("database", ("database", "sql", "query", "table", "postgres", "mysql", "mongo", "redis", "sqlite")),
    ("performance", ("slow", "timeout", "latency", "performance", "memory", "cpu", "disk", "duration")),
    ("business", ("payment", "order", "invoice", "subscription", "user", "login", "checkout", "cart")),
    ("system", ("system", "kernel", "process", "signal", "daemon", "service", "cron", "scheduler")),
)

BUSINESS_PATTERNS = (
    ("payment failed", "error"),
    ("payment successful", "success"),
    ("payment pending", "info"),
    ("payment declined", "error"),
    ("payment processed", "success"),
    ("order completed", "success"),
    ("order canceled", "warning"),
    ("order failed", "error"),
    ("order placed", "success"),
    ("order refunded", "info"),
    ("subscription expired", "warning"),
    ("subscription renewed", "success"),
    ("subscription canceled", "warning"),
    ("subscription activated", "success"),
    ("trial expired", "info"),
    ("trial started", "success"),
    ("invoice overdue", "warning"),
    ("invoice paid", "success"),
    ("invoice sent", "info"),
    ("refund processed", "info"),
    ("refund failed", "error"),
    ("refund requested", "info"),
    ("user registered", "success"),
    ("user deleted", "warning"),
    ("user deactivated", "warning"),
    ("user activated", "success"),
    ("login successful", "success"),
    ("login failed", "warning"),
    ("logout successful", "info"),
    ("password changed", "info"),
    ("password reset", "info"),
    ("cart abandoned", "warning"),
    ("cart updated", "info"),
    ("checkout started", "info"),
    ("checkout completed", "success"),
)

PERFORMANCE_PATTERNS = (
    ("slow query", "warning"),
    ("query timeout", "error"),
    ("request timeout", "error"),
    ("connection timeout", "error"),
    ("high latency", "warning"),
    ("memory pressure", "warning"),
    ("cpu spike", "warning"),
    ("disk full", "critical"),
    ("rate limited", "warning"),
    ("throttled", "warning"),
    ("bottleneck", "warning"),
    ("degraded", "warning"),
)

# top-level body keys holding a duration in milliseconds, in lookup order
DURATION_FIELDS = ("duration", "duration_ms", "elapsed", "elapsed_ms", "time_ms", "latency", "latency_ms")

# duration (ms) -> level: below 100 fast, below 1000 normal, below 3000 slow, else critical
DURATION_LEVELS = (
    (100, "fast"),
    (1000, "normal"),
    (3000, "slow"),
)
DURATION_TOP_LEVEL = "critical"

LEVEL_SEVERITY = (
    ("fast", "success"),
    ("normal", "info"),
    ("slow", "warning"),
    ("critical", "error"),
)

HTTP_STATUS_SEVERITY = (
    ("200", "success"), ("201", "success"), ("202", "success"), ("204", "success"),
    ("301", "info"), ("302", "info"), ("304", "info"),
    ("400", "warning"), ("401", "error"), ("403", "error"), ("404", "warning"),
    ("405", "warning"), ("408", "warning"), ("409", "warning"), ("410", "warning"),
    ("413", "warning"), ("422", "warning"), ("429", "warning"),
    ("500", "error"), ("501", "error"), ("502", "error"),
    ("503", "critical"), ("504", "critical"), ("507", "critical"), ("511", "error"),
)

# HTTP status extraction patterns in the RE2 dialect, tried in this order;
# the first pattern with any match decides (group 1 of its leftmost match).
HTTP_STATUS_REGEXES_RE2 = (
    r"(?i)(?:status|http|code)[\s:=]*(\d{3})",
    r"(?i)returned\s+(\d{3})",
    r"(?i)\b(\d{3})\s+(?:error|ok|found|not found)",
    r"""(?i)"status"[\s:]+["']?(\d{3})""",
    r"""(?i)"status_code"[\s:]+["']?(\d{3})""",
)

# stack-trace markers, compared case-insensitively; blanks are significant
STACK_MARKERS = (
    " at line ", " at Object.", "Traceback", "goroutine ",
    "panic:", ".java:", ".py:", ".js:", ".go:",
    "at /", 'File "', " line ", "in <module>",
    "Exception in thread", "Caused by:", "\n\tat ",
    "Call Stack:", "Stack trace:", "at Function.",
)

DATABASE_PATTERNS = (
    ("deadlock", "critical"),
    ("connection pool exhausted", "critical"),
    ("too many connections", "critical"),
    ("duplicate key", "warning"),
    ("constraint violation", "error"),
    ("foreign key violation", "error"),
    ("unique constraint", "warning"),
    ("table locked", "warning"),
    ("database locked", "warning"),
    ("sqlite_busy", "warning"),
    ("sqlite_locked", "warning"),
    ("sqlite_corrupt", "critical"),
    ("connection refused", "error"),
    ("connection timeout", "error"),
    ("query timeout", "warning"),
)

# matched case-sensitively against the original text
SYSTEM_ERROR_CODES = (
    ("ECONNREFUSED", "error"),
    ("ETIMEDOUT", "error"),
    ("ENOTFOUND", "error"),
    ("ECONNRESET", "error"),
    ("EPIPE", "error"),
    ("EACCES", "error"),
    ("ENOENT", "warning"),
    ("EISDIR", "error"),
    ("EMFILE", "critical"),
    ("ENOMEM", "critical"),
    ("ENOSPC", "critical"),
    ("EIO", "critical"),
    ("EROFS", "error"),
)

ERROR_KEYWORDS = (
    "error", "failed", "failure", "fatal", "critical", "crash", "exception",
    "panic", "abort", "aborted", "refused", "denied", "reject", "rejected",
    "timeout", "timed out", "unavailable", "unreachable", "invalid", "corrupt",
    "corrupted", "broken", "violation", "exceeded", "overflow", "underflow",
    "leak", "died", "dying", "dump", "dumped", "fault", "faulted", "kill",
    "killed", "terminate", "terminated", "segfault", "segmentation",
    "core dump", "stack overflow", "out of memory", "oom", "cannot",
    "could not", "unable", "impossible",
)

WARNING_KEYWORDS = (
    "warning", "warn", "deprecated", "deprecation", "slow", "slower", "delay",
    "delayed", "lag", "lagging", "retry", "retrying", "retried", "pending",
    "blocked", "blocking", "queue full", "high load", "degraded", "flaky",
    "unstable", "intermittent", "occasional", "sometimes", "timeout soon",
)

SUCCESS_KEYWORDS = (
    "success", "successful", "successfully", "succeeded", "complete",
    "completed", "done", "finished", "processed", "created", "updated", "saved",
    "stored", "published", "deployed", "approved", "accepted", "validated",
    "verified", "confirmed", "established", "connected", "ready", "available",
    "online", "restored", "recovered", "fixed", "resolved", "passed", "ok",
    "okay", "working", "operational", "healthy",
)

DEBUG_KEYWORDS = (
    "debug", "debugging", "trace", "tracing", "verbose", "entering", "entered",
    "exiting", "exited", "calling", "called", "executing", "executed",
    "invoking", "invoked", "beginning", "starting", "stopping", "ended",
)

# body fields that may name the originating service, in lookup order
SOURCE_BODY_FIELDS = ("service", "source", "app", "application", "component", "module")

# keyword groups naming a service, tested in order.  Each rule is
# (name, any_of, all_of, none_of): it fires when the lower-case text contains
# one of any_of (or any_of is empty), every word of all_of and no word of
# none_of.  The database rule is refined by DATABASE_SOURCE_REFINEMENT.
SOURCE_RULES = (
    ("database-service", ("database", "sql", "query", "table"), (), ()),
    ("auth-service", ("login", "auth", "token", "session", "jwt", "oauth"), (), ()),
    ("payment-service", ("payment", "stripe", "paypal", "billing", "invoice", "checkout"), (), ()),
    ("email-service", ("email", "smtp", "notification", "mailgun", "sendgrid", "push notification"), (), ()),
    ("api-gateway", ("api gateway", "endpoint", "route", "/api/"), (), ()),
    ("user-service", ("profile", "register", "account", "signup"), ("user",), ()),
    ("order-service", ("order", "cart", "inventory", "product", "catalog"), (), ()),
    ("file-service", ("file", "upload", "download", "s3", "storage", "blob", "bucket"), (), ()),
    ("search-service", ("search", "elasticsearch", "solr", "algolia", "opensearch"), (), ()),
    ("monitoring-service", ("health", "monitor", "metrics", "prometheus", "grafana", "datadog"), (), ()),
    ("load-balancer", ("load balan", "nginx", "haproxy", "upstream", "reverse proxy"), (), ()),
    ("cache-service", (), ("cache",), ("redis",)),
    ("queue-service", ("queue", "rabbitmq", "kafka", "sqs", "pubsub", "message broker"), (), ()),
    ("config-service", ("config", "setting", "environment", "feature flag"), (), ()),
    ("backup-service", ("backup", "restore", "archive", "snapshot"), (), ()),
    ("reporting-service", ("report", "analytics", "dashboard", "bi ", "business intelligence"), (), ()),
    ("deployment-service", ("deploy", "build", "pipeline", "docker", "kubernetes", "k8s", "ci/cd"), (), ()),
    ("cdn-service", ("cdn", "cloudflare", "fastly", "akamai", "static asset"), (), ()),
    ("scheduler-service", ("cron", "scheduler", "scheduled task", "job runner"), (), ()),
    ("webhook-service", ("webhook", "callback", "hook endpoint"), (), ()),
)

DATABASE_SOURCE_REFINEMENT = (
    ("postgres", "postgresql-db"),
    ("mysql", "mysql-db"),
    ("mongo", "mongodb"),
    ("redis", "redis-cache"),
    ("sqlite", "sqlite-db"),
)

# characters trimmed from both ends of a "<name>-service" token
SERVICE_TOKEN_TRIM = ".,!?:;\"'()[]{}"

# age buckets of the retention report, in display order
AGE_BUCKETS = ("today", "yesterday", "last_week", "last_month", "older")

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Rules:
    """All tables the enrichment reads; pass a modified copy to extend them."""

    security: tuple = SECURITY_PATTERNS
    category_words: tuple = CATEGORY_WORDS
    business: tuple = BUSINESS_PATTERNS
    performance: tuple = PERFORMANCE_PATTERNS
    duration_fields: tuple = DURATION_FIELDS
    duration_levels: tuple = DURATION_LEVELS
    duration_top_level: str = DURATION_TOP_LEVEL
    level_severity: tuple = LEVEL_SEVERITY
    http_status: tuple = HTTP_STATUS_SEVERITY
    stack_markers: tuple = STACK_MARKERS
    database: tuple = DATABASE_PATTERNS
    system_codes: tuple = SYSTEM_ERROR_CODES
    keyword_groups: tuple = field(default_factory=lambda: (
        ("error", ERROR_KEYWORDS),
        ("warning", WARNING_KEYWORDS),
        ("success", SUCCESS_KEYWORDS),
        ("debug", DEBUG_KEYWORDS),
    ))
    default_severity: str = "info"
    source_body_fields: tuple = SOURCE_BODY_FIELDS
    source_rules: tuple = SOURCE_RULES
    database_source_refinement: tuple = DATABASE_SOURCE_REFINEMENT


DEFAULT_RULES = Rules()
