"""Filters, paging, views and statistics on small hand-made log sets (E, F, B)."""

import datetime as dt

from pyspark.sql import functions as F

from logspark.functions import formatting as FM
from logspark.operators import query as Q
from logspark.operators import stats as S
from logspark.operators.enrich import enrich


def T(s):
    return dt.datetime.fromisoformat(s)


def five_logs(raw_frame):
    rows = [
        ("Error in payment", "error", "payment-service", None, None, None, T("2024-01-10 10:00:00")),
        ("Warning in auth", "warning", "auth-service", None, None, None, T("2024-01-10 11:00:00")),
        ("Info in api", "info", "api-gateway", None, None, None, T("2024-01-10 12:00:00")),
        ("Another error", "error", "database", None, None, None, T("2024-01-11 00:00:00")),
        ("Debug message", "debug", "api-gateway", None, None, None, T("2024-01-11 01:00:00")),
    ]
    return enrich(raw_frame(rows).withColumn("id", F.monotonically_increasing_id()))


def count(df):
    return df.count()


def test_filter_golden(spark, raw_frame):
    logs = five_logs(raw_frame).cache()
    cases = [
        (Q.LogFilter(severity="error"), 2),
        (Q.LogFilter(severity="warning"), 1),
        (Q.LogFilter(source="api-gateway"), 2),
        (Q.LogFilter(source="api-gateway", severity="info"), 1),
        (Q.LogFilter(search="payment"), 1),
        (Q.LogFilter(severity="critical"), 0),
        (Q.LogFilter(from_="2024-01-10 11:00:00", to="2024-01-11 00:00:00"), 3),   # both bounds inclusive
        (Q.day_filter("2024-01-10"), 4),                                            # next midnight inclusive
    ]
    for f, want in cases:
        assert count(Q.search(logs, f)) == want, f


def test_search_wildcards_and_escape(spark, raw_frame):
    logs = enrich(raw_frame([("100% done",), ("a_b c",), ("path C:\\temp",), ("abc",), ("ABC upper",)]))
    got = lambda q: sorted(r.title for r in Q.search(logs, Q.LogFilter(search=q)).collect())
    assert got("abc") == ["ABC upper", "abc"]            # case-insensitive
    assert got("a_b") == ["a_b c"]                       # _ is a one-char wildcard
    assert got("0%d") == ["100% done"]                   # % is a wildcard
    assert got("C:\\temp") == ["path C:\\temp"]          # backslash is literal


def test_paging_and_page_info(spark, raw_frame):
    rows = [(f"Log {i}", "info", None, None, None, None, T("2024-01-01 00:00:00") + dt.timedelta(minutes=i))
            for i in range(45)]
    logs = enrich(raw_frame(rows).withColumn("id", F.monotonically_increasing_id()))
    assert Q.clamp_api(None, None) == (20, 0)
    assert Q.clamp_api(3, 500) == (100, 200)
    assert Q.clamp_listing(0, -5) == (100, 0)
    assert Q.clamp_listing(5000, 7) == (1000, 7)
    page2 = [r.title for r in Q.page_number(logs, 2, 20).collect()]
    assert page2 == [f"Log {i}" for i in range(24, 4, -1)]
    info = Q.page_info(logs, 20, 40).first()
    assert (info.total, info.total_pages, info.shown) == (45, 3, 5)
    assert info.summary == "Showing 41-45 of 45 logs"
    assert Q.page_info(logs, 100, 0).first().summary is None


def test_list_view_title_cut(spark, raw_frame):
    t50, t51 = "x" * 50, "y" * 51
    logs = enrich(raw_frame([(t50,), (t51,)]))
    got = {r.title for r in Q.list_view(logs).collect()}
    assert got == {t50, "y" * 47 + "..."}
    assert {r.source for r in Q.list_view(logs).collect()} == {"-"}


def test_severity_and_source_counts(spark, raw_frame):
    sevs = ["error", "error", "warning", "info", "info", "info"]
    logs = enrich(raw_frame([("Log", s) for s in sevs]))
    assert {r.severity: r.n for r in S.severity_counts(logs).collect()} == {"error": 2, "warning": 1, "info": 3}
    srcs = ["api", "api", "database", "", None, "unknown"]
    logs = enrich(raw_frame([("Log", "info", s) for s in srcs]))
    assert {r.source: r.n for r in S.source_counts(logs).collect()} == {"api": 2, "database": 1, "unknown": 3}


def test_stats_bundle_one_row(spark, raw_frame):
    now = T("2024-01-29 12:00:00")
    rows = [("Log", "error", "api", None, None, None, now - dt.timedelta(hours=h)) for h in (1, 5, 30, 50)]
    logs = enrich(raw_frame(rows))
    st = S.stats(logs, now).first()
    assert (st.total, st.last_24_hours) == (4, 2)
    assert st.by_severity == {"error": 4} and st.by_source == {"api": 4}
    er = S.error_rate(logs).first()
    assert er.error_rate == 100.0


def test_age_buckets_bounds(spark, raw_frame):
    now = T("2024-03-31 10:20:30")
    d0 = T("2024-03-31 00:00:00")
    month_ago = T("2024-03-02 10:20:30")
    stamps = {
        "today": [d0, now - dt.timedelta(microseconds=1)],
        "yesterday": [d0 - dt.timedelta(days=1), d0 - dt.timedelta(microseconds=1)],
        "last_week": [now - dt.timedelta(days=7)],
        "last_month": [month_ago, now - dt.timedelta(days=7, microseconds=1)],
        "older": [month_ago - dt.timedelta(microseconds=1), T("2023-01-01 00:00:00")],
        None: [now, now + dt.timedelta(days=3)],          # at or after as_of: counted nowhere
    }
    rows = [("Log", None, None, None, None, None, ts) for v in stamps.values() for ts in v]
    logs = enrich(raw_frame(rows))
    got = {r.bucket: r.n for r in S.age_buckets(logs, now).collect()}
    assert got == {k: len(v) for k, v in stamps.items() if k}
    info = S.retention_info(logs, now).first()
    # today (2), the last microsecond of yesterday, and the two rows at or after as_of
    assert info.total == len(rows) and info.last_24_hours == 5


def test_month_ago_overflow(spark):
    cases = {
        "2024-03-31 10:20:30": "2024-03-02 10:20:30",   # leap year: 31 Feb -> 2 Mar
        "2023-03-31 10:20:30": "2023-03-03 10:20:30",   # 31 Feb -> 3 Mar
        "2024-01-15 00:00:00": "2023-12-15 00:00:00",
        "2024-05-31 23:59:59": "2024-05-01 23:59:59",   # 31 Apr -> 1 May
    }
    for k, v in cases.items():
        assert FM.month_ago_value(T(k)) == T(v)
    df = spark.createDataFrame([(T(k),) for k in cases], "t timestamp_ntz")
    got = {r.t: r.m for r in df.select("t", FM.month_ago("t").alias("m")).collect()}
    assert got == {T(k): T(v) for k, v in cases.items()}


def test_number_and_duration_text(spark):
    df = spark.createDataFrame([(0.0,), (12.3456,), (99.9999,), (100.0,), (1 / 3 * 100,)], "v double")
    got = [r.t for r in df.select(FM.percent_text("v").alias("t")).collect()]
    assert got == ["0.000%", "12.345%", "99.999%", "100.000%", "33.333%"]
    secs = spark.createDataFrame([(5,), (65,), (3600,), (3725,)], "s long")
    assert [r.t for r in secs.select(FM.duration_text("s").alias("t")).collect()] == ["5s", "1m 5s", "1h 0m 0s", "1h 2m 5s"]
    empty = spark.createDataFrame([(0, 0), (3, 1)], "total long, errors long")
    assert [r.t for r in empty.select(FM.rate_percent_text("errors", "total").alias("t")).collect()] == ["0.00%", "33.333%"]


def test_hourly_distribution_zero_filled(spark, raw_frame):
    rows = [("Log", None, None, None, None, None, T("2024-01-01 05:10:00")),
            ("Log", None, None, None, None, None, T("2024-01-02 05:50:00"))]
    got = {r.hour: r.n for r in S.hourly_distribution(enrich(raw_frame(rows))).collect()}
    assert len(got) == 24 and got[5] == 2 and sum(got.values()) == 2


def test_served_forms_and_orderings(spark, raw_frame):
    now = T("2024-01-29 12:00:00")
    rows = [("Log", s, src, None, None, None, now - dt.timedelta(hours=1))
            for s, src in [("error", "api"), ("debug", "api"), ("critical", None), ("custom", "db")]]
    logs = enrich(raw_frame(rows))
    assert [r.severity for r in S.by_type(logs).collect()] == ["debug", "error", "critical", "custom"]
    printed = [(r.kind, r.key) for r in S.stats_printout(logs, now).collect()]
    assert printed == sorted(printed) and ("by_source", "unknown") in printed
    opts = {(r.kind, r.value) for r in S.filter_options(logs).collect()}
    assert ("severity", "custom") in opts and ("source", "db") in opts
    br = {r.severity: (r.label, r.rank, r.percentage) for r in S.severity_breakdown(logs).collect()}
    assert br["custom"] == ("Custom", 10, 25) and br["debug"] == ("Debug", 0, 25)
    # rows exactly 1 h before as_of are in slot 1: no spike; no errors in the
    # previous 24 h: no change line; 2 of 4 are errors: one rate line
    alerts = [r.alert for r in S.alerts(logs, now).collect()]
    assert alerts == ["High error rate: 50.000% in the last 24 hours"]
