"""Ingest formats, store, ids, exports and physical-plan properties."""

import csv
import glob
import json
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from logspark.operators import export as X
from logspark.operators import metrics as M
from logspark.operators import query as Q
from logspark.operators import stats as S
from logspark.operators.enrich import enrich, from_nested, ingest
from logspark.plans import catalog
from logspark.schema import LOG_COLUMNS, RAW_NESTED
from logspark.sources import store as ST
from logspark.sources.adapters import access_logs, raw_logs, read_table
from tests.conftest import SF_SMALL


def test_nested_json_ingest(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    lines = [
        {"header": {"title": "Database connection failed", "source": "db", "extra": 1}, "body": {"test": True}},
        {"header": {"title": "Only title"}},
        {"header": {"title": "x"}, "body": [1, 2]},
        {"header": {"title": ""}},
    ]
    with open(f"{d}/in.json", "w") as fh:
        for ln in lines:
            fh.write(json.dumps(ln) + "\n")
        fh.write("{not json\n")
    nested = spark.read.schema(RAW_NESTED).option("mode", "DROPMALFORMED").json(d)
    res = ingest(from_nested(nested))
    got = {r.title: r for r in res.logs.collect()}
    assert set(got) == {"Database connection failed", "Only title"}
    assert got["Database connection failed"].body == '{"test":true}'
    assert got["Database connection failed"].derived_severity == "error"
    assert got["Only title"].body == "{}"
    assert res.rejected.count() == 2


def test_store_append_scan_and_tolerant_body(spark):
    d = tempfile.mkdtemp(dir="/tmp") + "/logs"
    logs = enrich(raw_logs(read_table(spark, SF_SMALL, "events")))
    ST.append(logs, d)
    back = ST.read_logs(spark, d)
    assert back.count() == logs.count()
    assert ST.max_id(spark, d) == logs.agg(F.max("id")).first()[0]
    broken = back.limit(3).withColumn("body", F.lit("not json"))
    assert {r.body for r in ST.tolerant(broken).collect()} == {"{}"}


def test_assign_ids_dense_and_ordered(spark):
    raw = raw_logs(read_table(spark, SF_SMALL, "events")).drop("id").repartition(5)
    ids = ST.assign_ids(raw, start_after=100)
    rows = sorted((r.created_at, r.id) for r in ids.select("created_at", "id").collect())
    assert [i for _, i in rows] == list(range(101, 101 + len(rows)))


def test_exports_read_back(spark):
    logs = enrich(raw_logs(read_table(spark, SF_SMALL, "events")))
    d = tempfile.mkdtemp(dir="/tmp")
    X.export_csv(logs, f"{d}/csv", X.export_request("csv", 50))
    files = glob.glob(f"{d}/csv/*.csv")
    rows = [r for f in files for r in csv.DictReader(open(f, newline=""))]
    assert len(rows) == 50 and list(rows[0].keys()) == ["id", "severity", "source", "title", "description", "created_at"]
    X.export_json(logs, f"{d}/json", X.export_request("json", 20))
    recs = [json.loads(x) for f in glob.glob(f"{d}/json/*.txt") for x in open(f)]
    assert len(recs) == 20 and set(recs[0]) >= {"id", "header", "body", "metadata", "created_at"}
    X.export_dashboard_csv(logs.limit(5), f"{d}/dash")
    text = "".join(open(f).read() for f in glob.glob(f"{d}/dash/*.csv"))
    assert text.startswith('"ID","Timestamp","Severity","Title","Source","Description"')
    try:
        X.export_request("xml")
        raise AssertionError("xml accepted")
    except ValueError:
        pass
    assert X.export_request("csv", 10**9).limit == 10**9 and X.export_request("json").limit is None
    assert X.export_rows(logs, X.export_request("csv")).count() == logs.count()


def _plan(df) -> str:
    """The text ``df.explain("formatted")`` prints."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_filters_reach_the_scan_and_prune_partitions(spark):
    d = tempfile.mkdtemp(dir="/tmp") + "/logs"
    ST.append(enrich(raw_logs(read_table(spark, SF_SMALL, "events"))), d)
    logs = ST.read_logs(spark, d)
    f = Q.LogFilter(severity="error", source="api", from_="2024-01-05 00:00:00", to="2024-01-06 00:00:00")
    plan = _plan(Q.page(Q.search(logs, f), 20))
    for pushed in ("EqualTo(severity,error)", "EqualTo(source,api)", "GreaterThanOrEqual(created_at,2024-01-05T00:00)",
                   "LessThanOrEqual(created_at,2024-01-06T00:00)"):
        assert pushed in plan, pushed
    assert "PartitionFilters: [isnotnull(log_date" in plan and "log_date" in plan.split("PartitionFilters")[1][:200]
    assert "TakeOrderedAndProject" in plan


def test_stats_bundle_is_one_scan(spark):
    d = tempfile.mkdtemp(dir="/tmp") + "/logs"
    ST.append(enrich(raw_logs(read_table(spark, SF_SMALL, "events"))), d)
    plan = _plan(S.stats_long(ST.read_logs(spark, d), "2024-01-29 12:00:00"))
    scans = re.findall(r"^\(\d+\) Scan parquet", plan, flags=re.M)
    assert len(scans) == 1 and "Expand" in plan


def test_last_n_is_cut_before_the_shuffle(spark):
    acc = access_logs(read_table(spark, SF_SMALL, "events"))
    plan = _plan(M.last_n_per_key(acc, "path", 100))
    assert "WindowGroupLimit" in plan


def test_no_python_in_batch_plans(spark):
    logs = enrich(raw_logs(read_table(spark, SF_SMALL, "events")))
    for df in (logs, S.pattern_stats(logs), S.detection_accuracy(logs), Q.flat_view(logs)):
        p = _plan(df)
        assert "Python" not in p and "ArrowEval" not in p


def test_record_and_event_views(spark, raw_frame):
    import datetime as dt

    from logspark.streaming import stream as STR

    raw = raw_frame([("Database connection failed", None, None, "BLUE", None, '{"b":2,"a":"x"}',
                      dt.datetime(2024, 1, 2, 3, 4, 5))]).withColumn("id", F.lit(7).cast("long"))
    logs = enrich(raw)
    rec = json.loads(Q.record_json(logs).first().json)
    assert rec["header"] == {"title": "Database connection failed", "severity": "error", "color": "blue"}
    assert rec["body"] == {"a": "x", "b": 2} and rec["created_at"] == "2024-01-02T03:04:05Z"
    assert rec["metadata"] == {"derived_severity": "error", "derived_source": "database-service",
                               "derived_category": "database"}
    ev = Q.event_view(logs).first()
    assert ev.header.source == "" and ev.header.description == ""        # empty strings kept
    feed = STR.change_feed(logs, logs.select("id", "severity", "derived_severity", "source", "created_at"))
    kinds = sorted(r.type for r in feed.collect())
    assert kinds == ["log_created", "log_deleted"]
    bus = STR.feed_kafka_shape(feed).collect()
    assert {r.key for r in bus} == {"7"} and all(json.loads(r.value)["type"] for r in bus)
    receipt = Q.receipt(logs).first()
    assert (receipt.severity, receipt.created_at) == ("error", "2024-01-02T03:04:05Z")


def test_enrich_splits_without_a_filter(spark):
    plan = _plan(enrich(raw_logs(read_table(spark, SF_SMALL, "events"))))
    assert "Generate" in plan and "inline" in plan
    assert not re.findall(r"^\(\d+\) Filter", plan, flags=re.M)       # no body re-parse in a pushed filter


def test_derived_table_follows_its_input(spark, tmp_path):
    calls = []

    def build(source):
        calls.append(1)
        return source.withColumn("x", F.col("id") * 2)

    def table(key=("test",)):
        return ST.derived_table(spark, key, spark.read.parquet(f"{tmp_path}/in"), build)

    spark.range(100).write.parquet(f"{tmp_path}/in")
    a, b = table(), table()
    assert a.inputFiles() == b.inputFiles() and a.count() == 100 and len(calls) == 1     # built and written once
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/in")
    assert table().count() == 105 and len(calls) == 2
    assert table(("other",)).inputFiles() != table().inputFiles()


def test_stored_logs_build_no_enrichment_twice(spark, monkeypatch):
    catalog.logs(spark, SF_SMALL)

    def never(*_):
        raise AssertionError("the table was written before")

    monkeypatch.setattr(ST, "enrich", never)
    assert catalog.logs(spark, SF_SMALL).columns == LOG_COLUMNS


@pytest.mark.parametrize("merge", ["true", "false"])
@pytest.mark.parametrize("partitions", ["8", "200"])
def test_ids_of_a_million_rows(spark, merge, partitions):
    """Row count, distinct ids, 1..N and the order are exact, whatever the split."""
    n = 1_000_000
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merge)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        rows = spark.range(0, n, 1, 16).select(
            (F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(n // 2)))).cast("timestamp_ntz").alias("created_at"),
            F.col("id").alias("payload"))
        ids = ST.assign_ids(rows, start_after=7)
        r = ids.agg(F.count(F.lit(1)), F.countDistinct("id"), F.min("id"), F.max("id"), F.countDistinct("payload")).first()
        assert tuple(r) == (n, n, 8, n + 7, n)
        before = ids.select(F.col("id") + 1, F.col("created_at")).toDF("id", "previous")
        assert ids.join(before, "id").filter(F.col("previous") > F.col("created_at")).count() == 0
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_recent_windows_prune_partitions(spark, tmp_path):
    from logspark.operators import retention as H

    ST.append(enrich(raw_logs(read_table(spark, SF_SMALL, "events"))), f"{tmp_path}/logs")
    logs = ST.read_logs(spark, f"{tmp_path}/logs")
    at = "2024-01-29 12:00:00"
    for df in (S.error_rate_24h(logs, at), S.trends(logs, at), S.alerts(logs, at), H.apply_retention(logs, 20, at).report):
        plan = _plan(df)
        assert re.search(r"PartitionFilters: \[[^\]]*log_date", plan), plan[:3000]


def test_few_files_for_each_day(spark, tmp_path):
    ST.append(enrich(raw_logs(read_table(spark, SF_SMALL, "events").repartition(16))), f"{tmp_path}/logs")
    days = glob.glob(f"{tmp_path}/logs/log_date=*")
    assert len(days) >= 28 and all(len(glob.glob(f"{d}/batch=*/*.parquet")) <= 2 for d in days)


def test_a_stray_hour_adds_a_day_of_rows(spark, raw_frame):
    import datetime as dt

    rows = [("an error", None, None, None, None, None, t) for t in (dt.datetime(2024, 1, 1, 5), dt.datetime(9998, 1, 1))]
    got = S.hourly_error_series(enrich(raw_frame(rows))).orderBy("hour").collect()
    assert len(got) == 26 and [r.total for r in got if r.total] == [1, 1]
    assert got[0].trailing_mean is None and got[1].trailing_mean == 1.0 and got[24].trailing_mean == pytest.approx(1 / 24)
