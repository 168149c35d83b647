"""Deletes, retention, request metrics and percentiles (H, F21-F27, G1)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logspark.operators import metrics as M
from logspark.operators import retention as H
from logspark.operators.enrich import enrich

NOW = dt.datetime(2024, 1, 29, 12, 0, 0)


def stamped(raw_frame, stamps):
    rows = [("Log", None, None, None, None, None, ts) for ts in stamps]
    return enrich(raw_frame(rows).withColumn("id", F.monotonically_increasing_id()))


def test_cleanup_counts_and_message(spark, raw_frame):
    logs = stamped(raw_frame, [NOW - dt.timedelta(days=40)] * 5 + [NOW - dt.timedelta(days=10)] * 3)
    kept, report = H.apply_retention(logs, 30, NOW)
    r = report.first()
    assert (r.deleted, r.days, r.message) == (5, 30, "Cleaned up 5 logs older than 30 days")
    assert kept.count() == 3
    none = H.apply_retention(stamped(raw_frame, [NOW]), 30, NOW).report.first()
    assert none.message == "No logs older than 30 days to clean up"


def test_cleanup_cutoff_edge(spark, raw_frame):
    cutoff = NOW - dt.timedelta(days=30)
    logs = stamped(raw_frame, [cutoff - dt.timedelta(seconds=1), cutoff, cutoff + dt.timedelta(seconds=1)])
    kept, report = H.apply_retention(logs, 30, NOW)
    assert report.first().deleted == 1 and kept.count() == 2


def test_cleanup_rejects_bad_days():
    for d in (0, -5, None):
        with pytest.raises(ValueError):
            H.cutoff_for(d, NOW)


def test_cleanup_many(spark, raw_frame):
    logs = stamped(raw_frame, [NOW - dt.timedelta(days=60)] * 1000)
    assert H.apply_retention(logs, 30, NOW).report.first().deleted == 1000


def test_delete_ids(spark, raw_frame):
    logs = stamped(raw_frame, [NOW] * 10)
    ids = [r.id for r in logs.select("id").collect()]
    req = spark.createDataFrame([(ids[0],), (ids[0],), (ids[1],), (-1,)], "id long")
    kept, report = H.delete_ids(logs, req)
    r = report.first()
    assert (r.requested, r.deleted, r.missing) == (3, 2, 1)
    assert kept.count() == 8
    with pytest.raises(ValueError):
        H.delete_ids(logs, spark.createDataFrame([], "id long"))
    one = H.delete_id(logs, ids[3]).report.first()
    assert one.found and one.deleted == 1
    assert not H.delete_id(logs, -7).report.first().found


def access_frame(spark, durations, path="/p", statuses=None):
    statuses = statuses or [200] * len(durations)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, path, s, d, base + dt.timedelta(seconds=i)) for i, (d, s) in enumerate(zip(durations, statuses))]
    return spark.createDataFrame(rows, "id long, path string, status int, duration_ms long, ts timestamp_ntz")


def test_rank_percentile_formula(spark):
    acc = access_frame(spark, [50, 10, 40, 20, 100, 30])
    r = M.rank_percentiles(acc, "duration_ms", (50, 95, 99, 0, 100)).first()
    # sorted = 10 20 30 40 50 100; index = min(N*p//100, N-1)
    assert (r.p50, r.p95, r.p99, r.p0, r.p100, r.n, r.max) == (40, 100, 100, 10, 100, 6, 100)
    ten = access_frame(spark, list(range(10)))
    assert M.rank_percentiles(ten, "duration_ms", (50,)).first().p50 == 5      # not 4 (plain percentile_disc)


def test_rank_percentile_with_ties_and_groups(spark):
    a = access_frame(spark, [5] * 7 + [9] * 3, "/a")
    b = access_frame(spark, [1, 2], "/b")
    got = {r.path: (r.p50, r.p95, r.n) for r in M.rank_percentiles(a.unionByName(b), "duration_ms", (50, 95), ("path",)).collect()}
    assert got == {"/a": (5, 9, 10), "/b": (2, 2, 2)}


def test_request_metrics_and_exposition(spark):
    acc = access_frame(spark, [1, 2, 3, 4], statuses=[200, 404, 500, 201])
    m = M.request_metrics(acc).first()
    assert (m.total_requests, m.total_errors, m.error_rate) == (4, 2, "50.000%")
    lines = sorted(r.line for r in M.exposition(acc).collect())
    assert lines == ["logspark_http_errors_total 2", "logspark_http_requests_total 4"]
    none = M.request_metrics(spark.createDataFrame([], acc.schema)).first()
    assert none.error_rate == "0.00%"


def test_last_n_cap(spark):
    acc = access_frame(spark, list(range(150)))
    last = M.last_n_per_key(acc, "path", 100)
    assert last.count() == 100
    assert last.agg(F.min("duration_ms")).first()[0] == 50     # the oldest 50 are dropped


def test_delivery_report(spark):
    acc = access_frame(spark, [10, 20, 30, 40, 50, 100], statuses=[200, 200, 500, 200, 200, 404])
    r = M.delivery_report(acc).first()
    assert (r.sent, r.success, r.failed, r.p50, r.max) == (6, 4, 2, 40, 100)
    assert r.rate_per_sec == pytest.approx(6 / 5.0)


def _table(spark, raw_frame, stamps):
    import tempfile

    from logspark.sources import store

    path = tempfile.mkdtemp(dir="/tmp") + "/logs"
    store.append(stamped(raw_frame, stamps), path)
    return path


def _files(path):
    import glob
    import os

    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/log_date=*/batch=*/*.parquet")}


def test_cleanup_table_rewrites_only_the_boundary_day(spark, raw_frame):
    from logspark.sources import store

    stamps = [dt.datetime(2024, 1, d, h) for d in range(1, 11) for h in (1, 13)]
    path = _table(spark, raw_frame, stamps)
    before = _files(path)
    as_of = dt.datetime(2024, 1, 10, 6)            # cutoff 2024-01-05 06:00 for 5 days
    rep = H.cleanup_table(spark, path, 5, as_of)
    assert rep["deleted"] == 9 and rep["message"] == "Cleaned up 9 logs older than 5 days"
    back = store.read_logs(spark, path)
    assert back.count() == len(stamps) - 9
    assert back.agg(F.min("created_at")).first()[0] == dt.datetime(2024, 1, 5, 13)
    days = sorted(H.partition_days(spark, path))
    assert days[0] == dt.date(2024, 1, 5) and len(days) == 6
    after = _files(path)
    later_days = [f for f in before if any(f"log_date=2024-01-{d:02d}" in f for d in range(6, 11))]
    assert later_days and all(f in after and before[f] == after[f] for f in later_days)   # not rewritten


def test_delete_from_table(spark, raw_frame):
    from logspark.sources import store

    stamps = [dt.datetime(2024, 2, d, 12) for d in range(1, 6) for _ in range(3)]
    path = _table(spark, raw_frame, stamps)
    back = store.read_logs(spark, path)
    day3 = [r.id for r in back.filter(F.col("log_date") == dt.date(2024, 2, 3)).collect()]
    one_day1 = back.filter(F.col("log_date") == dt.date(2024, 2, 1)).first().id
    ids = spark.createDataFrame([(i,) for i in day3 + [one_day1, one_day1, -5]], "id long")
    rep = H.delete_from_table(spark, path, ids)
    assert rep == {"requested": 5, "deleted": 4, "missing": 1}
    back = store.read_logs(spark, path)
    assert back.count() == 11
    assert dt.date(2024, 2, 3) not in H.partition_days(spark, path)


def test_exact_percentiles_on_a_hot_group(spark):
    import numpy as np

    hot = spark.range(60000).select(F.lit("/hot").alias("path"), (F.col("id") * 7 % 100003).alias("duration_ms"))
    small = spark.range(300).select(F.concat(F.lit("/p"), (F.col("id") % 7).cast("string")).alias("path"),
                                    (F.col("id") % 13).alias("duration_ms"))
    df = hot.unionByName(small)
    got = {r.path: (r.p50, r.p95, r.p99, r.n, r.max)
           for r in M.rank_percentiles(df, "duration_ms", (50, 95, 99), ("path",)).collect()}
    for path, g in df.toPandas().groupby("path"):
        v = np.sort(g.duration_ms.values)
        n = len(v)
        want = tuple(int(v[min(n * p // 100, n - 1)]) for p in (50, 95, 99)) + (n, int(v[-1]))
        assert got[path] == want, path


def test_percentile_plan_has_no_product_and_no_join_on_the_bare_group(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        acc = access_frame(spark, list(range(100)))
        for df in (M.latency_report(acc), M.delivery_report(acc)):
            plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan
            assert plan.count("Scan parquet") <= 3 * 2  # the histogram is read, never the records
            assert all("_bucket" in line for line in plan.split("\n") if line.startswith("Left keys"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_stopped_swap_is_finished_by_the_next_write(spark, raw_frame):
    from logspark.sources import store

    path = _table(spark, raw_frame, [dt.datetime(2024, 3, 1, h) for h in range(6)])
    day = dt.date(2024, 3, 1)
    kept = store.read_logs(spark, path).filter(F.col("created_at") >= dt.datetime(2024, 3, 1, 4))
    done, store.finish_swaps = store.finish_swaps, lambda *a: None   # the job dies before the swap
    try:
        store.replace_days(spark, path, kept, [day])
    finally:
        store.finish_swaps = done
    assert store.read_logs(spark, path).count() == 6                 # nothing has changed yet
    store.append(stamped(raw_frame, [dt.datetime(2024, 3, 2)]), path)
    assert store.read_logs(spark, path).count() == 3
    assert store.read_logs(spark, path).filter(F.col("log_date") == day).count() == 2


def test_rows_appended_during_a_rewrite_stay(spark, raw_frame):
    from logspark.sources import store

    path = _table(spark, raw_frame, [dt.datetime(2024, 3, 1, h) for h in range(6)])
    kept = store.read_logs(spark, path).filter(F.col("created_at") >= dt.datetime(2024, 3, 1, 4))
    done, store.finish_swaps = store.finish_swaps, lambda *a: None
    try:
        store.replace_days(spark, path, kept, [dt.date(2024, 3, 1)])
        store.append(stamped(raw_frame, [dt.datetime(2024, 3, 1, 23)]), path)
    finally:
        store.finish_swaps = done
    store.finish_swaps(spark, path)
    assert store.read_logs(spark, path).count() == 3
