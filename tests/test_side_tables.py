"""Rollup, text index, deep pages, lookups and deletes on the stored table."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from logspark.operators import query as Q
from logspark.operators import retention as H
from logspark.operators import stats as S
from logspark.operators.enrich import enrich
from logspark.sources import rollup as RU
from logspark.sources import search as TS
from logspark.sources import side, store
from logspark.sources.adapters import raw_logs, read_table
from logspark.streaming import stream as ST
from tests.conftest import SF_SMALL
from tests.test_io_plans import _plan

AS_OF = "2024-01-27 10:20:30.5"


def _events(spark):
    return enrich(raw_logs(read_table(spark, SF_SMALL, "events")))


def _made(spark, path):
    logs = _events(spark)
    store.append(logs.filter(F.col("id") % 2 == 0), path)
    store.append(logs.filter(F.col("id") % 2 == 1), path)
    return path


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    """A table that no test changes."""
    return _made(spark, str(tmp_path_factory.mktemp("shared") / "logs"))


@pytest.fixture()
def table(spark, tmp_path):
    return _made(spark, f"{tmp_path}/logs")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _same_statistics(spark, path, names=("stats_long", "retention_info")):
    logs = store.read_logs(spark, path)
    rolled = RU.rolled(spark, path, RU.bucket_bounds(AS_OF))
    for name in names:
        f = getattr(S, name)
        args = (AS_OF,) if name in ("stats_long", "stats_printout", "error_rate_24h", "age_buckets", "retention_info") else ()
        assert _rows(f(rolled, *args)) == _rows(f(logs, *args)), name


def test_statistics_from_the_rollup(spark, shared):
    _same_statistics(spark, shared, ("severity_counts", "source_counts", "error_rate", "severity_breakdown", "stats_long", "stats_printout",
                                    "error_rate_24h", "age_buckets", "retention_info"))


def test_side_tables_follow_the_store(spark, table):
    """Appends, a rewritten micro-batch, deletes, retention and compaction."""
    f = Q.LogFilter(search="timeout")
    some = store.read_logs(spark, table).limit(5).select("id")

    def check():
        _same_statistics(spark, table)
        assert _rows(TS.search_table(spark, table, f)) == _rows(Q.search(store.read_logs(spark, table), f))
        assert {k[:2] for k in side._files(spark, f"{table}/_side/hours")} == set(side.versions(spark, table))

    check()
    logs = _events(spark).withColumn("id", F.col("id") + 10_000)
    store._write(logs.filter("id % 3 = 0"), table, "s-w-7", "overwrite")    # a failed attempt that was seen
    check()
    store.append_once(logs.filter("id % 3 = 1"), table, "w", 7)
    check()
    H.delete_from_table(spark, table, some)
    H.delete_one_from_table(spark, table, 10_000 + 4)
    check()
    H.cleanup_table(spark, table, 20, AS_OF)
    check()
    before = _rows(store.read_logs(spark, table))
    assert H.compact_table(spark, table, 1) and _rows(store.read_logs(spark, table)) == before
    assert H.compact_table(spark, table, 1) == []
    check()


def test_rollup_reads_logs_of_cut_hours_alone(spark, shared):
    plan = _plan(S.retention_info(RU.rolled(spark, shared, RU.bucket_bounds(AS_OF)), AS_OF))
    scans = [ln for ln in plan.split("\n") if ln.startswith("Location")]
    logs = [ln for ln in scans if "_side" not in ln]
    assert len(logs) == 1 and "PartitionFilters: [(((" in plan and "GreaterThanOrEqual(created_at" in plan
    assert all("_side" in ln for ln in _plan(S.severity_counts(RU.rolled(spark, shared))).split("\n") if ln.startswith("Location"))


def test_rows_without_a_time(spark, tmp_path):
    path = f"{tmp_path}/logs"
    logs = _events(spark).limit(40)
    store.append(logs.withColumn("created_at", F.when(F.col("id") % 2 == 0, F.col("created_at")))
                 .withColumn("log_date", F.to_date("created_at")), path)
    _same_statistics(spark, path)
    assert TS.deep_page(spark, path, 50, 5).count() == store.read_logs(spark, path).count() - 5


@pytest.mark.parametrize("q", ["timeout", "TIMEOUT", "time_ut", "%deadlock%detected", "xyzzy", "ab", "", "é", 'k":6', "\\", "İnfo"])
def test_search_with_the_index_finds_the_same(spark, shared, q):
    f = Q.LogFilter(search=q, from_="2024-01-05 03:00:00", to="2024-01-25 00:00:00")
    assert _rows(TS.search_table(spark, shared, f)) == _rows(Q.search(store.read_logs(spark, shared), f))


def test_files_without_a_hit_are_not_read(spark, tmp_path):
    path = f"{tmp_path}/logs"
    logs = _events(spark)
    for i in range(4):
        store.append(logs.filter(F.col("id") % 4 == i).withColumn("description", F.lit(f"only in part {i}: 😀zq{i}zq")), path)
    found = TS.search_table(spark, path, Q.LogFilter(search="Q2Z"))
    assert found.count() == logs.filter("id % 4 = 2").count()
    assert len(found.inputFiles()) < len(store.read_logs(spark, path).inputFiles()) / 3
    assert TS.files_with(spark, path, Q.LogFilter(search="q2zq3")) == []


@pytest.mark.parametrize("offset", [0, 7, 333, 500, 900, 10_000])
def test_deep_pages(spark, shared, offset):
    got = TS.deep_page(spark, shared, 30, offset)
    assert got.collect() == Q.page(store.read_logs(spark, shared), 30, offset).collect()
    bounded = TS.deep_page(spark, shared, 30, offset, "2024-01-10", "2024-01-20")
    days = store.read_logs(spark, shared).filter("log_date between '2024-01-10' and '2024-01-20'")
    assert bounded.collect() == Q.page(days, 30, offset).collect()


def test_deep_page_reads_the_days_it_touches(spark, shared):
    at = store.read_logs(spark, shared).groupBy("log_date").count().orderBy(F.col("log_date").desc()).collect()
    skipped = sum(r["count"] for r in at[:10])
    got = TS.deep_page(spark, shared, at[10]["count"], skipped)
    assert {r.log_date for r in got.collect()} == {at[10].log_date}
    assert f"log_date IN ({at[10].log_date})" in _plan(got).replace("#", " ") or str(at[10].log_date) in _plan(got)


def test_lookup_skips_files_by_their_bloom_filter(spark, tmp_path):
    """Ids of two files interleave, so their ranges do not tell them apart."""
    path = f"{tmp_path}/logs"
    rows = spark.range(200_000).withColumn("created_at", F.lit(dt.datetime(2024, 1, 1))).select("id", "created_at")
    base = _events(spark).limit(1).drop("id", "created_at", "log_date").crossJoin(rows).withColumn("log_date", F.to_date("created_at"))
    for i in range(4):
        store.append(base.filter(F.col("id") % 4 == i).coalesce(1), path)
    found = Q.lookup(store.read_logs(spark, path), 123_457)
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan()
    found.collect()
    leaves = plan.collectLeaves() if not plan.toString().startswith("Adaptive") else plan.executedPlan().collectLeaves()
    read = leaves.head().metrics().apply("numOutputRows").value()
    assert 0 < read < 60_000                 # one file of four, and of it the pages around the id
    size = max(os.path.getsize(f) for f in glob.glob(f"{path}/log_date=*/batch=*/*.parquet"))
    assert size < 3_000_000
    assert H.delete_one_from_table(spark, path, 123_457) == {"id": 123_457, "deleted": 1, "found": True}
    assert H.delete_one_from_table(spark, path, 123_457) == {"id": 123_457, "deleted": 0, "found": False}
    assert store.read_logs(spark, path).count() == 199_999


def test_maintenance_announces_what_it_removes(spark, table, tmp_path):
    feed = f"{tmp_path}/feed"
    logs = store.read_logs(spark, table)
    ids = [r.id for r in logs.orderBy("id").limit(9).collect()] + [-7]
    H.delete_from_table(spark, table, spark.createDataFrame([(i,) for i in ids], "id long"), feed=feed)
    H.delete_one_from_table(spark, table, 300, feed=feed)
    H.delete_one_from_table(spark, table, -7, feed=feed)
    n = store.read_logs(spark, table).count()
    report = H.cleanup_table(spark, table, 10, AS_OF, feed=feed)
    said = spark.read.parquet(feed)
    assert said.filter("type = 'log_deleted'").count() == said.select("id").distinct().count() == 9 + 1 + report["deleted"]
    assert store.read_logs(spark, table).count() == n - report["deleted"]
    assert said.filter("severity is null or created_at is null").count() == 0


def _live(spark, base, created, deletes):
    return {(r.kind, r.key): r.rate if r.kind == "error_rate" else r.n
            for r in ST.live_stats(created, deletes, base, "40 days", "90 days").collect()}


def test_live_stats_after_every_arrival(spark, tmp_path):
    """Against a plain count after each of four arrivals, in odd order; ids are
    deleted twice, before their log arrives, and without one."""
    ev = read_table(spark, SF_SMALL, "events").withColumn("deleted_at", F.col("ts") + F.expr("INTERVAL 3 HOURS"))
    parts = [ev.filter(F.col("event_id") % 5 == 4), ev.filter("event_id % 5 = 1"), ev.filter("event_id < 400 and event_id % 5 in (0, 2)"),
             ev.filter("event_id >= 400 and event_id % 5 in (0, 2)")]
    gone = [ev.filter("event_id % 7 = 0"), ev.filter("event_id % 7 = 0 and event_id % 2 = 0"), ev.filter("event_id % 11 = 3"),
            ev.limit(1).withColumn("event_id", F.lit(-5).cast("long"))]
    seen, dead = None, set()
    for part, deleted in zip(parts, gone):
        part.drop("deleted_at").write.mode("append").parquet(f"{tmp_path}/events")
        deleted.select(F.col("event_id").alias("id"), "deleted_at").write.mode("append").parquet(f"{tmp_path}/deletes")
        got = _live(spark, f"{tmp_path}/run", enrich(raw_logs(ST.events_stream(spark, f"{tmp_path}/events", glob="*.parquet"))),
                    spark.readStream.schema("id long, deleted_at timestamp_ntz").parquet(f"{tmp_path}/deletes"))
        seen = part if seen is None else seen.union(part)
        dead |= {r.event_id for r in deleted.collect()}
        rows = enrich(raw_logs(seen)).select("id", "created_at", F.coalesce("derived_severity", "severity").alias("s"),
                                             F.coalesce("source", F.lit("unknown")).alias("src")).collect()
        left = [r for r in rows if r.id not in dead]
        edge = max(r.created_at for r in rows) - dt.timedelta(hours=24)
        want = {("total", None): len(left), ("recent", None): sum(r.created_at >= edge for r in left),
                ("error_rate", None): sum(r.s in ("error", "critical") for r in left) / len(left) * 100.0}
        for r in rows:
            for k in (("by_severity", r.s), ("by_source", r.src)):
                want[k] = want.get(k, 0) + (r.id not in dead)
        assert got == pytest.approx(want)
    assert len(os.listdir(f"{tmp_path}/run/times")) <= 27 + 2          # the ring, and no more


def test_live_stats_enrich_a_record_once(spark, tmp_path):
    """Over two arrivals of deletes and logs, and one of deletes alone."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(i):
        seen.add(1)
        return i

    counted = counted.asNondeterministic()      # not pushed about, not evaluated twice
    ev = read_table(spark, SF_SMALL, "events")
    for i, part in enumerate((ev.filter("event_id < 300"), ev.filter("event_id >= 300"), None)):
        if part is not None:
            part.write.mode("append").parquet(f"{tmp_path}/events")
        ev.filter(F.col("event_id") % 3 == i).select(F.col("event_id").alias("id"), F.col("ts").alias("deleted_at")) \
            .write.mode("append").parquet(f"{tmp_path}/deletes")
        created = enrich(raw_logs(ST.events_stream(spark, f"{tmp_path}/events", glob="*.parquet"))).withColumn("id", counted("id"))
        got = _live(spark, f"{tmp_path}/run", created, spark.readStream.schema("id long, deleted_at timestamp_ntz").parquet(f"{tmp_path}/deletes"))
    n = enrich(raw_logs(ev)).count()
    assert seen.value == n
    assert got["total", None] == 0 and got["recent", None] == 0
    assert len(os.listdir(f"{tmp_path}/run/kept/rows")) == 1        # what was read is dropped


def test_live_stats_of_deletes_alone(spark, tmp_path):
    ev = read_table(spark, SF_SMALL, "events")
    os.makedirs(f"{tmp_path}/events")
    ev.select(F.col("event_id").alias("id"), F.col("ts").alias("deleted_at")).write.parquet(f"{tmp_path}/deletes")
    for part in (None, ev.filter("event_id < 50")):
        if part is not None:
            part.write.mode("append").parquet(f"{tmp_path}/events")
        got = _live(spark, f"{tmp_path}/run", enrich(raw_logs(ST.events_stream(spark, f"{tmp_path}/events", glob="*.parquet"))),
                    spark.readStream.schema("id long, deleted_at timestamp_ntz").parquet(f"{tmp_path}/deletes"))
    assert got["total", None] == 0
