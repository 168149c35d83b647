"""Streaming results equal batch results (J), in and out of time order."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logspark.operators import stats as S
from logspark.operators.enrich import enrich
from logspark.sources.adapters import access_logs, raw_logs, read_table
from logspark.streaming import stream as ST
from tests.conftest import SF_SMALL


def _as_set(df, cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def _arrive(spark, base, frames):
    """Yields after each of ``frames`` of events has arrived as files."""
    for f in frames:
        f.write.mode("append").parquet(f"{base}/events")
        yield ST.events_stream(spark, f"{base}/events", glob="*.parquet")


def _thirds(spark):
    ev = read_table(spark, SF_SMALL, "events")
    day = F.dayofmonth("ts")
    return [ev.filter(day <= 10), ev.filter((day > 10) & (day <= 20)), ev.filter(day > 20)]


@pytest.mark.parametrize("order, watermark", [((0, 1, 2), "2 hours"), ((2, 0, 1), "40 days"), ((2, 0, 1), "2 hours")])
def test_hourly_counts_in_three_batches(spark, tmp_path, order, watermark):
    """With lateness enough nothing is lost; with less, what is lost is counted."""
    batch = enrich(raw_logs(read_table(spark, SF_SMALL, "events")))
    want = batch.groupBy(F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("hour")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.coalesce("derived_severity", "severity").isin("error", "critical")).alias("errors"))
    parts, entered = _thirds(spark), 0
    for stream in _arrive(spark, str(tmp_path), [parts[i] for i in order]):
        got, more = ST.run_available(ST.hourly_counts(enrich(raw_logs(stream)), watermark), f"{tmp_path}/run", "update", ("hour",))
        entered += more
    assert entered == batch.count()
    dropped = ST.not_counted(got, "total", entered)
    if (order, watermark) == ((2, 0, 1), "2 hours"):
        assert dropped > 0
    else:
        assert dropped == 0 and _as_set(got, ["hour", "total", "errors"]) == _as_set(want, ["hour", "total", "errors"])


def _one_row_group(spark, at, n=4000):
    """Events in one file of one row group, which a scan cannot split."""
    rows = spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 60).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 7).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.5).alias("value"), F.lit('{"k": 1}').alias("props"))
    rows.coalesce(1).write.mode("append").parquet(at)
    return rows


def test_one_row_group_is_enriched_by_all_cores(spark, tmp_path):
    rows = _one_row_group(spark, f"{tmp_path}/events")
    stream = ST.events_stream(spark, f"{tmp_path}/events", glob="*.parquet")
    got = ST.run_available(enrich(raw_logs(stream)).withColumn("task", F.spark_partition_id()), f"{tmp_path}/run").result
    want = enrich(raw_logs(rows))
    shares = [r["count"] for r in got.groupBy("task").count().collect()]
    assert len(shares) >= spark.sparkContext.defaultParallelism
    assert max(shares) < 2 * got.count() / spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, got.drop("task").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_tables_by_day_stay_in_few_files(spark, tmp_path):
    """However many tasks enrich, a day of a micro-batch is not cut into a file for each."""
    _one_row_group(spark, f"{tmp_path}/events")
    stream = enrich(raw_logs(ST.events_stream(spark, f"{tmp_path}/events", glob="*.parquet")))
    ST.stats_snapshots(stream, f"{tmp_path}/snapshots")
    ST.live_tail(stream, None, f"{tmp_path}/tail")
    for at in ("snapshots/times/epoch=0", "tail/created/epoch=0"):
        days = [[f for f in d.iterdir() if f.suffix == ".parquet"] for d in (tmp_path / at).glob("day=*")]
        assert len(days) == 3 and all(len(files) <= 2 for files in days)


def test_stream_ring_buffer_equals_batch(spark, tmp_path):
    for stream in _arrive(spark, str(tmp_path), _thirds(spark)):
        got = ST.run_available(ST.last_durations(access_logs(stream), 10), f"{tmp_path}/run", "update", ("path",)).result
    want = ST.last_durations_batch(access_logs(read_table(spark, SF_SMALL, "events")), 10)
    cols = ["path", "buffered", "avg_ms", "max_ms", "newest_ts"]
    assert _as_set(got, cols) == _as_set(want, cols)


def test_stream_running_stats_with_deletes(spark, tmp_path):
    created = enrich(raw_logs(ST.events_stream(spark, SF_SMALL)))
    deleted = enrich(raw_logs(ST.events_stream(spark, SF_SMALL).filter(F.col("event_type") == "click")))
    got = ST.run_available(ST.running_stats(ST.change_feed(created, deleted)), str(tmp_path), "update", ("kind", "key")).result
    ev = read_table(spark, SF_SMALL, "events")
    kept = enrich(raw_logs(ev.filter(F.col("event_type") != "click")))
    want = {("by_severity", r.severity): r.n for r in S.severity_counts(kept).collect()}
    got_sev = {(r.kind, r.key): r.n for r in got.filter(F.col("kind") == "by_severity").filter(F.col("n") > 0).collect()}
    assert got_sev == want
    assert got.filter(F.col("kind") == "total").first().n == kept.count()


def test_live_tail_over_batches_with_deletes_before_and_after(spark, tmp_path):
    """A delete of the newest logs brings older ones back; one that comes before
    its log keeps it out."""
    parts = _thirds(spark)
    ids = [[r.event_id for r in p.orderBy(F.col("ts").desc()).limit(5).collect()] for p in parts]
    gone = [ids[2][:2], [], ids[2][2:] + ids[1]]   # two before their logs, the others after
    for i, stream in enumerate(_arrive(spark, str(tmp_path), parts)):
        spark.createDataFrame([(x,) for x in gone[i]], "id long").write.mode("append").parquet(f"{tmp_path}/gone")
        deletes = spark.readStream.schema("id long").parquet(f"{tmp_path}/gone")
        tail = ST.live_tail(enrich(raw_logs(stream)), deletes, f"{tmp_path}/run", 10)
        assert tail.count() == 10
    all_gone = {x for g in gone for x in g}
    batch = enrich(raw_logs(read_table(spark, SF_SMALL, "events"))).filter(~F.col("id").isin(*all_gone))
    want = [r.id for r in batch.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(10).collect()]
    assert [r.id for r in tail.orderBy(F.col("created_at").desc(), F.col("id").desc()).collect()] == want


def test_store_survives_replay_and_maintenance(spark, tmp_path):
    from logspark.operators import retention as H
    from logspark.sources import store

    parts, path = _thirds(spark), f"{tmp_path}/store"
    for stream in _arrive(spark, str(tmp_path), parts[:2]):
        ST.ingest_stream(raw_logs(stream), f"{tmp_path}/run", path)
    first = store.read_logs(spark, path).count()
    some = store.read_logs(spark, path).limit(7).select("id")
    assert H.delete_from_table(spark, path, some)["deleted"] == 7
    # the same micro-batch once more, as after a failure before its commit: nothing comes back
    store.append_once(enrich(raw_logs(parts[1])), path, "stream", 1)
    assert store.read_logs(spark, path).count() == first - 7
    # another checkpoint (a lost one) under the same writer finds its batches in the table
    for stream in _arrive(spark, f"{tmp_path}/again", parts[:1]):
        ST.ingest_stream(raw_logs(stream), f"{tmp_path}/run2", path)
    assert store.read_logs(spark, path).count() == first - 7


def test_undecodable_lines_reach_the_quarantine(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"title":"one","created_at":"2024-01-01T00:00:00"}\n{broken\n{"title":""}\n')
    ST.ingest_stream(ST.raw_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/run", f"{tmp_path}/store")
    assert [r.title for r in spark.read.parquet(f"{tmp_path}/store").collect()] == ["one"]
    rejected = {(r.reason, r.undecodable) for r in spark.read.parquet(f"{tmp_path}/run/rejected").collect()}
    assert rejected == {("title is required", None), (ST.UNDECODABLE, "{broken")}


def test_no_shared_folder_on_a_cluster_is_an_error(monkeypatch):
    from types import SimpleNamespace

    from logspark.session import checkpoint_dir

    context = SimpleNamespace(master="spark://host:7077", applicationId="a", getConf=lambda: {})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None)))


def test_time_helpers_ignore_session_zone(spark):
    from logspark.functions.formatting import epoch_micros, utc_instant, utc_wall_clock

    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("Asia/Kolkata", "America/New_York", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 2, 30, 0, 5),)], "t timestamp_ntz")
            r = df.select(epoch_micros("t").alias("us"), utc_wall_clock(utc_instant("t")).alias("back")).first()
            assert r.us == 1710037800000005 and r.back == dt.datetime(2024, 3, 10, 2, 30, 0, 5), tz
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
