"""Ids by micro-batch, latency sketches, heavy hitters."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from logspark.operators import metrics as M
from logspark.operators import sketches as K
from logspark.operators import stats as S
from logspark.operators.enrich import enrich
from logspark.sources import heavy as HV
from logspark.sources import store
from logspark.sources.adapters import access_logs, raw_logs, read_table
from logspark.streaming import stream as ST
from tests.conftest import SF_SMALL
from tests.test_io_plans import _plan
from tests.test_stream import _arrive, _thirds


def _ids(spark, path):
    return {(r.created_at, r.title): r.id for r in store.read_logs(spark, path).collect()}


def test_streamed_ids_are_dense_and_survive_a_replay(spark, tmp_path):
    parts, path, run = _thirds(spark), f"{tmp_path}/store", f"{tmp_path}/run"
    for i, stream in enumerate(_arrive(spark, str(tmp_path), parts[:2])):
        raw = raw_logs(stream).drop("id")
        ST.ingest_stream(raw, run, path, number=True)
        if i == 0:
            first = _ids(spark, path)
    both = _ids(spark, path)
    assert sorted(both.values()) == list(range(1, len(both) + 1))
    assert first.items() <= both.items()
    # the second micro-batch again, as after a failure before it was committed
    for gone in (f"{run}/checkpoint/commits/1", f"{run}/checkpoint/commits/.1.crc", f"{path}/_committed/s-stream-1"):
        if os.path.exists(gone):
            os.remove(gone)
    ST.ingest_stream(raw, run, path, number=True)
    assert _ids(spark, path) == both


def test_id_blocks(spark, tmp_path):
    path, at = f"{tmp_path}/store", f"{tmp_path}/ids"
    logs = enrich(raw_logs(read_table(spark, SF_SMALL, "events"))).limit(10)
    assert store.reserve_ids(spark, path, f"{tmp_path}/other", 0, 3) == 0      # no table yet
    store.append(logs.withColumn("id", F.monotonically_increasing_id() % 10 + 1), path)
    top = store.read_logs(spark, path).agg(F.max("id")).first()[0]
    assert store.reserve_ids(spark, path, at, 0, 4) == top
    assert store.reserve_ids(spark, path, at, 0, 4) == top                     # a replay
    assert store.reserve_ids(spark, path, at, 1, 0) == top + 4
    assert store.reserve_ids(spark, path, at, 2, 7) == top + 4                 # an empty batch took none
    assert store.reserve_ids(spark, path, at, 3, 1) == top + 11


START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def records(spark):
    """One path with a third of the records and a skewed distribution; some
    records lack a duration, a path or a time."""
    return spark.range(60_000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("/hot")).when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(F.concat(F.lit("/p"), F.col("id") % 7)).alias("path"),
        F.when(F.col("id") % 11 == 0, F.lit(500)).otherwise(F.lit(200)).alias("status"),
        F.when(F.col("id") % 97 == 0, F.lit(None)).otherwise(F.pmod(F.xxhash64("id"), 100) * F.pmod(F.xxhash64("id", F.lit(1)), 1000)).cast("int").alias("duration_ms"),
        F.when(F.col("id") % 1001 != 2, F.lit(str(START)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id") * 7 + 0.5)).alias("ts"))


def _check(values, got, pcts=M.DEFAULT_PERCENTILES):
    values = sorted(values)
    assert got.sent == len(values) and got["max"] == values[-1]
    for p in pcts:
        v, n = got[f"p{p}"], len(values)
        assert sum(x < v for x in values) <= n * (p / 100 + 4 * K.RANK_ERROR)
        assert sum(x <= v for x in values) >= n * (p / 100 - 4 * K.RANK_ERROR)


def test_merged_sketches_keep_the_rank_error(spark, records, tmp_path):
    path = f"{tmp_path}/sketches"
    for b in range(3):
        K.keep_sketches(records.filter(F.col("id") % 3 == b), path, str(b))
    K.keep_sketches(records.filter(F.col("id") % 3 == 1), path, "1")            # a replay
    kept = K.read_sketches(spark, path)
    rows = records.filter("duration_ms is not null").collect()
    by_path = {r.path: r for r in K.merged(kept, ("path",)).collect()}
    assert set(by_path) == {r.path for r in rows}
    for name, got in by_path.items():
        _check([r.duration_ms for r in rows if r.path == name], got)
        assert got.failed == sum(r.status >= 400 for r in rows if r.path == name)
    one = K.merged(kept).collect()
    assert len(one) == 1
    _check([r.duration_ms for r in rows], one[0])
    assert kept.count() < len(rows) / 8


def test_spans_read_whole_hours_from_sketches_and_the_rest_from_records(spark, records, tmp_path):
    path, table = f"{tmp_path}/sketches", f"{tmp_path}/records"
    K.keep_sketches(records, path, "all")
    records.write.parquet(table)
    acc, kept = spark.read.parquet(table), K.read_sketches(spark, path)
    rows = [r for r in records.collect() if r.duration_ms is not None and r.ts is not None]
    for since, until in (("2024-01-01 05:10:00", "2024-01-03 07:20:30.25"), ("2024-01-02 00:00:00", "2024-01-02 06:00:00"),
                         ("2024-01-02 01:10:00", "2024-01-02 01:40:00"), ("2024-01-02 01:50:00", "2024-01-02 02:10:00")):
        lo, hi = dt.datetime.fromisoformat(since), dt.datetime.fromisoformat(until)
        _check([r.duration_ms for r in rows if lo <= r.ts < hi], K.merged(K.spanning(kept, acc, since, until)).first())
    plan = _plan(K.spanning(kept, acc, "2024-01-02 01:10:00", "2024-01-03 01:40:00"))
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(ts" in plan
    none = K.merged(K.spanning(kept, acc, "2025-01-01 00:30:00", "2025-01-02 00:10:00")).first()
    assert (none.sent, none.failed, none.p50, none["max"], none.rate_per_sec) == (0, 0, None, None, 0.0)
    assert K.merged(K.read_sketches(spark, f"{tmp_path}/nothing")).first().sent == 0
    assert K.merged(K.read_sketches(spark, f"{tmp_path}/nothing"), ("path",)).count() == 0


def test_streamed_sketches_equal_batch_counts(spark, tmp_path):
    parts = _thirds(spark)
    for stream in _arrive(spark, str(tmp_path), parts):
        kept = ST.keep_latency(access_logs(stream), f"{tmp_path}/run")
    acc = access_logs(read_table(spark, SF_SMALL, "events"))
    want = {r.path: (r.n, r["max"]) for r in M.latency_report(acc).collect()}
    assert {r.path: (r.sent, r["max"]) for r in K.merged(kept, ("path",)).collect()} == want


def _table(spark, path, source):
    """Logs whose (derived) source is an expression of their number."""
    base = enrich(raw_logs(read_table(spark, SF_SMALL, "events"))).limit(1)
    logs = base.drop("id").crossJoin(spark.range(30_000)).withColumn("derived_source", F.lit(None).cast("string")).withColumn("source", source)
    store.append(logs.filter("id < 9000"), path)
    store.append(logs.filter("id >= 9000"), path)
    return path


def _top(df):
    return [(r.source, r.n) for r in df.collect()]


def test_top_sources_from_states_with_many_sources(spark, tmp_path, monkeypatch):
    """More sources than a state tracks, a few of them heavy: the survivors are
    counted exactly, nothing else is."""
    few = F.when(F.col("id") % 2 == 0, F.concat(F.lit("heavy-"), F.floor(F.sqrt(F.col("id") % 100)))) \
        .when(F.col("id") % 9 == 1, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("id")))
    path = _table(spark, f"{tmp_path}/logs", few)
    want = _top(S.top_sources(store.read_logs(spark, path), 9))
    monkeypatch.setattr(HV.S, "top_sources", lambda *a: pytest.fail("every source was counted"))
    assert _top(HV.top_sources(spark, path, 9)) == want
    found, n = HV.candidates(spark, path)
    assert n == 30_000 and len(found) <= HV.TRACKED
    exact = dict(want)
    for r in HV.heavy_sources(spark, path).filter(F.col("source").isin(list(exact))).collect():
        assert r.at_least <= exact[r.source] <= r.at_most
    files = HV.read(spark, path, HV.HEAVY).inputFiles()
    assert files and all("/_side/heavy_sources/" in f for f in files)
    assert glob.glob(f"{path}/_side/heavy_sources/*")


def test_top_sources_when_no_source_is_heavy(spark, tmp_path):
    path = _table(spark, f"{tmp_path}/logs", F.concat(F.lit("s"), F.col("id") % 14_000))
    assert _top(HV.top_sources(spark, path)) == _top(S.top_sources(store.read_logs(spark, path)))


def test_top_sources_of_nothing(spark, tmp_path):
    path = f"{tmp_path}/logs"
    store.append(enrich(raw_logs(read_table(spark, SF_SMALL, "events"))).limit(0), path)
    assert _top(HV.top_sources(spark, path)) == []
    assert HV.heavy_sources(spark, path).count() == 0
