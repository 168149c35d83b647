"""Structured Streaming operators.

Time model: ``created_at`` (``ts`` for access records) is the event time.
Watermarks need a TIMESTAMP column, so streams carry ``event_time`` =
``created_at`` cast from TIMESTAMP_NTZ.  Every stateful operator keeps
bounded state: counters per (window, key), at most ``n`` rows per key for
the ring buffer and the tail.

``run_available`` runs a stream to completion (``availableNow``) into an
upsert log and returns the final result as a batch DataFrame, so stream
results can be compared with batch results.  Every runner takes its folder
from the caller: a job that is restarted with the same folder, under any
application id, goes on where it stopped.

Watermarks are required arguments: they decide which late rows a window still
takes.  ``run_available`` reports how many rows entered, so what a windowed
count has not taken is known (``not_counted``).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from logspark.functions import normalize as N
from logspark.functions.analyze import escaped_json
from logspark.functions.formatting import trunc_ntz, utc_instant, utc_wall_clock
from logspark.operators.enrich import ingest_marked
from logspark.operators.query import event_columns
from logspark.operators.sketches import keep_sketches, read_sketches
from logspark.schema import LOGS, RAW_FLAT
from logspark.sources.store import append_once, assign_ids, drop_folders, epochs, exists, folders, hadoop, reserve_ids, spread

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

ERRORS = ("error", "critical")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State that grows with the records lies on disk, one store for each partition
#: of a join; all stores of an executor share a bounded cache.  A checkpoint that
#: was begun with another provider keeps it.
ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.join.stateFormatVersion": "3",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "400",
}


# ------------------------------------------------------------------ sources
def events_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None,
                  glob: str = "events.parquet") -> DataFrame:
    """The ``events`` table of a scale directory as a file stream; files are
    taken in the order of their times, ``max_files_per_trigger`` at a time.
    The rows of a micro-batch are spread over all cores, however few files or
    row groups it has: enriching a row costs far more than moving it."""
    reader = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return spread(reader.parquet(sf_dir))


CORRUPT = "undecodable"
UNDECODABLE = "record is not JSON of the expected form"


def raw_stream(spark: SparkSession, path: str, schema: T.StructType = RAW_FLAT, **options) -> DataFrame:
    """A10: flat raw records arriving as files of JSON lines.  A line that
    cannot be decoded arrives as a record whose text is in ``undecodable``;
    ``ingest_stream`` puts it into the quarantine."""
    with_text = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.readStream.schema(with_text).option("columnNameOfCorruptRecord", CORRUPT)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.json(path)


def with_event_time(df: DataFrame, col: str = "created_at") -> DataFrame:
    """Adds ``event_time`` (TIMESTAMP) for watermarks; windows over it align
    with wall-clock hours whatever the session time zone."""
    return df.withColumn("event_time", utc_instant(F.col(col)))


# ------------------------------------------------------------ change feed
def _created_events(created: DataFrame) -> DataFrame:
    return created.select(
        F.lit("log_created").alias("type"), F.col("id"),
        N.effective_severity().alias("severity"), F.col("source"), F.col("created_at"), F.col("title"),
        escaped_json(F.to_json(F.struct(*event_columns()))).alias("data"),
    )


def _deleted_events(deleted: DataFrame) -> DataFrame:
    has = set(deleted.columns)
    sev = N.effective_severity() if {"derived_severity", "severity"} <= has else F.lit(None).cast("string")
    src = F.col("source") if "source" in has else F.lit(None).cast("string")
    ts = F.col("created_at") if "created_at" in has else F.lit(None).cast("timestamp_ntz")
    return deleted.select(
        F.lit("log_deleted").alias("type"), F.col("id"), sev.alias("severity"), src.alias("source"),
        ts.alias("created_at"), F.lit(None).cast("string").alias("title"), F.to_json(F.struct(F.col("id"))).alias("data"),
    )


def change_feed(created: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """``log_created`` events (full event view as JSON in ``data``) and
    ``log_deleted`` events.  Deleted events carry the id and, when the
    deleted rows are given, their effective severity and source so that
    running counters can be decremented."""
    c = _created_events(created)
    return c if deleted is None else c.unionByName(_deleted_events(deleted))


def resolved_deletes(created: DataFrame, deletes: DataFrame, watermark: str, horizon: str) -> DataFrame:
    """The created record of every delete in ``deletes`` (id, deleted_at),
    whichever of the two arrives first: id, derived_severity, severity, source
    and created_at, as ``change_feed`` takes them for deleted rows.

    A stream-stream join: a delete is looked for among the logs created at
    most ``horizon`` before it, so state is dropped once the watermark is past
    that; ids deleted again meanwhile count once, and ids that were never
    created find nothing.
    """
    logs = with_event_time(created).withWatermark("event_time", watermark) \
        .select("id", "event_time", "derived_severity", "severity", "source", "created_at")
    gone = deletes.select(F.col("id").cast("bigint").alias("gone_id"), utc_instant(F.col("deleted_at")).alias("gone_time")) \
        .withWatermark("gone_time", watermark).dropDuplicatesWithinWatermark(["gone_id"])
    within = (F.col("id") == F.col("gone_id")) & (F.col("gone_time") >= F.col("event_time")) \
        & (F.col("gone_time") <= F.col("event_time") + F.expr(f"INTERVAL {horizon}"))
    return logs.join(gone, within).select("id", "derived_severity", "severity", "source", "created_at")


def feed_kafka_shape(feed: DataFrame) -> DataFrame:
    """(key, value) JSON records for a message-bus sink."""
    return feed.select(F.col("id").cast("string").alias("key"),
                       F.to_json(F.struct("type", "data")).alias("value"))


# --------------------------------------------------------- running counters
def running_stats(feed: DataFrame) -> DataFrame:
    """Running total, per effective severity and per source (NULL ->
    'unknown'); +1 per created, -1 per deleted event.  Output (kind, key, n)
    - a streaming aggregation whose state is one counter per key."""
    delta = F.when(F.col("type") == "log_created", F.lit(1)).when(F.col("type") == "log_deleted", F.lit(-1))
    keyed = feed.select(delta.alias("delta"), F.explode(F.array(
        F.struct(F.lit("total").alias("kind"), F.lit(None).cast("string").alias("key")),
        F.struct(F.lit("by_severity").alias("kind"), F.col("severity").alias("key")),
        F.struct(F.lit("by_source").alias("kind"), F.coalesce("source", F.lit("unknown")).alias("key")),
    )).alias("k")).filter(F.col("delta").isNotNull())
    return keyed.groupBy(F.col("k.kind").alias("kind"), F.col("k.key").alias("key")) \
        .agg(F.greatest(F.sum("delta"), F.lit(0)).cast("bigint").alias("n"))


# -------------------------------------------------------------- windows
ENTERED = "entered"


def _entering(df: DataFrame) -> DataFrame:
    """Counts the rows that enter, seen in the query's progress."""
    return df.observe(ENTERED, F.count(F.lit(1)).alias("rows"))


def hourly_counts(logs: DataFrame, watermark: str) -> DataFrame:
    """Per event-time hour, total and error counts (effective severity);
    rows later than the watermark are dropped."""
    s = _entering(with_event_time(logs)).withWatermark("event_time", watermark)
    eff = N.effective_severity()
    return s.groupBy(F.window("event_time", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(eff.isin(*ERRORS)).alias("errors")
    ).select(utc_wall_clock(F.col("w.start")).alias("hour"), "total", "errors")


#: Hourly panes that a 24-hour window is made of.
PANES = 24


def sliding_day_counts(panes: DataFrame) -> DataFrame:
    """Rows in every 24-hour window sliding by one hour, from the panes of
    ``hourly_counts``.  The stream keeps one count an hour; each pane enters
    its 24 windows here, where it is read."""
    start = F.explode(F.transform(F.sequence(F.lit(0), F.lit(PANES - 1)),
                                  lambda k: F.col("hour") - F.make_dt_interval(F.lit(0), k))).alias("window_start")
    return panes.select(start, "total").groupBy("window_start").agg(F.sum("total").alias("n")) \
        .select("window_start", (F.col("window_start") + F.expr(f"INTERVAL {PANES} HOURS")).alias("window_end"), "n")


def progress(access: DataFrame, watermark: str) -> DataFrame:
    """Per second - sent, errors (status >= 400) and approximate p95."""
    s = _entering(with_event_time(access, "ts")).withWatermark("event_time", watermark)
    return s.groupBy(F.window("event_time", "1 second").alias("w")).agg(
        F.count(F.lit(1)).alias("sent"),
        F.count_if(F.col("status") >= 400).alias("errors"),
        F.percentile_approx("duration_ms", 0.95, 1000).alias("p95"),
    ).select(utc_wall_clock(F.col("w.start")).alias("second"), "sent", "errors", "p95")


# ------------------------------------------------- per-path ring buffer
RING_OUTPUT = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("buffered", T.LongType()),
    T.StructField("avg_ms", T.DoubleType()),
    T.StructField("max_ms", T.LongType()),
    T.StructField("newest_ts", T.TimestampNTZType()),
])
RING_STATE = T.StructType([
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("id", T.LongType()),
    T.StructField("duration_ms", T.LongType()),
])


def _ring_processor(n: int):
    from pyspark.sql.streaming import StatefulProcessor

    class LastDurations(StatefulProcessor):
        """Keeps the newest ``n`` (ts, id, duration) per path in a ListState."""

        def init(self, handle) -> None:
            self.buf = handle.getListState("buf", RING_STATE)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            keep = None
            if self.buf.exists():
                keep = pd.DataFrame(list(self.buf.get()), columns=["ts", "id", "duration_ms"])
            for pdf in rows:            # fold chunk by chunk: memory stays ~ chunk + n
                chunk = pdf[["ts", "id", "duration_ms"]]
                both = chunk if keep is None else pd.concat([keep, chunk], ignore_index=True)
                keep = both.sort_values(["ts", "id"], ascending=False).head(n)
            self.buf.put([tuple(r) for r in keep.itertuples(index=False, name=None)])
            yield pd.DataFrame({
                "path": [key[0]],
                "buffered": [int(len(keep))],
                "avg_ms": [float(keep["duration_ms"].astype("float64").sum() / len(keep))],
                "max_ms": [int(keep["duration_ms"].max())],
                "newest_ts": [keep["ts"].max()],
            })

        def close(self) -> None:
            pass

    return LastDurations()


RING_INPUT = T.StructType([T.StructField("path", T.StringType())] + RING_STATE.fields)


def _partial_newest(n: int):
    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep = None
        for pdf in batches:
            both = pdf if keep is None else pd.concat([keep, pdf], ignore_index=True)
            keep = both.sort_values(["ts", "id"], ascending=False).groupby("path", sort=False).head(n)
        if keep is not None:
            yield keep[["path", "ts", "id", "duration_ms"]]
    return reduce


def last_durations(access: DataFrame, n: int = 100) -> DataFrame:
    """Per path, a ring buffer of the newest ``n`` durations kept as
    state (never more than ``n`` rows per path, however hot the path);
    emits (path, buffered, avg_ms, max_ms, newest_ts) on every update.

    Each input partition is first cut to its newest ``n`` rows per path
    (a stateless partial top-n), so a hot path sends at most ``n`` rows per
    task - not a third of the micro-batch - into the keyed state.
    """
    spark = access.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    partial = access.select("path", "ts", "id", "duration_ms").mapInPandas(_partial_newest(n), RING_INPUT)
    return partial.groupBy("path").transformWithStateInPandas(
        statefulProcessor=_ring_processor(n), outputStructType=RING_OUTPUT,
        outputMode="Update", timeMode="None")


def last_durations_batch(access: DataFrame, n: int = 100) -> DataFrame:
    """Batch twin of ``last_durations`` (G1 + aggregate)."""
    from logspark.operators.metrics import last_n_per_key

    last = last_n_per_key(access, "path", n)
    return last.groupBy("path").agg(
        F.count(F.lit(1)).alias("buffered"),
        (F.sum(F.col("duration_ms").cast("double")) / F.count(F.lit(1))).alias("avg_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.max("ts").alias("newest_ts"),
    )


def keep_latency(access: DataFrame, base: str) -> DataFrame:
    """Everything available now goes into latency sketches by
    path and hour below ``base``, one folder a micro-batch (a replay writes it
    again); returns all that are kept."""
    def sink(batch: DataFrame, epoch: int) -> None:
        keep_sketches(batch, f"{base}/sketches", f"s-{epoch}")

    _run(access, base, "append", sink)
    return read_sketches(access.sparkSession, f"{base}/sketches")


# ------------------------------------------------------------- runners
def _run(df: DataFrame, base: str, output_mode: str, sink, conf: dict[str, str] | None = None) -> StreamingQuery:
    """Everything available now through ``sink(batch, epoch)``; ``conf`` holds
    for this query alone, which takes its settings when it starts."""
    session = df.sparkSession.conf
    before = {k: session.get(k, None) for k in conf or {}}
    for k, v in (conf or {}).items():
        session.set(k, v)
    try:
        q = (df.writeStream.outputMode(output_mode).foreachBatch(sink)
             .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    finally:
        for k, v in before.items():
            session.unset(k) if v is None else session.set(k, v)
    q.awaitTermination()
    return q


def _entered(q: StreamingQuery) -> int:
    return sum(p.observedMetrics[ENTERED]["rows"] or 0 for p in q.recentProgress if ENTERED in p.observedMetrics)


def not_counted(result: DataFrame, count: str, entered: int, windows: int = 1) -> int:
    """Rows (times the ``windows`` that each belongs to) that entered but were
    too late for their windows."""
    return entered * windows - (result.agg(F.sum(count)).first()[0] or 0)


class Available(NamedTuple):
    result: DataFrame
    entered: int


def run_available(df: DataFrame, base: str, output_mode: str = "append", keys: tuple[str, ...] = ()) -> Available:
    """Run a streaming DataFrame over everything available now.

    Each micro-batch is written to its own batch-id folder of an upsert log
    in ``base`` (a replayed batch overwrites its folder, so the log is
    exactly-once); the result keeps, per ``keys``, the row of the newest batch
    (update / complete modes) or every row (append mode with no keys).  With
    the result comes the number of rows that this run read into a windowed
    count.
    """
    spark = df.sparkSession
    out = f"{base}/log"

    def sink(batch: DataFrame, epoch: int) -> None:
        # one folder per batch id, overwritten on replay: idempotent
        batch.write.mode("overwrite").parquet(f"{out}/stream_batch={epoch}")

    q = _run(df, base, output_mode, sink)
    if not exists(spark, out):  # no batch so far
        return Available(spark.createDataFrame([], df.schema), _entered(q))
    result = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("stream_batch", T.LongType())])).parquet(out)
    if keys:
        w = Window.partitionBy(*keys).orderBy(F.col("stream_batch").desc())
        result = result.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") == 1).drop("_rank")
    return Available(result.drop("stream_batch"), _entered(q))


TAIL = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("severity", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("day", T.DateType()),
])


def _days(spark: SparkSession, path: str) -> list[str]:
    """Days that the batches below ``path`` hold, newest first."""
    found = {d for e in folders(spark, path) for d in folders(spark, e, "day=")}
    return sorted((d for d in found if not d.startswith("__")), reverse=True)


def tail_of(spark: SparkSession, base: str, n: int = 100) -> DataFrame:
    """The newest ``n`` created logs that no delete names, from the tables of
    ``live_tail``.  Days are read from the newest on, twice as many each time,
    until n rows are found."""
    created, gone = f"{base}/created", f"{base}/deleted"
    if not exists(spark, created):
        return spark.createDataFrame([], TAIL).drop("day")
    rows = spark.read.schema(TAIL).parquet(created).select(*TAIL.names)
    if exists(spark, gone):
        rows = rows.join(spark.read.schema("id long").parquet(gone).select("id").distinct(), "id", "left_anti")
    days = _days(spark, created)
    take = 1
    while True:
        first = days[min(take, len(days)) - 1] if days else None
        top = rows.filter(F.col("day") >= F.lit(first)) if take < len(days) else rows
        top = top.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n).drop("day")
        if take >= len(days) or top.count() == n:
            return top
        take *= 2


def live_tail(created: DataFrame, deleted_ids: DataFrame | None, base: str, n: int = 100) -> DataFrame:
    """The newest ``n`` logs, deletes removing their id - whether they come
    after, with or before the log they delete.

    Each micro-batch adds what a tail shows of its logs to a table by day, and
    the ids it deletes to a table of tombstones, both in folders of its batch
    id (overwritten on replay).  Nothing is thrown away, so a delete brings
    the next older log back into the tail.
    """
    spark = created.sparkSession
    feed = change_feed(created, deleted_ids)

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        adds = batch.filter(F.col("type") == "log_created").select(
            "id", "title", "severity", "source", "created_at", F.to_date("created_at").alias("day"))
        adds.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{base}/created/epoch={epoch}")
        batch.filter(F.col("type") == "log_deleted").select("id") \
            .write.mode("overwrite").parquet(f"{base}/deleted/epoch={epoch}")
        batch.unpersist()

    _run(feed, base, "append", sink)
    return tail_of(spark, base, n)


SNAPSHOT = "type string, kind string, key string, n long"


def stats_snapshots(logs: DataFrame, base: str) -> DataFrame:
    """One ``stats_updated`` snapshot per micro-batch - the F5 bundle of all
    rows so far, with as_of = the newest created_at so far (column ``batch``).

    Counters are carried from snapshot to snapshot; the last 24 hours are
    counted from a table of the rows' times by day, of which the newest two
    days are read.
    """
    spark = logs.sparkSession
    out, times = f"{base}/snapshots", f"{base}/times"

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        batch.select("created_at", F.to_date("created_at").alias("day")).filter("day is not null").hint("rebalance", "day") \
            .write.mode("overwrite").partitionBy("day").parquet(f"{times}/epoch={epoch}")
        keyed = batch.select(F.explode(F.array(
            F.struct(F.lit("total").alias("kind"), F.lit(None).cast("string").alias("key")),
            F.struct(F.lit("by_severity").alias("kind"), N.effective_severity().alias("key")),
            F.struct(F.lit("by_source").alias("kind"), F.coalesce("source", F.lit("unknown")).alias("key")))).alias("k"),
            F.lit(1).cast("bigint").alias("n"))
        now = keyed.select("k.kind", "k.key", "n")
        before = [e for e in epochs(spark, out) if e < epoch]
        if before:
            now = now.union(spark.read.schema(SNAPSHOT).parquet(f"{out}/batch={before[-1]}")
                            .filter(F.col("kind") != "last_24_hours").select("kind", "key", "n"))
        counters = now.groupBy("kind", "key").agg(F.sum("n").alias("n"))
        days = _days(spark, times)
        seen = spark.read.schema("created_at timestamp_ntz, day date").parquet(times) if days else None
        recent = None
        if seen is not None:
            newest = seen.filter(F.col("day") == F.lit(days[0])).agg(F.max("created_at").alias("m")).first().m
            recent = seen.filter((F.col("day") >= F.lit((newest - _dt.timedelta(days=1)).date()))
                                 & (F.col("created_at") >= F.lit(newest) - F.expr("INTERVAL 24 HOURS"))).count()
        last = spark.createDataFrame([("last_24_hours", None, recent or 0)], "kind string, key string, n long")
        counters.union(last).select(F.lit("stats_updated").alias("type"), "kind", "key", "n") \
            .write.mode("overwrite").parquet(f"{out}/batch={epoch}")
        batch.unpersist()

    _run(logs, base, "append", sink)
    return spark.read.schema(T.StructType.fromDDL(SNAPSHOT).add("batch", T.LongType())).parquet(out)


def _kept_stream(df: DataFrame, base: str) -> DataFrame:
    """What is available now, written once in folders of the micro-batch
    (overwritten on replay) and read back as a stream: for queries that use it
    more than once."""
    spark, rows = df.sparkSession, f"{base}/rows"

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/epoch={epoch}")

    _run(df, base, "append", sink)
    fs, make = hadoop(spark, rows)
    fs.mkdirs(make(rows))       # no batch so far
    return spark.readStream.schema(T.StructType([*df.schema.fields, T.StructField("epoch", T.LongType())])).parquet(rows).select(*df.columns)


LIVE = "kind string, key string, n long, rate double"
_RING = "kind string, key string, at timestamp_ntz, n long"


def live_stats(created: DataFrame, deletes: DataFrame, base: str, watermark: str, horizon: str, hours: int = 24) -> DataFrame:
    """Running total, counts by effective severity and by source, ``recent``
    (logs of the last ``hours`` before the newest one) and the error rate, after
    everything available now; deletes hold an id and their time alone.

    Created records and resolved deletes are signed rows.  Every micro-batch
    adds its rows to the counters and to a ring of hourly slots that the state
    before it held, and writes the new state under its batch id: counters, at
    most ``hours`` + 1 slots up to the newest log, and the newest time.  A slot
    that falls out of the ring takes its rows out of ``recent``.  The slot that
    the window begins in is counted row by row, from a table of times that is
    kept by hour for as long as the ring reaches.  Rows that arrive after they
    have left the window only enter the counters.  A replayed batch writes its
    own folders again.
    """
    spark = created.sparkSession
    state, times, kept = f"{base}/live", f"{base}/times", f"{base}/kept"
    if exists(spark, f"{base}/checkpoint") and not exists(spark, kept):
        raise RuntimeError(f"{base} was begun by a version that read created records twice; begin in a new folder")
    logs = _kept_stream(created.select("id", "derived_severity", "severity", "source", "created_at"), kept)
    feed = logs.withColumn("n", F.lit(1)).unionByName(
        resolved_deletes(logs, deletes, watermark, horizon).withColumn("n", F.lit(-1)))

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        hour = trunc_ntz("created_at", "hour")
        empty = F.lit(None).cast("timestamp_ntz")
        now = batch.select(F.explode(F.array(*(
            F.struct(F.lit(kind).alias("kind"), key.alias("key"), at.alias("at")) for kind, key, at in (
                ("total", F.lit(None).cast("string"), empty), ("by_severity", N.effective_severity(), empty),
                ("by_source", F.coalesce("source", F.lit("unknown")), empty), ("slot", F.lit(None).cast("string"), hour))))).alias("k"), "n") \
            .select("k.kind", "k.key", "k.at", F.col("n").cast("long").alias("n"))
        newest = batch.agg(F.max(F.when(F.col("n") > 0, F.col("created_at"))).alias("m")).first().m
        before = f"{state}/epoch={epoch - 1}"
        if epoch and exists(spark, before):
            held = spark.read.schema(_RING).parquet(before)
            last = held.filter("kind = 'newest'").select("at").first().at
            newest = max(filter(None, (newest, last)), default=None)
            now = now.union(held.filter("kind != 'newest'"))
        counted = now.groupBy("kind", "key", "at").agg(F.sum("n").alias("n"))
        if newest is not None:
            edge = newest - _dt.timedelta(hours=hours)
            first = edge.replace(minute=0, second=0, microsecond=0)
            counted = counted.filter((F.col("kind") != "slot") | (F.col("at") >= F.lit(first)))
            batch.filter(F.col("created_at") >= F.lit(edge)).groupBy("created_at", F.translate(F.substring(F.col("created_at").cast("string"), 1, 13), "- ", "").alias("hour")) \
                .agg(F.sum("n").alias("n")).withColumn("epoch", F.lit(epoch)).hint("rebalance", "hour") \
                .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour", "epoch").parquet(times)
            drop_folders(spark, [f"{times}/hour={h}" for h in folders(spark, times, "hour=") if h < first.strftime("%Y%m%d%H")])
        mark = spark.createDataFrame([("newest", None, newest, None)], _RING)
        counted.union(mark).write.mode("overwrite").parquet(f"{state}/epoch={epoch}")
        drop_folders(spark, [f"{state}/epoch={epoch - 2}"])     # what a replay of the next batch cannot need
        batch.unpersist()

    _run(feed, base, "append", sink, ON_DISK)
    drop_folders(spark, [f"{kept}/rows/epoch={e}" for e in epochs(spark, f"{kept}/rows", "epoch=")[:-1]])     # read and committed
    return live_of(spark, base, hours)


def live_of(spark: SparkSession, base: str, hours: int = 24) -> DataFrame:
    """The newest state that ``live_stats`` has written: (kind, key, n, rate)."""
    done = epochs(spark, f"{base}/live", "epoch=")
    if not done:
        return spark.createDataFrame([], LIVE)
    held = spark.read.schema(_RING).parquet(f"{base}/live/epoch={done[-1]}")
    newest = held.filter("kind = 'newest'").select("at").first().at
    recent = held.limit(0).agg(F.sum("n").alias("n"))
    if newest is not None:
        edge = newest - _dt.timedelta(hours=hours)
        first = edge.replace(minute=0, second=0, microsecond=0)
        recent = held.filter((F.col("kind") == "slot") & (F.col("at") > F.lit(first))).select("n")
        at = f"{base}/times/hour={first:%Y%m%d%H}"
        if exists(spark, at):
            recent = recent.union(spark.read.schema("created_at timestamp_ntz, n long").parquet(at)
                                  .filter(F.col("created_at") >= F.lit(edge)).select("n"))
    none, floor = F.lit(None), F.greatest(F.col("n"), F.lit(0)).cast("long")
    counters = held.filter(F.col("kind").isin("total", "by_severity", "by_source")).select("kind", "key", floor.alias("n"))
    errors = F.coalesce(F.sum(F.when((F.col("kind") == "by_severity") & F.col("key").isin(*ERRORS), F.col("n"))), F.lit(0))
    whole = F.max(F.when(F.col("kind") == "total", F.col("n")))
    rate = counters.agg(F.when(whole > 0, errors.cast("double") / whole.cast("double") * 100.0).otherwise(F.lit(0.0)).alias("rate"))
    return counters.select("kind", "key", "n", none.cast("double").alias("rate")) \
        .unionByName(recent.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
                     .select(F.lit("recent").alias("kind"), none.cast("string").alias("key"), floor.alias("n"), none.cast("double").alias("rate"))) \
        .unionByName(rate.select(F.lit("error_rate").alias("kind"), none.cast("string").alias("key"), none.cast("long").alias("n"), "rate"))


def ingest_stream(raw: DataFrame, base: str, store_path: str, writer: str = "stream", number: bool = False) -> None:
    """A10 + I5: everything available now goes through the enrichment once;
    accepted records are appended to the store, rejected ones (with the reason)
    to ``base``/rejected, and the ``log_created`` events of what was stored to
    ``base``/feed, each in folders of the micro-batch.

    The store is the batch table of ``sources.store``: a replayed micro-batch
    is appended once (``append_once``), and batch appends, deletes and
    retention work on the same table.  ``writer`` names the stream in it.

    With ``number`` the accepted records of each micro-batch get dense ids in
    order of ``created_at`` (A8), whatever ids they bring: the batch reserves
    its block of ids first (``reserve_ids``), so a replay numbers as before.
    """
    spark = raw.sparkSession
    if CORRUPT not in raw.columns:
        raw = raw.withColumn(CORRUPT, F.lit(None).cast("string"))

    def sink(batch: DataFrame, epoch: int) -> None:
        bad_lines = batch.filter(F.col(CORRUPT).isNotNull())
        marked = ingest_marked(batch.filter(F.col(CORRUPT).isNull())).persist()
        accepted = marked.filter(F.col("reason").isNull())
        if number:
            after = reserve_ids(spark, store_path, f"{base}/ids", epoch, accepted.count())
            accepted = assign_ids(accepted.drop("id", "reason"), after, at=f"{base}/numbered")
        name = append_once(accepted, store_path, writer, epoch)
        rejected = marked.filter(F.col("reason").isNotNull()).select("id", "created_at", "title", "reason") \
            .withColumn(CORRUPT, F.lit(None).cast("string"))
        lost = bad_lines.select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("timestamp_ntz").alias("created_at"),
                                F.col("title"), F.lit(UNDECODABLE).alias("reason"), CORRUPT)
        rejected.union(lost).write.mode("overwrite").parquet(f"{base}/rejected/epoch={epoch}")
        mine = spark.read.schema(STORED).parquet(store_path) \
            .filter(F.col("batch") == name)
        if not exists(spark, f"{base}/feed/epoch={epoch}/_SUCCESS"):
            change_feed(mine).write.mode("overwrite").parquet(f"{base}/feed/epoch={epoch}")
        marked.unpersist()

    _run(raw, base, "append", sink)


STORED = T.StructType([*LOGS.fields, T.StructField("batch", T.StringType())])
