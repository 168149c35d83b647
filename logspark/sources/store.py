"""Stored log table: scan, id assignment, append.

The table is Parquet partitioned by ``log_date`` and, inside a day, by the
batch that wrote the rows.  Batch and streaming writers and the maintenance
in ``operators.retention`` all work on this one layout: a writer only adds
folders of its own, maintenance replaces whole folders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logspark.functions.analyze import escaped_json
from logspark.functions.rules import DEFAULT_RULES, Rules
from logspark.operators.enrich import enrich
from logspark.schema import LOG_COLUMNS, LOGS
from logspark.session import checkpoint_dir, staged


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Scan with the fixed schema (no inference); Catalyst prunes
    columns and ``log_date`` partitions."""
    return spark.read.schema(LOGS).parquet(path).select(*LOG_COLUMNS)


def tolerant(logs: DataFrame) -> DataFrame:
    """A stored body that does not parse as a JSON object reads as {}."""
    v = F.try_parse_json("body")
    ok = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return logs.withColumn("body", F.when(ok, escaped_json(F.to_json(v))).otherwise(F.lit("{}")))


def assign_ids(df: DataFrame, start_after: int = 0, order=("created_at",), at: str | None = None) -> DataFrame:
    """Dense increasing ids start_after+1, start_after+2, ... in ``order``;
    ties are broken by a hash of the whole row, so rows that still tie are
    equal and any order of them is the same.

    The rows are range-partitioned and written once with their range number.
    Counts and rows are then read from that one table: a second evaluation of
    the range split could sample other bounds and number rows twice or not at
    all.  What is gathered is one count per range.  ``at`` names the folder of
    that table for callers that remove it afterwards.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    tie = F.xxhash64(*[F.col(c) for c in df.columns])
    ranged = staged(df.withColumn("_tie", tie).repartitionByRange(*cols, "_tie")
                    .withColumn("_range", F.spark_partition_id()), "ids", at)
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_range", before.alias("_before"))  # one row per range of the shuffle
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*cols, "_tie"))
    return ranged.withColumn("_place", place).join(F.broadcast(offsets), "_range") \
        .withColumn("id", (F.lit(start_after) + F.col("_before") + F.col("_place")).cast("bigint")) \
        .drop("_range", "_tie", "_place", "_before")


def reserve_ids(spark: SparkSession, path: str, at: str, epoch: int, n: int) -> int:
    """A8 for micro-batches: the id after which batch ``epoch`` of ``n`` rows
    numbers its rows.

    The block (after, n) is written to ``at`` before any row is, so a repeated
    batch finds its own block and gives the same ids.  A new block goes on
    where the one of the batch before ends - ids of deleted rows are not given
    again - and the first one where the table ends.  One writer at a time
    numbers the rows of a table.
    """
    def block(e):
        here = f"{at}/epoch={e}"
        return spark.read.schema("after long, n long").parquet(here).first() if exists(spark, f"{here}/_SUCCESS") else None

    mine = block(epoch)
    if mine is None:
        last = block(epoch - 1)
        after = last.after + last.n if last else 0
        if last is None and exists(spark, path):
            after = max(0, read_logs(spark, path).agg(F.max("id")).first()[0] or 0)
        spark.createDataFrame([(after, n)], "after long, n long").write.mode("overwrite").parquet(f"{at}/epoch={epoch}")
        drop_folders(spark, [f"{at}/epoch={epoch - 2}"])    # what a replay of the next batch cannot need
        return after
    return mine.after


def hadoop(spark: SparkSession, path: str):
    """(file system, Path class) that hold ``path``."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def exists(spark: SparkSession, path: str) -> bool:
    fs, make = hadoop(spark, path)
    return fs.exists(make(path))


def folders(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    """Sub-folders of ``path`` whose name starts with ``prefix``: their names
    after the prefix, or whole paths without one."""
    fs, make = hadoop(spark, path)
    if not fs.exists(make(path)):
        return []
    found = [st.getPath() for st in fs.listStatus(make(path)) if st.isDirectory() and not st.getPath().getName().startswith("_")]
    return [f.getName()[len(prefix):] for f in found if f.getName().startswith(prefix)] if prefix else [f.toString() for f in found]


def drop_folders(spark: SparkSession, paths: list[str]) -> None:
    """Remove folders that nothing reads any more."""
    for path in paths:
        fs, make = hadoop(spark, path)
        if fs.exists(make(path)):
            fs.delete(make(path), True)


def epochs(spark: SparkSession, path: str, prefix: str = "batch=") -> list[int]:
    """Batch ids with a completed folder below ``path``, in order."""
    return sorted(int(e) for e in folders(spark, path, prefix) if exists(spark, f"{path}/{prefix}{e}/_SUCCESS"))


#: Rows after which a task starts a new file: what a search or lookup skips or reads.
FILE_ROWS = 1_000_000


def _write(logs: DataFrame, path: str, batch: str, mode: str) -> None:
    """Rows of one batch, rebalanced by day: a day's rows meet in few files,
    and adaptive execution splits a heavy day.  Files are sorted by id and hold
    Parquet's bloom filter of their ids, so a lookup skips the others."""
    (logs.select(*LOG_COLUMNS).hint("rebalance", "log_date").sortWithinPartitions("log_date", "id")
     .withColumn("batch", F.lit(batch)).write.mode(mode)
     .option("maxRecordsPerFile", FILE_ROWS).option("parquet.bloom.filter.enabled#id", "true")
     .option("parquet.bloom.filter.adaptive.enabled", "true")
     .option("partitionOverwriteMode", "dynamic").partitionBy("log_date", "batch").parquet(path))


def append(logs: DataFrame, path: str, batch: str | None = None) -> None:
    """Append enriched records.  The table is partitioned by log_date and,
    inside a day, by the batch that wrote it."""
    finish_swaps(logs.sparkSession, path)
    _write(logs, path, batch or f"b-{uuid.uuid4().hex}", "append")


def append_once(logs: DataFrame, path: str, writer: str, epoch: int) -> str:
    """A10: append a micro-batch; written again after a failure it replaces its
    own folders, and once it is committed a replay leaves the table alone -
    also when its rows have been deleted or compacted since."""
    spark = logs.sparkSession
    finish_swaps(spark, path)
    fs, make = hadoop(spark, path)
    batch = f"s-{writer}-{epoch}"
    done = make(f"{path}/_committed/{batch}")
    if not fs.exists(done):
        _write(logs, path, batch, "overwrite")
        fs.create(done, True).close()
    return batch


def replace_days(spark: SparkSession, path: str, kept: DataFrame, days: list) -> None:
    """Put ``kept`` (rows of ``days`` read from this table) in the place of
    what those days hold now.  The new rows are written aside; then a list of
    the folders to drop marks the swap as ready, and ``finish_swaps`` carries
    it out.  A failure before the mark changes nothing; after it, the next
    write finishes the swap.  Folders that other batches add meanwhile stay.
    One maintenance job at a time."""
    fs, make = hadoop(spark, path)
    old = [st.getPath().toString() for d in days if fs.exists(make(f"{path}/log_date={d}"))
           for st in fs.listStatus(make(f"{path}/log_date={d}")) if st.isDirectory()]
    aside = f"{path}/_swap-{uuid.uuid4().hex}"
    _write(kept, f"{aside}/data", f"m-{uuid.uuid4().hex}", "append")
    out = fs.create(make(f"{aside}/_writing"), True)
    out.write(bytearray("\n".join(old).encode()))
    out.close()
    fs.rename(make(f"{aside}/_writing"), make(f"{aside}/_ready"))
    finish_swaps(spark, path)


def finish_swaps(spark: SparkSession, path: str) -> None:
    """Carry out the swaps that are marked as ready; each step can be repeated."""
    fs, make = hadoop(spark, path)
    if not fs.exists(make(path)):
        return
    for st in fs.listStatus(make(path)):
        aside = st.getPath()
        ready = make(aside, "_ready")
        if not aside.getName().startswith("_swap-") or not fs.exists(ready):
            continue
        stream = fs.open(ready)
        old = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        stream.close()
        for folder in filter(None, old.split("\n")):
            fs.delete(make(folder), True)
            if not fs.listStatus(make(folder).getParent()):
                fs.delete(make(folder).getParent(), True)
        data = make(aside, "data")
        for day in fs.listStatus(data) if fs.exists(data) else []:
            if not day.isDirectory():
                continue
            for batch in fs.listStatus(day.getPath()):
                target = make(make(path, day.getPath().getName()), batch.getPath().getName())
                fs.mkdirs(target.getParent())
                if not fs.exists(target):
                    fs.rename(batch.getPath(), target)
        fs.delete(aside, True)


def max_id(spark: SparkSession, path: str) -> int:
    """Largest stored id (0 for a table that does not exist or is empty); any
    other failure to read is raised."""
    if not exists(spark, path):
        return 0
    row = read_logs(spark, path).agg(F.max("id").alias("m")).first()
    return int(row.m) if row and row.m is not None else 0


_WRITTEN: dict[tuple, tuple[str, StructType]] = {}


def inputs_of(df: DataFrame) -> tuple:
    """What a frame is made from: its plan, its files and their times."""
    spark = df.sparkSession
    files = []
    for f in sorted(df.inputFiles()):
        fs, make = hadoop(spark, f)
        st = fs.getFileStatus(make(f))
        files.append((f, st.getModificationTime(), st.getLen()))
    return (df.semanticHash(), tuple(files))


def derived_table(spark: SparkSession, key: tuple, source: DataFrame, build: Callable[[DataFrame], DataFrame],
                  partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``build(source)`` into the shared folder and return a scan of it.
    An application builds and writes it once for the same ``key`` (what
    ``build`` does, with its rules) over the same source plan and unchanged
    files; later calls only look it up.

    This is where enrichment happens "at write time": queries then read the
    stored table, so their filters reach the Parquet scan (pushed filters,
    partition pruning) instead of being pushed down through - and inlined
    into - the enrichment projections.  The written table also cuts the
    lineage, so a lost executor never re-runs the enrichment.
    """
    k = (spark.sparkContext.applicationId, key, *inputs_of(source))
    if k not in _WRITTEN:
        df = build(source)
        path = f"{checkpoint_dir(spark)}/logspark-table-{uuid.uuid4().hex}"
        writer = df.write
        if partition_by:
            writer = df.hint("rebalance", *partition_by).write.partitionBy(*partition_by)
        writer.parquet(path)
        _WRITTEN[k] = (path, df.schema)
    path, schema = _WRITTEN[k]
    return spark.read.schema(schema).parquet(path)


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Round-robin over ``partitions`` tasks, by default twice the cores of the
    application: for input with fewer splits than cores, ahead of work that
    costs far more than moving its rows.  A scan cannot cut a row group, so a
    file of a million rows is one task however many cores wait."""
    return df.repartition(partitions or 2 * df.sparkSession.sparkContext.defaultParallelism)


def stored_logs(spark: SparkSession, source: DataFrame, adapter: Callable[[DataFrame], DataFrame],
                rules: Rules = DEFAULT_RULES) -> DataFrame:
    """The records that ``adapter`` makes of ``source``, enriched and written
    once (partitioned by log_date), then scanned.  The table belongs to the
    adapter, the rules and the source's files."""
    df = derived_table(spark, ("logs", adapter, rules), source, lambda s: enrich(adapter(s), rules).select(*LOG_COLUMNS), ("log_date",))
    return df.select(*LOG_COLUMNS)
