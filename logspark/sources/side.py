"""Tables kept beside the stored log table, derived from its folders.

A side table holds, for every (log_date, batch) folder of the store, rows that
are made from that folder's rows alone.  It lies under ``_side/<name>`` of the
store (Spark skips names with an underscore), in a folder for each source
folder and version; the version is a digest of the source folder's file names,
which no two writes share.  So what is missing or out of date is known from two
listings: ``refresh`` makes what is missing in one job and drops what belongs
to no folder any more.  Whatever happened to the store - appends, streams,
deletes, retention, compaction, a replayed batch - the next refresh follows,
and a lost or repeated refresh does no harm.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
from collections.abc import Callable
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from logspark.schema import LOGS
from logspark.sources.store import drop_folders, exists

STORED = StructType([*LOGS.fields, StructField("batch", StringType())])


class Side(NamedTuple):
    """``build`` makes rows (log_date, batch, ...) of logs that know their
    ``batch`` and ``file``; ``order`` sorts them within a file."""

    name: str
    schema: str         # without log_date, batch and version
    build: Callable[[DataFrame], DataFrame]
    order: tuple[str, ...] = ()


def _parts(path: str) -> tuple[str, ...]:
    """Values of the key=value folders at the end of a path (without a file)."""
    return tuple(unquote(p.split("=", 1)[1]) for p in path.split("/") if p.startswith(("log_date=", "batch=", "version=")))


def _files(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """File names by the values of their key=value folders: one listing."""
    found: dict[tuple[str, ...], list[str]] = {}
    for f in spark.read.schema(STORED).parquet(path).inputFiles() if exists(spark, path) else ():
        folder, _, name = f.rpartition("/")
        found.setdefault(_parts(folder), []).append(name)
    return found


def versions(spark: SparkSession, path: str) -> dict[tuple[str, str], str]:
    """{(log_date, batch): version} of the store's folders, from its file names."""
    return {k: hashlib.md5("\n".join(sorted(v)).encode()).hexdigest() for k, v in _files(spark, path).items()}


def at(root: str, day: str, batch: str, version: str) -> str:
    return f"{root}/log_date={day}/batch={batch}/version={version}"


def refresh(spark: SparkSession, path: str, side: Side) -> list[str]:
    """Bring a side table up to date; returns its folders."""
    root = f"{path}/_side/{side.name}"
    wanted = versions(spark, path)
    kept = set(_files(spark, root))     # (log_date, batch, version); a folder is written as a whole
    missing = [(d, b, v) for (d, b), v in wanted.items() if (d, b, v) not in kept]
    if missing:
        listed = spark.createDataFrame(missing, "day string, batch string, version string")  # one row a folder
        rows = spark.read.schema(STORED).parquet(path) \
            .select("*", F.col("_metadata.file_name").alias("file"))
        # prunes the folders of other days and batches
        day = F.coalesce(F.col("log_date").cast("string"), F.lit(NO_DAY))
        days = [_dt.date.fromisoformat(d) for d in sorted({d for d, _, _ in missing}) if d != NO_DAY]
        rows = rows.filter((F.col("log_date").isin(days) | F.col("log_date").isNull()) & F.col("batch").isin(sorted({b for _, b, _ in missing})))
        made = side.build(rows)
        made.join(F.broadcast(listed.withColumnRenamed("batch", "_b")), (day == F.col("day")) & (F.col("batch") == F.col("_b"))) \
            .drop("day", "_b").hint("rebalance", "log_date", "batch").sortWithinPartitions("log_date", "batch", *side.order) \
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log_date", "batch", "version").parquet(root)
    drop_folders(spark, [at(root, *k) for k in kept if wanted.get(k[:2]) != k[2]])
    made = kept | set(_files(spark, root)) if missing else kept
    return [at(root, *k) for k in sorted(made) if wanted.get(k[:2]) == k[2]]


#: Name of the folder of rows without a day.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def read(spark: SparkSession, path: str, side: Side) -> DataFrame:
    """The side table as of now: log_date, batch and its own columns."""
    current = refresh(spark, path, side)
    schema = StructType.fromDDL(f"{side.schema}, log_date date, batch string, version string")
    if not current:
        return spark.createDataFrame([], schema).drop("version")
    return spark.read.schema(schema).option("basePath", f"{path}/_side/{side.name}").parquet(*current).drop("version")
