"""Session helpers: configuration a job relies on, and where to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings this library's plans assume.  On a cluster they are normally in
# spark-defaults.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int = 8, app: str = "logspark", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in RECOMMENDED.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session.  Only a local master may go without: it gets one
    scratch folder per application.  Any other master without it is an
    error, since executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir is not set: with master {sc.master} the driver and the "
                           "executors need a shared folder for tables that are written in between")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="logspark-shared-")
    return _LOCAL[sc.applicationId]


def staged(df: DataFrame, name: str = "staged", at: str | None = None) -> DataFrame:
    """``df`` written once to a new folder in the shared folder (or over the
    folder ``at``) and read back: every reader sees the same rows, and a lost
    executor repeats nothing."""
    path = at or f"{checkpoint_dir(df.sparkSession)}/logspark-{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite" if at else "errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
