"""Shared helpers: tables in the cluster's shared folder, Arrow row access,
connected components, fixed-size bitmaps."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.session import checkpoint_dir
from logspark.sources.store import drop_folders

#: Rows that a Python worker gets at a time.
ROWS = 2000
#: 64-bit words of a prefilter bitmap (2 MB): a fixed size, whatever the data.
BITMAP_WORDS = 1 << 18


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that
    executors need not have it installed."""
    sc = spark.sparkContext
    # documents are large rows: small batches keep the workers' memory small
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    if sc.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="logspark-ship-")) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        sc.addPyFile(str(target))  # served to the executors by the driver
        _SHIPPED.add(sc.applicationId)


#: Has Spark remove the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_STORED: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts
    the lineage, and a lost executor never repeats the work before it.  The
    shuffles that led to it are gone afterwards."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _STORED[out] = path
    return out


def drop(*frames: DataFrame) -> None:
    """Remove tables that ``stored`` wrote and nothing reads any more; what was
    read from them has to be stored by then."""
    drop_folders(frames[0].sparkSession, [_STORED.pop(df) for df in frames])


def texts_of(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and the whole text, null as empty; other columns are left
    behind, so clashing names cannot matter."""
    return docs.select(*columns, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes of ``column``
    (a longer single row is a slice of its own)."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[dict[str, list]]:
    """Consecutive rows that agree on ``keys`` (rows come sorted by them)."""
    held: dict[str, list] | None = None
    last = None
    for batch in batches:
        cols = batch.to_pydict()
        ids = list(zip(*(cols[k] for k in keys)))
        start = 0
        for i, k in enumerate(ids):
            if k != last:
                if held is not None and start < i:
                    for name, values in held.items():
                        values.extend(cols[name][start:i])
                if held is not None:
                    yield held
                held, last, start = {name: [] for name in cols}, k, i
        if held is not None:
            for name, values in held.items():
                values.extend(cols[name][start:])
    if held is not None:
        yield held


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """Fixed-size bitmap of a long column.  It only saves shuffling rows that
    cannot join: an exact join always follows, and a full bitmap just lets
    every row through."""
    def slots(batches):
        bits = np.zeros(BITMAP_WORDS, np.uint64)
        for batch in batches:
            slot = mixed(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) % np.uint64(BITMAP_WORDS * 64)
            np.bitwise_or.at(bits, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].view(np.int64))], names=["w", "b"])

    words = df.select(F.col(column).cast("bigint").alias("v")).filter("v is not null") \
        .mapInArrow(slots, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(BITMAP_WORDS, np.int64)
    for w, b in words.collect():  # BITMAP_WORDS rows at most
        out[w] = b
    return out


def may_hold(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which 64-bit values may be in a bitmap."""
    slot = mixed(values.view(np.uint64)) % np.uint64(BITMAP_WORDS * 64)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)).astype(np.int64)) & 1 == 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (u, v): the smallest id that
    it reaches.  Alternates large-star and small-star steps until nothing
    changes; each round is written to the shared folder."""
    def print_of(e):
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    def least(e):
        return e.groupBy("u").agg(F.min("v").alias("m"))

    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
               .filter("u > v").distinct())
    before = print_of(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = least(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(m, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = least(large)
        small = large.join(m, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")) \
            .select("e.u", "e.v").filter("u > v").distinct()
        previous, e = e, stored(small)
        drop(previous)
        after = print_of(e)
        if after == before:
            break
        before = after
    out = stored(e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
                 .union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))
    drop(e)
    return out
