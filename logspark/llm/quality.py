"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams (one- and two-token grams,
``BUCKETS`` buckets) are counted: the target model over up to ``TARGET_DOCS``
documents labelled as good (drawn by a hash of their id), the raw model over
all documents.  Texts are read where they lie and never shuffled; labels meet
the scores, not the texts.  A document's log importance weight is the sum over
its n-grams of log p_target - log p_raw, by models that leave it out.  Adding
Gumbel noise and taking the k largest keys draws k documents without
replacement in proportion to their weights (Gumbel top-k).

k is part of the request, or is taken from the labelled documents: it is then
the number of documents above the key that separates good from bad labels
best (shares of both, a lost good document weighing KEEP times, read from a
histogram of fixed size).

Defined results: a null text is empty; a document without n-grams has weight
0; labels that are null, or that contradict each other for a doc_id, count as
good if any row says good; without good or without bad labels nothing can be
separated and every document is kept; rows that repeat a doc_id and text get
the same key; ties at the k-th key are all kept; a null doc_id is a value
like any other.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm.common import pieces, stored, texts_of

#: Buckets of the hashed n-gram models: a fixed size, whatever the data.
BUCKETS = 1 << 14
#: Resolution and range of the histogram of keys that k is read from.
BIN, CLIP = 0.25, 400.0
SEED = 20260
#: N-grams a bucket that the raw model counts as in the target model, and how
#: much more a good document that is lost counts than a bad one that is kept.
PRIOR, KEEP = 20, 3
#: Labelled documents that the target model is fitted on, at most.
TARGET_DOCS = 20_000
TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Hashes(dict):
    """Token -> 32-bit hash, forgotten when it grows beyond a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) > 1 << 17:
            self.clear()
        h = self[token] = zlib.crc32(token.encode("utf-8", "replace"))
        return h


def ngram_buckets(text: str, hashes: dict) -> np.ndarray:
    """Buckets of all one- and two-token grams of the whole text; a token said
    twice in a row is one and the same gram, whatever the token."""
    h = np.array([hashes[t] for t in TOKEN.findall(text.lower())], np.uint64)
    two = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    two[h[:-1] == h[1:]] = np.uint64(0)
    one = h * np.uint64(0xD6E8FEB86659FD93)
    return (np.concatenate([one, two]) >> np.uint64(64 - 14)).astype(np.int64)


def _among(ids: pa.Array, wanted: np.ndarray) -> np.ndarray:
    return np.isin(ids.fill_null(-1).to_numpy(zero_copy_only=False), wanted) & ids.is_valid().to_numpy(zero_copy_only=False)


def counts(docs: DataFrame, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(target, raw) n-gram counts of (doc_id, text); ``targets``: sorted ids.
    A task adds up its own counts, so at most BUCKETS rows leave it."""
    held = docs.sparkSession.sparkContext.broadcast(targets)

    def count(batches):
        hashes, total = _Hashes(), np.zeros((2, BUCKETS), np.int64)
        for batch in pieces(batches):
            for text, hit in zip(batch.column("text").to_pylist(), _among(batch.column("doc_id"), held.value)):
                c = np.bincount(ngram_buckets(text, hashes), minlength=BUCKETS)
                total[1] += c
                if hit:
                    total[0] += c
        b = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(total[0][b]), pa.array(total[1][b])], names=["b", "t", "r"])

    rows = docs.select("doc_id", "text").mapInArrow(count, "b long, t long, r long") \
        .groupBy("b").agg(F.sum("t").alias("t"), F.sum("r").alias("r")).collect()  # BUCKETS rows at most
    target, raw = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b, t, r in rows:
        target[b], raw[b] = t, r
    return target, raw


class Models(NamedTuple):
    """n-gram counts of both models, and the sorted ids the target is made of."""
    target: np.ndarray
    raw: np.ndarray
    ids: np.ndarray
    target_total: int
    raw_total: int

    def log_weight(self, buckets: np.ndarray, own: bool) -> float:
        """Sum over the n-grams of a document of log p_target - log p_raw, both
        without the document itself: a model knows its own documents too well.
        The raw model is add-one smoothed; the target model starts from it with
        the weight of PRIOR n-grams a bucket, so that a few labels move it a
        little and many move it freely."""
        n = len(buckets)
        if not n:
            return 0.0
        count = np.bincount(buckets, minlength=BUCKETS)
        at = np.flatnonzero(count)
        c = count[at]
        p_raw = (self.raw[at] - c + 1) / (self.raw_total - n + BUCKETS)
        prior = PRIOR * BUCKETS
        p_target = (self.target[at] - c * own + prior * p_raw) / (self.target_total - n * own + prior)
        return float((c * np.log(p_target / p_raw)).sum())


def weigh(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, noise, text_hash, log_weight) of each row."""
    held = docs.sparkSession.sparkContext.broadcast(models)

    def score(batches):
        hashes, m = _Hashes(), held.value
        for batch in pieces(batches):
            w = [m.log_weight(ngram_buckets(t, hashes), hit)
                 for t, hit in zip(batch.column("text").to_pylist(), _among(batch.column("doc_id"), m.ids))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("noise"), batch.column("text_hash"), pa.array(w, pa.float64())],
                                             names=["doc_id", "noise", "text_hash", "log_weight"])

    return docs.mapInArrow(score, "doc_id long, noise double, text_hash long, log_weight double")


def _gumbel(seed: int):
    """Gumbel noise from a hash of the row: the same in every run and attempt."""
    u = (F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


class Cutoff(NamedTuple):
    key: float | None  # None: keep all


def separating_key(keyed: DataFrame) -> Cutoff:
    """The key that separates good from bad labels best, over all labelled rows."""
    b = F.floor(F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), F.col("key"))) / BIN).cast("long")
    rows = sorted(keyed.filter("good or bad").groupBy(b.alias("b"))
                  .agg(F.count(F.when(F.col("good"), 1)).alias("g"), F.count(F.when(F.col("bad"), 1)).alias("n"))
                  .collect())  # 2 * CLIP / BIN rows at most
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return Cutoff(None)
    best, at, below_g, below_b = -1.0, None, 0, 0
    for bin_, g, n in rows:
        accuracy = KEEP * (good - below_g) / good + below_b / bad
        if accuracy > best + 1e-12:
            best, at = accuracy, bin_ * BIN
        below_g, below_b = below_g + g, below_b + n
    return Cutoff(None if at == rows[0][0] * BIN else at)


def kth_key(keyed: DataFrame, k: int) -> Cutoff:
    """The k-th largest key, by narrowing a histogram of fixed size."""
    if k <= 0:
        return Cutoff(float("inf"))
    lo, hi, n = keyed.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k >= n:
        return Cutoff(None)
    bins = 4096
    while lo < hi:
        width = (hi - lo) / bins
        inside = keyed.filter(F.col("key").between(lo, hi))
        b = F.least(F.lit(bins - 1), F.floor((F.col("key") - lo) / (width or 1.0)))
        rows = sorted(inside.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"),
                                                       F.max("key").alias("hi")).collect(), reverse=True)
        for _, n, b_lo, b_hi in rows:  # 4,096 rows at most
            if n >= k:
                lo, hi = b_lo, b_hi
                break
            k -= n
    return Cutoff(lo)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, key, kept) of every row of ``docs``; ``labels`` has
    doc_id and quality (1 good, 0 bad)."""
    return _decided(docs, labels, k, seed).drop("text_hash")


def _decided(docs: DataFrame, labels: DataFrame, k: int | None, seed: int) -> DataFrame:
    marks = labels.filter("doc_id is not null and quality is not null") \
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") >= 1).alias("good"))
    drawn = marks.filter("good").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(TARGET_DOCS).collect()
    targets = np.sort(np.array([r[0] for r in drawn], np.int64))
    rows = texts_of(docs, F.col("doc_id").cast("long").alias("doc_id")).select("doc_id", "text", _gumbel(seed).alias("noise"), F.xxhash64("text").alias("text_hash"))
    target, raw = counts(rows, targets)
    scored = weigh(rows, Models(target, raw, targets, int(target.sum()), int(raw.sum()))).withColumn("key", F.col("log_weight") + F.col("noise"))
    keyed = stored(scored.join(marks, "doc_id", "left").select(
        "doc_id", "text_hash", "log_weight", "key", F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce(~F.col("good"), F.lit(False)).alias("bad")))
    cut = separating_key(keyed) if k is None else kth_key(keyed, k)
    if target.sum() == 0 and k is None:
        cut = Cutoff(None)
    kept = F.lit(True) if cut.key is None else F.col("key") >= F.lit(cut.key)
    return keyed.select("doc_id", "log_weight", "key", kept.alias("kept"), "text_hash")


def keep_good(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their own columns.  A row finds
    its decision by doc_id and text, so rows without an id, or with one that
    other texts have, are decided one by one; rows that repeat both share it.
    Null texts are empty ones; ties at the k-th key all stay."""
    drawn = _decided(docs, labels, k, SEED).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")).distinct()
    return docs.join(drawn, docs["doc_id"].cast("long").eqNullSafe(drawn["_id"]) & (_text_hash_of(docs) == drawn["_text"]), "left_semi")


def _text_hash_of(docs: DataFrame):
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = spark.read.parquet
    return resample(read(f"{sf_dir}/documents.parquet"), read(f"{sf_dir}/labels.parquet"))
