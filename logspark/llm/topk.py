"""Exact top-k search with one KD-tree per shard.

Vectors are dealt over shards of bounded size; each shard is built once into a
KD-tree (median splits along the widest side, a tight bounding box per leaf)
and stored.  The greatest inner product that a query can have inside a box is
the sum over components of max(q * low, q * high).  A query opens the boxes of
a shard best first and stops where that bound is below its k-th score; boxes
are bounded for a whole block of queries by two matrix products.

The k-th score travels: every block first searches one shard, and takes the
scores found there along as a bound to all others.  A shard's task holds one
tree and one block of queries at a time; what leaves it is k rows for a query
at most.  The queries meet the shards as blocks, which is the stated query set
against all rows; no pairs are made.

Defined results: vectors that are null, or hold null or non-finite components,
take no part; vectors are compared when they have equal length; rows that
repeat a vec_id are one vector (the smallest); a null vec_id takes no part;
scores are exact, in wide integers where a product may leave a long; a score
beyond a long is the long's end (as are components beyond +-2^61); ties go to the smaller vec_id; a query with no other vector has no rows.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logspark.llm.common import groups, stored

K, EVERY, SCALE = 20, 20, 64.0
#: Vectors of a shard, of a leaf, and queries of a block (about).
SHARD, LEAF, BLOCK = 4096, 128, 256
#: Components are longs of at most this size; scores beyond a long are its ends.
CLIP = 1 << 61
_NONE, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def _small(x: np.ndarray) -> np.ndarray:
    """The smallest integer type that holds x."""
    top = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def build_tree(ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """Points in the order of their leaves, with each leaf's start and box."""
    order, starts = [], [0]
    todo = [np.arange(len(ids))]
    while todo:
        part = todo.pop()
        sides = points[part].max(axis=0) - points[part].min(axis=0) if points.shape[1] else np.zeros(1)
        if len(part) <= leaf or not sides.max():
            order.append(part)
            starts.append(starts[-1] + len(part))
            continue
        side = points[part, int(np.argmax(sides))]
        part = part[np.argpartition(side, len(part) // 2)]
        todo += [part[len(part) // 2:], part[:len(part) // 2]]
    at = np.concatenate(order)
    box = [(points[p].min(axis=0), points[p].max(axis=0)) for p in order]
    return {"ids": ids[at], "points": _small(points[at]), "starts": np.array(starts),
            "low": _small(np.stack([b[0] for b in box])), "high": _small(np.stack([b[1] for b in box]))}


def _product(q: np.ndarray, x: np.ndarray, top: int) -> np.ndarray:
    """Exact inner products, sums of at most ``top``: in doubles while they are
    exact, in longs, or in Python's integers, cut to a long at the end."""
    if top < 1 << 52:
        return q.astype(np.float64) @ x.astype(np.float64).T
    if top < 1 << 62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    exact = q.astype(object) @ x.astype(object).T
    return np.clip(exact, int(_NONE) + 1, int(_MOST)).astype(np.int64)


def search(tree: dict[str, np.ndarray], qids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int):
    """(query row, vec_id, score) of each query's k best of the tree, those
    below ``floor`` (a score that is reached elsewhere k times) left out."""
    top = int(np.abs(queries).max(initial=0)) * int(np.abs(tree["points"]).max(initial=0)) * max(1, queries.shape[1])
    # the best corner of a box takes its high side where the query is positive
    signed = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1)
    bound = _product(signed, np.concatenate([tree["high"], tree["low"]], axis=1), top)
    order = np.argsort(~bound if bound.dtype == np.int64 else -bound, axis=1, kind="stable")
    n = len(qids)
    least = _NONE
    score = np.full((n, k), least, np.int64)
    found = np.full((n, k), _MOST, np.int64)
    kth = np.maximum(floor, least)
    alive = np.arange(n)
    for step in range(order.shape[1]):
        leaf = order[alive, step]
        go = bound[alive, leaf] >= kth[alive]  # an equal score may have a smaller id
        alive, leaf = alive[go], leaf[go]
        if not len(alive):
            break
        for one in np.unique(leaf):
            rows = alive[leaf == one]
            here = slice(tree["starts"][one], tree["starts"][one + 1])
            ids = tree["ids"][here]
            s = _product(queries[rows], tree["points"][here], top).astype(np.int64)
            s[ids[None, :] == qids[rows, None]] = least
            s[s < kth[rows, None]] = least
            better = s.max(axis=1) > least
            rows, s = rows[better], s[better]
            if not len(rows):
                continue
            s = np.concatenate([score[rows], s], axis=1)
            i = np.concatenate([found[rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
            i = np.where(s == least, _MOST, i)
            best = np.lexsort((i, ~s), axis=1)[:, :k]
            score[rows], found[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
            kth[rows] = np.maximum(kth[rows], score[rows, -1])
    row, col = np.nonzero(score > least)
    return row, found[row, col], score[row, col]


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v array<long>, size) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.lit(-float(CLIP)), F.least(F.lit(float(CLIP)), c * SCALE))).cast("long"))
    return embeddings.filter(x.isNotNull() & ~bad & F.col("vec_id").isNotNull()) \
        .select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")) \
        .groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("size", F.size("v"))


def _matrix(rows: dict[str, list], size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.array(rows["vec_id"], np.int64), np.array(rows["v"], np.int64).reshape(len(rows["v"]), size)


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best."""
    rows = stored(vectors(embeddings))
    per = {r["size"]: (r["n"], r["q"]) for r in rows.groupBy("size").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).collect()}  # a row per length
    found = None
    for size, (n, q) in per.items():
        if q:
            part = _of_size(rows.filter(F.col("size") == size), size, max(1, -(-n // shard)), max(1, -(-q // block)), k, every)
            found = part if found is None else found.union(part)
    if found is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id",
                           F.lit(0).cast("long").alias("score")).filter(F.lit(False))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _of_size(rows: DataFrame, size: int, shards: int, blocks: int, k: int, every: int) -> DataFrame:
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")

    def trees(batches):
        for g in groups(batches, ("shard",)):
            yield pa.RecordBatch.from_pydict({"shard": pa.array(g["shard"][:1], pa.int32()),
                                              "data": pa.array([_pack(**build_tree(*_matrix(g, size)))], pa.binary())})

    shard_rows = rows.withColumn("shard", deal(shards, 1)).select("shard", "vec_id", "v")
    tree = stored(shard_rows.repartition(shards, "shard").sortWithinPartitions("shard")
                  .mapInArrow(trees, "shard int, data binary"))

    def packed(batches):
        for g in groups(batches, ("block",)):
            ids, x = _matrix(g, size)
            floor = np.array([_NONE if f is None else f for f in g["floor"]], np.int64)
            yield pa.RecordBatch.from_pydict({"block": pa.array(g["block"][:1], pa.int32()),
                                              "data": pa.array([_pack(ids=ids, x=_small(x), floor=floor)], pa.binary())})

    queries = rows.filter(F.col("vec_id") % every == 0).withColumn("block", deal(blocks, 2)).select("block", "vec_id", "v")

    def pack(q):
        return q.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(packed, "block int, data binary")

    def run(batches):
        held, at = None, None
        for batch in batches:
            for s, b, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "data"))):
                if b < 0:
                    held, at = _unpack(data), s
                elif at == s:  # a shard may be empty
                    q = _unpack(data)
                    row, ids, score = search(held, q["ids"], q["x"], q["floor"], k)
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(q["ids"][row]), "vec_id": pa.array(ids),
                                                      "score": pa.array(score)})

    def meet(q):
        """Each shard's tree, then the blocks that come to it."""
        both = tree.select("shard", F.lit(-1).alias("block"), "data").union(q.select("shard", "block", "data"))
        return both.repartition(shards, "shard").sortWithinPartitions("shard", "block") \
            .mapInArrow(run, "query_id long, vec_id long, score long")

    home = F.pmod(F.col("block"), F.lit(shards)).cast("int")
    first = stored(meet(pack(queries.withColumn("floor", F.lit(None).cast("long"))).withColumn("shard", home)))
    if shards == 1:
        return first
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    floor = first.withColumn("r", rank).filter(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    again = pack(queries.join(floor, "vec_id", "left").select("block", "vec_id", "v", "floor")) \
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter(F.col("shard") != home)
    return first.union(meet(again))


def op7_kd_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = """
with v as (
  select vec_id, [floor(64 * x::double) for x in embedding] as v from embeddings
  where vec_id is not null and embedding is not null and len([1 for x in embedding if x is null or not isfinite(x)]) = 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 20 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from pairs qualify rank <= 20
"""
