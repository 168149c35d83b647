"""Embedding near-duplicates by E8 lattice hashing.

A unit vector is projected to eight random directions, shifted and scaled, and
decoded to the nearest point of the E8 lattice; ``LATTICES`` such cells side by
side are its key in a table, since two cells keep strangers apart that one lets
meet.  Several tables are used, and a vector is also filed under the
neighbouring cells that lie nearest to it, so close vectors that a cell border
divides still meet.  Vectors of one label that share a cell are verified by
their cosine in double precision (``near``: dense cells are checked as blocks
inside tasks, copies of a vector as one).

Defined results: vectors that are null, empty or zero, hold null or non-finite
components, or have a null label link with nothing; vectors of another length
have cosine 0 with a vector; rows that repeat a vec_id are copies of one id;
a null vec_id takes no part: no component, kept.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm.common import drop, stored
from logspark.llm.near import classes, links

COSINE = 0.93
#: Tables, lattices in a table's key, neighbouring cells probed in each lattice,
#: and the width of a cell in units of the projected distance of a pair at the
#: threshold.  These miss about 1 pair in 100 at the threshold itself, and
#: fewer above it.
TABLES, LATTICES, PROBES, WIDTH = 8, 2, 1, 1.8
SEED = 4


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points of the rows of x, as doubled (integer) coordinates.

    E8 is D8 and D8 shifted by one half, D8 the integer points of even sum:
    round, and if the sum is odd move the worst coordinate to its second choice.
    """
    def d8(y):
        r = np.rint(y)
        odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
        off = y[odd] - r[odd]
        worst = np.argmax(np.abs(off), axis=1)
        at = np.arange(len(odd))
        r[odd, worst] += np.where(off[at, worst] >= 0, 1.0, -1.0)
        return r

    whole, half = d8(x), d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return (2 * np.where(closer[:, None], whole, half)).astype(np.int64)


def _shortest() -> np.ndarray:
    """The 240 shortest E8 vectors, doubled: two coordinates of +-1, and all of
    +-1/2 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [list(s) for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(out, np.int64)


NEIGHBOURS = _shortest()


def cell_keys(vectors: np.ndarray, label: np.ndarray, tables: int = TABLES, lattices: int = LATTICES, probes: int = PROBES,
              width: float = WIDTH, cosine: float = COSINE, seed: int = SEED) -> np.ndarray:
    """64-bit keys of each unit vector's own and neighbouring cells:
    (rows, tables * (1 + probes) ** lattices)."""
    dims = vectors.shape[1]
    scale = width * np.sqrt(2 - 2 * cosine) * np.sqrt(8)
    far_away = (NEIGHBOURS ** 2).sum(axis=1) / 4
    out = []
    for t in range(tables):
        sides = []
        for g in range(lattices):
            rng = np.random.default_rng([seed, t, g, dims])
            x = (vectors @ rng.standard_normal((dims, 8))) / scale + rng.random(8)
            own = nearest_e8(x)
            # distance to a neighbour's centre, less what all of them have in common
            far = far_away - (x - own / 2) @ NEIGHBOURS.T
            near = np.argpartition(far, probes, axis=1)[:, :probes]
            sides.append(np.concatenate([own[:, None, :], own[:, None, :] + NEIGHBOURS[near]], axis=1))
        head = np.stack([np.full(len(vectors), t), label], axis=1)
        for which in product(range(1 + probes), repeat=lattices):
            out.append(_hash(np.concatenate([head, *(side[:, k] for side, k in zip(sides, which))], axis=1)))
    return np.stack(out, axis=1)


def _hash(rows: np.ndarray) -> np.ndarray:
    key = np.zeros(len(rows), np.uint64)
    for column in rows.T.astype(np.int64).view(np.uint64):
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def signed_vectors(rows: DataFrame, **how) -> DataFrame:
    """(vec_id, id, payload, keys) of (vec_id, embedding, label): the class of
    equal vectors of a label, the vector as bytes of doubles; null ids link
    with nothing."""
    def sign(batches):
        for batch in batches:
            vectors, label = batch.column("embedding").to_pylist(), batch.column("label").to_pylist()
            by_size: dict[int, list[int]] = {}
            clean: dict[int, np.ndarray] = {}
            for i, (v, mark) in enumerate(zip(vectors, label)):
                if not v or mark is None or any(x is None for x in v):
                    continue
                x = np.array(v, np.float64)
                top = np.abs(x).max()
                if np.isfinite(top) and top > 0:
                    by_size.setdefault(len(v), []).append(i)
                    clean[i] = x
            ids: list[int | None] = [None] * batch.num_rows
            payload: list[bytes | None] = [None] * batch.num_rows
            keys: list[list[int]] = [[]] * batch.num_rows
            for at in by_size.values():
                x = np.stack([clean[i] for i in at])
                unit = x / np.abs(x).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                for i, k in zip(at, cell_keys(unit, np.array([label[i] for i in at], np.int64), **how)):
                    payload[i] = np.int64(label[i]).tobytes() + clean[i].tobytes()
                    ids[i] = xxhash.xxh3_64_intdigest(payload[i])
                    keys[i] = np.unique(k).tolist()
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), pa.array([None if i is None else i - (i >> 63 << 64) for i in ids], pa.int64()),
                pa.array(payload, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["vec_id", "id", "payload", "keys"])

    return rows.mapInArrow(sign, "vec_id long, id long, payload binary, keys array<long>")


def check_cosine(cosine: float) -> Callable:
    """Links among the vectors of one group (see ``near.Check``)."""
    def check(payloads: list[bytes], left: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(p) for p in payloads])
        label = np.array([np.frombuffer(p, np.int64, 1)[0] for p in payloads])
        link = np.zeros((len(size), len(size)), bool)
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            x = np.stack([np.frombuffer(payloads[i], np.float64, offset=8) for i in at])
            x = x / np.abs(x).max(axis=1, keepdims=True)
            norm = np.sqrt((x * x).sum(axis=1))
            link[np.ix_(at, at)] = (x @ x.T) / (norm[:, None] * norm[None, :]) >= cosine
        link &= label[:, None] == label[None, :]
        if left is not None:
            link &= left[:, None] != left[None, :]
        return np.nonzero(np.triu(link, 1))
    return check


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, **how) -> DataFrame:
    """One row for each row of ``embeddings``: vec_id, n_links (other ids linked
    directly), component_id (smallest vec_id that links reach), kept."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
                             F.col("label").cast("long").alias("label"))
    signed = stored(signed_vectors(rows, cosine=cosine, **how))
    named = signed.filter("id is not null and vec_id is not null")
    copies = stored(named.groupBy("id", "vec_id").agg(F.lit(1).alias("one")).groupBy("id")
                    .agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first")))

    def items(bits):  # all of them: a vector is a small row
        return named.select("id", "payload").dropDuplicates(["id"]).join(copies.select("id", "weight"), "id") \
            .select("id", "weight", "payload")

    near = classes(links(named.select("id", "keys"), items, check_cosine(cosine)))
    known = stored(copies.join(near, "id", "left").select(
        "id", "first", F.coalesce("component", "id").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    drop(copies, near)
    least = known.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = known.join(least, "component").select("id", "component_id", "n_links")
    own = F.coalesce("component_id", "vec_id")
    return signed.select("vec_id", "id").join(of_class, "id", "left").select(
        "vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), own).alias("component_id"),
        F.coalesce(own == F.col("vec_id"), F.lit(True)).alias("kept"))


def op4_e8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len([1 for x in embedding if x is null or not isfinite(x)]) = 0
    and len([1 for x in embedding if x <> 0]) > 0),
links as (
  select a.vec_id as u, b.vec_id as w
  from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93),
reach(u, w) as (
  select vec_id, vec_id from v union select r.u, l.w from reach r join links l on r.w = l.u),
least as (select u, min(w) as component_id from reach group by u),
degree as (select u, count(distinct w) as n from links group by u)
select e.vec_id, coalesce(d.n, 0)::bigint as n_links, coalesce(l.component_id, e.vec_id) as component_id,
       coalesce(l.component_id, e.vec_id) = e.vec_id as kept
from embeddings e left join degree d on e.vec_id = d.u left join least l on e.vec_id = l.u
"""
