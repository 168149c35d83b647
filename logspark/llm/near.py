"""Links between items that share a key (band, segment or lattice cell).

Every near-duplicate operator ends the same way: items hold keys, items with
a common key are candidates, and an exact check decides.  To stay linear in
a group's size, candidates are never expanded into rows of pairs when a group
is dense:

* per key only its least and greatest item are aggregated (map-side partial);
  keys of a single item go at once;
* every item is tied to the least item of each of its keys; the connected
  components of these ties hold all candidates;
* a component is cut into blocks of at most about ``BLOCK`` items, and each
  pair of its blocks is one small group that is checked whole inside one
  task: an item travels once per block, not once per pair;
* a large, loose component (fewer candidate pairs than that would move) is
  checked pair by pair instead.

Both ways check all candidates; the cheaper one is chosen for each component.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import bitmap, components, drop, groups, may_hold, stored

#: Items in a block that one task checks.
BLOCK = 256

#: (payloads, left) -> positions i, j of linked items; ``left`` marks the
#: first of two blocks (only pairs across count) or is None for one block.
Check = Callable[[list[bytes], np.ndarray | None], tuple[np.ndarray, np.ndarray]]

FOUND = "id long, links long, root long"


def _roots(n: int, i: np.ndarray, j: np.ndarray, ids: list[int]) -> list[int]:
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        a, b = top(a), top(b)
        if a != b:
            if ids[a] < ids[b]:
                parent[b] = a
            else:
                parent[a] = b
    return [ids[top(x)] for x in range(n)]


def _answer(ids: list[int], weights: list[int], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """For each item its links (copies counted) and the least item tied to it."""
    w = np.asarray(weights, np.int64)
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, i, w[j])
    np.add.at(links, j, w[i])
    root = np.asarray(_roots(len(ids), i, j, ids), np.int64)
    hit = links > 0
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(ids, np.int64)[hit]), pa.array(links[hit]), pa.array(root[hit])], names=["id", "links", "root"])


def candidates(signed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``signed``: (id, keys array<long>), several rows of an id allowed.
    Returns the shared keys (key, lo, hi, n), their members (key, id, lo) and
    the candidate components (id, component)."""
    rows = signed.select("id", F.explode("keys").alias("key"))
    shared = stored(rows.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"),
                                            F.count(F.lit(1)).alias("n")).filter("lo < hi"))
    held = signed.sparkSession.sparkContext.broadcast(bitmap(shared, "key"))

    def may_share(batches):
        for batch in batches:
            keys = batch.column("keys")
            flat, sizes = keys.flatten().to_numpy(zero_copy_only=False), np.diff(keys.offsets.to_numpy())
            hit = may_hold(held.value, flat)
            ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(flat[hit])], names=["id", "key"])

    members = stored(signed.filter(F.size("keys") > 0).select("id", "keys").mapInArrow(may_share, "id long, key long")
                     .join(shared.select("key", "lo"), "key").distinct())
    comp = components(members.filter("id > lo").select(F.col("id").alias("u"), F.col("lo").alias("v")))
    return shared, members, comp


def links(signed: DataFrame, items: Callable[[Broadcast], DataFrame], check: Check) -> DataFrame:
    """(id, links, root) for every linked item, several rows of an id.

    ``items(bits)`` returns (id, weight, payload), one row of an id; it may
    leave out ids that the bitmap does not hold (``common.may_hold``), which
    are no candidates.  Summing ``links`` by id counts each link once;
    (id, root) are edges that connect exactly what the links connect.
    """
    shared, members, comp = candidates(signed)
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    pairs = shared.select(F.col("lo").alias("id"), (F.col("n") * (F.col("n") - 1) / 2).alias("p")) \
        .join(comp, "id").groupBy("component").agg(F.sum("p").alias("pairs"))
    plan = stored(size.join(pairs, "component").select(
        "component", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"),
        (F.col("size") * F.ceil(F.col("size") / BLOCK) > 2 * F.col("pairs")).alias("loose")))
    named = stored(comp.join(plan, "component"))
    bits = signed.sparkSession.sparkContext.broadcast(bitmap(comp, "id"))
    drop(shared, comp, plan)
    held = stored(items(bits).join(named, "id"))

    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dense = held.filter("not loose").withColumn("mine", mine) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("component", F.least("mine", "other").alias("b1"), F.greatest("mine", "other").alias("b2"),
                (F.col("mine") < F.col("other")).alias("first"), "id", "weight", "payload") \
        .repartition("component", "b1", "b2").sortWithinPartitions("component", "b1", "b2", "id")

    def whole_blocks(batches):
        for g in groups(batches, ("component", "b1", "b2")):
            if len(g["id"]) > 1:
                left = np.asarray(g["first"], bool) if g["b1"][0] != g["b2"][0] else None
                i, j = check(g["payload"], left)
                if len(i):
                    yield _answer(g["id"], g["weight"], i, j)

    of_blocks = dense.mapInArrow(whole_blocks, FOUND)

    few = members.select("id", "key").join(named.filter("loose").select("id"), "id")
    two = few.select(F.col("id").alias("a"), "key").join(few.select(F.col("id").alias("b"), "key"), "key") \
        .filter("a < b").select("a", "b").distinct()
    side = held.filter("loose").select("id", "weight", "payload")
    both = two.join(side.toDF("a", "wa", "pa"), "a").join(side.toDF("b", "wb", "pb"), "b")

    def one_pair(batches):
        for batch in batches:
            for a, b, wa, wb, p, q in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "wa", "wb", "pa", "pb"))):
                i, j = check([p, q], None)
                if len(i):
                    yield _answer([a, b], [wa, wb], i, j)

    found = stored(of_blocks.union(both.mapInArrow(one_pair, FOUND)))
    drop(members, named, held)
    return found


def classes(found: DataFrame) -> DataFrame:
    """(id, links, component) of the linked items from ``links``, whose table goes."""
    comp = components(found.filter("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")))
    out = stored(found.groupBy("id").agg(F.sum("links").alias("links")).join(comp, "id"))
    drop(found, comp)
    return out
