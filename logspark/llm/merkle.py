"""Operator 11: Merkle manifest of a dataset, with incremental witnesses.

Every row is a leaf; the leaves of one ``lang`` form a tree, and the roots of
these trees form a tree of their own, whose root names the whole dataset.  A
row's proof is the list of digests that leads from its leaf to that root.

Method.  Leaves are numbered in order within their tree and dealt into aligned
blocks of 2^BLOCK.  One task appends the leaves of a block one after another,
as they stream in.  It keeps a stack of open subtrees, one a level, and each
open subtree holds the partial witnesses of its leaves; when a later sibling
is complete, the two are joined and all witnesses of both grow by one digest.
A block leaves one root.  The block roots of all tasks are then further
appends, to the next level of blocks, until each tree has one root; witnesses
of roots are attached to the witnesses below them.

Only (lang, doc_id, two leaf digests) is shuffled, never a text; a task holds
one block.  A tree of n leaves needs log(n) / BLOCK rounds, the rounds after
the first on 2^BLOCK times fewer rows each.

Defined results.  Null fields count as ``-``; a null lang is a tree of its own,
ordered first; null doc_ids come first in their tree; rows with the same doc_id
are ordered by their leaf, and equal rows each take a place of their own.
Other columns do not matter, also those with names used in here.  Long texts
are hashed whole.  An empty table has no leaves and no root: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logspark.llm.common import stored

#: A block holds 2^BLOCK leaves.
BLOCK = 10
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

WITNESS = "array<struct<before: boolean, digest: binary>>"
_STEP = pa.struct([("before", pa.bool_()), ("digest", pa.binary())])


def leaf_digest(columns: dict[str, Column]) -> Column:
    """Lowercase hex SHA-256 of the fields: ``-`` for null, else the UTF-8
    byte count, a colon and the value."""
    parts = []
    for name in FIELDS:
        v = columns[name].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


# ------------------------------------------------------------ appending
class Appender:
    """A tree that leaves are appended to.  ``open`` holds at most one complete
    subtree a level, the largest first: [level, digest, first leaf].  The
    witnesses of an open subtree are partial: they end at its root."""

    def __init__(self) -> None:
        self.open: list[list] = []
        self.witnesses: list[list] = []

    def append(self, digest: bytes) -> None:
        self.open.append([0, digest, len(self.witnesses)])
        self.witnesses.append([])
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self._join()

    def _join(self) -> None:
        level, right, middle = self.open.pop()
        _, left, first = self.open[-1]
        after, before = (False, right), (True, left)
        for w in self.witnesses[first:middle]:
            w.append(after)
        for w in self.witnesses[middle:]:
            w.append(before)
        self.open[-1] = [level + 1, _digest(left.hex() + right.hex()), first]

    def close(self, height: int | None) -> bytes:
        """No more leaves: nodes without a sibling are hashed alone, up to
        ``height`` levels above the leaves (None: up to a single root)."""
        alone = (None, None)
        while len(self.open) > 1 or (height is not None and self.open[0][0] < height):
            if len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
                self._join()
                continue
            level, digest, first = self.open[-1]
            for w in self.witnesses[first:]:
                w.append(alone)
            self.open[-1] = [level + 1, _digest(digest.hex()), first]
        return self.open[0][1]


def _digest(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


def _appended(block: int, keep: tuple[str, ...]):
    """Rows (grp, pos, n, digest, *keep) come sorted by (grp, pos), blocks
    whole; they leave with their witness up to the block's root, ``top``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types, at = ("digest", *keep), {}, None     # at: (grp, block, n)
        tree, held = Appender(), {}

        def closed():
            grp, number, n = at
            top = tree.close(block if n > 1 << block else None)
            m, first = len(tree.witnesses), number << block
            offsets, steps = [0], []
            for ws in tree.witnesses:
                steps.extend(ws)
                offsets.append(len(steps))
            values = pa.StructArray.from_arrays(
                [pa.array([s[0] for s in steps], pa.bool_()), pa.array([s[1] for s in steps], pa.binary())], names=["before", "digest"])
            return pa.RecordBatch.from_arrays(
                [pa.array([grp] * m, pa.string()), pa.array(range(first, first + m), pa.int64()), pa.array([number] * m, pa.int64()),
                 pa.array([n] * m, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values),
                 pa.array([top] * m, pa.binary()), *(pa.array(held[c], types[c]) for c in names)],
                names=["grp", "pos", "block", "n", "witness", "top", *names])

        for batch in batches:
            types = {c: batch.schema.field(c).type for c in names}
            cols = [batch.column(c).to_pylist() for c in ("grp", "pos", "n", *names)]
            for grp, pos, n, *rest in zip(*cols):
                here = (grp, pos >> block, n)
                if here != at:
                    if at is not None:
                        yield closed()
                    tree, held, at = Appender(), {c: [] for c in names}, here
                tree.append(rest[0])
                for c, v in zip(names, rest):
                    held[c].append(v)
        if at is not None:
            yield closed()
    return run


def _append_round(nodes: DataFrame, block: int) -> DataFrame:
    """(grp, pos, block, n, witness, top, digest, ...) of nodes (grp, pos, n,
    digest, ...): the partial witness up to the root of the node's block."""
    keep = tuple(c for c in nodes.columns if c not in ("grp", "pos", "n", "digest"))
    kept = "".join(f", `{c}` {nodes.schema[c].dataType.simpleString()}" for c in keep)
    ordered = nodes.withColumn("block", F.shiftright("pos", block)) \
        .repartition("grp", "block").sortWithinPartitions("grp", "pos").drop("block")
    return stored(ordered.mapInArrow(
        _appended(block, keep), f"grp string, pos long, block long, n long, witness {WITNESS}, top binary, digest binary{kept}"))


def climb(nodes: DataFrame, block: int = BLOCK) -> list[DataFrame]:
    """The rounds of appends over nodes (grp, pos, n, digest, ...); in each
    group pos counts from 0 to n - 1.  Block roots are the next round's nodes."""
    rounds = [_append_round(nodes, block)]
    most = rounds[0].agg(F.max("n")).first()[0] or 0
    while most > 1 << block:
        most = -(-most >> block)
        tops = rounds[-1].filter((F.col("n") > 1 << block) & (F.col("pos") == F.shiftleft("block", block))) \
            .select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / F.lit(1 << block)).cast("long").alias("n"),
                    F.col("top").alias("digest"))
        rounds.append(_append_round(tops, block))
    return rounds


def roots_of(rounds: list[DataFrame], block: int = BLOCK) -> DataFrame:
    """(grp, root): a group's root is the top of the round that it ends in."""
    ends = [r.filter((F.col("n") <= 1 << block) & (F.col("pos") == 0)).select("grp", F.col("top").alias("root")) for r in rounds]
    return reduce(DataFrame.union, ends)


def paths(rounds: list[DataFrame], beyond: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the first round with ``path``: their witnesses extended
    round by round, and then by what lies ``beyond`` their group (grp, more,
    and other columns).  No key of these joins has more than a block of rows."""
    beyond_columns = [c for c in beyond.columns if c not in ("grp", "more")]
    above = None
    for rows in reversed(rounds):
        kept = [c for c in rows.columns if c not in ("block", "n", "witness", "top")]
        joined = rows.filter(F.col("n") <= 1 << block).join(beyond, "grp")
        if above is not None:
            up = above.select("grp", F.col("pos").alias("block"), F.col("path").alias("more"), *beyond_columns)
            joined = joined.unionByName(rows.filter(F.col("n") > 1 << block).join(up, ["grp", "block"]))
        above = joined.select(*kept, F.concat("witness", "more").alias("path"), *beyond_columns)
    return above


# ------------------------------------------------------------- numbering
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of the task and the place within (task, grp)."""
    from pyspark import TaskContext

    part, last, place = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        places = []
        for g in batch.column("grp").to_pylist():
            place = place + 1 if g == last else 0
            last = g
            places.append(place)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(places, pa.int64())],
            names=[*batch.schema.names, "part", "place"])


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` (with a string column ``grp``) and their position ``pos`` in
    the order of their group, whose size is ``n``.

    One range partitioning by (grp, order), written with places counted in
    each task; one count a (task, group) then gives where a task's rows begin.
    The last key is the row's own number, so equal rows spread as well.
    """
    spread = F.monotonically_increasing_id()
    sorted_ = rows.withColumn("_spread", spread).repartitionByRange(F.col("grp"), *order, F.col("_spread")) \
        .sortWithinPartitions(F.col("grp"), *order, F.col("_spread")).drop("_spread")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_.schema)
    placed = stored(sorted_.mapInArrow(_counted, f"{schema}, part int, place long"))
    counts = placed.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy("grp")
    starts = counts.select(
        "grp", "part", F.sum("_rows").over(whole).alias("n"),
        (F.sum("_rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")).alias("_start"))
    return placed.join(starts, ["grp", "part"]).withColumn("pos", F.col("_start") + F.col("place")) \
        .drop("part", "place", "_start")


# -------------------------------------------------------------- manifest
def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf digest (hex) reaches along a path."""
    def step(acc, s):
        sibling = F.lower(F.hex(s["digest"]))
        return F.sha2(F.when(s["digest"].isNull(), acc).when(s["before"], F.concat(sibling, acc))
                      .otherwise(F.concat(acc, sibling)), 256)

    return F.aggregate(path, leaf, step)


def proof_digest(path: Column) -> Column:
    """SHA-256 over the digests of a path, as hex text, in order."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.lower(F.hex(s["digest"]))), ""), 256)


def leaves_of(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered): the leaf of every row, and the one that
    a row whose crc32(doc_id) is a multiple of 7 has with n_chars + 1 (else null)."""
    fields = {c: F.col(c) for c in FIELDS}
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    changed = F.when(hit, leaf_digest(fields | {"n_chars": F.col("n_chars") + 1}))
    return docs.select("doc_id", "lang", F.unhex(leaf_digest(fields)).alias("leaf"), F.unhex(changed).alias("tampered"))


def manifest(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, leaf, tampered, subroot, root, path), digests as hex text:
    ``path`` leads from the leaf to the root, one entry a level: whether the
    sibling stands before, and its digest (null: a node without a sibling)."""
    # the tree of null comes first; strings compare by their UTF-8 bytes
    grp = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    leaves = stored(leaves_of(docs).select(grp.alias("grp"), "doc_id", F.col("leaf").alias("digest"), "tampered"))
    inner = climb(numbered(leaves, F.col("doc_id").asc_nulls_first(), F.col("digest")), block)
    subroots = roots_of(inner, block).select(F.lit("").alias("grp"), F.col("grp").alias("tree"), F.col("root").alias("digest"))
    outer = climb(numbered(subroots, F.col("tree")), block)
    end = roots_of(outer, block).withColumn("more", F.array().cast(WITNESS))
    trees = stored(paths(outer, end, block)).select(
        F.col("tree").alias("grp"), F.col("path").alias("more"), F.col("digest").alias("subroot"), "root")
    return paths(inner, trees, block).select(
        "doc_id", *(F.lower(F.hex(c)).alias(n) for c, n in (("digest", "leaf"), ("tampered", "tampered"), ("subroot", "subroot"),
                                                            ("root", "root"))), "path")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents`` with each proof folded again, from the
    tampered leaf where there is one.  Nulls, ties, empty tables: see above."""
    m = manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    back = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    return m.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                    back.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


#: Hashes by levels; crc32 bit by bit over the digits of the id.
OP11_SQL = """WITH RECURSIVE f AS (
  SELECT doc_id, lang, n_chars, 'x' AS x,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(str_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda h, c: list_reduce(list_prepend(xor(h, c), CAST(range(8) AS BIGINT[])),
        lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295) % 7 = 0 AS hit
  FROM documents),
l AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) AS changed, coalesce(hit, false) AS hit FROM f),
p AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l
  WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf)),
inner_levels(lang, lvl, pos, n, digest) AS (
  SELECT lang, 0, pos, n, leaf FROM p
  UNION ALL SELECT lang, lvl + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
  FROM inner_levels WHERE n > 1 GROUP BY lang, lvl, pos // 2),
subroots AS (SELECT lang, lvl AS height, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n
  FROM inner_levels WHERE n = 1),
outer_levels(lvl, pos, n, digest) AS (
  SELECT 0, place, n, subroot FROM subroots
  UNION ALL SELECT lvl + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
  FROM outer_levels WHERE n > 1 GROUP BY lvl, pos // 2),
top AS (SELECT lvl AS height, digest AS root FROM outer_levels WHERE n = 1),
steps AS (
  SELECT p.lang, p.pos, k.lvl, xor(p.pos >> k.lvl, 1) < (p.pos >> k.lvl) AS before, s.digest
  FROM p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang, range(64) k(lvl)
  LEFT JOIN inner_levels s ON s.lang IS NOT DISTINCT FROM p.lang AND s.lvl = k.lvl AND s.pos = xor(p.pos >> k.lvl, 1) WHERE k.lvl < r.height
  UNION ALL SELECT p.lang, p.pos, 100 + k.lvl, xor(r.place >> k.lvl, 1) < (r.place >> k.lvl), s.digest
  FROM p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang, top t, range(64) k(lvl)
  LEFT JOIN outer_levels s ON s.lvl = k.lvl AND s.pos = xor(r.place >> k.lvl, 1) WHERE k.lvl < t.height),
paths AS (SELECT lang, pos, list(CASE WHEN before THEN digest ELSE '' END ORDER BY lvl) AS b,
    list(CASE WHEN before THEN '' ELSE coalesce(digest, '') END ORDER BY lvl) AS a, string_agg(digest, '' ORDER BY lvl) AS proof
  FROM steps GROUP BY lang, pos),
r AS (SELECT p.doc_id, p.leaf, s.subroot, t.root, sha256(coalesce(q.proof, '')) AS proof_sha256,
    CASE WHEN q.b IS NULL THEN CASE WHEN p.hit THEN p.changed ELSE p.leaf END
      ELSE list_reduce(list_prepend(CASE WHEN p.hit THEN p.changed ELSE p.leaf END, CAST(range(len(q.b)) AS VARCHAR[])),
        lambda h, i: sha256(q.b[CAST(i AS BIGINT) + 1] || h || q.a[CAST(i AS BIGINT) + 1])) END AS folded_root
  FROM p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang, top t
  LEFT JOIN paths q ON q.lang IS NOT DISTINCT FROM p.lang AND q.pos = p.pos)
SELECT *, folded_root = root AS verified FROM r"""
