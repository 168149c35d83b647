"""URL filter by a Bloom filter cascade.

Rules (host, path) decide first; the longest that fits wins.  The other pages
are judged by their host's listing: a host is listed when more of its pages
are blocked by rules than allowed.  Listed hosts are not joined to the pages:
they are encoded in a Bloom filter, the hosts of the corpus that it takes for
listed by mistake in a second one, the listed hosts that the second one takes
for such mistakes in a third, and so on until a level makes no mistake.  Over
the corpus's own hosts the answer is exact: a key leaves at the first level
that does not hold it, listed if that level is an even one.

The levels shrink by LEAK each.  They are broadcast, so keys are dealt over as
many cascades (by hash) as keep a filter's keys below ``SHARD_KEYS``; each is
built and used in its own pass.

Defined results: a null url, or one without ``://``, has empty host and path;
an empty host is never listed; rows that repeat a page_id are judged alike;
other columns, whatever their names, are left behind.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm.common import stored

#: verdict, host, path (fixed values of the query)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: False positives that a level lets through, and keys that a filter holds at most.
LEAK, SHARD_KEYS = 0.05, 2_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    first = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(first):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


class Level(NamedTuple):
    words: np.ndarray  # int64 words of the bit array
    bits: int
    hashes: range


def _places(bits: int, hashes: range) -> Column:
    """Bit numbers of a key with hashes a, b."""
    return F.array(*((F.col("a") + F.lit(i) * F.col("b")) % F.lit(bits) for i in hashes))


def build_level(keys: DataFrame, n: int, number: int, leak: float = LEAK) -> Level:
    """Bloom filter of (a, b); the set bits are merged by word before they
    reach the driver, whose array is as large as the filter.  Each level has
    hash functions and a size of its own: keys that one level takes for each
    other must not meet again in all the following ones."""
    k = max(1, round(-math.log2(leak)))
    hashes = range(number * k, number * k + k)
    bits = max(64, math.ceil(n * k / math.log(2))) + number
    place = keys.select(F.explode(_places(bits, hashes)).alias("p"))
    words = place.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v"))
    out = np.zeros((bits + 63) // 64, np.int64)
    for w, v in words.collect():  # as many rows as the filter has words
        out[w] = v
    return Level(out, bits, hashes)


def holds(level: Level, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which keys the level holds, as far as it can tell."""
    out = np.ones(len(a), bool)
    for i in level.hashes:
        p = (a + i * b) % level.bits
        out &= (level.words[p >> 6] >> (p & 63)) & 1 == 1
    return out


def listed_by(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cascade's answer for keys of its universe."""
    out = np.zeros(len(a), bool)
    inside = np.arange(len(a))
    for number, level in enumerate(levels, 1):
        hit = holds(level, a[inside], b[inside])
        out[inside[~hit]] = number % 2 == 0
        inside = inside[hit]
    out[inside] = len(levels) % 2 == 1
    return out


def hashed(frame: DataFrame, key: str) -> DataFrame:
    """Adds two hashes of 48 bits, so that a + i * b stays a long."""
    return frame.withColumns({c: F.shiftrightunsigned(F.xxhash64(F.lit(c), F.col(key)), 16) for c in "ab"})


def build_cascade(universe: DataFrame, leak: float = LEAK) -> list[Level]:
    """Levels over ``universe`` (a, b, listed), one row per key."""
    sc = universe.sparkSession.sparkContext
    levels: list[Level] = []
    rest = universe
    inserted = True  # the side that the next level encodes
    while True:
        n = {r[0]: r[1] for r in rest.groupBy("listed").count().collect()}
        if not n.get(inserted):
            return levels
        level = build_level(rest.filter(F.col("listed") == inserted), n[inserted], len(levels), leak)
        levels.append(level)
        if not n.get(not inserted):
            return levels
        held = sc.broadcast(level)

        def left(batches, held=held, inserted=inserted):
            for batch in batches:
                a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in "ab")
                other = batch.column("listed").to_numpy(zero_copy_only=False) != inserted
                yield batch.filter(pa.array(~other | holds(held.value, a, b)))

        rest = stored(rest.mapInArrow(left, rest.schema))
        inserted = not inserted


def judge(pages: DataFrame, rules=RULES, leak: float = LEAK, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule, verdict."""
    url = F.col("url").cast("string")
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")) \
        .withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)) \
        .select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("verdict"))
    votes = F.sum(F.when(F.col("verdict") == "block", 1).when(F.col("verdict") == "allow", -1).otherwise(0))
    hosts = stored(hashed(parsed.groupBy("host").agg(votes.alias("votes")), "host")
                   .select("a", "b", ((F.col("votes") > 0) & (F.col("host") != "")).alias("listed")))
    keys = hosts.count()
    shards = max(1, math.ceil(keys / shard_keys))
    pages_ = hashed(parsed, "host")
    out = None
    for shard in range(shards):
        mine = (lambda f: f.filter(F.pmod(F.col("a"), F.lit(shards)) == shard)) if shards > 1 else (lambda f: f)
        held = pages.sparkSession.sparkContext.broadcast(build_cascade(mine(hosts), leak))

        def test(batches, held=held):
            for batch in batches:
                a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in "ab")
                yield batch.append_column("listed", pa.array(listed_by(held.value, a, b)))

        part = mine(pages_).mapInArrow(test, pages_.withColumn("listed", F.lit(True)).schema)
        out = part if out is None else out.union(part)
    return out.select("page_id", "host", "path", "rule",
                      F.coalesce("verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def op5_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP5_SQL = r"""
with cut as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
hosts as (
  select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from cut),
parts as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from hosts),
rules(verdict, h, p) as (
  values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
judged as (
  select s.*, (select max(struct_pack(n := length(h || p), rule := h || p, verdict := verdict)) from rules
               where (s.host = h or ends_with(s.host, '.' || h)) and starts_with(s.path, p)) as hit
  from parts s),
listed as (
  select host from judged where host <> '' group by host
  having count(*) filter (hit.verdict = 'block') > count(*) filter (hit.verdict = 'allow'))
select page_id, host, path, hit.rule as rule,
       coalesce(hit.verdict, case when host in (select host from listed) then 'block' else 'allow' end) as verdict
from judged
"""
