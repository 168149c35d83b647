"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key, -ln(u) / weight, from a hash of its id
and text and its quality weight; sorted by key within its source, documents come in the
order of weighted sampling without replacement.  A source's target is met by
complete epochs (every document once) first, then by the documents whose
running word count stays within what is left (a document counts from its
middle on, so the sum ends within half a document of the target).

Only DataFrame functions.  The running count of a source is split: keys fall
into bins of bounded size, totals per bin give each bin's start, and windows
run inside (source, bin) only, so a source with a third of all rows is many
small tasks.  The one window without partition runs over one row per source.

Defined results: a null text has size 0; sizes count runs of anything but
ASCII white space; a null source is a source, sorted last; a null or
non-positive weight counts as the default; rows without a doc_id, or with one
that other texts have, are documents of their own; rows that agree in doc_id,
source and text tie and share one decision; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logspark.llm.common import stored

#: Cycle of source weights, in order of the source's name, and the size of the
#: mix as a share of all words; a source is repeated at most REPEATS times.
CYCLE, SHARE, REPEATS = (3, 1, 2), 1.5, 2
#: Quality weight by label; documents without one get DEFAULT_WEIGHT.
GOOD_WEIGHT, BAD_WEIGHT, DEFAULT_WEIGHT = 1.0, 0.25, 0.5
#: Rows that a bin holds about.
BIN_ROWS = 20_000
SEED = 8
WORD = r"[^\x20\x09-\x0D]+"


def text_hash() -> Column:
    """MD5 of the whole text, null as empty."""
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))


def uniform(column: str, digest: str, seed: int = SEED) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 of id, text and seed."""
    text = F.concat_ws(":", F.coalesce(F.col(column).cast("string"), F.lit("")), F.col(digest), F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sources: DataFrame) -> DataFrame:
    """Adds ``target`` to (source, source_size, ...), one row per source.

    Sources share SHARE of all words by weight, none above REPEATS times its
    size; what is cut off is shared again.  Ordered by cap / weight the capped
    sources come first, so running sums give the final level at once: it is
    the greatest of the levels that hold before each source.
    """
    cycle = F.array(*(F.lit(float(w)) for w in CYCLE))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    every = Window.partitionBy()
    before = Window.orderBy("ratio", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0.0)
    return sources \
        .withColumn("share", F.element_at(cycle, (rank % len(CYCLE) + 1).cast("int"))) \
        .withColumn("cap", F.col("source_size") * float(REPEATS)) \
        .withColumn("ratio", F.col("cap") / F.col("share")) \
        .withColumn("level", (F.sum("source_size").over(every) * SHARE - F.coalesce(F.sum("cap").over(before), none))
                    / (F.sum("share").over(every) - F.coalesce(F.sum("share").over(before), none))) \
        .withColumn("level", F.max("level").over(every)) \
        .withColumn("target", F.least("cap", F.col("level") * F.col("share"))) \
        .drop("share", "cap", "ratio", "level")


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) from quality labels; a document labelled good by any
    row is good."""
    return labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")) \
        .agg(F.when(F.max("quality") >= 1, GOOD_WEIGHT).otherwise(BAD_WEIGHT).alias("weight"))


def mix(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size,
    target, taken, copies, digest (of the text)."""
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"), text_hash().alias("digest"))
    good = F.when(F.col("weight") > 0, F.col("weight")).otherwise(DEFAULT_WEIGHT)
    keyed = stored(sized.join(weights.select("doc_id", "weight"), "doc_id", "left")
                   .withColumn("weight", good).withColumn("key", -F.log(uniform("doc_id", "digest")) / F.col("weight")))
    of_source = targets(keyed.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), F.min("weight").alias("least"))) \
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)) \
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")) \
        .withColumn("bins", F.ceil(F.col("n") / BIN_ROWS)).drop("n")
    of_source = of_source.withColumnRenamed("source", "_source")
    # 1 - exp(-least * key) is close to even over (0, 1): no bin holds more than
    # the ratio of the weights times its share
    binned = keyed.join(of_source, keyed["source"].eqNullSafe(of_source["_source"])).drop("_source") \
        .withColumn("bin", F.least(F.col("bins") - 1, F.floor((1 - F.exp(-F.col("least") * F.col("key"))) * F.col("bins"))))
    starts = binned.groupBy("source", "bin").agg(F.sum("size").alias("held"))
    starts = starts.select(
        F.col("source").alias("_source"), F.col("bin").alias("_bin"),
        F.coalesce(F.sum("held").over(Window.partitionBy("source").orderBy("bin")
                                      .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "digest")  # equal rows are peers
    summed = binned.withColumn("within", F.sum("size").over(inside))
    placed = summed.join(starts, summed["source"].eqNullSafe(starts["_source"]) & (summed["bin"] == starts["_bin"]))
    chosen = F.col("start") + F.col("within") - F.col("size") / 2 <= F.col("rest")
    copies = (F.col("epochs") + F.when(chosen & (F.col("rest") > 0), 1).otherwise(0)).cast("long")
    return placed.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "digest")


def mixed(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its
    own columns.  A row finds its decision by doc_id, source and text; no such
    key holds more rows than repeat one document, without an id or with one."""
    times = mix(docs, weights).filter("copies > 0").groupBy(*(F.col(c).alias(f"__mix_{c}") for c in ("doc_id", "source", "digest"))) \
        .agg(F.max("copies").cast("int").alias("__mix_copies"))
    own = docs.withColumn("__mix_text", text_hash())
    same = docs["doc_id"].cast("long").eqNullSafe(times["__mix_doc_id"]) & docs["source"].cast("string").eqNullSafe(times["__mix_source"])
    return own.join(times, same & (F.col("__mix_text") == F.col("__mix_digest"))) \
        .select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))).alias("__mix_copy")).drop("__mix_copy")


def op8_weighted_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = spark.read.parquet
    return mix(read(f"{sf_dir}/documents.parquet"), quality_weights(read(f"{sf_dir}/labels.parquet"))).drop("digest")


OP8_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5(coalesce(text, '')) as digest
  from documents),
marks as (
  select doc_id, case when max(quality) >= 1 then 1.0::double else 0.25::double end as weight
  from labels where doc_id is not null and quality is not null group by doc_id),
keyed as (
  select s.*, -ln((('0x' || substr(md5(coalesce(s.doc_id::varchar, '') || ':' || s.digest || ':8'), 1, 13))::bigint + 0.5) / 4503599627370496.0::double)
              / coalesce(m.weight, 0.5::double) as key
  from sized s left join marks m on s.doc_id = m.doc_id),
sources as (
  select source, sum(size)::bigint as source_size,
         [3.0, 1.0, 2.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as share
  from keyed group by source),
levels as (
  select *, (sum(source_size) over () * 1.5
             - coalesce(sum(2 * source_size) over (order by 2 * source_size / share, source nulls last
                                                   rows between unbounded preceding and 1 preceding), 0))
          / (sum(share) over () - coalesce(sum(share) over (order by 2 * source_size / share, source nulls last
                                                   rows between unbounded preceding and 1 preceding), 0)) as level
  from sources),
targets as (
  select source, source_size, least(2.0 * source_size, max(level) over () * share)::double as target from levels),
parts as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from targets),
placed as (
  select k.doc_id, k.source, k.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size as rest,
         sum(k.size) over (partition by k.source order by k.key, k.doc_id, k.digest) as upto
  from keyed k join parts p on k.source is not distinct from p.source),
chosen as (
  select *, (epochs + case when upto - size / 2.0 <= rest and rest > 0 then 1 else 0 end)::bigint as copies from placed)
select doc_id, source, size, source_size, target, (size * copies)::bigint as taken, copies from chosen
"""
