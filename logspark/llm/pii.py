"""Personal data: base patterns, and bootstrapped contextual extraction.

Base spans are the leftmost, non-overlapping matches of one pattern per kind
over the whole text; matches that fail the kind's test are dropped without
another try.  They are the seeds of the method: words that hold a digit or an
``@`` are candidate instances, and the words around them are lexical patterns
(left word, right word, both).  Pattern-instance edges are scored in turns:

* a pattern's confidence for a kind is the mean score of its instances;
* patterns with ``SUPPORT`` seeds and ``CONFIDENCE`` or more are trusted;
* a new instance scores 1 - product(1 - confidence) over its trusted patterns.

After ``ROUNDS`` turns, instances of ``CONFIDENCE`` or more are identifiers
that no base pattern knew; they add spans of their kind, the base spans stay.

Only DataFrame functions.  Spans are rows, never arrays that grow with a
corpus; positions are running sums inside one document.  Join and grouping
keys are patterns and instances; counts are aggregated before the shuffle and
only trusted patterns are joined back, so a frequent context stays a counter.

Defined results: a null text is empty; positions are code points, end
exclusive; rows that agree in doc_id and text share their spans; a null
doc_id is a value like any other; without seeds nothing is added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logspark.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
# The possessive forms match what the plain ones do (nothing that follows could
# make them give back), and the look-behind skips starts inside a run that its
# own start has already failed; \G lets a match begin where the last one ended.
PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP_TEST = rf"^{_PART}(?:\.{_PART}){{3}}$"

#: A word that holds a digit or an @.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
SUPPORT, CONFIDENCE, ROUNDS = 5, 0.8, 3
#: Characters of context that are looked at on each side.
AROUND = 64
#: An added identifier has this many characters at least.
LEAST = 5


def valid(kind: str, m: Column) -> Column:
    """The kind's test of a match."""
    if kind == "ip":
        return m.rlike(IP_TEST)
    if kind == "card":
        digits = F.translate(m, " -", "")
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _matches(text: Column, tag: int, pattern: str, gate: Column) -> Column:
    """array of (kind, no, gap, match, tail, ahead): each match, the length of
    the text between it and the match before it, and the text on both sides."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    def part(x, i, ahead):  # one end of a gap or match, blank beyond the text
        return F.coalesce(F.substring(F.get(x, i), *((1, AROUND) if ahead else (-AROUND, AROUND))), F.lit(""))

    def row(x, i):  # what stands around is read from the text, across the matches beside
        gaps, found = x["gaps"], x["found"]
        tail = F.concat(part(gaps, i - 1, False), part(found, i - 1, False), part(gaps, i, False))
        # a part cut off at its end goes on elsewhere: nothing is read behind it
        whole = F.length(F.get(gaps, i + 1)) <= AROUND
        ahead = F.concat(part(gaps, i + 1, True), F.when(whole, F.concat(part(found, i + 1, True), F.when(
            F.length(F.get(found, i + 1)) <= AROUND, part(gaps, i + 2, True)).otherwise(""))).otherwise(""))
        return F.struct(F.lit(tag).alias("kind"), i.alias("no"), F.length(F.get(gaps, i)).alias("gap"), F.get(found, i).alias("match"),
                        F.substring(tail, -AROUND, AROUND).alias("tail"), F.substring(ahead, 1, AROUND).alias("ahead"))

    both = F.struct(found.alias("found"), gaps.alias("gaps"))
    one = F.transform(F.array(both), lambda x: F.transform(x["found"], lambda _, i: row(x, i)))
    none = F.array().cast("array<array<struct<kind:int,no:int,gap:int,match:string,tail:string,ahead:string>>>")
    return F.flatten(F.when(gate, one).otherwise(none))


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, h, kind, match, start, end, tail, ahead) of all base matches
    (kind 0-3, not yet tested) and candidate words (kind 4)."""
    text = F.col("text")
    digit = text.rlike("[0-9]")
    gates = {k: digit & text.contains(NEEDS[k]) if NEEDS[k] else digit for k in KINDS} | {"email": text.contains("@")}
    parts = [_matches(text, i, PATTERN[k], gates[k]) for i, k in enumerate(KINDS)]
    parts.append(_matches(text, len(KINDS), CANDIDATE, digit | text.contains("@")))
    rows = docs.filter(digit | text.contains("@")).select("doc_id", "h", F.inline(F.concat(*parts))) \
        .dropDuplicates(["doc_id", "h", "kind", "no"])
    upto = Window.partitionBy("doc_id", "h", "kind").orderBy("no")
    sized = rows.select("doc_id", "h", "kind", "no", "match", F.length("match").alias("size"), "gap", "tail", "ahead")
    return sized.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto).cast("int")).select(
        "doc_id", "h", "kind", "match", "tail", "ahead", (F.col("end") - F.col("size")).alias("start"), "end")


def _named(word: Column) -> Column:
    """A context word: lower case, digits alike; a blank one is a text's edge."""
    return F.when(word == "", F.lit("|")).otherwise(F.regexp_replace(F.lower(word), "[0-9]", "9"))


def _tests() -> Column:
    return reduce(lambda a, b: a | b, ((F.col("kind") == i) & valid(k, F.col("match")) for i, k in enumerate(KINDS)))


def instances(found: DataFrame) -> DataFrame:
    """What the method sees: base spans (seed: their kind) and the candidate
    words that touch none (seed: null), each with value, span and patterns."""
    rows = found.filter(_tests() | (F.col("kind") == len(KINDS)))
    is_span = F.col("kind") < len(KINDS)
    order = Window.partitionBy("doc_id", "h").orderBy("start", F.col("kind"))
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("last", F.max(F.when(is_span, F.col("end"))).over(before)) \
        .withColumn("next", F.min(F.when(is_span, F.col("start"))).over(after)) \
        .filter(is_span | ~(F.coalesce(F.col("last") > F.col("start"), F.lit(False))
                            | F.coalesce(F.col("next") < F.col("end"), F.lit(False))))
    glued = F.when(is_span, F.lit("")).otherwise(F.regexp_extract("match", r"^([^\s0-9@=:]+[=:])[^\s=:]", 1))
    inner = F.substring(F.col("match"), F.length(glued) + 1, F.length("match"))  # name=value: the name is context
    bare = F.regexp_replace(F.regexp_replace(inner, r"^[^\p{L}\p{N}@+]++", ""), r"[^\p{L}\p{N}]++$", "")
    skipped = F.length(F.regexp_extract(inner, r"^([^\p{L}\p{N}@+]*+)", 1))
    left = F.when(glued != "", F.lower(glued)).otherwise(_named(F.regexp_extract("tail", r"(\S++)\s*+$", 1)))
    right = _named(F.regexp_extract("ahead", r"^\s*+(\S++)", 1))
    start = F.when(is_span, F.col("start")).otherwise(F.col("start") + F.length(glued) + skipped).cast("int")
    return rows.select(
        "doc_id", "h", start.alias("start"), F.when(is_span, F.col("match")).otherwise(bare).alias("value"),
        F.when(is_span, F.col("kind")).alias("seed"), left.alias("left"), right.alias("right")) \
        .filter("value <> ''").select(
        "doc_id", "h", "start", (F.col("start") + F.length("value")).cast("int").alias("end"), "value", "seed",
        F.array(F.concat(F.lit("l "), "left"), F.concat(F.lit("r "), "right"),
                F.concat(F.lit("b "), "left", F.lit(" "), "right")).alias("patterns"))


def bootstrap(cases: DataFrame) -> DataFrame:
    """(value, kind) of the identifiers that trusted patterns discover."""
    edges = stored(cases.select(F.explode("patterns").alias("pattern"), "value", "seed")
                   .groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    size = stored(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count("seed").alias("seeds"))
                  .filter(F.col("seeds") >= SUPPORT))
    seeds = edges.filter("seed is not null").select("value", F.col("seed").alias("kind")).distinct() \
        .withColumn("score", F.lit(1.0))
    known, new = seeds, None
    for _ in range(ROUNDS):
        scored = edges.join(known.select("value", "kind", "score"), "value") \
            .groupBy("pattern", "kind").agg(F.sum("score").alias("sum"))
        trusted = scored.join(size, "pattern").withColumn("confidence", F.least(F.lit(0.999), F.col("sum") / F.col("n"))) \
            .filter(F.col("confidence") >= CONFIDENCE).select("pattern", "kind", "confidence")
        new = stored(edges.filter("seed is null").join(trusted, "pattern").groupBy("value", "kind")
                     .agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
                     .join(seeds.select("value").distinct(), "value", "left_anti"))
        known = seeds.union(new.select("value", "kind", "score"))
    best = F.max(F.struct("score", (-F.col("kind")).alias("k")))
    return new.groupBy("value").agg(best.alias("b")).filter(F.col("b.score") >= CONFIDENCE) \
        .select("value", (-F.col("b.k")).cast("int").alias("kind"))


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, h, kind, start, end, added) of every span of (doc_id, h, text)."""
    found = stored(matches(docs))
    base = found.filter(_tests()).select("doc_id", "h", "kind", "start", "end", F.lit(False).alias("added"))
    cases = stored(instances(found))
    able = F.length("value") >= LEAST
    added = cases.filter(F.col("seed").isNull() & able).join(bootstrap(cases), "value") \
        .select("doc_id", "h", "kind", "start", "end", F.lit(True).alias("added"))
    return base.union(added)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone
    (base spans), base_sha256, spans (all), n_added."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")) \
        .withColumn("h", F.xxhash64("text"))
    names = F.array(*(F.lit(k) for k in KINDS))
    said = lambda x: F.array_join(F.transform(F.sort_array(x), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    one = F.struct("start", "kind", "end")
    of_doc = spans(rows).groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(
        *(F.count(F.when((F.col("kind") == i) & ~F.col("added"), 1)).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        said(F.collect_list(F.when(~F.col("added"), one))).alias("base"), said(F.collect_list(one)).alias("spans"),
        F.count(F.when(F.col("added"), 1)).alias("n_added"))
    light = rows.select("doc_id", "h")
    zero = F.lit(0).cast("long")
    return light.join(of_doc, light["doc_id"].eqNullSafe(of_doc["_id"]) & (light["h"] == of_doc["_h"]), "left").select(
        "doc_id", *(F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in KINDS),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_added", zero).alias("n_added"))


def op2_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
