"""N-gram Jaccard join by MinHash banding.

Words are runs without ASCII white space, ASCII letters lower-cased; an
n-gram is ``NGRAM`` words in a row (a shorter text is one n-gram as a whole).
Documents with equal words are copies and form one class; classes are linked
when the Jaccard similarity of their n-gram sets is at least ``SIMILARITY``.

Each class gets a MinHash signature; the number of bands and rows is chosen so
that a pair at the threshold meets in a band with probability ``RECALL`` at
least.  Classes that meet are verified on their full n-gram sets (64-bit
hashes of all n-grams).  A dense group is verified block against block inside
tasks (``near``), so thousands of near copies make no rows of pairs.

Defined results: a null or wordless text links with nothing, not even its
like; links count distinct ids; texts that share a doc_id are judged each on
their own, told apart by a 64-bit hash; of a class's texts under its smallest
doc_id ``one_of_each`` keeps one, in all rows that repeat it whole; a null
doc_id takes no part: no class id, no links, kept.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm.common import drop, may_hold, pieces, stored, texts_of
from logspark.llm.near import classes, links

NGRAM = 5
SIMILARITY = 0.8
RECALL = 0.999
#: Hashes in a signature at most; the rows of a band are as many as these allow.
HASHES = 128

SPACE = " \t\n\v\f\r"
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ" + SPACE[1:], "abcdefghijklmnopqrstuvwxyz" + " " * 5)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def banding(similarity: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows, and then the fewest bands, that reach
    ``recall`` at ``similarity`` with ``hashes`` values at most."""
    best = None
    for rows in range(1, hashes + 1):
        for bands in range(1, hashes // rows + 1):
            if 1 - (1 - similarity ** rows) ** bands >= recall:
                best = bands, rows
                break
    if best is None:
        raise ValueError("no banding reaches this recall; allow more hashes")
    return best


class _Words(dict):
    """Word -> 64-bit hash, forgotten when it grows beyond a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 17:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str) -> list[str]:
    return [w for w in text.translate(_FOLD).split(" ") if w]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(words: list[str], hashes: dict, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct hashes of all n-grams."""
    h = np.array([hashes[w] for w in words], np.uint64)
    size = max(1, min(n, len(h)))
    total = np.full(max(0, len(h) - size + 1), size, np.uint64)
    for k in range(size):
        total = total * _MIX + h[k:k + len(total)]
    return np.unique(_mixed(total))


def band_keys(grams: np.ndarray, bands: int, rows: int, seed: int = 7) -> np.ndarray:
    """One 64-bit key for each band of the MinHash signature."""
    odd = np.random.default_rng(seed).integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 2048):  # a very long text is hashed part by part
        part = grams[at:at + 2048, None] * odd
        np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=0), out=least)
    key = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        key = _mixed(key * _MIX + column)
    return key


def signed_docs(docs: DataFrame, bands: int, rows: int, n: int = NGRAM) -> DataFrame:
    """(doc_id, h, id, keys): the class of a document's words and its band keys;
    id is null for a text without words."""
    def sign(batches):
        hashes = _Words()
        for batch in pieces(batches):
            ids, keys, ends = [], [np.zeros(0, np.uint64)], [0]
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                ids.append(_class(words) if words else None)
                if words:
                    keys.append(band_keys(ngrams(words, hashes, n), bands, rows))
                ends.append(ends[-1] + bands * bool(words))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("h"), pa.array(ids, pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))],
                names=["doc_id", "h", "id", "keys"])

    return docs.mapInArrow(sign, "doc_id long, h long, id long, keys array<long>")


def _class(words: list[str]) -> int:
    h = xxhash.xxh3_64_intdigest(" ".join(words))
    return h - (1 << 64) if h >> 63 else h


def _gram_items(docs: DataFrame, weights: DataFrame, n: int) -> Callable:
    """Candidate classes with their number of documents and their n-gram sets."""
    def items(bits):
        def name(batches):
            for batch in pieces(batches):
                text = batch.column("text").to_pylist()
                ids = [_class(w) if (w := words_of(t)) else None for t in text]
                known = np.flatnonzero([i is not None for i in ids])
                at = known[may_hold(bits.value, np.array([ids[i] for i in known], np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at], pa.int64()), batch.column("text").take(pa.array(at))],
                                                 names=["id", "text"])

        def grams(batches):
            hashes = _Words()
            for batch in pieces(batches):
                sets = [ngrams(words_of(t), hashes, n).tobytes() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("weight"), pa.array(sets, pa.binary())],
                                                 names=["id", "weight", "payload"])

        return docs.select("text").mapInArrow(name, "id long, text string").dropDuplicates(["id"]).join(weights, "id").select("id", "weight", "text") \
            .mapInArrow(grams, "id long, weight long, payload binary")
    return items


def check_jaccard(similarity: float) -> Callable:
    """Links among the n-gram sets of one group (see ``near.Check``)."""
    def check(payloads: list[bytes], left: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        sets = [np.frombuffer(p, np.uint64) for p in payloads]
        sizes = np.array([len(s) for s in sets])
        if len(sets) == 2:
            common = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))], [0, 0]], float)
        else:
            owner = np.repeat(np.arange(len(sets)), sizes)
            values = np.concatenate(sets)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
            times = np.diff(np.r_[starts, len(values)])
            column = np.repeat(np.arange(len(starts)), times)
            shared = times[column] > 1  # a gram of one set adds nothing in common
            owner, column = owner[shared], column[shared]
            _, column = np.unique(column, return_inverse=True)
            common = np.zeros((len(sets), len(sets)), np.float32)
            for at in range(0, int(column.max(initial=-1)) + 1, 1 << 13):
                here = slice(*np.searchsorted(column, [at, at + (1 << 13)]))
                part = np.zeros((len(sets), 1 << 13), np.float32)
                part[owner[here], column[here] - at] = 1
                common += part @ part.T
        joined = sizes[:, None] + sizes[None, :] - common
        link = np.triu(common >= similarity * joined - 1e-9, 1)
        if left is not None:
            link &= left[:, None] != left[None, :]
        return np.nonzero(link)
    return check


def _hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _judged(docs: DataFrame, similarity: float, n: int, recall: float) -> DataFrame:
    """(doc_id, h, id, class_id, class_h, n_links) of each row; class_id and
    class_h are the first document of its class, null for one without."""
    bands, rows = banding(similarity, recall, HASHES)
    text = texts_of(docs, F.col("doc_id").cast("long").alias("doc_id"), _hash().alias("h"))
    signed = stored(signed_docs(text, bands, rows, n))
    named = signed.filter("id is not null and doc_id is not null")
    copies = stored(named.groupBy("id", "doc_id").agg(F.min("h").alias("h")).groupBy("id")
                    .agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("doc_id", "h")).alias("first")))
    found = links(named.select("id", "keys"), _gram_items(text, copies.select("id", "weight"), n), check_jaccard(similarity))
    near = classes(found)
    known = stored(copies.join(near, "id", "left").select(
        "id", "first", F.coalesce("component", "id").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    drop(copies, near)
    least = known.groupBy("component").agg(F.min("first").alias("least"))
    of_class = known.join(least, "component").select("id", F.col("least.doc_id").alias("class_id"), F.col("least.h").alias("class_h"), "n_links")
    return signed.select("doc_id", "h", "id").join(of_class, "id", "left")


def jaccard_join(docs: DataFrame, similarity: float = SIMILARITY, n: int = NGRAM, recall: float = RECALL) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id (smallest doc_id that
    links or copies reach), n_links (other documents linked to it directly,
    copies included), kept (it is its class's smallest)."""
    return _judged(docs, similarity, n, recall).select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.coalesce(F.coalesce("class_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each class does."""
    gone = _judged(docs, similarity, NGRAM, RECALL).filter("doc_id <> class_id or h <> class_h") \
        .select(F.col("doc_id").alias("__copy_of"), F.col("h").alias("__copy_h")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["__copy_of"]) & (_hash() == gone["__copy_h"]), "left_anti")


def op9_minhash_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
with recursive words as (
  select doc_id, [w for w in regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+')
           if w <> ''] as w
  from documents where doc_id is not null),
grams as (
  select distinct doc_id, unnest([array_to_string(w[i:i + 4], ' ') for i in range(1, greatest(len(w) - 4, 1) + 1)]) as g
  from words where len(w) > 0),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
common as (
  select a.doc_id as u, b.doc_id as w, count(*) as c
  from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
links as (
  select u, w from common join sizes x on x.doc_id = u join sizes y on y.doc_id = w where c >= 0.8 * (x.n + y.n - c)),
reach(u, w) as (
  select doc_id, doc_id from sizes union select r.u, l.w from reach r join links l on r.w = l.u),
least as (select u, min(w) as class_id from reach group by u),
degree as (select u, count(*) as n from links group by u)
select d.doc_id, coalesce(l.class_id, d.doc_id) as class_id, coalesce(g.n, 0)::bigint as n_links,
       coalesce(l.class_id, d.doc_id) = d.doc_id as kept
from documents d left join least l on d.doc_id = l.u left join degree g on d.doc_id = g.u
"""
