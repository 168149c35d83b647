"""Merkle manifest against a brute-force tree."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from logspark.llm import merkle
from tests.llm.conftest import DOCS


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded) of rows (doc_id, text, lang, source, n_chars)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: sorted(((r[0] is not None, r[0] or 0, leaf(r), r) for r in rows if r[2] == g), key=lambda t: t[:3]) for g in langs}
    inner = {g: levels([t[2] for t in ts]) for g, ts in trees.items()}
    outer = levels([inner[g][-1][0] for g in langs])
    out = []
    for place, g in enumerate(langs):
        for pos, (_, _, own, r) in enumerate(trees[g]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            acc, proof = leaf((*r[:4], None if r[4] is None else r[4] + 1)) if hit else own, ""
            for at, tree in ((pos, inner[g]), (place, outer)):
                for level in tree[:-1]:
                    pair = level[at - at % 2:at - at % 2 + 2]
                    other = [d for i, d in enumerate(pair) if i != at % 2]
                    proof += "".join(other)
                    acc = H("".join(acc if i == at % 2 else d for i, d in enumerate(pair)))
                    at //= 2
            out.append((r[0], own, inner[g][-1][0], outer[-1][0], H(proof), acc))
    return out


def of_spark(docs, block):
    m = merkle.manifest(docs, block)
    got = m.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("p"),
                   merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("f"))
    return [tuple(r) for r in got.collect()]


def key(row):
    return tuple((v is not None, v) for v in row)


@pytest.mark.parametrize("block", [1, 3, 10])
def test_manifest_against_brute_force(sc, block):
    """Trees of many blocks, of one leaf, without a lang; ids that repeat, that
    are missing; equal rows; odd texts."""
    rng = random.Random(block)
    rows = [(rng.choice([None, *range(90)]), rng.choice([None, "", "é😀", "x" * rng.randrange(50)]), rng.choice([None, "en", "en", "en", "dé"]),
             rng.choice([None, "a"]), rng.choice([None, 3, 10 ** 12])) for _ in range(150)]
    rows += [(7, "one leaf", "zz", "a", 1)] + [(5, "same", "en", "a", 2)] * 9 + [(8, "y" * 100_000, "en", "b", 100_000)]
    frame = sc.createDataFrame(rows, DOCS).withColumn("grp", F.lit("clash")).withColumn("pos", F.lit(-1)).withColumn("leaf", F.lit("z"))
    assert sorted(of_spark(frame, block), key=key) == sorted(brute(rows), key=key)


def test_small_tables(sc):
    empty = sc.createDataFrame([], DOCS)
    assert of_spark(empty, 10) == []
    one = [(1, None, None, None, None)]
    assert of_spark(sc.createDataFrame(one, DOCS), 10) == brute(one)


def test_appends_extend_witnesses():
    """After each append every witness leads to the root of its open subtree."""
    tree = merkle.Appender()
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(23)]
    for n, d in enumerate(digests, 1):
        tree.append(d)
        assert sum(1 << level for level, _, _ in tree.open) == n
        for (level, root, first), end in zip(tree.open, [f for _, _, f in tree.open[1:]] + [n]):
            for i in range(first, end):
                acc = digests[i]
                assert len(tree.witnesses[i]) == level
                for before, sibling in tree.witnesses[i]:
                    acc = merkle._digest(sibling.hex() + acc.hex() if before else acc.hex() + sibling.hex())
                assert acc == root
