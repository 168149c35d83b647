"""Nulls, empty and very long texts, repeats, ties, clashing names, no rows."""

import hashlib

import pytest

import corpus_pipeline
from logspark.llm import bpe, jaccard, lattice, lines, lm, mixing, pii, quality, topk, urls
from tests.llm.conftest import DOCS, ODD

EMPTY = hashlib.sha256(b"").hexdigest()
LABELS = "doc_id long, quality int, toxic int"
VECTORS = "vec_id long, embedding array<float>, label int, id string, payload int, size int"
PAGES = "page_id long, url string, html string, host int, path int, rule int, listed string, a int, b int"


@pytest.fixture(scope="module")
def labels(sc):
    return sc.createDataFrame([(4, 1, 0), (5, 1, 0), (5, 0, 0), (7, 0, 0), (8, 0, None), (None, 1, 0), (9, None, 0), (99, 1, 0)], LABELS)


def by_id(df):
    return sorted(df.collect(), key=lambda r: (r[0] is None, r[0] or 0))


def test_quality(sc, odd, labels):
    got = quality.resample(odd, labels).collect()
    assert len(got) == len(ODD)
    w = {r.doc_id: r.log_weight for r in got}
    assert w[1] == w[2] == w[3] == 0.0
    assert w[7] < 0  # its one word is in no other document: little is known, and that speaks against it
    assert len({r.key for r in got if r.doc_id == 5}) == 2  # two texts, one of them twice
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got) > 0
    none = sc.createDataFrame([], LABELS)
    assert all(r.kept for r in quality.resample(odd, none).collect())
    assert quality.resample(odd.limit(0), labels).count() == 0


def test_quality_k(odd, labels):
    got = quality.resample(odd, labels, k=4).collect()
    keys = sorted((r.key for r in got), reverse=True)
    assert sorted(r.key for r in got if r.kept) == sorted(k for k in keys if k >= keys[3])
    assert not any(r.kept for r in quality.resample(odd, labels, k=0).collect())
    assert all(r.kept for r in quality.resample(odd, labels, k=100).collect())


def test_pii(odd):
    got = by_id(pii.personal_data(odd))
    assert len(got) == len(ODD)
    assert {r.doc_id: r.base_sha256 for r in got}[1] == EMPTY
    assert all(r.spans == "" and r.n_card == 0 for r in got if r.doc_id != 4)
    assert pii.personal_data(odd.limit(0)).count() == 0


def test_lines(odd):
    got = {(r.doc_id, r.n_lines): r for r in lines.line_report(odd).collect()}
    assert got[1, 1].n_dropped == 0 and got[10, 6].n_dropped == 0
    assert got[6, 1].dropped == [0]
    assert all(r.n_dropped == 0 for r in got.values() if r.doc_id == 5)
    out = lines.without_near_lines(odd)
    assert out.schema == odd.schema
    rows = out.collect()
    assert len(rows) == len(ODD)
    assert {r.doc_id: r.text for r in rows}[6] == "" and [r.text for r in rows if r.doc_id == 1] == [None]
    assert lines.line_report(odd.limit(0)).count() == 0


def test_jaccard(odd):
    got = by_id(jaccard.jaccard_join(odd))
    assert len(got) == len(ODD)
    one = {r.doc_id: r for r in got}
    assert (one[6].class_id, one[6].n_links, one[6].kept) == (5, 1, False)
    assert all(one[i].class_id == i and one[i].n_links == 0 and one[i].kept for i in (1, 2, 3, 4, 7, 8, 9, 10))
    assert (one[None].class_id, one[None].n_links, one[None].kept) == (None, 0, True)
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    assert jaccard.jaccard_join(odd.limit(0)).count() == 0


def test_mixing(odd, labels):
    weights = mixing.quality_weights(labels)
    got = mixing.mix(odd, weights).collect()
    assert len(got) == len(ODD)
    assert all(r.taken <= 2 * r.size for r in got)
    assert {r.source for r in got} == {"a", "b", "c", None}
    assert {r.size for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(odd, weights).collect()))
    out = mixing.mixed(odd, weights)
    assert out.columns == odd.columns
    assert out.count() == sum(r.copies for r in got)
    assert mixing.mix(odd.limit(0), weights).count() == 0
    nothing = odd.filter("doc_id in (1, 2)")
    assert [(r.target, r.taken) for r in mixing.mix(nothing, weights).collect()] == [(0.0, 0), (0.0, 0)]


def test_bpe(odd):
    path = bpe.tokenizer_path()
    got = by_id(bpe.digests(odd, path))
    assert len(got) == len(ODD)
    one = {r.doc_id: r for r in got}
    assert (one[1].n_tokens, one[1].ids_sha256, one[1].decoded_sha256) == (0, EMPTY, EMPTY)
    for i, t, _ in ODD:
        if i not in (5, None):
            assert one[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(odd.limit(0), path).count() == 0


def test_lm(odd):
    got = by_id(lm.score(odd))
    assert len(got) == len(ODD)
    one = {r.doc_id: r for r in got}
    assert (one[1].n_tokens, one[2].n_tokens, one[3].n_tokens, one[4].n_tokens) == (1, 1, 1, 60_001)
    assert one[1].score == one[2].score < 0
    five = [r for r in got if r.doc_id == 5]
    assert len(five) == 3 and len(set(five)) == 2  # two equal rows, and another text
    assert lm.score(odd.limit(0)).count() == 0


def test_vectors(sc):
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, None, 1), (4, [0.0, 0.0], 1), (5, [], 1),
            (6, [1.0, None], 1), (7, [1.0, float("nan")], 1), (8, [float("inf"), 1.0], 1), (9, [1.0, 0.0], None),
            (None, [1.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1e-30, 0.0], 1), (12, [3e38, 0.0], 1), (1, [2.0, 0.0], 1),
            (20, [1.0, 1.0], 1), (40, [1.0, 1.0], 1), (60, [-1.0, -1.0], 3)]
    df = sc.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS)
    got = by_id(lattice.near_vectors(df))
    assert len(got) == len(rows)
    one = {r.vec_id: r for r in got}
    assert [one[i].component_id for i in (0, 1, 11, 12)] == [0] * 4 and [one[i].n_links for i in (0, 1, 11, 12)] == [3] * 4
    assert all(one[i].component_id == i and one[i].n_links == 0 and one[i].kept for i in (2, 3, 4, 5, 6, 7, 8, 9, 10, 60))
    assert one[None].component_id is None and one[None].kept
    assert (one[40].component_id, one[40].n_links, one[40].kept) == (20, 1, False)
    assert lattice.near_vectors(df.limit(0)).count() == 0

    best = [tuple(r) for r in topk.top_k(df.filter("vec_id not in (11, 12)")).orderBy("query_id", "rank").collect()]
    assert [r[2:] for r in best if r[0] == 20] == [(1, 8192), (40, 8192), (0, 4096), (2, 4096), (9, 4096), (4, 0), (60, -8192)]
    assert [r[1] for r in best if r[0] == 20] == list(range(1, 8))
    assert {r[0] for r in best} == {0, 20, 40, 60}
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.filter("vec_id = 20")).count() == 0


def test_urls(sc):
    at = ["http://A.Example.ORG/es/x", "http://a.example.org/en/12?q", "https://x.com/fr/", "x.com/fr/", None, "", "http://", "://h",
          "http://org/", "http://norg/", "http://b.COM/de/1#f", "http://b.com/en/", "http://c.com/en/", "http://É.com/fr/\n://x/y", "http://org",
          "http://b.com/en/"]
    df = sc.createDataFrame([(i if i != 8 else None, u, "", 1, 2, 3, "x", 4, 5) for i, u in enumerate(at)], PAGES)
    got = {r.page_id: tuple(r)[1:] for r in urls.judge(df).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[1] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("x.com", "/fr/", "com/fr/", "allow")
    assert [got[i] for i in (3, 4, 5, 6)] == [("", "", None, "allow")] * 4
    assert got[7] == ("h", "", None, "allow") and got[None] == ("org", "/", "org/", "allow")
    assert got[9] == ("norg", "/", None, "allow") and got[14] == ("org", "", None, "allow")
    assert got[10] == ("b.com", "/de/1", "com/de/", "block")
    assert got[11] == got[15] == ("b.com", "/en/", None, "block")  # its host is listed
    assert got[12] == ("c.com", "/en/", None, "allow")
    assert got[13] == ("É.com", "/fr/\n://x/y", "com/fr/", "allow")
    assert urls.judge(df.limit(0)).count() == 0


def test_pipeline_stages(sc, odd, labels, tmp_path):
    odd.select(*[c.split()[0] for c in DOCS.split(", ")]).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, n = odd, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(sc, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out/{name}")
        docs = sc.read.parquet(f"{tmp_path}/out/{name}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == odd.columns, name
    assert all(r.round_trip for r in docs.collect())
    nothing = odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(sc, nothing, str(tmp_path)).count() == 0, name


def test_lines_of_repeated_ids(docs_of):
    """Texts under one id, or none, lose their own lines alone."""
    a, b, c = ("one line that is said in two of the texts", "another line that has nothing like it", "a third line of quite other words here")
    rows = [(None, f"{a}\n{b}"), (None, f"u\nv\n{c}\n{a}"), (None, "p\nq\nr\nclean and alone at that place"), (7, f"only\n{b}"), (7, f"x\n{b}")]
    out = {r.text for r in lines.without_near_lines(docs_of(rows)).collect()}
    assert out == {f"{a}\n{b}", f"u\nv\n{c}", "p\nq\nr\nclean and alone at that place", "only", "x"}
    assert sorted((r.doc_id or 0, r.dropped) for r in lines.line_report(docs_of(rows)).collect()) == \
        [(0, []), (0, []), (0, [3]), (7, [1]), (7, [1])]
    two = {r.text for r in lines.without_near_lines(docs_of([(7, f"x\n{b}"), (7, f"y\n{b}")])).collect()}
    assert two in ({f"x\n{b}", "y"}, {"x", f"y\n{b}"})


def test_one_of_each_of_repeated_ids(docs_of):
    """A text is not lost with another one of its doc_id."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (2, f"{a} more"), (2, b), (3, b), (4, f"{b}  "), (4, b)]
    got = sorted((r.doc_id, r.text) for r in jaccard.one_of_each(docs_of(rows)).collect())
    assert got == [(1, a), (2, b)]
    assert [r.doc_id for r in jaccard.one_of_each(docs_of([(4, f"{b}  "), (4, b)])).collect()] == [4]


def test_emptied_documents_leave_the_pipeline(sc, docs_of):
    a, b = "a line that is the only one of its documents", "some other line that only one document has"
    rows = [(1, a), (2, a), (3, f"{a}\n\n"), (4, f"{a}\n{b}"), (5, ""), (6, " \n"), (7, None)]
    got = corpus_pipeline.drop_lines(sc, docs_of(rows), "").collect()
    assert sorted((r.doc_id, r.text) for r in got if r.text) == [(1, a), (4, b), (6, " \n")]
    assert {r.doc_id for r in got} == {1, 4, 5, 6, 7}
