"""WARC archives, their index, and what is read back."""

import gzip
import hashlib
import random

from pyspark.sql import functions as F

from logspark.llm import warc

PAGES = "page_id long, url string, html string"


def brute(rows):
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        ids = [p for p, _, h in rows if h == html and p is not None]
        first = min(ids) if ids and len(data) >= warc.FLOOR else None
        revisit = first is not None and page_id != first
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


ROWS = [(1, "https://www.Example.org:80/a?b#c", "x" * 100), (2, None, "x" * 100), (3, "no scheme at all", "x" * 99), (4, "http://e.org/x", "x" * 99),
        (None, "http://e.org/x", "x" * 100), (None, "http://e.org/y", None), (5, "http://e.org/x", ""), (6, "http://é.org/\r\nWARC-Type: x ", "é" * 50),
        (7, "http://e.org/x", "é" * 50), (7, "http://e.org/x", "é" * 50), (-8, "http://e.org/x", "z" * 300_000), (9, "http://e.org/x", "z" * 300_000),
        (10, "http://", "a\r\n\r\nb" * 40), (None, None, "only without an id " * 9), (None, None, "only without an id " * 9)]


def test_round_trip_of_odd_pages(sc, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = ROWS + [(100 + i, f"http://h{i % 7}.net/{rng.randrange(40)}", rng.choice(["hot " * 30, f"text {i} " * 20])) for i in range(300)]
    frame = sc.createDataFrame(rows, PAGES).withColumn("digest", F.lit("clash")).withColumn("first", F.lit(1)).repartition(5)
    frame.write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op12_capture_index(sc, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(brute(rows), key=key)


def test_empty_table(sc, tmp_path):
    sc.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op12_capture_index(sc, str(tmp_path)).collect() == []


def test_lookup_by_url_and_by_reference(sc, tmp_path):
    """All captures of a url, over several blocks and files; a revisit leads to
    the record that holds its payload; archives are plain gzip."""
    rows = [(i, f"http://a.org/{i % 3}", f"page {i % 50} " * 30) for i in range(5000)]
    pages = sc.createDataFrame(rows, PAGES).repartition(4)
    entries = warc.write_archives(pages, f"{tmp_path}/archives")
    index = warc.build_index(entries, f"{tmp_path}/index")
    parts = index.shards.collect()
    assert sum(r.entries for r in parts) == 5000 and sum(r.blocks for r in parts) >= 5
    ranges = sc.createDataFrame([warc.url_range("http://A.org/1"), warc.url_range("http://missing.org/")], "low string, high string")
    found = warc.fetch(warc.lookup(index, ranges), f"{tmp_path}/archives").collect()
    assert sorted(r.page_id for r in found) == list(range(1, 5000, 3))
    revisit = next(r for r in found if r.page_id == 4 + 50 * 30)
    assert (revisit.record_type, revisit.refers_to, revisit.payload) == ("revisit", 4, None)
    k = warc.capture_key("http://a.org/1", 4)
    first = warc.fetch(warc.lookup(index, sc.createDataFrame([(k, k)], "low string, high string")), f"{tmp_path}/archives").collect()
    assert [r.payload.decode() for r in first] == ["page 4 " * 30] and first[0].payload_digest == revisit.payload_digest
    for name in {r.archive for r in entries.select("archive").distinct().collect()}:
        assert gzip.open(f"{tmp_path}/archives/{name}").read().startswith(b"WARC/1.1\r\n")


def test_index_files_are_read_by_block(sc, tmp_path, monkeypatch):
    """A lookup decompresses the block that the directory names, no other."""
    keys = [(f"k{i:06d} ", "a", i, 1) for i in range(10 * warc.ENTRIES)]
    index = warc.build_index(sc.createDataFrame(keys, warc.ENTRY).coalesce(1), str(tmp_path))
    shards = [r for r in index.shards.collect() if r.first <= "k003333 " <= r.last]
    read = []
    plain = warc.read_block
    monkeypatch.setattr(warc, "read_block", lambda *a: read.append(a) or plain(*a))
    import pyarrow as pa

    asked = pa.RecordBatch.from_pylist([{"shard": shards[0].shard, "low": "k003333 ", "high": "k003333 "}])
    found = list(warc._found(str(tmp_path))([asked]))
    assert [b.to_pylist()[0]["offset"] for b in found] == [3333] and len(read) <= 2


def test_keys():
    assert warc.url_key("https://u@www.Example.org:80/a?b#c") == "org,example,www)/a?b"
    assert warc.url_key("http://e.org") == "org,e)/"
    assert warc.url_key(None) == "-" and warc.url_key("a b") == "a%20b"
    assert sorted([5, -3, None, 1 << 62], key=warc.stamp) == [None, -3, 5, 1 << 62]
