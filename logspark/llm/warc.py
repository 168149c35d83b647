"""Operator 12: WARC archives and a two-level capture index.

``write_archives`` writes one record a page into WARC 1.1 files, each record a
gzip member of its own.  Of pages with the same payload (FLOOR bytes at least)
the one with the smallest page_id is a response, the others are revisits that
name it and hold no payload.  Each task writes its own files, under names that
no other attempt uses, and starts a new one at ARCHIVE bytes; a file counts
once its task's entries are committed, so what a lost task leaves behind is
never read.

``build_index`` sorts the captures by reversed-host URL key (``com,example)/a``)
and stamp (the page_id, 20 digits), cuts them into compressed blocks of ENTRIES
lines, and keeps a sparse directory beside each index file: the first key,
offset and length of every block.

``lookup`` finds captures: the first keys of the index files tell the file (one
row a file on the driver), a binary search in its directory the block, one
range read brings that block, a second binary search the lines.  ``fetch`` then
range-reads the records themselves.  Lookups are sorted by key, fetches by
archive and offset, both dealt evenly over the tasks whatever host they ask for.

A page's payload is shuffled once, to meet what is known of its digest.  Digests
that more than one row in HOT has are at most HOT, are broadcast, and their
revisits leave their payload behind; no other digest has more than 1/HOT of the
rows.

Defined results.  A null html is an empty payload; a null url has the key ``-``.
A page without an id counts after all ids; rows that repeat the smallest
page_id of a payload are all responses.  Control characters in a url are
percent-encoded in the record and the key, urls without ``://`` are keys as they
are.  Texts of any length are one record; other columns do not matter.  An empty
table gives no archives and an empty index.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm.common import pieces, stored
from logspark.session import checkpoint_dir

FLOOR = 100             # bytes; shorter payloads are always written
ARCHIVE = 256 << 20     # bytes after which a task starts a new archive
ENTRIES = 1024          # captures a block
LEVEL = 4               # of zlib
READ = 1 << 20          # bytes of an archive read at a time
LOOKUPS = 50_000        # lookups a task
FETCHED = 32 << 20      # bytes of archives a task
HOT = 1000
DATE = "1970-01-01T00:00:00Z"  # pages hold no time of capture


# ------------------------------------------------------------- file access
def _open_folder(uri: str):
    """(file system, path) of a folder that driver and executors share."""
    from pyarrow import fs

    if "://" not in uri or uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + re.sub(r"^file:", "", uri).lstrip("/")
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


# ------------------------------------------------------------------- keys
def _escaped(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", text)


def url_key(url: str | None) -> str:
    """``https://www.Example.org:80/a?b#c`` -> ``org,example,www)/a?b``."""
    if url is None:
        return "-"
    _, found, rest = url.partition("://")
    if not found:
        return _escaped(url)
    rest = rest.partition("#")[0]
    host = re.split(r"[/?]", rest, maxsplit=1)[0]
    name = host.rpartition("@")[2].partition(":")[0].lower()
    return _escaped(",".join(reversed(name.split("."))) + ")" + (rest[len(host):] or "/"))


def stamp(page_id: int | None) -> str:
    """Twenty digits in the order of the ids; a page without one comes first."""
    return "" if page_id is None else f"{page_id + (1 << 63):020d}"


def capture_key(url: str | None, page_id: int | None) -> str:
    return f"{url_key(url)} {stamp(page_id)}"


def record_id(page_id: int | None, digest: str) -> str:
    return uuid.UUID(hashlib.md5(f"{page_id}:{digest}".encode()).hexdigest()).urn


# ---------------------------------------------------------------- records
class Record(NamedTuple):
    page_id: int | None
    uri: str | None
    record_type: str
    refers_to: int | None
    payload_bytes: int
    payload_digest: str
    payload: bytes | None   # None: a revisit, the payload is that of refers_to


def record_bytes(r: Record, refers_uri: str | None = None) -> bytes:
    """One gzip member that holds the record."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r.payload_bytes}\r\n\r\n").encode()
    block = http + (r.payload or b"")
    own = record_id(r.page_id, r.payload_digest)
    fields = [("WARC-Type", r.record_type), ("WARC-Record-ID", f"<{own}>"), ("WARC-Date", DATE),
              ("WARC-Target-URI", _escaped(r.uri) if r.uri is not None else own),
              ("WARC-Payload-Digest", f"sha256:{r.payload_digest}")]
    if r.page_id is not None:
        fields.append(("Page-ID", str(r.page_id)))
    if r.record_type == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", f"<{record_id(r.refers_to, r.payload_digest)}>"), ("Refers-To-Page-ID", str(r.refers_to))]
        if refers_uri is not None:
            fields.append(("WARC-Refers-To-Target-URI", _escaped(refers_uri)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return _member(head.encode() + block + b"\r\n\r\n")


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, wbits=31)
    return z.compress(data) + z.flush()


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return dict(line.split(": ", 1) for line in lines if ": " in line)


def parse_record(member: bytes) -> Record:
    """The record of a gzip member.  Length and digest of a response are those
    of the payload as read; it is an error if the header says otherwise."""
    data = zlib.decompress(member, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    f = _fields(head)
    http, _, payload = rest[:int(f["Content-Length"])].partition(b"\r\n\r\n")
    said = f["WARC-Payload-Digest"].removeprefix("sha256:")
    page_id = int(f["Page-ID"]) if "Page-ID" in f else None
    length = int(_fields(http)["Content-Length"])
    if f["WARC-Type"] == "revisit":
        return Record(page_id, f["WARC-Target-URI"], "revisit", int(f["Refers-To-Page-ID"]), length, said, None)
    if (len(payload), hashlib.sha256(payload).hexdigest()) != (length, said):
        raise ValueError(f"record {f['WARC-Record-ID']}: payload differs from its header")
    return Record(page_id, f["WARC-Target-URI"], "response", None, length, said, payload)


# --------------------------------------------------------------- archives
class _Output:
    """Appends byte strings to files of a folder, each closed at ``limit``."""

    def __init__(self, folder: str, suffix: str, limit: int) -> None:
        self.fs, self.path = _open_folder(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.suffix, self.limit, self.file, self.name, self.size = suffix, limit, None, None, 0

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.file is not None and self.size + len(data) > self.limit:
            self.close()
        if self.file is None:
            self.name, self.size = f"part-{uuid.uuid4().hex}{self.suffix}", 0
            self.file = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None)
        self.file.write(data)
        self.size += len(data)
        return self.name, self.size - len(data), len(data)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.file = None


ENTRY = "key string, archive string, offset long, length long"
_ENTRY = pa.schema([("key", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _archived(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Output(folder, ".warc.gz", ARCHIVE)
        for batch in pieces(batches, "html"):
            made = []
            for page_id, url, html, digest, size, first, first_url in zip(*(c.to_pylist() for c in batch.columns)):
                kind = "response" if first is None else "revisit"
                r = Record(page_id, url, kind, first, size, digest, html.encode() if first is None else None)
                made.append((capture_key(url, page_id), *out.add(record_bytes(r, first_url))))
            yield _rows(made, _ENTRY)
        out.close()
    return run


def captured(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, size, first, first_url): ``first`` is the
    page that a revisit refers to, null for a response; a revisit has no html."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("html"),
                        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    earliest = F.min(F.struct(F.col("page_id").isNull().alias("without"), "page_id", "url")).alias("e")
    copies = stored(rows.filter(F.col("size") >= FLOOR).groupBy("digest").agg(earliest, F.count(F.lit(1)).alias("n"))
                    .filter("n > 1 and not e.without")
                    .select("digest", "n", F.col("e.page_id").alias("first"), F.col("e.url").alias("first_url")))
    hot = F.col("n") * HOT > pages.count()
    few = copies.filter(hot).select(F.col("digest").alias("hot_digest"), F.col("first").alias("hot_first"), F.col("first_url").alias("hot_url"))
    rest = copies.filter(~hot).select(F.col("digest").alias("copy_digest"), "first", "first_url")
    # at most HOT rows, and those of their pages that stay revisits are spread
    known = rows.join(F.broadcast(few), F.col("digest") == F.col("hot_digest"), "left")
    spread = F.xxhash64(F.monotonically_increasing_id()).cast("string")
    key = F.when(F.col("hot_digest").isNull() & (F.col("size") >= FLOOR), F.col("digest")).otherwise(spread)
    own = F.col("hot_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("hot_first"))
    known = known.withColumn("_key", key).withColumn("html", F.when(~own, F.col("html")).otherwise(F.lit("")))
    joined = known.join(rest, F.col("_key") == F.col("copy_digest"), "left")
    first = F.coalesce("hot_first", "first")
    revisit = first.isNotNull() & ~F.col("page_id").eqNullSafe(first)
    return joined.select("page_id", "url", "html", "digest", "size", F.when(revisit, first).alias("first"),
                         F.when(revisit, F.coalesce("hot_url", "first_url")).alias("first_url"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives of ``pages``; returns the entries (key, archive,
    offset, length) of their records, as stored in the shared folder."""
    return stored(captured(pages).mapInArrow(_archived(folder), ENTRY))


# ------------------------------------------------------------------ index
DIRECTORY = "shard string, first string, last string, blocks long, entries long"
_DIRECTORY = pa.schema([("shard", pa.string()), ("first", pa.string()), ("last", pa.string()), ("blocks", pa.int64()), ("entries", pa.int64())])


def _indexed(folder: str):
    """Entries come sorted: one index file and its directory a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Output(folder, ".cdx.gz", 1 << 62)
        directory: list[list] = []
        block: list[str] = []
        entries, last = 0, ""

        def flush():
            name, offset, length = out.add(_member("\n".join(block).encode()))
            directory.append([block[0].rsplit(" ", 1)[0], offset, length])
            block.clear()

        for batch in batches:
            for key, archive, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                # keys hold no blank but the one before the stamp
                block.append(f"{key} {json.dumps([archive, offset, length], separators=(',', ':'))}")
                entries, last = entries + 1, key
                if len(block) == ENTRIES:
                    flush()
        if block:
            flush()
        if directory:
            with out.fs.open_output_stream(f"{out.path}/{out.name}.dir", compression=None) as f:
                f.write(_member(json.dumps(directory).encode()))
            out.close()
            yield _rows([(out.name, directory[0][0], last, len(directory), entries)], _DIRECTORY)
    return run


class Index(NamedTuple):
    folder: str
    shards: DataFrame       # one row an index file: shard, first, last, blocks, entries


def build_index(entries: DataFrame, folder: str) -> Index:
    ordered = ("key", "archive", "offset")
    return Index(folder, stored(entries.select("key", "archive", "offset", "length").repartitionByRange(*ordered)
                                .sortWithinPartitions(*ordered).mapInArrow(_indexed(folder), DIRECTORY)))


def read_block(f, offset: int, length: int) -> tuple[list[str], list[str]]:
    """(keys, lines) of one block."""
    f.seek(offset)
    lines = zlib.decompress(f.read(length), wbits=31).decode().split("\n")
    return [ln.rsplit(" ", 1)[0] for ln in lines], lines


def _dealt(firsts: list[str], lasts: list[str], names: list[str]):
    """Each (low, high) goes to the index files whose keys it meets."""
    schema = pa.schema([("shard", pa.string()), ("low", pa.string()), ("high", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for low, high in zip(batch.column("low").to_pylist(), batch.column("high").to_pylist()):
                for i in range(bisect.bisect_left(lasts, low), bisect.bisect_right(firsts, high)):
                    out.append((names[i], low, high))
            if out:
                yield _rows(out, schema)
    return run


def _found(folder: str):
    """(shard, low, high) come sorted: the captures with low <= key <= high."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open_folder(folder)
        name = f = directory = None
        firsts: list[str] = []
        at, keys, lines = None, [], []
        for batch in batches:
            for shard, low, high in zip(*(batch.column(c).to_pylist() for c in ("shard", "low", "high"))):
                if shard != name:
                    with fs.open_input_file(f"{path}/{shard}.dir") as d:
                        directory = json.loads(zlib.decompress(d.read(), wbits=31))
                    firsts = [first for first, _, _ in directory]
                    name, f, at = shard, fs.open_input_file(f"{path}/{shard}"), None
                out = []
                # the block before the first one that begins at low may end with it
                for b in range(max(bisect.bisect_left(firsts, low) - 1, 0), bisect.bisect_right(firsts, high)):
                    if at != b:
                        at = b
                        keys, lines = read_block(f, *directory[b][1:])
                    for i in range(bisect.bisect_left(keys, low), bisect.bisect_right(keys, high)):
                        out.append((keys[i], *json.loads(lines[i].rsplit(" ", 1)[1])))
                if out:
                    yield _rows(out, _ENTRY)
    return run


def _merged(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def lookup(index: Index, ranges: DataFrame) -> DataFrame:
    """The captures (key, archive, offset, length) whose key lies in one of the
    ``ranges`` (low, high); a capture in several of them comes several times."""
    shards = sorted((r.first, r.last, r.shard) for r in index.shards.select("first", "last", "shard").collect())  # a row a file
    if not shards:
        return ranges.sparkSession.createDataFrame([], ENTRY)
    dealt = stored(ranges.select("low", "high").mapInArrow(
        _dealt([s[0] for s in shards], [s[1] for s in shards], [s[2] for s in shards]), "shard string, low string, high string"))
    find = _found(index.folder)
    parts = -(-dealt.count() // LOOKUPS) or 1
    return stored(dealt.repartitionByRange(parts, "shard", "low", "high").sortWithinPartitions("shard", "low", "high")
                  .mapInArrow(lambda batches: _merged(find(batches)), ENTRY))


def url_range(url: str | None) -> tuple[str, str]:
    """(low, high) of all captures of a url."""
    return f"{url_key(url)} ", f"{url_key(url)} ~"


RECORD = "page_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_RECORD = pa.schema([("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                     ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _fetched(folder: str, payload: bool):
    """(archive, offset, length) come sorted: the records, by range reads."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open_folder(folder)
        name = f = None
        start, held = 0, b""
        for batch in batches:
            out, size = [], 0
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if archive != name:
                    name, f, start, held = archive, fs.open_input_file(f"{path}/{archive}"), 0, b""
                if not start <= offset <= offset + length <= start + len(held):
                    f.seek(offset)
                    start, held = offset, f.read(max(length, READ))
                r = parse_record(held[offset - start:offset - start + length])
                out.append(r if payload else r._replace(payload=None))
                size += len(r.payload or b"") if payload else 0
                if size > 1 << 23:
                    yield _rows(out, _RECORD)
                    out, size = [], 0
            if out:
                yield _rows(out, _RECORD)
    return run


def fetch(captures: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records of ``captures`` (archive, offset, length)."""
    parts = -(-(captures.agg(F.sum("length")).first()[0] or 0) // FETCHED) or 1
    return captures.select("archive", "offset", "length").repartitionByRange(parts, "archive", "offset") \
        .sortWithinPartitions("archive", "offset").mapInArrow(_fetched(folder, payload), RECORD)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [capture_key(u, p) for u, p in zip(batch.column("url").to_pylist(), batch.column("page_id").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], names=["key"])


def op12_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes ``pages`` into archives, builds their index, looks every page up
    by its key and reads its record back.  Edge cases: see above."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    base = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = build_index(write_archives(pages, f"{base}/archives"), f"{base}/index")
    wanted = pages.select(F.col("url").cast("string").alias("url"), "page_id").mapInArrow(_keys, "key string") \
        .distinct().select(F.col("key").alias("low"), F.col("key").alias("high"))
    records = fetch(lookup(index, wanted), f"{base}/archives", payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP12_SQL = f"""WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {FLOOR} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f"""
