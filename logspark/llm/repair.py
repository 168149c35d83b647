"""Operator 13: conversations repaired by weighted interval parsing (CYK).

A conversation should read ``(s?(ua)+)?`` by the initials of its roles.  Rows
may be kept, given another role (user or assistant), deleted, and rows without
text may be inserted; the repair is the cheapest sequence of such edits, and of
equally cheap ones the one whose initials (the audit: K, R, D, I) are least.

Method.  The grammar in Chomsky normal form has a nonterminal ``pq`` for every
pair of places in the pattern (0: start, 1: after s, 2: after u, 3: after a)
that some text leads from p to q, and the rules ``pq -> pr rq``.  The cell of a
span of rows holds, for each nonterminal, the least (cost, audit) that derives
it.  Insertions derive a nonterminal from no rows at all; their closure is
taken into the cells of single rows, on both sides, and thereby into all.  Two
neighbouring spans combine into one of their joint length, bottom-up.  Since
every split of a span allows the same derivations (a row's edits never depend
on its neighbours), one split a span is enough.  A cost follows from the audit
letter by letter, so no audit of a cell begins with another one of equal cost
and least audits combine into least audits.

Rows are numbered in order, whole segments of SEGMENT rows are parsed by one
task each, and the segments' cells are combined by SEGMENT at a time, so a
conversation that holds a third of all rows is parsed by many tasks.  What is
repeated is found by grouping (role, text digest), not within a task.  Texts
are shuffled once, sorted, and rewritten as they stream by.  Only the digest of
a conversation's whole text is taken in one task, row after row, since SHA-256
cannot be split; the same holds for its audit, which has a letter for each row.

Defined results.  Rows are ordered by turn (nulls first), then role, then the
SHA-256 of the text; null roles and texts read as one blank.  Rows without a
conv_id are one conversation.  Initials other than s, u and a, also of an empty
role, fit nowhere.  Repeated rows are duplicates; empty or blank texts must go;
texts of any length are used whole.  Other columns do not matter.  No rows: no
conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm.common import pieces, stored
from logspark.llm.merkle import numbered

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3   # costs; UNFINISHED: of a truncated row that stays
#: Rows a segment, and segments combined at a time.
SEGMENT = 256
BLANKS = " \t\n\x0b\x0c\r"

# ---------------------------------------------------------------- grammar
#: Places that an initial leads between.
STEPS = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}
INSERTS = STEPS["u"] + STEPS["a"]
NONTERMINALS = ((0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3))
_AT = {pq: i for i, pq in enumerate(NONTERMINALS)}
#: For each nonterminal pq the pairs (pr, rq).
RULES = tuple(tuple((_AT[p, r], _AT[r, q]) for r in range(4) if (p, r) in _AT and (r, q) in _AT) for p, q in NONTERMINALS)
#: Nonterminals that a whole conversation may be.
WHOLE = (_AT[0, 0], _AT[0, 3])

Cell = tuple  # of (cost, audit) or None, one a nonterminal


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans as one."""
    out = []
    for pairs in RULES:
        best = None
        for x, y in pairs:
            a, b = left[x], right[y]
            if a is None or b is None:
                continue
            cost = a[0] + b[0]
            if best is None or cost < best[0] or (cost == best[0] and a[1] + b[1] < best[1]):
                best = (cost, a[1] + b[1])
        out.append(best)
    return tuple(out)


def _closure() -> Cell:
    """What insertions alone derive."""
    one = tuple((0, "") if p == q else (INSERT, "I") if (p, q) in INSERTS else None for p, q in NONTERMINALS)
    cell = one
    while (more := combined(cell, one)) != cell:
        cell = more
    return cell


CLOSURE = _closure()


@lru_cache(maxsize=None)
def row_cell(initial: str, must_go: bool, truncated: bool) -> Cell:
    own: list = [(DELETE, "D") if p == q else None for p, q in NONTERMINALS]
    if not must_go:
        extra = UNFINISHED if truncated else 0
        for pq in INSERTS:
            own[_AT[pq]] = (REROLE + extra, "R")
        for pq in STEPS.get(initial, ()):
            own[_AT[pq]] = (KEEP + extra, "K")
    return combined(combined(CLOSURE, tuple(own)), CLOSURE)


def parsed(cells: list[Cell]) -> Cell:
    """The cell of a span from those of its neighbouring parts: spans of
    growing length, two at a time."""
    while len(cells) > 1:
        pairs = [combined(a, b) for a, b in zip(cells[::2], cells[1::2])]
        cells = pairs + cells[len(pairs) * 2:]
    return cells[0]


# ------------------------------------------------------------- rows, faults
def _key(conv_id: Column) -> Column:
    return F.coalesce(conv_id.cast("string"), F.lit(" "))


def rows_of(conversations: DataFrame) -> DataFrame:
    """(grp, turn, role, text), nulls read as one blank (turns stay null)."""
    return conversations.select(_key(F.col("conv_id")).alias("grp"), F.col("turn").cast("long").alias("turn"),
                                *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (grp, turn, role, text) with the damage that crc32(grp:turn) % 20 chooses."""
    hit = F.crc32(F.concat("grp", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    times = F.when(hit == 0, F.lit(0)).when(hit == 3, F.lit(2)).otherwise(F.lit(1))
    return rows.select("grp", "turn", F.when(hit == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       F.when(hit == 1, F.lit("")).when(hit == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                       F.explode(F.array_repeat(F.lit(1), times)).alias("_once")).drop("_once")


def _digest(text="text") -> Column:
    return F.unhex(F.sha2(F.col(text), 256))


def marked(rows: DataFrame) -> DataFrame:
    """(grp, pos, n, turn, initial, blank, truncated, repeated) of the rows (grp,
    turn, role, text): pos counts the rows of a conversation, n is their number."""
    end = F.rtrim("text", F.lit(BLANKS))
    light = stored(rows.select("grp", "turn", "role", _digest().alias("digest"), (end == "").alias("blank"),
                               (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("truncated")))
    placed = stored(numbered(light, F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")))
    earliest = placed.groupBy("grp", "role", "digest").agg(F.min("pos").alias("pos")).select("grp", "pos", F.lit(True).alias("_new"))
    return placed.join(earliest, ["grp", "pos"], "left").select(
        "grp", "pos", "n", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "truncated", F.col("_new").isNull().alias("repeated"))


# ---------------------------------------------------------------- segments
SPAN = ("grp string, seg long, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
        "low long, high long, turns long, costs array<long>, audits array<string>")
_SPAN = pa.schema([("grp", pa.string()), *((c, pa.int64()) for c in ("seg", "n", "blank", "duplicate", "truncated", "illegal")),
                   ("first", pa.string()), ("last", pa.string()), *((c, pa.int64()) for c in ("low", "high", "turns")),
                   ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
LEGAL = ("su", "ua", "au")


class _Span:
    """What is known of neighbouring rows or spans, taken in order."""

    def __init__(self) -> None:
        self.counts = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal
        self.first = self.last = self.low = self.high = None
        self.turns = 0
        self.cells: list[Cell] = []

    def add(self, counts, first, last, low, high, turns, cell) -> None:
        self.counts = [a + b for a, b in zip(self.counts, counts)]
        if self.last is None:
            self.first = first
        elif self.last + first not in LEGAL:
            self.counts[3] += 1
        self.last = last
        if low is not None:
            # turns ascend, so only the last one before can be met again
            self.turns += turns - (self.high == low)
            self.low, self.high = (low if self.low is None else self.low), high
        self.cells.append(cell)

    def row(self, grp: str, seg: int, n: int) -> tuple:
        cell = parsed(self.cells)
        return (grp, seg, n, *self.counts, self.first, self.last, self.low, self.high, self.turns,
                [c and c[0] for c in cell], [c and c[1] for c in cell])


def _spans(batches: Iterator[pa.RecordBatch], parts) -> Iterator[pa.RecordBatch]:
    """One row for the neighbouring rows with the same (grp, segment);
    ``parts`` gives (grp, segment, n, arguments of ``_Span.add``)."""
    span, at, made = None, None, []
    for batch in batches:
        for grp, seg, n, what in parts(batch):
            if (grp, seg, n) != at:
                if span is not None:
                    made.append(span.row(*at))
                span, at = _Span(), (grp, seg, n)
            span.add(*what)
        if made:
            yield _table(made)
            made = []
    if span is not None:
        yield _table([span.row(*at)])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SPAN)], schema=_SPAN)


def _of_rows(size: int):
    def parts(batch):
        names = ("grp", "pos", "n", "turn", "initial", "blank", "truncated", "repeated")
        for grp, pos, n, turn, initial, blank, truncated, repeated in zip(*(batch.column(c).to_pylist() for c in names)):
            must_go = blank or repeated
            fault = (int(blank), int(repeated and not blank), int(truncated and not must_go), 0)
            yield grp, pos // size, n, (fault, initial, initial, turn, turn, int(turn is not None), row_cell(initial, must_go, truncated))
    return lambda batches: _spans(batches, parts)


def _of_spans(size: int):
    def parts(batch):
        for r in batch.to_pylist():
            cell = tuple(None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"]))
            yield r["grp"], r["seg"] // size, r["n"], (
                (r["blank"], r["duplicate"], r["truncated"], r["illegal"]), r["first"], r["last"], r["low"], r["high"], r["turns"], cell)
    return lambda batches: _spans(batches, parts)


def parses(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """One row a conversation: gaps, blank, duplicate, truncated, illegal, cost
    and audit of the rows (grp, turn, role, text)."""
    part = F.floor(F.col("pos") / size)
    spans = stored(marked(rows).withColumn("_part", part).repartition("grp", "_part").sortWithinPartitions("grp", "pos").drop("_part")
                   .mapInArrow(_of_rows(size), SPAN))
    most = spans.agg(F.max("seg")).first()[0] or 0
    while most:
        most //= size
        spans = stored(spans.withColumn("_part", F.floor(F.col("seg") / size)).repartition("grp", "_part")
                       .sortWithinPartitions("grp", "seg").drop("_part").mapInArrow(_of_spans(size), SPAN))
    ways = F.array(*(F.struct(F.get("costs", F.lit(i)).alias("cost"), F.get("audits", F.lit(i)).alias("audit")) for i in WHOLE))
    best = F.array_min(F.filter(ways, lambda w: w["cost"].isNotNull()))
    return spans.select("grp", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps"),
                        "blank", "duplicate", "truncated", "illegal", best["cost"].alias("cost"), best["audit"].alias("audit"))


# ------------------------------------------------------------- rewriting
def _rewritten(digests: bool):
    """Each conversation's audit comes first, then its rows in order."""
    lines = pa.schema([("grp", pa.string()), ("line", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    hashes = pa.schema([("grp", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, audit, at, line, size, sha = None, "", 0, 0, 0, None
        out: list[tuple] = []

        def put(role, text):
            nonlocal line
            # an odd number of lines begins with the system's
            expected = "user" if (line - size % 2) % 2 == 0 else "assistant"
            role = expected if role is None else role
            if digests:
                sha.update(f"{chr(10) if line else ''}{role}:{text}".encode())
            else:
                out.append((grp, line, role, text))
            line += 1

        def inserted():
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                at += 1
                put(None, "")

        def ended():
            inserted()
            if digests:
                out.append((grp, sha.hexdigest()))

        def table():
            schema = hashes if digests else lines
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return batch

        for batch in pieces(batches):
            for key, first, role, text in zip(*(batch.column(c).to_pylist() for c in ("grp", "first", "role", "text"))):
                if first:
                    if grp is not None:
                        ended()
                    grp, audit, at, line, sha = key, text, 0, 0, hashlib.sha256()
                    size = len(audit) - audit.count("D")
                    continue
                inserted()
                edit = audit[at]
                at += 1
                if edit != "D":
                    put(role if edit == "K" else None, text)
            if out:
                yield table()
        if grp is not None:
            ended()
        if out:
            yield table()
    return run


def _streamed(rows: DataFrame, parses_: DataFrame) -> DataFrame:
    own = rows.select("grp", F.lit(False).alias("first"), "turn", "role", _digest().alias("digest"), "text")
    head = parses_.select("grp", F.lit(True).alias("first"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                          F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"))
    return own.union(head).repartition("grp") \
        .sortWithinPartitions("grp", F.col("first").desc(), F.col("turn").asc_nulls_first(), "role", "digest")


def repaired(rows: DataFrame, parses_: DataFrame) -> DataFrame:
    """(grp, line, role, text): the repaired conversations of rows (grp, turn, role, text)."""
    return _streamed(rows, parses_).mapInArrow(_rewritten(False), "grp string, line long, role string, text string")


def repaired_digests(rows: DataFrame, parses_: DataFrame) -> DataFrame:
    """(grp, repaired_sha256) over the lines ``role:text``."""
    return _streamed(rows, parses_).mapInArrow(_rewritten(True), "grp string, repaired_sha256 string")


def op13_cyk_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages ``conversations`` and repairs them, one row for each conv_id of
    the table; conversations that lost all rows are empty.  See above."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = damaged(rows_of(conversations))
    found = parses(rows)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    whole = conversations.select("conv_id").distinct().withColumn("grp", _key(F.col("conv_id")))
    return whole.join(found, "grp", "left").join(repaired_digests(rows, found), "grp", "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: Another way to the same edits: row by row, the best (cost, audit) for each
#: place in the pattern that the rows so far can lead to.
OP13_SQL = """WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') AS grp, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
c AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(str_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda h, c: list_reduce(list_prepend(xor(h, c), CAST(range(8) AS BIGINT[])),
        lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295) % 20 AS hit FROM k),
d AS (SELECT grp, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM c, range(2) r(i) WHERE hit <> 0 AND (i = 0 OR hit = 3)),
e AS (SELECT *, substr(role, 1, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed,
    row_number() OVER (PARTITION BY grp ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos FROM d),
f AS (SELECT *, trimmed = '' AS blank, trimmed <> '' AND row_number() OVER (PARTITION BY grp, role, text ORDER BY pos) > 1 AS duplicate,
    lag(initial) OVER (PARTITION BY grp ORDER BY pos) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM e),
g AS (SELECT *, blank OR duplicate AS gone, NOT blank AND NOT duplicate AND right(trimmed, 1) NOT IN ('.', '!', '?') AS truncated FROM f),
ins(p, q, cost, audit) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'),
  (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 3, 3, 'I'), (3, 2, 3, 'I')),
step(i, p, q) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
t AS (SELECT grp, pos, p, p AS q, 4 AS cost, 'D' AS audit FROM g, range(4) x(p)
  UNION ALL SELECT grp, pos, p, q, CASE WHEN truncated THEN 3 ELSE 0 END, 'K' FROM g JOIN step ON i = initial WHERE NOT gone
  UNION ALL SELECT grp, pos, p, q, CASE WHEN truncated THEN 6 ELSE 3 END, 'R' FROM g, step WHERE NOT gone AND i <> 's'),
best(grp, pos, q, way) AS (
  SELECT grp, CAST(0 AS BIGINT), q, lpad(CAST(cost AS VARCHAR), 12, '0') || audit FROM (SELECT DISTINCT grp FROM g), ins WHERE p = 0
  UNION ALL SELECT b.grp, b.pos + 1, n.q,
    min(lpad(CAST(CAST(left(b.way, 12) AS BIGINT) + t.cost + n.cost AS VARCHAR), 12, '0') || substr(b.way, 13) || t.audit || n.audit)
  FROM best b JOIN t ON t.grp = b.grp AND t.pos = b.pos + 1 AND t.p = b.q JOIN ins n ON n.p = t.q GROUP BY b.grp, b.pos, n.q),
ends AS (SELECT grp, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE illegal) AS illegal
  FROM g GROUP BY grp),
w AS (SELECT ends.grp, min(way) AS way FROM ends JOIN best ON best.grp = ends.grp AND best.pos = ends.n WHERE q IN (0, 3) GROUP BY ends.grp),
a AS (SELECT grp, CAST(left(way, 12) AS BIGINT) AS cost, substr(way, 13) AS audit, strlen(way) - 12 AS letters FROM w),
l AS (SELECT grp, i, audit[i] AS letter, length(replace(audit, 'D', '')) AS size, length(replace(left(audit, i), 'I', '')) AS pos,
    length(replace(left(audit, i), 'D', '')) - 1 AS line FROM (SELECT *, unnest(range(1, letters + 1)) AS i FROM a)),
o AS (SELECT l.grp, sha256(string_agg(
    CASE WHEN letter = 'K' THEN g.role WHEN (line - size % 2) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE g.text END,
    chr(10) ORDER BY i)) AS repaired FROM l LEFT JOIN g ON g.grp = l.grp AND g.pos = l.pos WHERE letter <> 'D' GROUP BY l.grp)
SELECT k.conv_id, CAST(coalesce(any_value(gaps), 0) AS BIGINT) AS gaps, CAST(coalesce(any_value(blank), 0) AS BIGINT) AS blank,
  CAST(coalesce(any_value(duplicate), 0) AS BIGINT) AS duplicate, CAST(coalesce(any_value(truncated), 0) AS BIGINT) AS truncated,
  CAST(coalesce(any_value(illegal), 0) AS BIGINT) AS illegal, CAST(coalesce(any_value(cost), 0) AS BIGINT) AS cost,
  coalesce(any_value(audit), '') AS audit, coalesce(any_value(repaired), sha256('')) AS repaired_sha256
FROM k LEFT JOIN ends ON ends.grp = k.grp LEFT JOIN a ON a.grp = k.grp LEFT JOIN o ON o.grp = k.grp GROUP BY k.conv_id"""
