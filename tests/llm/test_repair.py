"""Conversation repair against exhaustive search and a row-by-row automaton."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from logspark.llm import repair

TALK = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        end = text.rstrip(SPACE)
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def exhaustive(rows, inserts=4):
    """The cheapest, then least audit of all edit sequences with few insertions."""
    marks = faults(rows)
    ways = []
    for edits in itertools.product(*[("D",) if m in ("blank", "duplicate") else ("D", "K", "Ru", "Ra") for m in marks]):
        own = [(e[0], role[:1] if e == "K" else e[1:]) for e, (role, _) in zip(edits, rows)]
        base = sum(4 if e == "D" else 3 * (e != "K") + 3 * (m == "truncated") for e, m in zip(edits, marks))
        for n in range(inserts + 1):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), n):
                for what in itertools.product("ua", repeat=n):
                    line, audit, rest = "", "", list(zip(places, what))
                    for i in range(len(rows) + 1):
                        while rest and rest[0][0] == i:
                            line, audit = line + rest.pop(0)[1], audit + "I"
                        if i < len(rows):
                            audit, line = audit + own[i][0], line + ("" if own[i][0] == "D" else own[i][1] or "?")
                    if re.fullmatch("(s?(ua)+)?", line):
                        ways.append((base + 3 * n, audit))
    return min(ways)


def viterbi(rows):
    """Row by row: the best way to each place in the pattern."""
    steps = {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)]}

    def relaxed(best):
        for _ in range(3):
            for p, q in steps["u"] + steps["a"]:
                if p in best:
                    best[q] = min(best.get(q, (1 << 60, "")), (best[p][0] + 3, best[p][1] + "I"))
        return best

    best = relaxed({0: (0, "")})
    for (role, _), mark in zip(rows, faults(rows)):
        new = {p: (c + 4, a + "D") for p, (c, a) in best.items()}
        if mark not in ("blank", "duplicate"):
            more = 3 * (mark == "truncated")
            for initial, letter, cost in ((role[:1], "K", more), ("u", "R", 3 + more), ("a", "R", 3 + more)):
                for p, q in steps.get(initial, []):
                    if p in best:
                        new[q] = min(new.get(q, (1 << 60, "")), (best[p][0] + cost, best[p][1] + letter))
        best = relaxed(new)
    return min(best[p] for p in (0, 3) if p in best)


def lines_of(rows, audit):
    out, own, size = [], iter(rows), len(audit.replace("D", ""))
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(own)
        if letter != "D":
            turn = "assistant" if (len(out) - size % 2) % 2 else "user"
            out.append(f"{role if letter == 'K' else turn}:{text}")
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def brute(rows):
    left, out = damaged(rows), {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in left if r[0] == conv),
                     key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        talk = [r[2:] for r in own]
        marks, turns = faults(talk), {r[1] for r in own} - {None}
        cost, audit = viterbi(talk) if talk else (0, "")
        text = "\n".join(lines_of(talk, audit))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(marks.count(m) for m in ("blank", "duplicate", "truncated")),
                     sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(talk, talk[1:])), cost, audit,
                     hashlib.sha256(text.encode()).hexdigest())
    return out


def some(rng, conv, n):
    return [(conv, rng.choice([None, *range(n + 2)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]),
             rng.choice([None, "", " \t", "yes.", "no!", "cut", f"text {rng.random()}?", "é😀. \n"])) for _ in range(n)]


def test_cells_against_exhaustive_search():
    rng = random.Random(1)
    for n in range(1, 5):
        for _ in range(40 if n < 4 else 8):
            rows = [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b!", "cut", "", "d?"])) for _ in range(n)]
            cells = [repair.row_cell(role[:1], m in ("blank", "duplicate"), m == "truncated") for (role, _), m in zip(rows, faults(rows))]
            got = min(c for c in (repair.parsed(cells)[i] for i in repair.WHOLE) if c)
            assert got == exhaustive(rows, 5 if n < 3 else 4) == viterbi(rows)


def test_every_split_gives_the_same_cell():
    """The full chart, all splits of all spans, against one split a span."""
    rng = random.Random(2)
    for n in range(1, 10):
        cells = [repair.row_cell(rng.choice("suat"), rng.random() < .2, rng.random() < .3) for _ in range(n)]
        chart = {(i, i + 1): c for i, c in enumerate(cells)}
        for size in range(2, n + 1):
            for i in range(n - size + 1):
                ways = [repair.combined(chart[i, k], chart[k, i + size]) for k in range(i + 1, i + size)]
                assert all(w == ways[0] for w in ways)
                chart[i, i + size] = ways[0]
        assert chart[0, n] == repair.parsed(cells)


def test_query_against_brute_force(sc, tmp_path):
    """Nulls in every column, repeated rows, a conversation without rows left."""
    rng = random.Random(4)
    rows = [r for conv in [None, *range(60)] for r in some(rng, conv, rng.randrange(1, 9))]
    rows += rows[:20] + [(900 + i, t, "user", "x" * 50_000) for i in range(60) for t in (0,)]
    frame = sc.createDataFrame(rows, TALK).withColumn("grp", F.lit("clash")).withColumn("pos", F.lit(3)).withColumn("first", F.lit(True))
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in repair.op13_cyk_repair(sc, str(tmp_path)).collect()}
    assert got == brute(rows)
    assert any(v[-2] == "" for v in got.values())


@pytest.mark.parametrize("size", [2, 7, 256])
def test_one_long_conversation(sc, size):
    """Segments, and segments of segments, parse as the whole does; the
    repaired rows are those of the audit."""
    rng = random.Random(size)
    rows = [(5, i, rng.choice(["user", "assistant"]), f"{i if rng.random() < .9 else 0}{rng.choice(['.', '', '!'])}") for i in range(600)]
    frame = repair.rows_of(sc.createDataFrame(rows, TALK).repartition(6))
    found = repair.parses(frame, size)
    one = found.collect()[0]
    talk = [r[2:] for r in rows]
    assert (one.cost, one.audit) == viterbi(talk) and one.duplicate == faults(talk).count("duplicate")
    got = sorted((r.line, f"{r.role}:{r.text}") for r in repair.repaired(frame, found).collect())
    assert [g[1] for g in got] == lines_of(talk, one.audit)


def test_empty_table(sc, tmp_path):
    sc.createDataFrame([], TALK).write.parquet(f"{tmp_path}/conversations.parquet")
    assert repair.op13_cyk_repair(sc, str(tmp_path)).collect() == []
