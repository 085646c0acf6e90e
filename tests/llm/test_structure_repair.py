"""Structure repair against a plain dynamic program over whole audit strings."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from twinroute.llm import structure_repair as sr
from twinroute.llm import tables

TURN = "conv_id long, turn long, role string, text string"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    """(cost, audit) from the last row to the first; every state keeps its least pair."""

    def inserted(best):
        for _ in range(4):
            for q in range(4):
                for o in "ua":
                    t = NEXT.get((q, o))
                    if t in best:
                        best[q] = min(best.get(q, (10**9, "")), (best[t][0] + 5, "I" + best[t][1]))
        return best

    best = inserted({0: (0, ""), 3: (0, "")})
    for initial, fault in reversed(rows):
        new = {}
        for q in range(4):
            ways = [(best[q][0] + 2, "D" + best[q][1])] if q in best else []
            extra = 5 if fault == sr.TRUNCATED else 0
            for letter, out, cost in [("K", initial, 0), ("R", "u", 1), ("R", "a", 1)] if fault not in (sr.BLANK, sr.DUPLICATE) else []:
                t = NEXT.get((q, out))
                if t in best:
                    ways.append((best[t][0] + cost + extra, letter + best[t][1]))
            if ways:
                new[q] = min(ways)
        best = inserted(new)
    return best[0]


def expected(turns, damage=True):
    """Rows of the query in plain Python."""
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else -1
        own = by[conv]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        codes, seen = [], set()
        for _, role, text in rows:
            kept = text.strip(SPACE)
            codes.append((role[:1], sr.BLANK if not kept else sr.DUPLICATE if (role, text) in seen else sr.TRUNCATED if kept[-1] not in ".!?" else 0))
            seen.add((role, text))
        cost, audit = brute(codes)
        lines, state, todo = [], 0, iter(rows)
        for letter in audit:
            role, text = ("", "") if letter == "I" else next(todo)[1:]
            if letter != "D":
                role = role if letter == "K" else "assistant" if state == 2 else "user"
                state = NEXT[state, role[:1]]
                lines.append(f"{role}:{text}")
        known = [t for t, *_ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        counts = [sum(f == k for _, f in codes) for k in (sr.BLANK, sr.DUPLICATE, sr.TRUNCATED)]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "u", "a", "t", ""]), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=10))
def test_lightest_equals_dynamic_program(rows):
    assert sr.lightest(rows) == brute(rows)


def test_long_conversation_is_repaired():
    rows = [("usa"[k * k % 3], k * 7 % 4) for k in range(3000)]
    cost, audit = sr.lightest(rows)
    assert len(audit) - audit.count("I") == 3000 and (cost, audit) == brute(rows)


def test_query_equals_brute_force(spark, sf):
    turns = [tuple(r) for r in tables.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = sr.op12_structure_repair(spark, sf)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert rows_of(got) == expected(turns)


ODD = [
    (1, 0, "user", "hello."), (1, 1, "assistant", None), (1, None, None, None), (1, None, "system", "be kind."), (1, 1, "assistant", "a."), (1, 1, "assistant", "a."),
    (None, None, None, None), (None, 3, "user", "no id."), (2, 5, "assistant", " \t\n"), (3, -4, "tool", "x\x85"), (3, 9, "user", "x.\x85"), (3, 9, "user", "end? "),
    (4, 0, "", "empty role."), (4, 0, "user", "q" * 100_000 + ". "), (5, 0, "user", "kept"), *((6, k, "user" if k % 2 else "ässistant", f"{k}.") for k in range(300)),
]


def test_odd_rows_extra_columns_and_empty_table(spark):
    from pyspark.sql import functions as F

    turns = spark.createDataFrame(ODD, TURN)
    for name in ("gone", "place", "edit", "audit", "_ord", "_kind", "h1"):
        turns = turns.withColumn(name, F.lit("x"))
    plain = turns.select("conv_id", "turn", "role", "text")
    assert rows_of(sr.digests(sr.damaged(turns), "gone")) == expected(ODD)
    assert rows_of(sr.digests(turns)) == expected(ODD, damage=False)
    lines = defaultdict(list)
    for r in sorted(sr.repair(plain).collect(), key=lambda r: (str(r["conv_id"]), r["place"])):
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    want = {x[0]: x[-1] for x in expected(ODD, damage=False)}
    assert {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in lines.items()} == {k: v for k, v in want.items() if v != hashlib.sha256(b"").hexdigest()}
    assert sr.digests(sr.damaged(turns.limit(0)), "gone").count() == 0 and sr.repair(plain.limit(0)).count() == 0


def test_one_task_or_many_give_the_same(spark, sf):
    turns = tables.table(spark, sf, "conversations")
    assert rows_of(sr.digests(sr.damaged(turns.repartition(1)), "gone")) == rows_of(sr.digests(sr.damaged(turns.repartition(13, "text")), "gone"))
