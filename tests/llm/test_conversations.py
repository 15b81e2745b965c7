"""Conversation repair against a plain statement of its rules."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from netsift.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")


def reference(rows: list[tuple]) -> dict:
    """The contract, row by row; the least (cost, audit) from every point on by comparing strings, last row first."""
    convs: dict = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        mine += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return {conv: conversation(sorted(mine, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))) for conv, mine in convs.items()}


def conversation(rows: list[tuple]) -> tuple:
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        signs = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not signs else "duplicate" if (role, text) in seen else "" if signs[-1] in ".!?" else "truncated")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    after = {"": "su", "s": "u", "u": "a", "a": "u"}  # which initials may follow
    least = {("", 0): (0, ""), ("a", 0): (0, "")}
    for left in range(len(rows) + 1):
        i = len(rows) - left
        options: dict = {}
        for last in after:
            found = [least[last, 0]] if left == 0 and (last, 0) in least else []
            if left:
                _, role, text = rows[i]
                extra = 3 if faults[i] == "truncated" else 0
                cost, audit = least[last, left - 1]
                found.append((cost + 4, "D" + audit))
                for name, price, letter in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                    if faults[i] not in ("blank", "duplicate") and name[:1] and name[:1] in after[last]:
                        cost, audit = least[name[:1], left - 1]
                        found.append((cost + price + extra, letter + audit))
            options[last] = min(found, default=(10**9, ""))
        for _ in range(6):
            for last, nxt in itertools.product(after, "ua"):
                if nxt in after[last]:
                    options[last] = min(options[last], (options[nxt][0] + 3, "I" + options[nxt][1]))
        least |= {(last, left): x for last, x in options.items()}
    cost, audit = least["", len(rows)]
    out, at, last = [], iter(rows), ""
    for letter in audit:
        role, text = next(at)[1:] if letter != "I" else ("", "")
        if letter == "D":
            continue
        if letter != "K":
            role = {"": "user", "s": "user", "u": "assistant", "a": "user"}[last]
        last = role[:1]
        out.append(f"{role}:{text}")
    assert GOOD.fullmatch("".join(x[:1] for x in out))
    counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def got(spark, rows, schema=SCHEMA) -> dict:
    found = c.repaired(c.damaged(spark.createDataFrame(rows, schema))).collect()
    out = {r.conv_id: tuple(r)[1:] for r in found}
    assert len(out) == len(found)
    return out


def made(rng: random.Random, conv, n: int) -> list[tuple]:
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No!", "Why?", "cut", " ", "", None, "Thanks.  ", "é。", "a\nb."]
    return [(conv, rng.choice([None, i, i, i, i + 3]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}.") for i in range(n)]


def test_small_conversations(spark):
    rng = random.Random(5)
    rows = [r for conv in [None, *range(150)] for r in made(rng, conv, rng.randint(1, 9))]
    assert got(spark, rows) == reference(rows)


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    more = table.selectExpr("*", "1 AS copies", "'x' AS part", "true AS done", "text AS _t")
    assert {r.conv_id: tuple(r)[1:] for r in c.repaired(c.damaged(more)).collect()} == reference(rows)


def test_long_conversations_are_cut(spark):
    """Segments, seams between tasks, copies that come again far away and a long text give what one piece gives."""
    rng = random.Random(6)
    rows = made(rng, 1, 900) + made(rng, 2, 300) + [(3, i // 40, ("user", "assistant")[i % 2], "Again.") for i in range(700)]
    rows += [(4, i, ("user", "assistant")[i % 2], f"{i}" * (300_000 if i == 5 else 1) + ".") for i in range(40)] + made(rng, 5, 4)
    rng.shuffle(rows)
    assert got(spark, rows) == reference(rows)


def test_nothing_left(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert got(spark, [(dropped, 0, "user", "Hi.")]) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert got(spark, []) == {}


@pytest.mark.parametrize("seed", range(3))
def test_all_paths(seed):
    """The integer minimum against every edit sequence of short conversations."""
    rng = random.Random(seed)
    for _ in range(40):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), "x", rng.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 3))]
        best = None

        def walk(i, cost, audit, roles, inserts):
            nonlocal best
            if i == len(rows) and GOOD.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
            if best and cost > best[0]:
                return
            for r in "ua" if inserts < 2 else "":
                walk(i, cost + 3, audit + "I", roles + r, inserts + 1)
            if i < len(rows):
                role, _, fault = rows[i]
                extra = 3 * (fault == "truncated")
                walk(i + 1, cost + 4, audit + "D", roles, 0)
                if fault not in ("blank", "duplicate"):
                    walk(i + 1, cost + extra, audit + "K", roles + role[:1], 0)
                    for r in "ua":
                        walk(i + 1, cost + 3 + extra, audit + "R", roles + r, 0)

        walk(0, 0, "", "", 0)
        assert c.closed(*c.paths(rows, 0)) == best
