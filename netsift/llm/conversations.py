"""Conversation repair: the cheapest edits, and of those the least audit, by one minimum over integers.

An edit path is an integer: its cost in the high digits, below them the audit as a fraction of fixed
width, one digit of three bits for each letter, the first letter highest and zeros behind the last.
Every edge adds a scalar: its cost, and its letter at the place behind the path so far. A node of the
graph is a row's boundary and a state of ``(s?(ua)+)?``; its value is the least integer of all paths to
it. That is exact: two paths to one node consume the same rows and end with a row's letter, or one
costs more, so at equal cost neither audit is the beginning of the other, and what follows
both can't turn their order.

Rows are dealt to tasks by ranges of (conversation, turn), so a conversation of any length is cut, not
gathered. One that lies inside a task and isn't long is repaired there. The others are cut into
segments: a segment gives the least integer from each state to each state, one row for each segment goes
through a minimum over states, and every segment then writes its repaired rows. Only the digest, which
is sequential by nature, reads a long conversation's chunks one after the other, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, free_tokens, joined, ship, written

# Edits, costs, letters in ASCII order, legal neighbours, white space, ends of sentences.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LETTERS = " DIKR"
LEGAL = {"su", "ua", "au"}
SPACE = "\x20\t\n\x0b\x0c\r"
STOPS = ".!?"
#: States: nothing yet, after system, after user, after assistant. Where a kept row leads, and the role a new one must have.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
TURN = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
#: Inserts that end a conversation in each state.
CLOSING = (0, 2, 1, 0)
#: A segment: rows, and characters of its texts (a longer text is a segment of its own).
SEGMENT, SEGMENT_CHARS = 256, 1 << 21
_DIGIT = {c: i for i, c in enumerate(LETTERS)}
_RESULT = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
_RESULT_SQL = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

Row = tuple[str, str, str]  # role, text, fault


def fault(text: str, seen: bool) -> str:
    """The first fault of a row: blank, duplicate, truncated, or none."""
    end = text.rstrip(SPACE)
    return "blank" if not end else "duplicate" if seen else "" if end[-1] in STOPS else "truncated"


def paths(rows: list[Row], start: int) -> tuple[list[tuple[int, int] | None], int]:
    """(value, letters) of the least path from ``start`` before the first row to each state behind the last, and the width."""
    width = 3 * (3 * len(rows) + 2)

    def edge(path: tuple[int, int], cost: int, letter: str) -> tuple[int, int]:
        value, n = path
        return value + (cost << width) + (_DIGIT[letter] << (width - 3 * (n + 1))), n + 1

    def offer(at: list, state: int, path: tuple[int, int]) -> None:
        if at[state] is None or path[0] < at[state][0]:
            at[state] = path

    now: list[tuple[int, int] | None] = [None] * 4
    now[start] = (0, 0)
    for role, _, wrong in rows:
        before, layer = list(now), now
        for _ in range(2):  # a third insert comes back to a state that the first reached
            more: list = [None] * 4
            for s, p in enumerate(layer):
                if p:
                    offer(more, TURN[s][1], edge(p, INSERT, "I"))
            for s, p in enumerate(more):
                if p:
                    offer(before, s, p)
            layer = more
        now = [None] * 4
        extra, first = TRUNCATED if wrong == "truncated" else 0, role[:1]
        for s, p in enumerate(before):
            if p:
                offer(now, s, edge(p, DELETE, "D"))
                if wrong in ("blank", "duplicate"):
                    continue
                if first in KEPT[s]:
                    offer(now, KEPT[s][first], edge(p, KEEP + extra, "K"))
                offer(now, TURN[s][1], edge(p, REROLE + extra, "R"))
    return now, width


def letters(value: int, width: int) -> str:
    out, at = [], width - 3
    while at >= 0 and (d := (value >> at) & 7):
        out.append(LETTERS[d])
        at -= 3
    return "".join(out)


def closed(ends: list[tuple[int, int] | None], width: int) -> tuple[int, str]:
    """Cost and audit of the least path once every end has its closing inserts."""
    best = None
    for s, p in enumerate(ends):
        if p:
            value, n = p
            for k in range(CLOSING[s]):
                value += (INSERT << width) + (_DIGIT["I"] << (width - 3 * (n + k + 1)))
            best = value if best is None or value < best else best
    return best >> width, letters(best, width)


def applied(rows: list[Row], audit: str, state: int = 0) -> list[str]:
    """The repaired rows as ``role:text``."""
    out, at = [], iter(rows)
    for c in audit:
        role, text, _ = ("", "", "") if c == "I" else next(at)
        if c == "D":
            continue
        if c == "K":
            state = KEPT[state][role[:1]]
        else:
            role, state = TURN[state]
        out.append(f"{role}:{text}")
    return out


def _facts(turns: list[int | None], rows: list[Row]) -> tuple[int, int, int, int]:
    """blank, duplicate, truncated, illegal."""
    wrong = [r[2] for r in rows]
    illegal = sum(a[0][:1] + b[0][:1] not in LEGAL for a, b in zip(rows, rows[1:]))
    return wrong.count("blank"), wrong.count("duplicate"), wrong.count("truncated"), illegal


def repair(turns: list[int | None], rows: list[Row]) -> tuple:
    """The result of one conversation from its rows in order: gaps, counts, cost, audit, digest."""
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    cost, audit = closed(*paths(rows, 0))
    return (gaps, *_facts(turns, rows), cost, audit, hashlib.sha256("\n".join(applied(rows, audit)).encode()).hexdigest())


def _judged(rows: list[tuple]) -> tuple[list[int | None], list[Row]]:
    """Rows of a whole conversation (turn, role, text, copies) with their faults, copies written out."""
    turns, out, seen = [], [], set()
    for turn, role, text, copies in rows:
        for _ in range(copies):
            turns.append(turn)
            out.append((role, text, fault(text, (role, text) in seen)))
            seen.add((role, text))
    return turns, out


_ROW = [("part", pa.int32()), ("seq", pa.int64()), ("no", pa.int32()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int32())]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repairs the conversations that begin and end here; rows of the first, the last and long ones are passed on in segments."""
    free_tokens()
    part, seq, number = TaskContext.get().partitionId(), 0, 0
    current, held, size, open_, first = None, [], 0, True, True

    def columns(conv: list, done: list[tuple], passed: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        n, m = len(done), len(passed)
        arrays = [pa.array(conv, kind), pa.array([True] * n + [False] * m)]
        arrays += [pa.array([r[i] for r in done] + [None] * m, t) for i, (_, t) in enumerate(_RESULT)]
        arrays += [pa.array([None] * n + [r[i] for r in passed], t) for i, (_, t) in enumerate(_ROW)]
        return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "done", *(c for c, _ in _RESULT), *(c for c, _ in _ROW)])

    def passed_on() -> list[tuple]:
        return [(part, seq, i, *r) for i, r in enumerate(held)]

    kind = None
    for b in by_bytes(batches, "role", "text"):
        kind = b.schema.field("conv_id").type
        conv, done, rows, whose = b.column("conv_id").to_pylist(), [], [], []
        for c, *row in zip(conv, *(b.column(x).to_pylist() for x in ("turn", "role", "text", "copies"))):
            if number and c != current:
                if open_:
                    rows, whose = rows + passed_on(), whose + [current] * len(held)
                    seq += 1
                else:
                    done.append((current, repair(*_judged(held))))
                held, size, open_ = [], 0, False
            elif len(held) >= SEGMENT or (held and size + len(row[2]) > SEGMENT_CHARS):
                rows, whose = rows + passed_on(), whose + [current] * len(held)
                held, size, seq, open_ = [], 0, seq + 1, True
            current, number = c, number + 1
            held.append(tuple(row))
            size += len(row[2])
        if done or rows:
            yield columns([c for c, _ in done] + whose, [r for _, r in done], rows, kind)
    if held:
        yield columns([current] * len(held), [], passed_on(), kind)


def _segment_rows(t: pa.Table) -> tuple[list, list[Row]]:
    t = t.sort_by("no")
    turns, rows = [], []
    for turn, role, text, copies, again in zip(*(t.column(c).to_pylist() for c in ("turn", "role", "text", "copies", "again"))):
        for k in range(copies):
            turns.append(turn)
            rows.append((role, text, fault(text, again or k > 0)))
    return turns, rows


def _edges(t: pa.Table) -> pa.Table:
    """Costs from state to state (-1: no way) and, for each start, the order of the audits."""
    _, rows = _segment_rows(t)
    costs, ranks = [], []
    for start in range(4):
        ends, width = paths(rows, start)
        audit = [p[0] & ((1 << width) - 1) if p else -1 for p in ends]
        costs += [p[0] >> width if p else -1 for p in ends]
        ranks += [sorted(audit).index(a) for a in audit]
    return pa.table({"conv_id": t.column("conv_id").slice(0, 1), "part": t.column("part").slice(0, 1), "seq": t.column("seq").slice(0, 1), "costs": pa.array([costs], pa.list_(pa.int64())), "ranks": pa.array([ranks], pa.list_(pa.int32()))})


def _choice(t: pa.Table) -> pa.Table:
    """For each segment of a conversation the states that the cheapest way passes, from the last to the first."""
    t = t.sort_by([("part", "ascending"), ("seq", "ascending")])
    costs, ranks = t.column("costs").to_pylist(), t.column("ranks").to_pylist()
    ahead, ways = [INSERT * n for n in CLOSING], []
    for cost, rank in zip(reversed(costs), reversed(ranks)):
        now, way = [], []
        for s in range(4):
            total, _, end = min((cost[4 * s + e] + ahead[e], rank[4 * s + e], e) for e in range(4) if cost[4 * s + e] >= 0)
            now.append(total)
            way.append(end)
        ahead = now
        ways.append(way)
    state, begins, ends = 0, [], []
    for way in reversed(ways):
        begins.append(state)
        state = way[state]
        ends.append(state)
    return pa.table({"part": t.column("part"), "seq": t.column("seq"), "begin": pa.array(begins, pa.int32()), "end": pa.array(ends, pa.int32())})


_CHUNK = [("conv_id", None), ("part", pa.int32()), ("seq", pa.int64()), ("n", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("end", pa.int32()), ("lines", pa.int64()), ("chunk", pa.binary())]


def _chunk(t: pa.Table) -> pa.Table:
    """One row for a segment: what the fold needs of it and its repaired rows."""
    begin, end = t.column("begin")[0].as_py(), t.column("end")[0].as_py()
    turns, rows = _segment_rows(t)
    ends, width = paths(rows, begin)
    value, n = ends[end]
    audit = letters(value, width)
    done, known = applied(rows, audit, begin), [x for x in turns if x is not None]
    first, last = (rows[0][0][:1], rows[-1][0][:1]) if rows else (None, None)
    values = (None, None, None, len(rows), *_facts(turns, rows), first, last, min(known, default=None), max(known, default=None), len(set(known)), value >> width, audit, end, len(done), "\n".join(done).encode())
    same = {c: t.column(c).slice(0, 1) for c in ("conv_id", "part", "seq")}
    return pa.table(same | {c: pa.array([v], k) for (c, k), v in zip(_CHUNK, values) if c not in same})


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order to one row a conversation; a chunk is let go once its bytes are in the digest."""
    current, state = None, None
    kind = None

    def result(convs: list, states: list[dict]) -> pa.RecordBatch:
        out = []
        for s in states:
            gaps = s["high"] - s["low"] + 1 - s["turns"] if s["low"] is not None else 0
            audit = "".join(s["audit"]) + "I" * CLOSING[s["end"]]
            at = s["end"]
            for _ in range(CLOSING[s["end"]]):
                role, at = TURN[at]
                s["sha"].update((b"\n" if s["lines"] else b"") + f"{role}:".encode())
                s["lines"] += 1
            out.append((gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], s["cost"] + INSERT * CLOSING[s["end"]], audit, s["sha"].hexdigest()))
        return pa.RecordBatch.from_arrays([pa.array(convs, kind)] + [pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(_RESULT)], names=["conv_id", *(c for c, _ in _RESULT)])

    for b in by_bytes(batches, "chunk"):
        kind = b.schema.field("conv_id").type
        names, convs, states = b.schema.names, [], []
        for i in range(b.num_rows):
            r = {c: b.column(c)[i].as_py() for c in names}
            if state is None or r["conv_id"] != current:
                if state is not None:
                    convs.append(current)
                    states.append(state)
                current = r["conv_id"]
                state = {"sha": hashlib.sha256(), "lines": 0, "low": None, "high": None, "turns": 0, "last": None, "top": None, "audit": [], "end": 0, "cost": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
            if not r["n"]:
                continue
            for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                state[c] += r[c]
            if state["last"] is not None and state["last"] + r["first"] not in LEGAL:
                state["illegal"] += 1
            state["last"], state["end"] = r["last"], r["end"]
            if r["low"] is not None:
                # turns ascend, so only the turn at a seam can come in both segments
                state["turns"] += r["turns"] - (state["high"] == r["low"])
                state["low"] = r["low"] if state["low"] is None else state["low"]
                state["high"] = r["high"]
            state["audit"].append(r["audit"])
            if r["lines"]:
                state["sha"].update((b"\n" if state["lines"] else b"") + r["chunk"])
                state["lines"] += r["lines"]
        if convs:
            yield result(convs, states)
    if state is not None:
        yield result([current], [state])


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the contract's damage; dropped rows stay with copies 0, repeated ones have 2."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(h < 2, F.lit("")).when(h == 2, F.translate(said("text"), STOPS, "")).otherwise(said("text"))
    role = F.when(h == 4, F.lit("user")).otherwise(said("role"))
    copies = F.when(h == 0, 0).when(h == 3, 2).otherwise(1).cast("int")
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))


def _digest(*parts: str) -> Column:
    """Tells different values of the columns apart: lengths first, null unlike any text."""
    sized = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in parts]
    return F.sha2(F.concat(*sized).cast("binary"), 256)


def repaired(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of ``rows`` (conv_id, turn, role, text, copies), whose nulls are gone but in ids and turns.

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256). Rows of one turn come
    by role, then text (by the first 64 characters of each, then a hash); rows that are alike are adjacent,
    all but the first duplicates. A row has ``copies`` copies; a conversation with none at all has zeros, an
    empty audit and the digest of the empty string. A null conv_id is a conversation. A role without an initial,
    or with one that isn't s, u or a, can't be kept. Other columns are ignored, an empty table gives an empty result.
    """
    ship(rows.sparkSession)
    conv = rows.schema["conv_id"].dataType.simpleString()
    keyed = rows.select(
        "conv_id", "turn", "role", "text", "copies", F.substring("role", 1, 64).alias("_r"), F.substring("text", 1, 64).alias("_t"), F.xxhash64("role", "text").alias("_h"), F.monotonically_increasing_id().alias("_row")
    )
    order = ["conv_id", "turn", "_r", "_t", "_h", "_row"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "copies")
    first = written(dealt.mapInArrow(_local, f"conv_id {conv}, done boolean, {_RESULT_SQL}, part int, seq long, no int, turn long, role string, text string, copies int"), "repaired")
    names = ["conv_id", *(c for c, _ in _RESULT)]
    rest = first.where("NOT done").select("conv_id", "part", "seq", "no", "turn", "role", "text", "copies", _digest("conv_id", "role", "text").alias("same"))
    place = F.struct("part", "seq", "no")
    lookup = written(rest.groupBy("same").agg(F.min(F.when(F.col("copies") > 0, place)).alias("at"), F.count(F.lit(1)).alias("n")), "seen")
    marked = written(joined(rest, lookup, ["same"], "n").withColumn("again", F.coalesce(place != F.col("at"), F.lit(False))).drop("same", "at", "n"), "marked")
    edges = marked.groupBy("part", "seq").applyInArrow(_edges, f"conv_id {conv}, part int, seq long, costs array<long>, ranks array<int>")
    choice = edges.groupBy("conv_id").applyInArrow(_choice, "part int, seq long, begin int, end int")  # one row a segment
    chunks = marked.join(choice, ["part", "seq"]).groupBy("part", "seq").applyInArrow(
        _chunk, f"conv_id {conv}, part int, seq long, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, cost long, audit string, end int, lines long, chunk binary"
    )
    long_ = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_fold, f"conv_id {conv}, {_RESULT_SQL}")
    return first.where("done").select(*names).unionByName(long_)
