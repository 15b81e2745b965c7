"""SQL of conversation repair and of the hash tree, built from parts that repeat."""

from __future__ import annotations

from .conversations import CLOSING, DELETE, INSERT, KEPT, REROLE, TRUNCATED, TURN
from .sharding import _NULL_KEY, _RACK_SALT, _SHARD_SALT, RACK, RACKS, REGION, SHARDS

_POLYNOMIAL = 0xEDB88320


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (_POLYNOMIAL if i & 1 else 0)
        out.append(i)
    return out


def _crc32(hexadecimal: str) -> str:
    """CRC-32 of bytes given as hexadecimal digits."""
    digit = lambda k: f"(instr('123456789ABCDEF', substr(h, {k}, 1)))"
    numbers = f"list_transform(regexp_extract_all({hexadecimal}, '..'), lambda h: CAST({digit(1)} * 16 + {digit(2)} AS BIGINT))"
    step = "xor(tab[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8)"
    return f"xor(list_reduce({numbers}, lambda c, b: {step}, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


_TABLE = "crc AS (SELECT [" + ", ".join(f"{x}::BIGINT" for x in _crc_table()) + "] AS tab)"


def conversation_repair() -> str:
    """The least (cost, audit) from every row on, from the last row back."""
    path = lambda s, cost, letter, line=None: f"{{'c': {s}.c + {cost}, 'a': '{letter}' || {s}.a, 'r': {f'chr(10) || {line} || ' if line else ''}{s}.r}}"
    least = lambda *xs: f"list_sort(list_filter([{', '.join(xs)}], lambda p: p IS NOT NULL))[1]"
    end = [(INSERT * n, "I" * n, "".join("chr(10) || '" + r + ":' || " for r in roles) + "''") for n, roles in zip(CLOSING, ((), ("user", "assistant"), ("assistant",), ()))]
    after = [f"{{'c': CAST({c} AS BIGINT), 'a': '{a}', 'r': {r}}} AS v{s}" for s, (c, a, r) in enumerate(end)]
    extra = f"CASE WHEN x.fault = 'truncated' THEN {TRUNCATED} ELSE 0 END"
    own = []
    for s in range(4):
        kept = " ".join(f"WHEN x.ini = '{i}' THEN {path(f'd.v{t}', extra, 'K', 'x.line')}" for i, t in KEPT[s].items())
        role, to = TURN[s]
        may = "x.fault NOT IN ('blank', 'duplicate')"
        renamed = path(f"d.v{to}", f"{REROLE} + {extra}", "R", f"('{role}:' || x.text)")
        own.append(f"{least(path(f'd.v{s}', DELETE, 'D'), f'CASE WHEN {may} THEN CASE {kept} END END', f'CASE WHEN {may} THEN {renamed} END')} AS w{s}")
    put = []
    for s in range(4):
        role, to = TURN[s]
        then, last = TURN[to]
        once = path(f"w{to}", INSERT, "I", f"'{role}:'")
        twice = f"{{'c': w{last}.c + {2 * INSERT}, 'a': 'II' || w{last}.a, 'r': chr(10) || '{role}:' || chr(10) || '{then}:' || w{last}.r}}"
        put.append(f"{least(f'w{s}', once, twice)} AS v{s}")
    return rf"""
WITH RECURSIVE {_TABLE}, k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), h AS (SELECT k.*, {_crc32("hex(encode(name))")} % 20 AS h FROM k CROSS JOIN crc), e AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN h = 0 THEN 0 WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM h
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM e
), x AS (
  SELECT conv_id, turn, i, text, substr(role, 1, 1) AS ini, role || ':' || text AS line, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o
), y AS (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM x), f AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM y GROUP BY conv_id
), dp AS (
  SELECT conv_id, n + 1 AS i, {", ".join(after)} FROM f
  UNION ALL SELECT conv_id, i, {", ".join(put)} FROM (
    SELECT x.conv_id, x.i, {", ".join(own)} FROM dp d JOIN x ON x.conv_id IS NOT DISTINCT FROM d.conv_id AND x.i = d.i - 1)
), b AS (SELECT conv_id, v0.c AS cost, v0.a AS audit, sha256(substr(v0.r, 2)) AS digest FROM dp WHERE i = 1)
SELECT c.conv_id, CAST(coalesce(f.gaps, 0) AS BIGINT) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal,
  CAST(coalesce(b.cost, 0) AS BIGINT) AS cost, coalesce(b.audit, '') AS audit, coalesce(b.digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def hash_tree(shards: int = SHARDS, draws: int = 64) -> str:
    """Full regions decide by one draw; of the grown tree's new region ``draws`` are written out, far more than can come in time."""
    if shards % REGION:
        raise ValueError("this SQL is for full regions")
    big = lambda n: f"{int(n)}::UHUGEINT"
    word = 2**64

    def mix(x: str) -> str:
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = f"list_transform(list_transform({x}, lambda y: xor(y, y >> 33)), lambda y: y * {big(factor)} % {big(word)})"
        return f"list_transform({x}, lambda y: xor(y, y >> 33))"

    salted = lambda x, salt: mix(f"list_transform({x}, lambda y: xor(y, {big(salt)}))")
    unit = lambda x: f"(CAST({x} >> 11 AS DOUBLE) + 0.5::DOUBLE) / 9007199254740992.0::DOUBLE"
    regions = shards // REGION
    return f"""
WITH {_TABLE}, d AS (
  SELECT doc_id, row_number() OVER () AS rid, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size, {_crc32("hex(encode(coalesce(text, '')))")} AS text_crc32,
    (CAST(coalesce(doc_id, {_NULL_KEY}) AS HUGEINT) + {word}::HUGEINT) % {word}::HUGEINT AS key FROM documents CROSS JOIN crc
), p AS (
  SELECT rid, CAST(key AS UHUGEINT) AS key, r, unnest(range(1, CASE WHEN r < {regions} THEN 2 ELSE {draws + 1} END)) AS number FROM d CROSS JOIN (SELECT unnest(range({regions + 1})) AS r)
), h AS (SELECT rid, r, number, {mix(f"list_transform({mix('[CAST((r::UHUGEINT << 32) + number::UHUGEINT AS UHUGEINT)]')}, lambda m: xor(m, key))")} AS h FROM p),
k AS (SELECT *, {salted("h", _RACK_SALT)} AS rack FROM h), s AS (SELECT *, {salted("rack", _SHARD_SALT)} AS leaf FROM k), t AS (
  SELECT rid, r, number, sum(-ln({unit("h[1]")}) / {REGION}) OVER (PARTITION BY rid, r ORDER BY number) AS tm, CAST(r * {REGION} + (rack[1] % {RACKS}) * {RACK} + leaf[1] % {RACK} AS INTEGER) AS shard FROM s
), a AS (SELECT rid, arg_min(shard, tm) FILTER (WHERE shard < {shards}) AS shard, arg_min(shard, tm) FILTER (WHERE shard < {shards + 1}) AS grown_shard FROM t GROUP BY rid)
SELECT d.doc_id, d.size, d.text_crc32, 'key' AS law, a.shard, row_number() OVER (PARTITION BY a.shard ORDER BY d.doc_id NULLS FIRST, d.text_crc32, d.size) - 1 AS slot, a.grown_shard FROM d JOIN a ON a.rid = d.rid
"""
