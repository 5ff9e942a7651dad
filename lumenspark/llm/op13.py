"""Query of conversation repair, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.llm.common import read
from lumenspark.llm.conversations import damaged, repaired


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    return repaired(damaged(read(spark, sf_dir, "conversations"), F.crc32(name.cast("binary")) % 20))


# The same repair as a walk through the grammar's states, row by row: a state's column holds the least cost
# (nine digits) and audit of all ways to it.  Insertions come before a row or after the last.
_SQL = r"""
WITH RECURSIVE
n AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
bytes AS (SELECT *, list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT)) AS codes FROM n),
luck AS (
  SELECT *, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], codes),
    lambda c, b: list_reduce(list_concat([xor(c, b)], CAST(range(8) AS BIGINT[])), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)))), CAST(4294967295 AS BIGINT)) % 20 AS luck FROM bytes),
once AS (
  SELECT conv_id, turn, CASE WHEN luck = 4 THEN 'user' ELSE role END AS role,
         CASE luck WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, CASE luck WHEN 3 THEN 2 ELSE 1 END AS copies FROM luck WHERE luck <> 0),
r AS (SELECT conv_id, turn, role, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS BIGINT) AS i FROM (SELECT *, unnest(range(copies)) AS copy FROM once)),
s AS (
  SELECT *, substr(role, 1, 1) AS initial, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS stem,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lead(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS following FROM r),
f AS (SELECT *, CASE WHEN stem = '' THEN 'b' WHEN again THEN 'd' WHEN substr(stem, length(stem), 1) IN ('.', '!', '?') THEN '' ELSE 't' END AS kind FROM s),
last AS (SELECT conv_id, max(i) AS m FROM f GROUP BY conv_id),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS b, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM last
  UNION ALL
  SELECT conv_id, i,
    {d} AS b,
    CASE WHEN kind IN ('b', 'd') THEN {ds} WHEN initial = 's' THEN least({ds}, {ks}) ELSE {ds} END AS s,
    CASE WHEN kind IN ('b', 'd') THEN {du} ELSE least({du}, {tu}) END AS u,
    CASE WHEN kind IN ('b', 'd') THEN {da} ELSE least({da}, {ta}) END AS a
  FROM (
    SELECT f.conv_id, f.i, f.kind, f.initial, CASE WHEN f.kind = 't' THEN 5 ELSE 0 END AS fine, w.b, w.s, least(w.u, {iu}) AS u1, least(w.a, {ia1}) AS a1
    FROM (SELECT *, least(b, s, a) AS any1 FROM walk) w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)),
ended AS (
  SELECT conv_id, least(b, a, {e1}) AS best FROM (SELECT w.*, least(w.u, {eu}) AS u1 FROM (SELECT *, least(b, s, a) AS any1 FROM walk) w JOIN last l ON w.conv_id IS NOT DISTINCT FROM l.conv_id AND w.i = l.m)),
edit AS (SELECT conv_id, k, substr(best, 9 + k, 1) AS e FROM (SELECT conv_id, best, unnest(range(1, length(best) - 8)) AS k FROM ended)),
placed AS (SELECT *, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER w AS p, sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS size FROM edit WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
said AS (
  SELECT p.conv_id, string_agg(CASE WHEN p.e = 'K' THEN f.role WHEN (p.p + p.size) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN p.e = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY p.k) AS repaired
  FROM placed p LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i WHERE p.e <> 'D' GROUP BY p.conv_id),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 'b') AS blank, count(*) FILTER (kind = 'd') AS duplicate, count(*) FILTER (kind = 't') AS truncated,
         count(*) FILTER (following IS NOT NULL AND initial || following NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(t.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(t.blank, 0) AS BIGINT) AS blank, CAST(coalesce(t.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(t.truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(t.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(substr(e.best, 1, 9), '0') AS BIGINT) AS cost, coalesce(substr(e.best, 10), '') AS audit, sha256(coalesce(x.repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN said x ON x.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def _step(way: str, cost: str, edit: str) -> str:
    """A way with one more edit."""
    return f"lpad(CAST(CAST(substr({way}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({way}, 10) || {edit}"


def _sql() -> str:
    turn = lambda way, letter: _step(way, f"fine + CASE WHEN initial = '{letter}' THEN 0 ELSE 1 END", f"CASE WHEN initial = '{letter}' THEN 'K' ELSE 'R' END")
    insert = lambda way: _step(way, "5", "'I'")
    deleted = {"d": "b", "ds": "s", "du": "u1", "da": "a1"}
    out = _SQL
    for name, way in deleted.items():
        out = out.replace("{" + name + "}", _step(way, "2", "'D'"))
    parts = {"ks": _step("b", "fine", "'K'"), "tu": turn("least(b, s, a1)", "u"), "ta": turn("u1", "a"), "iu": insert("w.any1"), "eu": insert("w.any1"), "e1": insert("u1")}
    parts["ia1"] = insert(f"least(w.u, {insert('w.any1')})")
    for name, text in parts.items():
        out = out.replace("{" + name + "}", text)
    return out


QUERIES = {"op13_conversation_repair": op13_conversation_repair}
SQL = {"op13_conversation_repair": _sql()}
