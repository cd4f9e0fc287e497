"""SQL of the operators on conversations: op11 steps through each conversation's turns, op13 has each prefix as a list."""

from __future__ import annotations


def crc32(text: str) -> str:
    """SQL of the checksum of an ASCII text."""
    byte = f"list_transform(range(length({text})), lambda i: ascii(({text})[i + 1])::BIGINT)"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {byte}), lambda c, b: {bits}), 4294967295)"


DIGEST = "md5(strlen(role) || ':' || role || ':' || text)"
ORDER = f"turn NULLS FIRST, {DIGEST}"

OP13_SQL = rf"""
WITH own AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY {ORDER}) AS turns FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
sized AS (SELECT *, {crc32("conv_id::VARCHAR")} % 4 AS h FROM own),
rebuilt AS (SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS path FROM sized a LEFT JOIN sized b ON b.conv_id = a.conv_id - a.conv_id % 20),
members AS (SELECT conv_id, d, md5(to_json(path[1:d])::VARCHAR) AS node, CASE WHEN d > 0 THEN md5(to_json(path[1:d - 1])::VARCHAR) END AS parent, d = len(path) AS ends, CASE WHEN d > 0 THEN len(regexp_extract_all(path[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT node, any_value(parent) AS parent, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM members GROUP BY node, d),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
sums AS (SELECT m.node, count(*) FILTER (k.node IS NULL) AS n_leaves, sum((u.n_convs - 1) * u.words) AS saved_tokens FROM nodes u JOIN members m ON m.conv_id = u.conv_id AND m.d <= u.d LEFT JOIN kids k ON k.node = u.node GROUP BY m.node)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node LEFT JOIN kids k ON k.node = n.node LEFT JOIN nodes p ON p.node = n.parent
"""


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _more(state: str, cost: str, edit: str, when: str = "true") -> str:
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}'}} END"


def _op11() -> str:
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    stays = "CASE WHEN x <> lower(x) THEN 5 ELSE 0 END"
    kept = lambda state, role: _more(state, stays, "K", f"lower(x) = '{role}'")
    given = lambda state: _more(state, f"1 + {stays}", "R", "x <> 'd'")
    gone = lambda state: _more(state, "2", "D")
    into = _least("b0", "b1", "b3")
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
WITH RECURSIVE kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role_0, coalesce(text, ' ') AS text_0, {crc32(key)} % 20 AS kind FROM conversations),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role_0 END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text_0, '[.!?]', '', 'g') ELSE text_0 END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY {ORDER}) AS i, trim(text, {white}) AS body FROM hurt),
again AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM placed),
judged AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(body, '[.!?]$') THEN 'truncated' ELSE '' END AS fault, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS initial FROM again),
pairs AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM judged),
convs AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
  string_agg(CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN fault = 'truncated' THEN upper(initial) ELSE initial END, '' ORDER BY i) AS codes, list(role ORDER BY i) AS roles, list(text ORDER BY i) AS texts FROM pairs GROUP BY conv_id),
steps(conv_id, codes, i, b0, b1, b2, b3) AS (
  SELECT conv_id, codes, 0, {{'c': 0, 'a': ''}}, NULL::STRUCT(c INTEGER, a VARCHAR), {{'c': 5, 'a': 'I'}}, {{'c': 10, 'a': 'II'}} FROM convs
  UNION ALL
  SELECT conv_id, codes, i, n0, n1, {_least("m2", _more("m3", "5", "I"))}, m3 FROM (
    SELECT *, {_least("n3", _more("m2", "5", "I"))} AS m3 FROM (
      SELECT *, {_least("n2", _more("n0", "5", "I"), _more("n1", "5", "I"))} AS m2 FROM (
        SELECT conv_id, codes, i + 1 AS i, {gone("b0")} AS n0, {_least(gone("b1"), kept("b0", "s"))} AS n1, {_least(gone("b2"), kept("into_u", "u"), given("into_u"))} AS n2, {_least(gone("b3"), kept("b2", "a"), given("b2"))} AS n3
        FROM (SELECT *, codes[i + 1] AS x, {into} AS into_u FROM steps WHERE i < length(codes)))))
),
best AS (SELECT conv_id, {_least("b0", "b3")} AS b FROM steps WHERE i = length(codes)),
edits AS (SELECT c.conv_id, roles, texts, b.a[p + 1] AS edit, p, length(regexp_replace(b.a[1:p + 1], 'I', '', 'g')) AS n FROM (SELECT *, unnest(range(length(b.a))) AS p FROM best) b JOIN convs c ON c.conv_id IS NOT DISTINCT FROM b.conv_id),
stay AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY p) - 1 AS place FROM edits WHERE edit <> 'D'),
heads AS (SELECT conv_id, edit = 'K' AND roles[n][1] = 's' AS system FROM stay WHERE place = 0),
said AS (SELECT s.conv_id, place, CASE WHEN edit = 'K' THEN roles[n] WHEN (place - system::INT) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE texts[n] END AS line FROM stay s JOIN heads h ON h.conv_id IS NOT DISTINCT FROM s.conv_id),
shas AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY place)) AS sha FROM said GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.b.c, 0)::BIGINT AS cost, coalesce(b.b.a, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN convs c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN shas s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
"""


OP11_SQL = _op11()
