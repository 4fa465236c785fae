"""DuckDB SQL for the results of the operators over embeddings, pages and conversations."""

from __future__ import annotations

from .turns import moves
from .warc import BASE32


def centroid_clusters(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3:") -> str:
    """Lloyd's rounds, a pair of common table expressions for each."""
    distance = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.c[i] - t.c[i]) * (v.c[i] - t.c[i])))::BIGINT"
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS c FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, c) - 1 AS k, c FROM (SELECT sha256('{salt}' || vec_id) AS h, c FROM v ORDER BY h, c LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT r, min({{'d': {distance}, 'k': t.k}}) AS m FROM v, c{r} t GROUP BY r)")
        if r < rounds:
            sums = f"SELECT m.k AS k, i, sum(c[i])::HUGEINT AS s, count(*) AS n FROM a{r} JOIN v USING (r), range(1, {dims + 1}) g(i) GROUP BY ALL"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT t.k, coalesce(f.c, t.c) AS c FROM c{r} t LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM ({sums}) GROUP BY k) f USING (k))")
    total = "sum(m.d)"
    return f"WITH {', '.join(parts)} SELECT vec_id, m.k::INTEGER AS cluster, m.d AS distance, ({total} OVER (PARTITION BY m.k))::BIGINT AS cluster_inertia, ({total} OVER ())::BIGINT AS inertia, sha256(array_to_string(t.c, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN c{rounds} t ON t.k = m.k"


def warc_archive() -> str:
    five = "('0x' || substr(h, 5 * i + 1, 5))::BIGINT"
    digits = " || ".join(f"substr('{BASE32}', ({five} // {32**j} % 32 + 1)::BIGINT, 1)" for j in (3, 2, 1, 0))
    digest = f"array_to_string(list_transform(range(0, 8), lambda i: {digits}), '')"
    return f"SELECT page_id, strlen(t) AS payload_bytes, {digest} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM (SELECT page_id, t, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS first FROM (SELECT page_id, coalesce(html, '') AS t FROM pages))"


def conversation_repair() -> str:
    """One recursion over the turns of all conversations, each state with its cost, audit and repaired text."""
    word = r"[^\x20\x09-\x0D]"
    table = "list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ord(s[i])::BIGINT)), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"
    values = ", ".join(map(str, moves()))
    turn = "CASE x WHEN 'K' THEN role || ':' || txt WHEN 'R' THEN word || txt ELSE '' END"
    return f"""WITH RECURSIVE crc AS (SELECT {table} AS crcs),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
kinds AS (SELECT conv_id, turn, role, txt, {crc} % 20 AS kind FROM given, crc),
hurt AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(txt, '[.!?]', '', 'g') ELSE txt END AS txt FROM kinds, range(0, 2) g(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt) - 1 AS i FROM hurt),
seen AS (SELECT *, left(role, 1) AS f, row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY i) AS copy, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS b FROM placed),
turns AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(txt, '{word}') THEN 1 WHEN copy > 1 THEN 2 WHEN NOT regexp_matches(txt, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault, CASE WHEN f IN ('s', 'u', 'a') THEN f ELSE 'x' END || CASE fault WHEN 0 THEN 'k' WHEN 3 THEN 't' ELSE 'd' END AS sym FROM seen),
moves(state, sym, next, cost, letters) AS (VALUES {values}),
roads AS (SELECT *, length(letters) = 2 AS ins, right(letters, 1) AS x, CASE state WHEN 2 THEN 'assistant:' ELSE 'user:' END AS added, CASE next WHEN 3 THEN 'assistant:' ELSE 'user:' END AS word FROM moves),
best(conv_id, state, i, cost, audit, lines) USING KEY (conv_id, state) AS (
 SELECT DISTINCT conv_id, 0, 0::BIGINT, 0, '', ''::VARCHAR FROM turns
 UNION
 SELECT conv_id, next, i + 1, m.cost, m.audit, m.lines FROM (SELECT b.conv_id, r.next, b.i, min({{'cost': b.cost + r.cost, 'audit': b.audit || r.letters, 'lines': b.lines || CASE WHEN ins THEN added || chr(10) ELSE '' END || {turn} || CASE WHEN x = 'D' THEN '' ELSE chr(10) END}}) AS m FROM best b JOIN turns t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.i = b.i JOIN roads r ON r.state = b.state AND r.sym = t.sym GROUP BY ALL)),
sizes AS (SELECT conv_id, count(*) AS n, count(DISTINCT turn) AS d, coalesce(max(turn) - min(turn) + 1, 0) - d AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (b || f NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id),
ends AS (SELECT s.conv_id, min({{'cost': cost + CASE state WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END, 'audit': audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END, 'lines': lines || CASE state WHEN 1 THEN 'user:' || chr(10) || 'assistant:' || chr(10) WHEN 2 THEN 'assistant:' || chr(10) ELSE '' END}}) AS m FROM best b JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM b.conv_id WHERE b.i = s.n GROUP BY s.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(m.cost, 0)::BIGINT AS cost, coalesce(m.audit, '') AS audit, sha256(coalesce(left(m.lines, length(m.lines) - 1), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""
