"""DuckDB SQL that gives the same rows as the queries SQL can express.

It says what is asked for, not how the operators find it: all pairs, all windows.
"""

from __future__ import annotations

from . import secrets as S


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _found(name: str, pattern: str, kind: int, keep: str, group: int = 0) -> str:
    """Leftmost matches with code-point positions: matches and the pieces between them alternate."""
    p = _q(pattern)
    return f"""{name} AS (SELECT doc_id, {kind} AS kind, o AS start, o + length(m) AS stop, m, g FROM (
      SELECT doc_id, m, g, sum(length(piece)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM (
        SELECT doc_id, unnest(string_split_regex(t, {p})) AS piece, unnest(regexp_extract_all(t, {p}, 0)) AS m, unnest(regexp_extract_all(t, {p}, {group})) AS g, unnest(range(len(string_split_regex(t, {p})))) AS i FROM texts)
      WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE m IS NOT NULL AND {keep})"""


def _entropy() -> str:
    import math

    allowed = " OR ".join(f"regexp_matches(m, {_q(p)})" for p in S.ALLOW)
    (_, hex_letters, window, hex_bits), (_, _, _, base_bits) = S.CLASSES
    most = lambda bits: repr(window * (math.log2(window) - bits) + 1e-9)
    held = _q(S.PLACEHOLDER)
    return f"""cand AS (SELECT doc_id, start AS c0, m, CASE WHEN regexp_matches(m, '^[{hex_letters}]+$') THEN {most(hex_bits)} ELSE {most(base_bits)} END AS most FROM c3 WHERE NOT ({allowed})),
    cut AS (SELECT *, sum(length(piece) + coalesce(length(x), 0)) OVER (PARTITION BY doc_id, c0 ORDER BY i) - length(piece) - coalesce(length(x), 0) AS o FROM (
      SELECT doc_id, c0, most, len(string_split_regex(m, {held})) AS k, unnest(string_split_regex(m, {held})) AS piece, unnest(regexp_extract_all(m, {held}, 0)) AS x, unnest(range(len(string_split_regex(m, {held})))) AS i FROM cand)),
    part AS (SELECT doc_id, most, c0 + o + CASE WHEN i = 0 THEN 0 ELSE {S.REACH} END AS start,
      substr(piece, CASE WHEN i = 0 THEN 1 ELSE {S.REACH + 1} END, greatest(0, length(piece) - CASE WHEN i = 0 THEN 0 ELSE {S.REACH} END - CASE WHEN i = k - 1 THEN 0 ELSE {S.REACH} END)) AS m FROM cut),
    chars AS (SELECT doc_id, start, i, any_value(most) AS most, ch, count(*) AS c FROM (SELECT doc_id, start, most, i, unnest(string_split(substr(m, i::INT, {window}), '')) AS ch FROM (SELECT *, unnest(range(1, length(m) - {window} + 2)) AS i FROM part)) GROUP BY doc_id, start, i, ch),
    hot AS (SELECT doc_id, start, i FROM chars GROUP BY doc_id, start, i HAVING sum(c * log2(c)) <= any_value(most)),
    run AS (SELECT doc_id, start + min(i) - 1 AS a, start + max(i) - 1 + {window} AS z FROM hot GROUP BY doc_id, hot.start),
    met AS (SELECT run.doc_id, a, z, b.start, b.stop, max(b.stop) OVER (PARTITION BY run.doc_id, a ORDER BY b.start, b.stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM run LEFT JOIN base b ON b.doc_id = run.doc_id AND b.start < z AND a < b.stop),
    ent AS (SELECT doc_id, 3 AS kind, start, stop FROM (
      SELECT doc_id, greatest(a, coalesce(before, a)) AS start, start AS stop FROM met WHERE start IS NOT NULL
      UNION ALL SELECT doc_id, greatest(a, coalesce(max(stop), a)), z FROM met GROUP BY doc_id, a, z) WHERE stop > start)"""


_KIND = "CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'entropy' END || ':' || start || ':' || stop"

OP2 = f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_found("c0", S.ASSIGN, 0, "length(g) >= 6", 2)},
{_found("c1", S.ACCESS, 1, "length(m) >= 20")},
{_found("c2", S.HEX, 2, "length(m) >= 24")},
{_found("c3", S.CANDIDATE, 3, "true")},
base AS (SELECT doc_id, kind, start::BIGINT AS start, stop::BIGINT AS stop FROM c0 UNION ALL SELECT doc_id, kind, start::BIGINT, stop::BIGINT FROM c1 UNION ALL SELECT doc_id, kind, start::BIGINT, stop::BIGINT FROM c2),
{_entropy()},
every AS (SELECT * FROM base UNION ALL SELECT doc_id, kind, start::BIGINT, stop::BIGINT FROM ent),
b AS (SELECT doc_id, count_if(kind = 0)::BIGINT AS n_assign, count_if(kind = 1)::BIGINT AS n_access, count_if(kind = 2)::BIGINT AS n_hex, string_agg({_KIND}, ',' ORDER BY start, kind) AS s FROM base GROUP BY 1),
a AS (SELECT doc_id, string_agg({_KIND}, ',' ORDER BY start, kind) AS s FROM every GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.s, '')) AS base_sha256, coalesce(a.s, '') AS spans FROM texts LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)"""

OP3 = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM low LEFT JOIN n USING (vec_id)"""

OP7 = """WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
win AS (SELECT doc_id, p, md5(substr(h, (2 * p + 1)::BIGINT, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM b)),
first AS (SELECT s, min(doc_id::HUGEINT * 1000000000000 + p) AS f FROM win GROUP BY 1 HAVING count(*) > 1),
dup AS (SELECT doc_id, p FROM win JOIN first USING (s) WHERE doc_id::HUGEINT * 1000000000000 + p > f),
ends AS (SELECT doc_id, p, max(p + 100) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM dup),
isl AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM ends) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y FROM isl),
cut AS (SELECT doc_id, sum(z - a)::BIGINT AS removed, count(*) AS spans, max(z) AS tail, string_agg(substr(h, (2 * y + 1)::BIGINT, (2 * (a - y))::BIGINT), '' ORDER BY a) AS kept FROM gaps JOIN b USING (doc_id) GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE kept || substr(h, (2 * tail + 1)::BIGINT) END)) AS kept_sha256 FROM b LEFT JOIN cut USING (doc_id)"""

OP9 = r"""WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(list_slice(ws, p, p + 49), ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM words)),
first AS (SELECT s, min(doc_id) AS d FROM win GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
cov AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS k FROM win JOIN first USING (s) WHERE doc_id > d),
u AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM words),
kept AS (SELECT u.doc_id, count(cov.k) AS removed, string_agg(w, ' ' ORDER BY u.k) FILTER (WHERE cov.k IS NULL) AS t FROM u LEFT JOIN cov ON cov.doc_id = u.doc_id AND cov.k = u.k GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)"""

OP11 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INTEGER AS rank, s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other)
QUALIFY rank <= 5
"""

OP12 = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
one AS (SELECT lang, w[i] AS x, count(*) AS f FROM starts GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY ALL),
two AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM starts WHERE i < len(w) GROUP BY ALL),
three AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM starts WHERE i + 1 < len(w) GROUP BY ALL HAVING count(*) >= 10),
longer AS (SELECT lang, x, y, max(f) AS m FROM (SELECT lang, x, y, f FROM three UNION ALL SELECT lang, y, z, f FROM three) GROUP BY ALL),
cuts AS (
  SELECT t.lang, t.x || ' ' || t.y AS phrase, t.f AS a, 1 AS k, p.f AS l, q.f AS r FROM two t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN one q ON q.lang = t.lang AND q.x = t.y
    LEFT JOIN longer g ON g.lang = t.lang AND g.x = t.x AND g.y = t.y WHERE t.f >= 10 AND (g.m IS NULL OR 100 * g.m < 50 * t.f)
  UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 1, p.f, q.f FROM three t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN two q ON q.lang = t.lang AND q.x = t.y AND q.y = t.z
  UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 2, p.f, q.f FROM three t JOIN two p ON p.lang = t.lang AND p.x = t.x AND p.y = t.y JOIN one q ON q.lang = t.lang AND q.x = t.z),
scored AS (SELECT *, (1000000 * a::HUGEINT * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT s.lang, row_number() OVER w AS rank, phrase, a, l, r, n, score FROM scored s JOIN total t ON t.lang = s.lang
WINDOW w AS (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) QUALIFY rank <= 2000
"""
