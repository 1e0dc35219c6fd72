"""The queries that SQL can express, as DuckDB SQL."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

OP1 = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split),
keyed AS (SELECT doc_id, pos, line, {_LOWER.format(f"trim(line, {_SPACE})")} AS key FROM lines),
shared AS (SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10
           GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.keeper AS dropped
           FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP10 = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + 15
      + length(regexp_replace(role || text, '[^\\\\<]', '', 'g'))
      + length(regexp_replace(role, '[^' || chr(10) || ']', '', 'g')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

OP7 = """
WITH sized AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS size FROM pages),
keepers AS (SELECT body, max(page_id) AS keeper FROM sized WHERE size >= 1000 GROUP BY body)
SELECT page_id, size AS payload_bytes, sha1(s.body) AS payload_digest,
       CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < keeper THEN keeper END AS refers_to, true AS intact
FROM sized s LEFT JOIN keepers k ON s.body = k.body
"""

OP9 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ')
    ELSE array_to_string(w[i : i + 3], ' ') END AS s
  FROM words, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT reach.v, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id, d.doc_id = min(r) AS kept
FROM documents d JOIN reach ON reach.v = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id GROUP BY d.doc_id
"""



def _clustering(k: int, rounds: int) -> str:
    """Every distance of every round, in long form: rid, place i, component x."""
    def nearest(r: int) -> str:
        return f"""
dist{r} AS (SELECT v.rid, c.c, sum((v.x - c.x) * (v.x - c.x)) AS d FROM parts v JOIN cent{r} c ON v.i = c.i GROUP BY v.rid, c.c),
near{r} AS MATERIALIZED (SELECT rid, d, c FROM dist{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1),"""

    def moved(r: int) -> str:
        return f"""
mean{r} AS (SELECT n.c, v.i, sum(v.x) AS s, count(*) AS n FROM near{r} n JOIN parts v ON n.rid = v.rid GROUP BY n.c, v.i),
cent{r + 1} AS MATERIALIZED (
  SELECT o.c, o.i, CASE WHEN m.n IS NULL THEN o.x ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS x
  FROM cent{r} o LEFT JOIN mean{r} m ON o.c = m.c AND o.i = m.i),"""

    return f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
numbered AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS rid, vec_id, v FROM kept),
parts AS MATERIALIZED (SELECT rid, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM numbered),
cent0 AS MATERIALIZED (SELECT rid AS c, i, x FROM parts WHERE rid < {k}),
""" + "".join(nearest(r) + moved(r) for r in range(rounds)) + nearest(rounds) + f"""
hashes AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM cent{rounds} GROUP BY c)
SELECT b.vec_id, n.c::INTEGER AS cluster, n.d::BIGINT AS distance, (sum(n.d) OVER (PARTITION BY n.c))::BIGINT AS cluster_inertia,
       (sum(n.d) OVER ())::BIGINT AS inertia, h.h AS centroid_sha256
FROM near{rounds} n JOIN numbered b ON n.rid = b.rid JOIN hashes h ON n.c = h.c
"""


OP13 = _clustering(40, 5)

ORACLE = {"op1_line_dedup": OP1, "op7_warc": OP7, "op9_minhash": OP9, "op10_chat_formatting": OP10,
          "op13_pivot_clusters": OP13}
