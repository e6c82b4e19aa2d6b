"""The same questions as SQL for DuckDB, where SQL can express them on whole tables."""

from tesserix.llm.secrets import COPIED_OWNERS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+')"

OP3 = """
WITH good AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score
  FROM good q JOIN good c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
WHERE rank <= 20
"""

OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT r, i, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS prev FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
u AS (SELECT word, sum(k) AS n FROM (SELECT r, word, count(*) AS k FROM p GROUP BY ALL) GROUP BY 1),
uo AS (SELECT r, word, count(*) AS k FROM p GROUP BY ALL),
b AS (SELECT prev, word, count(*) AS n FROM p WHERE prev IS NOT NULL GROUP BY ALL),
bo AS (SELECT r, prev, word, count(*) AS k FROM p WHERE prev IS NOT NULL GROUP BY ALL),
total AS (SELECT count(*) AS n FROM p),
s AS (SELECT p.r, p.prev, ln(greatest(u.n - uo.k, 0.5) / greatest(total.n - len(d.w), 1)) AS uni, u.n - uo.k AS elsewhere,
    coalesce(b.n - bo.k, 0) AS pair, coalesce(hu.n - ho.k, 0) AS history
  FROM p JOIN d USING (r) CROSS JOIN total JOIN u ON p.word = u.word JOIN uo ON p.r = uo.r AND p.word = uo.word
  LEFT JOIN b ON p.prev = b.prev AND p.word = b.word LEFT JOIN bo ON p.r = bo.r AND p.prev = bo.prev AND p.word = bo.word
  LEFT JOIN u hu ON p.prev = hu.word LEFT JOIN uo ho ON p.r = ho.r AND p.prev = ho.word),
t AS (SELECT r, sum(CASE WHEN prev IS NULL THEN uni WHEN pair > 0 THEN ln(pair / history) ELSE ln(0.4) + uni END) AS score,
  count(*) FILTER (WHERE CASE WHEN prev IS NULL THEN elsewhere ELSE pair END > 0) AS found FROM s GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(score, 0), 6) AS log_score,
  round(CASE WHEN len(w) > 0 THEN score / len(w) END, 6) AS mean_log_score, coalesce(found, 0)::BIGINT AS n_found FROM d LEFT JOIN t USING (r)
"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN w ELSE w[i:i + 3] END AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
h AS (SELECT doc_id, gram, md5(array_to_string(gram, ' ') || len(gram)) AS k FROM g),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM h a JOIN h b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, other) AS (SELECT a, b FROM link UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON r.other = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id))::BIGINT AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY 1) m ON d.doc_id = m.doc_id
"""

#: (name, rank, pattern, group of the value, condition on a value v)
_KINDS = [
    ("assign", 0, """((?i:password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 4, "length(v) >= 8"),
    ("access", 1, "AKIA[A-Z0-9]+", 2, "length(v) >= 16"),
    ("hex", 2, "[0-9a-f]+", 2, "length(v) >= 32"),
    ("bare", 3, "[A-Za-z0-9+/_.=-]+", 2, "length(v) >= 16 AND regexp_matches(v[1:16], '[0-9]')"),
]
_FOUND = " UNION ALL ".join(f"""
SELECT r, source, '{name}' AS kind, {rank} AS rank, stop - length(hit) AS start, stop, v FROM (
  SELECT r, source, hit, v, sum(length(gap) + length(hit)) OVER (PARTITION BY r ORDER BY i)::BIGINT AS stop FROM (
    SELECT r, source, unnest(gaps) AS gap, unnest(hits) AS hit, unnest(vals) AS v, unnest(range(1, len(gaps) + 1)) AS i FROM (
      SELECT r, source, regexp_extract_all(text, '(?s)(.*?)({pattern})', 1) AS gaps, regexp_extract_all(text, '(?s)(.*?)({pattern})', 2) AS hits,
        regexp_extract_all(text, '(?s)(.*?)({pattern})', {group}) AS vals FROM d))) WHERE {test}""" for name, rank, pattern, group, test in _KINDS)

OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
f AS ({_FOUND}),
own AS (SELECT v, CASE WHEN owners >= {COPIED_OWNERS} THEN 'copied'
    WHEN NOT (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= 8
      AND NOT regexp_matches(v, '(?i)example|changeme|placeholder|dummy|sample|xxxx')) THEN 'plain'
    WHEN owners = 1 THEN 'live' ELSE 'shared' END AS ownership
  FROM (SELECT v, count(DISTINCT coalesce('o' || source, '')) AS owners, bool_or(kind <> 'bare') AS named FROM f GROUP BY 1) WHERE named),
s AS (SELECT f.*, ownership, kind || ':' || start || ':' || stop AS said FROM f JOIN own USING (v)),
kept AS (SELECT * FROM s WHERE kind <> 'bare' OR ownership = 'live' AND NOT EXISTS (
  SELECT 1 FROM s o WHERE o.r = s.r AND o.kind <> 'bare' AND o.start < s.stop AND s.start < o.stop)),
g AS (SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
    count(*) FILTER (WHERE kind = 'hex') AS n_hex, coalesce(string_agg(said, ',' ORDER BY start, rank) FILTER (WHERE kind <> 'bare'), '') AS base,
    string_agg(said, ',' ORDER BY start, rank) AS spans, count(*) FILTER (WHERE ownership = 'live') AS n_live,
    count(*) FILTER (WHERE ownership = 'shared') AS n_shared, count(*) FILTER (WHERE ownership = 'copied') AS n_copied FROM kept GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live,
  coalesce(n_shared, 0)::BIGINT AS n_shared, coalesce(n_copied, 0)::BIGINT AS n_copied FROM d LEFT JOIN g USING (r)
"""

_WHITE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"

OP12 = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, {_WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.doc_id, pos, line, coalesce(k.doc_id <> first_id, FALSE) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY 1
"""


def _clusters(rounds: int = 3, k: int = 16) -> str:
    """Rounds of clustering, one step of assignment and one of means each."""
    steps = [f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::HUGEINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
s AS (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, q FROM (SELECT sha256('1:' || vec_id) AS h, q FROM v ORDER BY h LIMIT {k})),
c0 AS (SELECT cluster, q FROM s)"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, q, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
  SELECT v.vec_id, v.q, c.cluster, list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{r} c) GROUP BY 1, 2)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT cluster, i, sum(x)::HUGEINT AS t, count(*)::HUGEINT AS n FROM (
  SELECT cluster, unnest(q) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY 1, 2),
n{r} AS (SELECT cluster, list((t - ((t % n) + n) % n) // n ORDER BY i) AS q FROM m{r} GROUP BY 1),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.q, c.q) AS q FROM c{r} c LEFT JOIN n{r} n ON c.cluster = n.cluster)""")
    return ",\n".join(steps) + f"""
SELECT vec_id, a.cluster::INTEGER AS cluster, distance::BIGINT AS distance, sum(distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster"""


OP13 = _clusters()
