"""DuckDB SQL for the queries that SQL can express."""

FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
SQUARES = "CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
MEAN = "CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"


def _lloyd_sql(centroids: int = 40, rounds: int = 5) -> str:
    """Rounds of nearest centroids and exact means, each a query of its own."""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND {FINITE})""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS c, v FROM kept
  ORDER BY c LIMIT {centroids})""",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT k.r, arg_min(c.c, {SQUARES} * 1000 + c.c) AS c, min({SQUARES}) AS d FROM kept k CROSS JOIN c{n} c GROUP BY k.r)")
        if n < rounds:
            parts.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(m.v, o.v) AS v FROM c{n} o LEFT JOIN (
    SELECT c, list(x ORDER BY i) AS v FROM (
      SELECT c, i, {MEAN} AS x FROM (SELECT a.c, unnest(range(1, 65)) AS i, unnest(k.v) AS x FROM a{n} a JOIN kept k USING (r)) GROUP BY c, i)
    GROUP BY c) m USING (c))""")
    return f"""WITH {", ".join(parts)}
SELECT k.vec_id, CAST(a.c AS INT) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM kept k JOIN a{rounds} a USING (r) JOIN c{rounds} c ON c.c = a.c"""


def _codebook_sql(parts: int = 4, entries: int = 256, rounds: int = 4, width: int = 16) -> str:
    """The same for codebooks: k holds a row a vector and part, c a row a part and entry."""
    steps = [
        f"""whole AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, vec_id, label, v FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {FINITE}))""",
        f"kept AS MATERIALIZED (SELECT r, p, v[p * {width} + 1 : p * {width} + {width}] AS v FROM whole, (SELECT unnest(range(0, {parts})) AS p))",
        f"c0 AS MATERIALIZED (SELECT p, r - 1 AS c, v FROM kept WHERE r <= {entries})",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT k.r, k.p, arg_min(c.c, {SQUARES} * 1000 + c.c) AS c, min({SQUARES}) AS d FROM kept k JOIN c{n} c USING (p) GROUP BY k.r, k.p)")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT o.p, o.c, coalesce(m.v, o.v) AS v FROM c{n} o LEFT JOIN (
    SELECT p, c, list(x ORDER BY i) AS v FROM (
      SELECT p, c, i, {MEAN} AS x FROM (SELECT a.p, a.c, unnest(range(1, {width + 1})) AS i, unnest(k.v) AS x FROM a{n} a JOIN kept k USING (r, p)) GROUP BY p, c, i)
    GROUP BY p, c) m USING (p, c))""")
    return f"""WITH {", ".join(steps)}, coded AS (
  SELECT r, string_agg(printf('%02x', c), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r
), books AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, c)) AS digest FROM c{rounds})
SELECT w.vec_id, d.code, d.error, CAST(sum(d.error) OVER (PARTITION BY w.label) AS BIGINT) AS label_error, b.digest AS codebooks_sha256
FROM whole w JOIN coded d USING (r) CROSS JOIN books b"""


ORACLES: dict[str, str] = {
    "op12_vector_codes": _codebook_sql(),
    "op13_centroid_clustering": _lloyd_sql(),
    "op8_line_dedup": """
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, ('0x' || left(md5(text), 15))::BIGINT AS mark, text, string_split(text, chr(10)) AS lines FROM documents
), windows AS (
  SELECT doc_id, mark, pos, lines[pos + 1] AS a, lines[pos + 2] AS b, lines[pos + 3] AS c
  FROM (SELECT doc_id, mark, lines, unnest(range(0, len(lines) - 2)) AS pos
    FROM (SELECT DISTINCT doc_id, mark, lines FROM texts) WHERE len(lines) >= 3)
), turns AS (
  SELECT doc_id, mark, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id NULLS FIRST, mark, pos) AS turn
  FROM windows WHERE regexp_matches(a || b || c, '[^\\x20\\x09-\\x0D]')
), cut AS (
  SELECT DISTINCT r, pos + k AS pos
  FROM turns JOIN texts t ON t.doc_id IS NOT DISTINCT FROM turns.doc_id AND t.mark = turns.mark, (SELECT unnest([0, 1, 2]) AS k) WHERE turn > 1
), parts AS (
  SELECT t.r, i AS pos, lines[i + 1] AS line
  FROM (SELECT r, lines, unnest(range(0, len(lines))) AS i FROM texts WHERE text IS NOT NULL) t
), kept AS (
  SELECT p.r, string_agg(p.line, chr(10) ORDER BY p.pos) AS text
  FROM parts p ANTI JOIN cut USING (r, pos) GROUP BY p.r
), gone AS (
  SELECT r, count(*) AS n FROM cut GROUP BY r
)
SELECT t.doc_id, CASE WHEN t.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  CASE WHEN t.text IS NULL THEN 0 ELSE len(t.lines) END AS n_lines, coalesce(g.n, 0) AS n_removed
FROM texts t LEFT JOIN kept k USING (r) LEFT JOIN gone g USING (r)
""",
}
