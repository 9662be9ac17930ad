"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

LINE_DEDUP = r"""
WITH lines AS (
  SELECT row_number() OVER () AS turn, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), placed AS (
  SELECT turn, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM lines
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM placed
), shared AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT turn, k.doc_id, place, line, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.last AS dropped FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY turn
"""


def vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, width: int = 8) -> str:
    """Each round is two tables: the codes of all parts, then the entries they make."""
    kept = f"""
WITH rows AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pieces AS MATERIALIZED (
  SELECT vec_id, p AS part, list_slice(v, p * {width} + 1, (p + 1) * {width}) AS x FROM rows, range({parts}) t(p)
), book0 AS MATERIALIZED (
  SELECT part, entry, x AS c FROM pieces JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM rows ORDER BY vec_id LIMIT {entries}) USING (vec_id)
)"""
    far = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    coded = lambda k: f""", near{k} AS MATERIALIZED (
  SELECT vec_id, part, any_value(x) AS x, min({{'far': CAST({far} AS HUGEINT), 'entry': entry}}) AS best FROM pieces JOIN book{k} USING (part) GROUP BY vec_id, part
)"""  # noqa: E731
    renewed = lambda k: f""", sums{k} AS MATERIALIZED (
  SELECT part, entry, place, sum(v) AS total, count(*) AS n FROM (SELECT part, best.entry AS entry, unnest(x) AS v, unnest(range({width})) AS place FROM near{k}) GROUP BY ALL
), means{k} AS MATERIALIZED (
  SELECT part, entry, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY place) AS c FROM sums{k} GROUP BY part, entry
), book{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN means{k} m USING (part, entry)
)"""  # noqa: E731
    steps = "".join(coded(k) + renewed(k) for k in range(rounds)) + coded(rounds)
    return (
        kept
        + steps
        + f""", codes AS (
  SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
FROM codes JOIN rows USING (vec_id)
"""
    )
