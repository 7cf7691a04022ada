"""DuckDB SQL for the results of this subpackage's queries, where SQL can express them."""

from __future__ import annotations

LINE_DEDUP = r"""
WITH n AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS v FROM documents),
p AS (
  SELECT doc_id, text, v, list_filter(range(1, len(v) + 1), lambda i: regexp_matches(v[i], '[^\x20\x09-\x0D]')) AS pos FROM n),
w AS (
  SELECT doc_id, pos, list_transform(pos, lambda i: len(regexp_extract_all(v[i], '[^\x20\x09-\x0D]+'))) AS words FROM p),
s AS (
  SELECT doc_id, len(pos) AS n, words, unnest(range(1, len(pos) + 1)) AS i FROM w),
lengths AS (SELECT unnest(range(0, 50)) AS k),
ahead AS (
  SELECT doc_id, i, min(k) AS k FROM s, lengths WHERE i + k <= n AND list_sum(words[i:i + k]) >= 50 GROUP BY doc_id, i),
behind AS (
  SELECT doc_id, i, min(k) AS k FROM s, lengths WHERE i - k >= 1 AND list_sum(words[i - k:i]) >= 50 GROUP BY doc_id, i),
runs AS (
  SELECT doc_id, i AS a, i + k AS b FROM ahead UNION SELECT doc_id, i - k AS a, i AS b FROM behind),
named AS (
  SELECT doc_id, a, b, array_to_string(list_transform(pos[a:b], lambda x: v[x]), chr(10)) AS run FROM runs JOIN p USING (doc_id)),
told AS (
  SELECT doc_id, a, b, first_value(doc_id) OVER f AS doc_1, first_value(b) OVER f AS b_1, row_number() OVER f AS r
  FROM named WINDOW f AS (PARTITION BY run ORDER BY doc_id, a)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_1 = doc_id THEN greatest(a, b_1 + 1) ELSE a END, b + 1)) AS i
  FROM told WHERE r > 1),
islands AS (
  SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM gone),
cut AS (
  SELECT doc_id, min(i) AS i, max(i) AS j FROM islands GROUP BY doc_id, g),
cuts AS (
  SELECT doc_id, list(pos[i]) AS froms, list(pos[j]) AS tos FROM cut JOIN p USING (doc_id) GROUP BY doc_id),
cleaned AS (
  SELECT doc_id, text, v, froms, list_filter(range(1, len(v) + 1), lambda x:
    froms IS NULL OR len(list_filter(range(1, len(froms) + 1), lambda q: froms[q] <= x AND x <= tos[q])) = 0) AS kept
  FROM p LEFT JOIN cuts USING (doc_id)),
joined AS (
  SELECT *, CASE WHEN froms IS NULL THEN text ELSE array_to_string(list_transform(kept, lambda x: v[x]), chr(10)) END AS new
  FROM cleaned)
SELECT doc_id, new AS text, CAST(coalesce(len(v), 0) AS INT) AS n_lines,
  CAST(coalesce(len(v) - len(kept), 0) AS INT) AS n_removed,
  froms IS NOT NULL AND NOT regexp_matches(new, '[^\x20\x09-\x0D]') AS emptied
FROM joined
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

LEXICAL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
d AS (SELECT doc_id, len(t) AS n, t FROM t WHERE len(t) > 0),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM d) GROUP BY doc_id, n, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
s AS (
  SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM i JOIN f USING (term) JOIN p USING (term), g GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 10
"""


def lloyd_sql(k: int = 40, rounds: int = 5) -> str:
    """Every round compares every vector with every centroid and adds up anew."""
    parts = [
        """v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), e) - 1 AS INT) AS c, e AS p FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id), e) <= {k})""",
    ]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (
  SELECT vec_id, r, any_value(e) AS e, min({{'d': d, 'c': c}}) AS o FROM (
    SELECT vec_id, r, e, c, CAST(list_sum(list_transform(list_zip(e, p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM v, c{n}) GROUP BY vec_id, r)""")
        if n < rounds:
            parts.append(f"""s{n} AS (
  SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
    SELECT o.c AS c, unnest(range(1, 65)) AS i, unnest(e) AS x FROM a{n}) GROUP BY c, i),
m{n} AS (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS p FROM s{n} GROUP BY c),
c{n + 1} AS MATERIALIZED (
  SELECT c, coalesce(m{n}.p, c{n}.p) AS p FROM c{n} LEFT JOIN m{n} USING (c))""")
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, o.c AS cluster, o.d AS distance, CAST(sum(o.d) OVER (PARTITION BY o.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(o.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(p, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON o.c = c{rounds}.c
"""


ORACLE_SQL: dict[str, str] = {"op1_exact_topk": TOP_K, "op4_line_dedup": LINE_DEDUP, "op11_inverted_treaps": LEXICAL, "op13_delta_lloyd": lloyd_sql()}
