"""DuckDB SQL of queries that SQL can express."""

OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
),
g AS (
  SELECT rid, unnest(list_transform(range(1, len(ws) - 1), lambda i: {'i': i, 'g': ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]}), recursive := true)
  FROM w WHERE len(ws) >= 3
),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
c AS (
  SELECT w.rid, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON w.rid = rep.rid
),
r AS (
  SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeats, 100 * n_symbols > 10 * n_words AS symbols,
         100 * n_dup_lines > 30 * n_lines AS dup_lines, 100 * n_repeat_words > 30 * n_words AS half_repeats
  FROM c
),
h AS (
  SELECT source, rule, count(*) AS n, sum(CAST(broke AS INT)) AS k
  FROM (SELECT source, unnest(['symbols', 'dup_lines', 'half_repeats']) AS rule, unnest([symbols, dup_lines, half_repeats]) AS broke FROM r)
  GROUP BY source, rule
),
m AS (SELECT rule, sum(k) / sum(n) AS mean FROM h GROUP BY rule),
b AS (SELECT rule, avg((k / n - mean) * (k / n - mean) - k / n * (1 - k / n) / (n - 1)) AS beyond FROM h JOIN m USING (rule) WHERE n > 1 GROUP BY rule),
p AS (SELECT rule, mean, CASE WHEN beyond > 0 THEN greatest(mean * (1 - mean) / beyond - 1, 1.0) ELSE 1e6 END AS weight FROM m LEFT JOIN b USING (rule)),
q AS (SELECT source, rule, n, mean, weight, (k + mean * weight) / (n + weight) AS rate FROM h JOIN p USING (rule)),
v AS (SELECT source, rule, rate - 2 * sqrt(rate * (1 - rate) / (n + weight + 1)) > mean AND rate >= 0.05::DOUBLE AS habit FROM q),
w3 AS (SELECT source, bool_or(habit AND rule = 'symbols') AS s, bool_or(habit AND rule = 'dup_lines') AS d, bool_or(habit AND rule = 'half_repeats') AS hr FROM v GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed,
       NOT (short OR repeats) AND NOT (symbols AND s OR dup_lines AND d OR half_repeats AND hr) AS kept
FROM r JOIN w3 ON r.source IS NOT DISTINCT FROM w3.source
"""

#: Vectors that take part, with integer components.
KEPT = """
kept AS (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
)"""

OP11 = f"""
WITH {KEPT},
pairs AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, c.rid AS crid, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM kept q JOIN kept c ON q.rid <> c.rid WHERE q.vec_id % 50 = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id ASC NULLS LAST, crid) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def _assigned(name: str, books: str) -> str:
    return f"""
{name} AS (
  SELECT rid, part, p, min_by(e, d * 100 + e) AS e, min(d) AS d
  FROM (
    SELECT parts.rid, parts.part, p, b.e, list_sum(list_transform(range(1, len(p) + 1), lambda i: (p[i] - b.z[i]) * (p[i] - b.z[i]))) AS d
    FROM parts JOIN {books} b ON parts.part = b.part
  ) GROUP BY ALL
)"""


def _moved(name: str, assigned: str, books: str) -> str:
    return f"""
{name}_sums AS (
  SELECT part, e, list(floor(s / n) ORDER BY i) AS z
  FROM (SELECT part, e, i, sum(x) AS s, count(*) AS n FROM (SELECT part, e, unnest(p) AS x, unnest(range(len(p))) AS i FROM {assigned}) GROUP BY ALL)
  GROUP BY part, e
),
{name} AS (SELECT b.part, b.e, coalesce(s.z, b.z) AS z FROM {books} b LEFT JOIN {name}_sums s ON b.part = s.part AND b.e = s.e)"""


OP12 = f"""
WITH {KEPT},
cut AS (SELECT rid, vec_id, unnest(range(16)) AS part, v, len(v) // 16 AS w FROM kept),
parts AS (SELECT rid, vec_id, part, list_slice(v, part * w + 1, (part + 1) * w) AS p FROM cut),
start AS (SELECT rid, row_number() OVER (ORDER BY vec_id ASC NULLS LAST, v) - 1 AS e FROM kept QUALIFY e < 64),
b0 AS (SELECT part, e, p AS z FROM parts JOIN start USING (rid)),
{_assigned("a0", "b0")}, {_moved("b1", "a0", "b0")}, {_assigned("a1", "b1")}, {_moved("b2", "a1", "b1")}, {_assigned("a2", "b2")},
codes AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY rid),
digest AS (
  SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, e, i)) AS codebooks_sha256
  FROM (SELECT part, e, unnest(z) AS x, unnest(range(len(z))) AS i FROM b2)
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN codes USING (rid), digest
"""

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[ 	-
]*[^ 	-
]+|[ 	-
]+') AS k,
         list_transform(range(4), lambda i: CAST('0x' || substr(h, 1 + 8 * i, 8) AS BIGINT)) AS r
  FROM d
),
c AS (
  SELECT doc_id, t, k, len(k) AS n, least(r[1] % (len(k) + 1), r[2] % (len(k) + 1)) AS a, greatest(r[1] % (len(k) + 1), r[2] % (len(k) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u
),
p AS (SELECT *, array_to_string(k[1:a], '') AS prefix, array_to_string(k[a + 1:b], '') AS middle, array_to_string(k[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
