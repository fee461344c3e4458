"""DuckDB SQL of the operators that SQL can express.

Operator 6: exact sets of word 5-grams (as strings), all pairs that share one,
exact Jaccard, and the transitive closure of the links.  The other operators'
results rest on trained models, tokenizers, robust estimates, 64-bit hashes or
look-around patterns; tests/llm holds them against brute force."""

from __future__ import annotations

from bitextkit.llm.common import LOWER_AZ, UPPER_AZ

OP6 = f"""WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER_AZ}', '{LOWER_AZ}'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(l.m, s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(l.m, s.doc_id)) AS kept
FROM sets s LEFT JOIN least l ON l.a = s.doc_id"""

# Operator 13: phrases by unnesting, scores in 128-bit integers.
OP13 = f"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER_AZ}', '{LOWER_AZ}'),
    '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM words, (VALUES (1), (2), (3)) AS t(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, g, count(*) AS a FROM grams GROUP BY lang, k, g),
total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
often AS MATERIALIZED (SELECT lang, g, a FROM f WHERE a >= 10),
c AS MATERIALIZED (SELECT lang, k, g, a, string_split(g, ' ') AS w FROM f WHERE k >= 2 AND a >= 10),
parts AS MATERIALIZED (
  SELECT lang, g, a, 1 AS cut, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM c
  UNION ALL SELECT lang, g, a, 2, array_to_string(w[1:2], ' '), w[3] FROM c WHERE k = 3),
lefts AS MATERIALIZED (SELECT p.*, o.a AS l FROM parts p JOIN often o ON o.lang = p.lang AND o.g = p.x),
cuts AS (SELECT p.lang, p.g, p.a, p.cut, p.l, o.a AS r, ((1000000::HUGEINT * p.a * p.a) // (p.l::HUGEINT * o.a))::BIGINT AS score
  FROM lefts p JOIN often o ON o.lang = p.lang AND o.g = p.y),
least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
around AS (SELECT lang, g, max(longer) AS longer FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS g, a AS longer FROM c WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3) GROUP BY lang, g),
kept AS (SELECT s.lang, s.g AS phrase, s.a, s.l, s.r, s.score FROM least s LEFT JOIN around i ON i.lang = s.lang AND i.g = s.g
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN total t ON t.lang = r.lang WHERE r.rank <= 2000"""

ORACLE: dict[str, str] = {"op6_minhash_dedup": OP6, "op13_collocations": OP13}
