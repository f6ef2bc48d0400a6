"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

STATEMENTS: dict[str, str] = {}

# Words, lines and three-word windows of whole texts; the thresholds are those of quality.THRESHOLDS.
STATEMENTS["op5_quality_rules"] = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines
  FROM documents
), placed AS (
  SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM texts
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n
  FROM placed WHERE i + 2 <= len(words)
), repeated AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM windows WHERE n > 1) GROUP BY doc_id
), counts AS (
  SELECT t.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(array_to_string(words, '')) - length(regexp_replace(array_to_string(words, ''), '[#*$%&|<>]', '', 'g'))
           AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(words, lambda w: lower(w) IN (@STOP@))) AS n_stop_words
  FROM texts t LEFT JOIN repeated r USING (doc_id)
), based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars / nullif(n_words, 0) BETWEEN 2 AND 15
         AND coalesce(n_symbols / nullif(word_chars, 0), 0) <= 0.03
         AND n_stop_words / nullif(n_words, 0) >= 0.05 AND coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.5 AS kept
FROM based
"""

# All pairs of queries and candidates in double precision.
STATEMENTS["op1_block_matrix_ann"] = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

# All pairs by an inverted index; components as what is reachable.
STATEMENTS["op6_minhash_near_dedup"] = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'),
         lambda w: w <> '') AS w
  FROM documents
), shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) > 1
           THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END) AS s
  FROM texts
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reached r JOIN both_ways l ON l.a = r.other
), least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""

# The template tree level by level, then merging, smoothing and the rules.
STATEMENTS["op2_url_filters"] = r"""
WITH RECURSIVE cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
           AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/') THEN 'org/' END AS rule
  FROM parsed
), said AS (
  SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS says FROM ruled
), level AS (
  SELECT 0 AS depth, host, path, count(*) AS n, count(*) FILTER (says = 'allow') AS good,
         count(*) FILTER (says = 'block') AS bad, string_split(ltrim(path, '/'), '/') AS segments, '' AS template
  FROM said GROUP BY host, path
  UNION ALL
  SELECT depth + 1, host, path, n, good, bad, segments, template || '/' || CASE
    WHEN regexp_matches(segments[depth + 1], '[0-9]') OR (total >= 8 AND kinds > 0.5 * total)
    THEN '*' || regexp_extract(segments[depth + 1], '[.][a-z]+$') ELSE segments[depth + 1] END
  FROM (
    SELECT *, sum(n) OVER node AS total, count(DISTINCT segments[depth + 1]) OVER node AS kinds
    FROM level WHERE len(segments) > depth WINDOW node AS (PARTITION BY host, template)
  )
), placed AS (
  SELECT host, path, good, bad, template FROM level WHERE len(segments) = depth
), merging AS (
  SELECT max(len(template) - len(replace(template, '/', ''))) OVER () AS d, host, template, sum(good) AS good,
         sum(bad) AS bad, string_split(substr(template, 2), '/') AS m
  FROM placed GROUP BY host, template
  UNION ALL
  SELECT d - 1, host, template, good, bad, CASE
    WHEN len(m) >= d AND coalesce(abs(b / nullif(one, 0) - (b_all - b) / nullif(others, 0))
           <= 1.96 * sqrt(pooled * (1 - pooled) * (1.0 / nullif(one, 0) + 1.0 / nullif(others, 0))), false)
    THEN m[:d - 1] || ['?'] || m[d + 1:] ELSE m END
  FROM (
    SELECT *, g + b AS one, g_all + b_all - g - b AS others, b_all / nullif(g_all + b_all, 0) AS pooled FROM (
      SELECT *, sum(good) OVER own AS g, sum(bad) OVER own AS b, sum(good) OVER kin AS g_all, sum(bad) OVER kin AS b_all
      FROM merging WHERE d > 0
      WINDOW own AS (PARTITION BY host, m), kin AS (PARTITION BY host, len(m) >= d, m[:d - 1], m[d + 1:])
    )
  )
), counted AS (
  SELECT host, template, '/' || array_to_string(m, '/') AS merged, sum(good) OVER (PARTITION BY host, m) AS good,
         sum(bad) OVER (PARTITION BY host, m) AS bad, sum(good) OVER (PARTITION BY host) AS good_host,
         sum(bad) OVER (PARTITION BY host) AS bad_host, sum(good) OVER () AS good_total, sum(bad) OVER () AS bad_total
  FROM merging WHERE d = 0
), scored AS (
  SELECT host, template, merged,
         (bad + 4.0 * ((bad_host + 4.0 * ((bad_total + 1.0) / (good_total + bad_total + 2.0))) / (good_host + bad_host + 4.0)))
         / (good + bad + 4.0) AS purity
  FROM counted
)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN purity >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict, template,
       merged, round(purity, 9) AS purity
FROM said JOIN placed USING (host, path) JOIN scored USING (host, template)
"""


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _fill() -> None:
    from dockflow.llm.quality import STOP_WORDS

    STATEMENTS["op5_quality_rules"] = STATEMENTS["op5_quality_rules"].replace("@STOP@", _quoted(STOP_WORDS))


_fill()

# Five rounds unrolled; centroids and vectors as lists of integers, floor of the mean by integer division.
_ROUND = """
a{i} AS MATERIALIZED (
  SELECT vec_id, v, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM (
    SELECT row, vec_id, v, cluster, list_sum(list_transform(range(1, 65), lambda d: (v[d] - c[d]) * (v[d] - c[d]))) AS distance
    FROM kept, c{i}
  ) GROUP BY row, vec_id, v
)"""
_MOVE = """, c{j} AS MATERIALIZED (
  SELECT cluster, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN (
    SELECT cluster, list(m ORDER BY d) AS c FROM (
      SELECT cluster, d, floor_div(sum(v[d]), count(*)) AS m FROM a{i}, range(1, 65) t(d) GROUP BY cluster, d
    ) GROUP BY cluster
  ) n USING (cluster)
), """

STATEMENTS["op11_centroid_clusters"] = (
    """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1)::INTEGER AS cluster, v AS c
  FROM kept ORDER BY cluster LIMIT 40
), """
    + "".join(_ROUND.format(i=i) + (_MOVE.format(i=i, j=i + 1) if i < 5 else "") for i in range(6))
    + """
SELECT vec_id, cluster, distance::BIGINT AS distance,
       (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a5 JOIN c5 USING (cluster)
"""
).replace("floor_div(sum(v[d]), count(*))", "((sum(v[d]) - ((sum(v[d]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT")

# Every phrase of up to five words by its position; parts by the number of their words.
STATEMENTS["op12_collocations"] = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, words FROM (
    SELECT coalesce(lang, 'und') AS lang, list_filter(string_split(piece, ' '), lambda w: w <> '') AS words FROM (
      SELECT lang, replace(unnest(string_split_regex(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[.,;:!?
-
]')), chr(9), ' ') AS piece
      FROM documents
    )
  ) WHERE len(words) > 0
), placed AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces
), sizes AS (
  SELECT lang, count(*)::HUGEINT AS n FROM placed GROUP BY lang
), freq AS MATERIALIZED (
  SELECT lang, words[i:i + m - 1] AS p, m, count(*)::HUGEINT AS a
  FROM placed, range(1, 6) t(m) WHERE i + m - 1 <= len(words) GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT f.lang, f.p, f.m, f.a, k, l.a AS l, r.a AS r, n, (1000 * f.a * n) // (l.a * r.a) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM freq WHERE m > 1) f JOIN sizes USING (lang)
  JOIN freq l ON l.lang = f.lang AND l.p = f.p[1:k] JOIN freq r ON r.lang = f.lang AND r.p = f.p[k + 1:]
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), inner_parts AS (
  SELECT lang, p[i:i + size - 1] AS p, max(a) AS longer
  FROM (SELECT lang, p, m, a, unnest(range(2, m)) AS size FROM freq WHERE m > 2), range(1, 5) t(i)
  WHERE i + size - 1 <= m GROUP BY ALL
), kept AS (
  SELECT b.*, array_to_string(b.p, ' ') AS phrase FROM best b LEFT JOIN inner_parts i USING (lang, p)
  WHERE longer IS NULL OR 100 * longer < 100 * b.a
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
WHERE rank <= 2000
"""
