"""SQL with the results of the queries that SQL can express, for DuckDB over the same tables."""

SYSTEM_SCORES = """
pairs AS (
  SELECT 'bm25' AS system, query_id, unnest(list_zip(ids, scores)) AS p FROM hits WHERE ids IS NOT NULL AND scores IS NOT NULL
  UNION ALL
  SELECT run, query_id, unnest(list_zip(top, topsims)) FROM ranked WHERE top IS NOT NULL AND topsims IS NOT NULL
),
usable AS (
  SELECT system, query_id, p[1] AS ord, max(p[2]) AS score FROM pairs
  WHERE p[1] IS NOT NULL AND p[2] IS NOT NULL AND NOT isnan(p[2]) GROUP BY ALL
)
"""

P3 = """
WITH good AS (
  SELECT DISTINCT line_no, machine, ranker, CAST(at_ts AS DATE) AS d, ms FROM calls
  WHERE at_ts IS NOT NULL AND ms IS NOT NULL AND NOT isnan(ms) AND ms > 0
),
spans AS (
  SELECT machine, ranker, 'day' AS span, d AS since, ms FROM good
  UNION ALL SELECT machine, ranker, 'week', CAST(date_trunc('week', d) AS DATE), ms FROM good
),
truth AS (
  SELECT machine, ranker, span, since, quantile_cont(ms, 0.5) AS p50, quantile_cont(ms, 0.95) AS p95
  FROM spans GROUP BY ALL
),
figures AS (
  SELECT DISTINCT machine, ranker, span, since, 'p50' AS stat, latencyp50 AS figure FROM summaries
  UNION SELECT DISTINCT machine, ranker, span, since, 'p95', latencyp95 FROM summaries
)
SELECT machine, ranker, span, strftime(since, '%Y-%m-%d') AS since, stat
FROM figures JOIN truth USING (machine, ranker, span, since)
WHERE figure IS NOT NULL AND abs(figure - CASE stat WHEN 'p50' THEN p50 ELSE p95 END) > 0.1 * CASE stat WHEN 'p50' THEN p50 ELSE p95 END
"""

P4 = f"""
WITH {SYSTEM_SCORES},
placed AS (
  SELECT system, query_id, CAST(row_number() OVER (PARTITION BY system, query_id ORDER BY score DESC, ord) AS INTEGER) AS place, ord
  FROM usable
)
SELECT system, query_id, place, ord FROM placed WHERE place <= 10
"""

LEXIMIN = f"""
WITH {SYSTEM_SCORES},
pct AS (
  SELECT system, query_id, ord,
    (rank() OVER (PARTITION BY system, query_id ORDER BY score) - 1
     + (count(*) OVER (PARTITION BY system, query_id, score) + 1) / 2.0) / count(*) OVER (PARTITION BY system, query_id) AS pct
  FROM usable WHERE system IS NOT NULL AND query_id IS NOT NULL
),
full_queries AS (SELECT query_id FROM pct GROUP BY query_id HAVING count(DISTINCT system) = 4),
items AS (
  SELECT query_id, ord, list(pct) AS p FROM pct JOIN full_queries USING (query_id) GROUP BY ALL
),
vectors AS (
  SELECT query_id, ord, list_sort(list_concat(list_transform(range(0, 4 - len(p)), lambda x: CAST(0 AS DOUBLE)), p)) AS weakest FROM items
)
"""

P5 = f"""
{LEXIMIN}
SELECT query_id, ord FROM vectors
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY weakest DESC, ord) = 1
"""

CUTOFFS = """
WITH rows_ AS (SELECT DISTINCT run, set_name, probe, question, random, relevant FROM setdata),
items AS (
  SELECT run, set_name, probe, question, 'random' AS field, unnest(random) AS v, generate_subscripts(random, 1) - 1 AS pos FROM rows_
  UNION ALL
  SELECT run, set_name, probe, question, 'relevant', unnest(relevant), generate_subscripts(relevant, 1) - 1 FROM rows_
),
good AS (SELECT * FROM items WHERE v IS NOT NULL AND NOT isnan(v) AND v BETWEEN 0 AND 2),
shares AS (
  SELECT DISTINCT run, 'random' AS field, random_share AS share FROM searchcutoff
  UNION SELECT DISTINCT run, 'relevant', relevant_share FROM searchcutoff
),
counts AS (SELECT run, set_name, probe, field, v, count(*) AS c FROM good GROUP BY ALL),
upto AS (
  SELECT *, sum(c) OVER (PARTITION BY run, set_name, probe, field ORDER BY v) AS k,
    sum(c) OVER (PARTITION BY run, set_name, probe, field) AS n FROM counts
),
cut AS (
  SELECT run, set_name, probe, field, share, max(CASE WHEN k / n <= share THEN v END) AS cutoff,
    CAST(coalesce(max(CASE WHEN k / n <= share THEN k END), 0) AS BIGINT) AS kept, CAST(max(n) AS BIGINT) AS n
  FROM upto JOIN shares USING (run, field) WHERE share IS NOT NULL GROUP BY ALL
)
"""

P6 = f"""
{CUTOFFS}
SELECT run, set_name, probe, question, field, CAST(pos AS INTEGER) AS pos
FROM good JOIN cut USING (run, set_name, probe, field) WHERE v <= cutoff
"""

P6_CUTOFFS = f"""
{CUTOFFS}
SELECT cut.run, set_name, probe, field, share, cutoff, kept, n, question AS in_force
FROM cut LEFT JOIN (SELECT DISTINCT run, question FROM searchcutoff) s ON s.run = cut.run
"""

P7 = """
SELECT DISTINCT id, CASE WHEN regexp_matches(text, '[^\\n .!?。！？]{1000}[^\\n .!?。！？]{201}') THEN 'yes' ELSE 'no' END AS forced
FROM passages WHERE length(text) > 1200
"""

P3_BOUNDS = f"""
WITH {P3[P3.index("good AS") : P3.index("truth AS")]}
counts AS (SELECT machine, ranker, span, since, count(*) AS n FROM spans GROUP BY ALL)
SELECT machine, ranker, span, since, unnest(['p50', 'p95']) AS stat, n, true AS inside FROM counts
"""

P5_RANKING = f"""
{LEXIMIN}
SELECT query_id, ord, round(weakest[1], 9) AS weakest,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY weakest DESC, ord) AS INTEGER) AS place
FROM vectors
"""

P1_NEAREST = """
WITH rows_ AS (
  SELECT DISTINCT 'chunks' AS collection, CAST(id AS BIGINT) AS key, embedding AS v, 384 AS width FROM chunks
  UNION SELECT DISTINCT set_name, CAST(ord AS BIGINT), vec, 64 FROM vectors
),
good AS (
  SELECT collection, key, CAST(v AS DOUBLE[]) AS v FROM rows_
  WHERE v IS NOT NULL AND len(v) = width AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
),
pairs AS (
  SELECT a.collection, a.key, b.key AS other, round(list_cosine_similarity(a.v, b.v), 9) AS cos
  FROM good a JOIN good b ON a.collection = b.collection AND a.key <> b.key WHERE a.key % 20 = 0
),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY collection, key ORDER BY cos DESC, other) AS INTEGER) AS place FROM pairs)
SELECT collection, key, place, other, round(cos, 6) AS similarity FROM placed WHERE place <= 10
"""

# Texts are cut into blocks first, as finding a place in a long text takes time in proportion to the place.
GRAMS = """
docs AS (SELECT doc_id, min(text) AS text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL GROUP BY doc_id),
blocks AS (
  SELECT doc_id, start, substr(text, start + 1, 1199) AS block
  FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 199, 0), 1000)) AS start FROM docs)
),
grams AS (
  SELECT doc_id, start + i AS place, md5(substr(block, CAST(i AS INTEGER) + 1, 200)) AS g
  FROM (SELECT doc_id, start, block, unnest(range(0, length(block) - 199)) AS i FROM blocks)
),
shared AS (SELECT g FROM grams GROUP BY g HAVING count(DISTINCT doc_id) > 1),
held AS (SELECT doc_id, place, g FROM grams JOIN shared USING (g))
"""

P10 = f"""
WITH {GRAMS}, one AS (SELECT DISTINCT doc_id, g FROM held)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM one a JOIN one b ON a.g = b.g AND a.doc_id < b.doc_id
"""

P10_COVERAGE = f"""
WITH {GRAMS},
steps AS (SELECT doc_id, least(200, place - lag(place, 1, -200) OVER (PARTITION BY doc_id ORDER BY place)) AS new FROM held),
per AS (SELECT doc_id, CAST(sum(new) AS BIGINT) AS shared FROM steps GROUP BY doc_id)
SELECT d.doc_id, length(d.text) AS length, coalesce(shared, 0) AS shared, CASE WHEN length(d.text) > 0 THEN coalesce(shared, 0) / length(d.text) ELSE 0.0 END AS share
FROM documents d LEFT JOIN per ON per.doc_id = d.doc_id
"""

ORACLE: dict[str, str] = {"p1_nearest": P1_NEAREST, "p3_bounds": P3_BOUNDS, "p5_ranking": P5_RANKING, "p10_found": P10, "p10_coverage": P10_COVERAGE, "p3_found": P3, "p4_found": P4, "p5_found": P5, "p6_found": P6, "p6_cutoffs": P6_CUTOFFS, "p7_found": P7}
