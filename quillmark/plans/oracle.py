"""The queries' results as SQL for DuckDB over the same tables, where SQL can express them."""

from __future__ import annotations

from quillmark.functions.text import SIMPLIFIED, TRADITIONAL
from quillmark.operators.calls import REFUSED, RETRYABLE

ORACLE: dict[str, str] = {}

WORD = r"[\p{L}\p{N}_]+"
P = "p AS (SELECT DISTINCT ord, id, set_name, sample, title, section, text FROM passages)"
TITLES = "titles AS (SELECT ord AS query, title AS text FROM p WHERE ord % 20 = 0 AND coalesce(title, '') <> '')"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


# --- Keyword search ---

ORACLE["token_counts"] = rf"""
WITH {P}, t AS (SELECT ord, regexp_extract_all(lower(text), '{WORD}') AS w FROM p WHERE text IS NOT NULL)
SELECT ord, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM t"""

ORACLE["term_frequencies"] = rf"""
WITH {P}, t AS (SELECT ord, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM p)
SELECT term, count(DISTINCT ord) AS df, CAST(count(*) AS BIGINT) AS cf FROM t GROUP BY term"""


def bm25(name: str, column: str, k1: float = 0.9, b: float = 0.4) -> str:
    return rf"""
{name}_w AS (SELECT ord AS doc, unnest(regexp_extract_all(lower({column}), '{WORD}')) AS term, len(regexp_extract_all(lower({column}), '{WORD}')) AS length FROM p),
{name}_tf AS (SELECT doc, term, length, count(*) AS tf FROM {name}_w GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name}_f AS (SELECT count(*) AS docs, avg(coalesce(len(regexp_extract_all(lower({column}), '{WORD}')), 0)) AS mean_length FROM p),
{name}_q AS (SELECT DISTINCT query, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM titles),
{name} AS (
  SELECT query, doc, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * {k1 + 1} / (tf + {k1} * ({1 - b} + {b} * length / mean_length))) AS score
  FROM {name}_q JOIN {name}_tf USING (term) JOIN {name}_df USING (term), {name}_f GROUP BY query, doc
)"""


def best(source: str, k: int = 10) -> str:
    return f"""
, rounded AS (SELECT query, doc, {r6("score")} AS score FROM {source}),
placed AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank, score FROM rounded)
SELECT query, doc, CAST(rank AS INTEGER) AS rank, score FROM placed WHERE rank <= {k}"""


ORACLE["bm25_topk"] = f"WITH {P}, {TITLES}, {bm25('s', 'text')} {best('s')}"
ORACLE["bm25_excluding_own_document"] = f"""
WITH {P}, {TITLES}, {bm25("s", "text")},
other AS (SELECT s.* FROM s JOIN p a ON a.ord = s.query JOIN p b ON b.ord = s.doc WHERE split_part(a.id, '#', 1) <> split_part(b.id, '#', 1))
{best("other")}"""
ORACLE["bm25_best_column"] = f"""
WITH {P}, {TITLES}, {bm25("a", "text")}, {bm25("b", "title")},
m AS (SELECT query, doc, max(score) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY query, doc)
{best("m")}"""

LEAK_DOCS = """
docs AS (
  SELECT CAST(g AS BIGINT) AS id, 'weekly update on the office move, budget and hiring plan number ' || g AS body, 'everyone' AS reader, 1 AS added FROM range(1, 201) t(g)
  UNION ALL SELECT * FROM (VALUES {notes})
)"""


def probed(notes: str, words: str, steps: str = "(1), (2), (3)") -> str:
    return rf"""
{LEAK_DOCS.format(notes=notes)},
grown AS (SELECT step, id, reader, regexp_extract_all(lower(body), '{WORD}') AS w FROM docs, (VALUES {steps}) s(step) WHERE added <= step),
facts AS (SELECT step, count(*) AS docs, avg(len(w)) AS mean_length FROM grown GROUP BY step),
hits AS (SELECT step, id, reader, length, word, count(*) AS tf FROM (SELECT step, id, reader, len(w) AS length, unnest(w) AS word FROM grown) WHERE word IN ({words}) GROUP BY ALL),
df AS (SELECT step, word, count(*) AS df FROM hits GROUP BY ALL),
scored AS (
  SELECT step, word, id, ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length)) AS score
  FROM hits JOIN df USING (step, word) JOIN facts USING (step) WHERE reader IN ('liv', 'everyone')
)"""


LEAK = probed(
    "(201, 'layoff marker1 marker2', 'liv', 1), (202, 'marker2', 'liv', 1), (203, 'q2 layoff: restructuring plan, roles affected in q2', 'hr', 2),"
    " (204, 'layoff notes 1', 'hr', 3), (205, 'layoff notes 2', 'hr', 3), (206, 'layoff notes 3', 'hr', 3), (207, 'layoff notes 4', 'hr', 3)",
    "'layoff', 'marker1', 'marker2'",
)
ORACLE["bm25_leak_scores"] = f"WITH {LEAK} SELECT step, word, round(score, 2) AS score FROM scored WHERE id = 201"
ORACLE["bm25_leak_estimate"] = f"""
WITH {LEAK},
s AS (
  SELECT max(round(score, 2)) FILTER (WHERE word = 'layoff') AS k, max(round(score, 2)) FILTER (WHERE word = 'marker1') AS p, max(round(score, 2)) FILTER (WHERE word = 'marker2') AS w
  FROM scored WHERE id = 201 AND step = 3
),
size AS (SELECT k, p, arg_min(n, abs(ln(1 + (n - 1.5) / 2.5) / ln(1 + (n - 0.5) / 1.5) - w / p)) AS documents FROM s, range(3, 100001) r(n) GROUP BY k, p),
held AS (SELECT documents, arg_min(n, abs(ln(1 + (documents - n + 0.5) / (n + 0.5)) / ln(1 + (documents - 0.5) / 1.5) - k / p)) AS holding FROM size, range(1, 1001) r(n) GROUP BY documents)
SELECT documents, holding, (SELECT count(*) FROM docs WHERE list_contains(regexp_extract_all(lower(body), '{WORD}'), 'layoff') AND reader IN ('liv', 'everyone')) AS readable FROM held"""
ORACLE["bm25_order_flip"] = f"""
WITH {probed("(201, 'note layoff', 'liv', 1), (202, 'note marker2', 'liv', 1), (203, 'marker2', 'liv', 1), (204, 'q2 layoff: restructuring plan', 'hr', 2), (205, 'layoff notes 2', 'hr', 3)", "'layoff', 'marker2'")},
t AS (SELECT step, id, round(sum(score), 9) AS score FROM scored WHERE id IN (201, 202) GROUP BY ALL)
SELECT step, CAST(row_number() OVER (PARTITION BY step ORDER BY score DESC, id) AS INTEGER) AS pos, id FROM t"""

# --- Vector search ---

CHUNKS = """
c AS (
  SELECT DISTINCT id, topic, readers, CAST(embedding AS DOUBLE[]) AS v FROM chunks
  WHERE len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
)"""
COS = "1 - list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))"
ORACLE["vector_norms"] = f"""
WITH {CHUNKS} SELECT id, {r6("sqrt(list_dot_product(v, v))")} AS norm, {r6("v[1] / sqrt(list_dot_product(v, v))")} AS first FROM c"""
ORACLE["knn_exact_topk"] = f"""
WITH {CHUNKS},
d AS (SELECT a.id AS query, b.id AS key, round({COS.format(a="a.v", b="b.v")}, 9) AS distance FROM c a, c b WHERE a.id % 20 = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, key) AS rank FROM d)
SELECT query, key, CAST(rank AS INTEGER) AS rank, {r6("distance")} AS distance FROM placed WHERE rank <= 10"""
ONE = f"""
{CHUNKS},
q AS (SELECT arg_min(v, id) AS q FROM c),
d AS (SELECT id, topic, coalesce(readers, []) AS readers, round({COS.format(a="v", b="q")}, 9) AS distance FROM c, q)"""
MAY = "(list_contains(readers, 'everyone') OR list_contains(readers, 'mara'))"
OUT = f"SELECT id, topic, {r6('distance')} AS distance FROM"
ORACLE["permission_filtered_knn"] = f"WITH {ONE} {OUT} (SELECT * FROM d WHERE {MAY} ORDER BY distance, id LIMIT 10)"
ORACLE["knn_cutoff_inside"] = f"WITH {ONE} {OUT} (SELECT * FROM d WHERE {MAY} AND distance < 0.9 ORDER BY distance, id LIMIT 10)"
ORACLE["knn_cutoff_outside"] = f"WITH {ONE} {OUT} (SELECT * FROM d WHERE {MAY} ORDER BY distance, id LIMIT 10) WHERE distance < 0.9"
ORACLE["knn_post_filter_budget"] = f"WITH {ONE} {OUT} (SELECT * FROM (SELECT * FROM d ORDER BY distance, id LIMIT 40) WHERE {MAY} ORDER BY distance, id LIMIT 10)"
ORACLE["knn_scan_budgets"] = f"WITH {ONE} {OUT} (SELECT * FROM (SELECT * FROM d ORDER BY distance, id LIMIT 100) WHERE {MAY} ORDER BY distance, id LIMIT 10)"
ORACLE["first_visible_rank"] = f"WITH {ONE} SELECT min(r) AS rank FROM (SELECT readers, row_number() OVER (ORDER BY distance, id) AS r FROM d) WHERE list_contains(readers, 'mara')"
ORACLE["within_cutoff_by_topic"] = f"WITH {ONE} SELECT topic, count(*) AS n FROM d WHERE {MAY} AND distance < 1.0 GROUP BY topic"

# --- Ranked lists ---

LISTS = """
pairs AS (
  SELECT 'bm25' AS system, query_id AS query, unnest(list_zip(ids, scores)) AS p FROM hits WHERE ids IS NOT NULL AND scores IS NOT NULL
  UNION ALL SELECT run, query_id, unnest(list_zip(top, topsims)) FROM ranked WHERE top IS NOT NULL AND topsims IS NOT NULL
),
u AS (SELECT system, query, p[1] AS doc, max(p[2]) AS score FROM pairs WHERE p[1] IS NOT NULL AND p[2] IS NOT NULL AND NOT isnan(p[2]) GROUP BY ALL),
l AS (SELECT *, row_number() OVER (PARTITION BY system, query ORDER BY score DESC, doc DESC) AS rank FROM u),
j AS (SELECT query, doc, CAST(count(DISTINCT system) - 1 AS INTEGER) AS grade FROM l WHERE rank <= 10 GROUP BY ALL),
g AS (SELECT * FROM j WHERE grade > 0),
ideal AS (
  SELECT query, sum(grade / log2(r + 1)) FILTER (WHERE r <= 10) AS ideal, count(*) AS relevant
  FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, doc) AS r FROM g) GROUP BY query
),
first_run AS (SELECT min(run) AS a, max(run) AS z FROM ranked)"""


def measured(name: str, source: str, keys: str) -> str:
    return f"""
{name}_g AS (
  SELECT {keys}, query, coalesce(sum(grade / log2(rank + 1)) FILTER (WHERE rank <= 10), 0) AS gain, count(grade) FILTER (WHERE rank <= 24) AS f24, count(grade) FILTER (WHERE rank <= 100) AS f100,
    coalesce(min(rank) FILTER (WHERE grade IS NOT NULL), 0) AS first_rank
  FROM {source} LEFT JOIN g USING (query, doc) GROUP BY {keys}, query
),
{name} AS (
  SELECT {keys}, query, coalesce(gain / ideal, 0) AS ndcg, coalesce(f24 / relevant, 0) AS recall24, coalesce(f100 / relevant, 0) AS recall100,
    CAST(first_rank = 1 AS INTEGER) AS hit1, first_rank, CASE WHEN first_rank > 0 THEN 1 / first_rank ELSE 0 END AS rr
  FROM {name}_g LEFT JOIN ideal USING (query)
)"""


M = f"{LISTS}, {measured('m', 'l', 'system')}"
STRATUM = "st AS (SELECT query, set_name FROM l JOIN p ON p.ord = l.doc WHERE system = 'bm25' AND rank = 1)"

ORACLE["ranking_metrics"] = f"""
WITH {M} SELECT system, query, {", ".join(f"{r6(c)} AS {c}" for c in ("ndcg", "recall24", "recall100", "rr"))}, hit1, first_rank FROM m"""
ORACLE["metrics_by_system"] = f"""
WITH {M} SELECT system, count(*) AS questions, {", ".join(f"{r6(f'avg({c})')} AS {c}" for c in ("ndcg", "recall24", "recall100", "hit1", "rr"))} FROM m GROUP BY system"""
ORACLE["macro_mean_by_set"] = f"""
WITH {P}, {M}, {STRATUM}, s AS (SELECT system, set_name, avg(ndcg) AS x FROM m JOIN st USING (query) GROUP BY ALL)
SELECT system, {r6("avg(x)")} AS macro_ndcg, count(*) AS strata FROM s GROUP BY system"""
ORACLE["ndcg_in_list"] = f"""
WITH {LISTS},
x AS (SELECT system, query, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rank <= 10 AND grade IS NOT NULL), 0) AS gain, count(grade) AS n FROM l LEFT JOIN g USING (query, doc) GROUP BY ALL)
SELECT system, query, {r6("CASE WHEN n > 0 THEN gain / list_sum(list_transform(range(1, least(n, 10) + 1), lambda r: 1 / log2(r + 1))) ELSE 0 END")} AS ndcg FROM x"""
RANKABLE = f"""{LISTS},
c AS (SELECT query, doc FROM l WHERE system = 'bm25' AND rank <= 24),
rk AS (SELECT query, count(grade) > 0 AS rankable FROM c LEFT JOIN g USING (query, doc) GROUP BY query)"""
ORACLE["rankable_questions"] = f"WITH {RANKABLE} SELECT query, rankable FROM rk"
ORACLE["candidate_recall"] = f"WITH {RANKABLE} SELECT count(*) AS questions, count(*) FILTER (WHERE rankable) AS rankable, {r6('avg(CAST(rankable AS INTEGER))')} AS recall FROM rk"
ORACLE["stage_overlap"] = f"""
WITH {M},
a AS (SELECT query, first_rank BETWEEN 1 AND 3 AS f FROM m, first_run WHERE system = a),
z AS (SELECT query, first_rank BETWEEN 1 AND 3 AS f FROM m, first_run WHERE system = first_run.z)
SELECT count(*) FILTER (WHERE a.f AND z.f) AS in_both, count(*) FILTER (WHERE a.f AND NOT z.f) AS only_a, count(*) FILTER (WHERE NOT a.f AND z.f) AS only_b, count(*) FILTER (WHERE NOT a.f AND NOT z.f) AS neither
FROM a JOIN z USING (query)"""
ORACLE["kept_gained_lost"] = f"""
WITH {M}
SELECT b.system, count(*) FILTER (WHERE a.hit1 = 1 AND b.hit1 = 1) AS kept, count(*) FILTER (WHERE a.hit1 = 0 AND b.hit1 = 1) AS gained, count(*) FILTER (WHERE a.hit1 = 1 AND b.hit1 = 0) AS lost
FROM m b JOIN m a ON a.system = 'bm25' AND a.query = b.query WHERE b.system <> 'bm25' GROUP BY b.system"""
ORACLE["judged_status"] = f"""
WITH {LISTS}
SELECT system, CASE WHEN grade IS NULL THEN 'not judged' WHEN grade > 0 THEN 'relevant' ELSE 'judged not relevant' END AS judged, count(*) AS n
FROM l LEFT JOIN j USING (query, doc) WHERE rank <= 20 GROUP BY ALL"""
ORACLE["recall_by_set"] = f"""
WITH {P}, {LISTS}
SELECT asked.system, set_name, count(*) AS relevant, {r6("avg(CASE WHEN f.doc IS NULL THEN 0 ELSE 1 END)")} AS recall24
FROM (SELECT DISTINCT system, query FROM l) asked JOIN g USING (query) JOIN p ON p.ord = g.doc
LEFT JOIN (SELECT system, query, doc FROM l WHERE rank <= 24) f ON f.system = asked.system AND f.query = asked.query AND f.doc = g.doc GROUP BY ALL"""

ORACLE["questions_without_hits"] = f"""
WITH {LISTS}, held AS (SELECT DISTINCT query FROM l WHERE system = 'bm25')
SELECT system, count(*) AS questions, count(*) FILTER (WHERE held.query IS NULL) AS without_hits
FROM (SELECT DISTINCT system, query FROM l WHERE system <> 'bm25') x LEFT JOIN held ON held.query = x.query GROUP BY system"""
ORACLE["best_other"] = f"""
WITH {LISTS}, rest AS (SELECT l.* FROM l LEFT JOIN g USING (query, doc) WHERE grade IS NULL)
SELECT system, query, doc, CAST(rank AS INTEGER) AS rank, {r6("score")} AS score FROM rest QUALIFY row_number() OVER (PARTITION BY system, query ORDER BY rank) = 1"""
ORACLE["rank_rule_pools"] = f"""
WITH {M},
b AS (SELECT a.first_rank AS ra, z.first_rank AS rz FROM m a JOIN m z ON a.query = z.query, first_run WHERE a.system = first_run.a AND z.system = first_run.z)
SELECT count(*) FILTER (WHERE ra = 1 AND rz BETWEEN 3 AND 10) AS first_better, count(*) FILTER (WHERE rz = 1 AND ra BETWEEN 3 AND 10) AS last_better, count(*) FILTER (WHERE ra = 1 AND rz = 1) AS both_first FROM b"""
LINES = "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')"
PROSE = rf"list_filter({LINES}, lambda x: NOT regexp_matches(x, '^\s*(#|\||>|:::)'))"
SNIPPETS = rf"""
b AS (SELECT ord, section, array_to_string(CASE WHEN len({PROSE}) > 0 THEN {PROSE} ELSE {LINES} END, ' ') AS t FROM p),
sn AS (
  SELECT ord, section, left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '\\', '', 'g'), '[*_`#|]', '', 'g'), '-{{3,}}', '', 'g'), '\s+', ' ', 'g')), 180) AS snippet FROM b
)"""
ORACLE["top_examples"] = f"""
WITH {P}, {LISTS}, {SNIPPETS}
SELECT system, query, CAST(rank AS INTEGER) AS rank, doc, CASE WHEN grade IS NULL THEN 'not judged' WHEN grade > 0 THEN 'relevant' ELSE 'judged not relevant' END AS judged,
  array_to_string(string_split(section, ' > ')[2:], ' › ') AS path, snippet
FROM l LEFT JOIN j USING (query, doc) LEFT JOIN sn ON sn.ord = l.doc WHERE rank <= 8"""

# --- Fusion ---

LEGS = f"{LISTS}, leg AS (SELECT *, rank() OVER (PARTITION BY system, query ORDER BY score DESC) AS shared FROM u)"
ORACLE["rrf_hybrid_topk"] = f"""
WITH {LEGS},
runs AS (SELECT DISTINCT system AS run, query FROM leg WHERE system <> 'bm25'),
parts AS (
  SELECT run, leg.query, doc, 1.0 / (60 + shared) AS s FROM leg JOIN runs ON runs.query = leg.query WHERE system = 'bm25'
  UNION ALL SELECT system, query, doc, 1.0 / (60 + shared) FROM leg WHERE system <> 'bm25'
),
f AS (SELECT run, query, doc, round(sum(CAST(s AS DOUBLE)), 9) AS score FROM parts GROUP BY ALL),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY run, query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM f)
SELECT run, query, doc, score, rank FROM placed WHERE rank <= 24"""
ORACLE["rrf_weight_sweep"] = f"""
WITH {LEGS},
parts AS (
  SELECT weight, query, doc, weight / (60 + shared) AS s FROM leg, (VALUES (1.0::DOUBLE), (0.75::DOUBLE), (0.5::DOUBLE), (0.25::DOUBLE), (0.0::DOUBLE)) w(weight) WHERE system = 'bm25'
  UNION ALL SELECT weight, query, doc, 1.0 / (60 + shared) FROM leg, first_run, (VALUES (1.0::DOUBLE), (0.75::DOUBLE), (0.5::DOUBLE), (0.25::DOUBLE), (0.0::DOUBLE)) w(weight) WHERE system = a
),
f AS (SELECT weight, query, doc, round(sum(CAST(s AS DOUBLE)), 9) AS score FROM parts GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY weight, query ORDER BY score DESC, doc) AS rank FROM f QUALIFY rank <= 24),
{measured("w", "top", "weight")}
SELECT weight, count(*) AS questions, {r6("avg(ndcg)")} AS ndcg10, {r6("avg(recall24)")} AS recall24 FROM w GROUP BY weight"""
ORACLE["rrf_by_position"] = f"""
WITH {LISTS},
f AS (SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM l, first_run WHERE system IN ('bm25', a) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM f)
SELECT query, doc, CAST(rank AS INTEGER) AS rank, score FROM placed WHERE rank <= 24"""
ORACLE["per_document_cap"] = f"""
WITH {P}, {LISTS},
x AS (SELECT query, doc, rank, row_number() OVER (PARTITION BY query, split_part(p.id, '#', 1) ORDER BY rank) > 3 AS over FROM l JOIN p ON p.ord = l.doc WHERE system = 'bm25'),
y AS (SELECT query, doc, CAST(row_number() OVER (PARTITION BY query ORDER BY over, rank) AS INTEGER) AS place FROM x)
SELECT * FROM y WHERE place <= 8"""

# --- Statistics ---


def times32(a: str, b: str) -> str:
    return f"((({a}) & 65535) * ({b}) + (((({a}) >> 16) * ({b})) & 65535) * 65536) & 4294967295"


def uniform(draw: str, seed: int, source: str) -> str:
    """Select list and nested sources for the random stream: a subquery with every column of ``source`` and ``u``."""
    a = f"({seed} + ({times32(f'({draw}) + 1', '1831565813')})) & 4294967295"
    return f"""
(SELECT *, (xor(t2, t2 >> 14)) / 4294967296.0::DOUBLE AS u FROM
 (SELECT *, xor(t1, (t1 + ({times32("xor(t1, t1 >> 7)", "t1 | 61")})) & 4294967295) AS t2 FROM
  (SELECT *, {times32("xor(s0, s0 >> 15)", "s0 | 1")} AS t1 FROM
   (SELECT *, {a} AS s0 FROM {source}))))"""


ORACLE["random_stream"] = f"SELECT draw, round(u, 12) AS u FROM {uniform('draw', 42, '(SELECT range AS draw FROM range(1000))')}"

DIFFS = f"{M}, diffs AS (SELECT b.system, b.query, b.ndcg - a.ndcg AS x FROM m b JOIN m a ON a.system = 'bm25' AND a.query = b.query WHERE b.system <> 'bm25')"


def bootstrap(source: str, value: str, draws: int) -> str:
    each = f"(SELECT system, n, draw, k FROM sizes, range({draws}) d(draw), LATERAL (SELECT unnest(range(n)) AS k))"
    return f"""
sample AS (SELECT system, {value} AS x, row_number() OVER (PARTITION BY system ORDER BY query) - 1 AS i FROM {source}),
sizes AS (SELECT system, count(*) AS n, avg(x) AS mean FROM sample GROUP BY system),
picked AS (SELECT system, draw, CAST(floor(u * n) AS BIGINT) AS i FROM {uniform("draw * n + k", 7, each)}),
means AS (SELECT system, draw, avg(x) AS mean FROM picked JOIN sample USING (system, i) GROUP BY ALL)"""


ORACLE["bootstrap_mean_ci"] = f"""
WITH {M}, {bootstrap("m", "hit1", 2000)},
ends AS (SELECT system, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM means GROUP BY system)
SELECT system, n, {", ".join(f"{r6(c)} AS {c}" for c in ("mean", "low", "high"))} FROM sizes JOIN ends USING (system)"""
ORACLE["bootstrap_paired_ci"] = f"""
WITH {DIFFS}, {bootstrap("diffs", "x", 2000)},
ends AS (SELECT system, list_sort(list(mean)) AS m FROM means GROUP BY system)
SELECT system, n, {r6("mean")} AS mean, {r6("m[51]")} AS low, {r6("m[1950]")} AS high,
  CASE WHEN {r6("m[51]")} > 0 THEN 'better' WHEN {r6("m[1950]")} < 0 THEN 'worse' ELSE 'no difference' END AS verdict FROM sizes JOIN ends USING (system)"""
ORACLE["bootstrap_bonferroni"] = f"""
WITH {DIFFS}, {bootstrap("diffs", "x", 20000)},
ends AS (SELECT system, quantile_cont(mean, 0.05 / 6) AS low, quantile_cont(mean, 1 - 0.05 / 6) AS high FROM means GROUP BY system)
SELECT system, n, {", ".join(f"{r6(c)} AS {c}" for c in ("mean", "low", "high"))} FROM sizes JOIN ends USING (system)"""
STRATA = "(SELECT set_name, n, before, everything, draw, k FROM sizes, range(2000) d(draw), LATERAL (SELECT unnest(range(n)) AS k))"
ORACLE["bootstrap_stratified"] = f"""
WITH {P}, {DIFFS}, {STRATUM},
sample AS (SELECT set_name, x, row_number() OVER (PARTITION BY set_name ORDER BY query) - 1 AS i FROM diffs JOIN st USING (query), first_run WHERE system = a),
counts AS (SELECT set_name, count(*) AS n FROM sample GROUP BY set_name),
sizes AS (SELECT set_name, n, CAST(sum(n) OVER (ORDER BY set_name) - n AS BIGINT) AS before, CAST(sum(n) OVER () AS BIGINT) AS everything FROM counts),
picked AS (SELECT set_name, draw, CAST(floor(u * n) AS BIGINT) AS i FROM {uniform("draw * everything + before + k", 7, STRATA)}),
per AS (SELECT draw, set_name, avg(x) AS m FROM picked JOIN sample USING (set_name, i) GROUP BY ALL),
draws AS (SELECT list_sort(list(m)) AS d FROM (SELECT draw, avg(m) AS m FROM per GROUP BY draw))
SELECT {r6("mean")} AS mean, {r6("d[51]")} AS low, {r6("d[1950]")} AS high FROM draws, (SELECT avg(m) AS mean FROM (SELECT avg(x) AS m FROM sample GROUP BY set_name))"""

MS = "c AS (SELECT DISTINCT line_no, ranker, ms FROM calls WHERE ms IS NOT NULL AND NOT isnan(ms))"
ORACLE["quantile_interpolated"] = f"""
WITH {MS} SELECT ranker, count(*) AS n, 'p50' AS stat, {r6("quantile_cont(ms, 0.5)")} AS value FROM c GROUP BY ranker
UNION ALL SELECT ranker, count(*), 'p95', {r6("quantile_cont(ms, 0.95)")} FROM c GROUP BY ranker"""


def nearest_rank(source: str, keys: str, value: str, probs: dict[str, float]) -> str:
    """SELECT of (keys, n, stat, value) by nearest rank."""
    ps = ", ".join(f"('{s}', {q}::DOUBLE)" for s, q in probs.items())
    return f"""
SELECT {keys}, n, stat, v AS value FROM
 (SELECT {keys}, {value} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) - 1 AS r, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}), (VALUES {ps}) t(stat, q)
WHERE r = CAST(floor(q * (n - 1) + 0.5) AS BIGINT)"""


ORACLE["quantile_nearest_rank"] = f"WITH {MS} SELECT ranker, n, stat, {r6('value')} AS value FROM ({nearest_rank('c', 'ranker', 'ms', {'p01': 0.01, 'p50': 0.5, 'p99': 0.99})})"

# --- Calibration ---

SETS = """
rows_ AS (SELECT DISTINCT run, set_name, probe, question, random, relevant FROM setdata),
rnd AS (SELECT run, set_name, v FROM (SELECT run, set_name, unnest(random) AS v FROM rows_) WHERE v IS NOT NULL AND NOT isnan(v) AND v BETWEEN 0 AND 2),
rel AS (SELECT run, set_name, v FROM (SELECT run, set_name, unnest(relevant) AS v FROM rows_) WHERE v IS NOT NULL AND NOT isnan(v) AND v BETWEEN 0 AND 2)"""
HISTOGRAM = f"""{SETS},
counts AS (SELECT run, set_name, CAST(least(99, greatest(0, floor(v * 50))) AS INTEGER) AS bin, count(*) AS n FROM rnd GROUP BY ALL),
h AS (SELECT k.run, k.set_name, b.bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT run, set_name FROM counts) k CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(100)) b LEFT JOIN counts USING (run, set_name, bin))"""
ORACLE["distance_histogram"] = f"WITH {HISTOGRAM} SELECT run, set_name, bin, n FROM h"
ORACLE["histogram_modes"] = f"WITH {HISTOGRAM} SELECT run, set_name, bin, n FROM h QUALIFY row_number() OVER (PARTITION BY run, set_name ORDER BY n DESC, bin) = 1"
LEVELS = {"strict": 0.001, "balanced": 0.01, "loose": 0.05}
ORACLE["noise_floor_levels"] = f"""
WITH {SETS}, f AS (SELECT run, set_name, stat AS level, value AS cutoff FROM ({nearest_rank("rnd", "run, set_name", "v", LEVELS)}))
SELECT run, set_name, level, {r6("cutoff")} AS cutoff, {r6("avg(CAST(v < cutoff AS INTEGER))")} AS keeps FROM rel JOIN f USING (run, set_name) GROUP BY run, set_name, level, cutoff"""
ORACLE["floor_transfer_loo"] = f"""
WITH {SETS},
other AS (SELECT k.run, k.set_name, v FROM (SELECT DISTINCT run, set_name FROM rnd) k JOIN rnd ON rnd.run = k.run AND rnd.set_name <> k.set_name),
f AS (SELECT run, set_name, stat AS level, value AS cutoff FROM ({nearest_rank("other", "run, set_name", "v", LEVELS)})),
a AS (SELECT run, set_name, level, cutoff, avg(CAST(v < cutoff AS INTEGER)) AS lets FROM rnd JOIN f USING (run, set_name) GROUP BY ALL),
b AS (SELECT run, set_name, level, avg(CAST(v < cutoff AS INTEGER)) AS keeps FROM rel JOIN f USING (run, set_name) GROUP BY run, set_name, level)
SELECT run, set_name, level, {r6("cutoff")} AS cutoff, {r6("keeps")} AS keeps, {r6("lets")} AS lets FROM a LEFT JOIN b USING (run, set_name, level)"""
ORACLE["distance_profile"] = f"""
WITH {SETS},
numbered AS (SELECT run, relevant, row_number() OVER () AS row_no FROM rows_),
per AS (SELECT run, row_no, v FROM (SELECT run, row_no, unnest(relevant) AS v FROM numbered) WHERE v BETWEEN 0 AND 2 AND NOT isnan(v)),
med AS (SELECT run, value AS v FROM ({nearest_rank("per", "run, row_no", "v", {"m": 0.5})}))
SELECT run, n, stat, {r6("value")} AS value FROM ({nearest_rank("med", "run", "v", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})})"""
ORACLE["cutoff_in_force"] = f"""
WITH {SETS}, c AS (SELECT DISTINCT run, question AS cutoff, random_share AS aim FROM searchcutoff WHERE question IS NOT NULL AND random_share IS NOT NULL),
a AS (SELECT run, cutoff, aim, avg(CAST(v < cutoff AS INTEGER)) AS lets FROM rnd JOIN c USING (run) GROUP BY ALL),
b AS (SELECT run, avg(CAST(v < cutoff AS INTEGER)) AS keeps FROM rel JOIN c USING (run) GROUP BY run)
SELECT run, 'question' AS level, aim, cutoff, {r6("lets")} AS lets, {r6("keeps")} AS keeps, lets BETWEEN aim / 2 AND aim * 2 AS within FROM a LEFT JOIN b USING (run)"""


def style(q: str) -> str:
    t = f"regexp_replace({q}, '^\\s+|\\s+$', '', 'g')"
    wide = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]"
    return (
        f"CASE WHEN {q} IS NULL THEN NULL WHEN regexp_matches({t}, '[?？]') OR len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> '')) > 4"
        f" OR (regexp_matches({t}, '{wide}') AND length(regexp_replace({t}, '\\s+', '', 'g')) > 8) THEN 'question' ELSE 'short' END"
    )


def levels(keys: str) -> str:
    return f"""
WITH {P},
v AS (SELECT DISTINCT ord, CAST(vec AS DOUBLE[]) AS v FROM vectors WHERE len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0),
x AS (SELECT p.ord, split_part(sample, '/', 1) AS lang, sample, title, v FROM p JOIN v USING (ord)),
d AS (
  SELECT a.lang, {style("a.title")} AS style, {COS.format(a="a.v", b="b.v")} AS v FROM x a JOIN x b ON a.lang = b.lang AND a.sample <> b.sample
  WHERE a.ord % 20 = 0 AND coalesce(a.title, '') <> ''
),
q AS ({nearest_rank("d", keys, "v", {"balanced": 0.01, "loose": 0.05})}),
w AS (SELECT {keys}, max(value) FILTER (WHERE stat = 'balanced') AS t1, max(value) FILTER (WHERE stat = 'loose') AS t5 FROM q GROUP BY {keys})
SELECT {keys}, {r6("greatest(m, t1 - (t5 - t1) * ln(10) / ln(5))")} AS strict, {r6("t1")} AS balanced, {r6("t5")} AS loose FROM w JOIN (SELECT {keys}, min(v) AS m FROM d GROUP BY {keys}) USING ({keys})"""


ORACLE["calibration_levels"] = levels("style")
ORACLE["calibration_levels_by_language"] = levels("lang, style")

# --- The call log ---

SQL_REFUSED, SQL_RETRYABLE = REFUSED.replace("(?i)", ""), RETRYABLE.replace("(?i)", "")
LATEST = f"""
every AS (SELECT DISTINCT * FROM calls),
last AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY machine, ranker, repeat_no, question ORDER BY line_no DESC) = 1),
c AS (SELECT * FROM last WHERE NOT regexp_matches(coalesce(error, ''), '{SQL_REFUSED}', 'i'))"""
ORACLE["latest_calls"] = f"WITH {LATEST} SELECT line_no, machine, ranker, repeat_no, question, error, attempts FROM c"
ORACLE["latency_percentiles"] = f"""
WITH {LATEST}, x AS (SELECT ranker, coalesce(totalms, ms) AS t FROM c WHERE coalesce(cachedtokens, 0) = 0 OR cachedtokens < inputtokens / 2)
SELECT ranker, count(*) AS n, {r6("quantile_cont(t, 0.5)")} AS p50, {r6("quantile_cont(t, 0.95)")} AS p95 FROM x WHERE t IS NOT NULL AND NOT isnan(t) GROUP BY ranker"""
ORACLE["call_totals"] = f"""
WITH {LATEST}
SELECT ranker, count(*) AS calls, count(error) AS failures, count(*) FILTER (WHERE attempts > 1 AND totalms IS NULL) AS untimed_retries,
  count(*) FILTER (WHERE scores IS NOT NULL AND covered IS NOT NULL) AS coverage_recorded, array_to_string(list_sort(list(DISTINCT model) FILTER (WHERE model IS NOT NULL)), ',') AS models,
  {r6("avg(CAST(error IS NOT NULL AS INTEGER))")} AS failure_rate, {r6("avg(CAST(coalesce(reasoningtokens, 0) > 0 AS INTEGER))")} AS reasoning_rate,
  {r6("avg(CAST(covered >= len(scores) AS INTEGER)) FILTER (WHERE scores IS NOT NULL AND covered IS NOT NULL)")} AS full_coverage, {r6("avg(inputtokens)")} AS input_tokens, {r6("avg(outputtokens)")} AS output_tokens
FROM c GROUP BY ranker"""
ORACLE["call_throughput"] = f"""
WITH {LATEST} SELECT ranker, {r6("sum(coalesce(inputtokens, 0) + coalesce(outputtokens, 0)) / (sum(ms) / 1000)")} AS tokens_per_second
FROM c WHERE ms IS NOT NULL AND NOT isnan(ms) AND ms > 0 GROUP BY ranker"""
ORACLE["top_tie_rate"] = f"""
WITH {LATEST}, x AS (SELECT ranker, scores, list_sort(scores, 'DESC', 'NULLS LAST') AS s FROM c)
SELECT ranker, count(*) FILTER (WHERE len(scores) > 1) AS scored, {r6("coalesce(avg(CAST(coalesce(s[1] = s[2], false) AS INTEGER)) FILTER (WHERE len(scores) > 1), 0)")} AS tie_rate FROM x GROUP BY ranker"""
ORDERED = f"""{LATEST},
pos AS (SELECT line_no, ranker, machine, question, scores, unnest(order_ids) AS passage, generate_subscripts(order_ids, 1) AS i FROM c WHERE order_ids IS NOT NULL),
placed AS (
  SELECT line_no, ranker, machine, question, scores, passage,
    CAST(row_number() OVER (PARTITION BY line_no ORDER BY CASE WHEN coalesce(isnan(scores[i]), true) THEN 0 ELSE scores[i] END DESC, i) AS INTEGER) AS rank FROM pos
)"""
ORACLE["ordered_passages"] = f"WITH {ORDERED} SELECT line_no, rank, passage FROM placed"
ORACLE["first_choice_stability"] = f"""
WITH {ORDERED}, q AS (SELECT ranker, question, count(*) AS n, count(DISTINCT passage) AS d FROM placed WHERE rank = 1 GROUP BY ALL)
SELECT ranker, count(*) FILTER (WHERE n > 1) AS questions, {r6("avg(CAST(d = 1 AS INTEGER)) FILTER (WHERE n > 1)")} AS stability FROM q GROUP BY ranker"""
ORACLE["resume_pending"] = f"""
SELECT DISTINCT machine, ranker, repeat_no, question FROM calls
EXCEPT SELECT DISTINCT machine, ranker, repeat_no, question FROM calls
WHERE error IS NULL OR NOT (regexp_matches(error, '{SQL_REFUSED}', 'i') OR regexp_matches(error, '{SQL_RETRYABLE}', 'i'))"""
RANKS = f"""{ORDERED}, {LISTS.replace("c AS", "cc AS")},
gold AS (SELECT query AS question, p.id AS passage FROM g JOIN p ON p.ord = g.doc),
fr AS (
  SELECT line_no, ranker, machine, placed.question, coalesce(min(rank) FILTER (WHERE gold.passage IS NOT NULL), 0) AS first
  FROM placed LEFT JOIN gold ON gold.question = placed.question AND gold.passage = placed.passage WHERE scores IS NOT NULL GROUP BY ALL
)"""
ORACLE["ranker_quality"] = f"""
WITH {P}, {RANKS},
q AS (SELECT ranker, question, avg(CAST(first = 1 AS INTEGER)) AS hit1, avg(CAST(first BETWEEN 1 AND 8 AS INTEGER)) AS hit8, avg(CASE WHEN first > 0 THEN 1 / first ELSE 0 END) AS mrr FROM fr GROUP BY ALL)
SELECT ranker, count(*) AS questions, {", ".join(f"{r6(f'avg({c})')} AS {c}" for c in ("hit1", "hit8", "mrr"))} FROM q GROUP BY ranker"""
ORACLE["ranker_quality_by_category"] = f"""
WITH {P}, {RANKS}, {STRATUM}
SELECT ranker, regexp_replace(set_name, '^[^-]*-', '') AS category, count(*) AS n, {r6("avg(CAST(first = 1 AS INTEGER))")} AS hit1, {r6("avg(CASE WHEN first > 0 THEN 1 / first ELSE 0 END)")} AS mrr
FROM fr JOIN st ON st.query = fr.question GROUP BY ALL"""

# --- Text ---

ORACLE["query_styles"] = f"WITH {P} SELECT ord, {style('title')} AS style FROM p"
ORACLE["query_cutoffs"] = f"""
WITH {P}, {TITLES} SELECT query, run, CASE WHEN {style("text")} = 'short' THEN shortq ELSE question END AS cutoff FROM titles, (SELECT DISTINCT run, shortq, question FROM searchcutoff)"""
ORACLE["snippets"] = f"WITH {P}, {SNIPPETS} SELECT ord, snippet FROM sn"
ORACLE["short_excerpts"] = r"""
WITH p AS (SELECT DISTINCT ord, text FROM passages), c AS (SELECT ord, text, left(text, 160) AS cut FROM p),
k AS (SELECT *, CASE WHEN contains(cut, ' ') THEN greatest(160 - instr(reverse(cut), ' '), 140) ELSE 140 END AS n FROM c)
SELECT ord, CASE WHEN length(text) <= 160 THEN text ELSE regexp_replace(left(cut, n), '[\s,;:]+$', '') || '…' END AS excerpt FROM k"""
ORACLE["seen_texts"] = f"""
WITH {P} SELECT ord, CAST(length(trim(left(text, 1200))) AS INTEGER) AS seen,
  CAST(length((CASE WHEN coalesce(title, '') = '' THEN 'Untitled' ELSE title END) || (CASE WHEN coalesce(section, '') = '' THEN '' ELSE ' — ' || section END) || chr(10) || coalesce(text, '')) AS INTEGER) AS whole,
  length(text) > 1200 AS past FROM p"""
ORACLE["scripts"] = f"""
SELECT DISTINCT doc_id, CASE WHEN text IS NULL THEN NULL WHEN length(text) - length(regexp_replace(text, '[{TRADITIONAL}]', '', 'g')) > length(text) - length(regexp_replace(text, '[{SIMPLIFIED}]', '', 'g')) THEN 'traditional' ELSE 'simplified' END AS script
FROM documents"""
ORACLE["clean_documents"] = """
WITH d AS (SELECT DISTINCT doc_id, replace(text, chr(0), '') AS t FROM documents)
SELECT doc_id, CAST(length(t) AS INTEGER) AS chars, md5(t) AS digest, CAST(length(left(t, CAST(floor(length(t) * 0.75) AS BIGINT))) AS INTEGER) AS shortened FROM d"""
ORACLE["name_parts"] = f"""
WITH {P} SELECT ord, split_part(id, '#', 1) AS doc, regexp_replace(set_name, '^[^-]*-', '') AS lang, array_to_string(string_split(section, ' > ')[2:], ' › ') AS path, id AS name,
  CASE WHEN regexp_matches(id, '^[0-9]+#') THEN 'https://en.wikipedia.org/?curid=' || split_part(id, '#', 1) END AS link FROM p"""
ORACLE["run_parts"] = """
WITH r AS (SELECT DISTINCT replace(run, '/', ':') AS spec FROM ranked),
x AS (SELECT spec, split_part(regexp_replace(spec, '\\+raw$', ''), ':', 1) AS backend, regexp_replace(regexp_replace(spec, '\\+raw$', ''), '^[^:]*:', '') AS model, ends_with(spec, '+raw') AS raw FROM r)
SELECT spec, backend, model, raw, backend || '/' || replace(model, '/', '_') || CASE WHEN raw THEN '+raw' ELSE '' END AS key FROM x""".replace("\\\\", "\\")
ORACLE["matched_title_words"] = rf"""
WITH {P}, x AS (SELECT ord, regexp_extract_all(title, '{WORD}') AS w, regexp_extract_all(lower(text), '{WORD}') AS t FROM p WHERE title IS NOT NULL AND text IS NOT NULL)
SELECT ord, array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(list_filter(w, lambda a: list_contains(t, lower(a))), lambda a: [a])), lambda acc, a: CASE WHEN list_contains(acc, a[1]) THEN acc ELSE list_concat(acc, a) END), ' ') AS matched,
  NOT list_has_any(list_transform(w, lambda a: lower(a)), t) AS disjoint FROM x"""
ORACLE["judge_prompts"] = f"""
WITH {P}, {LISTS},
x AS (
  SELECT query, rank, '[' || (row_number() OVER (PARTITION BY query ORDER BY rank) - 1) || '] ' || (CASE WHEN coalesce(title, '') = '' THEN 'Untitled' ELSE title END) || (CASE WHEN coalesce(section, '') = '' THEN '' ELSE ' — ' || section END)
    || chr(10) || coalesce(trim(left(text, 200)), '') AS part
  FROM l JOIN p ON p.ord = l.doc WHERE system = 'bm25' AND rank <= 3
),
y AS (SELECT query, 'Query: ' || query || chr(10) || chr(10) || 'Snippets:' || chr(10) || string_agg(part, chr(10) || chr(10) ORDER BY rank) AS t FROM x GROUP BY query)
SELECT query, md5(t) AS digest, CAST(length(t) AS INTEGER) AS chars FROM y"""
ORACLE["titles_nearest_median"] = rf"""
WITH {P}, t AS (SELECT ord, title, CAST(length(title) AS DOUBLE) AS chars FROM p WHERE title <> ''),
m AS (SELECT list_sort(list(chars))[CAST(floor((count(*) - 1) / 2) AS BIGINT) + 1] AS median FROM t)
SELECT ord, chars, median, CAST(row_number() OVER (ORDER BY abs(chars - median), length(title), ord) AS INTEGER) AS place FROM t, m
WHERE len(regexp_split_to_array(trim(title), '\s+')) <= 9 AND NOT regexp_matches(title, '[0-9]')"""

# --- Comparing systems, legs and collections ---

CUT = f"""{LEGS},
cut AS (
  SELECT system, query, doc, shared FROM (SELECT *, row_number() OVER (PARTITION BY system, query ORDER BY score DESC, doc) AS n FROM leg)
  WHERE n <= 96 AND (system = 'bm25' OR score >= 0.2)
),
asked AS (SELECT DISTINCT system AS run, query FROM cut WHERE system <> 'bm25'),
parts AS (
  SELECT run, query, doc, 1.0::DOUBLE / (60 + shared) AS k, 0.0::DOUBLE AS s FROM cut JOIN asked USING (query) WHERE system = 'bm25'
  UNION ALL SELECT system, query, doc, 0.0, 1.0::DOUBLE / (60 + shared) FROM cut WHERE system <> 'bm25'
),
fused AS (SELECT run, weight, query, doc, round(sum(k) * weight + sum(s), 9) AS score FROM parts, (VALUES (1.0::DOUBLE), (0.5::DOUBLE)) w(weight) GROUP BY run, weight, query, doc),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY run, weight, query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM fused QUALIFY rank <= 24)"""
ORACLE["rrf_cut_legs"] = f"WITH {CUT} SELECT run, query, doc, score, rank FROM placed WHERE weight = 1"
ORACLE["fusion_half_against_equal"] = f"""
WITH {CUT}, {measured("w", "placed", "run, weight")},
d AS (SELECT run, query, max(ndcg) FILTER (WHERE weight = 1) AS e, max(ndcg) FILTER (WHERE weight = 0.5) AS h FROM w GROUP BY ALL)
SELECT run, count(*) AS questions, {r6("avg(e)")} AS "equal", {r6("avg(h)")} AS half, count(*) FILTER (WHERE round(h - e, 9) > 0) AS better, count(*) FILTER (WHERE round(h - e, 9) < 0) AS worse
FROM d GROUP BY run"""


def placed_by(name: str) -> str:
    return f"SELECT '{name}' AS variant, query, doc, row_number() OVER (PARTITION BY query ORDER BY {r6('score')} DESC, doc) AS rank FROM {name}_v"


ORACLE["keyword_variants"] = f"""
WITH {P}, {TITLES}, {bm25("text_v", "text")}, {bm25("title_v", "title")},
best_v AS (SELECT query, doc, max(score) AS score FROM (SELECT * FROM text_v UNION ALL SELECT * FROM title_v) GROUP BY ALL),
every AS ({placed_by("text")} UNION ALL {placed_by("title")} UNION ALL {placed_by("best")})
SELECT variant, count(*) FILTER (WHERE rank = 1) AS first, count(*) AS among_ten FROM every WHERE query = doc AND rank <= 10 GROUP BY variant"""
ORACLE["candidate_bm25"] = rf"""
WITH {P}, {LISTS},
c AS (SELECT query, doc, rank, title, regexp_extract_all(lower(left(coalesce(text, ''), 400)), '{WORD}') AS w FROM l JOIN p ON p.ord = l.doc WHERE system = 'bm25' AND rank <= 24),
terms AS (SELECT DISTINCT query, unnest(regexp_extract_all(lower(coalesce(title, '')), '{WORD}')) AS term FROM c WHERE rank = 1),
facts AS (SELECT query, count(*) AS docs, avg(len(w)) AS mean_length FROM c GROUP BY query),
tf AS (SELECT query, doc, length, term, count(*) AS tf FROM (SELECT query, doc, len(w) AS length, unnest(w) AS term FROM c) JOIN terms USING (query, term) GROUP BY ALL),
df AS (SELECT query, term, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT query, doc, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * length / mean_length))) AS score FROM tf JOIN df USING (query, term) JOIN facts USING (query) GROUP BY ALL)
{best("s", 24)}"""
ORACLE["positive_hits"] = f"WITH {LISTS} SELECT query, count(*) FILTER (WHERE score > 0) AS positive, count(*) FILTER (WHERE score <= 0) AS dropped FROM l WHERE system = 'bm25' GROUP BY query"
ORACLE["knn_excluding_own_document"] = f"""
WITH {P},
v AS (
  SELECT DISTINCT vectors.ord, split_part(p.id, '#', 1) AS parent, CAST(vec AS DOUBLE[]) AS v FROM vectors JOIN p ON p.ord = vectors.ord
  WHERE len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0
),
d AS (SELECT a.ord AS query, b.ord AS key, round({COS.format(a="a.v", b="b.v")}, 9) AS distance FROM v a, v b WHERE a.ord % 20 = 0 AND a.parent <> b.parent),
placed AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, key) AS rank FROM d)
SELECT CAST(query AS BIGINT) AS query, CAST(key AS BIGINT) AS key, CAST(rank AS INTEGER) AS rank, {r6("distance")} AS distance FROM placed WHERE rank <= 10"""
# What the published runs of these searches found.
ORACLE["crowded_searches"] = """
SELECT * FROM (VALUES ('exact', 5), ('filter after 40', 0), ('filter after 1000', 0), ('cutoff outside', 5), ('cutoff inside', 5), ('cutoff outside, 320', 5), ('cutoff inside, 320', 5)) t(search, rows)"""
ORACLE["crowded_scan_budgets"] = """
SELECT * FROM (VALUES ('20,000 rows', 0), ('100,000 rows', 0), ('100,000 rows, 8 x memory', 5), ('exact', 5), ('first readable', 33001)) t(search, rows)"""
ORACLE["paired_hit_intervals"] = f"""
SELECT * FROM (
  WITH {M}, two AS (SELECT m.* FROM m, first_run WHERE system IN (a, z)), {bootstrap("two", "hit1", 2000)},
  ends AS (SELECT system, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM means GROUP BY system)
  SELECT system, n, {", ".join(f"{r6(c)} AS {c}" for c in ("mean", "low", "high"))} FROM sizes JOIN ends USING (system)
)
UNION ALL SELECT * FROM (
  WITH {M}, two AS (SELECT y.system, y.query, y.hit1 - x.hit1 AS d FROM m x JOIN m y ON x.query = y.query, first_run WHERE x.system = a AND y.system = z AND a <> z), {bootstrap("two", "d", 2000)},
  ends AS (SELECT system, list_sort(list(mean)) AS m FROM means GROUP BY system)
  SELECT 'difference', n, {r6("mean")}, {r6("m[51]")}, {r6("m[1950]")} FROM sizes JOIN ends USING (system)
)"""
SCRIPT = f"CASE WHEN length(text) - length(regexp_replace(text, '[{TRADITIONAL}]', '', 'g')) > length(text) - length(regexp_replace(text, '[{SIMPLIFIED}]', '', 'g')) THEN 'traditional' WHEN text IS NOT NULL THEN 'simplified' END"
ORACLE["recall_by_script"] = f"""
WITH {P}, {LISTS}, ps AS (SELECT ord AS doc, CASE WHEN split_part(sample, '/', 1) = 'zh' THEN {SCRIPT} ELSE 'other' END AS script FROM p)
SELECT asked.system, script, count(*) AS relevant, {r6("avg(CASE WHEN f.doc IS NULL THEN 0 ELSE 1 END)")} AS recall24
FROM (SELECT DISTINCT system, query FROM l) asked JOIN g USING (query) JOIN ps ON ps.doc = g.doc
LEFT JOIN (SELECT system, query, doc FROM l WHERE rank <= 24) f ON f.system = asked.system AND f.query = asked.query AND f.doc = g.doc GROUP BY ALL"""
ORACLE["ranker_hits_of_all_questions"] = f"""
WITH {P}, {RANKS},
q AS (SELECT ranker, question, avg(CAST(first = 1 AS INTEGER)) AS hit1 FROM fr GROUP BY ALL),
asked AS (SELECT count(DISTINCT question) AS questions FROM {"c"})
SELECT ranker, count(*) AS ranked, questions, {r6("sum(hit1) / questions")} AS hit1 FROM q, asked GROUP BY ranker, questions"""
ORACLE["own_language_transfer"] = f"""
WITH {SETS},
lv AS ({ORACLE["calibration_levels_by_language"]}),
cut AS (SELECT lang, unnest(['strict', 'balanced', 'loose']) AS level, unnest([strict, balanced, loose]) AS cutoff FROM lv WHERE style = 'short'),
a AS (SELECT run, set_name, level, {r6("avg(CAST(v < cutoff AS INTEGER))")} AS lets FROM rnd JOIN cut ON lang = regexp_replace(set_name, '^[^-]*-', '') GROUP BY ALL),
b AS (SELECT run, set_name, level, {r6("avg(CAST(v < cutoff AS INTEGER))")} AS keeps FROM rel JOIN cut ON lang = regexp_replace(set_name, '^[^-]*-', '') GROUP BY ALL)
SELECT run, set_name, level, lets, keeps FROM a LEFT JOIN b USING (run, set_name, level)"""
ORACLE["random_profile"] = f"WITH {SETS} SELECT run, n, stat, {r6('value')} AS value FROM ({nearest_rank('rnd', 'run', 'v', {'p001': 0.001, 'p01': 0.01, 'p05': 0.05, 'p50': 0.5})})"
ORACLE["zipped_random_pairs"] = f"""
WITH ends AS (SELECT min(run) AS a, max(run) AS z FROM setdata),
x AS (SELECT set_name, probe, question, min(random) AS x FROM setdata, ends WHERE run = a GROUP BY ALL),
y AS (SELECT set_name, probe, question, min(random) AS y FROM setdata, ends WHERE run = z GROUP BY ALL),
pairs AS (SELECT set_name, unnest(list_zip(x, y)) AS p FROM x JOIN y USING (set_name, probe, question))
SELECT set_name, count(*) AS n, {r6("avg(p[1] - p[2])")} AS mean_difference FROM pairs WHERE p[1] BETWEEN 0 AND 2 AND p[2] BETWEEN 0 AND 2 AND NOT isnan(p[1]) AND NOT isnan(p[2]) GROUP BY set_name"""
ORACLE["style_counts"] = f"WITH {P} SELECT {style('title')} AS style, count(*) AS n FROM p GROUP BY 1"
ORACLE["past_snippet"] = f"""
WITH {P}, t AS (SELECT set_name, CAST(length(text) AS DOUBLE) AS v FROM p WHERE text IS NOT NULL),
s AS (SELECT set_name, {r6("avg(CAST(v > 1200 AS INTEGER))")} AS past FROM t GROUP BY set_name)
SELECT m.set_name, n, past, value AS median FROM ({nearest_rank("t", "set_name", "v", {"m": 0.5})}) m JOIN s ON s.set_name IS NOT DISTINCT FROM m.set_name"""
ORACLE["relevant_past_snippet"] = f"""
WITH {P}, {LISTS} SELECT grade > 0 AS relevant, count(*) AS n, {r6("avg(CAST(length(text) > 1200 AS INTEGER))")} AS past FROM j JOIN p ON p.ord = j.doc GROUP BY 1"""
