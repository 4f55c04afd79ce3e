"""Schemas, as DDL, of the tables and files read; nothing is inferred."""

from __future__ import annotations

PASSAGES = "ord INT, id STRING, set_name STRING, sample STRING, title STRING, section STRING, text STRING"
CHUNKS = "id BIGINT, topic STRING, readers ARRAY<STRING>, embedding ARRAY<FLOAT>"
VECTORS = "set_name STRING, ord INT, vec ARRAY<FLOAT>"
HITS = "query_id STRING, shard INT, ids ARRAY<INT>, scores ARRAY<DOUBLE>"
RANKED = "query_id STRING, run STRING, top ARRAY<INT>, topsims ARRAY<DOUBLE>"
CALLS = ("line_no BIGINT, machine STRING, ranker STRING, repeat_no INT, question STRING, scores ARRAY<DOUBLE>, model STRING, inputtokens BIGINT, cachedtokens BIGINT, cachewritetokens BIGINT, outputtokens BIGINT,"
    " reasoningtokens BIGINT, ms DOUBLE, totalms DOUBLE, attempts INT, error STRING, raw STRING, covered INT, order_ids ARRAY<STRING>, at_ts TIMESTAMP_NTZ")
# Files of a test collection.
CORPUS = "id STRING, title STRING, text STRING"
QUERIES = "id STRING, text STRING"
JUDGEMENTS = "`query-id` STRING, `corpus-id` STRING, score BIGINT"
CORPUS_WITH_LISTS = "id STRING, content STRING"
EXAMPLES = "id STRING, query STRING, gold_ids ARRAY<STRING>, excluded_ids ARRAY<STRING>"
QUESTIONS = "id STRING, sample STRING, q STRING, category STRING, goldIds ARRAY<STRING>"
CANDIDATES = "question STRING, ids ARRAY<STRING>"
LOG_LINE = ("ranker STRING, repeat INT, question STRING, scores ARRAY<DOUBLE>, model STRING, inputTokens BIGINT, cachedTokens BIGINT, cacheWriteTokens BIGINT, outputTokens BIGINT, reasoningTokens BIGINT, ms DOUBLE,"
    " totalMs DOUBLE, attempts INT, error STRING, raw STRING, covered INT, order ARRAY<STRING>, at STRING")
METRIC = "ndcg10 DOUBLE, recall24 DOUBLE, recall100 DOUBLE, hit1 DOUBLE"
SCORED_SET = f"scores ARRAY<STRUCT<id STRING, dense STRUCT<{METRIC}>, bm25 STRUCT<{METRIC}>, fused MAP<STRING, STRUCT<{METRIC}, semantic INT>>, gold ARRAY<DOUBLE>, random ARRAY<DOUBLE>, nearestOther DOUBLE>>"
