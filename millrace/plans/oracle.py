"""DuckDB's SQL for the queries' results."""

from __future__ import annotations

from ..functions.text import DOUBTFUL_PHRASES, STOP_WORDS, TERM_STOP_WORDS
from ..operators.evaluation import SPACE

_words = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"

LOGS = """logs AS (SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, ts, user_id AS session_id, event_type AS query_type, value AS response_time_ms,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens_used, event_type <> 'error' AS answered,
  CASE WHEN event_type = 'purchase' THEN 'positive' WHEN event_type = 'error' THEN 'negative' END AS user_feedback FROM events)"""
TURNS = """n AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations),
turns AS (SELECT conv_id AS session_id, turn, text AS question, CASE WHEN next_role = 'assistant' THEN next_text END AS answer FROM n WHERE role = 'user')"""
HASH = "substr(sha256(trim(lower({0}), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), 1, 16)"


def cache(name: str = "cache", where: str = "true", of: str = "turns") -> str:
    return f"""{name} AS (SELECT *, CASE WHEN answer IS NULL THEN 'unanswered' WHEN length(answer) > 200 THEN 'rag' ELSE 'ai' END AS answer_quality FROM (
  SELECT {HASH.format('question')} AS question_hash, min(question) AS question, max(answer) AS answer, count(*) AS usage_count, min(session_id) AS cache_id FROM {of} WHERE {where} GROUP BY 1))"""


HEAD = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)"
NORMAL = r"regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*[^?#]*)', 1)"
PATH = "regexp_extract({0}, '" + HEAD + "([^?#]*)', 3)"
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
LISTED = f"listed AS (SELECT DISTINCT {NORMAL.format('url')} AS url FROM pages WHERE {NORMAL.format('url')} <> '')"
FETCHED = f"fetched AS (SELECT DISTINCT {NORMAL.format('url')} AS url FROM pages WHERE length(html) >= 3000 AND {NORMAL.format('url')} <> '' UNION ALL VALUES ('https://old.example.com/courses/1'), ('https://old.example.com/programs/2'))"
CATEGORY = "CASE WHEN contains({0}, '/programs/') THEN 'programs' WHEN contains({0}, '/specialisations/') THEN 'specialisations' WHEN contains({0}, '/courses/') THEN 'courses' ELSE 'other' END"
SEGMENT = "CASE WHEN contains({0}, '/en/') THEN 'en' WHEN contains({0}, '/fr/') THEN 'fr' WHEN contains({0}, '/de/') THEN 'de' ELSE 'other' END"
FOUND = f"""l AS (SELECT url AS page, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1)) AS link FROM pages),
r AS (SELECT link, regexp_extract(page, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+)', 1) AS root FROM l),
a AS (SELECT CASE WHEN regexp_matches(link, '{HEAD}') THEN link WHEN starts_with(link, '/') THEN root || link ELSE root || '/' || link END AS whole FROM r),
found AS (SELECT url, {CATEGORY.format('url')} AS category FROM (SELECT DISTINCT {NORMAL.format('whole')} AS url FROM a) WHERE url <> '')"""

TOKENS = f"""list_transform(list_filter(regexp_extract_all(lower({{0}}), '([\\p{{{{L}}}}\\p{{{{N}}}}]+)', 1), lambda w: regexp_matches(w, '^[a-z]{{{{4}}}}\\d{{{{4}}}}$')
  OR (regexp_matches(w, '^\\p{{{{L}}}}+$') AND length(w) > 2 AND NOT list_contains({_words(STOP_WORDS)}, w)) OR regexp_matches(w, '^\\d{{{{2,}}}}$')),
  lambda w: CASE WHEN regexp_matches(w, '^[a-z]{{{{4}}}}\\d{{{{4}}}}$') THEN upper(w) ELSE w END)""".replace("{{", "{").replace("}}", "}")


def tokens(column: str) -> str:
    return TOKENS.replace("{0}", column)


INDEX = f"""t AS MATERIALIZED (SELECT doc_id, {tokens("coalesce(text, '')")} AS tokens FROM documents),
lengths AS MATERIALIZED (SELECT doc_id, len(tokens) AS dl FROM t),
postings AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM t) GROUP BY ALL),
totals AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT query_id, term, count(*) AS qf FROM (SELECT item_id AS query_id, unnest({tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
scores AS (SELECT query_id, p.doc_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25_score
  FROM asked JOIN terms USING (term) JOIN postings p USING (term) JOIN lengths l ON l.doc_id = p.doc_id CROSS JOIN totals GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25_score, 9) DESC, doc_id) AS rank FROM scores)"""
NEAR = """sims AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, v.label, list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS similarity FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, doc_id) AS rank FROM sims)"""
FUSED = f"""{INDEX}, {NEAR},
rag AS (SELECT query_id, doc_id, text AS content, rank, substr(text, 1, 100) AS key FROM near JOIN documents USING (doc_id) WHERE rank <= 20 AND text <> ''),
words AS (SELECT query_id, doc_id, text AS content, rank, bm25_score, substr(text, 1, 100) AS key FROM ranked JOIN documents USING (doc_id) WHERE rank <= 40 AND bm25_score > 0 AND text <> ''),
lr AS (SELECT query_id, key, arg_min(doc_id, rank) AS doc_id, min(rank) AS rank FROM rag GROUP BY ALL),
lw AS (SELECT query_id, key, arg_min(doc_id, rank) AS doc_id, min(rank) AS rank, arg_max(bm25_score, rank) AS s, count(*) AS times FROM words GROUP BY ALL),
f AS (SELECT coalesce(lr.query_id, lw.query_id) AS query_id, coalesce(lr.doc_id, lw.doc_id) AS doc_id, CASE WHEN lr.key IS NOT NULL THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS rag_score, coalesce(s, 0.0) AS bm25_score,
  CASE WHEN s IS NULL THEN 'rag' WHEN lr.key IS NOT NULL OR times > 1 THEN 'hybrid' ELSE 'bm25' END AS search_type, CASE WHEN lr.key IS NOT NULL THEN 0 ELSE 1 END AS pa, coalesce(lr.rank, lw.rank) AS pb
  FROM lr FULL JOIN lw ON lr.query_id = lw.query_id AND lr.key = lw.key),
h AS (SELECT *, rag_score * 0.7 + bm25_score * 0.3 AS hybrid_score FROM f),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(hybrid_score, 9) DESC, pa, pb) AS rank FROM h WHERE hybrid_score >= 50 OR rag_score >= 25 OR bm25_score >= 1) WHERE rank <= 20)"""
SCORES = """j AS (SELECT doc_id, quality, toxic, lang AS category, n_chars, CASE WHEN n_chars < 1000 THEN 'easy' WHEN n_chars < 3000 THEN 'medium' ELSE 'hard' END AS difficulty FROM labels JOIN documents USING (doc_id)),
scores AS (SELECT category, difficulty, 'quality' AS metric, quality::DOUBLE AS score FROM j UNION ALL SELECT category, difficulty, 'harmless', (1 - toxic)::DOUBLE FROM j
  UNION ALL SELECT category, difficulty, 'length', CASE WHEN n_chars > 0 THEN least(n_chars / 4000, 1.0) END FROM j),
means AS (SELECT metric, round(avg(score), 4) AS mean, count(score) AS n FROM scores GROUP BY metric)"""
BAND = "CASE WHEN mean >= 0.9 THEN 'excellent' WHEN mean >= 0.8 THEN 'good' WHEN mean >= 0.7 THEN 'acceptable' ELSE 'poor' END"
RERANKED = f"""{INDEX},
hits AS (SELECT query_id, doc_id, rank, d.text AS content, b.text AS query FROM ranked JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id WHERE rank <= 20 AND bm25_score > 0)"""


def terms_of(column: str) -> str:
    return f"list_filter(list_filter(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z]{{4,}}$')), lambda w: NOT list_contains({_words(TERM_STOP_WORDS)}, w))"


GRID = " CROSS JOIN ".join(f"(SELECT unnest({values}::{'INT' if isinstance(values[0], int) else 'DOUBLE'}[]) AS {name}) {name}_" for name, values in SPACE.items())

SQL: dict[str, str] = {
    "log_dashboard_stats": f"WITH {LOGS} SELECT count(*) AS total, count(*) FILTER (WHERE answered) AS answered, count(*) FILTER (WHERE NOT answered) AS unanswered, round(coalesce(avg(response_time_ms) FILTER (WHERE response_time_ms <> 0), 0), 2) AS avg_response_time, sum(tokens_used)::BIGINT AS total_tokens, count(*) FILTER (WHERE user_feedback = 'positive') AS positive, count(*) FILTER (WHERE user_feedback = 'negative') AS negative FROM logs",
    "log_daily_trend": "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1",
    "log_snapshot": f"WITH {LOGS} SELECT 'stats_summary' AS type, count(*) AS total_queries, round(avg(response_time_ms) FILTER (WHERE response_time_ms <> 0), 2) AS avg_response_time, sum(tokens_used)::BIGINT AS total_tokens FROM logs",
    "log_export_counts": "SELECT count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS answered, count(*) FILTER (WHERE event_type = 'error') AS unanswered FROM events",
    "log_feedback_totals": f"WITH {LOGS} SELECT user_feedback, count(*) AS n FROM logs WHERE user_feedback IS NOT NULL GROUP BY 1",
    "log_by_type_rollup": f"WITH {LOGS} SELECT query_type, count(*) AS n, sum(tokens_used)::BIGINT AS tokens, round(avg(response_time_ms), 6) AS mean_ms FROM logs GROUP BY ROLLUP (query_type)",
    "log_types_and_labels": f"""WITH {LOGS} SELECT id, CASE WHEN NOT answered OR query_type = 'signup' THEN 'unanswered' WHEN query_type = 'click' THEN 'ai' ELSE 'rag' END AS kind,
      CASE WHEN query_type = 'signup' THEN 'safety_blocked' WHEN answered THEN 'answered' ELSE 'unanswered' END AS status,
      CASE WHEN query_type = 'signup' OR answered THEN timestamp ELSE 'Thank you for your question! Our staff will answer it soon.' END AS shown,
      CASE WHEN response_time_ms * 10 + 0.001 > 1000 THEN format('{{:.1f}}s', (response_time_ms * 10 + 0.001) / 1000) ELSE CAST(CAST(round(response_time_ms * 10 + 0.001) AS BIGINT) AS VARCHAR) || 'ms' END AS took FROM logs""",
    "page_of_logs": f"WITH {LOGS} SELECT id, timestamp, query_type FROM logs ORDER BY timestamp DESC, id LIMIT 25 OFFSET 50",
    "page_count": "SELECT count(*) AS total, CAST(ceil(count(*) / 25) AS BIGINT) AS pages FROM events",
    "nearest_log_asof": """WITH c AS (SELECT e.event_id AS error_id, p.event_id AS purchase_id, round(abs(epoch_us(p.ts) / 1e6 - epoch_us(e.ts) / 1e6), 6) AS gap FROM events e JOIN events p ON e.user_id = p.user_id AND e.event_type = 'error' AND p.event_type = 'purchase')
      SELECT error_id, purchase_id, gap FROM (SELECT *, row_number() OVER (PARTITION BY error_id ORDER BY gap, purchase_id) AS n FROM c) WHERE n = 1""",
    "json_field_extract": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS shown FROM events",
    "stats_stream": "SELECT event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1",
    "session_qa_pairs": f"WITH {TURNS} SELECT * FROM turns",
    "session_history_last5": f"""WITH {TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS k FROM turns WHERE answer IS NOT NULL)
      SELECT session_id, string_agg('User: ' || question || chr(10) || 'Assistant: ' || CASE WHEN length(answer) > 200 THEN substr(answer, 1, 200) || '...' ELSE answer END, chr(10) ORDER BY turn) AS history, count(*) AS turns FROM r WHERE k <= 5 GROUP BY 1""",
    "question_hash_lookup": f"WITH {TURNS}, {cache()} SELECT session_id * 1000 + turn AS query_id, c.question_hash, c.cache_id FROM turns t JOIN cache c ON c.question_hash = {HASH.format('upper(t.question)')}",
    "cache_upsert": f"""WITH {TURNS}, last AS (SELECT *, dense_rank() OVER (PARTITION BY session_id ORDER BY turn DESC) AS from_last FROM turns), {cache('old', 'from_last > 1', 'last')}, {cache('fresh', 'from_last <= 2', 'last')}
      SELECT coalesce(o.question_hash, f.question_hash) AS question_hash, coalesce(o.question, f.question) AS question, CASE WHEN f.question_hash IS NOT NULL THEN 'new: ' || coalesce(f.answer, '') ELSE o.answer END AS answer,
      CASE WHEN o.question_hash IS NULL THEN '2024-06-01T00:00:00' ELSE '2024-01-01T00:00:00' END AS created_at, CASE WHEN f.question_hash IS NOT NULL THEN '2024-06-01T00:00:00' ELSE '2024-01-01T00:00:00' END AS updated_at,
      CASE WHEN f.question_hash IS NOT NULL THEN 'rag' ELSE o.answer_quality END AS answer_quality, CASE WHEN f.question_hash IS NOT NULL THEN 'rag' END AS query_type, coalesce(o.usage_count, 1) AS usage_count FROM old o FULL JOIN fresh f ON o.question_hash = f.question_hash""",
    "cache_query_type": f"""WITH {TURNS}, {cache()}, k AS (SELECT *, CASE WHEN answer_quality IN ('rag', 'admin_answered') AND length(question) % 2 = 0 THEN 'rag' WHEN answer_quality IN ('rag', 'admin_answered', 'ai') THEN 'ai' ELSE 'unanswered' END AS query_type FROM cache)
      SELECT question_hash, query_type, concat_ws(',', CASE WHEN query_type = 'unanswered' THEN 'unanswered' END, CASE WHEN usage_count > 1 THEN 'negative_feedback' END) AS attention FROM k""",
    "cache_stats": f"WITH {TURNS}, {cache()} SELECT answer_quality AS quality, count(*) AS entries, sum(usage_count)::BIGINT AS uses, round(avg(usage_count), 2) AS mean_uses FROM cache GROUP BY ROLLUP (answer_quality)",
    "cache_use_counts": f"""WITH {TURNS}, {cache()}, u AS (SELECT {HASH.format('question')} AS question_hash, count(*) AS n FROM turns WHERE turn > 0 GROUP BY 1)
      SELECT question_hash, usage_count + coalesce(n, 0) AS usage_count, CASE WHEN n IS NOT NULL THEN '2024-06-01' END AS last_used FROM cache LEFT JOIN u USING (question_hash)""",
    "cache_delete_cascade": f"""WITH {TURNS}, {cache()}, l AS (SELECT session_id * 1000 + turn AS m, {HASH.format('question')} AS question_hash FROM turns), g AS (SELECT DISTINCT question_hash FROM l WHERE m % 5 = 0),
      k AS (SELECT question_hash, count(*) AS logs FROM l WHERE m % 5 <> 0 GROUP BY 1), c AS (SELECT question_hash FROM cache WHERE question_hash NOT IN (SELECT question_hash FROM g))
      SELECT coalesce(k.question_hash, c.question_hash) AS question_hash, coalesce(logs, 0) AS logs, c.question_hash IS NOT NULL AS cached FROM k FULL JOIN c ON k.question_hash = c.question_hash""",
    "url_normalize": f"SELECT page_id, {NORMAL.format('url')} AS normalized, regexp_extract(url, '{HEAD}', 2) AS host, {PATH.format('url')} AS path, regexp_matches(url, '{HEAD}') AS valid FROM pages",
    "url_category": f"""WITH p AS (SELECT page_id, url, {PATH.format('url')} AS path FROM pages), s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS steps FROM p)
      SELECT page_id, {SEGMENT.format('url')} AS category, contains(path, '/en/') OR contains(path, '/fr/') OR contains(path, '/de/') AS content_link,
      CASE WHEN len(steps) > 0 THEN translate(steps[-1], '-_', '  ') ELSE regexp_extract(url, '{HEAD}', 2) END AS name FROM s""",
    "url_slug": "SELECT page_id, regexp_replace(regexp_replace(url, '[^\\p{L}\\p{N}_]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, substr(translate(regexp_replace(url, '^https?://', ''), '/?=', '___'), 1, 100) AS stem FROM pages",
    "url_category_counts": f"SELECT {SEGMENT.format('url')} AS category, count(*) AS n FROM pages GROUP BY 1",
    "link_discovery": f"WITH {FOUND} SELECT url, category FROM found",
    "links_new_anti": f"WITH {LISTED}, {FETCHED} SELECT url FROM listed WHERE url NOT IN (SELECT url FROM fetched)",
    "links_existing_semi": f"WITH {LISTED}, {FETCHED} SELECT url FROM listed INTERSECT SELECT url FROM fetched",
    "links_consistency": f"WITH {LISTED}, {FETCHED} SELECT url, 'orphaned' AS state FROM (SELECT url FROM fetched EXCEPT SELECT url FROM listed) UNION ALL SELECT url, 'missing' FROM (SELECT url FROM listed EXCEPT SELECT url FROM fetched)",
    "links_add_states": f"WITH {LISTED}, {FETCHED}, q AS (SELECT url FROM fetched UNION VALUES ('nonsense'), ('ftp:/x')) SELECT url, CASE WHEN NOT regexp_matches(url, '{HEAD}') THEN 'invalid' WHEN url IN (SELECT url FROM listed) THEN 'existing' ELSE 'added' END AS state FROM q",
    "links_union": f"WITH {LISTED}, {FETCHED} SELECT url FROM listed UNION SELECT url FROM fetched",
    "scrape_status": f"""WITH {LISTED}, {FETCHED}, c AS (SELECT {CATEGORY.format('url')} AS category, url IN (SELECT url FROM fetched) AS done FROM listed), g AS (SELECT category, count(*) AS total, count(*) FILTER (WHERE done) AS scraped FROM c GROUP BY ROLLUP (category))
      SELECT *, total - scraped AS pending, round(scraped / total * 100, 2) AS percent FROM g""",
    "discovery_diff": f"""WITH {FOUND}, {LISTED}, n AS (SELECT DISTINCT url FROM found WHERE url NOT IN (SELECT url FROM listed))
      SELECT (SELECT count(*) FROM found) AS total, (SELECT count(*) FROM n) AS new, (SELECT count(DISTINCT url) FROM found WHERE url IN (SELECT url FROM listed)) AS existing, (SELECT string_agg(url, ' ' ORDER BY url) FROM (SELECT url FROM n ORDER BY url LIMIT 10)) AS preview""",
    "content_status": f"""WITH {FETCHED}, f AS (SELECT {NORMAL.format('url')} AS url, max(strlen(html)) AS size FROM pages GROUP BY 1)
      SELECT count(*) AS files, sum(size)::BIGINT AS bytes, (SELECT count(*) FROM f WHERE url NOT IN (SELECT url FROM fetched)) AS orphaned, (SELECT count(DISTINCT url) FROM fetched WHERE url NOT IN (SELECT url FROM f)) AS missing FROM f""",
    "html_clean": """WITH a AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
      b AS (SELECT page_id, html, replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS t FROM a),
      c AS (SELECT page_id, html, regexp_replace(trim(regexp_replace(t, '\\s+', ' ', 'g')), '&[a-zA-Z0-9#]+;', '', 'g') AS t FROM b) SELECT page_id, CASE WHEN html IS NULL OR lower(t) IN ('none', 'null', 'undefined') THEN '' ELSE t END AS text FROM c""",
    "chunk_sections": """WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(1) || '## '), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 10) AS s FROM documents)
      SELECT doc_id, unnest(generate_series(0, len(s) - 1)) AS chunk_index, unnest(s) AS chunk, trim(regexp_extract(unnest(s), '(?m)^[^\\S\\n]*##(.*)$', 1)) AS title FROM p WHERE len(s) > 0""",
    "chunk_sentences3": """WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\.\\s+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS s FROM documents),
      e AS (SELECT doc_id, unnest(generate_series(0, len(s) - 1)) AS i, unnest(s) AS x FROM p WHERE len(s) > 0) SELECT doc_id, i // 3 AS chunk_index, string_agg(x, ' ' ORDER BY i) AS chunk FROM e GROUP BY 1, 2""",
    "chunk_fixed_overlap": "WITH s AS (SELECT doc_id, text, unnest(generate_series(0, greatest(0, CAST(ceil((length(text) - 50) / 450) AS INT) - 1))) AS chunk_index FROM documents WHERE length(text) > 0) SELECT doc_id, chunk_index, substr(text, chunk_index * 450 + 1, 500) AS chunk FROM s",
    "chunk_merge_greedy": """WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 10) AS s FROM documents),
      w(doc_id, s, i, done, opened, size) AS (SELECT doc_id, s, 1, []::VARCHAR[], []::VARCHAR[], 0 FROM p WHERE len(s) > 0
        UNION ALL SELECT doc_id, s, i + 1,
          CASE WHEN starts_with(s[i], '## Overview') OR length(s[i]) >= 1200 THEN list_append(CASE WHEN len(opened) > 0 THEN list_append(done, array_to_string(opened, chr(10) || chr(10))) ELSE done END, s[i])
               WHEN (size + length(s[i]) > 600 OR len(opened) >= 8) AND len(opened) > 0 AND size >= 200 THEN list_append(done, array_to_string(opened, chr(10) || chr(10))) ELSE done END,
          CASE WHEN starts_with(s[i], '## Overview') OR length(s[i]) >= 1200 THEN []::VARCHAR[] WHEN (size + length(s[i]) > 600 OR len(opened) >= 8) AND len(opened) > 0 AND size >= 200 THEN [s[i]] ELSE list_append(opened, s[i]) END,
          CAST(CASE WHEN starts_with(s[i], '## Overview') OR length(s[i]) >= 1200 THEN 0 WHEN (size + length(s[i]) > 600 OR len(opened) >= 8) AND len(opened) > 0 AND size >= 200 THEN length(s[i]) ELSE size + length(s[i]) END AS INT) FROM w WHERE i <= len(s)),
      f AS (SELECT doc_id, CASE WHEN len(opened) > 0 THEN list_append(done, array_to_string(opened, chr(10) || chr(10))) ELSE done END AS c FROM w WHERE i = len(s) + 1),
      e AS (SELECT doc_id, unnest(generate_series(0, len(c) - 1)) AS chunk_index, unnest(c) AS chunk FROM f) SELECT doc_id, chunk_index, chunk, length(chunk) BETWEEN 200 AND 4000 AS kept FROM e""",
    "source_stats": "SELECT lang AS content_type, count(*) AS chunks, count(DISTINCT CASE WHEN source <> '' THEN source END) AS sources FROM documents GROUP BY ROLLUP (lang)",
    "chunks_by_file": "SELECT source || '.pdf' AS file, count(*) AS chunks FROM documents GROUP BY 1",
    "dedup_prefix100": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY substr(text, 1, 100)",
    "collection_changes": "SELECT source, count(*) AS chunks, sum(length(t))::BIGINT AS chars FROM (SELECT source, text AS t FROM documents WHERE source NOT IN ('src0', 'src1') UNION ALL VALUES ('src0', 'text new'), ('new', 'text')) GROUP BY 1",
    "bm25_terms": f"WITH {INDEX} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "bm25_stats": "SELECT count(*) AS total_documents, count(*) FILTER (WHERE coalesce(text, '') <> '') AS available, round(avg(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> ''))), 6) AS average_length FROM documents",
    "bm25_topk": f"WITH {INDEX} SELECT query_id, doc_id, round(bm25_score, 6) AS bm25_score, rank FROM ranked WHERE rank <= 20 AND bm25_score > 0",
    "bm25_filtered": f"""WITH {INDEX}, w AS (SELECT query_id, doc_id, bm25_score, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25_score, 9) DESC, doc_id) AS r FROM ranked JOIN documents USING (doc_id) WHERE rank <= 20 AND bm25_score > 0 AND lang = 'en')
      SELECT query_id, doc_id, round(bm25_score, 6) AS bm25_score, r AS rank FROM w WHERE r <= 10""",
    "vector_topk": f"WITH {NEAR} SELECT query_id, doc_id, round(similarity, 6) AS similarity, round(2 - 2 * similarity, 6) + 0.0 AS distance, rank FROM near WHERE rank <= 20",
    "vector_topk_filtered": f"WITH {NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, doc_id) AS k FROM sims WHERE label = 3) SELECT query_id, doc_id, round(similarity, 6) AS similarity, k AS rank FROM r WHERE k <= 5",
    "vector_matching": "SELECT vec_id AS doc_id FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 20",
    "hybrid_fusion": f"WITH {FUSED} SELECT query_id, doc_id, rag_score, round(bm25_score, 6) AS bm25_score, round(hybrid_score, 6) AS hybrid_score, search_type, rank FROM fused",
    "hybrid_type_counts": f"WITH {FUSED} SELECT query_id, count(*) FILTER (WHERE search_type = 'rag') AS n_rag, count(*) FILTER (WHERE search_type = 'bm25') AS n_bm25, count(*) FILTER (WHERE search_type = 'hybrid') AS n_hybrid FROM fused GROUP BY 1",
    "hybrid_reciprocal_rank": f"""WITH {FUSED}, rr AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS s FROM (SELECT query_id, doc_id, rank FROM near JOIN documents USING (doc_id) WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, rank FROM ranked WHERE rank <= 40 AND bm25_score > 0) GROUP BY ALL)
      SELECT query_id, doc_id, round(s, 6) AS rrf_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, doc_id) AS rank FROM rr) WHERE rank <= 20""",
    "rerank_lexical": f"""WITH {RERANKED}, x AS (SELECT query_id, doc_id, rank, count(*) OVER (PARTITION BY query_id) AS c, list_distinct({tokens('query')}) AS q, {tokens('substr(content, 1, 1500)')} AS t FROM hits),
      s AS (SELECT *, CASE WHEN c > 1 THEN CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / len(q) ELSE 0.0 END END AS v FROM x),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(v, 9) DESC, rank) AS k FROM s) SELECT query_id, doc_id, round(v, 6) AS rerank_score, k AS rerank FROM r WHERE k <= 12""",
    "matched_files": f"""WITH {INDEX}, m AS (SELECT query_id, source || '.pdf' AS name, min(rank) AS r FROM ranked JOIN documents USING (doc_id) WHERE rank <= 20 AND bm25_score > 0 GROUP BY ALL) SELECT query_id, string_agg(name, ',' ORDER BY r) AS files FROM m GROUP BY 1""",
    "safety_rules": """WITH r AS (SELECT conv_id, turn, CASE WHEN text IS NULL OR regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN 'empty' WHEN length(text) > 10000 THEN 'too_long' WHEN regexp_matches(lower(text), 'worthless|trash|scum') THEN 'unsafe' WHEN contains(lower(text), 'the ') OR contains(lower(text), ' die ') THEN 'indicator' ELSE 'model' END AS rule FROM conversations)
      SELECT *, rule NOT IN ('too_long', 'unsafe') AS safe FROM r""",
    "hallucination_flags": "SELECT conv_id, turn, (text IS NULL OR text = '' OR " + " OR ".join(f"contains(lower(text), '{p.replace(chr(39), chr(39) * 2)}')" for p in (*DOUBTFUL_PHRASES, "ich n", "the th")) + ") AS doubtful FROM conversations WHERE role = 'assistant'",
    "question_terms": f"SELECT item_id, array_to_string({terms_of('text')}, ' ') AS terms, length(text) // 4 AS tokens, {HASH.format('text')} AS hash FROM benchmark",
    "eval_metric_means": f"WITH {SCORES} SELECT * FROM means",
    "eval_bands": f"WITH {SCORES} SELECT metric, {BAND} AS band FROM means",
    "eval_overall": f"""WITH {SCORES}, g AS (SELECT *, {BAND} AS band FROM means), o AS (SELECT avg(mean) AS m, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE band IN ('excellent', 'good')), '') AS strengths, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE band = 'poor'), '') AS weaknesses, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE mean < 0.7), '') AS improve FROM g)
      SELECT round(m, 6) AS mean, CASE WHEN m >= 0.85 THEN 'excellent' WHEN m >= 0.75 THEN 'good' WHEN m >= 0.65 THEN 'acceptable' ELSE 'needs_improvement' END AS band, strengths, weaknesses, improve FROM o""",
    "eval_by_category": f"WITH {SCORES} SELECT category, difficulty, metric, round(avg(score), 6) AS mean, count(score) AS n FROM scores GROUP BY GROUPING SETS ((category, metric), (difficulty, metric), (metric))",
    "eval_compare": f"""WITH {SCORES}, b AS (SELECT metric, round(avg(score), 4) AS before FROM scores WHERE category = 'en' GROUP BY 1), c AS (SELECT metric, round(avg(score), 4) AS now FROM scores WHERE category <> 'en' GROUP BY 1),
      x AS (SELECT metric, before, now, round(now - before, 4) AS delta, CASE WHEN before = 0 THEN 0.0 ELSE round((now - before) / before * 100, 2) END AS percent FROM b JOIN c USING (metric)) SELECT *, CASE WHEN delta > 0.05 THEN 'improved' WHEN delta < -0.05 THEN 'regressed' ELSE 'stable' END AS verdict FROM x""",
    "proxy_score": f"""WITH {RERANKED}, a AS (SELECT query_id, lower(string_agg(content, ' ' ORDER BY content)) AS t, avg(CASE WHEN length(content) >= 500 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rich FROM hits WHERE rank <= 7 GROUP BY 1),
      q AS (SELECT item_id AS query_id, {terms_of('text')} AS g, list_transform(string_split(text, ' ')[1:4], lambda w: lower(w)) AS k FROM benchmark),
      s AS (SELECT q.query_id, coalesce(t, '') AS t, CASE WHEN len(g) > 0 THEN len(list_filter(g, lambda w: contains(coalesce(t, ''), w))) / len(g) ELSE 0.0 END AS recall, CASE WHEN len(k) > 0 THEN len(list_filter(k, lambda w: contains(coalesce(t, ''), w))) / len(k) ELSE 0.0 END AS keyword_hits, coalesce(rich, 0.0) AS richness FROM q LEFT JOIN a USING (query_id))
      SELECT query_id, round(recall, 6) AS recall, round(keyword_hits, 6) AS keyword_hits, round(richness, 6) AS richness, round(CASE WHEN t = '' THEN 0.0 ELSE 0.5 * recall + 0.3 * keyword_hits + 0.2 * richness END, 6) AS proxy_score FROM s""",
    "tuner_grid": f"SELECT {', '.join(SPACE)} FROM {GRID}",
    "tuner_rank": f"SELECT {', '.join(SPACE)}, round(rag_weight * 0.5 + vector_k / 100 - min_hybrid_score / 1000 + reranker_top_k / 1000 + min_rag_score / 10000 + min_bm25_score / 100000 + max_hybrid_results / 1000000, 9) AS proxy_score FROM {GRID} ORDER BY proxy_score DESC LIMIT 20",
}
