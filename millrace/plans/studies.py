"""Named queries over retrieval, evaluation and tuning, each beside its DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, fusion, rerank
from ..session import scratch, stored
from . import answering
from .oracle import BAND, FUSED, INDEX, NEAR, terms_of
from .queries import FUSE, _bm25, _lists, cache_rows, questions, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def named(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return named


def hits(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    """Lexical hits of all questions with their texts and sources."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"), F.concat(F.lit("/in/"), F.col("source"), F.when(F.col("doc_id") % 2 == 0, ".PDF").otherwise("")).alias("source"))
    return _bm25(spark, d, k).join(docs, "doc_id").join(questions(spark, d), "query_id")


HITS = f"""{INDEX}, hits AS (SELECT query_id, doc_id, rank, d.text AS content, b.text AS query, '/in/' || source || CASE WHEN doc_id % 2 = 0 THEN '.PDF' ELSE '' END AS source
    FROM ranked JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id WHERE rank <= 20 AND bm25_score > 0)"""

# Retrieval


@query(f"""WITH {FUSED}, extras AS (SELECT query_id, doc_id, text AS content, near.rank AS rank FROM near JOIN documents USING (doc_id) WHERE near.rank BETWEEN 21 AND 40),
    keys AS (SELECT query_id, substr(d.text, 1, 100) AS key FROM fused JOIN documents d USING (doc_id)), last AS (SELECT query_id, max(rank) AS l FROM fused GROUP BY 1),
    new AS (SELECT e.query_id, e.doc_id, coalesce(l, 0) + e.rank AS rank FROM extras e LEFT JOIN last USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM keys k WHERE k.query_id = e.query_id AND k.key = substr(e.content, 1, 100)))
    SELECT query_id, doc_id, search_type, rank FROM fused UNION ALL SELECT query_id, doc_id, NULL, rank FROM new""")
def fused_with_extras(spark, d):
    rag, words = _lists(spark, d)
    deep, _ = _lists(spark, d, 40)
    out = fusion.with_extras(fusion.fuse(rag, words, FUSE), deep.where("rank > 20").select("query_id", "doc_id", "content", "rank"))
    return out.select("query_id", "doc_id", "search_type", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {NEAR}, {INDEX}, u AS (
      SELECT query_id, doc_id, substr(text, 1, 150) AS key, 0 AS priority, near.rank AS rank FROM near JOIN documents USING (doc_id) WHERE near.rank <= 20
      UNION ALL SELECT query_id, doc_id, substr(text, 1, 150), 1, ranked.rank FROM ranked JOIN documents USING (doc_id) WHERE ranked.rank <= 40 AND bm25_score > 0)
    SELECT query_id, doc_id, priority, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY priority, rank) AS n FROM u) WHERE n = 1""")
def dual_query(spark, d):
    rag, words = _lists(spark, d)
    found = fusion.dual(rag, words.select("query_id", "doc_id", "content", "rank"))
    return found.select("query_id", "doc_id", "priority", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {HITS}, g AS (SELECT query_id, length(query) % 3 = 0 OR length(string_agg(substr(content, 1, 300), chr(10) ORDER BY rank)) % 2 = 0 AS bad FROM hits WHERE rank <= 5 GROUP BY query_id, query) SELECT query_id, doc_id, NOT bad AS relevant FROM hits JOIN g USING (query_id)""")
def graded_hits(spark, d):
    grader = lambda q, c: F.when((F.length(q) % 3 == 0) | (F.length(c) % 2 == 0), "it is Incorrect").otherwise("CORRECT")
    return rerank.grade(hits(spark, d), grader, "rank").select("query_id", "doc_id", "relevant")


@query(f"""WITH {HITS}, x AS (SELECT *, CASE WHEN ends_with(source, '.PDF') THEN '/docs/' || string_split(source, '/')[-1] ELSE source END AS link FROM hits),
    l AS (SELECT query_id, string_agg(link, chr(10) ORDER BY r) AS links FROM (SELECT query_id, link, min(rank) AS r FROM x WHERE link IS NOT NULL GROUP BY ALL) GROUP BY 1),
    c AS (SELECT query_id, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS body, string_agg(content, chr(10) || '---' || chr(10) ORDER BY rank) FILTER (WHERE rank <= 3) AS first3 FROM x GROUP BY 1)
    SELECT query_id, md5(body || CASE WHEN links IS NOT NULL THEN chr(10) || chr(10) || 'SOURCE METADATA' || chr(10) || links ELSE '' END) AS context, md5(first3) AS first3 FROM c LEFT JOIN l USING (query_id)""")
def answer_contexts(spark, d):
    h = hits(spark, d)
    return rerank.context(h, "rank").join(rerank.first_three(h), "query_id").select("query_id", F.md5("context").alias("context"), F.md5("text").alias("first3"))


@query()
def answer_batch(spark, d):
    """All questions through the whole pipeline, with the default plug-ins: no SQL says that, tests compare it by parts."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source"), F.lit("pdf").alias("content_type"), F.lit("").alias("code"), F.lit("").alias("title"))
    chunks = stored(answering.build(docs, answering.Models()), "chunks")
    return answering.answer(questions(spark, d), chunks, cache_rows(spark, d)).select("query_id", "status", "query_type", "cache_hit", F.md5("answer").alias("answer"))


# Evaluation

TERMS = f"q AS (SELECT item_id AS query_id, text AS question, {terms_of('text')} AS g FROM benchmark)"
SHARE = "CASE WHEN len({0}) > 0 THEN len(list_filter({0}, lambda w: contains({1}, w))) / len({0}) ELSE 0.0 END"
JUDGED = f"""{HITS}, {TERMS}, ctx AS (SELECT query_id, list(content ORDER BY rank) AS contexts, lower(string_agg(content, ' ' ORDER BY rank)) AS body FROM hits WHERE rank <= 10 GROUP BY 1),
    top AS (SELECT query_id, substr(content, 1, 300) AS answer FROM hits WHERE rank = 1),
    items AS (SELECT q.query_id, question, g, coalesce(contexts, []) AS contexts, coalesce(body, '') AS body, coalesce(answer, '') AS answer, {terms_of("coalesce(answer, '')")} AS a, CASE WHEN q.query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category FROM q LEFT JOIN ctx USING (query_id) LEFT JOIN top USING (query_id)),
    judged AS (SELECT query_id, category, 'faithfulness' AS metric, {SHARE.format('a', 'body')} AS score FROM items UNION ALL SELECT query_id, category, 'answer_relevancy', {SHARE.format('g', 'lower(answer)')} FROM items
      UNION ALL SELECT query_id, category, 'context_recall', {SHARE.format('g', 'body')} FROM items
      UNION ALL SELECT query_id, category, 'context_precision', CASE WHEN len(contexts) > 0 THEN len(list_filter(contexts, lambda c: len(list_filter(g, lambda w: contains(lower(c), w))) > 0)) / len(contexts) ELSE 0.0 END FROM items)"""


def truth(spark: SparkSession, d: str) -> DataFrame:
    t = questions(spark, d)
    return t.select("query_id", F.col("query").alias("question"), F.col("query").alias("ground_truth"), F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd").alias("category"), F.lit("medium").alias("difficulty"))


def judged(spark: SparkSession, d: str) -> DataFrame:
    h = hits(spark, d)
    answered = h.where("rank = 1").select("query_id", F.substring("content", 1, 300).alias("answer"))
    return evaluation.comprehensive(truth(spark, d), answered, h)


@query(f"WITH {JUDGED} SELECT query_id, category, metric, round(score, 6) AS score FROM judged")
def eval_comprehensive(spark, d):
    return judged(spark, d).select("query_id", "category", "metric", F.round("score", 6).alias("score"))


@query(f"""WITH {JUDGED}, b AS (SELECT query_id, metric, CASE WHEN query_id % 3 = 0 THEN score / 2 ELSE score END AS score FROM judged), m AS (SELECT metric, round(avg(j.score), 4) AS before, round(avg(b.score), 4) AS now, count(*) FILTER (WHERE j.score > b.score) AS a_wins, count(*) FILTER (WHERE b.score > j.score) AS b_wins FROM judged j JOIN b USING (query_id, metric) GROUP BY 1),
    x AS (SELECT metric, before, now, round(now - before, 4) AS delta, CASE WHEN before = 0 THEN 0.0 ELSE round((now - before) / before * 100, 2) END AS percent, a_wins, b_wins FROM m) SELECT *, CASE WHEN delta > 0.05 THEN 'improved' WHEN delta < -0.05 THEN 'regressed' ELSE 'stable' END AS verdict FROM x""")
def eval_ab(spark, d):
    a = judged(spark, d)
    return evaluation.ab_test(a, a.withColumn("score", F.when(F.col("query_id") % 3 == 0, F.col("score") / 2).otherwise(F.col("score"))))


@query(f"""WITH {JUDGED}, m AS (SELECT metric, round(avg(score), 4) AS mean, count(score) AS n FROM judged GROUP BY 1) SELECT string_agg(printf('%s: %.4f (%s, %d items)', metric, mean, {BAND}, n), chr(10) ORDER BY metric) AS report FROM m""")
def eval_report(spark, d):
    return evaluation.report(evaluation.metric_means(judged(spark, d)))


@query(f"""WITH {JUDGED}, m AS (SELECT CASE WHEN query_id % 3 = 0 THEN 1 WHEN query_id % 3 = 1 THEN 2 ELSE 3 END AS config_id, metric, avg(score) AS mean FROM judged GROUP BY ALL), o AS (SELECT config_id, avg(mean) AS mean FROM m GROUP BY 1) SELECT config_id, round(mean, 6) AS mean FROM o ORDER BY round(mean, 9) DESC, config_id LIMIT 1""")
def eval_best_configuration(spark, d):
    part = F.when(F.col("query_id") % 3 == 0, 1).when(F.col("query_id") % 3 == 1, 2).otherwise(3)
    means = judged(spark, d).groupBy(part.alias("config_id"), "metric").agg(F.avg("score").alias("mean"))
    return evaluation.best_configuration(means).select("config_id", F.round("mean", 6).alias("mean"))


BROAD = ("What is there to read?", "How does it end?")


@query("""WITH t AS (SELECT 'What is ABCD' || (1000 + item_id) || ' ' || text AS question, text AS ground_truth, 'ABCD' || (1000 + item_id) AS code, item_id FROM benchmark)
    SELECT question AS query, ground_truth, 'direct' AS query_type FROM t UNION ALL SELECT 'Tell me about ' || code, ground_truth, 'rephrased' FROM t UNION ALL VALUES ('What is there to read?', '', 'broad'), ('How does it end?', '', 'broad')""")
def eval_questions(spark, d):
    t = questions(spark, d)
    asked = t.select(F.concat(F.lit("What is ABCD"), (1000 + F.col("query_id")).cast("string"), F.lit(" "), F.col("query")).alias("question"), F.col("query").alias("ground_truth"), F.lit("c").alias("category"), F.lit("easy").alias("difficulty"))
    return evaluation.test_queries(asked, list(BROAD)).select("query", "ground_truth", "query_type")


@query("SELECT 'q_' || substr(sha256(text), 1, 12) AS query_id, text AS question, arg_max(text, item_id) AS ground_truth, CASE WHEN min(length(text)) % 2 = 0 THEN 'even' ELSE 'general' END AS category FROM benchmark GROUP BY text")
def eval_truth(spark, d):
    t = questions(spark, d)
    items = t.select(F.col("query").alias("question"), F.col("query").alias("ground_truth"), F.when(F.length("query") % 2 == 0, "even").alias("category"), F.lit(None).cast("string").alias("difficulty"), F.lit(None).cast("array<string>").alias("keywords"))
    path = evaluation.save_rows(evaluation.truth_rows(items), scratch(spark, "truth"), "truth_1")
    loaded = evaluation.load_rows(spark, path)
    both = evaluation.chosen(loaded, "even").unionByName(evaluation.chosen(loaded, "general", "medium"))
    return both.select("query_id", "question", "ground_truth", "category")


# Tuning

FEW = {"vector_k": [20], "max_hybrid_results": [30], "min_hybrid_score": [30.0, 70.0], "min_rag_score": [15.0], "min_bm25_score": [1.0, 3.0], "rag_weight": [0.5, 0.7], "reranker_top_k": [7, 12]}
CONFIGS = " CROSS JOIN ".join(f"(SELECT unnest({v}::{'INT' if isinstance(v[0], int) else 'DOUBLE'}[]) AS {k}) {k}_" for k, v in FEW.items())


def tuning_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lists as deep as the largest configuration reads, and all questions with their truth; questions and vector queries share ids."""
    rag, words = _lists(spark, d, max(evaluation.SPACE["vector_k"]), 2 * max(evaluation.SPACE["max_hybrid_results"]))
    asked = questions(spark, d).select("query_id", F.col("query").alias("question"), F.col("query").alias("ground_truth"), F.slice(F.split("query", " "), 1, 4).alias("keywords"))
    return rag, words, asked


@query(f"""WITH {INDEX}, {NEAR}, c AS (SELECT *, row_number() OVER () AS config FROM {CONFIGS}),
    rag AS (SELECT config, query_id, substr(text, 1, 100) AS key, arg_min(doc_id, near.rank) AS doc_id, min(near.rank) AS rank FROM near JOIN documents USING (doc_id), c WHERE near.rank <= vector_k GROUP BY ALL),
    words AS (SELECT config, query_id, substr(text, 1, 100) AS key, arg_min(doc_id, ranked.rank) AS doc_id, min(ranked.rank) AS rank, arg_max(least(bm25_score * 10, 100.0), ranked.rank) AS s FROM ranked JOIN documents USING (doc_id), c WHERE bm25_score > 0 AND ranked.rank <= 2 * max_hybrid_results GROUP BY ALL),
    f AS (SELECT coalesce(r.config, w.config) AS config, coalesce(r.query_id, w.query_id) AS query_id, coalesce(r.doc_id, w.doc_id) AS doc_id, CASE WHEN r.key IS NOT NULL THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS rs, coalesce(s, 0.0) AS bs, coalesce(r.rank, w.rank + 1000000) AS place FROM rag r FULL JOIN words w ON r.config = w.config AND r.query_id = w.query_id AND r.key = w.key),
    h AS (SELECT f.*, c.*, rs * rag_weight + bs * (1 - rag_weight) AS hs FROM f JOIN c USING (config)),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config, query_id ORDER BY round(hs, 9) DESC, place) AS n FROM h WHERE hs >= min_hybrid_score OR rs >= min_rag_score OR bs >= min_bm25_score) WHERE n <= max_hybrid_results AND n <= reranker_top_k),
    a AS (SELECT config, query_id, lower(string_agg(d.text, ' ' ORDER BY d.text)) AS t, avg(CASE WHEN length(d.text) >= 500 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rich FROM k JOIN documents d USING (doc_id) GROUP BY ALL),
    q AS (SELECT item_id AS query_id, {terms_of('text')} AS g, list_transform(string_split(text, ' ')[1:4], lambda w: lower(w)) AS kw FROM benchmark),
    s AS (SELECT c.config, coalesce(t, '') AS t, {SHARE.format('g', "coalesce(t, '')")} AS recall, {SHARE.format('kw', "coalesce(t, '')")} AS found, coalesce(rich, 0.0) AS rich FROM q CROSS JOIN c LEFT JOIN a ON a.config = c.config AND a.query_id = q.query_id),
    m AS (SELECT config, round(avg(CASE WHEN t = '' THEN 0.0 ELSE 0.5 * recall + 0.3 * found + 0.2 * rich END), 6) AS proxy_score, count(*) AS n FROM s GROUP BY 1)
    SELECT {', '.join(FEW)}, proxy_score, n FROM m JOIN c USING (config)""")
def tuner_scores(spark, d):
    rag, words, asked = tuning_lists(spark, d)
    out = evaluation.config_scores(rag, words, asked, evaluation.grid(spark, FEW))
    return out.select(*FEW, F.round("proxy_score", 6).alias("proxy_score"), "n")


@query()
def tuner_run(spark, d):
    """Random search, focused grid and baseline: which configurations are tried is by hash, so SQL can't; tuner_scores checks the scores."""
    rag, words, asked = tuning_lists(spark, d)
    out = evaluation.tuned(rag, words, asked, trials=10, near=6)
    return out.best.select(*evaluation.SPACE, F.round("proxy_score", 6).alias("proxy_score"), F.lit(round(out.baseline, 6)).alias("baseline"))
