"""One query for each operator family, over the test tables, by name.

Floats are rounded to six places and ties broken by id, so that oracle.SQL gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import logs as log_functions
from ..functions import text, urls
from ..functions.jsonflat import key_value
from ..operators import analytics, answers, chunking, evaluation, fusion, lexical, links, rerank, store, vectors
from ..session import scratch
from ..streaming import updates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: pages have one-letter-coded languages as first path segments; these stand for the categories.
SEGMENTS = ("en", "fr", "de")
#: Questions for retrieval: the benchmark's items.
FUSE = fusion.Weights(most=20)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def log_rows(spark: SparkSession, d: str) -> DataFrame:
    """events as interaction logs."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        "ts",
        F.col("user_id").alias("session_id"),
        F.col("event_type").alias("query_type"),
        F.col("value").alias("response_time_ms"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens_used"),
        (F.col("event_type") != "error").alias("answered"),
        F.when(F.col("event_type") == "purchase", "positive").when(F.col("event_type") == "error", "negative").alias("user_feedback"),
    )


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Questions of users with the assistant's next turn, if there is one."""
    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = c.withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w)).where("role = 'user'")
    return nxt.select(F.col("conv_id").alias("session_id"), "turn", F.col("text").alias("question"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("answer"))


def cache_rows(spark: SparkSession, d: str) -> DataFrame:
    """A cache of the distinct questions."""
    return cached(turns(spark, d))


def cached(t: DataFrame) -> DataFrame:
    return t.groupBy(text.question_hash(F.col("question")).alias("question_hash")).agg(
        F.min("question").alias("question"), F.max("answer").alias("answer"), F.count(F.lit(1)).alias("usage_count"), F.min("session_id").alias("cache_id")
    ).withColumn("answer_quality", F.when(F.col("answer").isNull(), "unanswered").when(F.length("answer") > 200, "rag").otherwise("ai"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def listed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(urls.normalized(F.col("url")).alias("url")).where("url != ''").distinct()


def fetched_urls(spark: SparkSession, d: str) -> DataFrame:
    """What has been fetched: URLs of long pages, and two that nobody lists."""
    long = table(spark, d, "pages").where("length(html) >= 3000").select(urls.normalized(F.col("url")).alias("url")).where("url != ''").distinct()
    return long.union(spark.createDataFrame([("https://old.example.com/courses/1",), ("https://old.example.com/programs/2",)], "url string"))


# Logs


@query
def log_dashboard_stats(spark, d):
    return analytics.dashboard(log_rows(spark, d)).withColumn("avg_response_time", F.round("avg_response_time", 2))


@query
def log_daily_trend(spark, d):
    return analytics.daily(log_rows(spark, d))


@query
def log_snapshot(spark, d):
    return analytics.snapshot(log_rows(spark, d))


@query
def log_export_counts(spark, d):
    return analytics.exported(log_rows(spark, d))


@query
def log_feedback_totals(spark, d):
    return analytics.feedback_totals(log_rows(spark, d))


@query
def log_by_type_rollup(spark, d):
    return log_rows(spark, d).rollup("query_type").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens_used").alias("tokens"), F.round(F.avg("response_time_ms"), 6).alias("mean_ms"))


@query
def log_types_and_labels(spark, d):
    r = log_rows(spark, d)
    blocked = F.col("query_type") == "signup"
    state = log_functions.status(F.col("answered"), blocked)
    return r.select("id", log_functions.query_type(F.col("answered"), blocked, F.when(F.col("query_type") == "click", "fallback").otherwise("rag")).alias("kind"), state.alias("status"), log_functions.shown_text(state, F.col("timestamp")).alias("shown"), text.duration_label(F.col("response_time_ms") * 10 + 0.001).alias("took"))


@query
def page_of_logs(spark, d):
    return analytics.page(log_rows(spark, d).select("id", "timestamp", "query_type"), [F.desc("timestamp"), F.col("id")], 3, 25)


@query
def page_count(spark, d):
    return analytics.page_count(log_rows(spark, d), 25)


@query
def nearest_log_asof(spark, d):
    r = log_rows(spark, d)
    left = r.where("query_type = 'error'").select("session_id", F.col("ts").alias("at"), F.col("id").alias("error_id"))
    right = r.where("query_type = 'purchase'").select("session_id", F.col("ts").alias("at"), F.col("id").alias("purchase_id"))
    return store.nearest_in_time(left, right, ["session_id"], "error_id", "purchase_id")


@query
def json_field_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), key_value(F.parse_json("props"), "k", "none").alias("shown"))


@query
def stats_stream(spark, d):
    name = "events_" + scratch(spark, "n")[-8:]
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    return updates.drained(updates.running_counts(events), name, "complete", scratch(spark, "stream"))


# Sessions


@query
def session_qa_pairs(spark, d):
    return turns(spark, d)


@query
def session_history_last5(spark, d):
    return analytics.history(turns(spark, d).where("answer is not null"))


# Cache


@query
def question_hash_lookup(spark, d):
    cache = cache_rows(spark, d)
    asked = turns(spark, d).select((F.col("session_id") * 1000 + F.col("turn")).alias("query_id"), F.upper("question").alias("query"))
    return answers.exact(asked.withColumn("query", F.concat(F.lit("  "), F.lower("query"))), cache).select("query_id", "question_hash", "cache_id")


@query
def fuzzy_cache_match(spark, d):
    cache = cache_rows(spark, d)
    asked = cache.select(F.col("cache_id").alias("query_id"), F.concat(F.col("question"), F.lit("?")).alias("query"))
    return answers.lookup(asked, cache)


@query
def cache_upsert(spark, d):
    now = F.lit("2024-06-01T00:00:00")
    none = F.lit(None).cast("string")
    full = lambda c: c.select("question_hash", "question", "answer", F.lit("2024-01-01T00:00:00").alias("created_at"), F.lit("2024-01-01T00:00:00").alias("updated_at"), "answer_quality", none.alias("last_used"), F.col("cache_id").cast("string").alias("cache_id"), none.alias("user_feedback"), none.alias("query_type"), "usage_count", F.array().cast("array<string>").alias("matched_files"))
    # the cache of all turns but each session's last meets new answers of the last two, so every turn arrives and some in both
    asked = turns(spark, d).withColumn("from_last", F.dense_rank().over(Window.partitionBy("session_id").orderBy(F.desc("turn"))))
    old = full(cached(asked.where("from_last > 1")))
    new = cached(asked.where("from_last <= 2")).select("question", F.concat(F.lit("new: "), F.coalesce("answer", F.lit(""))).alias("answer"), F.lit("rag").alias("answer_quality"), F.lit(None).cast("array<string>").alias("matched_files"), none.alias("user_feedback"), F.lit("rag").alias("query_type"))
    return store.upsert_cache(old, new, now).select("question_hash", "question", "answer", "created_at", "updated_at", "answer_quality", "query_type", "usage_count")


@query
def cache_query_type(spark, d):
    c = cache_rows(spark, d).withColumn("matched_files", F.when(F.length("question") % 2 == 0, F.array(F.lit("a.pdf"))))
    kind = log_functions.legacy_query_type(F.col("answer_quality"), F.col("matched_files"))
    reasons = log_functions.attention(kind != "unanswered", F.when(F.col("usage_count") > 1, "negative"))
    return c.select("question_hash", kind.alias("query_type"), F.array_join(reasons, ",").alias("attention"))


@query
def cache_stats(spark, d):
    return analytics.cache_stats(cache_rows(spark, d))


@query
def cache_use_counts(spark, d):
    cache = cache_rows(spark, d).withColumn("last_used", F.lit(None).cast("string"))
    hits = turns(spark, d).where("turn > 0").select(text.question_hash(F.col("question")).alias("question_hash"))
    return store.count_uses(cache, hits, F.lit("2024-06-01")).select("question_hash", "usage_count", "last_used")


@query
def cache_delete_cascade(spark, d):
    logs = turns(spark, d).select((F.col("session_id") * 1000 + F.col("turn")).alias("message_id"), text.question_hash(F.col("question")).alias("question_hash"))
    kept, cache = store.delete_logs(logs, cache_rows(spark, d), logs.where("message_id % 5 = 0"))
    return kept.groupBy("question_hash").agg(F.count(F.lit(1)).alias("logs")).join(cache.select("question_hash", F.lit(True).alias("cached")), "question_hash", "full_outer").select("question_hash", F.coalesce("logs", F.lit(0)).alias("logs"), F.coalesce("cached", F.lit(False)).alias("cached"))


# URLs, links, pages


@query
def url_normalize(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.normalized(u).alias("normalized"), urls.host(u).alias("host"), urls.path(u).alias("path"), urls.is_valid(u).alias("valid"))


@query
def url_category(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.category(u, SEGMENTS).alias("category"), urls.is_content_link(u, SEGMENTS).alias("content_link"), urls.display_name(u).alias("name"))


@query
def url_slug(spark, d):
    return table(spark, d, "pages").select("page_id", urls.slug(F.col("url")).alias("slug"), urls.file_stem(F.col("url")).alias("stem"))


@query
def url_category_counts(spark, d):
    return table(spark, d, "pages").groupBy(urls.category(F.col("url"), SEGMENTS).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query
def link_discovery(spark, d):
    return links.discover(table(spark, d, "pages")).select("url", "category")


@query
def links_new_anti(spark, d):
    return links.pending(listed(spark, d).withColumn("place", F.col("url")), fetched_urls(spark, d)).select("url")


@query
def links_existing_semi(spark, d):
    return listed(spark, d).intersect(fetched_urls(spark, d))


@query
def links_consistency(spark, d):
    return links.consistency(fetched_urls(spark, d), listed(spark, d))


@query
def links_add_states(spark, d):
    asked = fetched_urls(spark, d).union(spark.createDataFrame([("nonsense",), ("ftp:/x",)], "url string"))
    return links.add(listed(spark, d), asked)


@query
def links_union(spark, d):
    return links.union(listed(spark, d), fetched_urls(spark, d))


@query
def scrape_status(spark, d):
    return analytics.scrape_status(listed(spark, d), fetched_urls(spark, d))


@query
def discovery_diff(spark, d):
    found = links.discover(table(spark, d, "pages"))
    return analytics.discovery_diff(found, listed(spark, d)).select("total", "new", "existing", F.array_join("preview", " ").alias("preview"))


@query
def content_status(spark, d):
    files = table(spark, d, "pages").groupBy(urls.normalized(F.col("url")).alias("url")).agg(F.max(F.octet_length("html")).cast("bigint").alias("size"))
    return analytics.content_status(files, fetched_urls(spark, d))


@query
def html_clean(spark, d):
    return table(spark, d, "pages").select("page_id", text.clean_html(F.col("html")).alias("text"))


# Chunks


@query
def chunk_sections(spark, d):
    docs = table(spark, d, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n## ")))
    return docs.select("doc_id", F.posexplode(chunking.h2_sections(F.col("text"))).alias("chunk_index", "chunk")).select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "chunk", text.section_title(F.col("chunk")).alias("title"))


@query
def chunk_sentences3(spark, d):
    return chunking.split_sentences(table(spark, d, "documents"), splitter=lambda c: F.filter(F.transform(F.split(c, r"\.\s+"), text.strip), lambda s: s != "")).select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "chunk")


@query
def chunk_fixed_overlap(spark, d):
    return chunking.split_fixed(table(spark, d, "documents")).withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


@query
def chunk_recursive(spark, d):
    return chunking.split_recursive(table(spark, d, "documents"))


@query
def chunk_merge_greedy(spark, d):
    sections = F.filter(F.transform(F.split("text", "\n"), text.strip), lambda s: F.length(s) > chunking.SHORTEST_SECTION)
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(chunking.merged_sections(sections)).alias("chunk_index", "chunk"))
    return rows.withColumn("chunk_index", F.col("chunk_index").cast("bigint")).withColumn("kept", chunking.acceptable(F.col("chunk")))


@query
def source_stats(spark, d):
    chunks = table(spark, d, "documents").select(F.col("lang").alias("content_type"), "source")
    return analytics.collection_stats(chunks)


@query
def chunks_by_file(spark, d):
    return analytics.by_file(table(spark, d, "documents").select(F.concat(F.lit("/data/"), F.col("source"), F.lit(".pdf")).alias("source")))


@query
def dedup_prefix100(spark, d):
    docs = table(spark, d, "documents").select(F.lit(0).alias("query_id"), "doc_id", F.col("text").alias("content"), F.lit(0).alias("priority"), F.col("doc_id").alias("rank"))
    keys = docs.withColumn("query_id", F.substring("content", 1, 100))  # dealt by prefix, so no window holds all rows
    return fusion.first_by_prefix(keys, 100).select("doc_id")


@query
def collection_changes(spark, d):
    chunks = table(spark, d, "documents").select("source", F.col("text").alias("page_content"), F.col("lang").alias("content_type"))
    base = spark.createDataFrame([("src0", "modified", "text new", "en"), ("src1", "deleted", None, None), ("new", "added", "text", "fr")], "source string, op string, page_content string, content_type string")
    return store.apply_changes(chunks, base).groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("page_content")).alias("chars"))


# Retrieval


@query
def bm25_terms(spark, d):
    return lexical.build(table(spark, d, "documents")).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_stats(spark, d):
    return lexical.stats(table(spark, d, "documents"))


def _bm25(spark, d, k=20):
    return lexical.search(lexical.build(table(spark, d, "documents")), questions(spark, d), k)


@query
def bm25_topk(spark, d):
    return _bm25(spark, d).select("query_id", "doc_id", F.round("bm25_score", 6).alias("bm25_score"), F.col("rank").cast("bigint").alias("rank"))


@query
def bm25_filtered(spark, d):
    docs = table(spark, d, "documents")
    found = lexical.search_filtered(lexical.build(docs), questions(spark, d), docs.select("doc_id", "lang"), F.col("lang") == "en", 10)
    return found.select("query_id", "doc_id", F.round("bm25_score", 6).alias("bm25_score"), F.col("rank").cast("bigint").alias("rank"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def _vector_queries(spark, d):
    """The job's query set: every vector whose id is divisible by 50."""
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query
def vector_topk(spark, d):
    return vectors.nearest(_vectors(spark, d), _vector_queries(spark, d), 20).select("query_id", "doc_id", F.round("similarity", 6).alias("similarity"), (F.round("distance", 6) + 0.0).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


@query
def vector_topk_filtered(spark, d):
    return vectors.nearest_where(_vectors(spark, d), _vector_queries(spark, d), {"label": 3}, 5).select("query_id", "doc_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


@query
def vector_matching(spark, d):
    return vectors.matching(_vectors(spark, d), {"label": 3}, 20).select("doc_id")


def _lists(spark, d, near=20, lexical_k=40):
    """A vector list (of embeddings, for documents of the same ids) of all vector queries, and a lexical list of all questions."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    rag = vectors.nearest(_vectors(spark, d), _vector_queries(spark, d), near).join(docs, "doc_id").select("query_id", "doc_id", "content", "rank")
    words = lexical.search(lexical.build(table(spark, d, "documents")), questions(spark, d), lexical_k).join(docs, "doc_id").select("query_id", "doc_id", "content", "rank", "bm25_score")
    return rag, words


@query
def hybrid_fusion(spark, d):
    out = fusion.fuse(*_lists(spark, d), FUSE)
    return out.select("query_id", "doc_id", "rag_score", F.round("bm25_score", 6).alias("bm25_score"), F.round("hybrid_score", 6).alias("hybrid_score"), "search_type", F.col("rank").cast("bigint").alias("rank"))


@query
def hybrid_type_counts(spark, d):
    return fusion.type_counts(fusion.fuse(*_lists(spark, d), FUSE))


@query
def hybrid_reciprocal_rank(spark, d):
    out = fusion.reciprocal_rank(*_lists(spark, d), most=20)
    return out.select("query_id", "doc_id", F.round("rrf_score", 6).alias("rrf_score"), F.col("rank").cast("bigint").alias("rank"))


@query
def rerank_lexical(spark, d):
    hits = _bm25(spark, d).join(table(spark, d, "documents").select("doc_id", F.col("text").alias("content")), "doc_id").join(questions(spark, d), "query_id")
    return rerank.rerank(hits, 12).select("query_id", "doc_id", F.round("rerank_score", 6).alias("rerank_score"), F.col("rerank").cast("bigint").alias("rerank"))


@query
def matched_files(spark, d):
    hits = _bm25(spark, d).join(table(spark, d, "documents").select("doc_id", F.concat(F.lit("/docs/"), F.col("source"), F.lit(".pdf")).alias("source")), "doc_id")
    return rerank.files(hits).select("query_id", F.array_join("matched_files", ",").alias("files"))


# Rules


@query
def safety_rules(spark, d):
    rule = text.safety(F.col("text"), ("worthless", "trash", "scum"), ("the ", " die "))
    return table(spark, d, "conversations").select("conv_id", "turn", rule.alias("rule"), text.is_safe(rule).alias("safe"))


@query
def hallucination_flags(spark, d):
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", text.doubtful(F.col("text"), (*text.DOUBTFUL_PHRASES, "ich n", "the th")).alias("doubtful"))


@query
def question_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(text.terms(F.col("text")), " ").alias("terms"), text.token_estimate(F.col("text")).alias("tokens"), text.question_hash(F.col("text")).alias("hash"))


# Evaluation


def _scores(spark, d):
    """labels and lengths as metric scores of documents."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.col("lang").alias("category"), "n_chars"), "doc_id")
    size = F.when(F.col("n_chars") < 1000, "easy").when(F.col("n_chars") < 3000, "medium").otherwise("hard")
    pairs = F.array(F.struct(F.lit("quality").alias("metric"), F.col("quality").cast("double").alias("score")), F.struct(F.lit("harmless").alias("metric"), (1 - F.col("toxic")).cast("double").alias("score")), F.struct(F.lit("length").alias("metric"), F.when(F.col("n_chars") > 0, F.least(F.col("n_chars") / 4000, F.lit(1.0))).alias("score")))
    return rows.select("doc_id", "category", size.alias("difficulty"), F.explode(pairs).alias("p")).select("doc_id", "category", "difficulty", "p.metric", "p.score")


@query
def eval_metric_means(spark, d):
    return evaluation.metric_means(_scores(spark, d))


@query
def eval_bands(spark, d):
    return evaluation.graded(evaluation.metric_means(_scores(spark, d))).select("metric", "band")


@query
def eval_overall(spark, d):
    out = evaluation.overall(evaluation.metric_means(_scores(spark, d)))
    return out.select(F.round("mean", 6).alias("mean"), "band", *(F.array_join(c, ",").alias(c) for c in ("strengths", "weaknesses", "improve")))


@query
def eval_by_category(spark, d):
    return evaluation.by_category(_scores(spark, d))


@query
def eval_compare(spark, d):
    s = _scores(spark, d)
    return evaluation.compared(evaluation.metric_means(s.where("category = 'en'")), evaluation.metric_means(s.where("category != 'en'")))


@query
def proxy_score(spark, d):
    hits = _bm25(spark, d).join(table(spark, d, "documents").select("doc_id", F.col("text").alias("content")), "doc_id").where("rank <= 7")
    truth = questions(spark, d).select("query_id", F.col("query").alias("ground_truth"), F.slice(F.split("query", " "), 1, 4).alias("keywords"))
    out = evaluation.proxy(hits, truth)
    return out.select("query_id", *(F.round(c, 6).alias(c) for c in ("recall", "keyword_hits", "richness", "proxy_score")))


@query
def tuner_grid(spark, d):
    return evaluation.grid(spark)


@query
def tuner_rank(spark, d):
    score = F.round(F.col("rag_weight") * 0.5 + F.col("vector_k") / 100 - F.col("min_hybrid_score") / 1000 + F.col("reranker_top_k") / 1000 + F.col("min_rag_score") / 10_000 + F.col("min_bm25_score") / 100_000 + F.col("max_hybrid_results") / 1_000_000, 9)
    return evaluation.ranked_configs(evaluation.grid(spark).withColumn("proxy_score", score)).limit(20).drop("config_key")


@query
def tuner_apply(spark, d):
    # retrieved once, as deep as the largest configuration reads
    rag, words = _lists(spark, d, max(evaluation.SPACE["vector_k"]), 2 * max(evaluation.SPACE["max_hybrid_results"]))
    configs = evaluation.sampled(evaluation.grid(spark))
    return evaluation.apply_configs(rag, words, configs).groupBy("config_key").agg(F.count(F.lit(1)).alias("hits"), F.round(F.avg("hybrid_score"), 6).alias("mean"))
