"""Batches of questions through the whole pipeline, and the knowledge base behind it.

Stages add columns: cache hit, safety, rewrite, hypothesis, retrieval, fusion, rerank, grade, answer, doubt, fallback.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import logs
from ..functions.text import doubtful, index_tokens, is_safe, question_hash, safety
from ..operators import answers, chunking, fusion, lexical, rerank, vectors
from ..plugins import Models, filled
from ..session import stored

VECTOR_K, LEXICAL_K, RERANK_K = 50, 100, 12
#: So many chunks among the hits are broadcast when their texts are read; more are joined by shuffle.
BROADCAST_HITS = 200_000
NAVIGATION, REDIRECT = "NAVIGATION_QUERY", "REDIRECT:"


def build(docs: DataFrame, models: Models) -> DataFrame:
    """Chunks of docs (doc_id, text, source, content_type, code, title) with vectors: chunk_id, doc_id, source, content, tokens (of the lexical index), embedding."""
    chunks = chunking.route(docs).withColumn("chunk_id", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))
    chunks = chunks.select("chunk_id", "doc_id", "source", F.col("page_content").alias("content"), index_tokens(F.coalesce("page_content", F.lit(""))).alias("tokens"))
    of_tokens = getattr(models.embed, "of_tokens", None)
    return chunks.withColumn("embedding", of_tokens(F.col("tokens")) if of_tokens else models.embed(F.col("content")))


def route(rule, rewritten):
    """blocked, fallback, redirect or retrieve."""
    return F.when(~is_safe(rule), "blocked").when(F.trim(rewritten) == NAVIGATION, "fallback").when(rewritten.startswith(REDIRECT), "redirect").otherwise("retrieve")


def retrieve(questions: DataFrame, chunks: DataFrame, index: lexical.Index, models: Models, weights: fusion.Weights = fusion.Weights()) -> DataFrame:
    """Fused hits of questions (query_id, query, hyde): query_id, doc_id (the chunk), content, scores, rank."""
    space = chunks.select(F.col("chunk_id").alias("doc_id"), "embedding")
    near = lambda text: vectors.nearest(space, questions.where(text.isNotNull()).select("query_id", models.embed(text).alias("embedding")), VECTOR_K).select("query_id", "doc_id", "rank")
    lists = [near(F.col("query")), lexical.search(index, questions, LEXICAL_K)]
    if models.hypothesis is not None:
        lists.append(near(F.col("hyde")))
    lists = [stored(x, "hits") for x in lists]
    # the texts of all lists in one pass over the chunks
    wanted = reduce(DataFrame.union, (x.select("doc_id") for x in lists)).distinct()
    few = wanted.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS
    content = chunks.select(F.col("chunk_id").alias("doc_id"), "content", "source").join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")
    content = stored(content, "hit-texts")
    rag, words, *extra = (x.join(content.select("doc_id", "content"), "doc_id") for x in lists)
    fused = fusion.fuse(rag, words, weights)
    if extra:
        fused = fusion.with_extras(fused, extra[0].select("query_id", "doc_id", "content", "rank"))
    return fused.join(content.select("doc_id", "source"), "doc_id", "left")


def answer(questions: DataFrame, chunks: DataFrame, cache: DataFrame, models: Models | None = None, history: DataFrame | None = None) -> DataFrame:
    """query_id, query, answer, status, query_type, cache_hit, matched_files for questions (query_id, query)."""
    models = models or Models()
    # what several later stages read is written once
    hits = stored(answers.lookup(questions, cache).join(cache.select("cache_id", "answer"), "cache_id").select("query_id", "answer"), "answers-cached")
    rest = questions.join(hits.select("query_id"), "query_id", "left_anti")
    if history is not None:
        rest = rest.join(history.select("query_id", "history"), "query_id", "left")
    else:
        rest = rest.withColumn("history", F.lit(None).cast("string"))
    rule = safety(F.col("query"), model=models.safety(F.col("query")) if models.safety else None)
    rewritten = models.rewrite(filled("rewrite", history=F.col("history"), question=F.col("query"))) if models.rewrite else F.col("query")
    staged = rest.withColumn("rule", rule).withColumn("rewritten", rewritten).withColumn("route", route(F.col("rule"), F.col("rewritten")))
    # what goes to the text model is judged once more, as it was rewritten
    again = safety(F.col("rewritten"), model=models.safety(F.col("rewritten")) if models.safety else None)
    staged = staged.withColumn("route", F.when((F.col("route") == "retrieve") & ~is_safe(again), "blocked").otherwise(F.col("route")))
    staged = stored(staged, "answers-staged")
    asked = staged.where("route = 'retrieve'").select("query_id", F.col("rewritten").alias("query"))
    asked = asked.withColumn("hyde", models.hypothesis(filled("hypothesis", question=F.col("query"))) if models.hypothesis else F.lit(None).cast("string"))
    asked = stored(asked, "answers-asked")
    index = lexical.build(chunks.select(F.col("chunk_id").alias("doc_id"), *(["tokens"] if "tokens" in chunks.columns else [F.col("content").alias("text")])))
    found = retrieve(asked, chunks, index, models).join(asked.select("query_id", "query"), "query_id")
    top = rerank.grade(stored(rerank.rerank(found, RERANK_K, models.score), "answers-top"), models.grade)
    good = rerank.only_relevant(top)
    context = rerank.context(good, "rerank").join(rerank.files(good, "rerank"), "query_id", "left")
    made = staged.join(context, "query_id", "left")
    text = models.answer(filled("answer", context=F.col("context"), question=F.col("rewritten"))) if models.answer else F.substring_index("context", "\n\n", 1)
    first = F.when(F.col("route") == "redirect", F.trim(F.expr(f"substring(rewritten, {len(REDIRECT) + 1})"))).when((F.col("route") == "retrieve") & F.col("context").isNotNull(), text)
    made = made.withColumn("first", first)
    fallback = (F.col("route") == "fallback") | ((F.col("route") == "retrieve") & doubtful(F.col("first")))
    general = models.answer(filled("fallback", question=F.col("query"))) if models.answer else F.lit(None).cast("string")
    made = made.withColumn("fallback", fallback).withColumn("answer", F.when(F.col("route") == "blocked", "This question can't be answered here.").when(fallback, general).otherwise(F.col("first")))
    is_answered, blocked = F.col("answer").isNotNull() & (F.col("route") != "blocked"), F.col("route") == "blocked"
    new = made.select(
        "query_id", "query", "answer", logs.status(is_answered, blocked).alias("status"), logs.query_type(is_answered, blocked, F.when(fallback, "fallback").otherwise("rag")).alias("query_type"), F.lit(False).alias("cache_hit"), F.coalesce("matched_files", F.array().cast("array<string>")).alias("matched_files")
    )
    old = questions.join(hits, "query_id").select("query_id", "query", "answer", F.lit("answered").alias("status"), F.lit("rag").alias("query_type"), F.lit(True).alias("cache_hit"), F.array().cast("array<string>").alias("matched_files"))
    return new.unionByName(old).withColumn("question_hash", question_hash(F.col("query"))).withColumn("answer", logs.shown_text(F.col("status"), F.col("answer")))


def timed(made: DataFrame) -> DataFrame:
    """The answers, made now and kept in the shared folder, with response_time_ms: the batch's time by question."""
    began = time.monotonic()
    kept = stored(made, "answers")
    n = kept.count()
    return kept.withColumn("response_time_ms", F.lit(int((time.monotonic() - began) * 1000 / max(n, 1))).cast("bigint"))


def process(questions: DataFrame, chunks: DataFrame, cache: DataFrame, models: Models | None = None, history: DataFrame | None = None) -> DataFrame:
    """answer() and its times."""
    return timed(answer(questions, chunks, cache, models, history))


def retrieved(questions: DataFrame, chunks: DataFrame, models: Models | None = None, k: int = VECTOR_K) -> DataFrame:
    """query_id, context, matched_files and error of vector retrieval alone: every question has a row, and where nothing was found error says so."""
    models = models or Models()
    space = chunks.select(F.col("chunk_id").alias("doc_id"), "embedding")
    asked = questions.where("coalesce(query, '') != ''").select("query_id", models.embed(F.col("query")).alias("embedding"))
    hits = vectors.nearest(space, asked, k).join(chunks.select(F.col("chunk_id").alias("doc_id"), "content", "source"), "doc_id")
    found = rerank.context(hits).join(rerank.files(hits), "query_id", "left")
    error = F.when(F.coalesce("query", F.lit("")) == "", "empty question").when(F.col("context").isNull(), "nothing found")
    return questions.join(found, "query_id", "left").select("query_id", "context", F.coalesce("matched_files", F.array().cast("array<string>")).alias("matched_files"), error.alias("error"))


#: Passages that the plain chain puts into one prompt.
CHAIN_K = 20


def chain(questions: DataFrame, chunks: DataFrame, models: Models | None = None, k: int = CHAIN_K) -> DataFrame:
    """query_id and answer by the plain chain: the nearest passages in one prompt, without cache, rules, fusion or rerank."""
    models = models or Models()
    found = questions.join(retrieved(questions, chunks, models, k), "query_id")
    prompt = filled("answer", context=F.col("context"), question=F.col("query"))
    text = models.answer(prompt) if models.answer else F.substring_index("context", "\n\n", 1)
    return found.select("query_id", F.when(F.col("error").isNull(), text).alias("answer"))


#: Older names of the entry points.
process_with_rag, process_with_rag_only = process, retrieved
