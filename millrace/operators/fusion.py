"""Weighted fusion of a vector list and a lexical list, and what is added to it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY_LENGTH, SECOND_KEY_LENGTH = 100, 150


@dataclass(frozen=True)
class Weights:
    """Defaults: those of the live pipeline."""

    rag: float = 0.7
    bm25: float = 0.3
    min_hybrid: float = 50.0
    min_rag: float = 25.0
    min_bm25: float = 1.0
    most: int = 50
    normalize: bool = False
    key_length: int = KEY_LENGTH


CLASS_DEFAULT = Weights(0.6, 0.4, 50.0, 30.0, 5.0, 5)
TUNER_BASELINE = Weights(0.6, 0.4, 70.0, 25.0, 3.0, 30, True)


def fuse(rag: DataFrame, bm25: DataFrame, w: Weights = Weights()) -> DataFrame:
    """query_id, key, doc_id, content, rag_score, bm25_score, hybrid_score, search_type, rank.

    rag: query_id, doc_id, content, rank (the distance doesn't matter: every hit has 100). bm25: the same with bm25_score.
    Hits with the same first characters are one: the first vector hit gives the row, the last of the lexical list gives
    the score. A row is hybrid if its key occurs in both lists, or twice in the lexical one. It stays if any threshold is met.
    """
    key = F.substring("content", 1, w.key_length)
    keyed = lambda d: d.where(F.coalesce("content", F.lit("")) != "").withColumn("key", key)
    score = F.least(F.col("bm25_score") * 10, F.lit(100.0)) if w.normalize else F.col("bm25_score")
    left = keyed(rag).groupBy("query_id", "key").agg(F.min_by(F.struct("doc_id", "content", "rank"), "rank").alias("r"))
    right = keyed(bm25).withColumn("s", score).groupBy("query_id", "key").agg(F.min_by(F.struct("doc_id", "content", "rank"), "rank").alias("b"), F.max_by("s", "rank").alias("s"), F.count(F.lit(1)).alias("times"))
    both = left.join(right, ["query_id", "key"], "full_outer")
    rows = both.select(
        "query_id",
        "key",
        F.coalesce("r.doc_id", "b.doc_id").alias("doc_id"),
        F.coalesce("r.content", "b.content").alias("content"),
        F.when(F.col("r").isNotNull(), 100.0).otherwise(0.0).alias("rag_score"),
        F.coalesce("s", F.lit(0.0)).alias("bm25_score"),
        F.when(F.col("s").isNull(), "rag").when(F.col("r").isNotNull() | (F.col("times") > 1), "hybrid").otherwise("bm25").alias("search_type"),
        F.when(F.col("r").isNotNull(), F.struct(F.lit(0).alias("a"), F.col("r.rank").alias("b"))).otherwise(F.struct(F.lit(1).alias("a"), F.col("b.rank").alias("b"))).alias("place"),
    ).withColumn("hybrid_score", F.col("rag_score") * w.rag + F.col("bm25_score") * w.bm25)
    kept = rows.where((F.col("hybrid_score") >= w.min_hybrid) | (F.col("rag_score") >= w.min_rag) | (F.col("bm25_score") >= w.min_bm25))
    order = Window.partitionBy("query_id").orderBy(F.round("hybrid_score", 9).desc(), "place")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(w.most, 0)).drop("place")


def reciprocal_rank(rag: DataFrame, bm25: DataFrame, most: int = 50, k: int = 60) -> DataFrame:
    """Another fusion, on request only: the sum of 1 / (k + rank) by document."""
    both = rag.select("query_id", "doc_id", "rank").unionByName(bm25.select("query_id", "doc_id", "rank"))
    summed = both.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf_score"))
    order = Window.partitionBy("query_id").orderBy(F.round("rrf_score", 12).desc(), "doc_id")
    return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def type_counts(fused: DataFrame) -> DataFrame:
    return fused.groupBy("query_id").agg(*(F.count_if(F.col("search_type") == t).alias(f"n_{t}") for t in ("rag", "bm25", "hybrid")))


def first_by_prefix(hits: DataFrame, length: int = SECOND_KEY_LENGTH) -> DataFrame:
    """Of hits (query_id, content, priority, rank) with the same first characters the first."""
    order = Window.partitionBy("query_id", F.substring("content", 1, length)).orderBy("priority", "rank")
    return hits.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def dual(original: DataFrame, hypothetical: DataFrame, length: int = SECOND_KEY_LENGTH) -> DataFrame:
    """Hits of the question, then those of its hypothetical answer; the first of a prefix stays."""
    return first_by_prefix(original.withColumn("priority", F.lit(0)).unionByName(hypothetical.withColumn("priority", F.lit(1))), length)


def with_extras(fused: DataFrame, extras: DataFrame, length: int = KEY_LENGTH) -> DataFrame:
    """fused and behind it the extras whose prefix it doesn't have; these carry no scores."""
    new = extras.withColumn("key", F.substring("content", 1, length)).join(fused.select("query_id", "key").distinct(), ["query_id", "key"], "left_anti")
    last = fused.groupBy("query_id").agg(F.max("rank").alias("__last"))
    placed = new.join(last, "query_id", "left").withColumn("rank", F.coalesce("__last", F.lit(0)) + F.col("rank")).drop("__last")
    return fused.unionByName(placed.select(*[c for c in placed.columns if c in fused.columns]), allowMissingColumns=True)
