"""Reranking, grading and what is told about the sources of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import last_step
from ..plugins import PairScorer, lexical_scorer

# Characters that scorers see, and how many hits the grade looks at.
RERANK_CHARS, GRADE_CHARS, GRADE_TOP = 1500, 300, 5


def rerank(hits: DataFrame, k: int = 12, scorer: PairScorer = lexical_scorer, content: str = "content") -> DataFrame:
    """The first k hits of each query by score, ties in the order they came (rank): adds rerank_score and rerank. A single hit stays unscored.

    hits: query_id, query, rank and the content column.
    """
    each = Window.partitionBy("query_id")
    scored = hits.withColumn("__n", F.count(F.lit(1)).over(each)).withColumn("rerank_score", F.when(F.col("__n") > 1, scorer(F.col("query"), F.substring(content, 1, RERANK_CHARS))))
    order = each.orderBy(F.round("rerank_score", 9).desc(), "rank")
    return scored.withColumn("rerank", F.row_number().over(order)).where(F.col("rerank") <= max(k, 0)).drop("__n")


def grade(hits: DataFrame, grader: PairScorer | None = None, rank: str = "rerank", content: str = "content") -> DataFrame:
    """Adds relevant: one verdict for all hits of a query, from the first GRADE_TOP. Without a grader, or where it gives null, they are relevant."""
    if grader is None:
        return hits.withColumn("relevant", F.lit(True))
    top = hits.where(F.col(rank) <= GRADE_TOP).groupBy("query_id", "query").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), F.substring(content, 1, GRADE_CHARS).alias("c")))), lambda x: x["c"]), "\n").alias("context"))
    verdict = top.select("query_id", F.coalesce(~F.contains(F.upper(grader(F.col("query"), F.col("context")).cast("string")), F.lit("INCORRECT")), F.lit(True)).alias("relevant"))
    return hits.join(verdict, "query_id")


def only_relevant(graded: DataFrame) -> DataFrame:
    return graded.where("relevant").drop("relevant")


def files(hits: DataFrame, rank: str = "rank", source: str = "source") -> DataFrame:
    """query_id and the base names of its hits' sources in order, each once."""
    named = hits.where(F.coalesce(source, F.lit("")) != "").groupBy("query_id", last_step(F.col(source)).alias("name")).agg(F.min(rank).alias("r"))
    return named.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("matched_files"))


def context(hits: DataFrame, rank: str = "rank", content: str = "content", source: str = "source") -> DataFrame:
    """query_id and the hits' contents in order, with a block of sources; PDFs are linked below /docs/."""
    name = last_step(F.col(source))
    link: Column = F.when(F.lower(name).endswith(".pdf"), F.concat(F.lit("/docs/"), name)).otherwise(F.col(source))
    rows = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(content).alias("c"), link.alias("s")))).alias("h"))
    sources = F.array_distinct(F.filter(F.transform("h", lambda x: x["s"]), lambda s: s.isNotNull()))
    return rows.select("query_id", F.concat(F.array_join(F.transform("h", lambda x: x["c"]), "\n\n"), F.when(F.size(sources) > 0, F.concat(F.lit("\n\nSOURCE METADATA\n"), F.array_join(sources, "\n"))).otherwise("")).alias("context"))


def first_three(hits: DataFrame, rank: str = "rank", content: str = "content") -> DataFrame:
    rows = hits.where(F.col(rank) <= 3).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(content).alias("c")))).alias("h"))
    return rows.select("query_id", F.array_join(F.transform("h", lambda x: x["c"]), "\n---\n").alias("text"))
