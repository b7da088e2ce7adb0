"""Evaluation of retrieval and tuning of its parameters, over all queries and configurations at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.logs import METRIC_BANDS, OVERALL_BANDS, band, percent_change
from ..functions.text import code, terms
from ..session import stored

METRICS = ("faithfulness", "answer_relevancy", "context_recall", "context_precision")
# The tuner's search space, baseline, weights and sizes.
SPACE = {
    "vector_k": [20, 30, 40, 50],
    "max_hybrid_results": [30, 40, 50],
    "min_hybrid_score": [30.0, 50.0, 70.0],
    "min_rag_score": [15.0, 20.0, 25.0],
    "min_bm25_score": [1.0, 3.0],
    "rag_weight": [0.5, 0.6, 0.7],
    "reranker_top_k": [7, 10, 12],
}
BASELINE = {"vector_k": 20, "max_hybrid_results": 30, "min_hybrid_score": 70.0, "min_rag_score": 25.0, "min_bm25_score": 3.0, "rag_weight": 0.6, "reranker_top_k": 7}
PROXY_WEIGHTS = {"recall": 0.5, "keywords": 0.3, "richness": 0.2}
RICH_CHARS, TRIALS, FOCUSED, TOP, SEED = 500, 50, 64, 5, 42
LIMIT_CHANGE = 0.05


def metric_means(scores: DataFrame) -> DataFrame:
    """metric, mean (4 places), n of the numbers in scores (query_id, metric, score); NaN and null don't count."""
    good = F.when(~F.isnan("score"), F.col("score"))
    return scores.groupBy("metric").agg(F.round(F.avg(good), 4).alias("mean"), F.count(good).alias("n"))


def batch_summary(items: DataFrame) -> DataFrame:
    """items: success (boolean), seconds."""
    ok = F.coalesce("success", F.lit(False))
    return items.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.round(F.coalesce(F.avg(ok.cast("int")), F.lit(0.0)), 4).alias("rate"), F.round(F.avg("seconds"), 4).alias("mean_seconds"))


def graded(means: DataFrame) -> DataFrame:
    return means.withColumn("band", band(F.col("mean"), METRIC_BANDS))


def overall(means: DataFrame) -> DataFrame:
    """The mean of means with its band, strengths (excellent, good), weaknesses (poor) and metrics to improve (under 0.7)."""
    g = graded(means)
    pick = lambda condition: F.sort_array(F.collect_list(F.when(condition, F.col("metric"))))
    out = g.agg(F.avg("mean").alias("mean"), pick(F.col("band").isin("excellent", "good")).alias("strengths"), pick(F.col("band") == "poor").alias("weaknesses"), pick(F.col("mean") < 0.7).alias("improve"))
    return out.withColumn("band", F.when(F.col("mean").isNull(), "unknown").otherwise(band(F.col("mean"), OVERALL_BANDS, "needs_improvement")))


def by_category(scores: DataFrame) -> DataFrame:
    """Means by category and metric, by difficulty and metric, and by metric, in one pass."""
    return scores.groupingSets([["category", "metric"], ["difficulty", "metric"], ["metric"]], "category", "difficulty", "metric").agg(F.round(F.avg("score"), 6).alias("mean"), F.count("score").alias("n"))


def compared(before: DataFrame, now: DataFrame) -> DataFrame:
    """By metric: both means, their difference, the percent change and whether it improved, stayed or regressed (by LIMIT_CHANGE)."""
    j = before.select("metric", F.col("mean").alias("before")).join(now.select("metric", F.col("mean").alias("now")), "metric")
    delta = F.round(F.col("now") - F.col("before"), 4)
    return j.withColumn("delta", delta).withColumn("percent", percent_change(F.col("before"), F.col("now"))).withColumn("verdict", F.when(F.col("delta") > LIMIT_CHANGE, "improved").when(F.col("delta") < -LIMIT_CHANGE, "regressed").otherwise("stable"))


def best_configuration(means: DataFrame) -> DataFrame:
    """The configuration of the largest mean over its metrics: means (config_id, metric, mean)."""
    return means.groupBy("config_id").agg(F.avg("mean").alias("mean")).agg(F.max_by("config_id", F.struct(F.round("mean", 9).alias("a"), (-F.col("config_id")).alias("b"))).alias("config_id"), F.max("mean").alias("mean"))


def test_queries(truth: DataFrame, broad: list[str], n: int | None = None, code_pattern: str = r"[A-Z]{4}\d{4}") -> DataFrame:
    """query_id, query, ground_truth, category, difficulty, query_type: every truth row, a variant for those that ask what a code is, and broad questions; n of them by hash order."""
    found = code(F.col("question"), code_pattern)
    variant = F.when(F.contains(F.col("question"), F.lit("What is")) & (found != ""), F.concat(F.lit("Tell me about "), found))
    kinds = F.filter(F.array(F.struct(F.lit("direct").alias("t"), F.col("question").alias("q")), F.struct(F.lit("rephrased").alias("t"), variant.alias("q"))), lambda x: x["q"].isNotNull())
    rows = truth.select("ground_truth", "category", "difficulty", F.explode(kinds).alias("x")).select(F.col("x.q").alias("query"), "ground_truth", "category", "difficulty", F.col("x.t").alias("query_type"))
    if broad:
        wide = truth.sparkSession.createDataFrame([(q,) for q in broad], "query string").select("query", F.lit("").alias("ground_truth"), F.lit("general").alias("category"), F.lit("medium").alias("difficulty"), F.lit("broad").alias("query_type"))
        rows = rows.unionByName(wide)
    order = Window.orderBy(F.xxhash64("query", F.lit(SEED)), "query")  # a set of test questions, not of data
    numbered = rows.withColumn("n", F.row_number().over(order))
    if n is not None:
        numbered = numbered.where(F.col("n") <= n)
    return numbered.select(F.format_string("query_%03d", F.col("n")).alias("query_id"), "query", "ground_truth", "category", "difficulty", "query_type")


def term_recall(text: Column, wanted: Column) -> Column:
    return F.when(F.size(wanted) > 0, F.size(F.filter(wanted, lambda w: F.contains(text, w))) / F.size(wanted)).otherwise(0.0)


def proxy(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id, recall, keyword_hits, richness, proxy_score. hits: query_id, content (lists are short: a retrieval's top k); truth: query_id, ground_truth, keywords (array)."""
    joined = hits.groupBy("query_id").agg(F.lower(F.array_join(F.sort_array(F.collect_list("content")), " ")).alias("all"), F.avg(F.when(F.length("content") >= RICH_CHARS, 1.0).otherwise(0.0)).alias("richness"))
    rows = truth.join(joined, "query_id", "left").withColumn("all", F.coalesce("all", F.lit("")))
    low = F.transform(F.coalesce("keywords", F.array().cast("array<string>")), F.lower)
    recall, keywords, rich = term_recall(F.col("all"), terms(F.col("ground_truth"))), term_recall(F.col("all"), low), F.coalesce("richness", F.lit(0.0))
    total = PROXY_WEIGHTS["recall"] * F.col("recall") + PROXY_WEIGHTS["keywords"] * F.col("keyword_hits") + PROXY_WEIGHTS["richness"] * F.col("rich")
    return rows.select("query_id", "all", recall.alias("recall"), keywords.alias("keyword_hits"), rich.alias("rich")).select("query_id", "recall", "keyword_hits", F.col("rich").alias("richness"), F.when(F.col("all") == "", 0.0).otherwise(total).alias("proxy_score"))


def lexical_metrics(items: DataFrame) -> DataFrame:
    """Stand-ins for a judge: the shares of answer terms in the contexts, question terms in the answer, truth terms in the contexts, and of contexts with a truth term.

    items: query_id, question, answer, ground_truth, contexts (array). A long table query_id, metric, score.
    """
    body = F.lower(F.array_join("contexts", " "))
    useful = F.filter("contexts", lambda c: F.exists(terms(F.col("ground_truth")), lambda w: F.contains(F.lower(c), w)))
    values = {
        "faithfulness": term_recall(body, terms(F.col("answer"))),
        "answer_relevancy": term_recall(F.lower("answer"), terms(F.col("question"))),
        "context_recall": term_recall(body, terms(F.col("ground_truth"))),
        "context_precision": F.when(F.size("contexts") > 0, F.size(useful) / F.size("contexts")).otherwise(0.0),
    }
    return items.select("query_id", F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.cast("double").alias("score")) for k, v in values.items()))).alias("m")).select("query_id", "m.*")


def grid(spark: SparkSession, space: dict = SPACE) -> DataFrame:
    """Every combination: the parameter space is the bound."""
    out = spark.range(1, numPartitions=1).select()
    for name, values in space.items():
        out = out.select("*", F.explode(F.array(*(F.lit(v).cast("int" if isinstance(v, int) else "double") for v in values))).alias(name))
    return out


def with_key(configs: DataFrame) -> DataFrame:
    return configs.withColumn("config_key", F.to_json(F.struct(*sorted(SPACE))))


def sampled(configs: DataFrame, n: int = TRIALS, seed: int = SEED) -> DataFrame:
    """n configurations in hash order: the same ones for a seed, not those of another generator."""
    keyed = with_key(configs)
    return keyed.orderBy(F.xxhash64("config_key", F.lit(seed)), "config_key").limit(n)


def ranked_configs(results: DataFrame) -> DataFrame:
    """Of results (config columns, proxy_score) the best of each configuration, in order."""
    keyed = with_key(results)
    best = Window.partitionBy("config_key").orderBy(F.desc("proxy_score"))
    return keyed.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n").orderBy(F.desc("proxy_score"), "config_key")


def focused(results: DataFrame, n: int = FOCUSED, top: int = TOP, space: dict = SPACE) -> DataFrame:
    """The grid around the most frequent values of the top configurations: each with its neighbours in the space."""
    spark = results.sparkSession
    best = ranked_configs(results).limit(top)
    counts = [best.groupBy(c).agg(F.count(F.lit(1)).alias("k")).agg(F.max_by(c, F.struct("k", (-F.col(c)).alias("v"))).alias(c)) for c in space]
    modes = reduce(lambda a, b: a.crossJoin(b), counts).first()
    near = {c: [v for i, v in enumerate(values) if abs(i - values.index(modes[c])) <= 1] for c, values in space.items()} if modes and all(modes[c] in v for c, v in space.items()) else space
    return sampled(grid(spark, near), n)


def apply_configs(rag: DataFrame, bm25: DataFrame, configs: DataFrame, key_length: int = 100) -> DataFrame:
    """What every configuration keeps, of lists that were retrieved once at the largest k: config_key, query_id, doc_id, content, hybrid_score, rank.

    All parameters only cut or weigh ranked lists, so each is a column; scores are normalised as in tuning.
    """
    c = F.broadcast(with_key(configs))
    key = F.substring("content", 1, key_length)
    r = rag.withColumn("key", key).crossJoin(c.select("config_key", "vector_k")).where(F.col("rank") <= F.col("vector_k"))
    b = bm25.withColumn("key", key).withColumn("s", F.least(F.col("bm25_score") * 10, F.lit(100.0))).crossJoin(c.select("config_key", "max_hybrid_results")).where(F.col("rank") <= 2 * F.col("max_hybrid_results"))
    left = r.groupBy("config_key", "query_id", "key").agg(F.min_by(F.struct("doc_id", "content", "rank"), "rank").alias("r"))
    right = b.groupBy("config_key", "query_id", "key").agg(F.min_by(F.struct("doc_id", "content", "rank"), "rank").alias("b"), F.max_by("s", "rank").alias("s"))
    both = left.join(right, ["config_key", "query_id", "key"], "full_outer").join(c, "config_key")
    rag_score, bm = F.when(F.col("r").isNotNull(), 100.0).otherwise(0.0), F.coalesce("s", F.lit(0.0))
    scored = both.withColumn("hybrid_score", rag_score * F.col("rag_weight") + bm * (1 - F.col("rag_weight")))
    kept = scored.where((F.col("hybrid_score") >= F.col("min_hybrid_score")) | (rag_score >= F.col("min_rag_score")) | (bm >= F.col("min_bm25_score")))
    order = Window.partitionBy("config_key", "query_id").orderBy(F.round("hybrid_score", 9).desc(), F.coalesce("r.rank", F.col("b.rank") + 1_000_000))
    top = kept.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= F.col("max_hybrid_results")) & (F.col("rank") <= F.col("reranker_top_k")))
    return top.select("config_key", "query_id", F.coalesce("r.doc_id", "b.doc_id").alias("doc_id"), F.coalesce("r.content", "b.content").alias("content"), "hybrid_score", "rank")


def truth_rows(items: DataFrame) -> DataFrame:
    """Ground truth of items (question, ground_truth, category, difficulty, keywords): query_id in the order of the texts, and nulls filled."""
    numbered = items.groupBy("question").agg(F.min(F.struct("ground_truth", "category", "difficulty", "keywords")).alias("t"))
    return numbered.select(F.concat(F.lit("q_"), F.substring(F.sha2("question", 256), 1, 12)).alias("query_id"), "question", F.coalesce("t.ground_truth", F.lit("")).alias("ground_truth"), F.coalesce("t.category", F.lit("general")).alias("category"), F.coalesce("t.difficulty", F.lit("medium")).alias("difficulty"), F.coalesce("t.keywords", F.array().cast("array<string>")).alias("keywords"))


TRUTH = "query_id string, question string, ground_truth string, category string, difficulty string, keywords array<string>"


def save_rows(df: DataFrame, folder: str, name: str) -> str:
    """Results, truth or benchmark rows as JSON lines below a folder; the names of one kind sort by time."""
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("overwrite").json(path)
    return path


def load_rows(spark: SparkSession, path: str, schema: str = TRUTH) -> DataFrame:
    return spark.read.schema(schema).json(path)


def chosen(truth: DataFrame, category: str | None = None, difficulty: str | None = None, n: int | None = None) -> DataFrame:
    """Truth rows of a category and a difficulty (all without), the first n by id."""
    if category is not None:
        truth = truth.where(F.col("category") == category)
    if difficulty is not None:
        truth = truth.where(F.col("difficulty") == difficulty)
    return truth if n is None else truth.orderBy("query_id").limit(n)


def comprehensive(truth: DataFrame, answered: DataFrame, hits: DataFrame, most: int = 10) -> DataFrame:
    """query_id, category, difficulty, metric, score of all truth rows: answered (query_id, answer), hits (query_id, rank, content), of which the first so many are contexts."""
    contexts = hits.where(F.col("rank") <= most).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("contexts"))
    items = truth.join(answered.select("query_id", "answer"), "query_id", "left").join(contexts, "query_id", "left")
    items = items.withColumn("answer", F.coalesce("answer", F.lit(""))).withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
    return lexical_metrics(items).join(truth.select("query_id", "category", "difficulty"), "query_id").select("query_id", "category", "difficulty", "metric", "score")


def ab_test(scores_a: DataFrame, scores_b: DataFrame) -> DataFrame:
    """compared() of the means of two runs over the same questions, and by metric the questions that each run does better on."""
    both = scores_a.select("query_id", "metric", F.col("score").alias("a")).join(scores_b.select("query_id", "metric", F.col("score").alias("b")), ["query_id", "metric"])
    wins = both.groupBy("metric").agg(F.count_if(F.col("a") > F.col("b")).alias("a_wins"), F.count_if(F.col("b") > F.col("a")).alias("b_wins"))
    return compared(metric_means(scores_a), metric_means(scores_b)).join(wins, "metric")


def config_scores(rag: DataFrame, bm25: DataFrame, truth: DataFrame, configs: DataFrame) -> DataFrame:
    """The mean proxy score of every configuration over all questions, those without a hit included: config columns, config_key, proxy_score, n."""
    keyed = with_key(configs.select(*SPACE))
    kept = apply_configs(rag, bm25, keyed)
    pair = F.to_json(F.struct("config_key", "query_id"))
    asked = truth.crossJoin(F.broadcast(keyed.select("config_key")))  # as many rows as there are scores
    scored = proxy(kept.select(pair.alias("query_id"), "content"), asked.select(pair.alias("query_id"), "ground_truth", "keywords"))
    means = scored.groupBy(F.get_json_object("query_id", "$.config_key").alias("config_key")).agg(F.round(F.avg("proxy_score"), 9).alias("proxy_score"), F.count(F.lit(1)).alias("n"))
    return keyed.join(F.broadcast(means), "config_key")


@dataclass
class Tuning:
    """results: every configuration tried, with its mean proxy score; best: the top ones, in order; baseline: the score of the configuration in use."""

    results: DataFrame
    best: DataFrame
    baseline: float


def tuned(rag: DataFrame, bm25: DataFrame, truth: DataFrame, trials: int = TRIALS, near: int = FOCUSED, seed: int = SEED, top: int = TOP) -> Tuning:
    """Random search over the space, then a grid around the best: all over lists that were retrieved once, as deep as the largest configuration reads.

    rag: query_id, doc_id, content, rank; bm25: the same with bm25_score; truth: query_id, ground_truth, keywords.
    """
    spark = truth.sparkSession
    first = stored(config_scores(rag, bm25, truth, sampled(grid(spark), trials, seed)), "tuner-random")
    second = stored(config_scores(rag, bm25, truth, focused(first, near, top)), "tuner-focused")
    results = first.unionByName(second).dropDuplicates(["config_key"])  # a configuration's score is the same in both
    base = spark.createDataFrame([tuple(BASELINE.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'double'}" for k, v in BASELINE.items()))
    return Tuning(results, ranked_configs(results).limit(top), config_scores(rag, bm25, truth, base).first().proxy_score)


def validated(rag: DataFrame, bm25: DataFrame, truth: DataFrame, configs: DataFrame) -> DataFrame:
    """All judge metrics of few configurations: config_key, metric, mean, n. truth: query_id, question, ground_truth; the first hit stands for an answer."""
    kept = apply_configs(rag, bm25, configs.select(*SPACE))
    lists = kept.groupBy("config_key", "query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("contexts"))
    asked = truth.crossJoin(F.broadcast(with_key(configs.select(*SPACE)).select("config_key")))
    items = asked.join(lists, ["config_key", "query_id"], "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>"))).withColumn("answer", F.coalesce(F.get("contexts", F.lit(0)), F.lit("")))
    pair = F.to_json(F.struct("config_key", "query_id"))
    scores = lexical_metrics(items.withColumn("query_id", pair))
    return scores.groupBy(F.get_json_object("query_id", "$.config_key").alias("config_key"), "metric").agg(F.round(F.avg("score"), 6).alias("mean"), F.count("score").alias("n"))


def report(means: DataFrame) -> DataFrame:
    """One text: a line for each metric."""
    lines = graded(means).select(F.format_string("%s: %.4f (%s, %d items)", "metric", "mean", "band", "n").alias("l"))
    return lines.agg(F.array_join(F.sort_array(F.collect_list("l")), "\n").alias("report"))
