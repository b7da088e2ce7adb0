"""Reports over interaction logs, the cache and the collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.logs import own_date, turn_text
from ..functions.urls import category, last_step


def dashboard(logs: DataFrame) -> DataFrame:
    """Totals over answered, response_time_ms, tokens_used and user_feedback; the mean is over response times other than 0."""
    if "type" in logs.columns:
        logs = logs.where("type is null or type != 'stats_summary'")
    rt = F.col("response_time_ms")
    yes = F.coalesce("answered", F.lit(False))
    return logs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(yes).alias("answered"),
        F.count_if(~yes).alias("unanswered"),
        F.round(F.coalesce(F.avg(F.when(rt != 0, rt)), F.lit(0.0)), 2).alias("avg_response_time"),
        F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("total_tokens"),
        F.count_if(F.col("user_feedback") == "positive").alias("positive"),
        F.count_if(F.col("user_feedback") == "negative").alias("negative"),
    )


def snapshot(logs: DataFrame) -> DataFrame:
    """One stats_summary row; none if there are no logs."""
    return dashboard(logs).where("total > 0").select(F.lit("stats_summary").alias("type"), F.col("total").alias("total_queries"), "avg_response_time", "total_tokens")


def daily(logs: DataFrame, stamp: str = "timestamp") -> DataFrame:
    """Counts by date in the stamp's own offset; unreadable stamps are dropped."""
    return logs.select(own_date(F.col(stamp)).alias("day")).where("day is not null").groupBy("day").agg(F.count(F.lit(1)).alias("n")).orderBy("day")


def exported(logs: DataFrame, exclude_stats: bool = False) -> DataFrame:
    """Counts of the export; snapshots count as unanswered rows unless they are excluded."""
    if exclude_stats:
        logs = logs.where("type is null or type != 'stats_summary'")
    yes = F.coalesce("answered", F.lit(False))
    return logs.agg(F.count(F.lit(1)).alias("total"), F.count_if(yes).alias("answered"), F.count_if(~yes).alias("unanswered"))


def feedback_totals(logs: DataFrame) -> DataFrame:
    return logs.where("user_feedback is not null").groupBy("user_feedback").agg(F.count(F.lit(1)).alias("n"))


def last_turns(turns: DataFrame, n: int = 5) -> DataFrame:
    """The last n turns of each session in time order: turns (session_id, turn, question, answer)."""
    w = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    return turns.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def history(turns: DataFrame, n: int = 5) -> DataFrame:
    """session_id and the text of its last n turns."""
    rows = last_turns(turns, n).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("turn", "question", "answer"))).alias("t"))
    return rows.select("session_id", F.array_join(F.transform("t", lambda x: turn_text(x["question"], x["answer"])), "\n").alias("history"), F.size("t").alias("turns"))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of the page from 1 on; none for numbers or sizes under 1."""
    if number < 1 or size < 1:
        return rows.limit(0)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(rows: DataFrame, size: int) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), F.ceil(F.count(F.lit(1)) / max(size, 1)).alias("pages"))


def cache_stats(cache: DataFrame) -> DataFrame:
    """By quality and in all (quality null): entries, uses, mean uses."""
    known = cache.withColumn("quality", F.coalesce("answer_quality", F.lit("unknown")))
    return known.rollup("quality").agg(F.count(F.lit(1)).alias("entries"), F.sum("usage_count").alias("uses"), F.round(F.avg("usage_count"), 2).alias("mean_uses"))


def collection_stats(chunks: DataFrame) -> DataFrame:
    """By content type and in all: chunks and distinct sources that aren't empty."""
    return chunks.rollup("content_type").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct(F.when(F.col("source") != "", F.col("source"))).alias("sources"))


def by_file(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(last_step(F.col("source")).alias("file")).agg(F.count(F.lit(1)).alias("chunks"))


def source_summary(files: DataFrame, n: int = 10) -> DataFrame:
    """By kind of file: how many, the first n by name, and the latest change. files: kind, name, modified."""
    w = Window.partitionBy("kind").orderBy("name")
    first = files.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).groupBy("kind").agg(F.sort_array(F.collect_list("name")).alias("first"))  # n rows of each kind and task are shuffled
    return files.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.max("modified").alias("latest")).join(first, "kind").select("kind", "files", "first", "latest")


def scrape_status(listed: DataFrame, scraped: DataFrame) -> DataFrame:
    """By category and in all: listed URLs, scraped ones, pending ones, percent done."""
    done = scraped.select("url").distinct().withColumn("__d", F.lit(True))
    rows = listed.select("url").distinct().join(done, "url", "left").withColumn("category", category(F.col("url")))
    counted = rows.rollup("category").agg(F.count(F.lit(1)).alias("total"), F.count_if("__d").alias("scraped"))
    return counted.withColumn("pending", F.col("total") - F.col("scraped")).withColumn("percent", F.round(F.col("scraped") / F.col("total") * 100, 2))


def content_status(files: DataFrame, listed: DataFrame) -> DataFrame:
    """Files, their bytes, files without a listed URL and URLs without a file. files: url, size."""
    f, u = files.select("url").distinct(), listed.select("url").distinct()
    orphans = f.join(u, "url", "left_anti").agg(F.count(F.lit(1)).alias("orphaned"))
    missing = u.join(f, "url", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).crossJoin(orphans).crossJoin(missing)


def category_counts(urls: DataFrame) -> DataFrame:
    return urls.groupBy(category(F.col("url")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def discovery_diff(found: DataFrame, known: DataFrame) -> DataFrame:
    """Counts of found (url, category; a URL may stand in several), new and known URLs, and ten of the new ones."""
    new = found.select("url").distinct().join(known.select("url").distinct(), "url", "left_anti")
    old = found.select("url").distinct().join(known.select("url").distinct(), "url", "left_semi")
    preview = new.orderBy("url").limit(10).agg(F.sort_array(F.collect_list("url")).alias("preview"))
    return found.agg(F.count(F.lit(1)).alias("total")).crossJoin(new.agg(F.count(F.lit(1)).alias("new"))).crossJoin(old.agg(F.count(F.lit(1)).alias("existing"))).crossJoin(preview)


def attention_list(cache: DataFrame) -> DataFrame:
    from ..functions.logs import attention

    return cache.withColumn("attention", attention(F.col("query_type") != "unanswered", F.col("user_feedback"))).where(F.size("attention") > 0)
