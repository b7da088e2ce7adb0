"""The life of a chunk collection: made, opened, rebuilt if its sources changed, rebuilt by force, and cleared of removed URLs.

A collection is a folder of Parquet; the registry of its sources (kind, name) lies beside it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import links, store

#: Rows that are embedded at once.
BATCH = 500


class Missing(ValueError):
    """There is no such collection, or it holds nothing."""


def exists(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.parquet(store.settled(spark, path)).isEmpty()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False


def opened(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a collection that has some."""
    if not exists(spark, path):
        raise Missing(f"no collection at {path}")
    return spark.read.parquet(path)


def scanned(spark: SparkSession, path: str, *others: Callable[[], DataFrame]) -> DataFrame:
    """All rows of the collection, else of the first of the others that has rows."""
    if exists(spark, path):
        return spark.read.parquet(path)
    for other in others:
        found = other()
        if not found.isEmpty():
            return found
    raise Missing(f"no collection at {path}, and nothing in its place")


def create(chunks: DataFrame, path: str, batch: int = BATCH) -> DataFrame:
    """Writes a collection instead of what the path holds; embeddings by Python plug-ins come in batches. Without chunks the old one stays and it raises."""
    spark = chunks.sparkSession
    if chunks.isEmpty():
        raise Missing("no chunks to write")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        store.replace(chunks, path)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    return opened(spark, path)


def sources_of(docs: DataFrame) -> DataFrame:
    """kind and name of the documents' sources."""
    return docs.select(F.when(F.col("content_type") == "pdf", "pdf").otherwise("scraped").alias("kind"), F.col("source").alias("name")).where("name is not null").distinct()


def needs_rebuild(spark: SparkSession, docs: DataFrame, path: str) -> bool:
    """Whether there is no collection, or its registered sources aren't those of docs (by name; contents aren't looked at)."""
    if not exists(spark, path):
        return True
    try:
        known = spark.read.parquet(registry(path))
    except AnalysisException:
        return True
    now = sources_of(docs)
    return any(store.changed_names(known.where(F.col("kind") == k).select("name"), now.where(F.col("kind") == k).select("name")) for k in ("pdf", "scraped"))


def registry(path: str) -> str:
    return path.rstrip("/") + ".sources"


def rebuild(docs: DataFrame, path: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The collection anew from docs (content_type, source and what build() needs), and its registry."""
    made = create(build(docs), path)
    store.replace(sources_of(docs).orderBy("kind", "name"), registry(path))
    return made


def refreshed(docs: DataFrame, path: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The collection, rebuilt only if it has to be."""
    spark = docs.sparkSession
    return rebuild(docs, path, build) if needs_rebuild(spark, docs, path) else opened(spark, path)


@dataclass
class Removal:
    """Tables after URLs were removed, a state by URL (removed, missing), and the update requests that follow."""

    listed: DataFrame
    files: DataFrame
    metadata: DataFrame
    chunks: DataFrame
    states: DataFrame
    requests: DataFrame


def _known(listed: DataFrame, asked: DataFrame) -> DataFrame:
    return asked.select("url").distinct().join(listed.select("url").distinct().withColumn("__k", F.lit(True)), "url", "left").select("url", F.coalesce("__k", F.lit(False)).alias("known"))


def remove_urls(listed: DataFrame, files: DataFrame, metadata: DataFrame, chunks: DataFrame, asked: DataFrame) -> Removal:
    """URLs go from the list (url), the files (url, ..), the metadata row (scraped_urls, total_scraped) and the chunks (source, ..)."""
    known = _known(listed, asked)
    gone = known.where("known").select("url")
    states = known.select("url", F.when(F.col("known"), "removed").otherwise("missing").alias("state"))
    requests = gone.select(F.lit("scraped_content_removed").alias("reason"), F.col("url").alias("source"))
    kept = metadata.withColumn("__u", F.explode_outer("scraped_urls")).join(gone.select(F.col("url").alias("__u")), "__u", "left_anti").agg(F.collect_list("__u").alias("scraped_urls"))
    rest = metadata.drop("scraped_urls", "total_scraped").crossJoin(F.broadcast(kept))  # metadata is one row
    rest = rest.withColumn("total_scraped", F.size("scraped_urls").cast("bigint")).select(*metadata.columns)
    return Removal(links.remove(listed, gone), files.join(gone, "url", "left_anti"), rest, chunks.join(gone.select(F.col("url").alias("source")), "source", "left_anti").select(*chunks.columns), states, requests)


def refresh_urls(listed: DataFrame, files: DataFrame, fetch: Callable[[DataFrame], DataFrame], asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The files (url, html) with the URLs asked for (all without) fetched again, every outcome, and the update requests that follow. A page that can't be fetched keeps its old file."""
    todo = listed.select("url").distinct() if asked is None else listed.select("url").distinct().join(asked.select("url").distinct(), "url", "left_semi")
    got = fetch(todo)
    new = got.where("html is not null").select("url", "html")
    requests = new.select(F.lit("scraped_content_updated").alias("reason"), F.col("url").alias("source"), F.col("html").alias("page_content"))
    return files.select("url", "html").join(new.select("url"), "url", "left_anti").unionByName(new), got, requests


def monitor(listed: DataFrame, found: DataFrame, files: DataFrame, before: DataFrame) -> DataFrame:
    """One round of watching: url and action of new links (scrape), changed files (update) and files that nobody lists (remove).

    listed and found: url; files: url, hash; before: url, hash as of the last round.
    """
    new = found.select("url").distinct().join(listed.select("url"), "url", "left_anti").select("url", F.lit("scrape").alias("action"))
    name = lambda d: d.select(F.col("url").alias("name"), "hash")
    orphans = links.orphans(files.select("url"), listed).select("url", F.lit("remove").alias("action"))
    changed = links.changed(name(files), name(before)).select(F.col("name").alias("url")).join(orphans.select("url"), "url", "left_anti").select("url", F.lit("update").alias("action"))
    return new.unionByName(changed).unionByName(orphans)
