"""Lists of URLs: discovery in pages, changes, and consistency with what has been fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls


def discover(pages: DataFrame, keep: Column | None = None) -> DataFrame:
    """url and category of the links in pages (url, html), whole and without query and fragment, each once."""
    rows = pages.select(F.col("url").alias("page"), F.explode(urls.links_in(F.col("html"))).alias("link"))
    found = rows.select(urls.normalized(urls.absolute(F.col("page"), F.col("link"))).alias("url")).where("url != ''").distinct()
    found = found.withColumn("category", urls.category(F.col("url")))
    return found.where(keep) if keep is not None else found


def add(known: DataFrame, asked: DataFrame) -> DataFrame:
    """url and state (added, existing, invalid) of the URLs asked for, each once."""
    one = asked.select("url").distinct()
    flagged = one.join(known.select("url").distinct().withColumn("__k", F.lit(True)), "url", "left")
    return flagged.select("url", F.when(~urls.is_valid(F.col("url")), "invalid").when(F.col("__k"), "existing").otherwise("added").alias("state"))


def union(known: DataFrame, more: DataFrame) -> DataFrame:
    return known.select("url").union(more.select("url")).distinct()


def remove(known: DataFrame, gone: DataFrame) -> DataFrame:
    return known.join(gone.select("url").distinct(), "url", "left_anti")


def pending(listed: DataFrame, scraped: DataFrame) -> DataFrame:
    """URLs that haven't been fetched, in the list's order (place)."""
    return listed.join(scraped.select("url").distinct(), "url", "left_anti").orderBy("place")


def orphans(scraped: DataFrame, listed: DataFrame) -> DataFrame:
    return scraped.join(listed.select("url").distinct(), "url", "left_anti")


def consistency(files: DataFrame, listed: DataFrame) -> DataFrame:
    """URLs on one side only: orphaned (a file, not listed) or missing (listed, no file)."""
    f, u = files.select("url").distinct().withColumn("f", F.lit(True)), listed.select("url").distinct().withColumn("u", F.lit(True))
    return f.join(u, "url", "full_outer").where("f is null or u is null").select("url", F.when(F.col("u").isNull(), "orphaned").otherwise("missing").alias("state"))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files whose hash isn't the stored one, and new ones: name, hash."""
    stored_ = before.select("name", F.col("hash").alias("old"))
    return now.join(stored_, "name", "left").where(F.col("old").isNull() | (F.col("old") != F.col("hash"))).select("name", "hash")


def metadata_update(metadata: DataFrame, new_urls: list[str]) -> DataFrame:
    """URLs at the end of the list in a metadata row (scraped_urls), each once, and their number."""
    more = F.array_distinct(F.concat(F.coalesce("scraped_urls", F.array().cast("array<string>")), F.array(*map(F.lit, new_urls)).cast("array<string>")))
    return metadata.withColumn("scraped_urls", more).withColumn("total_scraped", F.size("scraped_urls"))
