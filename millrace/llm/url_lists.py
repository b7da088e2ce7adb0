"""URL filters: temporal list join.

List entries are dated: on a day a list adds or removes a key (a host, a domain, or a host with a path prefix). They
become validity intervals [valid_from, valid_to), and an as-of join judges each capture by the entries active on the day
it was fetched. Entries of one key and day collapse to the last (add wins), so a key has at most 366 changes a year;
a timeline row holds one key's changes of one year with the state carried in from the years before. Captures join
timelines on key and year, salted, and read their state from the array: no pairs of captures and entries are made.

Of several active entries the most specific decides (longest key, counted in labels and path steps), and of these an
allow entry before a block entry, then the list's name. Captures without an active entry are ``pass``.

Edge cases: a null or unparsable URL, or a null fetch day, is ``invalid``; null keys, lists, ops or days of entries are
ignored; an entry removed before it was ever added does nothing; repeated captures are judged one by one; empty lists
pass everything. Further columns of captures are dropped except those asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need

SALTS = 16


def host_of(url: Column) -> Column:
    """Lower-case host, without user, port and a leading www."""
    host = F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", F.regexp_replace(host, r"^www\.|\.$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(host: Column, path: Column) -> Column:
    """The host, all its parent domains of two labels and more, and host + every path prefix, each with its depth."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), n - 2)),
        lambda i: F.struct(F.array_join(F.slice(labels, i + 1, n), ".").alias("key"), (n - i).alias("depth")),
    )
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    m = F.size(steps)
    prefixes = F.when(
        m > 0,
        F.transform(F.sequence(F.lit(1), m), lambda i: F.struct(F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")).alias("key"), (n + i).alias("depth"))),
    ).otherwise(F.array().cast("array<struct<key:string,depth:int>>"))
    return F.concat(domains, prefixes)


def intervals(entries: DataFrame) -> DataFrame:
    """list, action, key, valid_from, valid_to (null: still valid) of dated entries list, action, key, op, day."""
    from pyspark.sql import Window

    need(entries, "list", "action", "key", "op", "day")
    w = Window.partitionBy("list", "action", "key").orderBy("day")
    daily = _daily(entries)
    changed = daily.withColumn("before", F.lag("on").over(w)).where("on != coalesce(before, false)")
    return changed.withColumn("valid_to", F.lead("day").over(w)).where("on").select("list", "action", "key", F.col("day").alias("valid_from"), "valid_to")


def _daily(entries: DataFrame) -> DataFrame:
    known = entries.where("list is not null and action in ('block', 'allow') and key is not null and op in ('add', 'remove') and day is not null")
    return known.groupBy("list", "action", "key", F.col("day").cast("date").alias("day")).agg(F.max(F.col("op") == "add").alias("on"))


def timelines(entries: DataFrame, years: DataFrame) -> DataFrame:
    """key, year, and the intervals of each list that touch the year, for the years asked for (a column year): at most 366 for one list and key."""
    touches = (F.col("year") >= F.year("valid_from")) & (F.col("valid_to").isNull() | (F.col("year") <= F.year(F.date_sub("valid_to", 1))))
    spread = intervals(entries).join(F.broadcast(years), touches)
    return spread.groupBy("list", "action", "key", "year").agg(F.sort_array(F.collect_list(F.struct("valid_from", "valid_to"))).alias("spans"))


def judge(captures: DataFrame, entries: DataFrame, *carry: str) -> DataFrame:
    """page_id, the columns to carry, host, verdict (pass, block, allow, invalid), list, key and valid_from of the entry that decided.

    captures: page_id, url, fetched (date).
    """
    need(captures, "page_id", "url", "fetched", *carry)
    base = captures.select(*dict.fromkeys(["page_id", *carry, "url", "fetched"])).withColumn("url", F.col("url").cast("string")).withColumn("fetched", F.col("fetched").cast("date"))
    base = base.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    valid = F.col("host").isNotNull() & F.col("fetched").isNotNull()
    # one row for each host, path and day first: what is the same is judged once
    asked = base.where(valid).select("host", "path", "fetched").distinct()
    keyed = asked.select("*", F.explode(keys_of(F.col("host"), F.col("path"))).alias("k")).select("host", "path", "fetched", "k.key", "k.depth", F.year("fetched").alias("year"))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("path", "fetched"), F.lit(SALTS)).cast("int"))
    lines = timelines(entries, base.where("fetched is not null").select(F.year("fetched").alias("year")).distinct()).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = keyed.join(lines, ["key", "year", "salt"])
    active = F.filter("spans", lambda s: (s["valid_from"] <= F.col("fetched")) & (s["valid_to"].isNull() | (F.col("fetched") < s["valid_to"])))
    hits = hits.withColumn("active", active).where(F.size("active") > 0).withColumn("span", F.col("active")[0])
    order = F.struct((-F.col("depth")).alias("a"), F.when(F.col("action") == "allow", 0).otherwise(1).alias("b"), F.col("list").alias("c"), F.col("key").alias("d"))
    decided = hits.groupBy("host", "path", "fetched").agg(F.min_by(F.struct("action", "list", "key", "span.valid_from"), order).alias("by"))
    return (
        base.join(decided, ["host", "path", "fetched"], "left")
        .select(
            "page_id",
            *carry,
            "host",
            F.when(~valid, "invalid").when(F.col("by").isNull(), "pass").otherwise(F.col("by.action")).alias("verdict"),
            F.col("by.list").alias("list"),
            F.col("by.key").alias("key"),
            F.col("by.valid_from").alias("valid_from"),
        )
    )
