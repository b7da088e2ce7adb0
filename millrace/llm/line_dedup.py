"""Line dedup by spread over sites, with DataFrame functions only.

Lines are known by 128 bits of hash. A first pass keeps the lines whose sites aren't all one (smallest and largest site hash
differ); the second reads only these. Each gets a HyperLogLog sketch of the sites (sources) it stands on; sketches of
tasks merge in the aggregation. A line whose estimate is surely at or over ``sites`` is boilerplate, one surely under it
stays, and one near the threshold gets an exact distinct count. Boilerplate lines go from every document but the first that
has them (smallest doc_id, then earliest line), so no wording is lost altogether.

A line is what stands between \\n, trimmed of ASCII white space; blank lines are never judged. Edge cases: a null text has no
lines and stays null; a null source is a site of its own; rows that repeat (doc_id and text) are treated as one and get
the same result; a document left without lines keeps an empty text; very long texts and lines are taken whole. Further
columns are kept, and those that clash with n_lines or n_removed too; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import bit_table, filtered, maybe_in, need

SITES = 10
#: Sketch size as a power of two: a relative standard error of about 1.04 / sqrt(2 ** LG). Five of them mark "near".
LG, ERRORS = 10, 5
SALTS = 16


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def line_rows(docs: DataFrame) -> DataFrame:
    """d (doc_id), t (hash of the text), s (site), p (place) and h, h2 (128 bits of hash) of every line that isn't blank."""
    lines = docs.where("text is not null").select(
        F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("s"), F.posexplode(F.split("text", "\n")).alias("p", "line")
    )
    line = trimmed(F.col("line"))
    return lines.withColumn("line", line).where("line != ''").select("d", "t", "s", "p", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("h2"))


def shared(lines: DataFrame) -> DataFrame:
    """The line rows of lines on two sites at least: one row for each line from each task is all that the first pass shuffles."""
    site = F.xxhash64("s")
    several = lines.groupBy("h", "h2").agg(F.min(site).alias("low"), F.max(site).alias("high")).where("low != high").select("h", "h2")
    several = stored(several, "lines-several")
    salted = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = filtered(lines, "h", several.select("h")).withColumn("salt", F.pmod(F.xxhash64("d", "t", "p"), F.lit(SALTS)).cast("int"))
    return stored(found.join(salted, ["h", "h2", "salt"]), "lines-shared")


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """h, h2, spread and the first place (first: d, t, p) of the lines (rows as shared() gives them) on at least so many sites."""
    error = ERRORS * 1.04 / 2 ** (LG / 2)
    # each line's sketch on each task takes in all its sites there; sketches of the same line then merge
    estimated = lines.groupBy("h", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("s", F.lit(LG))).alias("spread"), F.min(F.struct("d", "t", "p")).alias("first"))
    estimated = stored(estimated.where(F.col("spread") >= sites * (1 - error)), "lines-estimated")
    sure = estimated.where(F.col("spread") > sites * (1 + error)).select("h", "h2", "first", "spread")
    near = estimated.where(F.col("spread") <= sites * (1 + error)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    by_site = lines.select("h", "h2", "salt", "s").join(near.select("h", "h2", "salt", "first"), ["h", "h2", "salt"]).groupBy("h", "h2", "first", "s").agg(F.count(F.lit(1)).alias("n"))
    exact = by_site.groupBy("h", "h2", "first").agg(F.count(F.lit(1)).alias("spread")).where(F.col("spread") >= sites)
    return sure.unionByName(exact.select("h", "h2", "first", "spread"))


def removals(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """d, t and the sorted places of the lines to remove (gone)."""
    lines = shared(line_rows(docs))
    bad = boilerplate(lines, sites)
    salted = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = lines.join(salted, ["h", "h2", "salt"])
    found = found.where(~(F.col("first.d").eqNullSafe(F.col("d")) & (F.col("first.t") == F.col("t")) & (F.col("first.p") == F.col("p"))))
    return found.groupBy("d", "t").agg(F.sort_array(F.collect_set("p")).alias("gone"))


def dedup(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """docs with boilerplate lines gone from text, and n_lines and n_removed besides (names that clash get a trailing _)."""
    need(docs, "doc_id", "text", "source")
    gone = stored(removals(docs, sites), "lines-gone")
    # documents that surely lose nothing aren't shuffled
    known = maybe_in(docs.withColumn("__t", F.xxhash64("text")), "__t", bit_table(gone.select("t")))
    x = known.where("__maybe").alias("x")
    losing = x.join(gone.alias("g"), F.col("x.doc_id").eqNullSafe(F.col("g.d")) & (F.col("x.__t") == F.col("g.t")), "left").select("x.*", F.col("g.gone").alias("__gone"))
    rows = losing.unionByName(known.where("not __maybe").withColumn("__gone", F.lit(None).cast("array<int>")))
    lines = F.split("text", "\n")
    kept = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(F.col("__gone"), i)), "\n"))
    free = lambda n: n if n not in docs.columns else free(n + "_")
    return rows.select(
        *(kept.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns),
        F.coalesce(F.size(F.filter(lines, lambda l: trimmed(l) != "")), F.lit(0)).cast("bigint").alias(free("n_lines")),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint").alias(free("n_removed")),
    )
