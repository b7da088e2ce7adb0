"""The operators' queries by name, with production parameters over whole tables, and DuckDB's SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, language_id, licenses, line_dedup, near_dedup, quality, repeats, url_lists, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: pages has no fetch times and no lists; both are stated here, by rule. Captures: one day of 2024 by page_id.
FETCHED = "date '2024-01-01' + cast(page_id * 7 % 366 as int)"
#: Lists by rule: step, span and changes. A key's first day is its length * step % span days after FIRST_DAY; each change comes so many days later.
LISTS = {
    "spam": (11, 120, (("add", 0), ("remove", 40), ("add", 200))),
    "partners": (17, 300, (("add", 0), ("remove", 30))),
    "networks": (13, 200, (("add", 0), ("remove", 50))),
    "sections": (19, 250, (("add", 0), ("remove", 45))),
}
FIRST_DAY = "2023-12-15"


def entries_of(pages: DataFrame) -> DataFrame:
    """list, action, key, op, day of entries for all distinct hosts of pages: hosts blocked (spam) and allowed (partners), their parent domains blocked (networks), and hosts with a first path step (sections) allowed if the key's length is even, else blocked."""
    seen = pages.select(url_lists.host_of(F.col("url")).alias("host"), F.get(F.filter(F.split(url_lists.path_of(F.col("url")), "/"), lambda x: x != ""), F.lit(0)).alias("step")).where("host is not null").distinct()
    entry = lambda name, action, key: F.struct(F.lit(name).alias("list"), action.alias("action"), key.alias("key"))
    block, allow, section = F.lit("block"), F.lit("allow"), F.concat_ws("/", "host", "step")
    parents = F.filter(url_lists.keys_of(F.col("host"), F.lit("")), lambda k: k["key"] != F.col("host"))
    found = F.concat(
        F.array(entry("spam", block, F.col("host")), entry("partners", allow, F.col("host"))),
        F.transform(parents, lambda k: entry("networks", block, k["key"])),
        F.when(F.col("step").isNotNull(), F.array(entry("sections", F.when(F.length(section) % 2 == 0, allow).otherwise(block), section))).otherwise(F.array()),
    )
    keys = seen.select(F.explode(found).alias("e")).select("e.*").distinct()
    changes = None
    for name, (step, span, ops) in LISTS.items():
        days = F.array(*(F.struct(F.lit(op).alias("op"), (F.length("key") * step % span + after).alias("after")) for op, after in ops))
        changes = F.when(F.col("list") == name, days) if changes is None else changes.when(F.col("list") == name, days)
    return keys.select("list", "action", "key", F.explode(changes).alias("c")).select("list", "action", "key", "c.op", F.date_add(F.lit(FIRST_DAY).cast("date"), F.col("c.after")).cast("string").alias("day"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.expr(f"cast({FETCHED} as date)").alias("fetched"))
    return url_lists.judge(captures, entries_of(pages), "fetched")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(table(spark, sf_dir, "documents"), content=False)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.length("text").cast("bigint").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_copies")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}


#: The rule of entries_of, as a table: list, step, span, op, days after the key's first.
_CHANGES = ", ".join(f"('{name}', {step}, {span}, '{op}', {after})" for name, (step, span, ops) in LISTS.items() for op, after in ops)

SQL = {
    "op1_url_filters": f"""
WITH u AS (SELECT nullif(regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.|\\.$', '', 'g'), '') AS host,
                  list_filter(string_split(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '')[1] AS step FROM pages),
n AS (SELECT DISTINCT host, unnest(range(2, len(string_split(host, '.')))) AS k FROM u WHERE host IS NOT NULL),
k(list, action, key) AS (
  SELECT 'spam', 'block', host FROM u WHERE host IS NOT NULL UNION SELECT 'partners', 'allow', host FROM u WHERE host IS NOT NULL
  UNION SELECT 'networks', 'block', array_to_string(string_split(host, '.')[-k:], '.') FROM n
  UNION SELECT 'sections', CASE WHEN length(host || '/' || step) % 2 = 0 THEN 'allow' ELSE 'block' END, host || '/' || step FROM u WHERE host IS NOT NULL AND step IS NOT NULL),
t(list, f, s, op, o) AS (VALUES {_CHANGES}),
e AS (SELECT list, action, key, op, DATE '{FIRST_DAY}' + CAST(length(key) * f % s + o AS INT) AS day FROM k JOIN t USING (list)),
d AS (SELECT list, action, key, CAST(day AS DATE) AS day, max(op = 'add') AS is_on FROM e GROUP BY ALL),
c AS (SELECT *, lag(is_on) OVER (PARTITION BY list, action, key ORDER BY day) AS before FROM d),
i AS (SELECT list, action, key, day AS valid_from, lead(day) OVER (PARTITION BY list, action, key ORDER BY day) AS valid_to, is_on
      FROM c WHERE is_on <> coalesce(before, false)),
p AS (SELECT page_id, DATE '2024-01-01' + CAST(page_id * 7 % 366 AS INT) AS fetched,
             nullif(regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.|\\.$', '', 'g'), '') AS host,
             regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
s AS (SELECT p.*, list_filter(string_split(path, '/'), lambda x: x <> '') AS steps FROM p),
h AS (SELECT s.page_id, i.*, len(string_split(string_split(i.key, '/')[1], '.')) + len(string_split(i.key, '/')) - 1 AS depth
      FROM s JOIN i ON i.is_on AND s.fetched >= i.valid_from AND (i.valid_to IS NULL OR s.fetched < i.valid_to)
       AND (s.host = i.key OR ends_with(s.host, '.' || i.key)
            OR starts_with(s.host || '/' || array_to_string(s.steps, '/') || '/', i.key || '/') AND contains(i.key, '/'))),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY depth DESC, action, list, key) AS n FROM h)
SELECT s.page_id, s.fetched, s.host,
       CASE WHEN s.host IS NULL THEN 'invalid' WHEN r.page_id IS NULL THEN 'pass' ELSE r.action END AS verdict, r.list, r.key, r.valid_from
FROM s LEFT JOIN r ON r.page_id = s.page_id AND r.n = 1""",
    "op4_line_dedup": """
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
t AS (SELECT doc_id, source, line, p, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM l),
b AS (SELECT k, min(row(doc_id, p)) AS f FROM t WHERE k <> '' GROUP BY k HAVING count(DISTINCT coalesce('=' || source, 'null')) >= 10),
j AS (SELECT t.*, (b.k IS NOT NULL AND row(t.doc_id, t.p) <> b.f) AS gone FROM t LEFT JOIN b ON t.k = b.k),
a AS (SELECT doc_id, count(*) FILTER (WHERE k <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '') AS text FROM j GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, length(text) AS kept_chars, sha256(text) AS kept_sha256 FROM a""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages),
d AS (SELECT page_id, strlen(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to FROM r""",
}
