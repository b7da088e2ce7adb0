"""Named queries over stored state, sources, chunks and streams, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonflat, logs, text, urls
from ..operators import analytics, chunking, collection, evaluation, links, store
from ..session import scratch
from ..sources import files
from ..streaming import updates
from .oracle import HASH, NORMAL, TURNS, cache
from .queries import cache_rows, fetched_urls, listed, log_rows, table, turns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "2024-06-01T00:00:00"


def query(sql: str | None = None) -> Callable:
    def named(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return named


# Answers, logs and the cache

MESSAGES = f"{TURNS}, logs AS (SELECT session_id * 1000 + turn AS message_id, question, answer, {HASH.format('question')} AS question_hash FROM turns), {cache()}"


def messages(spark: SparkSession, d: str) -> DataFrame:
    """The log of all questions: message_id, question, answer, question_hash and what feedback and staff leave in it."""
    none = F.lit(None).cast("string")
    rows = turns(spark, d).select((F.col("session_id") * 1000 + F.col("turn")).alias("message_id"), "question", "answer", text.question_hash(F.col("question")).alias("question_hash"))
    return rows.select("*", F.col("answer").isNotNull().alias("answered"), F.lit(False).alias("admin_answered"), *(none.alias(c) for c in ("user_feedback", "feedback_time", "admin_response_time", "status", "query_type")), F.array().cast("array<string>").alias("matched_files"))


def full_cache(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    old = F.lit("2024-01-01T00:00:00")
    return cache_rows(spark, d).select("question_hash", "question", "answer", old.alias("created_at"), old.alias("updated_at"), "answer_quality", none.alias("last_used"), F.col("cache_id").cast("string").alias("cache_id"), none.alias("user_feedback"), none.alias("query_type"), "usage_count", F.array().cast("array<string>").alias("matched_files"))


@query(f"""WITH {MESSAGES}, g AS (SELECT message_id, question_hash, CASE WHEN message_id % 7 = 0 THEN 'negative' ELSE 'positive' END AS f FROM logs WHERE message_id % 7 < 2),
    l AS (SELECT question_hash, count(*) FILTER (WHERE message_id % 7 < 2) AS in_log FROM logs GROUP BY 1), c AS (SELECT question_hash, max(f) AS f FROM g GROUP BY 1)
    SELECT question_hash, coalesce(in_log, 0) AS in_log, c.f AS in_cache, CASE WHEN c.f IS NOT NULL THEN '{NOW}' ELSE '2024-01-01T00:00:00' END AS updated_at FROM cache LEFT JOIN l USING (question_hash) LEFT JOIN c USING (question_hash)""")
def feedback_cascade(spark, d):
    log = messages(spark, d)
    given = log.where("message_id % 7 < 2").select("message_id", F.when(F.col("message_id") % 7 == 0, "negative").otherwise("positive").alias("user_feedback"))
    changed, held = store.feedback(log, full_cache(spark, d), given, F.lit(NOW))
    by_hash = changed.groupBy("question_hash").agg(F.count("user_feedback").alias("in_log"))
    return held.join(by_hash, "question_hash", "left").select("question_hash", F.coalesce("in_log", F.lit(0)).alias("in_log"), F.col("user_feedback").alias("in_cache"), "updated_at")


@query(f"""WITH {MESSAGES}, g AS (SELECT question_hash, max('staff: ' || question) AS a, count(*) AS n FROM logs WHERE message_id % 11 = 0 GROUP BY 1)
    SELECT question_hash, coalesce(n, 0) AS in_log, coalesce(a, answer) AS answer, CASE WHEN a IS NOT NULL THEN 'admin_answered' ELSE answer_quality END AS answer_quality, usage_count FROM cache LEFT JOIN g USING (question_hash)""")
def admin_answer_cascade(spark, d):
    log = messages(spark, d)
    given = log.where("message_id % 11 = 0").select("message_id", F.concat(F.lit("staff: "), F.col("question")).alias("answer"))
    changed, held = store.admin_answers(log, full_cache(spark, d), given, F.lit(NOW))
    by_hash = changed.groupBy("question_hash").agg(F.count_if("admin_answered").alias("in_log"))
    return held.join(by_hash, "question_hash", "left").select("question_hash", F.coalesce("in_log", F.lit(0)).alias("in_log"), "answer", "answer_quality", "usage_count")


@query(f"""WITH {MESSAGES}, k AS (SELECT min(question_hash) AS h FROM cache) SELECT question_hash, CASE WHEN question_hash = h THEN 'set' ELSE answer END AS answer, CASE WHEN question_hash = h THEN 'admin_answered' ELSE answer_quality END AS answer_quality FROM cache, k""")
def cache_set_answer(spark, d):
    held = full_cache(spark, d)
    key = held.agg(F.min("question_hash")).first()[0]
    return store.set_answer(held, key, "set", F.lit(NOW)).select("question_hash", "answer", "answer_quality")


@query(f"""WITH {MESSAGES}, k AS (SELECT min(question_hash) AS h FROM cache) SELECT (SELECT count(*) FROM cache, k WHERE question_hash <> h) AS kept, true AS went, false AS went_again, 0 AS emptied""")
def cache_delete_entry(spark, d):
    held = full_cache(spark, d)
    key = held.agg(F.min("question_hash")).first()[0]
    kept, went = store.delete_entry(held, key)
    again = store.delete_entry(kept, key)[1]
    return kept.agg(F.count(F.lit(1)).alias("kept")).select("kept", F.lit(went).alias("went"), F.lit(again).alias("went_again"), F.lit(store.emptied(held).count()).alias("emptied"))


@query(f"""WITH {MESSAGES}, s AS (SELECT question_hash, max(CASE WHEN message_id % 3 = 0 THEN 'positive' END) AS f FROM logs GROUP BY 1) SELECT message_id, f AS user_feedback FROM logs LEFT JOIN s USING (question_hash)""")
def log_sync(spark, d):
    log = messages(spark, d)
    changes = log.groupBy("question_hash").agg(F.max(F.when(F.col("message_id") % 3 == 0, "positive")).alias("user_feedback"))
    return store.sync(log, changes, "question_hash", ["user_feedback"]).select("message_id", "user_feedback")


STAMPED = f"""{TURNS}, logs AS (SELECT session_id * 1000 + turn AS message_id, question, TIMESTAMP '2024-01-01' + to_minutes(session_id * 37 + turn) AS ts FROM turns),
    asked AS (SELECT message_id AS request_id, CASE message_id % 4 WHEN 0 THEN question WHEN 1 THEN substr(question, 3, 40) ELSE 'zzz ' || question END AS question, CASE WHEN message_id % 4 = 2 THEN ts + to_seconds(CAST(message_id % 5000 AS INT)) END AS hint FROM logs WHERE message_id % 50 < 4)"""


@query(f"""WITH {STAMPED}, c AS (
      SELECT request_id, 0 AS p, 0.0 AS o, ts AS t, message_id FROM asked JOIN logs USING (question)
      UNION ALL SELECT request_id, 1, 0.0, ts, message_id FROM asked a JOIN logs l ON contains(l.question, a.question) AND a.question <> ''
      UNION ALL SELECT request_id, 2, abs(epoch_us(ts) / 1e6 - epoch_us(hint) / 1e6), TIMESTAMP '2000-01-01', message_id FROM asked, logs WHERE hint IS NOT NULL
      UNION ALL SELECT request_id, 3, 0.0, ts, message_id FROM asked, (SELECT * FROM logs ORDER BY ts DESC, message_id LIMIT 1))
    SELECT request_id, message_id FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY p, round(o, 6), t, message_id) AS n FROM c) WHERE n = 1""")
def find_messages(spark, d):
    t = turns(spark, d).select((F.col("session_id") * 1000 + F.col("turn")).alias("message_id"), "question", F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(session_id * 37 + turn as int), 0)").alias("ts"))
    log = t.select("message_id", "question", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.lit(None).cast("string").alias("type"))
    kind = F.col("message_id") % 4
    asked = t.where("message_id % 50 < 4").select(F.col("message_id").alias("request_id"), F.when(kind == 0, F.col("question")).when(kind == 1, F.substring("question", 3, 40)).otherwise(F.concat(F.lit("zzz "), F.col("question"))).alias("question"), F.when(kind == 2, F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, cast(message_id % 5000 as int))")).alias("hint"))
    return store.find_message(asked, log)


@query(f"""WITH {TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS k FROM turns WHERE answer IS NOT NULL AND NOT contains(question, chr(10)) AND NOT contains(answer, chr(10))),
    x AS (SELECT session_id, question, CASE WHEN length(answer) > 200 THEN substr(answer, 1, 200) || '...' ELSE answer END AS a, turn, row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS i FROM r WHERE k <= 5) SELECT session_id, i AS place, question AS user, a AS assistant FROM x""")
def history_parse(spark, d):
    flat = turns(spark, d).where("answer is not null and not contains(question, '\\n') and not contains(answer, '\\n')")
    told = analytics.history(flat)
    return told.select("session_id", F.posexplode(logs.parsed_turns(F.col("history"))).alias("place", "x")).select("session_id", F.col("place").cast("bigint").alias("place"), "x.user", "x.assistant")


@query("""SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value > 10) AS done, round(count(*) FILTER (WHERE value > 10) / count(*) * 100, 2) AS percent, sum(event_id)::BIGINT // nullif(count(*) FILTER (WHERE value > 10), 0) AS mean_length,
    round(100.0 / count(*) FILTER (WHERE value > 10) * (count(*) - count(*) FILTER (WHERE value > 10)), 6) AS seconds_left FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE value > 10) > 0""")
def progress_figures(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("value") > 10).alias("done"), F.sum("event_id").alias("c")).where("done > 0")
    done, total = F.col("done"), F.col("total")
    return e.select("event_type", "total", "done", logs.success_rate(done, total).alias("percent"), logs.average_length(F.col("c"), done).alias("mean_length"), F.round(logs.seconds_left(F.lit(100.0), done, total), 6).alias("seconds_left"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS succeeded, count(*) FILTER (WHERE event_type = 'error') AS failed, round(avg(CASE WHEN event_type <> 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS rate, round(avg(value), 4) AS mean_seconds FROM events")
def batch_summary(spark, d):
    return evaluation.batch_summary(log_rows(spark, d).select((F.col("query_type") != "error").alias("success"), F.col("response_time_ms").alias("seconds")))


# Text rules

TITLE = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


@query(f"""SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) NOT IN ('', 'null', 'none', 'n/a', 'undefined') AS meaningful,
    regexp_matches(lower(source), 'key|cl_id|state|linking_id|order|active|hbeorder') AS technical, {TITLE.format("'field ' || lang || ' ' || source")} AS label, regexp_extract('see ABCD' || (1000 + doc_id % 9000) || ' ' || lang, '[A-Z]{{4}}\\d{{4}}') AS code,
    CASE WHEN contains(lang, 'e') THEN 'Lang ' ELSE 'Other ' END || source AS title FROM documents""")
def text_labels(spark, d):
    docs = table(spark, d, "documents")
    name = F.concat(F.lit("field_"), F.col("lang"), F.lit("_"), F.col("source"))
    kind = F.when(F.contains("lang", F.lit("e")), "lang").otherwise("other")
    return docs.select("doc_id", text.is_meaningful(F.col("text")).alias("meaningful"), text.ignored_key(F.col("source")).alias("technical"), text.field_label(name).alias("label"), text.code(F.concat(F.lit("see ABCD"), (F.lit(1000) + F.col("doc_id") % 9000).cast("string"), F.lit(" "), F.col("lang"))).alias("code"), urls.link_title(F.concat(F.lit("https://h/"), F.col("source"), F.lit("/")), kind).alias("title"))


# Sources

LINES = f"listed AS (SELECT DISTINCT {NORMAL.format('url')} AS url FROM pages WHERE {NORMAL.format('url')} <> '')"


@query("SELECT doc_id % 3 AS kind, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents WHERE text IS NOT NULL AND doc_id % 3 > 0 GROUP BY 1")
def scan_scraped(spark, d):
    folder = scratch(spark, "scraped")
    docs = table(spark, d, "documents").where("text is not null")
    meta = F.map_filter(F.create_map(F.lit("content_type"), F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 3).cast("string")), F.lit("source"), F.col("source")), lambda _, v: v.isNotNull())
    docs.select(F.col("text").alias("page_content"), meta.alias("metadata"), F.lit("now").alias("saved_at")).write.option("maxRecordsPerFile", 1).json(folder)
    found = files.scraped(spark, folder)
    return found.groupBy(F.col("metadata")["type"].cast("bigint").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("page_content")).alias("chars"))


@query(f"WITH {TURNS} SELECT count(*) AS n, count(DISTINCT question) AS questions, count(answer) AS answers, count(*) AS ids FROM turns")
def scan_logs(spark, d):
    path = scratch(spark, "log")
    store.append_log(turns(spark, d).select(F.col("session_id").cast("string").alias("session_id"), "question", "answer"), path)
    with_noise = spark.createDataFrame([("{broken",), ("",)], "value string")
    with_noise.coalesce(1).write.mode("append").text(path)
    rows = store.read_json_lines(spark, path, store.LOG_SCHEMA)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("question").alias("questions"), F.count("answer").alias("answers"), F.count_distinct("message_id").alias("ids"))


@query(f"WITH {TURNS}, {cache()} SELECT question_hash, answer_quality, usage_count FROM cache")
def scan_cache(spark, d):
    path = scratch(spark, "cache")
    store.replace(full_cache(spark, d), path, "json")
    store.replace(store.read_json_lines(spark, path, store.CACHE_SCHEMA), path, "json")
    return store.read_json_lines(spark, store.settled(spark, path), store.CACHE_SCHEMA).select("question_hash", "answer_quality", "usage_count")


@query(f"WITH {LINES} SELECT 'set' AS kind, url FROM listed UNION ALL SELECT 'list', url FROM listed UNION ALL SELECT 'list', url FROM listed")
def scan_urls(spark, d):
    path = scratch(spark, "urls")
    lines = listed(spark, d).select(F.explode(F.array("url", F.concat(F.lit("  "), F.col("url")), F.lit("# comment"), F.lit(""))).alias("value"))
    lines.write.text(path)
    return files.url_set(spark, path).select(F.lit("set").alias("kind"), "url").unionAll(files.url_list(spark, path).select(F.lit("list").alias("kind"), "url"))


@query(f"""WITH {LINES}, c AS (SELECT url, CASE WHEN contains(url, '/programs/') THEN 'programs' WHEN contains(url, '/specialisations/') THEN 'specialisations' WHEN contains(url, '/courses/') THEN 'courses' END AS category FROM (SELECT replace(replace(url, '/en/', '/courses/'), '/fr/', '/programs/') AS url FROM listed))
    SELECT value, count(*) AS n FROM (SELECT DISTINCT url AS value FROM c WHERE category IS NOT NULL UNION ALL SELECT DISTINCT '# ' || category FROM c WHERE category IS NOT NULL) GROUP BY 1""")
def saved_links(spark, d):
    path = scratch(spark, "links")
    moved = listed(spark, d).select(F.replace(F.replace("url", F.lit("/en/"), F.lit("/courses/")), F.lit("/fr/"), F.lit("/programs/")).alias("url"))
    files.write_links(moved, path)
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT strlen(html) AS size, md5(html) AS hash, count(*) AS n FROM pages WHERE html <> '' GROUP BY 1, 2")
def scan_files(spark, d):
    folder = scratch(spark, "files")
    table(spark, d, "pages").where("html != ''").select("html").write.option("maxRecordsPerFile", 1).option("lineSep", "\u0001").text(folder)
    found = files.file_status(spark, folder).where("path like '%part-%'")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select(F.expr("substring(content, 1, length - 1)").alias("c"))  # the writer ends a file with its separator
    both = raw.select(F.octet_length("c").cast("bigint").alias("size"), F.md5("c").alias("hash")).groupBy("size", "hash").agg(F.count(F.lit(1)).alias("n"))
    return both.join(found.select((F.col("size") - 1).alias("size")).distinct(), "size", "left_semi")


@query("SELECT source, arg_max(coalesce(text, ''), doc_id) AS text, regexp_replace(source, '[^\\p{L}\\p{N}_]+', '_', 'g') AS slug FROM documents WHERE source IS NOT NULL GROUP BY source")
def documents_by_slug(spark, d):
    docs = table(spark, d, "documents").where("source is not null").select("source", F.coalesce("text", F.lit("")).alias("text"), F.lpad(F.col("doc_id").cast("string"), 18, "0").alias("saved_at"))
    return files.with_slug(docs, F.col("source")).select("slug", "source", "text")


@query(f"WITH {LINES}, f AS (SELECT list(url ORDER BY url) AS u FROM listed) SELECT len(u) + 1 AS total, u[1] AS first FROM f")
def metadata_append(spark, d):
    path = scratch(spark, "none") + ".json"
    empty = files.metadata(spark, path)
    names = [r.url for r in listed(spark, d).orderBy("url").collect()]  # one metadata row holds them all
    return links.metadata_update(links.metadata_update(empty, names), [names[0], "https://new/"]).select(F.col("total_scraped").cast("bigint").alias("total"), F.col("scraped_urls")[0].alias("first"))


@query("""WITH f AS (SELECT lang AS kind, source || '.pdf' AS name, max(n_chars) AS m FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL)
    SELECT kind, count(*) AS files, array_to_string(list(name ORDER BY name)[1:10], ',') AS first, max(m) AS latest FROM f GROUP BY 1""")
def source_summary(spark, d):
    held = table(spark, d, "documents").where("lang is not null and source is not null").groupBy(F.col("lang").alias("kind"), F.concat(F.col("source"), F.lit(".pdf")).alias("name")).agg(F.max("n_chars").alias("modified"))
    return analytics.source_summary(held).withColumn("first", F.array_join("first", ","))


# Collections

DOCS = "SELECT coalesce(source, '') || '.pdf' AS source, coalesce(text, '') AS page_content, CASE WHEN doc_id % 2 = 0 THEN 'pdf' ELSE 'web' END AS content_type FROM documents"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.concat(F.coalesce("source", F.lit("")), F.lit(".pdf")).alias("source"), F.coalesce("text", F.lit("")).alias("page_content"), F.when(F.col("doc_id") % 2 == 0, "pdf").otherwise("web").alias("content_type"))


@query(f"WITH c AS ({DOCS}) SELECT (SELECT count(*) FROM c) AS made, (SELECT count(*) FROM c) AS kept, false AS same_sources_rebuild, true AS other_sources_rebuild, (SELECT count(*) FROM c WHERE content_type = 'web') AS rebuilt, (SELECT count(DISTINCT source) FROM c WHERE content_type = 'web') AS registered")
def collection_rebuild(spark, d):
    path, built = scratch(spark, "collection"), lambda x: x
    docs = chunks(spark, d)
    made = collection.refreshed(docs, path, built).count()
    same = collection.needs_rebuild(spark, docs, path)
    kept = collection.scanned(spark, path).count()
    web = docs.where("content_type = 'web'")
    other = collection.needs_rebuild(spark, web, path)
    now = collection.rebuild(web, path, built)
    return now.agg(F.count(F.lit(1)).alias("rebuilt")).select(F.lit(made).alias("made"), F.lit(kept).alias("kept"), F.lit(same).alias("same_sources_rebuild"), F.lit(other).alias("other_sources_rebuild"), "rebuilt", F.lit(spark.read.parquet(collection.registry(path)).count()).alias("registered"))


@query(f"WITH c AS ({DOCS}) SELECT source, count(*) AS n FROM c WHERE NOT ends_with(source, 'src1.pdf') AND NOT ends_with(source, '7.pdf') GROUP BY 1")
def delete_by_suffix(spark, d):
    left = store.without_suffix(chunks(spark, d), "/in/src1.pdf")
    return store.without_suffixes(left, spark.createDataFrame([("x/7.pdf",)], "path string")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH c AS ({DOCS}), s AS (SELECT DISTINCT CASE WHEN content_type = 'pdf' THEN 'pdf' ELSE 'scraped' END AS kind, source AS name FROM c) SELECT * FROM s WHERE NOT (kind = 'pdf' AND name = 'src1.pdf') UNION SELECT 'pdf', 'new.pdf'")
def source_registry(spark, d):
    kind = "kind string, name string"
    return store.register(collection.sources_of(chunks(spark, d)), spark.createDataFrame([("pdf", "new.pdf"), ("pdf", "new.pdf")], kind), spark.createDataFrame([("pdf", "src1.pdf")], kind))


@query(f"""WITH p AS (SELECT {NORMAL.format('url')} AS name, max(md5(coalesce(html, ''))) AS hash FROM pages GROUP BY 1) SELECT name, hash FROM p WHERE name <> '' AND length(name) % 3 < 2""")
def files_changed(spark, d):
    now = table(spark, d, "pages").groupBy(urls.normalized(F.col("url")).alias("name")).agg(F.max(F.md5(F.coalesce("html", F.lit("")))).alias("hash")).where("name != ''")
    size = F.length("name") % 3
    return links.changed(now, now.where(size > 0).select("name", F.when(size == 1, "old").otherwise(F.col("hash")).alias("hash")))


GONE = f"{LINES}, gone AS (SELECT url FROM listed WHERE length(url) % 4 = 0)"


@query(f"""WITH {GONE}, p AS (SELECT {NORMAL.format('url')} AS url, count(*) AS n FROM pages GROUP BY 1)
    SELECT 'listed' AS what, count(*) AS n FROM listed WHERE url NOT IN (FROM gone) UNION ALL SELECT 'files', count(*) FROM p WHERE url NOT IN (FROM gone) AND url <> '' UNION ALL SELECT 'chunks', sum(n)::BIGINT FROM p WHERE url NOT IN (FROM gone) AND url <> ''
    UNION ALL SELECT 'metadata', count(*) FROM listed WHERE url NOT IN (FROM gone) UNION ALL SELECT 'removed', count(*) FROM gone UNION ALL SELECT 'missing', 1 UNION ALL SELECT 'requests', count(*) FROM gone""")
def urls_removed(spark, d):
    known = listed(spark, d)
    pages = table(spark, d, "pages").select(urls.normalized(F.col("url")).alias("url"), "html").where("url != ''")
    meta = known.agg(F.lit("t").alias("last_scraped"), F.count(F.lit(1)).alias("total_scraped"), F.collect_list("url").alias("scraped_urls"))
    asked = known.where(F.length("url") % 4 == 0).unionByName(spark.createDataFrame([("https://not.listed/",)], "url string"))
    out = collection.remove_urls(known, pages.select("url").distinct(), meta, pages.select(F.col("url").alias("source"), "html"), asked)
    n = F.count(F.lit(1)).alias("n")
    counts = [out.listed.agg(F.lit("listed").alias("what"), n), out.files.agg(F.lit("files").alias("what"), n), out.chunks.agg(F.lit("chunks").alias("what"), n), out.metadata.select(F.lit("metadata").alias("what"), F.col("total_scraped").alias("n")), out.states.groupBy(F.col("state").alias("what")).agg(n), out.requests.agg(F.lit("requests").alias("what"), n)]
    done = counts[0]
    for x in counts[1:]:
        done = done.unionByName(x)
    return done


@query(f"""WITH {GONE}, x AS (SELECT url, CASE WHEN length(url) % 8 = 0 THEN 'new' ELSE 'old' END AS html FROM listed) SELECT html, count(*) AS n, sum(length(url))::BIGINT AS chars FROM x GROUP BY 1""")
def urls_refreshed(spark, d):
    known = listed(spark, d)
    fetch = lambda u: u.select("url", F.when(F.length("url") % 8 == 0, "new").alias("html"))
    now, _, _ = collection.refresh_urls(known, known.withColumn("html", F.lit("old")), fetch, known.where(F.length("url") % 4 == 0))
    return now.groupBy("html").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("url")).alias("chars"))


FETCHED = f"""fetched AS (SELECT DISTINCT {NORMAL.format('url')} AS url FROM pages WHERE length(html) >= 3000 AND {NORMAL.format('url')} <> '' UNION VALUES ('https://old.example.com/courses/1'), ('https://old.example.com/programs/2'))"""


@query(f"""WITH {LINES}, {FETCHED} SELECT url, 'scrape' AS action FROM (SELECT url || 'x' AS url FROM listed WHERE length(url) % 5 = 0 EXCEPT FROM listed)
    UNION ALL SELECT url, 'remove' FROM fetched WHERE url NOT IN (FROM listed) UNION ALL SELECT url, 'update' FROM fetched WHERE url IN (FROM listed) AND length(url) % 2 = 0""")
def monitor_round(spark, d):
    known, held = listed(spark, d), fetched_urls(spark, d).withColumn("hash", F.lit("1"))
    found = known.unionByName(known.where(F.length("url") % 5 == 0).select(F.concat(F.col("url"), F.lit("x")).alias("url")))
    return collection.monitor(known, found, held, held.withColumn("hash", F.when(F.length("url") % 2 == 0, "0").otherwise("1")))


# Streams

ASKED = "SELECT CAST(doc_id AS VARCHAR) AS request_id, CASE doc_id % 4 WHEN 0 THEN 'scraped_content_added' WHEN 1 THEN 'file_deletion' WHEN 2 THEN 'scraped_content_updated_x' ELSE 'other' END AS reason, CASE WHEN doc_id % 4 IN (1, 2) THEN source || '.pdf' ELSE 'u' || doc_id END AS source, text AS page_content, doc_id FROM documents WHERE doc_id % 9 = 0 AND source IS NOT NULL"


def asked_updates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_id % 9 = 0 and source is not null")
    kind = F.col("doc_id") % 4
    reason = F.when(kind == 0, "scraped_content_added").when(kind == 1, "file_deletion").when(kind == 2, "scraped_content_updated_x").otherwise("other")
    return docs.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("request_id"), reason.alias("reason"), F.when(kind.isin(1, 2), F.concat(F.col("source"), F.lit(".pdf"))).otherwise(F.concat(F.lit("u"), F.col("doc_id").cast("string"))).alias("source"), F.col("text").alias("page_content"), F.lit("web").alias("content_type"), F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, doc_id)").alias("requested_at"))


@query(f"""WITH c AS ({DOCS}), q AS ({ASKED}), l AS (SELECT source, arg_max(reason, doc_id) AS reason, arg_max(coalesce(page_content, ''), doc_id) AS page_content FROM q GROUP BY 1),
    n AS (SELECT source, page_content FROM c WHERE source NOT IN (SELECT source FROM l WHERE reason NOT IN ('scraped_content_added')) UNION ALL SELECT source, page_content FROM l WHERE reason <> 'file_deletion')
    SELECT source, count(*) AS n, sum(length(page_content))::BIGINT AS chars FROM n GROUP BY 1""")
def update_stream(spark, d):
    requests, path, status, point = (scratch(spark, x) for x in ("requests", "chunks", "status", "point"))
    store.replace(chunks(spark, d), path)
    asked_updates(spark, d).write.json(requests)
    updates.maintain(spark, requests, path, status, point).awaitTermination()
    return spark.read.parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("page_content")), F.lit(0)).alias("chars"))


@query(f"""WITH q AS ({ASKED}) SELECT state, count(*) AS n FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 27 = 0 THEN 'failed: OSError' ELSE 'completed' END ELSE 'queued' END AS state FROM q UNION ALL SELECT 'none') GROUP BY 1""")
def request_states(spark, d):
    requests = asked_updates(spark, d)
    number = F.col("request_id").cast("bigint")
    taken = requests.where(number % 2 == 0).select("request_id", "reason", F.lit(0).cast("bigint").alias("batch"), F.when(number % 27 == 0, "failed: OSError").otherwise("completed").alias("state"), F.col("requested_at").alias("at"))
    asked = requests.select("request_id").unionByName(spark.createDataFrame([("unknown",)], "request_id string"))
    return updates.states(requests, taken, asked).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH q AS ({ASKED}), t AS (SELECT * FROM q WHERE doc_id % 2 = 0) SELECT (SELECT count(*) FROM q WHERE doc_id % 2 <> 0) AS queued, count(*) FILTER (WHERE doc_id % 27 <> 0) AS completed, count(*) FILTER (WHERE doc_id % 27 = 0) AS failed,
    (SELECT string_agg(lpad(request_id, 12, '0'), ',' ORDER BY doc_id DESC) FROM (SELECT * FROM t ORDER BY doc_id DESC LIMIT 5)) AS last FROM t""")
def request_queue(spark, d):
    requests = asked_updates(spark, d)
    number = F.col("request_id").cast("bigint")
    taken = requests.where(number % 2 == 0).select("request_id", "reason", F.lit(0).cast("bigint").alias("batch"), F.when(number % 27 == 0, "failed: OSError").otherwise("completed").alias("state"), F.col("requested_at").alias("at"))
    return updates.queue_status(requests, taken).withColumn("last", F.array_join("last", ","))


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY date_trunc('hour', ts), event_type HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def windowed_stream(spark, d):
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    out = updates.drained(updates.windowed_counts(events), "w" + scratch(spark, "n")[-8:], "append", scratch(spark, "stream"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


# JSON

PAGE = "json_object('title', source, 'tags', json_array(json_object('value', lang), json_object('label', 'd' || doc_id)), 'inner', json_object('id', 1, 'n', doc_id))"


@query("""WITH e AS (SELECT event_id, event_type, CAST(event_id % 97 AS VARCHAR) AS v FROM events) SELECT event_id, 'root' AS path, '## Title' || chr(10) || event_type || chr(10) || chr(10) || '## Amount' || chr(10) || 'value (' || v || ')' AS content FROM e
    UNION ALL SELECT event_id, 'amount', '# Amount' || chr(10) || chr(10) || '## Label' || chr(10) || 'value' || chr(10) || chr(10) || '## Value' || chr(10) || v FROM e WHERE v <> ''""")
def json_sections(spark, d):
    value = (F.col("event_id") % 97).cast("string")
    rows = table(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("title"), F.struct(F.lit("value").alias("label"), value.alias("value")).alias("amount"))).alias("raw"))
    return jsonflat.exploded(rows, "raw", "event_id")


def json_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source is not null and lang is not null")
    tags = F.array(F.struct(F.col("lang").alias("value"), F.lit(None).cast("string").alias("label")), F.struct(F.lit(None).cast("string").alias("value"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("label")))
    return docs.select("doc_id", F.to_json(F.struct(F.col("source").alias("title"), F.col("source").alias("description"), tags.alias("tags"), F.struct(F.lit(1).alias("id"), (F.col("doc_id") + 1).alias("n")).alias("inner"))).alias("raw"))


@query("SELECT doc_id, 'title=' || source || ';description=' || source || ';tags=' || lang || ', d' || doc_id || ';inner_n=' || (doc_id + 1) AS fields, lang || ',d' || doc_id AS tags FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def json_fields(spark, d):
    flat = json_docs(spark, d).select("doc_id", jsonflat.to_fields(F.col("raw")).alias("m"), F.array_join(jsonflat.list_values(F.get_json_object("raw", "$.tags")), ",").alias("tags"))
    shown = F.array_join(F.transform(F.array(*map(F.lit, ("title", "description", "tags", "inner_n"))), lambda k: F.concat(k, F.lit("="), F.element_at("m", k))), ";")
    return flat.select("doc_id", shown.alias("fields"), "tags")


@query("""SELECT source AS title, '## Title' || chr(10) || source || chr(10) || chr(10) || '## Overview' || chr(10) || source || chr(10) || chr(10) || '## Tags' || chr(10) || chr(10) || '- ' || lang || chr(10) || '- d' || doc_id || chr(10) || chr(10) || '## Inner' || chr(10) || chr(10) || '### Id' || chr(10) || '1' || chr(10) || chr(10) || '### N' || chr(10) || (doc_id + 1) AS content
    FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def json_pages(spark, d):
    page = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"pageContent":{"old":1},"program":'), F.col("raw"), F.lit("}}}</script></html>"))
    found = json_docs(spark, d).select(F.lit("u").alias("url"), F.to_json(F.map_filter(jsonflat.page_content(page), lambda k, _: k.isin("title", "description"))).alias("flat"), "raw")
    same = found.where(F.get_json_object("flat", "$.title") == F.get_json_object("raw", "$.title"))
    out = jsonflat.structured(same, "raw", "url")
    return out.where(F.col("metadata")["content_length"].cast("int") == F.length("page_content")).select(F.col("metadata")["title"].alias("title"), F.col("page_content").alias("content"))


# Chunks

WEB = "SELECT doc_id, text, source, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'scraped_web' END AS content_type, CASE WHEN doc_id % 2 = 0 THEN 'C' || doc_id ELSE '' END AS code, lang AS title FROM documents"


def web(spark: SparkSession, d: str, marked: bool = True) -> DataFrame:
    docs = table(spark, d, "documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "pdf").when(F.col("doc_id") % 3 == 1, "scraped_web")
    body = F.replace("text", F.lit("\n"), F.lit("\n## ")) if marked else F.col("text")
    return docs.select("doc_id", body.alias("text"), "source", kind.alias("content_type"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("C"), F.col("doc_id").cast("string"))).otherwise("").alias("code"), F.col("lang").alias("title"))


SECTIONS = "list_filter(list_transform(string_split(replace(text, chr(10), chr(1) || '## '), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 10)"


@query(f"""WITH w AS ({WEB}), p AS (SELECT *, {SECTIONS} AS s FROM w), e AS (SELECT *, unnest(generate_series(0, len(s) - 1)) AS chunk_index, unnest(s) AS c FROM p WHERE len(s) > 0),
    h AS (SELECT *, concat_ws(chr(10), CASE WHEN code <> '' THEN '**Program/Course Code:** ' || code END, CASE WHEN title <> '' THEN '**Title:** ' || title END, CASE WHEN content_type <> '' THEN '**Type:** ' || content_type END, CASE WHEN source <> '' THEN '**Source:** ' || source END) AS body FROM e)
    SELECT doc_id, chunk_index, len(s) AS total_chunks, CASE WHEN body = '' THEN '' ELSE '**Context Information:**' || chr(10) || body || chr(10) || chr(10) END || c AS page_content FROM h""")
def chunk_headers(spark, d):
    return chunking.split_by_headers(web(spark, d)).select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("total_chunks").cast("bigint").alias("total_chunks"), "page_content")


MERGE = """c0(doc_id, source, content_type, code, title, s, i, done, opened, size) AS (SELECT doc_id, source, content_type, code, title, s, 1, []::VARCHAR[], []::VARCHAR[], 0 FROM p WHERE len(s) > 0
        UNION ALL SELECT doc_id, source, content_type, code, title, s, i + 1,
          CASE WHEN starts_with(s[i], '## Overview') OR length(s[i]) >= 1200 THEN list_append(CASE WHEN len(opened) > 0 THEN list_append(done, array_to_string(opened, chr(10) || chr(10))) ELSE done END, s[i])
               WHEN (size + length(s[i]) > 600 OR len(opened) >= 8) AND len(opened) > 0 AND size >= 200 THEN list_append(done, array_to_string(opened, chr(10) || chr(10))) ELSE done END,
          CASE WHEN starts_with(s[i], '## Overview') OR length(s[i]) >= 1200 THEN []::VARCHAR[] WHEN (size + length(s[i]) > 600 OR len(opened) >= 8) AND len(opened) > 0 AND size >= 200 THEN [s[i]] ELSE list_append(opened, s[i]) END,
          CAST(CASE WHEN starts_with(s[i], '## Overview') OR length(s[i]) >= 1200 THEN 0 WHEN (size + length(s[i]) > 600 OR len(opened) >= 8) AND len(opened) > 0 AND size >= 200 THEN length(s[i]) ELSE size + length(s[i]) END AS INT) FROM c0 WHERE i <= len(s)),
      c1 AS (SELECT * EXCLUDE (done, opened, s, i, size), CASE WHEN len(opened) > 0 THEN list_append(done, array_to_string(opened, chr(10) || chr(10))) ELSE done END AS c FROM c0 WHERE i = len(s) + 1),
      merged AS (SELECT doc_id, source, content_type, code, title, len(c) AS total_chunks, unnest(generate_series(0, len(c) - 1)) AS chunk_index, unnest(c) AS chunk FROM c1),
      compact AS (SELECT *, concat_ws(chr(10), CASE WHEN code <> '' AND title <> '' THEN '**' || code || ' - ' || title || '**' WHEN code <> '' THEN '**Code:** ' || code WHEN title <> '' THEN '**Title:** ' || title END, CASE WHEN content_type <> '' THEN '**Type:** ' || content_type END, CASE WHEN starts_with(source, 'https://') THEN '**Source:** ' || source END) AS head FROM merged WHERE length(chunk) BETWEEN 200 AND 4000)"""


@query(f"""WITH RECURSIVE w AS ({WEB}), p AS (SELECT *, {SECTIONS} AS s FROM w), {MERGE} SELECT doc_id, chunk_index, total_chunks, CASE WHEN head <> '' THEN head || chr(10) || chr(10) ELSE '' END || chunk AS page_content FROM compact""")
def chunk_web(spark, d):
    return chunking.split_merged(web(spark, d)).select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("total_chunks").cast("bigint").alias("total_chunks"), "page_content")


@query(f"""WITH RECURSIVE w AS ({WEB}), p AS (SELECT *, {SECTIONS} AS s FROM w WHERE content_type = 'scraped_web'), {MERGE},
    q AS (SELECT doc_id, source, list_filter(list_transform(string_split(regexp_replace(replace(text, chr(10), chr(10) || '## '), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS s FROM w WHERE content_type = 'pdf'),
    e AS (SELECT doc_id, unnest(generate_series(0, len(s) - 1)) AS i, unnest(s) AS x FROM q WHERE len(s) > 0)
    SELECT 'pdf' AS kind, doc_id, i // 3 AS chunk_index, string_agg(x, ' ' ORDER BY i) AS page_content FROM e GROUP BY 2, 3
    UNION ALL SELECT 'scraped_web', doc_id, chunk_index, CASE WHEN head <> '' THEN head || chr(10) || chr(10) ELSE '' END || chunk FROM compact
    UNION ALL SELECT 'other', doc_id, 0, replace(text, chr(10), chr(10) || '## ') FROM w WHERE content_type IS NULL""")
def chunk_routed(spark, d):
    rows = chunking.route(web(spark, d))
    return rows.select(F.coalesce("content_type", F.lit("other")).alias("kind"), "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "page_content")
