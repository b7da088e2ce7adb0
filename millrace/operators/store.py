"""Keyed tables: the answer cache, the interaction log, the chunk collection and the registry of sources.

Tables are DataFrames and every change gives a new one; replace() writes it beside the old files and then swaps, so
that no plan reads what it overwrites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.logs import legacy_query_type
from ..functions.text import question_hash
from ..session import stored

CACHE_SCHEMA = "question_hash string, question string, answer string, created_at string, updated_at string, answer_quality string, last_used string, cache_id string, user_feedback string, query_type string, usage_count bigint, matched_files array<string>"
LOG_SCHEMA = (
    "timestamp string, session_id string, question string, answer string, status string, query_type string, question_hash string, message_id string, model_used string, answered boolean, ai_answered boolean, "
    "safety_blocked boolean, cache_hit boolean, matched_files array<string>, processing_steps array<string>, response_time_ms bigint, tokens_used bigint, user_feedback string, feedback_time string, admin_answered boolean, "
    "admin_response_time string, type string, total_queries bigint, avg_response_time double, total_tokens bigint"
)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file; lines that can't be read are dropped."""
    parsed = spark.read.text(path).select(F.from_json("value", schema + ", _corrupt_record string").alias("r"))
    return parsed.where("r is not null and r._corrupt_record is null").select("r.*").drop("_corrupt_record")


def append_log(rows: DataFrame, path: str) -> None:
    if "message_id" not in rows.columns:
        rows = rows.withColumn("message_id", F.lit(None).cast("string"))
    rows.withColumn("message_id", F.coalesce("message_id", F.expr("uuid()"))).write.mode("append").json(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return at, at(path).getFileSystem(spark._jsc.hadoopConfiguration())


def settled(spark: SparkSession, path: str) -> str:
    """The path, after a swap that a crash has cut short is ended or undone: there is a whole table at it again if there was one."""
    at, fs = _fs(spark, path)
    path = path.rstrip("/")
    if fs.exists(at(path)):
        fs.delete(at(path + ".old"), True)
    elif fs.exists(at(path + ".staged/_SUCCESS")):
        fs.rename(at(path + ".staged"), at(path))
    elif fs.exists(at(path + ".old")):
        fs.rename(at(path + ".old"), at(path))
    return path


def replace(df: DataFrame, path: str, kind: str = "parquet", batch: int | None = None) -> None:
    """df instead of what path holds: written whole beside it first; then the old table moves aside and the new one takes its place.

    A crash at any point leaves the old or the new table, whole, for settled(). batch: the number of the change, kept in the table itself.
    """
    spark = df.sparkSession
    path = settled(spark, path)
    at, fs = _fs(spark, path)
    df.write.mode("overwrite").format(kind).save(path + ".staged")
    if batch is not None:
        fs.create(at(f"{path}.staged/_batch_{batch}")).close()
    had = fs.exists(at(path))
    if had and not fs.rename(at(path), at(path + ".old")):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(at(path + ".staged"), at(path)):
        raise OSError(f"{path}.staged can't be renamed to {path}")
    fs.delete(at(path + ".old"), True)
    spark.catalog.refreshByPath(path)


def has_batch(spark: SparkSession, path: str, batch: int) -> bool:
    """Whether the table has taken this change: a replayed batch must not be taken again."""
    at, fs = _fs(spark, path)
    return fs.exists(at(f"{settled(spark, path)}/_batch_{batch}"))


def upsert_cache(cache: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """Answers (question, answer, answer_quality, matched_files, user_feedback, query_type) by question hash.

    An update sets answer, quality and time, and of the extras only those that aren't null; usage and creation stay. Of several
    answers to one question the last by answer wins. New questions begin with one use.
    """
    new = answers.withColumn("question_hash", question_hash(F.col("question")))
    new = new.groupBy("question_hash").agg(F.max_by(F.struct(*[c for c in new.columns if c != "question_hash"]), "answer").alias("n"))
    both = cache.alias("c").join(new.alias("x"), F.col("c.question_hash") == F.col("x.question_hash"), "full_outer")
    hit, isnew = F.col("x.n").isNotNull(), F.col("c.question_hash").isNull()
    return both.select(
        F.coalesce("c.question_hash", "x.question_hash").alias("question_hash"),
        F.coalesce("c.question", "x.n.question").alias("question"),
        F.when(hit, F.col("x.n.answer")).otherwise(F.col("c.answer")).alias("answer"),
        F.when(isnew, now).otherwise(F.col("c.created_at")).alias("created_at"),
        F.when(hit, now).otherwise(F.col("c.updated_at")).alias("updated_at"),
        F.when(hit, F.col("x.n.answer_quality")).otherwise(F.col("c.answer_quality")).alias("answer_quality"),
        F.when(isnew, now).otherwise(F.col("c.last_used")).alias("last_used"),
        F.coalesce("c.cache_id", F.substring(F.sha2(F.col("x.question_hash"), 256), 17, 16)).alias("cache_id"),
        *(F.coalesce(f"x.n.{k}", f"c.{k}").alias(k) for k in ("user_feedback", "query_type")),
        F.when(isnew, F.lit(1).cast("bigint")).otherwise(F.col("c.usage_count")).alias("usage_count"),
        F.coalesce("x.n.matched_files", "c.matched_files").alias("matched_files"),
    )


def count_uses(cache: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """One more use for every hit (question_hash)."""
    uses = hits.groupBy("question_hash").agg(F.count(F.lit(1)).alias("__n"))
    joined = cache.join(uses, "question_hash", "left")
    return joined.withColumn("usage_count", F.col("usage_count") + F.coalesce("__n", F.lit(0))).withColumn("last_used", F.when(F.col("__n").isNotNull(), now).otherwise(F.col("last_used"))).drop("__n").select(*cache.columns)


def set_answer(cache: DataFrame, key: str, answer: str, now: Column, quality: str = "admin_answered") -> DataFrame:
    """A new answer for the first row of a hash."""
    first = cache.where(F.col("question_hash") == key).agg(F.min("cache_id").alias("__id"))
    joined = cache.crossJoin(F.broadcast(first))
    this = (F.col("question_hash") == key) & F.col("cache_id").eqNullSafe(F.col("__id"))
    return joined.withColumn("answer", F.when(this, answer).otherwise(F.col("answer"))).withColumn("answer_quality", F.when(this, quality).otherwise(F.col("answer_quality"))).withColumn("updated_at", F.when(this, now).otherwise(F.col("updated_at"))).drop("__id")


def delete_entry(cache: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """Without the rows of a question hash, and whether there were any."""
    this = F.col("question_hash").eqNullSafe(F.lit(key))
    return cache.where(~this), not cache.where(this).isEmpty()


def delete_where(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def delete_logs(logs: DataFrame, cache: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without these message_ids, and the cache without their questions."""
    gone = logs.join(ids.select("message_id").distinct(), "message_id", "left_semi")
    return delete_where(logs, ids, "message_id"), delete_where(cache, gone.select("question_hash"), "question_hash")


def sync(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of table that changes (one row for a key) has other than null are taken over, in all rows of the key."""
    renamed = changes.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    joined = table.join(renamed, key, "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(f"__{c}", c))
    return joined.select(*table.columns)


def feedback(logs: DataFrame, cache: DataFrame, given: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Feedback (message_id, user_feedback) in the log, and for the same questions in the cache."""
    one = given.groupBy("message_id").agg(F.max("user_feedback").alias("user_feedback"))
    changed = sync(logs, one.withColumn("feedback_time", now), "message_id", ["user_feedback", "feedback_time"])
    by_hash = logs.join(one.withColumnRenamed("user_feedback", "__f"), "message_id").groupBy("question_hash").agg(F.max("__f").alias("user_feedback"))
    return changed, sync(cache, by_hash.withColumn("updated_at", now), "question_hash", ["user_feedback", "updated_at"])


def admin_answers(logs: DataFrame, cache: DataFrame, given: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Staff's answers (message_id, answer) in the log, and as admin answers in the cache."""
    one = given.groupBy("message_id").agg(F.max("answer").alias("answer"))
    extra = one.withColumn("answered", F.lit(True)).withColumn("admin_answered", F.lit(True)).withColumn("admin_response_time", now).withColumn("status", F.lit("answered"))
    changed = sync(logs, extra, "message_id", ["answer", "answered", "admin_answered", "admin_response_time", "status"])
    to_cache = logs.join(one.withColumnRenamed("answer", "__a"), "message_id").select("question", F.col("__a").alias("answer"), F.lit("admin_answered").alias("answer_quality"), "matched_files", F.lit(None).cast("string").alias("user_feedback"), "query_type")
    return changed, upsert_cache(cache, to_cache, now)


def fill_query_types(cache: DataFrame) -> DataFrame:
    return cache.withColumn("query_type", F.coalesce("query_type", legacy_query_type(F.col("answer_quality"), F.col("matched_files"))))


def emptied(table: DataFrame) -> DataFrame:
    return table.limit(0)


# The chunk collection


def changed_names(before: DataFrame, now: DataFrame) -> bool:
    """Whether two sets of names differ (contents aren't looked at)."""
    return not (before.select("name").distinct().exceptAll(now.select("name").distinct()).isEmpty() and now.select("name").distinct().exceptAll(before.select("name").distinct()).isEmpty())


def without_source(chunks: DataFrame, url: str) -> DataFrame:
    return chunks.where(~F.col("source").eqNullSafe(F.lit(url)))


def without_suffix(chunks: DataFrame, path: str) -> DataFrame:
    """Without the chunks whose source ends with the path or its base name."""
    return chunks.where(~F.coalesce(F.col("source").endswith(path) | F.col("source").endswith(path.rsplit("/", 1)[-1]), F.lit(False)))


def without_suffixes(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """Without the chunks whose source ends with one of many paths (path) or their base names: joined on the last step, so only sources of that name are compared."""
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    tails = paths.where("path != ''").select(last(F.col("path")).alias("__step")).where("__step != ''").distinct()
    steps = chunks.select("source").where("source is not null").distinct().withColumn("__last", last(F.col("source")))
    # a base name may end a longer step too: every tail of a step is a key
    keyed = steps.select("source", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("__last"), F.lit(1))), lambda i: F.substr("__last", i))).alias("__step"))
    return chunks.join(keyed.join(tails, "__step").select("source").distinct(), "source", "left_anti").select(*chunks.columns)


def apply_changes(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """A change feed: changes (op: added, modified, deleted; source; and the columns of chunks). Deleted and modified sources go, added and modified chunks come."""
    gone = changes.where("op in ('deleted', 'modified')").select("source").distinct()
    kept = chunks.join(gone, "source", "left_anti").select(*chunks.columns)
    return kept.unionByName(changes.where("op in ('added', 'modified')").select(*chunks.columns))


def register(sources: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The registry (kind, name) after a change, sorted, each once."""
    return sources.unionByName(added).distinct().join(removed, ["kind", "name"], "left_anti").orderBy("kind", "name")


# Finding a message


#: Requests that are compared with the whole log by containment at once; further ones take further passes.
CONTAINED = 10_000


def find_message(asked: DataFrame, logs: DataFrame) -> DataFrame:
    """message_id for each request (request_id, question, hint timestamp): same question, else a logged question that contains it, else the nearest in time, else the latest; of equal ones the first by timestamp.

    Each step sees the requests that the steps before left open. Containment sends CONTAINED requests at a time to the log, and
    keeps one message of each request and task before anything is shuffled.
    """
    base = logs.where("type is null").select("message_id", F.col("question").alias("lq"), "timestamp", F.to_timestamp("timestamp").alias("ts"))
    first = F.min(F.struct("timestamp", "message_id")).alias("m")
    pick = lambda d: d.groupBy("request_id").agg(first).select("request_id", "m.message_id")
    exact = stored(pick(asked.join(base, F.col("question") == F.col("lq"))), "messages-exact")
    rest = stored(asked.join(exact, "request_id", "left_anti"), "messages-rest")
    n = rest.where("question != ''").count()
    inside = None
    for i in range(-(-n // CONTAINED)):
        part = rest.where("question != ''").where(F.pmod(F.xxhash64("request_id"), F.lit(-(-n // CONTAINED))) == i)
        found = pick(base.join(F.broadcast(part), F.contains(F.col("lq"), F.col("question"))))
        inside = found if inside is None else inside.unionByName(found)
    inside = stored(inside if inside is not None else exact.limit(0), "messages-inside")
    rest = rest.join(inside, "request_id", "left_anti")
    near = nearest_in_time(rest.where("hint is not null").select("request_id", F.col("hint").alias("at")), base.where("ts is not null").select(F.col("ts").alias("at"), "message_id"), [], "request_id", "message_id")
    near = stored(near.select("request_id", "message_id"), "messages-near")
    latest = base.orderBy(F.desc("timestamp"), "message_id").limit(1).select("message_id")
    last = rest.join(near, "request_id", "left_anti").select("request_id").crossJoin(F.broadcast(latest))  # one row
    return exact.unionByName(inside).unionByName(near).unionByName(last)


#: Width of the time buckets of the nearest join, in seconds.
BUCKET = 3600


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """For each left row (keys, at, left_id) the right row (keys, at, right_id) of the same keys nearest in time, earlier or later: left_id, right_id, gap in seconds.

    Both sides are dealt by keys and hour. An hour's nearest neighbours are in it, or the last of an earlier hour, or the first of a
    later one; these two are found from one row for each hour, so no row is compared with all others of its key.
    """
    sec = lambda c: F.unix_micros(F.to_timestamp(c)) / 1e6
    l = left.select(*keys, F.col(left_id), sec("at").alias("la")).withColumn("b", F.floor(F.col("la") / BUCKET))
    r = right.select(*keys, F.col(right_id), sec("at").alias("ra")).withColumn("b", F.floor(F.col("ra") / BUCKET))
    ends = r.groupBy(*keys, "b").agg(F.min(F.struct("ra", right_id)).alias("low"), F.max(F.struct("ra", F.col(right_id))).alias("top"), F.min_by(right_id, F.struct((-F.col("ra")).alias("x"), F.col(right_id).alias("y"))).alias("top_id"))
    hours = l.select(*keys, "b").distinct().withColumn("want", F.lit(True)).join(ends, [*keys, "b"], "full_outer")
    w = Window.partitionBy(*keys).orderBy("b")  # one row for each hour: without keys, 8,766 a year
    last = F.last(F.when(F.col("top").isNotNull(), F.struct(F.col("top.ra").alias("ra"), F.col("top_id").alias("id"))), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first(F.when(F.col("low").isNotNull(), F.struct(F.col("low.ra").alias("ra"), F.col(f"low.{right_id}").alias("id"))), True).over(w.rowsBetween(1, Window.unboundedFollowing))
    around = hours.withColumn("before", last).withColumn("after", first).where("want").select(*keys, "b", "before", "after")
    # inside an hour: rows in time order, the neighbour before and the one after
    mixed = l.select(*keys, "b", F.col("la").alias("t"), F.col(left_id).alias("lid"), F.lit(None).cast(dict(r.dtypes)[right_id]).alias("rid")).unionByName(r.select(*keys, "b", F.col("ra").alias("t"), F.lit(None).cast(dict(l.dtypes)[left_id]).alias("lid"), F.col(right_id).alias("rid")))
    inside = Window.partitionBy(*keys, "b")
    point = F.when(F.col("rid").isNotNull(), F.struct(F.col("t").alias("ra"), F.col("rid").alias("id")))
    back = inside.orderBy("t", F.col("rid").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = inside.orderBy("t", F.col("rid").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing)
    near = mixed.withColumn("x", F.last(point, True).over(back)).withColumn("y", F.first(point, True).over(ahead)).where("lid is not null")
    every = near.join(around, [*keys, "b"]).withColumn("c", F.filter(F.array("x", "y", "before", "after"), lambda p: p.isNotNull())).where(F.size("c") > 0)
    best = F.array_min(F.transform("c", lambda p: F.struct(F.round(F.abs(p["ra"] - F.col("t")), 6).alias("gap"), p["id"].alias("id"))))
    return every.select(F.col("lid").alias(left_id), best["id"].alias(right_id), best["gap"].alias("gap"))
