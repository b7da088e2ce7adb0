"""Maintenance of the collection from a stream of requests, and streaming reports."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import apply_changes, has_batch, replace
from ..session import stored

REQUESTS = "request_id string, reason string, source string, page_content string, content_type string, requested_at timestamp"
# Prefixes of reasons, and the operation each asks for; other reasons mean a general update.
REASONS = {"file_upload": "added", "file_deletion": "deleted", "scraped_content_added": "added", "scraped_content_removed": "deleted", "scraped_content_updated": "modified", "retry": "modified"}
HISTORY = 10


def operation(reason: Column) -> Column:
    out = F.lit("modified")
    for prefix, op in reversed(REASONS.items()):
        out = F.when(reason.startswith(prefix), op).otherwise(out)
    return out


def update(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """chunks (source, page_content, content_type) after a batch of requests; of several for one source the last counts."""
    last = requests.groupBy("source").agg(F.max_by(F.struct("reason", "page_content", "content_type"), F.struct("requested_at", "request_id")).alias("r"))
    return apply_changes(chunks, last.select(operation(F.col("r.reason")).alias("op"), "source", "r.page_content", "r.content_type"))


def submit(rows: DataFrame, requests: str) -> list[str]:
    """Appends update requests (reason, source and what else REQUESTS has) to the folder of requests; gives their ids, unique however many come at one time."""
    known = dict(x.split(" ") for x in REQUESTS.split(", "))
    numbered = rows.withColumn("request_id", F.expr("uuid()")).withColumn("requested_at", F.coalesce("requested_at", F.current_timestamp()) if "requested_at" in rows.columns else F.current_timestamp())
    whole = stored(numbered.select(*(F.col(c).cast(t) if c in numbered.columns else F.lit(None).cast(t).alias(c) for c, t in known.items())), "requests")  # ids are drawn once
    whole.write.mode("append").json(requests)
    return [r.request_id for r in whole.select("request_id").collect()]


def maintain(spark: SparkSession, requests: str, collection: str, status: str, checkpoint: str, apply: Callable[[DataFrame, DataFrame], DataFrame] = update, retries: int = 1) -> StreamingQuery:
    """Takes what is in the folder of requests (JSON) in micro-batches, one after the other, then ends.

    Every batch leaves its requests in the status table, as completed or failed. A batch that fails, after so many retries, ends
    the query, and a restart takes it again: nothing is lost. The collection keeps the numbers of its batches, so a batch that
    was applied before a crash isn't applied twice.
    """
    stream = spark.readStream.schema(REQUESTS).json(requests)

    def note(batch: DataFrame, number: int, state: str) -> None:
        rows = batch.select("request_id", "reason", F.lit(number).cast("bigint").alias("batch"), F.lit(state).alias("state"), F.current_timestamp().alias("at"))
        rows.write.mode("append").parquet(status)

    def each(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        for left in range(retries, -1, -1):
            try:
                if not has_batch(spark, collection, number):
                    replace(apply(spark.read.parquet(collection), batch), collection, batch=number)
                break
            except Exception as e:
                if not left:
                    note(batch, number, f"failed: {type(e).__name__}")
                    raise
        note(batch, number, "completed")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def states(requests: DataFrame, status: DataFrame, asked: DataFrame) -> DataFrame:
    """request_id and state (completed, failed: .., queued, none) for the ids asked for: the last that a batch left, a request that none has taken, or nothing known."""
    last = status.groupBy("request_id").agg(F.max_by("state", F.struct("at", "batch")).alias("state"))
    there = requests.select("request_id", F.lit("queued").alias("__q")).distinct()
    return asked.select("request_id").distinct().join(last, "request_id", "left").join(there, "request_id", "left").select("request_id", F.coalesce("state", "__q", F.lit("none")).alias("state"))


def queue_status(requests: DataFrame, status: DataFrame, last: int = 5) -> DataFrame:
    """One row: queued requests, completed and failed ones, and the ids of the last ones taken, newest first."""
    known = status.groupBy("request_id").agg(F.max_by(F.struct("state", "at"), F.struct("at", "batch")).alias("s")).select("request_id", "s.*")
    queued = requests.select("request_id").distinct().join(known, "request_id", "left_anti").agg(F.count(F.lit(1)).alias("queued"))
    done = known.agg(F.count_if(F.col("state") == "completed").alias("completed"), F.count_if(F.col("state") != "completed").alias("failed"))
    newest = known.orderBy(F.desc("at"), "request_id").limit(last).agg(F.sort_array(F.collect_list(F.struct((-F.unix_micros("at")).alias("t"), "request_id"))).alias("l"))
    return queued.crossJoin(done).crossJoin(newest.select(F.transform("l", lambda x: x["request_id"]).alias("last")))  # one row each


def recent(status: DataFrame, n: int = HISTORY) -> DataFrame:
    return status.orderBy(F.desc("batch"), "request_id").limit(n)


def running_counts(events: DataFrame) -> DataFrame:
    """Totals by event type; complete mode keeps them up to date."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: counts by event time and type with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def drained(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """What a streaming DataFrame gives for the input there is, as a table."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


class Rebuild:
    """One rebuild at a time: callers that come meanwhile wait and get its result."""

    def __init__(self, work: Callable[[], object]) -> None:
        self._work, self._lock, self._made = work, threading.Lock(), None

    def __call__(self, fresh: bool = False) -> object:
        with self._lock:
            if self._made is None or fresh:
                self._made = self._work()
            return self._made


class Session:
    """A cancellable job with progress: jobs run under its group, a step at a time; then() takes what it gives, such as a request for an update."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name, self.state, self.done, self.total, self.began = spark, name, "pending", 0, 0, 0.0

    def run_steps(self, steps: list[Callable[[], object]], then: Callable[[list], object] | None = None) -> list:
        """Results of the steps that ended before a cancellation; then() is called if all did."""
        self.total, self.done, self.began, results = len(steps), 0, time.monotonic(), []

        def work() -> None:
            for step in steps:
                if self.state == "cancelling":
                    break
                results.append(step())
                self.done += 1

        try:
            self.run(work)
        except Exception:
            if self.state != "cancelled":
                raise
        if self.state == "completed" and self.done == self.total and then is not None:
            then(results)
        return results

    def progress(self) -> dict[str, object]:
        """state, done, total, percent, and the seconds left at the mean speed so far (null before the first step's end)."""
        spent = time.monotonic() - self.began if self.began else 0.0
        left = spent / self.done * (self.total - self.done) if self.done else None
        return {"state": self.state, "done": self.done, "total": self.total, "percent": round(self.done / self.total * 100, 2) if self.total else 0.0, "seconds_left": left}

    def run(self, work: Callable[[], object]) -> object:
        self.spark.sparkContext.setJobGroup(self.name, self.name, True)
        self.state = "running"
        try:
            out = work()
            self.state = "cancelled" if self.state == "cancelling" else "completed"
            return out
        except Exception:
            self.state = "cancelled" if self.state == "cancelling" else "failed"
            raise
        finally:
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    def cancel(self) -> bool:
        """Whether there was something to cancel."""
        if self.state != "running":
            return False
        self.state = "cancelling"
        self.spark.sparkContext.cancelJobGroup(self.name)
        return True
