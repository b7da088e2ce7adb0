"""Expressions over interaction records, cached answers and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bands of a metric and of a mean of metrics.
METRIC_BANDS = ((0.9, "excellent"), (0.8, "good"), (0.7, "acceptable"))
OVERALL_BANDS = ((0.85, "excellent"), (0.75, "good"), (0.65, "acceptable"))
WAITING_TEXT = "Thank you for your question! Our staff will answer it soon."


def own_date(stamp: Column) -> Column:
    """The date of an ISO stamp in the stamp's own offset; null if it can't be read."""
    return F.when(F.try_to_timestamp(stamp).isNotNull(), F.to_date(F.substring(stamp, 1, 10)))


def answered(now: Column, before: Column | None = None) -> Column:
    return F.coalesce(now, before if before is not None else F.lit(None).cast("boolean"), F.lit(False))


def query_type(is_answered: Column, blocked: Column, route: Column) -> Column:
    return F.when(~is_answered, "unanswered").when(blocked, "unanswered").when(route.isin("fallback", "navigation"), "ai").otherwise("rag")


def status(is_answered: Column, blocked: Column) -> Column:
    return F.when(blocked, "safety_blocked").when(is_answered, "answered").otherwise("unanswered")


def shown_text(state: Column, answer: Column) -> Column:
    return F.when(state.isin("answered", "safety_blocked"), answer).otherwise(WAITING_TEXT)


def legacy_query_type(quality: Column, files: Column) -> Column:
    """What old cache rows without a query type get."""
    some = F.coalesce(F.size(files), F.lit(0)) > 0
    return F.when(quality.isin("rag", "admin_answered") & some, "rag").when(quality.isin("rag", "admin_answered", "ai"), "ai").otherwise("unanswered")


def attention(is_answered: Column, feedback: Column) -> Column:
    return F.filter(F.array(F.when(~is_answered, "unanswered"), F.when(feedback == "negative", "negative_feedback")), lambda x: x.isNotNull())


def band(score: Column, bands: tuple = METRIC_BANDS, lowest: str = "poor") -> Column:
    out = F.lit(lowest)
    for least, name in reversed(bands):
        out = F.when(score >= least, name).otherwise(out)
    return out


def percent_change(before: Column, now: Column) -> Column:
    return F.when(before == 0, 0.0).otherwise(F.round((now - before) / before * 100, 2))


def turn_text(question: Column, answer: Column, longest: int = 200) -> Column:
    short = F.when(F.length(answer) > longest, F.concat(F.substring(answer, 1, longest), F.lit("..."))).otherwise(answer)
    return F.concat(F.lit("User: "), question, F.lit("\nAssistant: "), short)


def parsed_turns(history: Column) -> Column:
    """User and assistant texts of a formatted history."""
    users = F.regexp_extract_all(history, F.lit(r"(?m)^User: (.*)$"), 1)
    replies = F.regexp_extract_all(history, F.lit(r"(?m)^Assistant: (.*)$"), 1)
    return F.transform(F.arrays_zip(users.alias("u"), replies.alias("a")), lambda x: F.struct(x["u"].alias("user"), x["a"].alias("assistant")))


def success_rate(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(done / total * 100, 2)).otherwise(0.0)


def seconds_left(spent: Column, done: Column, total: Column) -> Column:
    return F.when(done > 0, spent / done * (total - done))


def average_length(characters: Column, done: Column) -> Column:
    """Whole characters a finished item."""
    return F.when(done > 0, F.floor(characters / done)).otherwise(0)
