"""Text expressions: Column in, Column out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for nothing.
NULL_WORDS = ("none", "null", "undefined")
MEANINGLESS = ("", "null", "none", "n/a", "undefined")
# A key that contains one of these is technical.
IGNORED_KEYS = ("key", "cl_id", "state", "linking_id", "order", "active", "hbeorder")
# Stop words of the lexical index; those of the proxy metric are general English, and a parameter.
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by")
TERM_STOP_WORDS = (
    "the", "and", "for", "that", "this", "with", "from", "have", "will", "are", "been", "were", "they", "their", "about", "which", "when",
    "also", "into", "more", "some", "such", "than", "then", "there", "these", "those", "what", "your", "each", "can", "include", "including",
)
# An answer with one of these is not grounded.
DOUBTFUL_PHRASES = ("i don't have any information", "i don't know", "insufficient_context", "within the current context")
#: General phrases that block a question; what a domain adds, and the words that pass a question, are parameters.
UNSAFE_PHRASES = ("hack", "cheat", "illegal", "bypass", "forge")
SAFE_INDICATORS: tuple[str, ...] = ()
LONGEST_QUESTION = 10_000
# Named character references that cleaning decodes.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


#: White space at a text's ends: Unicode's, and the four separators of ASCII.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"

#: One of these that isn't white space to \\s.
ODD_SPACE = r"[\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}|{SPACE}$", "")


def normalized_question(c: Column) -> Column:
    return strip(F.lower(c))


def question_hash(c: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the normalised question."""
    return F.substring(F.sha2(normalized_question(c), 256), 1, 16)


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(F.coalesce(c, F.lit(""))) / 4).cast("bigint")


def clean_html(c: Column) -> Column:
    """Text of markup: scripts, styles and comments go, tags become spaces, entities are decoded once, white space collapses."""
    out = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for name, sign in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(sign))
    out = strip(F.regexp_replace(out, r"\s+", " "))
    out = F.regexp_replace(out, r"&[a-zA-Z0-9#]+;", "")
    return F.when(c.isNull() | F.lower(strip(c)).isin(*NULL_WORDS) | F.lower(out).isin(*NULL_WORDS), "").otherwise(out)


def is_meaningful(c: Column) -> Column:
    return c.isNotNull() & ~F.lower(strip(c)).isin(*MEANINGLESS)


def ignored_key(c: Column) -> Column:
    return F.exists(F.array(*map(F.lit, IGNORED_KEYS)), lambda k: F.contains(F.lower(c), k))


def field_label(c: Column) -> Column:
    return F.initcap(strip(F.regexp_replace(F.replace(c, F.lit("_"), F.lit(" ")), r"\b0\b", "")))


def section_title(c: Column) -> Column:
    return strip(F.regexp_extract(c, r"(?m)^[^\S\n]*##(.*)$", 1))


def terms(c: Column, stop_words: Sequence[str] = TERM_STOP_WORDS) -> Column:
    """Words of four letters and more without stop words, in order, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: w.rlike("^[a-z]{4,}$") & ~w.isin(*stop_words))


def index_tokens(c: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Tokens of the lexical index: letters only, over two of them, no stop word; or two digits and more; codes AAAA9999 and 9999 as they are."""
    kept = F.regexp_extract_all(F.lower(c), F.lit(r"(?<![\p{L}\p{N}])([a-z]{4}\d{4}|\p{L}{3,}+|\d{2,}+)(?![\p{L}\p{N}])"), 1)
    code = lambda w: (F.length(w) == 8) & (F.substr(w, F.lit(8), F.lit(1)) <= "9") & (F.substr(w, F.lit(1), F.lit(1)) > "9")
    found = F.filter(kept, lambda w: ~w.isin(*stop_words))
    return F.when(F.lower(c).rlike(r"[a-z]{4}\d{4}"), F.transform(found, lambda w: F.when(code(w), F.upper(w)).otherwise(w))).otherwise(found)


def doubtful(answer: Column, phrases: Sequence[str] = DOUBTFUL_PHRASES) -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    return (low == "") | F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p))


def safety(question: Column, unsafe: Sequence[str] = UNSAFE_PHRASES, indicators: Sequence[str] = SAFE_INDICATORS, model: Column | None = None) -> Column:
    """Which rule decides: empty, too_long, unsafe, indicator or model; rules in this order. model: the classifier's verdict (true: safe)."""
    low = F.lower(question)
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda p: F.contains(low, p)) if words else F.lit(False)
    return (
        F.when(question.isNull() | (strip(question) == ""), "empty")
        .when(F.length(question) > LONGEST_QUESTION, "too_long")
        .when(any_of(unsafe), "unsafe")
        .when(any_of(indicators), "indicator")
        .when(F.coalesce(model, F.lit(True)) if model is not None else F.lit(True), "model")
        .otherwise("unsafe")
    )


def is_safe(rule: Column) -> Column:
    return ~rule.isin("too_long", "unsafe")


def code(c: Column, pattern: str = r"[A-Z]{4}\d{4}") -> Column:
    return F.regexp_extract(c, f"({pattern})", 1)


def context_header(code: Column, title: Column, kind: Column, source: Column) -> Column:
    line = lambda label, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"**{label}:** "), c))
    body = F.concat_ws("\n", line("Program/Course Code", code), line("Title", title), line("Type", kind), line("Source", source))
    return F.when(body == "", "").otherwise(F.concat(F.lit("**Context Information:**\n"), body))


def compact_context(code: Column, title: Column, kind: Column, source: Column, base_url: str = "https://") -> Column:
    has = lambda c: c.isNotNull() & (c != "")
    head = F.when(has(code) & has(title), F.concat(F.lit("**"), code, F.lit(" - "), title, F.lit("**"))).when(has(code), F.concat(F.lit("**Code:** "), code)).when(has(title), F.concat(F.lit("**Title:** "), title))
    return F.concat_ws("\n", head, F.when(has(kind), F.concat(F.lit("**Type:** "), kind)), F.when(source.startswith(base_url), F.concat(F.lit("**Source:** "), source)))


def duration_label(ms: Column) -> Column:
    return F.when(F.coalesce(ms, F.lit(0)) == 0, "0ms").when(ms > 1000, F.concat(F.format_string("%.1f", ms / 1000), F.lit("s"))).otherwise(F.concat(F.round(ms).cast("bigint").cast("string"), F.lit("ms")))
