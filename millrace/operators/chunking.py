"""Documents into chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ODD_SPACE, compact_context, context_header, section_title, strip

# Sizes in characters, and sections in a chunk.
SHORTEST_SECTION, TARGET, LEAST, LARGE, MOST, SECTIONS = 10, 600, 200, 1200, 4000, 8
OVERVIEW = "## Overview"
SUMMARY_FROM = 2000


def h2_sections(text: Column) -> Column:
    """Parts that begin with a second-level heading, trimmed, those over SHORTEST_SECTION characters."""
    return F.filter(F.transform(F.split(text, r"\n(?=##\s)"), strip), lambda s: F.length(s) > SHORTEST_SECTION)


def merged_sections(sections: Column) -> Column:
    """Greedy merge of an array of sections, as an array of chunks.

    Blank ones are skipped; an overview and a section of LARGE characters or more stand alone; others join the open
    group unless it would pass TARGET or has SECTIONS already, and holds LEAST characters at least.
    """
    text = "array<string>"
    state = F.struct(F.array().cast(text).alias("done"), F.array().cast(text).alias("open"), F.lit(0).alias("size"))
    closed = lambda s: F.when(F.size(s["open"]) > 0, F.array_append(s["done"], F.array_join(s["open"], "\n\n"))).otherwise(s["done"])
    made = lambda done, group, size: F.struct(done.alias("done"), group.alias("open"), size.cast("int").alias("size"))

    def step(s: Column, x: Column) -> Column:
        n = F.length(x)
        alone = x.startswith(OVERVIEW) | (n >= LARGE)
        full = ((s["size"] + n > TARGET) | (F.size(s["open"]) >= SECTIONS)) & (F.size(s["open"]) > 0) & (s["size"] >= LEAST)
        return (
            F.when(n == 0, s)
            .when(alone, made(F.array_append(closed(s), x), F.array().cast(text), F.lit(0)))
            .when(full, made(closed(s), F.array(x), n))
            .otherwise(made(s["done"], F.array_append(s["open"], x), s["size"] + n))
        )

    return F.aggregate(F.transform(sections, strip), state, step, closed)


def acceptable(chunk: Column) -> Column:
    return F.length(chunk).between(LEAST, MOST)


def split_merged(docs: DataFrame, base_url: str = "https://") -> DataFrame:
    """Chunks of merged sections with a compact context; numbered before the size gate, so numbers may have gaps. docs: doc_id, text, code, title, content_type, source."""
    chunks = docs.select("*", merged_sections(h2_sections(F.col("text"))).alias("__chunks"))
    rows = chunks.select("*", F.size("__chunks").alias("total_chunks"), F.posexplode("__chunks").alias("chunk_index", "chunk")).where(acceptable(F.col("chunk")))
    head = compact_context(F.col("code"), F.col("title"), F.col("content_type"), F.col("source"), base_url)
    return rows.select("doc_id", "source", "content_type", "chunk_index", "total_chunks", section_title(F.col("chunk")).alias("section_title"), F.concat_ws("\n\n", F.when(head != "", head), F.col("chunk")).alias("page_content"))


def split_by_headers(docs: DataFrame) -> DataFrame:
    """One chunk for each section, with the long context header."""
    rows = docs.select("*", h2_sections(F.col("text")).alias("__s")).select("*", F.size("__s").alias("total_chunks"), F.posexplode("__s").alias("chunk_index", "chunk"))
    head = context_header(F.col("code"), F.col("title"), F.col("content_type"), F.col("source"))
    return rows.select("doc_id", "source", "content_type", "chunk_index", "total_chunks", section_title(F.col("chunk")).alias("section_title"), F.concat_ws("\n\n", F.when(head != "", head), F.col("chunk")).alias("page_content"))


def sentences(text: Column) -> Column:
    """Default splitter: after . ! ? and white space."""
    cut = lambda c: F.split(c, r"(?<=[.!?])\s+")
    # where a text has plain white space only, its parts have none at their ends once the text has none
    parts = F.when(text.rlike(ODD_SPACE), F.transform(cut(text), strip)).otherwise(cut(F.btrim(text, F.lit(" \t\n\x0b\f\r"))))
    return F.array_remove(parts, "")


def split_sentences(docs: DataFrame, size: int = 3, splitter: Callable[[Column], Column] = sentences, prefix: Column | None = None) -> DataFrame:
    """Windows of so many sentences, without overlap: doc_id, chunk_index, chunk."""
    found = docs.withColumn("__s", splitter(F.col("text")))
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("__s") / size).cast("int") - 1)), lambda i: F.array_join(F.slice("__s", i * size + 1, size), " "))
    # null instead of a filter, which would be evaluated on the text once more
    groups = F.when(F.size("__s") > 0, groups)
    rows = found.select("doc_id", *(["source"] if "source" in docs.columns else []), *([prefix.alias("__p")] if prefix is not None else []), F.posexplode(groups).alias("chunk_index", "chunk"))
    if prefix is not None:
        rows = rows.withColumn("chunk", F.when(F.coalesce(F.col("__p"), F.lit("")) != "", F.concat(F.lit("[Document Context: "), F.col("__p"), F.lit("]\n\n"), F.col("chunk"))).otherwise(F.col("chunk"))).drop("__p")
    return rows


def split_fixed(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Pieces of size characters, each beginning overlap characters before the last one's end."""
    stride = size - overlap
    n = F.length("text")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - overlap) / stride).cast("int") - 1))
    return docs.where(n > 0).select("doc_id", "text", F.explode(starts).alias("chunk_index")).select("doc_id", "chunk_index", F.expr(f"substring(text, chunk_index * {stride} + 1, {size})").alias("chunk"))


def recursive_split(text: str, size: int = 500, overlap: int = 50, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Splits at the coarsest separator there is, finer ones where a part is too long, and packs parts with an overlap of whole parts."""
    used = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(used) + 1 :]
    out: list[str] = []
    packed: list[str] = []

    def pack() -> None:
        if packed and (joined := used.join(packed).strip()):
            out.append(joined)

    for part in text.split(used) if used else list(text):
        if len(part) > size:
            pack()
            packed = []
            out += recursive_split(part, size, overlap, finer) if finer else [part]
            continue
        if packed and len(used.join([*packed, part])) > size:
            pack()
            while packed and (len(used.join(packed)) > overlap or len(used.join([*packed, part])) > size):
                packed.pop(0)
        packed.append(part)
    pack()
    return out


def split_recursive(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """recursive_split by document: doc_id, chunk_index, chunk."""
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, i, c) for d, t in zip(f["doc_id"], f["text"]) for i, c in enumerate(recursive_split(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "chunk"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, chunk_index int, chunk string")


def route(docs: DataFrame, summary: Callable[[Column], Column] | None = None) -> DataFrame:
    """Chunks by content type: pdf by sentences, scraped_web by merged headings, others as they are: doc_id, content_type, source, chunk_index, page_content."""
    prefix = summary(F.substring("text", 1, SUMMARY_FROM)) if summary else None
    pdf = split_sentences(docs.where("content_type = 'pdf'"), 3, prefix=prefix).select("doc_id", F.lit("pdf").alias("content_type"), "source", "chunk_index", F.col("chunk").alias("page_content"))
    web = split_merged(docs.where("content_type = 'scraped_web'")).select("doc_id", "content_type", "source", "chunk_index", "page_content")
    rest = docs.where("content_type is null or content_type not in ('pdf', 'scraped_web')").select("doc_id", "content_type", "source", F.lit(0).alias("chunk_index"), F.col("text").alias("page_content"))
    return pdf.unionByName(web).unionByName(rest)
