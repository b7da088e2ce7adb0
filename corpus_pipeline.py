"""A corpus pipeline of five operators: each stage works on what the one before it kept.

Every stage is a function of (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, language_id, line_dedup, near_dedup
from millrace.session import stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the learned languages go: those without a letter (null and empty texts too), and those whose letters are
    no more like any prototype than chance; a few letters say too little and stay. Whole texts count, however long; repeated rows
    are judged alike; further columns are kept; an empty table, and one that teaches no language, give an empty one."""
    return language_id.keep_identified(docs)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sites share go from the texts, but for their first place; documents of which no line is left go too. Null texts and
    texts of blank lines have no line to lose and stay; a null source is a site; repeated rows lose the same lines; long texts and
    lines are taken whole; further columns are kept (n_lines and n_removed too); an empty table gives an empty one."""
    out = line_dedup.dedup(docs)
    lines, removed = out.columns[-2:]
    kept = out.where((F.col(lines) == 0) | (F.col(removed) < F.col(lines))).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: that of the smallest doc_id (null first). Texts without a word are classes of their
    own; of repeated rows (doc_id and text) the one whose other columns are smallest as JSON stays; long texts are taken whole;
    further columns are kept; an empty table gives an empty one."""
    return near_dedup.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, in whatever order, go. Null and short texts hold none; an empty benchmark removes nothing;
    repeated rows go together; long texts are taken whole; further columns are kept; an empty table gives an empty one."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of the text they decode to, for each row: repeated ones too. Null and empty texts have no
    token; long texts are encoded whole; further columns are dropped; an empty table gives an empty one."""
    return bpe.round_trip(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_boilerplate),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("BPE", encode),
]

#: Signatures, tilings and merges have no SQL; tests/llm holds the whole pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
