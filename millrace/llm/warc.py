"""WARC archives: writing, and reading with a verified chain of record boundaries.

``write`` deduplicates payloads: of equal ones of at least ``least`` bytes the record with the largest page_id is a
response, the others are revisits that refer to it. Records go out by Spark's text writer (a record is UTF-8 text that
ends in a line break), so the committer of the job makes them appear whole or not at all.

``read`` splits files at the magic line wherever it stands. Each piece is a candidate: its header's Content-Length gives
the offset where the next record must begin. From the start of every file, pointer jumping (successors doubled each
round) keeps the candidates that are reachable; magic inside a payload is not, and its piece is part of the record it
stands in.

Edge cases: null html is an empty payload; a null url writes no target URI; line breaks in a url are percent-encoded;
rows that repeat a page_id with the same payload are all responses if the page_id is the largest; a null page_id sorts first and
is written as such; very long payloads are written and read whole; an empty table makes archives without records; further
columns, whatever their names, are ignored. A file that doesn't begin with a record, or a broken chain, yields the records up
to the break; strict reading raises Broken instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch, stored
from .common import bit_table, maybe_in, need

MAGIC = "WARC/1.0\r\n"
LEAST_BYTES = 1000
SALTS = 16
#: Rows in an archive file at most.
FILE_ROWS = 20_000
#: Dates are a parameter; the fixed one keeps archives reproducible.
DATE = "2024-01-01T00:00:00Z"


def marked(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest and, for revisits, refers_to."""
    need(pages, "page_id", "url", "html")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))
    large = pages.select("page_id", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("p")).where(F.octet_length("p") >= least)
    groups = large.groupBy(F.sha1(F.col("p").cast("binary")).alias("payload_digest")).agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = stored(groups.select("payload_digest", "last"), "warc-groups")
    # payloads that surely occur once aren't shuffled
    known = maybe_in(rows, "payload_digest", bit_table(groups.select("payload_digest")))
    salted = known.where("__maybe").withColumn("__salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["payload_digest", "__salt"], "left").select(*rows.columns, "last")
    every = joined.unionByName(known.where("not __maybe").select(*rows.columns, F.lit(None).cast(dict(rows.dtypes)["page_id"]).alias("last")))
    return every.select(*rows.columns, F.when(~F.col("last").eqNullSafe(F.col("page_id")), F.col("last")).alias("refers_to")).select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")


def urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def record(date: str = DATE) -> Column:
    """A record's text without its last line break, which the writer adds."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), "^\\s+|\\s+$", "")
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), url)),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("refers_to")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(head, F.lit("\r\n\r\n"), block, F.lit("\r\n\r"))


def write(pages: DataFrame, path: str, least: int = LEAST_BYTES, compression: str = "gzip") -> str:
    """Writes the archives as text files of at most FILE_ROWS records below path; read() takes them compressed or not."""
    marked(pages, least).select(record().alias("value")).write.option("maxRecordsPerFile", FILE_ROWS).option("compression", compression).text(path)
    return path


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """file, block (the start of the part of it that a task read), n (order within the block) and body of all that stands between magic lines."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("body")
    )


def header(name: str, head: Column) -> Column:
    found = F.regexp_extract(head, rf"(?im)^{name}: *([^\r\n]*)", 1)
    return F.when(found != "", found)


def parsed() -> dict[str, Column]:
    """What one body says if it is a whole record; payload columns hold then, and only then."""
    body = F.col("body")
    head = F.substring_index(body, "\r\n\r\n", 1)
    whole = F.locate("\r\n\r\n", body) > 0
    block = F.substr(body, F.length(head) + 5)
    http = F.when(F.coalesce(header("Content-Type", head), F.lit("")).startswith("application/http"), F.substring_index(block, "\r\n\r\n", 1))
    rest = F.when(http.isNull(), block).otherwise(F.substr(block, F.length(http) + 5))
    payload = F.substr(rest, F.lit(1), F.greatest(F.length(rest) - 4, F.lit(0)))
    return {
        "head_bytes": F.when(whole, F.octet_length(head) + 4),
        "content_length": header("Content-Length", head).cast("bigint"),
        "record_type": header("WARC-Type", head),
        "record_id": header("WARC-Record-ID", head),
        "refers_to": header("WARC-Refers-To", head),
        "url": header("WARC-Target-URI", head),
        "stated_digest": F.regexp_extract(F.coalesce(header("WARC-Payload-Digest", head), F.lit("")), r"^sha1:(.*)$", 1),
        "http_length": header("Content-Length", http).cast("bigint"),
        "payload": payload,
    }


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every piece with its offset (at), its end, and where the successor of the record begins that its header states (next; null: no header).

    Within a block of a file pieces come in order, so their offsets are running sums; blocks add up in the same way.
    Bodies stay behind: a piece's payload is digested where it is read.
    """
    columns = parsed()
    payload = columns.pop("payload")
    pieces = scanned(spark, path).select(
        "file", "block", "n", (F.octet_length("body") + len(MAGIC)).cast("bigint").alias("size"), *(c.alias(k) for k, c in columns.items()), F.octet_length(payload).cast("bigint").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("payload_digest")
    )
    pieces = stored(pieces, "warc-pieces")
    in_block = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = pieces.groupBy("file", "block").agg(F.sum("size").alias("size"))
    starts = blocks.select("file", "block", F.coalesce(F.sum("size").over(in_file), F.lit(0)).alias("start"))
    placed = pieces.withColumn("from", F.coalesce(F.sum("size").over(in_block), F.lit(0))).join(starts, ["file", "block"])
    # a body follows its magic, so that of the piece before the first magic would begin before the file
    at = F.col("start") + F.col("from") - len(MAGIC)
    return placed.withColumn("at", at).withColumn("end", at + F.col("size")).withColumn("next", at + len(MAGIC) + F.col("head_bytes") + F.col("content_length") + 4).drop("start", "from")


def reachable(links: DataFrame) -> DataFrame:
    """file and at of the candidates (file, at, next) that a chain from offset 0 reaches, by pointer jumping."""
    jump = links.where("next is not null").select("file", "at", "next")
    kept = stored(links.where("at = 0").select("file", "at"), "warc-kept")
    n = kept.count()
    while n:
        grown = kept.join(jump, ["file", "at"]).select("file", F.col("next").alias("at")).unionByName(kept).distinct()
        kept = stored(grown, "warc-kept")
        total = kept.count()
        if total == n:
            break
        n = total
        # twice as far: successors of successors; chains that end drop out
        further = jump.alias("a").join(jump.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.next") == F.col("b.at")))
        jump = stored(further.select("a.file", "a.at", "b.next"), "warc-jump")
    return kept


class Broken(ValueError):
    """Archives whose chain of records ends before the file does."""


def read(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """The records of the archives below path, all of them if strict: file, at, record_type, record_id, refers_to, url, payload_bytes and payload_digest (of a revisit as stated, else as read)."""
    found = stored(candidates(spark, path), "warc-candidates")
    starts = reachable(found.select("file", "at", "next"))
    true = found.where("next is not null").join(starts, ["file", "at"], "left_semi")
    if strict:
        ends = found.groupBy("file").agg(F.max("end").alias("end")).join(true.groupBy("file").agg(F.max("next").alias("reached")), "file", "left")
        bad = ends.where("end > 0 and (reached is null or reached != end)")
        if n := bad.count():
            raise Broken(f"{n} archives end before their chain does, such as {bad.first().file}")
    whole = true.where("end = next")
    records = whole.select("file", "at", *COLUMNS, "stated_digest", "http_length", "payload_bytes", "payload_digest")
    broken = true.where("end < next")
    if not broken.isEmpty():  # magic in payloads: put their pieces together again
        records = records.unionByName(joined(spark, path, found, broken))
    revisit = F.col("record_type") == "revisit"
    return records.select(
        "file",
        "at",
        *COLUMNS,
        F.when(revisit, F.col("http_length")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
    )


COLUMNS = ("record_type", "record_id", "refers_to", "url")


def joined(spark: SparkSession, path: str, found: DataFrame, broken: DataFrame) -> DataFrame:
    """Whole records of those that span several pieces: a piece belongs to the last true start before it."""
    spans = broken.select("file", "at", F.col("at").alias("record_at"), F.col("next").alias("record_end"))
    marks = found.select("file", "block", "n", "at").join(spans, ["file", "at"], "left")
    last = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owned = marks.withColumn("owner", F.last("record_at", True).over(last)).withColumn("until", F.last("record_end", True).over(last)).where("at < until")
    first = Window.partitionBy("file", "block")
    place = owned.join(found.groupBy("file", "block").agg(F.min("n").alias("first")), ["file", "block"]).select("file", "block", (F.col("n") - F.col("first")).alias("i"), "owner", "at")
    bodies = scanned(spark, path).withColumn("i", F.col("n") - F.min("n").over(first)).drop("n")
    parts = bodies.join(place, ["file", "block", "i"]).groupBy("file", F.col("owner").alias("at")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]), MAGIC).alias("body"))
    columns = parsed()
    payload = columns["payload"]
    return parts.select("file", "at", *(columns[k].alias(k) for k in COLUMNS), columns["stated_digest"].alias("stated_digest"), columns["http_length"].alias("http_length"), F.octet_length(payload).cast("bigint").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("payload_digest"))


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    kind = dict(pages.dtypes)["page_id"]
    records = read(spark, write(pages, scratch(spark, "warc")), strict=True)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(.*)>$", 1)
    page = number(F.col("record_id"))
    return records.select(F.when(page != "null", page).cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).cast(kind).alias("refers_to"))
