"""WARC archives: writing records, and reading them back by boundary-chain verification.

Writing uses Spark's text writer, whose line separator ends each record. Reading splits archives wherever the record
magic stands, also inside payloads, so large files are read by many tasks. Each piece becomes a candidate record with its
byte offset and the offset of its successor (from the header's length and Content-Length). Runs of candidates whose
successor is the next candidate of the block form segments; pointer jumping over segments, from the start of each file,
keeps those that the chain reaches. Magic inside a payload is never reached. Payloads that hold the magic are put
together again from their pieces, which a second scan finds by their length and 128 bits of hashes: no place of the first scan is used, since
files may be split in another way when executors come or go.

Very long payloads are records like others; pages of equal payload and equal page_id are alike, so ties change nothing. A null payload is empty; a null page_id or URL is written as an empty field and read as null; rows with the same page_id give
one record each, all of them the response if they hold the largest page_id of their payload; an empty table gives an empty archive and
no rows; a file whose chain breaks keeps the records before the break. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.shared import shared_dir, written

MIN_REVISIT = 1000
STRETCH = 1 << 20  # bytes of a file within which pieces meet their records
END = "\r\n\r\n"
MAGIC = "WARC/1.0\r\n"
SEPARATOR = END + MAGIC
# Fixed value: the date of all records, so that equal inputs give equal archives.
DATE = "2024-01-01T00:00:00Z"


def _field(c: Column) -> Column:
    """A header value: line breaks would end it."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\r\n]", " ")


def write_archive(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    """One record per row of (page_id, url, html); equal payloads are stored once and revisited."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(
        "page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"), F.sha1(payload.cast("binary")).alias("digest")
    )
    targets = written(
        rows.filter(F.col("size") >= min_revisit)
        .groupBy("digest")
        .agg(F.max("page_id").alias("target"), F.count("*").alias("copies"))
        .filter("copies > 1 and target is not null")
        .select("digest", "target")
    )
    marked = rows.join(targets, "digest", "left")  # a table of known size: Spark broadcasts it only if small
    revisit = F.col("target").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("target"))
    head = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        _field(F.col("page_id")),
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "),
        _field(F.col("url")),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("target").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\nWARC-Payload-Length: "),
        F.col("size").cast("string"),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.when(revisit, "0").otherwise(F.col("size").cast("string")),
        F.lit(END),
        F.when(revisit, "").otherwise(F.col("payload")),
    )
    marked.select(head.alias("value")).write.option("lineSep", END).text(path)


def _header(name: str) -> Column:
    found = F.regexp_extract("header", rf"(?mi)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", F.trim(found))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """All places where a record may start: file, block, offset, successor, header fields and the payload's digest.

    The digest is null where the piece ends before the payload does.
    """
    pieces = spark.read.option("lineSep", SEPARATOR).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),  # rises with the offset within a block
        "value",
    )
    at = F.instr("value", END)
    pieces = pieces.withColumn("header", F.when(at > 0, F.expr("substring(value, 1, instr(value, '\r\n\r\n') - 1)")))
    head, size = F.octet_length("header") + len(END), _header("Content-Length").try_cast("long")
    body = F.expr("substring(cast(value as binary), cast(head + 1 as int), cast(size as int))")
    whole = F.octet_length("value") >= F.col("head") + F.col("size")
    parsed = pieces.withColumn("head", head.cast("long")).withColumn("size", size).select(
        "file",
        "block",
        "place",
        F.octet_length("value").cast("long").alias("length"),
        "head",
        "size",
        _header("WARC-Type").alias("type"),
        _header("WARC-Record-ID").alias("record_id"),
        _header("WARC-Target-URI").alias("url"),
        _header("WARC-Refers-To").alias("refers"),
        _header("WARC-Payload-Digest").alias("declared"),
        _header("WARC-Payload-Length").alias("declared_size"),
        F.when(whole, F.sha1(body)).alias("digest"),
        F.xxhash64("value").alias("h1"),
        F.xxhash64("value", F.lit(1)).alias("h2"),
    )
    parsed = written(parsed)
    step = F.col("length") + len(SEPARATOR)
    blocks = parsed.groupBy("file", "block").agg(F.sum(step).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "block").orderBy("place")
    text = F.col("base") + F.coalesce(F.sum(step).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        parsed.join(bases, ["file", "block"])
        .withColumn("text", text)
        .withColumn("offset", F.when(F.col("text") == 0, F.lit(0).cast("long")).otherwise(F.col("text") - len(MAGIC)))
        .withColumn("next", F.col("text") + F.col("head") + F.col("size") + len(END))
    )


def reachable(found: DataFrame) -> DataFrame:
    """The candidates that the chain from the start of their file reaches."""
    inside = Window.partitionBy("file", "block").orderBy("offset")
    links = found.withColumn("simple", F.coalesce(F.lead("offset").over(inside) == F.col("next"), F.lit(False)))
    links = written(links)
    landings = links.filter(~F.col("simple") & F.col("next").isNotNull()).select("file", F.col("next").alias("offset"), F.lit(True).alias("landing")).distinct()
    links = links.join(landings, ["file", "offset"], "left")
    opens = F.col("landing").isNotNull() | ~F.coalesce(F.lag("simple").over(inside), F.lit(False))
    links = links.withColumn("opens", opens).withColumn("segment", F.max(F.when(F.col("opens"), F.col("offset"))).over(inside))
    links = written(links)
    segments = links.groupBy("file", "segment").agg(F.max_by("next", "offset").alias("next"))
    jumps = written(segments.join(segments.select("file", F.col("segment").alias("next")), ["file", "next"], "left_semi").select("file", "segment", "next"))
    reached = written(segments.filter("segment = 0").select("file", "segment"))
    while not jumps.isEmpty():
        stepped = reached.join(jumps, ["file", "segment"]).select("file", F.col("next").alias("segment"))
        reached = written(reached.union(stepped).distinct())
        onward = jumps.select("file", F.col("segment").alias("next"), F.col("next").alias("then"))
        jumps = written(jumps.join(onward, ["file", "next"]).select("file", "segment", F.col("then").alias("next")))
    return links.join(reached, ["file", "segment"], "left_semi")


def _joined_payloads(spark: SparkSession, path: str, records: DataFrame, found: DataFrame) -> DataFrame:
    """file, offset and digest of records whose payload holds the magic, from its pieces."""
    stop = F.col("text") + F.col("head") + F.col("size")
    broken = records.filter("digest is null and size is not null").select(
        "file", F.col("offset").alias("owner"), (F.col("text") + F.col("head")).alias("begin"), stop.alias("stop"), F.explode(F.sequence(F.floor(F.col("text") / STRETCH), F.floor(stop / STRETCH))).alias("stretch")
    )
    if broken.isEmpty():
        return None
    # records do not overlap, so a piece has one owner
    pieces = found.select("file", "text", "length", "h1", "h2", F.floor(F.col("text") / STRETCH).alias("stretch"))
    owned = pieces.join(broken, ["file", "stretch"]).filter((F.col("text") < F.col("stop")) & (F.col("text") + F.col("length") + len(SEPARATOR) > F.col("begin")))
    owned = written(owned.drop("stretch"))
    # pieces are found again by what they hold, so this scan may split files in another way than the first
    wanted = written(owned.select("length", "h1", "h2").distinct())
    again = spark.read.option("lineSep", SEPARATOR).text(path).select(
        F.octet_length("value").cast("long").alias("length"), F.xxhash64("value").alias("h1"), F.xxhash64("value", F.lit(1)).alias("h2"), F.col("value").cast("binary").alias("value")
    )
    again = again.join(wanted, ["length", "h1", "h2"], "left_semi").dropDuplicates(["length", "h1", "h2"])
    part = F.expr("substring(concat(value, cast('\r\n\r\nWARC/1.0\r\n' as binary)), cast(greatest(begin - text, 0) + 1 as int), cast(stop - greatest(begin, text) as int))")
    return (
        owned.join(again, ["length", "h1", "h2"])
        .select("file", "owner", "text", part.alias("part"))
        .groupBy("file", "owner")
        .agg(F.array_sort(F.collect_list(F.struct("text", "part"))).alias("parts"))
        .select("file", F.col("owner").alias("offset"), F.sha1(F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x.part))).alias("whole"))
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of each record that the chain reaches."""
    found = written(candidates(spark, path))
    records = reachable(found)
    joined = _joined_payloads(spark, path, records, found)
    if joined is not None:
        records = records.join(joined, ["file", "offset"], "left").withColumn("digest", F.coalesce("digest", "whole"))
    revisit = F.col("type") == "revisit"
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    return records.select(
        number("record_id").alias("page_id"),
        F.when(revisit, F.col("declared_size").try_cast("long")).otherwise(F.col("size")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("declared", "^sha1:", "")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(revisit, number("refers")).alias("refers_to"),
        "url",
        (revisit | (F.concat(F.lit("sha1:"), F.col("digest")) == F.col("declared"))).alias("verified"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to an archive in the shared folder and read it back."""
    path = shared_dir(pages.sparkSession)
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path)
