"""WARC archives, written by Spark's text writer and read back in splits with boundary-chain verification.

Writing: a record is one string; the writer ends each with the record's last line break, so files are plain WARC/1.1.

Reading: every task takes the splits it is given and cuts them at the magic line, wherever that stands. Each piece is a candidate
record; its header gives the offset of the record that would follow. Magic in a payload gives candidates too. The chain of true
records starts at the file's first byte, so candidates that pointer jumping from there does not reach are thrown away: each round
makes four jumps one, and a file of n records takes about log4(n) rounds. Only offsets are joined, never payloads.
"""

from __future__ import annotations

import hashlib
import re
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.llm.columns import read_table
from cuelake.llm.scratch import Scratch

MAGIC = "WARC/1.1\r\n"
#: Records of a file at most, which bounds the rounds that reading takes.
FILE_RECORDS = 4096
#: Numbers that digests are hashed to before pages are shuffled; what is broadcast has at most so many rows.
SIEVE = 1 << 20
_END = "\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of bytes or a string's UTF-8: four numbers of 40 bits, 8 digits each."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(record): a WARC record for each row of ``pages`` (page_id, url, html), without its last line break.

    Null html is an empty payload; a null url is the record's own id. Of equal payloads of at least ``min_revisit_bytes`` bytes the one
    with the smallest page_id is a response and others revisit it; rows that share that id are all responses. The first pages of
    payloads that occur more than once are joined by digest; a payload that very many pages share is a skewed key that adaptive
    execution splits.
    """
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", "url", text.alias("payload"), base32_sha1(text).alias("digest"), F.octet_length(text).alias("size"))
    first = rows.where(F.col("size") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select("digest", "first")
    # most payloads are found once: a table of at most ``SIEVE`` numbers keeps them out of the shuffle
    number = F.pmod(F.xxhash64("digest"), F.lit(SIEVE))
    sieve = F.broadcast(first.select(number.alias("number")).distinct())
    alone = rows.join(sieve, number == F.col("number"), "left_anti").withColumn("first", F.lit(None).cast(pages.schema["page_id"].dataType))
    shared = rows.join(sieve, number == F.col("number"), "left_semi").join(first, "digest", "left")
    joined = alone.unionByName(shared)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("size") >= min_revisit_bytes)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    url = F.coalesce(F.regexp_replace(F.col("url"), "[\\r\\n]", " "), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(_END))
    extra = F.concat(
        F.lit("WARC-Refers-To: "), name(F.col("first")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")
    )
    length = F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("size"))
    return joined.withColumn("revisit", revisit).select(
        F.concat(
            F.lit(f"{MAGIC}WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
            F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")),
            F.lit(f"\r\nWARC-Date: {_DATE}\r\nWARC-Target-URI: "), url,
            F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"),
            F.when(F.col("revisit"), extra).otherwise(""),
            F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit(_END),
            http, F.when(F.col("revisit"), "").otherwise(F.col("payload")), F.lit("\r\n"),
        ).alias("record")
    )


def write(recs: DataFrame, path: str) -> None:
    """Write records to files of at most ``FILE_RECORDS``; an empty table gives files without records or none."""
    recs.write.option("lineSep", "\r\n").option("maxRecordsPerFile", FILE_RECORDS).mode("overwrite").text(path)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, succ, type, id, refers, uri, digest, length, http_bytes, http_length, sum, whole) of each piece that follows a magic line.

    pos: offset of the magic; succ: offset of the record that would follow, null without a header that says so. sum: base32 SHA-1 of
    the payload and whole: that it lies in the piece, no further magic in it.
    """
    value, head = F.col("value"), F.col("head")
    field = lambda name: F.regexp_extract(head, f"(?im)^{re.escape(name)}:[ \\t]*(.*?)[ \\t]*\\r?$", 1)
    pieces = (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(
            value,
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("at"),
            F.octet_length(value).cast("bigint").alias("size"),
            F.when(value.contains(_END), F.substring_index(value, _END, 1)).alias("head"),
        )
    )
    pieces = pieces.withColumns(
        {
            "length": F.expr("try_cast(regexp_extract(head, '(?im)^Content-Length:[ \\\\t]*([0-9]+)[ \\\\t]*\\\\r?$', 1) AS bigint)"),
            "skip": F.octet_length(head) + F.lit(len(_END)),
        }
    )
    body = F.expr("substring(CAST(value AS binary), CAST(skip + 1 AS int), CAST(least(length, size) AS int))")
    pieces = pieces.withColumn("body", F.when(F.col("length").isNotNull(), body))
    http = F.substring_index(F.expr("CAST(substring(body, 1, 65536) AS string)"), _END, 1)
    pieces = pieces.withColumn("http", http).withColumn("http_bytes", F.octet_length("http") + F.lit(len(_END)))
    payload = F.expr("substring(body, CAST(http_bytes + 1 AS int), 2147483647)")
    small = pieces.select(
        "file", "block", "at", "size", "length", "skip", "http_bytes",
        field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("id"), field("WARC-Refers-To").alias("refers"),
        field("WARC-Target-URI").alias("uri"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"),
        F.expr("try_cast(regexp_extract(http, '(?im)^Content-Length:[ \\\\t]*([0-9]+)[ \\\\t]*\\\\r?$', 1) AS bigint)").alias("http_length"),
        base32_sha1(payload).alias("sum"),
        (F.col("skip") + F.col("length") + len(_END) <= F.col("size")).alias("whole"),
    )
    by = Window.partitionBy("file").orderBy("block", "at")
    start = F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = small.withColumn("pos", start - F.lit(len(MAGIC))).where(F.col("pos") >= 0)  # the piece before the first magic is no candidate
    return placed.withColumn("succ", F.col("pos") + len(MAGIC) + F.col("skip") + F.col("length") + len(_END)).drop("block", "at", "size")


def reachable(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(file, pos) of the candidates that the chain from each file's first byte reaches."""
    jump = scratch.save(found.where("succ IS NOT NULL").select("file", "pos", "succ"), "jump-0")
    reach = scratch.save(found.where("pos = 0").select("file", "pos"), "reach-0")
    real = scratch.save(found.select("file", "pos"), "real")
    over = lambda a, b: a.join(b.select("file", F.col("pos").alias("succ"), F.col("succ").alias("next")), ["file", "succ"]).select("file", "pos", F.col("next").alias("succ"))
    step = lambda r, j: r.unionByName(r.join(j, ["file", "pos"]).select("file", F.col("succ").alias("pos")).join(real, ["file", "pos"], "left_semi")).distinct()
    k = 0
    while not jump.isEmpty():
        k += 1
        two = scratch.save(over(jump, jump), f"two-{k}")
        reach = scratch.save(step(step(reach, jump), two), f"reach-{k}")
        jump = scratch.save(over(two, two), f"jump-{k}")
        scratch.drop(f"two-{k}", f"reach-{k - 1}", f"jump-{k - 1}")
    return reach


def _resum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payload sums of records with magic inside, read from their offsets."""
    for batch in batches:
        sums, sizes = [], []
        for file, pos, succ in zip(*(batch.column(k).to_pylist() for k in range(3))):
            store, at = fs.FileSystem.from_uri(file)
            with store.open_input_file(at) as f:
                f.seek(pos)
                block = f.read(succ - pos - len(_END)).split(_END.encode(), 1)[1]
            payload = block.split(_END.encode(), 1)[-1]
            sums.append(b32encode(hashlib.sha1(payload).digest()).decode())
            sizes.append(len(payload))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.string()), pa.array(sizes, pa.int64())], ["file", "pos", "again", "bytes_again"])


def read(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """(file, pos, type, id, refers, uri, digest, payload_bytes, payload_digest, verified) of the true records of archives.

    payload_bytes and payload_digest are measured for responses and taken from the headers of revisits, whose payload is elsewhere.
    verified: a response's measured digest is the one in its header; null for revisits.
    """
    found = scratch.save(candidates(spark, path), "candidates")
    true = scratch.save(found.join(reachable(found, scratch), ["file", "pos"]), "true")
    parted = true.where(~F.col("whole") & (F.col("type") != "revisit")).select("file", "pos", "succ")
    again = parted.mapInArrow(_resum, "file string, pos bigint, again string, bytes_again bigint")
    revisit = F.col("type") == "revisit"
    return true.join(again, ["file", "pos"], "left").select(
        "file", "pos", "type", "id", "refers", "uri", "digest",
        F.when(revisit, F.col("http_length")).otherwise(F.coalesce("bytes_again", F.col("length") - F.col("http_bytes"))).alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(F.coalesce("again", "sum")).alias("payload_digest"),
        F.when(~revisit, F.coalesce("again", "sum") == F.col("digest")).alias("verified"),
    )


def op1_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written as WARC records and read back."""
    scratch = Scratch(spark, "warc")
    write(records(read_table(spark, sf_dir, "pages")), scratch.path("archives"))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) AS bigint)")
    return read(spark, scratch.path("archives"), scratch).select(
        number("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers").alias("refers_to"), "verified"
    )
