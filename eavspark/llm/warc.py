"""A content-addressed WARC archive.

The archive is two tables. ``payloads`` keeps each distinct payload once, under its
SHA-256. ``headers`` keeps the exact header bytes of each record with the digest of its
payload. A record is joined from the two, byte for byte. A page whose payload another
page has is a revisit, which refers to the record of the smallest page id.
All of it is built-in functions; payload bytes are shuffled once, to be kept once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: RFC 4648, base 32.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: The date that the records carry; a page has none of its own.
DATE = "1970-01-01T00:00:00Z"
#: Controls and separators of lines, which a header's value must not have.
CONTROLS = r"[\x00-\x1f\x7f-\x9f\x{2028}\x{2029}]"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of bytes: 160 bits are 32 digits without padding.

    Each 5 bytes (10 hex digits, 40 bits) are 8 digits; hex goes to a number and its
    5-bit groups through a table of fixed order.
    """
    parts = []
    for k in range(4):
        number = F.conv(F.substring(F.sha1(data), 10 * k + 1, 10), 16, 10).cast("long")
        for shift in range(35, -1, -5):
            digit = F.shiftright(number, shift).bitwiseAND(F.lit(31)).cast("int")
            parts.append(F.substring(F.lit(ALPHABET), digit + 1, F.lit(1)))
    return F.concat(*parts)


def record_uri(page_id: Column) -> Column:
    """A record's id, from its page's: urn:uuid of the MD5."""
    d = F.md5(F.encode(F.concat(F.lit("page:"), page_id.cast("string")), "UTF-8"))
    return F.concat(
        F.lit("<urn:uuid:"), F.substring(d, 1, 8), F.lit("-"), F.substring(d, 9, 4), F.lit("-"), F.substring(d, 13, 4),
        F.lit("-"), F.substring(d, 17, 4), F.lit("-"), F.substring(d, 21, 12), F.lit(">"),
    )


def one_line(value: Column) -> Column:
    """A text with its controls and separators of lines percent-encoded; others come as they are."""
    part = F.regexp_extract_all(value, F.lit(rf"{CONTROLS}|(?:(?!{CONTROLS})[\s\S])+"), F.lit(0))
    return F.when(value.rlike(CONTROLS), F.array_join(F.transform(part, lambda x: F.when(x.rlike(CONTROLS), F.url_encode(x)).otherwise(x)), "")).otherwise(value)


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write the archive of ``pages`` (page_id, url, html).

    Of records with equal payloads of at least ``least`` bytes, the one with the
    smallest page_id is a response and the others revisit it; a null page_id comes after all
    others. A null html is an empty payload, a null url an empty target. Repeated page
    ids are records of their own, and only one row of a repeated smallest id is the
    response. Controls and separators of lines in a url are percent-encoded, so a header's lines are its own. An empty
    table gives an empty archive. Other columns are ignored.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), body.alias("body"))
    # The bytes are kept once a digest; Spark keeps one of each task before it shuffles.
    rows.select(F.sha2("body", 256).alias("digest"), "body").groupBy("digest").agg(F.first("body").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")

    slim = rows.select("page_id", "url", F.sha2("body", 256).alias("digest"), base32_sha1(F.col("body")).alias("sha1"), F.octet_length("body").alias("bytes"))
    slim = slim.withColumn("row", F.monotonically_increasing_id())
    place = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page_id"), F.col("row").alias("row"))
    first = slim.groupBy("digest").agg(F.min(place).alias("first"))
    known = slim.join(first, "digest")
    revisit = (F.col("bytes") >= least) & (F.col("row") != F.col("first.row"))
    known = known.withColumn("refers_to", F.when(revisit, F.col("first.page_id"))).withColumn("kind", F.when(revisit, F.lit("revisit")).otherwise("response"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("kind")),
        line("WARC-Record-ID", record_uri(F.coalesce(F.col("page_id").cast("string"), F.lit("")))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", one_line(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(
            F.col("kind") == "revisit",
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", record_uri(F.coalesce(F.col("refers_to").cast("string"), F.lit("")))),
                line("X-Refers-To-Page", F.coalesce(F.col("refers_to").cast("string"), F.lit(""))),
            ),
        ).otherwise(F.lit("")),
        F.when(F.col("page_id").isNotNull(), line("X-Page", F.col("page_id").cast("string"))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(F.col("kind") == "revisit", F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.lit("\r\n"),
    )
    known.select(F.encode(header, "UTF-8").alias("header"), "digest").write.option("compression", "zstd").parquet(f"{path}/headers")


def field(lines: Column, name: str) -> Column:
    """The value of the first of a header's lines that has the name, null where there is none or it is empty."""
    found = F.get(F.filter(lines, lambda x: x.startswith(F.lit(f"{name}: "))), F.lit(0))
    value = F.substring(found, len(name) + 3, 1 << 30)
    return F.when(value != "", value)


def records(spark: SparkSession, path: str) -> DataFrame:
    """The original records, joined: header, digest, payload (of a revisit too; null if the archive lost it), record (bytes of the WARC file)."""
    heads = spark.read.schema("header binary, digest string").parquet(f"{path}/headers")
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    of_revisit = F.decode("header", "UTF-8").contains("\r\nWARC-Type: revisit\r\n")
    end = F.encode(F.lit("\r\n\r\n"), "UTF-8")
    block = F.when(of_revisit, F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return heads.join(stored, "digest", "left").select("header", "digest", "payload", F.concat("header", block, end).alias("record"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Each record put together again, and what it says and is: page_id, payload_bytes, payload_digest, record_type, refers_to, url, verified.

    Headers are parsed from their bytes, line by line; sizes and digests are taken of the payloads' bytes. verified is true
    if the payload is that of its SHA-256 and of the SHA-1 in the header, and the record as long as its header says. A record
    whose payload is lost stays, with null figures, unverified. url is as in the header, with controls percent-encoded.
    """
    body, lines = F.col("payload"), F.split(F.decode("header", "UTF-8"), "\r\n")
    rows = records(spark, path).select(
        "digest", "payload", F.octet_length("header").alias("head"), F.octet_length("record").alias("size"), F.octet_length(body).cast("long").alias("payload_bytes"),
        base32_sha1(body).alias("payload_digest"), F.sha2(body, 256).alias("is"), *[field(lines, name).alias(c) for c, name in FIELDS.items()],
    )
    whole = (F.col("is") == F.col("digest")) & (F.col("said") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & (F.col("size") == F.col("head") + F.col("length").cast("long") + 4)
    return rows.select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "url", F.coalesce(whole, F.lit(False)).alias("verified")
    )


#: Columns that are read from headers.
FIELDS = {"page_id": "X-Page", "record_type": "WARC-Type", "refers_to": "X-Refers-To-Page", "said": "WARC-Payload-Digest", "url": "WARC-Target-URI", "length": "Content-Length"}
