"""Content-addressed web archive.

Payload bytes are stored once each under their SHA-256; record headers are kept
apart, byte for byte, with the digest of their payload.  Records are rebuilt by
joining both, and every payload is checked against its digest on the way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, shared_dir

#: Smaller payloads are never replaced by a revisit record.
LEAST = 100
#: Fixed parts of the format.
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _record_id(page_id: F.Column) -> F.Column:
    """An id in a header line: what could end the line or the id is written as ``%XX``."""
    plain = F.coalesce(page_id.cast("string"), F.lit("none"))
    for mark in ("%", "\r", "\n", "<", ">"):
        plain = F.replace(plain, F.lit(mark), F.lit(f"%{ord(mark):02X}"))
    return F.concat(F.lit("<urn:page:"), plain, F.lit(">"))


def _page_id(record_id: F.Column) -> F.Column:
    plain = F.regexp_extract(record_id, r"<urn:page:(.*)>", 1)
    for mark in (">", "<", "\n", "\r", "%"):
        plain = F.replace(plain, F.lit(f"%{ord(mark):02X}"), F.lit(mark))
    return plain


def write_archive(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = DATE, least: int = LEAST) -> None:
    """Writes the archive of ``pages`` under ``root``: ``payloads`` (digest, payload)
    and ``headers`` (page_id, digest, header).

    A null body is an empty payload; a null url leaves its header line out.  Of equal
    payloads of at least ``least`` bytes the smallest page_id has the response record
    and the others revisit it; rows repeated with that same page_id are all responses.
    A null page_id counts as larger than any other; where all are null, all are
    responses.  An empty table gives an empty archive.
    """
    rows = pick(pages, page_id=id_col, url=url_col, body=body_col)
    body = F.encode(F.coalesce("body", F.lit("")), "UTF-8")
    rows = rows.select("page_id", "url", body.alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256)))

    # each payload once: equal bytes meet on the map side first, then by digest
    once = rows.groupBy("digest").agg(F.first("payload").alias("payload"))
    once.write.option("compression", "zstd").parquet(f"{root}/payloads")

    # the digest in each row is narrow; payloads take part in the join of reading only
    facts = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("size"))
    owner = facts.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("owner"))
    joined = facts.join(owner, "digest", "left")
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(CRLF))
    optional = lambda when, value: F.when(when, value).otherwise(F.lit(""))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        optional(F.col("url").isNotNull(), line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", "%0A"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.lower(F.hex("digest")))),
        optional(revisit, line("WARC-Refers-To", _record_id(F.col("owner")))),
        optional(revisit, line("WARC-Profile", F.lit(REVISIT_PROFILE))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit(CRLF),
    )
    joined.select("page_id", "digest", header.alias("header")).write.option("compression", "zstd").parquet(f"{root}/headers")


def read_archive(spark: SparkSession, root: str) -> DataFrame:
    """Rebuilds every record: ``page_id, header, payload, record`` and what the records'
    bytes tell: ``payload_digest, payload_bytes, record_type, refers_to``.

    A response's record is its header, its payload and the two line ends that close a
    record; a revisit's has no payload.  ``payload`` is the full payload of either, and
    digest and size are measured on it: on the bytes of the record behind its header for
    a response, and on the bytes of the response that it revisits, which it is joined
    with, for a revisit.  A payload whose bytes don't have the digest that the header
    names, or that is missing, stops the read, and so does a record whose length is not
    that in its header."""
    payloads = spark.read.schema("digest binary, payload binary").parquet(f"{root}/payloads")
    headers = spark.read.parquet(f"{root}/headers")
    joined = headers.join(payloads, "digest", "left")
    end = F.encode(F.lit(CRLF + CRLF), "UTF-8")
    revisit = field("WARC-Type") == "revisit"
    head = F.encode("header", "UTF-8")
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    rows = joined.withColumn("record", F.concat(head, body, end)).withColumn("revisit", revisit)
    # bytes behind the header, and before the record's end
    inside = F.expr("substring(record, octet_length(encode(header, 'UTF-8')) + 1, octet_length(record) - octet_length(encode(header, 'UTF-8')) - 4)")
    rows = rows.withColumn("own", inside)
    size = F.octet_length("own").cast("long")
    whole = F.when(F.col("revisit"), F.col("payload")).otherwise(F.col("own"))
    rows = rows.withColumn("measured", F.concat(F.lit("sha256:"), F.sha2(whole, 256)))
    rows = rows.withColumn(
        "payload_digest",
        F.when(F.col("payload").isNull(), F.raise_error(F.lit("a payload is missing")))
        .when(F.col("measured") != field("WARC-Payload-Digest"), F.raise_error(F.concat(F.lit("damaged payload "), F.hex("digest"))))
        .when(size.cast("string") != field("Content-Length"), F.raise_error(F.lit("a record of another length")))
        .otherwise(F.substring("measured", len("sha256:") + 1, 64)),
    )
    return rows.select(
        "page_id", "header", "payload", "record", "payload_digest", F.octet_length(whole).cast("long").alias("payload_bytes"),
        field("WARC-Type").alias("record_type"), _page_id(field("WARC-Refers-To")).alias("refers_to"),
    )


def field(name: str) -> F.Column:
    """A header field's value, empty where the header lacks it."""
    return F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def archive_round_trip(pages: DataFrame, root: str | None = None, **columns) -> DataFrame:
    """Writes the archive of ``pages`` and reads it back: per page ``page_id,
    payload_bytes, payload_digest, record_type, refers_to``, all taken from the
    rebuilt records.  Without ``root`` it lies in the session's shared folder."""
    spark = pages.sparkSession
    root = root or f"{shared_dir(spark)}/quorial/warc-{uuid.uuid4().hex}"
    write_archive(pages, root, **columns)
    back = read_archive(spark, root)
    kind = back.schema["page_id"].dataType.simpleString()
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", F.expr(f"try_cast(nullif(refers_to, '') as {kind})").alias("refers_to"))
