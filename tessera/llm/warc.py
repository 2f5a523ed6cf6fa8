"""Content-addressed WARC archive.

An archive is a folder with two parts: ``headers`` holds the exact WARC header block of every record
(text files whose records end with the empty line that ends a header), ``payloads`` holds each
distinct payload once under its SHA-256. Records are put together again by a join on the digest, and
a payload counts only after its digest has been computed anew from the stored bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Payloads of fewer bytes are always written as responses.
REVISIT_BYTES = 100
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _page_urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _header(date: str) -> Column:
    """The record's header block without the empty line that ends it. Line breaks inside a URL are
    percent-encoded, so that a header never holds an empty line."""
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("record_type") == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _page_urn(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),  # null without a URL, and left out then
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _page_urn(F.col("refers_to")))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, 0).otherwise(F.col("size")).cast("string")),
    ]
    return F.concat_ws("\r\n", *lines)


def write_archive(spark: SparkSession, pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url",
                  html: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Archive a record for each row of ``pages`` under ``path``; ``page_id`` must be an integer.

    Of records with equal payloads of at least ``REVISIT_BYTES`` the one of the smallest page id is
    the response and the others revisit it; smaller ones are all responses. A null payload is empty; a
    null id is written as an empty one and never chosen while its payload has a record with an id;
    rows that repeat the response's id are responses as well. Other columns are not archived.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    small = materialize(spark, rows.drop("payload"), "warc-digests")
    holders = small.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("low"), F.max("size").alias("high"))
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "n")).alias("f")
    first = holders.groupBy("digest").agg(least, F.min("low").alias("low"), F.max("high").alias("high"))
    differ = F.raise_error(F.lit("payloads of one digest differ"))
    first = materialize(spark, first.select("digest", F.when(F.col("low") == F.col("high"), F.col("f.page_id")).otherwise(differ.cast("long")).alias("first"),
                                            (F.col("f.n") > 1).alias("twice")), "warc-first")
    # each payload once. What is left out is written beforehand, so Spark knows its size: while it is small the
    # payloads are not shuffled, else they are, by page, which no payload makes hot
    others = holders.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
    others = materialize(spark, others.select(F.col("digest").alias("d"), F.col("page_id").alias("p")), "warc-others")
    twice = materialize(spark, first.where("twice").select(F.col("digest").alias("d")), "warc-twice")
    alone = rows.join(others, (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p")), "left_anti")
    store = alone.join(twice, F.col("digest") == F.col("d"), "left_anti").select("digest", "payload")
    if not twice.isEmpty():  # the page that holds the payload has repeated rows
        store = store.unionByName(alone.join(twice, F.col("digest") == F.col("d"), "left_semi").select("digest", "payload").dropDuplicates(["digest"]))
    store.write.parquet(f"{path}/payloads")
    revisit = (F.col("size") >= REVISIT_BYTES) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    records = small.join(first.drop("twice"), "digest").select("*", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))
    records.select(_header(date).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(f"{path}/headers")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, record_type, refers_to, url, digest, size, header)`` of the archive's records."""
    lines = spark.read.option("lineSep", END).text(f"{path}/headers").withColumnRenamed("value", "header")

    def value(name: str, pattern: str) -> Column:
        found = F.regexp_extract("header", rf"\r\n{name}: {pattern}(\r\n|$)", 1)
        return F.when(found != "", found)

    return lines.select(value("WARC-Record-ID", "<urn:page:(-?[0-9]*)>").cast("long").alias("page_id"), value("WARC-Type", "([a-z]+)").alias("record_type"),
                        value("WARC-Refers-To", "<urn:page:(-?[0-9]*)>").cast("long").alias("refers_to"), value("WARC-Target-URI", "([^\r\n]*)").alias("url"),
                        value("WARC-Payload-Digest", "sha256:([0-9a-f]{64})").alias("digest"), value("Content-Length", "([0-9]+)").cast("long").alias("size"), "header")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``(digest, payload)`` of the store; a payload whose bytes do not have its digest is an error."""
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    actual = F.sha2("payload", 256)
    return stored.select(F.when(actual == F.col("digest"), actual).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "digest"))).alias("digest"), "payload")


def verified_records(spark: SparkSession, path: str) -> DataFrame:
    """The archive's headers with ``payload_bytes`` and ``payload_digest`` as computed from the stored
    payload; the bytes themselves stay in the scan that verifies them and are not joined."""
    checked = read_payloads(spark, path).select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"))
    out = read_headers(spark, path).join(checked, "digest", "left")
    lost = F.raise_error(F.concat(F.lit("no payload for "), F.coalesce("digest", F.lit("a record without digest"))))
    short = (F.col("record_type") == "response") & (F.col("size") != F.col("payload_bytes"))
    n = F.when(F.col("payload_bytes").isNull() | short, lost.cast("long")).otherwise(F.col("payload_bytes"))
    return out.withColumn("payload_bytes", n).withColumn("payload_digest", F.col("digest"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, record_type, header, payload, record, refers_to)``: the original payload of every
    record, revisits included, and ``record``, the exact bytes of the WARC record (a revisit has no
    block). A record without its payload, or with one of another length, is an error."""
    out = read_headers(spark, path).join(read_payloads(spark, path), "digest", "left")
    lost = F.raise_error(F.concat(F.lit("no payload for "), F.coalesce("digest", F.lit("a record without digest"))))
    short = (F.col("record_type") == "response") & (F.col("size") != F.octet_length("payload"))
    out = out.withColumn("payload", F.when(F.col("payload").isNull() | short, lost.cast("binary")).otherwise(F.col("payload")))
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    end = F.lit(END.encode())
    return out.select("page_id", "record_type", "header", "payload", F.concat(F.encode("header", "UTF-8"), end, block, end).alias("record"), "refers_to")


def export(spark: SparkSession, path: str, target: str) -> None:
    """Write the archive's records as plain WARC files under ``target``: header, empty line, block and
    two line breaks for each record, in the order of the join."""
    records = reconstruct(spark, path)
    block = F.when(F.col("record_type") == "response", F.decode("payload", "UTF-8")).otherwise(F.lit(""))
    records.select(F.concat("header", F.lit(END), block).alias("value")).write.option("lineSep", END).text(target)
