"""Content-addressed web archive.

Payload bytes are stored once under their SHA-256; record headers are stored apart, exactly as they
are written, and records are rebuilt by joining the two. Of the records with one payload the one
with the largest page id is the response and the others are revisits that name it.

Nulls count as empty payloads, a null URL as an empty one; a line break in a URL is percent-encoded,
as no header line may hold one. Payloads below `min_bytes` are never revisits. Rows that repeat one
page id and payload are records of their own, with record ids of their own; one of them is the
response. A null page id is the smallest. Every read checks each stored payload against its digest
and each rebuilt response against its header, and fails if they differ. Extra columns are left out,
whatever their names.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import shared_folder

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"
#: Fixed value of the format: what a revisit of an equal payload refers to.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a hexadecimal digest whose length is a multiple of 5 bytes."""
    alphabet = F.lit(BASE32)
    quads = []
    for k in range(8):
        value = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        quads += [alphabet.substr(F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*quads)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0, date: str | None = None) -> None:
    """Writes the tables `records`, `payloads` and `headers` of an archive below path; date is the records' WARC-Date, by default now."""
    spark, date = pages.sparkSession, date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    (
        rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("bytes"), base32_of_hex(F.sha1("payload")).alias("sha1"))
        .withColumn("record", F.monotonically_increasing_id())
        .write.parquet(f"{path}/records")
    )
    records = spark.read.parquet(f"{path}/records")
    each = records.groupBy("digest", "page_id").agg(F.max("record").alias("record"), F.count("*").alias("rows"))
    first = each.groupBy("digest").agg(F.max(F.struct("page_id", "record", "rows")).alias("of"))
    first.select("digest", *(F.col(f"of.{a}").alias(b) for a, b in (("page_id", "of_page"), ("record", "of_record"), ("rows", "of_rows")))).write.parquet(f"{path}/owners")
    owners = spark.read.parquet(f"{path}/owners").withColumnRenamed("digest", "of_digest")

    same = F.col("digest") == F.col("of_digest")
    owned = rows.join(owners, same & F.col("page_id").eqNullSafe(F.col("of_page"))).select("digest", "payload", "of_rows")
    if owners.where("of_rows > 1").isEmpty():
        payloads = owned  # no row repeats both id and payload: one row a digest already
    else:
        payloads = owned.where("of_rows = 1").union(owned.where("of_rows > 1").dropDuplicates(["digest"]))
    payloads.select("digest", "payload").write.parquet(f"{path}/payloads")

    revisit = (F.col("bytes") >= min_bytes) & (F.col("record") != F.col("of_record"))
    name = lambda page, record: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), record.cast("string"), F.lit(">"))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"), F.col("record"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("of_page"), F.col("of_record")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
    ]
    header = F.concat(F.concat_ws(END, *lines), F.lit(END + END))
    records.join(owners, same).select("record", "digest", revisit.alias("revisit"), header.alias("header")).write.parquet(f"{path}/headers")


def _field(name: str) -> Column:
    return F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1)


def _page(name: str) -> Column:
    return F.regexp_extract("header", rf"\r\n{name}: <urn:page:(-?\d*):\d+>\r\n", 1).try_cast("long")


def _checked(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads; reading one whose bytes do not have its digest fails."""
    bad = F.concat(F.lit("damaged payload "), F.col("digest"))
    return spark.read.parquet(f"{path}/payloads").withColumn("payload", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(bad).cast("binary")))


def rebuild(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, header and the record's exact bytes; a revisit's block is empty."""
    headers = spark.read.parquet(f"{path}/headers")
    stored = _checked(spark, path).withColumnRenamed("digest", "of_digest")
    whole = lambda block: F.concat(F.col("header").cast("binary"), block, F.lit(END + END).cast("binary")).alias("record")
    read = lambda block: [_page("WARC-Record-ID").alias("page_id"), "digest", "header", whole(block)]
    responses = headers.where("not revisit").join(stored, F.col("digest") == F.col("of_digest")).select(*read(F.col("payload")))
    return responses.union(headers.where("revisit").select(*read(F.lit("").cast("binary"))))


def index(spark: SparkSession, path: str) -> DataFrame:
    """One row per rebuilt record: what its header says, with the size and digest of the payload in its block or, for a revisit, in the response's."""
    rebuilt = rebuild(spark, path)
    block = F.expr("substring(record, octet_length(cast(header as binary)) + 1, octet_length(record) - octet_length(cast(header as binary)) - 4)")
    told = [_page("WARC-Record-ID").alias("page_id"), "digest", _field("WARC-Type").alias("record_type"), _page("WARC-Refers-To").alias("refers_to"), _field("WARC-Target-URI").alias("url"), _field("WARC-Payload-Digest").alias("told"), _field("Content-Length").cast("long").alias("length")]
    parsed = rebuilt.select(*told, F.octet_length(block).cast("long").alias("bytes"), base32_of_hex(F.sha1(block)).alias("sha1"))
    good = (F.col("length") == F.col("bytes")) & ((F.col("record_type") == "revisit") | (F.col("told") == F.concat(F.lit("sha1:"), F.col("sha1"))))
    parsed = parsed.withColumn("sha1", F.when(good, F.col("sha1")).otherwise(F.raise_error(F.concat(F.lit("damaged record of payload "), F.col("digest")))))
    out = ["page_id", F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to", "url"]
    responses = parsed.where("record_type = 'response'").select(*out)
    # a revisit's payload is that under its digest: one small row for each payload
    sizes = _checked(spark, path).select(F.col("digest").alias("of_digest"), F.octet_length("payload").cast("long").alias("of_bytes"), base32_of_hex(F.sha1("payload")).alias("of_sha1"))
    revisits = parsed.where("record_type = 'revisit'").drop("bytes", "sha1").join(sizes, F.col("digest") == F.col("of_digest"))
    same = F.when(F.col("told") == F.concat(F.lit("sha1:"), F.col("of_sha1")), F.col("of_sha1")).otherwise(F.raise_error(F.concat(F.lit("damaged record of payload "), F.col("digest"))))
    return responses.union(revisits.select("page_id", F.col("of_bytes").alias("payload_bytes"), same.alias("payload_digest"), "record_type", "refers_to", "url"))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes an archive of all rows in the shared folder, rebuilds every record and reads what the records say."""
    path = f"{shared_folder(pages.sparkSession)}/archive"
    write(pages, path, min_bytes=min_bytes)
    return index(pages.sparkSession, path)
