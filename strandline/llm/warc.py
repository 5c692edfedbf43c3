"""A content-addressed web archive.

Tables on shared storage make an archive: `payloads` holds the bytes of each different payload once, under their
SHA-256; `first` and `others` hold the exact header bytes of the records. A record is the join of its header with its
payload. Of equal payloads the record with the largest page id is the response; the others are revisits that refer to
it and have an empty block.

Payloads and the headers of their owners lie in buckets by digest, one for one, so that putting responses together
moves no payload again. The other headers, of which one payload may have any number, join with what the responses'
bytes say, a small row each; adaptive execution may split that join. Reading takes every response's bytes apart again,
recomputes both digests and the length of its block and fails on any that differs from its header or address.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, shared_path

#: Fixed values of the format.
VERSION = "WARC/1.1"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a hexadecimal SHA-1: 40 digits give 32 letters, five digits four of them."""
    letters = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*letters)


@dataclass(frozen=True)
class Archive:
    """The names of an archive's tables in the session's catalog, and where their files are."""

    payloads: str
    first: str
    others: str
    path: str


def bucket_count(size: int, partitions: int, most: int = 100_000) -> int:
    """Buckets for `size` bytes of payloads: a multiple of the shuffle partitions, `most` at most, of 64 MB if that allows."""
    return partitions * max(1, min(-(-size // (partitions * (64 << 20))), most // partitions)) if partitions <= most else most


def _record_id(page_id: Column, target: Column) -> Column:
    h = F.md5(F.concat_ws("|", page_id.cast("string"), F.coalesce(target, F.lit(""))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _uri(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), "[\r\n]", " ")


def _headers(date: str) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    is_revisit = F.col("record_type") == "revisit"
    refers = F.concat(
        line("WARC-Profile", F.lit(REVISIT_PROFILE)),
        line("WARC-Refers-To", _record_id(F.col("owner.page_id"), F.col("owner.url"))),
        line("WARC-Refers-To-Target-URI", _uri(F.col("owner.url"))),
        line("WARC-Refers-To-Date", F.lit(date)),
    )
    return F.concat(
        F.lit(VERSION + END),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _uri(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.when(is_revisit, refers).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(is_revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(END),
    )


def write_archive(pages: DataFrame, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", path: str | None = None, buckets: int | None = None) -> Archive:
    """Archive every row of pages(page_id, url, html); null html is an empty payload.

    Of the records with equal payloads of at least min_revisit_bytes, the one with the largest page id is the
    response and the others are revisits of it; smaller payloads are all responses. Rows that repeat a page id with
    the same payload are the same page: they share its type. A null page id comes before all others. Other columns are
    ignored. An empty table gives an archive without records. There are as many buckets as shuffle
    partitions, or a multiple of them where one would hold more than 64 MB of payloads, up to Spark's limit; beyond that
    they grow, and joins spill.
    """
    spark = pages.sparkSession
    base = path or shared_path(spark, "archive")
    name = f"strandline_{uuid.uuid4().hex}"
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    scanned = pages.select(F.col("page_id"), F.col("url"), html.alias("payload"))
    digests = checkpointed(scanned.select("page_id", "url", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes")))
    size = digests.agg(F.sum("payload_bytes")).first()[0] or 0
    buckets = buckets or bucket_count(size, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", F.coalesce("url", F.lit("")).alias("url"))
    # Written first, so that the join is of two plain exchanges, which the digest of a common page may split.
    owners = checkpointed(digests.groupBy("sha256").agg(F.max(order).alias("owner")))
    typed = digests.join(owners, "sha256").withColumn("payload_digest", base32_of_hex(F.col("sha1")))
    same_page = F.col("page_id").eqNullSafe(F.col("owner.page_id"))
    typed = typed.withColumn("record_type", F.when(same_page | (F.col("payload_bytes") < min_revisit_bytes), "response").otherwise("revisit"))
    is_owner = same_page & (F.coalesce("url", F.lit("")) == F.col("owner.url"))
    records = checkpointed(typed.select("sha256", _headers(date).cast("binary").alias("header"), is_owner.alias("is_owner"), (F.col("record_type") == "response").alias("is_response")))

    def save(df: DataFrame, table: str, keyed: bool) -> str:
        writer = df.write.option("compression", "zstd").option("path", f"{base}/{table}").format("parquet")
        (writer.bucketBy(buckets, "sha256") if keyed else writer).saveAsTable(f"{name}_{table}")
        return f"{name}_{table}"

    # One copy of each payload crosses the network: what shares an address must agree in its other digest and its length. The
    # aggregation's partitions are as the buckets, or each holds some whole ones, so a bucket is one file.
    other = F.struct(F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("bytes"))
    copies = scanned.groupBy(F.sha2("payload", 256).alias("sha256")).agg(F.first("payload").alias("payload"), F.min(other).alias("least"), F.max(other).alias("most"))
    alike = F.when(F.col("least") == F.col("most"), F.col("payload")).otherwise(F.raise_error(F.lit("different payloads share a digest")).cast("binary"))
    payloads = save(copies.select("sha256", alike.alias("payload")), "payloads", True)
    # Rows that repeat the owner have equal headers: one of them is the payload's, the rest are kept beside.
    first = records.filter("is_owner").repartition(buckets, "sha256").groupBy("sha256", "header").agg(F.count("*").alias("rows"))
    first = save(first, "first", True)
    return Archive(payloads, first, save(records.filter("NOT is_owner").select("sha256", "header", "is_response"), "others", False), base)


def _field(name: str) -> Column:
    return F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def responses(spark: SparkSession, archive: Archive) -> DataFrame:
    """The owners' records in full: sha256, rows (how often the record was archived), record (its exact bytes)."""
    both = spark.read.table(archive.first).join(spark.read.table(archive.payloads), "sha256", "left")
    return both.select("sha256", "rows", F.concat("header", F.coalesce("payload", F.lit(b"")), F.lit((END * 2).encode())).alias("record"), F.octet_length("header").alias("at"))


def read_archive(spark: SparkSession, archive: Archive, page_id_type: str = "bigint") -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to. All of it comes from the
    records' own bytes, which are put together and taken apart again; see the module."""
    number = lambda: F.nullif(_field("X-Page-ID"), F.lit("")).cast(page_id_type)
    # A record's block ends before its last four bytes and is as long as its header says.
    whole = responses(spark, archive).withColumn("header", F.expr("substring(record, 1, at)"))
    cut = whole.withColumn("n", _field("Content-Length").cast("int")).withColumn("block", F.expr("substring(record, octet_length(record) - 3 - n, n)"))
    sha1 = base32_of_hex(F.sha1("block"))
    sound = (F.sha2("block", 256) == F.col("sha256")) & (_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("digest"))) & (F.col("n") + F.col("at") + 4 == F.octet_length("record"))
    read = cut.withColumn("digest", sha1).select(
        "sha256", "rows", F.col("n").cast("long").alias("payload_bytes"),
        F.when(F.coalesce(sound, F.lit(False)), F.col("digest")).otherwise(F.raise_error(F.lit("an archived payload is missing or differs from its digest"))).alias("payload_digest"),
        number().alias("page_id"), _field("WARC-Record-ID").alias("record_id"), _field("WARC-Type").alias("record_type"),
    )
    first = checkpointed(read)
    others = spark.read.table(archive.others).select(
        "sha256", number().alias("page_id"), _field("WARC-Type").alias("record_type"), _field("WARC-Payload-Digest").alias("claimed"), F.nullif(_field("WARC-Refers-To"), F.lit("")).alias("refers"),
    )
    owner = first.select("sha256", "payload_bytes", "payload_digest", F.col("page_id").alias("owner"), "record_id")
    joined = others.join(owner, "sha256", "left")
    sound = (F.col("claimed") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & F.coalesce(F.col("refers") == F.col("record_id"), F.lit(True))
    checked = F.when(F.coalesce(sound, F.lit(False)), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record's payload is missing or not the one it names")))
    rest = joined.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", F.when(F.col("refers").isNotNull(), F.col("owner")).alias("refers_to"))
    copies = first.select("page_id", "payload_bytes", "payload_digest", "record_type", F.explode(F.expr("sequence(1L, rows)")).alias("copy"))
    return copies.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast(page_id_type).alias("refers_to")).unionByName(rest)


def record_bytes(spark: SparkSession, archive: Archive) -> DataFrame:
    """(page_id, record): every record's exact bytes, as an archive file would hold them one after the other."""
    page_id = F.nullif(_field("X-Page-ID"), F.lit("")).alias("page_id")
    end = F.lit((END * 2).encode())
    first = responses(spark, archive).withColumn("header", F.expr("substring(record, 1, at)")).withColumn("copy", F.explode(F.expr("sequence(1L, rows)")))
    others = spark.read.table(archive.others)
    bodies = others.filter("is_response").join(spark.read.table(archive.payloads), "sha256").select(page_id, F.concat("header", "payload", end).alias("record"))
    return first.select(page_id, "record").unionByName(bodies).unionByName(others.filter("NOT is_response").select(page_id, F.concat("header", end).alias("record")))


def archive_round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write an archive of pages and read it back: one row per row of pages. See `write_archive` for odd rows."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return read_archive(pages.sparkSession, write_archive(pages, min_revisit_bytes), kind)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records in the bytes of an archive file, plain or gzipped member by member."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        body = end + 4
        size = int(headers["Content-Length"])
        block = data[body : body + size]
        if len(block) != size or data[body + size : body + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut off")
        yield headers, block
        at = body + size + 4


def sha1_base32(payload: bytes) -> str:
    import base64

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


#: RFC 4648 base32 has no DuckDB function: the digest's letters are picked by arithmetic on hexadecimal groups.
ORACLE_SQL = """
WITH d AS (
  SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), o AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS owner FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM o
"""
