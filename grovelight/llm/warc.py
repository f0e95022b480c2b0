"""Operator 4: content-addressed WARC archive.

An archive is two tables. ``payloads`` holds every distinct payload once, under its SHA-256. ``records`` holds each
record's header block, byte for byte, and the address of its payload. Reading joins the two, checks the payload
against its address and against the header's digest and length, and so rebuilds each original record. Among equal
payloads of at least ``min_bytes`` the record of the smallest page id is the response and the others revisit it.

Only addresses and ids are shuffled to find repeated payloads. A bitmap of their addresses, of bounded size, goes to the
tasks: a payload that isn't in it occurs once and is written where it is read, the others are combined by address. An
address of very many records is read in as many slots as it needs, each with a copy of its payload.

Defined cases: a null html is an empty payload; a null url gives no target line; line ends in a url are
percent-encoded; rows repeated with the response's id are responses too, and the payload is still stored once; ids may be
numbers or text (an empty text id reads back as null); a page without an id revisits a page with one, or is a response if there is none; empty tables give empty archives.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, settle

END = "\r\n"
DATE = "2020-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The bitmap of repeated payloads has 64 bits an address within these bounds (2 to 16 MB).
BITS = (24, 27)
#: Records of an address that meet its payload in one slot, about.
SLOT = 10_000


def base32(digest: Column) -> Column:
    """Bare upper-case base32 of a 20-byte digest: 20 bits, so five hex digits, give four letters."""
    hexed = F.hex(digest)
    quads = F.concat(*[F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)])
    return F.translate(F.upper(quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def sha1(payload: Column) -> Column:
    return F.unhex(F.sha1(payload))


def sha256(payload: Column) -> Column:
    return F.unhex(F.sha2(payload, 256))


def record_id(page_id: Column) -> Column:
    """The id as text, percent-encoded where a header line would break."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(page_id.cast("string")), F.lit("")), F.lit(">"))


def slots(copies: Column) -> Column:
    return F.ceil(copies / SLOT).cast("int")


def repeated(rows: DataFrame, addresses: DataFrame) -> DataFrame:
    """``rows`` with ``repeated``: false only where the address occurs once in ``addresses`` (address, copies)."""
    shared = addresses.filter("copies > 1")
    bits = min(max(BITS[0], (64 * shared.count()).bit_length()), BITS[1])
    # The address's first bits as a number from 1, as the bitmap functions count.
    place = F.shiftright(F.conv(F.hex(F.substring("address", 1, 4)), 16, 10).cast("bigint"), 32 - bits) + 1
    bitmap = shared.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    # At most 4,096 rows of 4 KB.
    found = rows.withColumn("bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bitmap), "bucket", "left")
    return found.withColumn("repeated", F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).drop("bucket", "bits")


@dataclass(frozen=True)
class Archive:
    """Paths of an archive's two tables, and the type of its page ids."""

    records: str
    payloads: str
    id_type: str


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = DATE) -> Archive:
    """Write a record for each page to ``path``."""
    payload = F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    keyed = rows.select("page_id", "url", sha256(F.col("payload")).alias("address"), sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    first = settle(keyed.groupBy("address").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")), "addresses")
    decided = keyed.join(first, "address").withColumn("slot", F.pmod(F.xxhash64("page_id", "url"), slots(F.col("copies"))).cast("int"))
    response = (F.col("size") < min_bytes) | F.col("first_id").isNull() | F.coalesce(F.col("page_id") == F.col("first_id"), F.lit(False))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(response, F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))),
        F.when(response, F.lit("")).otherwise(F.concat(line("WARC-Profile", F.lit(REVISIT)), line("WARC-Refers-To", record_id(F.col("first_id"))))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(response, F.col("size")).otherwise(F.lit(0)).cast("string")),
        F.lit(END),
    )
    archive = Archive(f"{path}/records", f"{path}/payloads", pages.schema[id_col].dataType.simpleString())
    decided.select(F.encode(head, "UTF-8").alias("head"), "address", "slot").write.option("compression", "zstd").parquet(archive.records)
    marked = repeated(rows.select(sha256(F.col("payload")).alias("address"), "payload"), first)
    single = marked.filter(~F.col("repeated")).select("address", F.lit(1).alias("slots"), "payload")
    shared = marked.filter("repeated").groupBy("address").agg(slots(F.count("*")).alias("slots"), F.first("payload").alias("payload"))
    single.union(shared).write.option("compression", "zstd").parquet(archive.payloads)
    discard(first)
    return archive


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """(page_id, record_type, refers_to, head, payload): every record with its full payload, checked; a wrong one is an error."""
    text = F.decode(F.col("head"), "UTF-8")
    field = lambda name: F.nullif(F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))
    number = lambda name: F.url_decode(F.nullif(F.regexp_extract(text, rf"\r\n{name}: <urn:page:([^>]*)>\r\n", 1), F.lit(""))).cast(archive.id_type)
    records = spark.read.schema("head binary, address binary, slot int").parquet(archive.records)
    payloads = spark.read.schema("address binary, slots int, payload binary").parquet(archive.payloads)
    sound = payloads.withColumn("digest", base32(sha1(F.col("payload")))).withColumn("address", F.when(sha256(F.col("payload")) == F.col("address"), F.col("address")).otherwise(F.raise_error(F.lit("a payload differs from its address"))))
    joined = records.join(sound.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))), ["address", "slot"])
    right = (field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("digest"))) & ((field("WARC-Type") == "revisit") | (field("Content-Length").cast("long") == F.octet_length("payload")))
    return joined.select(
        number("WARC-Record-ID").alias("page_id"),
        F.when(right, field("WARC-Type")).otherwise(F.raise_error(F.lit("a header differs from its payload"))).alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
        "head",
        "payload",
        F.col("digest").alias("payload_digest"),
    )


def record_bytes(head: Column, payload: Column, record_type: Column) -> Column:
    """The record as it stands in a WARC file."""
    return F.concat(head, F.when(record_type == "response", payload).otherwise(F.lit(b"")), F.lit(b"\r\n\r\n"))
