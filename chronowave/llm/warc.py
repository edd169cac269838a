"""WARC: a content-addressed archive in two tables, and the records rebuilt from them.

``payloads`` holds every distinct payload once, under its SHA-256; ``records`` holds each record's exact header bytes with
the address of its payload. A record is its header, an empty line, the payload (none for a revisit) and two line ends.
Reading rebuilds every record and parses its bytes; it recomputes both digests and the length from them, and fails on any that
differ from the address or the header.

Defined results: a null payload is empty; of equal payloads the one with the largest id is the response; rows repeated with
one id become as many records (the second and later ones with ``:2`` and so on in their record id), responses where their id is
the largest; null urls leave their header line out; a null id is a response, with a record id made from the row's hash; line
ends inside a url are percent-encoded in the header, and the exact url is stored beside it; an empty table makes an empty
archive. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bit_table, drop_path, drop_tables, in_table, scratch, table, written

#: The base-32 alphabet of RFC 4648, and Spark's digits in base 32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base-32 SHA-1: four groups of 40 bits."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), DIGITS, BASE32)


class Archive(NamedTuple):
    payloads: str
    records: str


#: Header values hold no line ends: a crafted one would begin a header line of its own.
def _one_line(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = 0, date: str | None = None) -> Archive:
    """Write ``path/payloads`` and ``path/records``. Payloads under ``min_revisit`` bytes are never revisited; ``date`` is the
    records' WARC-Date, now unless given.

    Payloads that one row alone has are written by the task that reads them; a bit table of fixed size, filled from the digests
    that repeat, tells them apart. Copies meet by partial aggregation, so a payload of a third of all rows is nobody's task.
    """
    out = Archive(f"{path}/payloads", f"{path}/records")
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    data = F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8")
    named = pages.select(pages[key].alias("key"), pages[url].cast("string").alias("uri"), data.alias("payload"))
    named = named.withColumns({"address": F.unhex(F.sha2("payload", 256)), "payload_bytes": F.length("payload").cast("long")})
    label = F.coalesce(F.col("key").cast("string"), F.concat(F.lit("none-"), F.hex(F.xxhash64("address", "uri"))))
    small = named.select("key", "uri", "address", "payload_bytes", base32_sha1(F.col("payload")).alias("digest"), label.alias("label"))
    place = F.row_number().over(W.partitionBy("label").orderBy("address", "uri"))
    small = written(small.withColumn("place", place), "warc-rows")
    most = F.max(F.struct("key", (-F.col("place")).alias("place"), "label")).alias("owner")
    owners = written(small.groupBy("address").agg(most, F.count(F.lit(1)).alias("times")), "warc-owners")

    bits = bit_table(owners.where("times > 1").select(F.xxhash64("address").alias("h")), "h")
    hashed = named.select("address", "payload", F.xxhash64("address").alias("h"))

    def part(hit: bool) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                yield batch.filter(pa.array(in_table(bits.value, batch.column(2).to_numpy()) == hit))

        return hashed.mapInArrow(run, hashed.schema).select("address", "payload")

    for stored in (part(False), part(True).groupBy("address").agg(F.first("payload").alias("payload"))):
        stored.write.mode("append").option("compression", "zstd").parquet(out.payloads)

    record_id = lambda label, place: F.concat(F.lit("<urn:record:"), label, F.when(place > 1, F.concat(F.lit(":"), place.cast("string"))).otherwise(""), F.lit(">"))
    kind = F.when((F.col("payload_bytes") >= min_revisit) & (F.col("key") != F.col("owner.key")), "revisit")
    records = small.join(owners, "address").withColumn("record_type", F.coalesce(kind, F.lit("response")))
    revisit = F.col("record_type") == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(_one_line(F.col("label")), F.col("place"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _one_line(F.col("uri"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(_one_line(F.col("owner.label")), -F.col("owner.place")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
    ]
    header = F.encode(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")), "UTF-8")
    refers_to = F.when(revisit, F.col("owner.key")).alias("refers_to")
    records.select("key", "uri", "address", revisit.alias("revisit"), refers_to, header.alias("header")).write.option("compression", "zstd").parquet(out.records)
    drop_tables(small, owners)
    return out


def read_payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    """address, payload, with every stored payload held against its address: a corrupt one fails the job."""
    stored = spark.read.parquet(archive.payloads)
    whole = F.unhex(F.sha2("payload", 256)) == F.col("address")
    return stored.select("address", F.when(whole, F.col("payload")).otherwise(F.raise_error(F.lit("payload differs from its digest"))).alias("payload"))


def reconstruct(spark: SparkSession, archive: Archive) -> DataFrame:
    """key, address, refers_to and ``record``, the exact bytes of each record, from headers joined with payloads.

    A revisit has no payload, so only the responses' rows, about one of each payload, meet the payloads.
    """
    headers, end = spark.read.parquet(archive.records), F.lit(b"\r\n\r\n")
    joined = headers.where("NOT revisit").join(read_payloads(spark, archive), "address")
    responses = joined.select("key", "address", "refers_to", F.concat("header", "payload", end).alias("record"))
    return responses.unionByName(headers.where("revisit").select("key", "address", "refers_to", F.concat("header", end).alias("record")))


class Record(NamedTuple):
    fields: dict[str, str]
    body: bytes


def parse(record: bytes) -> Record:
    """The header's fields and the body of one record; raises ValueError where the record isn't whole or differs from its
    digest (a revisit's digest is that of a payload elsewhere)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    n = int(fields["Content-Length"])
    body = rest[:n]
    if first != "WARC/1.1" or len(body) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"{fields.get('WARC-Record-ID')}: a record is cut")
    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode():
        raise ValueError(f"{fields['WARC-Record-ID']}: header and payload differ")
    return Record(fields, body)


def parsed(records: DataFrame) -> DataFrame:
    """address, key, refers_to, record_type, digest and content_length read from the bytes of ``records`` (see
    ``reconstruct``)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [parse(r.as_buffer().to_pybytes()) for r in batch.column(3)]
            kinds, digests = [r.fields["WARC-Type"] for r in found], [r.fields["WARC-Payload-Digest"].removeprefix("sha1:") for r in found]
            columns = [pa.array(kinds, pa.string()), pa.array(digests, pa.string()), pa.array([len(r.body) for r in found], pa.int64())]
            yield pa.record_batch([*batch.columns[:3], *columns], [*batch.schema.names[:3], "record_type", "digest", "content_length"])

    key = records.schema["key"].dataType.simpleString()
    return records.select("address", "key", "refers_to", "record").mapInArrow(run, f"address binary, key {key}, refers_to {key}, record_type string, digest string, content_length long")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    archive = write_archive(table(spark, sf_dir, "pages"), path)
    found = written(parsed(reconstruct(spark, archive)), "warc-parsed")
    drop_path(spark, path)
    # A revisit's length is that of the response it refers to.
    sizes = found.where("record_type = 'response'").groupBy("address").agg(F.first("content_length").alias("payload_bytes"))
    return found.join(sizes, "address").select(F.col("key").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(floor(CAST(('0x' || substr(h, 10 * g + 1, 10)) AS BIGINT) / pow(32, 7 - k)) AS BIGINT) % 32, 1)"
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
s AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, sha256(b) AS a FROM p),
z AS (SELECT page_id, n, max(page_id) OVER (PARTITION BY a) AS o, {" || ".join(_DIGIT.replace("10 * g", str(10 * g)).replace("7 - k", str(7 - k)) for g in range(4) for k in range(8))} AS d FROM s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN page_id = o THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id <> o THEN o END AS refers_to FROM z
"""
