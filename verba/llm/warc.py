"""WARC files and a content-addressed archive of their records.

``write_files`` writes a WARC record for each row: WARC header, HTTP head, payload.
Among records with equal payloads of at least ``least`` bytes, that with the
smallest id is the response and the others are revisits of it, without the
payload's bytes; smaller payloads are all responses.

``ingest`` reads WARC files into an archive, two tables in one folder: ``payloads``
(digest, payload) keeps every payload's bytes once, under their SHA-256, which is
computed anew and must be the one that the record states; ``records`` keeps of every
record its exact head (all bytes before the payload), the digest that it points to
and the SHA-256 of the whole record.  ``rebuilt`` joins the two and gives each
record's exact bytes again; payloads and records are verified against their digests,
and a mismatch fails the job.

A group of copies only meets in grouped minima with partial aggregation over (digest,
id); payload bytes are shuffled once, for the join that rebuilds records, which
adaptive execution splits.  Files hold ``PER_FILE`` records at most and are parsed as
a stream.

Defined results: a null payload is empty; a null url has no target header, and CR or
LF in a url are percent-encoded in the header; rows with a null id are responses;
rows that repeat the response's id are responses too; a very long payload is a record
like others; an empty table makes an archive without records.  Extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verba.llm.common import Scratch, ceil_div, plainly, small

END = "\r\n"
#: The capture time is not known; records carry this one.
DATE = "1970-01-01T00:00:00Z"
#: Records of a WARC file at most, and bytes of records that a task parses at once.
PER_FILE, PARSED_BYTES = 4096, 8 << 20
RECORD_SCHEMA = "head binary, payload binary, payload_digest string, record_digest string"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value)


def record_id(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), key.cast("string"), F.lit(">"))


def header(again: Column, key: Column, url: Column, digest: Column, refers: Column, size: Column) -> Column:
    """A record's bytes before its payload: WARC header, empty line, HTTP head, empty line."""
    target = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), size.cast("string"), F.lit(END * 2))
    warc = F.concat_ws(
        END, F.lit("WARC/1.1"), _line("WARC-Type", F.when(again, "revisit").otherwise("response")), _line("WARC-Target-URI", target), _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Record-ID", record_id(key)), _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)), _line("WARC-Refers-To", F.when(again, record_id(refers))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http;msgtype=response"), _line("Content-Length", (F.octet_length(http) + F.when(again, 0).otherwise(size)).cast("string")),
    )
    return F.concat(warc, F.lit(END * 2), http)


def write_files(pages: DataFrame, path: str, least: int = 100, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write a WARC record for each row to gzip files below ``path``; payloads are neither shuffled nor sorted."""
    empty = F.lit("").cast("binary")
    rows = pages.select(F.col(id_col).alias("key"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), empty).alias("payload"))
    rows = rows.withColumns({"sum": F.sha2("payload", 256), "n": F.octet_length("payload").cast("long")})
    # digests that records of several rows share, with the response's id
    first = rows.where(F.col("n") >= least).groupBy(F.unhex("sum").alias("same")).agg(F.min("key").alias("first"), F.count("*").alias("c")).where("c > 1").select("same", "first")
    total = rows.count()
    first, _ = small(Scratch(pages.sparkSession, "copies").keep(first, "first", total), 300_000)
    named = rows.join(first, F.unhex("sum") == F.col("same"), "left")
    again = F.coalesce(F.col("key") > F.col("first"), F.lit(False))
    head = header(again, F.coalesce(F.col("key").cast("string"), F.lit("none")), F.col("url"), F.col("sum"), F.col("first"), F.col("n"))
    text = F.concat(head, F.when(again, F.lit("")).otherwise(F.col("payload").cast("string")))
    out = named.select(text.alias("value")).coalesce(max(1, ceil_div(total, PER_FILE)))
    out.write.mode("overwrite").options(**plainly(path)).option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).text(path)


# --------------------------------------------------------------------------
# reading


class Reader:
    """Records of a WARC file's bytes, which come in pieces: (head, payload) by Content-Length."""

    def __init__(self):
        self.held = bytearray()

    def feed(self, data: bytes):
        self.held += data
        at = 0
        while True:
            end = self.held.find(b"\r\n\r\n", at)
            if end < 0:
                break
            if not self.held.startswith(b"WARC/", at):
                raise ValueError("no record where one should begin")
            length = _field(bytes(self.held[at:end]), b"content-length")
            if length is None:
                raise ValueError("a record without length")
            stop = end + 4 + int(length)
            if len(self.held) < stop + 4:
                break
            if self.held[stop : stop + 4] != b"\r\n\r\n":
                raise ValueError("a record of another length than it states")
            cut = self.held.find(b"\r\n\r\n", end + 4, stop)
            cut = stop if cut < 0 else cut + 4
            yield bytes(self.held[at:cut]), bytes(self.held[cut:stop])
            at = stop + 4
        del self.held[:at]

    def close(self) -> None:
        if self.held:
            raise ValueError("the last record is cut")


def _field(head: bytes, name: bytes) -> bytes | None:
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        if k.strip().lower() == name:
            return v.strip()
    return None


def parse_records(data: bytes, piece: int = 1 << 20):
    """(head, payload) of each record of a file's bytes, gzip or plain."""
    packed = data[:2] == b"\x1f\x8b"
    reader, un = Reader(), zlib.decompressobj(31)
    for at in range(0, len(data), piece):
        part = data[at : at + piece]
        if not packed:
            yield from reader.feed(part)
            continue
        while part:
            yield from reader.feed(un.decompress(part, piece))
            part = un.unconsumed_tail
            if un.eof:  # files may have a member for each record
                part, un = un.unused_data, zlib.decompressobj(31)
    if packed:
        yield from reader.feed(un.flush())
    reader.close()


def _parse(batches):
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]

    def batch(rows):
        kinds = (pa.binary(), pa.binary(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for b in batches:
        for data in b.column(0):
            rows, size = [], 0
            for head, payload in parse_records(data.as_buffer().to_pybytes()):
                record = hashlib.sha256(head)
                record.update(payload)
                record.update(b"\r\n\r\n")
                again = b"\r\nWARC-Type: revisit\r\n" in head[: head.find(b"\r\n\r\n") + 2]
                rows.append((head, None if again else payload, None if again else hashlib.sha256(payload).hexdigest(), record.hexdigest()))
                size += len(head) + len(payload)
                if size >= PARSED_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(head, payload, payload_digest, record_digest) of the records of WARC files; revisits have no payload."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse, RECORD_SCHEMA)


def _named(text: Column, name: str) -> Column:
    """A header field's value; null if the block lacks it."""
    got = F.regexp_extract(text, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    return F.when(got != "", got)


def ingest(spark: SparkSession, files: str, path: str) -> None:
    """Read WARC files into the tables ``records`` and ``payloads`` below ``path``."""
    read = read_files(spark, files)
    said = F.regexp_replace(_named(F.col("head").cast("string"), "WARC-Payload-Digest"), "^sha256:", "")
    wrong = (F.col("payload_digest") != said) | said.isNull()
    digest = F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.lit("a payload does not have the digest that its record states")).cast("string")).otherwise(said)
    read = read.select("head", digest.alias("digest"), "record_digest", "payload")
    read.select("head", "digest", "record_digest", F.col("payload").isNotNull().alias("whole")).write.mode("overwrite").options(**plainly(path)).option("compression", "zstd").parquet(f"{path}/records")
    # equal payloads of several responses meet; the others go straight to the store
    several = spark.read.parquet(f"{path}/records").where("whole").groupBy("digest").agg(F.count("*").alias("c")).where("c > 1").select("digest")
    several, _ = small(several, 300_000)
    held = read.where("payload is not null").select("digest", "payload")
    once = held.join(several, "digest", "left_anti")
    met = held.join(several, "digest", "left_semi").groupBy("digest").agg(F.any_value("payload").alias("payload"))
    once.unionByName(met).write.mode("overwrite").options(**plainly(path)).option("compression", "zstd").parquet(f"{path}/payloads")


def rebuilt(spark: SparkSession, path: str) -> DataFrame:
    """(head, digest, payload, record) of every record of an archive, verified; a revisit's payload is the one it refers to."""
    store = spark.read.parquet(f"{path}/payloads")
    good = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not have digest "), F.col("digest"))).cast("binary"))
    rows = spark.read.parquet(f"{path}/records").join(store.select("digest", good.alias("payload")), "digest")
    record = F.concat(F.col("head"), F.when(F.col("whole"), F.col("payload")).otherwise(F.lit("").cast("binary")), F.lit(END * 2).cast("binary"))
    rows = rows.withColumn("record", record)
    same = F.when(F.sha2("record", 256) == F.col("record_digest"), F.col("record")).otherwise(F.raise_error(F.lit("a rebuilt record differs from the one that was read")).cast("binary"))
    return rows.select("head", "digest", "payload", same.alias("record"))


def described(records: DataFrame) -> DataFrame:
    """What records that were rebuilt say: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    rows = records.withColumn("warc", F.substring_index(F.col("record").cast("string"), END * 2, 1))
    page = lambda name: F.regexp_extract(F.coalesce(_named(F.col("warc"), name), F.lit("")), r"^<urn:page:(-?[0-9]+)>$", 1)
    number = lambda x: F.when(x != "", x.cast("long"))
    return rows.select(
        number(page("WARC-Record-ID")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.regexp_replace(_named(F.col("warc"), "WARC-Payload-Digest"), "^sha256:", "").alias("payload_digest"),
        _named(F.col("warc"), "WARC-Type").alias("record_type"), number(page("WARC-Refers-To")).alias("refers_to"),
    )
