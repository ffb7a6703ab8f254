"""WARC archives: records with revisits, and a normaliser for archives that are one gzip stream.

`write_archives` writes a record per page into archives whose whole content is a single gzip stream, as some crawlers
do; such a file can only be read from its start. `normalise` inflates each stream once, a piece at a time, writes
every record as a gzip member of its own and beside the archive an index with a line per record. `read_records` then
opens single records at their offsets.

Of pages with equal payloads of at least 1000 bytes the one with the largest page_id is a response and the others are
revisits of it; rows that repeat that page are responses too, and so is every page if all ids of such a group are
null. A null html is an empty payload. A url may be null (no address in the record) and is escaped where it holds
control characters.

Only ids and digests are grouped and joined; a digest that a third of all pages share is counted by partial
aggregation and split by the skew join. Archives are written by the tasks that hold the pages, in files of bounded
size, to names that a repeated task writes again.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, read, scratch_path
from tidemark.llm.files import open_input, open_output
from tidemark.llm.registry import register

#: Payloads from this size on are replaced by revisits.
REVISIT_BYTES = 1000
#: Bytes of records after which the next archive begins.
ARCHIVE_BYTES = 32 << 20
PIECE = 1 << 18
DATE = "2024-01-01T00:00:00Z"
RECORD_SCHEMA = (
    "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"
)


def with_revisits(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null for responses."""
    own = pages.select(
        F.col("page_id").cast("long"),
        "url",
        F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    keys = own.where(F.octet_length("payload") >= revisit_bytes).select("page_id", "digest")
    groups = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    # joined on another form of the digest, so that this join shuffles both sides and can split a hot digest
    groups = groups.select(F.unhex("digest").alias("key"), "refers_to")
    revisits = (
        keys.withColumn("key", F.unhex("digest"))
        .join(groups, "key")
        .where(F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to")))
        .select(F.col("page_id").alias("revisit_id"), F.col("digest").alias("revisit_digest"), "refers_to")
        .distinct()
    )
    same = F.col("page_id").eqNullSafe(F.col("revisit_id")) & (F.col("digest") == F.col("revisit_digest"))
    return own.join(revisits, same, "left").select("page_id", "url", "payload", "digest", "refers_to")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP header of its page and no payload."""
    kind = "response" if refers_to is None else "revisit"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body += payload if refers_to is None else b""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}:{digest}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}:{digest}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows of `with_revisits`; returns (path, records) of each archive."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        rows = (row.values() for batch in batches for row in batch.to_pylist())
        row = next(rows, None)
        while row is not None:
            path, held, n = f"{folder}/part-{part:06d}-{number:04d}.warc.gz", 0, 0
            stream = zlib.compressobj(6, zlib.DEFLATED, 31)
            with open_output(path) as f:
                while row is not None and held < archive_bytes:
                    data = record(*row)
                    f.write(stream.compress(data))
                    held, n, row = held + len(data), n + 1, next(rows, None)
                f.write(stream.flush())
            number += 1
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})

    return map_arrow(pages, write, "path string, records bigint")


def inflate(f: BinaryIO) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, in pieces; a cut file is an error."""
    engine, left, begun = zlib.decompressobj(31), f.read(PIECE), False
    while left:
        begun = True
        yield engine.decompress(left, PIECE)
        if engine.eof:
            left, engine, begun = engine.unused_data or f.read(PIECE), zlib.decompressobj(31), False
        else:
            left = engine.unconsumed_tail or f.read(PIECE)
    if begun:
        yield engine.flush()
        if not engine.eof:
            raise ValueError("the gzip stream ends early")


def fields_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, the whole record) of every record of a WARC stream; holds one record at a time."""
    buffer, at = bytearray(), 0

    def fill() -> bool:
        nonlocal buffer
        piece = next(pieces, None)
        if piece is not None:
            buffer += piece
        return piece is not None

    while True:
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(buffer) - 3)
            if not fill():
                if buffer.strip():
                    raise ValueError("the archive ends within a record")
                return
        fields = fields_of(bytes(buffer[:end]))
        size = end + 4 + int(fields["content-length"]) + 4
        while len(buffer) < size:
            if not fill():
                raise ValueError("the archive ends within a record")
        yield fields, bytes(buffer[:size])
        del buffer[:size]
        at = 0


def normalise(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """Rewrites every archive below `folder` into `target` with a member per record and an index beside it.

    A line of the index: offset, length, type, record id, tab-separated. Returns (path, records).
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                path, offset, lines = f"{target}/{source.rsplit('/', 1)[-1]}", 0, []
                with open_input(source) as f, open_output(path) as out, open_output(path + ".idx") as index:
                    n = 0
                    for fields, data in split_records(inflate(f)):
                        engine = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = engine.compress(data) + engine.flush()
                        out.write(member)
                        lines.append(f"{offset}\t{len(member)}\t{fields['warc-type']}\t{fields['warc-record-id']}\n")
                        offset, n = offset + len(member), n + 1
                        if len(lines) >= 1000:
                            index.write("".join(lines).encode())
                            lines = []
                    index.write("".join(lines).encode())
                yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})

    # only paths and sizes are read here; tasks are cut by size, and each streams its files
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path")
    return map_arrow(files, rewrite, "path string, records bigint")


def parse_member(member: bytes) -> dict:
    """A row of RECORD_SCHEMA from the gzip member of one record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = fields_of(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = fields["warc-record-id"].split(":")[2]
    row = {"page_id": int(page) if page else None, "record_type": fields["warc-type"], "refers_to": None}
    row["url"] = fields.get("warc-target-uri")
    if row["record_type"] == "revisit":
        row["refers_to"] = int(fields["warc-refers-to"].split(":")[2])
        row["payload_bytes"] = int(fields_of(http)["content-length"])
        row["payload_digest"] = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
    else:
        row["payload_bytes"] = len(payload)
        row["payload_digest"] = hashlib.sha1(payload).hexdigest()
    return row


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of normalised archives, each opened at the offset that the index names."""
    schema = pa.schema(
        [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
        + [("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f = None, None
        for batch in batches:
            rows = []
            for index, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if index != path:
                    if f:
                        f.close()
                    path, f = index, open_input(index.removesuffix(".idx"))
                f.seek(offset)
                rows.append(parse_member(f.read(length)))
            yield pa.RecordBatch.from_pylist(rows, schema)
        if f:
            f.close()

    lines = (
        spark.read.schema("offset bigint, length bigint, type string, record string")
        .option("sep", "\t")
        .option("pathGlobFilter", "*.idx")
        .csv(folder)
        .select(F.col("_metadata.file_path").alias("path"), "offset", "length")
    )
    return map_arrow(lines, parse, RECORD_SCHEMA)


def archive_round_trip(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages written as one-stream archives, normalised, and read back: a row of RECORD_SCHEMA for each."""
    spark = pages.sparkSession
    raw, target = scratch_path(spark, "warc-raw"), scratch_path(spark, "warc")
    n = write_archives(with_revisits(pages, revisit_bytes), raw, archive_bytes).agg(F.sum("records")).first()[0]
    if not n:
        return spark.createDataFrame([], RECORD_SCHEMA)
    again = normalise(spark, raw, target).agg(F.sum("records")).first()[0]
    if again != n:
        raise ValueError(f"{n} records written, {again} found again")
    return read_records(spark, target)


@register(
    "op8_warc",
    f"""
    SELECT p.page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
      CASE WHEN strlen(html) >= {REVISIT_BYTES} AND page_id < m THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN strlen(html) >= {REVISIT_BYTES} AND page_id < m THEN m END AS refers_to
    FROM (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS m FROM pages) p""",
)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(read(spark, sf_dir, "pages")).drop("url")
