"""WARC archives: written with Spark, one gzip member per record, and read back by a splittable reader.

The reader cuts files into byte ranges. A task scans its range for the gzip magic number, decodes the header of
each candidate to see whether a record begins there, and owns the records whose member starts inside the range,
reading on beyond its end where the last one needs it.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewaylens.session import new_path

LEAST_REPEATED = 1000  # bytes of payload from which equal payloads are written once
RANGE_BYTES = 8 << 20
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"  # fixed value
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
DATE = "2024-01-01T00:00:00Z"  # records carry no time of their own
MEMBER_LIMIT = 1 << 24
_BUFFER = 1 << 20


def planned(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, payload, digest, refers_to): of equal payloads of LEAST_REPEATED bytes or more, all but one refer to it.

    The one is the row with the largest id; rows that share it are all responses, and so are rows of a
    payload that has no row with an id. Null html is an empty payload.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"))
    # Short payloads get a key of their own each, so they neither meet nor crowd together.
    alone = F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("digest"))
    key = F.when(F.octet_length("payload") >= LEAST_REPEATED, F.col("digest")).otherwise(alone)
    keyed = rows.withColumn("key", key)
    newest = keyed.where(F.octet_length("payload") >= LEAST_REPEATED).groupBy("key").agg(
        F.max("id").alias("newest"), F.count("*").alias("n")).where("n > 1").select("key", "newest")
    joined = keyed.join(newest, "key", "left")
    refers = F.when(F.col("id").isNull() | (F.col("id") != F.col("newest")), F.col("newest"))
    return joined.select("id", "url", "payload", "digest", refers.alias("refers_to"))


def _record(page, url, payload: bytes, digest: str, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    body = b"" if refers_to is not None else payload
    label = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Date: {DATE}",
            f"WARC-Record-ID: <urn:page:{'none' if page is None else page}:{digest}>",
            f"WARC-Payload-Digest: sha1:{label}", f"X-Payload-Length: {len(payload)}",
            "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    if page is not None:
        head.append(f"X-Page-Id: {page}")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}:{digest}>", f"WARC-Profile: {REVISIT}"]
    return "\r\n".join([*head, "", ""]).encode() + body + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A gzip member, so written that its last byte is zero.

    A member ends in its length, the highest byte last: zero below 16 MiB. A longer record is followed by an empty member,
    which holds no record.
    """
    def packed(data: bytes) -> bytes:
        work = zlib.compressobj(6, zlib.DEFLATED, 31)
        return work.compress(data) + work.flush()

    whole = packed(record)
    return whole if len(record) < MEMBER_LIMIT else whole + packed(b"")


def write_archives(plan: DataFrame, path: str | None = None) -> str:
    """Writes the records of `planned` rows as archives below `path` (a new folder in the shared one), and returns it.

    Spark's own text writer writes them, so a task that is run again replaces what it had written. It ends every row with a
    separator, here the zero byte that a member ends in anyway.
    """
    path = path or new_path(plan.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = (batch.column(c) for c in ("id", "url", "payload", "digest", "refers_to"))
            made, size = [], 0
            for values in zip(*rows):
                one = member(_record(*(v.as_py() for v in values)))
                assert one[-1] == 0
                made.append(one[:-1])
                size += len(one)
                if size >= _BUFFER:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])
                    made, size = [], 0
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    packed = plan.mapInArrow(run, "value binary")
    # The cast keeps the bytes as they are.
    packed.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").text(path)
    return path


def byte_ranges(spark: SparkSession, path: str, size: int = RANGE_BYTES) -> DataFrame:
    """(file, first, past, length) for each range, one partition each; only names and lengths of the files are read.

    The number of partitions is given: rows as small as these would else be put into one.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(size).cast("bigint")))
    cut = listed.where("length > 0").select(F.col("path").alias("file"), starts.alias("first"), "length")
    ranges = listed.agg(F.sum(F.ceil(F.col("length") / size))).first()[0] or 1
    return cut.select("file", "first", F.least(F.col("first") + size, F.col("length")).alias("past"), "length").repartition(int(ranges))


def _opened(file: str) -> pa.NativeFile:
    """A file of the local or of a remote store, by its address."""
    store, name = fs.FileSystem.from_uri(file)
    return store.open_input_file(name)


def _head_of(source: pa.NativeFile, at: int) -> bytes | None:
    """The first decoded bytes of a member at this place; None if none begins here."""
    source.seek(at)
    work = zlib.decompressobj(31)
    try:
        return work.decompress(source.read(4096), 64)
    except zlib.error:
        return None


def _member_at(source: pa.NativeFile, at: int) -> tuple[bytes, int]:
    """The whole content of the member at this place, and where it ends."""
    source.seek(at)
    work, parts, read = zlib.decompressobj(31), [], 0
    while not work.eof:
        data = source.read(1 << 14)
        if not data:
            raise EOFError(f"the member at byte {at} ends early")
        read += len(data)
        parts.append(work.decompress(data))
    return b"".join(parts), at + read - len(work.unused_data)


def records_in(source: pa.NativeFile, first: int, past: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the records whose member starts in the range, whatever bytes look like a start."""
    at, window = first, 64
    while at < past:
        source.seek(at)
        # Two bytes more than the range, so that a number across its end is seen.
        data = source.read(min(window, past - at) + len(MAGIC) - 1)
        place = data.find(MAGIC)
        if place < 0:
            at += max(1, len(data) - len(MAGIC) + 1)
            window = min(2 * window, _BUFFER)
            continue
        at += place
        if at >= past:
            return
        head = _head_of(source, at)
        if head is None or not (head == b"" or head.startswith(b"WARC/1.")):
            at += 1
            continue
        try:
            content, end = _member_at(source, at)
        except (zlib.error, EOFError):
            at += 1  # looked like a start, but was none
            continue
        if content:
            yield at, content
        at, window = end, 64  # the next member mostly follows at once


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    length = int(fields.get("content-length", 0))
    if len(rest) < length:
        raise ValueError("a record is shorter than its length says")
    return fields, rest[:length]


def read_archives(spark: SparkSession, path: str, size: int = RANGE_BYTES, payload: bool = False) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, file, offset[, payload]) of all records.

    A response's digest and length are taken from the payload itself, and a digest that differs from the stored one is an error; those
    of a revisit are what its headers say of the payload that it stands for. An empty folder gives no rows.
    """
    schema = ("page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, "
              "refers_to bigint, file string, offset bigint" + (", payload binary" if payload else ""))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for file, first, past in zip(*(batch.column(c).to_pylist() for c in ("file", "first", "past"))):
                rows, held = [], 0
                with _opened(file) as source:
                    for offset, content in records_in(source, first, past):
                        fields, block = parsed(content)
                        row = (*described(fields, block), file, offset)
                        rows.append((*row, block) if payload else row)
                        held += len(content)
                        if held >= _BUFFER * 8:
                            yield table(rows, types)
                            rows, held = [], 0
                if rows:
                    yield table(rows, types)

    def table(rows: list[tuple], types: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return byte_ranges(spark, path, size).mapInArrow(run, schema)


def described(fields: dict[str, str], block: bytes) -> tuple:
    kind = fields["warc-type"]
    stored = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response":
        digest, length = hashlib.sha1(block).hexdigest(), len(block)
        if digest != stored:
            raise ValueError(f"{fields.get('warc-record-id')}: the payload does not have the digest of its header")
    else:
        digest, length = stored, int(fields["x-payload-length"])
    page = int(fields["x-page-id"]) if "x-page-id" in fields else None
    refers = int(fields["warc-refers-to"].split(":")[2]) if "warc-refers-to" in fields else None
    return page, fields.get("warc-target-uri"), kind, length, digest, refers
