"""WARC archives: a writer of one gzip member per record, and a splittable reader.

The reader gives tasks byte ranges of the archives. A task scans its range for gzip magic, validates each candidate by
inflating the member's beginning and decoding a WARC version line and headers from it, and owns the records that start
inside its range; it reads the last one to its end, past the range if need be. Payloads are inflated and hashed in pieces.

Equal payloads of at least ``LEAST_PAYLOAD`` bytes are stored once: the row with the largest page_id is the response, the
others are revisits that refer to it.

Edge cases: a null html is an empty payload; a null url is written as an empty URI; a null page_id counts as smaller
than any other and is a record without an id header; rows that repeat the largest page_id with equal payloads are all
responses; an empty table gives no archives and an empty result; other columns are ignored, whatever their names. URLs and
payloads may be of any length. Records of other writers may lack an id or a payload digest (``intact`` is null then) and
need not be HTTP (the payload is the whole block). Payloads count as equal if length and SHA-1 are.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilsift.llm.common import few, mapped, settled
from veilsift.llm.storage import new_folder, opened, own_name

LEAST_PAYLOAD = 1000
MAGIC = b"\x1f\x8b\x08"
PIECE, SPLIT, ROLL, PROBE = 1 << 18, 8 << 20, 512 << 20, 1 << 12
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(ID_SPACE, f'page/{page_id}')}>"


def digest_label(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def record_bytes(page_id: int | None, url: str, payload: bytes, sha1: bytes, response: int | None, revisit: bool) -> Iterator[bytes]:
    """One record: a response with its payload, or a revisit of the page ``response``."""
    block = HTTP if revisit else HTTP + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Target-URI": re.sub(r"[\r\n]", " ", url),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": digest_label(sha1),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if page_id is not None:
        head["WARC-X-Page-ID"] = str(page_id)
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(response)} | ({} if response is None else {"WARC-X-Refers-To-Page": str(response)})
    yield ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode()
    yield block
    yield b"\r\n\r\n"


def member(parts: Iterator[bytes], level: int = 6) -> Iterator[bytes]:
    """One gzip member."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    for x in parts:
        yield squeeze.compress(x)
    yield squeeze.flush()


def write_archives(pages: DataFrame, level: int = 6) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html); returns the archives' paths and sizes, settled."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    rows = pages.select(F.col("page_id").cast("bigint"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("large", F.octet_length("payload") >= LEAST_PAYLOAD)
    first = rows.where("large").groupBy(F.col("sha1").alias("same")).agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("members"))
    repeated = few(settled(first.where("members > 1").select("same", "response"), "repeated"))  # most payloads occur once
    joined = rows.join(repeated, F.col("large") & (F.col("sha1") == F.col("same")), "left")
    joined = joined.select("page_id", "url", "payload", "sha1", "response", (F.col("same").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sink, path, made = TaskContext.get().partitionId(), None, None, []
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                page_id, url, payload, sha1, response, revisit = (x.as_py() for x in row)
                if sink is not None and sink.tell() >= ROLL:
                    made[-1][1] = sink.tell()
                    sink.close()
                    sink = None
                if sink is None:
                    path = own_name(folder, part, ".warc.gz")
                    fs, inner = opened(path)
                    sink = fs.open_output_stream(inner, compression=None)
                    made.append([path, 0])
                for x in member(record_bytes(page_id, url, payload, bytes.fromhex(sha1), response, revisit), level):
                    sink.write(x)
        if sink is not None:
            made[-1][1] = sink.tell()
            sink.close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made]), pa.array([x[1] for x in made], pa.int64())], ["path", "bytes"])

    return settled(joined.transform(mapped, run, "path string, bytes bigint"), "archives")


class Inflated:
    """The bytes of one gzip member, inflated as they are asked for; ``end`` is the offset after it once it is read out."""

    def __init__(self, source: BinaryIO, start: int) -> None:
        self.source, self.at, self.unzip, self.held, self.end = source, start, zlib.decompressobj(31), b"", None

    def more(self, most: int = PIECE) -> bool:
        if self.unzip.eof:
            return False
        feed = self.unzip.unconsumed_tail
        if not feed:
            self.source.seek(self.at)
            feed = self.source.read(min(most, PIECE))
            if not feed:
                raise zlib.error("the member has no end")
            self.at += len(feed)
        self.held += self.unzip.decompress(feed, most)
        if self.unzip.eof:
            self.end = self.at - len(self.unzip.unused_data)
        return True

    def line_block(self) -> bytes:
        """Up to the first empty line; of any length, once the member is seen to begin a WARC record."""
        looked = 0
        while self.held.find(b"\r\n\r\n", max(0, looked - 3)) < 0:
            looked = len(self.held)
            if not self.more(max(PROBE, looked)):
                raise zlib.error("no header block")
            if len(self.held) >= 5 and not self.held.startswith(b"WARC/"):
                raise zlib.error("not a WARC record")
        block, _, self.held = self.held.partition(b"\r\n\r\n")
        return block

    def pieces(self, count: int) -> Iterator[bytes]:
        while count:
            if not self.held and not self.more():
                raise zlib.error("the record is cut short")
            piece, self.held = self.held[:count], self.held[count:]
            count -= len(piece)
            if piece:
                yield piece

    def rest(self) -> bytes:
        out = b""
        while self.held or self.more():
            out, self.held = out + self.held, b""
        return out


def headers(block: bytes) -> dict[str, str]:
    """The fields of a record's header block, names in lower case; raises ValueError if it is none."""
    version, *lines = block.decode("utf-8").split("\r\n")
    if not re.fullmatch(r"WARC/\d+\.\d+", version):
        raise ValueError(version)
    found = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(line)
        found[name.strip().lower()] = value.strip()
    if "warc-type" not in found or not found.get("content-length", "").isdigit():
        raise ValueError("no type or length")
    return found


def records(source: BinaryIO, start: int, stop: int) -> Iterator[tuple[int, dict[str, str], Inflated]]:
    """Offset, headers and content of the records that start in [start, stop); the content need not be read."""
    at = start
    while at < stop:
        source.seek(at)
        window = source.read(min(PIECE, stop - at + len(MAGIC) - 1))
        place = window.find(MAGIC)
        if place < 0 or at + place >= stop:
            if len(window) < len(MAGIC):
                return
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += place
        body = Inflated(source, at)
        try:
            fields = headers(body.line_block())
        except (zlib.error, ValueError):  # magic within a member, or another kind of member
            at += 1
            continue
        yield at, fields, body
        while body.held or body.more():
            body.held = b""
        at = body.end


def payload_of(fields: dict[str, str], body: Inflated) -> tuple[int, str]:
    """Length and SHA-1 of a record's payload: what follows the HTTP header if the block is one of HTTP, else the block."""
    left, head, size, sha1 = int(fields["content-length"]), b"", 0, hashlib.sha1()
    if not fields.get("content-type", "").lower().startswith("application/http"):
        head = None
    for piece in body.pieces(left):
        if head is not None:
            head += piece
            if b"\r\n\r\n" not in head:
                continue
            piece, head = head.partition(b"\r\n\r\n")[2], None
        size += len(piece)
        sha1.update(piece)
    if body.rest() != b"\r\n\r\n":
        raise ValueError("a record doesn't end in two line ends")
    return size, sha1.hexdigest()


def hex_of_label(label: str) -> str:
    return base64.b32decode(label.partition(":")[2]).hex()


def splits(spark: SparkSession, archives: DataFrame, size: int = SPLIT) -> DataFrame:
    """path, start and stop of byte ranges of the archives, dealt evenly."""
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(size).cast("bigint"))).alias("start")
    cut = archives.where("bytes > 0").select("path", "bytes", starts)
    return cut.select("path", "start", F.least(F.col("start") + size, "bytes").alias("stop")).repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "start")


FOUND = "page_id bigint, record_id string, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, target string, intact boolean"


def read_archives(archives: DataFrame, size: int = SPLIT) -> DataFrame:
    """One row for each record; bytes and digest are those of the payload that is stored (of revisits: none and the label's)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FOUND.split(", ")]
        for batch in batches:
            for path, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[tuple] = []
                fs, inner = opened(path)
                with fs.open_input_file(inner) as source:
                    for _, fields, body in records(source, start, stop):
                        n, sha1 = payload_of(fields, body)
                        told, again = fields.get("warc-payload-digest"), fields["warc-type"] == "revisit"
                        label = hex_of_label(told) if told and told.lower().startswith("sha1:") else None
                        ids = [int(fields[x]) if x in fields else None for x in ("warc-x-page-id", "warc-x-refers-to-page")]
                        rows.append((ids[0], fields.get("warc-record-id"), fields.get("warc-target-uri"), fields["warc-type"], None if again else n, label if again else sha1, ids[1], fields.get("warc-refers-to"), None if label is None else again or sha1 == label))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names)

    return splits(archives.sparkSession, archives, size).transform(mapped, run, FOUND)


TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_()]


def resolved(found: DataFrame) -> DataFrame:
    """Records with the payload of each revisit looked up at the record that it refers to."""
    found = settled(found, "records")
    again = found.where("record_type = 'revisit'")
    wanted = again.select(F.col("target").alias("wanted")).distinct()
    kept = found.where("record_type = 'response'").join(wanted, F.col("record_id") == F.col("wanted"), "left_semi")
    kept = kept.groupBy(F.col("record_id").alias("stored")).agg(F.max("payload_bytes").alias("stored_bytes"), F.max("payload_digest").alias("stored_digest"))
    whole = again.join(kept, F.col("target") == F.col("stored"), "left").withColumn("payload_bytes", F.col("stored_bytes")).withColumn("intact", F.col("stored_digest") == F.col("payload_digest"))
    return found.where("record_type <> 'revisit'").unionByName(whole.select(*found.columns))

