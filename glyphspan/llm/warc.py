"""WARC archives: one gzip member per record, written and read back record by record.

Writing makes a table of archives (name, content); each row is the bytes of one ``.warc.gz`` file of bounded size, so
Spark's own writer commits them and a task that is run again leaves nothing behind.  Reading takes such a table or Spark's
``binaryFile`` source over real files: a sequential reader inflates one member after another in small steps, frames the
header and the block by Content-Length and verifies the digests of block and payload.

Equal payloads are stored once: the row with the largest id is the response, the others revisit it.

Cases: a null payload is empty; a null url or id is written as an empty value and read back as null; control characters in
urls are percent-encoded; rows that repeat the largest id are all responses; of equal payloads without any id all are
responses; an empty table gives no archive and no record; broken members, short blocks and wrong digests raise
``ValueError`` unless ``strict`` is false, when the record is given with ``intact`` false and reading of that file ends.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARCHIVE_BYTES = 16_000_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "target_uri string, record_type string, record_id string, refers_to_id string, payload_bytes long, payload_digest string, payload binary, intact boolean"


def digest32(data: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def choose_records(df: DataFrame, page_id: str, url: str, html: str, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is null for responses."""
    rows = df.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("__sha", F.sha2("payload", 256))
    # only payloads that repeat are looked up; counts and maxima are added up in tasks, so a hot payload is a few rows
    last = rows.where(F.octet_length("payload") >= least_bytes).groupBy("__sha").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = rows.join(last, "__sha", "left")
    other = F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", F.when(other, F.col("last")).alias("refers_to"))


def _name(page_id) -> str:
    return "" if page_id is None else f"<urn:page:{page_id}>"


def _plain(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def record_bytes(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One record as one gzip member.  A revisit's block is the HTTP header alone, which states the payload's full length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_plain(url)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"WARC-Block-Digest: sha1:{digest32(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def write_archives(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(name, content): archives of about ``archive_bytes`` each, cut between records, within partitions."""

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, parts, size = TaskContext.get().partitionId(), 0, [], 0
        for pdf in batches:
            for page, url, payload, refers in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["refers_to"], strict=True):
                parts.append(record_bytes(page, url, payload, refers))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield pd.DataFrame({"name": [f"{part:06d}-{number:06d}.warc.gz"], "content": [b"".join(parts)]})
                    number, parts, size = number + 1, [], 0
        if parts:
            yield pd.DataFrame({"name": [f"{part:06d}-{number:06d}.warc.gz"], "content": [b"".join(parts)]})

    as_text = [F.col(c).cast("string").alias(c) for c in ("page_id", "refers_to")]  # whole numbers beside nulls would become floats
    return records.select("url", "payload", *as_text).mapInPandas(archive, "name string, content binary")


def members(content: bytes, step: int = 65536) -> Iterator[bytes]:
    """The inflated gzip members of a file, one at a time, fed to zlib in small steps."""
    view, at = memoryview(content), 0
    while at < len(view):
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(view):
                raise ValueError("gzip member ends early")
            out.append(inflate.decompress(view[at : at + step]))
            at = min(at + step, len(view)) - len(inflate.unused_data)
        yield b"".join(out)


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def read_record(data: bytes) -> dict:
    """A record of its own member: header, block of Content-Length bytes, two line ends; digests are verified."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    fields = _headers(head)
    if not head.startswith(b"WARC/") or not gap:
        raise ValueError("no WARC header")
    n = int(fields["content-length"])
    block = rest[:n]
    if len(block) < n or rest[n:] != b"\r\n\r\n":
        raise ValueError("block does not fit its Content-Length")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    intact = fields.get("warc-block-digest", "").removeprefix("sha1:") in ("", digest32(block)) and (revisit or stated in ("", digest32(payload)))
    length = int(_headers(http)["content-length"]) if revisit else len(payload)
    return {
        "target_uri": fields.get("warc-target-uri") or None, "record_type": fields["warc-type"], "record_id": fields.get("warc-record-id") or None, "refers_to_id": fields.get("warc-refers-to") or None,
        "payload_bytes": length, "payload_digest": stated or digest32(payload), "payload": None if revisit else payload, "intact": intact,
    }


def read_archives(archives: DataFrame, content: str = "content", strict: bool = True, payloads: bool = True) -> DataFrame:
    """One row per record of all archives; ``payloads`` false leaves the payload column null."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf[content]:
                rows, size = [], 0
                try:
                    for member in members(data):
                        rows.append(read_record(member))
                        if strict and not rows[-1]["intact"]:
                            raise ValueError("digest differs")
                        if not payloads:
                            rows[-1]["payload"] = None
                        size += len(rows[-1]["payload"] or b"")
                        if size > 32_000_000:
                            yield pd.DataFrame(rows)
                            rows, size = [], 0
                except (ValueError, KeyError, zlib.error) as e:
                    if strict:
                        raise ValueError(f"broken archive: {e}") from e
                    rows.append(dict.fromkeys(x.split()[0] for x in RECORD.split(", ")) | {"payload_bytes": 0, "intact": False})
                if rows:
                    yield pd.DataFrame(rows)

    return archives.select(content).mapInPandas(read, RECORD)


def page_of(record_id: str):
    """Column of the page id in a record id that ``write_archives`` gave."""
    return F.regexp_extract(F.col(record_id), r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")
