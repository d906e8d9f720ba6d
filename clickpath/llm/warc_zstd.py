"""WARC archives as dictionary-compressed Zstandard files, and their reader.

An archive starts with a skippable frame that holds a dictionary built from
its own records; every record is a frame of its own, so a reader can start at
any of them once it has the dictionary.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from clickpath.llm.common import whole_text

# Fixed values of the format
DICTIONARY_MAGIC = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _record(kind: str, page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    block = HTTP + payload if kind == "response" else HTTP
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:x-page:{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": " ".join(url.split()),  # a line end would end the header
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Payload-Length": str(len(payload)),
    }
    if kind == "revisit":
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:x-page:{refers_to}>"}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{name}: {value}\r\n" for name, value in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _archive(records: list[bytes], dictionary_bytes: int, sample_bytes: int, level: int) -> bytes:
    """One archive. Records that are too few or too alike to train on get no dictionary."""
    samples, taken = [], 0
    step = max(1, sum(map(len, records)) // max(sample_bytes, 1))
    for record in records[::step]:
        samples.append(record)
        taken += len(record)
        if taken >= sample_bytes:
            break
    try:
        trained = zstandard.train_dictionary(min(dictionary_bytes, max(256, taken // 8)), samples, k=256, d=8)
    except (zstandard.ZstdError, ValueError):
        trained = None
    writer = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True)
    head = b""
    if trained is not None:
        body = trained.as_bytes()
        head = struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body
    return head + b"".join(map(writer.compress, records))


def write(pages: DataFrame, archive_bytes: int = 8 << 20, dictionary_bytes: int = 64 << 10,
          sample_bytes: int = 1 << 20, level: int = 3, min_payload: int = 0) -> DataFrame:
    """(archive): the bytes of one archive per row, for ``stored`` or a binary table.

    Every row of pages (page_id, url, html) is a record with the html in UTF-8
    as payload; null html is empty, a null url an empty one. Of equal payloads
    of at least ``min_payload`` bytes the one with the largest page_id is a
    response and the others are revisits of it; rows that repeat that page_id
    are responses too, as are all if every page_id is null. An empty table
    gives no archive. A task starts a new archive after ``archive_bytes`` of
    records. Only payloads that occur twice meet in the join, and a payload
    that is very frequent is counted before the shuffle.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), whole_text("html").alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    repeated = (rows.where(F.octet_length("html") >= min_payload)
                .groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
                .where("n > 1 AND first IS NOT NULL").drop("n"))
    rows = rows.join(repeated, "digest", "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[bytes] = []
        held = 0
        for batch in batches:
            for row in batch.to_pylist():
                payload = row["html"].encode()
                digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                kind = "response" if row["refers_to"] is None else "revisit"
                records.append(_record(kind, row["page_id"], row["url"], payload, digest, row["refers_to"]))
                held += len(records[-1])
                if held >= archive_bytes:
                    yield pa.RecordBatch.from_pydict(
                        {"archive": [_archive(records, dictionary_bytes, sample_bytes, level)]})
                    records, held = [], 0
        if records:
            yield pa.RecordBatch.from_pydict({"archive": [_archive(records, dictionary_bytes, sample_bytes, level)]})

    return (rows.select("page_id", "url", "html", "digest", "refers_to")
            .mapInArrow(run, "archive binary"))


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive."""
    at, dictionary = 0, None
    if len(archive) >= 8:
        magic, length = struct.unpack_from("<II", archive)
        if magic == DICTIONARY_MAGIC:
            dictionary, at = zstandard.ZstdCompressionDict(archive[8:8 + length]), 8 + length
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    view = memoryview(archive)
    while at < len(archive):
        frame = reader.decompressobj()
        data = frame.decompress(view[at:at + (1 << 16)])
        end = at + (1 << 16)
        pieces = [data]
        while not frame.eof:
            if end >= len(archive):
                raise ValueError("the archive ends inside a record")
            pieces.append(frame.decompress(view[end:end + (1 << 16)]))
            end += 1 << 16
        at = min(end, len(archive)) - len(frame.unused_data)
        head, _, block = b"".join(pieces).partition(b"\r\n\r\n")
        names = dict(line.partition(": ")[::2] for line in head.decode().split("\r\n")[1:])
        yield names, block[:int(names["Content-Length"])]


READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def read(archives: DataFrame) -> DataFrame:
    """One row per record. A response's digest and length are taken from its
    payload and compared with its header; a revisit has only the header's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive"):
                rows = []
                for head, block in records(archive.as_py()):
                    digest, length = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                    if head["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        found = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                        if found != (digest, length):
                            raise ValueError(f"payload of {head['WARC-Record-ID']} differs from its header")
                    rows.append((_page(head["WARC-Record-ID"]), length, digest, head["WARC-Type"],
                                 _page(head.get("WARC-Refers-To"))))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_pydict({
                    field.split()[0]: pa.array([row[i] for row in rows], kind)
                    for i, (field, kind) in enumerate(zip(READ_SCHEMA.split(", "), kinds))})

    return archives.mapInArrow(run, READ_SCHEMA)


def export(archives: DataFrame, folder: str) -> None:
    """Write each archive as a .warc.zst file to a mounted folder that all executors share.

    Files are named by their content and moved into place when complete, so
    repeated task attempts leave the same files.
    """

    def run(rows: Iterator) -> None:
        for row in rows:
            name = os.path.join(folder, hashlib.sha1(row.archive).hexdigest() + ".warc.zst")
            with open(f"{name}.part-{os.getpid()}", "wb") as file:
                file.write(row.archive)
            os.replace(f"{name}.part-{os.getpid()}", name)

    archives.foreachPartition(run)
