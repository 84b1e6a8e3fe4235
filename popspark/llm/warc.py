"""Zstandard-compressed WARC archives: one frame for each record, the dictionary in a leading skippable frame.

Each task writes archives of its own and trains their dictionary on its first records. Writers leave a manifest of the
files of tasks that ended well; readers get one archive each and decode it record by record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.llm.common import BROADCAST_ROWS, shared_dir, ship, written

#: Fixed values of the formats: the skippable frame that holds a dictionary, a Zstandard frame, the revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads under so many bytes are never revisits.
LEAST_REVISIT = 1000
#: Records that a dictionary is trained on, its size, and uncompressed bytes after which the next archive begins.
TRAIN_RECORDS, DICTIONARY, ARCHIVE = 200, 64 << 10, 1 << 28
READ = 1 << 16
DATE = "2024-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _clean(value: str) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; digest is the payload's SHA-1 in hex. A revisit leaves the payload out and keeps its length in the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {_clean(url)}"] if isinstance(url, str) else []
    lines += [f"Page-ID: {page_id}"] if page_id is not None else []
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary, or the samples' own bytes where they are too few to train on."""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 4 + 256), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def leading_frame(data: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=9).compress(data)
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def write_archive(out, records: Iterator[bytes]) -> tuple[int, int]:
    """Records into an open file, until ARCHIVE bytes: how many, and their size before compression."""
    head, size, n = [], 0, 0
    for r in records:
        head.append(r)
        size += len(r)
        if len(head) == TRAIN_RECORDS or size >= ARCHIVE:
            break
    data = dictionary(head)
    out.write(leading_frame(data))
    pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data), write_checksum=True)
    for r in head:
        out.write(pack.compress(r))
    n = len(head)
    while size < ARCHIVE and (r := next(records, None)) is not None:
        out.write(pack.compress(r))
        size, n = size + len(r), n + 1
    return n, size


def frames(file) -> Iterator[bytes]:
    """The decoded frames of an archive one by one. Fails if the dictionary isn't there or a frame is cut."""
    head = file.read(8)
    if len(head) < 8:
        raise ValueError("an archive must begin with its dictionary")
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("an archive must begin with its dictionary")
    data = file.read(size)
    if len(data) < size:
        raise ValueError("the dictionary is cut")
    if data[:4] == struct.pack("<I", FRAME_MAGIC):
        data = zstandard.ZstdDecompressor().decompress(data)
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
    rest = file.read(READ)
    while rest:
        one, parts = unpack.decompressobj(), []
        while True:
            parts.append(one.decompress(rest))
            if one.eof:
                rest = one.unused_data or file.read(READ)
                break
            rest = file.read(READ)
            if not rest:
                raise ValueError("the last frame is cut")
        yield b"".join(parts)


def parse(data: bytes) -> dict:
    """The fields of one record, after a check of its version line, headers, lengths and digest."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("a frame must hold a WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"not a header line: {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"{name} is missing")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the record's length differs from Content-Length")
    http, mark, payload = rest[:-4].partition(b"\r\n\r\n")
    length = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), -1)
    if not mark or length < 0:
        raise ValueError("the HTTP header is missing or has no length")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if fields["warc-type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload differs from its length or digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("page-id"), "url": fields.get("warc-target-uri"), "payload_bytes": length, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": number("refers-to-page-id"), "payload": payload}


def _open(uri: str, write: bool = False):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if write:
        system.create_dir(path.rpartition("/")[0], recursive=True)
        return system.open_output_stream(path)
    return system.open_input_stream(path)


def _write(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def records():
            for pdf in batches:
                for page, url, payload, digest, top, n in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["digest"], pdf["top"], pdf["repeats"]):
                    own = None if pd.isna(page) else int(page)
                    to = None if pd.isna(n) or pd.isna(top) or own == int(top) else int(top)
                    yield record(own, url, payload, digest, to)

        left = records()
        first = next(left, None)
        while first is not None:
            def chained(head=first):
                yield head
                yield from left

            path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            with _open(path, write=True) as out:
                n, size = write_archive(out, chained())
            yield pd.DataFrame({"path": [path], "records": [n], "bytes": [size]})
            first = next(left, None)

    return run


def write(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Write a record for each row of pages; returns the manifest: path, records, bytes of each archive.

    Rows whose payloads are equal and have 1000 bytes or more become revisits of the one with the largest page_id;
    repeated rows of that page_id are responses too. A null html is an empty payload, a null url is left out, rows
    without page_id are responses unless another row has their payload. An empty table gives no archive.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    light = rows.filter(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("repeats"))
    repeated = written(light.filter("repeats > 1"), "repeated")
    few = repeated.limit(limit + 1).count() <= limit
    marked = rows.join(F.broadcast(repeated) if few else repeated, "digest", "left")
    return written(marked.mapInPandas(_write(folder), "path string, records long, bytes long"), "manifest")


def _read(payloads: bool):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with _open(path) as file:
                    for at, data in enumerate(frames(file)):
                        try:
                            rows.append(parse(data))
                        except ValueError as e:
                            raise ValueError(f"{path}, record {at}: {e}") from e
                        size += len(data)
                        if len(rows) == 5000 or size > 1 << 26:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)
                            rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

    return run


def read(spark: SparkSession, archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of archives, a table with their paths in column path; with payloads also the bytes of responses."""
    ship(spark)
    n = max(1, archives.count())
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return archives.select("path").repartition(n).mapInArrow(_read(payloads), schema)
