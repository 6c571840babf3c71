"""WARC archives in Zstandard frames: a shared dictionary first, then one frame per record."""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import beside_extreme, shared_path, stored, whole_text

# Fixed values of the format: the skippable frame of a dictionary, a frame's magic number.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1\r\n"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


@dataclass(frozen=True)
class WarcParams:
    """Production parameters. ``archive_bytes``: an archive is closed once it is this long.

    ``sample_bytes`` of a task's first payloads train its dictionary of ``dictionary_bytes``.
    ``revisit_bytes``: least payload that is written once and then referred to.
    """

    archive_bytes: int = 32 << 20
    sample_bytes: int = 1 << 20
    dictionary_bytes: int = 16 << 10
    revisit_bytes: int = 0
    level: int = 3
    date: str = "1970-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(value: object) -> str:
    """A header value on one line."""
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url, payload: bytes, refers_to, is_response: bool, p: WarcParams) -> bytes:
    """One record; a revisit holds the HTTP head of its payload, not the payload."""
    name = lambda x: f"<urn:uuid:{uuid.uuid5(NAMES, f'page:{x}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if is_response else b"")
    head = [
        ("WARC-Type", "response" if is_response else "revisit"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", p.date),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", _header(url)))
    if page_id is not None:
        head.append(("X-Page-ID", page_id))
    if not is_response:
        head += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", name(refers_to)),
            ("X-Refers-To-Page", refers_to),
        ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return VERSION + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary_frame(samples: list[bytes], p: WarcParams) -> bytes:
    """The leading skippable frame; too few samples for training make a raw dictionary."""
    if not samples:
        return b""
    try:
        content = zstandard.train_dictionary(p.dictionary_bytes, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        content = b"".join(samples)[: p.dictionary_bytes]
    packed = zstandard.ZstdCompressor(level=p.level).compress(content)
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def _dictionary(packed: bytes) -> zstandard.ZstdCompressionDict:
    content = zstandard.ZstdDecompressor().decompress(packed) if packed.startswith(FRAME_MAGIC) else packed
    return zstandard.ZstdCompressionDict(content)


def read_archive(stream, where: str) -> Iterator[bytes]:
    """The records of an archive, one frame at a time; raises ValueError on what is damaged."""
    head = stream.read(8)
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", head[4:])[0]
        packed = stream.read(size)
        if len(packed) != size:
            raise ValueError(f"{where}: the dictionary is cut short")
        reader, buffer = zstandard.ZstdDecompressor(dict_data=_dictionary(packed)), b""
    else:
        reader, buffer = zstandard.ZstdDecompressor(), head
    while True:
        buffer = buffer or stream.read(1 << 20)
        if not buffer:
            return
        frame, parts = reader.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(buffer))
            except zstandard.ZstdError as error:
                raise ValueError(f"{where}: {error}") from error
            if frame.eof:
                buffer = frame.unused_data
                break
            if not (buffer := stream.read(1 << 20)):
                raise ValueError(f"{where}: the last frame is cut short")
        yield b"".join(parts)


def parse_record(data: bytes, where: str) -> dict:
    """Headers and payload of a record, after checking version, headers, lengths and digest."""

    def need(true: bool, what: str) -> None:
        if not true:
            raise ValueError(f"{where}: {what}")

    head, gap, rest = data.partition(b"\r\n\r\n")
    need(data.startswith(VERSION) and bool(gap), "not a WARC record")
    fields = {}
    for line in head[len(VERSION) :].decode().split("\r\n"):
        name, colon, value = line.partition(":")
        need(bool(colon) and name.strip() == name and name.lower() not in fields, f"bad header {line[:80]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        need(name in fields, f"no {name}")
    need(fields["content-length"].isdigit(), "bad content-length")
    size = int(fields["content-length"])
    need(len(rest) == size + 4 and rest.endswith(b"\r\n\r\n"), "length differs from content-length")
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    need(bool(gap) and http.startswith(b"HTTP/"), "no HTTP head")
    lengths = [v for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if k.lower() == b"content-length"]
    need(len(lengths) == 1 and lengths[0].strip().isdigit(), "no single HTTP content-length")
    full = int(lengths[0])
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "response":
        need(len(payload) == full, "payload length differs from the HTTP head")
        need(digest_of(payload) == digest, "payload digest differs")
    else:
        need(fields["warc-type"] == "revisit" and not payload, "revisit with a payload")
        need("warc-refers-to" in fields, "revisit without its target")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("x-page-id"), "url": fields.get("warc-target-uri"), "payload": payload,
        "payload_bytes": full, "payload_digest": digest, "record_type": fields["warc-type"],
        "refers_to": number("x-refers-to-page"),
    }


def _open(path: str, write: bool = False):
    """A stream in any file system that the path names."""
    system, inner = fs.FileSystem.from_uri(path)
    if write:
        system.create_dir(os.path.dirname(inner), recursive=True)
        return system.open_output_stream(inner, compression=None)
    return system.open_input_stream(inner, compression=None)


MANIFEST = "path string, records long, bytes long"


def write_archives(pages: DataFrame, folder: str, params: WarcParams = WarcParams()) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html, others); returns the archives.

    Of records with equal payloads of at least ``revisit_bytes`` the one with the largest
    page_id is a response and the others revisit it; smaller ones are all responses. Null
    html is an empty payload. Rows with a null page_id revisit too; without any page_id
    among equal payloads all are responses. Rows that repeat the largest page_id are all
    responses. Each try of a task writes files of its own name and only the files of the
    try that Spark accepts are in the result.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(whole_text("html"), "UTF-8").alias("payload"),
    ).withColumn("sha", F.sha2("payload", 256))
    named = beside_extreme(rows, "sha", "page_id", "response", largest=True)
    alone = F.col("response").isNull() | F.col("page_id").eqNullSafe(F.col("response"))
    small = F.octet_length("payload") < params.revisit_bytes
    marked = named.select(
        "page_id", "url", "payload", "response", (alone | small).alias("is_response")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        head, packer, held, out, size, count, path, made = b"", None, [], None, 0, 0, "", 0

        def records() -> Iterator[tuple]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield tuple(c[i].as_py() for c in batch.columns)

        def first(rows: Iterator[tuple]) -> Iterator[tuple]:
            """Hold the first payloads back until the dictionary is trained on them."""
            nonlocal head, packer
            total = 0
            for row in rows:
                held.append(row)
                total += len(row[2])
                if total >= params.sample_bytes:
                    break
            head = dictionary_frame([r[2][: 64 << 10] for r in held if r[2]], params)
            packer = zstandard.ZstdCompressor(level=params.level, dict_data=_dictionary(head[8:]) if head else None)
            yield from held
            yield from rows

        done = []
        for page_id, url, payload, response, is_response in first(records()):
            if out is None:
                path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{made:04d}.warc.zst"
                out, size, count, made = _open(path, write=True), len(head), 0, made + 1
                out.write(head)
            frame = packer.compress(record(page_id, url, bytes(payload), response, is_response, params))
            out.write(frame)
            size, count = size + len(frame), count + 1
            if size >= params.archive_bytes:
                out.close()
                done.append((path, count, size))
                out = None
        if out is not None:
            out.close()
            done.append((path, count, size))
        if done:
            names = [c.split()[0] for c in MANIFEST.split(", ")]
            yield pa.record_batch([pa.array(c) for c in zip(*done, strict=True)], names=names)

    return stored(marked.mapInArrow(run, MANIFEST), "warc-manifest")


RECORDS = (
    "page_id long, url string, payload binary, payload_bytes long, payload_digest string,"
    " record_type string, refers_to long"
)


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the archives in ``manifest`` (path, records), one archive per task.

    A wrong header, length, digest or number of records raises an error that names the
    archive and the place.
    """
    fields = [c.split() for c in RECORDS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size, n = [], 0, 0
                with _open(path) as stream:
                    for n, data in enumerate(read_archive(stream, path), 1):  # noqa: B007
                        row = parse_record(data, f"{path}, record {n}")
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        size += len(row["payload"] or b"") + 500
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if n != wanted:
                    raise ValueError(f"{path}: {n} records, {wanted} were written")
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    # a stated number, since Spark would otherwise join these few small rows into one task
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "records").repartition(n, "path").mapInArrow(run, RECORDS)


def archive_round_trip(pages: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """Write archives below the shared folder and read them back, without the payloads."""
    folder = shared_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, params), with_payload=False).drop("payload")
