"""Dictionary-compressed WARC archives.

A Zstandard dictionary is trained on a bounded sample of the records. Each archive starts with a skippable frame that
holds it; every record follows as a frame of its own, so a reader can start at any record's offset. Equal payloads are
archived once; later ones become revisit records. Tasks write to names that carry their attempt, and only the files of
finished attempts are in the manifest, so lost or repeated tasks do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DICTIONARY_MAGIC = 0x184D2A5D
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _line(name: str, value: str) -> str:
    return f"{name}: " + "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value) + "\r\n"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """A response record, or a revisit of page ``first`` if that is given; a revisit keeps the HTTP head but no payload."""
    revisit = first is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = "WARC/1.1\r\n" + _line("WARC-Type", "revisit" if revisit else "response") + _line("WARC-Record-ID", record_id(page_id)) + _line("WARC-Date", date)
    if url is not None:
        lines += _line("WARC-Target-URI", url)
    if page_id is not None:
        lines += _line("X-Page-ID", str(page_id))
    lines += _line("WARC-Payload-Digest", "sha1:" + digest)
    if revisit:
        lines += _line("WARC-Profile", _PROFILE) + _line("WARC-Refers-To", record_id(first)) + _line("X-Refers-To-Page-ID", str(first))
    lines += _line("Content-Type", "application/http; msgtype=response") + _line("Content-Length", str(len(block)))
    return lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a record."""
    at = raw.index(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in raw[:at].decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = raw[at + 4 : at + 4 + int(fields["content-length"])]
    if raw[at + 4 + len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, block


def train(samples: list[bytes], size: int = 64 << 10) -> bytes:
    """Dictionary bytes from sample records; too few of them to train on serve as a raw dictionary."""
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 4)), samples).as_bytes()
    except zstandard.ZstdError:
        raw = b"".join(samples)[-size:]
        return raw if len(raw) >= 8 else b""


def _dictionary(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _write(root: str, dictionary, date: str, level: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(root)
        task = TaskContext.get()
        raw = dictionary.value
        made = _dictionary(raw)
        if made:
            made.precompute_compress(level)
        zip_ = zstandard.ZstdCompressor(level=level, dict_data=made)
        out, done = None, []
        path, records, size, number = "", 0, 0, 0
        for b in batches:
            ids, urls, pages, digests, firsts = (b.column(i) for i in range(5))
            ids, urls, digests, firsts = ids.to_pylist(), urls.to_pylist(), digests.to_pylist(), firsts.to_pylist()
            for page_id, url, html, digest, first in zip(ids, urls, common.utf8(pages), digests, firsts):
                if out is None:
                    path = f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{number:04d}.warc.zst"
                    out = fs.open_output_stream(path, compression=None)
                    number += 1
                    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
                    info = b"software: mnemoflow\r\nformat: WARC File Format 1.1\r\n"
                    head = "WARC/1.1\r\nWARC-Type: warcinfo\r\n" + _line("WARC-Record-ID", record_id(None)) + _line("WARC-Date", date)
                    head += f"Content-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                    out.write(zip_.compress(head.encode() + info + b"\r\n\r\n"))
                digest = base64.b32encode(bytes.fromhex(digest)).decode()
                out.write(zip_.compress(make_record(page_id, url, html or b"", digest, first, date)))
                records += 1
                if out.tell() >= file_bytes:
                    size = out.tell()
                    out.close()
                    done.append((path, records, size))
                    out, records = None, 0
        if out is not None:
            size = out.tell()
            out.close()
            done.append((path, records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), _MANIFEST)], schema=_MANIFEST)

    return run


def classify(pages: DataFrame, min_payload: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, digest hex, first): ``first`` is the smallest page_id with an equal payload if that is another page, else null."""
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    groups = pages.groupBy("digest").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    groups = common.materialize(groups, "warc-digests")
    rows = groups.agg(F.sum("copies")).first()[0] or 0
    joined = common.join_unique(pages, groups.select("digest", "least"), "digest", groups.filter(F.col("copies") * 256 > rows))
    first = F.when((F.octet_length("html") >= min_payload) & (F.col("least") < F.coalesce("page_id", F.lit(2**63 - 1))), F.col("least"))
    return joined.select("page_id", "url", "html", "digest", first.alias("first"))


def write_archives(pages: DataFrame, root: str, min_payload: int = 0, dictionary_samples: int = 1000, sample_bytes: int = 16 << 20, level: int = 3, file_bytes: int = 1 << 30, date: str = "2024-01-01T00:00:00Z", **columns) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) under the URI ``root``; returns the manifest (path, records, bytes).

    A null html is an empty payload. Of equal payloads of ``min_payload`` bytes or more the smallest page_id's record is
    the response and others revisit it; repeated rows of that page_id with that payload are responses too, and rows
    whose ids are all null are responses as there is no id to refer to. A null url leaves the field out. An empty table
    writes no file; other columns are ignored. A record must fit a task's memory some three times over. The dictionary
    is trained on about ``dictionary_samples`` whole records chosen by hash, of together ``sample_bytes`` at most (a larger
    one is passed over): a bound on rows that touches compression only.
    """
    spark = pages.sparkSession
    rows = classify(pages, min_payload, **columns)
    n = pages.count()
    html = F.coalesce(F.col(columns.get("html_col", "html")).cast("string"), F.lit(""))
    some = pages.filter(F.pmod(F.xxhash64(F.col(columns.get("id_col", "page_id")), F.lit(5)), F.lit(max(1, n // dictionary_samples))) == 0)
    some = some.select(html.alias("html")).filter(F.octet_length("html") <= sample_bytes).limit(4 * dictionary_samples)
    samples, room = [], sample_bytes
    for r in some.toLocalIterator():
        record = make_record(len(samples), "https://example.org/", r.html.encode(), base32_sha1(b""), None, date)
        if len(record) <= room:
            samples.append(record)
            room -= len(record)
    dictionary = spark.sparkContext.broadcast(train(samples))
    fs, base = pa.fs.FileSystem.from_uri(root)
    fs.create_dir(base)
    return common.materialize(rows.mapInArrow(_write(root, dictionary, date, level, file_bytes), "path string, records long, bytes long"), "warc-manifest")


def read_frames(stream, chunk: int = 1 << 16) -> Iterator[bytes]:
    """Records of an archive, each from its own frame, with the dictionary of the leading frame."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("not an archive with a leading dictionary")
    unzip = zstandard.ZstdDecompressor(dict_data=_dictionary(stream.read(size)))
    buffer = stream.read(chunk)
    while buffer:
        frame, out = unzip.decompressobj(), []
        while not frame.eof:
            if not buffer:
                raise ValueError("the archive ends within a record")
            out.append(frame.decompress(buffer))
            buffer = frame.unused_data if frame.eof else stream.read(chunk)
        yield b"".join(out)
        buffer = buffer or stream.read(chunk)


def _read(root: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(root)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as f:
                    for raw in read_frames(f):
                        fields, block = parse_record(raw)
                        kind = fields["warc-type"]
                        if kind == "warcinfo":
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = int(head.rpartition(b"Content-Length: ")[2])
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
                            raise ValueError(f"{path}: a payload differs from its digest")
                        ids = [None if fields.get(k) is None else int(fields[k]) for k in ("x-page-id", "x-refers-to-page-id")]
                        rows.append((ids[0], fields.get("warc-target-uri"), kind, length, digest, ids[1], payload if payloads and kind == "response" else None))
                        held += len(raw) if payloads else 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _READ)], schema=_READ)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _READ)], schema=_READ)

    return run


def read_archives(manifest: DataFrame, root: str, payloads: bool = False) -> DataFrame:
    """Records of the archives in ``manifest``, responses checked against their digests; ``payloads`` adds the responses'
    payloads (revisits: null). An empty manifest gives no rows; an archive that is cut short or altered is an error."""
    kind = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    files = manifest.count()
    return manifest.select("path").repartition(max(1, min(files, 10_000)), "path").mapInArrow(_read(root, payloads), kind)
