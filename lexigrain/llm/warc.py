"""Normalising monolithic WARC files (operator 7).

A ``.warc.gz`` that was compressed as one stream can't be read at a record. The normaliser inflates each
file once, front to back, writes every record as its own gzip member, and puts an index beside it: one JSON
line a record with the member's offset and length. A record can then be read with one seek.

Files are the unit of work. Output goes to a name of its own per attempt and is moved into place when it is
whole, so a lost executor or a second attempt leaves no half-written file. Input that is already one
member a record, or any mix, is read alike. Paths are those of ``pyarrow.fs``: local, HDFS, S3 or GCS.

Defined cases: an empty file gives an empty output and index; a stream that ends within a record gives the
whole records before it and one index row of status ``truncated`` without a member; bytes that aren't a WARC
record, or one without a proper length, give a row of status ``malformed``, and reading goes on at the next line that
begins a record; null values become absent headers or an empty body; bodies may be of any length that one worker's
memory holds; repeated records are kept; columns of other names don't matter.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.llm import storage

CHUNK = 1 << 20
LEVEL = 6
INDEX = "path string, record_id string, kind string, uri string, offset long, length long, size long, digest string, status string"
_FIELDS = ["path", "record_id", "kind", "uri", "offset", "length", "size", "digest", "status"]


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def record(uri: str | None, identity: str, body: bytes, kind: str = "resource") -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{identity}>"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {uri}")
    head += ["WARC-Date: 2000-01-01T00:00:00Z", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"


def inflated(stream) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, piece by piece."""
    machine = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            if machine.eof:
                machine = zlib.decompressobj(31)
            if out := machine.decompress(data, CHUNK * 4):
                yield out
            data = machine.unconsumed_tail or machine.unused_data


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, str]]:
    """Headers, whole bytes and status of each record."""
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            try:
                held.extend(next(pieces))
            except (StopIteration, zlib.error):
                return False
        return True

    def skip() -> bool:
        """Drops what stands before the next line that begins a record; False at the end of the file."""
        at = 1
        while (found := held.find(b"\nWARC/", at)) < 0:
            del held[: max(0, len(held) - 8)]
            at = 0
            if not fill(len(held) + 1):
                held.clear()
                return False
        del held[: found + 1]
        return True

    while True:
        while fill(1) and held[:2] in (b"\r\n", b"\n"):
            del held[: 2 if held[:1] == b"\r" else 1]
        if not held:
            return
        fill(5)
        if not held.startswith(b"WARC/"):
            yield {}, b"", "malformed"
            if not skip():
                return
            continue
        at, searched = -1, 0
        while (at := held.find(b"\r\n\r\n", max(0, searched - 3))) < 0:
            searched = len(held)
            if not fill(len(held) + 1):
                break
        if at < 0:
            yield {}, b"", "truncated"
            return
        lines = held[:at].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = headers.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            yield headers, b"", "malformed"
            if not skip():
                return
            continue
        size = int(length)
        if not fill(at + 4 + size):
            yield headers, b"", "truncated"
            return
        fill(at + 4 + size + 4)
        yield headers, bytes(held[: at + 4 + size]), "ok"
        del held[: at + 4 + size]


def normalise_file(source: str, folder: str) -> list[dict]:
    """Rewrites one file; the rows of its index."""
    into, root = opened(folder)
    name = f"{hashlib.sha256(source.encode()).hexdigest()[:24]}.warc.gz"
    attempt = f"{root}/.{name}.{uuid.uuid4().hex}"
    rows, offset = [], 0
    out_of, path = opened(source)
    with out_of.open_input_stream(path, compression=None) as stream, into.open_output_stream(attempt, compression=None) as out:
        for headers, whole, status in records(inflated(stream)):
            member = gzip.compress(whole + b"\r\n\r\n", LEVEL, mtime=0) if status == "ok" else b""
            body = whole[whole.index(b"\r\n\r\n") + 4 :] if whole else b""
            out.write(member)
            rows.append(
                {
                    "path": f"{folder}/{name}",
                    "record_id": headers.get("warc-record-id", "").strip("<>") or None,
                    "kind": headers.get("warc-type"),
                    "uri": headers.get("warc-target-uri"),
                    "offset": offset,
                    "length": len(member),
                    "size": len(body),
                    "digest": hashlib.sha256(body).hexdigest() if whole else None,
                    "status": status,
                }
            )
            offset += len(member)
    with into.open_output_stream(f"{attempt}.index", compression=None) as out:
        out.write("".join(json.dumps(r) + "\n" for r in rows).encode())
    into.move(f"{attempt}.index", f"{root}/{name}.index")
    into.move(attempt, f"{root}/{name}")
    return rows


def normalise(spark: SparkSession, paths: list[str], folder: str) -> DataFrame:
    """Normalises files into a folder; the joint index, which is written before it is returned, so that no file is done twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("source").to_pylist():
                rows = normalise_file(source, folder)
                yield pa.RecordBatch.from_pylist(rows, pa.schema([(n, pa.int64() if n in ("offset", "length", "size") else pa.string()) for n in _FIELDS]))

    # One file a task, whatever the hashes of their paths.
    files = spark.createDataFrame(list(enumerate(sorted(paths))), "nth int, source string").repartitionById(max(1, len(paths)), "nth").select("source")
    return storage.written(files.mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """(record_id, uri, body) of the index's whole records, each read at its offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, handle = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                bodies = []
                for where, offset, length in zip(*(part.column(c).to_pylist() for c in ("path", "offset", "length"))):
                    if where != path:
                        files, name = opened(where)
                        path, handle = where, files.open_input_file(name)
                    handle.seek(offset)
                    whole = gzip.decompress(handle.read(length))
                    bodies.append(whole[whole.index(b"\r\n\r\n") + 4 : -4])
                yield pa.RecordBatch.from_arrays([part.column("record_id"), part.column("uri"), pa.array(bodies, pa.binary())], names=["record_id", "uri", "body"])

    return index.where("status = 'ok'").select("record_id", "uri", "path", "offset", "length").mapInArrow(run, "record_id string, uri string, body binary")


def write_monolithic(pages: DataFrame, folder: str, key: str = "page_id") -> list[str]:
    """Writes pages as WARC files of one gzip stream, a file a partition; their paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(folder)
        name = f"{uuid.uuid4().hex}.warc.gz"
        with files.open_output_stream(f"{root}/{name}", compression=None) as raw:
            machine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            for batch in batches:
                for page, url, body in zip(*(batch.column(c).to_pylist() for c in (key, "url", "html"))):
                    raw.write(machine.compress(record(url, f"urn:page:{'' if page is None else page}", (body or "").encode("utf-8", "replace"))))
            raw.write(machine.flush())
        yield pa.RecordBatch.from_pylist([{"source": f"{folder}/{name}"}])

    rows = pages.select(F.col(key).cast("long").alias(key), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    # Paths of lost attempts aren't returned, so their files aren't read.
    return [r["source"] for r in rows.mapInArrow(run, "source string").collect()]


def round_trip(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, url, n_bytes, md5) of pages that went through a monolithic file, the normaliser and a read by index."""
    spark = pages.sparkSession
    raw, clean = storage.work_path(spark, "warc-raw"), storage.work_path(spark, "warc")
    for folder in (raw, clean):
        files, root = opened(folder)
        files.create_dir(root)
    index = normalise(spark, write_monolithic(pages, raw, key), clean)
    read = read_records(index)
    return read.select(F.expr("try_cast(substring(record_id, 10) as bigint)").alias(key), F.col("uri").alias("url"), F.length("body").cast("long").alias("n_bytes"), F.md5("body").alias("md5"))
