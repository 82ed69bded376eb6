"""WARC files as captures, and captures as WARC files.

A file is read by one task, record by record from a stream of the file that
the task opens itself, so its size doesn't matter; gzip members and plain
files are both read. A record that can't be parsed ends its file with an error
row rather than the job.
"""

from __future__ import annotations

import datetime
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

CAPTURES = "capture_id long, file string, kind string, url string, ts long, status int, headers map<string,string>, digest string, n_bytes long, body binary, error string"
#: Records that a file's numbers leave room for, and tasks that files are dealt to.
RECORDS, MAX_TASKS = 2**32, 100_000
_FIELDS = ("capture_id", "file", "kind", "url", "ts", "status", "headers", "digest", "n_bytes", "body", "error")


def _fields(stream) -> dict[str, str]:
    out = {}
    while (line := stream.readline()).strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def parse(stream):
    """(kind, url, seconds, status, headers, digest, body) of each record with a URL; other records are passed over."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        head = _fields(stream)
        block = stream.read(int(head["content-length"]))
        if len(block) < int(head["content-length"]):
            raise ValueError("the file ends within a record")
        if "warc-target-uri" not in head:
            continue
        when = datetime.datetime.fromisoformat(head["warc-date"].replace("Z", "+00:00"))
        status, headers, body = None, {}, block
        if block.startswith(b"HTTP/"):
            http = io.BytesIO(block)
            status = int(http.readline().split()[1])
            headers = _fields(http)
            body = http.read()
        digest = head.get("warc-payload-digest") or (f"sha1:{hashlib.sha1(body).hexdigest()}" if body else None)
        yield head.get("warc-type"), head["warc-target-uri"].strip("<>"), int(when.timestamp()), status, headers, digest, body


def read(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all files below path, ready for revisits.resolve.

    capture_id numbers the records by file, in the order of paths, and within
    it: 2**31 files of 2**32 records. It is the same in every run over the same
    files. A folder without files gives no captures.
    """
    shared.prepare(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    numbered = files.select((F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("n"), "path")  # the list that the driver has read
    files = numbered.repartition(min(max(1, files.count()), MAX_TASKS))

    def run(batches):
        for b in batches:
            for n, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, at = shared._open(name)
                rows, size, k = [], 0, 0
                with system.open_input_stream(at, compression=None) as raw:
                    stream = io.BufferedReader(raw, 1 << 20)
                    if stream.peek(2)[:2] == b"\x1f\x8b":
                        stream = gzip.GzipFile(fileobj=stream)
                    records = parse(stream)
                    while True:
                        try:
                            kind, url, ts, status, headers, digest, body = next(records)
                            rows.append((n * RECORDS + k, name, kind, url, ts, status, list(headers.items()), digest, len(body), body, None))
                            size += len(body)
                            k += 1
                        except StopIteration:
                            break
                        except (ValueError, KeyError, EOFError, OSError) as e:
                            rows.append((n * RECORDS + k, name, None, None, None, None, [], None, None, None, str(e)[:200]))
                            break
                        if size > 1 << 23:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(run, CAPTURES)


def _batch(rows) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=list(_FIELDS))


def record(kind: str, url: str, ts: int, status: int | None, headers: dict[str, str], body: bytes) -> bytes:
    """One record as bytes."""
    block = body
    if status is not None:
        block = f"HTTP/1.1 {status} -\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n" + body
    when = datetime.datetime.fromtimestamp(ts, datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {when}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"
