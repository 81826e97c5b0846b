"""WARC archives with an index: written record by record, read back by coalesced byte ranges.

Tasks write archives of gzip members, one per record, and return the place, url and digest of each record. That index is
a table of its own, so a reader selects records first and then reads only the byte ranges that hold them, in order of file
and offset, neighbouring ranges in one request. Archives lie in the folder that all executors share; a task that is run
again writes new files, and the index names the files of the attempt that was committed.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kembar import runtime
from kembar.llm.hot import join_groups

#: Payloads from this size on are stored once; smaller ones cost less than a reference to them.
REVISIT_BYTES = 1000
ARCHIVE_BYTES = 1 << 30
#: Ranges that lie no further apart are read together, up to a length.
GAP_BYTES = 64 << 10
REQUEST_BYTES = 8 << 20

INDEX = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, "
    "archive string, offset bigint, length bigint"
)
RECORDS = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, "
    "payload binary"
)


def with_originals(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = REVISIT_BYTES,
    limit: int = runtime.BROADCAST_BYTES,
) -> DataFrame:
    """(page_id, url, payload, payload_digest, refers_to): the page that each page revisits, or null for a response.

    Among equal payloads (by SHA-1 and length) of `least` bytes or more, the row with the largest page_id is the response.
    A null payload is empty. Null ids are smaller than all others; rows that share the largest id of a group are all
    responses, as are all rows of a group without any id.
    """
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("bigint")})
    keys = ["payload_digest", "payload_bytes"]
    groups = rows.where(F.col("payload_bytes") >= least).groupBy(*keys).agg(
        F.max("page_id").alias("original"), F.count("*").alias("__n")
    ).where(F.col("__n") > 1)
    groups = runtime.written(groups, "warc-originals")
    joined = join_groups(rows, groups, keys, "__n", ["page_id", "url"], limit)
    differs = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.select(
        "page_id", "url", "payload", "payload_digest", F.when(differs, F.col("original")).alias("refers_to")
    )


def _field(value: str) -> str:
    """A header value in one line."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def _record_id(digest: str, page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}')}>"


def record_bytes(
    page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str
) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(digest, page)),
        ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", _field(url)))
    if page is not None:
        fields.append(("X-Page-Id", str(page)))
    if refers_to is not None:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _record_id(digest, refers_to)), ("X-Refers-To-Page-Id", str(refers_to)),
        ]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


class Record(NamedTuple):
    fields: dict[str, str]
    payload: bytes
    payload_bytes: int


def parse_record(data: bytes) -> Record:
    """A record as `record_bytes` makes it; anything else is an error."""
    head, rest = data.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record starts here")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record does not end where its header says")
    http, payload = rest[:size].split(b"\r\n\r\n", 1)
    lengths = [line.split(b":", 1)[1] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    return Record(fields, payload, int(lengths[0]))


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The store that `path` names, as both the writing and the reading tasks open it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class _Archive:
    """One open archive of a task."""

    def __init__(self, folder: str, date: str):
        store, base = _filesystem(folder)
        self.name = f"{uuid.uuid4().hex}.warc.gz"
        self.out = store.open_output_stream(f"{base}/{self.name}", compression=None)
        self.size = 0
        body = b"software: kembar\r\nformat: WARC File Format 1.1\r\n"
        self.add(
            f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\n"
            f"Content-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n", 1
        )

    def add(self, record: bytes, level: int) -> tuple[int, int]:
        member = gzip.compress(record, level, mtime=0)
        self.out.write(member)
        place = (self.size, len(member))
        self.size += len(member)
        return place


def write_archives(
    pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, level: int = 1
) -> DataFrame:
    """Write each row of `with_originals` as a record below `folder`, and return the index as a written table.

    A task starts a new archive whenever one has `archive_bytes`. `page_id`, `url`, digest and place of each record are
    in the index; the payload is not.
    """
    spark = pages.sparkSession
    store, base = _filesystem(folder)
    store.create_dir(base, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            made = {name: [] for name in ("record_type", "payload_bytes", "archive", "offset", "length")}
            for page, url, payload, digest, refers_to in zip(
                *(columns[n].to_pylist() for n in ("page_id", "url", "payload", "payload_digest", "refers_to")), strict=True
            ):
                if archive is not None and archive.size >= archive_bytes:
                    archive.out.close()
                    archive = None
                archive = archive or _Archive(folder, date)
                offset, length = archive.add(record_bytes(page, url, payload, digest, refers_to, date), level)
                for name, value in zip(
                    made, ("response" if refers_to is None else "revisit", len(payload), archive.name, offset, length),
                    strict=True,
                ):
                    made[name].append(value)
            yield pa.RecordBatch.from_pydict({
                "page_id": columns["page_id"], "url": columns["url"], "record_type": pa.array(made["record_type"], pa.string()),
                "refers_to": columns["refers_to"], "payload_bytes": pa.array(made["payload_bytes"], pa.int64()),
                "payload_digest": columns["payload_digest"], "archive": pa.array(made["archive"], pa.string()),
                "offset": pa.array(made["offset"], pa.int64()), "length": pa.array(made["length"], pa.int64()),
            })
        if archive is not None:
            archive.out.close()

    rows = pages.select("page_id", "url", "payload", "payload_digest", "refers_to")
    index = rows.mapInArrow(write, INDEX)
    path = f"{folder}/index"
    index.write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def requests(places: list[tuple[str, int, int]], gap: int, most: int) -> list[tuple[int, int]]:
    """Half-open runs of sorted (archive, offset, length) that are read together."""
    runs: list[tuple[int, int]] = []
    for at, (archive, offset, length) in enumerate(places):
        if runs:
            first, _ = runs[-1]
            last = places[at - 1]
            near = last[0] == archive and offset - (last[1] + last[2]) <= gap
            if near and offset + length - places[first][1] <= most:
                runs[-1] = (first, at + 1)
                continue
        runs.append((at, at + 1))
    return runs


def read_records(
    selected: DataFrame, folder: str, gap: int = GAP_BYTES, most: int = REQUEST_BYTES, payloads: bool = True
) -> DataFrame:
    """The records that rows of the index name, read from the archives below `folder`.

    What is returned comes from the archives: type, ids and length from the headers, the digest from the payload where the
    record holds one, else from its header. A record that disagrees with the index is an error. A record longer than
    `most` is read alone.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, handle = None, None
        for batch in batches:
            places = list(zip(*(batch.column(n).to_pylist() for n in ("archive", "offset", "length")), strict=True))
            urls, digests = batch.column("url").to_pylist(), batch.column("payload_digest").to_pylist()
            for first, last in requests(places, gap, most):
                if places[first][0] != name:
                    name = places[first][0]
                    store, base = _filesystem(folder)
                    handle = store.open_input_file(f"{base}/{name}")
                start = places[first][1]
                data = handle.read_at(max(o + n for _, o, n in places[first:last]) - start, start)
                out: dict[str, list] = {field: [] for field in _RECORD_NAMES}
                for at in range(first, last):
                    _, offset, length = places[at]
                    row = _read_back(gzip.decompress(data[offset - start:offset - start + length]), digests[at])
                    row["url"] = urls[at]
                    row["payload"] = row["payload"] if payloads else None
                    for field in out:
                        out[field].append(row[field])
                yield pa.RecordBatch.from_pydict({f: pa.array(out[f], t) for f, t in _RECORD_NAMES.items()})

    rows = selected.select("archive", "offset", "length", "url", "payload_digest")
    ordered = rows.repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(read, RECORDS)


_RECORD_NAMES = {
    "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
    "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary(),
}


def _read_back(data: bytes, known: str) -> dict:
    record = parse_record(data)
    fields = record.fields
    kind = fields["WARC-Type"]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if kind == "response":
        digest = hashlib.sha1(record.payload).hexdigest()
        if len(record.payload) != record.payload_bytes:
            raise ValueError("a payload is not as long as its HTTP header says")
    if digest != known:
        raise ValueError("the index names another payload than the archive holds")
    page, refers_to = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
    return {
        "page_id": None if page is None else int(page), "record_type": kind,
        "refers_to": None if refers_to is None else int(refers_to), "payload_bytes": record.payload_bytes,
        "payload_digest": digest, "payload": record.payload if kind == "response" else None,
    }


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives among the session's tables."""
    return runtime.table_path(spark, "warc")
