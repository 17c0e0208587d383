"""WARC archives: written with an index, read back by sorted byte ranges.

Each task writes archives of its own name, so a repeated task never touches another's file, and
only archives of tasks that ended well are in the index. Archives hold one gzip member per record.
Their folder is reached through ``pyarrow.fs``, so it may be local, HDFS or an object store.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import same, stage
from tallywell.session import shared_dir

ARCHIVE_BYTES = 1 << 30
TASK_BYTES = 128 << 20  # fetched by one reading task
LEAST_TASK_BYTES = 1 << 20
READ_BYTES = 8 << 20
READ_GAP = 64 << 10
INDEX_SCHEMA = (
    "archive string, offset long, length long, url string, payload_digest string, record_type string, "
    "page_id long, refers_to long"
)
RECORD_SCHEMA = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "payload binary"
)
# The profile of a revisit to equal payload, and the crlf between parts.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    return None if urn is None or urn == _urn(None) else int(urn.rsplit(":", 1)[1].rstrip(">"))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP head, whose length is that of the full payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        *([("WARC-Target-URI", " ".join(url.split()))] if url is not None else []),
        *([("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", SAME_PAYLOAD)] if revisit else []),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"".join([b"WARC/1.1\r\n", *(f"{k}: {v}\r\n".encode() for k, v in fields), CRLF, block, CRLF, CRLF])


def parse(raw: bytes) -> dict:
    """The fields of a record of ``record``; checks lengths, and the digest of a response."""
    head, _, rest = raw.partition(CRLF + CRLF)
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if not version.startswith("WARC/") or rest[size:] != CRLF + CRLF:
        raise ValueError("not a whole WARC record")
    http, _, payload = rest[:size].partition(CRLF + CRLF)
    declared = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != declared or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": _page_of(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": _page_of(fields.get("WARC-Refers-To")),
        "payload_bytes": declared,
        "payload_digest": digest,
        "payload": None if revisit else payload,
    }


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if ":/" in path else (pyarrow.fs.LocalFileSystem(), path)


def write_archives(
    pages: DataFrame, root: str, min_payload: int = 0, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Writes ``(page_id, url, html)`` to archives under ``root``; returns their index, one row per record.

    Of records with equal payloads of at least ``min_payload`` bytes the smallest page_id is a
    response and the others revisit it. A null html is an empty payload. A row without page_id is a
    response and is never revisited, and rows that repeat the smallest page_id of a payload are all
    responses. A null url leaves the field out; blanks in a url become single spaces. Other columns
    are ignored. The index is a written table.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    size = F.octet_length("payload")
    first = (
        rows.where(size >= min_payload).groupBy("sha1").agg(F.min("page_id").alias("first"))
    )
    refers_to = F.when((size >= min_payload) & (F.col("page_id") != F.col("first")), F.col("first"))
    planned = rows.join(first, same(rows["sha1"], first["sha1"]), "left").select(
        "page_id", "url", "payload", refers_to.alias("refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _open(root)
        fs.create_dir(folder, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            index = []
            for row in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                page_id, url, payload, target = row
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None, buffer_size=1 << 20)
                digest = base32_sha1(payload)
                squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = squeeze.compress(record(page_id, url, payload, target, digest)) + squeeze.flush()
                out.write(member)
                kind = "response" if target is None else "revisit"
                index.append((name, at, len(member), url, digest, kind, page_id, target))
                at += len(member)
            if index:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*index), _TYPES, strict=True)], names=_NAMES)
        if out is not None:
            out.close()

    return stage(planned.mapInArrow(write, INDEX_SCHEMA), "warc-index")


_NAMES = [f.split()[0] for f in INDEX_SCHEMA.split(", ")]
_TYPES = [pa.int64() if f.split()[1] == "long" else pa.string() for f in INDEX_SCHEMA.split(", ")]
_RECORD_TYPES = [
    (f.split()[0], {"long": pa.int64(), "binary": pa.binary()}.get(f.split()[1], pa.string()))
    for f in RECORD_SCHEMA.split(", ")
]


def read_records(index: DataFrame, root: str, read_bytes: int = READ_BYTES, gap: int = READ_GAP) -> DataFrame:
    """The records that the rows of ``index`` select, read back from the archives.

    Rows are range-partitioned and sorted by place, so a large archive is shared by tasks, and
    neighbouring records are fetched in one read of at most ``read_bytes`` (or one record). Tasks
    are as many as the bytes to fetch ask for, since the index rows themselves are small.
    """
    places = index.select("archive", "offset", "length")
    total = places.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    at_hand = min(2 * index.sparkSession.sparkContext.defaultParallelism, -(-total // LEAST_TASK_BYTES))
    tasks = max(1, at_hand, -(-total // TASK_BYTES))
    sorted_places = places.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")

    def flush(fs, folder: str, run: list[tuple[str, int, int]]) -> list[dict]:
        name, start = run[0][0], run[0][1]
        end = max(at + n for _, at, n in run)
        with fs.open_input_file(f"{folder}/{name}") as f:
            data = f.read_at(end - start, start)
        return [parse(zlib.decompress(data[at - start : at - start + n], 31)) for _, at, n in run]

    def batch_of(records: list[dict]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[c] for r in records], t) for c, t in _RECORD_TYPES], names=[c for c, _ in _RECORD_TYPES])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _open(root)
        run: list[tuple[str, int, int]] = []
        for batch in batches:
            for place in zip(*(batch[c].to_pylist() for c in ("archive", "offset", "length")), strict=True):
                name, at, n = place
                if run:
                    end = run[-1][1] + run[-1][2]
                    if name != run[0][0] or at - end > gap or at + n - run[0][1] > read_bytes:
                        yield batch_of(flush(fs, folder, run))
                        run = []
                run.append(place)
        if run:
            yield batch_of(flush(fs, folder, run))

    return sorted_places.mapInArrow(read, RECORD_SCHEMA)


def round_trip(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Archives of ``pages`` in the shared folder, indexed and read back; one row per page."""
    root = shared_dir(pages.sparkSession, "warc")
    return read_records(write_archives(pages, root, min_payload), root)
