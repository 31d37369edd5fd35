"""WARC archives with a two-level capture index.

:func:`write_archives` writes a gzip member a record, one or more files a task; records whose payload
(at least ``min_bytes``) equals that of another become revisits of the one with the largest page_id.
Only digests are compared across tasks, so pages aren't shuffled as long as the table of repeated
digests, which is counted first, may be broadcast; beyond that they are joined by shuffle.

:func:`write_index` sorts captures by reversed-host URL key and page_id over ranges of equal size, so
that a hot host is split. A range is a shard: a file of compressed blocks of ``BLOCK_LINES`` lines and
a sparse directory of the blocks' first keys. :func:`locate` finds a key's shard in the list of shards
(one entry a task), binary-searches the shard's directory and reads only the block's range;
:func:`fetch` reads the records, by ranges of files of about equal bytes.

Files are named anew by each attempt, and the tables of captures and shards, committed by Spark, list
those that count: a lost executor or a second attempt leaves at most files that nobody reads. All
paths go through ``pyarrow.fs``, so the shared folder may be a remote store.

A null html is an empty payload, a null url has the key ``-``, a null page_id is kept as null, control
characters of URLs are percent-encoded. Repeated rows are captures each; of records with one payload
all with the largest page_id are responses (a group without any page_id has no revisits). An empty
table gives an empty table; extra columns aren't read. Very long pages are single records.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from typing import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import fits_broadcast, lean, materialize, new_path

BLOCK_LINES = 3000
SHARD_BLOCKS = 4
FILE_BYTES = 1 << 30
#: Compressed bytes of records that a task reads, and tasks at most (each reads more then, record by record).
READ_BYTES, MOST_TASKS = 4 << 20, 20_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def clean_url(url: str | None) -> str | None:
    return None if url is None else _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: ``com,example,www)/a?b``."""
    url = clean_url(url)
    if not url:
        return "-"
    rest = url.partition("://")[2] or url
    m = re.match(r"([^/?#]*)([^#]*)", rest)
    host, _, port = m[1].rpartition("@")[2].lower().partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (m[2] if m[2].startswith("/") else "/" + m[2])


def _id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    digits = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return int(digits) if digits else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _id(page_id)), ("WARC-Date", DATE)]
    fields += [("WARC-Target-URI", clean_url(url))] if url else []
    fields += [("WARC-Payload-Digest", f"sha1:{digest}")]
    fields += [("WARC-Refers-To", _id(refers_to)), ("WARC-Profile", PROFILE)] if revisit else []
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields, payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _gzip(data: bytes, level: int = 4) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _open(root: str):
    """File system and folder of a URI."""
    return pyarrow.fs.FileSystem.from_uri(root)


CAPTURES = "key string, page_id long, file string, offset long, length long"
_CAPTURES = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def write_archives(pages: DataFrame, root: str, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) into ``root``; the table of captures."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"), F.unhex(F.sha1(payload)).alias("sha"))
    groups = rows.where(F.length("payload") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    again = materialize(groups.where("n > 1").select("sha", "first"), "warc-again")
    side = F.broadcast(again) if fits_broadcast(again.count(), 64) else again
    marked = rows.join(side, "sha", "left").select("page_id", "url", "payload", "sha", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _open(root)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                kept: list[list] = [[] for _ in _CAPTURES]
                for page_id, url, data, sha, first in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{folder}/{name}", compression=None)
                    revisit = first is not None and first != page_id and len(data) >= min_bytes
                    packed = _gzip(record(page_id, url, data, base64.b32encode(sha).decode(), first if revisit else None, revisit))
                    out.write(packed)
                    for column, value in zip(kept, (url_key(url), page_id, name, at, len(packed))):
                        column.append(value)
                    at += len(packed)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(kept, _CAPTURES)], schema=_CAPTURES)
        finally:
            if out is not None:
                out.close()

    _make(root)
    return materialize(marked.mapInArrow(lean(run), CAPTURES), "warc-captures")


def _make(root: str) -> None:
    store, folder = _open(root)
    store.create_dir(folder, recursive=True)


def _tasks(total: int, share: int) -> int:
    return min(max(-(-total // share), 1), MOST_TASKS)


def _line(key: str, page_id: int | None, file: str, offset: int, length: int) -> str:
    return f"{key} {'' if page_id is None else page_id} {file} {offset} {length}\n"


def _order(key: str, page_id: int | None) -> tuple:
    """As Spark sorts: bytes of the key, then page_id, null first."""
    return key.encode(), page_id is not None, page_id or 0


def write_index(captures: DataFrame, root: str, lines: int = BLOCK_LINES) -> DataFrame:
    """Write sorted, compressed blocks and their directories; the list of shards (first key, last key, name)."""
    shards = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("name", pa.string()), ("blocks", pa.int64()), ("lines", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _open(root)
        name, at, total, block, firsts = uuid.uuid4().hex, 0, 0, [], []

        def flush() -> None:
            nonlocal at, block, total
            packed = _gzip("".join(_line(*x) for x in block).encode())
            out.write(packed)
            firsts.append((block[0][0], block[0][1], at, len(packed)))
            at, total, block = at + len(packed), total + len(block), []

        out = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = store.open_output_stream(f"{folder}/{name}.cdx.gz", compression=None)
                block.append(row)
                if len(block) == lines:
                    flush()
        if out is not None:
            if block:
                flush()
            out.close()
            with store.open_output_stream(f"{folder}/{name}.idx", compression=None) as directory:
                directory.write("".join(f"{k} {'' if p is None else p} {a} {n}\n" for k, p, a, n in firsts).encode())
            yield pa.RecordBatch.from_pylist([{"key": firsts[0][0], "page_id": firsts[0][1], "name": name, "blocks": len(firsts), "lines": total}], schema=shards)

    ordered = captures.select("key", "page_id", "file", "offset", "length").repartitionByRange(_tasks(captures.count(), SHARD_BLOCKS * lines), "key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")
    return materialize(ordered.mapInArrow(lean(run), "key string, page_id long, name string, blocks long, lines long"), "warc-shards")


class Shard:
    """A shard's directory, and the last block that was read."""

    def __init__(self, store, folder: str, name: str):
        with store.open_input_stream(f"{folder}/{name}.idx") as f:
            rows = [x.split(" ") for x in f.read().decode().splitlines()]
        self.firsts = [_order(k, int(p) if p else None) for k, p, _, _ in rows]
        self.ranges = [(int(a), int(n)) for _, _, a, n in rows]
        self.file = store.open_input_file(f"{folder}/{name}.cdx.gz")
        self.block, self.entries = -1, {}

    def find(self, key: str, page_id: int | None) -> list[tuple[str, int, int]]:
        want, found = _order(key, page_id), []
        at = max(bisect.bisect_left(self.firsts, want) - 1, 0)  # equal keys may begin in the block before
        while at < len(self.firsts) and self.firsts[at] <= want:
            if at != self.block:
                offset, length = self.ranges[at]
                self.block, self.entries = at, {}
                for line in zlib.decompress(self.file.read_at(length, offset), 31).decode().splitlines():
                    k, p, file, a, n = line.split(" ")
                    self.entries.setdefault((k, p), []).append((file, int(a), int(n)))
            found += self.entries.get((key, "" if page_id is None else str(page_id)), [])
            at += 1
        return found


def locate(wanted: DataFrame, shards: DataFrame, root: str) -> DataFrame:
    """Captures of the distinct (url, page_id) of ``wanted``, found through the index."""
    listed = sorted(((_order(r["key"], r["page_id"]), r["name"]) for r in shards.collect()), key=lambda x: x[0])  # a row a task that wrote the index
    firsts, names = [x[0] for x in listed], [x[1] for x in listed]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("shard", pa.int32())])
        for batch in batches:
            out: list[list] = [[], [], []]
            for url, page_id in zip(*(c.to_pylist() for c in batch.columns)):
                key = url_key(url)
                want = _order(key, page_id)
                last = bisect.bisect_right(firsts, want) - 1
                shard = max(bisect.bisect_left(firsts, want) - 1, 0)  # a key may go on in the next shards
                while shard <= last:
                    for column, value in zip(out, (key, page_id, shard)):
                        column.append(value)
                    shard += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema)], schema=schema)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _open(root)
        number, shard = -1, None
        for batch in batches:
            kept: list[list] = [[] for _ in _CAPTURES]
            for key, page_id, n in zip(*(c.to_pylist() for c in batch.columns)):
                if n != number:
                    number, shard = n, Shard(store, folder, names[n])
                for file, offset, length in shard.find(key, page_id):
                    for column, value in zip(kept, (key, page_id, file, offset, length)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(kept, _CAPTURES)], schema=_CAPTURES)

    distinct = wanted.select("url", F.col("page_id").cast("long")).distinct()
    placed = distinct.mapInArrow(lean(place), "key string, page_id long, shard int").distinct()
    by_shard = placed.repartition(max(len(names), 1), "shard").sortWithinPartitions("shard", "key", "page_id")
    return by_shard.mapInArrow(lean(look), CAPTURES)


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def fetch(captures: DataFrame, root: str) -> DataFrame:
    """What the located records say; a response's payload is checked against its digest and length.

    Ranges of ``READ_BYTES`` of a file are dealt out, so that as many tasks read as the records' bytes ask for."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _open(root)
        name, file = None, None
        for batch in batches:
            rows = []
            for own, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if own != name:
                    name, file = own, store.open_input_file(f"{folder}/{own}")
                fields, http, payload = parse(zlib.decompress(file.read_at(length, offset), 31))
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                revisit = fields["WARC-Type"] == "revisit"
                if not revisit and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != int(http["Content-Length"])):
                    raise ValueError(f"the payload at {own}:{offset} is damaged")
                rows.append((_page(fields["WARC-Record-ID"]), int(http["Content-Length"]), digest, fields["WARC-Type"], _page(fields["WARC-Refers-To"]) if revisit else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(schema)], schema=schema)

    captures = materialize(captures.select("file", "offset", "length"), "warc-located")
    tasks = _tasks(captures.agg(F.sum("length")).first()[0] or 0, READ_BYTES)
    by_range = captures.repartition(tasks, "file", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("file", "offset")
    return by_range.mapInArrow(lean(run), RECORDS)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    root = new_path(spark, "warc")
    captures = write_archives(pages, root)
    shards = write_index(captures, root)
    return fetch(locate(pages, shards, root), root)


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h, {1 + 5 * (k // 4)}, 5))::BIGINT // {32 ** (3 - k % 4)} % 32)::INTEGER, 1)" for k in range(32))
OP9_SQL = f"""
WITH hashed AS (
  SELECT page_id, octet_length(encode(COALESCE(html, '')))::BIGINT AS payload_bytes, sha1(COALESCE(html, '')) AS h FROM pages
), grouped AS (SELECT h, max(page_id) AS first_id FROM hashed GROUP BY h)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN first_id END AS refers_to
FROM hashed JOIN grouped USING (h)
"""
