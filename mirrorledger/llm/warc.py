"""WARC archives and a two-level capture index.

Archives: each task writes its pages as gzip members, one record each, to files of a shared folder. Of pages with equal
payloads the one with the largest page_id is a ``response``; the others are ``revisit`` records without payload, whose
HTTP header still tells the payload's length and whose WARC header its digest and the record it refers to.

Index: entries (reversed-host URL key, page_id, file, begin, length) are sorted over the whole collection; each task
writes one shard of compressed blocks and, at its end, the sparse directory with the first entry of each block. The
driver keeps only each shard's first entry. A lookup finds the shard and, in its directory, the block by binary search,
reads that block's range, searches in it, and gives the record's place; records are then read by range.

Files are named by task and a random part, and only those that a finished task reports are used, so a repeated task does no
harm. The folder must be one that every executor can write (a mounted one, or a store that Arrow's file systems reach).

A null page is an empty payload; a null URL has an empty key. Rows of equal page_id and payload are both responses if
theirs is the largest page_id. A null page_id is never the largest; such rows revisit the others if there are any. A
repeated row is a capture of its own. Empty tables give empty archives. Other columns may have any name.
"""

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import io_tasks, materialise, new_path
from .rows import join_same
from .urls import host_of

ARCHIVE_BYTES = 1 << 30
BLOCK_ENTRIES = 512
DATE = "2024-01-01T00:00:00Z"
ENTRY = "key string, page_id bigint, file string, begin bigint, length bigint"
_GZIP = 31  # window bits that make zlib write gzip members


def url_key(url: Column) -> Column:
    """``org,example,www)/path?query``: the host's labels in reverse, then what follows the host."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host = host_of(url)
    rest = F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*(.*)\z", 1)
    return F.when(url == "", "").otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(host == "", url).otherwise(rest))
    )


def _folder(uri: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    return system, path


def _name(page_id, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record as a gzip member. ``refers_to`` is the response's page_id for a revisit, else None."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_name(refers_to, digest)}",
        ]
    packer = zlib.compressobj(3, zlib.DEFLATED, _GZIP)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """The record's type, ids, payload length and digest; a response's payload is checked against its digest."""
    raw = zlib.decompress(member, _GZIP)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if len(payload) != size or found != digest:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    refers_to = fields.get("WARC-Refers-To", "").split(":")
    page = fields["WARC-Record-ID"].split(":")[2]
    return {
        "page_id": int(page) if page else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": int(refers_to[2]) if len(refers_to) > 2 else None,
    }


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes all pages; returns the written table of entries (key, page_id, file, begin, length)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        html.alias("html"),
        F.sha1(html.cast("binary")).alias("digest"),
        url_key(F.col("url")).alias("key"),
    )
    copies = rows.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # The narrow rows meet on the digest, of which one may be very frequent (skewed partitions are split, or the copies
    # broadcast where they are few); the payloads only on the page_id.
    narrow = rows.select("page_id", "digest").distinct().join(copies.drop("n"), "digest")
    revisits = narrow.where("first IS NOT NULL AND NOT (page_id <=> first)")
    planned = join_same(rows, revisits, ["page_id", "digest"], "left").select(
        "page_id", "url", "html", "digest", "key", "first"
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _folder(folder)
        name, out, at = "", None, 0
        for batch in batches:
            entries = []
            for page_id, url, page, digest, key, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                member = record(page_id, url, page.encode(), base64.b32encode(bytes.fromhex(digest)).decode(), first)
                out.write(member)
                entries.append((key, page_id, name, at, len(member)))
                at += len(member)
            columns = list(zip(*entries, strict=True)) or [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in ENTRY.split(", ")]
            )
        if out is not None:
            out.close()

    return materialise(planned.mapInArrow(write, ENTRY), "entries")[0]


def _order(key: str, page_id) -> tuple:
    """Sorts as Spark does: by code points, nulls first."""
    return key, page_id is not None, page_id or 0


def write_index(entries: DataFrame, folder: str, block_entries: int = BLOCK_ENTRIES) -> list[dict]:
    """Writes the sorted index; returns its shards in order: file, first entry, and where the directory is.

    One row per task reaches the driver.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _folder(folder)
        name, out, directory, at, held = f"shard-{uuid.uuid4().hex}.cdx", None, [], 0, []

        def flush() -> int:
            data = zlib.compress(json.dumps(held).encode(), 6)
            directory.append((held[0][0], held[0][1], at, len(data)))
            out.write(data)
            held.clear()
            return at + len(data)

        for batch in batches:
            for entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                held.append(entry)
                if len(held) == block_entries:
                    at = flush()
        if out is not None:
            if held:
                at = flush()
            data = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(data)
            out.close()
            first = directory[0]
            names = ["file", "key", "page_id", "begin", "length"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in zip(
                    (name, first[0], first[1], at, len(data)),
                    (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=names,
            )

    sort = ["key", "page_id", "file", "begin"]
    ordered = entries.repartitionByRange("key", "page_id").sortWithinPartitions(*sort)
    shards = ordered.mapInArrow(write, "file string, key string, page_id bigint, begin bigint, length bigint")
    return sorted((r.asDict() for r in shards.collect()), key=lambda r: _order(r["key"], r["page_id"]))


class Index:
    """Reads an index shard by shard; keeps one directory and one block."""

    def __init__(self, shards: list[dict], folder: str):
        self.shards, self.firsts = shards, [_order(s["key"], s["page_id"]) for s in shards]
        self.system, self.path = _folder(folder)
        self.shard = self.block = None

    def _open(self, shard: int) -> None:
        if self.shard != shard:
            s = self.shards[shard]
            self.file = self.system.open_input_file(f"{self.path}/{s['file']}")
            self.directory = json.loads(zlib.decompress(self.file.read_at(s["length"], s["begin"])))
            self.starts = [_order(d[0], d[1]) for d in self.directory]
            self.shard, self.block = shard, None

    def _load(self, block: int) -> None:
        if self.block != block:
            _, _, begin, length = self.directory[block]
            self.entries = json.loads(zlib.decompress(self.file.read_at(length, begin)))
            self.orders = [_order(e[0], e[1]) for e in self.entries]
            self.block = block

    def find(self, low: tuple, high: tuple) -> Iterator[list]:
        """Entries from ``low`` to ``high``, both included."""
        if not self.shards:
            return
        shard = max(0, bisect_left(self.firsts, low) - 1)
        while shard < len(self.shards) and (self.firsts[shard] <= high):
            self._open(shard)
            block = max(0, bisect_left(self.starts, low) - 1)
            while block < len(self.directory) and self.starts[block] <= high:
                self._load(block)
                yield from self.entries[bisect_left(self.orders, low) : bisect_right(self.orders, high)]
                block += 1
            shard += 1


def lookup(wanted: DataFrame, shards: list[dict], folder: str, by_page: bool = True) -> DataFrame:
    """Entries of the wanted (key, page_id) rows, or, unless ``by_page``, all captures under the wanted keys."""
    columns = ["key", "page_id"] if by_page else ["key"]
    rows = wanted.select(*columns).distinct()
    ordered = rows.repartitionByRange(*columns).sortWithinPartitions(*columns)
    shared = wanted.sparkSession.sparkContext.broadcast(shards)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, folder)
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in ENTRY.split(", ")]

        def out(entries: list) -> pa.RecordBatch:
            columns = list(zip(*entries, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        held: list = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low = _order(row[0], row[1]) if by_page else (row[0], False, 0)
                high = low if by_page else (row[0], True, float("inf"))
                for entry in index.find(low, high):
                    held.append(entry)
                    if len(held) == 10_000:
                        yield out(held)
                        held = []
        yield out(held)

    return ordered.mapInArrow(search, ENTRY)


def read_records(entries: DataFrame, folder: str) -> DataFrame:
    """Reads each entry's record by its range, file by file: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    places, _ = materialise(entries.select("file", "begin", "length"), "places")
    tasks = io_tasks(places, F.col("length"))
    ordered = places.repartitionByRange(tasks, "file", "begin").sortWithinPartitions("file", "begin")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _folder(folder)
        name, source = None, None
        for batch in batches:
            found = []
            for file, begin, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    name, source = file, system.open_input_file(f"{path}/{file}")
                found.append(parse(source.read_at(length, begin)))
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in found], k) for n, k in zip(names, kinds, strict=True)], names=names
            )

    return ordered.mapInArrow(read, schema)


def archive_folder(spark: SparkSession) -> str:
    """A new folder under the shared one."""
    return new_path(spark, "warc")
