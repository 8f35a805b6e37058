"""WARC archives with a two-level capture index.

Captures are sorted by reversed-host URL key.  An index file holds blocks of sorted, compressed
entries and, at its end, a sparse directory with the first key of each block.  A look-up finds the
files by their key bounds, the block by binary search in the directory, the entries by binary
search in the block, and reads just the records it wants.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, map_rows, stored
from .files import Readers, new_folder, open_to_write, own_name

BLOCK_ENTRIES = 1000
LEAST_REVISIT = 100  # bytes of a payload that is stored once
DATE = "2024-01-01T00:00:00Z"
_FOOTER = 16


def url_key(url: str | None) -> str:
    """Reversed host, path and query; NULL and URLs without a host sort by themselves."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return ")" + url
    if not host:
        return ")" + url
    name = ",".join(reversed(host.split(".")))
    port_text = f":{port}" if port not in (None, 80, 443) else ""
    return f"{name}{port_text}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def header_text(url: str | None) -> str:
    """URL for a header line: no control characters, no blanks."""
    return re.sub(r"[\x00-\x20\x7f\x85  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record as a gzip member; a revisit keeps the HTTP head and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{page_id}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {header_text(url)}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """Fields of a record; payload length and digest come from the payload where there is one."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda name: (m := re.fullmatch(r"<urn:x-page:(-?\d+)>", fields.get(name, ""))) and int(m[1])
    declared = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response":
        n, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if digest != declared:
            raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    else:
        n, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), declared
    return {
        "page_id": page("WARC-Record-ID"), "payload_bytes": n, "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": page("WARC-Refers-To"), "payload": payload,
    }


@dataclass(frozen=True)
class Archive:
    """A folder of archives and index files, and the key bounds of each index file."""

    folder: str
    bounds: DataFrame  # file, first_key, last_key, entries


def records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): equal payloads of enough bytes refer to the one of
    the smallest page_id.  A NULL page_id never is the smallest."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256))
    large = base.where(F.octet_length("payload") >= LEAST_REVISIT)
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    joined = base.join(firsts, "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write(pages: DataFrame) -> Archive:
    """Archives and index of all ``pages`` (page_id, url, html; NULL html: empty payload).

    Rows that repeat a page_id get a record each.  Hot payloads are split by the skew handling of
    the join, hot URLs by ranges of (key, page_id).
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, name, at = None, None, 0
        for b in batches:
            if sink is None and b.num_rows:
                name = own_name("pages", "warc.gz")
                sink = open_to_write(folder, name)
            keys, offsets, lengths = [], [], []
            columns = [b.column(i).to_pylist() for i in range(5)]
            for page_id, url, payload, digest, refers_to in zip(*columns, strict=True):
                member = record(page_id, url, payload.encode(), digest, refers_to)
                sink.write(member)
                keys.append(url_key(url))
                offsets.append(at)
                lengths.append(len(member))
                at += len(member)
            made = [pa.array(keys, pa.string()), b.column(0), pa.array([name] * len(keys), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())]
            yield pa.RecordBatch.from_arrays(made, ["key", "page_id", "file", "offset", "length"])
        if sink is not None:
            sink.close()

    captures = stored(in_arrow(records(pages), archive, "key string, page_id long, file string, offset long, length long"), "captures")
    ordered = captures.repartitionByRange(shards, "key", "page_id").sortWithinPartitions("key", "page_id")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, held, directory, at, n, last = None, [], [], 0, 0, None

        def flush() -> None:
            nonlocal at
            block = zlib.compress(json.dumps(held).encode())
            sink.write(block)
            directory.append([held[0][0], at, len(block)])
            at += len(block)

        for b in batches:
            if sink is None and b.num_rows:
                name = own_name("index", "blocks")
                sink = open_to_write(folder, name)
            for entry in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                held.append(entry)
                n, last = n + 1, entry[0]
                if len(held) == BLOCK_ENTRIES:
                    flush()
                    held = []
        if sink is None:
            return
        if held:
            flush()
        tail = zlib.compress(json.dumps(directory).encode())
        sink.write(tail + at.to_bytes(8, "little") + len(tail).to_bytes(8, "little"))
        sink.close()
        yield pa.RecordBatch.from_pydict({"file": [name], "first_key": [directory[0][0]], "last_key": [last], "entries": [n]})

    return Archive(folder, stored(in_arrow(ordered, index, "file string, first_key string, last_key string, entries long"), "bounds"))


class IndexFile:
    """Binary search in one index file; one block is held at a time."""

    def __init__(self, readers: Readers, name: str):
        self.readers, self.name = readers, name
        size = readers.get(name).size()
        foot = readers.read(name, size - _FOOTER, _FOOTER)
        self.directory = json.loads(zlib.decompress(readers.read(name, int.from_bytes(foot[:8], "little"), int.from_bytes(foot[8:], "little"))))
        self.firsts = [d[0] for d in self.directory]
        self.held: tuple[int, list] = (-1, [])

    def block(self, number: int) -> list:
        if self.held[0] != number:
            _, offset, length = self.directory[number]
            self.held = (number, json.loads(zlib.decompress(self.readers.read(self.name, offset, length))))
        return self.held[1]

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of all captures of a key."""
        number = max(0, bisect_left(self.firsts, key) - 1)
        while number < len(self.firsts) and self.firsts[number] <= key:
            entries = self.block(number)
            low = bisect_left(entries, key, key=lambda e: e[0])
            for e in entries[low : bisect_right(entries, key, low, key=lambda e: e[0])]:
                yield e[1], e[2], e[3]
            number += 1


def fetch(archive: Archive, urls: DataFrame, payload: bool = False) -> DataFrame:
    """All captures of the distinct keys of ``urls`` (a column ``url``), read from the archives.

    The key bounds of the index files, one row per file and so at most one per shuffle partition,
    route each key to the files that may hold it; a key that fills many files is read by as many
    tasks.  URLs without a capture give no row.
    """
    spark = urls.sparkSession
    bounds = sorted((r.first_key, r.last_key, r.file) for r in archive.bounds.collect())
    firsts, lasts, names = ([b[i] for b in bounds] for i in range(3))
    folder = archive.folder

    def route(c: dict):
        keys, files = [], []
        for key in {url_key(u) for u in c["url"].to_pylist()}:
            for i in range(bisect_left(lasts, key), bisect_right(firsts, key)):
                keys.append(key)
                files.append(names[i])
        return {"key": keys, "file": files}

    routed = map_rows(urls.select("url"), route, "key string, file string").distinct()
    names_out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers, index = Readers(folder), None
        for b in batches:
            out: dict[str, list] = {n: [] for n in names_out}
            for key, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if index is None or index.name != file:
                    index = IndexFile(readers, file)
                for name, offset, length in index.find(key):
                    found = parse(readers.read(name, offset, length))
                    for n in names_out:
                        out[n].append(found[n])
                    if len(out["page_id"]) >= 1000:
                        yield pa.RecordBatch.from_pydict(out, schema=schema)
                        out = {n: [] for n in names_out}
            yield pa.RecordBatch.from_pydict(out, schema=schema)
        readers.close()

    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(n, kinds[n]) for n in names_out])
    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    dealt = routed.repartition(max(1, len(names)), "file").sortWithinPartitions("file", "key")
    return in_arrow(dealt, read, ddl)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages and read every capture back through the index."""
    return fetch(write(pages), pages)
