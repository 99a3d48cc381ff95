"""WARC archives: one gzip member per record, written and read as streams.

Each task writes one archive in the cluster's shared folder, under a name of its own
that is put in place only when complete, so a task that runs again replaces its file.
The reader goes through an archive in blocks of bounded size: it inflates member after
member, takes a record's block by its Content-Length and checks the digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from drawbom.llm.shared import bytes_of, settle, shared_folder

CHUNK = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_BYTES = 4 << 20


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int, url: str | None, payload: bytes, first: int | None, date: str) -> bytes:
    """One record, compressed as a gzip member; a revisit carries the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if first is None else b"")
    uri = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "about:blank")
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
            "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{base32(hashlib.sha1(payload).digest())}",
            f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}", f"X-Page-ID: {page_id}"]
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first)}", f"X-Refers-To-Page-ID: {first}"]
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^(file:)?/+", "file:///", folder))


def first_pages(pages: DataFrame) -> DataFrame:
    """`page_id, sha, first` of the pages that repeat the payload of a smaller page_id."""
    ids = pages.select("page_id", F.sha1("raw").alias("sha"))
    groups = settle(ids.groupBy("sha").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last").select("sha", "first"), "payloads")
    return settle(ids.join(groups, "sha").filter("page_id > first").distinct(), "revisits")


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write pages(page_id, url, html) below `folder`; `path, records` of each archive."""
    given = pages.filter("page_id IS NOT NULL").select("page_id", "url", bytes_of("html").alias("raw"))
    rows = given.withColumn("sha", F.sha1("raw")).join(first_pages(given), ["page_id", "sha"], "left").select("page_id", "url", "raw", "first")

    def write(batches):
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        final, own = f"{root}/part-{task.partitionId():06d}.warc.gz", f"{root}/.part-{task.partitionId():06d}-{uuid.uuid4().hex}"
        n = 0
        with store.open_output_stream(own, compression=None) as out:
            for batch in batches:
                for page, url, raw, first in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("raw"), batch.column("first").to_pylist()):
                    out.write(record(page, url, raw.as_py(), first, date))
                    n += 1
        store.move(own, final)
        yield pa.RecordBatch.from_arrays([pa.array([final[len(root) + 1:]]), pa.array([n], pa.int64())], ["path", "records"])
    return settle(rows.mapInArrow(write, "path string, records long"), "archives").filter("records > 0")


def members(stream) -> Iterator[Iterator[bytes]]:
    """The inflated bytes of each gzip member of a stream, in pieces of bounded size."""
    rest = stream.read(CHUNK)

    def inflate():
        nonlocal rest
        unzip, full = zlib.decompressobj(31), False
        while not unzip.eof:
            if not rest and not full and not (rest := stream.read(CHUNK)):
                raise ValueError("an archive ends inside a record")
            piece = unzip.decompress(rest, CHUNK)
            full = len(piece) == CHUNK
            rest = unzip.unused_data if unzip.eof else unzip.unconsumed_tail
            if piece:
                yield piece
        rest = rest or stream.read(CHUNK)
    while rest:
        yield inflate()


def records(stream) -> Iterator[tuple[dict, bytes]]:
    """Header fields (lower-case names) and block of each record; a wrong frame or digest raises ValueError."""
    for pieces in members(stream):
        held = b""
        while b"\r\n\r\n" not in held:
            piece = next(pieces, None)
            if piece is None:
                raise ValueError("a record has no header")
            held += piece
        head, _, body = held.partition(b"\r\n\r\n")
        first, *lines = head.decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        parts = [body, *pieces]
        whole = b"".join(parts)
        if whole[size:] != b"\r\n\r\n":
            raise ValueError("a record's length is not its Content-Length")
        block = whole[:size]
        if (said := fields.get("warc-block-digest")) and said != "sha1:" + base32(hashlib.sha1(block).digest()):
            raise ValueError(f"block digest of {fields.get('warc-record-id')}")
        yield fields, block


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """`page_id, url, record_type, payload_digest, refers_to, payload` of every record of the
    archives(path); payload is null for revisits, and payload digests are checked."""
    def read(batches):
        store, root = opened(folder)

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()))],
                                              ["page_id", "url", "record_type", "payload_digest", "refers_to", "payload"])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{path}", compression=None) as stream:
                    for fields, block in records(stream):
                        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        if payload is not None and base32(hashlib.sha1(payload).digest()) != digest:
                            raise ValueError(f"payload digest of {fields['warc-record-id']}")
                        refers = fields.get("x-refers-to-page-id")
                        rows.append((int(fields["x-page-id"]), fields["warc-target-uri"], kind, digest, int(refers) if refers else None, payload))
                        held += len(payload or b"")
                        if held > BATCH_BYTES or len(rows) >= 5000:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)
    return archives.select("path").repartitionByRange(max(1, archives.count()), "path").mapInArrow(
        read, "page_id long, url string, record_type string, payload_digest string, refers_to long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages(page_id, url, html) as archives and read them back: `page_id,
    payload_bytes, payload_digest, record_type, refers_to, url`.

    Of pages with one payload (a null html is the empty one) the smallest page_id is the
    response, rows that repeat it included; the others are revisits of it, whose length
    is that of the response read back. Rows without page_id are not written; an empty
    table gives no rows; a null url becomes about:blank; extra columns are ignored.
    """
    folder = shared_folder(pages.sparkSession, "warc")
    archives = write_archives(pages.select("page_id", "url", "html"), folder)
    index = settle(read_archives(archives, folder).select(
        "page_id", F.length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url"), "index")
    found = index.filter("record_type = 'response'")
    sizes = settle(found.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.first("payload_bytes").alias("size")), "responses")
    again = index.filter("record_type = 'revisit'").drop("payload_bytes").join(sizes, ["refers_to", "payload_digest"])
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    return found.select(columns).unionByName(again.withColumnRenamed("size", "payload_bytes").select(columns))
