"""WARC archives: a writer that records equal payloads once, and a reader that splits archives by byte ranges.

Each record is a gzip member of its own. The reader's tasks get byte ranges, not files: a task looks for the gzip magic in
its range, takes a place as a member only if what it decodes to begins with a WARC version line, reads that member to its
end even past the range, and so owns exactly the records that start inside its range. Archives lie in a shared folder,
reached through ``pyarrow.fs``; only archives in the writer's manifest are read, so attempts that failed leave no records.

Null payloads are empty ones. Equal payloads of ``LEAST_REVISIT`` bytes or more are found by their SHA-1 digest; the
largest page_id has the response, also if several rows share it. A page_id may occur with several payloads: each row is
judged by its own. Rows without a page_id are always responses and come back without one. Null URLs fall back to the
record's own id. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm.store import cut, fresh_path

LEAST_REVISIT, ARCHIVE_BYTES, SPLIT_BYTES, CHUNK, RANGES_A_CORE = 1000, 128 << 20, 8 << 20, 1 << 18, 16
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. ``digest``: the payload's SHA-1, hexadecimal. A revisit carries the HTTP header only."""
    own = f"urn:page:{'null' if page_id is None else page_id}"
    target = "".join(c for c in url or own if c not in "\r\n")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    lines = [
        VERSION.decode(),
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{own}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[2:2] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def parse(raw: bytes) -> dict:
    """A record's fields; the payload follows its HTTP header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda x: None if x == "<urn:page:null>" else int(x.strip("<>").rpartition(":")[2])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].split(":")[1]).hex()
    if fields["WARC-Type"] == "response":
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    refers_to = number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": refers_to, "payload_bytes": size, "payload_digest": digest, "payload": payload}


def records_in(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """The decoded records whose members start in ``[start, end)`` of an archive (a seekable file)."""
    at, window, base = start, b"", start  # window: bytes of the file from base on

    def more(upto: int) -> None:
        nonlocal window
        while base + len(window) < min(upto, size):
            file.seek(base + len(window))
            got = file.read(CHUNK)
            if not got:
                break
            window += got

    while at < end:
        window, base = window[at - base :] if base <= at <= base + len(window) else b"", at
        more(at + len(MAGIC))
        k = window.find(MAGIC)
        if k < 0:
            # keep what may be the magic's beginning
            at = base + max(len(window) - len(MAGIC) + 1, 1)
            if base + len(window) >= size:
                return
            continue
        at = base + k
        if at >= end:
            return
        window, base = window[k:], at
        member = _member(file, size, base, window)
        if member is None:
            at += 1
            continue
        raw, length = member
        yield raw
        at += length


def _member(file, size: int, at: int, window: bytes) -> tuple[bytes, int] | None:
    """(decoded bytes, compressed length) of a WARC record's member at ``at``, None if there is none."""
    expand, out, used, first = zlib.decompressobj(31), [], 0, True
    piece = window
    try:
        while True:
            out.append(expand.decompress(piece))
            used += len(piece)
            if first and sum(map(len, out)) >= 5:
                first = False
                if not b"".join(out).startswith(b"WARC/"):
                    return None
            if expand.eof:
                raw = b"".join(out)
                return (raw, used - len(expand.unused_data)) if raw.startswith(b"WARC/") else None
            if at + used >= size:
                return None
            file.seek(at + used)
            piece = file.read(CHUNK)
    except zlib.error:
        return None


def write(pages: DataFrame, folder: str) -> DataFrame:
    """``pages``: page_id, url, html. Writes archives and returns their manifest (path, bytes, records), materialised."""
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    keyed = keyed.withColumn("digest", F.sha1("payload"))
    large = keyed.where(F.length("payload") >= LEAST_REVISIT).select("page_id", "digest")
    # digests that several pages share, then the pages that revisit: small rows, and copies are combined before the shuffle
    shared = large.groupBy("digest").agg(F.max("page_id").alias("response"), F.min("page_id").alias("other")).where("response <> other").select("digest", "response")
    revisits = large.join(shared, "digest").where("page_id <> response").select("page_id", "digest", F.col("response").alias("refers_to")).distinct()
    rows = keyed.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = out = None
        size = count = 0
        done = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name, size, count = f"{path}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(name, compression=None)
                data = record(*row)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((name, size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, count))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done, strict=True)) or [[]] * 3, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "bytes", "records"])

    return cut(rows.mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


def read(manifest: DataFrame, folder: str, split_bytes: int | None = None, with_payload: bool = False) -> DataFrame:
    """The records of the manifest's archives, by byte ranges of ``split_bytes``: a task for each, or for a few of them once
    there are ``RANGES_A_CORE`` tasks a core. The number is given, as so small a table would be merged to one task."""
    split_bytes = split_bytes or SPLIT_BYTES
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    ranges = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    tasks = max(1, min(int(ranges), RANGES_A_CORE * manifest.sparkSession.sparkContext.defaultParallelism))
    splits = manifest.where("bytes > 0").select("path", "bytes", starts.alias("start")).repartition(tasks)
    names = [c.split()[0] for c in RECORDS.split(", ")] + ["payload"] * with_payload
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, size, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with store.open_input_file(path) as file:
                    rows = []
                    for raw in records_in(file, size, start, min(start + split_bytes, size)):
                        got = parse(raw)
                        rows.append([got[n] for n in names])
                        if len(rows) >= 2000 or (with_payload and len(rows) >= 50):
                            yield _batch(rows, names, types)
                            rows = []
                    yield _batch(rows, names, types)

    return splits.mapInArrow(run, RECORDS + ", payload binary" * with_payload)


def _batch(rows: list, names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(names), types, strict=False)], names=names)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and returns what is read back."""
    folder = fresh_path(pages.sparkSession, "warc")
    if "://" not in folder:
        folder = folder.replace("file:", "file://", 1) if folder.startswith("file:") else f"file://{folder}"
    return read(write(pages, folder), folder)
