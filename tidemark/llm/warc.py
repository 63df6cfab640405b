"""WARC archives: one gzip member per record, written and read back in sequence by tasks.

Writing: payloads are digested in Spark; of the records with equal payloads of at least REVISIT_FROM bytes, the one with
the largest page_id is the response and the others are revisits without a body. Each task writes archives of about
ARCHIVE_BYTES into the shared folder, under names of its own attempt; only the paths that reached the manifest, itself
written to the shared folder, are read, so a lost or repeated task leaves nothing behind that counts.

Reading: a task goes through an archive in blocks, decompresses one member after the other, frames each record by its
content length and verifies payload and block digests; it holds a block and a record's header, never a whole archive.

Defined cases: null html is an empty payload; null or odd urls are written as a urn of the page, without line breaks; a
null page_id is read back as null, and counts as smaller than any other; rows that repeat a page_id with an equal
payload have the same type; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, in_batches, shared_dir, written

REVISIT_FROM, ARCHIVE_BYTES, BLOCK = 1000, 1 << 30, 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit's block is the HTTP head alone."""
    urn = f"urn:page:{'' if page_id is None else page_id}"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if not revisit:
        block += payload
    target = re.sub(r"[\r\n]+", " ", url or "").strip() or urn
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{urn}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{_b32(bytes.fromhex(digest))}", f"WARC-Block-Digest: sha1:{_b32(hashlib.sha1(block).digest())}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def decided(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, revisit, refers_to.

    The payloads that repeat are a table of their own before they meet the rows: few of them go to the rows, and many are met in a
    shuffle in which Spark can split the page of which there are very many copies.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    big = rows.where(F.col("payload_bytes") >= REVISIT_FROM).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("n"))
    big = written(big.where("n > 1").select("payload_digest", "payload_bytes", "target"))
    met = rows.join(big, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("target").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("target"))
    return met.select("page_id", "url", "payload", "payload_bytes", "payload_digest", revisit.alias("revisit"), F.when(revisit, F.col("target")).alias("refers_to"))


def _writing(folder: str, most: int):
    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        out, path, size, n = None, "", 0, 0

        def close():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

        for batch in batches:
            names = ("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to", "revisit")
            for i in range(batch.num_rows):
                if out is None:
                    path, size, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                data = record(*(batch[c][i].as_py() for c in names))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= most:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write(pages: DataFrame, folder: str, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives under folder and returns their manifest: path, records."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return checkpoint(in_batches(decided(pages), _writing(folder, most), "path string, records long"))


def _head(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


class _Record:
    """Takes one member's bytes as they come and hashes its block without holding it."""

    def __init__(self):
        self.pending, self.head, self.left = bytearray(), None, 0
        self.block, self.payload, self.size, self.http = hashlib.sha1(), hashlib.sha1(), 0, None

    def feed(self, data: bytes) -> None:
        self.pending += data
        if self.head is None:
            at = self.pending.find(b"\r\n\r\n")
            if at < 0:
                return
            self.head = _head(bytes(self.pending[:at]))
            self.left = int(self.head["content-length"])
            del self.pending[: at + 4]
        if self.left and self.pending:
            part = bytes(self.pending[: self.left])
            del self.pending[: len(part)]
            self.left -= len(part)
            self.block.update(part)
            if self.http is None:  # an HTTP head is short and stands at the beginning
                self.lead = getattr(self, "lead", b"") + part
                at = self.lead.find(b"\r\n\r\n")
                if at < 0:
                    return
                self.http, part = self.lead[:at], self.lead[at + 4 :]
                self.lead = b""
            self.payload.update(part)
            self.size += len(part)

    def done(self) -> tuple[int | None, int, str, str, int | None]:
        if self.head is None or self.left or bytes(self.pending) != b"\r\n\r\n":
            raise ValueError("a record does not end where its content length says")
        stated = lambda name: base64.b32decode(self.head[name].removeprefix("sha1:"))
        if self.block.digest() != stated("warc-block-digest"):
            raise ValueError(f"block digest differs: {self.head['warc-record-id']}")
        kind, digest, size = self.head["warc-type"], stated("warc-payload-digest"), self.size
        page = lambda name: int(x) if (x := self.head[name].removeprefix("<urn:page:").removesuffix(">")) else None
        if kind == "revisit":
            found = re.search(rb"(?im)^content-length:\s*(\d+)", self.http or b"")
            return page("warc-record-id"), int(found[1]), digest.hex(), kind, page("warc-refers-to")
        if self.payload.digest() != digest:
            raise ValueError(f"payload digest differs: {self.head['warc-record-id']}")
        return page("warc-record-id"), size, digest.hex(), kind, None


def records(stream, block: int = BLOCK) -> Iterator[tuple[int | None, int, str, str, int | None]]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each member of an archive, in sequence."""
    unpack, rec = zlib.decompressobj(31), _Record()
    began = False
    while data := stream.read(block):
        while data:
            began = True
            rec.feed(unpack.decompress(data, block))
            while unpack.unconsumed_tail and not unpack.eof:
                rec.feed(unpack.decompress(unpack.unconsumed_tail, block))
            if not unpack.eof:
                break
            data = unpack.unused_data
            yield rec.done()
            unpack, rec, began = zlib.decompressobj(31), _Record(), False
    if began:
        raise ValueError("the archive ends inside a member")


_ROWS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _reading(folder: str):
    def run(batches):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch["path"].to_pylist():
                with store.open_input_stream(path, compression=None) as stream:
                    held: list[tuple] = []
                    for row in records(stream):
                        held.append(row)
                        if len(held) == 5000:
                            yield pa.RecordBatch.from_pylist([dict(zip(_ROWS.names, r, strict=True)) for r in held], _ROWS)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_pylist([dict(zip(_ROWS.names, r, strict=True)) for r in held], _ROWS)

    return run


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the archives in a manifest, each archive by one task."""
    archives = manifest.select("path").repartition(max(1, manifest.count()))
    return in_batches(archives, _reading(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read(write(pages, folder), folder)
