"""WARC archives as seekable Zstandard bundles.

Writing. Records are grouped into frames of about ``frame_bytes``; each frame
is an independent Zstandard frame, and a bundle ends with the seek table of
the public seekable format (a skippable frame). A bundle is one row, at most
about ``bundle_bytes`` of input (one longer record is a frame and at most a
bundle of its own), written by Spark into the shared folder, so a lost task
is simply run again. Next to it an index maps every record to its bundle,
frame, and offset within the frame.

Equal payloads. Payloads of at least ``min_bytes`` are grouped by SHA-1 with a
partial aggregate; the group's largest page_id is the response, the others
are revisit records that refer to it and hold no payload. The page rows meet
their group in an equi-join, which Spark can split when a payload is frequent.

Reading finds each record through the seek table and the index, parses the
headers and checks the payload against its digest.

Defined results: a null html is an empty payload; a null page_id orders first
and is kept as null; of rows that repeat the largest page_id all are responses.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, small_batches

MIN_BYTES = 1000
FRAME_BYTES = 128 * 1024
BUNDLE_BYTES = 8 * 1024 * 1024
LEVEL = 3
# Fixed values of the seekable format: skippable frame magic, footer magic.
_SKIPPABLE, _FOOTER = 0x184D2A5E, 0x8F92EAB1
_CRLF = b"\r\n"


def record(page_id, url, payload: bytes, size: int, digest: str, refers_to, is_revisit: bool) -> bytes:
    """One WARC/1.1 record. ``size`` and ``digest`` are of the full payload, also for a revisit."""
    name = f"{page_id if page_id is not None else ''}"
    head = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("X-Payload-Length", str(size)),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", " ".join(url.split())))
    if is_revisit:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    body = b"" if is_revisit else payload
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(body)))]
    lines = _CRLF.join(f"{k}: {v}".encode("utf-8", "surrogatepass") for k, v in head)
    return b"WARC/1.1\r\n" + lines + _CRLF + _CRLF + body + _CRLF + _CRLF


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, body) of one record."""
    top, _, rest = raw.partition(_CRLF + _CRLF)
    lines = top.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    n = int(head["Content-Length"])
    if rest[n:] != _CRLF + _CRLF:
        raise ValueError("wrong record length")
    return head, rest[:n]


class Bundle:
    """Collects records into frames; ``close`` appends the seek table."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.frame_bytes, self.zstd = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[bytes] = []
        self.sizes: list[int] = []
        self.index: list[dict] = []
        self.open = bytearray()
        self.taken = 0

    def add(self, raw: bytes, page_id) -> None:
        if self.open and len(self.open) + len(raw) > self.frame_bytes:
            self._frame()
        self.index.append({"page_id": page_id, "frame": len(self.frames), "offset": len(self.open), "length": len(raw)})
        self.open += raw
        self.taken += len(raw)

    def _frame(self) -> None:
        self.frames.append(self.zstd.compress(bytes(self.open)))
        self.sizes.append(len(self.open))
        self.open.clear()

    def close(self) -> bytes:
        if self.open:
            self._frame()
        table = b"".join(struct.pack("<II", len(f), n) for f, n in zip(self.frames, self.sizes, strict=True))
        table += struct.pack("<IBI", len(self.frames), 0, _FOOTER)
        return b"".join(self.frames) + struct.pack("<II", _SKIPPABLE, len(table)) + table


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of every frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != _FOOTER:
        raise ValueError("no seek table")
    step = 12 if flags & 0x80 else 8
    at, out = len(bundle) - 9 - n * step, []
    start = 0
    for k in range(n):
        size, full = struct.unpack_from("<II", bundle, at + k * step)
        out.append((start, size, full))
        start += size
    return out


def read_record(bundle: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record by its place; only its frame is decompressed."""
    start, size, full = seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[start:start + size], max_output_size=full)[offset:offset + length]


def _decided(pages: DataFrame, scratch: Scratch, min_bytes: int) -> DataFrame:
    """Page rows with payload, digest, n and (of repeated payloads) the response's page_id."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    p = p.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload").cast("long")})
    groups = (p.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("c"))
              .where("c > 1").drop("c"))
    return p.join(scratch.save(groups, "groups"), "digest", "left")


def write_bundles(pages: DataFrame, scratch: Scratch, min_bytes: int = MIN_BYTES, frame_bytes: int = FRAME_BYTES,
                  bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """The stored bundles: (bundle, content, index) rows; ``index`` is an array of
    (page_id, frame, offset, length)."""
    from pyspark import TaskContext

    def out(b, part, k):
        return {"bundle": [f"part-{part:06d}-{k:05d}.warc.zst"], "content": [b.close()], "index": [b.index]}

    def run_all(batches):
        b, k, part = Bundle(frame_bytes), 0, TaskContext.get().partitionId()
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(6)), strict=True):
                page_id, url, payload, digest, n, first = (x.as_py() for x in row)
                again = first is not None and page_id != first
                b.add(record(page_id, url, payload, n, digest, first, again), page_id)
                if b.taken >= bundle_bytes:
                    yield out(b, part, k)
                    b, k = Bundle(frame_bytes), k + 1
        if b.taken:
            yield out(b, part, k)

    def batches(it):
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        for cols in run_all(it):
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in arrow], schema=arrow)
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("bundle string, content binary, "
                                "index array<struct<page_id:long,frame:int,offset:long,length:long>>")
    small_batches(pages.sparkSession)
    rows = _decided(pages, scratch, min_bytes).select("page_id", "url", "payload", "digest", "n", "first")
    return scratch.save(rows.mapInArrow(batches, schema), "bundles")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of every record."""
    names = ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")

    def run(batch):
        unzip = zstandard.ZstdDecompressor()
        for content, index in zip(batch.column(0), batch.column(1), strict=True):
            content = content.as_py()
            table, last, frame = seek_table(content), -1, b""
            rows = {c: [] for c in names}
            held = 0
            for x in index.as_py():
                if x["frame"] != last:
                    start, size, full = table[x["frame"]]
                    last, frame = x["frame"], unzip.decompress(content[start:start + size], max_output_size=full)
                head, body = parse(frame[x["offset"]:x["offset"] + x["length"]])
                digest = base64.b32decode(head["WARC-Payload-Digest"][5:]).hex()
                kind = head["WARC-Type"]
                if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                    raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
                refers = head.get("WARC-Refers-To")
                got = (x["page_id"], head.get("WARC-Target-URI"), body if kind == "response" else None,
                       int(head["X-Payload-Length"]), digest, kind, int(refers[10:-1]) if refers else None)
                for c, v in zip(names, got, strict=True):
                    rows[c].append(v)
                held += len(body)
                if held > 4 << 20:
                    yield rows
                    rows, held = {c: [] for c in names}, 0
            yield rows
    return map_arrow(bundles.select("content", "index"), run, "page_id long, url string, payload binary, payload_bytes long, "
                     "payload_digest string, record_type string, refers_to long")


def archive_report(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back: the digest columns per page."""
    read = read_bundles(write_bundles(pages, Scratch(pages.sparkSession, "warc")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def export(row, path: str) -> None:
    """Write one bundle row as a .warc.zst file, where the caller has a file system."""
    with open(path, "wb") as f:
        f.write(row["content"])


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS first FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN g.first IS NULL OR g.first = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.first <> d.page_id THEN g.first END AS refers_to
FROM d LEFT JOIN g ON g.payload_digest = d.payload_digest AND d.payload_bytes >= 1000
"""
