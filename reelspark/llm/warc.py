"""WARC archives: writing them, making monolithic gzip files seekable, and reading records by offset.

An archive is a row ``(archive, content)``; ``binaryFile`` gives rows of that shape
for files elsewhere. The normaliser inflates a whole-file gzip stream once, with a
bounded buffer, rewrites each record as a gzip member of its own and writes the
sidecar index ``(record_id, offset, length)``.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm._scratch import Scratch

# Fixed values of the format.
VERSION = b"WARC/1.1"
END = b"\r\n"
HEADERS_END = b"\r\n\r\n"
#: Uncompressed bytes after which a writer begins the next archive.
ARCHIVE_BYTES = 32 << 20
_LEVEL = 3
_ARCHIVE = "archive string, content binary"
_NORMAL = "archive string, content binary, index array<struct<record_id:string,offset:long,length:long>>"


def _record(fields: list[tuple[str, str]], body: bytes) -> bytes:
    head = [VERSION] + [f"{k}: {v}".encode() for k, v in fields] + [f"Content-Length: {len(body)}".encode()]
    return END.join(head) + HEADERS_END + body + HEADERS_END


def _one_line(url: str | None, key: int) -> str:
    return "".join(c if c > " " and c != "\x7f" else "%{:02X}".format(ord(c)) for c in url) if url else f"urn:page:{key}"


def _writer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Monolithic archives: one gzip stream for all records of a file, named by its first record."""
    stream, parts, size, name = None, [], 0, ""

    def close():
        parts.append(stream.flush())
        return pa.RecordBatch.from_pydict({"archive": [name], "content": [b"".join(parts)]}, schema=pa.schema([("archive", pa.string()), ("content", pa.binary())]))

    for batch in batches:
        for row in batch.to_pylist():
            body = row["payload"] or b""
            kind = "response" if row["refers_to"] is None else "revisit"
            fields = [
                ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{row['id']}>"), ("WARC-Target-URI", _one_line(row["url"], row["id"])),
                ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode()), ("Content-Type", "text/html; charset=utf-8"),
            ]
            if kind == "revisit":
                fields += [("WARC-Refers-To", f"<urn:page:{row['refers_to']}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                body = b""
            if stream is None:
                stream, parts, size, name = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31), [], 0, f"pages-{row['id']}.warc.gz"
            raw = _record(fields, body)
            parts.append(stream.compress(raw))
            size += len(raw)
            if size >= ARCHIVE_BYTES:
                yield close()
                stream = None
    if stream is not None:
        yield close()


def _inflated(content: bytes) -> Iterator[bytes]:
    """Pieces of the uncompressed stream, through one gzip member after another."""
    view, at = memoryview(content), 0
    while at < len(view):
        stream = zlib.decompressobj(31)
        while not stream.eof:
            feed = stream.unconsumed_tail
            if not feed:
                feed = view[at : at + (1 << 16)]
                at += len(feed)
            piece = stream.decompress(feed, 1 << 20)
            if piece:
                yield piece
            elif not feed and not stream.eof:
                raise ValueError("the gzip stream ends early")
        at -= len(stream.unused_data)


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.split(END)
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.decode("utf-8", "replace").partition(":") for line in lines[1:] if line)}


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and raw bytes of every record; holds one record at a time."""
    held = bytearray()
    more = iter(pieces)
    need: int | None = None
    fields: dict[str, str] = {}
    for piece in more:
        held += piece
        while True:
            if need is None:
                cut = held.find(HEADERS_END)
                if cut < 0:
                    break
                fields = parse_head(bytes(held[:cut]))
                need = cut + 4 + int(fields["content-length"]) + 4
            if len(held) < need:
                break
            yield fields, bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError("the last record is cut off")


def _normaliser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("archive", pa.string()), ("content", pa.binary()), ("index", pa.list_(pa.struct([("record_id", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])))])
    for batch in batches:
        for row in batch.to_pylist():
            out, index, at = [], [], 0
            for fields, raw in records(_inflated(row["content"] or b"")):
                press = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
                member = press.compress(raw) + press.flush()
                out.append(member)
                index.append({"record_id": fields.get("warc-record-id", ""), "offset": at, "length": len(member)})
                at += len(member)
            yield pa.RecordBatch.from_pylist([{"archive": row["archive"], "content": b"".join(out), "index": index}], schema=kind)


def _sha1_field(fields: dict[str, str]) -> str | None:
    """The payload digest of a revisit as hex; null where it is missing or no SHA-1 in base 32."""
    name, _, value = fields.get("warc-payload-digest", "").partition(":")
    try:
        return base64.b32decode(value).hex() if name.lower() == "sha1" and value else None
    except ValueError:
        return None


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record by its index entry alone."""
    kind = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("n", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])
    for batch in batches:
        for row in batch.to_pylist():
            out, size = [], 0
            for entry in row["index"]:
                raw = zlib.decompress(row["content"][entry["offset"] : entry["offset"] + entry["length"]], 31)
                head, _, rest = raw.partition(HEADERS_END)
                fields = parse_head(head)
                body = rest[: int(fields["content-length"])]
                revisit = fields.get("warc-type") == "revisit"
                digest = _sha1_field(fields) if revisit else hashlib.sha1(body).hexdigest()
                out.append({"record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "url": fields.get("warc-target-uri"), "digest": digest, "n": None if revisit else len(body), "refers_to": fields.get("warc-refers-to"), "payload": None if revisit else body})
                size += len(body)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema=kind)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kind)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 1000) -> DataFrame:
    """Monolithic archives ``archive, content`` with a record per row.

    Of rows with equal payloads of ``min_revisit_bytes`` or more, the one with the
    largest id is a response and the others are revisits of it. A null payload is
    empty and a null url becomes ``urn:page:<id>``.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload").cast("long")})
    chiefs = rows.where(F.col("n") >= min_revisit_bytes).groupBy("digest", "n").agg(F.max("id").alias("chief"), F.count("*").alias("k")).where("k > 1").drop("k")
    linked = rows.join(chiefs, ["digest", "n"], "left")
    linked = linked.select("id", "url", "payload", "digest", "n", F.when(F.col("chief") != F.col("id"), F.col("chief")).alias("refers_to"))
    return linked.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload"))).mapInArrow(_writer, _ARCHIVE)


def normalise(archives: DataFrame) -> DataFrame:
    """``archive, content, index`` with a gzip member per record, from archives compressed in any way."""
    return archives.select("archive", "content").mapInArrow(_normaliser, _NORMAL)


def read_records(normal: DataFrame) -> DataFrame:
    """One row per record of normalised archives, of any type; a field that a record lacks is null. A revisit has its response's digest, and neither length nor payload."""
    return normal.select("archive", "content", "index").mapInArrow(_reader, "record_id string, record_type string, url string, digest string, n long, refers_to string, payload binary")


def page_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes ``pages`` to archives, normalises them and reads all records back; a revisit's length is that of its response.

    Null payloads are empty and long ones whole. Every row has its record: rows that repeat
    the largest id of equal payloads are all responses, rows without an id come back
    without one. An empty table gives none; other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    whole = scratch.stage(write_archives(pages, **options), "monolithic")
    normal = scratch.stage(normalise(whole), "members")
    scratch.drop("monolithic")
    key = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    read = scratch.stage(read_records(normal), "records", compression="zstd")
    scratch.drop("members")
    scratch.release()
    lengths = read.where("record_type = 'response' AND record_id IS NOT NULL").groupBy(F.col("record_id").alias("refers_to")).agg(F.max("n").alias("n_response"))
    revisits = read.where("refers_to IS NOT NULL").join(lengths, "refers_to", "left").withColumn("n", F.col("n_response")).select(*read.columns)
    read = read.where("refers_to IS NULL").unionByName(revisits)
    return read.select(key("record_id").alias("page_id"), F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.when(F.col("refers_to").isNotNull(), key("refers_to")).alias("refers_to"), "url", "payload")
