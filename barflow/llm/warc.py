"""
WARC archives, written and read by Spark.

An archive is a row of gzip members, one for each record. Spark's text writer writes them: a member's last byte is the high byte of its
length, which is zero (records of 16 MB or more get an empty member after them, which readers pass over), and zero is also the
writer's line separator. So archives go through Spark's committed output to whatever store the path names, and a lost executor leaves
no half-written file. The reader goes through an archive from front to back: it inflates a member piece by piece, reads the header,
takes as many bytes as Content-Length says, and compares the digests of block and payload.

Equal payloads are stored once: the page with the largest id keeps them, the others are revisit records, which hold the HTTP header
alone and name the record to look at. Nulls: a null html is an empty payload; a null url gives no target URI; a null page_id is
written as such and never chosen to keep a payload that has an owner. Rows that repeat page_id and html are written each. An empty
table gives an empty archive folder. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, skew_join

PAGE = "urn:page:"
PIECE = 1 << 16
EMPTY = zlib.compress(b"", 9, 31)
BATCH = 512
RECORD = "record_id string, type string, target_uri string, payload_digest string, refers_to string, payload_bytes long, payload binary, error string"


class WarcError(ValueError):
    pass


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _fields(lines: list[tuple[str, str | None]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None).encode() + b"\r\n"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, payload_digest: str, size: int, date: str, level: int) -> bytes:
    """One gzip member, or two, that ends with a zero byte. A revisit (refers_to) doesn't hold the payload."""
    http = b"HTTP/1.1 200 OK\r\n" + _fields([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(size))])
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{PAGE}{'none' if page is None else page}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else quote(url, safe="%:/?#[]@!$&'()*+,;=~")),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("WARC-Profile", None if refers_to is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", None if refers_to is None else f"<{PAGE}{refers_to}>"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    packed = zlib.compress(b"WARC/1.1\r\n" + _fields(head) + block + b"\r\n\r\n", level, 31)
    return packed if packed[-1] == 0 else packed + EMPTY


def roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, sha (hex), size, refers_to: the page whose record holds an equal payload of `min_bytes` or more, or null; distinct."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = durable(pages.select(F.col("page_id").cast("long"), F.sha1(payload).alias("sha"), F.octet_length(payload).cast("long").alias("size")))
    shared = own.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1")
    found = skew_join(own, durable(shared), ["sha", "size"], "n", total=own.count())
    return found.select("page_id", "sha", "size", F.when(~F.col("page_id").eqNullSafe(F.col("target")), F.col("target")).alias("refers_to")).distinct()


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 6, file_bytes: int = 128 << 20) -> None:
    """
    Writes `pages` (page_id, url, html) as archives into the folder `path`, which mustn't exist yet. A task begins a new archive, in a
    subfolder of its own, when the one before has `file_bytes`.
    """
    html = F.coalesce(F.col("p.html"), F.lit("")).cast("binary")
    same = F.col("p.page_id").cast("long").eqNullSafe(F.col("r.page_id")) & (F.sha1(html) == F.col("r.sha"))
    rows = pages.alias("p").join(roles(pages, min_bytes).alias("r"), same).select("r.page_id", "p.url", F.when(F.col("r.refers_to").isNull(), html).otherwise(F.lit(b"")).alias("payload"), "r.refers_to", "r.sha", "r.size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                out, roll = [], []
                for page, url, payload, refers_to, sha, size in zip(*(c.to_pylist() for c in batch.slice(at, BATCH).columns), strict=True):
                    out.append(record(page, url, payload, refers_to, base64.b32encode(bytes.fromhex(sha)).decode(), size, date, level)[:-1])
                    roll.append(written // file_bytes)
                    written += len(out[-1]) + 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(roll, pa.int32())], ["member", "roll"])

    members = rows.mapInArrow(run, "member binary, roll int").select(F.col("member").cast("string").alias("value"), "roll")
    members.write.partitionBy("roll").option("lineSep", "\x00").text(path)


def members(archive: bytes) -> Iterator[bytes]:
    """What each gzip member of an archive holds, in order; empty members are passed over."""
    view, at = memoryview(archive), 0
    while at < len(view):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(view):
                raise WarcError("the archive ends inside a member")
            piece = view[at : at + PIECE]
            parts.append(inflate.decompress(piece))
            at += len(piece) - len(inflate.unused_data)
        if whole := b"".join(parts):
            yield whole


def parse(raw: bytes) -> tuple:
    """The fields of RECORD from one member."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not first.startswith("WARC/"):
        raise WarcError("no WARC header")
    field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(field["content-length"])
    block, tail = rest[:n], rest[n:]
    if len(block) < n or tail != b"\r\n\r\n":
        raise WarcError(f"Content-Length {n} doesn't frame the block")
    bare = lambda name: field.get(name, "").removeprefix("sha1:") or None
    payload, size = block, n
    if field.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        length = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size = int(length[0]) if length else len(payload)
    kind, error = field.get("warc-type"), None
    if (want := bare("warc-block-digest")) and want != digest(block):
        error = "block digest differs"
    elif kind == "response" and len(payload) != size:
        error = "payload length differs"
    elif kind == "response" and (want := bare("warc-payload-digest")) and want != digest(payload):
        error = "payload digest differs"
    name = lambda k: field[k].strip("<>") if k in field else None
    return name("warc-record-id"), kind, field.get("warc-target-uri"), bare("warc-payload-digest"), name("warc-refers-to"), size, None if kind == "revisit" else payload, error


def read_warc(spark: SparkSession, path: str, payloads: bool = True, strict: bool = True) -> DataFrame:
    """
    The records of all archives below `path`, as RECORD says. payload_bytes is that of the original also for revisits, whose payload
    is null. strict: a damaged record fails the job; else its row has the reason in error.
    """
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for content in batch.column(0):
                    try:
                        for raw in members(memoryview(content.as_buffer())):
                            try:
                                yield parse(raw)
                            except (WarcError, KeyError, ValueError) as e:
                                yield (*[None] * 7, str(e))
                    except (WarcError, zlib.error) as e:
                        yield (*[None] * 7, str(e))

        held: list[tuple] = []
        size = 0
        for row in rows():
            if strict and row[-1]:
                raise WarcError(f"{row[0]}: {row[-1]}")
            held.append(row if payloads else (*row[:6], None, row[7]))
            size += len(held[-1][6] or b"")
            if len(held) >= BATCH or size > 8 << 20:
                yield _batch(held, names)
                held, size = [], 0
        if held:
            yield _batch(held, names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records that write_warc wrote."""
    number = lambda c: F.expr(f"try_cast(substr({c}, {len(PAGE) + 1}) AS bigint)")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))
