"""Web archives: writing them with an index, and reading chosen records back by byte ranges.

Records are gzip members of ``.warc.gz`` files. Every writer emits the index as it goes: file, offset, length, URL and
digest per record. Readers take rows of an index, sort them by file and offset, join neighbouring ranges into one read and
cut the records out of it. Files are reached through Arrow's file systems by URI, so archives may lie in any store Arrow
knows. A writing task names its files anew at each attempt and the index only holds what finished attempts wrote; a lost
executor leaves files that nothing refers to.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.store import table, written
from assay.session import scratch_path

INDEX = (
    "path string, offset long, length long, url string, payload_digest string, record_type string, page_id long,"
    " refers_to long"
)
PAYLOADS = (
    "page_id long, record_type string, refers_to long, url string, payload_digest string, payload_bytes long,"
    " payload binary"
)
PAGE = "urn:assay:page:"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK = 1 << 20


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    for spark_name, arrow_name in (("s3a://", "s3://"), ("s3n://", "s3://")):
        if uri.startswith(spark_name):
            uri = arrow_name + uri[len(spark_name) :]
    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_url(url: str) -> str:
    """``url`` with blanks and controls escaped, which would end a header; other letters are UTF-8 there."""
    return "".join(quote(c) if c <= " " or c == "\x7f" else c for c in url)


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record. A revisit repeats the HTTP head and leaves the payload to the record it refers to."""
    block = HTTP_HEAD + f"Content-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{PAGE}{'null' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {url}")
    if revisit:
        head += [f"WARC-Refers-To: <{PAGE}{refers_to}>", f"WARC-Profile: {IDENTICAL}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """The fields of a record: ``payload`` is what follows the HTTP head of the block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    named = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(named["content-length"])]
    if named.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    page = lambda key: (
        int(x) if (x := named.get(key, "").strip("<>").removeprefix(PAGE)).lstrip("-").isdigit() else None
    )
    return {
        "record_type": named.get("warc-type"),
        "page_id": page("warc-record-id"),
        "refers_to": page("warc-refers-to"),
        "url": named.get("warc-target-uri"),
        "payload_digest": named.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "payload": block,
    }


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with ``digest`` (SHA-1 in hex) and, for revisits, ``refers_to``.

    Of pages with equal payloads of at least ``min_bytes``, that with the smallest page_id is the response. A null html is
    the empty payload. Rows that repeat the response's own page_id are responses too; a null page_id revisits if any page
    with an id has the payload. Only ids and digests are grouped; a payload many pages share is counted per task first, and
    the pages themselves are shuffled by page_id, and only if anything is repeated.
    """
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    ids = pages.filter(F.octet_length("html") >= min_bytes).select("page_id", "digest")
    firsts = (
        ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
        .filter("n > 1").select("digest", "refers_to")
    )
    revisits = ids.join(firsts, "digest").filter("page_id IS NULL OR page_id <> refers_to").distinct()
    same = pages.page_id.eqNullSafe(revisits.page_id) & (pages.digest == revisits.digest)
    return pages.join(revisits, same, "left").select(pages["*"], "refers_to")


def write_archives(
    marked: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 256 << 20, level: int = 6
) -> DataFrame:
    """Write the rows of ``mark_revisits`` as archives below ``path``; returns the stored index."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, folder = file_system(path)
        files.create_dir(folder, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for p in batch.itertuples(index=False):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{folder}/{name}", compression=None)
                page = None if pd.isna(p.page_id) else int(p.page_id)
                refers = None if pd.isna(p.refers_to) else int(p.refers_to)
                digest = base64.b32encode(bytes.fromhex(p.digest)).decode()
                url = header_url(p.url) if isinstance(p.url, str) else None
                record = record_bytes(page, url, p.html.encode(), digest, refers, refers is not None, date)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record) + packer.flush()
                out.write(member)
                kind = "response" if refers is None else "revisit"
                rows.append((f"{path}/{name}", at, len(member), url, digest, kind, page, refers))
                at += len(member)
            yield index_frame(rows)
        if out is not None:
            out.close()

    # ids stay text in pandas, where a column of whole numbers with gaps would turn to floats
    source = marked.select(F.col("page_id").cast("string"), "url", "html", "digest", F.col("refers_to").cast("string"))
    return written(source.mapInPandas(write, INDEX), "warc-index")


def index_frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(",")])
    return frame.astype({"offset": "int64", "length": "int64", "page_id": "Int64", "refers_to": "Int64"})


def index_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The index of given ``.warc.gz`` files, each streamed through once, one task a file."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                files, inner = file_system(path)
                with files.open_input_stream(inner, compression=None) as stream:
                    yield index_frame(list(scan_members(path, stream)))

    if not paths:
        return spark.createDataFrame([], INDEX)
    names = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
    return names.mapInPandas(scan, INDEX)


def scan_members(path: str, stream) -> Iterator[tuple]:
    """Index rows of a stream of gzip members, holding one record at a time."""
    start, data = 0, stream.read(BLOCK)
    while data:
        unpacker, parts, length = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            if not data and not (data := stream.read(BLOCK)):
                raise ValueError(f"{path}: the member at {start} is cut off")
            parts.append(unpacker.decompress(data))
            length += len(data) - len(unpacker.unused_data)
            data = unpacker.unused_data
        r = parse_record(b"".join(parts))
        yield path, start, length, r["url"], r["payload_digest"], r["record_type"], r["page_id"], r["refers_to"]
        start += length
        data = data or stream.read(BLOCK)


def read_records(
    index: DataFrame, payloads: bool = True, span: int = 16 << 20, gap: int = 64 << 10, most: int = 8 << 20
) -> DataFrame:
    """The records that ``index`` names, read in ranges.

    Rows are dealt by file and ``span`` of it, sorted by offset, and ranges that lie within ``gap`` bytes of each other
    become one read of up to ``most`` bytes. Each digest is compared with the payload's; a difference raises. With
    ``payloads=False`` the result says null there, for those who need counts and digests only.
    """

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened, source = None, None
        for batch in batches:
            rows, held = [], 0
            ranges = list(zip(batch["path"], batch["offset"], batch["length"], strict=True))
            at = 0
            while at < len(ranges):
                path, start, length = ranges[at]
                end, last = start + length, at + 1
                while last < len(ranges):
                    p, o, n = ranges[last]
                    if p != path or o - end > gap or max(end, o + n) - start > most:
                        break
                    end, last = max(end, o + n), last + 1
                if opened != path:
                    files, inner = file_system(path)
                    opened, source = path, files.open_input_file(inner)
                data = source.read_at(end - start, start)
                for _, o, n in ranges[at:last]:
                    r = parse_record(zlib.decompress(data[o - start : o - start + n], 31))
                    payload, revisit = r["payload"], r["record_type"] == "revisit"
                    if not revisit and r["payload_digest"] not in (None, base32_sha1(payload)):
                        raise ValueError(f"{path}, offset {o}: the payload differs from its digest")
                    rows.append((
                        r["page_id"], r["record_type"], r["refers_to"], r["url"], r["payload_digest"],
                        None if revisit else len(payload), payload if payloads and not revisit else None,
                    ))
                    held += len(payload) if payloads else 0
                    if held > most:
                        yield payload_frame(rows)
                        rows, held = [], 0
                at = last
            yield payload_frame(rows)

    # a task for each span: left alone, Spark would deal by the bytes of the index, not of the archives
    tasks = 1 + (index.agg(F.sum("length")).first()[0] or 0) // span
    deal = [F.col("path"), F.floor(F.col("offset") / span)]
    return (
        index.select("path", "offset", "length").repartition(tasks, *deal)
        .sortWithinPartitions("path", "offset").mapInPandas(fetch, PAYLOADS)
    )


def payload_frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in PAYLOADS.split(",")])
    return frame.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})


def op1_warc(spark, folder):
    """Every page through an archive and back."""
    index = write_archives(mark_revisits(table(spark, folder, "pages")), scratch_path(spark, "warc"))
    read = written(read_records(index, payloads=False).drop("payload"), "warc-read")
    sizes = read.filter("record_type = 'response' AND page_id IS NOT NULL").groupBy("page_id", "payload_digest").agg(
        F.first("payload_bytes").alias("full_bytes")
    )
    origin = sizes.select(F.col("page_id").alias("refers_to"), "payload_digest", "full_bytes")
    return read.join(origin, ["refers_to", "payload_digest"], "left").select(
        "page_id",
        F.coalesce("payload_bytes", "full_bytes").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )


OP1_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (
    SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM p
)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
        (('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INTEGER), 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31
    )::INTEGER, 1)), '') AS payload_digest,
    CASE WHEN page_id <> first_id OR page_id IS NULL AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END
        AS record_type,
    CASE WHEN page_id <> first_id OR page_id IS NULL THEN first_id END AS refers_to
FROM f
"""
