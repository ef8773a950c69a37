"""WARC archives: written from pages, read back sequentially.

An archive is a sequence of records, each in a gzip member of its own. The
reader inflates block by block, cuts records by their content length and checks
their digests, so that it holds one record and one block beyond the archive.

Archives are rows (``archive``, ``content``) of bounded size rather than files
of the executors: Spark's committers then see to retries and lost executors,
and any store that Spark reaches can hold them. ``read_archives`` takes such
rows as well as ``spark.read.format("binaryFile")``. A null payload is an empty
one; ids are numbers or any texts; an empty table makes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import column, id_type, written

BLOCK = 1 << 16
CRLF = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A record that is cut short or that its digest does not fit."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def http(self) -> tuple[dict[str, str], bytes]:
        """HTTP header fields and body of the block."""
        head, _, body = self.block.partition(CRLF * 2)
        return fields(head.split(CRLF)[1:]), body


def fields(lines: list[bytes]) -> dict[str, str]:
    found = {}
    for line in lines:
        name, sep, value = line.decode("utf-8").partition(":")
        if sep:
            found[name.strip().lower()] = value.strip()
    return found


def member(record_type: str, page: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One record as one gzip member. A revisit keeps the HTTP header, not the payload."""
    http = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        + f"Content-Length: {len(payload)}".encode()
        + CRLF * 2
    )
    block = http + (payload if record_type == "response" else b"")
    named = {
        "WARC-Type": record_type,
        "WARC-Record-ID": urn(page),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        named |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": urn(refers_to)}
    head = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in named.items()) + CRLF
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head + block + CRLF * 2) + pack.flush()


def inflated(content: bytes) -> Iterator[bytes]:
    """Each gzip member of an archive, inflated block by block."""
    view, at = memoryview(content), 0
    while at < len(view):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= len(view):
                raise WarcError("archive ends within a gzip member")
            block = view[at : at + BLOCK]
            try:
                parts.append(unpack.decompress(block))
            except zlib.error as error:
                raise WarcError(str(error)) from error
            at += len(block) - len(unpack.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> Record:
    head, sep, rest = data.partition(CRLF * 2)
    lines = head.split(CRLF)
    if not sep or not lines[0].startswith(b"WARC/"):
        raise WarcError("no WARC header")
    headers = fields(lines[1:])
    length = headers.get("content-length", "")
    if not length.isdigit() or rest[int(length) :] != CRLF * 2:
        raise WarcError("content length does not frame the record")
    record = Record(headers, rest[: int(length)])
    if headers.get("warc-block-digest", "") != f"sha1:{digest(record.block)}":
        raise WarcError("block digest does not fit")
    if headers["warc-type"] == "response":
        if headers.get("warc-payload-digest", "") != f"sha1:{digest(record.http[1])}":
            raise WarcError("payload digest does not fit")
    return record


def read_records(content: bytes) -> Iterator[Record]:
    for data in inflated(content):
        yield parse(data)


def urn(page: str | None) -> str:
    """The record's name: any text as an id, percent-encoded; no id has no last part."""
    return "<urn:page>" if page is None else f"<urn:page:{quote(page, safe='')}>"


def _named(value: str | None) -> str | None:
    """The id in such a name; names that others gave are returned as they are."""
    if value is None or value == "<urn:page>":
        return None
    plain = value.removeprefix("<").removesuffix(">")
    return unquote(plain.removeprefix("urn:page:")) if plain.startswith("urn:page:") else plain


def classify(
    pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int = 0
) -> DataFrame:
    """Page, url, payload and its part among equal payloads.

    Of records with equal payloads of at least ``min_bytes``, the one with the
    largest id is the response that the others refer to. Rows that repeat that
    id are responses too, and so is a page without an id. The digests are
    aggregated before the pages meet them, and the join's hot keys can be split.
    """
    page = pages.select(
        column(id_col).alias("page_id"),
        column(url_col).cast("string").alias("url"),
        F.coalesce(column(html_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("key", F.unhex(F.sha1("payload")))
    last = (
        page.filter(F.length("payload") >= min_bytes)
        .groupBy("key")
        .agg(F.max("page_id").alias("last_id"))
    )
    revisits = (F.length("payload") >= min_bytes) & (F.col("page_id") < F.col("last_id"))
    return page.join(last, "key", "left").select(
        "page_id",
        "url",
        "payload",
        F.when(revisits, F.col("last_id")).alias("refers_to"),
    )


def write_archives(records: DataFrame, archive_bytes: int = 4 << 20) -> DataFrame:
    """Archives of ``classify``'s rows, each closed once it holds ``archive_bytes``."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size, n = [], 0, 0
        for batch in batches:
            for page, url, payload, refers in zip(
                batch["page"], batch["url"], batch["payload"], batch["refers"]
            ):
                kind = "response" if refers is None else "revisit"
                parts.append(member(kind, page, url, bytes(payload), refers))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield pd.DataFrame({"n": [n], "content": [b"".join(parts)]})
                    parts, size, n = [], 0, n + 1
        if parts:
            yield pd.DataFrame({"n": [n], "content": [b"".join(parts)]})

    plain = records.select(
        F.col("page_id").cast("string").alias("page"),
        "url",
        "payload",
        F.col("refers_to").cast("string").alias("refers"),
    )
    packed = plain.mapInPandas(rows, "n long, content binary")
    name = F.format_string("part-%05d-%05d.warc.gz", F.spark_partition_id(), F.col("n"))
    return written(packed.select(name.alias("archive"), "content"), "warc")


def read_archives(
    archives: DataFrame, page_type: str = "string", content_col: str = "content"
) -> DataFrame:
    """One row per record: page, url, type, payload (null for revisits), its
    full size and digest, and the page a revisit refers to. A record that is
    cut short or altered fails the read."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch[content_col]:
                out = []
                for record in read_records(bytes(content)):
                    head, (http, body) = record.headers, record.http
                    kind = head["warc-type"]
                    out.append(
                        (
                            _named(head["warc-record-id"]),
                            head["warc-target-uri"],
                            kind,
                            body if kind == "response" else None,
                            int(http["content-length"]),
                            head["warc-payload-digest"].removeprefix("sha1:"),
                            _named(head.get("warc-refers-to")),
                        )
                    )
                    if len(out) >= 256:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=names)

    names = ["page", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers"]
    found = archives.select(column(content_col).alias(content_col)).mapInPandas(
        rows,
        "page string, url string, record_type string, payload binary, payload_bytes long, "
        "payload_digest string, refers string",
    )
    return found.select(
        F.col("page").cast(page_type).alias("page_id"),
        "url",
        "record_type",
        "payload",
        "payload_bytes",
        "payload_digest",
        F.col("refers").cast(page_type).alias("refers_to"),
    )


def archive_round_trip(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
) -> DataFrame:
    """Writes a record per row of ``pages`` and reads the archives back."""
    archives = write_archives(classify(pages, id_col, url_col, html_col, min_bytes))
    return read_archives(archives, id_type(pages, id_col))
