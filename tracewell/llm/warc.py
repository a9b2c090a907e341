"""WARC derivatives: metadata and plain-text conversion records of responses.

``derive`` turns every response record into two linked records. Both refer to the response
(WARC-Refers-To), keep its target and date, and carry digests of their own blocks. The
metadata block is JSON with the response's WARC headers, status line, HTTP headers, payload
digest, title and links; the conversion block is the page's text. Everything is a column
expression on the row of the response, so there is no exchange.

``read`` parses WARC files (plain, or gzip with a member per record) into records;
``responses`` makes response records from a table of pages; ``serialised`` gives the bytes
of derived records, which written one after the other are a WARC file.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Elements whose content isn't text, and elements that break a line.
SILENT = ("script", "style", "noscript", "template")
BREAKING = "p|div|h[1-6]|li|ul|ol|dl|dt|dd|tr|table|br|hr|article|section|nav|header|footer|title|head|body|html|main|aside|blockquote|pre|form"
# Named entities and their characters; the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&"))
DATE = "1970-01-01T00:00:00Z"
RESPONSE = "record_id string, target_uri string, warc_date string, block string"
CRLF = "\r\n"


def record_id(*parts: Column) -> Column:
    """A record id that depends on ``parts`` alone."""
    h = F.md5(F.concat_ws("|", *parts))
    cuts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses(pages: DataFrame) -> DataFrame:
    """Response records of pages (page_id, url, html), with page_id. Null html is an empty page."""
    html = F.coalesce(F.col("html"), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html), F.lit(CRLF * 2))
    ids = record_id(F.lit("response"), F.coalesce(F.col("url"), F.lit("")), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    return pages.select("page_id", ids.alias("record_id"), F.col("url").alias("target_uri"), F.lit(DATE).alias("warc_date"), F.concat(head, html).alias("block"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _numbers(text: Column, pattern: str, prefix: str, base: int) -> Column:
    """``text`` with its numeric entities of one base as characters."""

    def put(held: Column, number: Column) -> Column:
        code = F.conv(number, base, 10).cast("long")
        legal = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.when(legal, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
        held = F.replace(held, F.concat(F.lit(prefix), number, F.lit(";")), char)
        return F.replace(held, F.concat(F.lit(prefix.upper()), number, F.lit(";")), char) if base == 16 else held

    def replaced(text: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
        return F.aggregate(found, text, put)

    return _bound(text, lambda t: F.when(F.instr(t, prefix[:2]) > 0, replaced(t)).otherwise(t))


def _decoded(text: Column) -> Column:
    """Entities as characters: the table's, then numbers, the ampersand last."""

    def replaced(text: Column) -> Column:
        for name, char in ENTITIES[:-1]:
            text = F.replace(text, F.lit(name), F.lit(char))
        text = _numbers(text, "&#([0-9]{1,7});", "&#", 10)
        text = _numbers(text, "&#[xX]([0-9a-fA-F]{1,6});", "&#x", 16)
        return F.replace(text, F.lit("&amp;"), F.lit("&"))

    return _bound(text, lambda t: F.when(F.instr(t, "&") > 0, replaced(t)).otherwise(t))


def visible(html: Column) -> Column:
    """Markup without comments and without elements that hold no text."""
    html = F.regexp_replace(html, "(?s)<!--.*?-->", " ")
    return F.regexp_replace(html, rf"(?is)<({'|'.join(SILENT)})\b[^>]*>.*?</\1\s*>", " ")


def text_of(seen: Column) -> Column:
    """Lines of text of visible markup: block elements break lines, other tags vanish, white
    space is collapsed."""
    text = F.translate(seen, "\t\r\n\f", "    ")
    text = F.regexp_replace(text, rf"</?(?:(?i){BREAKING})\b[^>]*>", "\n")
    text = _decoded(F.regexp_replace(text, "<[/!?a-zA-Z][^>]*>", ""))
    text = F.regexp_replace(F.regexp_replace(text, "  +", " "), r" ?\n[ \n]*", "\n")
    return F.btrim(text, F.lit(" \n"))


def derive(records: DataFrame) -> DataFrame:
    """Two rows per response (record_id, target_uri, warc_date, block): its metadata and conversion.

    Returns the other columns of ``records``, then warc_type, record_id, refers_to,
    target_uri, warc_date, content_type, content_length, block_digest and block. A null
    block is an empty one; a block without an HTTP header has no headers and is all payload;
    repeated responses give repeated records; an empty table gives none.
    """
    own = [c for c in records.columns if c not in ("record_id", "target_uri", "warc_date", "block")]
    block = F.coalesce(F.col("block"), F.lit(""))
    at = F.when(F.startswith(block, F.lit("HTTP/")), F.instr(block, CRLF * 2)).otherwise(0)
    split = records.withColumn("__head", F.when(at > 0, F.substr(block, F.lit(1), at - 1)).otherwise("")).withColumn("__payload", F.when(at > 0, F.substr(block, at + 4)).otherwise(block))
    lines = F.split("__head", CRLF)
    title = lambda v: _decoded(F.trim(F.regexp_extract(v, r"(?is)<title\b[^>]*>(.*?)</title", 1)))
    links = lambda v: F.transform(F.regexp_extract_all(v, F.lit(r"<[aA]\s[^>]*?(?i:href)\s*=\s*[\"']([^\"'>]*)"), F.lit(1)), _decoded)
    seen = _bound(visible(F.col("__payload")), lambda v: F.struct(text_of(v).alias("text"), title(v).alias("title"), links(v).alias("links")))
    split = split.withColumn("__seen", seen)
    envelope = F.to_json(
        F.struct(
            F.struct(F.lit("response").alias("WARC-Type"), F.col("record_id").alias("WARC-Record-ID"), F.col("target_uri").alias("WARC-Target-URI"), F.col("warc_date").alias("WARC-Date"), digest(block).alias("WARC-Block-Digest"), digest(F.col("__payload")).alias("WARC-Payload-Digest")).alias("warc"),
            F.element_at(lines, 1).alias("status"),
            F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))).alias("headers"),
            F.col("__seen.title").alias("title"),
            F.col("__seen.links").alias("links"),
        )
    )
    made = [("metadata", "application/json", envelope), ("conversion", "text/plain", F.col("__seen.text"))]
    rows = split.select(
        *own,
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "warc_date",
        F.explode(F.array(*[F.struct(F.lit(kind).alias("warc_type"), F.lit(content).alias("content_type"), body.alias("block")) for kind, content, body in made])).alias("__r"),
    ).select(*own, "refers_to", "target_uri", "warc_date", "__r.*")
    return rows.select(
        *own,
        "warc_type",
        record_id(F.col("warc_type"), F.col("refers_to")).alias("record_id"),
        "refers_to",
        "target_uri",
        "warc_date",
        "content_type",
        F.octet_length("block").cast("long").alias("content_length"),
        digest(F.col("block")).alias("block_digest"),
        "block",
    )


def serialised(derived: DataFrame) -> DataFrame:
    """(record_id, data): each derived record as the bytes of a WARC/1.1 record."""
    head = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    lines = [F.concat(F.lit(f"{name}: "), F.col(column).cast("string"), F.lit(CRLF)) for name, column in head]
    whole = F.concat(F.lit(f"WARC/1.1{CRLF}"), *[F.coalesce(line, F.lit("")) for line in lines], F.lit(CRLF), F.col("block"), F.lit(CRLF * 2))
    return derived.select("record_id", whole.cast("binary").alias("data"))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC file; gzip members are unpacked one by one."""
    if data[:2] == b"\x1f\x8b":
        plain, rest = io.BytesIO(), data
        while rest[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            plain.write(member.decompress(rest))
            rest = member.unused_data
        data = plain.getvalue()
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", start)
        if end < 0:
            return
        lines = data[start:end].decode("utf-8", "replace").split(CRLF)[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(headers.get("content-length", 0))
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def read(spark: SparkSession, path: str, kind: str | None = "response") -> DataFrame:
    """Records of the WARC files at ``path`` (of one type, or all): warc_type, record_id,
    target_uri, warc_date, refers_to, block (bytes that aren't UTF-8 are replaced). A file is
    one task's work, as is usual for files of about a gigabyte."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = [(h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-refers-to"), b.decode("utf-8", "replace")) for h, b in parse(data.as_py()) if kind in (None, h.get("warc-type"))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [[]] * 6)], ["warc_type", "record_id", "target_uri", "warc_date", "refers_to", "block"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(work, "warc_type string, record_id string, target_uri string, warc_date string, refers_to string, block string")
