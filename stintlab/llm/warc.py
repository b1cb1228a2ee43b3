"""WARC derivatives: a metadata and a plain-text conversion record for every HTTP response record.

Both refer to their response by ``WARC-Refers-To`` and carry its target URI and date. The metadata record's
``application/warc-fields`` block holds the source's HTTP headers, digests and length next to what was derived
(title, language, number of links); the conversion record's block is the page's visible text.

Everything but the character references is built-in column functions. All named and numeric references are resolved
as HTML has them, but that a no-break space becomes a space. A response's record id is made from a digest of its page id,
URI and payload, a derivative's from its source's id and its type, so a rerun gives the same ids and rows that differ have
different ones; repeated rows repeat their records. Null payloads count as empty, and a null URI is left out of the headers.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
HTTP_HEADERS = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

#: In this order. The patterns mean the same to Java's and RE2's engines.
TEXT_STEPS = (
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<script[^>]*>.*?</script\s*>", " "),
    (r"(?is)<style[^>]*>.*?</style\s*>", " "),
    (r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)(?:[ \t\r\n/][^>]*)?>", "\n"),
    (r"<[A-Za-z/!?][^>]*>", ""),
)
SPACE_STEPS = ((r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"))


_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")


def resolved(text: str | None) -> str | None:
    """The text with its character references resolved once."""
    if text is None or "&" not in text:
        return text
    return _REFERENCE.sub(lambda m: html.unescape(m[0]).replace("\xa0", " "), text)


def text_of(page: Column) -> Column:
    """Visible text: a line for each block, character references resolved, white space collapsed."""
    out = page
    for pattern, by in TEXT_STEPS:
        out = F.regexp_replace(out, pattern, by)
    out = F.udf(resolved, "string", useArrow=True)(out)
    for pattern, by in SPACE_STEPS:
        out = F.regexp_replace(out, pattern, by)
    return F.btrim(out, F.lit(" \n"))


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _digest(of: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(of.cast("binary"), 256))


def responses(pages: DataFrame, date: str = DATE, http_headers: str = HTTP_HEADERS) -> DataFrame:
    """Crawled pages (page_id, url, html) as response records."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        _urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce(F.col("url"), F.lit("")), F.sha2(payload.cast("binary"), 256)).alias("record_id"),
        F.col("url").cast("string").alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.lit(http_headers).alias("http_headers"),
        payload.alias("payload"),
    )


def _record(kind: str, content_type: str, block: Column) -> Column:
    derived = _urn(F.lit(kind), F.col("record_id"))
    headers = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), derived,
        F.lit("\r\nWARC-Date: "), F.col("warc_date"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.col("target_uri")), F.lit("")),
        F.lit("\r\nWARC-Refers-To: "), F.col("record_id"),
        F.lit("\r\nWARC-Block-Digest: "), _digest(block),
        F.lit(f"\r\nContent-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n"),
    )
    return F.struct(F.lit(kind).alias("warc_type"), derived.alias("record_id"), headers.alias("headers"), block.alias("block"))


def derivatives(source: DataFrame) -> DataFrame:
    """Two records a response: page_id, warc_type, record_id, refers_to, headers, block and the block's digest."""
    digests = source.withColumn("payload_digest", _digest(F.col("payload"))).withColumn("plain", text_of(F.col("payload")))
    title = F.trim(F.regexp_replace(F.regexp_extract("payload", r"(?is)<title[^>]*>([^<]*)", 1), r"[ \t\r\n\f]+", " "))
    language = F.regexp_extract("payload", r"(?i)<html[^>]* lang=\"([^\">]*)\"", 1)
    fields = F.concat(
        F.lit("title: "), title, F.lit("\r\nlanguage: "), language,
        F.lit("\r\nlinks: "), F.regexp_count("payload", F.lit(r"(?i)<a [^>]*href=")).cast("string"),
        F.lit("\r\ntext-length: "), F.octet_length("plain").cast("string"),
        F.lit("\r\nsource-payload-digest: "), F.col("payload_digest"),
        F.lit("\r\nsource-block-digest: "), _digest(F.concat("http_headers", F.lit("\r\n"), "payload")),
        F.lit("\r\nsource-payload-length: "), F.octet_length("payload").cast("string"),
        F.lit("\r\n"), F.regexp_replace("http_headers", r"(?m)^", "source-http: "), F.lit("\r\n"),
    )
    both = digests.withColumn("fields", fields).select(
        "page_id", "payload_digest", F.col("record_id").alias("refers_to"),
        F.explode(F.array(_record("metadata", "application/warc-fields", F.col("fields")), _record("conversion", "text/plain; charset=utf-8", F.col("plain")))).alias("r"),
    )
    return both.select("page_id", "refers_to", "payload_digest", "r.warc_type", "r.record_id", "r.headers", "r.block")


def record_bytes(records: DataFrame) -> DataFrame:
    """Each record's complete bytes, ready to be concatenated into a file."""
    return records.withColumn("record", F.concat("headers", F.lit("\r\n"), "block", F.lit("\r\n\r\n")).cast("binary"))
