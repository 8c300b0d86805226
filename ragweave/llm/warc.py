"""WARC records and the resolution of not-modified revisits.

``parse_records`` reads WARC/1.x records from a binary column. ``resolve`` gives every revisit the
response it stands for: the latest earlier full response (status 200) of the same canonical URL, by
an as-of join. The response is accepted if no validator that both sides name differs (ETag, weakly
compared, or else Last-Modified) and at least one agrees; the revisit's headers are then merged
over the stored ones, but for those that describe the body or the connection.

The as-of join is a window over each URL and time block that carries the last full response
forward, and a second one over the last response of each block, so a URL with a large part of all
records is spread over its blocks. It carries a hash of the whole response, by which the stored
headers are joined then: record ids may be missing or repeat. That join's plain sides let adaptive
execution split a response that many revisits share.

Defined results: records without a URL or date resolve to nothing; of responses at the same time
the one with the largest record id is the later, then the one with the largest hash; a revisit at a
response's own time does not see it; null or malformed records, also those whose Content-Length is
negative, no number or beyond their end, have type null and are left out by ``resolve``; an empty
table gives no rows; columns beside the parsed ones are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragweave.llm.common import Tables

#: Length of a time block of the as-of join.
BLOCK_SECONDS = 3600
#: Headers of a 304 that don't replace stored ones.
NOT_MERGED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Query parameters that only track where a visit came from.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid")
PARSED = "type string, record_id string, url string, at timestamp, status int, headers map<string,string>, n_body long, body_sha1 string"
_SESSION = re.compile(r"^(jsessionid|phpsessid|sid|sessionid)$", re.I)


_ESCAPE = re.compile(r"%([0-9A-Fa-f]{2})?")
_UNRESERVED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")


def _escaped(m: re.Match) -> str:
    if m[1] is None:
        return "%25"
    char = chr(int(m[1], 16))
    return char if char in _UNRESERVED else f"%{m[1].upper()}"


def _normal(part: str) -> str:
    """One form of a part of a URL: escapes of unreserved characters are undone, all others are kept, in upper case."""
    return quote(_ESCAPE.sub(_escaped, part), safe="/%~!$&'()*+,;=:@-._?", errors="surrogatepass")


def canonical_url(url: str | None) -> str | None:
    """A URL without scheme, www, default port, fragment, tracking parameters and trailing slash."""
    if not url or "://" not in url:
        return None
    try:
        parts = urlsplit(url.strip())
        port = parts.port
    except ValueError:
        return None
    host = (parts.hostname or "").rstrip(".").lower()
    host = host[4:] if host.startswith("www.") else host
    if port and (parts.scheme.lower(), port) not in (("http", 80), ("https", 443)):
        host = f"{host}:{port}"
    path = _normal(re.sub(r"/{2,}", "/", parts.path)).rstrip("/") or "/"
    query = [_normal(p).partition("=") for p in parts.query.split("&") if p]
    query = sorted((k, v) for k, _, v in query if k.lower() not in TRACKING and not _SESSION.match(k))
    return host + path + ("?" + "&".join(f"{k}={v}" for k, v in query) if query else "")


def _head(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """First line, headers (lower-cased names; repeated ones joined by a comma) and the rest of a block."""
    head, _, rest = block.partition(b"\r\n\r\n")
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).decode("utf-8", "replace").split("\r\n")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            name = name.strip().lower()
            headers[name] = f"{headers[name]}, {value.strip()}" if name in headers else value.strip()
    return lines[0], headers, rest


def _date(text: str) -> datetime | None:
    """A WARC-Date (ISO 8601; UTC unless it says otherwise); None if it is none."""
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def parse_record(data: bytes | None) -> tuple:
    """type, record id, URL, date, HTTP status, HTTP headers, size and SHA-1 of the body; Nones if malformed."""
    nothing = (None,) * 8
    if not data or not data.startswith(b"WARC/1."):
        return nothing
    _, warc, block = _head(data)
    length = warc.get("content-length", "")
    if not (length.isascii() and length.isdigit() and len(length) < 19 and int(length) <= len(block)):
        return nothing
    block = block[: int(length)]
    at = _date(warc.get("warc-date", ""))
    http: dict[str, str] = {}
    status, body = None, block
    if warc.get("content-type", "").startswith("application/http"):
        first, http, body = _head(block)
        code = re.match(r"HTTP/\S+ (\d{3})", first)
        status = int(code[1]) if code else None
    return (warc.get("warc-type"), warc.get("warc-record-id", "").strip("<>") or None, warc.get("warc-target-uri"), at, status, http, len(body), hashlib.sha1(body).hexdigest())


def parse_records(records: DataFrame, column: str = "record") -> DataFrame:
    """The parsed fields of each record of a binary column, and its canonical URL."""
    names = [x.split()[0] for x in PARSED.split(", ")] + ["canonical"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.int32(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = [(*r, canonical_url(r[2])) for r in (parse_record(x.as_py()) for x in batch.column(0))]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            columns[5] = [None if x is None else list(x.items()) for x in columns[5]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return records.select(column).mapInArrow(run, PARSED + ", canonical string")


def _agreement(response: Column, revisit: Column) -> Column:
    """Whether the validators of a response and a revisit agree: ETag if both have it, else Last-Modified."""
    bare = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    etag, dated = bare(response).isNotNull() & bare(revisit).isNotNull(), response["last-modified"].isNotNull() & revisit["last-modified"].isNotNull()
    return F.when(etag, bare(response) == bare(revisit)).when(dated, response["last-modified"] == revisit["last-modified"]).otherwise(F.lit(False))


def resolve(records: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """One row per revisit of a table of ``parse_records``: record_id, canonical, at, response_id, outcome and headers.

    outcome is resolved, changed (a validator differs or none is shared) or orphan (no earlier
    full response); headers are the merged ones where resolved, the revisit's own elsewhere.
    """
    tables = Tables(records.sparkSession)
    full = (F.col("type") == "response") & (F.col("status") == 200)
    df = records.where(full | (F.col("type") == "revisit"))
    df = df.select("type", "record_id", "canonical", "at", "headers", "n_body", "body_sha1", F.floor(F.unix_seconds("at") / block_seconds).alias("block"))
    headers = F.array_sort(F.map_entries("headers"))
    df = tables.write(df.withColumn("key", F.when(F.col("type") == "response", F.xxhash64("record_id", "at", "n_body", "body_sha1", headers))))
    usable = df.where("canonical is not null and at is not null")
    # The last response of each block, carried over the blocks of its URL.
    light = F.when(F.col("type") == "response", F.struct("at", "record_id", "key"))
    blocks = usable.groupBy("canonical", "block").agg(F.max(light).alias("last"))
    earlier = Window.partitionBy("canonical").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("canonical", "block", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    # Inside a block, strictly earlier responses.
    order = Window.partitionBy("canonical", "block").orderBy(F.unix_micros("at")).rangeBetween(Window.unboundedPreceding, -1)
    inside = usable.withColumn("inside", F.max(light).over(order)).where("type = 'revisit'")
    found = inside.join(carried, ["canonical", "block"]).withColumn("match", F.coalesce("inside", "carried"))
    found = found.select("record_id", "canonical", "at", "headers", F.col("match.record_id").alias("response_id"), F.col("match.key").alias("key"))
    lost = df.where("type = 'revisit' and (canonical is null or at is null)").select("record_id", "canonical", "at", "headers", F.lit(None).cast("string").alias("response_id"), F.lit(None).cast("long").alias("key"))
    found = found.unionByName(lost)
    # The stored headers of what was found; many revisits may share one response.
    stored = usable.where("type = 'response'").select("canonical", "key", F.col("headers").alias("stored"), F.col("n_body").alias("stored_body"), F.col("body_sha1").alias("stored_sha1"))
    stored = tables.write(stored.dropDuplicates(["canonical", "key"]))
    out = found.join(stored, ["canonical", "key"], "left")
    agrees = _agreement(F.col("stored"), F.col("headers"))
    outcome = F.when(F.col("key").isNull(), "orphan").when(agrees, "resolved").otherwise("changed")
    news = F.map_filter("headers", lambda k, v: ~k.isin(*NOT_MERGED))
    merged = F.map_concat(F.map_filter("stored", lambda k, v: ~F.map_contains_key(news, k)), news)
    ok = F.col("outcome") == "resolved"
    out = out.withColumn("outcome", outcome).withColumn("merged", F.when(ok, merged).otherwise(F.col("headers")))
    return out.select("record_id", "canonical", "at", "response_id", "outcome", F.col("merged").alias("headers"), F.when(ok, F.col("stored_body")).alias("n_body"), F.when(ok, F.col("stored_sha1")).alias("body_sha1"))


def page_records(pages: DataFrame) -> DataFrame:
    """WARC records of a small crawl log made from ``pages``: a full response of each page and two revisits.

    The page id sets the times and what a revisit says: a third of the pages are captured again
    under another scheme or with a tracking parameter, some revisits carry another ETag, and some
    come before any response.
    """
    i = F.coalesce(F.col("page_id").cast("long"), F.lit(0))
    base = F.lit(1_700_000_000) + F.pmod(i * 37, F.lit(86_400 * 30))
    when = lambda s: F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    url = F.coalesce(F.col("url"), F.lit(""))
    body = F.coalesce(F.col("html"), F.lit(""))
    tag = F.substring(F.md5(body), 1, 16)

    def record(kind, number, at, status, etag, target, content):
        crlf = "\r\n"
        http = F.concat(F.lit(f"HTTP/1.1 {status}{crlf}ETag: \""), etag, F.lit(f"\"{crlf}Date: "), when(at), F.lit(f"{crlf}X-Cache: {kind}{crlf}Content-Length: "), F.octet_length(content).cast("string"), F.lit(f"{crlf}{crlf}"), content)
        rid = F.concat(F.lit("<urn:page:"), i.cast("string"), F.lit(f":{number}>"))
        head = F.concat(F.lit(f"WARC/1.1{crlf}WARC-Type: {kind}{crlf}WARC-Record-ID: "), rid, F.lit(f"{crlf}WARC-Date: "), when(at), F.lit(f"{crlf}WARC-Target-URI: "), target, F.lit(f"{crlf}Content-Type: application/http; msgtype=response{crlf}Content-Length: "), F.octet_length(http).cast("string"), F.lit(f"{crlf}{crlf}"))
        return F.encode(F.concat(head, http, F.lit(f"{crlf}{crlf}")), "UTF-8")

    other = F.when(i % 5 == 0, F.concat(F.lit("x"), tag)).otherwise(tag)
    again = F.when(i % 3 == 0, F.regexp_replace(url, "^https:", "http:")).otherwise(url)
    early = F.when(i % 7 == 0, base - 90_000).otherwise(base + 90_000)
    made = F.array(record("response", 0, base, "200 OK", tag, url, body), record("revisit", 1, base + 600, "304 Not Modified", other, again, F.lit("")), record("revisit", 2, early, "304 Not Modified", tag, again, F.lit("")))
    return pages.select(F.explode(made).alias("record"))


def report(pages: DataFrame) -> DataFrame:
    """The resolution of every revisit of ``page_records``: ids, outcome, body and a digest of the merged headers."""
    out = resolve(parse_records(page_records(pages)))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), "\n")
    part = lambda c, k: F.split(c, ":")[k].cast("long")
    return out.select(part(F.col("record_id"), 2).alias("page_id"), part(F.col("record_id"), 3).alias("revisit"), "canonical", "outcome", part(F.col("response_id"), 2).alias("response_page_id"), "n_body", "body_sha1", F.md5(headers).alias("headers_md5"))
