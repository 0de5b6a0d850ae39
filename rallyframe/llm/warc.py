"""WARC archives: writing with segments and revisits, and reassembly of segmented records.

Writing: each page becomes an HTTP response with chunked transfer framing. Blocks longer than ``SEGMENT`` bytes are cut: the
first record carries ``WARC-Segment-Number: 1``, the others are ``continuation`` records with the origin's identifier, and
the last one has the total length. Pages whose payload another page has already (same SHA-256, at least ``LEAST`` bytes)
become ``revisit`` records that name the page with the smallest id. Records are written by Spark's text writer, whose line
separator closes them; chunks are cut so that no block holds the delimiter that starts a record, however odd the page.

Reading: Spark's text reader splits files at that delimiter; each record is parsed in its task, and where a block of
another writer holds the delimiter, it is joined again by its Content-Length (in gzip files always; a plain file that Spark
cuts into several splits must not be cut within such a block). Whole records need no shuffle; continuation records are grouped by origin identifier, ordered by segment number, checked against
the total length and joined, a group being one page; then the chunked framing is decoded and the payload's digest checked.

Defined cases: null html is an empty payload; empty and very long pages round-trip; rows that repeat both id and payload
are responses each; a null id has no id header and comes back null, and is no page to refer to unless all pages with its
payload have none (each of these is a response); a missing segment, a wrong total length, broken framing or a wrong digest
gives intact = false; an empty table gives an empty archive and an empty table; input columns other than id, url and html
are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.plans.scratch import sized_join, stash

SEGMENT, CHUNK, LEAST = 65_536, 8_192, 100
#: Records a file holds at most.
FILE_RECORDS = 20_000
START = b"WARC/1.1\r\n"
#: Header fields and profile of the format.
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes) -> bytes:
    """The payload in chunks; an occurrence of the format's name, which starts a record, is cut in two."""
    cuts = {*range(0, len(payload), CHUNK), len(payload), *(m.start() + 4 for m in re.finditer(re.escape(START.strip()), payload))}
    ends = sorted(cuts)
    parts = [b"%x\r\n%b\r\n" % (b - a, payload[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if its framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return None
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            return None
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def _cut(block: bytes) -> list[bytes]:
    return [block[at : at + SEGMENT] for at in range(0, len(block), SEGMENT)] or [b""]


def _head(fields: list[tuple[str, str | int | None]]) -> bytes:
    lines = [f"{k}: {re.sub(r'[\r\n]+', ' ', str(v)).replace('WARC/1.1', 'WARC%2F1.1')}" for k, v in fields if v is not None]
    return START + "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n"


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of each record but for its last line break. Rows: id, url, payload, row, digest, refers_to."""
    for batch in batches:
        out = []
        for page, url, payload, row, digest, refers in batch[["id", "url", "payload", "row", "digest", "refers_to"]].itertuples(index=False, name=None):
            own = None if page is None or page != page else int(page)
            name = hashlib.md5(f"{own}:{digest}:{row}".encode()).hexdigest()
            urn = lambda k, x=name: f"<urn:uuid:{hashlib.md5(f'{x}:{k}'.encode()).hexdigest()}>"
            about = [("WARC-Date", DATE), ("WARC-Target-URI", url or None), ("WARC-Page-ID", own)]
            payload = bytes(payload)
            known = [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", len(payload))]
            if refers is not None and refers == refers:
                fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", urn(1)), *about, ("WARC-Profile", PROFILE), ("WARC-Refers-To-Page-ID", int(refers)), *known, ("Content-Length", 0)]
                out.append(_head(fields) + b"\r\n")
                continue
            block = HTTP + chunked(payload)
            parts = _cut(block)
            for k, part in enumerate(parts, 1):
                fields = [("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Record-ID", urn(k))]
                if k == 1:
                    fields += [*about, *known, ("Content-Type", "application/http;msgtype=response")]
                else:
                    fields += [("WARC-Date", DATE), ("WARC-Segment-Origin-ID", urn(1))]
                if len(parts) > 1:
                    fields.append(("WARC-Segment-Number", k))
                if 1 < len(parts) == k:
                    fields.append(("WARC-Segment-Total-Length", len(block)))
                out.append(_head([*fields, ("Content-Length", len(part))]) + part + b"\r\n")
        yield pd.DataFrame({"value": out})


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one record per page (and its continuations) below ``path``."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long_enough = F.octet_length("payload") >= LEAST
    # the smallest page of each payload that several pages have: counted per digest before anything moves
    first = rows.where(long_enough).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    first = stash(first, "digests")
    rows = sized_join(rows, first, ["digest"], "left", first.count()).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("refers_to", F.when(long_enough & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")
    records = rows.mapInPandas(_records, "value binary").select(F.col("value").cast("string").alias("value"))
    # a text row's separator is the line break that ends a record
    records.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n"))}


def _number(fields: dict[str, str], name: str) -> int | None:
    return int(fields[name]) if re.fullmatch(r"-?\d+", fields.get(name, "")) else None


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[list[bytes]]:
    """Records as long as their Content-Length says: a block that holds the delimiter itself is joined again.

    Rows come in the order of their file; a file begins with the delimiter, so with an empty row.
    """
    held, missing = b"", 0
    for batch in batches:
        out = []
        for raw in map(bytes, batch["value"]):
            if held:
                if raw and len(raw) + len(START) <= missing + 4:  # the line breaks after a block may be missing
                    held += START + raw
                    missing -= len(START) + len(raw)
                    if missing <= 0:
                        out.append(held)
                        held = b""
                    continue
                out.append(held)  # cut short
                held = b""
            head, gap, rest = raw.partition(b"\r\n\r\n")
            length = _number(_fields(head), "content-length") if gap else None
            if length is not None and length > len(rest):
                held, missing = raw, length - len(rest)
            elif raw:
                out.append(raw)
        yield out
    if held:
        yield [held]


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Header fields and block of each record. Rows: the bytes between two record starts."""
    for records in _whole(batches):
        rows = []
        for raw in records:
            head, gap, rest = raw.partition(b"\r\n\r\n")
            fields = _fields(head)
            if not gap or "warc-type" not in fields:
                continue
            length = _number(fields, "content-length")
            short = length is None or length > len(rest)
            rows.append((
                fields["warc-type"].lower(), fields.get("warc-record-id"), fields.get("warc-segment-origin-id"), _number(fields, "warc-segment-number"), _number(fields, "warc-segment-total-length"),
                _number(fields, "warc-page-id"), fields.get("warc-target-uri"), _number(fields, "warc-refers-to-page-id"), fields.get("warc-payload-digest", "").removeprefix("sha256:"),
                _number(fields, "warc-payload-length"), None if short else rest[:length],
            ))
        frame = pd.DataFrame(rows, columns=["kind", "record", "origin", "segment", "total", "id", "url", "refers_to", "digest", "length", "block"])
        yield frame.astype(dict.fromkeys(("segment", "total", "id", "refers_to", "length"), "Int64"))


_PARSED = "kind string, record string, origin string, segment long, total long, id long, url string, refers_to long, digest string, length long, block binary"


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for kind, block, whole, digest, length in batch[["kind", "block", "whole", "digest", "length"]].itertuples(index=False, name=None):
            if kind == "revisit":
                rows.append((length, digest, None, True))
                continue
            payload = None
            if block is not None and whole:
                head, gap, body = bytes(block).partition(b"\r\n\r\n")
                payload = body if b"transfer-encoding: chunked" not in head.lower() else dechunked(body)
                payload = payload if gap else None
            real = None if payload is None else hashlib.sha256(payload).hexdigest()
            rows.append((None if payload is None else len(payload), real, payload, real is not None and real == digest))
        made = pd.DataFrame(rows, columns=["payload_bytes", "payload_digest", "payload", "intact"]).astype({"payload_bytes": "Int64", "intact": bool})
        yield pd.concat([batch[["id", "url", "kind", "refers_to"]].reset_index(drop=True), made], axis=1)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per page of the archives below ``path``: page_id, url, record_type, refers_to, payload (null for revisits), payload_bytes, payload_digest and intact."""
    raw = spark.read.option("lineSep", START.decode()).text(path).select(F.col("value").cast("binary").alias("value"))
    records = raw.mapInPandas(_parsed, _PARSED)
    firsts = records.where("kind in ('response', 'revisit')")
    alone = firsts.where("segment is null").withColumn("whole", F.lit(True))
    parts = records.where("segment is not null").withColumn("origin", F.when(F.col("kind") == "continuation", F.col("origin")).otherwise(F.col("record")))
    ordered = F.sort_array(F.collect_list(F.struct("segment", "block")))
    of_first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    grouped = parts.groupBy("origin").agg(ordered.alias("parts"), F.max("total").alias("total"), *[of_first(c) for c in ("kind", "record", "id", "url", "refers_to", "digest", "length")])
    joined = F.aggregate(F.transform("parts", lambda p: p["block"]), F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    counted = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long"))
    grouped = grouped.where("kind is not null").withColumn("block", joined).withColumn("whole", F.coalesce(counted & (F.octet_length("block") == F.col("total")), F.lit(False)))
    columns = ["id", "url", "kind", "refers_to", "digest", "length", "block", "whole"]
    found = alone.select(*columns).union(grouped.select(*columns))
    out = found.mapInPandas(_decoded, "id long, url string, kind string, refers_to long, payload_bytes long, payload_digest string, payload binary, intact boolean")
    return out.select(F.col("id").alias("page_id"), "url", F.col("kind").alias("record_type"), "refers_to", "payload", "payload_bytes", "payload_digest", "intact")
