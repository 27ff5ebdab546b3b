"""WARC archives: writing captures, reading archives, and assembling transactions.

A capture is written as a request, a response (or a revisit of an earlier one with the same payload) and a metadata
record; the request and the metadata name the response in WARC-Concurrent-To. Archives are plain concatenations of records, written
by Spark's text writer and compressed file by file. Reading parses whole files by their Content-Length fields, so that a
payload may hold anything. Transactions are assembled by following concurrent-to identifiers to the record that has none.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from towline.session import checkpoint_folder, cut, drop

from .frames import bounded

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed by the format
_END = "\r\n"
MAX_FILE_BYTES = 16 << 20  # of records, before compression


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column."""
    digest = F.sha1(payload)
    groups = [F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 10).cast("int") for i in range(8)]
    letter = lambda g, shift: F.substring(F.lit(_BASE32), F.shiftright(g, shift).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*[letter(g, s) for g in groups for s in (15, 10, 5, 0)])


def _record_id(kind: str, *parts: Column) -> Column:
    """A URN that depends on the capture only, so that a task that runs again writes the same."""
    h = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))
    pieces = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for a NULL value. Control characters and spaces of values are written as %20."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\x00-\x20\x7f]", "%20"), F.lit(_END)), F.lit(""))


def _record(kind: str, headers: list[Column], block: Column) -> Column:
    """One record without the two line ends that close it, as the writer adds them."""
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(_END))
    return F.concat(F.lit(f"WARC/1.1{_END}WARC-Type: {kind}{_END}"), *headers, length, F.lit(_END), block)


def _numbered(rows: DataFrame, repeated: DataFrame, together: int = 1000) -> DataFrame:
    """`rows` with a `number` that tells equal captures apart. The `repeated` ones are written from one row each and their count, so no group is
    sorted, and are dealt out again, `together` at a time, so none makes a large task."""
    if repeated.isEmpty():
        return rows.withColumn("number", F.lit(0).cast("bigint"))
    keys = ["digest", "page_id", "url"]
    some = bounded(repeated, F.lit(96) + F.coalesce(F.octet_length("url"), F.lit(0))).withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    once = rows.join(some, same, "left_anti").withColumn("number", F.lit(0).cast("bigint"))
    again = rows.join(some, same).groupBy(*keys).agg(F.first("body").alias("body"), F.first("__n").alias("__n"))
    again = again.withColumn("__low", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1, F.lit(together).cast("bigint"))))
    again = again.repartition(*keys, "__low").withColumn("number", F.explode(F.sequence("__low", F.least(F.col("__low") + together, F.col("__n")) - 1)))
    return once.unionByName(again.drop("__n", "__low"))


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0) -> None:
    """Write a transaction for each capture of `pages` (page_id, url, html) as gzipped WARC files into `folder`.

    Of captures with equal payloads of at least `least_bytes` bytes, the one with the largest page_id is a response and
    the others are revisits of it; smaller payloads are always responses. NULL html is an empty payload; a NULL url has no
    target. NULL page_ids are smaller than all others and never revisited unless all are NULL. Rows with the same
    page_id, url and payload are numbered, so that each is a capture of its own; of those the first is the one revisited.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("body"), base32_sha1(payload.cast("binary")).alias("digest"))
    # Only payloads that recur: with the written size known, a small table is sent to all tasks and the pages are not shuffled.
    # Equal captures are counted first, so that a payload of any number of copies is combined before it is shuffled.
    seen = cut(rows.groupBy("digest", "page_id", "url").agg(F.count(F.lit(1)).alias("__n"), F.first(F.octet_length("body")).alias("__bytes")))
    copies = seen.filter(F.col("__bytes") >= least_bytes).groupBy("digest").agg(
        F.max(F.struct("page_id", "url")).alias("__first"), F.min("page_id").alias("__min"), F.count("page_id").alias("__ids"), F.count(F.lit(1)).alias("__all"))
    copies = copies.select("digest", F.col("__first.page_id").alias("keep"), F.col("__first.url").alias("keep_url"), "__min", "__ids", "__all")
    copies = cut(copies.filter("keep is not null and (keep <> __min or __ids < __all)").select("digest", "keep", "keep_url"))
    repeated = cut(seen.filter("__n > 1").select("digest", "page_id", "url", "__n"))
    mean = seen.agg(F.sum(F.col("__bytes") * F.col("__n")) / F.sum("__n")).first()[0] or 0
    drop(seen)
    rows = _numbered(rows, repeated).join(bounded(copies, F.lit(80) + F.coalesce(F.octet_length("keep_url"), F.lit(0))), "digest", "left")
    revisit = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))

    # The url comes last and is marked, so that no two captures read alike.
    own = [F.col("page_id"), F.col("digest"), F.concat(F.lit("url "), "url"), F.when(F.col("number") > 0, F.col("number"))]
    name = _record_id("response", *own)
    original = _record_id("response", F.col("keep"), F.col("digest"), F.concat(F.lit("url "), "keep_url"), F.lit(None))
    size = F.octet_length("body").cast("string")
    target, when = _header("WARC-Target-URI", F.col("url")), _header("WARC-Date", F.lit(date))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), size, F.lit(_END + _END))
    common = [_header("WARC-Record-ID", name), target, when, _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
              _header("Content-Type", F.lit("application/http;msgtype=response"))]
    response = _record("response", common, F.concat(http, "body"))
    again = _record("revisit", [
        *common, _header("WARC-Refers-To", original), _header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
    ], http)
    beside = [target, when, _header("WARC-Concurrent-To", name)]
    request = _record("request", [
        _header("WARC-Record-ID", _record_id("request", *own)), *beside,
        _header("Content-Type", F.lit("application/http;msgtype=request")),
    ], F.concat(F.lit("GET "), F.regexp_replace(F.coalesce("url", F.lit("/")), r"[\x00-\x20\x7f]", "%20"), F.lit(f" HTTP/1.1{_END}{_END}")))
    metadata = _record("metadata", [
        _header("WARC-Record-ID", _record_id("metadata", *own)), *beside, _header("Content-Type", F.lit("application/warc-fields")),
    ], F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(_END)))
    records = rows.select(F.explode(F.array(request, F.when(revisit, again).otherwise(response), metadata)).alias("value"))
    # Files are read whole, so their sizes are bounded by rows of mean size; one huge record is a file of its own at most.
    per_file = max(1, int(MAX_FILE_BYTES / (mean + 2000)) * 3)
    records.write.option("lineSep", _END + _END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)


_FIELDS = (
    "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, payload_bytes bigint, "
    "payload_digest string, stated_digest string, stated_bytes bigint, fields string, payload binary"
)


def _parsed(data: bytes):
    """Records of one archive: (headers with lower-case names, block). Members may be compressed one by one or together."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    view, at = memoryview(data), 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data) or not data[at : at + 16].strip():
            return
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        headers: dict[str, list[str]] = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        length = int(headers["content-length"][0])
        yield headers, view[end + 4 : end + 4 + length]
        at = end + 4 + length


def _rows(data: bytes, with_payload: bool):
    for headers, block in _parsed(data):
        one = lambda name: headers.get(name, [None])[0]
        kind, payload, stated, fields = one("warc-type"), block, None, None
        if (one("content-type") or "").startswith("application/http"):
            head, mark, _ = bytes(block[: 1 << 16]).partition(b"\r\n\r\n")
            if not mark:
                head, mark, _ = bytes(block).partition(b"\r\n\r\n")
            payload = block[len(head) + len(mark) :]
            sizes = [x.split(b":", 1)[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            stated = int(sizes[0]) if sizes else None
        elif kind == "metadata":
            fields = bytes(block).decode("utf-8", "replace")
        digest = (one("warc-payload-digest") or "").removeprefix("sha1:") or None
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind in ("response", "resource") else None
        yield (one("warc-record-id"), kind, headers.get("warc-concurrent-to"), one("warc-refers-to"), one("warc-target-uri"), one("warc-date"),
               len(payload), own, digest, stated, fields, bytes(payload) if with_payload else None)


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """One row per record of the WARC files in `folder`. A broken record is an error, not a skipped row."""

    def run(batches):
        kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(),
                 pa.string(), pa.binary()]
        names = [f.split()[0] for f in _FIELDS.split(", ")]
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for row in _rows(content.as_py(), payload):
                    rows.append(row)
                    size += 500 + (len(row[-1]) if row[-1] else 0)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(run, _FIELDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, requests, metadata.

    A response, revisit or resource is the capture itself. Other records belong to the capture that their concurrent-to
    identifiers lead to, also by way of other such records; those that lead nowhere form captures without
    response under the last identifier reached, and those without identifier under their own. Of records with one id the first
    of equal ones counts. Links that form a circle end at their least identifier.
    """
    main = F.col("type").isin("response", "revisit", "resource")
    head = F.struct(*[c for c in records.columns if c != "concurrent_to"])
    captures = records.filter(main).groupBy(F.col("record_id").alias("capture_id")).agg(F.first(head).alias("response"))
    beside = records.filter(~main).withColumn("capture_id", F.coalesce(F.array_min("concurrent_to"), "record_id"))
    # Identifiers that are records beside a capture themselves lead on; most archives have none.
    steps = beside.filter(F.col("capture_id") != F.col("record_id")).select(F.col("record_id").alias("capture_id"), F.col("capture_id").alias("__next"))
    inner = cut(steps.join(beside.select("capture_id").distinct(), "capture_id", "left_semi").distinct())
    if not inner.isEmpty():
        beside = _followed(beside, steps)
    parts = beside.groupBy("capture_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("type") == "request", F.struct("record_id", "target_uri", "date", "payload_bytes")))).alias("requests"),
        F.array_sort(F.collect_set(F.when(F.col("type") != "request", F.struct("record_id", "type", "target_uri", "fields")))).alias("metadata"))
    return captures.join(parts, "capture_id", "full")


def _followed(beside: DataFrame, steps: DataFrame) -> DataFrame:
    """`beside` with capture_id replaced by the end of its chain, by doubling the steps until none leads on."""
    steps = cut(steps.groupBy("capture_id").agg(F.min("__next").alias("__next")))
    while True:
        onward = steps.select(F.col("capture_id").alias("__next"), F.col("__next").alias("__far"))
        doubled = steps.join(onward, "__next", "left").select(
            "capture_id", "__next", F.when(F.col("__far") == F.col("capture_id"), F.least("capture_id", "__next")).otherwise(F.coalesce("__far", "__next")).alias("__end"))
        doubled = cut(doubled)
        steps = doubled.select("capture_id", F.col("__end").alias("__next"))
        if doubled.filter("__end <> __next").isEmpty():
            return beside.join(steps, "capture_id", "left").withColumn("capture_id", F.coalesce("__next", "capture_id")).drop("__next")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, capture_id) per row of `pages`, from archives written and read back.

    Length and digest of a revisit are those of the payload it refers to.
    """
    folder = f"{checkpoint_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    records = cut(read_archives(spark, folder, payload=False))
    captures = cut(assemble(records).select(
        "capture_id", F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("original"),
        F.coalesce("response.payload_digest", "response.stated_digest").alias("payload_digest"), F.col("response.payload_bytes").alias("own_bytes"),
        F.regexp_extract(F.get("metadata", F.lit(0))["fields"], r"pageId: (-?\d*)", 1).alias("page")))
    drop(records)
    page = F.when(F.col("page") != "", F.col("page").cast("bigint"))
    seen = captures.filter("record_type = 'revisit'").select(F.col("original").alias("capture_id")).distinct()
    originals = captures.join(seen, "capture_id", "left_semi").select(
        F.col("capture_id").alias("original"), page.alias("refers_to"), F.col("own_bytes").alias("full_bytes"))
    found = captures.join(bounded(cut(originals), 96), "original", "left")
    revisit = F.col("record_type") == "revisit"
    return found.select(
        page.alias("page_id"), F.when(revisit, F.col("full_bytes")).otherwise(F.col("own_bytes")).alias("payload_bytes"), "payload_digest", "record_type",
        F.when(revisit, F.col("refers_to")).alias("refers_to"), "capture_id")
