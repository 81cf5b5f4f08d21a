"""WARC archives: pages are written as request, response (or revisit) and metadata records, and read back as captures.

Writing is Spark's own text writer with the record terminator as line separator: records are text up to their end, and the commit
protocol takes care of lost executors and of any store. Archives are gzip files of at most BYTES of payload each, or one capture.
Reading parses by Content-Length, so payloads may hold anything. Transactions are assembled through WARC-Concurrent-To, of which a record may have
several: records that name a response, or that it names, meet it by that identifier in one nested row.
"""

from __future__ import annotations

import contextlib
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import normal_text, on_files, removed, scratch, shared_path, stored, table, with_row_id

LEAST = 100
#: Payload bytes of an archive at most, before compression; a power of two.
BYTES = 1 << 26
#: Rows of a table file from which an archive takes its captures at most; a power of two.
ROWS = 1 << 11
#: Archives that a task holds open before it sorts its rows by archive.
OPEN = 48
OPEN_SETTING = "spark.sql.maxConcurrentOutputFileWriters"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
#: archive and at: where the record lies, so that a capture can list its records in that order.
RECORD = "archive string, at long, record_id string, kind string, concurrent_to array<string>, uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, fields map<string,string>"


def _record_id(role: str, page: Column, rid: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(role), F.coalesce(page.cast("string"), F.lit("")), rid.cast("string")))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: str, headers: list[tuple[str, Column | str | None]], block: Column) -> Column:
    """One record without its terminator; headers with a null value are left out."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}")]
    lines += [F.concat(F.lit(f"{k}: "), v if isinstance(v, Column) else F.lit(v)) for k, v in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def _archive(rid: Column, size: Column, most: int) -> Column:
    """Names the archive of a row, which holds the rows of one run of a file that have one bound to their sizes. The bounds double from
    most / ROWS on and the runs halve from ROWS rows on, so a run's rows never exceed `most` bytes; a row above that is alone."""
    halvings = F.lit(ROWS.bit_length() - 1)
    for k in reversed(range(ROWS.bit_length() - 1)):
        halvings = F.when(size <= most // ROWS * 2**k, F.lit(k)).otherwise(halvings)
    run = F.floor(rid["row"] * F.pow(F.lit(2.0), halvings) / ROWS)
    return F.concat_ws("-", F.lit("rows"), F.hex(rid["file"]), halvings.cast("string"), run.cast("string"))


def repeated_payloads(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(rid, first_page, first_rid) of the rows of (rid, page_id, digest, bytes) that revisit another. Payloads take no part."""
    narrow = stored(rows.filter(F.col("bytes") >= least).select("rid", "page_id", "digest"), "warc-digests")
    order = F.struct(F.col("page_id").isNull(), "page_id", "rid")
    firsts = narrow.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = narrow.join(firsts, "digest").filter(F.col("first.rid") != F.col("rid"))
    return stored(again.select("rid", F.col("first.page_id").alias("first_page"), F.col("first.rid").alias("first_rid")), "warc-repeats")


def records_of(pages: DataFrame, least: int = LEAST, most: int = BYTES) -> DataFrame:
    """Three records per row of pages (page_id, url, html), in the column value, and the archive they belong to.

    Among equal payloads of at least `least` bytes the smallest page_id is the response (null last, then the first row), the others
    revisit it; page_id may have any type that has an order and a string form. Null html is the empty payload, white space and
    controls in a url become %20. Repeated rows are captures of their own. Which rows revisit is decided without payloads and joined
    by row id, so no frequent payload makes a large partition."""
    html = normal_text(F.col("html"))
    uri = F.regexp_replace(normal_text(F.col("url")), r"[\x00-\x20\x7f]", "%20")
    rows = with_row_id(on_files(pages)).select("rid", "page_id", uri.alias("uri"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    rows = rows.join(repeated_payloads(rows, least), "rid", "left")
    again = F.col("first_rid").isNotNull() & (F.col("first_rid") != F.col("rid"))
    ids = {k: _record_id(k, F.col("page_id"), F.col("rid")) for k in ("request", "response", "metadata")}
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    common = [("WARC-Date", DATE), ("WARC-Target-URI", F.col("uri"))]
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    http = ("Content-Type", "application/http; msgtype=response")
    request = _record("request", [("WARC-Record-ID", ids["request"]), ("WARC-Concurrent-To", ids["response"]), *common, ("Content-Type", "application/http; msgtype=request")], F.concat(F.lit("GET "), F.col("uri"), F.lit(" HTTP/1.1\r\n\r\n")))
    response = _record("response", [("WARC-Record-ID", ids["response"]), *common, digest, http], F.concat(head, F.col("html")))
    revisit = _record("revisit", [("WARC-Record-ID", ids["response"]), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id("response", F.col("first_page"), F.col("first_rid"))), digest, http], head)
    meta = _record("metadata", [("WARC-Record-ID", ids["metadata"]), ("WARC-Concurrent-To", ids["response"]), *common, ("Content-Type", "application/warc-fields")], F.concat(F.lit("via: lexquarry\r\n"), F.coalesce(F.concat(F.lit("page-id: "), F.url_encode(F.col("page_id").cast("string")), F.lit("\r\n")), F.lit(""))))
    return rows.select(_archive(F.col("rid"), F.col("bytes"), most).alias("archive"), F.explode(F.array(request, F.when(again, revisit).otherwise(response), meta)).alias("value"))


@contextlib.contextmanager
def _archives_open(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(OPEN_SETTING)
    spark.conf.set(OPEN_SETTING, OPEN)
    try:
        yield
    finally:
        spark.conf.set(OPEN_SETTING, before)


def write_archives(pages: DataFrame, path: str, least: int = LEAST, most: int = BYTES) -> None:
    """Archives of at most `most` payload bytes, or of one capture. What decides on revisits is stored meanwhile."""
    spark = pages.sparkSession
    with scratch(spark), _archives_open(spark):
        records_of(pages, least, most).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").partitionBy("archive").text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], list[str], bytes]]:
    """Of each record: headers (lower-case names; of repeated ones the last), all values of WARC-Concurrent-To in their order, block."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:60]!r}")
        headers: dict[str, str] = {}
        concurrent: list[str] = []
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[key := name.strip().lower()] = value.strip()
            if key == "warc-concurrent-to":
                concurrent.append(value.strip())
        yield headers, concurrent, stream.read(int(headers["content-length"]))


def _row(headers: dict[str, str], concurrent: list[str], block: bytes, with_payload: bool) -> tuple:
    kind, digest, size, payload, fields = headers["warc-type"], None, None, None, None
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        if kind == "response":
            digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
        else:
            digest = headers["warc-payload-digest"].removeprefix("sha256:")
            size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        payload = payload if with_payload and kind == "response" else None
    elif kind == "metadata":
        fields = [tuple(map(str.strip, x.split(":", 1))) for x in block.decode().split("\r\n") if ":" in x]
    return headers["warc-record-id"], kind, concurrent, headers.get("warc-target-uri"), headers.get("warc-refers-to"), digest, size, payload, fields


def _record_reader(with_payload: bool):
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())] + [pa.string()] * 3 + [pa.int64(), pa.binary(), pa.map_(pa.string(), pa.string())]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                rows, held = [], 0
                for at, (headers, concurrent, block) in enumerate(parse(io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer()))))):
                    rows.append((path, at, *_row(headers, concurrent, block, with_payload)))
                    held += 500 + len(block) * with_payload
                    if held > 4_000_000:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    return read


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_record_reader(with_payload), RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response (null where there is none), requests, metadata, others (arrays of structs, in
    the order of archives).

    A response or revisit makes a capture, named by its record id. Other records belong to every capture whose response they name or
    are named by, in any of their concurrent-to identifiers. Records without such a response make captures without one: together if
    they first name the same record, else alone, named by that or their own id. Of several responses with one id the first is
    response and the rest are in others, as are records of further kinds. No record is lost."""
    head = F.col("kind").isin("response", "revisit")
    ids = stored(records.select("record_id", head.alias("is_head"), "concurrent_to"), "warc-ids")
    named = ids.select("record_id", "is_head", F.explode("concurrent_to").alias("other"))
    heads = ids.filter("is_head").select(F.col("record_id").alias("capture_id")).distinct()
    ends = named.select("record_id", F.col("other").alias("capture_id")).union(named.filter("is_head").select(F.col("other").alias("record_id"), F.col("record_id").alias("capture_id")))
    joined = ends.join(heads, "capture_id").distinct()
    rows = records.withColumn("is_head", head).join(joined.select("record_id", F.col("capture_id").alias("of")), "record_id", "left")
    own = F.when(F.col("is_head"), F.col("record_id")).otherwise(F.coalesce("of", F.try_element_at("concurrent_to", F.lit(1)), "record_id"))
    rows = rows.withColumn("capture_id", own).dropDuplicates(["capture_id", "archive", "at"])
    part = F.struct("archive", "at", "record_id", "kind", "concurrent_to", "uri", "refers_to", "payload_digest", "payload_bytes", "payload", "fields")
    grouped = rows.groupBy("capture_id").agg(F.array_sort(F.collect_list(part), lambda a, b: F.when(F.struct(a["archive"], a["at"]) < F.struct(b["archive"], b["at"]), -1).otherwise(1)).alias("all"))
    of = lambda test: F.filter("all", test)
    is_head = lambda x: x["kind"].isin("response", "revisit")
    found = of(is_head)
    others = F.concat(F.slice(found, 2, F.greatest(F.size(found), F.lit(1))), of(lambda x: ~x["kind"].isin("response", "revisit", "request", "metadata")))
    return grouped.select("capture_id", F.try_element_at(found, F.lit(1)).alias("response"), of(lambda x: x["kind"] == "request").alias("requests"), of(lambda x: x["kind"] == "metadata").alias("metadata"), others.alias("others"))


def page_rows(found: DataFrame, kind: T.DataType | str = "long") -> DataFrame:
    """page_id (as `kind`, the type that it had; an id that is not of this type is an error), payload_bytes, payload_digest, record_type,
    refers_to of the captures that have a response."""
    page = F.url_decode(F.try_element_at(F.try_element_at("metadata", F.lit(1))["fields"], F.lit("page-id"))).cast(kind)
    found = found.filter("response is not null")
    flat = stored(found.select("capture_id", page.alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.kind").alias("record_type"), F.col("response.refers_to").alias("target")), "captures")
    origin = flat.filter("record_type = 'response'").select(F.col("capture_id").alias("target"), F.col("page_id").alias("refers_to"))
    return flat.join(origin, "target", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = table(spark, sf_dir, "pages"), shared_path(spark, "warc")
    write_archives(pages, path)
    records = stored(read_records(spark, path, with_payload=False), "warc-records")
    removed(spark, path)
    return page_rows(captures(records), pages.schema["page_id"].dataType)
