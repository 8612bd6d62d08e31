"""WARC archives: writing captures as transactions, reading records, assembling transactions.

Writing: each page becomes a request, a response (or revisit) and a metadata record, the latter two tied to the first
concerned by WARC-Concurrent-To. Which of the rows with equal payloads is the response comes from a partially aggregated
groupBy on the digest, joined back (a skewed digest is split by the skew-join rule), and is settled before anything is
written: the archive holds one response a payload, and every record has an identifier of its own. Archives are written by
Spark's text writer with the record separator of the format between records, so any store that Spark reaches will do. A
file is bounded by bytes: pages are written in classes of size, each with a number of captures a file to match.

Reading: binaryFile rows go through a streaming parser; a record's payload may be left out. Assembly joins the request and
metadata records to their response by the concurrent-to identifier, and gives one nested row a capture.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordmill.llm.common import discard, fresh_path, ship, stash, table, written

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
LEAST_BYTES = 100
#: Bytes of payload in an archive file, unless one page is larger, and captures in it.
FILE_BYTES, FILE_CAPTURES = 256 << 20, 2000

RECORDS = (
    "file string, at long, type string, record_id string, concurrent_to string, target_uri string, date string, content_type string, "
    "http_head string, payload_bytes long, payload_digest string, payload binary, fields map<string,string>"
)


def _urn(text: Column) -> Column:
    """A record identifier that depends on the text alone."""
    h = F.md5(text)
    cut = [F.substring(h, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _target(url: Column) -> Column:
    """The url with each blank and control character percent-encoded, so that it stays within its header line."""
    plain = url
    for code in (*range(33), 127):
        plain = F.replace(plain, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike("[\\x00-\\x20\\x7F]"), plain).otherwise(url)


def _record(headers: list[Column], block: Column) -> Column:
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *headers, length), F.lit(END), block)


def _header(name: str, value: Column) -> Column:
    """A header line, null (and so left out) where the value is null."""
    return F.concat(F.lit(f"{name}: "), value)


def _base(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    return pages.select(F.col(id_col).alias("id"), _target(F.col(url_col).cast("string")).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("n"))


def _told(base: DataFrame, least_bytes: int) -> tuple[DataFrame, str]:
    """The rows with ``revisit`` and, for revisits, ``first_id``; and the path of the narrow table that settles it.

    Rows of a payload are ordered by id, null last, then url. Rows equal in all of these cannot be told apart: where they
    are the first, one is the response and the others are revisits of it. Such rows are counted a partition of the input
    at a time and made anew from the counts, so that a row repeated very often is no task's burden.
    """
    spark = base.sparkSession
    order = F.struct(F.col("id").isNull().alias("id_null"), "id", F.col("url").isNull().alias("url_null"), "url")
    same = base.where(F.col("n") >= least_bytes).groupBy("digest", "id", "url").agg(F.count(F.lit(1)).alias("m"))
    firsts = same.groupBy("digest").agg(F.min(F.struct(order.alias("o"), "m")).alias("f"), F.sum("m").alias("copies")).where("copies > 1")
    firsts, path = written(firsts.select("digest", F.col("f.o.id").alias("first_id"), F.col("f.o.url").alias("first_url"), F.col("f.m").alias("alike"), F.lit(True).alias("several")), "payloads")
    joined = base.withColumn("part", F.spark_partition_id()).join(firsts, "digest", "left")
    first = F.col("id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    alike = F.coalesce(F.col("several") & first & (F.col("alike") > 1), F.lit(False))
    told = joined.where(~alike).select(*base.columns, F.coalesce(F.col("several") & ~first, F.lit(False)).alias("revisit"), "first_id")
    if firsts.where("alike > 1").isEmpty():
        return told, path
    rows = joined.where(alike)
    keys = ["digest", "id", "url", "n"]
    response = rows.groupBy(*keys).agg(F.first("html").alias("html")).select(*base.columns, F.lit(False).alias("revisit"), F.col("id").alias("first_id"))
    counts = rows.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("m"))
    counts = counts.withColumn("m", F.col("m") - (F.row_number().over(Window.partitionBy(*keys).orderBy("part")) == 1).cast("long")).where("m > 0")
    again = counts.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), "m"))).withColumn("html", F.lit(None).cast("string"))
    return told.unionByName(response).unionByName(again.select(*base.columns, F.lit(True).alias("revisit"), F.col("id").alias("first_id"))), path


def _classes(base: DataFrame, small: int) -> list[tuple[int, int]]:
    """Bounds (above, up to) of payload sizes, each class 16 times the last: as many as the largest page needs, one at least."""
    top = base.agg(F.max("n")).first()[0] or 0
    edges = [-1, small]
    while edges[-1] < top:
        edges.append(edges[-1] * 16)
    return list(zip(edges, edges[1:]))


def archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES, file_bytes: int = FILE_BYTES, file_captures: int = FILE_CAPTURES
) -> None:
    """Write a transaction for every row of ``pages``.

    Null html is an empty payload; a null url gives no target header, and control characters and blanks of a url are
    percent-encoded. Of rows with equal payloads of at least ``least_bytes`` bytes that with the smallest id is the
    response, a null id counting as larger than any and, of equal ids, the smaller url coming first; all others, repeated
    rows of the response's own page too, are revisits that name it. An empty table gives no records.
    """
    base = _base(pages, id_col, url_col, html_col)
    told, settled = _told(base, least_bytes)
    own = _urn(F.concat(F.lit("payload "), "digest"))  # of a payload's one response, so that revisits can name it
    single = (F.col("n") >= least_bytes) & ~F.col("revisit")
    told = told.withColumn("key", F.uuid()).withColumn("main", F.when(single, own).otherwise(F.concat(F.lit("<urn:uuid:"), "key", F.lit(">"))))
    main, asked, about = F.col("main"), _urn(F.concat(F.lit("request "), "key")), _urn(F.concat(F.lit("metadata "), "key"))
    target, date = _header("WARC-Target-URI", F.col("url")), F.lit(f"WARC-Date: {DATE}")
    host = F.coalesce(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]*)", 1), F.lit(""))
    place = F.coalesce(F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]*([^#]*)", 1), F.lit(""))
    request = F.concat(F.lit("GET "), F.when(place.startswith("/"), place).otherwise(F.concat(F.lit("/"), place)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    facts = F.concat_ws("\r\n", _header("page-id", F.col("id").cast("string")), F.when(F.col("revisit"), _header("refers-to-page", F.col("first_id").cast("string"))), F.lit("software: recordmill"))
    kind = F.when(F.col("revisit"), "revisit").otherwise("response")
    records = [
        _record([F.lit("WARC-Type: request"), _header("WARC-Record-ID", asked), _header("WARC-Concurrent-To", main), date, target, F.lit("Content-Type: application/http;msgtype=request")], request),
        _record(
            [
                _header("WARC-Type", kind), _header("WARC-Record-ID", main), date, target, _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
                F.when(F.col("revisit"), F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), own)), F.lit("Content-Type: application/http;msgtype=response"),
            ],
            F.when(F.col("revisit"), head).otherwise(F.concat(head, F.col("html"))),
        ),
        _record([F.lit("WARC-Type: metadata"), _header("WARC-Record-ID", about), _header("WARC-Concurrent-To", main), date, target, F.lit("Content-Type: application/warc-fields")], facts),
    ]
    lines = told.select("n", F.concat_ws(END, *records).alias("value"))
    for i, (over, most) in enumerate(_classes(base, max(1, file_bytes // file_captures))):
        some = lines.where((F.col("n") > over) & (F.col("n") <= most)).select("value")
        some.write.mode("append").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(1, file_captures >> (4 * i))).text(path)
    discard(pages.sparkSession, settled)


def parse(stream: io.BufferedIOBase, with_payload: bool = True) -> Iterator[dict]:
    """The records of one archive, in order. Bytes between records that start none are passed over."""
    at = 0
    while line := stream.readline():
        if not line.startswith(b"WARC/1."):
            continue
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = headers.get("content-length", "")
        block = stream.read(int(length) if length.isdigit() else 0)
        kind = headers.get("warc-type")
        row = {"at": at, "type": kind, "record_id": headers.get("warc-record-id"), "concurrent_to": headers.get("warc-concurrent-to")}
        row |= {"target_uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"), "content_type": headers.get("content-type"), "fields": None}
        head, payload = (block.partition(b"\r\n\r\n")[::2]) if (row["content_type"] or "").startswith("application/http") else (b"", block)
        row["http_head"] = head.decode("utf-8", "replace")
        if kind == "revisit":  # the payload is elsewhere: its size and digest are what the headers say
            said = [v for k, _, v in (x.partition(":") for x in row["http_head"].split("\r\n")) if k.strip().lower() == "content-length"]
            row["payload_bytes"] = int(said[0]) if said and said[0].strip().isdigit() else None
            row["payload_digest"] = headers.get("warc-payload-digest", "").removeprefix("sha256:") or None
            row["payload"] = None
        else:
            row["payload_bytes"], row["payload_digest"] = len(payload), hashlib.sha256(payload).hexdigest()
            row["payload"] = payload if with_payload else None
        if row["content_type"] == "application/warc-fields":
            pairs = (x.partition(":") for x in payload.decode("utf-8", "replace").splitlines() if ":" in x)
            row["fields"] = [(k.strip(), v.strip()) for k, _, v in pairs]
        yield row
        at += 1


_ARROW = pa.schema(
    [("file", pa.string()), ("at", pa.int64()), *[(n, pa.string()) for n in ("type", "record_id", "concurrent_to", "target_uri", "date", "content_type", "http_head")]]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string()))]
)


def read_archives(spark, path: str, with_payload: bool = True) -> DataFrame:
    """One row a record of all archives under ``path``, gzip or plain. An empty folder gives no rows."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                name, raw = b.column(0)[i].as_py(), pa.BufferReader(b.column(1)[i].as_buffer())
                packed = b.column(1)[i].as_buffer()[:2].to_pybytes() == b"\x1f\x8b"
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if packed else raw, 1 << 20)
                rows: list[dict] = []
                held = 0
                for row in parse(stream, with_payload):
                    rows.append(row | {"file": name})
                    held += len(row["payload"] or b"") + 500
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row a capture: (capture_id, request, response, metadata), each a struct of the record's columns.

    The response or revisit record is the capture; requests and metadata are those concurrent to it. Records written
    several times under one identifier are paired in the order of the archive; a request or metadata record whose
    response is missing gives a row without response.
    """
    key = F.when(F.col("type").isin("response", "revisit", "resource"), F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    role = F.when(F.col("type").isin("request", "metadata"), F.col("type")).otherwise(F.lit("response"))
    rows = records.where(F.col("type").isin("request", "response", "revisit", "resource", "metadata")).withColumn("capture_id", key).withColumn("role", role)
    order = Window.partitionBy("capture_id", "role").orderBy("file", "at")
    numbered = rows.withColumn("turn", F.row_number().over(order))
    body = F.struct(*[F.col(c) for c in records.columns])
    one = lambda name: numbered.where(F.col("role") == name).select("capture_id", "turn", body.alias(name))
    return one("response").join(one("request"), ["capture_id", "turn"], "full").join(one("metadata"), ["capture_id", "turn"], "full")


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = fresh_path(spark, "warc")
    archive(pages, path)
    found = captures(stash(read_archives(spark, path, with_payload=False), "records"))
    kind = pages.schema["page_id"].dataType.simpleString()
    page, target = (F.col("metadata.fields")[name].cast(kind) for name in ("page-id", "refers-to-page"))
    response = F.col("response")
    return found.select(
        page.alias("page_id"), response["payload_bytes"].alias("payload_bytes"), response["payload_digest"].alias("payload_digest"), response["type"].alias("record_type"),
        F.when(response["type"] == "revisit", target).alias("refers_to"),
    )


ORACLE = """
with p as (select page_id, strlen(coalesce(html, '')) n, sha256(coalesce(html, '')) d, row_number() over (partition by coalesce(html, '') order by page_id nulls last) k,
 min(page_id) over (partition by coalesce(html, '')) first_id from pages)
select page_id, n payload_bytes, d payload_digest, case when n >= 100 and k > 1 then 'revisit' else 'response' end record_type,
 case when n >= 100 and k > 1 then first_id end refers_to from p
"""
