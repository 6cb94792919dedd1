"""Archives of web pages: legacy ARC batches converted to WARC files in the shared folder, and read back.

A WARC file is a warcinfo record and then records up to FILE_BYTES, each a gzip
member of its own, as the usual readers expect. A file is made in one task, from
whole ARC archives of ARC_BYTES at most (or one page), and is written by Spark.
"""

from __future__ import annotations

import gzip
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arc import ArcRecord, payload_of, read_arc, read_warc, record_id, sha1, to_warc, warcinfo, write_arc
from .common import new_path, stored

#: Payloads of so many bytes and more are stored once. Bytes of records before gzip that a WARC file, and that an ARC batch, holds at most, or one record. Every page's timestamp.
LEAST, FILE_BYTES, ARC_BYTES, CAPTURED = 0, 32 << 20, 4 << 20, "19990101000000"
#: What Spark's text writer ends a file with; gzip readers skip zeros at the end.
PADDING = "\0"


def _http(html: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode() + html


def _converted(rows: list[tuple], n: int) -> list[bytes]:
    """page_id, url, html, first, salt -> a WARC record each, by way of an ARC archive; versions take turns."""
    legacy = [ArcRecord(url or "-", "0.0.0.0", CAPTURED, "text/html", _http(html), {}) for _, url, html, _, _ in rows]
    out = []
    for r, (i, _, _, first, salt) in zip(read_arc(write_arc(f"pages-{n}.arc", legacy, 1 + n % 2)), rows, strict=True):
        again = first is not None and first != i
        digest = sha1(payload_of(r.content)[1])
        extra = ({} if i is None else {"X-Page-Id": str(i)}) | ({"X-Refers-To-Page-Id": str(first)} if again else {})
        out.append(to_warc(r, refers_to=record_id("page", "", digest, str(first)) if again else None, extra=extra, identifier=record_id("page", "", digest, f"{i}{salt}")))
    return out


def _files(batches):
    """page_id, url, html, first, salt -> whole gzipped WARC files, one a row."""
    n = size = pending = 0
    rows: list[tuple] = []
    members: list[bytes] = []

    def convert():
        nonlocal n, size, pending
        if rows:
            records = _converted(rows, n)
            if not members:
                members.append(gzip.compress(warcinfo(records[0]) + b"\r\n\r\n", 5, mtime=0))
            members.extend(gzip.compress(r + b"\r\n\r\n", 5, mtime=0) for r in records)
            size += sum(map(len, records))
            n, pending = n + 1, 0
            rows.clear()

    def file():
        nonlocal size
        out = pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["value"])
        members.clear()
        size = 0
        return out

    for b in batches:
        for k in range(b.num_rows):
            row = tuple(c[k].as_py() for c in b.columns)
            if rows and pending + len(row[2]) > ARC_BYTES:
                convert()
            if members and size + pending + len(row[2]) > FILE_BYTES:
                convert()
                yield file()
            rows.append(row)
            pending += len(row[2]) + 600  # and its head lines, about
    convert()
    if members:
        yield file()


def _salted(pages: DataFrame, seen: DataFrame) -> DataFrame:
    """``pages`` with ``salt``: empty, but for all but one of the rows that share page_id and payload; so that record ids are unique."""
    twice = stored(seen.groupBy("page_id", "sha1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("page_id").alias("__id"), F.col("sha1").alias("__sha1")), "repeated-pages")
    single = pages.withColumn("salt", F.lit(""))
    if twice.isEmpty():
        return single
    same = F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("sha1") == F.col("__sha1"))
    # Written down, as its numbers must not change; ranked by where the rows came from too, so that no row's repeats are all in one task.
    again = stored(pages.join(twice, same, "left_semi").withColumn("from", F.spark_partition_id()), "repeats")
    first = again.groupBy("page_id", "sha1").agg(F.min("from").alias("__from")).select(F.col("page_id").alias("__id"), F.col("sha1").alias("__sha1"), "__from")
    nth = F.row_number().over(Window.partitionBy("page_id", "sha1", "from").orderBy("url"))
    ranked = again.withColumn("nth", nth).join(first, same)
    salt = F.when((F.col("from") == F.col("__from")) & (F.col("nth") == 1), "").otherwise(F.concat_ws(" ", F.lit(""), F.col("from"), F.col("nth")))
    return single.join(twice, same, "left_anti").unionByName(ranked.withColumn("salt", salt).select(single.columns))


def write(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """A WARC record for each row of ``pages(page_id, url, html)``, in ``.warc.gz`` files under ``path``.

    Of rows with equal payloads of ``least`` bytes or more, those with the
    smallest page_id are responses and the others revisit it; smaller payloads
    are all responses. A null html is an empty payload, a null url is ``-``, and
    a null page_id never is the smallest: among others it revisits. A row that
    repeats another one is a record with an id of its own. A very large page
    is a file of its own.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("sha1"))
    seen = stored(pages.select("page_id", "sha1", F.octet_length("html").alias("n")), "payloads")
    firsts = seen.where(F.col("n") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    told = _salted(pages, seen).join(firsts.select("sha1", "first"), "sha1", "left").select("page_id", "url", "html", "first", "salt")
    files = told.mapInArrow(_files, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("lineSep", PADDING).option("compression", "none").option("maxRecordsPerFile", 1).text(path)
    _name(spark, path)


def _name(spark, path: str) -> None:
    """Give Spark's part files the name that WARC readers look for; only names move."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if name.startswith("part-") and status.getLen():
            fs.rename(status.getPath(), at.suffix(f"/{name.removesuffix('.txt')}.warc.gz"))


def _members(data: memoryview, step: int = 1 << 16):
    """The gzip members of a file, unpacked; read in steps, as what lies behind a member is copied with it."""
    at = 0
    while at < len(data):
        if not data[at]:
            at += 1
            continue
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(data):
                raise ValueError("a member has no end")
            part = data[at : at + step]
            out.append(z.decompress(part))
            at += len(part)
        at -= len(z.unused_data)
        yield b"".join(out)


def _records(batches):
    for b in batches:
        for data in b.column(0):
            rows = []
            for fields, block in (r for m in _members(memoryview(data.as_buffer())) for r in read_warc(m)):
                if fields["warc-type"] not in ("response", "revisit"):
                    continue
                head, payload = payload_of(block)
                http = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n"))}
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if fields["warc-type"] == "response" and sha1(payload) != digest:
                    raise ValueError(f"payload digest of {fields['warc-record-id']} is wrong")
                page, first = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                rows.append((page and int(page), int(http["content-length"]), digest, fields["warc-type"], first and int(first), fields["warc-record-id"]))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"])


def read(spark, path: str) -> DataFrame:
    """The response and revisit records under ``path``: ``page_id, payload_bytes, payload_digest, record_type, refers_to, record_id``; digests are checked."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content")
    return files.mapInArrow(_records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string")


def archived(pages: DataFrame) -> DataFrame:
    """``pages`` written as WARC and read back; see ``write`` and ``read``. An empty table gives no rows; other columns are ignored."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)


#: DuckDB has no base 32, so it is spelt out: 160 bits in groups of five.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
bits AS (
  SELECT DISTINCT s, list_reduce(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', CAST((instr('0123456789abcdef', substr(s, CAST(i AS BIGINT), 1)) - 1) * 4 + 1 AS BIGINT), 4)), lambda a, b: a || b) AS b FROM p
), digests AS (
  SELECT s, list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
    16 * CAST(substr(b, CAST(i * 5 + 1 AS BIGINT), 1) AS INT) + 8 * CAST(substr(b, CAST(i * 5 + 2 AS BIGINT), 1) AS INT) + 4 * CAST(substr(b, CAST(i * 5 + 3 AS BIGINT), 1) AS INT)
    + 2 * CAST(substr(b, CAST(i * 5 + 4 AS BIGINT), 1) AS INT) + CAST(substr(b, CAST(i * 5 + 5 AS BIGINT), 1) AS INT) + 1 AS BIGINT), 1)), lambda a, b: a || b) AS d FROM bits
), firsts AS (SELECT s, min(page_id) AS first FROM p GROUP BY s)
SELECT p.page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN p.page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN p.page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN digests USING (s) JOIN firsts USING (s)
"""
