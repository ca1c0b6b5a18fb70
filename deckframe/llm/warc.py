"""WARC archives: writing, reading and revisit resolution by payload digest.

Headers alone, digest, size and id, are shuffled to find the payloads that occur
more than once; of these the record of the largest id stays a response and the
others become revisits without payload. Records are written with fresh headers by
Spark's own text writer, whose line end is the end of a WARC record, so the archives
go wherever Spark can write and a lost task leaves nothing behind. Records are written
by classes of size, so that an archive holds ``ARCHIVE_BYTES`` or one record, however
large pages follow each other; it is read as a whole by one task. Up to a million
repeated payloads only headers move; beyond that records meet their digest's entry by
shuffle, payloads and all, once. Revisits are joined to the responses they refer to
when the archives are read back.

Defined results: null html is an empty payload; payloads below ``MIN_BYTES`` are
never revisits; a null id is smaller than any other and has no header, and where all
ids of a payload are null each record is a response; rows of one id and payload are
one record written as often as given; control characters in a URL are
percent-encoded, a null URL has no header; other columns play no part, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deckframe.plans import sized, stored, work_dir

MIN_BYTES = 1000
ARCHIVE_BYTES = 24 << 20
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id: Column, digest: Column) -> Column:
    m = F.md5(F.concat_ws(" ", page_id.cast("string"), digest))
    parts = [F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _uri(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A"), "[\\x00-\\x1F\\x7F]", "%00")


def resolved(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html (never null), digest, size and refers_to, the id of the response that a revisit repeats."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    heads = rows.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("last"))
    repeated = stored(heads.where((F.col("n") > 1) & F.col("last").isNotNull()).select("digest", "last"), "repeated-payloads")
    joined = rows.join(sized(repeated), "digest", "left")
    refers = F.when((F.col("size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return joined.select("page_id", "url", "html", "digest", "size", refers.alias("refers_to"))


def _record(date: str) -> Column:
    """A whole record without its end."""
    header = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit, url = F.col("refers_to").isNotNull(), _uri(F.col("url"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    maybe = lambda c: F.coalesce(c, F.lit(""))  # noqa: E731  a header of a null value is left out
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        header("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        header("WARC-Date", F.lit(date)),
        maybe(header("WARC-Target-URI", url)),
        maybe(header("X-Page-ID", F.col("page_id").cast("string"))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(header("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("digest"))), header("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        F.lit("Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
        block,
    )


def write_archives(pages: DataFrame, folder: str, date: str = DATE) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html)."""
    records = resolved(pages).select(_record(date).alias("value"), _size_class().alias("class"))
    classes = sorted(r["class"] for r in pages.select(_size_class().alias("class")).distinct().collect())  # a dozen at most
    for c in classes:
        each = max(1, ARCHIVE_BYTES // _upto(c))
        records.where(F.col("class") == c).select("value").write.option("lineSep", END).option("maxRecordsPerFile", each).text(f"{folder}/class={c}")


#: Bytes of the smallest class of records, how much larger the next is, and what a record has beside payload and URL.
LEAST, STEP, HEADERS = 4096, 8, 1024


def _upto(size_class: int) -> int:
    return LEAST * STEP**size_class


def _size_class() -> Column:
    """The first class whose size holds a record of ``html`` and ``url``, control characters of a URL written out."""
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long") + 3 * F.coalesce(F.octet_length("url"), F.lit(0)).cast("long") + HEADERS
    return F.greatest(F.lit(0), F.ceil(F.log(float(STEP), size / float(LEAST)))).cast("int")


def _parse(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    at, view = 0, memoryview(data)
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        first, *fields = data[at:stop].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(f.split(": ", 1) for f in fields)
        start = stop + 4
        end = start + int(head["Content-Length"])
        yield head, view[start:end]
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        at = end + 4


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """record_id, record_type, page_id, url, digest, size (of the payload in the record), refers_to (a record id), and the payload if asked for.

    The digest of every payload read is compared with that of its header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "page_id", "url", "digest", "size", "refers_to", "payload"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for head, block in _parse(content.as_py()):
                    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    body = bytes(block)
                    payload = body[body.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
                    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{head['WARC-Record-ID']}: the payload is not that of the header")
                    page = head.get("X-Page-ID")
                    rows.append((head["WARC-Record-ID"], kind, int(page) if page else None, head.get("WARC-Target-URI"), digest, None if payload is None else len(payload), head.get("WARC-Refers-To"), payload if payloads else None))
                    held += len(payload or b"") * payloads
                    if len(rows) >= 5000 or held > ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    if not _exists(spark, folder):  # no record was written
        files = spark.createDataFrame([], "content binary")
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(folder).select("content")
    out = files.mapInArrow(run, "record_id string, record_type string, page_id long, url string, digest string, size long, refers_to string, payload binary")
    return out if payloads else out.drop("payload")


def with_originals(records: DataFrame) -> DataFrame:
    """``records`` as read, with original_page_id and original_size of the response that a revisit refers to."""
    responses = records.where("record_type = 'response'").groupBy("record_id").agg(F.first("page_id").alias("original_page_id"), F.first("size").alias("original_size"))
    responses = responses.withColumnRenamed("record_id", "refers_to")
    return records.join(responses, "refers_to", "left")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back and resolve the revisits: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = folder or f"{work_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    records = stored(read_archives(pages.sparkSession, folder), "warc-headers")
    found = with_originals(records)
    return found.select("page_id", F.coalesce("size", "original_size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("original_page_id").alias("refers_to"))
