"""WARC archives: writing, reading, and revisit resolution by payload digest.

Headers alone (id, url, digest, length) are written once and shuffled by
payload digest; the record with the largest page_id of a digest stays a
response and the others become revisit records that refer to it, made from
their headers under fresh headers of their own. Payloads are read for
responses only: they meet the chosen ids by digest and id together, so a
payload that a third of all pages share meets in no single task. Reading back
joins revisits to their responses.

An archive is a gzip file of records in sequence, RECORDS at most. Spark's own
writer and reader move them, so any file system that Spark knows will do;
archives are read as streams, whatever their size.

Defined results: a null payload counts as empty, and empty payloads as equal;
payloads of any length are whole; a null url is left out; equal page_ids of one
digest are all responses if theirs is the largest, so repeated rows stay equal;
a null page_id counts as smallest and is never referred to unless all of its
digest are null; payloads under min_bytes are all responses. No pages give no
records. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.store import dropped, shared_dir, written

RECORDS = 10_000
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_digests(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """page_id, url, payload (string, never null), payload_digest, payload_bytes."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    sha1 = F.sha1(F.col("payload").cast("binary"))
    # 160 bits are four times 40, and 40 bits eight digits to the base 32
    digits = F.concat(*[F.lpad(F.conv(F.substring(sha1, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)])
    return rows.select("*", F.translate(digits, DIGITS, BASE32).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))


def first_of(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """payload_digest and first_id, the page_id its other records refer to; the largest ids are combined before the shuffle."""
    return headers.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("first_id"))


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """headers(page_id, payload_digest, payload_bytes, ...) with record_type and refers_to; the join is one that Spark splits where skewed."""
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    joined = headers.join(first_of(headers, min_bytes), "payload_digest", "left")
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first_id"))).drop("first_id")


def write_deduplicated(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """pages as with_digests gives them, as archives: revisits from their headers, responses with their payloads."""
    headers = written(pages.drop("payload"), "warc-headers")
    revisits = resolve(headers, min_bytes).where("record_type = 'revisit'").withColumn("payload", F.lit(""))
    first = first_of(headers, min_bytes).select(F.col("payload_digest").alias("digest"), "first_id")
    chosen = pages.where(F.col("payload_bytes") >= min_bytes).join(first, (F.col("payload_digest") == F.col("digest")) & F.col("page_id").eqNullSafe(F.col("first_id")), "left_semi")
    if min_bytes > 0:
        chosen = chosen.unionByName(pages.where(F.col("payload_bytes") < min_bytes))
    responses = chosen.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")})
    write_archives(responses.unionByName(revisits), path)
    dropped(headers)


def _uri(page_id) -> "F.Column":
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write_archives(records: DataFrame, path: str) -> None:
    """records(page_id, url, payload, payload_digest, payload_bytes, record_type, refers_to) as gzipped WARC files.

    A record ends with CR LF CR LF; the text writer adds the last LF. The url
    is written percent-encoded where a header could not hold it.
    """
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise("")
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("url"), "%", "%25"), "\r", "%0D"), "\n", "%0A")
    text = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _uri(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _uri(F.col("refers_to")))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
        F.lit(""),
        F.concat(body, F.lit("\r\n\r")),
    )
    records.select(text.alias("value")).write.option("maxRecordsPerFile", RECORDS).option("compression", "gzip").option("lineSep", "\n").text(path)


_END = re.compile(rb"\r\n\r\n")


def parse(pieces):
    """(header dict, payload bytes) of each record of one archive, given as an iterator of bytes."""
    held = bytearray()
    for piece in pieces:
        held += piece
        at = 0
        while True:
            head = _END.search(held, at)
            if not head:
                break
            lines = bytes(held[at : head.start()]).decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            end = head.end() + int(fields["Content-Length"])
            if len(held) < end + 4:
                break
            if not lines[0].startswith("WARC/") or held[end : end + 4] != b"\r\n\r\n":
                raise ValueError(f"not a record: {lines[0][:40]!r}")
            yield fields, bytes(held[head.end() : end])
            at = end + 4
        del held[:at]
    if held:
        raise ValueError("the archive ends within a record")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archives below path: page_id, url, record_type, refers_to, payload_digest and payload_bytes as
    written, and body_digest and body_bytes (and body) as found."""
    id_of = re.compile(r"<urn:page:(-?\d+)>")

    def number(uri):
        found = id_of.fullmatch(uri or "")
        return int(found[1]) if found else None

    def run(batches):
        rows, size = [], 0
        for fields, body in parse(piece for batch in batches for piece in lines(batch.column(0))):
            url = fields.get("WARC-Target-URI")
            url = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
            rows.append((number(fields["WARC-Record-ID"]), url, fields["WARC-Type"], number(fields.get("WARC-Refers-To")), fields["WARC-Payload-Digest"][5:], digest(body), len(body), body.decode() if payloads else None))
            size += len(body)
            if size > 4 << 20 or len(rows) == RECORDS:
                yield batch_of(rows)
                rows, size = [], 0
        if rows:
            yield batch_of(rows)

    def lines(column):
        """A batch's lines as they stood in the archive, some at a time."""
        for at in range(0, len(column), 256):
            yield b"\n".join([*column[at : at + 256].to_pylist(), b""])

    def batch_of(rows):
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["page_id", "url", "record_type", "refers_to", "payload_digest", "body_digest", "body_bytes", "body"])

    # gzip files aren't split, so a task has the lines of whole archives in their order
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").option("lineSep", "\n").text(path).select(F.col("value").cast("binary"))
    return files.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_digest string, body_digest string, body_bytes long, body string")


def expand_revisits(records: DataFrame) -> DataFrame:
    """Records with payload_bytes and payload_digest of the full payload, taken from the response for revisits."""
    full = records.where("record_type = 'response'").groupBy(F.col("body_digest").alias("full_digest")).agg(F.max("body_bytes").alias("full_bytes"))
    joined = records.join(full, F.col("payload_digest") == F.col("full_digest"), "left")
    return joined.select("page_id", F.when(F.col("record_type") == "response", F.col("body_bytes")).otherwise(F.col("full_bytes")).alias("payload_bytes"), F.when(F.col("record_type") == "response", F.col("body_digest")).otherwise(F.col("full_digest")).alias("payload_digest"), "record_type", "refers_to", "url")


def dedup_archive(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes pages as a deduplicated archive and reads it back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = path or shared_dir(spark, "warc")
    write_deduplicated(with_digests(pages, id_col, url_col, payload_col), path, min_bytes)
    return expand_revisits(read_archives(spark, path, payloads=False)).drop("url")


def rededup_archive(spark: SparkSession, source: str, target: str, min_bytes: int = 0) -> None:
    """Existing archives, with their revisits resolved anew, written deduplicated with fresh headers."""
    records = read_archives(spark, source)
    texts = records.where("record_type = 'response'").groupBy(F.col("body_digest").alias("full_digest")).agg(F.max("body").alias("full"))
    whole = records.join(texts, F.col("payload_digest") == F.col("full_digest"), "left").select("page_id", "url", F.coalesce(F.when(F.col("record_type") == "response", F.col("body")), F.col("full"), F.lit("")).alias("payload"))
    write_deduplicated(with_digests(whole, "page_id", "url", "payload"), target, min_bytes)
