"""WARC archives with revisit records in place of repeated payloads.

Only heads (id, length, SHA-256 of the payload) are shuffled by digest to find repeated payloads. The
earliest record of a payload is the response; the verdicts on the others go back to their rows by id
and digest together, and those rows become revisit records that carry no payload. Each record is a
gzip member of its own with fresh headers; a response holds the HTTP head and the payload. Members
are written in bundles of a bounded size by Spark's own text writer, so lost tasks are written again
whole and half-written files never show. Every member ends with a zero byte (the top byte of its
size, kept below 16 MiB by starting a further member), and that byte is the writer's line separator.

Reading parses each file record by record and resolves revisits: the heads of revisit records are
joined to those of responses by payload digest.

Defined cases: null html is an empty payload; payloads under min_bytes are always responses; rows
that share both payload and smallest id are all responses; a null id counts as larger than any
other, and if all ids of a payload are null all are responses; rows that repeat an id get record ids
of their own; null URLs are left out of the header and white space or line ends in a URL are
percent-encoded; very long payloads are one record of several members; an empty table gives no
records.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, written

EOL = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}"
READ = "record_type string, record_id string, refers_to_record string, digest string, page_id long, url string, payload string"
#: Bytes before compression of a gzip member, under 16 MiB; bytes of a bundle of members; bundles in a file.
MEMBER, BUNDLE, BUNDLES = 15 << 20, 4 << 20, 8


def record_id(page_id: Column, digest: Column, number: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), digest, number.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def with_revisits(pages: DataFrame, *, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """page_id, url, payload, digest, number (0 unless rows repeat id and payload), first_id (null for
    responses, else the response's id) and named: has the response the number 0."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    heads = rows.groupBy("page_id", "digest").agg(F.count("*").alias("n"), F.first(F.octet_length("payload")).alias("size"))
    firsts = heads.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.sum("n").alias("of_digest"), F.min(F.struct(F.col("page_id").isNull(), "page_id", "n")).alias("first"))
    firsts = firsts.filter("of_digest > 1").select("digest", "first_id", (F.col("first.n") == 1).alias("named"))
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id"))
    verdicts = heads.join(firsts, "digest", "left").select("page_id", "digest", F.when(later, F.col("first_id")).alias("first_id"), "named", (F.col("n") > 1).alias("repeated"))
    verdicts = verdicts.filter("first_id is not null or repeated").select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "first_id", "named", "repeated")
    joined = rows.join(verdicts, (F.col("digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_page")), "left")
    number = F.when(F.col("repeated"), F.monotonically_increasing_id() + 1).otherwise(F.lit(0))
    return joined.select("page_id", "url", "payload", "digest", number.alias("number"), "first_id", F.coalesce("named", F.lit(True)).alias("named"))


def head(date: str) -> Column:
    """The header fields of one record but its length, which follows."""
    revisit, field = F.col("first_id").isNotNull(), lambda name, c: F.concat(F.lit(f"{EOL}{name}: "), c)
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("url", " ", "%20"), "\t", "%09"), "\r", "%0D"), "\n", "%0A")
    refers = F.when(F.col("named"), field("WARC-Refers-To", record_id(F.col("first_id"), F.col("digest"), F.lit(0)))).otherwise("")
    return F.concat(
        F.lit("WARC/1.1"),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"), F.col("number"))),
        field("WARC-Date", F.lit(date)),
        F.coalesce(field("WARC-Target-URI", url), F.lit("")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.coalesce(field("X-Page-Id", F.col("page_id").cast("string")), F.lit("")),
        F.when(revisit, F.concat(field("WARC-Profile", F.lit(PROFILE)), refers)).otherwise(""),
        field("Content-Type", F.lit("application/http; msgtype=response")),
    )


def members(record: bytes) -> bytes:
    """record as a gzip member, or several if it is long; the last byte is zero."""
    out = []
    for k in range(0, len(record), MEMBER):
        press = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += [press.compress(record[k : k + MEMBER]), press.flush()]
    return b"".join(out)


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    one = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["bundle"])
    for batch in batches:
        for top, body, revisit in zip(batch.column("head"), batch.column("body"), batch.column("revisit").to_pylist()):
            payload = body.as_buffer()
            block = f"{HTTP}Content-Length: {len(payload)}{EOL * 2}".encode() if not revisit else HTTP.encode() + EOL.encode()
            held.append(members(b"".join((top.as_buffer(), f"{EOL}Content-Length: {len(block) + len(payload)}{EOL * 2}".encode(), block, payload, EOL.encode() * 2))))
            size += len(held[-1])
            if size >= BUNDLE:
                yield one()
                held, size = [], 0
    if held:
        yield one()


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 100, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write a record for each row of pages to files under path, each a row of gzip members. date goes into the headers.

    A file holds BUNDLES bundles of BUNDLE bytes, and what the last record of each goes beyond that.
    """
    rows = with_revisits(pages, id_col=id_col, url_col=url_col, html_col=html_col, min_bytes=min_bytes)
    revisit = F.col("first_id").isNotNull()
    slim = rows.select(head(date).alias("head"), F.when(revisit, F.lit("")).otherwise(F.col("payload")).alias("body"), revisit.alias("revisit"))
    bundles = slim.mapInArrow(_bundled, "bundle binary").select(F.col("bundle").cast("string").alias("value"))
    bundles.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", BUNDLES).text(path)


def records(file: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content of each record, one at a time."""
    while version := file.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        fields: dict[str, str] = {}
        while (line := file.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(": ")
            fields[name] = value
        content = file.read(int(fields["Content-Length"]))
        file.read(4)
        yield fields, content


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n.split()[0], pa.int64() if n.endswith("long") else pa.string()) for n in READ.split(", ")])
    for batch in batches:
        for content in batch.column("content"):
            rows, held = [], 0
            for fields, block in records(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                page, body = fields.get("X-Page-Id"), block.partition(b"\r\n\r\n")[2]
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                rows.append((fields["WARC-Type"], fields["WARC-Record-ID"], fields.get("WARC-Refers-To"), digest, page and int(page), fields.get("WARC-Target-URI"), body.decode()))
                held += len(body)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record under path; revisits have an empty payload."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parsed, READ)


def resolved(read: DataFrame) -> DataFrame:
    """Length and digest of each record's full payload; those of a revisit come from the response with its digest.

    Lengths and digests of responses are taken from the payloads read, not from their headers.
    """
    payload = F.col("payload").cast("binary")
    slim = read.select("record_type", "digest", "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    slim = written(slim, "warc-headers")
    responses = slim.filter("record_type = 'response'")
    originals = responses.groupBy(F.col("payload_digest").alias("digest")).agg(F.min("page_id").alias("refers_to"), F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    revisits = slim.filter("record_type = 'revisit'").select("page_id", "record_type", "digest").join(originals, "digest", "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(names).unionByName(revisits.select(names))


def query(spark, sf_dir: str) -> DataFrame:
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path := new_path(spark, "warc"))
    return resolved(read_archives(spark, path))


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM h)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND f IS NOT NULL AND (page_id IS NULL OR page_id > f) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND f IS NOT NULL AND (page_id IS NULL OR page_id > f) THEN f END AS refers_to
FROM m
"""
