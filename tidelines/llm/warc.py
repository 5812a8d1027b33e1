"""WARC archives: writing through Spark's text writer, reading with boundary-chain verification.

Every record is one line of the text writer, whose line separator is the record separator (two line breaks), so archives can
be written to any store that Spark writes to, plain or gzipped. A response's block is an HTTP response with the payload as its
body; a revisit's is the HTTP head alone. The task that reads a file finds a candidate at every occurrence of the record magic,
with the offset of the record that its Content-Length says comes next. Payloads may hold the magic too; pointer jumping from the
start of the file then keeps only the candidates that the chain reaches, and only their payloads are cut out and hashed. A chain
that doesn't end at the file's end is an error that names the file and the offset.

Defined results: a null payload is an empty one; payloads of any length are kept whole; of equal payloads of at least
`least_bytes` bytes those with the smallest id are responses and the others revisits (rows that repeat the smallest id are all
responses; null ids never are the smallest unless all are null); an empty table gives an empty archive and result. Extra input
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize

MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
END = "\r\n\r\n"
#: Fixed value: the profile of revisits with an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Archives hold about this many bytes, by the mean size of a record, so that a reader's task can hold one.
ARCHIVE_BYTES = 16 << 20

RECORD_SCHEMA = "path string, start long, next long, size long, record_id string, record_type string, uri string, digest string, refers_to string, payload_bytes long, payload_digest string"


def records(pages: DataFrame, least_bytes: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """id, record: a WARC record by page, repeated payloads as revisits.

    The smallest id by digest comes from an aggregation that combines before it shuffles. Only digests that occur twice enter the
    join, as a written table of known size: a small one is broadcast, so that payloads aren't shuffled; for a large one Spark
    shuffles and splits where one digest is hot.
    """
    payload = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), payload.alias("payload"), F.sha2(F.encode(payload, "UTF-8"), 256).alias("digest"), F.octet_length(payload).cast("bigint").alias("size"))
    first = rows.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    first = materialize(first, "repeated")
    joined = rows.join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    uri = F.regexp_replace("url", r"[\r\n]", " ")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    head = [
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), page, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("first"), F.lit(f">\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))).cast("string"), F.lit(END),
        http, F.when(revisit, "").otherwise(F.col("payload")),
    ]
    return joined.select("page_id", F.concat(*head).alias("record"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 100, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z", gzip: bool = False) -> None:
    """Write pages (page_id, url, html) as .warc or .warc.gz files of about archive_bytes."""
    found = records(pages, least_bytes, date)
    mean = (pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0) + 500
    writer = found.select("record").write.option("lineSep", END).option("maxRecordsPerFile", max(1, int(archive_bytes / mean)))
    (writer.option("compression", "gzip") if gzip else writer).text(path)
    # Spark's text files get their proper names
    spark = pages.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for status in store.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("part-"):
            store.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, name.replace(".txt", ".warc")))


def unpacked(name: str, data: bytes) -> bytes:
    """An archive's bytes; gzipped ones may have a member by record."""
    import gzip

    return gzip.decompress(data) if name.endswith(".gz") else data


def head_of(data: bytes, start: int, body: int) -> dict[str, str]:
    """The fields of a head, by lower-case name; its last four bytes are the blank line."""
    fields = {}
    for line in data[start : body - 4].split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        fields[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
    return fields


def candidates(data: bytes) -> Iterator[tuple[int, int, int]]:
    """Every place that looks like a record: its start, its block's start and the start of the next record.

    A head ends at its blank line; where the magic comes again before that, the head holds a line that is no field.
    """
    places = [m.start() for m in MAGIC.finditer(data)]
    for at, following in zip(places, [*places[1:], len(data)], strict=True):
        stop = data.find(b"\r\n\r\n", at, max(following, at + 14))
        if stop >= 0 and (size := head_of(data, at, stop + 4).get("content-length", "")).isdecimal() and size.isascii():
            yield at, stop + 4, stop + 4 + int(size) + 4


def reachable(start: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Pointer jumping: True for the candidates that the chain from offset 0 reaches. Offsets are sorted."""
    n = len(start)
    reached = np.zeros(n + 1, bool)
    if not n or start[0] != 0:
        return reached[:n]
    place = np.searchsorted(start, following)
    jump = np.append(np.where((place < n) & (start[np.minimum(place, n - 1)] == following), place, n), n)  # n: no such record
    reached[0] = True
    for _ in range(max(1, n).bit_length()):
        reached[jump[np.flatnonzero(reached)]] = True
        jump = jump[jump]
    return reached[:n]


def files_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(path).select("path", "content")


def chained(name: str, data: bytes, strict: bool = True) -> list[tuple[int, int, int]]:
    """The candidates on the chain from the start of an archive.

    A chain that breaks before the file's end is an error, or with strict=False loses the records after the break.
    """
    found = [*candidates(data), (len(data), 0, -1)]  # the file's end comes last
    start, _, following = np.array(found, np.int64).T
    on = reachable(start, following)
    if strict and not on[-1]:
        raise ValueError(f"{name}: no record and no end at offset {following[on][-1] if on.any() else 0}")
    return [found[i] for i in np.flatnonzero(on & (following >= 0))]


def cut_records(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """path, head, start, next, payload of the verified records of the archives under path.

    A task that holds a file verifies its chain and cuts its records, so that no file's bytes are shuffled.
    """

    def cut(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, rows, held = unpacked(name, content.as_py()), [], 0
                for at, body, after in chained(name, data, strict):
                    block = data[body : after - 4]
                    http = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -4
                    payload = block[http + 4 :] if http != -1 else b""
                    rows.append((name, data[at:body], at, after, payload))
                    held += len(block)
                    if held > 4 << 20 or len(rows) >= 2000:
                        yield pack(rows)
                        rows, held = [], 0
                if rows:
                    yield pack(rows)

    def pack(rows):
        import pyarrow as pa

        kinds = (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "head", "start", "next", "payload"])

    return files_of(spark, path).mapInArrow(cut, "path string, head binary, start long, next long, payload binary")


def described(cut: DataFrame) -> DataFrame:
    """The records with the fields of their heads, and length and digest of their payloads."""

    def describe(batches):
        import hashlib

        import pyarrow as pa

        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        long = {"start", "next", "size", "payload_bytes"}
        bare = lambda x: x and x.removeprefix("<").removesuffix(">").removeprefix("urn:page:")
        for batch in batches:
            rows = []
            for path, head, start, after, payload in zip(*batch.columns, strict=True):
                f, body = head_of(head.as_py(), 0, len(head.as_py())), payload.as_py()
                digest = (f.get("warc-payload-digest") or "").removeprefix("sha256:")
                rows.append((path.as_py(), start.as_py(), after.as_py(), int(f["content-length"]), bare(f.get("warc-record-id")), f.get("warc-type"), f.get("warc-target-uri"), digest, bare(f.get("warc-refers-to")), len(body), hashlib.sha256(body).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if n in long else pa.string()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    return cut.mapInArrow(describe, RECORD_SCHEMA)


def read_archives(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Verified records of the archives under path; revisits get length and digest from the response they refer to."""
    kept = described(cut_records(spark, path, strict))
    answers = kept.where("record_type = 'response'").groupBy(F.col("record_id").alias("__tl_id"), F.col("payload_digest").alias("__tl_digest")).agg(F.max("payload_bytes").alias("__tl_bytes"))
    revisit = F.col("record_type") == "revisit"
    joined = kept.join(answers, revisit & (kept["refers_to"] == answers["__tl_id"]) & (kept["digest"] == answers["__tl_digest"]), "left")
    return joined.withColumns({"payload_bytes": F.when(revisit, F.col("__tl_bytes")).otherwise(F.col("payload_bytes")), "payload_digest": F.when(revisit, F.col("__tl_digest")).otherwise(F.col("payload_digest"))}).drop("__tl_id", "__tl_digest", "__tl_bytes")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """path, start and payload (binary) of every verified record."""
    return cut_records(spark, path).select("path", "start", "payload")
