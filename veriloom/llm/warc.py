"""WARC archives on any file system that Spark writes, and their revisit resolution."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.rows import named
from veriloom.session import bound_batches, checkpoint_dir, materialised, remove

#: Fixed values of the WARC 1.1 format.
VERSION, REVISIT_PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records of one archive file, which is read back as a whole, and bytes of their payloads, whichever are fewer; a longer
#: record is a file of its own. Records of very different sizes lie in different files, so a long one leaves the others' as they
#: are: payloads of up to FILE_BYTES / RECORDS_PER_FILE bytes together, then each STEP times longer.
RECORDS_PER_FILE, FILE_BYTES, STEP = 4000, 128 << 20, 8

#: Records whose verdicts (some 60 bytes each) are sent to all files at most; beyond, files and verdicts are joined by shuffle.
FEW_RECORDS = 1 << 20

_DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_SCHEMA = "file string, offset long, record_type string, record_id string, uri string, page_id long, payload_bytes long, payload_digest string, refers_to long, refers_to_id string, payload string"


def sha1_base32(text: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a text's UTF-8 bytes; ten hex digits make eight base32 digits."""
    hexed = F.sha1(text)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), _DIGITS32, BASE32)


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value. Line breaks inside a value become spaces."""
    clean = F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def _derived(record_id: Column) -> Column:
    """The id of the record that a deduplicated archive holds in place of another's, as a UUID."""
    h = F.md5(F.concat(F.lit("deduplicated|"), record_id))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def size_class(payload_bytes: Column) -> Column:
    """The number of the class of sizes that a payload belongs to."""
    bounds = [max(1, FILE_BYTES // RECORDS_PER_FILE)]
    while bounds[-1] < FILE_BYTES:
        bounds.append(bounds[-1] * STEP)
    return reduce(lambda a, b: a + b, [(payload_bytes > b).cast("int") for b in bounds])


def records_per_file(size: int) -> int:
    """Records of a class that a file may hold."""
    return max(1, RECORDS_PER_FILE // STEP**size)


def write_archive(records: DataFrame, path: str, per_file: int) -> str:
    """Writes (record_type, record_id, uri, page_id, payload_bytes, payload_digest, refers_to, refers_to_id, payload) as
    gzipped WARC files of at most `per_file` records. Spark's own writer commits them, so lost executors leave no half
    files; a record ends with the line separator. A block is an HTTP response, of a revisit without the payload."""
    revisit = F.col("record_type") == "revisit"
    payload = F.coalesce("payload", F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(payload))
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.octet_length(payload))
    urn = lambda c: F.concat(F.lit("<urn:uuid:"), c, F.lit(">"))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", urn(F.col("record_id"))),
        _line("WARC-Date", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _line("WARC-Target-URI", F.col("uri")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        _line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, urn(F.col("refers_to_id")))),
        _line("WARC-Refers-To-Page", F.when(revisit, F.col("refers_to"))),
        _line("X-Page-Id", F.col("page_id")),
        _line("X-Payload-Length", F.col("payload_bytes")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        size.cast("string"),
        F.lit("\r\n\r\n"),
    )
    rows = records.select(F.concat(head, block).alias("value"))
    rows.write.mode("append").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).text(path)
    return path


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records of an unpacked archive, found by their lengths alone."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        start, size = end + 4, int(headers["Content-Length"])
        yield at, headers, data[start : start + size]
        at = start + size + 4


def _records(path: str, data: bytes, payloads: bool) -> Iterator[tuple]:
    """The values of _SCHEMA of each record of an unpacked archive. The digest of a payload that is there is made anew and
    must be the one that its header states."""
    urn = lambda x: x.removeprefix("<urn:uuid:").removesuffix(">") if x is not None else None
    number = lambda x: int(x) if x is not None else None
    for offset, h, block in parse(data):
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
        if h["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {h['WARC-Record-ID']} does not match its digest")
        refers = number(h.get("WARC-Refers-To-Page")), urn(h.get("WARC-Refers-To"))
        yield path, offset, h["WARC-Type"], urn(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), number(h.get("X-Page-Id")), int(h["X-Payload-Length"]), digest, *refers, payload.decode() if payloads else None


def read_archive(files: DataFrame) -> DataFrame:
    """Records of archives (path, content: rows of Spark's binaryFile source), and, where they have `verdicts` (array of
    offset, new_type, new_refers_to, new_refers_to_id), with those and the payloads."""
    judged = "verdicts" in files.columns
    schema = _SCHEMA + (", new_type string, new_refers_to long, new_refers_to_id string" if judged else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = batch.column("verdicts").to_pylist() if judged else [None] * batch.num_rows
            for path, content, told in zip(batch.column("path").to_pylist(), batch.column("content"), verdicts, strict=True):
                by = {v["offset"]: (v["new_type"], v["new_refers_to"], v["new_refers_to_id"]) for v in told or ()}
                out, size = [], 0
                for record in _records(path, gzip.decompress(content.as_buffer()), judged):
                    out.append((*record, *by[record[1]]) if judged else record)
                    size += len(record[-1] or "")
                    if size > 8 << 20:
                        yield _batch(out, judged)
                        out, size = [], 0
                yield _batch(out, judged)

    return files.select("path", "content", *(["verdicts"] if judged else [])).mapInArrow(run, schema)


def _batch(rows: list[tuple], judged: bool) -> pa.RecordBatch:
    text, number = pa.string(), pa.int64()
    kinds = [("file", text), ("offset", number), ("record_type", text), ("record_id", text), ("uri", text), ("page_id", number), ("payload_bytes", number), ("payload_digest", text), ("refers_to", number), ("refers_to_id", text), ("payload", text)]
    kinds += [("new_type", text), ("new_refers_to", number), ("new_refers_to_id", text)] if judged else []
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def resolve(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(file, offset, new_type, new_refers_to, new_refers_to_id) of every record: of those with one payload digest and length of
    at least `least_bytes`, the one with the largest page_id is the response (null is the smallest; of equal ones
    the last in the archive), the others revisit it. Only headers are shuffled."""
    who = F.struct("page_id", "file", "offset", "record_id")
    same = ["payload_digest", "payload_bytes"]
    first = materialised(headers.groupBy(*same).agg(F.max(who).alias("original")))
    joined = headers.join(first, same)
    is_original = (F.col("file") == F.col("original.file")) & (F.col("offset") == F.col("original.offset"))
    revisit = ~is_original & (F.col("payload_bytes") >= least_bytes)
    return joined.select(
        "file", "offset", F.when(revisit, "revisit").otherwise("response").alias("new_type"), F.when(revisit, F.col("original.page_id")).alias("new_refers_to"), F.when(revisit, _derived(F.col("original.record_id"))).alias("new_refers_to_id")
    )


def archive(pages: DataFrame, least_bytes: int = 0, key: str = "page_id", uri: str = "url", payload: str = "html", folder: str | None = None) -> DataFrame:
    """Writes a response record per row, resolves revisits, writes the deduplicated archives, and returns the
    records read back from those: file, offset, record_type, record_id, uri, page_id, payload_bytes,
    payload_digest, refers_to, refers_to_id.

    A null payload is empty; empty payloads are equal payloads; a null key or uri leaves its header out;
    repeated rows are records of their own, of which one is the response; an empty table gives an empty
    archive. The headers' verdicts go to the files, which are unpacked once more; beyond FEW_RECORDS the packed files are
    shuffled to them, never unpacked payloads. A file
    holds at most RECORDS_PER_FILE records and about FILE_BYTES of payloads, or one longer page, whatever the longest page:
    pages are written by classes of size, each to files of its own. Files are one gzip stream each, as Spark's text
    writer makes them. The first archives are removed when the others are whole; those stay.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    folder = folder or f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    text = F.coalesce(named(payload), F.lit(""))
    raw = pages.select(
        F.lit("response").alias("record_type"),
        F.uuid().alias("record_id"),
        named(uri).alias("uri"),
        named(key).cast("long").alias("page_id"),
        F.octet_length(text).cast("long").alias("payload_bytes"),
        sha1_base32(text).alias("payload_digest"),
        F.lit(None).cast("long").alias("refers_to"),
        F.lit(None).cast("string").alias("refers_to_id"),
        text.alias("payload"),
    )
    sizes = sorted(r[0] for r in pages.select(size_class(F.coalesce(F.octet_length(named(payload)), F.lit(0)))).distinct().collect())
    for size in sizes:
        write_archive(raw.where(size_class(F.col("payload_bytes")) == size), f"{folder}/raw/{size}", records_per_file(size))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").schema("path string, modificationTime timestamp, length long, content binary")
    if not sizes:
        return read_archive(spark.createDataFrame([], "path string, content binary")).drop("payload")
    first = files.load([f"{folder}/raw/{size}" for size in sizes])
    headers = materialised(read_archive(first.select("path", "content")).drop("payload"))
    verdicts = resolve(headers, least_bytes).groupBy("file").agg(F.collect_list(F.struct("offset", "new_type", "new_refers_to", "new_refers_to_id")).alias("verdicts"))
    if headers.count() <= FEW_RECORDS:
        verdicts = F.broadcast(verdicts)
    for size in sizes:
        before = files.load(f"{folder}/raw/{size}").select("path", "content")
        fresh = read_archive(before.join(verdicts, F.col("path") == F.col("file")).select("path", "content", "verdicts")).select(
            F.col("new_type").alias("record_type"), _derived(F.col("record_id")).alias("record_id"), "uri", "page_id", "payload_bytes", "payload_digest",
            F.col("new_refers_to").alias("refers_to"), F.col("new_refers_to_id").alias("refers_to_id"), "payload",
        )
        write_archive(fresh, f"{folder}/deduplicated", records_per_file(size))
    remove(spark, f"{folder}/raw")
    return read_archive(files.load(f"{folder}/deduplicated")).drop("payload")
