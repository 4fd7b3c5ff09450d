"""WARC archives in Zstandard with a dictionary, and their reader.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary built from records of
the archive itself; each record follows as a frame of its own, so that any record can be read alone. Payloads
that occur more than once, at MIN_REVISIT bytes or more, are stored once, as the response with the largest page_id;
the others become revisit records that refer to it.

Tasks write an archive for every ARCHIVE_BYTES of records under a name that no other attempt has; the names that Spark
commits are the manifest, so that what a lost or repeated task left behind is never read. The folder is reached by pyarrow's file systems (local and mounted
paths, s3, gs, hdfs); reading goes through Spark.

Defined cases: a null html or url is empty; a null page_id is kept as such and loses ties; rows that repeat page_id and payload of a
group's largest page_id are all responses; an empty table writes no archive; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespan.llm.common import new_folder, utf8

MIN_REVISIT = 1000
ARCHIVE_BYTES = 32 << 20
#: The dictionary is built from the first records of each archive, up to so many bytes, and holds so many itself.
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
SKIPPABLE = 0x184D2A5D
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_types(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """page_id, html, url, payload_bytes, payload_digest, record_type, refers_to of each row of pages."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), body.alias("html"))
    known = known.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha1("html"), "check": F.sha2("html", 256)})
    keys = ["payload_digest", "check", "payload_bytes"]
    # Bodies stay out of these shuffles; a body moves once, by its page_id, so that no digest is hot.
    ids = known.where(F.col("payload_bytes") >= least).select("page_id", *keys)
    groups = ids.groupBy(*keys).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = ids.distinct().join(groups, keys).where("not (page_id <=> first)").select(F.col("page_id").alias("at"), F.col("check").alias("as"), "first")
    joined = known.join(again, F.col("page_id").eqNullSafe(F.col("at")) & (F.col("check") == F.col("as")), "left")
    revisit = F.col("as").isNotNull()
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _clean(value: str) -> str:
    return value.replace("\r", " ").replace("\n", " ")


def record(page_id: int | None, url: str, html: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. Page ids and the payload's length, which a revisit leaves out, are extension fields."""
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {record_id(page_id)}\r\nWARC-Date: {_DATE}\r\nWARC-Target-URI: {_clean(url)}\r\nWARC-Payload-Digest: sha1:{digest}\r\n"
    if page_id is not None:
        head += f"X-Page-ID: {page_id}\r\n"
    if kind == "revisit":
        head += f"WARC-Profile: {_PROFILE}\r\nX-Refers-To-Page-ID: {refers_to}\r\nWARC-Refers-To: {record_id(refers_to)}\r\n"
        body = b""
    else:
        body = html
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html) + body
    return f"{head}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def archive(records: list[bytes], level: int = 3) -> bytes:
    """Records -> skippable frame with the dictionary, then a frame for each record. Too few records for a dictionary: an empty one."""
    sample, held = [], 0
    for r in records:
        if held >= SAMPLE_BYTES:
            break
        sample.append(r[: 128 << 10])
        held += len(sample[-1])
    try:
        trained = zstandard.train_dictionary(min(DICTIONARY_BYTES, held // 8), sample, k=256, d=8, level=level).as_bytes()
    except zstandard.ZstdError:
        trained = b""
    to = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
    return struct.pack("<II", SKIPPABLE, len(trained)) + trained + b"".join(map(to.compress, records))


def _folder(at: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if urlsplit(at).scheme in ("", "file"):
        return pyarrow.fs.LocalFileSystem(), urlsplit(at).path
    return pyarrow.fs.FileSystem.from_uri(at)


def write(pages: DataFrame, at: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives of all pages to the folder `at`; the manifest: name and records of each archive."""
    fs, base = _folder(at)
    fs.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = _folder(at)
        number, held, records = 0, 0, []

        def close() -> pa.RecordBatch:
            nonlocal number, held, records
            name, n = f"pages-{task.partitionId():05d}-{number:05d}-{task.taskAttemptId()}-{uuid.uuid4().hex}.warc.zst", len(records)
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write(archive(records))
            number, held, records = number + 1, 0, []
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["name", "records"])

        columns = ("page_id", "url", "html", "payload_digest", "record_type", "refers_to")
        for batch in batches:
            rows = zip(*(utf8(batch, c).to_pylist() if c == "html" else batch.column(c).to_pylist() for c in columns), strict=True)
            for row in rows:
                records.append(record(*row))
                held += len(records[-1])
                if held >= archive_bytes:
                    yield close()
        if records:
            yield close()

    spark = pages.sparkSession
    record_types(pages).mapInArrow(run, "name string, records long").write.parquet(f"{at}/manifest")
    return spark.read.schema("name string, records long").parquet(f"{at}/manifest")


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields and block of each record of an archive."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    made = zstandard.ZstdCompressionDict(data[8 : 8 + size]) if size else None
    reader = zstandard.ZstdDecompressor(dict_data=made).stream_reader(memoryview(data)[8 + size :], read_across_frames=True)
    held = b""
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            more = reader.read(1 << 16)
            if not more:
                if held:
                    raise ValueError("a record's header is cut off")
                return
            held += more
        fields = dict(line.split(": ", 1) for line in held[:end].decode().split("\r\n")[1:])
        held = held[end + 4 :]
        need = int(fields["Content-Length"]) + 4
        if len(held) < need:
            rest = [held]
            missing = need - len(held)
            while missing > 0:
                more = reader.read(max(missing, 1 << 16))
                if not more:
                    raise ValueError("a record's block is cut off")
                rest.append(more)
                missing -= len(more)
            held = b"".join(rest)
        yield fields, held[: need - 4]
        held = held[need:]


def read(spark: SparkSession, at: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (null for revisits) of every record of the archives in `at`.

    Where the folder has a manifest, of those that it names.

    A response's length and digest are those of the payload read; one that differs from its header is an error.
    """
    import hashlib

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"

    def rows(data: bytes) -> Iterator[tuple]:
        for fields, block in records(data):
            http, _, body = block.partition(b"\r\n\r\n")
            kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
            size = int(http.rpartition(b"Content-Length: ")[2])
            if kind == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
                raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its header")
            page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
            yield page and int(page), size, digest, kind, int(refers) if refers not in (None, "None") else None, fields["WARC-Target-URI"], body if kind == "response" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        for batch in batches:
            for data in batch.column("content"):
                held, size = [], 0
                for row in rows(data.as_py()):
                    held.append(row)
                    size += len(row[-1] or b"")
                    if size >= 4 << 20 or len(held) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

    fs, base = _folder(at)
    if fs.get_file_info(f"{base}/manifest").type != pyarrow.fs.FileType.Directory:
        return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(at).select("content").mapInArrow(run, schema)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _folder(at)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with fs.open_input_stream(f"{base}/{name}") as file:
                    yield from run(iter([pa.RecordBatch.from_arrays([pa.array([file.read()], pa.binary())], ["content"])]))

    named = spark.read.schema("name string").parquet(f"{at}/manifest")
    return named.repartition(max(1, named.count())).mapInArrow(opened, schema)  # an archive a task


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to a new folder of archives in the shared folder and reads them back, without their payloads."""
    spark = pages.sparkSession
    at = new_folder(spark, "warc")
    write(pages, at)
    return read(spark, at).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
