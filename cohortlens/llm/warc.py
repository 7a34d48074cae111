"""WARC archives of records compressed one by one with a shared Zstandard dictionary.

The dictionary is built from a bounded sample of the records to archive and stands in a
skippable frame at the head of every archive, so that an archive can be read alone and any
record from its offset. Of records with equal payloads one is a response, the others
revisit it. Tasks write archives under names that follow from their partition, first as
temporary files that are then moved: a task that runs again replaces its own archives.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.rows import about, small_enough
from cohortlens.session import materialized

#: Fixed value: the skippable frame that holds a dictionary.
DICT_MAGIC = 0x184D2A5D
#: The dictionary is built from about so many records of at most so many payload bytes each, and is of this size.
SAMPLE_ROWS, SAMPLE_BYTES, DICT_BYTES = 400, 32 << 10, 64 << 10
#: Smaller payloads are not worth a revisit.
REVISIT_FROM = 100
#: Compressed bytes after which a task begins its next archive.
ARCHIVE_BYTES = 64 << 20
#: Bytes read at once.
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = "archive string, records long, bytes long"
READ = "id string, record_type string, payload_bytes long, payload_digest string, refers_to string, url string, payload binary"


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI; of a bare path, the local ones."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!//)", "file:///", folder) if ":" in folder else f"file://{folder}")


def _line(value: str) -> str:
    """A header value: white space and control characters as percent codes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", value)


def _urn(kind: str, value: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{kind}:{value}')}>"


def _headed(first: str, fields: Iterable[tuple[str, object]]) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in fields), "", ""]).encode()


def record(id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit with only the HTTP head."""
    http = _headed("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))])
    block = http if refers_to is not None else http + payload
    fields: list[tuple[str, object]] = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _urn("page", str(id))), ("WARC-Date", date),
        ("WARC-Target-URI", _line(url or "about:blank")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response"),
    ]
    fields += [("X-Page-ID", _line(id))] if id is not None else []
    fields += [("X-No-URL", "1")] if url is None else []
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn("page", refers_to)), ("X-Refers-To-Page", _line(refers_to))]
    return _headed("WARC/1.1", [*fields, ("Content-Length", len(block))]) + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict[str, object] | None:
    """The fields of ``READ`` of one record, its digest checked; None for a record of another type."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(rest) != len(block) + 4:
        raise ValueError("a record is cut short")
    if fields["WARC-Type"] not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    whole = fields["WARC-Type"] == "response"
    if whole and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not what was written")
    return {
        "id": fields.get("X-Page-ID"), "record_type": fields["WARC-Type"], "payload_bytes": length, "payload_digest": digest,
        "refers_to": fields.get("X-Refers-To-Page"), "url": None if "X-No-URL" in fields else fields["WARC-Target-URI"], "payload": payload if whole else None,
    }


def built_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary; of samples too few to train on, none."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b""


class Writer:
    """Appends records to archives of bounded size."""

    def __init__(self, folder: str, name: str, attempt: str, dictionary: bytes, limit: int, date: str):
        self.fs, self.folder = opened(folder)
        self.name, self.attempt, self.dictionary, self.limit, self.date = name, attempt, dictionary, limit, date
        own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.zstd = zstandard.ZstdCompressor(level=3, dict_data=own, write_content_size=True)
        self.out, self.made = None, 0

    def add(self, data: bytes) -> Iterator[tuple[str, int, int]]:
        """Write one record; yields the archive if that filled it."""
        if self.out is None:
            self.path = f"{self.folder}/{self.name}-{self.made:05d}.warc.zst"
            self.out, self.records, self.size = self.fs.open_output_stream(f"{self.path}.{self.attempt}.tmp", compression=None), 0, 0
            if self.dictionary:
                self._put(struct.pack("<II", DICT_MAGIC, len(self.dictionary)) + self.dictionary)
            info = b"software: cohortlens\r\nformat: WARC File Format 1.1\r\n"
            fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn("archive", f"{self.name}-{self.made}")), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))]
            self._put(self.zstd.compress(_headed("WARC/1.1", fields) + info + b"\r\n\r\n"))
        self._put(self.zstd.compress(data))
        self.records += 1
        if self.size >= self.limit:
            yield from self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> Iterator[tuple[str, int, int]]:
        if self.out is not None:
            self.out.close()
            self.fs.move(f"{self.path}.{self.attempt}.tmp", self.path)
            self.out, self.made = None, self.made + 1
            yield self.path, self.records, self.size


def frames(stream) -> Iterator[bytes]:
    """The records of an archive, one after another; only one and a chunk are in memory."""
    zstd, held = zstandard.ZstdDecompressor(), stream.read(8)
    if len(held) == 8 and struct.unpack("<I", held[:4])[0] == DICT_MAGIC:
        dictionary = stream.read(struct.unpack("<I", held[4:])[0])
        zstd, held = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)), b""
    while held or (held := stream.read(CHUNK)):
        one, parts = zstd.decompressobj(), []
        while True:
            parts.append(one.decompress(held))
            if one.eof:
                held = one.unused_data
                break
            if not (held := stream.read(CHUNK)):
                raise ValueError("an archive ends within a record")
        yield b"".join(parts)


def linked(df: DataFrame, id: str, url: str, payload: str, revisit_from: int) -> DataFrame:
    """(id, url, payload, digest, refers_to) per row, as text and bytes; refers_to for what is not a response.

    Only digests that occur more than once are joined back, so payloads move only if there are too many of those to broadcast.
    """
    d = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary").alias("payload"))
    d = d.withColumn("digest", F.sha2("payload", 256))
    groups = d.where(F.length("payload") >= revisit_from).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = materialized(groups.where("n > 1").drop("n"))
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return d.join(small_enough(groups), "digest", "left").select(
        F.col("id").cast("string").alias("id"), "url", "payload", "digest", F.when(again, F.col("first")).cast("string").alias("refers_to")
    )


def write_archives(
    df: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html",
    revisit_from: int = REVISIT_FROM, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None,
) -> DataFrame:
    """Write one record per row below ``folder`` (a path or any URI that pyarrow opens); (archive, records, bytes) per archive.

    Null payloads are empty, null URLs are marked, null ids are left out of the record. Of rows
    with one payload that with the smallest id is the response; rows that repeat its id are
    responses, too. Payloads of any length are written whole, one record each; other columns are not
    read, whatever their names. An empty table writes no archive.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = linked(df, id, url, payload, revisit_from)
    drawn = about(rows, "digest", SAMPLE_ROWS, df.count()).where((F.length("payload") <= SAMPLE_BYTES) & F.col("refers_to").isNull())
    drawn = drawn.limit(2 * SAMPLE_ROWS).collect()  # payloads that occur once, or whose response it is: about SAMPLE_ROWS
    dictionary = built_dictionary([record(r.id, r.url, bytes(r.payload), r.digest, None, date) for r in sorted(drawn, key=lambda r: (r.digest, r.id or ""))])
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer = Writer(folder, f"part-{task.partitionId():06d}", f"{task.stageId()}-{task.taskAttemptId()}", dictionary, archive_bytes, date)

        def done(archives):
            found = [dict(zip(("archive", "records", "bytes"), a, strict=True)) for a in archives]
            return pa.RecordBatch.from_pylist(found, pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for r in batch.to_pylist():
                if full := list(writer.add(record(r["id"], r["url"], r["payload"], r["digest"], r["refers_to"], date))):
                    yield done(full)
        yield done(writer.close())

    return materialized(rows.mapInArrow(write, WRITTEN))


def read_archives(spark: SparkSession, archives: DataFrame, folder: str) -> DataFrame:
    """The records in ``archives``, a table with their paths: one row each, with the payload of responses."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("payload_bytes", pa.int64()), ("payload", pa.binary())]
        schema = pa.schema([(c.split()[0], dict(kinds).get(c.split()[0], pa.string())) for c in READ.split(", ")])
        fs = opened(folder)[0]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for data in frames(stream):
                        if row := parsed(data):
                            rows.append(row)
                            size += len(data)
                        if size > 8 * CHUNK or len(rows) >= 256:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    tasks = max(1, archives.count())
    return archives.select("archive").repartition(tasks).mapInArrow(read, READ)
