"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page_id; every task writes its range to files that roll at a compressed size, one gzip
member a record, under a temporary name, and renames them when whole. The manifest (a table in the shared folder)
lists the files of the tasks that succeeded; readers open only those. Names, headers, record ids and digests follow
from the rows alone, so a task that runs again writes the same bytes over the same names.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import join_hot, partitions, ship, stage
from strata.operators.clean import shared_root

#: Compressed bytes at which a file ends (a single record can pass it).
ROLL_BYTES = 64 << 20
#: Equal payloads of at least so many bytes are written once; the others revisit the first.
REVISIT_BYTES = 100
DATE = "2001-12-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page}')}>"


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in headers)]
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page_record(page, url: str, payload: bytes, refers) -> bytes:
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Record-ID", _record_id(page)),
        ("WARC-Target-URI", "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("X-Page-ID", str(page)),
    ]
    if refers is None:
        return _record("response", headers, http + payload)
    more = [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(refers)), ("X-Refers-To-Page-ID", str(refers))]
    return _record("revisit", headers + more, http)


class _Roller:
    """Writes gzip members to numbered files in one folder; a file appears under its name only when it is whole."""

    def __init__(self, folder: str, task: int, attempt: int, roll: int):
        self.fs, self.folder = pyarrow.fs.FileSystem.from_uri(folder)
        self.task, self.attempt, self.roll = task, attempt, roll
        self.out, self.number, self.done = None, 0, []
        self.fs.create_dir(f"{self.folder}/_temporary", recursive=True)

    def write(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"pages-{self.task:05d}-{self.number:05d}.warc.gz"
            self.path = f"{self.folder}/_temporary/{self.name}.{self.attempt}"
            self.out, self.bytes, self.records = self.fs.open_output_stream(self.path, compression=None), 0, 0
            info = f"software: strata\r\nformat: WARC File Format 1.1\r\nisPartOf: pages\r\nfilename: {self.name}\r\n"
            self._member(_record("warcinfo", [("WARC-Record-ID", _record_id_of(self.name)), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info.encode()))
            self.records = 0
        self._member(record)
        if self.bytes >= self.roll:
            self.close()

    def _member(self, record: bytes) -> None:
        z = zlib.compressobj(5, zlib.DEFLATED, 31)
        data = z.compress(record) + z.flush()
        self.out.write(data)
        self.bytes += len(data)
        self.records += 1

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        final = f"{self.folder}/{self.name}"
        if self.fs.get_file_info(final).type != pyarrow.fs.FileType.NotFound:
            self.fs.delete_file(final)  # of an earlier attempt, with the same bytes
        self.fs.move(self.path, final)
        self.done.append((self.name, self.records, self.bytes))
        self.out, self.number = None, self.number + 1


def _record_id_of(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, name)}>"


def _writer(folder: str, roll: int):
    """Rows by (page_id, is_page): a page's revisit note, if there is one, comes before its rows."""

    def run(batches):
        context = TaskContext.get()
        files = _Roller(folder, context.partitionId(), context.taskAttemptId(), roll)
        noted = refers = None
        for batch in batches:
            for page, is_page, target, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not is_page:
                    noted, refers = page, target
                else:
                    files.write(_page_record(page, url or "", (html or "").encode("utf-8"), refers if page == noted and noted is not None else None))
        files.close()
        if files.done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*files.done, strict=True)], ["file", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, roll_bytes: int = ROLL_BYTES) -> tuple[str, DataFrame]:
    """pages(page_id, url, html) -> (folder, manifest(file, records, bytes)): the archives, written and committed.

    A null html is an empty payload, a null url an empty target. Of equal payloads of REVISIT_BYTES or more the least
    page_id is a response and other page_ids revisit it; rows that repeat that page_id are responses too. A null
    page_id is written as page None and neither refers nor is referred to. Other columns are ignored.
    """
    spark = pages.sparkSession
    ship(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    large = rows.where((F.octet_length("html") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).select(
        "page_id", F.unhex(F.sha2(F.col("html").cast("binary"), 256)).alias("digest")
    )
    large = stage(large, "digests")
    first = large.groupBy("digest").agg(F.min("page_id").alias("target"), F.count("*").alias("_n")).where("_n > 1")
    notes = join_hot(large, first, ["digest"], large.count()).where("page_id != target").select("page_id", "target").distinct()
    nothing = F.lit(None).cast("string")
    both = rows.select("page_id", F.lit(True).alias("is_page"), F.lit(None).cast("long").alias("target"), "url", "html").union(
        notes.select("page_id", F.lit(False), "target", nothing, nothing)
    )
    ordered = both.repartitionByRange(partitions(spark), "page_id").sortWithinPartitions("page_id", "is_page", "url", "html")
    folder = f"{shared_root(spark)}/strata/warc-{uuid.uuid4().hex}"
    manifest = ordered.mapInArrow(_writer(folder, roll_bytes), "file string, records long, bytes long")
    return folder, stage(manifest, "manifest")


def _parse(stream):
    """Yields (headers, block) of the records of one archive."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            k, _, v = line.decode().partition(": ")
            headers[k] = v
        block = stream.read(int(headers["Content-Length"]))
        if "sha256:" + hashlib.sha256(block).hexdigest() != headers["WARC-Block-Digest"]:
            raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
        stream.read(4)
        yield headers, block


def _reader(folder: str):
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "html"]

    def rows(fs, root, batches):
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for h, block in _parse(stream):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        found += 1
                        head, _, payload = block.partition(b"\r\n\r\n")
                        digest, page, refers = h["WARC-Payload-Digest"].removeprefix("sha256:"), h["X-Page-ID"], h.get("X-Refers-To-Page-ID")
                        if h["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"damaged payload of page {page}")
                        size = int(head.decode().split("Content-Length: ")[1].split("\r\n")[0])
                        yield None if page == "None" else int(page), h["WARC-Target-URI"], h["WARC-Type"], int(refers) if refers else None, size, digest, payload.decode("utf-8") if h["WARC-Type"] == "response" else None
                if found != records:
                    raise ValueError(f"{name} holds {found} of {records} records")

    def run(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        block, size = [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block, strict=True), types, strict=True)], names)
        for row in rows(fs, root, batches):
            block.append(row)
            size += len(row[-1] or "")
            if size > 4 << 20 or len(block) >= 1000:
                yield flush()
                block, size = [], 0
        if block:
            yield flush()

    return run


def read_archives(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """The page records of the archives that the manifest lists: page_id, url, record_type (response or revisit),
    refers_to, payload_bytes, payload_digest, html (null for revisits). Digests are checked; damage is an error."""
    ship(spark)
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, html string"
    return manifest.select("file", "records").repartition(partitions(spark), "file").mapInArrow(_reader(folder), schema)
