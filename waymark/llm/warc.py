"""Operator 8, WARC archives as chunked record tables.

``write_archives`` streams one record for each row into gzip-compressed archives (a gzip member a
record) in the shared folder, through pyarrow's file systems, and returns the manifest of the
files that count: a task that is run again writes a new file, and the one left behind is in no
manifest. ``read_chunks`` streams archives back in pieces of fixed size and gives rows
(record id, chunk number), each with the digest of the payload so far, so neither side holds a
whole archive; a reader holds one piece at a time, however large the record. ``record_index`` reduces chunks to records.

Of rows with equal payloads of at least ``least`` bytes, the one with the largest page id is a
response and the others are revisits that refer to it, without a payload of their own.

Defined cases: a null payload is empty; a null url leaves the target header out; rows that repeat
the largest page id are all responses; a null page id is only a response if no row of its payload has one; empty
tables give no archives; further columns are ignored.
"""

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.sources.tables import shared_dir

CHUNK = 64 * 1024          # bytes of payload in a chunk row
ARCHIVE = 256 * 1024 ** 2  # payload bytes after which a task starts its next archive
SALTS = 16
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

MANIFEST = "archive string, records long, bytes long"
CHUNKS = ("archive string, record_no long, page_id long, record_id string, record_type string, refers_to long, target string, "
          "chunk_no long, chunk_bytes long, payload_bytes long, sha1_so_far string, data binary")


def _file_system(uri: str):
    """The file system and path of a shared folder, given as a URI or a plain path."""
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, payload_digest, refers_to. One payload may hold a third of all rows, so the
    join on digests is salted; only payloads that occur again and count as large are on its small side."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload"))
    again = (rows.filter(F.length("payload") >= least).groupBy("payload_digest")
             .agg(F.max("page_id").alias("_keeper"), F.count("*").alias("_n")).filter("_n > 1 AND _keeper IS NOT NULL")
             .select(F.col("payload_digest"), "_keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(again, ["payload_digest", "_salt"], "left")
    revisit = F.col("_keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_keeper"))
    return joined.select("page_id", "url", "payload", "payload_digest",
                         F.when(revisit, F.col("_keeper")).alias("refers_to"))


def _name(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _head(kind: str, page_id, url, digest: str, refers_to, block: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}",
             "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
             f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_name(refers_to)}",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join([*lines, f"Content-Length: {block}"]) + "\r\n\r\n").encode()


class _Archive:
    def __init__(self, system, folder: str):
        self.name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        self.out, self.records, self.bytes = system.open_output_stream(self.name, compression=None), 0, 0

    def add(self, page_id, url, digest, refers_to, payload) -> None:
        http = HTTP.format(len(payload)).encode()
        body = memoryview(b"") if refers_to is not None else memoryview(payload)
        head = _head("response" if refers_to is None else "revisit", page_id, url, digest, refers_to,
                     len(http) + len(body))
        gz = zlib.compressobj(1, zlib.DEFLATED, 31)
        self.out.write(gz.compress(head + http))
        for at in range(0, len(body), CHUNK):
            self.out.write(gz.compress(body[at:at + CHUNK]))
        self.out.write(gz.compress(b"\r\n\r\n") + gz.flush())
        self.records, self.bytes = self.records + 1, self.bytes + len(body)

    def end(self) -> pa.RecordBatch:
        self.out.close()
        return pa.RecordBatch.from_pydict({"archive": [self.name], "records": [self.records], "bytes": [self.bytes]},
                                          pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))


def write_archives(rows: DataFrame, folder: str = None) -> DataFrame:
    """Write the rows of ``with_revisits``; returns the manifest, itself written before it is used."""
    spark = rows.sparkSession
    folder = folder or f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"

    def write(batches):
        system, path = _file_system(folder)
        system.create_dir(f"{path}/warc", recursive=True)
        archive = None
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload_digest", "refers_to", "payload")]
            for i in range(batch.num_rows):
                archive = archive or _Archive(system, f"{path}/warc")
                archive.add(*[c[i].as_py() for c in columns[:4]], columns[4][i].as_buffer())
                if archive.bytes >= ARCHIVE:
                    yield archive.end()
                    archive = None
        if archive:
            yield archive.end()

    rows.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").withColumn("folder", F.lit(folder))


class _Stream:
    """Reads of bounded size over concatenated gzip members."""

    def __init__(self, raw):
        self.raw, self.gz, self.ready, self.rest = raw, zlib.decompressobj(31), bytearray(), b""

    def _more(self) -> bool:
        if self.gz.eof:
            # At the end of a member the tail not consumed is the data after it, given twice.
            self.rest, self.gz = self.gz.unused_data, zlib.decompressobj(31)
        piece = self.rest or self.raw.read(CHUNK)
        more = self.gz.decompress(piece, CHUNK)
        self.ready += more
        self.rest = self.gz.unconsumed_tail
        return bool(piece or more)

    def line(self) -> bytes:
        while (at := self.ready.find(b"\r\n")) < 0 and self._more():
            pass
        if at < 0:
            if self.ready:
                raise ValueError("archive ends inside a line")
            return None
        line = bytes(self.ready[:at])
        del self.ready[:at + 2]
        return line

    def take(self, n: int) -> bytes:
        while len(self.ready) < n and self._more():
            pass
        if len(self.ready) < n:
            raise ValueError("archive ends inside a record")
        piece = bytes(self.ready[:n])
        del self.ready[:n]
        return piece

    def headers(self) -> dict:
        found = {}
        while line := self.line():
            name, _, value = line.decode().partition(":")
            found[name.strip().lower()] = value.strip()
        return found


def _page(name: str):
    digits = (name or "")[len("<urn:page:"):-1]
    return int(digits) if digits else None


def _records(name: str, raw):
    """The chunk rows of one archive. A record without a payload has one empty chunk."""
    stream, record = _Stream(raw), 0
    while (line := stream.line()) is not None:
        if line != b"WARC/1.1":
            raise ValueError(f"{name}: a record does not begin where one must")
        head = stream.headers()
        http_from = stream.line()
        http = stream.headers()
        size, digest = int(http["content-length"]), hashlib.sha1()
        if not http_from.startswith(b"HTTP/"):
            raise ValueError(f"{name}: no HTTP message in {head['warc-record-id']}")
        kind = head["warc-type"]
        base = (name, record, _page(head["warc-record-id"]), head["warc-record-id"], kind,
                _page(head.get("warc-refers-to")), head.get("warc-target-uri"))
        left, number = (size if kind == "response" else 0), 0
        while left or not number:
            data = stream.take(min(left, CHUNK))
            digest.update(data)
            left -= len(data)
            so_far = digest.hexdigest() if kind == "response" else base64.b32decode(
                head["warc-payload-digest"].removeprefix("sha1:")).hex()
            yield (*base, number, len(data), size, so_far, data)
            number += 1
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError(f"{name}: {head['warc-record-id']} is not ended")
        record += 1


def read_chunks(manifest: DataFrame) -> DataFrame:
    """Chunk rows of the archives of a manifest; an archive is read by one task, in order."""
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in CHUNKS.split(", ")])

    def read(batches):
        for batch in batches:
            for name, folder in zip(batch.column("archive").to_pylist(), batch.column("folder").to_pylist()):
                rows, held = [], 0
                with _file_system(folder)[0].open_input_stream(name, compression=None) as raw:
                    for row in _records(name, raw):
                        rows.append(row)
                        held += row[8] + 200
                        if held > 16 * CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], names)

    spread = manifest.select("archive", "folder").repartition(
        max(1, manifest.sparkSession.sparkContext.defaultParallelism), "archive")
    return spread.mapInArrow(read, CHUNKS)


def record_index(chunks: DataFrame) -> DataFrame:
    """One row for each record: the digest of its last chunk covers the whole payload."""
    return chunks.groupBy("archive", "record_no").agg(
        *[F.first(c).alias(c) for c in ("record_id", "page_id", "record_type", "refers_to", "payload_bytes")],
        F.max_by("sha1_so_far", "chunk_no").alias("payload_digest"), F.count("*").alias("n_chunks"))


def digest(pages: DataFrame) -> DataFrame:
    chunks = read_chunks(write_archives(with_revisits(pages)))
    return record_index(chunks.drop("data")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
