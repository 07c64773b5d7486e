r"""WARC archives: writing, normalising monolithic gzip files, and reading back by index.

``write`` puts pages into archives that are one gzip stream each, as some crawlers leave them: such a file can't be read
from the middle or by several tasks.  ``normalise`` inflates a whole-file stream once, block by block, finds the records
by their Content-Length, rewrites each as its own gzip member, and writes a sidecar index (offset and length of every
member) beside the archive.  ``indexed`` reads the sidecars; ``read`` takes runs of their entries, seeks, and inflates
members.

Of pages with equal payloads of at least 100 bytes the one with the smallest page_id is a response, the others are
revisits of it (identical-payload-digest): they keep the HTTP head, with its Content-Length, and the digest, and drop
the payload.  Tasks hold one record and one block at a time; a file's name holds the attempt, and only files in a written
manifest belong to the output, so lost or repeated tasks leave nothing behind that is read.

Defined results: a null html is an empty payload; a payload of any length is one record, held whole by the task that
writes or reads it; smaller payloads are all responses; rows that share the smallest
page_id of equal payloads are all responses; a null page_id is kept and is never referred to, and such a row revisits
like others; an empty table gives no archives and no rows; other columns take no part.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, shared_dir, shuffle_partitions, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Smallest payload that is revisited; bytes taken from a stream at once; index entries that a task reads together.
LEAST, BLOCK, RUN = 100, 1 << 20, 512
DATE = "2024-01-01T00:00:00Z"
#: An entry of a sidecar: where a member begins and its length.
ENTRY = "<QQ"


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to (null for responses).

    The smallest id of each payload is a grouped minimum with partial sums; the join back is a plain equi-join, whose hot
    keys adaptive execution splits.
    """
    p = columns_of(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    p = p.withColumn("_key", F.when(F.octet_length("html") >= LEAST, F.sha2("html", 256)))
    first = p.where("_key is not null").groupBy(F.col("_key").alias("_k")).agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    p = p.join(first, F.col("_key") == F.col("_k"), "left")
    return p.select("page_id", "url", "html", F.when(~F.col("_first").eqNullSafe(F.col("page_id")), F.col("_first")).alias("refers_to"))


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    head.append(f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    body = http + payload if refers_to is None else http
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def head_of(data: bytes | bytearray, start: int = 0) -> tuple[dict[str, str], int] | None:
    """Header fields by lower-case name and where the block after them begins; None where the head is not all there."""
    end = data.find(b"\r\n\r\n", start)
    if end < 0:
        return None
    lines = bytes(data[start:end]).decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields | {"": lines[0]}, end + 4


def records_of(stream, block: int = BLOCK) -> Iterator[bytes]:
    """The records of a gzip stream of any number of members, each whole, in order."""
    inflate, held, need = zlib.decompressobj(31), bytearray(), 0
    while True:
        raw = stream.read(block)
        if not raw:
            break
        while raw:
            held += inflate.decompress(raw)
            raw = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
        at = 0
        while len(held) - at >= max(need, 1):
            if (head := head_of(held, at)) is None:
                break
            end = head[1] + int(head[0]["content-length"]) + 4
            if end > len(held):
                need = end - at
                break
            yield bytes(held[at:end])
            at, need = end, 0
        del held[:at]
    if held.strip():
        raise ValueError("the archive ends inside a record")


def write(pages: DataFrame) -> DataFrame:
    """Monolithic archives of planned() pages; the manifest (folder, file, records), a written table."""
    folder = shared_dir(pages.sparkSession)

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name, n, f, deflate = f"{root}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, None, zlib.compressobj(1, zlib.DEFLATED, 31)
        for b in batches:
            for page_id, url, html, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                f = f or fs.open_output_stream(name, compression=None)
                f.write(deflate.compress(record(page_id, url, html.encode(), refers_to)))
                n += 1
        if f:
            f.write(deflate.flush())
            f.close()
            yield pa.RecordBatch.from_pydict({"folder": [folder], "file": [name], "records": [n]})

    return written(planned(pages).mapInArrow(run, "folder string, file string, records long"))


def normalise(manifest: DataFrame) -> DataFrame:
    """Rewrite each archive with a gzip member per record, and a sidecar index; the manifest (folder, file, records), a written table."""
    folder = shared_dir(manifest.sparkSession)

    def run(batches):
        for b in batches:
            for source, name in zip(b.column("folder").to_pylist(), b.column("file").to_pylist(), strict=True):
                fs, _ = pafs.FileSystem.from_uri(source)
                to, root = pafs.FileSystem.from_uri(folder)
                to.create_dir(root, recursive=True)
                out, at, n = f"{root}/{name.rpartition('/')[2].partition('-')[0]}-{uuid.uuid4().hex}.warc.gz", 0, 0
                with fs.open_input_stream(name, compression=None) as stream, to.open_output_stream(out, compression=None) as f, to.open_output_stream(f"{out}.idx", compression=None) as sidecar:
                    for rec in records_of(stream):
                        deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
                        member = deflate.compress(rec) + deflate.flush()
                        f.write(member)
                        sidecar.write(struct.pack(ENTRY, at, len(member)))
                        at, n = at + len(member), n + 1
                yield pa.RecordBatch.from_pydict({"folder": [folder], "file": [out], "records": [n]})

    files = manifest.select("folder", "file").repartition(4 * shuffle_partitions(manifest.sparkSession), "file")
    return written(files.mapInArrow(run, "folder string, file string, records long"))


def indexed(manifest: DataFrame) -> DataFrame:
    """folder, file, at, size and run of each record, from the archives' sidecars; each has to name as many as were written."""

    def run(batches):
        for b in batches:
            for folder, file, records in zip(*(b.column(c).to_pylist() for c in ("folder", "file", "records")), strict=True):
                with pafs.FileSystem.from_uri(folder)[0].open_input_stream(f"{file}.idx", compression=None) as f:
                    n = 0
                    while raw := f.read(struct.calcsize(ENTRY) * RUN):
                        starts, sizes = zip(*struct.iter_unpack(ENTRY, raw), strict=True)
                        yield pa.RecordBatch.from_pydict({"folder": [folder] * len(starts), "file": [file] * len(starts), "at": starts, "size": sizes, "run": [n] * len(starts)}, schema)
                        n += 1
                        records -= len(starts)
                if records:
                    raise ValueError(f"{file}.idx: {records} records are missing")

    schema = pa.schema([("folder", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("run", pa.int64())])
    return manifest.mapInArrow(run, "folder string, file string, at long, size long, run long")


def read(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record that the sidecars of normalise() name.

    A response's payload is measured and hashed as it was read; it has to agree with the record's own digest.
    """

    def page(urn: str) -> int | None:
        v = urn.strip("<>").rpartition(":")[2]
        return None if v == "null" else int(v)

    def run(batches):
        name, f = None, None
        for b in batches:
            rows = []
            for folder, file, at, size in zip(*(b.column(c).to_pylist() for c in ("folder", "file", "at", "size")), strict=True):
                if file != name:
                    if f:
                        f.close()
                    name, f = file, pafs.FileSystem.from_uri(folder)[0].open_input_file(file)
                f.seek(at)
                rec = zlib.decompress(f.read(size), 31)
                fields, begin = head_of(rec)
                http, payload_at = head_of(rec, begin)
                digest, kind = fields["warc-payload-digest"].partition(":")[2], fields["warc-type"]
                n = int(http["content-length"])
                if kind == "response":
                    payload = memoryview(rec)[payload_at : begin + int(fields["content-length"])]
                    if len(payload) != n or hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{file} at {at}: the payload does not match its head")
                rows.append((page(fields["warc-record-id"]), n, digest, kind, page(fields["warc-refers-to"]) if kind == "revisit" else None))
            yield pa.RecordBatch.from_pydict(dict(zip(out.names, zip(*rows, strict=True), strict=True)), out) if rows else pa.RecordBatch.from_pylist([], out)
        if f:
            f.close()

    out = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    spread = indexed(manifest).repartition(4 * shuffle_partitions(manifest.sparkSession), "file", "run").sortWithinPartitions("file", "at")
    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, octet_length(encode(h)) AS n, min(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN n >= {LEAST} AND m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {LEAST} AND m <> page_id THEN m END AS refers_to
FROM d
"""
