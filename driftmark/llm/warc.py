"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by page id; a range is one task, which rolls to a new file once the
compressed size reaches ``roll_bytes``. Headers, record ids and digests are generated from the rows
alone, files are written under temporary names and moved, and the manifest table is committed last,
so that a task or job that runs again gives the same bytes.

Of pages with equal payloads of at least ``least`` bytes, the one with the largest page id is the
response and the others are revisits of it (of repeated rows of that page, the first). Null html is
an empty payload; pages without id are responses; a null url leaves the target header out; an empty
table writes no file. Columns beside the named ones are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's namespace for URLs


def _record_id(page, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page}/{digest}/{copy}')}>"


def record(page, url: str | None, payload: bytes, digest: str, refers_to, copy: int, date: str) -> bytes:
    """One record, uncompressed. ``refers_to`` is the response's page id of a revisit, else None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    b32 = lambda hexed: base64.b32encode(bytes.fromhex(hexed)).decode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {_record_id(page, digest, copy)}", f"WARC-Date: {date}"]
    if url:
        head.append(f"WARC-Target-URI: {quote(url, safe='!#$%&()*+,/:;=?@[]~')}")
    head += [f"WARC-Payload-Digest: sha1:{b32(digest)}", f"WARC-Block-Digest: sha1:{b32(hashlib.sha1(block).hexdigest())}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest, 0)}", f"X-Refers-To-Page: {refers_to}"]
    head += [f"X-Page: {page if page is not None else ''}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def write(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, shard_bytes: int = 32 << 20, roll_bytes: int = 4 << 20, level: int = 6, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write all pages below ``out``; returns the manifest (shard, number, file, records, bytes, sha256)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    lean = rows.select("page_id", F.octet_length("html").alias("n"), F.when((F.octet_length("html") >= least) & F.col("page_id").isNotNull(), F.sha1(F.encode("html", "utf-8"))).alias("digest"))
    equal = lean.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1")
    marks = lean.where("digest is not null").join(equal, "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to")
    cuts = shared.range_cuts(lean.select("page_id", (F.col("n") + 300).alias("n")), "page_id", F.col("n"), shard_bytes)
    # A mark sorts before the records of its page, so one shuffle brings both to the writer.
    both = rows.select("page_id", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("refers_to")).unionByName(
        marks.select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to")
    )
    ranged = shared.with_range(both, "page_id", cuts, "dm_shard").repartitionById(len(cuts[2]) + 1, "dm_shard")
    ranged = ranged.sortWithinPartitions("page_id", "kind", "html", "url", "digest").select("page_id", "kind", "url", "html", "digest", "refers_to")

    def run(batches):
        import pyarrow as pa

        files, root = shared.files(out)
        shard, made = TaskContext.get().partitionId(), []
        page, marked, copies = object(), {}, {}
        stream, temp, size, records, sha = None, "", 0, 0, None

        def close():
            nonlocal stream
            if stream is not None:
                stream.close()
                name = f"{shard:06d}-{len(made):05d}.warc.gz"
                files.move(temp, f"{root}/{name}")
                made.append((shard, len(made), name, records, size, sha.hexdigest()))
                stream = None

        for batch in batches:
            ids, kinds, urls, htmls, digests, refers = batch.columns
            for at, own in enumerate(ids.to_pylist()):
                if own != page:
                    page, marked, copies = own, {}, {}
                if not kinds[at].as_py():
                    marked[digests[at].as_py()] = refers[at].as_py()
                    continue
                payload = htmls[at].as_py().encode()
                digest = hashlib.sha1(payload).hexdigest()
                copy = copies.get(digest, 0)
                copies[digest] = copy + 1
                to = marked.get(digest)
                if to is None and copy and own is not None and len(payload) >= least:
                    to = own
                squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = squeeze.compress(record(own, urls[at].as_py(), payload, digest, to, copy, date)) + squeeze.flush()
                if stream is not None and size + len(data) > roll_bytes:
                    close()
                if stream is None:
                    files.create_dir(f"{root}/tmp", recursive=True)
                    temp, size, records, sha = f"{root}/tmp/{shard:06d}.{uuid.uuid4().hex}", 0, 0, hashlib.sha256()
                    stream = files.open_output_stream(temp, compression=None)
                stream.write(data)
                sha.update(data)
                size, records = size + len(data), records + 1
        close()
        if made:
            types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=["shard", "number", "file", "records", "bytes", "sha256"])

    schema = "shard int, number int, file string, records long, bytes long, sha256 string"
    fs, root = shared.hadoop_path(pages.sparkSession, out)
    fs.mkdirs(root)
    ranged.mapInArrow(run, schema).write.parquet(f"{out}/manifest.tmp")
    spark = pages.sparkSession
    fs.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/manifest.tmp"), spark._jvm.org.apache.hadoop.fs.Path(f"{out}/manifest"))
    return spark.read.schema(schema).parquet(f"{out}/manifest")


def records_of(stream, chunk: int = 1 << 20):
    """(headers, block) of each record of a gzipped archive, one member at a time."""
    inflate, parts, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(chunk)
        if not data:
            return
        parts.append(inflate.decompress(data))
        data = inflate.unused_data
        if inflate.eof:
            head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield fields, rest[: int(fields["Content-Length"])]
            inflate, parts = zlib.decompressobj(31), []


def read(manifest: DataFrame, out: str) -> DataFrame:
    """Per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Payloads of responses are digested again and must match their headers.
    """

    def run(batches):
        import pyarrow as pa

        files, root = shared.files(out)
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        emit = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with files.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for fields, block in records_of(f):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        kind = fields["WARC-Type"]
                        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"{name}: a payload does not match its digest")
                        page = fields["X-Page"]
                        rows.append((int(page) if page else None, size, digest, kind, int(fields["X-Refers-To-Page"]) if kind == "revisit" else None))
                        if len(rows) >= 20_000:
                            yield emit(rows)
                            rows = []
                if rows:
                    yield emit(rows)

    n = max(1, manifest.count())
    return manifest.select("file").repartition(min(n, 4096)).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
