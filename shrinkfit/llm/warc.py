"""Sharded WARC archives with payload digests and revisit records.

Digests are computed where the pages are read. One aggregate by digest finds the equal payloads and
the largest page_id of each group; its narrow rows (page_id, digest, refers_to) travel through the
same range sort as the pages themselves, so a page meets its decision without a join of whole
payloads, and however many pages share a payload, they are dealt by page_id. Each task then writes
its range in order: records are gzip members of their own, a file is closed when its compressed size
reaches the limit, and lengths and digests in the headers are computed from the bytes
written. Record ids and dates are derived from page_id and digest, so a rerun writes the same
bytes. A file is written under a temporary name and moved; the manifest that Spark commits
names the files that count.

Nulls: null html is an empty payload; a null url is written as an empty target; a null page_id is written as
such and its record is always a response. Payloads under ``least`` bytes are never revisits. Repeated rows (page_id and
html equal): the first one is the response, the others revisit it. Empty table: no files, no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from base64 import b32encode

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import file_system, scratch, shuffle_partitions

VERSION = "WARC/1.1"
#: Fixed value: the profile of a revisit by identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_RECORDS = "page_id long, url string, html string, digest string, decision boolean, refers_to long"
_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def labelled(digest_hex: str) -> str:
    return "sha1:" + b32encode(bytes.fromhex(digest_hex)).decode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, repeat: int) -> bytes:
    """One WARC record, without compression. ``repeat`` tells repeated rows' records apart."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page_id, f"{digest}/{repeat}" if repeat else digest), "WARC-Date": DATE,
        "WARC-Target-URI": target, "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
        "WARC-Payload-Digest": labelled(digest), "WARC-Block-Digest": labelled(hashlib.sha1(block).hexdigest()), "X-Page-Id": "" if page_id is None else str(page_id), "X-Payload-Length": str(len(payload)),
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Page": str(refers_to)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"{VERSION}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, *, least: int = 1000, roll: int = 64 << 20, files: int | None = None) -> DataFrame:
    """Write all pages into ``folder``; returns the manifest: file, part, first, n_records, n_bytes."""
    spark = pages.sparkSession
    data_dir, manifest = posixpath.join(folder, "data"), posixpath.join(folder, "manifest")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    whole = whole.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    narrow = whole.filter(F.octet_length("html") >= least).select("page_id", "digest")
    narrow = materialize(narrow, "warc-digests")
    groups = narrow.groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).filter("n > 1 AND keep IS NOT NULL")
    # Not a join of all pages: only those whose digest occurs again have a decision.
    decisions = narrow.join(groups, "digest").select("page_id", "digest", F.col("keep").alias("refers_to")).distinct()
    marks = decisions.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", F.lit(True).alias("decision"), "refers_to")
    rows = whole.select("page_id", "url", "html", "digest", F.lit(False).alias("decision"), F.lit(None).cast("long").alias("refers_to"))
    order = ["page_id", "digest", F.col("decision").desc(), "url"]
    sorted_rows = rows.unionByName(marks).repartitionByRange(files or shuffle_partitions(spark), "page_id", "digest").sortWithinPartitions(*order)

    def write(batches):
        fs, path = file_system(data_dir)
        fs.create_dir(path, recursive=True)
        part = TaskContext.get().partitionId()
        attempt, number, out, done = uuid.uuid4().hex[:8], 0, None, []
        mark, before, repeat = None, None, 0
        try:
            for batch in batches:
                for page_id, url, html, digest, decision, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    if decision:
                        mark = (page_id, digest, refers_to)
                        continue
                    repeat = repeat + 1 if before == (page_id, digest) else 0
                    before = (page_id, digest)
                    refers = None
                    if mark is not None and mark[:2] == before and (mark[2] != page_id or repeat):
                        refers = mark[2]
                    payload = html.encode()
                    zipped = zlib.compress(record(page_id, url, payload, digest, refers, repeat), 6, 31)
                    if out is None:
                        name = f"pages-{part:06d}-{number:05d}-{attempt}.warc.gz"
                        temporary = posixpath.join(path, f"_{name}.tmp")
                        out, row = fs.open_output_stream(temporary), {"file": posixpath.join(data_dir, name), "part": part, "first": page_id, "n_records": 0, "n_bytes": 0}
                        info = zlib.compress(f"{VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None, f'info/{part}/{number}')}\r\nWARC-Date: {DATE}\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode(), 6, 31)
                        out.write(info)
                        row["n_bytes"] += len(info)
                    out.write(zipped)
                    row["n_records"] += 1
                    row["n_bytes"] += len(zipped)
                    if row["n_bytes"] >= roll:
                        out.close()
                        fs.move(temporary, posixpath.join(path, name))
                        out, number = None, number + 1
                        done.append(row)
            if out is not None:
                out.close()
                fs.move(temporary, posixpath.join(path, name))
                done.append(row)
                out = None
        finally:
            if out is not None:
                out.close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("file", pa.string()), ("part", pa.int64()), ("first", pa.int64()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    sorted_rows.mapInArrow(write, "file string, part long, first long, n_records long, n_bytes long").write.parquet(manifest)
    return spark.read.parquet(manifest)


def members(stream, most: int = 1 << 20):
    """The gzip members of a stream, one after the other; memory follows the largest record."""
    data, inflate, parts = b"", zlib.decompressobj(31), []
    while True:
        if not data and not (data := stream.read(most)):
            break
        parts.append(inflate.decompress(data))
        data = inflate.unused_data
        if inflate.eof:
            yield b"".join(parts)
            inflate, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("cut short")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != VERSION or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a record")
    return fields, block


def read_warc(manifest: DataFrame) -> DataFrame:
    """One row per page record, from the archives; each response's payload digest is computed anew and compared."""

    def read(batches):
        rows: list[dict] = []
        for batch in batches:
            for uri in batch.column("file").to_pylist():
                fs, path = file_system(uri)
                with fs.open_input_stream(path, compression=None) as f:
                    for data in members(f):
                        head, block = parse(data)
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        _, _, payload = block.partition(b"\r\n\r\n")
                        digest = head["WARC-Payload-Digest"]
                        if head["WARC-Type"] == "response" and labelled(hashlib.sha1(payload).hexdigest()) != digest:
                            raise ValueError(f"payload digest differs in {uri}")
                        rows.append({"page_id": int(head["X-Page-Id"]) if head["X-Page-Id"] else None, "payload_bytes": int(head["X-Payload-Length"]), "payload_digest": _hex(digest),
                                     "record_type": head["WARC-Type"], "refers_to": int(head["X-Refers-To-Page"]) if "X-Refers-To-Page" in head else None})
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                            rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    spark = manifest.sparkSession
    n = max(1, manifest.count())
    return manifest.select("file").repartition(min(n, 4 * shuffle_partitions(spark))).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _hex(label: str) -> str:
    from base64 import b32decode

    return b32decode(label.removeprefix("sha1:")).hex()


def warc_query(pages: DataFrame) -> DataFrame:
    """op10: write all pages, read the archives back."""
    spark: SparkSession = pages.sparkSession
    return read_warc(write_warc(pages, scratch(spark, "warc")))
