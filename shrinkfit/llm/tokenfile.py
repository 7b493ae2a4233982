"""Token-id files: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

The documents are range-sorted by id, and each task encodes its range, once, into one file of sections. A
section holds whole documents of some millions of tokens: the id of each rank (ids by falling count in the section, ties:
smaller id), so the frequent ones take one byte; the documents' ids and lengths; two control bits per token (its bytes less one, four
tokens to a control byte); the data bytes. Reading decodes a section with numpy: a 256-entry table
gives the four lengths of a control byte, a running sum the place of every token.

A file is written under a temporary name and moved; the manifest (one row per committed file,
written by Spark) names the files that count, so a repeated or lost task leaves nothing behind
that a reader sees. The manifest, one row per file, is all that passes through the driver.

Nulls: a null text is empty (only the end id is written); a null doc_id sorts first and is kept.
Very long texts: a section holds one document at least, so memory follows the longest text. Ties and
repeated rows: rows of one doc_id follow each other by text, each is written. Empty table: no
file, no rows. Further columns are not read.
"""

from __future__ import annotations

import posixpath
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cache import tidy
from .common import file_system, scratch, shuffle_partitions, slices
from .tokens import encoder, tokenizer_path

MAGIC = b"TOKFILE1"
_HEAD = struct.Struct("<QQQQQ")  # documents, tokens, different ids, control bytes, data bytes
#: Tokens from which a section is closed.
SECTION = 4_000_000
_NULL = np.iinfo(np.int64).min

#: Lengths of the four tokens of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.uint8) + 1


def encode_section(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    often = np.bincount(ids)
    used = np.flatnonzero(often)
    by_rank = used[np.lexsort((used, -often[used]))].astype("<u4")
    rank = np.zeros(len(often), dtype="<u4")
    rank[by_rank] = np.arange(len(by_rank), dtype="<u4")
    ranks = rank[ids]
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= code[:, None]]
    padded = np.zeros(-(-len(code) // 4) * 4, dtype=np.uint8)
    padded[: len(code)] = code
    control = (padded.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(axis=1).astype(np.uint8)
    return b"".join([_HEAD.pack(len(doc_ids), len(ranks), len(by_rank), len(control), len(data)), by_rank.tobytes(), doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), control.tobytes(), data.tobytes()])


def decode_ranks(n: int, control: np.ndarray, data: np.ndarray) -> np.ndarray:
    lens = LENGTHS[control].reshape(-1)[:n]
    starts = np.cumsum(lens, dtype=np.int64) - lens
    out = data[starts].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lens > k)
        out[more] |= data[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def read_sections(uri: str):
    """(doc_ids, counts, ids) of each section of a file."""
    fs, path = file_system(uri)
    with fs.open_input_stream(path) as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        while head := f.read(_HEAD.size):
            docs, tokens, n_ids, n_control, n_data = _HEAD.unpack(head)
            by_rank = np.frombuffer(f.read(4 * n_ids), "<u4")
            doc_ids = np.frombuffer(f.read(8 * docs), "<i8")
            counts = np.frombuffer(f.read(4 * docs), "<u4")
            control = np.frombuffer(f.read(n_control), np.uint8)
            data = np.frombuffer(f.read(n_data), np.uint8)
            if len(data) != n_data:
                raise ValueError(f"cut short: {uri}")
            yield doc_ids, counts, by_rank[decode_ranks(tokens, control, data)]


def write_tokens(docs: DataFrame, folder: str, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end: int = 0, files: int | None = None) -> DataFrame:
    """Encode every text, write the files into ``folder`` (a path that all executors share); returns the manifest: file, part, first, n_docs, n_tokens."""
    spark, path = docs.sparkSession, path or tokenizer_path()
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    data_dir, manifest = posixpath.join(folder, "data"), posixpath.join(folder, "manifest")

    def write(batches):
        enc, out, name, place = encoder(path), None, "", None
        first, docs_n, tokens_n = None, 0, 0
        held: list[tuple] = []

        def section():
            keys, counts, ids = (np.concatenate(x) for x in zip(*held))
            out.write(encode_section(keys, counts, ids))
            held.clear()

        try:
            for batch in batches:
                for part in slices(batch, "text"):
                    offsets, ids = enc.encode(part.column("text"), end)
                    keys = part.column("doc_id").fill_null(int(_NULL)).to_numpy(zero_copy_only=False)
                    if out is None:
                        fs, folder_path = file_system(data_dir)
                        fs.create_dir(folder_path, recursive=True)
                        # The attempt's own name: a second attempt of a task never touches the first one's file.
                        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.tok"
                        place = fs, posixpath.join(folder_path, f"_{name}.tmp"), posixpath.join(folder_path, name)
                        out = fs.open_output_stream(place[1])
                        out.write(MAGIC)
                        first = int(keys[0])
                    held.append((keys, np.diff(offsets), ids))
                    if sum(len(x[2]) for x in held) >= SECTION:
                        section()
                    docs_n, tokens_n = docs_n + len(keys), tokens_n + len(ids)
            if held:
                section()
        finally:
            if out is not None:
                out.close()
        if out is not None:
            place[0].move(place[1], place[2])
            order = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pylist([{"file": posixpath.join(data_dir, name), "part": order, "first": first, "n_docs": docs_n, "n_tokens": tokens_n}], schema=pa.schema([("file", pa.string()), ("part", pa.int64()), ("first", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    # Ranges by the text's hash too: rows that share an id (null, say) may be many, and then fill several files.
    key = ["doc_id", F.xxhash64("text")]
    ordered = narrow.repartitionByRange(files or shuffle_partitions(spark), *key).sortWithinPartitions(*key)
    ordered.mapInArrow(tidy(write), "file string, part long, first long, n_docs long, n_tokens long").write.parquet(manifest)
    return spark.read.parquet(manifest)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row per document, read from the files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""
    spark = manifest.sparkSession
    rows = sorted(manifest.collect(), key=lambda r: r.part)  # a row per file
    base, plan = 0, []
    for r in rows:
        plan.append((r.file, base))
        base += r.n_tokens
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not plan:
        return spark.createDataFrame([], schema)
    out_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches):
        for batch in batches:
            for uri, at in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                for doc_ids, counts, ids in read_sections(uri):
                    ends = np.cumsum(counts, dtype=np.int64)
                    data, starts = ids.tobytes(), ends - counts
                    binary = [data[4 * a : 4 * z] for a, z in zip(starts.tolist(), ends.tolist())]
                    keys = pa.array(doc_ids, mask=doc_ids == _NULL)
                    yield pa.RecordBatch.from_arrays([keys, pa.array(at + starts), pa.array(counts.astype(np.int64)), pa.array(binary, pa.binary())], schema=out_schema)
                    at += int(ends[-1]) if len(ends) else 0

    listing = spark.createDataFrame(plan, "file string, base long").repartition(len(plan))
    return listing.mapInArrow(tidy(read), schema)


def token_files_query(docs: DataFrame) -> DataFrame:
    """op6: write all documents, read the files back, and give each document's digest."""
    spark = docs.sparkSession
    rows = read_tokens(write_tokens(docs, scratch(spark, "tokens")))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
