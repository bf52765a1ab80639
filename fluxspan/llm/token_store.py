"""Token files of single documents: a shared zstandard dictionary, a frame for each document, and an offset index.

A file holds documents in order of their ids:

    magic | sha256 of the dictionary | frames | index | offset of the index, magic

The index has the width of an id in bytes, the number of documents, their ids, where each frame begins, and the tokens
before each document.  A short document is read by two small reads: the index, and its frame.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .encoder import encoder

MAGIC = b"ZTOKENS1"
#: Bytes of text, about, whose documents share a file; where that makes more than MOST_FILES, files are larger.
FILE_TEXT_BYTES, MOST_FILES = 16 << 20, 50_000
#: Bounds of the dictionary and of the sample that it is trained on: id arrays of documents up to SAMPLE_TEXT bytes, as the
#: dictionary serves short documents.
DICTIONARY_BYTES, SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_TEXT = 64 << 10, 2_000, 4 << 20, 32 << 10
#: Bytes of frames that a reader holds at once.
READ_BYTES = 8 << 20
#: Files whose tokens are summed together when documents are numbered.
SUM_FILES = 1000
NULL_ID = -(1 << 63)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class Whole:
    """A file that appears under its name only when it is complete, so that a repeated task replaces it."""

    def __init__(self, uri: str, attempt: str = ""):
        self.fs, self.path = _open(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part, self.size = f"{self.path}.{attempt}.part", 0
        self.out = self.fs.open_output_stream(self.part)

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        if self.fs.get_file_info(self.path).type != pafs.FileType.NotFound:
            self.fs.delete_file(self.path)  # of an earlier attempt; some stores don't move onto a file
        self.fs.move(self.part, self.path)


def put(uri: str, data: bytes) -> None:
    f = Whole(uri, uuid.uuid4().hex)  # attempts of one task write apart
    f.write(data)
    f.close()


def get(uri: str, start: int = 0, length: int | None = None) -> bytes:
    fs, path = _open(uri)
    with fs.open_input_file(path) as f:
        f.seek(start)
        return f.read(f.size() - start if length is None else length)


def train_dictionary(arrays: list[bytes]) -> bytes:
    """A zstandard dictionary of serialized id arrays; of too few arrays, their plain content."""
    if not arrays:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except zstandard.ZstdError:
        return b"".join(arrays)[-DICTIONARY_BYTES:]


def index_of(ids: list[int], sizes: list[int], counts: list[int], width: int) -> bytes:
    """What follows the frames of a file."""
    offsets = np.cumsum([0, *sizes]) + len(MAGIC) + 32
    parts = ([width, len(ids)], ids, offsets, np.cumsum([0, *counts]), offsets[-1:])
    return b"".join(np.asarray(p, "<i8").tobytes() for p in parts) + MAGIC


def read_index(uri: str) -> tuple[bytes, int, np.ndarray, np.ndarray, np.ndarray]:
    """Digest of the dictionary, width, document ids, frame offsets, token offsets of a file."""
    fs, path = _open(uri)
    with fs.open_input_file(path) as f:
        head = f.read(40)
        f.seek(f.size() - 16)
        tail = f.read(16)
        if head[:8] != MAGIC or tail[8:] != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        at = int(np.frombuffer(tail, "<i8", 1)[0])
        f.seek(at)
        index = f.read(f.size() - 16 - at)
    width, n = np.frombuffer(index, "<i8", 2).tolist()
    ids, offsets = np.frombuffer(index, "<i8", n, 16), np.frombuffer(index, "<i8", n + 1, 16 + 8 * n)
    return head[8:], width, ids, offsets, np.frombuffer(index, "<i8", n + 1, 24 + 16 * n)


def write_tokens(docs: DataFrame, path: str, end_id: int | None = 1, words_apart: bool = False, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and writes all documents; returns the manifest: shard, uri, docs, tokens, first_token.

    Documents are in ascending order of (id, hash of the text), null ids first; Spark's range partitioning deals them to
    files.  Each row is written and counted, rows that repeat another too.  Null or empty text: no ids but `end_id`.  An
    empty table gives an empty manifest.
    """
    spark: SparkSession = docs.sparkSession
    folder = folder or common.folder(spark)
    d = common.documents(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    stats = d.agg(F.sum(size).alias("b"), F.count_if(size <= SAMPLE_TEXT).alias("n"), F.sum(F.when(size <= SAMPLE_TEXT, size)).alias("short")).first()
    files = max(1, min(MOST_FILES, -(-(stats.b or 0) // FILE_TEXT_BYTES)))

    def coded(texts: list[bytes]) -> list[bytes]:
        enc = encoder(path, words_apart)
        return enc.encode(texts, b"" if end_id is None else np.array([end_id], enc.kind).tobytes())

    def sample(batches):
        for b in common.chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(coded(b.column("text").to_pylist()), pa.binary())], ["ids"])

    share = min(1.0, SAMPLE_DOCS / max(stats.n, 1), SAMPLE_BYTES / max(stats.short or 0, 1))
    arrays = [bytes(r.ids) for r in d.where(size <= SAMPLE_TEXT).sample(share, 5).limit(2 * SAMPLE_DOCS).mapInArrow(sample, "ids binary").collect()]
    words = train_dictionary(arrays)
    digest = hashlib.sha256(words).digest()
    put(f"{folder}/dictionary", words)

    def frames(batches):
        zd = zstandard.ZstdCompressionDict(words) if words else None
        z = zstandard.ZstdCompressor(level=3, dict_data=zd, write_content_size=True)
        for b in common.chunks(batches):
            ids = coded(b.column("text").to_pylist())
            width = encoder(path, words_apart).width
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), b.column("tie"), pa.array([len(x) // width for x in ids], pa.int64()), pa.array([z.compress(x) for x in ids], pa.binary())], ["doc_id", "mark", "tie", "n", "frame"])

    def write(batches):
        part, out, ids, sizes, counts = TaskContext.get().partitionId(), None, [], [], []
        uri = f"{folder}/part-{part:07d}.ztok"
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                out = Whole(uri, str(TaskContext.get().taskAttemptId()))
                out.write(MAGIC + digest)
            blobs = b.column("frame").to_pylist()
            out.write(b"".join(blobs))
            ids += b.column("doc_id").to_pylist()
            sizes += map(len, blobs)
            counts += b.column("n").to_pylist()
        if out is not None:
            out.write(index_of(ids, sizes, counts, encoder(path, words_apart).width))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([uri]), pa.array([len(ids)], pa.int64()), pa.array([sum(counts)], pa.int64())], ["shard", "uri", "docs", "tokens"])

    # the number of the row parts even repeated rows; the frames are a table, so that finding the ranges encodes nothing again
    coded_rows = common.written(d.withColumn("tie", F.monotonically_increasing_id()).mapInArrow(frames, "doc_id long, mark long, tie long, n long, frame binary"))
    order = ["doc_id", "mark", "tie"]
    ranges = coded_rows.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "n", "frame")
    manifest = common.written(ranges.mapInArrow(write, "shard int, uri string, docs long, tokens long"))
    common.discard(coded_rows)
    return numbered(manifest)


def numbered(manifest: DataFrame) -> DataFrame:
    """The manifest with first_token, the tokens in all files before: sums inside blocks of files, and over the blocks."""
    block = F.floor(F.col("shard") / SUM_FILES).cast("int").alias("block")
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = manifest.groupBy(block).agg(F.sum("tokens").alias("tokens")).select("block", before(Window.orderBy("block")).alias("base"))
    inside = manifest.select("*", block).withColumn("inside", before(Window.partitionBy("block").orderBy("shard")))
    return inside.join(blocks, "block").withColumn("first_token", F.col("base") + F.col("inside")).drop("block", "base", "inside")


def _read(manifest: DataFrame, made, schema: str) -> DataFrame:
    """made(ids of documents, tokens before each, arrays of unsigned 32-bit ids) -> columns, for stretches of all files.

    A task reads a few files, of each the index and then stretches of frames.
    """

    def work(batches):
        for b in batches:
            for uri, first in zip(b.column("uri").to_pylist(), b.column("first_token").to_pylist(), strict=True):
                words = get(f"{uri.rpartition('/')[0]}/dictionary")
                digest, width, ids, offsets, tokens = read_index(uri)
                if hashlib.sha256(words).digest() != digest:
                    raise ValueError(f"{uri} was written with another dictionary")
                z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
                lo = 0
                while lo < len(ids):
                    hi = min(max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + READ_BYTES))), lo + 2000, len(ids))
                    data = get(uri, int(offsets[lo]), int(offsets[hi] - offsets[lo]))
                    at = (offsets[lo : hi + 1] - offsets[lo]).tolist()
                    arrays = [np.frombuffer(z.decompress(data[x:y]), f"<u{width}").astype("<u4") for x, y in zip(at, at[1:], strict=False)]
                    doc = pa.array([None if i == NULL_ID else i for i in ids[lo:hi].tolist()], pa.int64())
                    columns = made(doc, pa.array(first + tokens[lo:hi]), arrays)
                    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
                    lo = hi

    # a given number of partitions, as adaptive execution would join those of so small a table
    tasks = max(1, manifest.agg(F.max("shard")).first()[0] or 0)
    return manifest.repartition(tasks, "shard").mapInArrow(work, schema)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """All documents of the files: doc_id, start (tokens before it in all files), ids (unsigned 32-bit).

    An empty manifest gives no rows.
    """
    made = lambda doc, start, arrays: {"doc_id": doc, "start": start, "ids": pa.array([x.tobytes() for x in arrays], pa.binary())}
    return _read(manifest, made, "doc_id long, start long, ids binary")


def read_document(uri: str, doc_id: int) -> list[int]:
    """One document's ids from the file that holds it: reads the index and a single frame."""
    fs, path = _open(uri)
    with fs.open_input_file(path) as f:
        f.seek(f.size() - 16)
        at = int(np.frombuffer(f.read(8), "<i8")[0])
        f.seek(at)
        index = f.read(f.size() - 16 - at)
        width, n = np.frombuffer(index, "<i8", 2).tolist()
        ids = np.frombuffer(index, "<i8", n, 16)
        k = int(np.searchsorted(ids, doc_id))
        if k == n or ids[k] != doc_id:
            raise KeyError(doc_id)
        lo, hi = np.frombuffer(index, "<i8", 2, 16 + 8 * n + 8 * k).tolist()
        f.seek(lo)
        frame = f.read(hi - lo)
    words = get(f"{uri.rpartition('/')[0]}/dictionary")
    z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    return np.frombuffer(z.decompress(frame), f"<u{width}").tolist()


def store_digests(docs: DataFrame, path: str, end_id: int = 1, words_apart: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, as the written files give them.

    One row for each input row: rows that repeat another are encoded, written and numbered like any.  Null or empty text: the
    end id alone.  An empty table gives no rows.
    """

    def made(doc, start, arrays):
        return {"doc_id": doc, "start": start, "n_tokens": pa.array(map(len, arrays), pa.int64()), "ids_crc32": pa.array(map(zlib.crc32, arrays), pa.int64())}

    return _read(write_tokens(docs, path, end_id, words_apart), made, "doc_id long, start long, n_tokens long, ids_crc32 long")
