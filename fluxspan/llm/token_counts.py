"""Token counts by a separator scan over flat token files that have no index.

Files are cut into blocks of equal size.  Each block is searched for end-of-document ids at once; a prefix scan over the
blocks of a file then gives each its number of documents before it and the tokens of the document it begins inside.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .encoder import encoder
from .token_store import Whole, _open

#: Tokens in a block, and blocks that a scanning task reads.
BLOCK_TOKENS, TASK_BLOCKS = 1 << 20, 16


def write_flat(docs: DataFrame, path: str, separator: int, words_apart: bool = False, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One flat file for each input partition: ids of all its documents, the separator after each.  No token has the
    separator's id, as strings of special tokens are encoded as plain text.

    Returns uri, ordinal (of the document in its file), doc_id, n_tokens_file (tokens in the file; on its last row only).
    Null text: no ids but the separator.  A partition without rows writes no file.
    """
    folder = folder or common.folder(docs.sparkSession)

    def work(batches):
        enc, part = encoder(path, words_apart, literal=True), TaskContext.get().partitionId()
        stop, uri = np.array([separator], enc.kind).tobytes(), f"{folder}/flat-{part:06d}.bin"
        out, rows = None, 0
        held = None  # the latest rows, until it is known whether they are the last
        for b in common.chunks(batches):
            out = out or Whole(uri, str(TaskContext.get().taskAttemptId()))
            out.write(b"".join(enc.encode(b.column("text").to_pylist(), stop)))
            if held is not None:
                yield held
            n = b.num_rows
            held = pa.RecordBatch.from_arrays([pa.array([uri] * n), pa.array(np.arange(rows, rows + n)), b.column("doc_id"), pa.array([None] * n, pa.int64())], ["uri", "ordinal", "doc_id", "n_tokens_file"])
            rows += n
        if out is not None:
            out.close()
            last = pa.array([None] * (held.num_rows - 1) + [out.size // enc.width], pa.int64())
            yield held.set_column(3, held.schema.field(3), last)

    return common.written(common.documents(docs, id_col, text_col).mapInArrow(work, "uri string, ordinal long, doc_id long, n_tokens_file long"))


def separator_scan(files: DataFrame, separator: int, width: int, block: int = BLOCK_TOKENS) -> DataFrame:
    """Tokens of every document in flat files: uri, ordinal, n_tokens (without the separator).

    files: uri, tokens.  Tokens after a file's last separator are a document of their own, if there are any.
    """
    blocks = files.select("uri", "tokens", F.explode(F.expr(f"sequence(0L, greatest(tokens - 1, 0L), {block}L)")).alias("at")).withColumn("n", F.least(F.lit(block), F.col("tokens") - F.col("at"))).where("n > 0")

    def work(batches):
        for b in batches:
            rows = []
            for uri, at, n in zip(b.column("uri").to_pylist(), b.column("at").to_pylist(), b.column("n").to_pylist(), strict=True):
                fs, name = _open(uri)
                with fs.open_input_file(name) as f:
                    f.seek(at * width)
                    ids = np.frombuffer(f.read(n * width), f"<u{width}")
                seps = np.flatnonzero(ids == separator)
                inner = (np.diff(seps) - 1).tolist()
                rows.append((uri, at, len(seps), int(seps[0]) if len(seps) else None, int(n - 1 - seps[-1]) if len(seps) else n, inner))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["uri", "at", "seps", "head", "tail", "inner"])

    # a given number of partitions, as adaptive execution would join those of so small a table
    tasks = max(1, (files.agg(F.sum(F.ceil(F.col("tokens") / block))).first()[0] or 0) // TASK_BLOCKS)
    found = blocks.repartition(int(tasks), "uri", "at").mapInArrow(work, "uri string, at long, seps long, head long, tail long, inner array<long>")
    order = Window.partitionBy("uri").orderBy("at")
    found = found.withColumn("before", F.sum("seps").over(order) - F.col("seps")).withColumn("era", F.sum(F.expr("cast(seps > 0 as int)")).over(order))
    found = found.withColumn("open", F.sum("tail").over(Window.partitionBy("uri", "era").orderBy("at")))
    found = found.withColumn("carry", F.coalesce(F.lag("open").over(order), F.lit(0))).withColumn("final", F.lead("at").over(order).isNull())
    closed = F.when(F.col("seps") > 0, F.concat(F.array(F.col("carry") + F.col("head")), F.col("inner"))).otherwise(F.array().cast("array<long>"))
    rest = F.when(F.col("final") & (F.col("open") > 0), F.array("open")).otherwise(F.array().cast("array<long>"))
    return found.select("uri", "before", F.posexplode(F.concat(closed, rest)).alias("k", "n_tokens")).select("uri", (F.col("before") + F.col("k")).alias("ordinal"), "n_tokens")


def token_counts(docs: DataFrame, path: str, separator: int, words_apart: bool = False, block: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_tokens of every document, counted in flat files that are written for it.

    One row for each input row, repeated ones too.  Null or empty text: 0.  An empty table gives no rows.
    """
    side = write_flat(docs, path, separator, words_apart)
    files = side.where("n_tokens_file is not null").select("uri", F.col("n_tokens_file").alias("tokens"))
    counts = separator_scan(files, separator, encoder(path, words_apart, literal=True).width, block)
    # the side table is far smaller as a file than in memory, so its file size must not make it a broadcast
    return side.select("uri", "ordinal", "doc_id").join(counts.hint("merge"), ["uri", "ordinal"], "left").select("doc_id", "n_tokens")
