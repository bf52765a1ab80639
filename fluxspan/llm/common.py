"""Helpers shared by the operators: reading documents, chunks of whole texts, shared storage."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import discard, folder, temporary, written  # noqa: F401

#: Bytes of text that one vectorised step inside a task takes at once.  A longer text is taken alone and whole.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, as bytes: what the tasks read."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))


def chunks(batches, limit: int = CHUNK_BYTES):
    """Arrow batches of (doc_id, text, ...) cut so that each holds about `limit` bytes of text; a null text becomes empty."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        batch = batch.set_column(at, batch.schema.field(at).with_nullable(True), pc.fill_null(batch.column(at), b""))
        ends = np.cumsum(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False).astype(np.int64))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each followed by a line feed; the start of each text, and the end of all."""
    data = np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return data, starts


def crc32_sql(digits: str) -> str:
    """SQL for the crc32 of a text, from a column with its bytes in hexadecimal digits: four bits in a step."""
    table = []
    for k in range(16):
        for _ in range(4):
            k = 0xEDB88320 ^ (k >> 1) if k & 1 else k >> 1
        table.append(k)
    value = "instr('0123456789ABCDEF', substr({d}, {at}, 1)) - 1"
    low, high = (value.format(d=digits, at=at) for at in ("i + 1", "i"))
    halves = f"flatten(list_transform(range(1, length({digits}), 2), lambda i: [{low}, {high}]))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {halves}::bigint[]), lambda c, x: xor(list_extract({table}::bigint[], (xor(c, x) & 15) + 1), c >> 4)), 4294967295::bigint)"


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of text in all rows, to size buckets by."""
    return docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x


#: Bytes that the vectorised word hash reads; longer words go through a library hash.
LONG_WORD = 64
_masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans at once, eight bytes of all spans in a step."""
    sizes = ends - starts
    h = (sizes + (seed << 40)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    if seed:
        h = mix(h)
    if not len(sizes):
        return h
    symbols = np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))).data, strides=(1,))
    h = mix(h ^ (symbols[starts] & _masks[np.minimum(sizes, 8)]))
    live = np.flatnonzero(sizes > 8)
    for depth in range(8, LONG_WORD, 8):
        if not len(live):
            break
        h[live] = mix(h[live] ^ (symbols[starts[live] + depth] & _masks[np.minimum(sizes[live] - depth, 8)]))
        live = live[sizes[live] > depth + 8]
    for k in live.tolist():
        digest = hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, key=bytes([seed])).digest()
        h[k] ^= np.uint64(int.from_bytes(digest, "little"))
    return h


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different strings among data[start:end]: where each first stands, and for each span the number of its string.

    Hashes bring equal strings together, their bytes are compared; should hashes collide, the strings decide.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, number = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    sizes, like = ends - starts, first[number]
    same = sizes == sizes[like]
    symbols = np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))).data, strides=(1,))
    live, depth = np.flatnonzero(like != np.arange(len(like))), 0
    while len(live) and same.all() and depth < LONG_WORD:
        mask = _masks[np.minimum(sizes[live] - depth, 8)]
        same[live] = (symbols[starts[live] + depth] & mask) == (symbols[starts[like[live]] + depth] & mask)
        depth += 8
        live = live[sizes[live] > depth]
    raw = data.tobytes() if len(live) or not same.all() else b""
    for k in live.tolist():
        same[k] &= raw[starts[k] : ends[k]] == raw[starts[like[k]] : ends[like[k]]]
    if same.all():
        return first, number
    seen: dict[bytes, int] = {}
    number = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    return np.unique(number, return_index=True)[1], number


def gathered(parts: list[bytes], number: np.ndarray) -> tuple[bytes, np.ndarray]:
    """parts[i] of every i in `number`, one after the other; and where each begins and the last ends."""
    if not len(number):
        return b"", np.zeros(1, np.int64)
    _, offsets, data = pa.array(parts, pa.large_binary()).take(pa.array(number)).buffers()
    return data.to_pybytes() if data else b"", np.frombuffer(offsets, np.int64, len(number) + 1)


class Recent:
    """What a worker remembers by word: two generations of at most `size` bytes of words each, so that memory is bounded and
    words that come often stay."""

    def __init__(self, size: int = 1 << 20):
        self.size, self.held, self.new, self.old = size, 0, {}, {}

    def __len__(self) -> int:
        return len(self.new) + len(self.old)

    def get(self, word: bytes):
        found = self.new.get(word)
        if found is None:
            found = self.old.get(word)
            if found is not None:
                self.put(word, found)
        return found

    def put(self, word: bytes, value) -> None:
        if self.held > self.size:
            self.old, self.new, self.held = self.new, {}, 0
        self.new[word] = value
        self.held += len(word)


_space = np.zeros(256, bool)
_space[[0x20, *range(9, 14)]] = True


def word_spans(data: np.ndarray, is_space: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array: runs of bytes that aren't white space (0x20, 0x09-0x0D)."""
    gap = (_space if is_space is None else is_space)[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(gap) and not gap[0]:
        edge = np.concatenate(([0], edge))
    if len(edge) % 2:
        edge = np.append(edge, len(data))
    return edge[0::2], edge[1::2]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive entries."""
    size, m = 1, x
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    n = len(x) - w + 1
    return m[:n] if size == w else np.minimum(m[:n], m[w - size : w - size + n])
