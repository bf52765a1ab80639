"""Suffix-array deduplication on bytes.

Suffixes are ordered by their leading bytes: splitters from a sample cut that order into ranges, each bucket sorts its
suffixes by multikey quicksort as far as a window reaches, and neighbours in that order tell which strings occur earlier.
Sending all suffixes would multiply the input a hundredfold, so suffixes travel in runs: those whose window contains
the same anchor (the smallest-hashed gram) are one packed string, placed by the suffix that begins at the anchor.  Equal
windows have equal anchors, so no pair of equal suffixes is separated by a border between ranges; a range with an anchor
too frequent for one bucket is cut into parts by text chunks, and the distinct suffixes of these parts, each ordered on its
own, are compared across the borders of the parts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .repeats import Method, Runs, Units, flat_spans, found_spans, keyed, with_spans
from .substring_dedup import anchored, leftmost_min

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def byte_method(size: int = 100, gram: int = 16) -> Method:
    none = np.zeros(0, np.int64)

    def runs(texts: list[bytes]) -> tuple[Units, Runs]:
        data = np.frombuffer(b"".join(texts) + bytes(16), np.uint8)
        units = Units(data, size, gram)
        lengths = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(lengths) - lengths
        windows = np.maximum(lengths - size + 1, 0)
        if not windows.sum():
            return units, Runs(none, none, none, none, none)
        where = leftmost_min(grams(units), size - gram + 1)
        if (windows > 0).all() and len(texts) == 1:
            valid, doc = np.arange(windows[0]), np.zeros(windows[0], np.int64)
        else:
            doc = np.repeat(np.arange(len(texts)), windows)
            total = np.cumsum(windows)
            valid = np.arange(total[-1]) + (starts - (total - windows))[doc]
        return units, anchored(valid, where[valid], doc, valid - starts[doc])

    def grams(units: Units) -> np.ndarray:
        symbols = np.ndarray(len(units.data) - 7, "<u8", np.ascontiguousarray(units.data).data, strides=(1,))
        n = len(units.data) - 16
        g = symbols[: n - gram + 1] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(8, gram, 8):
            g ^= g >> np.uint64(31)
            g += symbols[min(k, gram - 8) : n - gram + 1 + min(k, gram - 8)]
            g *= np.uint64(0xD6E8FEB86659FD93)
        g ^= g >> np.uint64(32)
        g *= np.uint64(0x2545F4914F6CDD1D)
        return g

    def deal(units, runs, anchors, splitters, buckets):
        """The range of the suffix that begins at the anchor; a range that stands for several buckets is dealt by anchors."""
        lead = np.ndarray(len(units.data) - 7, ">u8", np.ascontiguousarray(units.data).data, strides=(1,))[runs.unit + runs.anchor]
        range_ = np.searchsorted(splitters, lead.astype(np.uint64).view(np.int64) ^ np.int64(-(1 << 63)), side="right")
        each = max(1, buckets // (len(splitters) + 1))
        return range_ * each + (common.mix(anchors) % np.uint64(each)).astype(np.int64)

    def reread(data: bytes, n: np.ndarray, lengths: np.ndarray) -> tuple[Units, np.ndarray]:
        return Units(np.frombuffer(data + bytes(16), np.uint8), size, gram), np.cumsum(lengths) - lengths

    return Method(size, gram, runs, grams, deal, reread)


def suffix_dedup(docs: DataFrame, size: int = 100, gram: int = 16, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes each byte covered by a string of `size` bytes that also starts earlier (smaller id, or earlier in the text).

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed stretches), kept (the other bytes), kept_sha256.  Matches
    never cross documents.  Null or empty text: all counts are 0.  Different texts under one id count as different
    documents, in the order of a hash of the text.
    """
    d = keyed(docs, id_col, text_col)
    found = found_spans(d.select("doc_id", "mark", "text"), byte_method(size, gram), buckets)

    def work(batches):
        for b in common.chunks(batches):
            row, start, n = flat_spans(b)
            texts = b.column("text").to_pylist()
            removed, pieces, kept = [0] * len(texts), [0] * len(texts), texts
            if len(row):
                kept = list(texts)
                order = np.lexsort((start, row))
                row, start, end = row[order], start[order], (start + n + size - 1)[order]
                first = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
                for k in np.unique(row).tolist():
                    s, e = start[first[k] : first[k + 1]], np.maximum.accumulate(end[first[k] : first[k + 1]])
                    new = np.concatenate(([True], s[1:] > e[:-1]))
                    s, e = s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]
                    t, at, left = texts[k], 0, []
                    for x, y in zip(s.tolist(), e.tolist(), strict=True):
                        left.append(t[at:x])
                        at = y
                    left.append(t[at:])
                    kept[k] = b"".join(left)
                    removed[k], pieces[k] = len(t) - len(kept[k]), len(s)
            sha = [hashlib.sha256(t).hexdigest() for t in kept]
            cols = [pa.array(x, pa.int64()) for x in ([len(t) for t in texts], removed, pieces)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols, pa.array(kept, pa.binary()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return with_spans(d, found).mapInArrow(work, SCHEMA)
