"""Substring deduplication on words: super-k-mer partitioning by minimisers.

Consecutive windows of words that share a minimiser (the smallest-hashed gram of `gram` words in the window) travel as one
packed string, the words joined by blanks, to the minimiser's bucket.  There multikey quicksort brings equal windows
together, so which windows start earlier elsewhere is counted exactly, on the words' bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .repeats import Method, Runs, Units, covered, flat_spans, found_spans, keyed, with_spans

SCHEMA = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"


def anchored(valid: np.ndarray, where: np.ndarray, doc: np.ndarray, start: np.ndarray) -> Runs:
    """Runs of windows with one anchor.  valid: the windows' first units; where: the anchor's unit of each; start: the first unit in its document."""
    new = np.ones(len(valid), bool)
    new[1:] = (where[1:] != where[:-1]) | (valid[1:] != valid[:-1] + 1) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    return Runs(doc[head], start[head], np.diff(np.append(head, len(valid))), where[head] - valid[head], valid[head])


def leftmost_min(h: np.ndarray, w: int) -> np.ndarray:
    """Where the leftmost smallest of each w consecutive hashes is."""
    tagged = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    return (common.sliding_min(tagged, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def word_method(size: int = 20, gram: int = 4) -> Method:
    none = np.zeros(0, np.int64)

    def runs(texts: list[bytes]) -> tuple[Units, Runs]:
        data, text_starts = common.joined(texts)
        s, e = common.word_spans(data) if len(data) else (none, none)
        # words and single blanks only: then equal windows are equal strings
        keep = np.zeros(len(data) + 1, bool)
        edge = np.zeros(len(data) + 1, np.int8)
        edge[s], edge[e] = 1, -1
        keep[:] = np.cumsum(edge, dtype=np.int8) > 0
        keep[e] = True
        plain = np.append(data, np.uint8(32))
        plain[e] = 32
        plain = np.concatenate((plain[keep], np.zeros(16, np.uint8)))
        lengths = e - s
        starts = np.cumsum(lengths + 1) - lengths - 1
        units = Units(plain, size, gram, starts, starts + lengths)
        if len(s) < size:
            return units, Runs(none, none, none, none, none)
        doc = np.searchsorted(text_starts, s, side="right") - 1
        where = leftmost_min(grams(units), size - gram + 1)
        last = np.arange(len(s) - size + 1) + size - 1
        valid = np.flatnonzero(doc[last] == doc[: len(last)])
        first_word = np.searchsorted(s, text_starts[:-1])
        d = doc[valid]
        return units, anchored(valid, where[valid], d, valid - first_word[d])

    def grams(units: Units) -> np.ndarray:
        h = common.span_hashes(units.data[:-16], units.starts, units.ends)
        g = h[: len(h) - gram + 1].copy()
        for k in range(1, gram):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - gram + 1 + k]
        return common.mix(g)

    def deal(units, runs, anchors, splitters, buckets):
        return (common.mix(anchors) % np.uint64(buckets)).astype(np.int64)

    def reread(data: bytes, n: np.ndarray, lengths: np.ndarray) -> tuple[Units, np.ndarray]:
        flat = np.frombuffer(data, np.uint8)
        ends_of_runs = np.cumsum(lengths)
        # runs follow each other without blanks, so a word ends at a blank or at a run's end
        blank = np.flatnonzero(flat == 32)
        ends = np.sort(np.concatenate((blank, ends_of_runs)))
        starts = np.sort(np.concatenate((blank + 1, ends_of_runs - lengths)))
        words = n + size - 1
        return Units(np.concatenate((flat, np.zeros(16, np.uint8))), size, gram, starts, ends), np.cumsum(words) - words

    return Method(size, gram, runs, grams, deal, reread)


def substring_dedup(docs: DataFrame, size: int = 20, gram: int = 4, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes each word covered by a window of `size` words that also starts earlier (smaller id, or earlier in the text).

    Returns doc_id, n_words, n_removed, kept (the other words joined by one blank), kept_sha256.  Words are runs of bytes
    other than white space (0x20, 0x09-0x0D).  Null or empty text: no words, kept is empty.  Texts shorter than a window
    lose nothing.  Different texts under one id count as different documents, in the order of a hash of the text.
    """
    d = keyed(docs, id_col, text_col)
    found = found_spans(d.select("doc_id", "mark", "text"), word_method(size, gram), buckets)

    def work(batches):
        for b in common.chunks(batches):
            row, start, n = flat_spans(b)
            first = np.searchsorted(row, np.arange(b.num_rows + 1)).tolist()
            texts, out = b.column("text").to_pylist(), []
            for k, t in enumerate(texts):
                words, removed = t.split(), 0
                total = len(words)
                if first[k] < first[k + 1]:
                    at = slice(first[k], first[k + 1])
                    mask = covered(total, start[at], start[at] + n[at] + size - 1).tolist()
                    words = [w for w, m in zip(words, mask, strict=True) if not m]
                    removed = total - len(words)
                kept = b" ".join(words)
                out.append((total, removed, kept, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()).cast(pa.string()), pa.array(cols[3], pa.string())], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return with_spans(d, found).mapInArrow(work, SCHEMA)
