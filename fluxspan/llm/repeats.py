"""What the two substring operators share: order of byte strings, packed runs of windows, and the Spark stages.

A window is a fixed number of consecutive units (words or bytes) of one document.  Each window is assigned an anchor, the
leftmost smallest-hashed gram inside it, which depends on the window's content alone; consecutive windows with one anchor
form a run.  A run travels as one packed string to the bucket of its anchor, so equal windows always meet.

Before the shuffle each chunk of texts settles its own repeats and sends only windows that are its first.  Anchors that are
frequent in a sample are split twice: by a second gram that equal windows share, which parts a common gram's contexts; and
by chunks, whose parts settle first and pass on only their distinct windows, so that a passage that every chunk holds
meets in two steps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Packed bytes, about, that one bucket holds before compression.
BUCKET_BYTES = 24 << 20
#: Bytes of sampled text that splitters and frequent anchors are taken from: at least, and as a share of all text.
SAMPLE_BYTES, SAMPLE_SHARE = 8 << 20, 1 / 4096
#: Runs of an anchor in the sample from which on its share counts, ranges that leading bytes are cut into at most.
RECURS, RANGES = 4, 4096
NULL_ID = -(1 << 63)
#: zstandard level of packed runs: they are most of what the operators shuffle.
PACK_LEVEL = 4


def suffix_order(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings data[start:end], and whether each in that order equals its neighbour before.

    Multikey quicksort on 8-byte symbols: strings that differ so far are in place, and a group whose strings agree in the
    next symbol isn't sorted again.  Strings that are equal up to the end of the shorter are ordered by length.  `data` has
    at least 8 spare bytes at its end.
    """
    n = len(starts)
    same = np.zeros(n, bool)
    if n < 2:
        return np.arange(n), same
    symbols = np.ndarray(len(data) - 7, ">u8", np.ascontiguousarray(data).data, strides=(1,))
    lengths = ends - starts
    masks = np.array([0] + [((1 << 64) - 1) ^ ((1 << (8 * (8 - k))) - 1) for k in range(1, 9)], np.uint64)

    def symbol(idx: np.ndarray, depth: int) -> np.ndarray:
        at = np.minimum(starts[idx] + depth, len(symbols) - 1)
        return symbols[at].astype(np.uint64) & masks[np.clip(lengths[idx] - depth, 0, 8)]

    def cut(place: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of groups of two or more, and where these groups begin; new: marks the first of each group."""
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(place)))
        keep = np.repeat(sizes > 1, sizes)
        sizes = sizes[sizes > 1]
        return place[keep], np.cumsum(sizes) - sizes

    key = symbol(np.arange(n), 0)
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    place, heads = cut(np.arange(n), new)
    depth, longest = 8, int(lengths.max())
    while len(place):
        last = depth >= longest
        idx = order[place]
        key = lengths[idx].astype(np.uint64) if last else symbol(idx, depth)
        sizes = np.diff(np.append(heads, len(place)))
        alike = np.logical_and.reduceat(key == np.repeat(key[heads], sizes), heads)
        if not alike.all():
            new = np.zeros(len(place), bool)
            new[heads] = True
            part = np.flatnonzero(np.repeat(~alike, sizes))
            group = np.repeat(np.arange(len(heads)), sizes)[part]
            by = np.lexsort((key[part], group))
            order[place[part]], key[part] = idx[part][by], key[part][by]
            new[part[1:]] |= (key[part[1:]] != key[part[:-1]]) | (group[1:] != group[:-1])
            place, heads = cut(place, new)
        if last:
            break
        depth += 8
    if len(place):
        same[place] = True
        same[place[heads]] = False
    return order, same


def first_rank(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each string data[start:end] the smallest rank among all equal strings, which are neighbours in their order."""
    if not len(starts):
        return rank.copy()
    order, same = suffix_order(data, starts, ends)
    heads = np.flatnonzero(~same)
    out = np.empty(len(rank), rank.dtype)
    out[order] = np.repeat(np.minimum.reduceat(rank[order], heads), np.diff(np.append(heads, len(order))))
    return out


def ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[0]-1, 0, 1, ... counts[1]-1, ..."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - counts, counts)


@dataclass
class Runs:
    """Runs of windows: document, first unit in its document, windows, units from the first to the anchor; first unit in the chunk."""

    doc: np.ndarray
    start: np.ndarray
    n: np.ndarray
    anchor: np.ndarray
    unit: np.ndarray

    def take(self, at) -> Runs:
        return Runs(self.doc[at], self.start[at], self.n[at], self.anchor[at], self.unit[at])

    def pieces(self, keep: np.ndarray) -> Runs:
        """The runs without the windows that `keep` (a mask over all windows, run after run) leaves out."""
        if keep.all():
            return self
        run, pos = np.repeat(np.arange(len(self.n)), self.n)[keep], ramp(self.n)[keep]
        if not len(run):
            return self.take(np.zeros(0, np.int64))
        new = np.ones(len(run), bool)
        new[1:] = (run[1:] != run[:-1]) | (pos[1:] != pos[:-1] + 1)
        head = np.flatnonzero(new)
        r, p = run[head], pos[head]
        return Runs(self.doc[r], self.start[r] + p, np.diff(np.append(head, len(run))), self.anchor[r] - p, self.unit[r] + p)

    def split(self, marked: np.ndarray, value: np.ndarray) -> tuple[Runs, np.ndarray]:
        """Marked runs cut where `value`, of each window by its first unit in the chunk, changes; and each piece's value, 0 if
        not marked."""
        run, pos = np.repeat(np.arange(len(self.n)), self.n), ramp(self.n)
        each = np.where(marked[run], value[np.minimum(self.unit[run] + pos, len(value) - 1)], np.uint64(0))
        new = np.ones(len(run), bool)
        new[1:] = (run[1:] != run[:-1]) | (each[1:] != each[:-1])
        head = np.flatnonzero(new)
        r, p = run[head], pos[head]
        return Runs(self.doc[r], self.start[r] + p, np.diff(np.append(head, len(run))), self.anchor[r] - p, self.unit[r] + p), each[head]


@dataclass
class Units:
    """The units of a byte array and the length of a window and a gram in units."""

    data: np.ndarray  # with 8 spare bytes
    size: int
    gram: int
    starts: np.ndarray | None = None  # of words; None: the units are bytes
    ends: np.ndarray | None = None

    def begin(self, unit: np.ndarray) -> np.ndarray:
        return unit if self.starts is None else self.starts[unit]

    def end(self, unit: np.ndarray, size: int) -> np.ndarray:
        """Where `size` units from this one end."""
        return unit + size if self.ends is None else self.ends[unit + (size - 1)]

    def anchors(self, runs: Runs) -> np.ndarray:
        """A number that equal anchors share, from the ends and the length of the gram."""
        at = runs.unit + runs.anchor
        lo, hi = self.begin(at), self.end(at, self.gram)
        symbols = np.ndarray(len(self.data) - 7, "<u8", np.ascontiguousarray(self.data).data, strides=(1,))
        return common.mix(symbols[lo] ^ common.mix(symbols[np.maximum(hi - 8, 0)] * np.uint64(3) + (hi - lo).astype(np.uint64)))


def repeated(units: Units, runs: Runs, rank: np.ndarray) -> np.ndarray:
    """Mask over all windows, run after run: whether an equal window has a smaller rank.  rank: of each run's first window."""
    offset = np.cumsum(runs.n) - runs.n
    out = np.zeros(int(runs.n.sum()), bool)

    def shared(at: np.ndarray) -> np.ndarray:
        if len(at) < 2:
            return at[:0]
        _, where, count = np.unique(anchor[at], return_inverse=True, return_counts=True)
        return at[count[where] > 1]

    if len(runs.n) < 2:
        return out
    anchor = units.anchors(runs)
    some = shared(np.arange(len(runs.n)))
    if not len(some):
        return out
    u, n = runs.unit[some], runs.n[some]
    again = first_rank(units.data, units.begin(u), units.end(u + n - 1, units.size), rank[some]) < rank[some]
    whole = some[again]
    out[np.repeat(offset[whole], runs.n[whole]) + ramp(runs.n[whole])] = True
    some = shared(some[~again])
    if len(some):
        n = runs.n[some]
        step = ramp(n)
        u, r = np.repeat(runs.unit[some], n) + step, np.repeat(rank[some], n) + step
        twice = first_rank(units.data, units.begin(u), units.end(u, units.size), r) < r
        out[(np.repeat(offset[some], n) + step)[twice]] = True
    return out


def spans(runs: Runs, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches of marked windows: document, first window, windows; stretches of neighbouring runs are joined."""
    hit = runs.pieces(mask) if mask.any() else runs.take(np.zeros(0, np.int64))
    order = np.lexsort((hit.start, hit.doc))
    doc, start, n = hit.doc[order], hit.start[order], hit.n[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + n[:-1])
    head = np.flatnonzero(new)
    return doc[head], start[head], np.add.reduceat(n, head) if len(head) else n


def doc_ranks(ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Dense ranks of documents by id and then mark, as the high half of a window's rank."""
    order = np.lexsort((marks, ids))
    new = np.ones(len(ids), bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (marks[order][1:] != marks[order][:-1])
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(new)
    return out << 32


def pack(ids, marks, start, n, anchor, lengths, data: bytes) -> bytes:
    head = np.array([len(ids), len(data)], np.int64).tobytes()
    body = b"".join((np.diff(ids, prepend=0).tobytes(), marks.astype(np.int32).tobytes(), start.astype(np.int32).tobytes(), n.astype(np.int32).tobytes(), anchor.astype(np.int32).tobytes(), lengths.astype(np.int32).tobytes(), data))
    return zstandard.ZstdCompressor(level=PACK_LEVEL).compress(head + body)


def unpack(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    k, size = np.frombuffer(raw, np.int64, 2).tolist()
    at, out = 16, []
    for kind in (np.int64, *[np.int32] * 5):
        out.append(np.frombuffer(raw, kind, k, at).astype(np.int64))
        at += k * np.dtype(kind).itemsize
    out[0] = np.cumsum(out[0])
    return *out, raw[at : at + size]


def gather(data: np.ndarray, lo: np.ndarray, lengths: np.ndarray) -> bytes:
    """data[lo:lo+length] of all ranges, one after the other."""
    return data[np.repeat(lo, lengths) + ramp(lengths)].tobytes()


def packed(units: Units, size: int, runs: Runs, ids: np.ndarray, marks: np.ndarray) -> bytes:
    """The runs with their text; ids and marks: of their documents."""
    lo = units.begin(runs.unit)
    lengths = units.end(runs.unit + runs.n - 1, size) - lo
    return pack(ids, marks, runs.start, runs.n, runs.anchor, lengths, gather(units.data, lo, lengths))


@dataclass
class Method:
    """How an operator cuts texts into units and anchors, and deals anchors to buckets."""

    size: int  # units of a window
    gram: int  # units of an anchor
    #: texts -> units, runs; documents are numbered as given
    runs: Callable[[list[bytes]], tuple[Units, Runs]]
    #: units -> hash of the gram at each unit
    grams: Callable[[Units], np.ndarray]
    #: units, runs, anchors' numbers, splitters, buckets -> bucket of each run
    deal: Callable[[Units, Runs, np.ndarray, np.ndarray, int], np.ndarray]
    #: concatenated packed strings, windows of each run -> units, first unit of each run
    reread: Callable[[bytes, np.ndarray, np.ndarray], tuple[Units, np.ndarray]]

    def contexts(self, units: Units) -> np.ndarray:
        """For each unit the smallest of other hashes of the grams of the window that begins there."""
        g = common.mix(self.grams(units) ^ np.uint64(0x94D049BB133111EB))
        return common.sliding_min(g, self.size - self.gram + 1)


SENT = "bucket int, sub int, runs binary, done binary"
FOUND = "doc_id long, mark int, start int, n int"


def sample_of(docs: DataFrame, total: int, method: Method, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Splitters of leading bytes; sorted numbers of anchors that hold more than half a bucket, and how many buckets each fills.

    The sample grows with the input, and is counted where it lies.
    """
    share = min(1.0, max(SAMPLE_BYTES, total * SAMPLE_SHARE) / max(total, 1))

    def work(batches):
        for b in common.chunks(batches):
            units, runs = method.runs(b.column("text").to_pylist())
            anchors = units.anchors(runs) if len(runs.n) else np.zeros(0, np.uint64)
            at = runs.unit + runs.anchor
            lead = np.ndarray(len(units.data) - 7, ">u8", np.ascontiguousarray(units.data).data, strides=(1,))[units.begin(at)].astype(np.uint64) if len(at) else anchors
            yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(lead.view(np.int64) ^ np.int64(-(1 << 63))), pa.array(runs.n.astype(np.int64) + method.size)], ["anchor", "lead", "weight"])

    none = np.zeros(0, np.int64)
    if buckets < 2:
        return none, none.view(np.uint64), none
    got = docs.sample(share, 11).mapInArrow(work, "anchor long, lead long, weight long")
    rows = got.groupBy("anchor", "lead").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).persist()
    try:
        all_w = rows.agg(F.sum("w")).first()[0] or 0
        # each has more than half a bucket, so there are at most twice as many as buckets
        much = rows.groupBy("anchor").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).where((F.col("w") * 2 * buckets > all_w) & (F.col("n") >= RECURS)).orderBy("anchor").collect()
        ranges = min(buckets, RANGES)
        lead = rows.approxQuantile("lead", [k / ranges for k in range(1, ranges)], 0.25 / ranges) if all_w else []
    finally:
        rows.unpersist()
    hot = np.array([r.anchor for r in much], np.int64).view(np.uint64)
    fills = np.array([-(-r.w * buckets // all_w) for r in much], np.int64)
    order = np.argsort(hot)
    return np.array(sorted({int(x) for x in lead}), np.int64), hot[order], np.maximum(fills[order], 2)


def found_spans(docs: DataFrame, method: Method, buckets: int | None = None) -> DataFrame:
    """Stretches of windows that also start earlier: doc_id, mark, start, n (first window and number of windows).

    docs: doc_id (null as NULL_ID), mark (tells apart texts under one id), text as bytes.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = buckets or max(1, -(-int(total * 3.3) // BUCKET_BYTES))
    splitters, hot, fills = sample_of(docs, total, method, buckets)

    def send(batches):
        for number, b in enumerate(common.chunks(batches)):
            ids, marks = b.column("doc_id").to_numpy(), b.column("mark").to_numpy()
            units, runs = method.runs(b.column("text").to_pylist())
            ranks = doc_ranks(ids, marks)
            mask = repeated(units, runs, ranks[runs.doc] + runs.start)
            doc, start, n = spans(runs, mask)
            runs = runs.pieces(~mask)
            if len(doc):
                done = pack(ids[doc], marks[doc], start, n, n * 0, n * 0, b"")
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[doc[0]]) % buckets], pa.int32()), pa.array([0], pa.int32()), pa.array([None], pa.binary()), pa.array([done], pa.binary())], ["bucket", "sub", "runs", "done"])
            if not len(runs.n):
                continue
            anchors = units.anchors(runs)
            sub, salt = np.zeros(len(anchors), np.int64), np.zeros(len(anchors), np.int64)
            is_hot = np.isin(anchors, hot)
            if is_hot.any():
                runs, context = runs.split(is_hot, method.contexts(units))
                anchors = units.anchors(runs)
                at = np.minimum(np.searchsorted(hot, anchors), len(hot) - 1)
                is_hot = hot[at] == anchors
                parts = fills[at]
                salt = np.where(is_hot, (common.mix(context) % parts.astype(np.uint64)).astype(np.int64), 0)
                chunk = int(common.mix(np.array([TaskContext.get().partitionId() * 1_000_003 + number], np.uint64))[0] >> np.uint64(1))
                sub = np.where(is_hot, 1 + chunk % np.ceil(np.sqrt(parts)).astype(np.int64), 0)
            bucket = (method.deal(units, runs, anchors, splitters, buckets) + salt) % buckets
            order = np.lexsort((sub, bucket))
            bucket, sub, runs = bucket[order], sub[order], runs.take(order)
            head = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (sub[1:] != sub[:-1]))))
            blobs = []
            for x, y in zip(head.tolist(), [*head[1:].tolist(), len(bucket)], strict=True):
                part = runs.take(slice(x, y))
                blobs.append(packed(units, method.size, part, ids[part.doc], marks[part.doc]))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[head].astype(np.int32)), pa.array(sub[head].astype(np.int32)), pa.array(blobs, pa.binary()), pa.array([None] * len(blobs), pa.binary())], ["bucket", "sub", "runs", "done"])

    def settled(blobs: list[bytes]) -> tuple[tuple, Callable[[], bytes | None]]:
        """Repeated stretches among packed runs, and what packs the other windows again."""
        parts = [unpack(x) for x in blobs]
        ids, marks, start, n, anchor, lengths = (np.concatenate([p[k] for p in parts]) for k in range(6))
        data = b"".join(p[6] for p in parts)
        del parts
        units, unit = method.reread(data, n, lengths)
        runs = Runs(np.arange(len(ids)), start, n, anchor, unit)
        mask = repeated(units, runs, doc_ranks(ids, marks) + start)
        run, start, n = spans(runs, mask)
        left = runs.pieces(~mask)
        return (ids[run], marks[run], start, n), lambda: packed(units, method.size, left, ids[left.doc], marks[left.doc]) if len(left.n) else None

    def as_table(outs: list[tuple]) -> pa.Table:
        cols = [np.concatenate([o[k] for o in outs]) if outs else np.zeros(0, np.int64) for k in range(4)]
        return pa.table([pa.array(cols[0]), *(pa.array(c.astype(np.int32)) for c in cols[1:])], ["doc_id", "mark", "start", "n"])

    def settle(group: pa.Table) -> pa.Table:
        outs, rest = [unpack(x)[:4] for x in group.column("done").drop_null().to_pylist()], None
        runs = group.column("runs").drop_null().to_pylist()
        if runs:
            found, left = settled(runs)
            outs.append(found)
            rest = left() if group.column("sub")[0].as_py() else None
        t = as_table(outs)
        bucket = group.column("bucket")[0].as_py()
        t = t.append_column("bucket", pa.array([bucket] * t.num_rows, pa.int32())).append_column("rest", pa.array([None] * t.num_rows, pa.binary()))
        if rest is None:
            return t
        more = pa.table([pa.array([None], pa.int64()), *[pa.array([None], pa.int32())] * 3, pa.array([bucket], pa.int32()), pa.array([rest], pa.binary())], t.schema.names)
        return pa.concat_tables([t, more])

    def compare(group: pa.Table) -> pa.Table:
        return as_table([settled(group.column("rest").to_pylist())[0]])

    first = docs.mapInArrow(send, SENT).groupBy("bucket", "sub").applyInArrow(settle, FOUND + ", bucket int, rest binary")
    if not len(hot):
        return first.select("doc_id", "mark", "start", "n")
    # the distinct windows of the parts of frequent anchors are compared across the parts
    first = common.written(first)
    second = first.where("rest is not null").groupBy("bucket").applyInArrow(compare, FOUND)
    return first.where("rest is null").select("doc_id", "mark", "start", "n").union(second)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id with NULL_ID for null, a mark of the text, the text as bytes, and whether the id was null."""
    d = common.documents(docs, id_col, text_col)
    return d.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.expr("cast(pmod(xxhash64(text), 2147483647) as int)").alias("mark"), "text", F.col("doc_id").isNull().alias("no_id"))


def with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Each document with its stretches: columns starts and ns, null if it has none."""
    each = found.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "n")).alias("s"))
    return docs.join(each, ["doc_id", "mark"], "left").select(F.expr("if(no_id, null, doc_id)").alias("doc_id"), "text", F.col("s.start").alias("starts"), F.col("s.n").alias("ns"))


def flat_spans(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and n of all stretches of a batch."""
    lists = batch.column("starts")
    counts = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
    flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(counts)), counts), flat("starts"), flat("ns")


def covered(length: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the positions inside any [start, end)."""
    edge = np.zeros(length + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0
