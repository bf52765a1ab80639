"""MinHash near-deduplication: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

Documents with equal shingle sets are one node.  Each bucket links its nodes to one centre, so candidates are at most one
for each node and band, and full sets confirm them.  A bucket whose nodes then still lie in several components may hide a
link that no centre is part of.  There, sketches tell which nodes have a plausible partner in another component, and those
nodes alone are compared on full sets, block by block.  No pairs are emitted but links that join components, blocks are
bounded by bytes, and nothing depends on how large a bucket is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BANDS, ROWS = 40, 5
BINS = BANDS * ROWS
#: Chance, at most, that the sketches of two sets of just the wanted similarity rule them out.
SKETCH_RISK = 1e-9
#: Nodes whose sketches, and bytes of the sets, that a comparing task holds at once on either side.
BLOCK_NODES, BLOCK_BYTES = 1000, 8 << 20
#: Pairs of sketches that are compared in one step.
SLAB_PAIRS = 20_000
#: Texts whose bins are filled in one step.
SIGNED_TEXTS = 1000
NO_ID = (1 << 63) - 1

_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 32
#: For each bin the order in which an empty one looks at the others: a random permutation, alike for all documents.
_probes = np.argsort(np.random.default_rng(17).random((BINS, BINS)), axis=1)


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit hash) of each text's distinct word shingles, sorted.  A text of fewer words, but not none, has one."""
    data, starts = common.joined(texts)
    data = _lower[data]
    s, e = common.word_spans(data) if len(data) else (np.zeros(0, np.int64),) * 2
    doc = np.searchsorted(starts, s, side="right") - 1
    words = np.bincount(doc, minlength=len(texts))
    h = common.span_hashes(data, s, e)
    n = max(len(h) - size + 1, 0)
    g = h[:n].copy()
    for k in range(1, size):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[k : n + k]
    valid = doc[size - 1 :] == doc[:n] if n else np.zeros(0, bool)
    owner, value = doc[:n][valid], common.mix(g[valid])
    few = np.flatnonzero((words > 0) & (words < size))
    if len(few):
        first = np.cumsum(words) - words
        extra = [hash_sequence(h[first[k] : first[k] + words[k]]) for k in few.tolist()]
        owner, value = np.concatenate((owner, few)), np.concatenate((value, np.array(extra, np.uint64)))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def sketch_floors(percent: int) -> np.ndarray:
    """Smallest number of equal bins, by the number of bins that either set fills, that leaves a similarity possible.

    Of the bins that the union fills, those whose smallest hash both sets share are a sample without replacement, so
    Chernoff's bound exp(-n KL(x || p)) holds for a share x below p: rarer than SKETCH_RISK is ruled out.
    """
    p, floors = percent / 100, np.zeros(BINS + 1, np.int64)
    for n in range(1, BINS + 1):
        k = np.arange(int(np.floor(n * p)) + 1)
        x = k / n
        kl = np.where(k > 0, x * np.log(np.maximum(x, 1e-300) / p), 0) + np.where(k < n, (1 - x) * np.log(np.maximum(1 - x, 1e-300) / max(1 - p, 1e-300)), 0)
        may = np.flatnonzero(n * kl < -np.log(SKETCH_RISK))
        floors[n] = may[0] if len(may) else n
    return floors


def hash_sequence(h: np.ndarray) -> int:
    x = len(h)
    for v in h.tolist():
        x = (x * 0x9E3779B97F4A7C15 + v) % (1 << 64)
    return x


def minima(owner: np.ndarray, value: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """One-permutation MinHash of each text, (texts, BINS): as hashed, and with empty bins filled from the first full bin
    that they look at.  A text without shingles stays empty."""
    empty = np.uint64((1 << 64) - 1)
    m = np.full(texts * BINS, empty, np.uint64)
    v = common.mix(value ^ np.uint64(0x5851F42D4C957F2D))
    np.minimum.at(m, owner * BINS + (value >> np.uint64(33)).astype(np.int64) % BINS, v)
    bare, full = m.reshape(texts, BINS), m != empty
    filled, todo = m.copy(), np.flatnonzero(~full & np.repeat(full.reshape(texts, BINS).any(1), BINS))
    for step in range(BINS):
        if not len(todo):
            break
        bin_ = todo % BINS
        pick = todo - bin_ + _probes[bin_, step]
        hit = full[pick]
        filled[todo[hit]] = m[pick[hit]]
        todo = todo[~hit]
    return bare, filled.reshape(texts, BINS)


SIGNED = "doc_id long, mark long, n_shingles int, node long, sketch binary, bands array<long>"


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """Of each document: number of shingles, hash of its set (its node), a byte of each minimum (0: empty), band keys (none if empty)."""

    def work(batches):
        for b in (c.slice(lo, SIGNED_TEXTS) for c in common.chunks(batches, 2 << 20) for lo in range(0, c.num_rows, SIGNED_TEXTS)):
            n = b.num_rows
            owner, value = shingle_sets(b.column("text").to_pylist(), size)
            count = np.bincount(owner, minlength=n)
            node = np.zeros(n, np.uint64)
            np.add.at(node, owner, common.mix(value ^ np.uint64(0xA0761D6478BD642F)))
            node = common.mix(node + count.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
            bare, m = minima(owner, value, n)
            byte = (common.mix(bare) >> np.uint64(40)) % np.uint64(255) + np.uint64(1)
            sketch = np.where(bare == np.uint64((1 << 64) - 1), 0, byte).astype(np.uint8)
            g = m.reshape(n, BANDS, ROWS)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS)).copy()
            for k in range(ROWS):
                key = common.mix(key * np.uint64(0x9E3779B97F4A7C15) + g[:, :, k])
            have = count > 0
            offsets = np.concatenate(([0], np.cumsum(have * BANDS))).astype(np.int32)
            bands = pa.ListArray.from_arrays(offsets, pa.array(key[have].view(np.int64).ravel()), mask=pa.array(~have))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(count.astype(np.int32)), pa.array(node.view(np.int64)), pa.array([r.tobytes() for r in sketch], pa.binary()), bands], ["doc_id", "mark", "n_shingles", "node", "sketch", "bands"])

    return docs.mapInArrow(work, SIGNED)


def components(links: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) of all nodes in `links` (a, b).

    Each round hooks every node to its smallest neighbour, if that is smaller, and merges what is hooked together; links
    inside a merged node go, so the rounds' tables shrink.
    """
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    edges = common.written(links.select(*ends).where("a != b").distinct())
    nodes = common.written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("comp", F.col("node")))
    while edges.limit(1).count():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        hooked = common.written(both.groupBy(F.col("a").alias("x")).agg(F.least(F.min("b"), F.col("a")).alias("y")))
        jump = common.written(hooked.join(hooked.select(F.col("x").alias("y"), F.col("y").alias("z")), "y").select("x", "z"))
        moved = common.written(nodes.join(jump.withColumnRenamed("x", "comp"), "comp", "left").select("node", F.coalesce("z", "comp").alias("comp")))
        left = edges.join(jump.select(F.col("x").alias("a"), F.col("z").alias("za")), "a").join(jump.select(F.col("x").alias("b"), F.col("z").alias("zb")), "b")
        fewer = common.written(left.where("za != zb").select(F.least("za", "zb").alias("a"), F.greatest("za", "zb").alias("b")).distinct())
        for old in (edges, nodes, hooked, jump):
            common.discard(old)
        edges, nodes = fewer, moved
    return nodes


def _whole_groups(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches cut so that no group is parted."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        if not t.num_rows:
            continue
        last = np.ones(t.num_rows, bool)
        for k in keys:
            c = t.column(k).to_numpy()
            last &= c == c[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut)
    if held is not None:
        yield held


class Sketches:
    """What decides without full sets whether two nodes may be similar: sizes, sketches, and a shared bucket.

    `band` of a row is the band of the bucket that it stands for, or -1 for all its buckets.
    """

    def __init__(self, t: pa.Table, percent: int, floors: np.ndarray):
        self.n, self.band = t.column("n_shingles").to_numpy(), t.column("band").to_numpy()
        self.sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
        self.bands = t.column("all_bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        self.percent, self.floors = percent, floors

    def plausible(self, a: np.ndarray, b: np.ndarray, first: int | None = None) -> np.ndarray:
        """For many pairs of rows.  first: the band that must be the first which they share; None: as their rows say."""
        ok = 100 * np.minimum(self.n[a], self.n[b]) >= self.percent * np.maximum(self.n[a], self.n[b])
        a, b = a[ok], b[ok]
        one, other = self.sketch[a], self.sketch[b]
        may = ((one == other) & (one > 0)).sum(1) >= self.floors[((one > 0) | (other > 0)).sum(1)]
        ok[ok] = may
        a, b = a[may], b[may]
        equal = self.bands[a] == self.bands[b]
        at = equal.argmax(1)
        ok[ok] = equal.any(1) & ((self.band[a] < 0) | (at == self.band[a])) if first is None else at == first
        return ok


def active_nodes(rows: DataFrame, percent: int) -> DataFrame:
    """unit, node: nodes that have, in a bucket, a plausible partner in another component, each pair in its first common bucket.

    rows: unit, i, j (block), side (0: compared with all of side 1), node, comp, n_shingles, sketch, all_bands, band.
    """
    floors, keys = sketch_floors(percent), ["unit", "i", "j"]

    def work(batches):
        for t in _whole_groups(batches, keys):
            unit, i, j, side, node, comp = (t.column(c).to_numpy() for c in (*keys, "side", "node", "comp"))
            sketches = Sketches(t, percent, floors)
            new = np.concatenate(([True], (unit[1:] != unit[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            group = common.mix(np.cumsum(new).astype(np.uint64))
            live = np.zeros(len(node), bool)
            for band in range(BANDS):
                use = (sketches.band < 0) | (sketches.band == band)
                lefts, rights = np.flatnonzero(use & (side == 0)), np.flatnonzero(use & (side == 1))
                key = common.mix(sketches.bands[:, band].view(np.uint64) ^ group)
                rights = rights[np.argsort(key[rights])]
                lo, hi = (np.searchsorted(key[rights], key[lefts], side=x) for x in ("left", "right"))
                total = np.cumsum(hi - lo)
                at = 0
                while at < len(lefts):
                    to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLAB_PAIRS, side="right")))
                    count = (hi - lo)[at:to]
                    a = np.repeat(lefts[at:to], count)
                    b = rights[np.repeat(lo[at:to] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
                    at = to
                    apart = comp[a] != comp[b]
                    a, b = a[apart], b[apart]
                    ok = sketches.plausible(a, b, band)
                    live[a[ok]] = live[b[ok]] = True
            yield pa.RecordBatch.from_arrays([pa.array(unit[live]), pa.array(node[live])], ["unit", "node"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(work, "unit long, node long").distinct()


def compared(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes of different components.

    rows: those of `active_nodes`, and items (hashes, sorted unsigned).
    """
    floors = sketch_floors(percent)

    def compare(group: pa.Table) -> pa.Table:
        sketches = Sketches(group, percent, floors)
        side, node, cls = (group.column(c).to_numpy() for c in ("side", "node", "comp"))
        items = group.column("items").combine_chunks()
        flat, at = items.values.to_numpy().view(np.uint64), items.offsets.to_numpy().astype(np.int64)
        n, cls = np.diff(at), np.unique(cls, return_inverse=True)[1]
        right, links = np.flatnonzero(side == 1), []
        for k in np.flatnonzero(side == 0).tolist():
            r = right[cls[right] != cls[k]]
            r = r[sketches.plausible(np.full(len(r), k), r)]
            own = flat[at[k] : at[k + 1]]
            while len(r):
                some, r = r[:64], r[64:]
                ends = np.cumsum(n[some])
                theirs = flat[np.repeat(at[some] - (ends - n[some]), n[some]) + np.arange(ends[-1])]
                found = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
                both = np.add.reduceat(found.astype(np.int64), ends - n[some])
                for x in some[100 * both >= percent * (n[some] + n[k] - both)].tolist():
                    if cls[x] != cls[k]:
                        links.append((int(node[k]), int(node[x])))
                        cls[cls == cls[x]] = cls[k]
                r = r[cls[r] != cls[k]]
        return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], ["a", "b"])

    return rows.groupBy("unit", "i", "j").applyInArrow(compare, "a long, b long")


def _blocks(rows: DataFrame, unit: str, weight: str, most: int, main: DataFrame) -> DataFrame:
    """Rows as both sides of their unit's blocks, side 0 without the unit's main component.  Sides are cut by total weight."""
    w = F.col(weight)
    sums = rows.join(main, unit).groupBy(unit).agg(F.first("main").alias("main"), F.ceil(F.sum(F.when(F.col("comp") != F.col("main"), w).otherwise(0)) / most).cast("int").alias("left"), F.ceil(F.sum(w) / most).cast("int").alias("right")).where("left > 0")
    here = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    all_ = rows.join(sums, unit)
    lefts = all_.where("comp != main").withColumns({"i": F.pmod(here, F.col("left")).cast("int"), "j": F.explode(F.expr("sequence(0, right - 1)")), "side": F.lit(0)})
    rights = all_.withColumns({"j": F.pmod(here, F.col("right")).cast("int"), "i": F.explode(F.expr("sequence(0, left - 1)")), "side": F.lit(1)})
    return lefts.drop("main", "left", "right").unionByName(rights.drop("main", "left", "right"))


def _main(rows: DataFrame, unit: str) -> DataFrame:
    """The component with the most rows of each unit that has several."""
    sizes = rows.groupBy(unit, "comp").agg(F.count("*").alias("n"))
    return sizes.groupBy(unit).agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")


def near_classes(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept (doc_id = component_id).

    Linked: Jaccard similarity of the sets of lower-cased (A-Z) word shingles of at least `percent` %.  Null or empty text:
    an empty set, linked with nothing.  Rows under one id are linked by their texts like others, each keeps its own count;
    a null id is never the smallest while its component has another, and is kept only if it has none.
    """
    return _marked(docs, size, percent, id_col, text_col).drop("mark")


def _mark(text: str) -> str:
    """SQL of a text's hash, which tells the texts under one id apart."""
    return f"xxhash64(cast({text} as binary))"


def _marked(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """`near_classes` with the hash of each text (mark)."""
    d = common.documents(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.expr(_mark("text")).alias("mark"), "text")
    sig = common.written(signatures(d, size))
    # nodes: sets that differ
    first = sig.where("bands is not null").groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("f"))
    nodes = first.select("node", F.col("f.doc_id").alias("doc_id"), F.col("f.mark").alias("mark"))
    reps = sig.join(nodes, ["node", "doc_id", "mark"]).dropDuplicates(["node"])
    members = common.written(reps.select("node", F.posexplode("bands").alias("band", "key")))
    keys = members.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre != last").drop("last")
    inside = common.written(members.join(keys, "key"))
    stars = common.written(inside.where("node != centre").groupBy("node", "centre").agg(F.count("*").alias("shared")))
    wanted = nodes.join(stars.select("node").union(stars.select("centre")).distinct(), "node")

    def set_rows(batches):
        for b in common.chunks(batches):
            owner, value = shingle_sets(b.column("text").to_pylist(), size)
            offsets = np.searchsorted(owner, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.ListArray.from_arrays(offsets, pa.array(value.view(np.int64)))], ["node", "items"])

    sets = common.written(d.join(wanted, ["doc_id", "mark"]).dropDuplicates(["node"]).select("node", "text").mapInArrow(set_rows, "node long, items array<long>"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that are similar enough, by their full sets."""
        x = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
        both = x.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
        may = both.where(f"100 * least(size(x), size(y)) >= {percent} * greatest(size(x), size(y))")
        return may.where(f"{100 + percent} * size(array_intersect(x, y)) >= {percent} * (size(x) + size(y))").select("a", "b")

    def labelled(df: DataFrame, comp: DataFrame, col: str, out: str) -> DataFrame:
        return df.join(comp.select(F.col("node").alias(col), F.col("comp").alias(out)), col, "left").withColumn(out, F.coalesce(out, col))

    best = stars.groupBy("node").agg(F.max_by("centre", F.struct("shared", "centre")).alias("b")).withColumnRenamed("node", "a")
    links = common.written(confirmed(best))
    comp = components(links)
    rest = stars.select(F.col("node").alias("a"), F.col("centre").alias("b")).join(best, ["a", "b"], "left_anti")
    rest = labelled(labelled(rest, comp, "a", "ca"), comp, "b", "cb").where("ca != cb").select("a", "b")
    more = common.written(confirmed(rest))
    if more.limit(1).count():
        links = links.union(more)
        comp = components(links)
    # what is left: clusters of candidates whose nodes still lie in several components
    across = labelled(labelled(stars.select(F.col("node").alias("a"), F.col("centre").alias("b")), comp, "a", "ca"), comp, "b", "cb").where("ca != cb")
    merged = components(across.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()).select(F.col("node").alias("comp"), F.col("comp").alias("cluster"))
    clusters = labelled(wanted.select("node"), comp, "node", "comp").join(merged, "comp")
    main = _main(clusters, "cluster")
    sizes = clusters.join(main, "cluster").groupBy("cluster").agg(F.count("*").alias("all"), F.count_if(F.col("comp") != F.col("main")).alias("left"))
    # either all nodes of a cluster meet block by block, or those of each of its buckets: whichever takes fewer rows
    by_blocks = F.col("all") * F.ceil(F.col("left") / BLOCK_NODES) + F.col("left") * F.ceil(F.col("all") / BLOCK_NODES)
    open_nodes = common.written(clusters.join(sizes.select("cluster", (by_blocks <= 2 * BANDS * F.col("all")).alias("whole")), "cluster"))
    near = open_nodes.where("whole").select(F.col("cluster").alias("unit"), F.lit(-1).alias("band"), "node", "comp")
    details = reps.select("node", "n_shingles", "sketch", F.col("bands").alias("all_bands"))
    if open_nodes.where("not whole").limit(1).count():
        # a bucket, and in it sizes that allow the similarity: one class and its neighbours
        steps = F.floor(F.log("n_shingles") / float(np.log(100 / min(percent, 99)))).cast("int")
        placed = open_nodes.where("not whole").join(inside.select("key", "band", "node"), "node").join(reps.select("node", steps.alias("cls")), "node")
        placed = placed.withColumn("at", F.explode(F.array(F.col("cls"), F.col("cls") + 1))).withColumn("unit", F.xxhash64("key", "at"))
        near = near.union(placed.select("unit", "band", "node", "comp"))
    near = common.written(near.join(_main(near, "unit").select("unit"), "unit").join(details, "node"))
    cols = ["unit", "i", "j", "side", "node", "comp", "n_shingles", "band", "sketch", "all_bands"]
    blocks = _blocks(near.withColumn("one", F.lit(1)), "unit", "one", BLOCK_NODES, _main(near, "unit"))
    active = common.written(active_nodes(blocks.select(*cols), percent))
    again = near.join(active, ["unit", "node"]).join(sets, "node").withColumn("bytes", F.expr("8 * size(items) + 600"))
    last = common.written(compared(_blocks(again, "unit", "bytes", BLOCK_BYTES, _main(again, "unit")).select(*cols, "items"), percent))
    if last.limit(1).count():
        comp = components(links.union(last))
    ids = sig.groupBy("node").agg(F.min("doc_id").alias("least_id"))
    ids = labelled(ids, comp, "node", "comp")
    least = ids.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    by_node = ids.join(least, "comp").select("node", "component_id")
    bare = F.expr("bands is null")
    out = sig.where(~bare).join(by_node, "node").select("doc_id", "mark", "n_shingles", "component_id").union(sig.where(bare).select("doc_id", "mark", "n_shingles", F.col("doc_id").alias("component_id")))
    real = lambda c: F.expr(f"nullif({c}, {NO_ID})").alias(c)
    return out.select(real("doc_id"), "mark", F.col("n_shingles").cast("long").alias("n_shingles"), real("component_id"), F.expr("doc_id = component_id").alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that `near_classes` keeps, with all their columns."""
    gone = _marked(docs, size, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias("_gone"), F.col("mark").alias("_gone_mark")).distinct()
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_gone")) & F.expr(_mark(f"`{text_col}`")).eqNullSafe(F.col("_gone_mark"))
    return docs.join(gone, same, "left_anti")
