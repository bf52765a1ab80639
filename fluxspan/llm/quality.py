"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown on histograms of a bounded sample of labelled documents, with monotonic constraints on chosen statistics,
then flattened into numpy node arrays; a task scores all documents of a chunk at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled documents that the trees are grown on: those with the smallest hashes of their ids.
TRAINING_ROWS = 20_000
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that the trees see, with the sign in which each may move the score (0: freely).
FEATURES = {"log_words": 0, "chars_per_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "bang_share": -1, "digit_share": 0, "twin_share": -1, "words_per_line": 0, "short_share": 0, "distinct_share": 0, "stop_share": 0}


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_symbols, _upper, _digits, _ends = _table(b"#*$%&|<>"), _table(bytes(range(65, 91))), _table(b"0123456789"), _table(b".!?")


def statistics(texts: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Base counts of each text, and the matrix of FEATURES.  Repeated 5-word windows are found by 64-bit hashes."""
    n = len(texts)
    data, starts = common.joined(texts)
    s, e = common.word_spans(data)
    doc = np.searchsorted(starts, s, side="right") - 1
    total = lambda mask: np.add.reduceat(mask.astype(np.int32), starts[:-1], dtype=np.int64) if n else np.zeros(0, np.int64)
    words = np.bincount(doc, minlength=n)
    points = (data & 0xC0) != 0x80
    word_chars = total(points & ~common._space[data])
    lines, dup_lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, t in enumerate(texts):
        if b"\n" in t:
            seen, all_lines, twice = set(), 0, 0
            for line in t.split(b"\n"):
                if line in seen:
                    twice += bool(line.split(None, 1))
                else:
                    seen.add(line)
                all_lines += 1
            lines[k], dup_lines[k] = all_lines, twice
    h = common.span_hashes(data, s, e)
    repeat = np.zeros(n, np.int64)
    if len(h) >= 5:
        g = h[:-4].copy()
        for k in range(1, 5):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - 4 + k]
        valid = np.flatnonzero(doc[4:] == doc[:-4])
        key = common.mix(common.mix(g[valid]) + doc[valid].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(valid), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        mark = np.zeros(len(h), np.int32)
        for k in range(5):
            mark[valid[twice] + k] = 1
        repeat = np.bincount(doc[mark > 0], minlength=n)
    symbols = total(_symbols[data])
    base = dict(zip(BASE, (words, word_chars, symbols, dup_lines, repeat), strict=True))
    twins = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=n) if len(h) else np.zeros(n)
    distinct = np.zeros(n)
    if len(h):
        order = np.lexsort((h, doc))
        first = np.ones(len(h), bool)
        first[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        distinct = np.bincount(doc[order][first], minlength=n)
    w, c = np.maximum(words, 1), np.maximum(word_chars, 1)
    short = np.bincount(doc[(e - s) <= 3], minlength=n)
    stops = total(_ends[data])
    x = np.column_stack([np.log1p(words), word_chars / w, symbols / c, dup_lines / np.maximum(lines, 1), repeat / w, total(_upper[data]) / c, total(data == 33) / w, total(_digits[data]) / c, twins / w, w / np.maximum(lines, 1), short / w, distinct / np.sqrt(w), stops / w])
    return base, x.astype(np.float64)


@dataclass
class Forest:
    """All trees in flat arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Of label 1, for each row."""
        if not len(self.roots) or not len(x):
            return np.full(len(x), 1 / (1 + np.exp(-self.bias)))
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.bias + self.value[at].sum(1))))


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 50, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 20) -> Forest:
    """Newton-boosted logistic trees on histograms.

    Constraints: a split whose children's values go against the sign is not taken, and their middle bounds all values below.
    With no rows or only one label the forest is empty and its bias says all (no rows: all are kept).
    """
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    if not len(y) or y.min() == y.max():
        ints, floats = np.zeros(0, np.int64), np.zeros(0)
        return Forest(ints, floats, ints, ints, floats, ints, depth, 5.0 if not len(y) or y[0] else -5.0)
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    binned = np.column_stack([np.searchsorted(ed, col, side="left") for ed, col in zip(edges, x.T, strict=True)])
    rate_of = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    bias = float(np.log(rate_of / (1 - rate_of)))
    score = np.full(len(y), bias)

    def leaf(v: float) -> int:
        k = len(feature)
        feature.append(0)
        threshold.append(np.inf)
        left.append(k)
        right.append(k)
        value.append(v)
        return k

    def build(rows, g, h, level, lo, hi) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        own = float(np.clip(-gs / (hs + ridge), lo, hi))
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for f, ed in enumerate(edges):
                if not len(ed):
                    continue
                b = binned[rows, f]
                k = len(ed) + 1
                cg, ch, cn = (np.cumsum(np.bincount(b, w, k))[:-1] for w in (g[rows], h[rows], None))
                vl, vr = np.clip(-cg / (ch + ridge), lo, hi), np.clip(-(gs - cg) / (hs - ch + ridge), lo, hi)
                gain = -(cg * vl + 0.5 * (ch + ridge) * vl**2) - ((gs - cg) * vr + 0.5 * (hs - ch + ridge) * vr**2) + (gs * own + 0.5 * (hs + ridge) * own**2)
                gain[(cn < least) | (len(rows) - cn < least) | (signs[f] * (vr - vl) < 0)] = -1
                j = int(np.argmax(gain))
                if gain[j] > best[0]:
                    best = (float(gain[j]), (f, j, float(vl[j]), float(vr[j])))
        if best[1] is None:
            return leaf(own * rate)
        f, j, vl, vr = best[1]
        k = leaf(0.0)
        feature[k], threshold[k] = f, float(edges[f][j])
        go = binned[rows, f] <= j
        mid = (vl + vr) / 2
        l_hi, r_lo = (min(hi, mid), max(lo, mid)) if signs[f] > 0 else (hi, lo)
        l_lo, r_hi = (max(lo, mid), min(hi, mid)) if signs[f] < 0 else (lo, hi)
        left[k] = build(rows[go], g, h, level + 1, l_lo, l_hi)
        right[k] = build(rows[~go], g, h, level + 1, r_lo, r_hi)
        return k

    every = np.arange(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(build(every, p - y, np.maximum(p * (1 - p), 1e-9), 0, -4.0, 4.0))
        f, t, lt, rt, v = (np.array(a) for a in (feature, threshold, left, right, value))
        at = np.full(len(y), roots[-1])
        for _ in range(depth):
            at = np.where(x[every, f[at]] <= t[at], lt[at], rt[at])
        score += v[at]
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), depth, bias)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", **grow_options) -> Forest:
    """Forest from at most `rows` labelled documents.

    Rows with a null id or label, or without a document, are left out; of several labels of one id the smallest counts, of
    several texts the one with the smallest hash.  With no label left all documents are kept, with labels of one kind all
    get that kind's verdict.
    """
    picked = labels.select(F.col(f"`{label_id}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y")).dropna().groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def work(batches):
        for b in common.chunks(batches):
            _, x = statistics(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), b.column("y"), *(pa.array(c) for c in x.T)], ["doc_id", "mark", "y", *FEATURES])

    schema = "doc_id long, mark long, y int, " + ", ".join(f"{f} double" for f in FEATURES)
    d = common.documents(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    each = d.join(F.broadcast(picked), "doc_id").select("doc_id", "mark", "y", "text").mapInArrow(work, schema)
    one = each.groupBy("doc_id").agg(F.min_by(F.struct("y", *FEATURES), "mark").alias("r")).select("r.*")
    got = one.toPandas()  # one row for each picked label: bounded by `rows`
    got = got.sort_values(list(got.columns), kind="stable")
    return grow(got[list(FEATURES)].to_numpy(float), got["y"].to_numpy(float), list(FEATURES.values()), **grow_options)


def verdicts(docs: DataFrame, forest: Forest, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, base_failed, quality (probability of label 1) and kept of every document.

    base_failed: under 10 words, or over 20 % of words in repeated 5-word windows.  kept: not base_failed, and quality of at
    least `least`.  Null or empty text: all counts 0, base_failed.
    """

    def work(batches):
        for b in common.chunks(batches):
            base, x = statistics(b.column("text").to_pylist())
            failed = (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])
            p = forest.probability(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(base[c], pa.int64()) for c in BASE), pa.array(failed), pa.array(~failed & (p >= least)), pa.array(p)], ["doc_id", *BASE, "base_failed", "kept", "quality"])

    return common.documents(docs, id_col, text_col).mapInArrow(work, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, quality double")


def keep_good(docs: DataFrame, forest: Forest, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that `verdicts` keeps, with all their columns: none with a null or empty text; repeated rows alike."""

    def work(batches):
        for b in batches:
            at = b.schema.get_field_index(text_col)
            small = pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), b.column(at).cast(pa.binary())], ["row", "text"])
            for c in common.chunks([small]):
                base, x = statistics(c.column("text").to_pylist())
                failed = (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])
                good = ~failed & (forest.probability(x) >= least)
                lo = c.column("row")[0].as_py()
                yield b.slice(lo, c.num_rows).filter(pa.array(good))

    return docs.mapInArrow(work, docs.schema)
