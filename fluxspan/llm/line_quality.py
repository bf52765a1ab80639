"""Quality of documents from their lines: a linear-chain conditional random field labels each line good or bad.

A line's evidence comes from binned statistics of itself and of its neighbours; transitions tie adjacent labels.  Marginals by
forward-backward sums, weighted by the lines' lengths, make the document's share of good text, which a logistic curve turns
into a probability.  Forward and backward sums are products of 2 x 2 matrices, so all documents of a chunk go through in
doubling steps, whatever their numbers of lines.

Labels belong to documents.  Training starts with every line under its document's label; lines of bad documents that the
field then finds good are relabelled, unless none would be left bad, and the field is fitted again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, quality

#: Labelled documents of each label that the field is fitted on, at most: those with the smallest hashes of their ids.
TRAINING_TEXTS = 2_000
#: Documents of more lines are not trained on, so that the driver holds a bounded number of lines.
TRAINING_LINES = 2_000
#: Bins of each statistic, and rounds of relabelling.
BINS, ROUNDS = 12, 2
#: Statistics of a line; `twin_line` is 1 where the document has the same line again.
STATISTICS = [*quality.FEATURES, "twin_line"]
#: Keeps the share of good text away from 0 and 1 before its logarithm.
MARGIN = 1e-3


def lines_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The lines of each text that have a word; where each text's lines begin, and the last's end; and the lines' bytes
    without white space at their ends."""
    lines, starts = [], [0]
    for t in texts:
        lines += [w for w in (x.strip() for x in t.split(b"\n")) if w]
        starts.append(len(lines))
    return lines, np.array(starts, np.int64), np.array([len(x) for x in lines], np.int64)


def line_statistics(lines: list[bytes], starts: np.ndarray) -> np.ndarray:
    _, x = quality.statistics(lines)
    twin = np.zeros(len(lines))
    if lines:
        data, begins = common.joined(lines)
        doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        key = common.mix(common.span_hashes(data, begins[:-1], begins[1:] - 1) + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twin[order[1:][same]] = 1
        twin[order[:-1][same]] = 1
    return np.column_stack([x, twin])


def chain(evidence: np.ndarray, trans: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label 1 for each line, and of the label pairs (0 0, 0 1, 1 0, 1 1) of each line and the one before it
    (zeros for a document's first).  evidence: log odds of label 1; trans: 2 x 2 logarithms."""
    n = len(evidence)
    if not n:
        return np.zeros(0), np.zeros((0, 4))
    sizes = np.diff(starts)
    at = np.arange(n) - np.repeat(starts[:-1], sizes)
    left = np.repeat(starts[1:], sizes) - 1 - np.arange(n)
    odds, t = np.exp(np.clip(evidence, -30, 30)), np.exp(np.clip(trans, -30, 30))
    own = np.empty((n, 2, 2))
    own[:, :, 0], own[:, :, 1] = t[:, 0], t[:, 1] * odds[:, None]
    first = at == 0
    own[first, :, 0], own[first, :, 1] = 1, odds[first, None]
    own /= own.max(axis=(1, 2), keepdims=True)

    def products(steps: np.ndarray, back: int) -> np.ndarray:
        """Products of the matrices from a document's first line to each, or from each to the last."""
        m, d = own.copy(), 1
        live = np.flatnonzero(steps >= d)
        while len(live):
            a, b = (m[live - d], m[live]) if back < 0 else (m[live], m[live + d])
            c = np.empty_like(a)
            for i in range(2):
                for j in range(2):
                    c[:, i, j] = a[:, i, 0] * b[:, 0, j] + a[:, i, 1] * b[:, 1, j]
            m[live] = c / c.max(axis=(1, 2), keepdims=True)
            d *= 2
            live = live[steps[live] >= d]
        return m

    alpha = products(at, -1)[:, 0, :]
    rest = products(left, 1).sum(axis=2)
    beta = np.ones((n, 2))
    more = np.flatnonzero(left > 0)
    beta[more] = rest[more + 1]
    both = alpha * beta
    pairs = np.zeros((n, 4))
    later = np.flatnonzero(~first)
    joint = alpha[later - 1][:, :, None] * own[later] * beta[later][:, None, :]
    pairs[later] = joint.reshape(-1, 4) / joint.sum(axis=(1, 2))[:, None]
    return both[:, 1] / both.sum(axis=1), pairs


@dataclass
class LineField:
    """edges: of each statistic's bins; weights: (line before, itself, line after) x statistic x bin, the last bin for a line
    that isn't there; trans: 2 x 2; slope and shift: from the share of good text to the document's log odds."""

    edges: list[np.ndarray]
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def bins(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(3, statistic, line) indices into the weights."""
        own = np.vstack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)]) if len(x) else np.zeros((len(self.edges), 0), np.int64)
        none = self.weights.shape[2] - 1
        out = np.full((3, *own.shape), none, np.int64)
        if own.shape[1]:
            out[0, :, 1:], out[1], out[2, :, :-1] = own[:, :-1], own, own[:, 1:]
            some = starts[:-1][np.diff(starts) > 0]
            out[0][:, some] = none
            out[2][:, starts[1:][np.diff(starts) > 0] - 1] = none
        return out

    def evidence(self, bins: np.ndarray) -> np.ndarray:
        k = np.arange(bins.shape[1])[:, None]
        return self.bias + sum(self.weights[side][k, bins[side]].sum(axis=0) for side in range(3))

    def marginals(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of each line to be good, where each text's lines begin, and the lines' lengths."""
        lines, starts, sizes = lines_of(texts)
        return chain(self.evidence(self.bins(line_statistics(lines, starts), starts)), self.trans, starts)[0], starts, sizes

    def probability(self, good: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * log_share(good, starts, sizes) + self.shift, -60, 60)))


def log_share(good: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Log odds of each text's share of good bytes; a text without a word has none."""
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    share = np.bincount(doc, good * sizes, minlength=len(starts) - 1) / np.maximum(np.bincount(doc, sizes, minlength=len(starts) - 1), 1)
    return np.log((share + MARGIN) / (1 - share + MARGIN))


def _fitted(field: LineField, bins: np.ndarray, starts: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int, ridge: float = 1e-3) -> None:
    """Likelihood of line labels, weighted by line, climbed by Adam's steps from the field's present values."""
    sizes = field.weights.shape
    flat = (np.arange(3)[:, None, None] * sizes[1] + np.arange(sizes[1])[None, :, None]) * sizes[2] + bins
    flat = flat.ravel()
    pair = np.zeros((len(label), 4))
    later = np.ones(len(label), bool)
    later[starts[:-1][np.diff(starts) > 0]] = False
    at = np.flatnonzero(later)
    pair[at, 2 * label[at - 1] + label[at]] = 1
    theta = np.concatenate((field.weights.ravel(), [field.bias], field.trans.ravel()))
    m, v, total = np.zeros_like(theta), np.zeros_like(theta), weight.sum()
    for k in range(1, steps + 1):
        field.weights, field.bias, field.trans = theta[:-5].reshape(sizes), float(theta[-5]), theta[-4:].reshape(2, 2)
        good, pairs = chain(field.evidence(bins), field.trans, starts)
        miss = (label - good) * weight / total
        grad = np.concatenate((np.bincount(flat, np.tile(miss, 3 * sizes[1]), minlength=len(theta) - 5), [miss.sum()], ((pair - pairs) * weight[:, None]).sum(axis=0) / total)) - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 / (1 + 3 * k / steps) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    field.weights, field.bias, field.trans = theta[:-5].reshape(sizes), float(theta[-5]), theta[-4:].reshape(2, 2)


def fit(x: np.ndarray, sizes: np.ndarray, starts: np.ndarray, y: np.ndarray, share: float | None = None, rounds: int = ROUNDS, steps: int = 60) -> LineField:
    """Field from lines' statistics and lengths, where documents begin, and the documents' labels.

    share: of label 1 among all labelled documents, if the given ones were picked by label.  Without labels, or with those of
    one kind, all documents get that kind's verdict (label 1 where there is none).
    """
    n_stats = len(STATISTICS)
    if not len(y) or y.min() == y.max():
        return LineField([np.zeros(0)] * n_stats, np.zeros((3, n_stats, 2)), 0.0, np.zeros((2, 2)), 0.0, 60.0 if not len(y) or y[0] else -60.0)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(n_stats)]
    # a value that most lines share gets an edge of its own, so rare values beyond it stand apart
    edges = [np.unique(np.concatenate((e, np.quantile(x[:, k], [0.95, 0.98, 0.995])))) if len(x) else e for k, e in enumerate(edges)]
    field = LineField(edges, np.zeros((3, n_stats, max(len(e) for e in edges) + 2)), 0.0, np.zeros((2, 2)))
    counts = np.diff(starts)
    doc = np.repeat(np.arange(len(y)), counts)
    # each label weighs the same, a document counts by the root of its lines
    of_doc = 1 / np.sqrt(np.maximum(counts, 1)) / np.bincount(y, minlength=2)[y]
    bins, label = field.bins(x, starts), y[doc].astype(np.int64)
    for k in range(rounds + 1):
        _fitted(field, bins, starts, label, of_doc[doc], steps)
        good = chain(field.evidence(bins), field.trans, starts)[0]
        if k < rounds:
            found = (good > 0.5) & (y[doc] == 0)
            bad_left = np.bincount(doc, (~found) * sizes, minlength=len(y)) > 0
            label = np.where(y[doc] == 1, 1, (found & bad_left[doc]).astype(np.int64))
    z = log_share(good, starts, sizes)
    share = y.mean() if share is None else share
    w = np.where(y == 1, share / max((y == 1).mean(), 1e-9), (1 - share) / max((y == 0).mean(), 1e-9))
    target = np.where(y == 1, 1 - 1 / (len(y) + 2), 1 / (len(y) + 2))
    a, b = 1.0, 0.0
    for _ in range(200):  # Newton's steps for the logistic curve
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        d, h = w * (p - target), w * np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve(np.array([[(h * z**2).sum(), (h * z).sum()], [(h * z).sum(), h.sum()]]) + 1e-6 * np.eye(2), np.array([(d * z).sum() + 1e-3 * a, d.sum()]))
        step = np.clip(step, -1, 1)
        a, b = max(a - step[0], 1e-6), b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    field.slope, field.shift = float(a), float(b)
    return field


def train(docs: DataFrame, labels: DataFrame, texts: int = TRAINING_TEXTS, most_lines: int = TRAINING_LINES, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality") -> LineField:
    """Field from at most `texts` labelled documents of each label, none of over `most_lines` lines.

    Rows without an id, a label or a document are left out; of several labels of one id the smallest counts, of several texts
    the one with the smallest hash.
    """
    rows = labels.select(F.col(f"`{label_id}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y")).dropna().groupBy("doc_id").agg(F.min("y").alias("y"))
    seen = {r.y: r.n for r in rows.where("y in (0, 1)").groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = rows.where("y = 1").orderBy(*order).limit(texts).union(rows.where("y = 0").orderBy(*order).limit(texts))

    def work(batches):
        for b in common.chunks(batches):
            lines, starts, sizes = lines_of(b.column("text").to_pylist())
            x = line_statistics(lines, starts)
            keep = np.flatnonzero(np.diff(starts) <= most_lines)
            parts = [(x[starts[k] : starts[k + 1]].tobytes(), sizes[starts[k] : starts[k + 1]].tobytes()) for k in keep.tolist()]
            some = pa.array(keep)
            arrays = [*(b.column(c).take(some) for c in ("doc_id", "mark", "y")), *(pa.array([p[k] for p in parts], pa.binary()) for k in range(2))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "mark", "y", "x", "sizes"])

    d = common.documents(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    each = d.join(F.broadcast(picked), "doc_id").select("doc_id", "mark", "y", "text").mapInArrow(work, "doc_id long, mark long, y int, x binary, sizes binary")
    got = each.groupBy("doc_id").agg(F.min_by(F.struct("y", "x", "sizes"), "mark").alias("r")).select("doc_id", "r.*").collect()  # a row for each picked label
    got.sort(key=lambda r: r.doc_id)
    sizes = [np.frombuffer(r.sizes, np.int64) for r in got]
    x = [np.frombuffer(r.x, np.float64).reshape(-1, len(STATISTICS)) for r in got]
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sizes]))).astype(np.int64)
    return fit(np.vstack(x) if x else np.zeros((0, len(STATISTICS))), np.concatenate(sizes) if sizes else np.zeros(0, np.int64), starts, np.array([r.y for r in got], np.int64), seen.get(1, 0) / max(sum(seen.values()), 1))


def scores(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines (with a word), n_good (lines more likely good than bad) and score (probability of label 1)."""

    def work(batches):
        for b in common.chunks(batches):
            good, starts, sizes = field.marginals(b.column("text").to_pylist())
            doc = np.repeat(np.arange(b.num_rows), np.diff(starts))
            n_good = np.bincount(doc[good > 0.5], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(starts)), pa.array(n_good), pa.array(field.probability(good, starts, sizes))], ["doc_id", "n_lines", "n_good", "score"])

    return common.documents(docs, id_col, text_col).mapInArrow(work, "doc_id long, n_lines long, n_good long, score double")


def good_lines(docs: DataFrame, field: LineField, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """All columns of `docs`, and _good: the text of the lines that are good with a probability of at least `least`, and of
    lines without a word.  A null text stays null."""
    target = docs.drop("_good").withColumn("_good", F.lit(None).cast("string")).schema

    def work(batches):
        for b in batches:
            at, out = b.schema.get_field_index(text_col), []
            texts = b.column(at).cast(pa.binary())
            small = pa.RecordBatch.from_arrays([texts.is_valid(), texts], ["some", "text"])
            for c in common.chunks([small]):
                raw = c.column("text").to_pylist()
                good, starts, _ = field.marginals(raw)
                for k, (t, some) in enumerate(zip(raw, c.column("some").to_pylist(), strict=True)):
                    verdict = iter((good[starts[k] : starts[k + 1]] >= least).tolist())
                    out.append(b"\n".join(x for x in t.split(b"\n") if not x.strip() or next(verdict)).decode() if some else None)
            names = [n for n in b.schema.names if n != "_good"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(out, pa.string())], [*names, "_good"])

    return docs.drop("_good").mapInArrow(work, target)


def held_out(col):
    """Whether crc32 of an id as text leaves 2 modulo 4: such rows are never trained on.  A null id isn't held out."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def line_quality(docs: DataFrame, labels: DataFrame, least: float = 0.7, texts: int = TRAINING_TEXTS) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from `least` on), n_lines and n_good of every document, repeated rows alike.

    A null or empty text, or one of white space, has no good line and scores as wholly bad.
    """
    field = train(docs, labels.where(~held_out(F.col("doc_id"))), texts)
    return scores(docs, field).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.expr(f"cast(score >= {least} as int)").alias("predicted"), "n_lines", "n_good")
