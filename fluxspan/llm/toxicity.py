"""Toxicity: a support vector machine on a gapped-subsequence string kernel, with Nyström landmarks.

The kernel compares short strings (words, or spelled-out letters put together) by the four-character subsequences they
share, each weighted by a decay for the characters it stretches over, so insults with gaps or inserted characters stay
close to the plain ones.  Landmarks span the feature space; a linear machine is trained in it.  Labels belong to whole
texts, so training is by witnesses: each toxic text, as a bag of its sentences' strings, is represented by the string that
scores highest, all strings of clean texts are negative.  Trained, the machine is one weight for each subsequence of the
landmarks; a string's margin is a normalised sum of weights.  A text's score is a logistic curve of its worst strings'
margins and of the share of its words that are suspicious, since beginnings of insults also begin rare harmless words.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import LongTable

#: Labelled texts of each class that the machine is trained on, at most: those with the smallest hashes of their ids.
TRAINING_TEXTS = 2_000
#: Landmark strings, and strings of clean texts that a round trains against: the likeliest, and others drawn from all.
LANDMARKS, NEAR_STRINGS, FAR_STRINGS = 200, 4_000, 8_000
#: The worst strings of a text that its score looks at, and the margin from which on a string counts as suspicious.
WORST, SUSPECT = 3, 0.0
#: What a missed toxic text weighs against a clean one that is marked, when the curve is fitted.
MISS_COST = 3.0
#: Margin of a string that isn't there.
FLOOR = -2.0
#: Strings whose kernel rows are made in one step on the driver.
STEP_STRINGS = 200
_MIX = np.uint64(0x9E3779B97F4A7C15)
SPAN, DECAY = 6, 0.6
#: A longer string is read in overlapping pieces of this length.
PIECE = 32
STEPS = [(a, b, c) for a in range(1, SPAN) for b in range(1, SPAN - a) for c in range(1, SPAN - a - b)]


def spelled_out(data: np.ndarray, s: np.ndarray, e: np.ndarray, bounds: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Runs of three or more words of a single character, put together, and the text of each.  bounds: first words of texts."""
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    single = np.concatenate(([False], begins[e] - begins[s] == 1, [False]))
    apart = np.zeros(len(s) + 1, bool)
    apart[bounds] = True
    open_ = np.flatnonzero(single[1:-1] & (~single[:-2] | apart[:-1]))
    shut = np.flatnonzero(single[1:-1] & (~single[2:] | apart[1:])) + 1
    long = shut - open_ > 2
    raw, runs = data.tobytes(), []
    for a, b in zip(open_[long].tolist(), shut[long].tolist(), strict=True):
        runs.append(b"".join([raw[x:y] for x, y in zip(s[a:b].tolist(), e[a:b].tolist(), strict=True)]))
    return runs, np.searchsorted(bounds, open_[long], side="right") - 1


def strings_of(text: bytes) -> list[bytes]:
    """The white-space separated strings of a text, and each run of three or more single characters put together."""
    data, _ = common.joined([text])
    s, e = common.word_spans(data)
    return text.split() + spelled_out(data, s, e, np.array([0, len(s)]))[0]


def normal_forms(word: bytes) -> list[str]:
    """Lower-cased, without punctuation at its ends; and its letters alone, if other characters stand between them."""
    w = word.decode("utf-8", "replace").lower()
    lo, hi = 0, len(w)
    while lo < hi and not w[lo].isalnum():
        lo += 1
    while hi > lo and not w[hi - 1].isalnum():
        hi -= 1
    w = w[lo:hi]
    forms = [w] if w else []
    if w and not w.isalpha():
        bare = "".join(c for c in w if c.isalpha())
        if bare and bare != w:
            forms.append(bare)
    return [p for f in forms for p in ([f] if len(f) <= PIECE else [f[i : i + PIECE] for i in range(0, len(f) - PIECE // 2, PIECE // 2)])]


def subsequences(words: list[str]):
    """For each of the STEPS: (string, 64-bit hash of the subsequence's code points, weight) arrays; strings are marked at both ends."""
    text = np.frombuffer("\x02\x03".join(["", *words, ""]).encode("utf-32-le"), np.uint32)[1:-1].astype(np.int64) if words else np.zeros(0, np.int64)
    # \x03 begins a string and \x02 ends it; the first begin and the last end come from the outer joins
    owner = np.cumsum(text == 3) - 1
    letters = text.view(np.uint64)
    for a, b, c in STEPS:
        n = len(text) - a - b - c
        if n <= 0:
            continue
        at = np.flatnonzero(owner[:n] == owner[a + b + c :])
        code = ((letters[at] * _MIX + letters[at + a]) * _MIX + letters[at + a + b]) * _MIX + letters[at + a + b + c]
        yield owner[at], code.view(np.int64), DECAY ** (a + b + c - 3)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, subsequence, value) of all strings, each subsequence of a string once, divided by the string's norm."""
    owners, codes, weights = [], [], []
    for owner, code, weight in subsequences(words):
        owners.append(owner)
        codes.append(code)
        weights.append(np.full(len(code), weight))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    owner, code, value = np.concatenate(owners), np.concatenate(codes), np.concatenate(weights)
    # equal codes of one string stand together after sorting by a hash of both
    order = np.argsort(common.mix(code.astype(np.uint64) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    owner, code, value = owner[order], code[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
    head = np.flatnonzero(new)
    owner, code, value = owner[head], code[head], np.add.reduceat(value, head)
    norm = np.sqrt(np.bincount(owner, value**2, minlength=len(words)))
    return owner, code, value / norm[owner]


@dataclass
class StringMachine:
    """codes and weights: of all landmark subsequences; bias; curve: weights of a text's features and of 1 in its log odds."""

    codes: np.ndarray
    weights: np.ndarray
    bias: float
    curve: np.ndarray
    most: float = 1.0  # margins count up to here

    def margins(self, words: list[str]) -> np.ndarray:
        if not hasattr(self, "_table"):
            self._table = LongTable(self.codes, np.arange(len(self.codes)))
        owner, code, value = features(words)
        at = self._table(code)
        hit = at >= 0
        return np.bincount(owner[hit], self.weights[at[hit]] * value[hit], minlength=len(words)) + self.bias

    def features(self, worst: np.ndarray, suspects: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Of texts: margins of the worst different strings, worst first; how many are suspicious, and their share of the words."""
        tops = np.clip(worst, -1, self.most)
        return np.column_stack([tops, np.log((suspects + 0.5) / (words + 50.0)), np.minimum(suspects, 2), np.log1p(suspects)])

    def probability(self, worst: np.ndarray, suspects: np.ndarray, words: np.ndarray) -> np.ndarray:
        odds = self.features(worst, suspects, words) @ self.curve[:-1] + self.curve[-1]
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))

    def of_text(self, margins: np.ndarray, words: int) -> float:
        """Probability for one text, from the margins of its different strings and its number of words."""
        worst = np.full((1, WORST), FLOOR)
        top = np.sort(margins)[::-1][:WORST]
        worst[0, : len(top)] = top
        return float(self.probability(worst, np.array([(margins > SUSPECT).sum()]), np.array([words]))[0])


def _kernel(words: list[str], codes: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Kernel of strings with landmarks.  columns: (subsequence, landmark) values, already normalised."""
    table, out = LongTable(codes, np.arange(len(codes))), []
    for lo in range(0, len(words), STEP_STRINGS):
        part = words[lo : lo + STEP_STRINGS]
        dense = np.zeros((len(part), len(codes)))
        owner, code, value = features(part)
        at = table(code)
        hit = at >= 0
        dense[owner[hit], at[hit]] = value[hit]
        out.append(dense @ columns)
    return np.vstack(out) if out else np.zeros((0, columns.shape[1]))


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 4e-5, rounds: int = 30) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps; the last coefficient is the bias."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(x.shape[1])
    reg = np.full(len(w), ridge)
    reg[-1] = 1e-6
    weight = weight / weight.sum()
    for _ in range(rounds):
        gap = 1 - y * (x @ w)
        live = gap > 0
        grad = reg * w - 2 * x[live].T @ (weight[live] * y[live] * gap[live])
        hess = np.diag(reg) + 2 * (x[live] * weight[live, None]).T @ x[live]
        step = np.linalg.solve(hess + 1e-9 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _spread(word: str, rng: np.random.Generator) -> str:
    """The string with characters inserted between its own."""
    marks = ".-*_ "
    return "".join(c + (marks[rng.integers(4)] if rng.random() < 0.7 else "") for c in word[:-1]) + word[-1:]


def fit(bags: list[list[str]], toxic: np.ndarray, sizes: np.ndarray, toxic_share: float | None = None, landmarks: int = LANDMARKS, rounds: int = 3, seed: int = 1) -> StringMachine:
    """Trains on bags of distinct strings of texts with `sizes` words; toxic_share: of toxic texts among all that are labelled, if
    the given ones were picked by label.  With labels of one kind only, all scores are 0 (none toxic) or 1 (all toxic)."""
    if not len(toxic) or toxic.min() == toxic.max():
        curve = np.zeros(WORST + 4)
        curve[-1] = 60.0 if len(toxic) and toxic[0] else -60.0
        return StringMachine(np.zeros(0, np.int64), np.zeros(0), 0.0, curve)
    rng = np.random.default_rng(seed)
    words = sorted({w for b in bags for w in b})
    number = {w: k for k, w in enumerate(words)}
    member = [np.array([number[w] for w in b], np.int64) for b in bags]
    bad, good = np.zeros(len(words)), np.zeros(len(words))
    for m, t in zip(member, toxic, strict=True):
        (bad if t else good)[m] += 1
    n_bad, n_good = max(int(toxic.sum()), 1), max(int((1 - toxic).sum()), 1)
    # evidence that a string, or a piece of it (four characters, or up to seven at its beginning), belongs to toxic texts: log likelihood ratios of its
    # numbers of texts, which must exceed the logarithm of the number of candidates
    one: dict[str, str] = {}  # equal pieces of different strings are kept once
    grams = [tuple({one.setdefault(p, p) for p in {f"^{w}"[i : i + 4] for i in range(max(1, len(w) - 2))} | {f"^{w[:k]}" for k in (4, 5, 6, 7)}}) for w in words]
    pieces: dict[str, list[int]] = {}
    for m, t in zip(member, toxic, strict=True):
        for g in {g for k in m.tolist() for g in grams[k]}:
            pieces.setdefault(g, [0, 0])[int(t)] += 1
    rate = n_bad / (n_bad + n_good)

    def evidence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = np.maximum(a + b, 1)
        llr = a * np.log(np.maximum(a, 1e-9) / (n * rate)) + b * np.log(np.maximum(b, 1e-9) / (n * (1 - rate)))
        return np.where(a > n * rate, llr, -llr)

    names = list(pieces)
    both = np.array([pieces[g] for g in names], float).reshape(-1, 2)
    of_piece = dict(zip(names, evidence(both[:, 1], both[:, 0]).tolist(), strict=True))
    own = evidence(bad, good)
    score = np.maximum(own, [max((of_piece[g] for g in gs), default=-9.0) for gs in grams])
    enough = np.log(len(words) + len(names))
    del grams, pieces, of_piece, names, one, both
    surely = np.flatnonzero((score > enough) & ((good == 0) | (own > enough)) & (bad > 0))
    if not len(surely):
        surely = np.argsort(-own, kind="stable")[: max(1, n_bad // 2)]
    marked = np.zeros(len(words), bool)
    marked[surely] = True
    clean = np.flatnonzero((good > 0) & ~marked)
    machine = None
    for _ in range(rounds):
        extra = [m[np.argmax(score[m])] for m, t in zip(member, toxic, strict=True) if machine is not None and t and len(m) and not marked[m].any()]
        witness = np.union1d(surely, [k for k in extra if score[k] > 0 and not good[k]]).astype(np.int64)
        near = clean[np.argsort(-score[clean], kind="stable")[:NEAR_STRINGS]]
        far = rng.choice(clean, min(len(clean), FAR_STRINGS), replace=False) if len(clean) else clean
        negative = np.unique(np.concatenate((near, far)))
        pos = [words[k] for k in witness]
        pos_weight = [bad[k] for k in witness]
        gapped = [_spread(w, rng) for w in pos]
        neg = [words[k] for k in negative]
        chosen = sorted(range(len(pos)), key=lambda k: -pos_weight[k])[: landmarks * 3 // 4]
        picks = [pos[k] for k in chosen] + [words[k] for k in near[: landmarks - len(chosen)]]
        picks = sorted(set(picks))
        owner, code, value = features(picks)
        codes, where = np.unique(code, return_inverse=True)
        columns = np.zeros((len(codes), len(picks)))
        columns[where, owner] = value
        k_ll = _kernel(picks, codes, columns)
        value, vector = np.linalg.eigh((k_ll + k_ll.T) / 2)
        keep = value > 1e-5 * value.max()
        root = vector[:, keep] / np.sqrt(value[keep])
        z = np.vstack([_kernel(x, codes, columns) for x in (pos, gapped, neg)]) @ root
        y = np.concatenate((np.ones(2 * len(pos)), -np.ones(len(neg))))
        share = np.array(pos_weight) ** 1.0
        against = good[negative] ** 0.5
        weight = np.concatenate((share / share.sum(), 0.3 * share / share.sum(), 6 * against / max(against.sum(), 1)))
        w = _svm(z, y, weight)
        machine = StringMachine(codes, columns @ (root @ w[:-1]), float(w[-1]), np.zeros(WORST + 4))
        score = np.concatenate([machine.margins(words[lo : lo + 20 * STEP_STRINGS]) for lo in range(0, len(words), 20 * STEP_STRINGS)])
    # a logistic curve of the texts' features, margins clipped where that fits best
    worst, suspects = np.full((len(member), WORST), FLOOR), np.zeros(len(member))
    for k, m in enumerate(member):
        top = np.sort(score[m])[::-1][:WORST]
        worst[k, : len(top)], suspects[k] = top, (score[m] > SUSPECT).sum()
    target = np.where(toxic > 0, (n_bad + 1) / (n_bad + 2), 1 / (n_good + 2))
    odds = n_bad / n_good if toxic_share is None else toxic_share / max(1 - toxic_share, 1e-9)
    cost, fits = np.where(toxic > 0, MISS_COST * odds * n_good / n_bad, 1.0), []
    for most in (1.0, 2.0, 4.0, 8.0):
        machine.most = most
        x = np.column_stack([machine.features(worst, suspects, sizes), np.ones(len(member))])
        curve = np.zeros(x.shape[1])
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(x @ curve, -60, 60)))
            d, h = cost * (p - target), cost * np.maximum(p * (1 - p), 1e-9)
            reg = np.full(len(curve), 1e-2)
            reg[-1] = 1e-6
            step = np.clip(np.linalg.solve((x * h[:, None]).T @ x + np.diag(reg) + 1e-9 * np.eye(len(curve)), x.T @ d + reg * curve), -1, 1)
            curve -= step
            if np.abs(step).max() < 1e-6:
                break
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ curve, -60, 60))), 1e-12, 1 - 1e-12)
        fits.append((float(-(cost * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum()), most, curve))
    _, machine.most, machine.curve = min(fits, key=lambda f: f[0])
    return machine


def train(docs: DataFrame, labels: DataFrame, texts: int = TRAINING_TEXTS, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic") -> StringMachine:
    """Machine from at most `texts` labelled texts of each class.

    Rows without an id, a label or a document are left out; of several labels of one id the largest counts, of several texts
    the one with the smallest hash.
    """
    rows = labels.select(F.col(f"`{label_id}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y")).dropna().groupBy("doc_id").agg(F.max("y").alias("y"))
    seen = {r.y: r.n for r in rows.where("y in (0, 1)").groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = rows.where("y = 1").orderBy(*order).limit(texts).union(rows.where("y = 0").orderBy(*order).limit(texts))

    def work(batches):
        for b in common.chunks(batches):
            bags = [sorted({f for w in set(strings_of(t)) for f in normal_forms(w)}) for t in b.column("text").to_pylist()]
            sizes = [len(t.split()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), b.column("y"), pa.array(["\n".join(x) for x in bags]), pa.array(sizes, pa.int64())], ["doc_id", "mark", "y", "bag", "size"])

    d = common.documents(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    each = d.join(F.broadcast(picked), "doc_id").select("doc_id", "mark", "y", "text").mapInArrow(work, "doc_id long, mark long, y int, bag string, size long")
    got = each.groupBy("doc_id").agg(F.min_by(F.struct("y", "bag", "size"), "mark").alias("r")).select("r.*").collect()  # one row for each picked label
    got.sort(key=lambda r: (r.y, r.bag))
    return fit([r.bag.split("\n") if r.bag else [] for r in got], np.array([r.y for r in got], np.int64), np.array([r.size for r in got], np.int64), seen.get(1, 0) / max(sum(seen.values()), 1))


_known: dict[str, common.Recent] = {}


def scores(docs: DataFrame, machine: StringMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of every document; a null or empty text scores like no string at all."""
    token = hashlib.blake2b(machine.weights.tobytes() + machine.codes.tobytes() + np.float64(machine.bias).tobytes(), digest_size=16).hexdigest()

    def worst_forms(words: list[bytes]) -> list[float]:
        """The highest margin of each word's forms."""
        out = []
        for lo in range(0, len(words), 20_000):
            forms = [normal_forms(w) for w in words[lo : lo + 20_000]]
            best = np.full(len(forms), FLOOR)
            np.maximum.at(best, np.repeat(np.arange(len(forms)), [len(f) for f in forms]), machine.margins([x for f in forms for x in f]))
            out += best.tolist()
        return out

    def work(batches):
        if token not in _known:
            _known.clear()  # a worker serves one machine at a time
            _known[token] = common.Recent()
        known = _known[token]

        def margins(words: list[bytes]) -> np.ndarray:
            got = [known.get(w) for w in words]
            new = [k for k, m in enumerate(got) if m is None]
            for k, m in zip(new, worst_forms([words[k] for k in new]), strict=True):
                got[k] = m
                known.put(words[k], m)
            return np.array(got, float)

        for b in common.chunks(batches):
            texts = b.column("text").to_pylist()
            data, text_starts = common.joined(texts)
            s, e = common.word_spans(data)
            bounds = np.searchsorted(s, text_starts)
            first, number = common.distinct_spans(data, s, e)
            raw = data.tobytes()
            each = margins([raw[x:y] for x, y in zip(s[first].tolist(), e[first].tolist(), strict=True)])[number]
            runs, run_text = spelled_out(data, s, e, bounds)
            # each different string of a text once; of those only the ones that may be among its worst
            owner = np.concatenate((np.repeat(np.arange(len(texts)), np.diff(bounds)), run_text))
            margin = np.concatenate((each, margins(runs)))
            string = np.concatenate((number, len(first) + np.arange(len(runs))))
            best = np.full(len(texts), FLOOR)
            np.maximum.at(best, owner, margin)
            near = np.flatnonzero((margin > -1) | (margin == best[owner]))
            near = near[np.unique(owner[near] * (len(first) + len(runs) + 1) + string[near], return_index=True)[1]]
            near = near[np.lexsort((-margin[near], owner[near]))]
            rank = np.arange(len(near)) - np.searchsorted(owner[near], owner[near])
            worst = np.full((len(texts), WORST), FLOOR)
            top = near[rank < WORST]
            worst[owner[top], rank[rank < WORST]] = margin[top]
            suspects = np.bincount(owner[near[margin[near] > SUSPECT]], minlength=len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(machine.probability(worst, suspects, np.diff(bounds)))], ["doc_id", "score"])

    return common.documents(docs, id_col, text_col).mapInArrow(work, "doc_id long, score double")


def held_out(col):
    """Whether crc32 of an id as text leaves 1 modulo 3: such rows are never trained on.  A null id isn't held out."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, least: float = 0.7, texts: int = TRAINING_TEXTS) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from `least` on).

    One row for each document, repeated rows alike.  A null or empty text scores as one without strings.  Labels that are
    null, or without a document, teach nothing; with none, or labels of one kind, all scores are that kind's.
    """
    machine = train(docs, labels.where(~held_out(F.col("doc_id"))), texts)
    return scores(docs, machine).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.expr(f"cast(score >= {least} as int)").alias("predicted"))
