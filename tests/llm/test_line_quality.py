"""Lines' marginals against enumeration, quality against held-out labels, odd rows."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from fluxspan.llm import common
from fluxspan.llm import line_quality as lq


@pytest.mark.parametrize("seed", range(8))
def test_marginals_equal_enumeration(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 9, 6)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    e, t = rng.normal(0, 4, sizes.sum()), rng.normal(0, 2, (2, 2))
    got, pairs = lq.chain(e, t, starts)
    for lo, hi in itertools.pairwise(starts.tolist()):
        n = hi - lo
        p, joint, total = np.zeros(n), np.zeros((n, 4)), 0.0
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(e[lo + k] * y[k] for k in range(n)) + sum(t[y[k - 1], y[k]] for k in range(1, n)))
            total += w
            p += w * np.array(y)
            for k in range(1, n):
                joint[k, 2 * y[k - 1] + y[k]] += w
        if n:
            assert np.allclose(got[lo:hi], p / total) and np.allclose(pairs[lo:hi], joint / total)


def test_long_chain_stays_finite():
    n = 100_000
    rng = np.random.default_rng(1)
    p, pairs = lq.chain(rng.normal(0, 40, n), np.array([[3.0, -8.0], [-8.0, 3.0]]), np.array([0, n]))
    assert np.isfinite(p).all() and np.isfinite(pairs).all() and np.allclose(pairs[1:].sum(axis=1), 1)
    assert np.allclose(pairs[1:, 1] + pairs[1:, 3], p[1:])


def test_likelihood_climbs_to_the_labels():
    rng = np.random.default_rng(2)
    y = np.repeat([0, 1], 30)
    counts = rng.integers(1, 12, 60)
    starts = np.concatenate(([0], np.cumsum(counts)))
    doc = np.repeat(np.arange(60), counts)
    x = rng.normal(0, 1, (counts.sum(), len(lq.STATISTICS)))
    noise = rng.random(len(x)) < 0.3  # a bad document also has lines like those of good ones
    x[:, 3] += 6 * ((y[doc] == 0) & ~noise)
    first = np.array([np.flatnonzero(doc == d)[0] for d in range(60)])
    x[first[y == 0], 3] += 6
    field = lq.fit(x, np.ones(len(x), np.int64), starts, y)
    good = lq.chain(field.evidence(field.bins(x, starts)), field.trans, starts)[0]
    p = field.probability(good, starts, np.ones(len(x), np.int64))
    assert ((p > 0.5) == (y == 1)).all()


def test_held_out(spark):
    docs, labels = (common.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    got = {r.doc_id: r for r in lq.line_quality(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for k, r in got.items())
    pairs = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(g.predicted == q for g, q in pairs) >= 0.93 * len(pairs)
    order = [(a.score > b.score) + 0.5 * (a.score == b.score) for a, q in pairs for b, r in pairs if q > r]
    assert np.mean(order) > 0.97


def test_odd_rows(spark):
    long = "\n".join(" ".join(hashlib.md5(f"{k} {j}".encode()).hexdigest()[:7] for j in range(12)) for k in range(55_000))
    good, bad = "The one line of it.\nAnd another one, quite plain.", "A%%% b&&& c###\nd$$$ e*** f%%%"
    rows = [(1, good), (2, bad), (2, bad), (None, good), (None, None), (3, ""), (4, " \n\t"), (5, long), (6, good + "\n" + bad)]
    rng = random.Random(0)
    rows += [(10 + k, "\n".join(rng.choice((good, bad)[k % 2].split("\n")) for _ in range(rng.randint(1, 6)))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", lq.F.lit(1)).withColumn("mark", lq.F.lit("x"))
    labels = spark.createDataFrame([(10 + k, 1 - k % 2) for k in range(60)] + [(1, 1), (1, None), (None, 0), (99, 1), (10, 1)], "doc_id long, quality int")
    got = lq.line_quality(docs, labels).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_lines): r for r in got}
    assert by[(1, 2)].score > 0.7 > by[(2, 2)].score and by[(None, 2)].score == by[(1, 2)].score
    assert by[(None, 0)].score == by[(3, 0)].score == by[(4, 0)].score <= by[(2, 2)].score
    assert by[(5, 55_000)].n_lines == 55_000 and len({r.score for r in got if r.doc_id == 2}) == 1
    field = lq.train(docs, labels)
    kept = {r.doc_id: r._good for r in lq.good_lines(docs.where("doc_id in (2, 4, 6)"), field).collect()}
    assert kept == {2: "", 4: " \n\t", 6: good}
    assert lq.line_quality(docs.limit(0), labels).count() == 0
    for some, want in ((labels.limit(0), 1), (labels.where("quality = 0"), 0), (labels.where("quality = 1"), 1)):
        assert {r.predicted for r in lq.line_quality(docs.where("doc_id <> 5"), some).collect()} == {want}
