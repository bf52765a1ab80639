"""Importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fluxspan.llm import importance as imp

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def features(text):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))
    return w, [b" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, items, buckets=10_000, percent=5, least=20):
    own = [features(t) for _, t in docs]
    s, t = (Counter(zlib.crc32(f) % buckets for fs in x for f in fs) for x in ([f for _, f in own], [features(t)[1] for t in items]))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for (i, _), (w, fs) in zip(docs, own, strict=True):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in fs)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted((tuple(r[:4]) + (ranks.get(id(r)),) for r in rows), key=str)


WORDS = ["ab", "C", "the", "été", "x1", "日本", "9", "Zz"]


@pytest.mark.parametrize("seed", range(6))
def test_scan(seed):
    rng = random.Random(seed)
    texts = ["", " ", "one", "a,b", "x" * 200 + " y " + "z" * 70, "\x00A\x7fb"] + ["".join(rng.choice(WORDS) + rng.choice([" ", ", ", "--", "\n", ""]) for _ in range(rng.randint(0, 60))) for _ in range(30)]
    words, found = imp.scan([t.encode() for t in texts], 997)
    for t, n, f in zip(texts, words, found, strict=True):
        w, fs = features(t)
        assert n == len(w) and Counter(np.frombuffer(f, "<u4").tolist()) == Counter(zlib.crc32(x) % 997 for x in fs)


@pytest.mark.parametrize("block", [1, 5, 40])
def test_blocks_of_long_texts(block):
    raw = b" " + b" ".join(b"w%d" % (k * k) for k in range(60)) + b" "
    whole = [np.concatenate(x) for x in zip(*imp.ngram_spans(raw), strict=True)]
    cut = [np.concatenate(x) for x in zip(*imp.ngram_spans(raw, block), strict=True)]
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True)) and len(whole[0]) == 60


def test_report_equals_brute_force(spark):
    rng = random.Random(3)
    docs = [(k, " ".join(rng.choices(WORDS, k=rng.randint(0, 50)))) for k in range(300)]
    docs += [(5, docs[5][1]), (None, "the " * 30), (None, None), (1000, ""), (1001, docs[7][1])] + [(7, docs[7][1])] * 80
    items = ["the ab été C the", None, "", "x1 9"]
    d = spark.createDataFrame([(i, t, "a", 0) for i, t in docs], "doc_id long, text string, score string, mark int")
    b = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    got = [tuple(r) for r in imp.importance_report(d, b).collect()]
    key = lambda r: str(r[:4])  # noqa: E731  (which of several equal rows has which rank is not defined)
    want = brute(docs, items)
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert sorted((r[4] or 0, r[0] or -1) for r in got) == sorted((r[4] or 0, r[0] or -1) for r in want)
    chosen = imp.resample(d, b).collect()
    assert sum(r._copies for r in chosen) == sum(r[4] is not None for r in want) and {r.doc_id for r in chosen} == {r[0] for r in want if r[4]}
    assert imp.importance_report(d.limit(0), b).count() == 0
    alone = imp.importance_report(d, b.limit(0)).collect()
    assert len(alone) == len(docs)


def test_long_text(spark):
    text = "\n".join(" ".join(hashlib.md5(f"{k} {j}".encode()).hexdigest()[:7] for j in range(12)) for k in range(50_000))
    docs = [(1, text), (2, "x" * 300_000), (3, "a b c d")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    got = sorted((tuple(r) for r in imp.importance_report(d, b).collect()), key=str)
    assert got == brute(docs, ["a b c"])
