"""Decontamination, quality and toxicity against brute force and on held-out labels."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from fluxspan.llm import decontamination as dec
from fluxspan.llm import quality, toxicity

WORDS = ["ab", "C", "the", "of", "été", "x1", "日本"]


def words(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c + 32 if 65 <= c <= 90 else c for c in t))


@pytest.mark.parametrize("seed", range(8))
def test_automaton(seed):
    rng = random.Random(seed)
    items = [(str(i), " ".join(rng.choices(WORDS, k=rng.choice([0, 1, 3, 8, 12, 25] if seed % 3 == 0 else [0, 8, 12, 25])))) for i in range(12)]
    texts = []
    for _ in range(40):
        w = rng.choices(WORDS, k=rng.randint(0, 60))
        texts.append(" ".join(w[:5] + items[rng.randrange(12)][1].split() + w[5:]).replace("the", "The,").encode())
    auto = dec.SuffixAutomaton([(i, words(t.encode())) for i, t in items], 10)
    n, found = dec.match_chunk(texts, auto)
    for d, t in enumerate(texts):
        dw, mask, hit = words(t), [0] * len(words(t)), set()
        for i, it in items:
            iw = words(it.encode())
            for w in [iw] if 0 < len(iw) < 10 else [iw[k : k + 10] for k in range(len(iw) - 9)]:
                for p in range(len(dw) - len(w) + 1):
                    if dw[p : p + len(w)] == w:
                        hit.add(i)
                        mask[p : p + len(w)] = [1] * len(w)
        spans, got = found.get(d, ([], set()))
        assert (n[d], sum(b - a for a, b in spans), {auto.names[g] for g in got}) == (len(dw), sum(mask), hit)


def test_decontamination_frames(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"Clean {' '.join('a%d' % i for i in range(30))} {passage.upper()} end.", "en", "s", 9), (2, passage, "en", "s", 5), (3, None, "en", "s", 0), (4, "nothing here", "en", "s", 12)], "doc_id long, text string, lang string, source string, n_chars long")
    items = spark.createDataFrame([(7, passage), (8, None), (9, ""), (7, passage), (None, "zz yy")], "item_id long, text string")
    out = {r.doc_id: r for r in dec.contamination(docs, items).collect()}
    assert [(out[k].n_hit, out[k].n_items, out[k].contaminated) for k in (1, 2, 3, 4)] == [(12, 1, True), (12, 1, True), (0, 0, False), (0, 0, False)]
    split = {r.doc_id: r.n_hit for r in dec.contamination(docs, items, limit=2).collect()}
    assert split == {1: 12, 2: 12, 3: 0, 4: 0}
    kept = {r.doc_id: r for r in dec.clean_rows(docs, items).collect()}
    assert set(kept) == {1, 3, 4} and "P5" not in kept[1].text and kept[1].text.endswith(" end.") and kept[1].n_chars == len(kept[1].text)
    assert kept[3].text is None and kept[4].n_chars == 12
    assert dec.contamination(docs.limit(0), items).count() == 0


def test_clean_rows_in_groups(spark):
    p = [f"p{i}" for i in range(40)]
    own = " ".join(f"a{i}" for i in range(60))
    texts = [f"{own} {' '.join(p[:18])} end", f"{' '.join(p[20:30])} x y z {' '.join(p[30:40])}", f"{own} {' '.join(p[:5])} {' '.join(p[20:30])} {' '.join(p[5:10])} end", own, None]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    items = spark.createDataFrame([(k, " ".join(p[x:y])) for k, (x, y) in enumerate([(0, 12), (6, 18), (20, 30), (30, 40), (0, 10), (8, 18)])], "item_id long, text string")
    assert len(dec.item_groups(items, "item_id", "text", 2)) > 1
    whole, split = (sorted(map(tuple, dec.clean_rows(docs, items, **limit).collect())) for limit in ({}, {"limit": 2}))
    assert [r[0] for r in whole] == [0, 2, 3, 4]
    assert whole[0][1] == f"{own}  end" and whole[1][1] == f"{own} {' '.join(p[:5])}  {' '.join(p[5:10])} end"
    assert split == whole


def brute_stats(t):
    w, repeat, seen = t.split(), set(), {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                repeat |= set(range(i, i + 5))
    lines, twice = set(), 0
    for line in t.split(b"\n"):
        twice += bool(line.split() and line in lines)
        lines.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum(t.count(bytes([c])) for c in b"#*$%&|<>"), twice, len(repeat)


def test_statistics(sf):
    texts = [(r[0] or "").encode() for r in duckdb.sql(f"select text from '{sf}/documents.parquet'").fetchall()] + [b"", b" \n \n", b"a b c d e " * 9]
    base, x = quality.statistics(texts)
    assert [tuple(int(base[c][k]) for c in quality.BASE) for k in range(len(texts))] == [brute_stats(t) for t in texts]
    assert x.shape == (len(texts), len(quality.FEATURES)) and np.isfinite(x).all()
    assert quality.statistics([])[1].shape[0] == 0


def test_forest_is_monotone():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] - x[:, 1] + 0.3 * rng.standard_normal(3000)) > 0).astype(float)
    f = quality.grow(x, y, [1, -1, 0])
    assert ((f.probability(x) > 0.5) == y).mean() > 0.8
    grid = np.repeat(rng.random((50, 3)), 20, 0)
    for col, sign in ((0, 1), (1, -1)):
        g = grid.copy()
        g[:, col] = np.tile(np.linspace(0, 1, 20), 50)
        steps = np.diff(f.probability(g).reshape(50, 20), axis=1) * sign
        assert (steps >= -1e-12).all()
    assert quality.grow(x[:0], y[:0], [0, 0, 0]).probability(x[:2]).min() > 0.5


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    forest = quality.train(docs, labels.where("doc_id % 2 = 0"))
    held = labels.where("doc_id % 2 = 1")
    out = quality.verdicts(docs, forest).withColumnRenamed("quality", "p").join(held, "doc_id").toPandas()
    assert ((out["p"] >= 0.5) == (out["quality"] == 1)).mean() > 0.95
    assert quality.verdicts(docs.limit(0), forest).count() == 0
    assert quality.keep_good(docs, forest).columns == docs.columns


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    some = docs.where("n_chars < 3000")
    out = toxicity.toxicity(some, labels, texts=400).join(labels, "doc_id").where("held_out").toPandas()
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out["doc_id"]]).all()
    y = out["toxic"] == 1
    # some labels are noise, and each language has its own insults in few texts
    assert (out["predicted"][y] == 1).mean() > 0.5 and (out["predicted"][~y] == 1).mean() < 0.02
    assert out["score"].between(0, 1).all()


def test_gapped_insults():
    rng = random.Random(2)
    clean = ["".join(rng.choices(["ta", "ro", "min", "el", "us", "ka"], k=3)) for _ in range(300)]
    bags = [sorted(set(rng.choices(clean, k=25)) | ({rng.choice(["blockhead", "scoundrel"])} if k % 2 else set())) for k in range(200)]
    m = toxicity.fit(bags, np.array([k % 2 for k in range(200)]), np.array([len(b) for b in bags]))
    score = lambda t: m.of_text(m.margins([f for w in toxicity.strings_of(t.encode()) for f in toxicity.normal_forms(w)]), len(t.split()))
    for bad in ("blockhead", "block.head", "b-l-o-c-k-h-e-a-d", "s c o u n d r e l", "scouxndrel"):
        assert score(bad) > 0.5, bad
    assert max(score(w) for w in clean[:50]) < 0.5
    assert toxicity.fit(bags, np.zeros(200, int), np.full(200, 9)).of_text(np.zeros(1), 9) < 0.01
